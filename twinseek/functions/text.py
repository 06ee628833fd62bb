"""Text functions, Column to Column. All run inside the JVM but the exact NFKD slug."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schemas import PROFICIENCY

# The English stop words of the lexical channel.
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
# Country aliases, and what a query holds that asks for openings (plurals hold their singular).
COUNTRY_ALIASES = {"USA": "United States", "United States of America": "United States", "UK": "United Kingdom", "Britain": "United Kingdom"}
JOB_WORDS = ("role", "position", "opening", "vacancy", "vacancies", "job")


def service_slug(c: Column) -> Column:
    """Runs of anything but ASCII letters and digits become one hyphen; 'unknown' if nothing is left."""
    s = F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def slugify(text: str | None) -> str:
    """Slug after NFKD folding to ASCII, for one string."""
    flat = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode()
    return re.sub(r"[^A-Za-z0-9]+", "-", flat).strip("-").lower() or "unknown"


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(slugify)


def etl_slug(c: Column) -> Column:
    """Slug after NFKD folding: built-in functions for ASCII text, Arrow batches for the rest."""
    return F.when(c.rlike(r"^\p{ASCII}*$") | c.isNull(), service_slug(c)).otherwise(_nfkd(c))


def clean(c: Column) -> Column:
    """Text without white space around it, null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def split_list(c: Column) -> Column:
    """Comma-separated parts, trimmed, without empty ones; null gives an empty array."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def ordinal(label: Column) -> Column:
    out = F.when(F.lit(False), None)
    for i, name in enumerate(PROFICIENCY, 1):
        out = out.when(label == name, i)
    return out.cast("int")


def label_of(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PROFICIENCY)), n)


def proficiency_skills(c: Column) -> Column:
    """'name (Label), ...' as array<struct<name, label, ordinal>>; commas inside parentheses do not part, and a
    chunk without a known label is a Beginner's."""
    chunks = F.filter(F.transform(F.split(c, r",(?![^(]*\))"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    pattern = rf"^(.+?)\s*\(\s*({'|'.join(PROFICIENCY)})\s*\)$"

    def parse(x: Column) -> Column:
        known = x.rlike(pattern)
        label = F.when(known, F.regexp_extract(x, pattern, 2)).otherwise(PROFICIENCY[0])
        return F.struct(F.when(known, F.regexp_extract(x, pattern, 1)).otherwise(x).alias("name"), label.alias("label"), ordinal(label).alias("ordinal"))

    return F.coalesce(F.transform(chunks, parse), F.array().cast("array<struct<name:string,label:string,ordinal:int>>"))


def country(c: Column) -> Column:
    c = clean(c)
    out = F.when(F.lit(False), None)
    for k, v in COUNTRY_ALIASES.items():
        out = out.when(c == k, v)
    return out.otherwise(c)


def location(c: Column) -> tuple[Column, Column]:
    """(city, country) of 'city, rest': only the first comma parts."""
    parts = F.split(c, ",", 2)
    return clean(F.get(parts, F.lit(0))), country(F.get(parts, F.lit(1)))


def tokens(c: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores, without stop words; null gives none."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.coalesce(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), F.array().cast("array<string>"))


def snippet(c: Column, most: int = 220) -> Column:
    """One line of at most `most` characters, an ellipsis at its end if it was cut."""
    s = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^ | $", "")
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…"))).otherwise(s)


def normalise(c: Column) -> Column:
    """Dashes unified, trimmed, lower case, single spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, "[‐-―]", "-")), r"\s+", " "), "^ | $", "")


def title_case(c: Column) -> Column:
    """Words in small letters get a capital; others stay as they are."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((w == F.lower(w)) & w.rlike("[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(w)), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def wants_jobs(query: Column) -> Column:
    """Whether a query asks for openings: any of the job words inside it."""
    return F.lower(query).rlike("|".join(JOB_WORDS))


def matched_skills(query_skills: Column, text: Column, any_known: Column) -> Column:
    """Query skills that the text contains, in their order; none if no query skill is known at all."""
    found = F.filter(query_skills, lambda s: F.contains(F.lower(text), F.lower(s)))
    return F.when(any_known, found).otherwise(F.array().cast("array<string>"))


def contains_either(a: Column, b: Column) -> Column:
    """Whether one text contains the other; a must not be empty."""
    return (a != "") & (F.contains(b, a) | F.contains(a, b))


def section_map(markdown: Column) -> Column:
    """'## title' sections as a map from title to body; of equal titles the last wins."""
    text = F.regexp_replace(markdown, "\r\n?", "\n")
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n##[ \t]+", -1), lambda p: F.lit(True))
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    entry = lambda p: F.struct(F.regexp_replace(F.substring_index(p, "\n", 1), r"\s+$", "").alias("key"), F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("value"))
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(F.transform(F.array(F.transform(parts, entry)), last)[0])


def bullets(body: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(body, F.lit(r"(?m)^\s*[-*]\s+(.+?)\s*$"), F.lit(1)), F.array().cast("array<string>"))


def requirement_buckets(body: Column) -> Column:
    """Bullets under bold headers as struct<must, good, edu>. Without headers all are must; a header names its
    bucket by the words in it, other headers are left out, and of two for one bucket the later wins."""
    text = F.regexp_replace(body, "\r\n?", "\n")
    header = r"\n\*\*[^*\n]+\*\*[ \t]*:?[ \t]*(?=\n|$)"
    parts = F.split(F.concat(F.lit("\n"), text), rf"(?={header})", -1)
    named = F.filter(parts, lambda p: p.rlike(rf"^{header}"))
    of = lambda p: F.lower(F.regexp_extract(p, rf"^{header}", 0))
    under = lambda p: bullets(F.regexp_replace(p, rf"^{header}", "\n"))
    must, good = "must|required", "good|nice|preferred"
    whole = F.size(named) == 0
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(whole, bullets(text)).otherwise(F.coalesce(under(F.try_element_at(F.filter(named, lambda p: of(p).rlike(must)), F.lit(-1))), none)).alias("must"),
        F.when(whole, none).otherwise(F.coalesce(under(F.try_element_at(F.filter(named, lambda p: of(p).rlike(good) & ~of(p).rlike(must)), F.lit(-1))), none)).alias("good"),
        F.when(whole, none).otherwise(F.coalesce(under(F.try_element_at(F.filter(named, lambda p: of(p).rlike("education") & ~of(p).rlike(f"{must}|{good}")), F.lit(-1))), none)).alias("edu"),
    )


def _line(label: str, c: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("")))


def profile_text(name: Column, core: Column, secondary: Column, soft: Column, years: Column, roles: Column, summary: Column) -> Column:
    """The searchable text of a person: labelled lines, a blank name left out."""
    lines = (_line("Skills", clean(core)), _line("Secondary skills", clean(secondary)), _line("Soft skills", clean(soft)), _line("Years experience", years.cast("string")), _line("Potential roles", clean(roles)), _line("Summary", clean(summary)))
    return F.regexp_replace(F.concat_ws("\n", clean(name), *lines), r"^\s+|\s+$", "")


def demand_text(designation: Column, primary: Column, secondary: Column, city: Column, land: Column, low: Column, high: Column) -> Column:
    """The searchable text of a demand: five fixed lines."""
    place = F.concat(F.lit("Location: "), F.coalesce(city, F.lit("")), F.lit(", "), F.coalesce(land, F.lit("")))
    span = F.concat(F.lit("Experience: "), low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" years"))
    return F.regexp_replace(F.concat_ws("\n", _line("Designation", designation), _line("Primary skills", F.array_join(primary, ", ")), _line("Secondary skills", F.array_join(secondary, ", ")), place, span), r"^\s+|\s+$", "")


def posting_text(title: Column, industry: Column, place: Column, duties: Column, must: Column, good: Column, other: Column) -> Column:
    """The searchable text of a job description: labelled lines, duties as bullets."""
    bullet = F.transform(duties, lambda x: F.concat(F.lit("- "), x))
    lines = F.concat(
        F.array(_line("Title", title), _line("Industry", industry), _line("Location", place), F.lit("Responsibilities:")),
        bullet,
        F.array(_line("Must have skills", F.array_join(must, ", ")), _line("Good to have skills", F.array_join(good, ", ")), _line("Other requirements", other)),
    )
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")
