"""PII by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Base spans follow fixed rules and always stay. Further candidates of the same kinds (mail addresses written
out, numbers with other separators or without a plus sign) and of one more, secrets (keys, tokens, passwords: long
strings of letters and digits), are voted on by regex, gazetteer and context labelers, together with the base spans. Per kind, EM over the
table of vote patterns estimates how often each labeler is right and how likely each pattern is personal
data; a logistic classifier over votes and shape features is then fitted to those likelihoods and scores
every candidate. Vote patterns are counted by Spark; the table has at most KINDS * 3^LABELERS * SHAPES rows
whatever the input. Only DataFrame functions run on the texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, running_starts

#: Kinds with base rules, and all kinds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: A candidate that is not a base span joins if the classifier is at least this sure.
CERTAIN = 0.9
CONTEXT = 48  # code points looked at on either side
EM_ROUNDS, FIT_ROUNDS = 25, 60

# Base rules. Possessive loops and look-behinds give the leftmost matches in one pass over any text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}  # without this sign a text has no match

# Further candidates.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[(]at[\])] ?)[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ ._/-])[0-9]{4}+(?:[._/ -][0-9]{4}){3}(?![ ._/-]?[0-9])",
    "phone": r"(?<![0-9+])(?<![0-9][ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![ .-]?[0-9])",
    "secret": r"(?<![A-Za-z0-9_/+.@-])(?=[A-Za-z_/+=-]*+[0-9])(?=[0-9_/+=-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+={0,2}+(?![A-Za-z0-9_@])",
}
WIDE_NEEDS = {"email": "[\\[(]", "ip": ":", "card": "[0-9]{4}[._/ -][0-9]{4}", "phone": "[0-9]{3}[ .-][0-9]{4}", "secret": "(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16}"}

# Gazetteers (top-level domains, first digits of payment cards, country calling codes, heads of keys, cue words).
TOP_LEVEL = "com org net edu gov mil int info biz io co de fr es uk eu us ca au jp cn in it nl ch"
CARD_PREFIX = "^(?:4|5[1-5]|2[2-7]|3[47]|36|38|6011|65|35)"
CALLING = "^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
KEY_HEADS = "^(?:sk[-_]|pk[-_]|rk[-_]|gh[opsu]_|glpat-|xox[abp]-|AKIA|ASIA|AIza|eyJ)"
CUES = {
    "email": "mail contact write reach address correo courriel kontakt adresse",
    "ip": "ip host server address login from client adresse serveur",
    "card": "card visa mastercard amex credit payment karte carte tarjeta",
    "phone": "phone tel call mobile fax cell telefon telefono appeler anruf",
    "secret": "token secret passwor passwd pwd api.?key access.?key private.?key key bearer auth credential",
}
COUNTER_CUES = "version release isbn issn doi order invoice license licence section chapter page build"
SECRET_COUNTER_CUES = "sha[0-9] md5 checksum digest commit revision uuid http www file path"


def found(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start, end, value>> in code points, in one pass with the same pattern."""
    long = lambda x: F.length(x).cast("long")

    def placed(values: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), long)
        steps = F.zip_with(gaps, F.concat(F.array(F.lit(0).cast("long")), F.transform(values, long)), lambda a, b: a + b)
        starts = let(steps, lambda x: F.zip_with(running_starts(x), x, lambda a, b: a + b))  # inclusive sums: where each match begins
        return F.zip_with(F.slice(starts, F.lit(1), F.size(values)), values, lambda s, v: F.struct(s.alias("start"), (s + long(v)).alias("end"), v.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


_NONE = "array<struct<start:bigint,end:bigint,value:string>>"


def passing(kind: str):
    return lambda s: valid(kind, s["value"])


def free_of(spans: Column):
    return lambda taken: F.filter(spans, lambda s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs(text) with base_<kind> and wide_<kind>, spans of each kind; wide ones overlap no base span of any kind."""
    text, none = F.coalesce("text", F.lit("")), F.array().cast(_NONE)
    out = docs
    for kind in KINDS:
        has = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9][ -]?[0-9]")
        out = out.withColumn(f"_raw_{kind}", F.when(has, found(text, BASE[kind])).otherwise(none))
        out = out.withColumn(f"base_{kind}", F.filter(f"_raw_{kind}", passing(kind))).drop(f"_raw_{kind}")
    out = out.withColumn("_taken", F.concat(*(f"base_{k}" for k in KINDS)))
    for kind in ALL_KINDS:
        spans = F.when(text.rlike(WIDE_NEEDS[kind]), found(text, WIDE[kind])).otherwise(none)
        out = out.withColumn(f"wide_{kind}", let(F.col("_taken"), free_of(spans))).withColumn("_taken", F.concat("_taken", f"wide_{kind}"))
    return out.drop("_taken")


def votes(kind: str, value: Column, before: Column, after: Column) -> tuple[Column, ...]:
    """What each labeler says of a span: 1 personal data, -1 not, 0 no opinion."""
    say = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)
    number = digits(value)
    words = lambda cues: rf"(?i)(?<![\p{{L}}])(?:{cues.replace(' ', '|')})"
    if kind == "secret":
        signs = F.size(F.array_distinct(F.split(value, "")))
        return (
            say(value.rlike(r"^(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])(?=[^0-9]*+[0-9])"), value.rlike(r"^[A-Za-z]+[-_/]?[0-9]{1,4}$|[-_/][a-z]+[-_/][a-z]+[-_/]")),
            say(value.rlike(KEY_HEADS), value.rlike(r"^(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-|[0-9-]+[A-Za-z]$)")),
            say(signs >= 11, signs <= 6),
            say(before.rlike(words(CUES[kind]) + r"[\p{L}_-]*+[\s\"'=:>(]*+$"), before.rlike(words(SECRET_COUNTER_CUES))),
            say(before.rlike(r"[=:]\s?[\"']?$|[\"'`]$"), before.rlike(r"[\p{L}0-9_/]$|[a-z]\s$")),
        )
    regex = say(value.rlike(rf"^(?:{BASE[kind]})$") & valid(kind, value), ~valid(kind, value) if kind != "email" else None)
    if kind == "email":
        gazetteer = say(F.lower(value).rlike(rf"(?:\.|dot[\])] ?)(?:{TOP_LEVEL.replace(' ', '|')})$"), ~value.rlike(r"[.\])] ?[A-Za-z]{2,}$"))
        form = say(value.rlike(r"@|[\[(]at[\])]"), value.rlike(r"\.\.|^[.]"))
    elif kind == "ip":
        gazetteer = say(~value.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\."), value.rlike(r"^(?:0\.|255\.)"))
        form = say(value.rlike(r"[0-9]{2,}"), value.rlike(r"(?:^|\.)0[0-9]"))
    elif kind == "card":
        gazetteer = say(number.rlike(CARD_PREFIX), number.rlike("^(?:0|1[^8])"))
        form = say(F.call_function("luhn_check", number), ~F.call_function("luhn_check", number))
    else:
        gazetteer = say(number.rlike(CALLING) & value.startswith("+"), number.rlike("^0{3}"))
        form = say(F.length(number).between(10, 13), ~F.length(number).between(9, 15))
    cue = say(before.rlike(words(CUES[kind])), before.rlike(words(COUNTER_CUES)))
    place = say(before.rlike(r"(?:^|[\s(<\[\"':=])$") & after.rlike(r"^(?:$|[\s)>\],;.\"'])"), before.rlike(r"[\p{L}0-9_/]$") | after.rlike(r"^[\p{L}0-9_/]"))
    return regex, gazetteer, form, cue, place


LABELERS = ("regex", "gazetteer", "form", "cue", "place")


def candidate(kind: str, origin: str):
    text = F.coalesce("text", F.lit(""))

    def of(s: Column) -> Column:
        before = F.substr(text, F.greatest(s["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(CONTEXT)).cast("int"))
        after = F.substr(text, s["end"].cast("int") + 1, F.lit(CONTEXT))
        shape = F.concat(F.least(F.floor(F.length(s["value"]) / 8), F.lit(3)).cast("string"), F.when(s["value"].rlike(r"[ \[(]"), "s").otherwise("-"))
        said = F.concat_ws(",", *(v.cast("string") for v in votes(kind, s["value"], before, after)))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(origin == "base").alias("base"), said.alias("votes"), shape.alias("shape"))

    return of


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs(text) with candidates: array of (kind, start, end, base, votes as text, shape as text)."""
    origins = [(origin, kind) for kind in ALL_KINDS for origin in ("base", "wide") if origin == "wide" or kind in KINDS]
    parts = [F.transform(f"{origin}_{kind}", candidate(kind, origin)) for origin, kind in origins]
    return with_spans(docs).withColumn("candidates", F.concat(*parts)).drop(*(f"{origin}_{kind}" for origin, kind in origins))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[list[float], list[tuple[dict[int, float], dict[int, float]]]]:
    """EM of the two-class labeler model over (votes, count): the likelihood of each pattern, and per labeler
    the shares of votes on personal data and on other spans. Starts from the majority vote; one pseudo-count
    leans to labelers being right."""
    belief = [sigmoid(1.5 * sum(v)) for v, _ in patterns]
    rates: list[tuple[dict[int, float], dict[int, float]]] = []
    for _ in range(EM_ROUNDS):
        total = sum(n for _, n in patterns)
        prior = (sum(b * n for b, (_, n) in zip(belief, patterns)) + 1) / (total + 2)
        rates = []
        for k in range(len(LABELERS)):
            yes, no = {1: 3.0, 0: 2.0, -1: 1.0}, {1: 1.0, 0: 2.0, -1: 3.0}
            for b, (v, n) in zip(belief, patterns):
                yes[v[k]] += b * n
                no[v[k]] += (1 - b) * n
            rates.append(({v: x / sum(yes.values()) for v, x in yes.items()}, {v: x / sum(no.values()) for v, x in no.items()}))
        belief = [sigmoid(math.log(prior / (1 - prior)) + sum(math.log(rates[k][0][x] / rates[k][1][x]) for k, x in enumerate(v))) for v, _ in patterns]
    return belief, rates


def inputs(votes_: tuple[int, ...], shape: str) -> list[float]:
    return [1.0, *map(float, votes_), float(shape[0]) / 3, float(shape[1] == "s")]


def fit(rows: list[tuple[tuple[int, ...], str, int, float]]) -> list[float]:
    """Weights of a ridge logistic regression on soft labels, by gradient steps over (votes, shape, count, likelihood)."""
    w, total = [0.0] * (len(LABELERS) + 3), sum(n for _, _, n, _ in rows)
    for _ in range(FIT_ROUNDS):
        grad, curve = [0.1 * x / max(1, total) for x in w], [0.1 / max(1, total) + 1e-6] * len(w)
        for v, shape, n, y in rows:
            x = inputs(v, shape)
            p = sigmoid(sum(a * b for a, b in zip(w, x)))
            for k, xk in enumerate(x):
                grad[k] += (p - y) * xk * n / total
                curve[k] += p * (1 - p) * xk * xk * n / total
        w = [max(-8.0, min(8.0, a - 0.5 * g / (c + 0.02))) for a, g, c in zip(w, grad, curve)]
    return w


def learn(candidates: DataFrame) -> dict[str, list[float]]:
    """The span classifier's weights by kind, from the vote patterns of all candidates; a kind without candidates has none."""
    each = candidates.select(F.explode_outer("candidates").alias("c")).where("c is not null")
    counted: dict[str, list[tuple[tuple[int, ...], str, int]]] = {}
    for r in each.groupBy("c.kind", "c.votes", "c.shape").count().collect():
        counted.setdefault(r.kind, []).append((tuple(map(int, r.votes.split(","))), r.shape, r["count"]))
    out = {}
    for kind, rows in counted.items():
        rows.sort()
        merged: dict[tuple[int, ...], int] = {}
        for v, _, n in rows:
            merged[v] = merged.get(v, 0) + n
        belief = dict(zip(merged, estimate(list(merged.items()))[0]))
        out[kind] = fit([(v, shape, n, belief[v]) for v, shape, n in rows])
    return out


def detect(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs(text, ...) with base and spans, arrays of (kind, start, end, score) by kind as listed and start.

    base holds the spans of the fixed rules; spans holds these and the candidates the classifier is CERTAIN
    of. Positions are code points, end exclusive. Null texts are empty and have no spans. All rows stay, and
    rows that repeat are judged alike. The classifier is learned from all rows of docs. Texts are searched once:
    rows with their candidates, and without the text unless keep_text, are an intermediate table.
    """
    seen = with_candidates(docs)
    seen = Scratch(docs.sparkSession).keep(seen if keep_text else seen.drop("text"))
    weights = learn(seen)

    def sure(c: Column) -> Column:
        vote = F.split(c["votes"], ",")
        x = [F.lit(1.0), *(vote[k].cast("double") for k in range(len(LABELERS))), F.substr(c["shape"], F.lit(1), F.lit(1)).cast("double") / 3, (F.substr(c["shape"], F.lit(2), F.lit(1)) == "s").cast("double")]
        out = F.lit(0.0)
        for kind, w in sorted(weights.items()):
            out = F.when(c["kind"] == kind, 1 / (1 + F.exp(-sum((a * b for a, b in zip(map(F.lit, w), x)), F.lit(0.0))))).otherwise(out)
        return out

    scored = F.transform("candidates", lambda c: F.struct(F.array_position(F.array(*map(F.lit, ALL_KINDS)), c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"), F.when(c["base"], 1.0).otherwise(sure(c)).alias("score")))
    out = seen.withColumn("_scored", F.sort_array(scored)).drop("candidates")
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"))
    return out.withColumns(
        {"base": F.transform(F.filter("_scored", lambda x: x["base"]), plain), "spans": F.transform(F.filter("_scored", lambda x: x["base"] | (x["score"] >= CERTAIN)), plain)}
    ).drop("_scored")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs(text, spans) with every span of text replaced by [KIND]. Where spans overlap, as a number that is
    also part of another, the earlier (then longer) one is named and the rest of the later one goes too."""
    text = F.coalesce("text", F.lit(""))
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= a["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(a["at"], -s["back"]).alias("at"), F.concat(a["out"], gap, mark).alias("out"))

    done = F.aggregate(ordered, state, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), F.length(text))))
    return docs.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(F.col("text")))
