"""Sources and sinks: CSV, zipped descriptions, JSON lines, TREC files, YAML tables, parquet artifacts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators.graph import counts

# What counts as a missing value in a CSV file.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def csv(spark: SparkSession, path: str, ddl: str, tolerant: bool = False) -> DataFrame:
    """A CSV with header and quoted line breaks in a fixed schema; missing-value words become null. With tolerant,
    rows that do not parse stay and carry their text in _corrupt_record."""
    ddl_ = f"{ddl}, _corrupt_record string" if tolerant else ddl
    reader = spark.read.schema(ddl_).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True)
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("nullValue", "").csv(path)
    strings = {c: F.when(F.col(c).isin(*MISSING), None).otherwise(F.col(c)) for c, t in df.dtypes if t == "string" and c != "_corrupt_record"}
    return df.withColumns(strings) if strings else df


def profiles(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, profile_skills) of the raw people rows."""
    person = F.concat(F.lit("person_"), F.col("id").cast("string"))
    years = F.coalesce("years_of_experience", F.lit(0.0))
    people = raw.select(
        person.alias("id"), F.col("id").alias("raw_id"), T.clean(F.col("name")).alias("name"), years.alias("years_experience"), T.split_list(F.col("potential_roles")).alias("potential_roles"), T.clean(F.col("skill_summary")).alias("skill_summary"),
        T.profile_text(F.col("name"), F.col("core_skills"), F.col("secondary_skills"), F.col("soft_skills"), years, F.col("potential_roles"), F.col("skill_summary")).alias("canonical_text"),
    )
    tagged = F.flatten(F.array(*(F.transform(T.proficiency_skills(F.col(f"{c}_skills")), _tag(c)) for c in ("core", "secondary", "soft"))))
    each = raw.select(person.alias("person_id"), F.explode(tagged).alias("s"))
    skills = each.select(
        "person_id", T.etl_slug(F.col("s.name")).alias("skill_id"), F.col("s.name").alias("skill_name"), "s.category", F.col("s.label").alias("proficiency_label"), F.col("s.ordinal").alias("proficiency"), F.lit("resume").alias("source")
    )
    return people, skills


def _tag(category: str):
    return lambda s: F.struct(s["name"].alias("name"), s["label"].alias("label"), s["ordinal"].alias("ordinal"), F.lit(category).alias("category"))


def demands(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, job_skills) of the raw demand rows."""
    job = F.concat(F.lit("job_demand_"), T.etl_slug(F.trim("id")))
    base = raw.select(
        job.alias("id"), F.trim("id").alias("raw_id"), T.clean(F.col("designation")).alias("designation"), T.clean(F.col("job_title")).alias("t"), T.clean(F.col("city")).alias("city"), T.country(F.col("country")).alias("country"),
        F.coalesce("experience_lower", F.lit(0)).alias("experience_lower"), F.coalesce("experience_upper", F.lit(0)).alias("experience_upper"), T.split_list(F.col("primary_skills")).alias("p"), T.split_list(F.col("secondary_skills")).alias("s"),
    )
    none = F.array().cast("array<string>")
    text = T.demand_text(F.col("designation"), F.col("p"), F.col("s"), F.col("city"), F.col("country"), F.col("experience_lower"), F.col("experience_upper"))
    jobs = base.select(
        "id", F.lit("demands_csv").alias("source"), "raw_id", F.coalesce("t", "designation").alias("title"), "designation", F.lit(None).cast("string").alias("industry"), "city", "country", "experience_lower", "experience_upper",
        none.alias("responsibilities"), none.alias("educational_qualifications"), *(F.lit(None).cast("string").alias(c) for c in ("other_requirements", "raw_text", "enhanced_text")), text.alias("canonical_text"),
    )
    return jobs, _job_skills(base, (("p", "must_have", "primary", "demand_primary"), ("s", "good_to_have", "secondary", "demand_secondary")))


def _job_skills(base: DataFrame, lists) -> DataFrame:
    parts = [base.select(F.col("id").alias("job_id"), F.explode(c).alias("skill_name"), F.lit(pr).alias("priority"), F.lit(cat).alias("category"), F.lit(src).alias("source")) for c, pr, cat, src in lists]
    return parts[0].union(parts[1]).select("job_id", T.etl_slug(F.col("skill_name")).alias("skill_id"), "skill_name", "priority", "category", "source")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(folder, raw, enhanced) of an archive of {folder}/raw_jd.txt and {folder}/enhanced_job_description.md, one row
    per folder in numeric order of its name; bytes that are not UTF-8 are replaced. Archives are read one per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = set(z.namelist())
                    text = lambda n, names=names, z=z: z.read(n).decode("utf-8", "replace") if n in names else None
                    folders = sorted({n.split("/")[0] for n in names if "/" in n}, key=lambda f: (int(f) if f.isdigit() else 0, f))
                    yield pd.DataFrame([(f, text(f"{f}/raw_jd.txt"), text(f"{f}/enhanced_job_description.md")) for f in folders], columns=["folder", "raw", "enhanced"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "folder string, raw string, enhanced string")


def postings(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, job_skills) of zip_members(); folders without the markdown are left out, a broken raw file is empty."""
    raw = F.from_json(F.coalesce("raw", F.lit("{}")), "industry string, raw_jd string", {"mode": "PERMISSIVE"})
    m = members.where("enhanced is not null").select("folder", "enhanced", T.section_map(F.col("enhanced")).alias("m"), raw.alias("r"))
    get = lambda k: T.clean(F.col("m")[k])
    need = T.requirement_buckets(F.coalesce(get("Skill Requirements"), F.lit("")))
    city, land = T.location(get("Location"))
    base = m.select(
        F.concat(F.lit("job_jd_"), "folder").alias("id"), F.col("folder").alias("raw_id"), get("Job Title").alias("title"), F.coalesce(get("Client Industry"), T.clean(F.col("r.industry"))).alias("industry"), city.alias("city"), land.alias("country"),
        get("Location").alias("place"), T.bullets(F.coalesce(get("Detailed Responsibilities"), F.lit(""))).alias("duties"), need.alias("need"), get("Other Requirements").alias("other_requirements"), F.col("r.raw_jd").alias("raw_text"), F.col("enhanced").alias("enhanced_text"),
    ).withColumns({"p": F.col("need.must"), "s": F.col("need.good")})
    jobs = base.select(
        "id", F.lit("jd_zip").alias("source"), "raw_id", "title", F.col("title").alias("designation"), "industry", "city", "country", F.lit(0).alias("experience_lower"), F.lit(0).alias("experience_upper"), F.col("duties").alias("responsibilities"),
        F.col("need.edu").alias("educational_qualifications"), "other_requirements", "raw_text", "enhanced_text", T.posting_text(F.col("title"), F.col("industry"), F.col("place"), F.col("duties"), F.col("p"), F.col("s"), F.col("other_requirements")).alias("canonical_text"),
    )
    return jobs, _job_skills(base, (("p", "must_have", "must_have", "jd_must"), ("s", "good_to_have", "good_to_have", "jd_nice")))


def register(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes the tables and the skill catalog over both sides; returns (table, n)."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    out = {name: spark.read.parquet(f"{path}/{name}") for name in tables}
    both = out["profile_skills"].select("skill_id", "skill_name").union(out["job_skills"].select("skill_id", "skill_name"))
    both.groupBy("skill_id").agg(F.min("skill_name").alias("skill_name"), F.count("*").alias("occurrences")).write.mode("overwrite").parquet(f"{path}/skills")
    return counts(out | {"skills": spark.read.parquet(f"{path}/skills")})


def json_lines(spark: SparkSession, path: str, ddl: str = schemas.QUERIES) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def latest(cache: DataFrame, key: str, order: str) -> DataFrame:
    """An append-only cache: of equal keys the last line wins."""
    return cache.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) of 'qid 0 doc_id rel' lines."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(p[0].alias("qid"), p[2].alias("doc_id"), p[3].cast("int").alias("rel"))


def write_qrels(df: DataFrame, path: str) -> None:
    df.orderBy("qid", "doc_id").select(F.concat_ws(" ", "qid", F.lit("0"), "doc_id", F.col("rel").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_run(df: DataFrame, path: str, name: str, k: int = 100) -> None:
    """The first k of every query as 'qid Q0 doc rank score name' lines."""
    line = F.concat_ws(" ", "qid", F.lit("Q0"), "doc_id", F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit(name))
    df.where(F.col("rank") <= k).orderBy("qid", "rank").select(line.alias("value")).write.mode("overwrite").text(path)


def write_document(rows: DataFrame, path: str, **parameters) -> None:
    """A run document: parameters and metric rows as one JSON object per row."""
    rows.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in parameters.items()), F.struct(*rows.columns).alias("metrics"))).alias("value")).write.mode("overwrite").text(path)


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical_name) of a YAML file 'canonical: [alias, ...]' or of lists under it; a canonical name is an
    alias of itself, later entries win. The table is one the user writes by hand, so it is parsed on the driver."""
    lines = [r.value for r in spark.read.text(path).collect()]
    table: dict[str, str] = {}
    name = None
    for line in lines:
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if m := re.match(r"^\s*-\s+(.+)$", line):
            if name:
                table[_norm(m[1])] = name
        elif m := re.match(r"^(\S.*?):\s*(\[(.*)\])?\s*$", line):
            name = m[1].strip("\"' ")
            table[_norm(name)] = name
            for a in (m[3] or "").split(","):
                if a.strip():
                    table[_norm(a)] = name
    return spark.createDataFrame(sorted(table.items()), "alias string, canonical_name string")


def _norm(s: str) -> str:
    return " ".join(s.strip().strip("\"'").lower().split())


def field_map(spark: SparkSession, path: str) -> dict:
    """A field map: nested 'key: value' mappings by indentation, lists of values or of mappings, and mappings in
    braces; a missing file raises. It is a file the user writes by hand, so it is parsed on the driver."""
    lines = []
    for r in spark.read.text(path).collect():
        line = re.sub(r"(^|\s)#.*$", "", r.value).rstrip()
        if line.strip() not in ("", "---"):
            lines.append((len(line) - len(line.lstrip()), line.strip()))
    return _block(lines, 0, 0)[0] if lines else {}


def columns_of(fields: dict) -> dict[str, str]:
    """The column of each canonical field that has one."""
    return {name: f["column"] for name, f in (fields.get("fields") or {}).items() if isinstance(f, dict) and f.get("column")}


def _value(text: str):
    text = text.strip()
    if text[:1] == "{":
        return {k.strip(): _value(v) for k, _, v in (x.partition(":") for x in text.strip("{} ").split(",")) if k.strip()}
    if text[:1] == "[":
        return [_value(x) for x in text.strip("[] ").split(",") if x.strip()]
    if text[:1] in ("'", '"'):
        return text[1:-1]
    plain = {"": None, "null": None, "~": None, "true": True, "false": False}
    return plain[text] if text in plain else int(text) if re.fullmatch(r"-?\d+", text) else text


def _block(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[dict | list, int]:
    """(the mapping or list that begins at a line, the line after it)."""
    out: dict | list = [] if lines[at][1].startswith("- ") else {}
    while at < len(lines) and lines[at][0] >= indent:
        text = lines[at][1]
        at += 1
        if isinstance(out, list):
            if not text.startswith("- "):
                return out, at - 1
            out.append(_value(text[2:]))
            continue
        key, _, rest = text.partition(":")
        if rest.strip() in ("|", ">"):
            held = []
            while at < len(lines) and lines[at][0] > indent:
                held.append(lines[at][1])
                at += 1
            out[key.strip("\"' ")] = "\n".join(held)
        elif rest.strip() or at >= len(lines) or lines[at][0] < indent or (lines[at][0] == indent and not lines[at][1].startswith("- ")):
            out[key.strip("\"' ")] = _value(rest)
        else:
            out[key.strip("\"' ")], at = _block(lines, at, lines[at][0])
    return out, at
