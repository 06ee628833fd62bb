from pyspark.sql import functions as F

from twinseek.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def test_slugs_differ_on_accents(spark):
    rows = {"C++ / .NET": ("c-net", "c-net"), "***": ("unknown", "unknown"), "Café": ("cafe", "caf"), "ﬁ½ß": ("fi12", "unknown"), None: ("unknown", "unknown"), "": ("unknown", "unknown")}
    df = spark.createDataFrame([(k,) for k in rows], "s string")
    for r in df.select("s", T.etl_slug(F.col("s")).alias("e"), T.service_slug(F.col("s")).alias("v")).collect():
        assert (r.e, r.v) == rows[r.s]
    again = df.select(T.service_slug(F.col("s")).alias("a"), T.service_slug(T.service_slug(F.col("s"))).alias("b")).collect()
    assert all(r.a == r.b for r in again)


def test_proficiency_skills(spark):
    parse = lambda s: [(x.name, x.label, x.ordinal) for x in one(spark, T.proficiency_skills(lit(s)))]
    assert parse("Python (Advanced Beginner), SQL (Beginner)") == [("Python", "Advanced Beginner", 2), ("SQL", "Beginner", 1)]
    assert parse("CI/CD (Jenkins, GitLab) (Competent), Go") == [("CI/CD (Jenkins, GitLab)", "Competent", 3), ("Go", "Beginner", 1)]
    assert parse("python (expert)") == [("python (expert)", "Beginner", 1)] and parse(None) == [] and parse(" , ") == []


def test_lists_and_places(spark):
    assert one(spark, T.split_list(F.lit("Azure,Azure API Management,Java,"))) == ["Azure", "Azure API Management", "Java"] and one(spark, T.split_list(lit(None))) == []
    for raw, want in {"USA": "United States", "UK": "United Kingdom", "  ": None, None: None, " India ": "India"}.items():
        assert one(spark, T.country(lit(raw))) == want
    for raw, want in {"Pune, India": ("Pune", "India"), "Pune, MH, India": ("Pune", "MH, India"), "Pune": ("Pune", None), None: (None, None)}.items():
        assert tuple(one(spark, c) for c in T.location(lit(raw))) == want


def test_requirement_buckets(spark):
    b = lambda s: one(spark, T.requirement_buckets(F.lit(s))).asDict()
    assert b("- a\n* b\n") == {"must": ["a", "b"], "good": [], "edu": []}
    text = "**Must Have:**\r\n- m1\r\n- m2\r\n**Preferred:**\r\n- g\r\n**Educational Qualifications:**\r\n- e\r\n**Certifications:**\r\n- c\r\n**Required**:\n- last"
    assert b(text) == {"must": ["last"], "good": ["g"], "edu": ["e"]}


def test_sections_last_duplicate_wins(spark):
    m = one(spark, T.section_map(F.lit("x\n## A  \nfirst\n## B\nb1\nb2\n## A\nsecond\r\n")))
    assert m == {"A": "second", "B": "b1\nb2"}


def test_snippet_and_tokens(spark):
    assert one(spark, T.snippet(F.lit("  a \n b  "))) == "a b" and len(one(spark, T.snippet(F.lit("word " * 100)))) <= 220
    assert one(spark, T.tokens(F.lit("The Café, a b2 and IT's x"))) == ["café", "b2"] and one(spark, T.tokens(lit(None))) == []
    assert one(spark, T.title_case(F.lit("java  c++ iOS DEV"))) == "Java C++ iOS DEV" and one(spark, T.normalise(F.lit(" A‐B\t c "))) == "a-b c"


def test_jaccard(spark):
    j = lambda a, b: one(spark, T.jaccard(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>")))
    assert abs(j("abc", "ab") - 2 / 3) < 1e-12 and j("", "") == 0.0 and j("ab", "bc") == j("bc", "ab")


def test_side_words(spark):
    for q, want in {"openings in Pune": True, "Java developer": False, "reposition": True, "": False}.items():
        assert one(spark, T.wants_jobs(F.lit(q))) == want
