import json
import zipfile

from pyspark.sql import functions as F

from twinseek import __main__ as cli
from twinseek import schemas
from twinseek.sources import readers as R
from twinseek.streaming import windows


def test_profiles_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,name,core_skills,secondary_skills,soft_skills,years_of_experience,potential_roles,skill_summary\n1,Ann,"Python (Expert), SQL","Go (Competent)",NA,2.0,"Dev, ,Lead","Line one\nline ""two"""\n2,,N/A,,,,,\n')
    people, skills = R.profiles(R.csv(spark, str(tmp_path / "p.csv"), schemas.PROFILES_CSV))
    a, b = people.orderBy("raw_id").collect()
    assert a.id == "person_1" and a.potential_roles == ["Dev", "Lead"] and a.years_experience == 2.0 and 'line "two"' in a.canonical_text and a.canonical_text.startswith("Ann\nSkills: Python (Expert), SQL\n")
    assert b.name is None and b.years_experience == 0.0 and b.canonical_text.startswith("Skills:")
    assert {(s.skill_id, s.category, s.proficiency) for s in skills.collect()} == {("python", "core", 5), ("sql", "core", 1), ("go", "secondary", 3)}
    assert people.columns == [c.split()[0] for c in schemas.PROFILES.split(", ")] and skills.columns == [c.split()[0] for c in schemas.PROFILE_SKILLS.split(", ")]


def test_demands_and_zip_and_register(spark, tmp_path):
    (tmp_path / "d.csv").write_text('id,state,city,country,job_title,primary_skills,secondary_skills,experience_lower,experience_upper,designation\nD 1,,Pune,USA,,"Azure,Java,",,2,5,Engineer\n')
    jobs, skills = R.demands(R.csv(spark, str(tmp_path / "d.csv"), schemas.DEMANDS_CSV))
    j = jobs.first()
    assert (j.id, j.title, j.country, j.industry) == ("job_demand_d-1", "Engineer", "United States", None) and "Experience: 2-5 years" in j.canonical_text
    md = "## Job Title\nLead\n## Location\nPune, India\n## Detailed Responsibilities\n- build\n- run\n## Skill Requirements\n**Must Have:**\n- Java\n**Good to Have:**\n- Go\n"
    with zipfile.ZipFile(tmp_path / "jds.zip", "w") as z:
        z.writestr("10/raw_jd.txt", json.dumps({"industry": "Bank", "raw_jd": "x"}))
        z.writestr("10/enhanced_job_description.md", md)
        z.writestr("2/raw_jd.txt", b"\xff broken")
        z.writestr("2/enhanced_job_description.md", md)
        z.writestr("3/raw_jd.txt", "{}")
    members = R.zip_members(spark, str(tmp_path / "jds.zip"))
    assert [m.folder for m in members.collect()] == ["2", "3", "10"]
    jd, jd_skills = R.postings(members)
    got = {r.raw_id: r for r in jd.collect()}
    assert got.keys() == {"2", "10"} and got["10"].industry == "Bank" and got["2"].industry is None and got["10"].responsibilities == ["build", "run"] and got["10"].city == "Pune"
    assert jd.columns == jobs.columns == [c.split()[0] for c in schemas.JOBS.split(", ")]
    people, mine = R.profiles(spark.createDataFrame([(1, "A", "Java (Expert)", None, None, 1.0, None, None)], schemas.PROFILES_CSV))
    report = R.register({"profiles": people, "profile_skills": mine, "jobs": jobs.unionByName(jd), "job_skills": skills.unionByName(jd_skills)}, str(tmp_path / "out"))
    assert {r.table: r.n for r in report.collect()} == {"profiles": 1, "profile_skills": 1, "jobs": 3, "job_skills": 6, "skills": 3}
    assert {r.skill_id: r.occurrences for r in spark.read.parquet(f"{tmp_path}/out/skills").collect()}["java"] == 4


def test_trec_files_and_caches(spark, tmp_path):
    df = spark.createDataFrame([("q1", "b", 1), ("q1", "a", 2)], "qid string, doc_id string, rel int")
    R.write_qrels(df, f"{tmp_path}/qrels")
    assert {tuple(r) for r in R.qrels(spark, f"{tmp_path}/qrels").collect()} == {tuple(r) for r in df.collect()}
    run = spark.createDataFrame([("q1", f"d{i}", 1.0 / i, i) for i in range(1, 121)], "qid string, doc_id string, score double, rank int")
    R.write_run(run, f"{tmp_path}/run", "cfg")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/run").collect()]
    assert len(lines) == 100 and lines[2] == "q1 Q0 d3 3 0.333333 cfg"
    (tmp_path / "c.jsonl").write_text('{"qid":"a","text":"old"}\n\n{"qid":"a","text":"new"}\n{"qid":"b","text":"x"}\n')
    cache = R.json_lines(spark, str(tmp_path / "c.jsonl")).where("qid is not null").withColumn("n", F.monotonically_increasing_id())
    assert {(r.qid, r.text) for r in R.latest(cache, "qid", "n").collect()} == {("a", "new"), ("b", "x")}
    R.write_document(run.limit(1), f"{tmp_path}/doc", config="bm25")
    assert json.loads(spark.read.text(f"{tmp_path}/doc").first().value)["config"] == "bm25"


def test_aliases(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("# table\nPython: [py, 'Python3']\nGo:\n  - golang  # alias\n  - py\n")
    assert {tuple(r) for r in R.aliases(spark, str(tmp_path / "a.yaml")).collect()} == {("python", "Python"), ("py", "Go"), ("python3", "Python"), ("go", "Go"), ("golang", "Go")}


def test_nested_field_maps(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("# map\nversion: 2\ncolumns:\n  - { name: id, dtype: int64 }\n  - { name: n, dtype: object }\n\nfields:\n  id:\n    column: id\n    required: true\n    notes:\n      - \"low, signal\"\n  summary:\n    column: text  # long\n  city:\n    column: null\nlevels:\n  Expert: 5\nnone: []\ntemplate: |\n  {name}\n  Skills: {x}\nlast: x y\n")
    got = R.field_map(spark, str(tmp_path / "m.yaml"))
    assert got["version"] == 2 and got["columns"] == [{"name": "id", "dtype": "int64"}, {"name": "n", "dtype": "object"}] and got["levels"] == {"Expert": 5} and got["none"] == []
    assert got["fields"]["id"] == {"column": "id", "required": True, "notes": ["low, signal"]} and got["template"] == "{name}\nSkills: {x}" and got["last"] == "x y"
    assert R.columns_of(got) == {"id": "id", "summary": "text"}


def test_the_command_line_from_files_to_graph(spark, tmp_path, capsys):
    (tmp_path / "p.csv").write_text('id,name,core_skills,secondary_skills,soft_skills,years_of_experience,potential_roles,skill_summary\n1,Ann,"Python ( Expert ), SQL",,,2.0,"Dev, ,Lead",s\n2,Bob,py (Competent),,,1.0,Dev,t\n')
    (tmp_path / "d.csv").write_text("id,state,city,country,job_title,primary_skills,secondary_skills,experience_lower,experience_upper,designation\nD1,,Pune,USA,,Python,Go,2,5,Engineer\n")
    (tmp_path / "a.yaml").write_text("Python: [py]\n")
    (tmp_path / "q.jsonl").write_text('{"qid":"q1","text":"python engineer"}\n')
    md = "## Job Title\nLead\n## Skill Requirements\n**Must Have:**\n- Java\n**Good to Have:**\n- Go\n"
    with zipfile.ZipFile(tmp_path / "j.zip", "w") as z:
        z.writestr("1/enhanced_job_description.md", md)
    run = lambda *a: cli.main([str(x) for x in a])
    run("etl", "profiles", tmp_path / "p.csv", tmp_path / "x")
    run("etl", "demands", tmp_path / "d.csv", tmp_path / "x")
    run("etl", "jds", tmp_path / "j.zip", tmp_path / "y")
    run("register", tmp_path / "x", tmp_path / "y", "--out", tmp_path / "t")
    assert {r.source for r in spark.read.parquet(f"{tmp_path}/t/job_skills").collect()} == {"demand_primary", "demand_secondary", "jd_must", "jd_nice"}
    run("canonicalise", tmp_path / "t/skills", tmp_path / "a.yaml", tmp_path / "c", "--embed")
    run("kg", tmp_path / "t", tmp_path / "c", tmp_path / "g", "--wipe")
    edges = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/g/edge_has_skill").select("person_id", "skill_id", "proficiency").collect()}
    assert edges == {("person_1", "python", 5), ("person_1", "sql", 1), ("person_2", "python", 3)}
    assert spark.read.parquet(f"{tmp_path}/g/edge_can_fill").count() == 3 and spark.read.parquet(f"{tmp_path}/g/node_location").count() == 1
    for kind in ("bm25", "dense"):
        run("index", kind, tmp_path / "t/jobs", tmp_path / kind)
        run("search", kind, tmp_path / kind, tmp_path / "q.jsonl", tmp_path / f"{kind}.run")
        assert spark.read.text(f"{tmp_path}/{kind}.run").first().value.startswith("q1 Q0 job_demand_d1 1 ")
    run("inspect", tmp_path / "p.csv", "id")
    run("queries")
    assert "canonical_run" in capsys.readouterr().out


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,name\n1,a\nx,b\n")
    got = R.csv(spark, str(tmp_path / "t.csv"), "id int, name string", tolerant=True).cache().collect()
    assert [r._corrupt_record is None for r in got] == [True, False]


def test_streamed_windows_match_the_static_ones(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp'2024-01-01' + make_dt_interval(0, 0, id * 7) as ts, id % 3 as user_id, 'view' as event_type, cast(id as double) as value from range(200)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windows.tumbling(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, windows.tumbling(rows, "1 hour").collect()))
    asked = windows.search_each_batch(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), lambda b: b.select("event_id"), f"{tmp_path}/out", f"{tmp_path}/cp")
    asked.processAllAvailable()
    asked.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200
