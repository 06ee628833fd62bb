"""python -m twinseek queries | run | etl | inspect | register | index | search | canonicalise | kg"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import schemas
from .functions import text as T
from .operators import canonical, graph, introspect, lexical, vector
from .session import session
from .sources import readers as R


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="twinseek", description=__doc__)
    todo = parser.add_subparsers(dest="todo", required=True)
    todo.add_parser("queries", help="names of the registered queries")
    run = todo.add_parser("run", help="one query over a folder of tables")
    run.add_argument("name")
    run.add_argument("dir")
    run.add_argument("out", nargs="?")
    etl = todo.add_parser("etl", help="raw files to tables")
    etl.add_argument("kind", choices=("profiles", "demands", "jds"))
    etl.add_argument("source")
    etl.add_argument("out")
    look = todo.add_parser("inspect", help="columns of a CSV: their profile and how well each fits each field")
    look.add_argument("source")
    look.add_argument("key", help="a column that orders the rows")
    reg = todo.add_parser("register", help="folders of etl to one folder of tables, with the skill catalog")
    reg.add_argument("dirs", nargs="+")
    reg.add_argument("--out", required=True)
    index = todo.add_parser("index", help="a saved index over a table of (id, canonical_text)")
    index.add_argument("kind", choices=("bm25", "dense"))
    index.add_argument("source")
    index.add_argument("out")
    find = todo.add_parser("search", help="a run file of a saved index for a JSON-lines file of queries")
    find.add_argument("kind", choices=("bm25", "dense"))
    find.add_argument("index")
    find.add_argument("queries")
    find.add_argument("out")
    canon = todo.add_parser("canonicalise", help="a skill catalog to canonical skills")
    canon.add_argument("skills")
    canon.add_argument("aliases", help="YAML of aliases")
    canon.add_argument("out")
    canon.add_argument("--labels", help="a table of (title, uri)")
    canon.add_argument("--embed", action="store_true", help="cluster what is left by vectors")
    kg = todo.add_parser("kg", help="registered tables and canonical skills to node and edge tables")
    kg.add_argument("dir")
    kg.add_argument("canonical")
    kg.add_argument("out")
    kg.add_argument("--wipe", action="store_true")
    args = parser.parse_args(argv)
    if args.todo == "queries":
        from .plans import catalog

        print(*catalog.queries(), sep="\n")
        return
    {"run": _run, "etl": _etl, "inspect": _inspect, "register": _register, "index": _index, "search": _search, "canonicalise": _canonicalise, "kg": _kg}[args.todo](session(), args)


def _run(spark, args) -> None:
    from .plans import catalog

    df = catalog.queries()[args.name](spark, args.dir)
    df.write.mode("overwrite").parquet(args.out) if args.out else df.show(20, False)


def _etl(spark, args) -> None:
    left, right = {
        "profiles": lambda: R.profiles(R.csv(spark, args.source, schemas.PROFILES_CSV)),
        "demands": lambda: R.demands(R.csv(spark, args.source, schemas.DEMANDS_CSV)),
        "jds": lambda: R.postings(R.zip_members(spark, args.source)),
    }[args.kind]()
    left.write.mode("overwrite").parquet(f"{args.out}/{args.kind}")
    right.write.mode("overwrite").parquet(f"{args.out}/{args.kind}_skills")


def _inspect(spark, args) -> None:
    raw = spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(args.source)
    introspect.profile(raw).show(200, 40)
    introspect.scores(raw, args.key).orderBy("column", "field").show(2000, False)


def _register(spark, args) -> None:
    """Demands and descriptions are one table of jobs."""
    there = spark._jvm.org.apache.hadoop.fs.Path
    found: dict[str, list] = {}
    for d in args.dirs:
        for kind, name in (("profiles", "profiles"), ("profiles_skills", "profile_skills"), ("demands", "jobs"), ("jds", "jobs"), ("demands_skills", "job_skills"), ("jds_skills", "job_skills")):
            path = there(f"{d}/{kind}")
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                found.setdefault(name, []).append(spark.read.parquet(f"{d}/{kind}"))
    R.register({name: canonical.layers(*dfs) for name, dfs in found.items()}, args.out).show(20, False)


def _index(spark, args) -> None:
    texts = spark.read.parquet(args.source).select(F.col("id").alias("doc_id"), F.col("canonical_text").alias("text"))
    if args.kind == "bm25":
        lexical.build(texts).save(args.out)
    else:
        vector.save(texts.select("doc_id", vector.hash_encode(F.col("text")).alias("vec")), args.out)


def _search(spark, args) -> None:
    asked = R.json_lines(spark, args.queries).select("qid", "text")
    if args.kind == "bm25":
        run = lexical.search(lexical.load(spark, args.index), asked)
    else:
        run = vector.search(vector.load(spark, args.index), asked.select("qid", vector.hash_encode(F.col("text")).alias("vec")))
    R.write_run(run, args.out, args.kind)


def _canonicalise(spark, args) -> None:
    skills = spark.read.parquet(args.skills).select(F.col("skill_id").alias("legacy_id"), F.col("skill_name").alias("raw_name"), "occurrences")
    labels = spark.read.parquet(args.labels) if args.labels else None
    canonical.run(skills, R.aliases(spark, args.aliases), labels, vector.hash_encode if args.embed else None).write.mode("overwrite").parquet(args.out)
    canonical.stats(spark.read.parquet(args.out)).show(1, False)


def _kg(spark, args) -> None:
    if args.wipe:
        graph.wipe(spark, args.out)
    tables = (spark.read.parquet(f"{args.dir}/{t}") for t in ("profiles", "profile_skills", "jobs", "job_skills"))
    made = graph.build(*tables, spark.read.parquet(args.canonical), T.service_slug)
    graph.write(made, args.out)
    graph.counts({name: spark.read.parquet(f"{args.out}/{name}") for name in made}).show(20, False)


if __name__ == "__main__":
    main()
