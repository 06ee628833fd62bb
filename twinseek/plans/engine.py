"""The engine: modes, batched search, events, details, health."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, graph, lexical, metrics, vector
from ..session import durable

BUDGET, HEAD, MOST = 100, 25, 100
MODES = ("bm25", "dense", "rrf", "rrf3", "rrf3_rerank")
SIDES = ("candidates", "jobs")
SHORTEST, LONGEST = 2, 1000


@dataclass
class Side:
    """What one side is searched through: index, vectors(doc_id, vec), edges, and texts(doc_id, kind, text, snippet, title)."""

    index: lexical.Index
    vectors: DataFrame
    edges: DataFrame
    texts: DataFrame


@dataclass
class Engine:
    candidates: Side
    jobs: Side
    canonical: DataFrame  # (legacy_id, canonical_id)
    profiles: DataFrame | None = None
    profile_skills: DataFrame | None = None
    postings: DataFrame | None = None
    job_skills: DataFrame | None = None
    encode: object = vector.hash_encode
    scorer: fusion.Scorer = fusion.overlap_scorer
    #: A classifier: queries(qid, text, ...) to the same with side and query_skills, null where it has no answer.
    classify: Callable[[DataFrame], DataFrame] | None = None

    def intent(self, queries: DataFrame) -> DataFrame:
        """queries(qid, text, side?, query_skills?) with the side they ask for: that given, else the classifier's, else
        that of the words. A classifier that fails gives way to the words; given skills win over its own."""
        given = [c for c in ("side", "query_skills") if c in queries.columns]
        if self.classify is not None:
            asked = queries.select(*(F.col(c).alias(f"_{c}") if c in given else F.col(c) for c in queries.columns))
            try:
                queries = durable(self.classify(asked))
            except Exception:  # noqa: BLE001  any classifier's failure
                queries = asked
            for c in given:
                queries = queries.withColumn(c, F.coalesce(f"_{c}", c) if c in queries.columns else F.col(f"_{c}")).drop(f"_{c}")
        side = F.when(T.wants_jobs(F.col("text")), "jobs").otherwise("candidates")
        asked = F.col("side") if "side" in queries.columns else F.lit(None).cast("string")
        skills = F.col("query_skills") if "query_skills" in queries.columns else F.array().cast("array<string>")
        return queries.withColumns({"side": F.coalesce(asked, side), "query_skills": F.coalesce(skills, F.array().cast("array<string>")), "free_text": F.trim("text")})

    def _encoded(self, queries: DataFrame) -> DataFrame:
        return queries.select("qid", self.encode(F.col("free_text")).alias("vec"))

    def _channel_runs(self, side: str, queries: DataFrame, mode: str, only: tuple[str, ...] | None = None, encoded: DataFrame | None = None) -> dict[str, DataFrame]:
        s, used = getattr(self, side), only or fusion.MODES[mode]
        runs = {}
        if "bm25" in used:
            runs["bm25"] = lexical.search(s.index, queries.select("qid", F.col("free_text").alias("text")), BUDGET)
        if "dense" in used:
            runs["dense"] = vector.search(s.vectors, self._encoded(queries) if encoded is None else encoded, BUDGET)
        if "kg" in used:
            ids = graph.query_skill_ids(queries, self.canonical, T.service_slug)
            runs["kg"] = (graph.persons if side == "candidates" else graph.jobs)(ids, s.edges, BUDGET)
        return runs

    @staticmethod
    def check(side: str, mode: str, top_k: int, queries: DataFrame | None = None) -> None:
        if mode not in MODES or side not in SIDES or not 1 <= top_k <= MOST:
            raise ValueError(f"mode of {MODES}, side of {SIDES} and top_k of 1..{MOST} expected")
        if queries is not None and not queries.where(~F.coalesce(F.length("text"), F.lit(0)).between(SHORTEST, LONGEST)).isEmpty():
            raise ValueError(f"a query has {SHORTEST} to {LONGEST} characters")

    def search_many(self, queries: DataFrame, side: str, mode: str = "rrf3_rerank", top_k: int = 10) -> DataFrame:
        """Results of queries(qid, text, query_skills?) on a side: rank, score, entity and stage scores."""
        self.check(side, mode, top_k, queries)
        asked = self.intent(queries)
        ranked = fusion.fuse(mode, self._channel_runs(side, asked, mode), BUDGET)
        return self._results(self._reranked(ranked, asked, side) if mode == "rrf3_rerank" else ranked, asked, side, top_k)

    def _reranked(self, ranked: DataFrame, asked: DataFrame, side: str) -> DataFrame:
        return fusion.rerank(ranked, asked.select("qid", F.col("free_text").alias("text")), getattr(self, side).texts.select("doc_id", "text"), HEAD, self.scorer)

    def _results(self, ranked: DataFrame, asked: DataFrame, side: str, top_k: int) -> DataFrame:
        s = getattr(self, side)
        found = fusion.results(ranked, s.texts.select("doc_id", "kind", "title", "snippet", F.col("text").alias("_text")), top_k)
        known = graph.query_skill_ids(asked, self.canonical, T.service_slug).select("qid").distinct().withColumn("_known", F.lit(True))
        found = found.join(asked.select("qid", "query_skills"), "qid").join(known, "qid", "left")
        rerank: Column = F.col("rerank") if "rerank" in found.columns else F.lit(None).cast("double")
        return found.select(
            "qid", "rank", "score", "n_candidates",
            F.struct("doc_id", "kind", "title", "snippet", T.matched_skills(F.col("query_skills"), F.coalesce("_text", F.lit("")), F.coalesce("_known", F.lit(False))).alias("matched_skills")).alias("entity"),
            F.struct(F.col("bm25_score").alias("bm25"), F.col("dense_score").alias("dense"), F.col("kg_score").alias("kg"), F.col("fused").alias("rrf"), rerank.alias("rerank")).alias("stage_scores"),
        )

    def search(self, query: str, side: str | None = None, mode: str = "rrf3_rerank", top_k: int = 10, query_skills: list[str] | None = None) -> list[dict]:
        """Results of one query of 2 to 1000 characters, best first."""
        one = self._one(query, side, query_skills)
        return [r.asDict(recursive=True) for r in self.search_many(one, self.intent(one).first().side, mode, top_k).orderBy("rank").collect()]

    def _one(self, query: str, side: str | None, query_skills: list[str] | None) -> DataFrame:
        if not SHORTEST <= len(query) <= LONGEST:
            raise ValueError(f"a query has {SHORTEST} to {LONGEST} characters")
        return self.canonical.sparkSession.createDataFrame([("q", query, side, query_skills)], "qid string, text string, side string, query_skills array<string>")

    def search_events(self, query: str, side: str | None = None, mode: str = "rrf3_rerank", top_k: int = 10, query_skills: list[str] | None = None) -> Iterator[dict]:
        """The events of a search: intent, start, each stage with its own time, results, done; an error ends it. A
        stage is run and written before the next one begins, so its time is its own."""
        began = time.time()
        try:
            asked = durable(self.intent(self._one(query, side, query_skills)))
            told = asked.first()
            self.check(told.side, mode, top_k)
            yield {"type": "intent", "query": query, "side": told.side, "query_skills": told.query_skills}
            yield {"type": "stage_start", "stage": "all"}
            runs, held = {}, {}

            def timed(stage: str, df: DataFrame) -> dict:
                start = time.time()
                held[stage] = durable(df)
                return {"type": "stage_done", "stage": stage, "elapsed_ms": 1000 * (time.time() - start)}

            used = fusion.MODES[mode]
            if "dense" in used:
                yield timed("encode", self._encoded(asked))
            for channel in used:
                yield timed(channel, self._channel_runs(told.side, asked, mode, (channel,), held.get("encode"))[channel])
                runs[channel] = held[channel]
            ranked = fusion.fuse(mode, runs, BUDGET)
            if len(used) > 1:
                yield timed("rrf", ranked)
                ranked = held["rrf"]
            if mode == "rrf3_rerank":
                yield timed("rerank", self._reranked(ranked, asked, told.side))
                ranked = held["rerank"]
            found = [r.asDict(recursive=True) for r in self._results(ranked, asked, told.side, top_k).orderBy("rank").collect()]
        except Exception as e:  # noqa: BLE001  the caller gets it as an event
            yield {"type": "error", "message": str(e)[:300]}
            return
        yield {"type": "results", "n_candidates": found[0]["n_candidates"] if found else 0, "results": found}
        yield {"type": "done", "elapsed_ms": 1000 * (time.time() - began)}

    def eval_summary(self, queries: DataFrame, qrels: DataFrame, side: str, modes: tuple[str, ...] = MODES) -> DataFrame:
        """(config, stratum, n, metrics, is_best) of each mode over queries(qid, text, task, stratum?, query_skills?)
        judged by qrels(qid, doc_id, rel), overall and per stratum."""
        key = lambda df, mode: df.withColumn("qid", F.concat(F.lit(f"{mode}/"), "qid"))
        run = rels = None
        for mode in modes:
            found = key(self.search_many(queries, side, mode, MOST).select("qid", F.col("entity.doc_id").alias("doc_id"), "rank"), mode)
            run, rels = (found, key(qrels, mode)) if run is None else (run.union(found), rels.union(key(qrels, mode)))
        panel = metrics.per_query(run, rels).select(F.substring_index("qid", "/", 1).alias("config"), F.substring_index("qid", "/", -1).alias("qid"), *metrics.PANEL)
        stratum = F.coalesce("stratum", F.lit("original")) if "stratum" in queries.columns else F.lit("original")
        strata = queries.select("qid", F.explode(F.array(F.lit("overall"), stratum)).alias("stratum"))
        rows = panel.join(strata, "qid").groupBy("config", "stratum").agg(F.count("*").alias("n"), *metrics.means(None))
        return metrics.best_per(rows, "stratum", "ndcg_10", "config")

    def profile(self, id_: str) -> dict | None:
        return self._detail(self.profiles, self.profile_skills, "person_id", id_, [F.col("proficiency").desc(), "skill_name"])

    def job(self, id_: str) -> dict | None:
        return self._detail(self.postings, self.job_skills, "job_id", id_, ["priority", "skill_name"])

    @staticmethod
    def _detail(entities: DataFrame, skills: DataFrame, key: str, id_: str, order: list) -> dict | None:
        row = entities.where(F.col("id") == id_).first()
        return None if row is None else row.asDict(recursive=True) | {"skills": [s.asDict() for s in skills.where(F.col(key) == id_).orderBy(*order).collect()]}

    def health(self) -> dict:
        return {"candidates": self.candidates.index.n, "jobs": self.jobs.index.n, "skills": self.canonical.select("canonical_id").distinct().count()}
