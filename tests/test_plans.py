"""What the plans of the larger queries must not do: sort or widen rows before they are counted, or work twice."""

import os
import re

import pytest

from twinseek.operators import evalset, lexical
from twinseek.plans import catalog, views

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plan(spark, name):
    return catalog.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_column_profile_does_not_widen_rows(spark):
    assert "Expand" not in plan(spark, "column_profile")


def test_skill_catalog_counts_names_before_it_sorts(spark):
    assert re.search(r"HashAggregate\(keys=\[skill_id#\d+, skill_name#\d+\], functions=\[partial_count", plan(spark, "skill_catalog"))


def test_graph_4way_deals_pairs_before_it_counts(spark):
    assert re.search(r"hashpartitioning\(o_orderkey#\d+L?, \d+\), REPARTITION_BY_COL", plan(spark, "graph_4way"))


def test_edges_are_dealt_and_merged_as_numbers(spark):
    for name, merged in (("detail_order", r"keys=\[person#\d+L, skill#\d+L, kind#\d+\]"), ("kg_job_topk", r"keys=\[job#\d+L, skill#\d+L, must#\d+\]")):
        assert re.search(merged, plan(spark, name))


def test_profile_detail_merges_edges_of_its_people_only(spark):
    assert "LeftSemi" in plan(spark, "profile_detail")


def test_hash_encode_encodes_once(spark):
    assert plan(spark, "hash_encode").count("md5(") == 1


def test_index_for_queries_keeps_their_terms_only(spark, monkeypatch):
    written, durable = [], lexical.durable
    monkeypatch.setattr(lexical, "durable", lambda df: (y := durable(df), written.append(y))[0])
    docs = spark.createDataFrame([("d1", "red apple red"), ("d2", "green apple"), ("d3", "blue sky")], "doc_id string, text string")
    index = lexical.build(docs, spark.createDataFrame([("q", "red sky")], "qid string, text string"))
    assert {t for r in written[0].collect() for t in r.tokens} == {"red", "sky"}
    assert (index.n, round(index.avgdl, 6)) == (3, 2.333333) and {tuple(r) for r in index.terms.collect()} == {("red", 1), ("sky", 1)}


def test_index_of_repeated_ids(spark):
    docs = spark.createDataFrame([("d1", "red apple"), ("d1", "red sky"), ("d2", "sky")], "doc_id string, text string")
    index = lexical.build(docs)
    assert {tuple(r) for r in index.terms.collect()} == {("red", 1), ("apple", 1), ("sky", 2)}
    assert {(r.term, r.doc_id, r.tf) for r in index.postings.collect()} == {("red", "d1", 2), ("apple", "d1", 1), ("sky", "d1", 1), ("sky", "d2", 1)}


def test_judgements_are_made_once(spark):
    """Both uses in a panel read what was written; texts are not searched again."""
    assert "documents.parquet" not in views.judgements(spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_passages_are_found_with_many_or_few_first_words(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "x a b c d e f g y"), (2, "a b c d e f"), (3, "b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, "e f")], "item_id long, text string")
    for most in (2000, 0):
        monkeypatch.setattr(evalset, "NAMED_WORDS", most, raising=False)
        assert sorted(map(tuple, evalset.holding(texts, items).collect())) == [(1, 1), (1, 2), (2, 2), (3, 2)]
