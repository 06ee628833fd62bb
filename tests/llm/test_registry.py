"""Queries of the subpackage that have SQL, against it in DuckDB."""

import os

import duckdb
import pytest

from tests.llm.helpers import docs
from twinseek.llm import registry

DIR = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


def compare(spark, folder, name):
    con = duckdb.connect()
    for n in ("documents", "conversations"):
        if os.path.exists(f"{folder}/{n}.parquet"):
            con.sql(f"create view {n} as select * from read_parquet('{folder}/{n}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{n}.parquet') else ''}')")
    df, want = registry.queries()[name](spark, folder), con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    mine = [tuple(plain(r[c]) for c in want.columns) for r in df.collect()]
    assert sorted(mine, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    compare(spark, DIR, name)


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - {"op9_schema_fingerprints"}))
def test_odd_rows_match_the_sql(spark, tmp_path, name):
    texts = [None, "", " \n", "a b c a b c", "x@y.zz 1.2.3.4 1.2.3.400 4111 1111 1111 1111 +1 (364) 555-9741", "l\nl\n\nl", "w " * 300, "# $", "5500-0000-0000-0004 and 4111111111111112"]
    sources = ["a", "b", None, "c", "a", "b", "c", None, "d"]
    docs(spark, [(i, t, "en", s, None) for i, (t, s) in enumerate(zip(texts, sources))]).write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, str(tmp_path), name)
