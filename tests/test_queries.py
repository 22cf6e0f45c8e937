"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import lexiweave.plans.registry as registry
from lexiweave.streaming.sentence_cap import all_full, run_available

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
SOME = ["extract_picks", "pick_winner_fill", "fa_quality", "cosine_ppmi", "nearest_cues", "model_jaccard_percue", "best_k", "k_report", "grand_mean_row", "forced_choice_round", "sentence_word_match", "stream_sentence_cap"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def ordered(rows):
    return sorted(rows, key=lambda r: ([repr(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)]))


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-6)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    mine = ordered(tuple(r) for r in df.select(columns).collect())
    theirs = ordered(tuple(r[i] for i in at) for r in want.fetchall())
    assert len(mine) == len(theirs)
    assert all(same(a, b) for x, y in zip(mine, theirs) for a, b in zip(x, y))


def test_every_query_has_a_shape(spark):
    assert len(QUERIES) >= 80 and set(SQL) <= set(QUERIES)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    import uuid

    words = spark.createDataFrame([("dog",), ("cat",)], "word string")
    label, source = uuid.uuid4().hex, f"{tmp_path}/docs.parquet"
    text = "The dog saw one more thing. A dog and a cat sat there."
    docs = spark.createDataFrame([(i, text) for i in range(3)] + [(9, None)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(source)
    kept = run_available(spark, source, words, 4, label=label)
    assert {r.word: r["count"] for r in kept.groupBy("word").count().collect()} == {"dog": 4, "cat": 3} and not all_full(kept, words, 4)
    docs.coalesce(1).write.mode("append").parquet(source)
    kept = run_available(spark, source, words, 4, label=label)
    assert {r.word: r["count"] for r in kept.groupBy("word").count().collect()} == {"dog": 4, "cat": 4} and all_full(kept, words, 4)
