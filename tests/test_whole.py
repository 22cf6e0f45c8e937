"""Queries that do the whole job where their older namesakes, bound by their SQL, take a part of it."""

import glob
import hashlib
import os

import duckdb
import numpy as np
import pytest
from test_queries import DATA, QUERIES, SQL, ordered, same

from lexiweave.functions.digests import Words
from lexiweave.operators import counts, svd
from lexiweave.operators.compare import all_pair_consensus, all_pair_correlations, consensus_sims, correlations, dense_sims, sampled_pairs, sparse_sims
from lexiweave.operators.counts import cosine_of_all, cosine_pairs, nearest_by_cosine, nearest_of_all
from lexiweave.plans import geometry as G
from lexiweave.plans import words as W
from lexiweave.sources import workdir


def against_sql(spark, name, data=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    mine = ordered(tuple(r) for r in df.select(columns).collect())
    theirs = ordered(tuple(r[i] for i in at) for r in want.fetchall())
    assert len(mine) == len(theirs)
    assert all(same(a, b) for x, y in zip(mine, theirs) for a, b in zip(x, y))
    return mine


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["rsa_layerwise_all", "consensus_loo_all", "uncentered_cosine_all"])
def test_all_pairs_against_sql(spark, name):
    assert against_sql(spark, name)


def test_all_pairs_are_counted_beyond_the_sample(spark):
    rng, n = np.random.default_rng(3), 200
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(size=3))
    hidden = spark.createDataFrame([(m, l, i, unit()) for m in "ab" for l in (1, 2) for i in range(n)], "model string, layer int, idx long, vec array<double>")
    words = spark.createDataFrame([(f"w{i}", i) for i in range(n)], "word string, idx long")
    cells = spark.createDataFrame([(f"w{i}", f"r{r}", float(1 + r % 3)) for i in range(n - 1) for r in set(rng.integers(0, 40, 5).tolist())], "cue string, response string, cnt double")
    valid = words.where("idx % 2 = 0").select("idx")
    got = {(r.model, r.layer): r for r in all_pair_correlations(hidden, cells, "cnt", words, valid, block=64).collect()}
    pairs = sampled_pairs(words, 0)
    sims = dense_sims(pairs, hidden, "model", "layer")
    fa = sparse_sims(pairs, cells, "cnt", words)
    want = correlations(sims, {"fa": fa, "cross": consensus_sims(sims), "valid": fa.where("i % 2 = 0 and j % 2 = 0")}, "model", "layer").collect()
    assert len(want) == len(got) == 4
    for r in want:
        g = got[r.model, r.layer]
        assert g.n_pairs == r.n_pairs == n * (n - 1) // 2 > 10_000
        assert np.allclose([g.pearson_fa, g.pearson_cross, g.pearson_valid], [r.pearson_fa, r.pearson_cross, r.pearson_valid], atol=1e-9)
    mine = {(r.model, r.i, r.j): r.sim for r in all_pair_consensus(hidden, words, block=64).collect()}
    theirs = {(r.model, r.i, r.j): r.sim for r in consensus_sims(sims).collect()}
    assert mine.keys() == theirs.keys() and all(abs(mine[k] - theirs[k]) < 1e-9 for k in mine)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["nearest_cues_all", "cosine_counts_all", "cosine_ppmi_all"])
def test_all_cues_against_sql(spark, name):
    assert len(against_sql(spark, name)) > QUERIES[name.removesuffix("_all")](spark, DATA).count()


def test_all_cues_in_many_blocks(spark):
    rng = np.random.default_rng(5)
    rows = {(f"c{i:03}", f"r{r}"): float(rng.integers(1, 4)) for i in range(300) for r in rng.integers(0, 60, 4)}
    cells = spark.createDataFrame([(c, r, w) for (c, r), w in rows.items()], "cue string, response string, cnt double")
    key = lambda df: {(r.word, r.place): (r.neighbour, r.sim) for r in df.collect()}
    want = key(nearest_by_cosine(cells, "cnt", 5))
    assert key(nearest_of_all(cells, "cnt", 5, task_cells=300)) == want and len(want) == 1500
    pairs = lambda df: {(r.cue_i, r.cue_j): round(r.sim, 9) for r in df.collect()}
    assert pairs(cosine_of_all(cells, "cnt", task_cells=300)) == pairs(cosine_pairs(cells, "cnt"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["cosine_counts_all", "cosine_ppmi_all"])
def test_all_pairs_leave_in_the_order_of_sim(spark, name):
    parts = QUERIES[name](spark, DATA).rdd.map(lambda r: r.sim).glom().collect()
    assert sum(map(len, parts)) > 4_000 and all(p == sorted(p) for p in parts)


def test_sorted_pairs_are_those_of_sql(spark, monkeypatch):
    monkeypatch.setattr(counts, "SORTED", 30_000)
    monkeypatch.setattr(counts, "BATCH", 7_000)
    rng = np.random.default_rng(8)
    rows = {(f"c{i:03}", f"r{r}"): float(w) for i in range(600) for r, w in zip([0, *rng.integers(1, 90, 5)], rng.integers(1, 5, 6))}
    cells = spark.createDataFrame([(c, r, w) for (c, r), w in rows.items()], "cue string, response string, cnt double")
    con = duckdb.connect()
    con.register("cells", cells.toPandas())
    un = "with un as (select cue, response, cnt / sqrt(sum(cnt * cnt) over (partition by cue)) as w from cells)"
    want = con.sql(f"{un} select a.cue, b.cue, round(sum(a.w * b.w), 6) from un a join un b on a.response = b.response and a.cue < b.cue group by 1, 2").fetchall()
    got = [tuple(r) for r in cosine_of_all(cells, "cnt", digits=6, task_cells=2_000).collect()]
    assert len(got) == len(set(r[:2] for r in got)) == len(want) == 600 * 599 // 2
    assert all(x[:2] == y[:2] and same(x[2], y[2]) for x, y in zip(sorted(got), sorted(want)))


def test_sorted_pairs_take_fewer_bytes(spark, tmp_path):
    rows = [(f"c{i:04}", r, w) for i in range(1_600) for r, w in (("r", 1.0), (f"own{i}", 0.005 * (1 + i % 1_000)))]
    cells, size = spark.createDataFrame(rows, "cue string, response string, cnt double"), {}
    for digits in (None, 6):
        df = cosine_of_all(cells, "cnt", digits=digits).selectExpr("cue_i", "cue_j", "round(sim, 6) as sim")
        df.write.parquet(f"{tmp_path}/{digits}")
        assert spark.read.parquet(f"{tmp_path}/{digits}").count() == 1_600 * 1_599 // 2
        size[digits] = sum(os.path.getsize(p) for p in glob.glob(f"{tmp_path}/{digits}/*.parquet"))
    assert size[6] < 0.75 * size[None], size


def test_a_task_sorts_the_pairs_of_all_its_blocks(spark):
    rng = np.random.default_rng(11)
    # Ten cues in a row have most of the cells.
    rows = {(f"c{i:03}", f"r{r}"): float(rng.integers(1, 5)) for i in range(600) for r in rng.integers(0, 90, 60 if 300 <= i < 310 else 4)}
    cells = spark.createDataFrame([(c, r, w) for (c, r), w in rows.items()], "cue string, response string, cnt double")
    parts = [p for p in cosine_of_all(cells, "cnt", digits=6, task_cells=300).rdd.map(tuple).glom().collect() if p]
    assert len(parts) > 3 and all([r[2] for r in p] == sorted(r[2] for r in p) for p in parts)
    # The first cues of a task are those of a range, in the order of the text.
    firsts = {(min(r[0] for r in p), max(r[0] for r in p)) for p in parts}
    assert all(a == c or b < c or d < a for a, b in firsts for c, d in firsts)
    blocks = counts._ranges(cells, 300).groupBy("block").agg({"cue": "count"}).collect()
    assert len(blocks) > 4 and sum(b[1] for b in blocks) == 600 and max(b[1] for b in blocks) < 300
    want = {(r.cue_i, r.cue_j): r.sim for r in cosine_pairs(cells, "cnt").collect()}
    got = {r[:2]: r[2] for p in parts for r in p}
    assert sum(map(len, parts)) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_more_cues_than_places_of_a_window(spark, monkeypatch):
    monkeypatch.setattr(counts, "PLACE_BITS", 8)
    cells = spark.createDataFrame([(f"c{i:03}", f"r{r}", 1.0 + (i + r) % 3) for i in range(400) for r in {i % 7, 8 + i % 11, 20}], "cue string, response string, cnt double")
    got = [tuple(r) for r in cosine_of_all(cells, "cnt", digits=6, task_cells=100).collect()]
    want = {(r.cue_i, r.cue_j): r.sim for r in cosine_pairs(cells, "cnt").collect()}
    assert len(got) == len(want) == 400 * 399 // 2 and all(abs(want[r[:2]] - r[2]) < 1e-6 for r in got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_counts_need_no_marginals(spark, monkeypatch):
    monkeypatch.delattr(counts, "with_marginals")
    assert against_sql(spark, "cosine_counts_all")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_marginals_are_made_of_counts_that_are_there(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(G, "stored", lambda df, label: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or workdir.stored(df, label))
    assert against_sql(spark, "cosine_ppmi_all")
    assert "long_df" in plans["counts"] and "long_df" not in plans["cells"]


def test_sims_are_rounded_as_duckdb_rounds():
    x = np.concatenate([np.arange(1, 129) / 128, np.random.default_rng(1).random(2_000), [0.0, 1e-9, 4.9999999999e-7, 5e-7, 1 + 1e-12]])
    want = [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in x.tolist()]
    assert (counts._scaled(x, 6) / 1e6).tolist() == want and want[0] == 0.007813


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_every_word_has_all_others_as_its_pool(spark):
    rows = against_sql(spark, "cue_shuffle_all")
    n = spark.read.parquet(f"{DATA}/vocabulary.parquet").selectExpr("lower(word) as w").where("w is not null").distinct().count()
    assert len(rows) == n * (n - 1) and max(r[1] if isinstance(r[1], int) else r[2] for r in rows) == n - 1


@pytest.mark.parametrize("name", ["nearest_of_all", "cosine_of_all"])
def test_no_block_or_pair_is_copied_by_a_shuffle(spark, name):
    cells = spark.createDataFrame([(f"c{i:03}", f"r{r}", 1.0 + (i + r) % 3) for i in range(200) for r in {i % 7, 8 + i % 11, 20}], "cue string, response string, cnt double")
    df = nearest_of_all(cells, "cnt", 5, task_cells=30) if name == "nearest_of_all" else cosine_of_all(cells, "cnt", task_cells=30)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Each side is shuffled once as packed blocks; pairs of words meet no join, and the nearest only the window that takes the best of parts.
    assert plan.count("CartesianProduct") == 1 and not any(x in plan for x in ("SortMergeJoin", "HashJoin", "FlatMapGroups"))
    assert plan.count("Exchange ") == (3 if name == "nearest_of_all" else 2)
    want = nearest_by_cosine(cells, "cnt", 5) if name == "nearest_of_all" else cosine_pairs(cells, "cnt")
    shown = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(sorted(d.columns)).collect())
    assert shown(df) == shown(want)


@pytest.mark.parametrize("name", ["cosine_counts", "cosine_ppmi", "nearest_cues"])
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_geometry_of_lemmas_goes_by_blocks(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapGroups" not in plan


def test_digests_of_many_words():
    words = [b"", b"a", "\u00e9\u732b".encode(), *(b"x" * n for n in range(30, 70)), *(f"w{i}".encode() for i in range(9000))]
    for prefix in (b"12345|a|", b"", b"123", b"p" * 40, b"q" * 60):
        high, low = Words(words).md5(prefix)
        assert [f"{h:016x}{l:016x}" for h, l in zip(high.tolist(), low.tolist())] == [hashlib.md5(prefix + w).hexdigest() for w in words]


def test_pools_without_a_row_per_pair_in_a_shuffle(spark):
    rows = spark.createDataFrame([(w, k) for k, w in enumerate(["a", "b", "\u00e9", "long" * 20, "c|d", "a", *(f"w{i}" for i in range(300))])], "word string, vocab_rank int")
    asked = rows.vocab_rank % 2 == 0
    df = W._pools(rows, asked)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan
    shown = lambda d: sorted(map(tuple, d.select("cue", "word", "place").collect()))
    assert shown(df) == shown(W._pools(rows, asked, most_words=0)) and df.count() > 300 * 150


def test_vectors_of_an_svd_pass_as_binary_values():
    rng = np.random.default_rng(2)
    row, column, w, v = rng.integers(0, 40, 3000), rng.integers(0, 60, 3000), rng.normal(size=3000), rng.normal(size=(60, 7))
    ids, at = np.unique(row, return_inverse=True)
    got = svd._summed(ids, at, v, column, w, "idx")
    assert all(isinstance(x, bytes) for x in got.v)
    want = np.zeros((len(ids), 7))
    np.add.at(want, at, v[column] * w[:, None])
    assert np.allclose(svd._vectors(got.v), want)
    twice = svd._add_up("idx")(got.iloc[np.tile(np.arange(len(ids)), 2)])
    assert np.allclose(svd._vectors(twice.v), 2 * want)
