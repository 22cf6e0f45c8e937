"""Rules on hand-written rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiweave.functions.rules import associations, clean, picks, short_number, valid_picks
from lexiweave.functions.vectors import pearson
from lexiweave.operators import counts as N
from lexiweave.operators import logs as L
from lexiweave.operators import overlap as O
from lexiweave.operators import summaries as S
from lexiweave.operators.compare import consensus_sims, overlap_at_k, pair_of_index, sampled_pairs
from lexiweave.operators.geometry import centred, nearest
from lexiweave.operators.lexicon import balanced_group, contiguous_shard, dense_index
from lexiweave.operators.ridge import ALPHAS, fit_groups
from lexiweave.operators.rounds import play
from lexiweave.operators.svd import svd_vectors


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("Output: Bark, leash, pet, animal, cat.", ["bark", "leash", "pet", "animal", "cat"]), ("output: a, b, c, d, e, f", list("abcde")), ("dog, cat\nfoo", ["dog", "cat"]), ("output:\nfoo, bar", []),
        ("output: «Éa», --, x-y", ["éa", "x-y"]), (None, []), ("", []),
    ],
)
def test_associations(spark, text, words):
    assert spark.createDataFrame([(text,)], "t string").select(associations(F.col("t"))).first()[0] == words


@pytest.mark.parametrize(
    ("given", "text", "want"),
    [("table", "table: platform, desk", ("platform", "desk")), ("x", "output: a, b\noutput: c, d", ("c", "d")), ("x", "x: y\nfoo, bar", ("foo", "bar")), ("x", "no idea", (None, None)), ("x", None, (None, None)), (None, "output: a, b", ("a", "b")), ("a.b", "A.B : c, d", ("c", "d"))],
)
def test_picks(spark, given, text, want):
    a, b = picks("o", "i")
    assert tuple(spark.createDataFrame([(given, text)], "i string, o string").select(a, b).first()) == want


def test_valid_picks(spark):
    rows = [("x", ["a", "b"], "a", "a"), ("a", ["a", "b"], "a", "b"), ("x", ["a", "b"], "A", "b"), ("x", [], "a", "b"), (None, ["a"], "a", None)]
    a, b = valid_picks("p", "q", "c", "i")
    got = [tuple(r) for r in spark.createDataFrame(rows, "i string, c array<string>, p string, q string").select(a, b).collect()]
    assert got == [("a", None), (None, "b"), (None, "b"), (None, None), ("a", None)]


def test_clean_and_numbers(spark):
    got = [r[0] for r in spark.createDataFrame([(" NA ",), ("nan",), ("--",), ("_",), ("\xa0Dog ",), (None,)], "t string").select(clean(F.col("t"))).collect()]
    assert got == [None, None, None, None, "dog", None]
    got = [r[0] for r in spark.createDataFrame([(0.12,), (-0.12,), (1.5,), (float("nan"),), (None,)], "x double").select(short_number(F.col("x"))).collect()]
    assert got == [".12", "-.12", "1.50", "", ""]


def test_balanced_groups_and_shards(spark):
    def sizes(n, k):
        return sorted(r[1] for r in spark.range(n).groupBy(balanced_group(F.col("id"), F.lit(n), k)).count().collect())

    assert sizes(98, 16) == [14] * 7 and sizes(4999, 16) == [15] * 9 + [16] * 304
    got = [r[1] for r in spark.range(10).groupBy(contiguous_shard(F.col("id"), F.lit(10), 3).alias("s")).count().orderBy("s").collect()]
    assert got == [3, 3, 4]
    assert [r[0] for r in spark.range(2).select(contiguous_shard(F.col("id"), F.lit(2), 3)).collect()] == [2, 2]


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in "dacbe"], "w string")
    assert {r.w: r["index"] for r in dense_index(df, ["w"]).collect()} == dict(zip("abcde", range(1, 6)))


def test_ppmi_and_cosine(spark):
    c = spark.createDataFrame([("a", "x", 2), ("b", "x", 1), ("b", "y", 1)], "cue string, response string, cnt long")
    got = {(r.cue, r.response): round(r.ppmi, 6) for r in N.ppmi(c).collect()}
    assert got == {("a", "x"): 0.287682, ("b", "x"): 0.0, ("b", "y"): 0.693147}
    assert [round(r.sim, 6) for r in N.cosine_pairs(c, "cnt").collect()] == [round(1 / math.sqrt(2), 6)]
    assert N.cosine_pairs(N.ppmi(c), "ppmi").count() == 0 and N.ppmi(c.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "cells"), [(1024, 1_000_000), (5, 40), (1, 10)])
def test_cosine_blocks_against_numpy(spark, block, cells):
    rng = np.random.default_rng(block)
    m = rng.integers(0, 3, size=(2, 17, 11)).astype(float)
    rows = [(f"m{k}", f"c{i:02d}", f"r{j}", float(m[k, i, j])) for k in range(2) for i in range(17) for j in range(11) if m[k, i, j]]
    got = {(r.model, r.cue_i, r.cue_j): r.sim for r in N.cosine_pairs(spark.createDataFrame(rows, "model string, cue string, response string, w double"), "w", "model", block=block, task_cells=cells).collect()}
    u = m / np.linalg.norm(m, axis=2, keepdims=True)
    want = {(f"m{k}", f"c{i:02d}", f"c{j:02d}"): u[k, i] @ u[k, j] for k in range(2) for i in range(17) for j in range(i + 1, 17) if (m[k, i] * m[k, j]).any()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    near = N.nearest_by_cosine(spark.createDataFrame(rows, "model string, cue string, response string, w double"), "w", 3, "model", block=block, task_cells=cells)
    both = {}
    for (k, a, b), s in want.items():
        both.setdefault((k, a), []).append((-round(s, 9), b))
        both.setdefault((k, b), []).append((-round(s, 9), a))
    assert {(r.model, r.word, r.place): r.neighbour for r in near.collect()} == {(*k, p + 1): b for k, l in both.items() for p, (_, b) in enumerate(sorted(l)[:3])}


def test_pair_numbers(spark):
    got = [tuple(r) for r in spark.range(6).select(*pair_of_index(F.col("id"), F.lit(4).cast("long"))).collect()]
    assert got == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    n = 3000
    words = spark.range(n).select(F.col("id").alias("idx"))
    rows = sampled_pairs(words, 5000, 3).collect()
    assert len({tuple(r) for r in rows}) == 5000 and all(0 <= r.i < r.j < n for r in rows)
    assert sampled_pairs(spark.range(5).select(F.col("id").alias("idx")), 0).distinct().count() == 10
    assert sampled_pairs(spark.range(1).select(F.col("id").alias("idx")), 0).count() == 0


def test_pearson_of_a_constant_is_null(spark):
    assert spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double").agg(pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 6))
    m[7] = m[3]  # a tie
    df = centred(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "word long, vec array<double>"))
    u = m - m.mean(0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -np.inf)
    want = {i: sorted(range(60), key=lambda j, i=i: (-s[i, j], j))[:4] for i in range(60)}
    for block in (7, 1000):
        got = {}
        for r in nearest(df, 4, block=block).orderBy("word", "place").collect():
            got.setdefault(r.word, []).append(r.neighbour)
        assert got == want
    assert nearest(df.limit(1), 4).count() == 0


def test_consensus_is_total_minus_own(spark):
    rows = [("a", 0, 9.0), ("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 4.0), ("c", 1, 8.0)]
    df = spark.createDataFrame([(m, l, 0, 1, s) for m, l, s in rows], "model string, layer int, i long, j long, sim double")
    assert {r.model: r.sim for r in consensus_sims(df).collect()} == {"a": 6.0, "b": 11 / 3, "c": 7 / 3}
    assert consensus_sims(df.where("model = 'b'")).first().sim is None


def test_overlap(spark):
    a = spark.createDataFrame([("m", 1, x) for x in (1, 2, 3)] + [("m", 2, 9)], "model string, word long, neighbour long")
    b = spark.createDataFrame([(1, x) for x in (3, 4, 5)], "word long, neighbour long")
    words = spark.createDataFrame([(1,), (2,)], "idx long")
    assert overlap_at_k(a, b, words, 3, "model").first().overlap == pytest.approx(1 / 6)


def test_jaccard(spark):
    s = spark.createDataFrame([("a", "c", "x"), ("a", "c", "y"), ("b", "c", "y"), ("b", "d", "z")], "model string, cue string, response string")
    assert {(r.model_a, r.model_b): r.jaccard for r in O.jaccard_matrix(s).collect()} == {("a", "a"): 1.0, ("a", "b"): 1 / 3, ("b", "a"): 1 / 3, ("b", "b"): 1.0}
    assert O.jaccard_per_cue(s, s.where("model = 'a'").select("cue")).first().jaccard == 0.5
    assert {r.model: r.rate for r in O.uniqueness(s).collect()} == {"a": 0.5, "b": 0.5}
    assert O.jaccard_matrix(s.limit(0)).count() == 0 and O.consensus(s, 2).count() == 1


def test_summaries(spark):
    df = spark.createDataFrame([("m", 1, 0.5, float("nan")), ("m", 2, 0.5, 0.1), ("n", 1, 0.1, None)], "model string, layer int, value double, x double")
    assert {r.model: (r.peak, r.peak_layer) for r in S.peaks(df, "model").collect()} == {"m": (0.5, 1), "n": (0.1, 1)}
    assert [r.x for r in S.finite(df, "x").orderBy("model", "layer").collect()] == [None, 0.1, None]
    assert S.canonical_columns(["pearson_tournament_PPMI", "nn_forced_choice_PPMI", "pearson_fc_counts", "pearson_crossmodel", "layer"]) == {
        "pearson_tournament_PPMI": "pearson_fc", "nn_forced_choice_PPMI": "nn_fc", "pearson_fc_counts": "pearson_fc", "pearson_crossmodel": "pearson_cross"}
    got = S.mean_of_means(df.select("model", "layer", "value"), ["model"], []).first()[0]
    assert got == pytest.approx(0.3)


def test_logs(spark):
    t = "[Round 1] Initial generation: compliant=8/10 noncompliant=2\n[Round 1] After deterministic repair: remaining noncompliant=1\n[Round 1] After sampled retries: compliant=10/10 (100.00%), sampled_retries_used=3\n[Round 2] 45%"
    df = spark.createDataFrame([("a", t), ("b", "Traceback (most recent call last):"), ("c", "Wrote final pools summary: x"), ("d", None)], "job string, text string")
    s = {r.job: r for r in L.statistics(df).collect()}
    assert (s["a"].initial_rate, s["a"].repair_rate, s["a"].retry_rate, s["b"].initial_rate) == (80.0, 50.0, 100.0, None)
    assert [(r.status, r.last_round, r.percent) for r in L.status(df).orderBy("job").collect()] == [("Running", 2, 45), ("Failed", None, 0), ("Completed", None, 100), ("Running", None, 0)]


def test_rounds_end_in_pools_of_two(spark):
    pools = spark.createDataFrame([("c", f"w{i}") for i in range(37)] + [("d", "x")], "cue string, word string")
    last, played = play(pools, F.col("word"), size=4, most_rounds=10)
    assert {r.cue: r["count"] for r in last.groupBy("cue").count().collect()} == {"c": 2, "d": 1} and 3 <= played <= 6


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = x @ [0.5, 0, 0.2, -0.3, 0.1] + rng.normal(size=300) * 0.3
    split = ["train"] * 250 + ["test"] * 50
    fold = [i // 50 for i in range(250)] + [0] * 50
    rows = [("m", split[i], fold[i], *map(float, x[i]), float(y[i])) for i in range(300)]
    got = fit_groups(spark.createDataFrame(rows, "model string, split string, fold int, ft double, bert double, cross double, fc double, fa double, y double"), ["model"])[0]

    def solve(a, b, alpha):
        mu, sd = a.mean(0), a.std(0)
        w = np.linalg.solve((a - mu).T @ (a - mu) / np.outer(sd, sd) + alpha * np.eye(a.shape[1]), ((a - mu) / sd).T @ (b - b.mean())) / sd
        return w, b.mean() - w @ mu

    def r2(a, b, w, c):
        return 1 - ((b - a @ w - c) ** 2).sum() / ((b - b.mean()) ** 2).sum()

    f = np.array(fold[:250])
    a, b = x[:250], y[:250]
    score = {al: np.mean([r2(a[f == k], b[f == k], *solve(a[f != k], b[f != k], al)) for k in range(5)]) for al in ALPHAS}
    best = max(ALPHAS, key=lambda al: (score[al], -al))
    assert got["alpha_full"] == best and got["r2_full"] == pytest.approx(r2(x[250:], y[250:], *solve(a, b, best)), abs=1e-9)


@pytest.mark.parametrize("block_cells", [500_000, 400])
def test_svd_against_numpy(spark, block_cells):
    rng = np.random.default_rng(2)
    m = rng.integers(0, 4, size=(60, 45)).astype(float) * (rng.random((60, 45)) < 0.5)
    cells = spark.createDataFrame([(f"c{i}", f"r{j}", float(m[i, j])) for i in range(60) for j in range(45) if m[i, j]], "cue string, response string, w double")
    words = spark.createDataFrame([(f"c{i}", i) for i in range(60)], "word string, idx long")
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    for dim in (3, 30):  # 23 directions of 45, and all
        got = {r.idx: np.array(r.vec) for r in svd_vectors(cells, "w", words, dim, block_cells=block_cells).collect()}
        e, g = u[:, :dim] * s[:dim], np.stack([got[i] for i in range(60)])
        assert np.allclose(g @ g.T, e @ e.T, atol=0.05 * s[0] if dim == 3 else 1e-6)
    assert svd_vectors(cells.limit(0), "w", words, 9).count() == 0
