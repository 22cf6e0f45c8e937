"""Comparing geometries: sampled pairs, correlation by layer, overlap of neighbours, consensus of the other models."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.vectors import dot, pearson
from lexiweave.operators.counts import sparse_product, unit_rows
from lexiweave.operators.lexicon import dense_index

def pair_of_index(k: Column, n: Column) -> tuple[Column, Column]:
    """The k-th pair i < j (all from 0) of n words in the order (0,1), (0,2) ... (1,2) ..., for up to a thousand million words."""
    two = 2 * n - 1
    guess = F.floor((two - F.sqrt((two * two - 8 * k).cast("double"))) / 2).cast("long")
    before = lambda i: F.shiftright(i * (2 * n - i - 1), 1)
    i = F.when(before(guess) > k, guess - 1).when(before(guess + 1) <= k, guess + 1).otherwise(guess)
    return i, (k - before(i) + i + 1).cast("long")


def sampled_pairs(words: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """i < j (idx of words): `size` different pairs drawn uniformly, all of them if there are no more; the same for the same seed.

    Needs idx dense from 0. Pair numbers are drawn by hash, twice as many as needed, of which the first
    `size` different ones count; where there are at most four times as many pairs as needed, they are all
    put in the order of their hashes. So no list of all pairs is made. size 0 means all pairs.
    """
    n = words.select("idx").count()
    pairs = n * (n - 1) // 2
    spark, digest = words.sparkSession, F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))
    if size == 0 or pairs <= size:
        k = spark.range(pairs).select(F.col("id").alias("k"))
    elif pairs <= 4 * size:
        k = spark.range(pairs).select(F.col("id").alias("k"), digest.alias("o")).orderBy("o").limit(size)
    else:
        drawn = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(pairs)
        k = spark.range(2 * size).select(drawn.alias("k"), "id").groupBy("k").agg(F.min("id").alias("o")).orderBy("o").limit(size)
    i, j = pair_of_index(F.col("k"), F.lit(n).cast("long"))
    return k.select(i.alias("i"), j.alias("j"))


def dense_sims(pairs: DataFrame, vectors: DataFrame, *by: str, name: str = "sim") -> DataFrame:
    """by..., i, j, sim of the given pairs: vectors are fetched for the pairs that were drawn, not the other way round."""
    a = vectors.select(*by, F.col("idx").alias("i"), F.col("vec").alias("vi"))
    b = vectors.select(*by, F.col("idx").alias("j"), F.col("vec").alias("vj"))
    return pairs.join(a, "i").join(b, [*by, "j"]).select(*by, "i", "j", dot(F.col("vi"), F.col("vj")).alias(name))


def sparse_sims(pairs: DataFrame, cells: DataFrame, weight: str, words: DataFrame, name: str = "sim") -> DataFrame:
    """i, j, sim of the given pairs from count or PPMI cells; 0 where two cues share no response or one has no weight."""
    w = unit_rows(cells, weight).join(words.select(F.col("word").alias("cue"), "idx"), "cue").select("idx", "response", "w")
    a = w.select(F.col("idx").alias("i"), "response", F.col("w").alias("wi"))
    b = w.select(F.col("idx").alias("j"), "response", F.col("w").alias("wj"))
    shared = pairs.join(a, "i").join(b, ["j", "response"]).groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias(name))
    return pairs.join(shared, ["i", "j"], "left").select("i", "j", F.coalesce(name, F.lit(0.0)).alias(name))


def consensus_sims(sims: DataFrame, *, least_layer: int = 1) -> DataFrame:
    """model, i, j, sim: mean over all layers from `least_layer` on of all other models; null if there are none.

    As (sum of all - own sum) / (number of all - own number): every model's vectors are used once. It
    needs all models to share their words, as they are centred over them.
    """
    kept = sims.where(F.col("layer") >= least_layer)
    own = kept.groupBy("model", "i", "j").agg(F.sum("sim").alias("s"), F.count(F.lit(1)).alias("n"))
    every = own.groupBy("i", "j").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    return own.join(every, ["i", "j"]).select("model", "i", "j", F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")).alias("sim"))


def correlations(sims: DataFrame, others: dict[str, DataFrame], *by: str) -> DataFrame:
    """by..., n_pairs, and for each name in others the correlation of its sim with that of sims over the pairs both have."""
    df = sims
    for name, other in others.items():
        keys = [c for c in (*by, "i", "j") if c in other.columns]
        df = df.join(other.select(*keys, F.col("sim").alias(name)), keys, "left")
    # A pair that a space lacks counts for the other spaces only.
    both = [pearson(F.when(F.col(o).isNotNull(), F.col("sim")), F.when(F.col("sim").isNotNull(), F.col(o))).alias(f"pearson_{o}") for o in others]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), *both)


#: Words of one block of a comparison over all pairs, and numbers that the vectors of one block may hold.
BLOCK, BLOCK_NUMBERS = 1_024, 8_000_000


def _pair_blocks(hidden: DataFrame, words: DataFrame, block: int) -> DataFrame:
    """bi, bj, side and the columns of words (one row per word) with all its vectors as `vecs`, for each pair of blocks."""
    packed = hidden.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("model", "layer", "vec"))).alias("vecs"))  # as many as models and layers
    size = packed.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vecs", F.lit(0), lambda s, v: s + F.size(v["vec"]))).alias("width")).first()
    block = max(1, min(block, BLOCK_NUMBERS // max(1, size["width"] or 1)))
    blocks = max(1, -(-size["n"] // block))
    own = words.join(packed, "idx").withColumn("own", F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return met.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other")


class _Blocks:
    """The two blocks of words of one task, and the similarities of all their pairs i < j."""

    def __init__(self, key: tuple, rows: pd.DataFrame) -> None:
        same = key[0] == key[1]
        self.sides = [rows[rows.side == s].sort_values("idx") for s in ((0, 0) if same else (0, 1))]
        self.empty = any(not len(s) for s in self.sides)
        if self.empty:
            return
        self.ids = [s.idx.to_numpy() for s in self.sides]
        self.names = [(v["model"], v["layer"]) for v in self.sides[0].vecs.iloc[0]]
        self.vecs = [[np.array([v[k]["vec"] for v in s.vecs]) for k in range(len(self.names))] for s in self.sides]
        self.pairs = np.triu(np.ones((len(self.ids[0]),) * 2, bool), 1) if same else np.ones((len(self.ids[0]), len(self.ids[1])), bool)

    def hidden(self) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
        for k, name in enumerate(self.names):
            yield name, (self.vecs[0][k] @ self.vecs[1][k].T)[self.pairs]

    def consensus(self) -> dict[str, np.ndarray | None]:
        """Of each model the mean over all layers of the other models; None if there are none."""
        own: dict[str, np.ndarray] = {}
        count: dict[str, int] = {}
        for (model, _), sim in self.hidden():
            own[model] = own[model] + sim if model in own else sim
            count[model] = count.get(model, 0) + 1
        every, n = sum(own.values()), sum(count.values())
        return {m: (every - own[m]) / (n - count[m]) if n > count[m] else None for m in own}

    def sparse(self) -> np.ndarray:
        cells = []
        for s in self.sides:
            n = s.responses.map(len).to_numpy()
            cells.append((np.repeat(np.arange(len(s)), n), np.concatenate(s.responses.to_list()).astype(np.int64), np.concatenate(s.weights.to_list()).astype(float)))
        out = np.concatenate([part for _, part in sparse_product(*cells, *self.pairs.shape)])
        return out[self.pairs]

    def both(self, flag: str) -> np.ndarray:
        a, b = (s[flag].to_numpy(bool) for s in self.sides)
        return (a[:, None] & b[None, :])[self.pairs]


def _block_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    b = _Blocks(key, rows)
    out = []
    if not b.empty:
        fa, cross, valid = b.sparse(), b.consensus(), b.both("valid")
        for (model, layer), h in b.hidden():
            for name, x, keep in (("fa", fa, None), ("cross", cross[model], None), ("valid", fa, valid)):
                if x is not None:
                    u, v = (h, x) if keep is None else (h[keep], x[keep])
                    out.append((model, layer, name, len(u), u.sum(), v.sum(), u @ u, v @ v, u @ v))
    return pd.DataFrame(out, columns=["model", "layer", "name", "n", "h", "x", "hh", "xx", "hx"])


def _block_consensus(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    b = _Blocks(key, rows)
    out = [pd.DataFrame({"model": [], "i": [], "j": [], "sim": []})]
    if not b.empty:
        i, j = (x[b.pairs] for x in np.meshgrid(*b.ids, indexing="ij"))
        for model, sim in b.consensus().items():
            out.append(pd.DataFrame({"model": model, "i": np.minimum(i, j), "j": np.maximum(i, j), "sim": sim}))
    return pd.concat(out[1:] or out)


def all_pair_correlations(hidden: DataFrame, cells: DataFrame, weight: str, words: DataFrame, valid: DataFrame, block: int = BLOCK) -> DataFrame:
    """model, layer, n_pairs, pearson_fa, pearson_cross, pearson_valid over all pairs of words.

    hidden: model, layer, idx, vec (unit vectors; every word in every layer). cells: cue, response and weight;
    words: idx, word; valid: idx of the words that pearson_valid looks at. Every pair of blocks of words is a task
    that hands on counts, sums, squares and products per model and layer, so no pair is listed.
    """
    w = unit_rows(cells, weight).join(words.select(F.col("word").alias("cue"), "idx"), "cue")
    ids = dense_index(w.select("response").distinct(), ["response"], "id")
    rows = w.join(ids, "response").groupBy("idx").agg(F.collect_list(F.struct("id", "w")).alias("r"))
    per_word = words.select("idx").join(rows, "idx", "left").join(valid.select("idx", F.lit(True).alias("valid")), "idx", "left")
    none = F.array().cast("array<double>")
    per_word = per_word.select(
        "idx", F.coalesce(F.transform("r", lambda s: s["id"].cast("double")), none).alias("responses"), F.coalesce(F.transform("r", lambda s: s["w"]), none).alias("weights"), F.coalesce("valid", F.lit(False)).alias("valid")
    )
    kinds = ", ".join(f"{c} {t}" for c, t in hidden.select("model", "layer").dtypes)
    parts = _pair_blocks(hidden, per_word, block).groupBy("bi", "bj").applyInPandas(_block_sums, f"{kinds}, name string, n long, h double, x double, hh double, xx double, hx double")
    s = parts.groupBy("model", "layer", "name").agg(*[F.sum(c).alias(c) for c in ("n", "h", "x", "hh", "xx", "hx")])
    # A constant side leaves nothing but the rounding of its squares.
    spread = lambda a, aa: F.when(F.col(aa) - F.col(a) * F.col(a) / F.col("n") > F.col(aa) * 1e-12, F.col(aa) - F.col(a) * F.col(a) / F.col("n"))
    r = (F.col("hx") - F.col("h") * F.col("x") / F.col("n")) / F.sqrt(spread("h", "hh") * spread("x", "xx"))
    s = s.select("model", "layer", "name", "n", F.when(F.col("n") > 0, r).alias("r"))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("r"))).alias(f"pearson_{name}")
    return s.groupBy("model", "layer").agg(F.max(F.when(F.col("name") == "fa", F.col("n"))).alias("n_pairs"), of("fa"), of("cross"), of("valid"))


def all_pair_consensus(hidden: DataFrame, words: DataFrame, block: int = BLOCK) -> DataFrame:
    """model, i, j, sim: as consensus_sims, of all pairs i < j, by products of blocks."""
    return _pair_blocks(hidden, words.select("idx"), block).groupBy("bi", "bj").applyInPandas(_block_consensus, f"model {dict(hidden.dtypes)['model']}, i long, j long, sim double")


def overlap_at_k(left: DataFrame, right: DataFrame, words: DataFrame, k: int, *by: str) -> DataFrame:
    """by..., overlap: mean share of the k neighbours of each word that both lists hold; words without any count as 0.

    right may lack the columns `by`; then it holds for all of them.
    """
    keys = [*(c for c in by if c in right.columns), "word", "neighbour"]
    shared = left.join(right.select(*keys), keys).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
    groups = left.select(*by).distinct()
    every = groups.crossJoin(F.broadcast(words.agg(F.count(F.lit(1)).alias("n_words"))))  # one number
    return every.join(shared.groupBy(*by).agg(F.sum("n").alias("n")), list(by), "left").select(*by, (F.coalesce("n", F.lit(0)).cast("double") / k / F.col("n_words")).alias("overlap"))
