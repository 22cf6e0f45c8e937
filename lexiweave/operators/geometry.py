"""Dense vectors per word and layer: centring, cosines between all words of bounded blocks, nearest neighbours."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexiweave.functions.vectors import minus, normalized

#: Words of one block of a matrix product.
BLOCK = 1_024


def mean_vector(vectors: DataFrame, *by: str) -> DataFrame:
    """by..., mean: the average vector, position by position."""
    flat = vectors.select(*by, F.posexplode("vec").alias("at", "x"))
    means = flat.groupBy(*by, "at").agg(F.avg("x").alias("x"))
    sorted_ = F.array_sort(F.collect_list(F.struct("at", "x")))  # as long as one vector
    return means.groupBy(*by).agg(F.transform(sorted_, lambda s: s["x"]).alias("mean"))


def centred(vectors: DataFrame, *by: str, of: DataFrame | None = None) -> DataFrame:
    """vectors minus the mean of their group (of the rows `of`, if given), each over its length (at least 1e-12)."""
    means = mean_vector(vectors if of is None else of, *by)
    df = vectors.join(F.broadcast(means), list(by)) if by else vectors.crossJoin(F.broadcast(means))  # one vector per group
    return df.withColumn("vec", normalized(minus(F.col("vec"), F.col("mean")))).drop("mean")


def _best_of(sims: np.ndarray, word: np.ndarray, other: np.ndarray, k: int) -> pd.DataFrame:
    """word, neighbour, sim of the k largest entries of each row; ties (to 12 digits) go to the smaller word: sorted by it first, then by similarity, stably."""
    order = np.argsort(other, kind="stable")
    sims, other = np.round(sims[:, order], 12), other[order]
    at = np.argsort(-sims, axis=1, kind="stable")[:, : min(k, sims.shape[1])]
    rows = np.repeat(np.arange(len(word)), at.shape[1])
    out = pd.DataFrame({"word": word[rows], "neighbour": other[at.ravel()], "sim": sims[rows, at.ravel()]})
    return out[np.isfinite(out.sim)]


def _best_of_blocks(k: int, by: list[str], columns: list[str]):
    """The k best of each word of two blocks in the other one, both ways from one product; or within one block."""

    def best(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        left = block[block.side == 0]
        right = left if key[0] == key[1] else block[block.side == 1]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        sims = np.stack(left.vec.to_list()) @ np.stack(right.vec.to_list()).T
        wi, wj = left.word.to_numpy(), right.word.to_numpy()
        sims[wi[:, None] == wj[None, :]] = -np.inf
        out = pd.concat([_best_of(sims, wi, wj, k)] + ([] if key[0] == key[1] else [_best_of(sims.T, wj, wi, k)]))
        for c, v in zip(by, key[2:]):
            out[c] = v
        return out[columns]

    return best


def nearest(vectors: DataFrame, k: int, *by: str, words: int | None = None, block: int = BLOCK) -> DataFrame:
    """by..., word, neighbour, sim, place: the k nearest words of each word by the dot product of unit vectors.

    Exact: words are parted into blocks, every pair of blocks is one matrix product in a task, which
    hands on only the k best of each word of either, and a window takes the best of these. Ties (to 12 digits) go to the smaller
    word. A word is not its own neighbour; with n words there are at most n - 1 neighbours.
    """
    words = vectors.select("word").distinct().count() if words is None else words
    blocks = max(1, -(-words // block))
    own = vectors.withColumn("own", F.pmod(F.xxhash64("word"), F.lit(blocks)))
    sides = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keyed = sides.select(*by, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).cast("int").alias("side"), "word", "vec")
    schema = StructType([*vectors.select(*by).schema.fields, *(StructField(c, vectors.schema["word"].dataType) for c in ("word", "neighbour"))]).add("sim", "double")
    parts = keyed.groupBy("bi", "bj", *by).applyInPandas(_best_of_blocks(k, list(by), schema.names), schema)
    w = Window.partitionBy(*by, "word").orderBy(F.col("sim").desc(), "neighbour")
    return parts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def embedding_layers(embeddings: DataFrame, layers: int = 4) -> DataFrame:
    """model, layer, word, vec: embeddings cut into layers of equal width, dimensions of even and odd number as two models."""
    width = (F.size("embedding") / layers).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(layers - 1)), lambda n: F.slice("embedding", n * width + 1, width))
    by_layer = embeddings.select(F.col("vec_id").alias("word"), F.posexplode(cut).alias("layer", "part"))

    def every_second(rest: int):
        return F.filter("part", lambda x, i: i % 2 == rest).cast("array<double>")

    parts = F.array(*[F.struct(F.lit(m).alias("model"), every_second(r).alias("vec")) for r, m in enumerate(("even", "odd"))])
    return by_layer.select("layer", "word", F.explode(parts).alias("p")).select("p.model", "layer", "word", "p.vec")
