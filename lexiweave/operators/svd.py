"""Truncated SVD of a sparse cue by response matrix by randomised projection: blocks of the matrix stay in tasks, the driver holds squares of the dimension."""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.sources.workdir import stored

#: Cells of one block of the matrix, and directions that are kept beside those asked for.
BLOCK_CELLS, MORE = 500_000, 20


def _bytes(vectors: np.ndarray) -> list[bytes]:
    """Each row as one binary value, which passes between Spark and Python as it is."""
    return [v.tobytes() for v in np.ascontiguousarray(vectors, np.float64)]


def _vectors(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _directions(responses: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A random row for every response, made from its text: the same in every task."""
    return np.stack([np.random.default_rng([seed, zlib.crc32(r.encode()), zlib.adler32(r.encode())]).standard_normal(width) for r in responses])


def _project(width: int, seed: int):
    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        ids, row = np.unique(cells["idx"].to_numpy(), return_inverse=True)
        responses, column = np.unique(cells["response"].to_numpy(), return_inverse=True)
        return _summed(ids, row, _directions(responses, width, seed), column, cells["w"].to_numpy(), "idx")

    return run


def _summed(ids: np.ndarray, row: np.ndarray, vectors: np.ndarray, column: np.ndarray, w: np.ndarray, name: str) -> pd.DataFrame:
    """For each id the sum of the vectors of its cells, each times its weight."""
    out = np.zeros((len(ids), vectors.shape[1]))
    order = np.argsort(row, kind="stable")
    for part in np.array_split(order, max(1, len(order) * vectors.shape[1] // 2_000_000)):
        if len(part):
            own, first = np.unique(row[part], return_index=True)
            out[own] += np.add.reduceat(vectors[column[part]] * w[part, None], first, axis=0)
    return pd.DataFrame({name: ids, "v": _bytes(out)})


def _multiply(left: str, right: str):
    """Partial sums for the ids of `left` over the vectors of `right` in one block of the matrix."""

    def run(cells: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(cells) or not len(vectors):
            return pd.DataFrame({left: cells[left].iloc[:0], "v": []})
        ids, row = np.unique(cells[left].to_numpy(), return_inverse=True)
        known = pd.Index(vectors[right])
        return _summed(ids, row, _vectors(vectors["v"]), known.get_indexer(cells[right]), cells["w"].to_numpy(), left)

    return run


def _add_up(name: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(rows[name].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        out = np.add.reduceat(_vectors(rows["v"])[order], np.searchsorted(at[order], np.arange(len(ids))), axis=0)
        return pd.DataFrame({name: ids, "v": _bytes(out)})

    return run


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """The sum of all products of the vectors' parts: width by width, one such square for each of 64 tasks at most reaches the driver at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for f in frames:
            if len(f):
                v = _vectors(f["v"])
                total += v.T @ v
        yield pd.DataFrame({"g": [total.ravel()]})

    squares = vectors.select("v").coalesce(64).mapInPandas(run, "g array<double>")
    return sum((np.array(r["g"]).reshape(width, width) for r in squares.toLocalIterator()), np.zeros((width, width)))


def _times(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """vectors with v times a matrix that is as large as the dimension allows."""
    name = vectors.columns[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({name: f[name], "v": _bytes(_vectors(f["v"]) @ matrix) if len(f) else []})

    return vectors.mapInPandas(run, vectors.schema)


def _width(vectors: DataFrame) -> int:
    return len(vectors.first()["v"]) // 8


def _whiten(vectors: DataFrame, width: int) -> DataFrame:
    """Vectors of the same space as columns that are orthogonal and of length 1; directions of no length are left out."""
    values, axes = np.linalg.eigh(_gram(vectors, width))
    keep = values > max(values.max(), 1e-300) * 1e-12
    return _times(vectors, axes[:, keep] / np.sqrt(values[keep]))


def _as_arrays(vectors: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"idx": f["idx"], "vec": list(_vectors(f["v"])) if len(f) else []})

    return vectors.mapInPandas(run, f"idx {vectors.schema['idx'].dataType.simpleString()}, vec array<double>")


def svd_vectors(cells: DataFrame, weight: str, words: DataFrame, dim: int, *, rounds: int = 2, seed: int = 5, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """idx, vec: each cue's row times the first `dim` right singular vectors (U times Sigma), the largest singular value first.

    All responses are columns. The row space is found by random directions and `rounds` rounds of power
    iteration: every product is taken block by block (rows by columns of the matrix) and summed up by
    key, so neither all rows nor all columns meet in one task, and only squares of dim + 20 pass through
    the driver. Exact where dim + 20 reaches the rank, else close to it. Signs, and rotations within equal singular values, are
    arbitrary; compare cosines. Fewer than `dim` parts where the rank is less.
    """
    width = dim + MORE
    rows = cells.join(words.select(F.col("word").alias("cue"), "idx"), "cue").select("idx", "response", F.col(weight).cast("double").alias("w")).where("w <> 0")
    n = rows.agg(F.count(F.lit(1)).alias("cells")).first()["cells"]
    blocks = max(1, round((n / block_cells) ** 0.5))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = stored(rows.withColumns({"rb": block("idx"), "cb": block("response")}), "svd-cells")
    kinds = {"idx": placed.schema["idx"].dataType.simpleString(), "response": "string"}

    def added(parts: DataFrame, name: str) -> DataFrame:
        if blocks == 1:
            return stored(parts, "svd-part")
        return stored(parts.groupBy(block(name), F.pmod(F.xxhash64(name, F.lit(1)), F.lit(16))).applyInPandas(_add_up(name), parts.schema), "svd-part")

    def product(vectors: DataFrame, left: str, right: str) -> DataFrame:
        own, other = ("rb", "cb") if right == "idx" else ("cb", "rb")
        sent = vectors.withColumn(own, block(right)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        parts = placed.groupBy("rb", "cb").cogroup(sent.groupBy("rb", "cb")).applyInPandas(_multiply(left, right), f"{left} {kinds[left]}, v binary")
        return added(parts, left)

    y = added(placed.groupBy("rb", "cb").applyInPandas(_project(width, seed), f"idx {kinds['idx']}, v binary"), "idx")
    if y.isEmpty():
        return _as_arrays(y)
    for _ in range(rounds):
        z = product(stored(_whiten(y, width), "svd-rows"), "response", "idx")
        y = product(stored(_whiten(z, _width(z)), "svd-columns"), "idx", "response")
        width = _width(y)
    q = stored(_whiten(y, width), "svd-rows")
    z = product(q, "response", "idx")
    values, axes = np.linalg.eigh(_gram(z, _width(z)))
    top = np.argsort(-values)[:dim]
    top = top[values[top] > values.max() * 1e-12]
    return _as_arrays(_times(q, axes[:, top] * np.sqrt(values[top])))
