"""Cue by response counts, PPMI and the sparse cosine between cues."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lexiweave.operators.lexicon import dense_index
from lexiweave.sources.workdir import stored


def count_pairs(rows: DataFrame, *by: str) -> DataFrame:
    """by..., cue, response, cnt over rows where both texts are there and differ."""
    keep = rows.where("cue is not null and response is not null and cue <> response")
    return keep.groupBy(*by, "cue", "response").agg(F.count(F.lit(1)).alias("cnt"))


def with_marginals(counts: DataFrame, *by: str) -> DataFrame:
    """counts with row_sum, col_sum and total, each within `by`.

    Sums are aggregated first and joined back, so a response that most cues share is no window of its own.
    """
    rows = counts.groupBy(*by, "cue").agg(F.sum("cnt").alias("row_sum"))
    cols = counts.groupBy(*by, "response").agg(F.sum("cnt").alias("col_sum"))
    df = counts.join(rows, [*by, "cue"]).join(cols, [*by, "response"])
    if by:
        return df.join(counts.groupBy(*by).agg(F.sum("cnt").alias("total")), list(by))
    return df.crossJoin(F.broadcast(counts.agg(F.sum("cnt").alias("total"))))  # one row


def ppmi(counts: DataFrame, *by: str) -> DataFrame:
    """counts with ppmi = max(0, ln(cnt * total / (row_sum * col_sum))) of the cells that are there."""
    cell = F.col("cnt").cast("double") * F.col("total") / (F.col("row_sum").cast("double") * F.col("col_sum"))
    return with_marginals(counts, *by).withColumn("ppmi", F.greatest(F.log(cell), F.lit(0.0)))


def row_statistics(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """Per model and for all (model 'ALL'): n_cues of the cleaned input, total count, mean count per cue (a cue without counts is 0)."""
    cues = rows.where("cue is not null").groupBy("model").agg(F.count_distinct("cue").alias("n_cues"))
    sums = counts.groupBy("model").agg(F.sum("cnt").alias("total"))
    per = cues.join(sums, "model", "left").select("model", "n_cues", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    every = per.agg(F.lit("ALL").alias("model"), F.sum("n_cues").alias("n_cues"), F.sum("total").alias("total"))
    return per.unionByName(every).withColumn("mean_per_cue", F.col("total").cast("double") / F.col("n_cues"))


def unit_rows(cells: DataFrame, weight: str, *by: str) -> DataFrame:
    """by..., cue, response, w: each cue's weights over their length. Cues of length 0 are left out; their similarity is 0."""
    lengths = cells.groupBy(*by, "cue").agg(F.sqrt(F.sum(F.col(weight).cast("double") * F.col(weight))).alias("length")).where("length > 0")
    return cells.where(F.col(weight) != 0).join(lengths, [*by, "cue"]).select(*by, "cue", "response", (F.col(weight) / F.col("length")).alias("w"))


#: Cues of one block of a product, responses that are made dense at a time, and cells of one task.
BLOCK_CUES, DENSE_RESPONSES, TASK_CELLS = 1_024, 2_048, 1_000_000


def _best_of(names: np.ndarray, others: np.ndarray, sims: np.ndarray, k: int) -> pd.DataFrame:
    """word, neighbour, sim of the k largest of each row; others are in text order, so ties go to the smaller."""
    top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(names)), top.shape[1])
    out = pd.DataFrame({"word": names[row], "neighbour": others[top.ravel()], "sim": sims[row, top.ravel()]})
    return out[np.isfinite(out.sim)]


def _block_product(by: list[str], best: int | None = None):
    """All pairs of two blocks that share a response; with best, only each cue's nearest in the other block."""

    def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        responses, r = np.unique(rows.response.to_numpy(), return_inverse=True)
        sides = []
        same = key[0] == key[1]
        for side in (0, 0) if same else (0, 1):
            own = (rows.side == side).to_numpy()
            cues, c = np.unique(rows.cue.to_numpy()[own], return_inverse=True)
            order = np.argsort(r[own], kind="stable")
            sides.append((cues, c[order], r[own][order], rows.w.to_numpy()[own][order]))
        (ca, ia, ra, wa), (cb, ib, rb, wb) = sides
        sims, met = np.zeros((len(ca), len(cb))), np.zeros((len(ca), len(cb)), bool)
        for at in range(0, len(responses), DENSE_RESPONSES):
            dense = []
            for cues, i, rr, w in sides:
                lo, hi = np.searchsorted(rr, at), np.searchsorted(rr, at + DENSE_RESPONSES)
                m = np.zeros((len(cues), min(DENSE_RESPONSES, len(responses) - at)))
                m[i[lo:hi], rr[lo:hi] - at] = w[lo:hi]
                dense.append(m)
            sims += dense[0] @ dense[1].T
            met |= ((dense[0] != 0).astype(np.float32) @ (dense[1] != 0).astype(np.float32).T) > 0
        if best is not None:
            sims = np.where(met, np.round(sims, 9), -np.inf)
            if same:
                np.fill_diagonal(sims, -np.inf)
            out = pd.concat([_best_of(ca, cb, sims, best)] + ([] if same else [_best_of(cb, ca, sims.T, best)]))
            for k, v in zip(by, key[3:]):
                out[k] = pd.Series([v] * len(out), dtype="object", index=out.index)
            return out[[*by, "word", "neighbour", "sim"]]
        keep_i, keep_j = np.nonzero(met)
        left, right, sim = ca[keep_i], cb[keep_j], sims[keep_i, keep_j]
        other = left != right
        if same:
            other &= left < right
        left, right, sim = left[other], right[other], sim[other]
        swap = left > right
        out = pd.DataFrame({"cue_i": np.where(swap, right, left), "cue_j": np.where(swap, left, right), "sim": sim})
        for k, v in zip(by, key[3:]):
            out[k] = pd.Series([v] * len(out), dtype="object")
        return out[[*by, "cue_i", "cue_j", "sim"]]

    return product


def _blocks(cells: DataFrame, weight: str, by: tuple[str, ...], block: int, task_cells: int, sliced: bool) -> DataFrame:
    """Unit rows keyed by pair of blocks of cues and, with sliced, slice of responses; without, blocks are so many that each has about task_cells cells at most."""
    w = unit_rows(cells, weight, *by)
    n = w.agg(F.count(F.lit(1)).alias("cells"), F.approx_count_distinct("cue", 0.02).alias("cues")).first()
    blocks, slices = max(1, -(-n["cues"] // block)), max(1, -(-n["cells"] // task_cells))
    if not sliced:
        blocks, slices = max(blocks, slices), 1
    own = F.pmod(F.xxhash64("cue", F.lit(1)), F.lit(blocks)).cast("int")
    placed = w.select(*by, "cue", "response", "w", own.alias("own"), F.pmod(F.xxhash64("response"), F.lit(slices)).cast("int").alias("slice"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keyed = met.select(*by, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "slice", (F.col("own") > F.col("other")).cast("int").alias("side"), "cue", "response", "w")
    return keyed


def _pair_schema(df: DataFrame, by: tuple[str, ...], left: str, right: str) -> StructType:
    return StructType([*df.select(*by).schema.fields, StructField(left, StringType()), StructField(right, StringType()), StructField("sim", DoubleType())])


def cosine_pairs(cells: DataFrame, weight: str, *by: str, block: int = BLOCK_CUES, task_cells: int = TASK_CELLS) -> DataFrame:
    """by..., cue_i < cue_j, sim of all pairs of cues that share a response (the others are 0).

    Rows are normalised first. Cues are parted into blocks and responses into slices; each pair of
    blocks is a matrix product per slice, and the slices are summed up. So a response that most cues
    share is one more column of the products, and its pairs of cues are never listed.
    """
    keyed = _blocks(cells, weight, by, block, task_cells, True)
    parts = keyed.groupBy("bi", "bj", "slice", *by).applyInPandas(_block_product(list(by)), _pair_schema(keyed, by, "cue_i", "cue_j"))
    return parts.groupBy(*by, "cue_i", "cue_j").agg(F.sum("sim").alias("sim"))


def nearest_by_cosine(cells: DataFrame, weight: str, k: int, *by: str, block: int = BLOCK_CUES, task_cells: int = TASK_CELLS) -> DataFrame:
    """by..., word, neighbour, sim (to 9 digits), place: the k nearest cues of each cue that share a response with it.

    Ties go to the smaller neighbour. Each product of two blocks of cues runs over all their responses
    and hands on only the k best of its cues, however many responses or cells there are.
    """
    keyed = _blocks(cells, weight, by, block, task_cells, False)
    parts = keyed.groupBy("bi", "bj", "slice", *by).applyInPandas(_block_product(list(by), k), _pair_schema(keyed, by, "word", "neighbour"))
    w = Window.partitionBy(*by, "word").orderBy(F.col("sim").desc(), "neighbour")
    return parts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


#: Entries of a product that are held at a time, and where blocks are small enough for a processor's cache.
HELD, NEAR_HELD = 4_000_000, 300_000


def sparse_product(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], n_a: int, n_b: int, held: int = HELD) -> Iterator[tuple[int, np.ndarray]]:
    """First row, dense rows of the product of two sparse blocks (row, column, weight), some rows of a at a time.

    Only the cells that meet are multiplied, so the work is that of the shared columns, however long the rows are.
    """
    order = np.argsort(a[0], kind="stable")
    ia, ra, wa = (x[order] for x in a)
    order = np.argsort(b[1], kind="stable")
    ib, rb, wb = (x[order] for x in b)
    lo = np.searchsorted(rb, ra, "left")
    met = np.searchsorted(rb, ra, "right") - lo
    starts = np.searchsorted(ia, np.arange(n_a + 1))
    work = np.concatenate([[0], np.cumsum(met)])[starts]
    at, most = 0, max(1, held // max(1, n_b))
    while at < n_a:
        end = min(n_a, at + most, max(at + 1, int(np.searchsorted(work, work[at] + held, "right")) - 1))
        own = slice(starts[at], starts[end])
        n = met[own]
        right = np.repeat(lo[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat((ia[own] - at) * n_b, n) + ib[right]
        yield at, np.bincount(key, np.repeat(wa[own], n) * wb[right], (end - at) * n_b).reshape(end - at, n_b)
        at = end


#: Neighbouring columns whose largest entry is looked at first.
RUN = 64


def _best_columns(dense: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values (to 9 digits) of the k largest entries over 0 of each row, ties by column; -inf where there are fewer. Rows are as long as some runs."""
    known = lambda x: np.where(x > 0, np.round(x, 9), -np.inf)
    runs = known(dense.reshape(len(dense), -1, RUN).max(axis=2))
    # An entry of the k best lies in one of the k best runs, as each better run holds a better entry.
    run = np.sort(np.argsort(-runs, axis=1, kind="stable")[:, :k], axis=1)
    columns = (run[:, :, None] * RUN + np.arange(RUN)).reshape(len(dense), -1)
    values = known(np.take_along_axis(dense, columns, axis=1))
    top = np.argsort(-values, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(columns, top, axis=1), np.take_along_axis(values, top, axis=1)


#: Parts of the left side of a product of all blocks at most, and of the right side.
LEFT_PARTS, RIGHT_PARTS = 200, 1_000
_PACKED = "block int, cues array<string>, c binary, at binary, r binary, w binary"


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: its cues in text order, their numbers, and of each cell the place of the cue, the response and the weight."""
    c, first, at = np.unique(rows.c.to_numpy(), return_index=True, return_inverse=True)
    cells = (c.astype(np.int64).tobytes(), at.astype(np.int32).tobytes(), rows.r.to_numpy(np.int64).tobytes(), rows.w.to_numpy(np.float64).tobytes())
    return pd.DataFrame([(key[0], rows.cue.to_numpy()[first].tolist(), *cells)], columns=["block", "cues", "c", "at", "r", "w"])


#: Neighbouring cues that stay together when ranges of cues are cut.
TOGETHER = 32


def _ranges(w: DataFrame, task_cells: int) -> DataFrame:
    """cue, c, block: cues numbered in text order and cut into ranges of about task_cells cells, however unlike they are in cells."""
    cues = dense_index(w.groupBy("cue").agg(F.count(F.lit(1)).alias("n")), ["cue"], "c").withColumn("some", F.floor(F.col("c") / TOGETHER))
    before = Window.orderBy("some").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cues.groupBy("some").agg(F.sum("n").alias("n")).select("some", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / task_cells).cast("int").alias("block"))  # one row for TOGETHER cues
    return cues.join(blocks, "some").select("cue", "c", "block")


def _pairs_of_blocks(cells: DataFrame, weight: str, task_cells: int, run: int, every: bool, ranges: bool = False) -> DataFrame:
    """Rows of two blocks of cues of about task_cells cells each: every ordered pair, or with every false those of block <= b_block.

    A block is one packed row, and each side is stored once: tasks of a Cartesian product read the blocks
    they need, `run` of the right side after one another for each of the left, so nothing is copied per pair.
    With ranges, a block is a range of cues in text order, and the first block has the smaller cues.
    """
    w = stored(unit_rows(cells, weight), "unit-rows")
    blocks = max(1, -(-w.count() // task_cells))
    if ranges:
        cues = _ranges(w, task_cells)
    else:
        cues = dense_index(w.select("cue").distinct(), ["cue"], "c").withColumn("block", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int"))
    responses = dense_index(w.select("response").distinct(), ["response"], "r")
    placed = w.join(cues, "cue").join(responses, "response").select("block", "cue", "c", "r", "w")
    packed = stored(placed.groupBy("block").applyInPandas(_pack, _PACKED), "blocks")
    left = packed.repartitionByRange(min(blocks, LEFT_PARTS), "block")
    right = packed.select(*(F.col(c).alias(f"b_{c}") for c in packed.columns)).repartitionByRange(min(-(-blocks // run), RIGHT_PARTS), "b_block")
    return left.hint("shuffle_replicate_nl").join(right, F.lit(True) if every else F.col("block") <= F.col("b_block"))


def _sides(pair: dict) -> list[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """Of both blocks of a row: the cues, their numbers in text order, and the cells as places of cues, responses, weights."""
    at = lambda name, kind: np.frombuffer(pair[name], kind)
    return [(np.array(pair[f"{b}cues"], object), at(f"{b}c", np.int64), (at(f"{b}at", np.int32).astype(np.int64), at(f"{b}r", np.int64), at(f"{b}w", np.float64))) for b in ("", "b_")]


def _each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def nearest_of_all(cells: DataFrame, weight: str, k: int, *, task_cells: int = 50_000) -> DataFrame:
    """As nearest_by_cosine, for weights of 0 and more and any number of cues: only cells of a common response are multiplied.

    A task goes through a run of blocks for each of its own blocks and hands on the k best of each cue.
    """
    schema = pa.schema([("word", pa.string()), ("neighbour", pa.string()), ("sim", pa.float64())])

    def best_of_two(pair: dict, top: list[np.ndarray] | None) -> tuple[np.ndarray, list[np.ndarray]]:
        (words, _, a), (others, c, b) = _sides(pair)
        more = -len(others) % RUN
        others, c, found = np.append(others, [""] * more), np.append(c, np.zeros(more, np.int64)), []
        for at, dense in sparse_product(a, b, len(words), len(others), NEAR_HELD):
            row = np.arange(len(dense))
            if pair["block"] == pair["b_block"]:
                dense[row, at + row] = 0
            if top is None:
                columns, values = _best_columns(dense, k)
                found.append([others[columns], c[columns], values])
                continue
            # Only entries that reach the last of the k best so far, rounded as it is, can be among the best.
            before = [x[at : at + len(dense)] for x in top]
            least = before[2][:, -1] if before[2].shape[1] == k else np.full(len(dense), -np.inf)
            row, column = np.nonzero(dense >= np.maximum(least - 1e-9, 1e-300)[:, None])
            sizes = np.bincount(row, minlength=len(dense))
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            new = [np.full((len(dense), sizes.max(initial=0)), x, t) for x, t in (("", object), (0, np.int64), (-np.inf, np.float64))]
            for x, y in zip(new, (others[column], c[column], np.round(dense[row, column], 9))):
                x[row, place] = y
            both = [np.concatenate(x, axis=1) for x in zip(before, new)]
            best = np.lexsort((both[1], -both[2]), axis=1)[:, :k]
            found.append([np.take_along_axis(x, best, axis=1) for x in both])
        return words, [np.concatenate(x) for x in zip(*found)]

    def rows(words: np.ndarray, names: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(values))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((words[row], names[row, place], values[row, place]), schema.types)], schema=schema)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, top = None, None, None
        for pair in _each_pair(batches):
            if block is not None and pair["block"] != block:
                yield rows(words, top[0], top[2])
                top = None
            words, top = best_of_two(pair, top)
            block = pair["block"]
        if block is not None:
            yield rows(words, top[0], top[2])

    parts = _pairs_of_blocks(cells, weight, task_cells, 16, True).mapInArrow(best, "word string, neighbour string, sim double")
    w = Window.partitionBy("word").orderBy(F.col("sim").desc(), "neighbour")
    return parts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _scaled(x: np.ndarray, digits: int) -> np.ndarray:
    """Values of 0 and more as whole numbers of the last of so many digits, halves up: DuckDB's round, where Spark's goes through decimal text."""
    scaled = x * 10.0**digits
    low = np.floor(scaled)
    return (low + (scaled - low >= 0.5)).astype(np.int64)


#: Pairs that are sorted at a time, pairs of one batch that leaves a task, and bits of the place of a cue among those of a task.
SORTED, BATCH, PLACE_BITS = 32_000_000, 100_000, 21


def cosine_of_all(cells: DataFrame, weight: str, *, digits: int | None = None, task_cells: int = 50_000) -> DataFrame:
    """As cosine_pairs, for weights of 0 and more and any number of cues. Pairs leave the products as they are listed: they are neither summed up nor joined afterwards.

    With digits, sim is rounded to so many, and a task hands on the pairs of all its blocks in the order of sim, SORTED at a time:
    equal values stand together, so a file holds a pair in fewer bytes where they are many and come up again and again; where they hardly do, in more.
    Blocks are then ranges of cues, so a file has few different first cues.
    """
    schema = pa.schema([("cue_i", pa.string()), ("cue_j", pa.string()), ("sim", pa.float64())])
    if digits is not None and 10**digits >> 62 - 2 * PLACE_BITS:
        raise ValueError(f"{digits} digits and 2 places of {PLACE_BITS} bits don't fit a whole number")

    def listed(pair: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of the smaller and the larger cue among the cues of both blocks, sim."""
        (left, ca, a), (right, cb, b) = _sides(pair)
        for at, dense in sparse_product(a, b, len(left), len(right), NEAR_HELD):
            row, column = np.nonzero(dense)
            i, j, sim = at + row, len(left) + column, dense[row, column]
            swap = ca[i] > cb[column]
            if pair["block"] == pair["b_block"]:
                i, j, sim, swap = (x[ca[i] < cb[column]] for x in (i, j, sim, swap))
            yield np.where(swap, j, i), np.where(swap, i, j), sim

    def rows(names: pa.Array, i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(sim)], schema=schema)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _each_pair(batches):
            names = pa.array([*pair["cues"], *pair["b_cues"]], pa.string())
            for found in listed(pair):
                yield rows(names, *found)

    def by_sim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same in the order of sim. A pair is one number while it is sorted, in place: sim before the places among the cues that the task has met."""
        keys, n, cues, first = np.empty(SORTED, np.int64), 0, [], {}
        mask = (1 << PLACE_BITS) - 1

        def sorted_rows() -> Iterator[pa.RecordBatch]:
            names, full = pa.array(cues, pa.string()), keys[:n]
            full.sort()
            for at in range(0, n, BATCH):
                key = full[at : at + BATCH]
                yield rows(names, key >> PLACE_BITS & mask, key & mask, (key >> 2 * PLACE_BITS) / 10.0**digits)

        for pair in _each_pair(batches):
            if len(cues) + len(pair["cues"]) + len(pair["b_cues"]) > mask:
                yield from sorted_rows()
                n, cues, first = 0, [], {}
            for block in ("block", "cues"), ("b_block", "b_cues"):
                if pair[block[0]] not in first:
                    first[pair[block[0]]] = len(cues)
                    cues.extend(pair[block[1]])
            sizes = len(pair["cues"]), len(pair["b_cues"])
            place = np.concatenate([first[pair[b]] + np.arange(size) for b, size in zip(("block", "b_block"), sizes)])
            for i, j, sim in listed(pair):
                key = _scaled(sim, digits) << 2 * PLACE_BITS | place[i] << PLACE_BITS | place[j]
                while len(key):
                    more = key[: SORTED - n]
                    keys[n : n + len(more)] = more
                    key, n = key[len(more) :], n + len(more)
                    if n == SORTED:
                        yield from sorted_rows()
                        n = 0
        yield from sorted_rows()

    pairs = _pairs_of_blocks(cells, weight, task_cells, 4 if digits is None else 8, False, digits is not None)
    return pairs.mapInArrow(met if digits is None else by_sim, "cue_i string, cue_j string, sim double")


def both_ways(pairs: DataFrame, i: str = "cue_i", j: str = "cue_j") -> DataFrame:
    """Every pair in both directions."""
    return pairs.unionByName(pairs.withColumnsRenamed({i: "_x", j: i}).withColumnRenamed("_x", j))
