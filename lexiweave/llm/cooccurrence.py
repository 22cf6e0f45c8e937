"""Problem 3: items that appear together in one record, and how much more often than chance."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.text import fingerprint
from lexiweave.llm.common import BROADCAST_BYTES, folded_rows, sized
from lexiweave.operators.lexicon import dense_index
from lexiweave.sources.workdir import stored

#: Frequent items that get a row in the bit matrix.
HEAVY_ITEMS = 512
#: Records of one block of the bit matrix.
BLOCK_RECORDS = 65_536
#: Records with more items than this are wide: their pairs are never listed, but counted between blocks of items.
WIDE = 256
#: Items of one block of the wide records' bit matrix.
BLOCK_ITEMS = 1_024
#: Pairs that one task lists before it counts them, and rows of wide records that it holds at a time.
LISTED_PAIRS = 4_000_000
WIDE_ROWS = 1_000_000

_PAIRS = "a long, b long, n long"
_PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _popcounts(bits: np.ndarray, others: np.ndarray) -> Iterator[np.ndarray]:
    """For each row of bits: in how many columns it and each row of others are both set."""
    for row in bits:
        yield np.bitwise_count(row & others).sum(axis=1, dtype=np.int64)


def _bit_rows(row: np.ndarray, column: np.ndarray, rows: int, columns: int) -> np.ndarray:
    bits = np.zeros((rows, -(-columns // 64)), np.uint64)
    np.bitwise_or.at(bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return bits


def _count_block(record: np.ndarray, item: np.ndarray, heavy: int, dense: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of the block's records. Heavy pairs are added to dense; the others are returned as listed pairs.

    record: 0, 1, ... rising; item: ascending within its record, no item twice; items below heavy are heavy.
    """
    n = int(record[-1]) + 1
    is_heavy = item < heavy
    if is_heavy.any():
        bits = _bit_rows(item[is_heavy], record[is_heavy], heavy, n)
        seen = np.flatnonzero(bits.any(axis=1))
        for k, counts in enumerate(_popcounts(bits[seen], bits[seen])):
            dense[seen[k], seen[k + 1 :]] += counts[k + 1 :]
    light, light_at = item[~is_heavy], record[~is_heavy]
    # Mixed pairs: each light item of a record probes the record's list of heavy items.
    listed, listed_at = item[is_heavy], record[is_heavy]
    begin, end = np.searchsorted(listed_at, light_at, "left"), np.searchsorted(listed_at, light_at, "right")
    many = end - begin
    if many.sum():
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield listed[np.repeat(begin, many) + step], np.repeat(light, many)
    # Rare pairs: within a record each light item with the d-th after it.
    d = 1
    while d < len(light):
        same = light_at[d:] == light_at[:-d]
        if not same.any():
            break
        yield light[:-d][same], light[d:][same]
        d += 1


def _starts(r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """Where a record begins."""
    fresh = np.ones(len(r1), bool)
    fresh[1:] = (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])
    return np.flatnonzero(fresh)


def _last_start(r1: np.ndarray, r2: np.ndarray) -> int:
    return int(_starts(r1, r2)[-1]) if len(r1) else 0


def _cuts(r1: np.ndarray, r2: np.ndarray, most: int = LISTED_PAIRS) -> Iterator[slice]:
    """Whole records, so many at a time that they list at most `most` pairs, or one record."""
    start = _starts(r1, r2)
    size = np.diff(np.append(start, len(r1)))
    part = np.cumsum(size * (size - 1) // 2) // most
    first = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(first, np.append(first[1:], len(start))):
        yield slice(int(start[a]), int(start[b]) if b < len(start) else len(r1))


def _pair_counter(heavy: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((heavy, heavy), np.int64)

        def block(r1: np.ndarray, r2: np.ndarray, item: np.ndarray) -> Iterator[pa.RecordBatch]:
            fresh = np.ones(len(r1), bool)
            fresh[1:] = (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])
            lists = list(_count_block(np.cumsum(fresh) - 1, item, heavy, dense))
            if lists:
                a, b = (np.concatenate(x) for x in zip(*lists))
                ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
                key, n = np.unique(code[: len(a)] * len(ids) + code[len(a) :], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[key // len(ids)]), pa.array(ids[key % len(ids)]), pa.array(n.astype(np.int64))], schema=_PAIRS_ARROW)

        held = tuple(np.empty(0, np.int64) for _ in range(3))
        for b in batches:
            held = tuple(np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
            if len(held[0]) >= BLOCK_RECORDS:
                cut = _last_start(held[0], held[1])  # the last record may go on in the next batch
                for rows in _cuts(held[0][:cut], held[1][:cut]):
                    yield from block(*(h[rows] for h in held))
                held = tuple(h[cut:] for h in held)
        for rows in _cuts(held[0], held[1]):
            yield from block(*(h[rows] for h in held))
        a, b = np.nonzero(dense)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(dense[a, b])], schema=_PAIRS_ARROW)

    return count


def _wide_counter(least: int, blocks: int, width: int):
    """Pairs of two blocks of items in wide records: popcounts of bit matrices over records, added to what the narrow records gave."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        dense = np.zeros((0, 0), np.int64)
        ids = np.zeros((2, width), np.int64)
        held: list[np.ndarray] = []

        def add(rows: np.ndarray) -> None:
            start = _starts(rows[0], rows[1])
            record = np.repeat(np.arange(len(start)), np.diff(np.append(start, rows.shape[1])))
            side, at = (rows[2] % blocks != key[0]).astype(np.int64), rows[2] // blocks
            ids[side, at] = rows[3]
            bits = [_bit_rows(at[side == s], record[side == s], width, len(start)) for s in (0, 1)]
            left = np.flatnonzero(bits[0].any(axis=1))
            for k, n in zip(left, _popcounts(bits[0][left], bits[0] if key[0] == key[1] else bits[1])):
                dense[k] += n

        def flush(end: bool) -> None:
            if held:
                rows = np.concatenate(held, axis=1)
                held.clear()
                cut = rows.shape[1] if end else _last_start(rows[0], rows[1])
                if cut:
                    add(rows[:, :cut])
                if cut < rows.shape[1]:
                    held.append(rows[:, cut:])

        def out() -> Iterator[pa.RecordBatch]:
            flush(True)
            if key[0] == key[1]:
                dense[np.tril_indices(width)] = 0
            a, b = np.nonzero(dense >= least)
            if len(a):
                x, y = ids[0][a], ids[0 if key[0] == key[1] else 1][b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(dense[a, b])], schema=_PAIRS_ARROW)

        for b in batches:
            if not b.num_rows:
                continue
            i, j, r1, r2, num, item, other, num2, n = (b.column(c).to_numpy(zero_copy_only=False) for c in range(9))
            part = i * blocks + j
            cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for lo, hi in zip(cut, cut[1:]):
                if key != (i[lo], j[lo]):
                    if key is not None:
                        yield from out()
                    key, dense = (int(i[lo]), int(j[lo])), np.zeros((width, width), np.int64)
                rows = slice(lo, hi)
                known = n[rows] > 0  # what narrow records gave
                if known.any():
                    x, y, xi, yi = num[rows][known], num2[rows][known], item[rows][known], other[rows][known]
                    turn = (x % blocks != key[0]) | ((key[0] == key[1]) & (x > y))
                    x, y, xi, yi = np.where(turn, y, x), np.where(turn, x, y), np.where(turn, yi, xi), np.where(turn, xi, yi)
                    ids[0, x // blocks], ids[0 if key[0] == key[1] else 1, y // blocks] = xi, yi
                    np.add.at(dense, (x // blocks, y // blocks), n[rows][known])
                if not known.all():
                    held.append(np.stack([r1[rows], r2[rows], num[rows], item[rows]])[:, ~known])
                    if sum(h.shape[1] for h in held) >= WIDE_ROWS:
                        flush(False)
        if key is not None:
            yield from out()

    return count


def _wide_pairs(wide: DataFrame, listed: DataFrame, least: int, block_items: int) -> DataFrame:
    """a, b, n of all pairs of `listed` (from narrow records) and of `wide`, those of two wide items only if n >= least.

    wide: r1, r2, item of the wide records. Items of wide records are numbered and dealt to blocks; each
    posting goes to the pairs of blocks it may meet, sorted by record, and each pair of blocks is counted
    by popcounts, some records at a time, on top of the listed pairs of its items. So no list of a pair's
    or an item's records is ever formed.
    """
    numbers = stored(dense_index(wide.select("item").distinct(), ["item"], "num").withColumn("num", F.col("num") - 1), "p3-wide")
    items = numbers.count()
    blocks = max(1, -(-items // block_items))
    width = -(-items // blocks)
    block = lambda c: F.pmod(c, F.lit(blocks))
    posted = wide.join(sized(numbers), "item").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least(block(F.col("num")), "other").cast("long").alias("i"), F.greatest(block(F.col("num")), "other").cast("long").alias("j"), "r1", "r2", "num", "item",
        *[F.lit(0).cast("long").alias(c) for c in ("item2", "num2", "n")],
    )
    x, y = numbers.select(F.col("item").alias("a"), F.col("num").alias("x")), numbers.select(F.col("item").alias("b"), F.col("num").alias("y"))
    known = listed.join(sized(stored(x, "p3-x")), "a", "left").join(sized(stored(y, "p3-y")), "b", "left")
    both = known.where("x is not null and y is not null").select(
        F.least(block(F.col("x")), block(F.col("y"))).alias("i"), F.greatest(block(F.col("x")), block(F.col("y"))).alias("j"), F.lit(0).cast("long").alias("r1"), F.lit(0).cast("long").alias("r2"),
        F.col("x").alias("num"), F.col("a").alias("item"), F.col("b").alias("item2"), F.col("y").alias("num2"), "n",
    )
    keyed = posted.unionByName(both).repartition("i", "j").sortWithinPartitions("i", "j", "r1", "r2")
    met = keyed.mapInArrow(_wide_counter(least, blocks, width), _PAIRS)
    return known.where("x is null or y is null").select("a", "b", "n").unionByName(met)


def pairs_together(
    postings: DataFrame, *, least: int = 5, lift: float = 6.0, heavy_items: int = HEAVY_ITEMS, wide: int = WIDE, block_items: int = BLOCK_ITEMS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """assoc_a, assoc_b (assoc_a < assoc_b), n, na, nb, n_records, lift: pairs in n >= least records with n * N >= lift * na * nb.

    postings: item (string), r1, r2 (the record's fingerprint), each row once, in a stored table.

    Heavy-light decomposition by the items' record counts. The `heavy_items` most frequent ones are
    rows of a dense bit matrix over blocks of records; their pairs are popcounts. Pairs of rare items
    are counted by hash, and a rare item probes its record's list of heavy ones for the mixed pairs.
    Left out before are only items that no result pair can hold: n is at most na, so a pair needs
    na >= least and N >= lift * na. Records with over `wide` items left are never expanded into
    pairs; see _wide_pairs.

    Null items are left out. An empty input gives an empty result.
    """
    spark = postings.sparkSession
    postings = postings.where(F.col("item").isNotNull())
    total = postings.select("r1", "r2").distinct().count()
    counts = postings.groupBy("item").agg(F.count(F.lit(1)).alias("na")).where((F.col("na") >= least) & (F.col("na") * lift <= total))
    counts = stored(counts, "p3-counts")
    top = [r["item"] for r in counts.orderBy(F.col("na").desc(), "item").limit(heavy_items).collect()]  # at most heavy_items texts
    head = spark.createDataFrame([(t, k) for k, t in enumerate(top)], "item string, head long")
    code = F.coalesce(F.col("head"), F.lit(heavy_items) + F.monotonically_increasing_id())
    items = stored(counts.join(F.broadcast(head), "item", "left").select("item", "na", code.alias("id")), "p3-items")
    coded = postings.join(sized(items.select("item", "id"), broadcast_bytes), "item").select("r1", "r2", F.col("id").alias("item"))
    sizes = coded.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > wide).select("r1", "r2")
    broad = stored(sizes, "p3-sizes")
    some = not broad.isEmpty()
    narrow = coded.join(sized(broad, broadcast_bytes), ["r1", "r2"], "left_anti") if some else coded
    in_order = narrow.repartition("r1", "r2").sortWithinPartitions("r1", "r2", "item")
    listed = in_order.mapInArrow(_pair_counter(heavy_items), _PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"))
    if some:
        listed = _wide_pairs(coded.join(sized(broad, broadcast_bytes), ["r1", "r2"], "left_semi"), stored(listed, "p3-listed"), least, block_items)
    often = listed.where(F.col("n") >= least)
    left = sized(items.select(F.col("id").alias("a"), F.col("item").alias("x"), F.col("na").alias("nx")), broadcast_bytes)
    right = sized(items.select(F.col("id").alias("b"), F.col("item").alias("y"), F.col("na").alias("ny")), broadcast_bytes)
    n, nx, ny = (F.col(c).cast("decimal(38,0)") for c in ("n", "nx", "ny"))
    above = (n * F.lit(total).cast("decimal(20,0)")).cast("double") >= (F.lit(float(lift)) * nx.cast("double") * ny.cast("double"))
    first: Column = F.col("x") < F.col("y")
    return often.join(left, "a").join(right, "b").where(above).select(
        F.when(first, F.col("x")).otherwise(F.col("y")).alias("assoc_a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("assoc_b"),
        "n", F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("nb"),
        F.lit(total).cast("long").alias("n_records"), (F.col("n") * F.lit(float(total)) / (F.col("nx").cast("double") * F.col("ny"))).alias("lift"),
    )


def association_pairs(long_df: DataFrame, *, least: int = 5, lift: float = 6.0, **how) -> DataFrame:
    """Pairs of folded associations that trials (a run_file with a folded cue) hold together; see pairs_together."""
    rows = folded_rows(long_df, "run_file")
    r1, r2 = fingerprint(F.col("run_file"), F.col("cue"))
    postings = rows.select(F.col("assoc").alias("item"), r1.alias("r1"), r2.alias("r2")).distinct()
    return pairs_together(stored(postings, "p3-postings"), least=least, lift=lift, **how)
