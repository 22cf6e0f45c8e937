"""Problem 1: the N best items of every group, also of groups that hold a large share of all rows."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexiweave.functions.text import fingerprint
from lexiweave.llm.common import folded_rows
from lexiweave.sources.workdir import stored

#: A group is heavy if it has so many times the rows of the average group, and a 10,000th of all rows:
#: so there are at most 10,000 heavy groups, and their 64-bit hashes are at most 80 kB.
HEAVY_TIMES = 8
MOST_HEAVY = 10_000
#: Rows of heavy groups that one task sorts.
RANGE_ROWS = 100_000


def _cut(n: int):
    """The first n rows of each group in a sorted range, with the number of the range and the row's place in it from 0; the last two columns tell groups apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            h1, h2 = (b.column(b.num_columns - k).to_numpy(zero_copy_only=False) for k in (2, 1))
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            start = np.flatnonzero(new)
            place = np.arange(len(h1)) - np.repeat(start, np.diff(np.append(start, len(h1))))
            if held == (h1[0], h2[0]):
                place[: start[1] if len(start) > 1 else len(h1)] += seen
            held, seen = (h1[-1], h2[-1]), int(place[-1]) + 1
            cut = b.append_column("_range", pa.array(np.full(len(h1), part, np.int64))).append_column("_at", pa.array(place.astype(np.int64)))
            yield cut.filter(pa.array(place < n))

    return run


def top_n_per_group(
    items: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, *,
    place: str = "place", heavy_times: float = HEAVY_TIMES, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The first n rows of every group in the given order, numbered from 1 in column `place` (int).

    Hot-cold split. Exact row counts of the groups part them into heavy and light ones. Light groups
    go through an ordinary window. Rows of heavy groups are sorted by salted ranges: range partitions
    over (group, order, salt), where the salt parts even rows that are equal in everything else. Each
    range keeps the first n rows of every group in it, whatever n is. Ranges stand in order, so the
    place of a row is its place in its range behind the rows of the ranges before; no task sees a
    heavy group as a whole.

    The order should be total; rows equal in all order columns are numbered arbitrarily. Null group
    keys form a group of their own. An empty input gives an empty result; n < 1 gives one, too.
    `items` is read three times: hand in a stored table.
    """
    hashed = [F.xxhash64(F.lit(seed), *[F.struct(F.col(g).isNull(), F.col(g)) for g in group]) for seed in (1, 2)]
    counts = items.groupBy(*group).agg(F.count(F.lit(1)).alias("rows_in_group"))
    counts = counts.select(hashed[0].alias("h"), "rows_in_group")
    total, groups = counts.agg(F.coalesce(F.sum("rows_in_group"), F.lit(0)), F.count(F.lit(1))).first()
    bound = max(heavy_times * total / max(1, groups), total / MOST_HEAVY)
    heavy = counts.where(F.col("rows_in_group") > bound).collect()  # at most MOST_HEAVY
    first = Window.partitionBy(*group).orderBy(*order)

    def best(df: DataFrame) -> DataFrame:
        return df.withColumn(place, F.row_number().over(first)).where(F.col(place) <= n)

    if not heavy:
        return best(items)
    # A light group whose hash equals a heavy group's is only sorted the other way.
    is_heavy = hashed[0].isin([r["h"] for r in heavy])
    ranges = max(2, -(-sum(r["rows_in_group"] for r in heavy) // range_rows))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    told = items.where(is_heavy).select("*", hashed[0].alias("_h1"), hashed[1].alias("_h2"))
    ordered = told.repartitionByRange(ranges, *group, *order, salt).sortWithinPartitions(*group, *order)
    schema = StructType([*told.schema.fields, StructField("_range", LongType()), StructField("_at", LongType())])
    cut = stored(ordered.mapInArrow(_cut(n), schema), "top-n-ranges")
    key = ["_h1", "_h2", "_range"]
    sizes = cut.groupBy(*key).agg((F.max("_at") + 1).alias("_many"))  # a row or two for each range
    before = Window.partitionBy("_h1", "_h2").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_many").over(before), F.lit(0))).where(F.col("_before") < n)
    hot = cut.join(sizes.drop("_many"), key).withColumn(place, (F.col("_before") + F.col("_at") + 1).cast("int")).where(F.col(place) <= n)
    return hot.select(*items.columns, place).unionByName(best(items.where(~is_heavy)))


def associations_by_runs(long_df: DataFrame) -> DataFrame:
    """cue, assoc, runs: in how many distinct run_files each folded cue has each folded association.

    A null run_file counts as one run of its own. Runs are told apart by 128-bit fingerprints.
    """
    rows = folded_rows(long_df, "run_file")
    r1, r2 = fingerprint(F.col("run_file"))
    pairs = rows.select("cue", "assoc", r1.alias("r1"), r2.alias("r2"))
    return pairs.groupBy("cue", "assoc").agg(F.count_distinct("r1", "r2").alias("runs"))


def top_associations(long_df: DataFrame, n: int = 3) -> DataFrame:
    """cue, place, assoc: for each folded cue the n folded associations of the most run_files; ties to the smaller text."""
    items = stored(associations_by_runs(long_df), "p1-items")
    best = top_n_per_group(items, ["cue"], [F.col("runs").desc(), F.col("assoc").asc()], n)
    return best.select("cue", "place", "assoc")
