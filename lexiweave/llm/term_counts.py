"""Problem 2: how often, and in how many records, every distinct term occurs."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.functions.text import fingerprint
from lexiweave.llm.common import folded_rows
from lexiweave.sources.workdir import stored

#: Pairs that one task sorts, and ranges at most: beyond both the ranges grow with the data and are sorted on disk.
RANGE_ROWS = 200_000
MOST_RANGES = 20_000

_RUNS = "term string, n_rows long, n_records long, part int, edge int, first1 long, first2 long, last1 long, last2 long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal terms in the sorted partition; edge is 1 for its first run, 2 for its last, 3 for both."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("term", pa.string()), ("n_rows", pa.int64()), ("n_records", pa.int64()), ("part", pa.int32()), ("edge", pa.int32()), *((k, pa.int64()) for k in ("first1", "first2", "last1", "last2"))])
    held: tuple | None = None  # the run that may go on: term, rows, records, first record, last record
    first = True

    def rows(runs: list[tuple], edge: int) -> pa.RecordBatch:
        cols = list(zip(*[(t, n, m, part, edge, *a, *z) for t, n, m, a, z in runs]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        term, r1, r2 = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        new_term = np.ones(len(r1), bool)
        new_term[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        goes_on = held is not None and held[0] == term[0].as_py()
        new_rec = new_term.copy()
        new_rec[1:] |= (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])
        if goes_on:
            new_rec[0] = held[4] != (r1[0], r2[0])
        starts = np.flatnonzero(new_term)
        ends = np.append(starts[1:], len(r1))
        n_rows, n_recs = ends - starts, np.add.reduceat(new_rec.astype(np.int64), starts)
        texts = term.take(pa.array(starts)).to_pylist()
        runs = [(t, int(n), int(m), (int(r1[s]), int(r2[s])), (int(r1[e - 1]), int(r2[e - 1]))) for t, n, m, s, e in zip(texts, n_rows, n_recs, starts, ends)]
        if goes_on:
            t, n, m, a, z = runs[0]
            runs[0] = (t, n + held[1], m + held[2], held[3], z)
        elif held is not None:
            runs.insert(0, held)
        held = runs.pop()
        if runs and first:
            yield rows(runs[:1], 1)
            runs, first = runs[1:], False
        if runs:
            yield rows(runs, 0)
    if held is not None:
        yield rows([held], 3 if first else 2)


def term_counts(pairs: DataFrame, *, range_rows: int = RANGE_ROWS, n_pairs: int | None = None) -> DataFrame:
    """term, n_rows, n_records of a table of (term string, r1 long, r2 long), where (r1, r2) identifies the record.

    External sort: pairs are range-partitioned by (term, record) and a salt, sorted within their
    partition, and scanned run by run. The salt lets even the rows of one term in one record spread
    over several tasks; where a record goes on in the next partition, it is counted once. That
    correction looks at the two outer runs of each partition only.

    Null terms are left out. An empty input gives an empty result.
    """
    pairs = pairs.select("term", "r1", "r2").where(F.col("term").isNotNull())
    if n_pairs is None:
        n_pairs = pairs.count()
    parts = min(MOST_RANGES, max(1, -(-n_pairs // range_rows)))
    salted = pairs.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    ordered = salted.repartitionByRange(parts, "term", "r1", "r2", "salt").sortWithinPartitions("term", "r1", "r2")
    runs = stored(ordered.select("term", "r1", "r2").mapInArrow(_scan, _RUNS), "term-runs")
    # Two rows a range, so 2 * MOST_RANGES at most: small enough for one task, whatever the data.
    edges = runs.where("edge > 0")
    before = Window.orderBy("part", "edge")
    twice = edges.select(
        "term",
        (
            (F.lag("term").over(before) == F.col("term")) & (F.lag("last1").over(before) == F.col("first1"))
            & (F.lag("last2").over(before) == F.col("first2")) & (F.lag("part").over(before) < F.col("part"))
        ).alias("same"),
    ).where("same").select("term", F.lit(0).alias("n_rows"), F.lit(-1).alias("n_records"))
    counted = runs.select("term", "n_rows", "n_records").unionByName(twice)
    return counted.groupBy("term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))


def association_counts(long_df: DataFrame, *, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """The counts of every folded association (a record is a trial: a run_file with a folded cue), and the number of all trials."""
    rows = folded_rows(long_df, "run_file")
    r1, r2 = fingerprint(F.col("run_file"), F.col("cue"))
    pairs = stored(rows.select(F.col("assoc").alias("term"), r1.alias("r1"), r2.alias("r2")), "p2-pairs")
    trials, n = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return term_counts(pairs, range_rows=range_rows, n_pairs=n), trials


def marked_terms(long_df: DataFrame, *, rare_below: int = 3, common_share: int = 100, range_rows: int = RANGE_ROWS) -> DataFrame:
    """term, n_rows, n_records, mark: `rare` below `rare_below` records, `common` above one in `common_share` of all, else `useful`.

    A term that is both (only where there are under 300 records) is rare.
    """
    counts, trials = association_counts(long_df, range_rows=range_rows)
    rare, common = F.col("n_records") < rare_below, F.col("n_records") * common_share > trials
    return counts.withColumn("mark", F.when(rare, "rare").when(common, "common").otherwise("useful"))
