"""The row before each row of its group, without one task per group."""

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from lexiweave.sources.workdir import stored


#: Ranges at most; beyond so many times range_rows they grow with the data, and the table of their borders doesn't.
MOST_RANGES = 20_000


def with_previous(df: DataFrame, group: str, order: Sequence[str], value: str, name: str, *, rows: int, range_rows: int = 200_000) -> DataFrame:
    """df with a column `name`: the `value` of the row before it within its group, null for the first.

    Rows are range-partitioned by (group, order) and sorted, so a group of any size spreads over many
    tasks. Each task looks back within its partition; the first row of a partition takes the last row
    of the one before, from a table of one row per partition. Rows equal in group and order stand in
    an arbitrary order; `value` must not be null.
    """
    parts = min(MOST_RANGES, max(1, -(-rows // range_rows)))
    keep = [c for c in df.columns if c != name]
    out = StructType([*df.select(*keep).schema.fields, StructField(name, df.schema[value].dataType), StructField("_part", IntegerType()), StructField("_first", BooleanType()), StructField("_last", BooleanType())])

    def look_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, before, first = TaskContext.get().partitionId(), None, (None, None), True

        def ready(t: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            nonlocal before, first
            groups, values = t.column(keep.index(group)).to_pylist(), t.column(keep.index(value)).to_pylist()
            shown = []
            for g, v in zip(groups, values):
                shown.append(before[1] if before[0] == g and before[1] is not None else None)
                before = (g, v)
            n = t.num_rows
            extra = [pa.array(shown, t.column(keep.index(value)).type), pa.array([part] * n, pa.int32()), pa.array([first and i == 0 for i in range(n)]), pa.array([last and i == n - 1 for i in range(n)])]
            first = False
            return pa.RecordBatch.from_arrays([*t.columns, *extra], names=[*keep, name, "_part", "_first", "_last"])

        for b in batches:
            if b.num_rows:
                if held is not None:
                    yield ready(held, False)
                held = b
        if held is not None:
            yield ready(held, True)

    seen = df.select(*keep).repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).mapInArrow(look_back, out)
    if parts == 1:
        return seen.drop("_part", "_first", "_last")
    seen = stored(seen, "ranges")  # ranges are cut by samples: both uses need the same ones
    edges = seen.where("_first or _last")  # at most two rows a range
    w = Window.orderBy("_part", F.col("_last").cast("int"))
    joins = edges.select("_part", "_first", F.col(group).alias("g"), F.lag(group).over(w).alias("pg"), F.lag(value).over(w).alias("pv")).where("_first and g <=> pg").select(F.col("_part"), F.lit(True).alias("_first"), "pv")
    return seen.join(F.broadcast(joins), ["_part", "_first"], "left").withColumn(name, F.coalesce(F.col(name), F.col("pv"))).select(*keep, name)
