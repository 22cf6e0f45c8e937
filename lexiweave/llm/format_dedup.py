"""Problem 4: records that differ only in writing or in the order of their fields."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.common import BROADCAST_BYTES, folded_rows, sized
from lexiweave.sources.workdir import stored


def _value_hash(name: str, value: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(name), F.struct(value.isNull(), value))


def multiset_fingerprint(fields: list[tuple[str, Column]]) -> list[Column]:
    """128 bits that don't depend on the order of the fields: sums of the hashes of each field-name and value pair.

    Fields that may stand for one another carry the same name. The sums wrap around; each term is
    squeezed by another hash first, so that two equal values don't cancel.
    """
    out = []
    for seed in (11, 23):
        total = F.lit(0).cast("decimal(38,0)")
        for name, value in fields:
            total = total + _value_hash(name, value, seed).cast("decimal(38,0)")
        out.append(F.xxhash64(total))
    return out


def grouped_copies(rows: DataFrame, key: str, fixed: list[str], loose: tuple[str, str], *, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """first_id, n of every fingerprint; and k, first_id of the rows in groups of copies, whether they are the `same` as the group's first row, and if not their fields.

    Two rows are copies if they agree in the `fixed` columns and their two `loose` columns hold the same
    two values, whichever holds which; nulls equal nulls. Rows are grouped by a multiset fingerprint;
    first_id is the smallest `key` of the group, and each row is held against that first row, field by
    field and without sorting the fields. The first row is the same as itself.

    Only fingerprints and keys are shuffled to find the groups, aggregated before the shuffle. Texts
    are looked at in groups of two and more only, so the join to their rows leaves out all others.
    Repeated `key` values give repeated rows.
    """
    a, b = loose
    fp1, fp2 = multiset_fingerprint([*((c, F.col(c)) for c in fixed), ("loose", F.col(a)), ("loose", F.col(b))])
    fields = [*fixed, a, b]
    marked = rows.select(F.col(key).alias("k"), *fields, fp1.alias("fp1"), fp2.alias("fp2"))
    every = marked.groupBy("fp1", "fp2").agg(F.min("k").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = stored(every.where("n > 1").drop("n"), "p4-groups")
    members = stored(marked.join(sized(groups, broadcast_bytes), ["fp1", "fp2"]), "p4-members")
    first = members.where("k = first_id").dropDuplicates(["fp1", "fp2"]).select("fp1", "fp2", *[F.col(c).alias(f"of_{c}") for c in fields])
    held = members.join(sized(stored(first, "p4-first"), broadcast_bytes), ["fp1", "fp2"])
    same = F.lit(True)
    for c in fixed:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    straight = F.col(a).eqNullSafe(F.col(f"of_{a}")) & F.col(b).eqNullSafe(F.col(f"of_{b}"))
    crossed = F.col(a).eqNullSafe(F.col(f"of_{b}")) & F.col(b).eqNullSafe(F.col(f"of_{a}"))
    held = held.withColumn("same", same & (straight | crossed))
    return every.select("first_id", "n"), stored(held.select("k", "first_id", "same", *[F.when(~F.col("same"), F.col(c)).alias(c) for c in fields]), "p4-held")


_FIXED, _LOOSE = ["run_file", "assoc_pos"], ("cue", "assoc")


def _classes(long_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """first_id, n of every fingerprint; first_id, k of every row that is in a fingerprint's group of two and more."""
    rows = folded_rows(long_df, "row_id", *_FIXED)
    every, held = grouped_copies(rows, "row_id", _FIXED, _LOOSE)
    good = held.where("same").select("first_id", "k")
    # Two different records under one 128-bit fingerprint, which hardly ever are: the odd ones are grouped by their fields.
    odd = held.where(~F.col("same"))
    if odd.isEmpty():
        return every, good
    odd = odd.withColumns({"x": F.least(*_LOOSE), "y": F.greatest(*_LOOSE)})
    lowest = odd.groupBy(*_FIXED, "x", "y").agg(F.min("k").alias("lowest"))
    cond = [odd[c].eqNullSafe(lowest[c]) for c in (*_FIXED, "x", "y")]
    return every, good.unionByName(odd.join(lowest, cond).select(F.col("lowest").alias("first_id"), "k"))


def copies(long_df: DataFrame) -> DataFrame:
    """first_id, row_id: every row that repeats a record of long_df, with the record's smallest row_id.

    Rows with a missing text are left out (see folded_rows). A null run_file or assoc_pos equals another null.
    """
    return _classes(long_df)[1].where("k <> first_id").select("first_id", F.col("k").alias("row_id"))


def records_with_copies(long_df: DataFrame) -> DataFrame:
    """first_id, n_copies: each record of long_df once, with the number of rows that hold it.

    A fingerprint that one row has is a record; the others are counted from the rows held against the first of their group.
    """
    every, members = _classes(long_df)
    single = every.where("n = 1").select("first_id", F.lit(1).cast("long").alias("n_copies"))
    return single.unionByName(members.groupBy("first_id").agg(F.count(F.lit(1)).alias("n_copies")))
