"""What problems 1 to 4 share: which rows of the long table count, their folded texts, and when a table may be broadcast."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.text import fold, present


def folded_rows(long_df: DataFrame, *keep: str) -> DataFrame:
    """Columns cue and assoc (folded) and the columns named in keep, of the rows where both texts are present.

    Rows whose folded cue_word or association is empty, na, nan or null are left out. Every other
    column of long_df is dropped, so extra columns can't clash.
    """
    rows = long_df.select(fold(F.col("cue_word")).alias("cue"), fold(F.col("association")).alias("assoc"), *keep)
    return rows.where(present(F.col("cue")) & present(F.col("assoc")))


#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 32_000_000


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast if its rows take at most so many bytes: 16 for each column, and the bytes of every text."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    row = F.lit(16 * len(df.columns)).cast("long")
    for t in texts:
        row = row + t
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most else df
