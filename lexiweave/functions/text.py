"""Text rules as column expressions; none of them leaves the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folded texts that mean "missing".
MISSING_WORDS = ("", "na", "nan")


def fold(c: Column) -> Column:
    """Only the letters and digits of a text (accents stay), in lower case. Null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def present(folded: Column) -> Column:
    """True where a folded text is neither null, empty nor a word for a missing value."""
    return F.coalesce(~folded.isin(*MISSING_WORDS), F.lit(False))


def fingerprint(*columns: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes of the columns: 128 bits that stand for their values.

    Nulls hash apart from every text. Each column is hashed with its place, so that a null in one
    column never equals a null in another.
    """
    tagged = [F.struct(F.lit(i), c.isNull(), c) for i, c in enumerate(columns)]
    return [F.xxhash64(*tagged), F.xxhash64(F.lit("second"), *tagged)]
