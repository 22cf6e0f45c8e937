"""Word lists: filters, first rows per key, shares of an ordered list, sentences per word."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.functions.rules import squeeze

#: Fragments of contractions, and one misspelling, that word lists carry as nouns.
FRAGMENTS = (
    "isn", "aren", "wasn", "weren", "doesn", "don", "didn",
    "couldn", "shouldn", "wouldn", "mustn", "mightn", "needn",
    "hasn", "haven", "hadn", "ain",
    "ll", "itll", "thatll", "therell", "theyll", "youl", "youll", "iwill",
    "re", "yre", "theyr",
    "ve", "theve", "youve", "theyve",
    "d", "itd", "theyd", "youd", "hed",
    "ts", "hes", "shes",
    "weli",
)


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order. Rows with a null key are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_n_per_key(df: DataFrame, key: str, n: int, *order: Column, place: str = "place") -> DataFrame:
    """The first n rows of each key in the given order, numbered from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n)


def dense_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Numbers rows from 1 in the order of the columns, without sorting in one task.

    Range partitions are sorted and counted; each adds the sizes of those before it. Only one number per partition is gathered.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # A stable copy: numbering looks at the partitions twice.
    from lexiweave.sources.workdir import stored

    kept = stored(parts, "dense-index")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + within).cast("long")).drop("_part", "_before")


def balanced_group(place: Column, n: Column, size: int) -> Column:
    """Which of ceil(n / size) groups (from 0) the place (from 0) of n falls in, if the first n mod groups have one more."""
    groups = F.greatest(F.ceil(n / F.lit(size)), F.lit(1))
    base, more = F.floor(n / groups), n % groups
    return F.when(place < more * (base + 1), F.floor(place / (base + 1))).otherwise(more + F.floor((place - more * (base + 1)) / F.greatest(base, F.lit(1)))).cast("long")


def contiguous_shard(place: Column, n: Column, shards: int) -> Column:
    """Which of the shards (from 0) the place (from 0) of n falls in: equal slices, the last takes the rest."""
    size = F.floor(n / F.lit(shards))
    return F.when(size == 0, shards - 1).otherwise(F.least(F.floor(place / F.greatest(size, F.lit(1))), F.lit(shards - 1))).cast("long")


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, at (from 0), sentence: texts cut behind . ! ? before white space, white space squeezed; blank ones go, whatever their place."""
    cut = documents.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("at", "sentence"))
    return cut.withColumn("sentence", squeeze(F.col("sentence"))).where("sentence <> ''")


def few_words(words: DataFrame, most: int, most_bytes: int = 32_000_000) -> bool:
    """Whether a table of one column of words is small enough for a broadcast, by rows and by bytes."""
    n, size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    return n <= most and size + 16 * n <= most_bytes


def sentences_of_words(documents: DataFrame, words: DataFrame, *, shortest: int = 5, longest: int = 100, n: int | None = 50, broadcast_words: int = 200_000) -> DataFrame:
    """word, doc_id, at, sentence, place: the first n sentences that hold each word, of `shortest` to `longest` words between blanks.

    Tokens are runs of a-z and 0-9 in lower case. Word lists of up to `broadcast_words` rows are broadcast;
    longer ones are joined by shuffle.
    """
    wanted = words.select(F.lower("word").alias("word")).where("word is not null").distinct()
    wanted = F.broadcast(wanted) if few_words(wanted, broadcast_words) else wanted
    good = sentences(documents).where(F.size(F.split("sentence", " ")).between(shortest, longest))
    tokens = good.withColumn("word", F.explode(F.array_distinct(F.split(F.lower("sentence"), "[^a-z0-9]+")))).where("word <> ''")
    held = tokens.join(wanted, "word").select("word", "doc_id", "at", "sentence")
    return first_n_per_key(held, "word", n, F.col("doc_id").asc(), F.col("at").asc()) if n else held
