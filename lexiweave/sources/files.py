"""Result files as tables: readers with explicit schemas, columns out of names and paths, the latest of several versions, sinks."""

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiweave.operators.lexicon import few_words
from lexiweave.operators.summaries import canonical_columns

#: Logical inputs and outputs, so that no reader has to guess.
SCHEMAS = {
    "lexicon": "Word string, FREQcount bigint, Dom_PoS_SUBTLEX string",
    "vocabulary": "lemma string, word string, freq bigint",
    "sentences": "word string, sentence string",
    "fc_raw": "trial_id int, round int, input string, candidates string, output string",
    "fa_raw": "run_idx int, seed int, cue_word string, response string",
    "fa_long": "cue_word string, run_file string, position int, association string",
}


def separator(path: str) -> str:
    return "\t" if path.rsplit(".gz", 1)[0].endswith((".tsv", ".tab")) else ","


def read_delimited(spark: SparkSession, paths: str | Sequence[str], schema: str | StructType, *, drop_malformed: bool = False, recursive: bool = False) -> DataFrame:
    """One or many CSV or TSV files (by suffix) with a header. Malformed lines are nulls, or go with drop_malformed; empty files give no rows."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.schema(schema).option("header", True).option("sep", separator(paths[0])).option("multiLine", True).option("escape", '"')
    reader = reader.option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE").option("recursiveFileLookup", recursive)
    return reader.csv(paths)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a delimited file, from its first line only."""
    return spark.read.option("header", True).option("sep", separator(path)).csv(path).columns


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """text and the folders' columns: every file below a folder as one row, such as a job's log."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def column_key(name: str) -> str:
    """A column name in lower case, without blanks and underscores."""
    return re.sub(r"[\s_]+", "", name.lower())


def resolve(columns: Sequence[str], *wanted: str, prefix: bool = False) -> str:
    """The first column that is one of the wanted names (by column_key), else, with prefix, that begins with one; KeyError if none does."""
    keys = {column_key(c): c for c in reversed(columns)}
    for w in map(column_key, wanted):
        if w in keys:
            return keys[w]
    for w in map(column_key, wanted) if prefix else ():
        for c in columns:
            if column_key(c).startswith(w):
                return c
    raise KeyError(f"none of {wanted} is in {list(columns)}")


def outside_folders(df: DataFrame, *folders: str) -> DataFrame:
    """Rows whose file lies in none of the folders, such as 01_summary and 99_old."""
    return df.where(~F.arrays_overlap(F.split(F.col("_metadata.file_path"), "/"), F.array(*map(F.lit, folders))))


def date_tag(day: date | None = None) -> str:
    """Today, or the given day, as yyyymmdd for names of outputs."""
    return (day or date.today()).strftime("%Y%m%d")


def job_slice(items: Sequence, index: int, count: int) -> list:
    """The index-th of `count` contiguous slices of a list of targets; the last takes the rest."""
    if not 0 <= index < count:
        raise ValueError("index must be from 0 to count - 1")
    size = len(items) // count
    return list(items[index * size : None if index == count - 1 else (index + 1) * size])


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All frames below one another; columns that one lacks are null there, metric columns take their canonical names."""
    out = None
    for f in frames:
        f = f.withColumnsRenamed(canonical_columns(f.columns))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames")
    return out


def run_name_parts(name: Column) -> dict[str, Column]:
    """alias, kind, run and stamp of a name such as model_FA_run0000012_20250101_203806.csv; '' where the name is another."""
    pattern = r"^(.+?)_(F[AC])_(?:run|round|probe)(\d+)_(\d{8}_\d{6})\."
    return {c: F.regexp_extract(name, pattern, k) for k, c in enumerate(("alias", "kind", "run", "stamp"), 1)}


def clean_alias(alias: Column) -> Column:
    """Without a time stamp and without _small, _large or _old."""
    return F.regexp_replace(F.regexp_replace(alias, r"_\d{8}_\d{6}$", ""), r"_(?:small|large|old)", "")


def with_path_parts(df: DataFrame, *names: str) -> DataFrame:
    """df and the last folders of each row's file under the given names, the innermost last."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return df.select("*", *[F.get(parts, F.size(parts) - 2 - i).alias(n) for i, n in enumerate(reversed(names))])


def latest(df: DataFrame, by: Sequence[str], stamp: str, *tie: str) -> DataFrame:
    """All rows of the latest stamp of each group (stamps compare as text or time); with tie columns, one row."""
    if not tie:
        top = df.groupBy(*by).agg(F.max(stamp).alias(stamp))
        return df.join(top, [*by, stamp], "left_semi")
    w = Window.partitionBy(*by).orderBy(F.col(stamp).desc(), *[F.col(t).desc() for t in tie])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def file_times(df: DataFrame) -> DataFrame:
    """file_path, modified of the files behind df."""
    return df.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


def word_vectors(spark: SparkSession, path: str, words: DataFrame, *, broadcast_words: int = 200_000) -> DataFrame:
    """word, vec, valid of a text file of vectors (a header line, then a word and its numbers), plain or gzip.

    Only lines of wanted words are parsed into numbers; words without a line keep a row with valid false.
    """
    wanted = words.select(F.lower("word").alias("word")).where("word is not null").distinct()
    small = few_words(wanted, broadcast_words)
    lines = spark.read.text(path).select(F.substring_index("value", " ", 1).alias("word"), "value").where(F.size(F.split("value", " ")) > 2)
    hits = lines.join(F.broadcast(wanted) if small else wanted, "word", "left_semi").dropDuplicates(["word"])
    vectors = hits.select("word", F.transform(F.slice(F.split(F.trim("value"), " "), 2, 1_000_000), lambda x: x.cast("double")).alias("vec"))
    return wanted.join(vectors, "word", "left").withColumn("valid", F.col("vec").isNotNull())


def preferred(have: DataFrame, by: Sequence[str], order: Sequence[str] = ("ppmi", "counts")) -> DataFrame:
    """by..., weighting: the first weighting in `order` that a group has results for."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("weighting"))
    return have.where(place > 0).groupBy(*by).agg(F.min_by("weighting", place).alias("weighting"))


def missing(wanted: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that is still to do."""
    return wanted.join(have, list(keys), "left_anti")


def write_table(df: DataFrame, path: str, *, form: str = "parquet", mode: str = "errorifexists", partitions: Sequence[str] = ()) -> None:
    """A sink with Spark's commit protocol, so a job that fails leaves no half file.

    mode: overwrite, append, ignore (skip if it is there) or errorifexists. CSV files have a header each.
    """
    w = df.write.mode(mode).partitionBy(*partitions)
    (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv if form == "csv" else w.parquet)(path)


def summary_json(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
