"""A stream of documents, and for every word its first sentences up to a cap; state is one count per word."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiweave.operators.lexicon import sentences_of_words
from lexiweave.sources.workdir import shared_dir


def _capped(n: int):
    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = state.get[0] if state.exists else 0
        out = []
        for f in frames:  # once the cap is reached nothing is kept, however many rows come
            if have < n:
                f = f.sort_values(["doc_id", "at"]).head(n - have)
                have += len(f)
                out.append(f[["word", "doc_id", "at", "sentence"]])
        state.update((have,))
        yield from out

    return keep


def _cut(n: int):
    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.sort_values(["doc_id", "at"]).groupby("word").head(n)

    return first


def capped_sentences(documents: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """word, doc_id, at, sentence of a stream of documents: at most n sentences per word, in the order of arrival.

    Of a batch of rows only the first n of each word are shuffled; those of a word go through one task.
    """
    held = sentences_of_words(documents, words, n=None).select("word", "doc_id", "at", "sentence").mapInPandas(_cut(n), "word string, doc_id long, at int, sentence string")
    return held.groupBy("word").applyInPandasWithState(_capped(n), "word string, doc_id long, at int, sentence string", "n int", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, source: str, words: DataFrame, n: int, *, label: str, files_per_trigger: int = 8, progress: list[dict] | None = None) -> DataFrame:
    """All documents that are there by now, as a stream of parquet files; the sentences that were kept.

    progress takes a batch_id, n_rows (read from the source) and n_states (words met so far) for every batch of this run.

    The sink and its checkpoint lie in the shared folder: a query that starts anew with the same label
    goes on where it stopped, and repeats nothing.
    """
    schema = spark.read.parquet(source).schema
    pattern = f"{source[:-1]}[{source[-1]}]"  # as a pattern, a table may be one file or a folder of files
    documents = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern).select("doc_id", "text")
    place = f"{shared_dir(spark)}/lexiweave/stream-{label}"
    kept = capped_sentences(documents, words, n)
    query = kept.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress += [{"batch_id": int(p["batchId"]), "n_rows": int(p["numInputRows"]), "n_states": sum(int(o["numRowsTotal"]) for o in p["stateOperators"])} for p in query.recentProgress]
    return spark.read.schema("word string, doc_id long, at int, sentence string").parquet(f"{place}/out")


def all_full(kept: DataFrame, words: DataFrame, n: int) -> bool:
    """Whether every word has its n sentences, so that a driver may stop the stream."""
    full = kept.groupBy("word").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= n)
    return words.select(F.lower("word").alias("word")).where("word is not null").distinct().join(full, "word", "left_anti").isEmpty()
