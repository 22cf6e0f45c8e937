"""Several values packed in one field: one row per value, with its place, from any mix of layouts."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.packed import A_LIST, LIST_IF_KNOWN, folded, list_reading, unpack
from lexiweave.functions.text import fold
from lexiweave.sources.workdir import stored

#: Values an answer was asked for.
ASKED = {"response": 5, "output": 2}

READ = "field_name string, rec_id long, items array<string>, n_errors int, reading int"
_ARROW = pa.schema([("field_name", pa.string()), ("rec_id", pa.int64()), ("items", pa.list_(pa.string())), ("n_errors", pa.int32()), ("reading", pa.int32())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _read_fc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for rec_id, cue, candidates, output in zip(*(c.to_pylist() for c in b.columns)):
            listed = unpack(candidates, answer=False)
            rows.append(("candidates", rec_id, listed.values, len(listed.errors), A_LIST))
            got = unpack(output, cue)
            rows.append(("output", rec_id, got.values, len(got.errors), list_reading(got, cue, [folded(v) for v in listed.values], ASKED["output"])))
        if rows:
            yield _batch(rows)


def _read_fa(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for rec_id, cue, text in zip(*(c.to_pylist() for c in b.columns)):
            got = unpack(text, cue)
            rows.append(("response", rec_id, got.values, len(got.errors), list_reading(got, cue, None, ASKED["response"])))
        if rows:
            yield _batch(rows)


def read_fields(fc_raw: DataFrame, fa_raw: DataFrame) -> DataFrame:
    """Every candidates, output and response text, read by the grammar of functions.packed. Null texts have no items."""
    fc = fc_raw.select("fc_id", "input_word", "candidates", "output").mapInArrow(_read_fc, READ)
    fa = fa_raw.select("fa_id", "cue_word", "response").mapInArrow(_read_fa, READ)
    return fc.unionByName(fa)


def item_words(lists: DataFrame, *keep: str) -> DataFrame:
    """keep..., word: each different folded word of the `items` of a row."""
    return lists.select(*keep, F.explode(F.array_distinct(F.transform("items", fold))).alias("word")).where("word <> ''")


def words_in_use(lists: DataFrame) -> DataFrame:
    """word: the words of candidate lists, and those of answers that mostly keep company with such words.

    lists: row (a key), field_name, items. An answer's word is in use if at least half of the answers that
    hold it hold another word of a candidate list, too; answers of one word don't count. Words of answers
    in another language stand among each other, even where two languages share one of them. Both counts
    are exact and the rule is a share, so it is the same at every size.
    """
    listed = stored(item_words(lists.where("field_name = 'candidates'")).distinct(), "words-listed")
    words = item_words(lists.where("field_name <> 'candidates' and size(items) > 1"), "row").join(listed.withColumn("known", F.lit(1)), "word", "left")
    answers = words.groupBy("row").agg(F.collect_list(F.struct("word", F.coalesce("known", F.lit(0)).alias("known"))).alias("w"))  # as long as the answer
    answers = answers.where(F.size("w") > 1).select(F.explode("w").alias("w"), F.expr("aggregate(w, 0, (n, x) -> n + x.known)").alias("n_known"))
    company = answers.groupBy("w.word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_known") > F.col("w.known")).alias("together"))
    return stored(listed.unionByName(company.where("2 * together >= n").select("word")).distinct(), "words-in-use")


def without_known(lists: DataFrame, words: DataFrame) -> DataFrame:
    """row of those lists that hold no word in use."""
    held = item_words(lists, "row").join(words.withColumn("known", F.lit(1)), "word", "left")
    return held.groupBy("row").agg(F.max("known").alias("known")).where("known is null").select("row")


def packed_items(fc_raw: DataFrame, fa_raw: DataFrame) -> DataFrame:
    """field_name, rec_id, item_pos (from 1), item_text, n_errors: one row per value of candidates, output and response.

    Empty slots are not counted. An answer that doesn't read as the list it was asked for gives no rows
    (see functions.packed.list_reading), nor do null, empty and blank texts; n_errors counts the text's
    empty slots and its unclosed quotes and brackets, which are read as bare text.
    """
    read = stored(read_fields(fc_raw, fa_raw).where("reading > 0").withColumn("row", F.monotonically_increasing_id()), "p7-read")
    foreign = without_known(read.where(F.col("reading") == LIST_IF_KNOWN), words_in_use(read))
    return read.join(foreign, "row", "left_anti").select("field_name", "rec_id", "n_errors", F.posexplode("items").alias("at", "item_text")).select(
        "field_name", "rec_id", (F.col("at") + 1).alias("item_pos"), "item_text", "n_errors"
    )
