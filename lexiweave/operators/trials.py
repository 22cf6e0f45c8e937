"""Raw trials of both paradigms, read into typed tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.rules import associations, clean, picks, split_list, valid_picks


def forced_choice_trials(fc_raw: DataFrame) -> DataFrame:
    """fc_id, model, trial_id, round_no, input, candidates, extracted1/2, pick1/2, compliant of every trial.

    pick1/2 are the extracted words where they are valid, else null. Null candidates are an empty
    list, so nothing is valid. compliant: both picks valid.
    """
    e1, e2 = picks("output", "input_word")
    base = fc_raw.select("fc_id", F.col("model_alias").alias("model"), "trial_id", "round_no", F.col("input_word").alias("input"), split_list(F.col("candidates")).alias("candidates"), e1.alias("extracted1"), e2.alias("extracted2"))
    v1, v2 = valid_picks("extracted1", "extracted2", "candidates", "input")
    return base.withColumns({"pick1": v1, "pick2": v2}).withColumn("compliant", F.col("pick1").isNotNull() & F.col("pick2").isNotNull())


def winners(trials: DataFrame) -> DataFrame:
    """The trials with winner1/2: valid picks, filled up from the candidates other than the input.

    Missing ones come from the eligible candidates in the order of md5(round|trial|input|candidate), so
    every run draws the same. One eligible candidate stands twice; none gives nulls.
    """
    eligible = F.filter("candidates", lambda c: ~c.eqNullSafe(F.col("input")))
    key = F.concat_ws("|", F.col("round_no").cast("string"), F.col("trial_id").cast("string"), "input")
    drawn = F.transform(F.array_sort(F.transform(F.array_distinct(eligible), lambda c: F.struct(F.md5(F.concat_ws("|", key, c)).alias("h"), c.alias("c")))), lambda s: s["c"])
    first, second = F.col("pick1"), F.col("pick2")
    df = trials.withColumn("_drawn", drawn)
    w1 = F.coalesce(first, F.get(F.filter("_drawn", lambda c: ~c.eqNullSafe(second)), F.lit(0)), second)
    df = df.withColumn("winner1", w1)
    w2 = F.coalesce(second, F.get(F.filter("_drawn", lambda c: ~c.eqNullSafe(F.col("winner1"))), F.lit(0)), F.col("winner1"))
    return df.withColumn("winner2", w2).drop("_drawn")


def free_association_trials(fa_raw: DataFrame) -> DataFrame:
    """fa_id, model, run_file, cue (lower case), words (up to five) of every response; no word is left out."""
    return fa_raw.select("fa_id", F.col("model_alias").alias("model"), "run_file", F.lower("cue_word").alias("cue"), associations(F.col("response")).alias("words"))


def association_rows(trials: DataFrame) -> DataFrame:
    """fa_id, model, run_file, cue, position (from 1), association: one row per word."""
    return trials.select("fa_id", "model", "run_file", "cue", F.posexplode("words").alias("at", "association")).select("fa_id", "model", "run_file", "cue", (F.col("at") + 1).alias("position"), "association")


def quality(trials: DataFrame) -> DataFrame:
    """Per model: trials, mean words, percent with five and with none, percent that repeat the cue, vocabulary, mean distinct words per cue.

    Trials without words count in all shares; cues without words count as 0 in the mean.
    """
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double")) * 100
    n = F.size("words")
    per_trial = trials.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_trials"), F.avg(n.cast("double")).alias("mean_words"), share(n == 5).alias("pct_full"), share(n == 0).alias("pct_empty"),
        share(F.array_contains("words", F.col("cue"))).alias("pct_cue"),
    )
    words = trials.select("model", "cue", F.explode_outer("words").alias("word"))
    vocabulary = words.groupBy("model").agg(F.count_distinct("word").alias("vocabulary"))
    per_cue = words.where("cue is not null").groupBy("model", "cue").agg(F.count_distinct("word").alias("n")).groupBy("model").agg(F.avg("n").alias("words_per_cue"))
    return per_trial.join(vocabulary, "model").join(per_cue, "model", "left")


def cue_responses(long_df: DataFrame) -> DataFrame:
    """model, cue, response (cleaned, either may be null) of every row of the long table."""
    return long_df.select(F.col("model_alias").alias("model"), clean(F.col("cue_word")).alias("cue"), clean(F.col("association")).alias("response"))


def stacked_picks(trials: DataFrame) -> DataFrame:
    """model, cue, response: both valid picks of a trial, one below the other (cleaned, either may be null)."""
    stacked = trials.select("model", "input", F.explode(F.array("pick1", "pick2")).alias("pick"))
    return stacked.select("model", clean(F.col("input")).alias("cue"), clean(F.col("pick")).alias("response"))
