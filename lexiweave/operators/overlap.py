"""How far the models' answers overlap: sets of (cue, response) per model."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_sets(rows: DataFrame) -> DataFrame:
    """model, cue, response without repetition; rows with a null text go."""
    return rows.where("cue is not null and response is not null").select("model", "cue", "response").distinct()


def jaccard_matrix(sets: DataFrame) -> DataFrame:
    """model_a, model_b, shared, jaccard of all models with all, 1 on the diagonal, 0 where both are empty.

    Each (cue, response) is listed once with the models that have it, so only pairs of models are expanded.
    """
    holders = sets.groupBy("cue", "response").agg(F.collect_set("model").alias("models"))
    pairs = holders.select(F.explode("models").alias("model_a"), "models").select("model_a", F.explode("models").alias("model_b"))
    shared = pairs.groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("shared"))
    sizes = sets.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    a, b = sizes.select(F.col("model").alias("model_a"), F.col("n").alias("na")), sizes.select(F.col("model").alias("model_b"), F.col("n").alias("nb"))
    df = a.crossJoin(F.broadcast(b)).join(shared, ["model_a", "model_b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))  # models by models
    return df.select("model_a", "model_b", "shared", F.coalesce(F.try_divide(F.col("shared").cast("double"), F.col("na") + F.col("nb") - F.col("shared")), F.lit(0.0)).alias("jaccard"))


def jaccard_per_cue(sets: DataFrame, cues: DataFrame) -> DataFrame:
    """model_a < model_b, mean Jaccard, shared and joint responses over the given cues; a cue one model lacks counts with an empty set."""
    holders = sets.join(cues.select("cue").distinct(), "cue").groupBy("cue", "response").agg(F.collect_set("model").alias("models"))
    pairs = holders.select("cue", F.explode("models").alias("model_a"), "models").select("cue", "model_a", F.explode("models").alias("model_b")).where("model_a < model_b")
    shared = pairs.groupBy("cue", "model_a", "model_b").agg(F.count(F.lit(1)).alias("shared"))
    sizes = sets.join(cues.select("cue").distinct(), "cue").groupBy("model", "cue").agg(F.count(F.lit(1)).alias("n"))
    models = sets.select("model").distinct()
    grid = models.select(F.col("model").alias("model_a")).crossJoin(F.broadcast(models.select(F.col("model").alias("model_b")))).where("model_a < model_b")
    every = cues.select("cue").distinct().crossJoin(F.broadcast(grid))  # models by models for each cue
    df = (
        every.join(sizes.select(F.col("model").alias("model_a"), "cue", F.col("n").alias("na")), ["model_a", "cue"], "left")
        .join(sizes.select(F.col("model").alias("model_b"), "cue", F.col("n").alias("nb")), ["model_b", "cue"], "left")
        .join(shared, ["cue", "model_a", "model_b"], "left").na.fill(0, ["na", "nb", "shared"])
    )
    joint = F.col("na") + F.col("nb") - F.col("shared")
    return df.groupBy("model_a", "model_b").agg(F.avg(F.coalesce(F.try_divide(F.col("shared").cast("double"), joint), F.lit(0.0))).alias("jaccard"), F.avg("shared").alias("shared"), F.avg(joint).alias("joint"))


def consensus(sets: DataFrame, least: int | None = None) -> DataFrame:
    """cue, response, n_models, share of responses that at least `least` models give (half of all models, rounded down, but 1)."""
    n = sets.select("model").distinct().count()
    least = max(1, n // 2) if least is None else least
    held = sets.groupBy("cue", "response").agg(F.count(F.lit(1)).alias("n_models")).where(F.col("n_models") >= least)
    return held.withColumn("share", F.col("n_models").cast("double") / max(1, n))


def uniqueness(sets: DataFrame) -> DataFrame:
    """model, total, own (responses to a cue that no other model gives), rate."""
    held = sets.groupBy("cue", "response").agg(F.count(F.lit(1)).alias("n"), F.min("model").alias("model")).where("n = 1")
    own = held.groupBy("model").agg(F.count(F.lit(1)).alias("own"))
    total = sets.groupBy("model").agg(F.count(F.lit(1)).alias("total"))
    df = total.join(own, "model", "left").na.fill(0, ["own"])
    return df.withColumn("rate", F.col("own").cast("double") / F.col("total"))


def exclusive_to(df: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """Rows whose keys only one model has."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_n", F.size(F.collect_set(model).over(w))).where("_n = 1").drop("_n")
