"""Roll-ups of results by layer, prompt, model and neighbourhood size; long in, wide only at the sink."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The names one metric goes by in older result files.
CANONICAL = {"tournament": "fc", "forced_choice": "fc", "fc": "fc", "free_association": "fa", "fa": "fa", "fasttext": "fasttext", "bert": "bert", "crossmodel": "cross", "cross": "cross"}
#: The order of prompts in every report.
PROMPTS = ("averaged", "template", "forced_choice", "free_association")


def canonical_columns(columns: Sequence[str]) -> dict[str, str]:
    """Old name to canonical name of metric columns such as pearson_tournament_PPMI or nn_fa_counts."""
    out = {}
    for c in columns:
        kind, _, rest = c.partition("_")
        if kind in ("pearson", "nn"):
            name = next((v for k, v in sorted(CANONICAL.items(), key=lambda kv: -len(kv[0])) if rest == k or rest.startswith(k + "_")), None)
            if name:
                out[c] = f"{kind}_{name}"
    return out


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinite values become null, so that means and peaks pass them over."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns})


def melted(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """ids..., metric, value."""
    return df.unpivot(list(ids), list(metrics), "metric", "value")


def mean_of_means(long: DataFrame, inner: Sequence[str], outer: Sequence[str]) -> DataFrame:
    """outer..., value: mean over the groups `inner` of their means; not the mean of all rows, as groups differ in size."""
    return long.groupBy(*inner).agg(F.avg("value").alias("value")).groupBy(*outer).agg(F.avg("value").alias("value"))


def peaks(long: DataFrame, *by: str, layer: str = "layer") -> DataFrame:
    """by..., peak, peak_layer: the largest value and its lowest layer; groups without a value are left out."""
    have = long.where("value is not null")
    best = have.groupBy(*by).agg(F.max(F.struct("value", (-F.col(layer)).alias("l"))).alias("s"))
    return best.select(*by, F.col("s.value").alias("peak"), (-F.col("s.l")).alias("peak_layer"))


def per_group(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """by..., and per metric its mean, maximum and best layer; mean of row means, maximum of row maxima. Null keys are a group."""
    aggs = []
    for m in metrics:
        best = F.max(F.when(F.col(m).isNotNull(), F.struct(F.round(m, 9), (-F.col("layer")).alias("l"))))
        aggs += [F.avg(m).alias(f"{m}_mean"), F.max(m).alias(f"{m}_max"), (-best.getField("l")).alias(f"{m}_best_layer")]
    values = F.filter(F.array(*metrics), lambda x: x.isNotNull())
    row_mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))
    return df.groupBy(*by).agg(*aggs, F.avg(row_mean).alias("mean_all"), F.max(F.array_max(values)).alias("max_all"))


def best_k(summary: DataFrame, base: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """base..., metric, the k with the largest mean and the k with the largest maximum; ties go to the smaller k."""
    out = None
    for m in metrics:
        pick = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(c, (-F.col("k")).alias("k"), F.col(f"{m}_best_layer").alias("layer"))))  # noqa: B023, E731
        g = summary.groupBy(*base).agg(pick(f"{m}_mean").alias("a"), pick(f"{m}_max").alias("b"))
        rows = g.select(*base, F.lit(m).alias("metric"), (-F.col("a.k")).alias("best_k_mean"), F.col(f"a.{m}_mean").alias("best_mean"), F.col("a.layer").alias("best_mean_layer"), (-F.col("b.k")).alias("best_k_max"), F.col(f"b.{m}_max").alias("best_max"))
        out = rows if out is None else out.unionByName(rows)
    return out


def at_extreme(df: DataFrame, by: Sequence[str], value: str, beside: str) -> DataFrame:
    """by..., and `value` at its largest and smallest with `beside` in the same row (lowest layer on ties), and both means."""
    low = F.min(F.struct(value, "layer", beside))
    high = F.max(F.struct(value, (-F.col("layer")).alias("l"), beside))
    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(high.alias("h"), low.alias("l"), F.avg(value).alias("mean"), F.avg(beside).alias("beside_mean"))
    return g.select(*by, F.col(f"h.{value}").alias("highest"), F.col(f"h.{beside}").alias("beside_highest"), F.col(f"l.{value}").alias("lowest"), F.col(f"l.{beside}").alias("beside_lowest"), "mean", "beside_mean")


def with_grand_mean(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], digits: int = 3) -> DataFrame:
    """df and one more row: 'MEAN' in the ids, the means of the metrics rounded half to even."""
    mean = df.agg(*[F.bround(F.avg(m), digits).alias(m) for m in metrics]).select(*[F.lit("MEAN").alias(i) for i in ids], *metrics)
    return df.select(*ids, *metrics).unionByName(mean)


def ranked(long: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """long with place: 1 for the largest value of each group; ties by key."""
    w = Window.partitionBy(*by).orderBy(F.col("value").desc_nulls_last(), key)
    return long.withColumn("place", F.row_number().over(w))
