"""Report queries. Their rows are metrics by model, prompt, layer and k, taken from the long table:
a model's rows are parted into prompts by the day they were loaded, into layers by position, into k by row number."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiweave.operators import summaries as S
from lexiweave.plans.base import Catalogue, sql_round
from lexiweave.sources.tables import table

C = Catalogue()
r6 = lambda c: F.round(c, 6) + F.lit(0.0)
METRICS = ("fc", "fa", "fasttext", "bert", "cross")
_rank = "case prompt when 'averaged' then 1 when 'template' then 2 when 'forced_choice' then 3 else 4 end"

SQL_ROWS = """
base as (select model_alias as model, ['averaged', 'template', 'forced_choice', 'free_association'][day(loaded_at) % 4 + 1] as prompt, assoc_pos as layer, [5, 10, 20][row_id % 3 + 1] as k,
         length(association)::double / 20 as la, length(cue_word)::double / 20 as lc, (association = lower(association))::int::double as lo, (row_id % 7)::double / 7 as h,
         case when length(association) > 9 then 1.0::double else 0.0::double end as big from long_df where loaded_at is not null and assoc_pos is not null),
lay as (select model, prompt, layer, k, avg(la) as fc, avg(lo) as fa, avg(lc) as fasttext, nullif(avg(big), 0) as bert, avg(h) as "cross", count(*) as n from base group by 1, 2, 3, 4),
mp as (select model, prompt, layer, avg(fc) as fc, avg(fa) as fa, avg(fasttext) as fasttext, avg(bert) as bert, avg("cross") as "cross" from lay group by 1, 2, 3),
lng as (select model, prompt, layer, metric, value from (select * from mp) unpivot include nulls (value for metric in (fc, fa, fasttext, bert, "cross")))"""


def layer_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "long_df", "model_alias", "loaded_at", "assoc_pos", "row_id", "association", "cue_word").where("loaded_at is not null and assoc_pos is not null")
    prompt = F.element_at(F.array(*map(F.lit, S.PROMPTS)), F.dayofmonth("loaded_at") % 4 + 1)
    k = F.element_at(F.array(F.lit(5), F.lit(10), F.lit(20)), (F.col("row_id") % 3 + 1).cast("int"))
    base = t.select(
        F.col("model_alias").alias("model"), prompt.alias("prompt"), F.col("assoc_pos").alias("layer"), k.alias("k"), (F.length("association") / 20).alias("la"), (F.length("cue_word") / 20).alias("lc"),
        (F.col("association") == F.lower("association")).cast("double").alias("lo"), ((F.col("row_id") % 7) / 7).alias("h"), F.when(F.length("association") > 9, 1.0).otherwise(0.0).alias("big"),
    )
    return base.groupBy("model", "prompt", "layer", "k").agg(
        F.avg("la").alias("fc"), F.avg("lo").alias("fa"), F.avg("lc").alias("fasttext"), F.nullif(F.avg("big"), F.lit(0.0)).alias("bert"), F.avg("h").alias("cross"), F.count(F.lit(1)).alias("n")
    )


def _mp(spark: SparkSession, d: str) -> DataFrame:
    return layer_rows(spark, d).groupBy("model", "prompt", "layer").agg(*[F.avg(m).alias(m) for m in METRICS])


def _long(spark: SparkSession, d: str) -> DataFrame:
    return S.melted(_mp(spark, d), ["model", "prompt", "layer"], METRICS)


@C.query(f"with {SQL_ROWS}, a as (select model, prompt, metric, avg(value) as v from lng group by 1, 2, 3) select prompt, metric, {sql_round('avg(v)')} as value from a group by 1, 2")
def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    """Layers to models, then models to prompts."""
    return S.mean_of_means(_long(spark, d), ["model", "prompt", "metric"], ["prompt", "metric"]).withColumn("value", r6(F.col("value")))


@C.query(f"with {SQL_ROWS}, a as (select prompt, layer, metric, avg(value) as v from lng group by 1, 2, 3) select prompt, metric, {sql_round('max(v)')} as peak, (arg_max(layer, (round(v, 9), -layer)))::int as peak_layer from a where v is not null group by 1, 2")
def peak_layer(spark: SparkSession, d: str) -> DataFrame:
    """The layer with the largest mean of each prompt and metric; the lowest on ties."""
    means = _long(spark, d).groupBy("prompt", "layer", "metric").agg(F.round(F.avg("value"), 9).alias("value"))
    return S.peaks(means, "prompt", "metric").withColumn("peak", r6(F.col("peak")))


@C.query(f"""with {SQL_ROWS}, c as (select model, prompt, metric, round(avg(value), 9) as v from lng group by 1, 2, 3)
    select metric, {sql_round("max(v)")} as best, arg_max(model || '/' || prompt, v) as best_cell, {sql_round("min(v)")} as worst, arg_min(model || '/' || prompt, v) as worst_cell from c where v is not null group by 1""")
def best_worst_cell(spark: SparkSession, d: str) -> DataFrame:
    """The best and the worst model and prompt of each metric."""
    c = _long(spark, d).groupBy("model", "prompt", "metric").agg(F.round(F.avg("value"), 9).alias("v")).where("v is not null")
    cell = F.concat_ws("/", "model", "prompt")
    g = c.groupBy("metric").agg(F.max(F.struct("v", cell.alias("c"))).alias("b"), F.min(F.struct("v", cell.alias("c"))).alias("w"))
    return g.select("metric", r6(F.col("b.v")).alias("best"), F.col("b.c").alias("best_cell"), r6(F.col("w.v")).alias("worst"), F.col("w.c").alias("worst_cell"))


_KSQL = ", ".join(f'avg("{m}") as {m}_mean, max("{m}") as {m}_max, arg_max(layer, (round("{m}", 9), -layer)) filter (where "{m}" is not null) as {m}_best_layer' for m in METRICS)
_ROWAVG = "list_avg(list_filter([fc, fa, fasttext, bert, \"cross\"], lambda x: x is not null))"
_PERK = f"perk as (select model, prompt, k, {_KSQL}, avg({_ROWAVG}) as mean_all, max(greatest(fc, fa, fasttext, bert, \"cross\")) as max_all from lay group by 1, 2, 3)"


def _perk(spark: SparkSession, d: str) -> DataFrame:
    return S.per_group(S.finite(layer_rows(spark, d), *METRICS), ["model", "prompt", "k"], METRICS)


@C.query(f"with {SQL_ROWS}, {_PERK} select model, prompt, k, {', '.join(f'{sql_round(f'{m}_mean')} as {m}_mean, {sql_round(f'{m}_max')} as {m}_max, {m}_best_layer::int as {m}_best_layer' for m in METRICS)}, {sql_round('mean_all')} as mean_all, {sql_round('max_all')} as max_all from perk")
def summary_per_k(spark: SparkSession, d: str) -> DataFrame:
    """Mean, maximum and best layer per group and k; null values are passed over, null keys kept."""
    s = _perk(spark, d)
    return s.select(*[F.col(c) if c in ("model", "prompt", "k") or c.endswith("_layer") else r6(F.col(c)).alias(c) for c in s.columns])


@C.query(f"""with {SQL_ROWS}, {_PERK}, m as ({" union all ".join(f"select model, prompt, k, '{m}' as metric, {m}_mean as mean, {m}_max as mx from perk" for m in METRICS)})
    select model, prompt, metric, (arg_max(k, (round(mean, 9), -k)))::int as best_k_mean, {sql_round("max(mean)")} as best_mean, (arg_max(k, (round(mx, 9), -k)))::int as best_k_max, {sql_round("max(mx)")} as best_max from m where mean is not null group by 1, 2, 3""")
def best_k(spark: SparkSession, d: str) -> DataFrame:
    """The best k by mean and by maximum."""
    s = _perk(spark, d)
    s = s.withColumns({c: F.round(c, 9) for c in s.columns if c.endswith(("_mean", "_max"))})
    b = S.best_k(s, ["model", "prompt"], METRICS).where("best_mean is not null")
    return b.select("model", "prompt", "metric", "best_k_mean", r6(F.col("best_mean")).alias("best_mean"), "best_k_max", r6(F.col("best_max")).alias("best_max"))


@C.query(f"""with {SQL_ROWS}, {_PERK}, m as ({" union all ".join(f"select model, prompt, k, '{m}' as metric, {m}_mean as v, {m}_best_layer as l from perk" for m in METRICS)}),
    a as (select metric, k, round(avg(v), 9) as v, avg(l) as l from m where v is not null group by 1, 2), b as (select metric, arg_max(k, (v, -k)) as k from a group by 1),
    p as (select m.metric, m.k, prompt, round(avg(v), 9) as v from m join b on b.metric = m.metric and b.k = m.k where v is not null group by 1, 2, 3)
    select p.metric, p.k, p.prompt, row_number() over (partition by p.metric order by p.v desc, p.prompt) as place, {sql_round("a.v")} as k_mean, {sql_round("a.l")} as mean_best_layer from p join a on a.metric = p.metric and a.k = p.k""")
def k_report(spark: SparkSession, d: str) -> DataFrame:
    """Per metric the best k, and the prompts in order at that k."""
    s = _perk(spark, d)
    rows = None
    for m in METRICS:
        part = s.select("model", "prompt", "k", F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("v"), F.col(f"{m}_best_layer").alias("l")).where("v is not null")
        rows = part if rows is None else rows.unionByName(part)
    a = rows.groupBy("metric", "k").agg(F.round(F.avg("v"), 9).alias("k_mean"), F.avg("l").alias("mean_best_layer"))
    b = a.groupBy("metric").agg(F.max(F.struct("k_mean", (-F.col("k")).alias("nk"), "mean_best_layer")).alias("s")).select("metric", (-F.col("s.nk")).alias("k"), "s.k_mean", "s.mean_best_layer")
    p = rows.join(F.broadcast(b), ["metric", "k"]).groupBy("metric", "k", "prompt", "k_mean", "mean_best_layer").agg(F.round(F.avg("v"), 9).alias("value"))  # one row per metric
    out = S.ranked(p, ["metric"], "prompt")
    return out.select("metric", "k", "prompt", F.col("place").cast("long").alias("place"), r6(F.col("k_mean")).alias("k_mean"), r6(F.col("mean_best_layer")).alias("mean_best_layer"))


@C.query(f"with {SQL_ROWS}, a as (select model, prompt, metric, min(value) as lo, max(value) as hi, avg(value) as av from lng where layer > 0 group by 1, 2, 3) select model, prompt, metric, stat, {sql_round('v')} as v from a unpivot include nulls (v for stat in (lo, hi, av))")
def minmaxmean_long(spark: SparkSession, d: str) -> DataFrame:
    """Smallest, largest and mean value, in long form."""
    a = _long(spark, d).where("layer > 0").groupBy("model", "prompt", "metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("av"))
    return a.unpivot(["model", "prompt", "metric"], ["lo", "hi", "av"], "stat", "v").withColumn("v", r6(F.col("v")))


@C.query(f"""with {SQL_ROWS}, m as (select *, round(fa, 9) as f from mp where fa is not null) select model, prompt, {sql_round("max(f)")} as highest, {sql_round("arg_max(fc, (f, -layer))")} as beside_highest,
    {sql_round("min(f)")} as lowest, {sql_round("arg_min(fc, (f, layer))")} as beside_lowest, {sql_round("avg(f)")} as mean, {sql_round("avg(fc)")} as beside_mean from m group by 1, 2""")
def perf_grid(spark: SparkSession, d: str) -> DataFrame:
    """The full model at its best and worst layer, with the baseline of the same layer."""
    g = S.at_extreme(_mp(spark, d).withColumn("fa", F.round("fa", 9)), ["model", "prompt"], "fa", "fc")
    return g.select("model", "prompt", *[r6(F.col(c)).alias(c) for c in g.columns[2:]])


_PEAK = """pk as (select model, prompt, round(max(fa), 9) as peak, arg_max(layer, (round(fa, 9), -layer)) as best_layer, arg_max(fc, (round(fa, 9), -layer)) as fc_at, arg_max("cross", (round(fa, 9), -layer)) as cross_at from mp group by 1, 2),
me as (select model, prompt, avg(fa) as mean_fa, avg(fc) as mean_fc from mp group by 1, 2), pj as (select *, fc_at - cross_at as delta from pk left join me using (model, prompt))"""


def _peak_join(spark: SparkSession, d: str) -> DataFrame:
    mp = _mp(spark, d)
    best = mp.groupBy("model", "prompt").agg(F.max(F.struct(F.round("fa", 9).alias("peak"), (-F.col("layer")).alias("l"), "fc", "cross")).alias("s"))
    peak = best.select("model", "prompt", "s.peak", (-F.col("s.l")).alias("best_layer"), (F.col("s.fc") - F.col("s.cross")).alias("delta"))
    mean = mp.groupBy("model", "prompt").agg(F.avg("fa").alias("mean_fa"), F.avg("fc").alias("mean_fc"))
    return peak.join(mean, ["model", "prompt"], "left")


@C.query(f"with {SQL_ROWS}, {_PEAK} select model, prompt, best_layer::int as best_layer, {sql_round('peak')} as peak, {sql_round('delta')} as delta, {sql_round('mean_fa')} as mean_fa, {sql_round('mean_fc')} as mean_fc from pj")
def peak_join_mean(spark: SparkSession, d: str) -> DataFrame:
    """The peak row of each model and prompt beside its means."""
    return _peak_join(spark, d).select("model", "prompt", "best_layer", *[r6(F.col(c)).alias(c) for c in ("peak", "delta", "mean_fa", "mean_fc")])


@C.query(f"with {SQL_ROWS}, {_PEAK} select model, prompt, {sql_round('peak')} as peak, {sql_round('mean_fa')} as mean_fa from pj union all select 'MEAN', 'MEAN', round_even(avg(round(peak, 6)), 3), round_even(avg(round(mean_fa, 6)), 3) from pj")
def grand_mean_row(spark: SparkSession, d: str) -> DataFrame:
    """The summary with a row of means at its end."""
    s = _peak_join(spark, d).select("model", "prompt", r6(F.col("peak")).alias("peak"), r6(F.col("mean_fa")).alias("mean_fa"))
    return S.with_grand_mean(s, ["model", "prompt"], ["peak", "mean_fa"])


@C.query(f"""with {SQL_ROWS}, {_PEAK} select model, {sql_round("avg(delta)")} as mean_delta, {sql_round("max(abs(delta))")} as scale from pj where upper(model) <> 'MEAN' group by 1""")
def weighted_delta(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference per model and its symmetric scale, without summary rows."""
    return _peak_join(spark, d).where("upper(model) <> 'MEAN'").groupBy("model").agg(r6(F.avg("delta")).alias("mean_delta"), r6(F.max(F.abs("delta"))).alias("scale"))


@C.query(f"""with {SQL_ROWS} select model, {", ".join(f"{sql_round(f"avg(value) filter (where prompt = '{p}')")} as {p}" for p in S.PROMPTS)} from lng where metric = 'fc' group by 1""")
def pivot_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Models by prompts in their fixed order."""
    p = _long(spark, d).where("metric = 'fc'").groupBy("model").pivot("prompt", list(S.PROMPTS)).agg(F.avg("value"))
    return p.select("model", *[r6(F.col(c)).alias(c) for c in S.PROMPTS])


@C.query(f"with {SQL_ROWS} select layer, metric, {sql_round('avg(value)')} as value from lng group by 1, 2")
def melt_avg(spark: SparkSession, d: str) -> DataFrame:
    """Metrics in long form, averaged over all models and prompts of a layer."""
    return _long(spark, d).groupBy("layer", "metric").agg(r6(F.avg("value")).alias("value"))


@C.query(f"with {SQL_ROWS}, l as (select k, metric, value from lay unpivot include nulls (value for metric in (fc, fa, fasttext, bert, \"cross\"))) select k, metric, {sql_round('avg(value)')} as value from l group by 1, 2")
def k_metric_means(spark: SparkSession, d: str) -> DataFrame:
    """Flat means over all rows by k and metric."""
    return S.melted(layer_rows(spark, d), ["k"], METRICS).groupBy("k", "metric").agg(r6(F.avg("value")).alias("value"))


@C.query(f"with {SQL_ROWS} select model, prompt, k, {sql_round('avg(fa)')} as fa, {sql_round('avg(fc)')} as fc from lay group by 1, 2, 3")
def nn_grid(spark: SparkSession, d: str) -> DataFrame:
    """Means over layers per model, prompt and k."""
    return layer_rows(spark, d).groupBy("model", "prompt", "k").agg(r6(F.avg("fa")).alias("fa"), r6(F.avg("fc")).alias("fc"))


@C.query(f"with {SQL_ROWS}, n as (select model, count(distinct layer) as n_layers from mp group by 1) select model, n_layers, row_number() over (order by n_layers, model) as place from n")
def layer_order(spark: SparkSession, d: str) -> DataFrame:
    """Models in the order of their number of layers."""
    n = _mp(spark, d).groupBy("model").agg(F.count_distinct("layer").alias("n_layers"))
    # One row per model: a dimension, whatever the data.
    return n.withColumn("place", F.row_number().over(Window.orderBy("n_layers", "model")).cast("long"))


@C.query(f"with {SQL_ROWS} select prompt, {_rank} as place, layer, {sql_round('avg(fa)')} as value from mp group by 1, 2, 3")
def prompt_curves(spark: SparkSession, d: str) -> DataFrame:
    """One curve per prompt, prompts in their fixed order."""
    order = F.array_position(F.array(*map(F.lit, S.PROMPTS)), F.col("prompt")).cast("int")
    return _mp(spark, d).groupBy("prompt", order.alias("place"), "layer").agg(r6(F.avg("fa")).alias("value"))


@C.query(f"""with {SQL_ROWS}, v as (select row_id % 4 as variant, (length(association) % 5)::double as x from long_df where association is not null),
    dim as (select * from (values (0, 'counts', 100), (1, 'counts', 300), (2, 'ppmi', 100), (3, 'ppmi', null)) t(variant, kind, svd_dim))
    select kind, coalesce(svd_dim, 1000) as svd_dim, {sql_round("avg(x)")} as value, count(*) as n from v join dim using (variant) group by 1, 2""")
def variant_join(spark: SparkSession, d: str) -> DataFrame:
    """A small table of variants joined to the results, means by kind and dimension (none is drawn at 1000)."""
    dim = spark.createDataFrame([(0, "counts", 100), (1, "counts", 300), (2, "ppmi", 100), (3, "ppmi", None)], "variant long, kind string, svd_dim int")
    v = table(spark, d, "long_df", "row_id", "association").where("association is not null").select((F.col("row_id") % 4).alias("variant"), (F.length("association") % 5).cast("double").alias("x"))
    j = v.join(F.broadcast(dim), "variant")  # four rows
    return j.groupBy("kind", F.coalesce("svd_dim", F.lit(1000)).alias("svd_dim")).agg(r6(F.avg("x")).alias("value"), F.count(F.lit(1)).alias("n"))


@C.query(f"""with {SQL_ROWS}, w as (select model, prompt from (select distinct model from lay) cross join (select unnest(['averaged', 'template', 'forced_choice', 'free_association', 'isolated']) as prompt))
    select w.model, w.prompt from w anti join lay on lay.model = w.model and lay.prompt = w.prompt""")
def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    """Wanted models and prompts without results."""
    have = layer_rows(spark, d)
    prompts = spark.createDataFrame([(p,) for p in (*S.PROMPTS, "isolated")], "prompt string")
    return have.select("model").distinct().crossJoin(F.broadcast(prompts)).join(have.select("model", "prompt"), ["model", "prompt"], "left_anti")  # five prompts


@C.query(f"""with {SQL_ROWS}, r as (select case model when 'quill-4' then 'Quill 4' when 'sedge-1-instruct' then 'Sedge 1' else model end as label, fa from mp)
    select label, {sql_round("avg(fa)")} as fa from r group by 1""")
def category_recode(spark: SparkSession, d: str) -> DataFrame:
    """models under the names a figure shows."""
    return _mp(spark, d).replace({"quill-4": "Quill 4", "sedge-1-instruct": "Sedge 1"}, subset=["model"]).groupBy(F.col("model").alias("label")).agg(r6(F.avg("fa")).alias("fa"))


@C.query(f"with {SQL_ROWS} select metric, {sql_round('min(value)')} as low, {sql_round('max(value)')} as high, {sql_round('max(abs(value))')} as scale from lng group by 1")
def color_scale(spark: SparkSession, d: str) -> DataFrame:
    """Common scale of all panels of a figure."""
    return _long(spark, d).groupBy("metric").agg(r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"), r6(F.max(F.abs("value"))).alias("scale"))


@C.query(f"with {SQL_ROWS} select model, prompt, metric, {sql_round('avg(value)')} as mean, {sql_round('stddev_samp(value)')} as sd from lng where metric in ('fc', 'fa') group by 1, 2, 3")
def seed_mean_sd(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation (null for one value)."""
    return _long(spark, d).where(F.col("metric").isin("fc", "fa")).groupBy("model", "prompt", "metric").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"))


@C.query(f"with {SQL_ROWS} select model, prompt, {sql_round('max(fc)')} as peak_fc, (arg_max(layer, (round(fc, 9), -layer)))::int as layer_fc, {sql_round('max(fa)')} as peak_fa, (arg_max(layer, (round(fa, 9), -layer)))::int as layer_fa from mp group by 1, 2")
def rsa_peak_summary(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of both paradigms and their layers."""
    p = S.peaks(_long(spark, d).where(F.col("metric").isin("fc", "fa")).withColumn("value", F.round("value", 9)), "model", "prompt", "metric")
    g = p.groupBy("model", "prompt").pivot("metric", ["fc", "fa"]).agg(F.first("peak").alias("peak"), F.first("peak_layer").alias("layer"))
    return g.select("model", "prompt", r6(F.col("fc_peak")).alias("peak_fc"), F.col("fc_layer").alias("layer_fc"), r6(F.col("fa_peak")).alias("peak_fa"), F.col("fa_layer").alias("layer_fa"))


QUERIES, SQL = C.queries, C.sql
