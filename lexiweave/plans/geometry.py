"""Queries over counts, PPMI, geometries and their comparison."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiweave.functions.rules import clean
from lexiweave.functions.vectors import normalized, normalized_by_sum
from lexiweave.operators import counts as N
from lexiweave.operators import overlap as O
from lexiweave.operators.compare import all_pair_consensus, all_pair_correlations, consensus_sims, correlations, dense_sims, overlap_at_k, sampled_pairs, sparse_sims
from lexiweave.operators.geometry import centred, embedding_layers, mean_vector, nearest
from lexiweave.operators.lexicon import dense_index
from lexiweave.operators.trials import cue_responses, forced_choice_trials, stacked_picks
from lexiweave.plans.base import SQL_COUNTS, SQL_FC, SQL_LONG, SQL_PPMI, Catalogue, sql_clean, sql_round
from lexiweave.sources.tables import table
from lexiweave.sources.workdir import stored

C = Catalogue()
r6 = lambda c: F.round(c, 6) + F.lit(0.0)
#: Pairs of a sampled comparison, as the SVD and ridge programs sample by default; the RSA program takes all pairs (rsa_layerwise_all).
PAIRS = 10_000


def _long(spark: SparkSession, d: str) -> DataFrame:
    return cue_responses(table(spark, d, "long_df", "model_alias", "cue_word", "association"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return N.count_pairs(_long(spark, d))


@C.query(f"with {SQL_LONG} select model, cue, response, count(*) as cnt from lng where cue is not null and response is not null and cue <> response group by 1, 2, 3")
def cue_response_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per model, cue and response, without answers that repeat the cue."""
    return N.count_pairs(_long(spark, d), "model")


@C.query(f"with {SQL_COUNTS}, {SQL_PPMI} select cue, response, cnt, row_sum::bigint as row_sum, col_sum::bigint as col_sum, total::bigint as total from pp")
def marginals(spark: SparkSession, d: str) -> DataFrame:
    """A4: row, column and grand totals beside each count."""
    return N.with_marginals(_counts(spark, d))


@C.query(f"with {SQL_COUNTS}, {SQL_PPMI} select cue, response, {sql_round('ppmi')} as ppmi from pp")
def ppmi(spark: SparkSession, d: str) -> DataFrame:
    """A5: positive pointwise mutual information of the cells that are there."""
    return N.ppmi(_counts(spark, d)).select("cue", "response", r6(F.col("ppmi")).alias("ppmi"))


@C.query(f"""with {SQL_LONG}, c as (select model, cue, response, count(*) as cnt from lng where cue is not null and response is not null and cue <> response group by 1, 2, 3),
    q as (select model, count(distinct cue) as n_cues from lng where cue is not null group by 1),
    p as (select model, n_cues, coalesce(s, 0)::bigint as total from q left join (select model, sum(cnt) as s from c group by 1) using (model)),
    u as (select * from p union all select 'ALL', sum(n_cues)::bigint, sum(total)::bigint from p)
    select model, n_cues, total, {sql_round("total::double / n_cues")} as mean_per_cue from u""")
def row_sum_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals and means per model with a weighted row for all."""
    s = N.row_statistics(N.count_pairs(_long(spark, d), "model"), _long(spark, d))
    return s.withColumn("mean_per_cue", r6(F.col("mean_per_cue")))


#: The words of the geometry: lemmas of the vocabulary that are cues of at least 5 rows, by rank; idx dense from 0.
SQL_WORDS = f"""
sup as (select cue as word, count(*) as n from lng where cue is not null group by 1),
wrd as (select word, vr, row_number() over (order by vr, word) - 1 as idx from (select v.word, v.vr from
        (select lower(lemma) as word, min(vocab_rank) as vr from vocabulary where lemma is not null group by 1) v join sup using (word) where n >= 5))"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    support = table(spark, d, "long_df", "cue_word").groupBy(clean(F.col("cue_word")).alias("word")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5 and word is not null")
    v = table(spark, d, "vocabulary").where("lemma is not null").groupBy(F.lower("lemma").alias("word")).agg(F.min("vocab_rank").alias("vr"))
    top = v.join(support, "word").select("word", "vr")
    return stored(dense_index(top, ["vr", "word"]).select("word", "vr", (F.col("index") - 1).alias("idx")), "words")


def _cells(spark: SparkSession, d: str, words: DataFrame) -> DataFrame:
    kept = _counts(spark, d).join(words.select(F.col("word").alias("cue")), "cue", "left_semi")
    return stored(N.ppmi(kept), "cells")


_CELLS = f"""{SQL_COUNTS.replace("cnt as (", "cnt_all as (")}, {SQL_WORDS}, cnt as (select * from cnt_all where cue in (select word from wrd)), {SQL_PPMI}"""


def _sql_cos(weight: str) -> str:
    return f"""
un as (select cue, response, {weight} / sqrt(sum({weight}::double * {weight}) over (partition by cue)) as w from pp),
cosv as (select a.cue as cue_i, b.cue as cue_j, sum(a.w * b.w) as sim from un a join un b on a.response = b.response and a.cue < b.cue
        where a.w <> 0 and b.w <> 0 and not isnan(a.w) and not isnan(b.w) group by 1, 2)"""


@C.query(f"with {_CELLS}, {_sql_cos('cnt')} select cue_i, cue_j, {sql_round('sim')} as sim from cosv")
def cosine_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cosine between cues over counts; pairs without a common response are 0 and not listed."""
    return N.cosine_of_all(_cells(spark, d, _words(spark, d)), "cnt").withColumn("sim", r6(F.col("sim")))


@C.query(f"with {_CELLS}, {_sql_cos('ppmi')} select cue_i, cue_j, {sql_round('sim')} as sim from cosv")
def cosine_ppmi(spark: SparkSession, d: str) -> DataFrame:
    """Cosine between cues over PPMI."""
    return N.cosine_of_all(_cells(spark, d, _words(spark, d)), "ppmi").withColumn("sim", r6(F.col("sim")))


_NEAR = f"""{_CELLS}, {_sql_cos('ppmi')}, bw as (select cue_i as word, cue_j as neighbour, round(sim, 9) as sim from cosv union all select cue_j, cue_i, round(sim, 9) from cosv),
fan as (select word, neighbour, sim, row_number() over (partition by word order by sim desc, neighbour) as place from bw qualify place <= 5)"""


@C.query(f"with {_NEAR} select word, neighbour, sim, place from fan")
def nearest_cues(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: counts, PPMI, cosine and the five nearest cues of each cue (W8 over M5)."""
    near = N.nearest_of_all(_cells(spark, d, _words(spark, d)), "ppmi", 5)
    return near.select("word", "neighbour", "sim", F.col("place").cast("long").alias("place"))


def _every_cue(spark: SparkSession, d: str) -> DataFrame:
    return stored(N.ppmi(_counts(spark, d)), "cells")


@C.query(C.sql["cosine_counts"].replace(_CELLS, f"{SQL_COUNTS}, {SQL_PPMI}"))
def cosine_counts_all(spark: SparkSession, d: str) -> DataFrame:
    """cosine_counts of all cues of the file, whether they are lemmas of the vocabulary or not."""
    return N.cosine_of_all(stored(_counts(spark, d), "cells"), "cnt", digits=6)


@C.query(C.sql["cosine_ppmi"].replace(_CELLS, f"{SQL_COUNTS}, {SQL_PPMI}"))
def cosine_ppmi_all(spark: SparkSession, d: str) -> DataFrame:
    """cosine_ppmi of all cues of the file, with the marginals of all."""
    # Marginals read the counts four times.
    return N.cosine_of_all(stored(N.ppmi(stored(_counts(spark, d), "counts")), "cells"), "ppmi", digits=6)


@C.query(C.sql["nearest_cues"].replace(_CELLS, f"{SQL_COUNTS}, {SQL_PPMI}"))
def nearest_cues_all(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest cues of every cue of the file, without the limit and the lemma filter of nearest_cues."""
    near = N.nearest_of_all(_every_cue(spark, d), "ppmi", 5)
    return near.select("word", "neighbour", "sim", F.col("place").cast("long").alias("place"))


_EMB = """
e0 as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as p from embeddings)"""


@C.query(f"""with {_EMB}, m as (select p, avg(x) as mu from e0 group by 1), c as (select vec_id, p, x - mu as x from e0 join m using (p)),
    l as (select vec_id, sqrt(sum(x * x)) as len from c group by 1)
    select vec_id, {sql_round("sum(abs(x)) / max(greatest(len, 1e-12))")} as l1, {sql_round("max(x / greatest(len, 1e-12))")} as top from c join l using (vec_id) group by 1""")
def embedding_center_norm(spark: SparkSession, d: str) -> DataFrame:
    """Vectors minus the mean vector at unit length (shown by their absolute sum and largest part)."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    c = centred(v)
    return c.select("vec_id", r6(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.abs(x))).alias("l1"), r6(F.array_max("vec")).alias("top"))


@C.query(f"""with {_EMB}, l as (select vec_id, sqrt(sum(x * x)) as len from e0 group by 1)
    select vec_id, {sql_round("sum(x) / max(greatest(len, 1e-12))")} as unit_sum, {sql_round("sum(x) / max(len + 1e-12)")} as eps_sum from e0 join l using (vec_id) group by 1""")
def embedding_norm_variants(spark: SparkSession, d: str) -> DataFrame:
    """The two ways to bring vectors to unit length without centring."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", r6(total(normalized(F.col("vec")))).alias("unit_sum"), r6(total(normalized_by_sum(F.col("vec")))).alias("eps_sum"))


@C.query(f"with {_EMB} select p as dim, {sql_round('avg(x)')} as mean from e0 group by 1")
def mean_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The average vector."""
    v = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"))
    return mean_vector(v).select(F.posexplode("mean").alias("dim", "mean")).select(F.col("dim").cast("long").alias("dim"), r6(F.col("mean")).alias("mean"))


_UNIT = f"""{_EMB}, mu as (select p, avg(x) as mu from e0 group by 1), ce as (select vec_id, p, x - mu as x from e0 join mu using (p)),
le as (select vec_id, sqrt(sum(x * x)) as len from ce group by 1),
uv as (select vec_id as w, list(x / greatest(len, 1e-12) order by p) as v from ce join le using (vec_id) group by 1)"""


@C.query(f"""with {_UNIT}, s as (select a.w as word, b.w as neighbour, round(list_dot_product(a.v, b.v), 9) as sim from uv a join uv b on a.w <> b.w),
    t as (select *, row_number() over (partition by word order by sim desc, neighbour) as place from s qualify place <= 10)
    select word, neighbour, place from t""")
def embedding_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of each vector by products of blocks."""
    v = centred(table(spark, d, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").cast("array<double>").alias("vec")))
    near = nearest(stored(v.select("word", "vec"), "unit"), 10)
    return near.select("word", "neighbour", F.col("place").cast("long").alias("place"))


_RAW = f"{_EMB}, lr as (select vec_id, sqrt(sum(x * x)) as len from e0 group by 1), ur as (select vec_id as w, list(x / greatest(len, 1e-12) order by p) as v from e0 join lr using (vec_id) group by 1)"


@C.query(f"""with {_RAW}, s as (select a.w as word, b.w as neighbour, round(list_dot_product(a.v, b.v), 12) as sim from ur a join ur b on a.w <> b.w)
    select word, neighbour, place from (select *, row_number() over (partition by word order by sim desc, neighbour) as place from s) where place <= 3""")
def static_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of a static space, at unit length without centring."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("word"), normalized(F.col("embedding").cast("array<double>")).alias("vec"))
    return nearest(stored(v, "static"), 3).select("word", "neighbour", F.col("place").cast("long").alias("place"))


def sql_pairs(words: str, seed: int, size: int = PAIRS) -> str:
    """prs (i, j): the pairs that operators.compare.sampled_pairs draws among the rows of `words`."""
    return f"""
pn as (select count(*) as n, count(*) * (count(*) - 1) // 2 as np from {words}),
pt as (select n, np, np <= {4 * size} as few, unnest(generate_series(0::bigint, case when np <= {4 * size} then np - 1 else {2 * size} - 1 end)) as t from pn),
ph as (select n, case when few then t else ('0x' || substr(md5('{seed}|' || t), 1, 15))::bigint % np end as k, case when few then md5('{seed}|' || t) else lpad(t::varchar, 20, '0') end as o from pt),
pk as (select n, k from (select n, k, min(o) as o from ph group by 1, 2) order by o limit {size}),
pg as (select *, floor(((2 * n - 1) - sqrt(((2 * n - 1) * (2 * n - 1) - 8 * k)::double)) / 2)::bigint as g from pk),
pi_ as (select k, n, case when (g * (2 * n - g - 1)) // 2 > k then g - 1 when ((g + 1) * (2 * n - g - 2)) // 2 <= k then g + 1 else g end as i from pg),
prs as (select i, (k - (i * (2 * n - i - 1)) // 2 + i + 1)::bigint as j from pi_)"""


@C.query(f"with {sql_pairs('(select distinct vec_id from embeddings)', 7)} select i, j from prs")
def pair_sample(spark: SparkSession, d: str) -> DataFrame:
    """10,000 different pairs i < j, drawn by number."""
    words = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx")).distinct()
    return sampled_pairs(words, PAIRS, 7)


@C.query("""select vec_id, case when row_number() over (order by md5('42|' || vec_id::varchar), vec_id) <= ceil(0.2 * count(*) over ()) then 'test' else 'train' end as split from embeddings""")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the words for testing, by hash; the two parts are disjoint."""
    return word_split(table(spark, d, "embeddings").select("vec_id"), "vec_id", 42)


def word_split(words: DataFrame, key: str, seed: int, share: float = 0.2) -> DataFrame:
    hashed = words.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    n = words.agg(F.ceil(F.count(F.lit(1)) * share).alias("_n"))
    placed = dense_index(hashed, ["_h", key], "_place").crossJoin(F.broadcast(n))  # one number
    return placed.select(key, F.when(F.col("_place") <= F.col("_n"), "test").otherwise("train").alias("split"))


# ---- hidden states: embeddings whose number is a word's rank; even and odd dimensions are two models, slices are layers


def _hidden(spark: SparkSession, d: str, words: DataFrame) -> DataFrame:
    own = words.select(F.col("vr").alias("word"), "idx")
    v = embedding_layers(table(spark, d, "embeddings")).join(own, "word")
    return v.drop("word")


def _common(spark: SparkSession, d: str) -> DataFrame:
    """Words that the associations and the embeddings share, idx dense again."""
    w = _words(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("vr")), "vr", "left_semi")
    return stored(dense_index(w.select("word", "vr"), ["vr", "word"]).select("word", "vr", (F.col("index") - 1).alias("idx")), "common")


_COMMON = f"""{SQL_COUNTS.replace("cnt as (", "cnt_all as (")}, {SQL_WORDS.replace("wrd as (", "wrd0 as (")},
wrd as (select word, vr, row_number() over (order by vr, word) - 1 as idx from wrd0 where vr in (select vec_id from embeddings)),
cnt as (select * from cnt_all where cue in (select word from wrd)), {SQL_PPMI}"""
_HID = """
h0 as (select idx, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as p from embeddings join wrd on vr = vec_id),
h1 as (select idx, p // 16 as layer, case when p % 2 = 0 then 'even' else 'odd' end as model, p, x from h0),
hm as (select layer, model, p, avg(x) as mu from h1 group by 1, 2, 3),
h2 as (select idx, layer, model, p, x - mu as x from h1 join hm using (layer, model, p)),
hl as (select idx, layer, model, sqrt(sum(x * x)) as len from h2 group by 1, 2, 3),
hv as (select idx, layer, model, list(x / greatest(len, 1e-12) order by p) as v from h2 join hl using (idx, layer, model) group by 1, 2, 3)"""
_PR = sql_pairs("wrd", 0)
_HS = """
hs as (select a.model, a.layer, i, j, list_dot_product(a.v, b.v) as sim from prs join hv a on a.idx = i join hv b on b.idx = j and a.model = b.model and a.layer = b.layer),
own as (select model, i, j, sum(sim) as s, count(*) as n from hs where layer >= 1 group by 1, 2, 3),
con as (select model, i, j, (sum(s) over (partition by i, j) - s) / nullif(sum(n) over (partition by i, j) - n, 0) as sim from own)"""


@C.query(f"with {_COMMON}, {_HID}, {_PR}, {_HS} select model, i, j, {sql_round('sim')} as sim from con")
def consensus_loo_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Mean similarity of each sampled pair in all layers of the other models."""
    words = _common(spark, d)
    sims = dense_sims(sampled_pairs(words, PAIRS), centred(_hidden(spark, d, words), "model", "layer"), "model", "layer")
    return consensus_sims(sims).withColumn("sim", r6(F.col("sim")))


@C.query(f"""with {_COMMON}, {_HID}, {_PR}, {_HS}, {_sql_cos('ppmi')},
    fs as (select i, j, coalesce(sim, 0) as sim from prs join wrd a on a.idx = i join wrd b on b.idx = j left join cosv on cue_i = least(a.word, b.word) and cue_j = greatest(a.word, b.word)),
    valid as (select idx from wrd join embeddings on vec_id = vr where label % 2 = 0),
    j_ as (select hs.model, hs.layer, hs.sim as h, fs.sim as fa, con.sim as x, case when hs.i in (select idx from valid) and hs.j in (select idx from valid) then fs.sim end as ft
           from hs join fs using (i, j) left join con on con.model = hs.model and con.i = hs.i and con.j = hs.j where hs.layer >= 1)
    select model, layer, count(*) as n_pairs, {sql_round("covar_pop(h, fa) / nullif(stddev_pop(h) * stddev_pop(fa), 0)")} as pearson_fa,
      {sql_round("covar_pop(h, x) / nullif(stddev_pop(h) * stddev_pop(x), 0)")} as pearson_cross,
      {sql_round("covar_pop(h, ft) filter (where ft is not null) / nullif(stddev_pop(h) filter (where ft is not null) * stddev_pop(ft), 0)")} as pearson_valid from j_ group by 1, 2""")
def rsa_layerwise(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of hidden similarities with associations, with the other models, and within the valid words."""
    words = _common(spark, d)
    pairs = stored(sampled_pairs(words, PAIRS), "pairs")
    sims = stored(dense_sims(pairs, centred(_hidden(spark, d, words), "model", "layer"), "model", "layer"), "sims")
    fa = stored(sparse_sims(pairs, _cells(spark, d, words), "ppmi", words), "fa-sims")
    valid = words.join(table(spark, d, "embeddings").where("label % 2 = 0").select(F.col("vec_id").cast("int").alias("vr")), "vr", "left_semi").select("idx")
    ft = fa.join(valid.select(F.col("idx").alias("i")), "i", "left_semi").join(valid.select(F.col("idx").alias("j")), "j", "left_semi")
    out = correlations(sims.where("layer >= 1"), {"fa": fa, "cross": consensus_sims(sims), "valid": ft}, "model", "layer")
    return out.select("model", F.col("layer").cast("long").alias("layer"), "n_pairs", *[r6(F.col(c)).alias(c) for c in ("pearson_fa", "pearson_cross", "pearson_valid")])


#: PPMI over all cues instead of the words' own, and all pairs instead of sampled ones.
_COMMON_ALL = f"""{SQL_COUNTS}, {SQL_PPMI.replace("pp as (", "pp_all as (")}, {SQL_WORDS.replace("wrd as (", "wrd0 as (")},
wrd as (select word, vr, row_number() over (order by vr, word) - 1 as idx from wrd0 where vr in (select vec_id from embeddings)),
pp as (select * from pp_all where cue in (select word from wrd))"""
_PR_ALL = """
prs as (select a.idx as i, b.idx as j from wrd a join wrd b on a.idx < b.idx)"""


def _sql_all(name: str) -> str:
    return C.sql[name].replace(_COMMON, _COMMON_ALL).replace(_PR, _PR_ALL)


@C.query(_sql_all("consensus_loo_pairs"))
def consensus_loo_all(spark: SparkSession, d: str) -> DataFrame:
    """consensus_loo_pairs of all pairs."""
    words = _common(spark, d)
    hidden = centred(_hidden(spark, d, words), "model", "layer").where("layer >= 1")
    return all_pair_consensus(hidden, words).withColumn("sim", r6(F.col("sim")))


@C.query(_sql_all("rsa_layerwise"))
def rsa_layerwise_all(spark: SparkSession, d: str) -> DataFrame:
    """rsa_layerwise over all pairs of all supported words, as the RSA program does by default."""
    words = _common(spark, d)
    hidden = centred(_hidden(spark, d, words), "model", "layer").where("layer >= 1")
    cells = stored(N.ppmi(_counts(spark, d)).join(words.select(F.col("word").alias("cue")), "cue", "left_semi"), "cells")
    valid = words.join(table(spark, d, "embeddings").where("label % 2 = 0").select(F.col("vec_id").cast("int").alias("vr")), "vr", "left_semi").select("idx")
    out = all_pair_correlations(hidden, cells, "ppmi", words, valid)
    return out.select("model", F.col("layer").cast("long").alias("layer"), "n_pairs", *[r6(F.col(c)).alias(c) for c in ("pearson_fa", "pearson_cross", "pearson_valid")])


_HNEAR = """
hnn as (select model, layer, word, neighbour from (select a.model, a.layer, a.idx as word, b.idx as neighbour, row_number() over (partition by a.model, a.layer, a.idx
        order by round(list_dot_product(a.v, b.v), 12) desc, b.idx) as place from hv a join hv b on a.model = b.model and a.layer = b.layer and a.idx <> b.idx) where place <= 5)"""


@C.query(f"""with {_COMMON}, {_HID}, {_HNEAR}, {_sql_cos('ppmi')}, bw as (select cue_i as word, cue_j as neighbour, round(sim, 9) as sim from cosv union all select cue_j, cue_i, round(sim, 9) from cosv),
    fan as (select a.idx as word, b.idx as neighbour from (select word, neighbour, row_number() over (partition by word order by sim desc, neighbour) as place from bw qualify place <= 5) f
            join wrd a on a.word = f.word join wrd b on b.word = f.neighbour),
    o as (select h.model, h.layer, count(*) as n from hnn h join fan using (word, neighbour) group by 1, 2)
    select g.model, g.layer, {sql_round("coalesce(n, 0) / 5.0 / (select count(*) from wrd)")} as overlap from (select distinct model, layer from hnn where layer >= 1) g left join o using (model, layer)""")
def nn_overlap_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Shared part of the five nearest words in each layer and in the associations."""
    words = _common(spark, d)
    hidden = stored(centred(_hidden(spark, d, words), "model", "layer").withColumnRenamed("idx", "word"), "hidden")
    mine = nearest(hidden.where("layer >= 1"), 5, "model", "layer")
    theirs = N.nearest_by_cosine(_cells(spark, d, words), "ppmi", 5).join(words.select("word", "idx"), "word").join(words.select(F.col("word").alias("neighbour"), F.col("idx").alias("jdx")), "neighbour")
    out = overlap_at_k(mine, theirs.select(F.col("idx").alias("word"), F.col("jdx").alias("neighbour")), words, 5, "model", "layer")
    return out.select("model", F.col("layer").cast("long").alias("layer"), r6(F.col("overlap")).alias("overlap"))


#: Numbers of neighbours that are looked at in one run.
KS = (5, 10, 20, 50, 100, 200)
_HALF = """
el as (select idx, label % 2 = 0 as valid, [x::double for x in embedding[1:8]] as a, [x::double for x in embedding[9:16]] as b from embeddings join wrd on vr = vec_id),
eu as (select idx, valid, [x / greatest(sqrt(list_dot_product(a, a)), 1e-12) for x in a] as ft, [x / greatest(sqrt(list_dot_product(b, b)), 1e-12) for x in b] as bert from el)"""
_FC_COS = f"""
fcs as (select {sql_clean("input")} as cue, {sql_clean("p1")} as response from fct union all select {sql_clean("input")}, {sql_clean("p2")} from fct),
fcc as (select cue, response, count(*)::double as n from fcs where cue is not null and response is not null and cue <> response and cue in (select word from wrd) group by 1, 2),
fcu as (select cue, response, n / sqrt(sum(n * n) over (partition by cue)) as w from fcc),
fcos as (select a.cue as cue_i, b.cue as cue_j, sum(a.w * b.w) as sim from fcu a join fcu b on a.response = b.response and a.cue < b.cue group by 1, 2)"""


def _static(spark: SparkSession, d: str, words: DataFrame) -> DataFrame:
    """idx, valid, ft, bert: two static spaces, the halves of the embeddings, at unit length without centring; words of odd labels are not valid in the first."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("vr"), "label", F.col("embedding").cast("array<double>").alias("e")).join(words.select("vr", "idx"), "vr")
    return e.select("idx", (F.col("label") % 2 == 0).alias("valid"), normalized(F.slice("e", 1, 8)).alias("ft"), normalized(F.slice("e", 9, 8)).alias("bert"))


@C.query(f"""with {SQL_FC}, {_COMMON}, {_HID}, {_PR}, {_HS}, {_HALF}, {_FC_COS},
    o as (select i, j, coalesce(sim, 0) as fc, case when x.valid and y.valid then list_dot_product(x.ft, y.ft) end as ft, list_dot_product(x.bert, y.bert) as bert
          from prs join wrd a on a.idx = i join wrd b on b.idx = j join eu x on x.idx = i join eu y on y.idx = j left join fcos on cue_i = least(a.word, b.word) and cue_j = greatest(a.word, b.word)),
    j_ as (select model, layer, sim as h, fc, ft, bert from hs join o using (i, j) where layer >= 1)
    select model, layer, count(*) as n_pairs, count(ft) as n_valid, {sql_round("covar_pop(h, fc) / nullif(stddev_pop(h) * stddev_pop(fc), 0)")} as pearson_fc,
      {sql_round("covar_pop(h, ft) filter (where ft is not null) / nullif(stddev_pop(h) filter (where ft is not null) * stddev_pop(ft), 0)")} as pearson_ft,
      {sql_round("covar_pop(h, bert) / nullif(stddev_pop(h) * stddev_pop(bert), 0)")} as pearson_bert from j_ group by 1, 2""")
def rsa_references(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of hidden similarities with forced choice, with the first static space within its valid words, and with the second one, over the sampled pairs."""
    words = _common(spark, d)
    pairs = stored(sampled_pairs(words, PAIRS), "pairs")
    sims = dense_sims(pairs, centred(_hidden(spark, d, words), "model", "layer").where("layer >= 1"), "model", "layer")
    picks = N.count_pairs(stacked_picks(forced_choice_trials(table(spark, d, "fc_raw")))).join(words.select(F.col("word").alias("cue")), "cue", "left_semi")
    static = stored(_static(spark, d, words), "static")
    ft = dense_sims(pairs, static.where("valid").select("idx", F.col("ft").alias("vec")))
    others = {"fc": sparse_sims(pairs, stored(picks, "picks"), "cnt", words), "ft": ft, "bert": dense_sims(pairs, static.select("idx", F.col("bert").alias("vec")))}
    out = correlations(stored(sims, "sims"), others, "model", "layer").crossJoin(F.broadcast(ft.agg(F.count(F.lit(1)).alias("n_valid"))))  # one number
    return out.select("model", F.col("layer").cast("long").alias("layer"), "n_pairs", "n_valid", *[r6(F.col(f"pearson_{c}")).alias(f"pearson_{c}") for c in others])


def _sql_near(name: str, of: str, by: str, vec: str, where: str = "true") -> str:
    keys = "".join(f"a.{b}, " for b in by.split()) if by else ""
    same = "".join(f" and a.{b} = b.{b}" for b in by.split())
    return f"""
{name} as (select {keys}a.idx as word, b.idx as neighbour, row_number() over (partition by {keys}a.idx order by round(list_dot_product(a.{vec}, b.{vec}), 12) desc, b.idx) as place
    from (select * from {of} where {where}) a join (select * from {of} where {where}) b on a.idx <> b.idx{same} qualify place <= {KS[-1]})"""


@C.query(f"""with {_COMMON}, {_HID}, {_HALF}, {_sql_cos('ppmi')}, hz as (select h.*, valid from hv h join eu using (idx) where layer >= 1),
    {_sql_near("hn", "hz", "model layer", "v")}, {_sql_near("hf", "hz", "model layer", "v", "valid")}, {_sql_near("nf", "eu", "", "ft", "valid")}, {_sql_near("nb", "eu", "", "bert")},
    bw as (select cue_i as word, cue_j as neighbour, round(sim, 9) as sim from cosv union all select cue_j, cue_i, round(sim, 9) from cosv),
    na as (select a.idx as word, b.idx as neighbour, place from (select word, neighbour, row_number() over (partition by word order by sim desc, neighbour) as place from bw qualify place <= {KS[-1]}) f
           join wrd a on a.word = f.word join wrd b on b.word = f.neighbour),
    met as (select 'fa' as reference, model, layer, greatest(hn.place, na.place) as p from hn join na using (word, neighbour) union all
            select 'bert', model, layer, greatest(hn.place, nb.place) from hn join nb using (word, neighbour) union all
            select 'ft', model, layer, greatest(hf.place, nf.place) from hf join nf using (word, neighbour)),
    n as (select 'fa' as reference, count(*) as n from eu union all select 'bert', count(*) from eu union all select 'ft', count(*) from eu where valid),
    g as (select distinct reference, model, layer, k, n, least(k, n - 1) as k_eff from n cross join (select distinct model, layer from hz) cross join (select unnest({list(KS)}) as k))
    select g.reference, g.model, g.layer, g.k, g.k_eff, {sql_round("count(p) / g.k_eff::double / max(n)")} as overlap from g left join met on met.reference = g.reference and met.model = g.model and met.layer = g.layer and p <= g.k
    group by 1, 2, 3, 4, 5""")
def nn_overlap_all_k(spark: SparkSession, d: str) -> DataFrame:
    """nn_overlap_at_k for all k in one run and further reference spaces; with n words there are k_eff = min(k, n - 1) neighbours.

    The first static space is compared among its valid words only, whose hidden neighbours are taken
    anew. A pair of neighbours counts for every k from the greater of its two places on, so each list is
    made and joined once.
    """
    words = _common(spark, d)
    static = stored(_static(spark, d, words), "static")
    hidden = stored(centred(_hidden(spark, d, words), "model", "layer").where("layer >= 1").withColumnRenamed("idx", "word"), "hidden")
    valid = static.where("valid").select(F.col("idx").alias("word"))
    top = KS[-1]
    fa = N.nearest_by_cosine(_cells(spark, d, words), "ppmi", top).join(words.select("word", "idx"), "word").join(words.select(F.col("word").alias("neighbour"), F.col("idx").alias("jdx")), "neighbour")
    mine = stored(nearest(hidden, top, "model", "layer"), "near")
    sides = {
        "fa": (mine, fa.select(F.col("idx").alias("word"), F.col("jdx").alias("neighbour"), "place")),
        "bert": (mine, nearest(static.select(F.col("idx").alias("word"), F.col("bert").alias("vec")), top)),
        "ft": (nearest(hidden.join(valid, "word", "left_semi"), top, "model", "layer"), nearest(static.where("valid").select(F.col("idx").alias("word"), F.col("ft").alias("vec")), top)),
    }
    n = static.agg(F.count(F.lit(1)).alias("n_all"), F.count_if("valid").alias("n_valid"))
    groups = hidden.select("model", "layer").distinct().crossJoin(F.broadcast(n)).select("*", F.explode(F.array(*map(F.lit, KS))).alias("k"))  # one row
    out = None
    for name, (left, right) in sides.items():
        met = left.withColumnRenamed("place", "p").join(right.select("word", "neighbour", F.col("place").alias("q")), ["word", "neighbour"])
        counts = met.groupBy("model", "layer").agg(*[F.count_if(F.greatest("p", "q") <= k).alias(f"k{k}") for k in KS])
        counts = counts.select("model", "layer", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("shared")) for k in KS])).alias("s")).select("model", "layer", "s.k", "s.shared")
        size = F.col("n_valid" if name == "ft" else "n_all")
        rows = groups.join(counts, ["model", "layer", "k"], "left").withColumn("k_eff", F.least(F.col("k").cast("long"), size - 1)).select(
            F.lit(name).alias("reference"), "model", F.col("layer").cast("long").alias("layer"), F.col("k").cast("long").alias("k"), "k_eff",
            r6(F.try_divide(F.coalesce("shared", F.lit(0)).cast("double"), F.col("k_eff") * size)).alias("overlap"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@C.query(f"""with {_COMMON}, {_HID}, s as (select a.model, a.idx as word, b.idx as neighbour, round(avg(list_dot_product(a.v, b.v)), 9) as sim
      from hv a join hv b on a.model = b.model and a.layer = b.layer and a.idx <> b.idx where a.layer >= 1 group by 1, 2, 3),
    t as (select m.model, word, neighbour, sim from (select distinct model from s) m join s on s.model <> m.model),
    r as (select *, row_number() over (partition by model, word order by sim desc, neighbour) as place from t qualify place <= 5)
    select model, word, neighbour, round(sim, 5) as sim, place from r""")
def consensus_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest words by the mean similarity in all layers of the other models.

    The mean of the layers' cosines is the product of their joined unit vectors, so no matrix of means is formed.
    """
    words = _common(spark, d)
    unit = centred(_hidden(spark, d, words), "model", "layer").where("layer >= 1")
    layers = unit.groupBy("model", "idx").agg(F.array_sort(F.collect_list(F.struct("layer", "vec"))).alias("l"))
    models = unit.select(F.col("model").alias("target")).distinct()
    joined = F.flatten(F.transform(F.array_sort(F.flatten(F.collect_list("l"))), lambda s: s["vec"]))
    n = F.size(F.flatten(F.collect_list("l")))
    others = layers.crossJoin(F.broadcast(models)).where("model <> target").groupBy("target", "idx").agg(joined.alias("v"), n.alias("n"))  # models by models
    vec = F.transform("v", lambda x: x / F.sqrt("n"))
    near = nearest(stored(others.select(F.col("target").alias("model"), F.col("idx").alias("word"), vec.alias("vec")), "joined"), 5, "model")
    return near.select("model", "word", "neighbour", F.round("sim", 5).alias("sim"), F.col("place").cast("long").alias("place"))


@C.query(f"""with {_COMMON}, sp as (select 'fa' as source, word from wrd union all select 'fc', {sql_clean("input_word")} from fc_raw union all select 'emb', word from wrd join embeddings on vec_id = vr where label % 2 = 0),
    u as (select distinct source, word from sp where word in (select word from wrd)), n as (select source, count(*) as n_words from u group by 1)
    select source, n_words, n_words = (select count(*) from wrd) as covers_all, n_words >= 100 as enough from n""")
def vocab_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Which sources hold all common words, and which at least a hundred."""
    words = _common(spark, d)
    fc = table(spark, d, "fc_raw").select(clean(F.col("input_word")).alias("word"))
    emb = words.join(table(spark, d, "embeddings").where("label % 2 = 0").select(F.col("vec_id").cast("int").alias("vr")), "vr", "left_semi")
    listed = [words.select(F.lit("fa").alias("source"), "word"), fc.select(F.lit("fc").alias("source"), "word"), emb.select(F.lit("emb").alias("source"), "word")]
    every = listed[0].unionByName(listed[1]).unionByName(listed[2]).join(words.select("word"), "word", "left_semi").distinct()
    n = every.groupBy("source").agg(F.count(F.lit(1)).alias("n_words")).crossJoin(F.broadcast(words.agg(F.count(F.lit(1)).alias("n"))))  # one number
    return n.select("source", "n_words", (F.col("n_words") == F.col("n")).alias("covers_all"), (F.col("n_words") >= 100).alias("enough"))


# ---- overlap of the models' answers

_SETS = f"{SQL_LONG}, sets as (select distinct model, cue, response from lng where cue is not null and response is not null)"


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return stored(O.pair_sets(_long(spark, d)), "sets")


_JM = f"""{_SETS}, sz as (select model, count(*) as n from sets group by 1), sh as (select a.model as model_a, b.model as model_b, count(*) as shared from sets a join sets b using (cue, response) group by 1, 2),
jm as (select a.model as model_a, b.model as model_b, coalesce(shared, 0) as shared, coalesce(shared, 0)::double / (a.n + b.n - coalesce(shared, 0)) as jaccard
       from sz a cross join sz b left join sh on sh.model_a = a.model and sh.model_b = b.model)"""


@C.query(f"with {_JM} select model_a, model_b, shared, {sql_round('jaccard')} as jaccard from jm")
def model_jaccard_global(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard of the models' (cue, response) sets."""
    return O.jaccard_matrix(_sets(spark, d)).withColumn("jaccard", r6(F.col("jaccard")))


@C.query(f"with {_JM} select {sql_round('avg(jaccard)')} as mean, {sql_round('stddev_pop(jaccard)')} as sd, {sql_round('min(jaccard)')} as lowest, {sql_round('max(jaccard)')} as highest from jm where model_a < model_b")
def jaccard_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean, population deviation, extremes over pairs of models."""
    j = O.jaccard_matrix(_sets(spark, d)).where("model_a < model_b")
    x = F.col("jaccard")
    return j.agg(r6(F.avg(x)).alias("mean"), r6(F.stddev_pop(x)).alias("sd"), r6(F.min(x)).alias("lowest"), r6(F.max(x)).alias("highest"))


_PC = f"""{_SETS}, first_ as (select min(model) as m from sets), cues as (select distinct cue from sets join first_ on model = m),
g as (select a.model as model_a, b.model as model_b, cue from (select distinct model from sets) a join (select distinct model from sets) b on a.model < b.model cross join cues),
sz as (select model, cue, count(*) as n from sets group by 1, 2), sh as (select a.model as model_a, b.model as model_b, cue, count(*) as shared from sets a join sets b using (cue, response) where a.model < b.model group by 1, 2, 3),
pc as (select g.model_a, g.model_b, coalesce(a.n, 0) as na, coalesce(b.n, 0) as nb, coalesce(shared, 0) as shared from g left join sz a on a.model = g.model_a and a.cue = g.cue
       left join sz b on b.model = g.model_b and b.cue = g.cue left join sh on sh.model_a = g.model_a and sh.model_b = g.model_b and sh.cue = g.cue)"""


@C.query(f"""with {_PC} select model_a, model_b, {sql_round("avg(coalesce(shared::double / nullif(na + nb - shared, 0), 0))")} as jaccard, {sql_round("avg(shared)")} as shared, {sql_round("avg(na + nb - shared)")} as joint from pc group by 1, 2""")
def model_jaccard_percue(spark: SparkSession, d: str) -> DataFrame:
    """Mean overlap per cue of the first model; a cue the other lacks counts as empty."""
    sets = _sets(spark, d)
    first = sets.agg(F.min("model").alias("m"))
    cues = sets.join(F.broadcast(first), F.col("model") == F.col("m")).select("cue").distinct()
    out = O.jaccard_per_cue(sets, cues)
    return out.select("model_a", "model_b", *[r6(F.col(c)).alias(c) for c in ("jaccard", "shared", "joint")])


@C.query(f"""with {_SETS}, m as (select count(distinct model) as m from sets), c as (select cue, response, count(*) as n_models from sets group by 1, 2)
    select cue, response, n_models, {sql_round("n_models::double / m")} as share from c cross join m where n_models >= greatest(1, m // 2)""")
def consensus_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Responses that at least half of the models give."""
    return O.consensus(_sets(spark, d)).withColumn("share", r6(F.col("share")))


@C.query(f"""with {_SETS}, t as (select model, count(*) as total from sets group by 1), o as (select model, count(*) as own from (select min(model) as model from sets group by cue, response having count(*) = 1) group by 1)
    select model, total, coalesce(own, 0) as own, {sql_round("coalesce(own, 0)::double / total")} as rate from t left join o using (model)""")
def model_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    """Responses to a cue that only one model gives."""
    return O.uniqueness(_sets(spark, d)).withColumn("rate", r6(F.col("rate")))


@C.query(f"""with {SQL_FC}, s as (select distinct {sql_clean("input")} as word from fct), l as (select distinct {sql_clean("cue_word")} as word from long_df), v as (select distinct lower(lemma) as word from vocabulary)
    select word, 'both' as side from (select word from s intersect select word from l) where word is not null union all
    select word, 'fc only' from (select word from s except select word from l) where word is not null""")
def vocabulary_sets(spark: SparkSession, d: str) -> DataFrame:
    """Cues of both paradigms, and those of forced choice alone."""
    s = stacked_picks(forced_choice_trials(table(spark, d, "fc_raw"))).select(F.col("cue").alias("word")).where("word is not null").distinct()
    lng = _long(spark, d).select(F.col("cue").alias("word")).distinct()
    both = s.join(lng, "word", "left_semi").select("word", F.lit("both").alias("side"))
    return both.unionByName(s.join(lng, "word", "left_anti").select("word", F.lit("fc only").alias("side")))


QUERIES, SQL = C.queries, C.sql
