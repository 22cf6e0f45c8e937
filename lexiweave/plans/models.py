"""Queries that fit models, play rounds, read logs and run a stream."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.functions.vectors import dot, minus, normalized, norm
from lexiweave.operators import counts as N
from lexiweave.operators import logs as L
from lexiweave.operators.compare import consensus_sims, correlations, dense_sims, sampled_pairs, sparse_sims
from lexiweave.operators.geometry import centred
from lexiweave.operators.lexicon import dense_index
from lexiweave.operators.ridge import fit_groups, fold_of, gram_sums
from lexiweave.operators.rounds import play
from lexiweave.operators.svd import svd_vectors
from lexiweave.operators.trials import forced_choice_trials, stacked_picks
from lexiweave.plans.base import SQL_FC, Catalogue, sql_round
from lexiweave.plans.geometry import _COMMON, _COMMON_ALL, _HID, _HS, _PR, _PR_ALL, PAIRS, _cells, _common, _hidden, word_split
from lexiweave.sources.files import whole_texts
from lexiweave.sources.tables import table
from lexiweave.sources.workdir import scratch, stored
from lexiweave.streaming.sentence_cap import run_available

C = Catalogue()
r6 = lambda c: F.round(c, 6) + F.lit(0.0)


#: Seeds of the split of words and of the pairs, for the spread of a fit.
SEEDS = (42, 43, 44)


def _split_pairs(words: DataFrame, size: int, seed: int) -> DataFrame:
    """split, i, j (idx), place: sampled pairs within the training words and within the test words; no word is in both."""
    split = stored(word_split(words.select("idx"), "idx", seed), "split")
    out = None
    for k, name in enumerate(("train", "test")):
        own = stored(dense_index(split.where(F.col("split") == name).select(F.col("idx").alias("word_idx")), ["word_idx"]).select("word_idx", (F.col("index") - 1).alias("idx")), "own")
        p = sampled_pairs(own, size, seed + k)
        p = p.join(own.select(F.col("idx").alias("i"), F.col("word_idx").alias("wi")), "i").join(own.select(F.col("idx").alias("j"), F.col("word_idx").alias("wj")), "j")
        p = dense_index(p.select(F.col("wi").alias("i"), F.col("wj").alias("j")), ["i", "j"]).select(F.lit(name).alias("split"), "i", "j", (F.col("index") - 1).alias("place"))
        out = p if out is None else out.unionByName(p)
    return stored(out, "split-pairs")


def _ridge_rows(spark: SparkSession, d: str, seed: int = SEEDS[0], words: DataFrame | None = None) -> DataFrame:
    """model, layer, split, fold, the five features and y (the hidden similarity, centred over the training words only)."""
    words = _common(spark, d) if words is None else words
    pairs = _split_pairs(words, PAIRS, seed)
    ij = pairs.select("i", "j")
    hidden = _hidden(spark, d, words).where("layer >= 1")
    train = hidden.join(word_split(words.select("idx"), "idx", seed).where("split = 'train'").select("idx"), "idx", "left_semi")
    y = stored(dense_sims(ij, centred(hidden, "model", "layer", of=train), "model", "layer"), "y")
    cells = _cells(spark, d, words)
    fa = sparse_sims(ij, cells, "cnt", words, "fa")
    fc_cells = N.count_pairs(stacked_picks(forced_choice_trials(table(spark, d, "fc_raw"))))
    fc = sparse_sims(ij, fc_cells, "cnt", words, "fc")
    emb = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("vr"), F.col("embedding").cast("array<double>").alias("e")).join(words.select("vr", "idx"), "vr")
    half = lambda a, b: emb.select("idx", normalized(F.slice("e", a, b)).alias("vec"))
    ft, bert = dense_sims(ij, half(1, 8), name="ft"), dense_sims(ij, half(9, 8), name="bert")
    cross = consensus_sims(y).withColumnRenamed("sim", "cross")
    df = y.withColumnRenamed("sim", "y").join(pairs, ["i", "j"])
    for other in (fa, fc, ft, bert):
        df = df.join(other, ["i", "j"])
    df = df.join(cross, ["model", "i", "j"])
    n = pairs.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    df = df.join(F.broadcast(n), "split")  # two rows
    return df.withColumn("fold", F.when(F.col("split") == "train", fold_of(F.col("place"), F.col("n"))).otherwise(0))


def _ridge_fits(spark: SparkSession, d: str) -> DataFrame:
    words, rows = _common(spark, d), None
    for seed in SEEDS:
        own = _ridge_rows(spark, d, seed, words).withColumn("seed", F.lit(seed))
        rows = own if rows is None else rows.unionByName(own)
    fits = fit_groups(stored(rows, "ridge"), ["seed", "model", "layer"])  # one row per seed, model and layer
    keys = ["seed", "model", "layer"]
    columns = [*keys, *sorted(c for c in fits[0] if c not in keys)] if fits else keys
    kinds = {"seed": "int", "model": "string", "layer": "int", "n_train": "long", "n_test": "long"}
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in fits], ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns))


@C.query()
def ridge_r2_by_layer(spark: SparkSession, d: str) -> DataFrame:
    """R squared of five feature sets per seed, model and layer on words that training never saw."""
    return _ridge_fits(spark, d)


@C.query()
def ridge_seed_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation over the seeds of each R squared and each gain, per model and layer."""
    f = _ridge_fits(spark, d)
    values = [c for c in f.columns if c.startswith(("r2_", "delta_")) and not c.startswith("r2_train")]
    return f.groupBy("model", "layer").agg(F.count(F.lit(1)).alias("n_seeds"), *[x for c in values for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"))])


@C.query()
def ridge_gram_sums(spark: SparkSession, d: str) -> DataFrame:
    """The sums of products per model, layer, split and fold that the ridge is solved from."""
    return gram_sums(stored(_ridge_rows(spark, d), "ridge"), ["model", "layer", "split", "fold"], ["ft", "bert", "cross", "fc", "fa"], "y")


@C.query(f"""with {_COMMON}, {_HID}, tr as (select idx from (select idx, row_number() over (order by md5('42|' || idx::varchar), idx) as r, ceil(0.2 * count(*) over ()) as t from wrd) where r > t),
    um as (select layer, model, p, avg(x) as mu from h1 where idx in (select idx from tr) group by 1, 2, 3), u2 as (select idx, layer, model, p, x - mu as x from h1 join um using (layer, model, p))
    select model, layer, idx, {sql_round("sqrt(sum(x * x))")} as length from u2 group by 1, 2, 3""")
def train_centered_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Vectors minus the mean of the training words only (shown by their lengths)."""
    words = _common(spark, d)
    hidden = _hidden(spark, d, words)
    train = hidden.join(word_split(words.select("idx"), "idx", 42).where("split = 'train'").select("idx"), "idx", "left_semi")
    from lexiweave.operators.geometry import mean_vector

    means = mean_vector(train, "model", "layer")
    out = hidden.join(F.broadcast(means), ["model", "layer"])  # one vector per model and layer
    return out.select("model", F.col("layer").cast("long").alias("layer"), "idx", r6(norm(minus(F.col("vec"), F.col("mean")))).alias("length"))


@C.query(f"""with {_COMMON}, {_HID}, {_PR}, uv as (select idx, layer, model, list(x order by p) as v, sqrt(sum(x * x)) as l from h1 group by 1, 2, 3)
    select a.model, a.layer, {sql_round("avg(list_dot_product(a.v, b.v) / (greatest(a.l, 1e-12) * greatest(b.l, 1e-12)))")} as mean_sim, count(*) as n_pairs
    from prs join uv a on a.idx = i join uv b on b.idx = j and a.model = b.model and a.layer = b.layer group by 1, 2""")
def uncentered_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Similarities without centring, averaged per model and layer."""
    words = _common(spark, d)
    unit = _hidden(spark, d, words).withColumn("vec", normalized(F.col("vec")))
    sims = dense_sims(sampled_pairs(words, PAIRS), unit, "model", "layer")
    return sims.groupBy("model", F.col("layer").cast("long").alias("layer")).agg(r6(F.avg("sim")).alias("mean_sim"), F.count(F.lit(1)).alias("n_pairs"))


@C.query(C.sql["uncentered_cosine"].replace(_COMMON, _COMMON_ALL).replace(_PR, _PR_ALL))
def uncentered_cosine_all(spark: SparkSession, d: str) -> DataFrame:
    """M9: the mean of uncentered_cosine over all pairs, in one pass: the square of the sum of all unit vectors less their own squares is twice the sum over pairs."""
    unit = _hidden(spark, d, _common(spark, d)).withColumn("vec", normalized(F.col("vec")))
    sums = unit.select("model", "layer", F.posexplode("vec").alias("at", "x")).groupBy("model", "layer", "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count(F.lit(1)).alias("n"))
    s = sums.groupBy("model", F.col("layer").cast("long").alias("layer")).agg(((F.sum(F.col("s") * F.col("s")) - F.sum("own")) / 2).alias("sum"), F.expr("max(n) * (max(n) - 1) div 2").alias("n_pairs"))
    return s.where("n_pairs > 0").select("model", "layer", r6(F.col("sum") / F.col("n_pairs")).alias("mean_sim"), "n_pairs")


@C.query(f"""with {_COMMON}, {_HID}, {_PR}, {_HS} select model, {sql_round("avg(sim)")} as mean_sim, {sql_round("stddev_pop(sim)")} as sd, count(*) as n from con group by 1""")
def cross_feature(spark: SparkSession, d: str) -> DataFrame:
    """The cross-model feature of sampled pairs, summed up per model."""
    words = _common(spark, d)
    sims = dense_sims(sampled_pairs(words, PAIRS), centred(_hidden(spark, d, words), "model", "layer"), "model", "layer")
    return consensus_sims(sims).groupBy("model").agg(r6(F.avg("sim")).alias("mean_sim"), r6(F.stddev_pop("sim")).alias("sd"), F.count("sim").alias("n"))


#: Dimensions of the SVD variants.
DIMS = (100, 300, 600)


@C.query()
def svd_variant_rsa(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of hidden similarities, layer 0 included, with counts and PPMI and their SVD variants.

    A variant needs more words and more responses than dimensions; smaller ones are the first parts of the largest.
    """
    words = _common(spark, d)
    cells = _cells(spark, d, words)
    pairs = stored(sampled_pairs(words, PAIRS, 42), "pairs")
    hidden = stored(dense_sims(pairs, centred(_hidden(spark, d, words), "model", "layer"), "model", "layer"), "sims")
    rank = min(cells.agg(F.count_distinct("cue")).first()[0], cells.agg(F.count_distinct("response")).first()[0])
    dims = [n for n in DIMS if n < rank]
    out = None
    for weight in ("cnt", "ppmi"):
        spaces = {weight: sparse_sims(pairs, cells, weight, words)}
        if dims:
            v = stored(svd_vectors(cells, weight, words, dims[-1]), "svd")
            spaces |= {f"{weight}_svd{n}": dense_sims(pairs, v.select("idx", normalized(F.slice("vec", 1, n)).alias("vec"))) for n in dims}
        for name, sims in spaces.items():
            c = correlations(hidden, {"svd": stored(sims, "svd-sims")}, "model", "layer")
            rows = c.select(F.lit(name).alias("variant"), "model", "layer", r6(F.col("pearson_svd")).alias("pearson"), "n_pairs")
            out = rows if out is None else out.unionByName(rows)
    return out


_ROUND = """{nxt}h as (select cue, word, row_number() over (partition by cue order by md5('12345.{r}|' || cue || '|' || word), word) - 1 as p, count(*) over (partition by cue) as n from {cur}),
{nxt}g as (select *, ceil(n / 4.0)::bigint as g from {nxt}h where n > 2),
{nxt}i as (select cue, word, case when p < (n % g) * (n // g + 1) then p // (n // g + 1) else (n % g) + (p - (n % g) * (n // g + 1)) // (n // g) end as grp from {nxt}g),
{nxt} as (select cue, word from (select *, row_number() over (partition by cue, grp order by md5('pick|' || cue || '|' || word), word) as w from {nxt}i) where w <= 2
          union all select cue, word from {cur} where cue not in (select cue from {nxt}i))"""


@C.query(f"""with {SQL_FC}, p0 as (select distinct input as cue, unnest(cand) as word from fct where input is not null and fc_id is not null),
    q0 as (select distinct cue, word from p0 where word <> cue), {_ROUND.format(cur="q0", nxt="q1", r=0)}, {_ROUND.format(cur="q1", nxt="q2", r=1)} select cue, word from q2""")
def forced_choice_round(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds over the pools of all inputs, in groups of four; a hash stands in for the model's picks."""
    t = forced_choice_trials(table(spark, d, "fc_raw"))
    pools = t.select(F.col("input").alias("cue"), F.explode("candidates").alias("word")).where("cue is not null and word <> cue")
    return play(pools, F.md5(F.concat_ws("|", F.lit("pick"), "cue", "word")), size=4, most_rounds=2)[0]


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """One log file per model and round, written from its trials as the jobs write it, and read back as whole texts."""
    t = forced_choice_trials(table(spark, d, "fc_raw"))
    g = t.groupBy("model", "round_no").agg(F.count(F.lit(1)).alias("n"), F.count_if("compliant").alias("ok"), F.count_if(F.col("pick1").isNull() & F.col("pick2").isNull()).alias("none"))
    lines = F.format_string(
        "[Round 1] Initial generation: compliant=%d/%d noncompliant=%d\n[Round 1] After deterministic repair: remaining noncompliant=%d\n"
        "[Round 1] After sampled retries: compliant=%d/%d (%.2f%%), sampled_retries_used=%d\n[Round %d] 45%%\n%s",
        "ok", "n", F.col("n") - F.col("ok"), "none", F.col("n") - F.col("none"), "n", (F.col("n") - F.col("none")) * 100.0 / F.col("n"), F.col("none") * 5, "round_no",
        F.when(F.col("round_no") % 3 == 0, "Wrote final pools summary: x").when(F.col("round_no") % 3 == 1, "Traceback (most recent call last):").otherwise("running"),
    )
    path = scratch(spark, "logs")
    g.select("model", "round_no", lines.alias("text")).where("model is not null and round_no is not null").repartition("model", "round_no").write.partitionBy("model", "round_no").text(path)
    return whole_texts(spark, path).select("model", F.col("round_no").cast("int").alias("round_no"), "text")


_LOGN = f"""{SQL_FC}, g as (select model, round_no, count(*) as n, count(*) filter (where p1 is not null and p2 is not null) as ok, count(*) filter (where p1 is null and p2 is null) as none_ from fct group by 1, 2)"""


@C.query(f"""with {_LOGN} select model, round_no, ok::double as initial_compliant, none_::double as repair_remaining, (n - none_)::double as final_compliant, (none_ * 5)::double as retries_used,
    round_even(ok * 100.0::double / n, 1) as initial_rate, round_even((n - ok - none_) * 100.0::double / nullif(n - ok, 0), 1) as repair_rate from g""")
def log_parse(spark: SparkSession, d: str) -> DataFrame:
    """Counters and rates out of the jobs' logs."""
    s = L.statistics(_logs(spark, d))
    return s.select("model", "round_no", "initial_compliant", "repair_remaining", "final_compliant", "retries_used", "initial_rate", "repair_rate")


@C.query(f"""with {_LOGN} select model, round_no, case round_no % 3 when 0 then 'Completed' when 1 then 'Failed' else 'Running' end as status,
    case when round_no % 3 = 2 then round_no end as last_round, (case round_no % 3 when 0 then 100 when 1 then 0 else 45 end)::int as percent from g""")
def log_status(spark: SparkSession, d: str) -> DataFrame:
    """State, last round and percent done of every job."""
    return L.status(_logs(spark, d))


_STREAM_SQL = r"""with s0 as (select doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1))) as s from documents where text is not null),
s1 as (select doc_id, trim(regexp_replace(s, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) as sentence from s0),
tok as (select unnest(list_distinct(string_split_regex(lower(sentence), '[^a-z0-9]+'))) as word from s1 where sentence <> '' and len(string_split(sentence, ' ')) between 5 and 100),
n as (select word, count(*) as n from tok where word in (select lower(word) from vocabulary) group by 1) select word, least(n, 5) as n_sentences from n where word <> ''"""


@C.query(_STREAM_SQL)
def stream_sentence_cap(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream, five sentences per word at most, state and sink in the shared folder."""
    kept = run_available(spark, f"{d}/documents.parquet", table(spark, d, "vocabulary", "word"), 5, label=uuid.uuid4().hex)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n_sentences"))


@C.query("select count(*) as n_rows from documents")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the batches of the stream have read, from its progress reports."""
    seen: list[dict] = []
    run_available(spark, f"{d}/documents.parquet", table(spark, d, "vocabulary", "word"), 5, label=uuid.uuid4().hex, progress=seen)
    return spark.createDataFrame([(sum(p["n_rows"] for p in seen),)], "n_rows long")  # one number a batch


@C.query(f"""with {_COMMON}, e as (select idx, embedding from wrd join embeddings on vec_id = vr)
    select {sql_round("avg(list_dot_product(a.embedding::double[], b.embedding::double[]))")} as mean_product, count(*) as n from e a join e b on b.idx = a.idx + 1""")
def required_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of words and of the words after them, by inner joins."""
    words = _common(spark, d)
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("vr"), F.col("embedding").cast("array<double>").alias("v")).join(words.select("vr", "idx"), "vr")
    nxt = e.select((F.col("idx") - 1).alias("idx"), F.col("v").alias("w"))
    return e.join(nxt, "idx").agg(r6(F.avg(dot(F.col("v"), F.col("w")))).alias("mean_product"), F.count(F.lit(1)).alias("n"))


QUERIES, SQL = C.queries, C.sql
