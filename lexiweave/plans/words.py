"""Queries over word lists, texts and raw trials."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiweave.functions.digests import Words
from lexiweave.functions.rules import clean, short_number, slug, squeeze, stable_seed
from lexiweave.operators.lexicon import FRAGMENTS, balanced_group, contiguous_shard, dense_index, few_words, first_n_per_key, first_per_key, sentences_of_words
from lexiweave.operators.trials import association_rows, forced_choice_trials, free_association_trials, quality, stacked_picks, winners
from lexiweave.plans.base import SQL_FA, SQL_FC, WS, Catalogue, sql_clean, sql_round, sql_strip
from lexiweave.sources.tables import table
from lexiweave.sources.workdir import stored

C = Catalogue()
r6 = lambda c: F.round(c, 6) + F.lit(0.0)
_bad = ", ".join(f"'{w}'" for w in FRAGMENTS)


@C.query("select p_partkey, p_name as word, p_retailprice as freq, p_type as pos from part where p_type = 'STANDARD' and p_retailprice > 950")
def equality_filter_project(spark: SparkSession, d: str) -> DataFrame:
    """Filter on one class and project with new names; filters reach the scan."""
    p = table(spark, d, "part").where((F.col("p_type") == "STANDARD") & (F.col("p_retailprice") > 950))
    return p.select("p_partkey", F.col("p_name").alias("word"), F.col("p_retailprice").alias("freq"), F.col("p_type").alias("pos"))


@C.query(f"select vocab_rank, lemma, word, freq from vocabulary where lower(word) not in ({_bad}) and word is not null and length(word) > 2")
def lexicon_stop_list(spark: SparkSession, d: str) -> DataFrame:
    """without contraction fragments, nulls and words of two letters."""
    return table(spark, d, "vocabulary").where(~F.lower("word").isin(*FRAGMENTS) & F.col("word").isNotNull() & (F.length("word") > 2)).select("vocab_rank", "lemma", "word", "freq")


@C.query("""select lemma, word, freq, vocab_rank from (select *, row_number() over (partition by lemma order by freq desc nulls last, vocab_rank, word) as n
    from (select distinct * from vocabulary) where lemma is not null) where n = 1""")
def lexicon_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent row of each lemma; repeated rows count once."""
    v = table(spark, d, "vocabulary").distinct()
    return first_per_key(v, "lemma", F.col("freq").desc_nulls_last(), F.col("vocab_rank").asc(), F.col("word").asc()).select("lemma", "word", "freq", "vocab_rank")


@C.query("select lemma, freq, row_number() over (order by freq desc, lemma) as index from (select lemma, max(freq) as freq from vocabulary where lemma is not null and freq is not null group by 1)")
def dense_frequency_index(spark: SparkSession, d: str) -> DataFrame:
    """Position in the order of falling frequency, from 1."""
    v = table(spark, d, "vocabulary").where("lemma is not null and freq is not null").groupBy("lemma").agg(F.max("freq").alias("freq"))
    return dense_index(v.withColumn("_down", -F.col("freq")), ["_down", "lemma"]).select("lemma", "freq", "index")


@C.query("select lemma, freq from (select lemma, max(freq) as freq from vocabulary where lemma is not null group by 1) order by freq desc nulls last, lemma limit 100")
def topn_by_freq(spark: SparkSession, d: str) -> DataFrame:
    """O1, O2: the 100 most frequent lemmas."""
    v = table(spark, d, "vocabulary").where("lemma is not null").groupBy("lemma").agg(F.max("freq").alias("freq"))
    return v.orderBy(F.col("freq").desc_nulls_last(), "lemma").limit(100)


@C.query(f"""with c as (select {sql_clean("cue_word")} as w, count(*) as n from long_df group by 1),
    v as (select lower(word) as word, min(vocab_rank) as vocab_rank from vocabulary where word is not null group by 1)
    select word, vocab_rank, n as support from v join c on c.w = word where n >= 5 order by vocab_rank, word limit 5000""")
def min_support_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Vocabulary words that at least five rows of the long table have as their cue, by rank, 5,000 at most."""
    support = table(spark, d, "long_df", "cue_word").groupBy(clean(F.col("cue_word")).alias("word")).agg(F.count(F.lit(1)).alias("support")).where("support >= 5")
    v = table(spark, d, "vocabulary").where("word is not null").groupBy(F.lower("word").alias("word")).agg(F.min("vocab_rank").alias("vocab_rank"))
    return v.join(support, "word").orderBy("vocab_rank", "word").limit(5000).select("word", "vocab_rank", "support")


@C.query("""with v as (select word, row_number() over (order by word) - 1 as p, count(*) over () as n from (select distinct lower(word) as word from vocabulary where word is not null))
    select word, least(p // greatest(n // 7, 1), 6) as shard from v where n >= 7""")
def contiguous_shards(spark: SparkSession, d: str) -> DataFrame:
    """Seven contiguous shares of the sorted word list, the last with the rest."""
    v = table(spark, d, "vocabulary").where("word is not null").select(F.lower("word").alias("word")).distinct()
    n = v.agg(F.count(F.lit(1)).alias("n"))
    return dense_index(v, ["word"]).crossJoin(F.broadcast(n)).where("n >= 7").select("word", contiguous_shard(F.col("index") - 1, F.col("n"), 7).alias("shard"))


@C.query(f"""with {SQL_FC}, c as (select fc_id, cand, len(cand) as n, ceil(len(cand) / 4.0)::bigint as g from fct where len(cand) > 0),
    e as (select fc_id, n, g, unnest(cand) as candidate, generate_subscripts(cand, 1) - 1 as p from c)
    select fc_id, candidate, p::bigint as place, (case when p < (n % g) * (n // g + 1) then p // (n // g + 1) else (n % g) + (p - (n % g) * (n // g + 1)) // (n // g) end)::bigint as grp from e""")
def balanced_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a trial in groups of at most four, their sizes differing by one at most."""
    t = forced_choice_trials(table(spark, d, "fc_raw")).select("fc_id", F.size("candidates").alias("n"), F.posexplode("candidates").alias("place", "candidate"))
    return t.select("fc_id", "candidate", F.col("place").cast("long").alias("place"), balanced_group(F.col("place"), F.col("n"), 4).alias("grp"))


@C.query(f"""select cue, row_id, place from (select {sql_clean("cue_word")} as cue, row_id, row_number() over (partition by {sql_clean("cue_word")} order by run_file, row_id) as place from long_df)
    where cue is not null and place <= 3""")
def first_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The first three rows of every cue in file order."""
    rows = table(spark, d, "long_df").select(clean(F.col("cue_word")).alias("cue"), "row_id", "run_file").where("cue is not null")
    return first_n_per_key(rows, "cue", 3, F.col("run_file").asc(), F.col("row_id").asc()).select("cue", "row_id", F.col("place").cast("long").alias("place"))


@C.query(f"""select association as raw, {sql_clean("association")} as cleaned, count(*) as n from long_df group by 1, 2""")
def clean_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Raw and cleaned text; what is no word is null."""
    t = table(spark, d, "long_df", "association")
    return t.groupBy(F.col("association").alias("raw"), clean(F.col("association")).alias("cleaned")).agg(F.count(F.lit(1)).alias("n"))


@C.query(f"""with {SQL_FA} select fa_id, unnest(words) as association, generate_subscripts(words, 1)::bigint as position from fat""")
def association_positions(spark: SparkSession, d: str) -> DataFrame:
    """One row per extracted association with its position from 1."""
    return association_rows(free_association_trials(table(spark, d, "fa_raw"))).select("fa_id", "association", F.col("position").cast("long").alias("position"))


@C.query(f"""with {SQL_FA} select fa_id, list_aggregate(words, 'string_agg', '|') as words, len(words)::bigint as n from fat""")
def extract_associations(spark: SparkSession, d: str) -> DataFrame:
    """The words of every response, joined."""
    t = free_association_trials(table(spark, d, "fa_raw"))
    return t.select("fa_id", F.when(F.size("words") > 0, F.array_join("words", "|")).alias("words"), F.size("words").cast("long").alias("n"))


@C.query(f"""with {SQL_FC} select fc_id, e1 as extracted1, e2 as extracted2, p1 as pick1, p2 as pick2, (p1 is not null and p2 is not null) as compliant from fct""")
def extract_picks(spark: SparkSession, d: str) -> DataFrame:
    """Extracted words, valid picks, compliance of every forced-choice trial."""
    return forced_choice_trials(table(spark, d, "fc_raw")).select("fc_id", "extracted1", "extracted2", "pick1", "pick2", "compliant")


_WIN = f"""{SQL_FC},
w0 as (select *, list_transform(list_sort(list_transform(list_distinct(list_filter(cand, lambda c: c is distinct from input)),
        lambda c: {{'h': md5(concat_ws('|', round_no::varchar, trial_id::varchar, input, c)), 'c': c}})), lambda s: s.c) as drawn from fct),
w1 as (select *, coalesce(p1, list_filter(drawn, lambda c: c is distinct from p2)[1], p2) as winner1 from w0),
win as (select *, coalesce(p2, list_filter(drawn, lambda c: c is distinct from winner1)[1], winner1) as winner2 from w1)"""


@C.query(f"with {_WIN} select fc_id, winner1, winner2 from win")
def pick_winner_fill(spark: SparkSession, d: str) -> DataFrame:
    """Two winners per trial, missing picks filled up reproducibly."""
    return winners(forced_choice_trials(table(spark, d, "fc_raw"))).select("fc_id", "winner1", "winner2")


@C.query("select fc_id, ('0x' || substr(sha256(concat_ws('||', round_no::varchar, trial_id::varchar, input_word)), 1, 16))::ubigint::varchar as seed from fc_raw")
def stable_seeds(spark: SparkSession, d: str) -> DataFrame:
    """A 64-bit seed from the trial's content."""
    return table(spark, d, "fc_raw").select("fc_id", stable_seed(F.col("round_no").cast("string"), F.col("trial_id").cast("string"), F.col("input_word")).cast("string").alias("seed"))


@C.query(f"""with {SQL_FC} select fc_id, 'input: ' || coalesce(input, '') || chr(10) || 'candidates: ' || coalesce(list_aggregate(cand, 'string_agg', ', '), '') as prompt from fct""")
def prompt_join(spark: SparkSession, d: str) -> DataFrame:
    """The prompt text of a trial from its parts."""
    t = forced_choice_trials(table(spark, d, "fc_raw"))
    return t.select("fc_id", F.format_string("input: %s\ncandidates: %s", F.coalesce("input", F.lit("")), F.array_join("candidates", ", ")).alias("prompt"))


@C.query(f"""select doc_id, {sql_strip(f"regexp_replace(text, '{WS}+', ' ', 'g')")} as squeezed, regexp_replace(coalesce(author, ''), '[^A-Za-z0-9_.-]+', '_', 'g') as slug from documents""")
def squeeze_and_slug(spark: SparkSession, d: str) -> DataFrame:
    """Texts with single blanks, file-safe author names."""
    return table(spark, d, "documents").select("doc_id", squeeze(F.col("text")).alias("squeezed"), slug(F.coalesce("author", F.lit(""))).alias("slug"))


@C.query("""select c_custkey, regexp_replace(printf('%.2f', c_acctbal / 10000), '^(-?)0\\.', '\\1.') as label,
    regexp_replace(replace(c_mktsegment, 'E', '_'), '_(.*)$', '$_{\\1}$') as axis from customer""")
def name_format(spark: SparkSession, d: str) -> DataFrame:
    """Numbers without the leading zero, subscripts for axis labels."""
    axis = F.regexp_replace(F.regexp_replace("c_mktsegment", "E", "_"), "_(.*)$", "\\$_{$1}\\$")
    return table(spark, d, "customer").select("c_custkey", short_number(F.col("c_acctbal") / 10000).alias("label"), axis.alias("axis"))


_SENT = f"""s0 as (select doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))) as s,
      generate_subscripts(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), 1) - 1 as sent_no from documents where text is not null),
s1 as (select doc_id, sent_no, {sql_strip(f"regexp_replace(s, '{WS}+', ' ', 'g')")} as sentence from s0),
tok as (select doc_id, sent_no, sentence, unnest(list_distinct(string_split_regex(lower(sentence), '[^a-z0-9]+'))) as word from s1
        where sentence <> '' and len(string_split(sentence, ' ')) between 5 and 100),
voc as (select distinct lower(word) as word from vocabulary where word is not null),
hit as (select word, doc_id, sent_no, sentence, row_number() over (partition by word order by doc_id, sent_no) as place from tok join voc using (word) where word <> '')"""


@C.query(f"with {_SENT} select word, doc_id, sent_no::bigint as sent_no, place from hit where place <= 50")
def sentence_word_match(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 sentences that hold each vocabulary word."""
    s = sentences_of_words(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "vocabulary", "word"))
    return s.select("word", "doc_id", F.col("at").cast("long").alias("sent_no"), F.col("place").cast("long").alias("place"))


@C.query(f"""with {_SENT}, n as (select word, count(*) as n from hit where place <= 50 group by 1)
    select word, coalesce(n, 0) as n_sentences, n is null as isolated from voc left join n using (word)""")
def sentences_per_word(spark: SparkSession, d: str) -> DataFrame:
    """Sentences per vocabulary word; words without one stand alone."""
    words = table(spark, d, "vocabulary", "word").where("word is not null").select(F.lower("word").alias("word")).distinct()
    n = sentences_of_words(table(spark, d, "documents", "doc_id", "text"), words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.join(n, "word", "left").select("word", F.coalesce("n", F.lit(0)).cast("long").alias("n_sentences"), F.col("n").isNull().alias("isolated"))


@C.query(f"""with {SQL_FA}, e as (select model, cue, unnest(words) as w from fat), c0 as (select distinct model, cue from fat where cue is not null),
    pc as (select c0.model, c0.cue, count(distinct e.w) as n from c0 left join e on e.model = c0.model and e.cue = c0.cue group by 1, 2),
    q as (select model, count(*) as n_trials, avg(len(words)) as mw, avg((len(words) = 5)::int::double) * 100 as pf, avg((len(words) = 0)::int::double) * 100 as pe,
          avg(coalesce(list_contains(words, cue), false)::int::double) * 100 as pq from fat group by 1)
    select model, n_trials, {sql_round("mw")} as mean_words, {sql_round("pf")} as pct_full, {sql_round("pe")} as pct_empty, {sql_round("pq")} as pct_cue, v.n as vocabulary, {sql_round("p.n")} as words_per_cue
    from q join (select model, count(distinct w) as n from e group by 1) v using (model) join (select model, avg(n) as n from pc group by 1) p using (model)""")
def fa_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the free-association trials per model."""
    q = quality(free_association_trials(table(spark, d, "fa_raw")))
    return q.select("model", "n_trials", *[r6(F.col(c)).alias(c) for c in ("mean_words", "pct_full", "pct_empty", "pct_cue")], "vocabulary", r6(F.col("words_per_cue")).alias("words_per_cue"))


@C.query(f"""with {SQL_FC}, s as (select model, {sql_clean("input")} as cue, {sql_clean("p1")} as response from fct union all select model, {sql_clean("input")}, {sql_clean("p2")} from fct)
    select model, cue, response, count(*) as cnt from s where cue is not null and response is not null and cue <> response group by 1, 2, 3""")
def stacked_pick_counts(spark: SparkSession, d: str) -> DataFrame:
    """Both pick columns stacked and counted per model, cue and response."""
    from lexiweave.operators.counts import count_pairs

    return count_pairs(stacked_picks(forced_choice_trials(table(spark, d, "fc_raw"))), "model")


@C.query(f"""with {SQL_FC}, n as (select model, count(*) as total, count(*) filter (where p1 is not null and p2 is not null) as ok, count(*) filter (where p1 is not null or p2 is not null) as half_ok from fct group by 1)
    select model, total, ok as compliant, round_even(ok * 100.0::double / total, 1) as compliance_rate, round_even((half_ok - ok) * 100.0::double / nullif(total - ok, 0), 1) as half_rate from n""")
def compliance_rates(spark: SparkSession, d: str) -> DataFrame:
    """Compliant trials per model, and how many of the rest have one valid pick; halves are rounded to even."""
    t = forced_choice_trials(table(spark, d, "fc_raw"))
    some = F.col("pick1").isNotNull() | F.col("pick2").isNotNull()
    n = t.groupBy("model").agg(F.count(F.lit(1)).alias("total"), F.count_if("compliant").alias("compliant"), F.count_if(some).alias("some"))
    return n.select("model", "total", "compliant", F.bround(F.col("compliant") * 100.0 / F.col("total"), 1).alias("compliance_rate"), F.bround(F.try_divide((F.col("some") - F.col("compliant")) * F.lit(100.0), F.col("total") - F.col("compliant")), 1).alias("half_rate"))


@C.query(f"""with {_WIN}, p as (select input, winner1 as c, fc_id * 2 as o from win union all select input, winner2, fc_id * 2 + 1 from win),
    f as (select input, c, min(o) as o from p where c is not null and input is not null and c <> input group by 1, 2),
    l as (select input, string_agg(c, ', ' order by o) as final_candidates, count(*) as final_pool_size from f group by 1) select * from l""")
def final_pools(spark: SparkSession, d: str) -> DataFrame:
    """Winners of each input in the order of their first win."""
    t = winners(forced_choice_trials(table(spark, d, "fc_raw")))
    stacked = t.select("input", F.posexplode(F.array("winner1", "winner2")).alias("w", "c"), "fc_id").where("c is not null and input is not null and c <> input")
    first = stacked.groupBy("input", "c").agg(F.min(F.col("fc_id") * 2 + F.col("w")).alias("o"))
    pools = first.groupBy("input").agg(F.array_sort(F.collect_list(F.struct("o", "c"))).alias("l"))
    return pools.select("input", F.array_join(F.transform("l", lambda s: s["c"]), ", ").alias("final_candidates"), F.size("l").cast("long").alias("final_pool_size"))


@C.query(f"""with {SQL_FC}, n as (select len(cand) as n from fct) select min(n)::bigint as smallest, median(n)::double as middle, max(n)::bigint as largest from n""")
def pool_size_summary(spark: SparkSession, d: str) -> DataFrame:
    """Smallest, median and largest pool."""
    n = forced_choice_trials(table(spark, d, "fc_raw")).select(F.size("candidates").alias("n"))
    return n.agg(F.min("n").cast("long").alias("smallest"), F.percentile("n", 0.5).cast("double").alias("middle"), F.max("n").cast("long").alias("largest"))


#: Cues that meet a word at a time, or whose pools a task makes; parts of cues at most; words of a list that is sent to every task.
BLOCK_CUES, TASK_CUES, MOST_PARTS, MOST_WORDS = 100, 50, 2_000, 1_000_000


@C.query("""select cue, word, row_number() over (partition by cue order by md5('12345|' || cue || '|' || word), word) as place from
    (select distinct v.word as cue, w.word as word from (select distinct lower(word) as word from vocabulary where vocab_rank % 50 = 0 and word is not null) v,
     (select distinct lower(word) as word from vocabulary where word is not null) w where v.word <> w.word)""")
def cue_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """The whole pool of a cue, which is every other word, in the order of the hashes; the cues are the words of every 50th rank.

    Tasks of some 50 cues hash and sort the list of all words for each cue, so that no pair of words is shuffled. Beyond MOST_WORDS words (or 32 MB)
    each word meets each block of cues once, and pools are sorted after a shuffle.
    """
    return _pools(table(spark, d, "vocabulary").where("word is not null").select(F.lower("word").alias("word"), "vocab_rank"), F.col("vocab_rank") % 50 == 0)


def _pools_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = None
    for batch in batches:
        for i in range(batch.num_rows):
            if texts is None:  # the list of words is the same in every row
                texts = sorted(w.encode() for w in batch.column(1)[i].as_py())
                words, shown, at = Words(texts), pa.array([w.decode() for w in texts], pa.string()), {w: k for k, w in enumerate(texts)}
                places = pa.array(np.arange(1, len(texts)), pa.int64())
            for cue in batch.column(0)[i].as_py():
                order = words.order(b"12345|" + cue.encode() + b"|")
                order = order[order != at[cue.encode()]]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(cue, pa.string()), len(order)), shown.take(pa.array(order)), places], names=["cue", "word", "place"])


def _pools(rows: DataFrame, asked: Column, most_words: int = MOST_WORDS) -> DataFrame:
    words = stored(rows.groupBy("word").agg(F.max(asked).alias("asked")), "words")
    if few_words(words.select("word"), most_words):
        blocks = max(1, -(-words.where("asked").count() // TASK_CUES))
        cues = words.where("asked").select("word", F.pmod(F.xxhash64("word"), F.lit(blocks)).alias("block")).repartition(min(blocks, MOST_PARTS), "block")
        lists = cues.groupBy("block").agg(F.collect_list("word").alias("cues"))
        every = F.broadcast(words.agg(F.collect_list("word").alias("words")))  # one row of few_words
        return lists.crossJoin(every).select("cues", "words").mapInArrow(_pools_in_tasks, "cue string, word string, place long")
    cues = dense_index(words.where("asked").select("word"), ["word"]).select(F.col("word").alias("cue"), F.floor((F.col("index") - 1) / BLOCK_CUES).cast("int").alias("block"))
    cues = stored(cues.groupBy("block").agg(F.collect_list("cue").alias("cues")), "cues")
    blocks = cues.count()
    met = words.select("word", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))).alias("block")).join(cues, "block")
    pool = met.select(F.explode("cues").alias("cue"), "word").where("word <> cue")
    w = Window.partitionBy("cue").orderBy(F.md5(F.concat_ws("|", F.lit("12345"), "cue", "word")), "word")
    return pool.select("cue", "word", F.row_number().over(w).cast("long").alias("place"))


@C.query(C.sql["cue_shuffle"].replace("vocab_rank % 50 = 0 and ", ""))
def cue_shuffle_all(spark: SparkSession, d: str) -> DataFrame:
    """For every word all other words in the order of their hashes."""
    return _pools(table(spark, d, "vocabulary").where("word is not null").select(F.lower("word").alias("word"), "vocab_rank"), F.lit(True))


@C.query("select event_type, count(*) as n, round(avg(value), 6) + 0.0 as mean_value from events where event_type in ('click', 'view', 'error') group by 1")
def in_list_filter(spark: SparkSession, d: str) -> DataFrame:
    """rows of the listed types only; the list reaches the scan."""
    e = table(spark, d, "events", "event_type", "value").where(F.col("event_type").isin("click", "view", "error"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_value"))


@C.query(r"""select fa_id, try_cast(regexp_extract(run_file, '_(?:run|probe)0*(\d+)_', 1) as bigint) as run_no, seed from fa_raw
    where lower(coalesce(cue_word, '')) <> 'cue_word' and try_cast(regexp_extract(run_file, '_(?:run|probe)0*(\d+)_', 1) as bigint) is not null and seed is not null""")
def numeric_coercion(spark: SparkSession, d: str) -> DataFrame:
    """numbers out of text, without stray header rows and rows whose keys are no numbers."""
    t = table(spark, d, "fa_raw", "fa_id", "run_file", "cue_word", "seed").where(F.lower(F.coalesce("cue_word", F.lit(""))) != "cue_word")
    run = F.regexp_extract("run_file", r"_(?:run|probe)0*(\d+)_", 1).try_cast("long")
    return t.select("fa_id", run.alias("run_no"), "seed").where("run_no is not null and seed is not null")


@C.query(f"""select word, row_number() over (order by word) as index from (select distinct lower(lemma) as word from vocabulary where lemma is not null) where word in (select {sql_clean("input_word")} from fc_raw)""")
def aligned_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of two sources in text order, numbered from 1."""
    fc = table(spark, d, "fc_raw", "input_word").select(clean(F.col("input_word")).alias("word"))
    v = table(spark, d, "vocabulary", "lemma").where("lemma is not null").select(F.lower("lemma").alias("word")).distinct()
    return dense_index(v.join(fc, "word", "left_semi"), ["word"]).select("word", "index")


@C.query("""select user_id, event_id, place from (select user_id, event_id, row_number() over (partition by user_id order by case when event_id % 10 = 0 then '-inf'::double else value end desc, event_id) as place from events) where place <= 3""")
def nan_last_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three largest values per key, where an undefined value (NaN, here every tenth) counts as the smallest."""
    e = table(spark, d, "events", "user_id", "event_id", "value").withColumn("value", F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    top = first_n_per_key(e, "user_id", 3, F.nanvl("value", F.lit(float("-inf"))).desc(), F.col("event_id").asc())
    return top.select("user_id", "event_id", F.col("place").cast("long").alias("place"))


QUERIES, SQL = C.queries, C.sql
