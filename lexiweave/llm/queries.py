"""Registered queries of the training-data problems, and SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm.bpe_transducer import decode_documents, encode_documents
from lexiweave.llm.broken_pairs import broken_pairs
from lexiweave.llm.cooccurrence import association_pairs
from lexiweave.llm.eval_leakage import leaked, passages, without_leaks
from lexiweave.llm.format_dedup import copies, records_with_copies
from lexiweave.llm.personal_data import masked, personal_data
from lexiweave.llm.term_counts import association_counts, marked_terms
from lexiweave.llm.top_n import top_associations
from lexiweave.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_associations(table(spark, folder, "long_df"))


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    return association_counts(table(spark, folder, "long_df"))[0]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return marked_terms(table(spark, folder, "long_df")).where("mark <> 'useful'").select("term", "mark")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return association_pairs(table(spark, folder, "long_df")).select("assoc_a", "assoc_b")


def p3_lift(spark: SparkSession, folder: str) -> DataFrame:
    pairs = association_pairs(table(spark, folder, "long_df"))
    return pairs.withColumn("lift", F.round("lift", 4))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies(table(spark, folder, "long_df"))


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    return records_with_copies(table(spark, folder, "long_df"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return broken_pairs(*(table(spark, folder, t) for t in ("fc_raw", "fa_raw", "documents")))


#: The public vocabulary byte_bpe_50k.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"), VOCABULARY)


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text after encoding and streaming decode; a null text comes back empty."""
    return decode_documents(p8_ids(spark, folder), VOCABULARY)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    return without_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))


def p10_masked(spark: SparkSession, folder: str) -> DataFrame:
    return masked(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_terms, p2_found, p3_found, p3_lift, p4_found, p4_records, p6_found, p8_ids, p8_roundtrip, p9_found, p9_passages, p9_clean, p10_found, p10_masked)
}

_ROWS = r"""
rows_ as (select * from (
  select lower(regexp_replace(cue_word, '[^\p{L}\p{N}]+', '', 'g')) as cue, lower(regexp_replace(association, '[^\p{L}\p{N}]+', '', 'g')) as assoc,
         coalesce(run_file, '') as run_file, row_id, assoc_pos from long_df)
  where cue not in ('', 'na', 'nan') and assoc not in ('', 'na', 'nan'))"""
_TERMS = f"""with {_ROWS},
trials as (select count(*) as n_all from (select distinct run_file, cue from rows_)),
terms as (select assoc as term, count(*) as n_rows, count(distinct (run_file, cue)) as n_records from rows_ group by 1)"""
_PAIRS = f"""with {_ROWS},
post as (select distinct run_file, cue, assoc from rows_),
trials as (select count(*) as n_all from (select distinct run_file, cue from post)),
cnt as (select assoc, count(*) as na from post group by 1),
prs as (select x.assoc as assoc_a, y.assoc as assoc_b, count(*) as n from post x join post y
        on x.run_file = y.run_file and x.cue = y.cue and x.assoc < y.assoc group by 1, 2 having count(*) >= 5),
res as (select assoc_a, assoc_b, n, a.na as na, b.na as nb, n_all as n_records, round(n * n_all::double / (a.na::double * b.na), 4) as lift
        from prs join cnt a on a.assoc = assoc_a join cnt b on b.assoc = assoc_b cross join trials where n * n_all >= 6 * a.na * b.na)"""
_MARKUP = (
    r"<!--.*?-->|</?[a-zA-Z][^<>]*>|&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"
    r"|\[/?(?:b|i|u|s|q|url|img|quote|color|size|list|code|center|font|spoiler|\*)(?:=[^\[\]]*)?\]"
)
#: Ten words in a row of every document and item, and where both have them.
_TENS = f"""dw as (select doc_id, regexp_extract_all(lower(regexp_replace(text, '{_MARKUP}', ' ', 'gis')), '[\\p{{L}}\\p{{N}}]+') as w from documents where doc_id is not null and text is not null),
iw as (select item_id, regexp_extract_all(lower(regexp_replace(item_text, '{_MARKUP}', ' ', 'gis')), '[\\p{{L}}\\p{{N}}]+') as w from eval_items where item_id is not null and item_text is not null),
dg as (select doc_id, p, array_to_string(w[p:p + 9], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 9)) as p from dw)),
ig as (select item_id, p, array_to_string(w[p:p + 9], ' ') as g from (select item_id, w, unnest(generate_series(1, len(w) - 9)) as p from iw)),
hit as (select doc_id, item_id, dg.p - 1 as dp, ig.p - 1 as ip from dg join ig using (g))"""
_KEY = "run_file, assoc_pos, least(cue, assoc), greatest(cue, assoc)"

SQL: dict[str, str] = {
    "p1_found": f"""with {_ROWS},
        c as (select cue, assoc, count(distinct run_file) as runs from rows_ group by 1, 2),
        r as (select cue, assoc, row_number() over (partition by cue order by runs desc, assoc) as place from c)
        select cue, cast(place as integer) as place, assoc from r where place <= 3""",
    "p2_terms": f"{_TERMS} select term, n_rows, n_records from terms",
    "p2_found": f"""{_TERMS} select term, case when n_records < 3 then 'rare' else 'common' end as mark
        from terms cross join trials where n_records < 3 or n_records * 100 > n_all""",
    "p3_found": f"{_PAIRS} select assoc_a, assoc_b from res",
    "p3_lift": f"{_PAIRS} select assoc_a, assoc_b, n, na, nb, n_records, lift from res",
    "p4_found": f"""with {_ROWS}, f as (select row_id, min(row_id) over (partition by {_KEY}) as first_id from rows_)
        select first_id, row_id from f where row_id <> first_id""",
    "p9_found": f"with {_TENS} select distinct doc_id, item_id from hit",
    "p9_clean": f"with {_TENS} select doc_id, text from documents where doc_id is null or doc_id not in (select doc_id from hit)",
    "p9_passages": f"""with {_TENS}, run as (select *, dp - row_number() over (partition by doc_id, item_id, dp - ip order by dp) as r from hit)
        select doc_id, item_id, min(ip) as item_word, min(dp) as doc_word, count(*) + 9 as n_words from run group by doc_id, item_id, dp - ip, r""",
    "p8_roundtrip": "select doc_id, coalesce(text, '') as text from documents",
    "p4_records": f"with {_ROWS} select min(row_id) as first_id, count(*) as n_copies from rows_ group by {_KEY}",
}
