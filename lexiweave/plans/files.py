"""Queries over file names and paths."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.plans.base import Catalogue
from lexiweave.sources.files import (
    clean_alias, column_key, header_of, job_slice, latest, missing, outside_folders, preferred, read_delimited, resolve, run_name_parts, summary_json, union_by_name, with_path_parts, word_vectors, write_table,
)
from lexiweave.sources.tables import table
from lexiweave.sources.workdir import scratch

C = Catalogue()
_PARTS = r"""p as (select distinct run_file, regexp_extract(run_file, '^(.+?)_(F[AC])_(?:run|round|probe)(\d+)_(\d{8}_\d{6})\.', 1) as alias,
    regexp_extract(run_file, '^(.+?)_(F[AC])_(?:run|round|probe)(\d+)_(\d{8}_\d{6})\.', 3) as run, regexp_extract(run_file, '^(.+?)_(F[AC])_(?:run|round|probe)(\d+)_(\d{8}_\d{6})\.', 4) as stamp from fa_raw where run_file is not null)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "fa_raw", "run_file").where("run_file is not null").distinct()
    parts = run_name_parts(F.col("run_file"))
    return t.select("run_file", *[parts[c].alias(c) for c in ("alias", "run", "stamp")])


@C.query(f"with {_PARTS} select run_file, alias, try_cast(run as int) as run, stamp from p")
def file_name_parse(spark: SparkSession, d: str) -> DataFrame:
    """Alias, run and time stamp out of file names."""
    return _parts(spark, d).select("run_file", "alias", F.col("run").try_cast("int").alias("run"), "stamp")


@C.query(f"with {_PARTS} select alias, run_file, stamp from p where (alias, stamp) in (select (alias, max(stamp)) from p group by alias)")
def latest_file_set(spark: SparkSession, d: str) -> DataFrame:
    """The files of the latest stamp of each model."""
    return latest(_parts(spark, d), ["alias"], "stamp").select("alias", "run_file", "stamp")


@C.query(f"""with {_PARTS} select regexp_replace(regexp_replace(alias || '_' || stamp, '_\\d{{8}}_\\d{{6}}$', ''), '_(?:small|large|old)', '', 'g') as clean, count(*) as n_files from p group by 1""")
def alias_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Aliases without stamps and size words."""
    p = _parts(spark, d)
    return p.groupBy(clean_alias(F.concat_ws("_", "alias", "stamp")).alias("clean")).agg(F.count(F.lit(1)).alias("n_files"))


@C.query()
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Rows per source file and model, with the file's folder and whether its time is known."""
    t = table(spark, d, "fa_raw").select("model_alias", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("time"))
    parts = F.split("path", "/")
    named = t.select("model_alias", F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("folder"), "time")
    return named.groupBy("model_alias", "file", "folder").agg(F.count(F.lit(1)).alias("n"), F.max("time").isNotNull().alias("has_time"))


@C.query("""select '{"model_alias":"' || model_alias || '","n":' || count(*) || '}' as value from fa_raw where model_alias is not null group by model_alias""")
def summary_as_json(spark: SparkSession, d: str) -> DataFrame:
    """A summary as one JSON object per model."""
    return summary_json(table(spark, d, "fa_raw", "model_alias").where("model_alias is not null").groupBy("model_alias").agg(F.count(F.lit(1)).alias("n")))


_VOC = "lemma string, word string, freq bigint, vocab_rank int"


@C.query("select lemma, word, freq, vocab_rank from vocabulary")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary written as CSV files with a header and read again by schema; columns are found by their names."""
    path = scratch(spark, "csv")
    write_table(table(spark, d, "vocabulary").select("lemma", "word", "freq", "vocab_rank"), path, form="csv")
    found = header_of(spark, path)
    back = read_delimited(spark, path, _VOC)
    return back.select(*[resolve(found, name) for name in ("Lemma", "word", "Freq", "vocabrank")])


@C.query("select lemma, freq, vocab_rank from vocabulary where vocab_rank is not null and lemma is not null and freq is not null")
def tsv_columns(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated files of several folders read together, without lines that don't fit, by column keys."""
    path = scratch(spark, "tsv")
    v = table(spark, d, "vocabulary").where("lemma is not null and freq is not null").select("lemma", "freq", "vocab_rank")
    for k in (0, 1):
        v.where(F.pmod("vocab_rank", F.lit(2)) == k).write.option("header", True).option("sep", "\t").csv(f"{path}/part{k}/words.tsv")
    back = read_delimited(spark, [f"{path}/part{k}/words.tsv" for k in (0, 1)], "lemma string, freq bigint, vocab_rank int", drop_malformed=True)
    keys = {column_key(c): c for c in back.columns}
    return back.select(keys["lemma"], keys["freq"], keys["vocabrank"])


@C.query("""select model_alias, round_no, count(*) as n from fc_raw where model_alias is not null and round_no is not null and round_no <> 1 group by 1, 2""")
def partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    """A table written by folders, overwritten and appended to, read back without one of its folders; columns out of the path."""
    path = scratch(spark, "folders")
    t = table(spark, d, "fc_raw", "fc_id", "model_alias", "round_no").where("model_alias is not null and round_no is not null").withColumn("folder", F.concat(F.lit("r"), "round_no"))
    write_table(t.where("round_no <= 2"), path, mode="overwrite", partitions=["folder"])
    write_table(t.where("round_no > 2"), path, mode="append", partitions=["folder"])
    back = outside_folders(spark.read.option("recursiveFileLookup", True).parquet(path), "folder=r1")
    named = with_path_parts(back, "part")
    return named.where(F.col("part") == F.concat(F.lit("folder=r"), "round_no")).groupBy("model_alias", "round_no").agg(F.count(F.lit(1)).alias("n"))


@C.query("""select fa_id as id, model_alias, seed, cast(null as integer) as round_no from fa_raw union all select fc_id, model_alias, null, round_no from fc_raw""")
def union_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources with different columns below one another."""
    fa = table(spark, d, "fa_raw", "fa_id", "model_alias", "seed").withColumnRenamed("fa_id", "id")
    fc = table(spark, d, "fc_raw", "fc_id", "model_alias", "round_no").withColumnRenamed("fc_id", "id")
    return union_by_name([fa, fc]).select("id", "model_alias", "seed", "round_no")


@C.query("""select vec_id, label % 2 = 0 as valid, case when label % 2 = 0 then len(embedding) end::bigint as n, case when label % 2 = 0 then round(embedding[1]::double, 6) + 0.0 end as head from embeddings""")
def vector_file(spark: SparkSession, d: str) -> DataFrame:
    """Vectors from a text file of word and numbers; words without a line are not valid."""
    e = table(spark, d, "embeddings", "vec_id", "label", "embedding").withColumn("word", F.concat(F.lit("w"), "vec_id"))
    path = scratch(spark, "vectors")
    lines = e.where("label % 2 = 0").select(F.concat_ws(" ", "word", F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ")).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    v = word_vectors(spark, path, e.select("word"))
    return v.join(e.select("word", "vec_id"), "word").select("vec_id", "valid", F.when(F.col("valid"), F.size("vec")).cast("long").alias("n"), (F.round(F.get("vec", F.lit(0)), 6) + F.lit(0.0)).alias("head"))


@C.query("""select model_alias, case when bool_or(event = 'ppmi') then 'ppmi' else 'counts' end as weighting from (select model_alias, case when run_idx % 7 = 0 then 'ppmi' else 'counts' end as event from fa_raw where model_alias is not null and run_idx is not null) group by 1""")
def preferred_weighting(spark: SparkSession, d: str) -> DataFrame:
    """Of the weightings a model has results for, PPMI before counts."""
    have = table(spark, d, "fa_raw", "model_alias", "run_idx").where("model_alias is not null and run_idx is not null")
    return preferred(have.select("model_alias", F.when(F.col("run_idx") % 7 == 0, "ppmi").otherwise("counts").alias("weighting")), ["model_alias"])


@C.query("select distinct cue_word from long_df where cue_word is not null and cue_word not in (select cue_word from fa_raw where cue_word is not null)")
def work_to_do(spark: SparkSession, d: str) -> DataFrame:
    """Cues of the long table that no raw trial has."""
    wanted = table(spark, d, "long_df", "cue_word").where("cue_word is not null").distinct()
    return missing(wanted, table(spark, d, "fa_raw", "cue_word").where("cue_word is not null"), ["cue_word"])


@C.query("""with m as (select model_alias, row_number() over (order by model_alias) - 1 as p, count(*) over () as n from (select distinct model_alias from fa_raw where model_alias is not null))
    select model_alias, least(p // greatest(n // 3, 1), 2)::int as slice from m where n >= 3""")
def job_slices(spark: SparkSession, d: str) -> DataFrame:
    """targets dealt to three jobs in contiguous slices; the targets are the models, a short list."""
    models = sorted(r["model_alias"] for r in table(spark, d, "fa_raw", "model_alias").where("model_alias is not null").distinct().collect())
    return spark.createDataFrame([(m, k) for k in range(3) for m in job_slice(models, k, 3)], "model_alias string, slice int")


QUERIES, SQL = C.queries, C.sql
