"""Files of JSON lines whose fields come, go, change their name or their type."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.operators.neighbours_in_order import with_previous
from lexiweave.sources.workdir import stored

def _raw_type(v: str) -> Column:
    t = F.expr(f"schema_of_variant({v})")
    return (
        F.when(t == "BIGINT", "integer").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "decimal").when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when(t.startswith("OBJECT"), "object").otherwise("array")
    )


_LINE = ("row", "job_id", "run_file", "rec_id", "line_no", "readable")


def path_values(lines: DataFrame, keep: Sequence[str] = _LINE) -> DataFrame:
    """The line's columns named in keep (row is a key of the line), path, raw_type, value of every field of every line.

    Readable is a line that is one whole JSON object; null, empty, cut-off and other lines give one row
    without a path, as do objects without fields. raw_type is boolean, integer, decimal, string, array,
    object (one without fields) or null. Nested objects give paths with dots, to any depth. Integers of
    over 38 digits count as decimal. The result is stored: every line is parsed once.
    """
    base = lines.select("job_id", "run_file", "rec_id", "line_no", F.expr("try_parse_json(raw_line)").alias("v"), F.monotonically_increasing_id().alias("row"))
    base = base.withColumn("readable", F.coalesce(F.expr("schema_of_variant(v)").startswith("OBJECT"), F.lit(False)))
    level, path, out = base.withColumn("v", F.when(F.col("readable"), F.col("v"))), F.col("key"), None
    while True:
        # A generator over (key, value) pairs of an object; the variant stays in the JVM.
        opened = level.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
        opened = opened.select(*keep, path.alias("path"), F.col("value").alias("v")).withColumn("raw_type", F.when(F.col("path").isNotNull(), _raw_type("v")))
        nested = F.coalesce((F.col("raw_type") == "object") & (F.expr("cast(v as string)") != "{}"), F.lit(False))
        opened = stored(opened.select(*keep, "path", "raw_type", F.when(~nested, F.expr("cast(v as string)")).alias("value"), F.when(nested, F.col("v")).alias("v"), nested.alias("nested")), "p5-values")
        rows = opened.where("not nested").select(*keep, "path", "raw_type", "value")
        out = rows if out is None else out.unionByName(rows)
        level, path = opened.where("nested").select(*keep, F.col("path").alias("above"), "v"), F.concat("above", F.lit("."), "key")
        if level.isEmpty():
            return out


@dataclass
class Drift:
    """fields: one row per file and path, with raw_type (null if it has nulls only) and role. files: every file with the one before it. strings: the different telling strings of every file and path."""

    fields: DataFrame
    files: DataFrame
    strings: DataFrame


#: Strings that say what a path holds are looked at by their separators: an answer is a list.
_LISTED = r"[^,;|/\n]+[,;|/\n]+[^,;|/\n]+[,;|/\n]"


#: Strings that are numbers or truth values tell of no thing by themselves.
_TELLING = "raw_type = 'string' and try_cast(value as double) is null and lower(value) not in ('true', 'false')"


def file_statistics(lines: DataFrame, values: DataFrame | None = None) -> Drift:
    """Types and meaning of every path in every file.

    role says what a path holds, from its values. A number that is the same in all lines of a file
    holds `constant:d`, where d is its distance from the run number in the file's name: 0 for the run
    number itself, the base seed for a seed. Strings that are mostly lists hold the answer. Other
    strings hold the cue if they mostly differ from line to line: over two thirds of the values of a
    file are different ones, over all files of two and more lines together (where there are only files
    of one line: over all values). All counts are exact, and the rules are shares, so a small job is read like a
    large one. A path takes its role in the file, else the role it has most often in all files; flags
    and labels have none.
    """
    values = path_values(lines, ("job_id", "run_file")) if values is None else values
    values = values.where("path is not null")
    number = F.expr("try_cast(value as double)")
    run = F.expr("try_cast(regexp_extract(run_file, '_run_?0*([0-9]+)', 1) as double)")
    by_type = values.groupBy("job_id", "run_file", "path", "raw_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(number).alias("n_number"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.count_if(F.col("value").rlike(_LISTED)).alias("n_list"),
    )
    typed = F.col("raw_type") != "null"
    fields = by_type.groupBy("job_id", "run_file", "path").agg(
        F.max(F.when(typed, F.struct("n", "raw_type"))).getField("raw_type").alias("raw_type"),
        F.sum(F.when(typed, F.col("n")).otherwise(0)).alias("n"), F.sum("n_number").alias("n_number"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n_list").alias("n_list"),
    )
    distance = (F.col("low") - run).cast("long").cast("string")
    steady = (F.col("n") > 0) & (F.col("n_number") == F.col("n")) & (F.col("low") == F.col("high")) & ~F.col("raw_type").isin("boolean") & run.isNotNull()
    fields = stored(fields.withColumn("held", F.when(steady, F.concat(F.lit("constant:"), distance))), "p5-fields")

    each = stored(values.where(_TELLING).groupBy("job_id", "run_file", "path", "value").agg(F.count(F.lit(1)).alias("n")), "p5-strings")
    per_file = each.groupBy("job_id", "run_file", "path").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.sum(F.when(F.col("value").rlike(_LISTED), F.col("n")).otherwise(0)).alias("lists"), F.min("value").alias("only"))
    many = F.col("n") > 1
    strings = per_file.groupBy("path").agg(
        F.sum("n").alias("n"), F.sum("lists").alias("lists"), F.sum(F.when(many, F.col("n"))).alias("n_many"), F.sum(F.when(many, F.col("kinds"))).alias("kinds_many"),
        F.count_distinct("only").alias("kinds"),
    )
    differ = F.coalesce(F.col("kinds_many") * 3 > F.col("n_many") * 2, (F.col("n") > 1) & (F.col("kinds") * 3 > F.col("n") * 2))
    texts = strings.select("path", F.when(F.col("lists") * 2 > F.col("n"), "answer").when(differ, "cue").alias("text_role"))
    # A distance that holds in most files where the path has a number is no accident.
    held = fields.where("n_number > 0").groupBy("path", "held").agg(F.count(F.lit(1)).alias("n_files"))
    most = held.groupBy("path").agg(F.max_by("held", F.struct(F.col("n_files"), F.coalesce("held", F.lit("")))).alias("usual"), F.max("n_files").alias("top"), F.sum("n_files").alias("all"))
    usual = most.where("usual is not null and top * 2 > all").select("path", "usual")
    roles = fields.join(texts, "path", "left").join(usual, "path", "left")
    fields = roles.select("job_id", "run_file", "path", "raw_type", F.coalesce("text_role", "usual").alias("role"))

    listed = stored(lines.groupBy("job_id", "run_file").agg(F.min("written_at").alias("written_at")), "p5-files")
    files = with_previous(listed, "job_id", ["written_at", "run_file"], "run_file", "before", rows=listed.count())
    return Drift(stored(fields, "p5-roles"), files, each)


def changes(lines: DataFrame) -> DataFrame:
    """run_file, change_kind, old_field, new_field: what changed in each file against the one written just before it in its job.

    added (old_field ''), removed (new_field ''), renamed or retyped (both names equal). A field that goes
    and one that comes are one renamed field if they have the same role, or, where neither has one, if
    they hold the same strings: at least half of the different ones of either. Paths with nulls only have
    no type, so they are never retyped. The first file of a job has no changes; one without readable
    lines loses all its fields.
    """
    drift = file_statistics(lines, path_values(lines, ("job_id", "run_file")))
    fields = drift.fields
    pairs = drift.files.where("before is not null").select("job_id", "run_file", "before")
    new = pairs.join(fields, ["job_id", "run_file"]).select("job_id", "run_file", "path", F.col("raw_type").alias("new_type"), F.col("role").alias("new_role"))
    old = pairs.join(fields.withColumnRenamed("run_file", "before"), ["job_id", "before"]).select("job_id", "run_file", "before", "path", F.col("raw_type").alias("old_type"), F.col("role").alias("old_role"))
    both = old.withColumn("was", F.lit(True)).join(new.withColumn("is", F.lit(True)), ["job_id", "run_file", "path"], "full")
    both = stored(both.where("was is null or is is null or old_type <> new_type"), "p5-changed")
    retyped = both.where("was and is").select("run_file", F.lit("retyped").alias("change_kind"), F.col("path").alias("old_field"), F.col("path").alias("new_field"))
    gone = both.where("is is null").select("job_id", "run_file", "before", F.col("path").alias("old_field"), F.col("old_role").alias("role"))
    come = both.where("was is null").select("job_id", "run_file", F.col("path").alias("new_field"), F.col("new_role").alias("role"))
    same = _same_strings(drift.strings, gone.where("role is null").drop("role"), come.where("role is null").drop("role"))
    gone = gone.join(same.select("job_id", "run_file", "old_field", "twin"), ["job_id", "run_file", "old_field"], "left")
    come = come.join(same.select("job_id", "run_file", "new_field", "twin"), ["job_id", "run_file", "new_field"], "left")
    gone = gone.select("job_id", "run_file", "old_field", F.coalesce("role", "twin", F.concat(F.lit("gone "), "old_field")).alias("role"))
    come = come.select("job_id", "run_file", "new_field", F.coalesce("role", "twin", F.concat(F.lit("come "), "new_field")).alias("role"))
    moved = gone.join(come, ["job_id", "run_file", "role"], "full").select(
        "run_file", F.when(F.col("old_field").isNull(), "added").when(F.col("new_field").isNull(), "removed").otherwise("renamed").alias("change_kind"),
        F.coalesce("old_field", F.lit("")).alias("old_field"), F.coalesce("new_field", F.lit("")).alias("new_field"),
    )
    return moved.unionByName(retyped)


def _same_strings(strings: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """job_id, run_file, old_field, new_field, twin (a name of the pair) of fields without a role that hold the same strings before and after; each field is in one pair at most."""
    held = strings.select("job_id", "run_file", "path", "value")
    before = gone.join(held.withColumnsRenamed({"run_file": "before", "path": "old_field"}), ["job_id", "before", "old_field"])
    after = come.join(held.withColumnRenamed("path", "new_field"), ["job_id", "run_file", "new_field"])
    file = ["job_id", "run_file"]
    met = before.join(after, [*file, "value"]).groupBy(*file, "old_field", "new_field").agg(F.count(F.lit(1)).alias("shared"))
    n_old, n_new = before.groupBy(*file, "old_field").agg(F.count(F.lit(1)).alias("n_old")), after.groupBy(*file, "new_field").agg(F.count(F.lit(1)).alias("n_new"))
    close = met.join(n_old, [*file, "old_field"]).join(n_new, [*file, "new_field"]).where("2 * shared >= n_old and 2 * shared >= n_new")
    best = F.struct("shared", "old_field", "new_field")
    for side in ("old_field", "new_field"):  # a file has few fields, so its pairs of fields are few
        close = close.join(close.groupBy(*file, side).agg(F.max(best).alias("best")), [*file, side]).where(best == F.col("best")).drop("best")
    return stored(close.withColumn("twin", F.concat(F.lit("same "), "old_field")), "p5-twins")


_SPARK_TYPES = {"integer": "bigint", "decimal": "double", "boolean": "boolean", "string": "string"}


def one_table(lines: DataFrame) -> DataFrame:
    """rec_id, run_file, line_no, readable, one typed column per field, and failed_casts.

    Typed columns are projected from the path-value rows. Names of one role become one column under the
    name that most files use; its type is the one that most files give it. A value that can't be cast is
    null, and its column is named in failed_casts (names in text order, joined by commas; '' if all is
    well), also if another name of the column in the same line holds a good value; of several good ones
    that of the first name in text order counts. Unreadable lines keep their row. Columns are as many as
    there are fields, so their list is small whatever the data.
    """
    values = path_values(lines)
    fields = file_statistics(lines, values).fields
    per = fields.groupBy("path", "role", "raw_type").agg(F.count(F.lit(1)).alias("n")).collect()
    groups: dict[str, dict] = {}
    for r in per:
        g = groups.setdefault(r["role"] or f"path {r['path']}", {"names": {}, "types": {}})
        g["names"][r["path"]] = g["names"].get(r["path"], 0) + r["n"]
        if r["raw_type"] is not None:
            g["types"][r["raw_type"]] = g["types"].get(r["raw_type"], 0) + r["n"]
    top = lambda d: min(d, key=lambda k: (-d[k], k)) if d else "string"
    held = values.where("raw_type is null or raw_type <> 'null'")
    columns, failed = [], []
    for g in sorted(groups.values(), key=lambda g: top(g["names"])):
        name, kind = top(g["names"]), _SPARK_TYPES.get(top(g["types"]), "string")
        own = F.col("path").isin(*sorted(g["names"]))
        cast = F.col("value").try_cast(kind)
        if kind == "bigint":  # a decimal text such as 7.0 is no failure, 7.5 is
            whole = F.col("value").try_cast("double")
            cast = F.coalesce(F.when(F.col("value").rlike(r"^\s*[+-]?\d+\s*$"), cast), F.when(whole == F.floor(whole), whole.cast("bigint")))
        columns.append(F.min_by(F.when(own, cast), F.when(own & cast.isNotNull(), F.col("path"))).alias(name))
        failed.append(F.when(F.count_if(own & F.col("value").isNotNull() & cast.isNull()) > 0, F.lit(name)))
    report = F.array_join(F.array_sort(F.array_compact(F.array(*failed))), ",") if failed else F.lit("")
    # A line of nulls only has no row left above.
    rows = held.unionByName(values.where("raw_type = 'null'").select(*_LINE).distinct(), allowMissingColumns=True)
    return rows.groupBy("row", "rec_id", "run_file", "line_no", "readable").agg(*columns, report.alias("failed_casts")).drop("row")
