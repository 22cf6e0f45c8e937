"""Queries of problems 5 and 7."""

from pyspark.sql import DataFrame, SparkSession

from lexiweave.operators.packed_values import packed_items
from lexiweave.operators.schema_drift import changes, one_table
from lexiweave.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return changes(table(spark, folder, "fa_files"))


def p5_table(spark: SparkSession, folder: str) -> DataFrame:
    return one_table(table(spark, folder, "fa_files"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return packed_items(table(spark, folder, "fc_raw"), table(spark, folder, "fa_raw"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _items(spark, folder).drop("n_errors")


def p7_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are not written cleanly: empty slots, unclosed quotes or brackets."""
    return _items(spark, folder).where("n_errors > 0").select("field_name", "rec_id", "n_errors").distinct()


QUERIES = {f.__name__: f for f in (p5_found, p5_table, p7_found, p7_errors)}

_FIELDS = r"""
ok as (select job_id, run_file, raw_line, json_keys(raw_line) as ks from (select * from fa_files where json_valid(raw_line)) where json_type(raw_line) = 'OBJECT' and len(list_distinct(json_keys(raw_line))) = len(json_keys(raw_line))),
kv as (select job_id, run_file, k as path, json_type(raw_line, '$."' || k || '"') as jt, raw_line ->> ('$."' || k || '"') as v from (select *, unnest(ks) as k from ok)),
ty as (select *, case jt when 'BIGINT' then 'integer' when 'UBIGINT' then 'integer' when 'DOUBLE' then 'decimal' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' end as t, try_cast(v as double) as x from kv),
bt as (select job_id, run_file, path, t, count(*) as n, count(x) as nx, min(x) as low, max(x) as high from ty group by all),
f0 as (select job_id, run_file, path, arg_max(t, (n, t)) filter (where t is not null) as raw_type, sum(case when t is not null then n else 0 end) as n, sum(nx) as nx, min(low) as low, max(high) as high,
       try_cast(nullif(regexp_extract(run_file, '_run_?0*([0-9]+)', 1), '') as double) as run from bt group by job_id, run_file, path),
f1 as (select *, case when n > 0 and nx = n and low = high and raw_type <> 'boolean' and run is not null then 'constant:' || cast(trunc(low - run) as bigint) end as held from f0),
es as (select job_id, run_file, path, v, count(*) as n from ty where t = 'string' and x is null and lower(v) not in ('true', 'false') group by all),
pf as (select job_id, run_file, path, sum(n) as n, count(*) as kinds, sum(case when regexp_matches(v, '[^,;|/\n]+[,;|/\n]+[^,;|/\n]+[,;|/\n]') then n else 0 end) as lists, min(v) as one from es group by all),
ps as (select path, sum(n) as n, sum(lists) as lists, sum(case when n > 1 then n end) as nm, sum(case when n > 1 then kinds end) as km, count(distinct one) as kinds from pf group by path),
tr as (select path, case when lists * 2 > n then 'answer' when coalesce(km * 3 > nm * 2, n > 1 and kinds * 3 > n * 2) then 'cue' end as text_role from ps),
us as (select path, usual from (select path, arg_max(coalesce(held, ''), (n, coalesce(held, ''))) as usual, max(n) as top, sum(n) as al from (select path, held, count(*) as n from f1 where nx > 0 group by all) group by path) where usual <> '' and top * 2 > al),
fr as (select job_id, run_file, path, raw_type, coalesce(text_role, usual) as role from f1 left join tr using (path) left join us using (path)),
pr as (select job_id, run_file, before from (select job_id, run_file, lag(run_file) over (partition by job_id order by w, run_file) as before from (select job_id, run_file, min(written_at) as w from fa_files group by all)) where before is not null),
nw as (select pr.job_id, pr.run_file, pr.before, path, raw_type, role from pr join fr on fr.job_id = pr.job_id and fr.run_file = pr.run_file),
od as (select pr.job_id, pr.run_file, pr.before, path, raw_type, role from pr join fr on fr.job_id = pr.job_id and fr.run_file = pr.before),
gone as (select * from od anti join nw using (job_id, run_file, path)), come as (select * from nw anti join od using (job_id, run_file, path)),
gs as (select g.job_id, g.run_file, g.path as old_field, v from gone g join es on es.job_id = g.job_id and es.run_file = g.before and es.path = g.path where role is null),
cs as (select c.job_id, c.run_file, c.path as new_field, v from come c join es on es.job_id = c.job_id and es.run_file = c.run_file and es.path = c.path where role is null),
cl as (select m.* from (select job_id, run_file, old_field, new_field, count(*) as shared from gs join cs using (job_id, run_file, v) group by all) m
       join (select job_id, run_file, old_field, count(*) as no from gs group by all) using (job_id, run_file, old_field) join (select job_id, run_file, new_field, count(*) as nn from cs group by all) using (job_id, run_file, new_field)
       where 2 * shared >= no and 2 * shared >= nn),
c1 as (select * from cl qualify row_number() over (partition by job_id, run_file, old_field order by shared desc, old_field desc, new_field desc) = 1),
tw as (select * from c1 qualify row_number() over (partition by job_id, run_file, new_field order by shared desc, old_field desc, new_field desc) = 1),
g2 as (select g.job_id, g.run_file, g.path as old_field, coalesce(role, 'same ' || tw.old_field, 'gone ' || g.path) as role from gone g left join tw on tw.job_id = g.job_id and tw.run_file = g.run_file and tw.old_field = g.path),
c2 as (select c.job_id, c.run_file, c.path as new_field, coalesce(role, 'same ' || tw.old_field, 'come ' || c.path) as role from come c left join tw on tw.job_id = c.job_id and tw.run_file = c.run_file and tw.new_field = c.path)"""

SQL = {
    "p5_found": f"""with {_FIELDS} select run_file, case when old_field is null then 'added' when new_field is null then 'removed' else 'renamed' end as change_kind,
        coalesce(old_field, '') as old_field, coalesce(new_field, '') as new_field from g2 full join c2 using (job_id, run_file, role)
        union all select od.run_file, 'retyped', path, path from od join nw using (job_id, run_file, path) where od.raw_type <> nw.raw_type""",
}
