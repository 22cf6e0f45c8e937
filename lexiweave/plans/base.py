"""How a query is registered, and the SQL fragments that several of them share."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiweave.functions.rules import WS

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_clean(x: str) -> str:
    s = f"lower({sql_strip(x)})"
    return f"(case when {s} not in ('', 'na', 'nan') and regexp_matches({s}, '[\\p{{L}}\\p{{N}}]') then {s} end)"


def sql_split(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda p: {sql_strip('p')}), lambda p: p <> '')"


def sql_round(x: str, digits: int = 6) -> str:
    """A double that both engines print alike; no negative zero."""
    return f"(round(({x})::double, {digits}) + 0.0)"


#: Forced-choice trials with extracted words (e1, e2) and valid picks (p1, p2).
SQL_FC = f"""
fc0 as (select fc_id, model_alias as model, trial_id, round_no, input_word as input, {sql_split("candidates")} as cand,
        {sql_strip("output")} as txt, {sql_strip("input_word")} as inp from fc_raw),
fc1 as (select *, case when coalesce(inp, '') <> '' then regexp_replace(txt, '(?i)^{WS}*\\Q' || inp || '\\E{WS}*:{WS}*', 'output: ') else txt end as led from fc0),
fc2 as (select *, regexp_extract_all(led, '(?i)output:{WS}*([A-Za-z]+){WS}*,{WS}*([A-Za-z]+)')[-1] as m,
        list_filter(list_transform(string_split(led, chr(10)), lambda l: {sql_strip("l")}),
                    lambda l: contains(l, ',') and not contains(l, ':') and len({sql_split("l")}) >= 2)[-1] as ln from fc1),
fc3 as (select *, {sql_split("ln")} as parts from fc2),
fc4 as (select *, case when m is not null then regexp_extract(m, '(?i)output:{WS}*([A-Za-z]+){WS}*,{WS}*([A-Za-z]+)', 1) when ln is not null then parts[1] end as e1,
        case when m is not null then regexp_extract(m, '(?i)output:{WS}*([A-Za-z]+){WS}*,{WS}*([A-Za-z]+)', 2) when ln is not null then parts[2] end as e2 from fc3),
fc5 as (select *, case when list_contains(cand, e1) and e1 is distinct from input then e1 end as p1,
        case when list_contains(cand, e2) and e2 is distinct from input then e2 end as v2 from fc4),
fct as (select *, case when p1 is null or p1 <> v2 then v2 end as p2 from fc5)"""

#: Free-association trials with their words, and the long table's cleaned cue and response.
SQL_FA = f"""
fat as (select fa_id, model_alias as model, run_file, lower(cue_word) as cue,
        case when response is null then [] else list_filter(list_transform(string_split(regexp_replace(
          case when regexp_matches(response, '(?i)output{WS}*:') then {sql_strip(f"regexp_extract(response, '(?is)output{WS}*:(.*?)(?:[.]|' || chr(10) || '|$)', 1)")}
               else coalesce(list_filter(list_transform(string_split(response, chr(10)), lambda l: {sql_strip("l")}), lambda l: l <> '')[1], '') end,
          '[.]+$', ''), ','), lambda w: regexp_replace(lower({sql_strip("w")}), '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g')), lambda w: w <> '')[1:5] end as words
        from fa_raw)"""
SQL_LONG = f"""
lng as (select model_alias as model, {sql_clean("cue_word")} as cue, {sql_clean("association")} as response, row_id, run_file, assoc_pos from long_df)"""
SQL_COUNTS = f"""{SQL_LONG},
cnt as (select cue, response, count(*) as cnt from lng where cue is not null and response is not null and cue <> response group by 1, 2)"""
SQL_PPMI = """
rs as (select cue, sum(cnt) as row_sum from cnt group by 1), cs as (select response, sum(cnt) as col_sum from cnt group by 1), tt as (select sum(cnt) as total from cnt),
pp as (select cue, response, cnt, row_sum, col_sum, total, greatest(ln(cnt::double * total / (row_sum::double * col_sum)), 0.0) as ppmi
       from cnt join rs using (cue) join cs using (response) cross join tt)"""
