import datetime as dt
import json

import pytest

from lexiweave.operators.neighbours_in_order import with_previous
from lexiweave.operators.schema_drift import changes, one_table

SCHEMA = "rec_id long, job_id long, run_file string, written_at timestamp, line_no int, raw_line string, value string"


def _lines(spark, files):
    rows, rec = [], 0
    for job, n, lines in files:
        for k, x in enumerate(lines):
            rec += 1
            rows.append((rec, job, f"m_FA_job{job}_run0000{n}.jsonl", dt.datetime(2025, 1, n), k, x if isinstance(x, str) or x is None else json.dumps(x), "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def _file(n, cue="cue_word", run="run_idx", seed="seed", made=str, **more):
    return [{run: n, seed: 12345 + n, cue: f"word{n}{chr(97 + k)}", "response": "output: a, b, c, d.", **more} for k in range(8)]


def test_changes(spark):
    files = [
        (1, 1, [*_file(1), '{"cut', "", None]), (1, 2, _file(2, cue="stimulus")), (1, 3, _file(3, cue="stimulus", note="x")), (1, 4, _file(4, cue="stimulus", run="run_no", score=1)),
        (1, 5, _file(5, cue="stimulus", run="run_no", score=1.0)), (1, 6, ["{broken", None]), (2, 1, _file(1, note=None)), (2, 2, _file(2, note="y", extra={"a": 1, "b": [1]})), (3, 7, _file(7)),
    ]
    got = {(r.run_file[4:].split(".")[0], r.change_kind, r.old_field, r.new_field) for r in changes(_lines(spark, files)).collect()}
    f = lambda j, n: f"_job{j}_run0000{n}"
    want = {
        (f(1, 2), "renamed", "cue_word", "stimulus"), (f(1, 3), "added", "", "note"), (f(1, 4), "removed", "note", ""), (f(1, 4), "renamed", "run_idx", "run_no"), (f(1, 4), "added", "", "score"),
        (f(1, 5), "retyped", "score", "score"), *((f(1, 6), "removed", c, "") for c in ("stimulus", "run_no", "seed", "response", "score")), (f(2, 2), "added", "", "extra.a"), (f(2, 2), "added", "", "extra.b"),
    }
    assert {(k[0][k[0].index("_job") :], *k[1:]) for k in got} == want


def test_one_table_and_empty(spark):
    lines = _lines(spark, [(1, 1, _file(1)), (1, 2, _file(2, cue="stimulus")), (1, 3, [{"run_idx": "3", "seed": "x", "cue_word": "c", "response": None}, "{"])])
    t = one_table(lines)
    rows = {r.rec_id: r for r in t.collect()}
    assert len(rows) == 18 and rows[9].cue_word == "word2a" and rows[17].run_idx == 3 and rows[17].seed is None and rows[17].failed_casts == "seed" and not rows[18].readable
    assert changes(lines.limit(0)).count() == 0 and one_table(lines.limit(0)).count() == 0


def test_with_previous_over_many_partitions(spark):
    df = spark.createDataFrame([(g, i, f"{g}-{i}") for g in "ab" for i in range(500)], "g string, i int, v string")
    got = with_previous(df, "g", ["i"], "v", "before", rows=1000, range_rows=37).collect()
    assert len(got) == 1000 and all(r.before == (f"{r.g}-{r.i - 1}" if r.i else None) for r in got)


@pytest.mark.parametrize("kinds", [1, 2, 6, 7])
def test_renames_with_few_different_values(spark, kinds):
    lines = [{"run_idx": 1, "cue_word": f"c{k % kinds}", "tag": "x"} for k in range(12)]
    moved = [{"run_idx": 2, "stimulus": f"c{k % kinds}", "tag": "x"} for k in range(12)]
    other = [{"run_idx": 3, "stimulus": f"c{k % kinds}", "label": "yz"} for k in range(12)]
    got = {tuple(r)[1:] for r in changes(_lines(spark, [(1, 1, lines), (1, 2, moved), (1, 3, other)])).collect()}
    assert got == {("renamed", "cue_word", "stimulus"), ("removed", "tag", ""), ("added", "", "label")}


def test_any_depth_and_two_names_in_one_line(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}
    got = {tuple(r)[1:] for r in changes(_lines(spark, [(1, 1, [{"x": 1}]), (1, 2, [{"x": 1, **deep}, {}])])).collect()}
    assert got == {("added", "", "a.b.c.d.e.f")}
    files = [(1, n, _file(n)) for n in range(1, 5)] + [(1, 5, [*_file(5, run="run_no"), {"run_idx": "bad", "run_no": 5}])]
    t = one_table(_lines(spark, files))
    row = t.where("rec_id = 41").first()
    assert t.count() == 41 and row.run_idx == 5 and row.failed_casts == "run_idx"
