"""The grammar of packed values, and the table of its values."""

import pytest

import time

from lexiweave.functions.packed import A_LIST, LIST_IF_KNOWN, NO_LIST, folded, list_reading, unpack
from lexiweave.operators.packed_values import packed_items, without_known, words_in_use

CASES = [
    ("output: a, b, c.", ["a", "b", "c"]), ("dog, cat\tfox", ["dog", "cat", "fox"]), ('output: "x, y"; \'z\' | w/v', ["x, y", "z", "w", "v"]), ('"so-called ""expert""", b', ['so-called "expert"', "b"]),
    ("'rock'n'roll', jack-o'-lantern, farmer's market", ["rock'n'roll", "jack-o'-lantern", "farmer's market"]), ("output: 1. a b 2. route 9 3. c", ["a b", "route 9", "c"]),
    ("(1) a\n(2) 7up", ["a", "7up"]), ("- a\n- \"b\"\n- c.", ["a", "b", "c"]), ("[a, b and c]", ["a", "b", "c"]), ("output: a and \"b c\".", ["a", "b c"]), ("x, , y,,", ["x", "y"]),
    ("Sure!\noutput: a; b", ["a", "b"]), ("input: cue.\noutput:\na, b", ["a", "b"]), ("cue: a / b.", ["a", "b"]), ("a · b · c·", ["a", "b", "c"]), ('"open, b', ["open", "b"]), ("", []), (None, []), (" \n", []), ("output: , , ,", []),
]


@pytest.mark.parametrize(("text", "values"), CASES)
def test_values(text, values):
    assert unpack(text, "cue").values == values


def test_malformed_quote_is_flagged_and_long_text_is_read_whole():
    assert unpack('"open, b', "cue").errors == ["unclosed_quote"]
    assert len(unpack(", ".join(["word"] * 20_000)).values) == 20_000


@pytest.mark.parametrize(
    ("text", "asked", "candidates", "kind"),
    [
        ("", 5, None, NO_LIST), ("output: .", 5, None, NO_LIST), ("-", 2, None, NO_LIST), ("cue", 5, None, NO_LIST), ("cue, cue, cue, cue, cue.", 5, None, NO_LIST), ("input: cue.\noutput:", 5, None, NO_LIST),
        ("Take the two that suit cue best of all.", 2, None, NO_LIST), ("candidates: a, b, c, d, e, f", 2, list("abcdef"), NO_LIST), ("I will not say so.", 5, None, NO_LIST),
        ("output: a, b, c", 5, None, NO_LIST), ("Well, for cue the five", 5, None, NO_LIST), ("output: a, b, c.", 5, None, LIST_IF_KNOWN), ("Hard to say.\noutput: a, b", 2, list("ab"), A_LIST),
        ("output: κλειδί, ρολόι", 2, list("ab"), NO_LIST), ("output: bank, sun", 2, ["bank", "sunshine"], NO_LIST), ("output: no, cannot, sorry, refuse, a", 5, None, LIST_IF_KNOWN),
    ],
)
def test_readings(text, asked, candidates, kind):
    assert list_reading(unpack(text, "cue"), "cue", candidates, asked) == kind


@pytest.mark.parametrize("part", ['"a, ', "'x y, ", " and ", "a and ", " ", "(", '"', "\n", "'a' ", '"a\n', "1. ", "(1) x ", "- ", "output: \n", "[a, "])
def test_time_grows_with_the_length_only(part):
    text = "b " + part * (200_000 // len(part)) + " c"
    began = time.process_time()
    unpack(text, "cue")
    assert time.process_time() - began < 3  # under one second on an idle machine; a square would take minutes


def test_folded_keeps_accents():
    assert folded(" Ca-fé! ") == "café"


def _tables(spark, n=20):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    fc = [(i, words[i % 40], ", ".join(words[:8]), f"output: {words[1]}, {words[2]}") for i in range(n)]
    fc += [(100, "q", None, None), (101, "q", "", ""), (102, None, '"a, b"; c', "output: c")]
    fa = [(i, "q", "output: " + ", ".join(words[1:6]) + ".") for i in range(n)] + [(200, None, None), (201, "q", "output: wba, wca")]
    return spark.createDataFrame(fc, "fc_id long, input_word string, candidates string, output string"), spark.createDataFrame(fa, "fa_id long, cue_word string, response string")


def test_items(spark):
    fc, fa = _tables(spark)
    rows = packed_items(fc.selectExpr("*", "1 as items"), fa.selectExpr("*", "2 as defect")).collect()  # extra columns may clash
    at = {(r.field_name, r.rec_id, r.item_pos): r.item_text for r in rows}
    assert at["candidates", 102, 1] == "a, b" and at["candidates", 102, 2] == "c"
    assert at["response", 3, 5] == "wfa" and at["output", 0, 2] == "wca"
    assert not any(k[1] in (100, 101, 200, 201) for k in at) and ("output", 102, 1) not in at
    assert packed_items(fc.limit(0), fa.limit(0)).count() == 0


def test_words_in_use_by_company(spark):
    lists = [(1, "candidates", ["hotel", "river", "stone"]), (2, "response", ["river", "qeva"]), (3, "response", ["hotel", "perro", "gato"]), (4, "response", ["perro", "gato"]), (5, "response", ["perro", "Gato!"]), (6, "output", ["solo"]), (7, "output", [])]
    df = spark.createDataFrame(lists, "row long, field_name string, items array<string>")
    words = words_in_use(df)
    assert {r.word for r in words.collect()} == {"hotel", "river", "stone", "qeva"}
    assert {r.row for r in without_known(df, words).collect()} == {4, 5, 6}
