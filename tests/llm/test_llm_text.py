"""Problems 6 and 8 to 10."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiweave.llm.bpe_transducer import Encoder, Utf8Stream, decode, decode_documents, encode_documents, read_ranks
from lexiweave.llm.broken_pairs import broken_pairs
from lexiweave.llm.eval_leakage import leaked, passages, suffix_array, without_leaks, words
from lexiweave.llm.linear import best_cut, fit_calibrated, platt, train
from lexiweave.llm.word_map import known_words
from lexiweave.llm.personal_data import find_spans, masked, personal_data, reliabilities

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_ranks(RANKS))


@needs_ranks
def test_encoding_equals_the_public_tokenizer(encoder):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    public.encode_special_tokens = True
    rng = random.Random(1)
    pool = "aeiou tnrsl\n  \t'0123héñ日本😀́ABC.,!?-_/\\<|endoftext|>‍\r"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["<|endoftext|>", " " * 99, "a" * 5000, "\n\n\n x", "don't we'll I'VE", "=" * 999, "0" * 999, "ab" * 700, "word " * 20_000]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == public.encode(t, add_special_tokens=False).ids
        assert "".join(decode(ids, encoder.fst.bytes_of)) == t
    assert encoder.encode("") == encoder.encode(None) == []


@needs_ranks
def test_tables_of_states_start_anew(monkeypatch):
    import lexiweave.llm.bpe_transducer as bt

    monkeypatch.setattr(bt, "MOST_STATES", 50)
    monkeypatch.setattr(bt, "MOST_PARTS", 5)
    small, text = Encoder(read_ranks(RANKS)), "An unbelievably long sentence, antidisestablishmentarianism included; 12345 times. " * 5
    whole = Encoder(read_ranks(RANKS))
    assert small.encode(text) == whole.encode(text)


def test_utf8_stream_against_python():
    rng = random.Random(3)
    for _ in range(1500):
        x = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0]) for _ in range(rng.randint(0, 12)))
        s = Utf8Stream()
        assert "".join(s.feed(x[i : i + 2]) for i in range(0, len(x), 2)) + s.feed(b"", final=True) == x.decode("utf-8", "replace")


@needs_ranks
def test_documents(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, "", 5), (3, None, 5), (4, "x" * 30_000, 5)], "doc_id long, text string, ids int")
    ids = {r.doc_id: r.ids for r in encode_documents(df, RANKS).collect()}
    assert ids[2] == ids[3] == [] and ids[1] == [15496, 995]
    assert {r.doc_id: r.text for r in decode_documents(encode_documents(df, RANKS), RANKS).collect()} == {1: "Hello world", 2: "", 3: "", 4: "x" * 30_000}
    assert encode_documents(df.limit(0), RANKS).count() == 0


# ---- leakage


def brute(docs, items, least):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
    return out


@pytest.mark.parametrize("shard", [30, 400_000])
def test_leaks_against_brute_force(spark, shard, monkeypatch):
    import lexiweave.llm.eval_leakage as el

    monkeypatch.setattr(el, "SHARD_WORDS", shard)
    monkeypatch.setattr(el._shard_matches, "__defaults__", (7 if shard == 30 else 2_000_000,))
    rng = random.Random(8)
    voc = "abcd"
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.choice([2, 5, 30])))) for i in range(25)] + [(90, None), (91, "")]
    docs = [(d, " ".join(rng.choice(voc + "xyz") for _ in range(60))) for d in range(60)]
    docs += [(100, items[3][1] or ""), (101, None), (102, ""), (103, f"<b>{items[4][1].upper().replace(' ', '</b>,\n> &quot;')}"), (104, "z " * 5000 + items[5][1])]
    df, it = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, item_text string")
    want = brute([d for d in docs if d[1]], [i for i in items if i[1]], 5)
    assert len(want) > 5
    assert {tuple(r) for r in leaked(df, it, least=5).collect()} == want
    assert {tuple(r) for r in leaked(df, it, least=5, block_items=4).collect()} == want
    clean = {r.doc_id for r in without_leaks(df, it, least=5).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    item, doc = {i: words(t) for i, t in items}, {d: words(t) for d, t in docs}
    for r in passages(df, it, least=5).collect():
        a, b = item[r.item_id][r.item_word :], doc[r.doc_id][r.doc_word :]
        assert a[: r.n_words] == b[: r.n_words] and (len(a) == r.n_words or len(b) == r.n_words or a[r.n_words] != b[r.n_words])
    lost = df.withColumn("doc_id", F.when(F.col("doc_id") >= 30, F.col("doc_id")))
    assert without_leaks(lost, it, least=5).count() == len(clean) and without_leaks(df.limit(0), it).count() == 0
    assert leaked(df.limit(0), it).count() == 0 and leaked(df, it.limit(0)).count() == 0


def test_suffix_array():
    seq = np.array([2, 1, 2, 1, 3, 0, 1, 2, 0, 2, 1], np.int32)
    at = np.flatnonzero(seq)
    want = sorted(at, key=lambda i: (list(seq[i : i + list(seq[i:]).index(0)] if 0 in seq[i:] else seq[i:])))
    assert [list(seq[i:]) for i in suffix_array(seq, at, 16)][:1] == [list(seq[i:]) for i in want][:1]
    s = suffix_array(np.array([*b"mississippi"], np.int32), np.arange(11), 16)
    assert list(s) == sorted(range(11), key=lambda i: b"mississippi"[i:])


# ---- personal data


def posts(n=60):
    given, family = ["Anna", "Boris", "Clara", "Dario", "Edda"], ["Lindmora", "Falkstead", "Ostwick", "Brandhaven"]
    out, truth = [], set()
    for i in range(n):
        g, f = given[i % 5], family[i % 4]
        mail, phone, street = f"{g.lower()}.{f.lower()}@mail.example", f"020 7946 0{i:03d}", f"{i + 1} Old Mill Lane"
        out.append((i, f"My name is {g} {f} and I am new here.\nMail me at {mail} please. Call {phone} after six.\nI live at {street}, come over. Order 7771-220-168 never arrived. The Silver Kite Club won.\nMy NI number is QQ12{i % 10}456B if you need it."))
        truth |= {(i, "name", f"{g} {f}"), (i, "email", mail), (i, "phone", phone), (i, "address", street), (i, "id_number", f"QQ12{i % 10}456B")}
    return out, truth


def test_personal_data(spark):
    docs, truth = posts()
    docs += [(1000, None), (1001, ""), (1002, "We meet @ 9 pm. Version 2.48.13 fixes it. Page 12 Road section."), (1003, "anna ostwick wrote: hi"), (1004, "word " * 30_000 + "\nSigned: Boris Ostwick")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, a int, kind string")
    got = {tuple(r) for r in personal_data(df).collect()}
    truth |= {(1003, "name", "anna ostwick"), (1004, "name", "Boris Ostwick")}
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)
    assert not any(d in (1000, 1001, 1002) for d, _, _ in got)
    text = {r.doc_id: r.text for r in masked(df).collect()}
    assert text[1000] is None and text[1002] == docs[62][1] and "[EMAIL]" in text[5] and "@" not in text[5]
    spans = {(r.doc_id, r.a): r for r in find_spans(df).collect()}
    assert all(dict(docs)[d][r.a : r.b] == r.found_text for (d, _), r in spans.items())
    assert personal_data(df.limit(0)).count() == 0


def test_em_finds_the_reliable_labelers():
    rng = random.Random(0)
    counts = {}
    for _ in range(6000):
        y = rng.random() < 0.3
        vote = lambda p: (1 if y else -1) if rng.random() < p else (-1 if y else 1)  # noqa: B023, E731
        v = (vote(0.95), vote(0.9), vote(0.6))
        counts.setdefault((v, y), 0)
        counts[v, y] += 1
    patterns = {}
    for (v, _), n in counts.items():
        patterns[v] = patterns.get(v, 0) + n
    sure = reliabilities(sorted(patterns.items()))
    for v in patterns:
        share = counts.get((v, True), 0) / patterns[v]
        assert patterns[v] < 300 or abs(sure[v] - share) < 0.12


# ---- broken pairs


def test_linear_classifier_and_threshold():
    rng = np.random.default_rng(0)
    x = [np.array([0 if k % 3 == 0 else 1, 2 + int(rng.integers(5))]) for k in range(900)]
    y = np.array([float(k % 3 == 0) for k in range(900)])
    w = train(x, y, 8)
    s = np.array([w[f].sum() + w[-1] for f in x])
    a, b = platt(s, y)
    p = 1 / (1 + np.exp(-(a * s + b)))
    assert ((p > best_cut(p, y)) == (y > 0.5)).all() and best_cut(p, y * 0) == float("inf")
    kinds = ["red" if k % 3 == 0 else "" if k % 3 == 1 else "blue" for k in range(900)]
    rows = [[k % 3, 3 + int(rng.integers(5))] for k in range(900)]
    model = fit_calibrated(rows, kinds, [f"f{k % 7}" for k in range(900)], ("red", "blue"), 16)
    assert all((model.decide(model.margins(r)) or "") == k for r, k in zip(rows, kinds))


def test_platt_gives_shares():
    rng = np.random.default_rng(2)
    s = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * s - 1)))).astype(float)
    a, b = platt(s, y)
    assert abs(a - 0.5) < 0.05 and abs(b + 1) < 0.08


def test_known_words_exact_and_as_bits(spark):
    words = spark.range(5000).selectExpr("concat('w', id) as word")
    exact, bits = known_words(words, more=frozenset({"x"})), known_words(words, exact_words=100, more=frozenset({"x"}))
    others = [f"u{k}" for k in range(20_000)]
    for known in (exact, bits):
        assert all(f"w{k}" in known for k in range(5000)) and "x" in known and known.among({"w1", "x"}) == {"w1", "x"}
    assert not any(u in exact for u in others) and sum(u in bits for u in others) <= 0.005 * len(others)
    assert "w" not in known_words(words.limit(0))


def trials(spark, n=700, seed=3):
    rng = random.Random(seed)
    voc = ["night", "station", "river", "candle", "bridge", "ladder", "pepper", "anchor", "market", "tower", "branch", "garden", "lantern", "saddle", "meadow", "pocket", "harbor", "button", "kettle", "sofa"]
    fa, fc, truth = [], [], {}
    for i in range(n):
        cue, w = rng.choice(["stone", "cloud"]), rng.sample(voc, 5)
        kind = rng.choice([None] * 14 + ["empty", "truncated", "refusal", "copy", "language"])
        text = {None: f"output: {', '.join(w)}.", "empty": rng.choice(["", "output:", "-"]), "truncated": f"output: {', '.join(w[:3])}, {w[3][:2]}", "refusal": f"I'm sorry, but I cannot help with {cue}.",
                "copy": rng.choice([cue, f"input: {cue}."]), "language": "output: κλειδί, ρολόι, πλοίο, γόνατο, βροχή."}[kind]
        fa.append((i, cue, text, "x"))
        if kind:
            truth["fa", i] = kind
        c = rng.sample(voc, 8)
        kind = rng.choice([None] * 14 + ["empty", "truncated", "refusal", "copy"])
        text = {None: f"output: {c[0]}, {c[1]}", "empty": "...", "truncated": f"output: {c[0]},", "refusal": "This is not something I am able to do.", "copy": ", ".join(c)}[kind]
        fc.append((i, cue, ", ".join(c), text))
        if kind:
            truth["fc", i] = kind
    fa += [(9000, None, None, "x"), (9001, None, "night, river, candle, bridge, sofa.", "x"), (9002, "stone", "night, " * 20_000, "x")]
    fc += [(9000, None, None, None)]
    truth |= {("fa", 9000): "empty", ("fc", 9000): "empty"}
    return spark.createDataFrame(fc, "fc_id long, input_word string, candidates string, output string"), spark.createDataFrame(fa, "fa_id long, cue_word string, response string, defect string"), truth


def test_broken_pairs(spark):
    fc, fa, truth = trials(spark)
    got = {(r.pair_kind, r.rec_id): r.defect for r in broken_pairs(fc, fa).collect()}
    right = sum(truth.get(k) == v for k, v in got.items())
    assert right >= 0.97 * len(truth) and right >= 0.97 * len(got)
    assert broken_pairs(fc.limit(0), fa.limit(0)).count() == 0
