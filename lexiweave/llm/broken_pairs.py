"""Problem 6: prompt and response pairs whose answer is empty, cut off, declined, copied or in another language."""

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.packed import Packed, folded, is_prose, unpack
from lexiweave.llm.linear import Calibrated, fit_calibrated
from lexiweave.llm.synthetic_pairs import DEFECTS, examples
from lexiweave.operators.packed_values import ASKED, item_words, words_in_use
from lexiweave.sources.workdir import stored

#: Clean answers of each pair kind that training examples are made from; a bounded sample.
TRAIN_PAIRS = 1_500
#: Posts that give words of other languages; a bounded sample.
FOREIGN_POSTS = 1_000
FEATURES = 1 << 17

# ---- what an answer is to its pair: a few small facts, each with a few values

_HARD_STOP, _SOFT_STOP = re.compile(r"[.!?…。！？]['\"”’)\]]?\s*$"), re.compile(r"[,;:|/、·-]\s*$")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def _amount(n: int, asked: int) -> str:
    return str(n) if n <= asked else "more" if n <= 2 * asked else "many"


def _share(n: int, of: int) -> str:
    return "-" if not of else "none" if not n else "all" if n == of else "most" if 2 * n >= of else "some"


def relation(field: str, cue: str | None, body: str, candidates: list[str] | None, got: Packed) -> list[str]:
    """The facts of one pair as `name=value`: how many values, how it ends, and what it shares with its cue and candidates."""
    asked, listed = ASKED[field], set(candidates or ())
    prose = [is_prose(v, b) for v, b in zip(got.values, got.bare)]
    values = [folded(v) for v, p in zip(got.values, prose) if not p]
    own, kinds = folded(cue or ""), set(values)
    hits = kinds & listed
    words = [folded(w) for w in _TOKEN.findall(body)] if any(prose) else []
    named = len(set(words) & listed)
    last = values[-1] if values and not prose[-1] else ""
    begins = bool(last) and last not in listed and any(c.startswith(last) for c in listed)
    return [
        f"n={_amount(len(values), asked)}", f"prose={min(sum(prose), 3)}",
        f"end={'hard' if _HARD_STOP.search(body) else 'soft' if _SOFT_STOP.search(body) else 'none'}", f"closed={got.closed:d}", f"open={got.open_end:d}",
        f"label={got.label}", f"echo={got.echo:d}", f"before={bool(got.preface):d}", f"hits={_share(len(kinds & listed), len(kinds)) if listed else 'nolist'}",
        f"back={bool(listed) and 10 * max(len(hits), named) >= 8 * len(listed):d}", f"begins={begins:d}", f"first={bool(values) and any(c.startswith(values[0]) for c in listed):d}",
        f"own={_share(sum(v == own for v in values), len(values)) if own else '-'}{min(len(values), 2) if own in kinds else ''}", f"named={min(named, 3)}",
        f"ownin={own in words:d}", f"script={any(ord(c) > 0x24F and c.isalpha() for v in values for c in v):d}", f"words={min(len(words), 12) // 3}",
    ]


#: Classes of English words that carry what a sentence does, whatever it is about.
_CLASSES = {
    "NOT": "no not never nothing none nor cannot can't won't don't doesn't didn't isn't aren't wasn't couldn't wouldn't shouldn't mustn't haven't unable without refuse refuses refusing refusal decline declines declining declined deny denied reject rejected impossible avoid unwilling hesitant",
    "I": "i i'm i've i'd i'll me my mine myself we us our we're we'll", "YOU": "you your yours yourself",
    "SORRY": "sorry apologies apologise apologize apology regret regrettably unfortunately sadly afraid forgive pardon excuse",
    "CAN": "can could able possible comfortable allowed permitted may capable willing ability", "WANT": "want wish like prefer rather choose choosing",
    "HELP": "help assist assistance answer answers answering reply respond response responding provide providing give giving complete completing produce comply fulfill fulfil engage discuss continue proceed share generate process handle",
    "RULE": "policy policies rule rules guideline guidelines terms safety inappropriate appropriate harmful sensitive offensive against restricted restrictions forbidden prohibited limits scope programming instructions content",
    "MACHINE": "ai assistant model language machine program bot computer system software", "OTHER": "another different else something instead elsewhere",
    "COUNT": "one two three four five six several exactly single both pair", "MUST": "must should only need required each every exactly avoid never ensure",
    "ASK": "write choose select pick give name list provide return respond enter type state tell think produce read find supply mention answer reply say use separate include consider",
    "TASK": "word words term terms list lists candidate candidates option options input cue following below associated association associations related relate relates mind come comes output format comma commas order instruction task question",
}
#: Words that a sentence seldom ends with.
_LEADING = frozenset("a an the and or but of to in on at by for with from as than that which who when where while because since if so is are was were be been being has have had would could should will can may might must do does it its they their this these those my your our each some any such like very most between among into about often usually".split())
_CLASS = {w: c for c, words in _CLASSES.items() for w in words.split()}


def grams(body: str, cue: str | None, candidates: list[str] | None) -> list[str]:
    """Word n-grams of an answer in sentences, with its cue and candidates as signs; and the same of the classes of its words."""
    listed, own = set(candidates or ()), folded(cue or "")
    words = [w.replace("’", "'") for w in _TOKEN.findall(body.lower())]
    words = ["<cue>" if own and folded(w) == own else "<one>" if folded(w) in listed else w for w in words]
    kinds = [k for k in (_CLASS.get(w, w if w[0] == "<" else "NOT" if w.endswith("n't") else "") for w in words) if k]
    out = [f"w={w}" for w in words] + [f"w={a} {b}" for a, b in zip(words, words[1:])] + [f"s={w[:5]}" for w in words if len(w) > 5]
    out += [f"k={k}" for k in kinds] + [f"k={a} {b}" for a, b in zip(kinds, kinds[1:])] + [f"kk={a} {b}" for a in set(kinds) for b in set(kinds) if a < b]
    first = [_CLASS.get(w, "") for w in words[:2]]
    stop = "stop" if _HARD_STOP.search(body) else "open"
    ends = "lead" if words and words[-1] in _LEADING else "word"
    whole = [f"{c}={c in kinds:d}" for c in ("NOT", "I", "SORRY", "ASK", "COUNT")]
    out += [f"ends={ends} {stop}"] + [f"{x} {stop}" for x in whole] + [f"{x} {ends}" for x in whole] + [f"{x} {y}" for i, x in enumerate(whole) for y in whole[i + 1 :]]
    return out + [f"first={words[0] if words else ''}", f"opens={' '.join(first)}", f"closes={_CLASS.get(words[-1], '') if words else ''}", f"many={min(len(kinds), 6)}"]


def _hash(names: list[str]) -> list[int]:
    return sorted({zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in names})


@lru_cache(20_000)
def facts_features(field: str, facts: tuple[str, ...]) -> list[int]:
    """Hashed: each fact, and each pair of facts. There are many pairs of few kinds, so they are remembered."""
    return _hash([*facts, *(f"{field}:{x}" for x in facts), *(f"{field}:{x}&{y}" for i, x in enumerate(facts) for y in facts[i + 1 :])])


def letters(values: list[str]) -> list[str]:
    """Letter n-grams of the words of a list none of whose words is in use."""
    return [f"c={f'^{v}$'[i : i + 3]}" for v in map(folded, values[:8]) for i in range(max(1, len(v)))]


def known_fact(n_known: int, n_words: int) -> str:
    return f"known={_share(n_known, n_words)}"


def read_pair(field: str, cue: str | None, text: str | None, candidates: list[str] | None) -> tuple[list[str], list[str], list[int]]:
    """values of the answer that are no sentences, its facts, and the hashed n-grams if it has sentences."""
    body = text or ""
    got = unpack(body, cue)
    prose = [is_prose(v, b) for v, b in zip(got.values, got.bare)]
    said = _hash(grams(body[len(got.preface) :] if got.preface and body.startswith(got.preface) else body, cue, candidates)) if any(prose) else []
    return [v for v, p in zip(got.values, prose) if not p], relation(field, cue, body, candidates, got), said


# ---- Spark

_READ = "field_name string, rec_id long, cue string, body string, items array<string>, facts array<string>, said array<int>, candidates array<string>, sound boolean"
_COLUMNS = [c.split()[0] for c in _READ.split(", ")]


def _answer(field: str, rec_id, cue, text, candidates) -> tuple:
    values, facts, said = read_pair(field, cue, text, candidates)
    sound = not said and len(values) == ASKED[field] and (not candidates or all(folded(v) in candidates for v in values)) and "echo=0" in facts and not any(c in v for v in values for c in ",;|/")
    return field, rec_id, cue, text, values, facts, said, candidates, sound


def _read_fc(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for rec_id, cue, candidates, output in f.itertuples(index=False):
            listed = unpack(candidates, answer=False).values
            rows.append(("candidates", rec_id, None, None, listed, None, None, None, False))
            rows.append(_answer("output", rec_id, cue, output, [folded(v) for v in listed]))
        yield pd.DataFrame(rows, columns=_COLUMNS)


def _read_fa(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame([_answer("response", i, c, t, None) for i, c, t in f.itertuples(index=False)], columns=_COLUMNS)


def _sample(df: DataFrame, columns: list[str], most: int, *key: str) -> pd.DataFrame:
    """At most `most` rows, by hash, so that every run trains alike."""
    return df.orderBy(F.xxhash64(*key), *key).select(*columns).limit(most).toPandas()


def fit(read: DataFrame, words: DataFrame, documents: DataFrame | None, *, train_pairs: int = TRAIN_PAIRS) -> Calibrated | None:
    """Weights and calibration of each defect, from synthetic examples made of at most `train_pairs` clean pairs of each kind.

    A clean pair has as many values as were asked for, half of them in use at least, and all of them in
    the list of candidates if there is one. None where there is no clean pair.
    """
    spark = read.sparkSession
    clean = [tuple(r) for field in ASKED for r in _sample(read.where((F.col("field_name") == field) & F.col("sound")), ["field_name", "cue", "body", "candidates", "items"], train_pairs, "rec_id", "row").itertuples(index=False)]
    if not clean:
        return None
    clean = [(f, c, t, None if cand is None else list(cand), list(v)) for f, c, t, cand, v in clean]
    foreign: list[tuple[str, str]] = []
    if documents is not None:
        posts = documents.where("text is not null and lang is not null and lower(trim(lang)) not like 'en%'")
        for lang, t in _sample(posts, ["lang", "text"], FOREIGN_POSTS, "doc_id", "text").itertuples(index=False):
            foreign += [(lang.strip().lower()[:2], w) for w in set(re.findall(r"[^\W\d_]{3,}", t.lower()))]
    # Which words of the sample are in use.
    asked = {folded(w) for _, w in foreign} | {folded(v) for *_, cand, values in clean for v in values}
    known = {r["word"] for r in spark.createDataFrame([(w,) for w in sorted(asked)], "word string").join(words, "word", "left_semi").collect()}
    clean = [c for c in clean if 2 * sum(folded(v) in known for v in c[4]) >= len(c[4])]
    if not clean:
        return None
    made = examples(clean, sorted({(lang, w) for lang, w in foreign if folded(w) not in known}))
    rows, kinds, families = [], [], []
    for field, cue, text, candidates, kind, family in made:
        values, facts, said = read_pair(field, cue, text, candidates)
        hit = sum(folded(v) in known for v in values)
        rows.append(facts_features(field, (*facts, known_fact(hit, len(values)))) + said + (_hash(letters(values)) if values and not hit else []))
        kinds.append(kind)
        families.append(family)
    return fit_calibrated(rows, kinds, families, DEFECTS, FEATURES)


def _classify(model: Calibrated):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, np.ndarray] = {}  # most answers are lists, and there are few kinds of lists
        for f in frames:
            out = []
            for field, facts, said, items, n_known in zip(f["field_name"], f["facts"], f["said"], f["items"], f["n_known"]):
                key = (field, *facts, known_fact(int(n_known), len(items)))
                score = seen.get(key)
                if score is None:
                    if len(seen) > 100_000:
                        seen.clear()
                    score = seen[key] = model.margins(facts_features(field, key[1:]))
                if len(said):
                    score = score + model.weights[said].sum(axis=0)
                if len(items) and not n_known:
                    score = score + model.weights[_hash(letters(list(items)))].sum(axis=0)
                out.append(model.decide(score))
            yield pd.DataFrame({"field_name": f["field_name"], "rec_id": f["rec_id"], "defect": pd.Series(out, dtype=object)})

    return run


def broken_pairs(fc_raw: DataFrame, fa_raw: DataFrame, documents: DataFrame | None = None, *, train_pairs: int = TRAIN_PAIRS) -> DataFrame:
    """pair_kind (fa or fc), rec_id, defect of every defective pair: empty, truncated, refusal, copy or language.

    A multi-label linear classifier. Its features are hashed n-grams of the answer, with the cue and the
    candidates as signs, and what the answer is to its cue, its candidates and the words in use, each
    fact alone and with each other one. It is trained on clean answers of at most `train_pairs` pairs of
    each kind, on sound ones in other layouts and wordings, and on synthetic defects made from them: cut
    off, copied, declined, emptied, and with the words swapped for those of `documents` in other
    languages. Each kind is written by several families of wordings; scores become probabilities, and
    the threshold is set, by families that training didn't see. It decides on every pair: whether there
    is a defect, and which one is the likeliest. Without clean answers to learn from nothing is flagged. Null
    answers are empty; a null cue or missing candidates leave out the facts that need them.
    """
    fc = fc_raw.select("fc_id", "input_word", "candidates", "output").mapInPandas(_read_fc, _READ)
    fa = fa_raw.select("fa_id", "cue_word", "response").mapInPandas(_read_fa, _READ)
    read = stored(fc.unionByName(fa).withColumn("row", F.monotonically_increasing_id()), "p6-read")
    words = words_in_use(read.select("row", "field_name", "items"))
    model = fit(read, words, documents, train_pairs=train_pairs)
    answers = read.where("field_name <> 'candidates'").select("row", "field_name", "rec_id", "items", "facts", "said")
    if model is None:
        return answers.limit(0).select(F.lit("").alias("pair_kind"), "rec_id", F.lit("").alias("defect"))
    # Of a word given twice both count, so that n_known is out of the number of items.
    each = answers.select("row", F.posexplode("items").alias("at", "item")).withColumn("items", F.array("item"))
    n_known = item_words(each, "row", "at").join(words, "word", "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias("n_known"))
    pairs = answers.join(n_known, "row", "left").withColumn("n_known", F.coalesce("n_known", F.lit(0)))
    marked = pairs.select("field_name", "rec_id", "items", "facts", "said", "n_known").mapInPandas(_classify(model), "field_name string, rec_id long, defect string").where("defect is not null")
    return marked.select(F.when(F.col("field_name") == "response", "fa").otherwise("fc").alias("pair_kind"), "rec_id", "defect")
