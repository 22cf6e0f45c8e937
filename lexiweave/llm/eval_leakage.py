"""Problem 9: passages of evaluation items inside a corpus, by suffix arrays of the corpus's shards."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a shard: so many go into one suffix array.
SHARD_WORDS = 400_000
#: Items of one block and bytes of their texts; the words of a block (not the corpus) travel to every task.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32_000_000
#: Places of passages that a task lists at a time.
LISTED = 2_000_000

#: Markup that may stand between two words. Other brackets are punctuation.
_MARKUP = re.compile(
    r"<!--.*?-->|</?[a-zA-Z][^<>]*>|&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"
    r"|\[/?(?:b|i|u|s|q|url|img|quote|color|size|list|code|center|font|spoiler|\*)(?:=[^\[\]]*)?\]",
    re.S | re.I,
)
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The runs of letters and digits of a text, in lower case, without tags and entities. Null gives none."""
    return _WORD.findall(_MARKUP.sub(" ", text or "").lower())


@dataclass
class Block:
    """The items of one block, as numbers: code of each word, all items' words in a row, where each item begins."""

    code: dict[str, int]
    seq: np.ndarray
    start: np.ndarray
    item_id: np.ndarray
    least: int

    def suffixes(self) -> np.ndarray:
        """Where a suffix of at least `least` words of an item begins."""
        ends = np.append(self.start[1:], len(self.seq))
        return np.concatenate([np.arange(a, max(a, b - self.least + 1)) for a, b in zip(self.start, ends)]) if len(self.start) else np.empty(0, np.int64)


def block_of(items: pd.DataFrame, least: int) -> Block:
    code: dict[str, int] = {}
    seq: list[int] = []
    start, ids = [], []
    for item_id, text in items.itertuples(index=False):
        found = words(text)
        if len(found) >= least:  # a shorter item holds no passage
            start.append(len(seq))
            ids.append(item_id)
            seq += [code.setdefault(w, len(code) + 1) for w in found]
    return Block(code, np.array(seq, np.int32), np.array(start, np.int64), np.array(ids, np.int64), least)


def suffix_array(seq: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions `at`, in the order of the suffixes of seq that begin there, told apart by `depth` words at least.

    Prefix doubling: ranks by one word, two words, four words and so on. Code 0 ends a suffix.
    """
    rank = seq.astype(np.int64)
    length = 1
    while length < depth:
        behind = np.zeros_like(rank)
        behind[:-length] = rank[length:]
        behind[rank == 0] = 0
        key = rank * (int(rank.max()) + 1) + behind
        used, new = np.unique(key, return_inverse=True)
        new = new + 1
        new[seq == 0] = 0
        rank, length = new, length * 2
        if len(used) >= np.count_nonzero(seq) + 1:
            break
    return at[np.argsort(rank[at], kind="stable")]


def _compare(seq: np.ndarray, at: np.ndarray, want: np.ndarray) -> np.ndarray:
    """-1, 0, 1 for each row of want: how the words from `at` on stand against it."""
    have = seq[at[:, None] + np.arange(want.shape[1])]
    differ = have != want
    first = differ.argmax(axis=1)
    row = np.arange(len(at))
    return np.where(differ[row, first], np.where(have[row, first] < want[row, first], -1, 1), 0)


def _search(seq: np.ndarray, sa: np.ndarray, want: np.ndarray, *, right: bool) -> np.ndarray:
    """Binary search of each row of want among the suffixes: the first that is not smaller (right: the first that is greater)."""
    low, high = np.zeros(len(want), np.int64), np.full(len(want), len(sa), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        order = _compare(seq, sa[np.minimum(mid, len(sa) - 1)], want)
        after = (order <= 0) if right else (order < 0)
        low, high = np.where(open_ & after, mid + 1, low), np.where(open_ & ~after, mid, high)
    return low


_MATCH_COLUMNS = ("doc_id", "item_id", "item_word", "doc_word", "n_words")


def _shard_matches(docs: list[tuple[int, np.ndarray]], block: Block, listed: int = LISTED) -> Iterator[pd.DataFrame]:
    """Longest matches of one shard: doc_id, item_id, item_word, doc_word, n_words; about `listed` places at a time, however often a passage stands in the shard."""
    n = block.least
    seq = np.concatenate([np.append(codes, 0) for _, codes in docs] + [np.zeros(n, np.int64)]).astype(np.int32)
    sizes = np.array([len(c) + 1 for _, c in docs])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc_id = np.array([d for d, _ in docs], np.int64)
    # A passage needs n known words in a row; only suffixes that begin with so many are kept.
    stop = np.flatnonzero(seq == 0)
    at = np.arange(len(seq) - n)
    at = at[(seq[at] != 0) & (stop[np.minimum(np.searchsorted(stop, at), len(stop) - 1)] - at >= n)]
    query = block.suffixes()
    if not len(at) or not len(query):
        return
    sa = suffix_array(seq, at, n)
    want = block.seq[query[:, None] + np.arange(n)]
    low, high = _search(seq, sa, want, right=False), _search(seq, sa, want, right=True)
    found = np.flatnonzero(high > low)
    query, low, many = query[found], low[found], (high - low)[found]
    before = np.cumsum(many) - many
    item_of = np.searchsorted(block.start, query, "right") - 1
    ends = np.append(block.start[1:], len(block.seq))
    for first in range(0, int(many.sum()), listed):
        place_no = np.arange(first, min(first + listed, int(many.sum())))
        q = np.searchsorted(before, place_no, "right") - 1
        place, suffix, item = sa[low[q] + place_no - before[q]], query[q], item_of[q]
        # Only where the word before differs, so that each passage comes once, from its beginning.
        goes_back = (suffix > block.start[item]) & (place > 0)
        goes_back &= seq[np.maximum(place - 1, 0)] == block.seq[np.maximum(suffix - 1, 0)]
        place, suffix, item = (x[~goes_back] for x in (place, suffix, item))
        length = np.full(len(place), n)
        growing = np.ones(len(place), bool)
        while growing.any():
            a, b = suffix + length, place + length
            growing &= (a < ends[item]) & (b < len(seq))
            growing &= block.seq[np.minimum(a, len(block.seq) - 1)] == seq[np.minimum(b, len(seq) - 1)]
            length += growing
        doc = np.searchsorted(begin, place, "right") - 1
        yield pd.DataFrame(dict(zip(_MATCH_COLUMNS, (doc_id[doc], block.item_id[item], suffix - block.start[item], place - begin[doc], length))))


_MATCH = "doc_id long, item_id long, item_word long, doc_word long, n_words long"


def _matcher(block: Block):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for f in frames:
            for doc_id, text in f.itertuples(index=False):
                codes = np.array([block.code.get(w, 0) for w in words(text)], np.int32)
                if len(codes) < block.least or not codes.any():
                    continue
                held.append((doc_id, codes))
                size += len(codes)
                if size >= SHARD_WORDS:
                    yield from _shard_matches(held, block)
                    held, size = [], 0
        if held:
            yield from _shard_matches(held, block)

    return run


def _leak_filter(block: Block, column: int):
    """The rows whose text holds no passage of the block's items, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        docs: list[tuple[int, np.ndarray]] = []
        rows = size = 0

        def clean() -> Iterator[pa.RecordBatch]:
            keep = np.ones(rows, bool)
            for found in _shard_matches(docs, block) if docs else ():
                keep[found["doc_id"].to_numpy(np.int64)] = False
            at = 0
            for b in held:
                yield b.filter(pa.array(keep[at : at + b.num_rows]))
                at += b.num_rows

        for b in batches:
            for k, text in enumerate(b.column(column).to_pylist()):
                codes = np.array([block.code.get(w, 0) for w in words(text)], np.int32)
                if len(codes) >= block.least and codes.any():
                    docs.append((rows + k, codes))
                    size += len(codes)
            held.append(b)
            rows += b.num_rows
            if size >= SHARD_WORDS or rows >= 50_000:
                yield from clean()
                held, docs, rows, size = [], [], 0, 0
        yield from clean()

    return run


def _item_blocks(items: DataFrame, least: int, block_items: int, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of about so many items and bytes at most."""
    listed = items.select("item_id", "item_text").where("item_id is not null and item_text is not null")
    n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_bytes))
    for k in range(blocks):
        yield block_of(listed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toPandas(), least)


def passages(documents: DataFrame, items: DataFrame, *, least: int = 10, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_word, doc_word, n_words: every longest verbatim run of at least `least` words that a document shares with an item.

    item_word and doc_word say at which word (from 0) the run begins. The corpus isn't shuffled: each
    task cuts its documents into shards, builds a suffix array of a shard's words and searches every
    suffix of every item in it. The items are a query set against all documents; they go through in
    blocks, and only a block's words are sent to the tasks.

    Null and empty texts, and items of fewer words, share nothing. A document with a null doc_id is left out.
    """
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    out = None
    for block in _item_blocks(items, least, block_items, block_bytes):
        found = docs.mapInPandas(_matcher(block), _MATCH)
        out = found if out is None else out.unionByName(found)
    return out


def leaked(documents: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, once for each document and the items it holds a passage of."""
    return passages(documents, items, **how).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, *, least: int = 10, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no passage of any item, with all their columns, also those with a null doc_id. Nothing is shuffled or joined."""
    column = documents.columns.index("text")
    for block in _item_blocks(items, least, block_items, block_bytes):
        documents = documents.mapInArrow(_leak_filter(block, column), documents.schema)
    return documents
