"""Problem 8: byte-pair encoding as a finite-state transducer that is built while it runs, and streaming decode."""

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: how the public byte-level vocabularies part a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: States and parts kept in memory by one task; the tables start anew beyond that.
MOST_STATES = 200_000
MOST_PARTS = 300_000
#: Pairs of tokens whose order is remembered.
MOST_FOLLOWS = 1_000_000


def read_ranks(path: str) -> bytes:
    """The vocabulary file as it is: one line per token, its bytes in base64 and its id, which is also its merge rank."""
    with open(path, "rb") as f:
        return f.read()


class Transducer:
    """Reads bytes, emits token ids as soon as no later byte can change them.

    Merging in rank order has one result per prefix: its last token v, and before it the result of the
    prefix without v, where merging the two last tokens' bytes must give back just these two. So the
    result of every prefix hangs on that of a shorter one, and a byte is read by walking the token trie
    from every prefix that may still be extended. A state is the set of these: for each the trie node,
    and the tokens not yet emitted. What all of them share is emitted, so lookahead is bounded by the
    longest token. States are numbered when first met, and every step is kept in a table.
    """

    def __init__(self, ranks: bytes) -> None:
        self.bytes_of: dict[int, bytes] = {}
        self.id_of: dict[bytes, int] = {}
        for line in ranks.splitlines():
            if line:
                token, rank = line.split()
                token = base64.b64decode(token)
                self.bytes_of[int(rank)], self.id_of[token] = token, int(rank)
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in self.id_of.items():
            node = 0
            for b in token:
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self.follows: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [(-1, ((0, ()),))]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[tuple[int, ...], int]]] = [{}]

    def _merged(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.id_of.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, last: int, token: int) -> bool:
        key = (last, token)
        ok = self.follows.get(key)
        if ok is None:
            if len(self.follows) > MOST_FOLLOWS:
                self.follows.clear()
            right = self.bytes_of[token]
            want = [right] if last < 0 else [self.bytes_of[last], right]
            ok = self.follows[key] = self._merged(b"".join(want)) == want
        return ok

    def _step(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        last, live = self.states[state]
        grown: list[tuple[int, tuple[int, ...]]] = []
        here: tuple[int, ...] | None = None
        for node, path in live:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if token >= 0 and here is None and self._may_follow(path[-1] if path else last, token):
                here = (*path, token)
            if self.trie[child]:
                grown.append((child, path))
        if here is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        grown.append((0, here))
        shared = 0
        shortest = min(len(p) for _, p in grown)
        while shared < shortest and all(p[shared] == here[shared] for _, p in grown):
            shared += 1
        emitted = here[:shared]
        new = (emitted[-1] if emitted else last, tuple((n, p[shared:]) for n, p in grown))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
            self.steps.append({})
        out = self.steps[state][byte] = (emitted, number)
        return out

    def encode_part(self, part: bytes) -> list[int]:
        """Ids of one part of a text (parts never merge with each other)."""
        if len(self.states) > MOST_STATES:
            self._clear()
        state, out, steps = 0, [], self.steps
        for b in part:
            emitted, state = steps[state].get(b) or self._step(state, b)
            if emitted:
                out += emitted
        out += self.states[state][1][-1][1]  # the prefix that ends here is always the last one
        return out


class Encoder:
    def __init__(self, ranks: bytes) -> None:
        self.fst = Transducer(ranks)
        self.split = regex.compile(SPLIT)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; their strings are ordinary text. Null and empty give no ids."""
        out: list[int] = []
        known = self.known
        for m in self.split.finditer(text or ""):
            part = m[0]
            ids = known.get(part)
            if ids is None:
                ids = self.fst.encode_part(part.encode("utf-8", "surrogatepass"))
                if len(part) < 64:
                    if len(known) > MOST_PARTS:
                        known.clear()
                    known[part] = ids
            out += ids
        return out


class Utf8Stream:
    """Decodes bytes as they come. need: continuation bytes still to come; low, high: what the next one may be."""

    def __init__(self) -> None:
        self.held = b""
        self.need, self.low, self.high = 0, 0x80, 0xBF

    def feed(self, piece: bytes, *, final: bool = False) -> str:
        """The text that is certain by now. Bytes that can't be UTF-8 give U+FFFD, as does a cut-off end with final."""
        out: list[str] = []
        start = 0
        data = self.held + piece
        i = len(self.held)
        while i < len(data):
            b = data[i]
            if self.need:
                if self.low <= b <= self.high:
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    i += 1
                    continue
                whole = i - 1
                while data[whole] & 0xC0 == 0x80:
                    whole -= 1
                out += [data[start:whole].decode(), "�"]
                start, self.need, self.low, self.high = i, 0, 0x80, 0xBF
                continue
            if b >= 0x80:
                if 0xC2 <= b <= 0xDF:
                    self.need = 1
                elif 0xE0 <= b <= 0xEF:
                    self.need, self.low, self.high = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
                elif 0xF0 <= b <= 0xF4:
                    self.need, self.low, self.high = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
                else:
                    out += [data[start:i].decode(), "�"]
                    start = i + 1
            i += 1
        end = len(data)
        if self.need:
            end -= 1
            while data[end] & 0xC0 == 0x80:
                end -= 1
        out.append(data[start:end].decode())
        self.held = data[end:]
        if final and self.held:
            out.append("�")
            self.held, self.need, self.low, self.high = b"", 0, 0x80, 0xBF
        return "".join(out)


def decode(ids: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """The text of ids, piece by piece: a piece ends where a token ends, or later if that is within a character."""
    stream = Utf8Stream()
    for i in ids:
        if piece := stream.feed(bytes_of[i]):
            yield piece
    if rest := stream.feed(b"", final=True):
        yield rest


#: Rows of one result batch.
BATCH = 2_000


def _encode(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                ids = pa.array((encoder.encode(t.as_py()) for t in part.column(1)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return run


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every text, whole and without special tokens; null and empty texts have the empty list.

    The driver reads the vocabulary (a file of fixed size, under 1 MB) and broadcasts it as it is.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))
    return documents.select("doc_id", "text").mapInArrow(_encode(ranks), "doc_id long, ids array<int>")


def _decode(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = Transducer(ranks.value).bytes_of
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                texts = pa.array(("".join(decode(ids.as_py() or (), bytes_of)) for ids in part.column(1)), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of ids; null ids give the empty text. Unknown ids raise KeyError."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    return encoded.select("doc_id", "ids").mapInArrow(_decode(ranks), "doc_id long, text string")
