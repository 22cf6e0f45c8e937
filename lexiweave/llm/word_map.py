"""Which words of a table a task knows: an exact set while it is small, beyond that a map of bits sized by the exact number of words."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many words travel as they are (some 10 MB).
EXACT_WORDS = 200_000
#: Bits for each word beyond that, of which four are looked up: 2.4 of 1,000 unknown words pass as known.
BITS_PER_WORD = 16
LOOKED_UP = 4


def _places(word: str, bits: int) -> list[int]:
    b = word.encode("utf-8", "surrogatepass")
    h1, h2 = zlib.crc32(b), zlib.crc32(b, 0x9E3779B9) | 1
    h1 = (h1 << 32 | zlib.crc32(b, 0x5BD1E995)) & 0xFFFFFFFFFFFFFFFF
    return [(h1 + k * h2 * 0x9E3779B97F4A7C15) % bits for k in range(LOOKED_UP)]


class KnownWords:
    """`word in known`."""

    def __init__(self, words: frozenset[str] | None, bits: np.ndarray | None) -> None:
        self.words, self.bits = words, bits

    def __contains__(self, word: str) -> bool:
        if self.words is not None:
            return word in self.words
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in _places(word, len(self.bits) * 8))

    def among(self, words: set[str]) -> set[str]:
        return words & self.words if self.words is not None else {w for w in words if w in self}


def known_words(words: DataFrame, *, exact_words: int = EXACT_WORDS, more: frozenset[str] = frozenset()) -> KnownWords:
    """The words of a stored table of one string column, and `more`.

    Tasks set the bits of their words; what reaches the driver is one map at a time, as large as all
    words together ask for (2 bytes a word).
    """
    column = F.col(words.columns[0]).alias("word")
    words = words.select(column).where(F.col("word").isNotNull())
    n = words.count()
    if n <= exact_words:
        return KnownWords(frozenset(r["word"] for r in words.collect()) | more, None)
    size = -(-(n + len(more)) * BITS_PER_WORD // 8)
    tasks = max(1, min(64, words.rdd.getNumPartitions()))

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            for w in b.column(0).to_pylist():
                for p in _places(w, size * 8):
                    bits[p >> 3] |= 1 << (p & 7)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(size, np.uint8)
    for r in words.coalesce(tasks).mapInArrow(set_bits, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    for w in more:
        for p in _places(w, size * 8):
            bits[p >> 3] |= 1 << (p & 7)
    return KnownWords(None, bits)
