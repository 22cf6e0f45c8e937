"""MD5 of one prefix and many words at once, in NumPy."""

import hashlib

import numpy as np

_K = [int(abs(np.sin(i + 1.0)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_SHIFT = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a message that fit one block of MD5, and words that are hashed at a time, within a processor's cache.
ONE_BLOCK, CHUNK = 55, 8_192


def _rounds(columns: list[np.ndarray | int], n: int) -> list[np.ndarray]:
    """The four words of the digests of n messages of one block, whose sixteen words are arrays, or numbers where all have the same."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        m = columns[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        f += a
        if isinstance(m, int):
            f += np.uint32((m + _K[i]) & 0xFFFFFFFF)
        else:
            f += m
            f += np.uint32(_K[i])
        s = _SHIFT[kind][i % 4]
        np.left_shift(f, np.uint32(s), out=t)
        f >>= np.uint32(32 - s)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START)]


class Words:
    """Words as UTF-8, whose digests with a prefix are asked for again and again."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.width = int(min(ONE_BLOCK, self.sizes.max(initial=0)))
        self.body = np.zeros((len(words), self.width + 1), np.uint8)
        for i, w in enumerate(words):
            if len(w) <= self.width:
                self.body[i, : len(w) + 1] = np.frombuffer(w + b"\x80", np.uint8)

    def md5(self, prefix: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last 64 bits of md5(prefix + word) of each word: as numbers in the order of the digests' hexadecimal text."""
        p, n = len(prefix), len(self.words)
        high, low = np.empty(n, np.uint64), np.empty(n, np.uint64)
        width = min(self.width, ONE_BLOCK - p)
        short = self.sizes <= width if width >= 0 else np.zeros(n, bool)
        for i in np.flatnonzero(~short):
            digest = hashlib.md5(prefix + self.words[i], usedforsecurity=False).digest()
            high[i], low[i] = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")
        if not short.any():
            return high, low
        every = bool(short.all())
        for at in range(0, n, CHUNK):
            own = slice(at, at + CHUNK) if every else at + np.flatnonzero(short[at : at + CHUNK])
            body = self.body[own, : width + 1]
            block = np.zeros((len(body), 64), np.uint8)
            block[:, :p] = np.frombuffer(prefix, np.uint8)
            block[:, p : p + width + 1] = body
            parts = block.view("<u4")
            columns: list[np.ndarray | int] = [np.ascontiguousarray(parts[:, k]) if 4 * k + 4 > p and 4 * k <= p + width else int(parts[0, k]) if len(parts) else 0 for k in range(14)]
            columns += [((self.sizes[own] + p) * 8).astype(np.uint32), 0]
            a, b, c, d = (x.byteswap().astype(np.uint64) for x in _rounds(columns, len(body)))
            high[own], low[own] = a << np.uint64(32) | b, c << np.uint64(32) | d
        return high, low

    def order(self, prefix: bytes) -> np.ndarray:
        """Places of the words in the order of their digests; those of one digest as they stand."""
        high, low = self.md5(prefix)
        at = np.argsort(high)
        if (high[at[1:]] == high[at[:-1]]).any():
            at = np.lexsort((np.arange(len(at)), low, high))
        return at
