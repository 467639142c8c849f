"""Word and word k-gram hashes of whole texts, computed over the UTF-8 bytes of an Arrow batch.

A word's hash is a polynomial over random 64-bit values of its bytes (mod 2**64), mixed at the end.  Hashes depend on
the bytes only, so they are equal in every process.  Texts are never cut; a batch is worked on in pieces of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Work on about so many bytes of text at once, which take some 60 times as much memory; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19
#: Texts in a piece at most, so that a text's place in its piece fits in 16 bits.
PIECE_TEXTS = 60_000

_P = np.uint64(0x9E3779B97F4A7C13)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)


def _mix_one(x: int) -> int:
    mask = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return x ^ (x >> 31)


_BYTE_VALUES = np.array([_mix_one(i + 1) for i in range(256)], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_SOLID = np.ones(256, dtype=bool)
_SOLID[[32, 9, 10, 11, 12, 13]] = False
#: Kinds of words: letters, digits and all beyond ASCII; or whatever white space does not hold.
KINDS = {"alnum": _ALNUM, "solid": _SOLID}
_LOWER_VALUES = _BYTE_VALUES[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """P**i and P**-i, grown to the longest piece seen."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PIECE_BYTES + (1 << 16))
            for name, base in (("up", _P), ("down", _P_INV)):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up[:n], cls.down[:n]


class Words:
    """The words of a piece of ``n`` texts: ``doc`` (place of the text), ``hash``, ``first`` (of each text; n + 1)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind: str):
        n, size = len(bounds) - 1, len(data)
        solid = KINDS[kind][data]
        edge = np.zeros(size + 1, dtype=bool)
        edge[bounds] = True
        before = np.empty(size, dtype=bool)
        after = np.empty(size, dtype=bool)
        if size:
            before[0] = after[-1] = False
            before[1:], after[:-1] = solid[:-1], solid[1:]
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        up, down = _Powers.to(size)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_LOWER_VALUES[data] * up, out=total[1:])
        self.hash = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        #: First byte of each word.
        self.start = start
        self._total, self._down = total, down
        #: Bytes of each word.
        self.size = end - start
        self.first = np.searchsorted(start, bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        #: One fingerprint of each whole text, byte for byte.
        whole = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up, out=whole[1:])
        lengths = np.diff(bounds).astype(np.uint64)
        down1 = np.append(down, np.uint64(1))
        self.text_hash = mix((whole[bounds[1:]] - whole[bounds[:-1]]) * down1[bounds[:-1]] + lengths)

    def openings(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of the words that are longer, unlike those of any whole word."""
        at = self.start[self.size > n]
        return mix(((self._total[at + n] - self._total[at]) * self._down[at] + np.uint64(n)) ^ np.uint64(0xA0761D6478BD642F))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (among all words of the piece) where k words of one text begin, and the hash of these words."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        h = np.full(len(at), np.uint64(k), dtype=np.uint64)
        for j in range(k):
            h = h * _Q + self.hash[at + j]
        return at, mix(h)


def pieces(texts: pa.Array, kind: str) -> Iterator[tuple[int, int, Words]]:
    """(first row, row behind the last, words) for pieces of the batch; a null text counts as an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    rows = len(texts)
    if rows == 0:
        return
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < rows:
        b = int(np.searchsorted(bounds, bounds[a] + PIECE_BYTES, side="right")) - 1
        b = min(max(b, a + 1), rows, a + PIECE_TEXTS)
        yield a, b, Words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], kind)
        a = b


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's bigint."""
    return x.view(np.int64)


def phrase_words(text: str | None, kind: str = "alnum") -> np.ndarray:
    """The word hashes of one short text."""
    for _, _, w in pieces(pa.array([text], pa.string()), kind):
        return w.hash
    return np.zeros(0, dtype=np.uint64)
