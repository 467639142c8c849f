"""Counting quotient filters without loss: exact counters of integer keys in a few bytes each.

A key is a pair of integers of given widths.  An invertible permutation spreads the keys evenly; the leading bits of the
permuted key are its quotient, the rest is kept in full as its remainder, so keys come back from a filter as they went in.
The leading ``section`` bits of the quotient say which section of the filter a key is in.  A packed section has, as in any
quotient filter, a bit for each slot (is there a key of this quotient?), a bit for each key (is it the last of its run?), the
remainders in the order of their keys, and the counters, one byte each where that suffices.  Sections of several filters are
merged by their sorted keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ROUNDS = 4


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _spread(x: np.ndarray, k: int) -> np.ndarray:
    x = (x + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Widths:
    """Bits of the two halves of a key (1 to 64 each), and of the section number (at most ``high``)."""

    high: int
    low: int
    section: int

    def permute(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in range(_ROUNDS):
            high = high ^ (_spread(low, 2 * k + 1) & _mask(self.high))
            low = low ^ (_spread(high, 2 * k + 2) & _mask(self.low))
        return high, low

    def restore(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in reversed(range(_ROUNDS)):
            low = low ^ (_spread(high, 2 * k + 2) & _mask(self.low))
            high = high ^ (_spread(low, 2 * k + 1) & _mask(self.high))
        return high, low


@dataclass
class Counters:
    """Permuted keys in ascending order, each once, with their counts."""

    high: np.ndarray
    low: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.high)

    @staticmethod
    def none() -> Counters:
        empty = np.zeros(0, dtype=np.uint64)
        return Counters(empty, empty, np.zeros(0, dtype=np.int64))


def merged(parts: list[Counters], widths: Widths) -> Counters:
    """The sums of several filters, by key."""
    high, low, count = (np.concatenate([getattr(p, f) for p in parts]) for f in ("high", "low", "count"))
    if not len(high):
        return Counters.none()
    if widths.high + widths.low <= 64:
        key = (high << np.uint64(widths.low % 64)) | low
        order = np.argsort(key)
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((low, high))
        new = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    starts = np.flatnonzero(np.append(True, new))
    first = order[starts]
    return Counters(high[first], low[first], np.add.reduceat(count[order], starts))


def counted(high: np.ndarray, low: np.ndarray, widths: Widths) -> Counters:
    """The filter of some keys, each of which counts once."""
    if not len(high):
        return Counters.none()
    high, low = widths.permute(high.astype(np.uint64), low.astype(np.uint64))
    if widths.high + widths.low <= 64:
        key = np.sort((high << np.uint64(widths.low % 64)) | low)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key = key[starts]
        return Counters(key >> np.uint64(widths.low % 64), key & _mask(widths.low), np.diff(np.append(starts, len(high))))
    return merged([Counters(high, low, np.ones(len(high), dtype=np.int64))], widths)


def _to_bytes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_bytes(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width if width else 0, 8), dtype=np.uint8)
    if width:
        out[:, :width] = data.reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _pack(part: Counters, widths: Widths) -> bytes:
    """One section's keys: numbers of keys, slot bits and large counters, then the bits, remainders and counters."""
    n, inside = len(part), widths.high - widths.section
    slot_bits = min(inside, n.bit_length())
    rest_bits = inside - slot_bits
    slot = ((part.high >> np.uint64(rest_bits)) & _mask(slot_bits)).astype(np.int64)
    occupied = np.zeros(1 << slot_bits, dtype=bool)
    occupied[slot] = True
    last = np.append(slot[1:] != slot[:-1], True)
    large = part.count[part.count >= 255].astype("<i8")
    head = np.array([n, slot_bits, len(large)], dtype="<i8").tobytes()
    rest, low = part.high & _mask(rest_bits), part.low
    if rest_bits + widths.low <= 64:
        remainders = _to_bytes((rest << np.uint64(widths.low % 64)) | low, (rest_bits + widths.low + 7) // 8)
    else:
        remainders = _to_bytes(rest, (rest_bits + 7) // 8) + _to_bytes(low, (widths.low + 7) // 8)
    small = np.minimum(part.count, 255).astype(np.uint8).tobytes()
    return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(last).tobytes(), remainders, small, large.tobytes()])


def pack(part: Counters, widths: Widths) -> list[tuple[int, bytes]]:
    """(section, packed keys) of each section that has any."""
    if not len(part):
        return []
    section = (part.high >> np.uint64(widths.high - widths.section)).astype(np.int64) if widths.section else np.zeros(len(part), dtype=np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, section[1:] != section[:-1])), len(part))
    return [(int(section[a]), _pack(Counters(part.high[a:b], part.low[a:b], part.count[a:b]), widths)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def unpack(section: int, data: bytes, widths: Widths) -> Counters:
    n, slot_bits, n_large = (int(x) for x in np.frombuffer(data, dtype="<i8", count=3))
    inside = widths.high - widths.section
    rest_bits = inside - slot_bits
    at = 24

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, dtype=np.uint8, count=size, offset=at - size)

    occupied = np.flatnonzero(np.unpackbits(take(((1 << slot_bits) + 7) // 8)))
    last = np.unpackbits(take((n + 7) // 8), count=n)
    # the run that a key is in is the number of runs that ended before it
    slot = occupied[np.cumsum(last) - last].astype(np.uint64)
    if rest_bits + widths.low <= 64:
        width = (rest_bits + widths.low + 7) // 8
        both = _from_bytes(take(n * width), width)
        rest, low = (both >> np.uint64(widths.low) if rest_bits else np.zeros(n, dtype=np.uint64)), both & _mask(widths.low)
    else:
        rest, low = (_from_bytes(take(n * ((bits + 7) // 8)), (bits + 7) // 8) for bits in (rest_bits, widths.low))
    count = take(n).astype(np.int64)
    count[count == 255] = np.frombuffer(data, dtype="<i8", count=n_large, offset=at)
    top = np.uint64(section << inside)
    return Counters(top | (slot << np.uint64(rest_bits)) | rest, low, count)
