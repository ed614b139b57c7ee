"""Words of a batch of texts as flat arrays: where they stand and 64-bit hashes of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEGMENT_BYTES = 1 << 18
U = np.uint64

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, np.uint64)
_ODD = _RANDOM.integers(1, 2**63, 8, np.uint64) | U(1)
_POWER = _ODD[0]

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
# Everything but ASCII letters and digits parts words here; bytes of longer characters do not.
MARK = np.ones(256, bool)
MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32


def scramble(values: np.ndarray, turn: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes all bits."""
    values = values ^ (values >> U(32))
    values = values * _ODD[1 + turn]
    return values ^ (values >> U(29))


@dataclass
class Words:
    """``data``: the bytes of all texts; ``start``, ``end``: of each word in them; ``key``: its
    hash; ``more``: a second one, if asked for; words ``first[i]`` up to ``first[i + 1]`` belong to
    text ``i``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    first: np.ndarray
    more: np.ndarray | None = None


def words_of(
    texts: list[str], apart: np.ndarray = BLANK, lower: bool = False, more: bool = False
) -> Words:
    """Words are longest runs of bytes not in ``apart`` (which holds the line feed).

    Each byte is mixed with its place in the word before the sum, so that no word, however regular,
    has the sum of another by rule.
    """
    encoded = [t.encode() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in encoded])
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    table = (_BYTE[_LOWER] if lower else _BYTE).copy()
    starts, stops, keys, others = [], [], [], []
    begin = 0
    while begin < len(data):
        end = min(begin + SEGMENT_BYTES, len(data))
        while end < len(data) and not apart[data[end - 1]]:
            ahead = np.flatnonzero(apart[data[end : end + SEGMENT_BYTES]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + SEGMENT_BYTES, len(data))
        part = data[begin:end]
        gap = apart[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
        start, stop = edge[0::2], edge[1::2]
        if len(start):
            words = part[start[0] : stop[-1]]
            at = start - start[0]
            place = np.arange(len(words)) - np.repeat(at, np.diff(np.append(at, len(words))))
            value = scramble(table[words] + place.view(np.uint64) * _ODD[7])
            value[gap[start[0] : stop[-1]]] = 0
            starts.append(start + begin)
            stops.append(stop + begin)
            keys.append(scramble(np.add.reduceat(value, at)))
            if more:
                # Bytes between words are 0 and stay so.
                others.append(scramble(np.add.reduceat(scramble(value, 5), at), 4))
        begin = end
    if not starts:
        empty = np.zeros(0, np.int64)
        none = np.zeros(0, np.uint64)
        return Words(data, empty, empty, none, np.zeros(len(texts) + 1, np.int64), none)
    start = np.concatenate(starts)
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    return Words(data, start, np.concatenate(stops), np.concatenate(keys), first,
                 np.concatenate(others) if more else None)


def shingles(keys: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words; of all words as one if they are fewer."""
    if len(keys) < size:
        size = len(keys)
    if not size:
        return np.zeros(0, np.uint64)
    n = len(keys) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = (total + keys[i : i + n]) * _ODD[6]
    return scramble(total + U(size), 2)


def stems(words: Words, lengths: tuple[int, ...], lower: bool = True) -> list[np.ndarray]:
    """Hashes of the first bytes of every word, per length; 0 where a word is shorter."""
    table = _BYTE[_LOWER] if lower else _BYTE
    size = words.end - words.start
    total = np.zeros(len(size), np.uint64)
    out = []
    for i in range(max(lengths)):
        at = np.minimum(words.start + i, len(words.data) - 1)
        total = total * _POWER + table[words.data[at]]
        if i + 1 in lengths:
            out.append(np.where(size > i, scramble(total + U(i), 4), U(0)))
    return out
