"""Word and word-run hashes of many texts at once, with numpy.

A *block* is the texts of one Arrow batch laid end to end. Every function here
works on whole blocks, so the cost per word is a few vector operations and no
Python loop runs per word. Hashes are 64 bits wide; the same words give the
same hash in every task.

A word's hash is multilinear: each byte's value times the multiplier of its
place in the word. Multipliers have no relation to each other (the powers of a
base modulo 2**64 would make long patterns of two letters collide).
"""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN_BASE = np.uint64(0xD6E8FEB86659FD93)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

# Byte classes: True where a byte belongs to a word.
_NONSPACE = np.ones(256, dtype=bool)
_NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[0x30:0x3A] = True
_ALNUM[0x61:0x7B] = True
_ALNUM[0x80:] = True
#: Lower-cases A-Z alone.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: Bytes that are hashed at a time.
STRETCH = 1 << 16
#: Words of more bytes have another hash.
LONG = 1 << 16

_powers: dict[str, np.ndarray] = {}


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", int(_BASE)), ("q", _inverse(int(_BASE)))):
            steps = np.full(size, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


#: The value of each byte in a hash.
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _RUN_BASE)


def _multipliers() -> np.ndarray:
    if "m" not in _powers:
        _powers["m"] = mix(np.arange(1, LONG + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    return _powers["m"]


class Words:
    """The words of a block: `hash`, byte `start` and `end` in `data`, and
    `first`, an offset for each text (and one past the last) into those."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, member: np.ndarray):
        inside = member[data]
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[0] = len(data) > 0 and inside[0]
        edge[-1] = len(data) > 0 and inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        at = np.flatnonzero(edge)
        self.data, self.start, self.end = data, at[0::2], at[1::2]
        # No word spans two texts: texts are separated by a byte outside words.
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, a stretch of bounded length at a time."""
        out = np.empty(len(self.start), dtype=np.uint64)
        size = self.end - self.start
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self.data[self.start[k] : self.end[k]], digest_size=8).digest(), "little")
        short = np.flatnonzero(size <= LONG)
        start, size = self.start[short], size[short]
        ends, i = start + size, 0
        while i < len(short):
            j = max(i + 1, int(np.searchsorted(ends, start[i] + STRETCH, "right")))
            out[short[i:j]] = self._hashes(start[i:j], size[i:j])
            i = j
        return out

    def _hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        size = size.astype(np.int32)
        begin = np.cumsum(size, dtype=np.int32) - size
        at = np.arange(begin[-1] + size[-1], dtype=np.int32)
        place = at - np.repeat(begin, size)
        data = self.data[start[0] : start[-1] + size[-1]]
        values = _VALUES[data[np.repeat((start - start[0]).astype(np.int32) - begin, size) + at]]
        values *= _multipliers()[place]
        return mix(np.add.reduceat(values, begin) ^ (size.astype(np.uint64) * _MIX2))


def block(texts: list[bytes | None], kind: str = "nonspace") -> Words:
    """Words of these texts. kind: "nonspace" (bytes other than space and
    0x09-0x0D, unchanged) or "alnum" (A-Z lower-cased, then digits, a-z and all
    that is not ASCII). "lower" is "nonspace" after lower-casing A-Z. A null
    text has no words."""
    joined = b"\n".join([t or b"" for t in texts]) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    if kind != "nonspace":
        data = _LOWER[data]
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return Words(data, ends, _ALNUM if kind == "alnum" else _NONSPACE)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words: element i covers words i .. i+k-1.
    Runs that cross into the next text are for the caller to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _RUN_BASE
        out += h[j : j + n]
    return mix(out)


def run_owner(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which starts of k-word runs lie wholly in one text: (start, text)."""
    lengths = np.maximum(np.diff(first) - (k - 1), 0)
    text = np.repeat(np.arange(len(lengths)), lengths)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return first[:-1][text] + offset, text


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the elements start .. end-1 of each span, of any lengths. h:
    hashes of runs of several words, so that no long pattern of two elements
    makes hashes of different spans equal."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        # Spans come in ascending order of start, and of end.
        j = max(i + 1, int(np.searchsorted(end, start[i] + STRETCH, "right")))
        base = start[i]
        words = h[base : end[j - 1]]
        up, down = _power_tables(len(words) + 1)
        sums = np.empty(len(words) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(words * up[: len(words)], out=sums[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * down[a] ^ ((b - a).astype(np.uint64) * _MIX1))
        i = j
    return out
