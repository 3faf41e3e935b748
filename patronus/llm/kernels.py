"""Words of whole Arrow text columns as numpy arrays: no Python object per word.

A batch is cut into blocks of whole documents; a block's UTF-8 bytes give the
word limits by table lookup (all separators are single bytes, so bytes decide as
characters would) and every word gets a 64-bit hash of its lower-cased bytes.
Byte-sized work runs in pieces, so a very long text needs memory for its words,
not eight times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed)) | _U(1)


@dataclass(frozen=True)
class Rule:
    """Which bytes belong to words; A-Z count as a-z."""
    separators: bytes

    @property
    def word(self) -> np.ndarray:
        out = np.ones(256, dtype=bool)
        out[list(self.separators)] = False
        return out


#: Words are what stands between white space.
BETWEEN_SPACES = Rule(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of digits, letters and all characters beyond ASCII.
LETTERS = Rule(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = constants(256, 7)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
    up = lambda b: np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, b, _U))])
    return up(base), up(inverse)


@dataclass
class Block:
    """Documents ``lo`` to ``hi`` of a batch: word hashes, their byte limits in
    ``data`` (lower-cased) and ``ptr``, the first word of each document."""
    lo: int
    hi: int
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    data: np.ndarray

    def word(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().decode("utf-8")


def blocks(texts: pa.Array, rule: Rule, max_bytes: int = 1 << 22) -> Iterator[Block]:
    """The words of every text of a batch (null: no words)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    is_word, lo = rule.word, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        yield _block(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], is_word, lo, hi)
        lo = hi


def _block(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray, lo: int, hi: int) -> Block:
    inside = is_word[raw]
    limit = np.zeros(len(raw) + 1, dtype=bool)
    limit[off] = True
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    starts = np.flatnonzero(inside & (limit[:-1] | ~before))
    ends = np.flatnonzero(inside & (limit[1:] | ~after)) + 1
    data = _LOWER[raw]
    hashes = np.empty(len(starts), dtype=_U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _PIECE, "right")))
        b0, b1 = starts[at], ends[to - 1]
        up, down = _powers(max(_PIECE, 1 << int(b1 - b0).bit_length()))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[data[b0:b1]] * up[:b1 - b0])])
        s, e = starts[at:to] - b0, ends[at:to] - b0
        hashes[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _U(_BASE))
        at = to
    return Block(lo, hi, hashes, starts, ends, np.searchsorted(starts, off), data)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = np.full(n, k * _BASE & (1 << 64) - 1, dtype=_U)
    for i, c in enumerate(constants(k, 11)):
        out += hashes[i:i + n] * c
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
