"""Word and word-shingle hashes of many texts at once, computed on their bytes.

A word is a run of ASCII letters and digits and of all bytes from 0x80 (so of all characters beyond ASCII); A-Z
count as a-z. Hashes are the same in every process.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BYTES = np.arange(256)
_IS_WORD = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)
_FOLDED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES | 32, _BYTES).astype(np.uint64) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(64)], np.uint64)
_powers: dict[int, np.ndarray] = {}


#: Bytes that are hashed at a time, so that memory doesn't grow with a text.
BLOCK = 1 << 20
#: Words of more bytes get a cryptographic hash: polynomial ones confuse some long words, whatever their base.
LONG = 256


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1 mod 2**64; n up to BLOCK + LONG."""
    if base not in _powers:
        out = np.full(BLOCK + LONG, base, np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every bit of a hash depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end) of data, in order and apart; value: what each byte counts as."""
    out = np.zeros(len(starts), np.uint64)
    short = np.flatnonzero(ends - starts <= LONG)
    at = 0
    while at < len(short):
        low = starts[short[at]]
        to = int(np.searchsorted(ends[short], low + BLOCK, side="right"))
        some = short[at:to]
        stretch = data[low : ends[some[-1]]]
        total = np.zeros(len(stretch) + 1, np.uint64)
        np.cumsum(value[stretch] * _power(_BASE, len(stretch)), out=total[1:])
        out[some] = mix((total[ends[some] - low] - total[starts[some] - low]) * _power(_INVERSE, len(stretch))[starts[some] - low])
        at = to
    for i in np.flatnonzero(ends - starts > LONG):
        folded = value[data[starts[i] : ends[i]]].astype("<u2").tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(folded, digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 places in them where each text's words start."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    last = first[1:] - 1
    ends[last] = inside[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return span_hashes(data, starts, ends, _FOLDED), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words and where each text's start. A text of fewer words, but one at least, has one."""
    n = np.diff(at)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    runs = np.zeros(len(hashes), np.uint64)
    for i in range(width):
        runs += padded[i : i + len(hashes)] * _PLACE[i]
    for k in np.flatnonzero((n > 0) & (n < width)):
        runs[at[k]] = (hashes[at[k] : at[k + 1]] * _PLACE[: n[k]]).sum(dtype=np.uint64)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(counts)])
    keep = np.repeat(at[:-1] - to[:-1], counts) + np.arange(to[-1])
    return mix(runs[keep]), to


def distinct(runs: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes, of all their 64 bits."""
    return [np.unique(runs[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
