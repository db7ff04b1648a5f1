"""Words of many texts at once, each as a 64-bit hash, with numpy over the raw bytes.

A word is read in lanes of eight bytes, each mixed into the hash of those before it, so
words of one length up to eight bytes never share a hash and others do by chance only;
longer words than LONG bytes go through blake2b. Seeds are fixed, so every worker makes
equal hashes; another seed gives an independent hash of the same words.
"""

from __future__ import annotations

import hashlib

import numpy as np

from loomgraph.llm.perfect_hash import mix

BASE = 0x9E3779B97F4A7C15
LONG = 64
#: Words are what lies between these bytes.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Words are made of digits, letters a-z and all that is not ASCII; case is folded before.
NOT_ALNUM = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def lane_hashes(folded: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the byte runs [begin, end) of ``folded``."""
    padded = np.concatenate([folded, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(folded) + 1, "<u8", padded, strides=(1,))
    left = end - begin
    out = mix(left.astype(np.uint64), seed)
    at, own = begin, np.flatnonzero(left <= LONG)
    if len(own) < len(begin):
        key = seed.to_bytes(8, "little")
        for i in np.flatnonzero(left > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(folded[begin[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
        at, left = begin[own], left[own]
    while len(own):
        short = np.uint64(8) * np.maximum(8 - left, 0).astype(np.uint64)
        out[own] = mix(out[own] ^ ((lanes[at] << short) >> short), seed + 1)
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    return out


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, hashed: bool = True, seed: int = 3):
    """(begin, end, row) of each word of the slab, and its hash; begin and end in slab bytes.

    separators: 256 booleans over folded bytes; no word crosses a row's end.
    """
    folded = FOLD[data]
    sep = separators[folded]
    first = np.ones(len(data), bool)
    first[1:] = sep[:-1]
    inner = offsets[1:-1]
    first[inner[inner < len(data)]] = True
    first &= ~sep
    last = np.ones(len(data) + 1, bool)
    last[:-1] = sep
    last[offsets] = True
    begin = np.flatnonzero(first)
    stop = np.flatnonzero(last)
    end = stop[np.searchsorted(stop, begin, side="right")] if len(begin) else begin
    row = np.searchsorted(offsets, begin, side="right") - 1
    if not hashed:
        return begin, end, row, None
    return begin, end, row, lane_hashes(folded, begin, end, seed)


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words (fewer rows than words by width - 1)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(BASE)
        out += hashes[i : i + n]
    return mix(out, 100 + width)


def shingle_rows(hashes: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct shingle hashes; a row of fewer words, but not none, is one shingle."""
    counts = np.bincount(row, minlength=n_rows)
    at = np.concatenate([[0], np.cumsum(counts)])
    runs = chain(hashes, width)
    out = []
    for i in range(n_rows):
        n = counts[i]
        if n >= width:
            out.append(np.unique(runs[at[i] : at[i] + n - width + 1]))
        elif n:
            out.append(chain(hashes[at[i] : at[i] + n], int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
