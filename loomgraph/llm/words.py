"""Words of many texts at a time, as places in their bytes instead of Python strings.

Words end where str.split() ends them. Most are plain: letters of one or two bytes, none
three times in a row, once ASCII signs at both ends are cut off. Those are told apart by
their bytes, so that a caller makes Python objects of distinct words, or of those that
begin like the ones it looks for, alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

GROUP = 4_000_000  # characters of a group of texts; a longer text is a group of its own
SIGNS = ".,;:!?\"'()[]{}<>*-_~#%&/\\|+=`^"  # cut off plain words
STEP = 1 << 18  # words whose bytes are gathered at once
HEAD = 8  # bytes of a word that Beginnings looks at
_SLOTS = 20  # bits of a slot in the tables of Beginnings

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_SIGN = np.zeros(256, np.int8)
_SIGN[list(SIGNS.encode())] = 1
_TWO = np.array([192 <= b < 224 for b in range(256)])
_LETTER2 = np.array([chr(c).isalpha() for c in range(2048)])
_WHITE = np.array([b < 128 and chr(b).isspace() for b in range(256)])
#: White space of two and of three bytes; four-byte characters are none.
_WIDE = [
    (n, np.array([int.from_bytes(c.encode(), "big") for c in map(chr, range(128, 0xD800)) if c.isspace() and len(c.encode()) == n], np.int32)) for n in (2, 3)
]
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(HEAD + 1)], np.uint64)  # masks of the first bytes
_LEAD = np.zeros(256, bool)
for _n, _codes in _WIDE:
    _LEAD[_codes >> 8 * (_n - 1)] = True


def groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """The texts in lists of about GROUP characters; null as empty."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from each start to its end, as an Arrow string column."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    chosen = np.empty(offsets[-1], np.uint8)
    for i in range(0, len(size), STEP):
        own = offsets[i : i + STEP + 1]
        chosen[own[0] : own[-1]] = data[np.arange(own[0], own[-1]) + np.repeat(start[i : i + STEP] - own[:-1], size[i : i + STEP])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(chosen))


def _distinct(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct values, for each row which)."""
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


class Words:
    """Words of lower-case texts: begin and end in ``data``, number of the text; words of a text in their order.

    from_, to: the same without SIGNS at the ends, for plain words.
    """

    def __init__(self, texts: list[str]):
        parts = [t.encode() for t in texts]
        self.data = data = np.frombuffer(b"\n".join([b"", *parts, b"\n" * HEAD]), np.uint8)
        white = _WHITE[data]
        lead = np.flatnonzero(_LEAD[data])
        if len(lead):
            code = data[lead].astype(np.int32) << 16 | data[lead + 1].astype(np.int32) << 8 | data[lead + 2]
            for n, codes in _WIDE:
                at = lead[np.isin(code >> 8 * (3 - n), codes)]
                for k in range(n):
                    white[at + k] = True
        turns = np.flatnonzero(white[1:] != white[:-1]) + 1
        small = np.int32 if len(data) < 1 << 31 else np.int64
        self.start, self.end = start, end = turns[::2].astype(small), turns[1::2].astype(small)
        begins = np.cumsum([1] + [len(p) + 1 for p in parts])
        del white, turns, parts
        self.bounds = np.searchsorted(start, begins.astype(small))  # of each text's words
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.bounds))
        before = self._others()
        self.from_, self.to = start.copy(), end.copy()
        for _ in range(3):
            self.from_ += _SIGN[data[self.from_]] & (self.from_ < end)
        for _ in range(3):
            self.to -= _SIGN[data[self.to - 1]] & (self.from_ < self.to)
        self.plain = (self.from_ < self.to) & (before[self.from_] == before[self.to])

    def _others(self) -> np.ndarray:
        """For each place how many bytes before it no plain word has."""
        data = self.data
        other = ~_LETTER[data]
        same = data[1:] == data[:-1]
        other[:-2] |= same[1:] & same[:-1]
        two = np.flatnonzero(_TWO[data])
        code = (data[two] & 31).astype(np.int32) << 6 | data[two + 1] & 63
        letter = _LETTER2[code]
        letter[:-2] &= (code[2:] != code[1:-1]) | (code[1:-1] != code[:-2]) | (two[2:] - two[:-2] > 4)
        other[two] = ~letter
        other[two[letter] + 1] = False
        before = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(other, out=before[1:])
        return before

    def heads(self) -> np.ndarray:
        """The first HEAD bytes of each plain word, zeros behind shorter ones; no meaning for others."""
        every = np.ndarray(len(self.data) - HEAD + 1, "<u8", self.data, strides=(1,))
        return every[self.from_] & _FIRST[np.clip(self.to - self.from_, 0, HEAD)]

    def pairs(self, clean: Callable[[str], str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct clean words that are not empty, pairs: number of a text, which word it has); each pair once, plain words are clean."""
        plain, other = np.flatnonzero(self.plain), np.flatnonzero(~self.plain)
        found, which = _distinct(strings(self.data, self.from_[plain], self.to[plain]))
        rest, which_rest = _distinct(strings(self.data, self.start[other], self.end[other]))
        cleaned = pa.array([clean(w) for w in rest.to_pylist()], pa.large_string())
        words, code = _distinct(pa.concat_arrays([found, cleaned, pa.array([""], pa.large_string())]))
        text = np.concatenate([self.text[plain], self.text[other]])
        word = np.concatenate([code[which], code[len(found) + which_rest]])
        empty = code[-1]
        text, word = once(text[word != empty], word[word != empty], len(words))
        return words.take(pa.array(np.delete(np.arange(len(words)), empty))), text, word - (word > empty)


def once(text: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without repetitions; n: items there may be."""
    both = np.sort(text.astype(np.int64) * n + item)
    both = both[np.insert(both[1:] != both[:-1], 0, True)] if len(both) else both
    return both // max(n, 1), both % max(n, 1)


class Beginnings:
    """Tells plain words that begin like one of some strings, or may be one of some words; others pass by chance, in no great number."""

    def __init__(self, beginnings: Iterable[str], words: Iterable[str]):
        found: dict[int, set[bytes]] = {HEAD: {w.encode()[:HEAD] for w in words}}
        for b in map(str.encode, beginnings):
            found.setdefault(min(len(b), HEAD), set()).add(b[:HEAD])
        self.tables = []
        for n, keys in found.items():
            table = np.zeros(1 << _SLOTS, bool)
            table[_slots(np.array([int.from_bytes(k, "little") for k in keys], np.uint64))] = True
            self.tables.append((_FIRST[n], table))

    def may(self, words: Words) -> np.ndarray:
        """Whether a word may be looked for: all that are not plain are."""
        heads, out = words.heads(), ~words.plain
        for mask, table in self.tables:
            out |= table[_slots(heads & mask)]
        return out


def _slots(keys: np.ndarray) -> np.ndarray:
    return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOTS)
