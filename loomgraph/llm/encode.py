"""Whole-text encoding with the tokenizers library, remembered by chunk.

A text is cut only where the tokenizer itself always cuts, so the joined ids equal those
of one encode() call over the whole text:

* byte-level BPE: between a non-space character and a following space or newline, and
  between an ASCII letter and a following ASCII sign or digit. Texts with any other white
  space (where such a place may lie inside a run) are encoded whole.
* word-end BPE, which drops white space: at every space and newline.

Texts that hold a special token's string are encoded whole, as the library treats it.
Chunks are cut, counted and looked up as Arrow strings, many texts at a time; only those
that are not remembered become Python objects. The memory has two generations of about
half the room each: chunks asked again stay.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomgraph.llm.columns import string_buffers
from loomgraph.llm.workers import remembers

#: White space for which the library's pattern and ours could differ on where a run ends.
SPACES = [9, 11, 12, 13, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
OTHER_SPACE = re.compile("[" + "".join(map(chr, SPACES)) + "]")
ROOM = 600_000
#: The settings under which the cuts below hold.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: Below this code point, letters, digits and case are the same in every Unicode version.
STABLE = "\u0250"
#: The pattern by which the word-end tokenizer cuts.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
GROUP_CHARS, CALL_CHUNKS = 1 << 23, 1000
SPACE, NEWLINE = b" \n"
LETTER, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
SIGN[[c for c in range(33, 127) if not chr(c).isalpha()]] = True
WORD_END = "</w>"


class Encoder:
    """encode(text) -> ids as little-endian unsigned 32-bit integers; encode_all() is faster.

    Chunks not remembered are encoded many at a time, as one string: its ids fall to the
    chunks by the tokens' lengths in bytes, which must add up to the chunk's at its end.
    For the word-end tokenizer that string is put into lower case here and needs none of
    its normalizer, as the chunks' letters are stable and single spaces part them.
    """

    def __init__(self, path: str, room: int = ROOM):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(Path(path).read_text())
        before, normal = parts["pre_tokenizer"], parts["normalizer"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space = before == BYTE_LEVEL and normal is None
        drops_space = normal == LOWER and before["type"] == "Sequence" and before["pretokenizers"][0].get("pattern") == {"Regex": WORD_PATTERN}
        if not (self.keeps_space or drops_space):
            raise ValueError(f"{path}: neither of the two kinds whose cuts are known")
        self.plain = self.tokenizer if self.keeps_space else Tokenizer.from_str(json.dumps(parts | {"normalizer": None}))
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # byte-level letters: one a byte
            self.bytes_of[i] = len(token.removesuffix(WORD_END)) if drops_space else len(token)
        self.half = room // 2
        self.known, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.uint32)  # chunks; the ids of all
        self.start, self.length, self.asked = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def whole(self, text: str) -> bytes:
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _joins(self, chunk: str) -> bool:
        """The chunk may stand in a string of chunks: it begins where the tokenizer surely cuts, and its bytes are known."""
        if self.keeps_space:
            return chunk[0] in " \n" and not chunk.isspace()
        return (chunk.isascii() and chunk.isprintable()) or (max(chunk) < STABLE and not OTHER_SPACE.search(chunk))

    def _cut(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of a column, and for each text, and the end, the number of its first chunk."""
        data, offsets = string_buffers(column)
        data = data[: offsets[-1]]
        space = (data == SPACE) | (data == NEWLINE)
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        if self.keeps_space:
            begins[1:] |= SIGN[data[1:]] & LETTER[data[:-1]]
        else:
            data = np.where(space, np.uint8(SPACE), data)
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.append(np.flatnonzero(begins), len(data))
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)), np.searchsorted(at, offsets)

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many each chunk has, the chunks' numbers in that order)."""
        if not self.keeps_space:
            chunks = [c.lstrip(" ") for c in chunks]
        joins = np.array([c != "" and self._joins(c) for c in chunks], bool)
        order = np.argsort(~joins, kind="stable")
        joined, apart = [chunks[i] for i in np.flatnonzero(joins)], [chunks[i] for i in np.flatnonzero(~joins)]
        codes, lengths = [], []

        def singly(some: list[str]) -> None:
            own = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            codes.extend(np.array(c, np.uint32) for c in own)
            lengths.append(np.array([len(c) for c in own], np.int64))

        for k in range(0, len(joined), CALL_CHUNKS):
            some = joined[k : k + CALL_CHUNKS]
            text = "".join(some) if self.keeps_space else " ".join(some).lower()
            stands = some if self.keeps_space else text.split(" ")
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in stands])
            at = np.cumsum(self.bytes_of[ids])
            stop = np.searchsorted(at, ends) + 1
            if len(stop) != len(some) or stop[-1] != len(ids) or (at[stop - 1] != ends).any():  # tokens that do not end where chunks do
                singly(some)
            else:
                codes.append(ids)
                lengths.append(np.diff(stop, prepend=0))
        singly(apart)
        return np.concatenate([np.zeros(0, np.uint32), *codes]), np.concatenate(lengths), order

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these places, joined, and where each place's begin and the last's end."""
        n = self.length[slots]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.start[slots] - ends[:-1], n)
        at += np.arange(ends[-1])
        return self.ids[at], ends

    def _slots(self, distinct: pa.Array) -> np.ndarray:
        """Places of chunks in the memory, those learned now included."""
        if np.count_nonzero(self.asked) > self.half:  # a generation ends: what was not asked in it goes
            keep = np.flatnonzero(self.asked)
            self.ids, ends = self._gather(keep)
            self.known, self.start, self.length = self.known.take(pa.array(keep)), ends[:-1], self.length[keep]
            self.asked = np.zeros(len(keep), bool)
        slots = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        lacking = np.flatnonzero(slots < 0)
        if len(lacking):
            ids, lengths, order = self._learn(distinct.take(pa.array(lacking)).to_pylist())
            lacking = lacking[order]
            slots[lacking] = len(self.known) + np.arange(len(lacking))
            self.known = pa.concat_arrays([self.known, distinct.take(pa.array(lacking))])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lengths) - lengths])
            self.ids, self.length = np.concatenate([self.ids, ids]), np.concatenate([self.length, lengths])
            self.asked = np.concatenate([self.asked, np.zeros(len(lacking), bool)])
        self.asked[slots] = True
        return slots

    def _group(self, texts: list[str]) -> list[bytes]:
        whole = [any(s in t for s in self.special) or (self.keeps_space and bool(OTHER_SPACE.search(t))) for t in texts]
        chunks, first = self._cut(pa.array(["" if w else t for t, w in zip(texts, whole)], pa.large_string()))
        counted = chunks.dictionary_encode()
        ids, ends = self._gather(self._slots(counted.dictionary)[counted.indices.to_numpy()])
        at = ends[first].tolist()
        return [self.whole(t) if w else ids[x:y].tobytes() for t, w, x, y in zip(texts, whole, at, at[1:])]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def encode(self, text: str) -> bytes:
        return self._group([text])[0]


@lru_cache(maxsize=1)
def encoder(path: str, room: int = ROOM) -> Encoder:
    return Encoder(path, room)


remembers("encode", encoder.cache_clear)


def resolve(name_or_path: str) -> str:
    """A vocabulary file by path, or by its name among the installed public ones."""
    import os

    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)
