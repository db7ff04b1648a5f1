"""Hybrid chunking: paragraphs and packed lines, long pieces split, short ones joined, metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip, word_count

#: Separators in order of preference, and marks to end a fixed-size piece at.
SEPARATORS = ["。", "？", "！", "\n\n", "\n", "；", "，"]
MARKS = frozenset("。？！；，.?!;,")


@dataclass(frozen=True)
class ChunkConfig:
    max_size: int = 1000
    min_size: int = 200
    overlap: int = 50  # accepted for compatibility; no step uses it
    separators: tuple[str, ...] = tuple(SEPARATORS)


def fold_pieces(pieces: Iterator[str], most: int, glue: str) -> list[str]:
    """Greedy packing: pieces join while the result with its glue stays within ``most``."""
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) + len(glue) + len(p) <= most:
            out[-1] += glue + p
        else:
            out.append(p)
    return out


def paragraphs(text: str, c: ChunkConfig) -> Iterator[str]:
    for block in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        if len(block) <= c.max_size:
            yield block
        else:
            yield from fold_pieces(filter(None, map(str.strip, block.split("\n"))), c.max_size, "\n")


def _by_separator(piece: str, sep: str, most: int) -> list[str]:
    parts = piece.split(sep)
    ends = [sep] * (len(parts) - 1) + [""]
    return fold_pieces((p.strip() + e for p, e in zip(parts, ends) if p.strip()), most, "")


def _split_at(text: str, start: int, end: int) -> int:
    if end >= len(text):
        return end
    for good in (MARKS.__contains__, str.isspace):
        at = next((i for i in range(end, start, -1) if good(text[i])), None)
        if at is not None:
            return at + 1
    return end


def split_long(piece: str, c: ChunkConfig) -> list[str]:
    for sep in c.separators:
        if sep in piece:
            parts = _by_separator(piece, sep, c.max_size)
            if all(len(p) <= c.max_size for p in parts):
                return parts
    out, start = [], 0
    while start < len(piece):
        stop = _split_at(piece, start, min(start + c.max_size, len(piece)))
        if part := piece[start:stop].strip():
            out.append(part)
        start = stop
    return out


def chunk_text(text: str | None, c: ChunkConfig = ChunkConfig()) -> list[str]:
    out: list[str] = []
    for piece in paragraphs(text or "", c):
        if len(piece) > c.max_size:
            out += split_long(piece, c)
        elif len(piece) >= c.min_size or not out or len(out[-1]) + len(piece) > c.max_size:
            out.append(piece)
        else:  # the line break is not counted: one character more than max_size is possible
            out[-1] += "\n" + piece
    return out


def hybrid_chunks(docs: DataFrame, key: str, text: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(key, src_id, text) of every chunk; the scan is stateful within one document only."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunk_text(t, config))

    return docs.select(key, F.posexplode(cut(text)).alias("pos", "text")).select(key, (F.col("pos") + 1).cast("long").alias("src_id"), "text")


def line_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, src_id, text) of the stripped lines that are not blank; no Python."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda t: t != "")
    return docs.select(key, F.posexplode(lines).alias("pos", "text")).select(key, (F.col("pos") + 1).cast("long").alias("src_id"), "text")


def with_metadata(chunks: DataFrame, key: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Adds char_count, word_count, position_ratio and is_optimal_size."""
    n = F.length("text").cast("long")
    whole = Window.partitionBy(key)
    before = F.coalesce(F.sum("char_count").over(whole.orderBy("src_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("char_count").over(whole)
    counted = chunks.withColumns({"char_count": n, "word_count": word_count("text"), "is_optimal_size": n.between(config.min_size, config.max_size)})
    return counted.withColumn("position_ratio", F.when(total > 0, before / F.when(total > 0, total)).otherwise(0.0))
