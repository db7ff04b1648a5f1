"""Packing into fixed-length sequences by harmonic classes.

Class k holds pieces of exactly floor(C / k) tokens, k to a bin (C: capacity). Every
document is cut greedily into the largest class lengths that fit: whole sequences first,
then its rest. As all pieces of a class have one length, the place of a piece follows from
its number in the class alone: bin = number div k, offset = (number mod k) * length.
Workers number their own pieces; only the counts of each (worker, class) are summed to
give every worker its first number, so bins fill independently and no task sees a group.

What is left over, at most k - 1 pieces of each class (a number that depends on C alone,
not on the data), is packed longest first into the fullest bin that has room.

Defined results: null text counts as empty; a document always has its end id, so no
document is without a piece; null keys are dropped; repeated rows are packed once each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.encode import ROOM, encoder, resolve
from loomgraph.llm.token_store import _schema
from loomgraph.llm.workers import mapped
from loomgraph.scratch import materialize

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, number long"
LEFT = "length long, rank long, sequence_id long, offset long"


def class_lengths(capacity: int) -> np.ndarray:
    """Distinct floor(capacity / k), ascending."""
    return np.unique(capacity // np.arange(1, capacity + 1))


def cut(total: int, capacity: int, lengths: np.ndarray) -> list[int]:
    whole, rest = divmod(total, capacity)
    out = [capacity] * whole
    while rest:
        out.append(int(lengths[np.searchsorted(lengths, rest, side="right") - 1]))
        rest -= out[-1]
    return out


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text", room: int = ROOM) -> DataFrame:
    vocabulary = resolve(vocabulary)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")

    def encode(batches):
        from pyspark import TaskContext

        worker, enc, lengths, end = TaskContext.get().partitionId(), encoder(vocabulary, room), class_lengths(capacity), struct.pack("<I", end_id)
        numbers: dict[int, int] = {}
        for b in batches:
            out: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist())):
                ids += end
                total, at = len(ids) // 4, 0
                for n in cut(total, capacity, lengths):
                    number = numbers.get(n, 0)
                    numbers[n] = number + 1
                    out.append((doc, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total, worker, number))
                    at += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _schema(PIECES))], schema=_schema(PIECES))

    return rows.transform(mapped, encode, PIECES, keeps="encode")


def pack_left(left: list[tuple[int, int]], capacity: int, first: int) -> list[tuple[int, int, int, int]]:
    """(length, rank) -> (length, rank, sequence, offset): longest first, into the fullest bin that has room."""
    from bisect import bisect_left, insort

    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    used, out = [], []
    for n, rank in sorted(left, key=lambda x: (-x[0], x[1])):
        i = bisect_left(rooms, (n, -1))
        if i < len(rooms):
            room, b = rooms.pop(i)
        else:
            room, b = capacity, len(used)
            used.append(0)
        out.append((n, rank, first + b, used[b]))
        used[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096, room: int = ROOM) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. room: chunks that a worker remembers."""
    spark = docs.sparkSession
    made = materialize(pieces(docs, vocabulary, end_id, capacity, room=room), "pieces")
    counts = made.groupBy("length", "worker").agg(F.count("*").alias("n"))
    base = F.sum("n").over(Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "worker", F.coalesce(base, F.lit(0)).alias("base"))
    totals = sorted((r.length, r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect())
    classes, left, first = [], [], 0
    for length, n in totals:  # one row a class: as many as the capacity has classes
        k = capacity // length
        classes.append((length, k, first, n // k * k))
        left += [(length, r) for r in range(n // k * k, n)]
        first += n // k
    if not totals:
        return spark.createDataFrame([], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    by_class = F.broadcast(spark.createDataFrame(classes, "length long, k long, first long, full long"))
    placed_left = F.broadcast(spark.createDataFrame(pack_left(left, capacity, first), LEFT))
    ranked = made.join(bases, ["length", "worker"]).join(by_class, "length").withColumn("rank", F.col("base") + F.col("number"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = ranked.where("rank < full").select(
        *columns, (F.col("first") + F.floor(F.col("rank") / F.col("k"))).alias("sequence_id"), ((F.col("rank") % F.col("k")) * F.col("length")).alias("offset")
    )
    rest = ranked.where("rank >= full").join(placed_left, ["length", "rank"]).select(*columns, "sequence_id", "offset")
    return full.unionByName(rest)


def op7_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary, end_id=2)
