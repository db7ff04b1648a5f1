"""A bitmap that keeps rows whose id may be in a set, before a join does it exactly.

It spares the join the shuffle of texts that have no partner, lets some other rows pass,
and never drops one of the set. Eight bits an id or more, 2^27 bits (16 MB) at most; for
more ids than it could tell apart there is no bitmap and the join alone decides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.workers import mapped

LEAST_BITS, MOST_BITS = 16, 27


def place(column: str, bits: int) -> F.Column:
    return F.xxhash64(column).bitwiseAND((1 << bits) - 1)


def bitmap(ids: DataFrame, place: Callable[[str, int], F.Column] = place) -> tuple[np.ndarray, int] | None:
    """(64-bit words, bits) for the one column of ids; None for too many. place: which bit is whose."""
    n = ids.count()
    bits = max(LEAST_BITS, (8 * n).bit_length())
    if bits > MOST_BITS:
        bits = MOST_BITS
        if n > 1 << (MOST_BITS - 1):
            return None
    h = place(ids.columns[0], bits)
    words = ids.select(F.shiftright(h, 6).alias("w"), F.expr("1L").alias("one"), h.alias("h"))
    words = words.select("w", F.expr("shiftleft(one, cast(h & 63 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return table, bits


def holds(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1


def keep_listed(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows whose ``key`` is in the one column of ids, and some others."""
    made = bitmap(ids)
    if made is None:
        return rows
    sent = rows.sparkSession.sparkContext.broadcast(made[0])
    names = rows.columns

    def keep(batches):
        for b in batches:
            out = b.filter(pa.array(holds(sent.value, b.column(len(names)).to_numpy())))
            if out.num_rows:
                yield pa.RecordBatch.from_arrays(out.columns[: len(names)], names=names)

    return rows.withColumn("idfilter_place", place(key, made[1])).transform(mapped, keep, rows.schema)
