"""Cosine self-join, its components, and greedy semantic deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.scratch import materialize

BLOCK = 2048
#: Pivots, each the centre of a cell; at most so many vectors are sent to the workers.
PIVOTS = 256
#: Numbers of a batch that a worker deals out: vectors of one length, and the cells they visit.
PLACED = 1 << 20
#: Room for rounding in the angle bound.
SLACK = 1e-6
DEALT = "dim int, cell int, home boolean, id {kind}, v array<double>"


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of one length, from the Arrow buffer."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length one, which rows have a direction at all)."""
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return x[ok] / norm[ok][:, None], ok


def _parts(rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    most = max(1, most)
    return (rows[i : i + most] for i in range(0, len(rows), most))


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def cosine_pairs(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """(a, b, cosine) with a < b and cosine >= threshold, exactly.

    Each vector lives in the cell of its nearest pivot. Angles obey the triangle
    inequality, so a partner within the threshold's angle t lives in a cell whose pivot is
    at most 2 t further away than one's own: a vector visits those cells of smaller number,
    and no pair is lost or met twice. Within a cell, rows are dealt by hash into blocks of
    about ``block`` rows; a pair of blocks is one matrix product in one task. A high
    threshold leaves few visits; at a low one every pair of vectors is multiplied.

    Null, zero and non-finite vectors and null ids have no pairs, nor have vectors of
    different lengths; repeated ids pair with others once for each row.
    """
    v = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    v = v.where(~F.exists("v", lambda x: x.isNull()))
    kind = dict(v.dtypes)["id"]
    cells = min(PIVOTS, max(1, -(-v.count() // block)))
    centres: dict[int, np.ndarray] = {}
    if cells > 1:
        rows = [np.array(r.v) for r in v.orderBy(F.xxhash64("id"), "id").limit(cells).collect()]
        for dim in {len(r) for r in rows}:
            centres[dim] = _unit(np.array([r for r in rows if len(r) == dim]))[0]
    reach = 2 * float(np.arccos(np.clip(threshold, -1.0, 1.0))) + SLACK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.diff(b.column(1).offsets.to_numpy())
            for dim, at in ((dim, at) for dim in np.unique(dims).tolist() for at in _parts(np.flatnonzero(dims == dim), PLACED // (dim + PIVOTS))):
                x, ok = _unit(_matrix(b.column(1).take(pa.array(at)), dim))
                at = at[ok]
                if not len(at):
                    continue
                if dim in centres and len(centres[dim]):
                    angle = _angles(x, centres[dim])
                    own = angle.argmin(1)
                    row, cell = np.nonzero(angle <= angle.min(1)[:, None] + reach)
                    keep = cell <= own[row]
                    row, cell = row[keep], cell[keep]
                    home = cell == own[row]
                else:
                    row, cell, home = np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool)
                for part in _parts(np.arange(len(row)), PLACED // dim):
                    r = row[part]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * np.int32(dim)), pa.array(x[r].reshape(-1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(r), dim, np.int32)), pa.array(cell[part].astype(np.int32)), pa.array(home[part]), b.column(0).take(pa.array(at[r])), lists],
                        names=["dim", "cell", "home", "id", "v"],
                    )

    dealt = materialize(v.mapInArrow(place, DEALT.format(kind=kind)), "cells")
    counts = dealt.groupBy("dim", "cell").agg(
        F.ceil(F.sum(F.expr("int(home)")) / block).cast("int").alias("nh"), F.ceil(F.sum(F.expr("int(not home)")) / block).cast("int").alias("nv")
    ).where("nh > 0")
    own = dealt.join(counts, ["dim", "cell"]).withColumn("h", F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("nv"))).cast("int"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    spot = lambda visit, i, j: F.struct(F.lit(visit).alias("visit"), i.alias("i"), j.alias("j"))
    among = F.transform(upto("nh"), lambda o: spot(False, F.least("h", o), F.greatest("h", o)))
    received = F.transform(upto("nv"), lambda o: spot(True, o, F.col("h")))
    visiting = F.transform(upto("nh"), lambda o: spot(True, F.col("h"), o))
    spots = F.when(F.col("home"), F.concat(among, received)).otherwise(visiting)
    tasks = own.select("dim", "cell", "home", "id", "v", "h", F.explode(spots).alias("p")).select("dim", "cell", "p.visit", "p.i", "p.j", "home", "h", "id", "v")

    def product(table: pa.Table) -> pa.Table:
        dim, i, j, visit = (table.column(c)[0].as_py() for c in ("dim", "i", "j", "visit"))
        ids, at, home = table.column("id").to_numpy(), table.column("h").to_numpy(), table.column("home").to_numpy()
        x = _matrix(table.column("v"), dim)
        left = np.flatnonzero(~home if visit else at == i)
        right = np.flatnonzero(home if visit else at == j)
        c = x[left] @ x[right].T
        r, s = np.nonzero(c >= threshold)
        a, b, value = ids[left[r]], ids[right[s]], c[r, s]
        keep = a < b if not visit and i == j else a != b
        low, high = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
        kind_ = table.schema.field("id").type
        return pa.table({"a": pa.array(low, kind_), "b": pa.array(high, kind_), "cosine": pa.array(value[keep], pa.float64())})

    return tasks.groupBy("dim", "cell", "visit", "i", "j").applyInArrow(product, f"a {kind}, b {kind}, cosine double")


def similarity_classes(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "vector") -> DataFrame:
    """(id, component) of every vector; one without a partner is its own."""
    parts = connected_components(cosine_pairs(vectors, threshold, key, vector).select("a", "b"))
    ids = vectors.select(F.col(key).alias("id")).distinct()
    return ids.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _without_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to compare, ids that go at once) of (id, v): of equal vectors the smallest id alone is compared.

    A larger id with the same vector always goes: by the smallest, or by what made that one
    go. Copies so make no pairs, whose number is the square of theirs. Vectors without a
    direction, and ids of several rows, are left as they are.
    """
    rows = materialize(rows, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    plain = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()) & (square > 0) & (square < float("inf")) & ~F.isnan(square)
    once = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.first("v").alias("v")).where((F.col("n") == 1) & F.col("v").isNotNull() & plain)
    first = once.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(once.join(first.select("v", "least"), "v").where("id > least").select("id"), "copies")
    return rows.join(copies, "id", "left_anti"), copies


def greedy_dedup(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "vector", enabled: bool = True, max_rounds: int | None = None) -> DataFrame:
    """Ids kept when rows pass in id order and each goes if near one kept before.

    By rounds over the pairs: a row whose smaller partners are all decided and none kept is
    kept, and its larger partners go. A round settles every row without an undecided
    smaller partner, so all chains move at once. The smallest of the undecided rows always
    settles, so rounds go on until none is left; beyond max_rounds, where given, it raises.
    """
    ids = vectors.select(F.col(key).alias("id")).distinct()
    if not enabled:
        return ids
    own = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    gone = None
    if threshold <= 1 - SLACK:
        own, gone = _without_copies(own)
    pairs = materialize(cosine_pairs(own, threshold, "id", "v").select("a", "b"), "pairs")
    rounds = 0
    while not pairs.isEmpty():
        if rounds == max_rounds:
            raise RuntimeError(f"rows still undecided after {max_rounds} rounds")
        rounds += 1
        waiting = pairs.select(F.col("b").alias("id")).distinct()
        free = pairs.select(F.col("a").alias("id")).distinct().join(waiting, "id", "left_anti")
        out = materialize(pairs.join(free, pairs.a == free.id, "left_semi").select(F.col("b").alias("id")).distinct(), "gone")
        gone = out if gone is None else gone.unionByName(out)
        if rounds % 50 == 0:
            gone = materialize(gone, "gone")  # a plan of bounded size
        left = pairs.join(out, pairs.a == out.id, "left_anti").join(out, pairs.b == out.id, "left_anti").join(free, pairs.a == free.id, "left_anti")
        pairs = materialize(left, "pairs")
    return ids if gone is None else ids.join(gone, "id", "left_anti")
