"""Connected components by alternating large-star and small-star rounds.

Each round is a groupBy with map-side combine and a join; no node's neighbours are ever
gathered. Hubs are dealt out by adaptive skew-join splitting. Rounds end when the edge
set is a set of stars, of which at most O(log^2 n) are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import drop, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # edges have a < b: the smaller neighbours of b are its a
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return moved.unionByName(own).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(a, b) links -> (id, component) for every linked id; component is the smallest id reachable.

    Null ends and self-links are ignored; repeated and reversed links count once; no
    links give no rows.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    state = _state(e)
    if state[0]:
        for _ in range(max_rounds):
            last, e = e, materialize(_small_star(_large_star(e)), "edges")
            drop(last)
            now = _state(e)
            if now == state:
                break
            state = now
        else:
            raise RuntimeError("components did not settle")
    stars = e.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return stars.unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
