"""Subgraph samplers. Randomness is hash order by a seed, so a sample repeats on any engine."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ids import hash_order, packed, unpacked
from loomgraph.operators.graph import distances, few, induced_subgraph, stored
from loomgraph.scratch import materialize


def whole_graph(nodes: DataFrame, subgraph_id: int = 0) -> DataFrame:
    return nodes.select(F.lit(subgraph_id).alias("subgraph_id"), "id")


def random_nodes(nodes: DataFrame, order: int, seed: str) -> DataFrame:
    """``order`` ids, the first in hash order: a top-k without a global sort."""
    return nodes.select("id").distinct().orderBy(hash_order(seed, "id"), "id").limit(order)


def random_sampler(nodes: DataFrame, edges: DataFrame, order: int, seed: str, tries: int = 10) -> DataFrame:
    """A random sample that induces an edge, if one of the tries does; else the last try's."""
    chosen, edges = None, stored(edges)
    for k in range(tries):
        chosen = materialize(random_nodes(nodes, order, f"{seed}:{k}"), "sample")
        if not induced_subgraph(edges, few(chosen).select(packed("id").alias("id"))).isEmpty():
            break
    return chosen


def bfs_sampler(nodes: DataFrame, edges: DataFrame, order: int, seed: str, children: int = 3) -> DataFrame:
    """From a random start, up to ``children`` random successors of each node reached (chosen
    before the visited ones are left out); topped up with random nodes. (id, step)."""
    rank = F.row_number().over(Window.partitionBy("head").orderBy(hash_order(seed, "head", "tail"), "tail"))
    edges = stored(edges)
    seen = materialize(random_nodes(nodes, 1, seed).select("id", F.lit(0).alias("step")), "bfs")
    frontier, n = seen, 1
    for k in count(1):
        if n >= order:
            break
        # only the successors of a frontier of at most ``order`` nodes are ranked
        own = edges.join(few(frontier.select(packed("id").alias("head"))), "head", "left_semi").where("head <> tail").distinct()
        own = own.select(unpacked("head").alias("head"), unpacked("tail").alias("tail")).withColumn("r", rank).where(F.col("r") <= children)
        new = own.select(F.col("tail").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        new = new.orderBy(hash_order(seed, "id"), "id").limit(order - n).withColumn("step", F.lit(k))
        frontier = materialize(new, "bfs")
        more = frontier.count()
        if not more:
            break
        seen, n = seen.unionByName(frontier), n + more
    if n < order:
        rest = nodes.select("id").distinct().join(seen.select("id"), "id", "left_anti").orderBy(hash_order(seed, "id"), "id").limit(order - n)
        seen = seen.unionByName(rest.withColumn("step", F.lit(-1)))
    return seen


def chain_sampler(nodes: DataFrame, edges: DataFrame, order: int, seed: str, attempts: int = 10) -> DataFrame:
    """Augmented chain: the shortest path between a random start and the first of ``attempts`` random
    nodes that it reaches, not next to it; then up to two successors of each path node, up to
    ``order``; a random sample where no end is found. (id, part)."""
    edges = stored(edges)
    first = edges.select(unpacked("head").alias("id")).orderBy(hash_order(seed, "id"), "id").limit(1)  # repeated heads change nothing
    start = materialize(first, "start")
    reached = distances(edges, start.select(F.col("id").alias("src")))
    tried = nodes.select(F.col("id").alias("dst")).distinct().join(reached.where("len < 2").select("dst"), "dst", "left_anti")
    tried = tried.orderBy(hash_order(seed, "dst"), "dst").limit(attempts)
    end = tried.join(reached, "dst").orderBy(hash_order(seed, "dst"), "dst").limit(1).collect()
    if not end:
        return random_sampler(nodes, edges, order, seed).withColumn("part", F.lit("random"))
    path, at = [end[0].dst], end[0].dst
    for k in range(end[0].len - 1, -1, -1):  # back along distances, a row a step
        into = edges.where(F.col("tail") == packed(F.lit(at))).select(unpacked("head").alias("head"))
        before = reached.where(F.col("len") == k).join(into, F.col("dst") == F.col("head"))
        at = before.agg(F.min("dst")).first()[0]
        path.append(at)
    spark = nodes.sparkSession
    backbone = spark.createDataFrame([(x,) for x in path[:order]], "id string").withColumn("part", F.lit("path"))
    rank = F.row_number().over(Window.partitionBy("head").orderBy(hash_order(seed, "head", "tail"), "tail"))
    near = edges.join(F.broadcast(backbone.select(packed("id").alias("head"))), "head", "left_semi").distinct()
    near = near.select(unpacked("head").alias("head"), unpacked("tail").alias("tail")).withColumn("r", rank).where("r <= 2")
    side = near.select(F.col("tail").alias("id")).distinct().join(backbone.select("id"), "id", "left_anti")
    side = side.orderBy(hash_order(seed, "id"), "id").limit(max(0, order - len(path)))
    return backbone.unionByName(side.withColumn("part", F.lit("side")))


def samples(nodes: DataFrame, edges: DataFrame, kind: str, number: int, order: int, seed: str) -> DataFrame:
    """``number`` independent samples: (subgraph_id, id)."""
    if kind != "no_subgraph_sampling":
        edges = stored(edges)  # read many times
        nodes = materialize(nodes.select(packed("id").alias("id")).distinct().select(unpacked("id").alias("id")), "ids")
    run = {"no_subgraph_sampling": lambda s: nodes.select("id"), "random": lambda s: random_sampler(nodes, edges, order, s),
           "bfs": lambda s: bfs_sampler(nodes, edges, order, s), "acs": lambda s: chain_sampler(nodes, edges, order, s)}[kind]
    out = None
    for k in range(number):
        own = run(f"{seed}/{k}").select(F.lit(k).alias("subgraph_id"), "id")
        out = own if out is None else out.unionByName(own)
    return out
