"""The property graph as two frames: nodes (id, type, ...) and edges (head, tail, relation, ...)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import packed, unpacked
from loomgraph.operators.resolve import last_wins
from loomgraph.scratch import materialize

#: Most bytes (as Parquet) of a table of ids that is sent to every worker.
SENT = 20_000_000
#: Most id prefixes that a filter lists.
PREFIXES = 100
NODE_COLUMNS = ["id", "name", "content", "caption", "img_path", "type", "desc"]


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges["head"] == ids.id, "left_semi").join(ids, edges["tail"] == ids.id, "left_semi")


def induced_subgraph(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    return valid_edges(edges, chosen)


def collapse(edges: DataFrame) -> DataFrame:
    """At most one edge for each ordered (head, tail): the last one's relation and desc; attributes overlay in order."""
    out = last_wins(edges.drop("attr"), ["head", "tail"])
    if "attr" in edges.columns:
        attrs = edges.select("head", "tail", "seq", F.explode("attr").alias("k", "v")).groupBy("head", "tail", "k").agg(F.max_by("v", "seq").alias("v"))
        out = out.join(attrs.groupBy("head", "tail").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attr")), ["head", "tail"], "left")
    return out


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """The columns a graph carries, null where a list lacks them; of one id the last row."""
    kept = [F.col(c) if c in nodes.columns else F.lit(None).cast("string").alias(c) for c in NODE_COLUMNS]
    return last_wins(nodes.select(*kept, "seq"), ["id"]).drop("seq")


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_deg, out_deg by one shuffle."""
    e = compact(edges)
    ends = e.select(F.explode(F.array(F.struct(F.col("head").alias("id"), F.lit(1).alias("o")), F.struct(F.col("tail").alias("id"), F.lit(0).alias("o")))).alias("e"))
    counted = ends.groupBy("e.id").agg(F.sum(1 - F.col("e.o")).cast("long").alias("in_deg"), F.sum("e.o").cast("long").alias("out_deg"))
    return counted.withColumn("id", unpacked("id"))


def compact(edges: DataFrame) -> DataFrame:
    """(head, tail) as packed ids; edges that are so already stay."""
    if dict(edges.dtypes)["head"] == "binary":
        return edges.select("head", "tail")
    return edges.select(packed("head").alias("head"), packed("tail").alias("tail"))


def stored(edges: DataFrame) -> DataFrame:
    """compact() edges in a table of their own, where several steps read them."""
    return edges if hasattr(edges, "scratch_path") and dict(edges.dtypes)["head"] == "binary" else materialize(compact(edges), "edges")


def few(rows: DataFrame) -> DataFrame:
    """A table of ids that materialize() made, as the side of a join that is sent to every worker, unless its files have more than SENT bytes."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(rows) if size <= SENT else rows


def _turned(edges: DataFrame, mode: str) -> DataFrame:
    """(id, neighbour) of each edge; both ways (all) by one reading of the edges."""
    way = {"out": ("head", "tail"), "in": ("tail", "head")}
    both = [F.struct(F.col(a).alias("id"), F.col(b).alias("neighbour")) for a, b in ([way[mode]] if mode != "all" else way.values())]
    return edges.select(both[0].alias("p") if len(both) == 1 else F.explode(F.array(*both)).alias("p")).select("p.id", "p.neighbour")


def near(edges: DataFrame, ids: DataFrame, mode: str) -> DataFrame:
    """neighbours() of some ids only, from stored() edges; ids: a table of distinct ids that materialize() made."""
    wanted = few(ids).select(packed("id").alias("id"))
    own = _turned(edges, mode).join(wanted, "id", "left_semi").distinct()
    return own.select(unpacked("id").alias("id"), unpacked("neighbour").alias("neighbour"))


def prefixes(nodes: DataFrame) -> list[str] | None:
    """The first four characters of all ids, if they are few."""
    found = nodes.select(F.substring("id", 1, 4).alias("p")).where("p is not null").distinct().limit(PREFIXES + 1).collect()
    return [r.p for r in found] if len(found) <= PREFIXES else None


def _starting(rows: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """Rows whose id may be one of the nodes', by the first four characters alone; others go before anything is shuffled."""
    known = prefixes(nodes)
    return rows if known is None else rows.where(F.substring(column, 1, 4).isin(known))


def neighbours(edges: DataFrame, mode: str = "all", distinct: bool = True) -> DataFrame:
    """(id, neighbour) along edges (out), against them (in), or both (all)."""
    both = _turned(edges, mode)
    return both.distinct() if distinct else both


def typed_neighbours(
    edges: DataFrame, nodes: DataFrame, mode: str = "all", types: list[str] | None = None, has: dict[str, str] | None = None, distinct: bool = True
) -> DataFrame:
    """(id, neighbour, type), of the wanted types; ``has``: of a type only nodes that carry this attribute, not null and not empty.

    distinct=False keeps a neighbour along and against an edge as two (a bag).
    """
    found = _typed_pairs(edges, nodes, mode, types, has, distinct)
    return found.select(unpacked("id").alias("id"), unpacked("neighbour").alias("neighbour"), "type")


def _typed_pairs(edges: DataFrame, nodes: DataFrame, mode: str, types: list[str] | None, has: dict[str, str] | None, distinct: bool, own: list[str] | None = None) -> DataFrame:
    """typed_neighbours() with packed ids; own: of ids that may be of these types only.

    Pairs are dealt once, by neighbour: both the distinct rows and the join use this.
    """
    kinds = nodes
    if types:
        kinds = kinds.where(F.col("type").isin(types))
    for kind, column in (has or {}).items():
        kinds = kinds.where((F.col("type") != kind) | (F.coalesce(F.length(F.col(column).cast("string")), F.lit(0)) > 0))
    pairs = _turned(edges, mode)
    if types or has:
        pairs = _starting(pairs, "neighbour", kinds)
    if own:
        pairs = _starting(pairs, "id", nodes.where(F.col("type").isin(own)))
    pairs = pairs.select(packed("id").alias("id"), packed("neighbour").alias("neighbour"))
    if distinct:
        pairs = pairs.repartition("neighbour").distinct()
    return pairs.join(kinds.select(packed("id").alias("neighbour"), "type"), "neighbour").select("id", "neighbour", "type")


def neighbour_types(edges: DataFrame, nodes: DataFrame, mode: str = "all", types: list[str] | None = None, own: list[str] | None = None) -> DataFrame:
    """(id, type, n); types: only neighbours of these are counted; own: other ids than of these types may be left out."""
    found = _typed_pairs(edges, nodes, mode, types, None, True, own).groupBy("id", "type").agg(F.count("*").alias("n"))
    return found.withColumn("id", unpacked("id"))


def out_triples(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, relation, name of the other end) of a node's outgoing edges."""
    return _named(edges, nodes, "head", "tail")


def in_triples(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, relation, name of the other end) of a node's incoming edges."""
    return _named(edges, nodes, "tail", "head")


def _named(edges: DataFrame, nodes: DataFrame, own: str, other: str) -> DataFrame:
    names = nodes.select(packed("id").alias("other"), "name")
    ends = edges.select(packed(own).alias("id"), "relation", packed(other).alias("other"))
    return ends.join(names, "other").select(unpacked("id").alias("id"), "relation", "name")


def node_relations(edges: DataFrame) -> DataFrame:
    """All edges at each node, as a bag: a self-loop counts twice."""
    return edges.select(F.explode(F.array("head", "tail")).alias("id"), "head", "relation", "tail")


def node_attributes(nodes: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """(id, attributes): a map column -> value of the wanted ids; empty for ids that no node has. Null values are left out."""
    pairs = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns)), lambda e: e["v"].isNotNull()))
    known = nodes.select("id", pairs.alias("attributes"))
    return wanted.select("id").distinct().join(known, "id", "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def all_relations(edges: DataFrame, as_json: bool = False) -> DataFrame:
    """Every edge as (head, relation, tail, desc), or as one JSON object each."""
    rows = edges.select("head", "relation", "tail", F.coalesce("desc", F.lit("")).alias("desc") if "desc" in edges.columns else F.lit("").alias("desc"))
    return rows.select(F.to_json(F.struct("*")).alias("json")) if as_json else rows


def objects(edges: DataFrame) -> DataFrame:
    """The first tail for each head and relation."""
    return edges.groupBy("head", "relation").agg(F.min_by("tail", F.struct("seq", "tail")).alias("tail"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_count, relationship_count."""
    counted = lambda df, name: df.agg(F.count("*").alias(name))
    return counted(nodes, "node_count").crossJoin(counted(edges, "relationship_count"))  # one row each


def node_types(nodes: DataFrame) -> DataFrame:
    return nodes.select("type").distinct()


def shortest_paths(edges: DataFrame, sources: DataFrame, max_steps: int | None) -> DataFrame:
    """(src, dst, len) by breadth-first frontiers along edges, without max_steps until nothing new is met; sources: (src). A node's own distance is 0."""
    steps = edges.select("head", "tail").distinct()
    heads = steps.select(F.col("head").alias("tail"), F.lit(True).alias("goes")).distinct()
    steps = materialize(steps.join(heads, "tail", "left").select("head", "tail", F.coalesce("goes", F.lit(False)).alias("goes")), "steps")
    seen = sources.select("src", F.col("src").alias("dst"), F.lit(0).alias("len"))
    open_ = seen.select("src", "dst")  # from where a step leads on
    for k in count(1) if max_steps is None else range(1, max_steps + 1):
        met = open_.select(F.col("dst").alias("head")).distinct().join(steps, "head").select(F.col("tail").alias("dst")).distinct()
        before = seen.select("src", "dst").join(few(materialize(met, "met")), "dst", "left_semi")  # of rows known already only those that can be met again
        reached = open_.join(steps, open_.dst == steps["head"]).select("src", F.col("tail").alias("dst"), "goes").distinct()
        frontier = materialize(reached.join(before, ["src", "dst"], "left_anti").withColumn("len", F.lit(k)), "frontier")
        seen = seen.unionByName(frontier.select("src", "dst", "len"))
        open_ = frontier.where("goes").select("src", "dst")
        if open_.isEmpty():
            break
    return seen


def distances(edges: DataFrame, source: DataFrame) -> DataFrame:
    """shortest_paths() from one source, as (dst, len); edges: stored(), source: one row (src).

    A frontier of up to SENT bytes is sent to the workers, which read the edges where they lie.
    """
    seen = materialize(source.select(packed("src").alias("dst"), F.lit(0).alias("len")), "reached")
    frontier = seen
    for k in count(1):
        reached = edges.join(few(frontier.select(F.col("dst").alias("head"))), "head", "left_semi").select(F.col("tail").alias("dst")).distinct()
        frontier = materialize(reached.join(seen.select("dst"), "dst", "left_anti").withColumn("len", F.lit(k)), "reached")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select(unpacked("dst").alias("dst"), "len")
