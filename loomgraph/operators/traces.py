"""Path mining: start nodes by requirement or degree band, companions, paths, task registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.ids import hash_fraction, hash_order, packed, unpacked
from loomgraph.operators.graph import compact, degrees, near, neighbour_types, prefixes, stored, typed_neighbours
from loomgraph.schemas import TASK
from loomgraph.scratch import materialize

#: Task, required Chunk, Table, Image and Formula neighbours, most steps.
TASKS = [
    ("Entity", 0, 0, 0, 0, 4), ("single_table", 0, 1, 0, 0, 1), ("single_table_mutihop", 0, 1, 0, 0, 4), ("single_table_single_text", 1, 1, 0, 0, 1),
    ("single_table_multi_text_qa", 2, 1, 0, 0, 1), ("multi_table", 0, 2, 0, 0, 1), ("multi_table_multihop", 0, 2, 0, 0, 4), ("multi_table_multi_text", 2, 2, 0, 0, 1),
    ("single_text", 1, 0, 0, 0, 1), ("multi_text", 2, 0, 0, 0, 1), ("single_text_multihop", 1, 0, 0, 0, 4), ("multi_text_multihop", 2, 0, 0, 0, 4),
    ("single_formula", 0, 0, 0, 1, 1), ("single_formula_multihop", 0, 0, 0, 1, 4), ("single_formula_single_text", 1, 0, 0, 1, 1), ("single_formula_multi_text", 2, 0, 0, 1, 1),
    ("multi_formula", 0, 0, 0, 2, 1), ("multi_formula_multihop", 0, 0, 0, 2, 4), ("multi_formula_multi_text", 2, 0, 0, 2, 1), ("single_chart", 0, 0, 1, 0, 1),
    ("single_chart_multihop", 0, 0, 1, 0, 4), ("single_chart_single_text", 1, 0, 1, 0, 1), ("single_chart_multi_text", 2, 0, 1, 0, 1), ("multi_chart", 0, 0, 2, 0, 1),
    ("multi_chart_multihop", 0, 0, 2, 0, 4), ("multi_chart_multi_text", 2, 0, 2, 0, 1), ("single_table_single_chart", 0, 1, 1, 0, 1),
    ("single_table_single_chart_multihop", 0, 1, 1, 0, 4), ("single_table_single_formula", 0, 1, 0, 1, 1), ("single_table_single_formula_multihop", 0, 1, 0, 1, 4),
    ("single_chart_single_formula", 0, 0, 1, 1, 1), ("single_chart_single_formula_multihop", 0, 0, 1, 1, 4),
]
STARTS = 10


def task_info(spark: SparkSession) -> DataFrame:
    rows = [(t, m, {"Chunk": c, "Table": tb, "Image": i, "Formula": f}, ["Entity"], []) for t, c, tb, i, f, m in TASKS]
    return spark.createDataFrame(rows, TASK)


def start_candidates(edges: DataFrame, nodes: DataFrame, tasks: DataFrame, seed: str, limit: int = STARTS) -> DataFrame:
    """(task, id): nodes of a wanted type with the required neighbours, the first ``limit`` by hash.

    A requirement of -k asks for at least k - 1.
    """
    asked = tasks.select(F.explode(F.map_keys("requirement")).alias("t")).distinct().collect()  # types
    wanted = tasks.select(F.explode("ans_types").alias("t")).distinct().collect()
    kinds = neighbour_types(edges, nodes, types=[r.t for r in asked], own=[r.t for r in wanted]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("has"))
    own = nodes.select("id", F.col("type").alias("own")).where(F.col("type").isin([r.t for r in wanted])).join(kinds, "id", "left").withColumn("has", F.coalesce("has", F.create_map().cast("map<string,bigint>")))
    met = F.forall(
        F.map_entries("requirement"),
        lambda e: F.coalesce(F.try_element_at("has", e["key"]), F.lit(0)) >= F.when(e["value"] < 0, -e["value"] - 1).otherwise(e["value"]),
    )
    found = own.join(F.broadcast(tasks), F.array_contains("ans_types", F.col("own")) & met)  # the registry has one row a task
    rank = F.row_number().over(Window.partitionBy("task_type").orderBy(hash_order(seed, "task_type", "id"), "id"))
    return found.select("task_type", "id").withColumn("r", rank).where(F.col("r") <= limit).select(F.col("task_type").alias("task"), "id")


def degree_band(edges: DataFrame, nodes: DataFrame, band: str) -> DataFrame:
    """(id, degree): the top quartile (high), the middle half (medium) or all, ranked by degree, ties by id."""
    if band not in ("high", "medium"):
        return _full_degrees(edges, nodes)
    return degree_bands(edges, nodes).where(F.col("band") == band).select("id", "degree")


def _full_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = degrees(edges).select(packed("id").alias("id"), (F.col("in_deg") + F.col("out_deg")).alias("degree"))
    full = nodes.select(packed("id").alias("id")).join(d, "id", "left")
    return full.select(unpacked("id").alias("id"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_bands(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(band, id, degree) of the high and the medium band.

    Rows are dealt by range of (degree, id) and sorted in each partition; a row's rank is its
    place there plus the rows of the partitions before, of which only the counts are
    gathered. So no task holds a whole degree. Nodes without edges have degree 0.
    """
    full = materialize(_full_degrees(edges, nodes), "degrees")  # dealing by range reads them twice
    dealt = full.repartitionByRange(F.desc("degree"), "id").sortWithinPartitions(F.desc("degree"), "id")
    # numbered once and kept, as a range partitioning may differ when it is made again
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = materialize(dealt.select("id", "degree", part.alias("part"), place.alias("place")), "ranked")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = dealt.count()
    rank = F.col("before") + F.col("place")
    ranked = dealt.join(F.broadcast(before), "part").where(rank < total // 4 * 3)
    return ranked.select(F.when(rank < total // 4, "high").otherwise("medium").alias("band"), "id", "degree")


def companions(starts: DataFrame, edges: DataFrame, nodes: DataFrame, tasks: DataFrame, seed: str) -> DataFrame:
    """(task, start, type, id): for each required type so many neighbours of the start, by hash.

    A requirement -k asks for k - 1 or more: a seeded number from k - 1 to all there are.
    """
    wanted = tasks.select(F.col("task_type").alias("task"), F.explode("requirement").alias("type", "k")).where("k <> 0")
    first = starts.select("id").distinct()  # a limited number a task
    own = lambda c: F.broadcast(first.select(F.col("id").alias(f"own_{c}")))
    around = edges.join(own("head"), F.col("head") == F.col("own_head"), "left").join(own("tail"), F.col("tail") == F.col("own_tail"), "left")
    around = around.where("own_head is not null or own_tail is not null").select("head", "tail")
    pairs = typed_neighbours(materialize(around, "around"), nodes).select(F.col("id").alias("start"), F.col("neighbour").alias("id"), "type")
    found = starts.select("task", F.col("id").alias("start")).join(F.broadcast(wanted), "task").join(pairs, ["start", "type"])
    rank = F.row_number().over(Window.partitionBy("task", "start", "type").orderBy(hash_order(seed, "start", "id"), "id"))
    there = F.count("*").over(Window.partitionBy("task", "start", "type"))
    least = F.least(-F.col("k") - 1, "there")
    some = least + F.floor(hash_fraction(seed, "task", "start", "type") * (F.col("there") - least + 1))
    wanted_n = F.when(F.col("k") >= 0, F.col("k")).otherwise(some)
    return found.withColumns({"r": rank, "there": there}).where(F.col("r") <= wanted_n).select("task", "start", "type", "id")


def khop_paths(edges: DataFrame, k: int, starts: DataFrame | None = None) -> DataFrame:
    """All simple directed paths of up to k steps: (path array, len). starts: (id), all heads if absent."""
    steps = materialize(compact(edges).distinct().withColumn("relations", F.lit(None).cast("array<struct<relation:string>>")), "steps")
    return _walks(steps, k, starts).select(F.transform("path", unpacked).alias("path"), "len")


def khop_relations(edges: DataFrame, k: int, starts: DataFrame | None = None) -> DataFrame:
    """path_relations() of khop_paths(), path_id being the ids with arrows between.

    A step's relations go along with it, so the paths are never joined with the edges.
    """
    own = edges.select(packed("head").alias("head"), packed("tail").alias("tail"), "relation")
    steps = materialize(own.groupBy("head", "tail").agg(F.collect_set(F.struct("relation")).alias("relations")), "steps")
    walks = _walks(steps, k, starts).select(F.transform("path", unpacked).alias("path"), "relations")
    each = walks.select("path", F.array_join("path", "->").alias("path_id"), F.posexplode("relations").alias("pos", "found"))
    each = each.select("path_id", "pos", F.col("path")[F.col("pos")].alias("head"), F.col("path")[F.col("pos") + 1].alias("tail"), F.explode("found").alias("found"))
    return each.select("path_id", "pos", "head", "found.relation", "tail")


def _walks(steps: DataFrame, k: int, starts: DataFrame | None) -> DataFrame:
    """(path, relations, len) over stored steps (head, tail, relations), packed.

    Most paths end where no step begins. So paths of n steps are not kept to make those of
    n + 1: these come anew from the steps that can be followed (``inner``), which are few.
    """
    first = lambda df: df if starts is None else df.join(starts.select(packed("id").alias("head")), "head", "left_semi")
    begun = lambda df: first(df).where("head <> tail").select(F.array("head", "tail").alias("path"), F.array("relations").alias("relations"), F.col("tail").alias("last"))
    out = begun(steps).withColumn("len", F.lit(1))
    if k > 1:
        heads = steps.select(F.col("head").alias("tail")).distinct()
        inner = materialize(steps.join(heads, "tail", "left_semi").select(*steps.columns), "inner")
    for n in range(2, k + 1):
        paths = begun(inner)
        for m in range(2, n + 1):
            way = (steps if m == n else inner).withColumnRenamed("relations", "more")
            grown = paths.join(way, paths.last == way["head"]).where(~F.array_contains("path", F.col("tail")))
            paths = grown.select(F.concat("path", F.array("tail")).alias("path"), F.concat("relations", F.array("more")).alias("relations"), F.col("tail").alias("last"))
        out = out.unionByName(paths.withColumn("len", F.lit(n)))
    return out.drop("last")


def path_relations(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, pos, head, relation, tail): the edges between consecutive nodes of each path."""
    pairs = paths.select(
        "path_id", F.posexplode(F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda a, b: F.struct(a.alias("head"), b.alias("tail")))).alias("pos", "s")
    ).select("path_id", "pos", "s.head", "s.tail")
    return pairs.join(edges.select("head", "relation", "tail"), ["head", "tail"]).select("path_id", "pos", "head", "relation", "tail")


def deduplicate(paths: DataFrame) -> DataFrame:
    return paths.withColumn("path_key", F.array_join("path", "->")).dropDuplicates(["path_key"]).drop("path_key")


def dfs_traces(starts: DataFrame, edges: DataFrame, max_steps: int, seed: str, low: int = 0, high: int = 200, width: int = 20, mode: str = "out") -> DataFrame:
    """(start, path): from each start the longest simple path of at most max_steps steps.

    Steps go along edges (out), against them (in; the path is given reversed) or both (all),
    to unvisited neighbours with between low and high neighbours of their own: the ``width``
    with most of these, in hash order. Of equally long paths the one that a backtracking
    search in that order meets first. All ``width`` choices of every path are followed, so at
    most width^(max_steps - 1) paths a start are held; the last step keeps one choice a path.
    """
    edges = stored(edges)
    begin = materialize(starts.select("id").distinct(), "begin")
    last = begin
    paths = begin.select(F.col("id").alias("start"), F.array("id").alias("path"), F.array().cast("array<string>").alias("order"), F.col("id").alias("last"))
    best = lambda df: df.groupBy("start").agg(F.min_by("path", "order").alias("path"))
    out = best(paths)
    for n in range(1, max_steps + 1):
        choices = _choices(edges, last, mode, low, high, seed, width, max_steps)
        grown = paths.join(choices, paths.last == choices.id)
        grown = grown.withColumn("choices", F.slice(F.filter("choices", lambda x: ~F.array_contains("path", x)), 1, width)).where("size(choices) > 0")
        found = F.transform("choices", lambda x: F.struct(hash_order(seed, F.col("start"), x).alias("h"), x.alias("id")))
        grown = grown.select("start", "path", "order", F.explode(F.array(F.array_min(found)) if n == max_steps else found).alias("c"))
        paths = materialize(grown.select("start", F.concat("path", F.array("c.id")).alias("path"), F.concat("order", F.array("c.h")).alias("order"), F.col("c.id").alias("last")), "paths")
        out = out.unionByName(best(paths))
        if n < max_steps:
            last = materialize(paths.select(F.col("last").alias("id")).distinct(), "last")
    longest = out.groupBy("start").agg(F.max_by("path", F.size("path")).alias("path"))
    return longest.withColumn("path", F.reverse("path")) if mode == "in" else longest


def _choices(edges: DataFrame, last: DataFrame, mode: str, low: int, high: int, seed: str, width: int, max_steps: int) -> DataFrame:
    """(id, choices) for the nodes that paths end in: where they may go on. Nothing is made for the rest of the graph."""
    steps = materialize(near(edges, last, mode), "steps")
    met = materialize(steps.select(F.col("neighbour").alias("id")).distinct(), "met")
    d = near(edges, met, mode).groupBy("id").agg(F.count("*").alias("degree"))
    steps = steps.join(d.withColumnRenamed("id", "neighbour"), "neighbour", "left")
    steps = steps.withColumn("degree", F.coalesce("degree", F.lit(0))).where(F.col("degree").between(low, high))
    top = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("degree"), hash_order(seed, "neighbour"), "neighbour"))
    ranked = steps.withColumn("t", top).where(F.col("t") <= width + max_steps)  # a path visits at most max_steps of them
    choices = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "neighbour"))).getField("neighbour").alias("choices"))
    return materialize(choices, "choices")


def bridges(edges: DataFrame, nodes: DataFrame, hubs: int = 10) -> DataFrame:
    """(hub_a, hub_b, bridge): nodes next to two of the table, image and formula nodes of highest in-degree."""
    modal = nodes.where(F.col("type").isin("Table", "Image", "Formula")).select("id")
    known = prefixes(modal)
    tails = edges.select("tail") if known is None else edges.select("tail").where(F.substring("tail", 1, 4).isin(known))
    met = tails.groupBy(packed("tail").alias("id")).agg(F.count("*").alias("in_deg"))
    ranked = modal.select(packed("id").alias("id")).join(met, "id").select(unpacked("id").alias("id"), "in_deg")
    ranked = materialize(ranked.orderBy(F.desc("in_deg"), "id").limit(hubs).select("id"), "hubs")
    ranked = F.broadcast(ranked)  # at most ``hubs`` rows
    own = materialize(edges.join(ranked, edges["tail"] == ranked.id).select(F.col("head").alias("bridge"), F.col("tail").alias("hub")).distinct(), "bridges")
    a, b = own.select("bridge", F.col("hub").alias("hub_a")), own.select("bridge", F.col("hub").alias("hub_b"))
    return a.join(b, "bridge").where("hub_a < hub_b").select("hub_a", "hub_b", "bridge")
