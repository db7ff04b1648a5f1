"""Graph steps shuffle packed ids, read edges once and go only where they must."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.ids import packed, unpacked
from loomgraph.operators import edges as E
from loomgraph.operators import graph as G
from loomgraph.operators import resolve as R
from loomgraph.operators import traces as T
from loomgraph.plans.fixtures import TYPED_EDGES, frame, typed_edges
from tests.conftest import DATA

MD5 = "0123456789abcdef0123456789abcdef"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_packed_ids_come_back(spark):
    ids = ["ent-" + MD5, "ENT-" + MD5, "ent-" + MD5.upper(), "ent-" + MD5[:-1], "ent-" + MD5 + "\n", "ent-" + MD5[:-1] + "g", "x", "", None, "\0", "\0ab-" + MD5, "é-" + MD5 + "a", "图-" + MD5, "e-t-" + MD5[:30] + "zz", "123-" + MD5]
    df = spark.createDataFrame([(x,) for x in ids], "id string").select("id", packed("id").alias("p")).select("*", unpacked("p").alias("back"))
    rows = df.collect()
    assert [r.back for r in rows] == ids and len({bytes(r.p) for r in rows if r.p is not None}) == len(ids) - 1
    assert len(rows[0].p) == 19


def test_typed_edges_are_the_same_bag(spark):
    rows = lambda df: Counter(map(tuple, df.select("head", "relation", "tail").collect()))
    assert rows(typed_edges(spark, DATA)) == rows(frame(spark, DATA, TYPED_EDGES))


def test_both_ways_by_one_reading(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c")], "head string, tail string")
    both = G.neighbours(e, "all")
    assert "Union" not in plan(both) and sorted(map(tuple, both.collect())) == [("a", "b"), ("b", "a"), ("c", "c")]


def test_other_types_go_before_the_shuffle(spark):
    nodes = spark.createDataFrame([("ent-1", "Entity"), ("tbl-1", "Table"), ("chk-1", "Chunk")], "id string, type string")
    e = spark.createDataFrame([("ent-1", "tbl-1"), ("ent-1", "chk-1"), ("chk-1", "tbl-1"), ("ent-1", "tbl-9")], "head string, tail string")
    near = G.typed_neighbours(e, nodes, "all", ["Table"])
    assert "tbl-" in plan(near) and sorted(map(tuple, near.collect())) == [("chk-1", "tbl-1", "Table"), ("ent-1", "tbl-1", "Table")]


def test_folded_edges_have_the_ids_of_relation_edges(spark):
    t = spark.createDataFrame([("A", "r", "b", 1), ("a", "r", "B", 2), (None, "r", "", 3), ("", "r", None, 4)], "head string, relation string, tail string, seq long")
    want = E.deduplicate(E.relation_edges(t))
    got = E.identified(E.deduplicate(E.folded(t)))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert "max_by" not in plan(R.last_wins(t, ["head", "relation", "tail"]))  # a number alone needs no sort


def test_relations_go_along_with_paths(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("a", "s", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "t", "d"), ("d", "r", "d")], "head string, relation string, tail string")
    whole = T.path_relations(T.khop_paths(e, 3).withColumn("path_id", F.array_join("path", "->")), e)
    got = T.khop_relations(e, 3)
    assert Counter(map(tuple, got.select(*whole.columns).collect())) == Counter(map(tuple, whole.collect()))
    one = spark.createDataFrame([("b",)], "id string")
    assert {tuple(r.path) for r in T.khop_paths(e, 2, one).collect()} == {("b", "c"), ("b", "c", "a"), ("b", "c", "d")}


@pytest.mark.parametrize("band", ["high", "medium"])
def test_bands_from_one_ranking(spark, band):
    e = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(9) for j in range(i)], "head string, tail string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(12)], "id string")
    want = sorted(map(tuple, T.degree_band(e, nodes, band).collect()))
    assert sorted((r.id, r.degree) for r in T.degree_bands(e, nodes).where(F.col("band") == band).collect()) == want
    assert len(want) == (3 if band == "high" else 6)


def test_distances_equal_shortest_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")], "head string, tail string")
    source = spark.createDataFrame([("a",)], "src string")
    got = sorted(map(tuple, G.distances(G.stored(e), source).collect()))
    assert got == sorted((r.dst, r.len) for r in G.shortest_paths(e, source, None).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
