from loomgraph.sources import sinks


def test_graph_file_in_a_folder_that_nothing_has_made(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, region string")
    edges = spark.createDataFrame([("a", "b", "near")], "head string, tail string, relation string")
    path = f"file:{tmp_path}/new/deep/graph.graphml"
    sinks.save_graphml(nodes, edges, path)
    n, e = sinks.load_graphml(spark, path)
    assert sorted(r.id for r in n.collect()) == ["a", "b"] and [(r["head"], r["tail"]) for r in e.collect()] == [("a", "b")]
