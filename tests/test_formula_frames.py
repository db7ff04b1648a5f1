from loomgraph.operators import nodes as N


def test_contexts_by_growing_frames_alone(spark):
    rows = [("d", 0, "equation", "e0"), ("d", 1, "text", "t1"), ("d", 2, "equation", "e2"), ("d", 3, "equation", "e3"), ("d", 4, "table", "x"), ("d", 5, "text", None), ("d", 6, "text", "t6"), ("d", 7, "equation", "e7"), ("f", 1, "text", "other")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_name string, pos int, type string, text string, seq long")
    out = N.formula_nodes(df)
    assert {r.content: r.context for r in out.collect()} == {"e0": "t1", "e2": "t1\nt6", "e3": "t1\nt6", "e7": "t6"}
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()  # such a frame is read anew for each row
