"""Drivers and operators over small graphs, against what a few lines of Python say."""

import json

import pytest

from loomgraph import scratch
from loomgraph.operators import models as MO
from loomgraph.operators import resolve as R
from loomgraph.operators import sampling as S
from loomgraph.operators import traces as T
from loomgraph.plans import drivers
from loomgraph.sources import sinks


def test_rewrite_last_wins_and_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("b", None, 2), ("b", None, 2)], "head string, rewritten string, old int")
    mapping = spark.createDataFrame([("a", "z", 1), ("a", "y", 2), (None, "q", 3), ("c", "d", 1)], "old string, new string, seq long")
    assert sorted(map(tuple, R.rewrite(rows, mapping, "head").collect())) == [("b", None, 2), ("b", None, 2), ("y", "x", 1)]
    assert sorted(r.head for r in R.rewrite(rows, mapping.where("false"), "head").collect()) == ["a", "b", "b"]


def test_chain_sampler_walks_long_chains(spark):
    n = 12
    edges = spark.createDataFrame([(f"n{i:03}", f"n{(i + 1) % n:03}") for i in range(n)], "head string, tail string")
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(n)], "id string")
    lengths = []
    for seed in ("s",):
        found = {r.id: r.part for r in S.chain_sampler(nodes, edges, 500, seed).collect()}
        path = {int(k[1:]) for k, part in found.items() if part == "path"}
        begins = [k for k in path if (k - 1) % n not in path]
        assert len(path) == n or len(begins) == 1 and path == {(begins[0] + i) % n for i in range(len(path))}
        lengths.append(len(path))
    assert min(lengths) > 2
    reached = {r.id for r in S.bfs_sampler(nodes, edges, n, "s").collect()}
    assert len(reached) == n


def test_companions_of_negative_requirements(spark):
    nodes = spark.createDataFrame([("s", "Entity")] + [(f"c{i}", "Chunk") for i in range(6)], "id string, type string")
    edges = spark.createDataFrame([("s", f"c{i}") for i in range(6)], "head string, tail string")
    starts = spark.createDataFrame([("t", "s")], "task string, id string")
    for k, least, most in ((2, 2, 2), (-3, 2, 6), (-1, 0, 6)):
        tasks = spark.createDataFrame([("t", {"Chunk": k})], "task_type string, requirement map<string,int>")
        assert least <= T.companions(starts, edges, nodes, tasks, "x").count() <= most


def test_degree_bands_split_equal_degrees(spark):
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(22)], "id string")
    edges = spark.createDataFrame([(f"n{i:02}", "n00") for i in range(1, 15)], "head string, tail string")
    order = sorted((f"n{i:02}" for i in range(22)), key=lambda x: (-(14 if x == "n00" else 1 if x < "n15" else 0), x))
    assert sorted(r.id for r in T.degree_band(edges, nodes, "high").collect()) == sorted(order[:5])
    assert sorted(r.id for r in T.degree_band(edges, nodes, "medium").collect()) == sorted(order[5:15])


def test_failed_calls_give_null_and_endpoints_hold():
    calls = []

    def broken(model, prompt):
        calls.append(prompt)
        raise OSError

    assert MO.retrying(broken, 3, 0.0)("m", "p") is None and calls == ["p"] * 3
    assert MO.retrying(lambda m, p: p * 2, 3, 0.0)("m", "p") == "pp"
    for base in ("http://h", "http://h/", "http://h/v1", "http://h/v1/chat/completions"):
        assert MO.endpoint(base) == "http://h/v1/chat/completions"


def test_http_chat_and_vision(spark):
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            answer = json.dumps({"choices": [{"message": {"content": f"{body['model']}: {len(body['messages'])}"}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    asked = spark.createDataFrame([("m", "hello")], "model string, prompt string")
    assert MO.live(asked, MO.http_chat(base, "key", "be brief", json_mode=True)).first().response == "m: 2"
    assert seen[0][0] == "/v1/chat/completions" and seen[0][1] == "Bearer key" and seen[0][2]["response_format"] == {"type": "json_object"}
    from pyspark.sql import functions as F

    image = spark.createDataFrame([("m", "a.png", bytearray(b"\x01\x02"))], "model string, path string, content binary")
    payload = image.select("model", MO.vision_payload(F.lit("what?"), MO.data_url("path", "content")).alias("prompt"))
    assert MO.live(payload, MO.http_vision(base)).first().response == "m: 1"
    assert seen[1][2]["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,AQI="
    server.shutdown()


def graph(spark):
    """An entity with two chunks, a table and a chain of entities."""
    nodes = [("ent-s", "Entity", "s")] + [(f"ent-{i}", "Entity", f"e{i}") for i in range(5)] + [("chk-1", "Chunk", "c1"), ("chk-2", "Chunk", "c2"), ("tbl-1", "Table", "t1")]
    edges = [("ent-s", "ent-0")] + [(f"ent-{i}", f"ent-{i + 1}") for i in range(4)] + [("ent-s", "chk-1"), ("ent-s", "chk-2"), ("ent-s", "tbl-1"), ("ent-2", "ent-s")]
    n = spark.createDataFrame([(*r, f"about {r[2]}", 0) for r in nodes], "id string, type string, name string, content string, seq long")
    return n, spark.createDataFrame([(a, "rel", b) for a, b in edges], "head string, relation string, tail string")


def test_traces_keep_subgraphs_and_tasks_apart(spark):
    nodes, edges = graph(spark)
    config = drivers.Config(subgraphs=2, mode="out")
    rows = drivers.traced(nodes, edges, config).collect()
    steps = {t[0]: t[-1] for t in T.TASKS}
    assert {r.subgraph_id for r in rows} == {0, 1} and len({r.path_id for r in rows}) == len(rows)
    pairs = {tuple(r)[::2] for r in edges.collect()}
    for r in rows:
        assert len(r.path) <= steps[r.task_type] + 1 and all(p in pairs for p in zip(r.path, r.path[1:]))
    of = {(r.subgraph_id, r.task_type, r.start): r for r in rows}
    both = of[0, "single_table_multi_text_qa", "ent-s"]
    assert sorted(both.companions) == ["chk-1", "chk-2", "tbl-1"] and len(both.path) <= 2
    assert len(of[1, "Entity", "ent-s"].path) == 5


def test_synthesis_filters_and_exports(spark):
    nodes, edges = graph(spark)
    none = spark.createDataFrame([], "request_hash string, stage string, ordinal int, response string")
    config = drivers.Config(mode="out", need_info=["Chunk"])
    empty = drivers.synthesis(nodes, edges, none, config)
    assert empty.where("size(present) > 1").count() == 0
    from pyspark.sql import functions as F

    import loomgraph.plans.drivers as D

    asked = []
    real = D.models.qa_requests
    D.models.qa_requests = lambda *a, **k: asked.append(real(*a, **k)) or asked[-1]
    try:
        drivers.synthesis(nodes, edges, none, config)
    finally:
        D.models.qa_requests = real
    said = asked[0].select("request_hash", F.lit("qa").alias("stage"), F.lit(1).alias("ordinal"), F.lit('{"question": "who?", "answer": "s", "reasoning_path": ["a", "b"]}').alias("response"))
    records = drivers.synthesis(nodes, edges, said, config)
    one = records.where("path_id = '0/single_table_multi_text_qa/ent-s'").first()
    assert one.q.endswith("who?") and "c1" in one.q and set(one.node_ids) >= {"ent-s", "chk-1", "chk-2", "tbl-1"}
    assert {(r["head"], r["tail"]) for r in one.evidence.relations} >= {("s", "c1"), ("s", "c2"), ("s", "t1")}
    assert drivers.export_records(drivers.filtering(records)).count() == records.count()


def test_settings_from_a_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"order": 7, "judge_models": ["a"]}')
    config = drivers.load_config(spark, str(tmp_path / "c.json"))
    assert (config.order, config.judge_models, config.max_steps) == (7, ("a",), 4)
    (tmp_path / "d.json").write_text('{"ordr": 7}')
    with pytest.raises(ValueError, match="ordr"):
        drivers.load_config(spark, str(tmp_path / "d.json"))


def test_scratch_tables_go_when_dropped(spark):
    import os

    table = scratch.materialize(spark.range(3), "t")
    path = table.scratch_path.removeprefix("file:")
    assert os.path.isdir(path)
    scratch.drop(table, None)
    assert not os.path.exists(path)
    scratch.drop(table)


def test_pages_of_graphs_and_reports(spark):
    nodes, edges = graph(spark)
    page = sinks.graph_page(nodes, edges, ["Entity", "Chunk"])
    assert "c1" in page and "t1" not in page and page.count(" - rel - ") == edges.where("tail <> 'tbl-1'").count()
    rows = [("distribution", "level", k, 1.0) for k in ("unevaluated", "hard", "simple")] + [("distribution", "num_hops", str(k), 1.0) for k in (10, 9)]
    report = sinks.report_page(spark.createDataFrame(rows, "section string, metric string, key string, value double"))
    assert report.index("simple") < report.index("hard") < report.index("unevaluated") and report.index(">9 <") < report.index(">10 <")
