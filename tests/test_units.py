import io
import zipfile

from pyspark.sql import functions as F

from loomgraph.functions import metrics as M
from loomgraph.functions import text as X
from loomgraph.functions.ids import node_id
from loomgraph.operators import chunking as C
from loomgraph.operators import edges as E
from loomgraph.operators import graph as G
from loomgraph.operators import nodes as N
from loomgraph.operators import parse as P
from loomgraph.operators.components import connected_components
from loomgraph.plans import drivers
from loomgraph.sources import readers, sinks


def test_ids_ignore_case_and_nulls(spark):
    r = spark.sql("SELECT 'Ab' AS a, 'aB' AS b, CAST(NULL AS STRING) AS c").select(node_id("Entity", "a").alias("x"), node_id("Entity", "b").alias("y"), node_id("Entity", "c").alias("z")).first()
    assert r.x == r.y and r.x.startswith("ent-") and r.z == "ent-d41d8cd98f00b204e9800998ecf8427e"


def test_labels_next_to_cjk(spark):
    row = spark.createDataFrame([("如 表 12 所示, Table 3 and tab 3; 见表1所示",), (None,)], "t string").select(X.labels("t", X.TABLE_LABELS).alias("l")).collect()
    assert row[0].l == ["12", "3"] and row[1].l is None


def test_chunks_keep_their_bound_and_all_words():
    text = "\n\n".join(["short", "word " * 400, "a,b;" * 700, "x" * 2500, "tail"])
    out = C.chunk_text(text)
    assert all(0 < len(c) <= 1001 for c in out)
    assert "".join("".join(out).split()) == "".join(text.split())
    assert C.chunk_text(None) == C.chunk_text(" \n ") == []


def test_components_of_chain_star_and_loop(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{k: 100 for k in range(100, 140)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_triple_file_hazards(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a,r,b\na,r,b\na,b\n北京,位于,中国\nA,r,b\na,s,b\nx,loop,x\n")
    t = readers.triple_file(spark, str(tmp_path / "t.txt"))
    assert sorted(map(tuple, t.collect())) == sorted([("a", "r", "b"), ("北京", "位于", "中国"), ("A", "r", "b"), ("a", "s", "b"), ("x", "loop", "x")])
    nodes, edges = drivers.structured(t)
    assert edges.where("head = tail").count() == 1
    assert nodes.where("type = 'Entity'").select("id").distinct().count() == 5
    assert edges.count() == edges.select("head", "tail").distinct().count()


def test_between_tags_edges(spark):
    texts = ["a<myjson>{}</myjson>b", "none", "<myjson>{\"a\":1}x", "<myjson>", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.between_tags("t")).collect()]
    assert got == ["{}", "", '{"a":1}', "", ""]


def test_tolerant_json():
    assert P.tolerant('{"a": "b"}') == {"a": "b"}
    assert P.tolerant("{'a': 'b'}") == {"a": "b"}
    assert P.tolerant('{\n"a": "b",\nc: d\n}') == {"a": "b", "c": "d"}
    assert P.tolerant("nothing") == P.tolerant(None) == P.tolerant("") == {}


def test_metrics(spark):
    rows = [(" a ", "a"), ("the cat sat", "the cat"), ("", ""), ("北京 大学", "北京"), (None, "x")]
    df = spark.createDataFrame(rows, "p string, g string")
    got = df.select(M.exact_match(F.col("p"), F.col("g")), M.accuracy("p", "g"), F.round(M.token_f1("p", "g"), 4), F.round(M.rouge_n("p", "g", 1), 4), F.round(M.rouge_l("p", "g"), 4)).collect()
    assert tuple(got[0]) == (1.0, 1.0, 1.0, 1.0, 1.0)
    assert tuple(got[1]) == (0.0, 1.0, 0.8, 0.8, 0.8)
    assert tuple(got[2])[:3] == (1.0, 1.0, 0.0)
    assert got[3][2] == round(2 * 0.5 * 1 / 1.5, 4) and got[3][3] == 0.0
    assert tuple(got[4]) == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert M.lcs(list("abcde"), list("xbxdy")) == 2


def test_content_lists_and_unstructured_run(spark, tmp_path):
    import json

    d = tmp_path / "doc1" / "vlm"
    d.mkdir(parents=True)
    blocks = [{"type": "text", "text": "See Table 1."}, {"type": "table", "table_body": "<table/>", "table_caption": ["Table 1"], "img_path": "i.png"},
              {"type": "image", "image_caption": "Figure 2", "img_path": "f.png"}, {"type": "equation", "text": "x=1"}, {"type": "text", "text": "After."}]
    (d / "doc1_content_list.json").write_text(json.dumps(blocks))
    b = readers.content_lists(spark, str(d))
    assert b.count() == 5 and b.where("type = 'image'").first().image_caption == ["Figure 2"]
    assert N.formula_nodes(b).first().context == "See Table 1.\nAfter."
    empty = spark.createDataFrame([], "request_hash string, stage string, ordinal int, response string")
    nodes, edges = drivers.unstructured(b, empty)
    assert {r.type for r in nodes.select("type").distinct().collect()} == {"Document", "Chunk", "Table", "Image", "Formula"}
    assert edges.where("relation = 'refer_to'").count() == 1


def test_stage_tables_graphml_and_workbook(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert sinks.stage(spark, str(tmp_path), "s", make).count() == 3
    assert calls == [1]
    nodes = spark.createDataFrame([("a", "A", ["x", "y"]), ("b", None, None)], "id string, name string, alias array<string>")
    edges = spark.createDataFrame([("a", "b", "r")], "head string, tail string, relation string")
    sinks.save_graphml(nodes, edges, str(tmp_path / "g.graphml"))
    n, e = sinks.load_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.id: r.attr for r in n.collect()}["a"] == {"name": '"A"', "alias": '["x", "y"]'}
    assert e.first().attr == {"relation": '"r"'}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>one</t></is></c><c r="B1"><v>2</v></c></row><row><c r="A2"><v>3</v></c></row></sheetData></worksheet>')
    assert readers.workbook_first_column(data.getvalue()) == ["one", "3"]


def test_json_records_tell_missing_from_null(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"q": null, "a": "x"}\n{"a": "y"}\n')
    rows = readers.json_records(spark, str(tmp_path / "q.jsonl"), "q string, a string").collect()
    assert [sorted(r.present) for r in rows] == [["a", "q"], ["a"]]


def test_evaluation_snapshots(spark, tmp_path):
    one = spark.createDataFrame([("m", "q1", 1.0), ("m", "q2", 2.0)], "model_name string, query string, f1 double")
    two = spark.createDataFrame([("m", "q2", 3.0)], "model_name string, query string, f1 double")
    sinks.merge_evaluations(spark, str(tmp_path / "e"), one, "v1")
    got = sinks.merge_evaluations(spark, str(tmp_path / "e"), two, "v2")
    assert {r.query: r.f1 for r in got.collect()} == {"q1": 1.0, "q2": 3.0}


def test_collapse_overlays_attributes(spark):
    e = spark.createDataFrame([("a", "b", "r", "d1", {"k": ["1"]}, 1), ("a", "b", "s", "d2", {"l": ["2"]}, 2)], "head string, tail string, relation string, desc string, attr map<string,array<string>>, seq long")
    r = G.collapse(e).first()
    assert (r.relation, r.desc, r.attr) == ("s", "d2", {"k": ["1"], "l": ["2"]})


def test_stream_equals_batch(spark, tmp_path):
    from loomgraph.streaming import ingest
    from tests.conftest import DATA

    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").symlink_to(f"{DATA}/events.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = ingest.write_edges(ingest.edge_stream(ingest.event_triples(stream), "10000 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = E.relation_edges(ingest.event_triples(spark.read.parquet(f"{DATA}/events.parquet")).select("head", "relation", "tail")).distinct()
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
