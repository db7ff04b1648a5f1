"""Queries over the resolution chain, modal answers, recall, requests and sources and sinks, each beside its DuckDB form.

Scans and sinks first write what they read, below the shared folder.
"""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import models as MO
from loomgraph.operators import nodes as N
from loomgraph.operators import parse as P
from loomgraph.operators import qa as QA
from loomgraph.operators import resolve as R
from loomgraph.operators import similarity as SI
from loomgraph.operators import stats as ST
from loomgraph.operators import traces as T
from loomgraph.plans.fixtures import STAR, TYPED_EDGES, TYPED_NODES, frame, plain, typed_edges
from loomgraph.plans import drivers
from loomgraph.plans.text_queries import _blocks, BLOCKS_, COS_SQL, EVALS, EVALS_, PATHS, QA_TEXT, RELS, SCORED, SCORED_, THRESHOLD, TOTAL, WORDS
from loomgraph.scratch import materialize, scratch_path
from loomgraph.sources import readers, sinks

Q: dict = {}
SQL: dict[str, str] = {}
STAR_, NODES_, EDGES_ = plain(STAR), plain(TYPED_NODES), plain(TYPED_EDGES)


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def filled(template: str, values: dict[str, str]) -> str:
    """models.fill() as a DuckDB expression."""
    parts, at = [], 0
    for m in MO.PLACE.finditer(template):
        parts += ["'" + template[at : m.start()].replace("'", "''") + "'", f"coalesce(CAST({values[m[1]]} AS VARCHAR), '')"]
        at = m.end()
    return " || ".join([*parts, "'" + template[at:].replace("'", "''") + "'"])


def hashed(stage: str, prompt: str, model: str = "''") -> str:
    return f"md5(concat_ws(chr(1), '{stage}', {model}, {prompt}))"


# ---- similarity merges ----------------------------------------------------------------

COMP = COS_SQL.replace("WITH v", "WITH RECURSIVE v") + """, l AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c), r AS (SELECT id, id AS k FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.k = l.a),
comp AS (SELECT id, min(k) AS component FROM r GROUP BY id), cs AS (SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM comp)"""


def _classes(spark, d, word: str):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = SI.similarity_classes(vectors, THRESHOLD)
    return materialize(found.select(F.concat(F.lit(word + " "), "id").alias("name"), "component"), "classes")


def _entity_answers(classes):
    """Every class is one entity; the answers leave out names that end in 7."""
    asked = R.class_requests(classes, "entity_standard")
    alias = F.filter("names", lambda x: ~F.endswith(x, F.lit("7")))
    said = F.to_json(F.array(F.struct(F.concat(F.lit("std "), "component").alias("name"), alias.alias("alias"), F.lit("").alias("desc"))))
    return asked.select("request_hash", F.concat(F.lit("<myjson>"), said, F.lit("</myjson>")).alias("response"), F.lit(1).alias("ordinal"))


def _relation_answers(classes):
    said = F.concat(F.lit("relation_std_map<|#|>std "), "component", F.lit("<|#|>"), F.array_join("names", ", "), F.lit("\nnoise"))
    return R.class_requests(classes, "relation_standard").select("request_hash", said.alias("response"), F.lit(1).alias("ordinal"))


STD = "CASE WHEN size = 1 THEN 'item ' || id WHEN id % 10 <> 7 THEN 'std ' || component END"
_NAMES = "string_agg('item ' || id, chr(10) ORDER BY 'item ' || id)"


@query("standard_requests", COMP + f" SELECT component, count(*) AS n, {hashed('entity_standard', filled(MO.TEMPLATES['entity_standard'], {'names': _NAMES}))} AS request_hash FROM cs WHERE size > 1 GROUP BY component")
def standard_requests(spark, d):
    return R.class_requests(_classes(spark, d, "item"), "entity_standard").select("component", F.size("names").cast("long").alias("n"), "request_hash")


@query("entity_similarity_merge", COMP + f""", s AS (SELECT id, {STD} AS name, 'item ' || id AS alias FROM cs), t AS (SELECT name, alias, 'chk-' || label AS src FROM s JOIN embeddings ON vec_id = id WHERE name IS NOT NULL)
SELECT 'ent-' || md5(lower(name)) AS id, name, string_agg(DISTINCT alias, '|' ORDER BY alias) AS alias, count(DISTINCT src) AS n_src FROM t GROUP BY name""")
def entity_similarity_merge(spark, d):
    classes = _classes(spark, d, "item")
    entities = frame(spark, d, "SELECT concat('item ', vec_id) AS name, concat('chk-', label) AS src_id FROM {embeddings}")
    merged, _ = R.merge_entities_by_similarity(entities, classes, _entity_answers(classes))
    return merged.select("id", "name", F.array_join("alias", "|").alias("alias"), F.size("src_id_list").cast("long").alias("n_src"))


RELATED = """SELECT concat('c', o_custkey % 50) AS head, concat('rel ', vec_id) AS relation, concat('p', o_orderkey % 20) AS tail, o_orderpriority AS desc, concat('chk-', o_orderkey % 100) AS src_id, o_orderstatus = 'P' AS from_modal, o_orderkey AS seq
FROM {orders} JOIN {embeddings} ON vec_id = o_orderkey % 500"""


@query("assertion_similarity_merge", COMP + f""", a AS ({plain(RELATED).replace('AS desc', 'AS "desc"')}), m AS (SELECT a.*, CASE WHEN size = 1 THEN relation ELSE 'std ' || component END AS std FROM a JOIN cs ON relation = 'rel ' || id)
SELECT head, std AS relation, tail, string_agg("desc", chr(10) ORDER BY seq) AS "desc", string_agg(DISTINCT relation, '|' ORDER BY relation) AS alias, count(DISTINCT src_id) AS n_src FROM m GROUP BY head, std, tail HAVING NOT bool_and(from_modal)""")
def assertion_similarity_merge(spark, d):
    classes = _classes(spark, d, "rel")
    merged, _ = R.merge_assertions_by_similarity(frame(spark, d, RELATED), classes, _relation_answers(classes))
    return merged.select("head", "relation", "tail", "desc", F.array_join("alias", "|").alias("alias"), F.size("src_id_list").cast("long").alias("n_src"))


@query("merge_driver", COMP + f""", s AS (SELECT id, {STD} AS name FROM cs), e AS (SELECT DISTINCT name FROM s WHERE name IS NOT NULL), m AS (SELECT 'item ' || id AS old, name FROM s WHERE name LIKE 'std %'),
t AS (SELECT coalesce(h.name, 'item ' || vec_id) AS head, coalesce(x.name, 'item ' || (vec_id % 50)) AS tail FROM embeddings LEFT JOIN m h ON h.old = 'item ' || vec_id LEFT JOIN m x ON x.old = 'item ' || (vec_id % 50))
SELECT 'Entity' AS type, name FROM e UNION ALL SELECT DISTINCT 'Assertion', head || '|near|' || tail FROM t UNION ALL SELECT 'Document', max_by(n_name, n_nationkey) FROM nation GROUP BY n_regionkey""")
def merge_driver(spark, d):
    classes = _classes(spark, d, "item")
    nodes = {
        "Entity": frame(spark, d, "SELECT concat('ent-', vec_id) AS id, concat('item ', vec_id) AS name, CAST(NULL AS ARRAY<STRING>) AS alias, '' AS desc, concat('chk-', label) AS src_id, false AS from_modal, vec_id AS seq FROM {embeddings}"),
        "Assertion": frame(spark, d, "SELECT concat('item ', vec_id) AS head, 'near' AS relation, concat('item ', vec_id % 50) AS tail, '' AS desc, concat('chk-', label) AS src_id, false AS from_modal, vec_id AS seq FROM {embeddings}"),
        "Document": frame(spark, d, "SELECT concat('doc-', n_regionkey) AS id, n_name AS name, n_nationkey AS seq FROM {nation}"),
    }
    out = R.merge(nodes, {"Entity": (classes, _entity_answers(classes))})
    typed = lambda kind, name: out[kind].select(F.lit(kind).alias("type"), name.alias("name"))
    return typed("Entity", F.col("name")).unionByName(typed("Assertion", F.concat_ws("|", "head", "relation", "tail"))).unionByName(typed("Document", F.col("name")))


@query("standard_map_files", COMP + " SELECT 'entities' AS map, 'item ' || id AS old, 'std ' || component AS new FROM cs WHERE size > 1 AND id % 10 <> 7 UNION ALL SELECT 'relations', 'item ' || id, 'std ' || component FROM cs WHERE size > 1")
def standard_map_files(spark, d):
    classes, path = _classes(spark, d, "item"), scratch_path(spark, "maps")
    said, lines = _entity_answers(classes), _relation_answers(classes)
    names = P.alias_map(said.select("response", F.lit(1).alias("ordinal"))).toDF("old", "new")
    sinks.save_standard_maps(path, names, R.standard_relations(lines), said)
    read = lambda kind: spark.read.parquet(f"{path}/{kind}").select(F.lit(kind).alias("map"), "old", "new")
    return read("entities").unionByName(read("relations"))


# ---- modal answers and recall ---------------------------------------------------------

ANSWERS = """SELECT concat('x-', p_partkey) AS src_id, CASE p_partkey % 4 WHEN 0 THEN 'no tags' WHEN 1 THEN concat('<myjson>{"name": "', p_name, '", "class": "c", "caption": "", "content": "t", "desc": "d"}</myjson>')
ELSE concat('text <myjson>{"name": "', p_name, '", "class": "', p_type, '", "caption": "', p_brand, '", "content": "c', p_partkey, '", "desc": "size ', p_size, '"}</myjson> tail') END AS response FROM {part} WHERE p_partkey % 5 > 0"""
MODAL = "SELECT concat('x-', p_partkey) AS id, concat('own ', p_partkey) AS name, CASE WHEN p_partkey % 3 = 0 THEN concat('caption ', p_partkey) ELSE '' END AS caption, 'body' AS content FROM {part}"
_ROWS = "SELECT 'x-' || p_partkey AS id, 'own ' || p_partkey AS own, CASE WHEN p_partkey % 3 = 0 THEN 'caption ' || p_partkey END AS cap, p_partkey % 5 > 0 AND p_partkey % 4 >= 2 AS ok, * FROM part"


@query("table_analysis", f"SELECT id, ok AS llm_ok, coalesce(cap, CASE WHEN ok THEN p_brand END, own) AS name, coalesce(cap, CASE WHEN ok THEN p_brand END) AS caption, CASE WHEN ok THEN concat('size ', p_size) END AS \"desc\" FROM ({_ROWS})")
def table_analysis(spark, d):
    return N.with_analysis(frame(spark, d, MODAL), "Table", frame(spark, d, ANSWERS)).drop("content")


@query("formula_analysis", f"SELECT id, ok AS llm_ok, CASE WHEN ok THEN p_name ELSE own END AS name, CASE WHEN ok THEN p_brand ELSE coalesce(cap, '') END AS caption, CASE WHEN ok THEN concat('size ', p_size) END AS \"desc\" FROM ({_ROWS})")
def formula_analysis(spark, d):
    return N.with_analysis(frame(spark, d, MODAL), "Formula", frame(spark, d, ANSWERS)).drop("content")


@query("image_analysis", f"""SELECT id, ok AS llm_ok, CASE WHEN ok THEN p_name ELSE own END AS name, CASE WHEN ok THEN p_type END AS class, coalesce(cap, CASE WHEN ok THEN p_brand END) AS caption,
CASE WHEN ok THEN 'c' || p_partkey ELSE 'body' END AS content, CASE WHEN ok THEN concat('size ', p_size) END AS "desc" FROM ({_ROWS})""")
def image_analysis(spark, d):
    return N.with_analysis(frame(spark, d, MODAL), "Image", frame(spark, d, ANSWERS))


@query("modal_entities", "SELECT 'ent-' || md5(lower(p_name)) AS id, 'tbl-' || p_partkey AS src_id, p_name AS name, 'thing' AS entity_type, 'size ' || p_size AS \"desc\", true AS from_modal FROM part WHERE p_partkey % 2 = 0")
def modal_entities(spark, d):
    nodes = frame(spark, d, "SELECT concat('tbl-', p_partkey) AS id FROM {part} WHERE p_partkey % 2 = 0")
    said = frame(spark, d, "SELECT concat('tbl-', p_partkey) AS src_id, 1 AS ordinal, concat('entity<|#|>', p_name, '<|#|>thing<|#|>size ', p_size, chr(10), 'relation<|#|>a<|#|>b<|#|>c<|#|>d') AS response FROM {part}")
    return N.modal_entities(nodes, said)


CHUNKS = "SELECT concat('chk-', o_orderkey) AS id, concat('Order ', o_orderkey, ' of ', o_custkey) AS content FROM {orders}"
FOUND = "SELECT concat('chk-', o_orderkey) AS src_id, c_name AS name FROM {orders} JOIN {customer} ON o_custkey = c_custkey UNION ALL SELECT concat('chk-', o_orderkey), concat('Order#', o_orderkey) FROM {orders} WHERE o_orderkey % 3 = 0"
SAID = "SELECT concat('chk-', o_orderkey) AS src_id, c_name AS head, 'placed' AS relation, concat('Order#', o_orderkey) AS tail FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0"


@query("relation_recall", f"""WITH e AS (SELECT src_id, string_agg(DISTINCT name, chr(10) ORDER BY name) AS entities FROM ({plain(FOUND)}) GROUP BY src_id), k AS (SELECT src_id, string_agg(DISTINCT concat_ws(' ', head, relation, tail), chr(10)) AS relations FROM ({plain(SAID)}) GROUP BY src_id)
SELECT id, {filled(MO.TEMPLATES['recall_relations'], {c: c for c in ('entities', 'relations', 'content')})} AS prompt FROM ({plain(CHUNKS)}) c JOIN e ON e.src_id = id LEFT JOIN k ON k.src_id = id""")
def relation_recall(spark, d):
    return N.relation_recall(frame(spark, d, CHUNKS), frame(spark, d, FOUND), frame(spark, d, SAID)).select("id", "prompt")


@query("entity_recall", f"""WITH n AS (SELECT src_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM (SELECT src_id, head AS name FROM ({plain(SAID)}) UNION SELECT src_id, tail FROM ({plain(SAID)})) WHERE name NOT IN (SELECT name FROM ({plain(FOUND)})) GROUP BY src_id)
SELECT id, names, {filled(MO.TEMPLATES['recall_entities'], {c: c for c in ('names', 'content')})} AS prompt FROM ({plain(CHUNKS)}) c JOIN n ON n.src_id = id""")
def entity_recall(spark, d):
    return N.entity_recall(frame(spark, d, CHUNKS), frame(spark, d, SAID), frame(spark, d, FOUND)).select("id", "names", "prompt")


@query("document_call", "SELECT n_name AS name, '' AS llm_out, CAST(NULL AS VARCHAR) AS llm_out_error, '' AS \"desc\", CAST(0 AS BIGINT) AS n_attr FROM nation")
def document_call(spark, d):
    done = N.finish_documents(N.accepted(N.call_without_model(frame(spark, d, "SELECT n_name AS name FROM {nation}"))))
    return done.select("name", "llm_out", "llm_out_error", "desc", F.size("attr").cast("long").alias("n_attr"))


# ---- requests -------------------------------------------------------------------------

TASKED = "SELECT concat('p', c_custkey) AS path_id, c_custkey % 33 AS k, concat('context of ', c_name) AS context FROM {customer}"
_TASKS = ", ".join(f"({i}, '{t[0]}')" for i, t in enumerate(T.TASKS))
_HINTS = "concat_ws(' ', " + ", ".join(f"CASE WHEN contains(task, '{w}') THEN '{h}' END" for w, h in MO.TASK_HINTS.items()) + ")"
_PROMPT = filled(MO.TEMPLATES["qa"], {"graph_context": "context"}) + f" || CASE WHEN length({_HINTS}) > 0 THEN chr(10) || {_HINTS} ELSE '' END"


@query("qa_prompts", f"SELECT path_id, task AS task_type, {_PROMPT} AS prompt, {hashed('qa', _PROMPT)} AS request_hash FROM ({plain(TASKED)}) JOIN (VALUES {_TASKS}) t(i, task) ON i = k")
def qa_prompts(spark, d):
    names = spark.createDataFrame([(i, t[0]) for i, t in enumerate(T.TASKS)] + [(len(T.TASKS), "no such task")], "k long, task_type string")
    contexts = frame(spark, d, TASKED).join(names, "k")
    return MO.qa_requests(contexts, T.task_info(spark)).select("path_id", "task_type", "prompt", "request_hash")


JUDGED = "SELECT concat('p', c_custkey) AS path_id, concat('who is ', c_name, '?') AS q, c_name AS a, 'by name' AS cot, c_mktsegment AS evidence FROM {customer}"
_JUDGES = [("support", ["j0", "j1", "j2"]), ("answer", ["strong", "weak"]), ("complexity", ["j0"])]


@query("judge_requests", " UNION ALL ".join(
    f"SELECT path_id, '{stage}' AS stage, {i} AS model_index, {hashed(stage, filled(MO.TEMPLATES[stage], {c: c for c in ('evidence', 'q', 'a', 'cot')}), repr(m))} AS request_hash FROM ({plain(JUDGED)})"
    for stage, names in _JUDGES for i, m in enumerate(names)))
def judge_requests(spark, d):
    records, out = frame(spark, d, JUDGED), None
    for stage, names in _JUDGES:
        own = MO.judge_requests(records, stage, names).select("path_id", "stage", "model_index", "request_hash")
        out = own if out is None else out.unionByName(own)
    return out


@query("vision_payload", """SELECT s_suppkey, '[{"role":"user","content":[{"type":"text","text":"Describe ' || s_name || '"},{"type":"image_url","image_url":{"url":"' ||
CASE s_suppkey % 3 WHEN 0 THEN 'https://example.org/' || s_suppkey || '.png' WHEN 1 THEN 'data:image/png;base64,' || base64(encode(s_name)) ELSE 'data:image/jpeg;base64,' || base64(encode(s_name)) END || '"}}]}]' AS payload FROM supplier""")
def vision_payload(spark, d):
    rows = frame(spark, d, "SELECT s_suppkey, concat('Describe ', s_name) AS prompt, CASE s_suppkey % 3 WHEN 0 THEN concat('https://example.org/', s_suppkey, '.png') WHEN 1 THEN concat('img/', s_suppkey, '.PNG') ELSE concat('img/', s_suppkey) END AS path, CAST(s_name AS BINARY) AS content FROM {supplier}")
    return rows.select("s_suppkey", MO.vision_payload(F.col("prompt"), MO.data_url("path", "content")).alias("payload"))


@query("batch_rewrite", "SELECT path_id, CASE WHEN length(q) % 2 = 0 THEN 'again: ' || q END AS response FROM (" + plain(JUDGED) + ")")
def batch_rewrite(spark, d):
    rows = frame(spark, d, JUDGED)
    said = MO.llm_map(rows, "answer", spark.createDataFrame([], "request_hash string, response string, ordinal int"), "path_id", "q")
    said = said.where("length(q) % 2 = 0").select("request_hash", F.concat(F.lit("again: "), "q").alias("response"), F.lit(1).alias("ordinal"))
    return MO.llm_map(rows, "answer", said, "path_id").select("path_id", "response")


# ---- graph accessors ------------------------------------------------------------------

@query("node_attributes", f"WITH n AS ({NODES_}) SELECT id, type, name FROM n UNION ALL SELECT 'none-' || r_regionkey, NULL, NULL FROM region")
def node_attributes(spark, d):
    n = frame(spark, d, TYPED_NODES)
    wanted = n.select("id").unionByName(frame(spark, d, "SELECT concat('none-', r_regionkey) AS id FROM {region}"))
    found = G.node_attributes(n, wanted, "type", "name").select("id", "attributes")
    return found.select("id", F.try_element_at("attributes", F.lit("type")).alias("type"), F.try_element_at("attributes", F.lit("name")).alias("name"))


@query("all_relations", f"SELECT to_json({{'head': head, 'relation': relation, 'tail': tail, 'desc': ''}}) AS json FROM ({STAR_})")
def all_relations(spark, d):
    return G.all_relations(frame(spark, d, STAR), as_json=True)


@query("typed_neighbors_with", f"WITH n AS (SELECT id, type, CASE WHEN seq % 2 = 0 THEN name END AS name FROM ({NODES_})), e AS ({EDGES_}) SELECT head AS id, tail AS neighbour, type FROM e JOIN n ON n.id = tail WHERE type IN ('Table', 'Chunk') AND (type <> 'Table' OR name IS NOT NULL) UNION ALL SELECT tail, head, type FROM e JOIN n ON n.id = head WHERE type IN ('Table', 'Chunk') AND (type <> 'Table' OR name IS NOT NULL)")
def typed_neighbors_with(spark, d):
    nodes = frame(spark, d, TYPED_NODES).withColumn("name", F.expr("CASE WHEN seq % 2 = 0 THEN name END"))
    return G.typed_neighbours(typed_edges(spark, d), nodes, "all", ["Table", "Chunk"], {"Table": "name"}, distinct=False)


# ---- scans and sinks ------------------------------------------------------------------

@query("triple_file_scan", f"SELECT DISTINCT head, relation, tail FROM ({STAR_})")
def triple_file_scan(spark, d):
    path = scratch_path(spark, "triples")
    lines = frame(spark, d, STAR).select(F.concat_ws(",", "head", "relation", "tail").alias("value"))
    broken = frame(spark, d, "SELECT concat('two,', n_name) AS value FROM {nation} UNION ALL SELECT concat('a,b,c,', n_name) FROM {nation}")
    lines.unionByName(broken).write.text(path)
    return readers.triple_file(spark, path)


@query("memory_triples", "SELECT DISTINCT n_name AS head, 'in' AS relation, CAST(n_regionkey AS VARCHAR) AS tail FROM nation")
def memory_triples(spark, d):
    return readers.triples(frame(spark, d, "SELECT n_name AS a, 'in' AS b, CAST(n_regionkey AS STRING) AS c FROM {nation} UNION ALL SELECT n_name, 'in', CAST(n_regionkey AS STRING) FROM {nation} UNION ALL SELECT n_name, NULL, 'x' FROM {nation}"))


@query("content_list_scan", f"SELECT doc_name, CAST(row_number() OVER (PARTITION BY doc_name ORDER BY pos) - 1 AS INT) AS pos, type, CASE WHEN type <> 'image' THEN text END AS text, CASE WHEN type = 'table' THEN cap END AS caption FROM ({BLOCKS_})")
def content_list_scan(spark, d):
    path = scratch_path(spark, "contents")
    block = F.struct("pos", "type", F.when(F.col("type") != "image", F.col("text")).alias("text"), F.when(F.col("type") == "table", F.col("table_caption")).alias("table_caption"))
    lists = _blocks(spark, d).groupBy("doc_name").agg(F.to_json(F.array_sort(F.collect_list(block))).alias("json"))
    name = F.concat("doc_name", F.lit("/vlm/"), "doc_name", F.lit("_content_list.json"))
    sinks.write_files(lists.select(name.alias("name"), F.encode("json", "UTF-8").alias("data")), path)
    return readers.content_lists(spark, f"{path}/*/vlm").select("doc_name", "pos", "type", "text", F.col("table_caption")[0].alias("caption"))


def _sheet(texts: list[str]) -> bytes:
    cells = "".join(f'<row><c r="A{i + 1}" t="inlineStr"><is><t>{escape(t)}</t></is></c><c r="B{i + 1}"><v>{i}</v></c></row>' for i, t in enumerate(texts))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return data.getvalue()


@query("workbook_scan", "SELECT 'r' || n_regionkey || '.xlsx' AS doc_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS pos, 'text' AS type, n_name AS text FROM nation")
def workbook_scan(spark, d):
    path = scratch_path(spark, "books")
    texts = frame(spark, d, "SELECT n_regionkey, n_nationkey, n_name FROM {nation}").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("texts"))

    def books(frames):
        for f in frames:
            yield pd.DataFrame({"name": [f"r{k}.xlsx" for k in f["n_regionkey"]], "data": [_sheet(list(t)) for t in f["texts"]]})

    sinks.write_files(texts.mapInPandas(books, "name string, data binary"), path)
    return readers.workbooks(spark, path)


@query("node_table_scan", f"WITH n AS ({NODES_}) SELECT id, type, name FROM n WHERE type IN ('Table', 'Entity')")
def node_table_scan(spark, d):
    path = scratch_path(spark, "nodes")
    sinks.save_nodes(frame(spark, d, TYPED_NODES), path)
    return readers.nodes(spark, path, ["Table", "Entity"]).select("id", "type", "name")


@query("edge_table_scan", f"SELECT head, relation, tail, max(seq) AS seq FROM ({STAR_}) GROUP BY head, relation, tail")
def edge_table_scan(spark, d):
    path = scratch_path(spark, "edges")
    sinks.save_edges(frame(spark, d, STAR), path)
    return readers.edges(spark, path).select("head", "relation", "tail", "seq")


@query("flat_nodes", f"WITH n AS ({NODES_}) SELECT id, type, name FROM n WHERE type IN ('Document', 'Chunk', 'Formula')")
def flat_nodes(spark, d):
    path, n = scratch_path(spark, "flat"), frame(spark, d, TYPED_NODES)
    sinks.save_flat(path, n.where("type = 'Document'").drop("seq"), n.where("type = 'Chunk'"), n.where("type = 'Formula'").select("name", "id", "type"))
    return spark.read.parquet(path).select("id", "type", "name")


@query("record_scan", "SELECT c_custkey AS id, c_name AS q, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS a, c_custkey % 4 <> 2 AS has_a FROM customer")
def record_scan(spark, d):
    path = scratch_path(spark, "records") + ".jsonl"
    rows = frame(spark, d, """SELECT CASE c_custkey % 4 WHEN 1 THEN concat('{"id": ', c_custkey, ', "q": "', c_name, '", "a": null}') WHEN 2 THEN concat('{"id": ', c_custkey, ', "q": "', c_name, '", "b": "', c_mktsegment, '"}') ELSE concat('{"id": ', c_custkey, ', "q": "', c_name, '", "a": "', c_mktsegment, '"}') END AS json, c_custkey, c_mktsegment FROM {customer}""")
    sinks.save_json_lines(rows, path)
    found = readers.json_records(spark, path, "id long, q string, a string, b string", ["id", "q"])
    return found.select("id", "q", F.coalesce("a", "b").alias("a"), F.array_contains("present", "a").alias("has_a"))


@query("ontology_scan", "SELECT n_name AS type FROM nation")
def ontology_scan(spark, d):
    path = scratch_path(spark, "ontology")
    names = frame(spark, d, "SELECT n_name FROM {nation}")
    body = names.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("n_name", F.create_map().cast("map<string,string>")))).alias("Ontology"))).alias("value"))  # one row a type
    body.write.text(path)
    return spark.createDataFrame([(t,) for t in readers.ontology_types(spark, path)], "type string")


@query("graphml_round_trip", "SELECT 'node' AS kind, n_name AS a, '' AS b, CAST(n_regionkey AS VARCHAR) AS value FROM nation UNION ALL SELECT 'edge', n_name, r_name, 'in_region' FROM nation JOIN region ON n_regionkey = r_regionkey")
def graphml_round_trip(spark, d):
    path = scratch_path(spark, "graph") + ".graphml"
    nodes = frame(spark, d, "SELECT n_name AS id, CAST(n_regionkey AS STRING) AS region FROM {nation}")
    edges = frame(spark, d, "SELECT n_name AS head, r_name AS tail, 'in_region' AS relation FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
    sinks.save_graphml(nodes, edges, path)
    n, e = sinks.load_graphml(spark, path)
    plain_ = lambda c: F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), plain_(F.col("attr")["region"]).alias("value")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("head").alias("a"), F.col("tail").alias("b"), plain_(F.col("attr")["relation"]).alias("value")))


@query("attribute_codec", "SELECT c_custkey, base64(encode('[\"' || c_name || '\"]')) AS code FROM customer")
def attribute_codec(spark, d):
    return frame(spark, d, "SELECT c_custkey, c_name AS name FROM {customer}").select("c_custkey", F.regexp_replace(sinks.graphml_column("name")["name"], r"\s", "").alias("code"))


@query("stage_checkpoint", "SELECT c_custkey, c_name FROM customer")
def stage_checkpoint(spark, d):
    path, made = scratch_path(spark, "stages"), []
    for _ in range(2):  # the second run reads what the first committed
        out = sinks.stage(spark, path, "customers", lambda: made.append(1) or frame(spark, d, "SELECT c_custkey, c_name FROM {customer}"))
    assert made == [1]
    return out


@query("failed_responses", "SELECT c_custkey, c_custkey % 3 > 0 AS answered FROM customer")
def failed_responses(spark, d):
    path = scratch_path(spark, "failed")
    good = sinks.save_failed(frame(spark, d, "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS response FROM {customer}"), path)
    return good.select("c_custkey", F.lit(True).alias("answered")).unionByName(spark.read.parquet(path).select("c_custkey", F.lit(False).alias("answered")))


@query("invalid_record_files", "SELECT 'valid' AS kind, count(*) AS n FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT 'MISSING_FIELD', count(*) FROM customer WHERE c_custkey % 3 = 2 HAVING count(*) > 0 UNION ALL SELECT 'samples', least(3, count(*)) FROM customer WHERE c_custkey % 3 = 2")
def invalid_record_files(spark, d):
    path = scratch_path(spark, "checked")
    valid = sinks.split_invalid(QA.validate(QA.qa_records(P.qa(frame(spark, d, QA_TEXT)), frame(spark, d, PATHS), frame(spark, d, RELS))), path)
    report = spark.read.json(f"{path}/report").select(F.col("error_type").alias("kind"), "n")
    counted = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return counted(valid, "valid").unionByName(report).unionByName(counted(spark.read.json(f"{path}/samples"), "samples"))


_GEN = f"SELECT model_name, query, max(f1) AS f1 FROM ({EVALS_}) WHERE example_id % 12 = {{k}} GROUP BY model_name, query"


@query("eval_snapshots", "WITH g AS (" + " UNION ALL ".join(f"SELECT *, {k} AS gen FROM ({_GEN.replace('{k}', str(k))})" for k in range(12)) + ") SELECT model_name, query, max_by(f1, gen) AS f1 FROM g GROUP BY model_name, query")
def eval_snapshots(spark, d):
    """Twelve versions, each over the one before."""
    path, e = scratch_path(spark, "evaluations"), frame(spark, d, EVALS)
    for k in range(12):
        new = e.where(f"example_id % 12 = {k}").groupBy("model_name", "query").agg(F.max("f1").alias("f1"))
        out = sinks.merge_evaluations(spark, path, new, f"v{k}")
    assert len(sinks.snapshots(spark, path)) == 12
    return out


@query("csv_append", f"SELECT model_name, query, CAST(f1 AS VARCHAR) AS f1 FROM ({EVALS_}) UNION ALL SELECT model_name, query, CAST(f1 AS VARCHAR) FROM ({EVALS_})".replace("CAST(f1 AS VARCHAR)", "round(f1, 6)"))
def csv_append(spark, d):
    """Every run appends, so rows of two runs are there twice."""
    path, rows = scratch_path(spark, "csv"), frame(spark, d, EVALS).select("model_name", "query", "f1")
    for _ in range(2):
        sinks.append_csv(rows, path)
    return spark.read.option("header", True).schema("model_name string, query string, f1 double").csv(path).withColumn("f1", F.round("f1", 6))


@query("pivot_file", f"SELECT m.model_name, round(avg(f1) FILTER (task_type = 'click'), 6) AS click, round(avg(f1) FILTER (task_type = 'purchase'), 6) AS purchase FROM (VALUES ('model3'), ('model1'), ('absent')) m(model_name) LEFT JOIN ({EVALS_}) e ON e.model_name = m.model_name GROUP BY m.model_name")
def pivot_file(spark, d):
    path = scratch_path(spark, "pivot")
    sinks.save_pivot(ST.model_task_pivot(frame(spark, d, EVALS), "f1", ["click", "purchase"], ["model3", "model1", "absent"]), path)
    read = spark.read.option("header", True).schema("model_name string, click double, purchase double").csv(path)
    return read.select("model_name", F.round("click", 6).alias("click"), F.round("purchase", 6).alias("purchase"))


@query("page_texts", "SELECT n_regionkey AS doc_name, string_agg(n_name, '' ORDER BY n_nationkey) AS text, avg(CAST(n_nationkey AS DOUBLE)) AS page_idx FROM nation GROUP BY n_regionkey")
def page_texts(spark, d):
    return N.merge_pages(frame(spark, d, "SELECT n_regionkey AS doc_name, n_nationkey AS pos, n_name AS text, CAST(n_nationkey AS DOUBLE) AS page_idx FROM {nation}"))


# ---- drivers --------------------------------------------------------------------------

@query("synthesis_traces")
def synthesis_traces(spark, d):
    """Traces of every task over two random subgraphs, with companions."""
    config = drivers.Config(sampler="random", subgraphs=2, order=400, mode="all")
    found = drivers.traced(frame(spark, d, TYPED_NODES), typed_edges(spark, d), config)
    return found.select("subgraph_id", "task_type", "path_id", F.array_join("companions", ",").alias("companions"), F.array_join("path", "->").alias("path"))


ONE_HOT = "SELECT concat('p', c_custkey) AS path_id, transform(sequence(0, 24), i -> if(i = c_nationkey, 1.0D, 0.0D)) AS vector FROM {customer}"


@query("filter_run", """WITH v AS (SELECT 'p' || c_custkey AS path_id, * FROM customer WHERE c_custkey % 3 < 2), k AS (SELECT min(path_id) AS path_id FROM v GROUP BY c_nationkey)
SELECT path_id, CASE WHEN c_custkey % 2 = 0 THEN 'supported' ELSE 'unsupported' END AS support_label, CASE WHEN c_custkey % 4 = 0 THEN 'simple' WHEN c_custkey % 2 = 0 THEN 'medium' ELSE 'hard' END AS level, CAST(c_custkey % 5 + 1 AS INT) AS score, CAST(1 AS BIGINT) AS num_hops FROM v JOIN k USING (path_id)""")
def filter_run(spark, d):
    """Validation, semantic deduplication and three judges; every stage goes to files and is read back."""
    records = QA.qa_records(P.qa(frame(spark, d, QA_TEXT)), frame(spark, d, PATHS), frame(spark, d, RELS))
    votes = frame(spark, d, "SELECT concat('p', c_custkey) AS path_id, m AS model_index, CASE WHEN c_custkey % 2 = 0 AND m < 2 THEN ' 1 ' ELSE '0' END AS response FROM {customer} CROSS JOIN (SELECT explode(array(0, 1, 2)) AS m) x")
    answers = frame(spark, d, "SELECT concat('p', c_custkey) AS path_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'no' END AS strong, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'no' END AS weak FROM {customer}")
    reviews = frame(spark, d, "SELECT concat('p', c_custkey) AS path_id, concat('complexity score: ', c_custkey % 5 + 1) AS response FROM {customer}")
    out = drivers.filtering(records, votes, answers, reviews, frame(spark, d, ONE_HOT), 0.95, scratch_path(spark, "filter"))
    return out.select("path_id", "support_label", "level", "score", "num_hops")


EXAMPLES = "SELECT item_id AS example_id, concat('task', item_id % 2) AS task_type, concat('q', item_id) AS query, text AS gold_answer FROM {benchmark}"


@query("evaluation_run", """SELECT model_name, example_id, CASE WHEN model_name = 'm0' OR example_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS em, 1.0::DOUBLE AS acc
FROM (SELECT item_id AS example_id FROM benchmark WHERE text IS NOT NULL AND trim(text) <> '') e, (VALUES ('m0'), ('m1')) m(model_name)""")
def evaluation_run(spark, d):
    """Two runs: the second finds all but the new examples scored already, so its other answers change nothing."""
    path = scratch_path(spark, "evaluation")
    examples = frame(spark, d, EXAMPLES).where("gold_answer is not null and trim(gold_answer) <> ''")
    right = examples.select("example_id", F.concat(F.col("gold_answer"), F.expr("if(example_id % 2 = 0, '', ' and more')")).alias("more"), "gold_answer")
    said = right.select(F.lit("m0").alias("model_name"), "example_id", F.col("gold_answer").alias("response")).unionByName(right.select(F.lit("m1").alias("model_name"), "example_id", F.col("more").alias("response")))
    drivers.evaluate(path, examples.where("example_id % 3 > 0"), ["m0", "m1"], said, "v0")
    changed = said.withColumn("response", F.expr("if(example_id % 3 > 0, 'something else', response)"))
    return drivers.evaluate(path, examples, ["m0", "m1"], changed, "v1").select("model_name", "example_id", "em", "acc")


@query("config_scan", "SELECT 'order' AS name, '50' AS value UNION ALL SELECT 'subgraphs', '3' UNION ALL SELECT 'max_steps', '4'")
def config_scan(spark, d):
    path = scratch_path(spark, "config")
    spark.createDataFrame([(json.dumps({"order": 50, "subgraphs": 3}),)], "value string").coalesce(1).write.text(path)
    config = drivers.load_config(spark, path)
    return spark.createDataFrame([(n, str(getattr(config, n))) for n in ("order", "subgraphs", "max_steps")], "name string, value string")


_DIST = lambda metric, column, values: f"SELECT 'distribution' AS section, '{metric}' AS metric, u.key, CAST(count(s.k) AS DOUBLE) AS value FROM (VALUES {', '.join(f'({v!r})' for v in values)}) u(key) LEFT JOIN (SELECT CAST({column} AS VARCHAR) AS k FROM s) s ON s.k = u.key GROUP BY u.key"
_NUM = lambda c: " UNION ALL ".join(f"SELECT 'summary', '{c}', '{k}', coalesce(CAST({f}({c}) AS DOUBLE), 0) FROM s" for k, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("median", "median")))
_BUCKET = "CASE WHEN total_tokens <= 64 THEN '0-64' WHEN total_tokens <= 128 THEN '65-128' WHEN total_tokens <= 256 THEN '129-256' WHEN total_tokens <= 512 THEN '257-512' ELSE '513+' END"
STATISTICS_SQL = (
    f"WITH s AS (SELECT *, {WORDS.replace('{c}', 'q')} AS q_tokens, {WORDS.replace('{c}', 'a')} AS a_tokens, {WORDS.replace('{c}', 'cot')} AS cot_tokens, {TOTAL} AS total_tokens FROM ({SCORED_})), all_ AS ("
    + " UNION ALL ".join([
        _DIST("task_type", "task_type", ["task0", "task1", "task2"]), _DIST("support_label", "support_label", ["supported", "unsupported", "unevaluated"]),
        _DIST("level", "level", ["simple", "medium", "hard", "unevaluated"]), _DIST("score", "score", [str(i) for i in range(6)]), _DIST("bucket", _BUCKET, ST.BUCKETS),
        "SELECT 'distribution', 'num_hops', CAST(num_hops AS VARCHAR), CAST(count(*) AS DOUBLE) FROM s GROUP BY num_hops",
        *(_NUM(c) for c in ("q_tokens", "a_tokens", "cot_tokens", "total_tokens", "num_hops", "score")),
        "SELECT 'rate', 'strong_correct', 'mean', avg(CAST(strong_correct AS INT)) FROM s", "SELECT 'rate', 'weak_correct', 'mean', avg(CAST(weak_correct AS INT)) FROM s",
    ]) + ") SELECT section, metric, key, round(value, 6) AS value FROM all_"
)


@query("statistics_file", STATISTICS_SQL)
def statistics_file(spark, d):
    path = scratch_path(spark, "statistics")
    sinks.save_statistics(ST.statistics(frame(spark, d, SCORED), ["task0", "task1", "task2"]), path)
    return spark.read.schema("section string, metric string, key string, value double").json(path).withColumn("value", F.round("value", 6))
