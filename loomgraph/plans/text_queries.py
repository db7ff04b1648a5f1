"""Queries over documents, responses, records and evaluations, each beside its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import metrics as M
from loomgraph.functions import text as X
from loomgraph.operators import chunking as C
from loomgraph.operators import edges as E
from loomgraph.operators import export as EX
from loomgraph.operators import judge as J
from loomgraph.operators import models as MO
from loomgraph.operators import nodes as N
from loomgraph.operators import parse as P
from loomgraph.operators import qa as QA
from loomgraph.operators import resolve as R
from loomgraph.operators import similarity as SI
from loomgraph.operators import stats as ST
from loomgraph.plans.fixtures import frame, plain, table

Q: dict = {}
SQL: dict[str, str] = {}
THRESHOLD = 0.35
SEED = "loom"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- labels, references, contexts -----------------------------------------------------

BLOCKS = """SELECT concat('Nation', c_nationkey) AS doc_name, CAST(o_orderkey AS INT) * 2 AS pos, 'text' AS type, concat('Order ', o_orderkey, ' see Table ', o_orderkey % 7, ' and Figure ', o_orderkey % 5, '.') AS text, CAST(NULL AS STRING) AS cap, o_orderkey AS seq FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL SELECT concat('Nation', n_nationkey), 100000000 + k, CASE WHEN k < 7 THEN 'table' WHEN k < 12 THEN 'image' ELSE 'equation' END, concat('body ', n_nationkey, ' ', k), CASE WHEN k < 7 THEN concat('Table ', k) WHEN k < 12 THEN concat('Fig ', k - 7) END, 1000000000 + n_nationkey * 100 + k FROM {nation} CROSS JOIN (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM {part} WHERE p_partkey <= 14) x"""
BLOCKS_ = plain(BLOCKS)


def _blocks(spark, d) -> DataFrame:
    b = frame(spark, d, BLOCKS)
    cap = F.when(F.col("cap").isNotNull(), F.array("cap"))
    return b.withColumns({"table_body": F.col("text"), "table_caption": cap, "image_caption": cap, "img_path": F.col("text"), "page_idx": F.lit(0.0)})


@query("document_nodes", f"SELECT 'doc-' || md5(lower(doc_name)) AS id, doc_name AS name, coalesce(string_agg(text || chr(10) || chr(10), '' ORDER BY pos) FILTER (type = 'text'), '') AS content FROM ({BLOCKS_}) GROUP BY doc_name")
def document_nodes(spark, d):
    return N.document_nodes(_blocks(spark, d))


@query("chunk_nodes", f"SELECT 'chk-' || md5(lower(text)) AS id, 'doc-' || md5(lower(doc_name)) AS doc_id, text AS content, text AS name, seq FROM ({BLOCKS_}) WHERE type = 'text'")
def chunk_nodes(spark, d):
    return N.chunk_nodes(_blocks(spark, d))


@query("modal_nodes", f"""SELECT CASE type WHEN 'table' THEN 'tbl-' ELSE 'img-' END || md5(lower(text)) AS id, 'doc-' || md5(lower(doc_name)) AS doc_id, cap AS caption FROM ({BLOCKS_}) WHERE type IN ('table', 'image')""")
def modal_nodes(spark, d):
    b = _blocks(spark, d)
    return N.flatten(N.table_nodes(b), N.image_nodes(b)).select("id", "doc_id", "caption")


@query("formula_context", f"""SELECT 'fml-' || md5(lower(text)) AS id, context FROM (SELECT *, concat_ws(chr(10), last_value(CASE WHEN type = 'text' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
first_value(CASE WHEN type = 'text' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_name ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS context FROM ({BLOCKS_})) WHERE type = 'equation'""")
def formula_context(spark, d):
    return N.formula_nodes(_blocks(spark, d)).select("id", "context")


@query("modal_labels", f"SELECT 'chk-' || md5(lower(text)) AS chunk_id, unnest(list_distinct(regexp_extract_all(text, '(?i)\\b(?:tab|table)\\s*(\\d+)\\b', 1))) AS label FROM ({BLOCKS_}) WHERE type = 'text'")
def modal_labels(spark, d):
    return N.label_mentions(N.chunk_nodes(_blocks(spark, d)), X.TABLE_LABELS).select("chunk_id", "label")


@query("refer_edges", f"""WITH b AS ({BLOCKS_}) SELECT DISTINCT 'chk-' || md5(lower(c.text)) AS head, 'refer_to' AS relation, CASE m.type WHEN 'table' THEN 'tbl-' ELSE 'img-' END || md5(lower(m.text)) AS tail FROM b c JOIN b m ON c.doc_name = m.doc_name AND c.type = 'text'
AND ((m.type = 'table' AND regexp_extract(c.text, 'Table (\\d+)', 1) = regexp_extract(m.cap, '(\\d+)', 1)) OR (m.type = 'image' AND regexp_extract(c.text, 'Figure (\\d+)', 1) = regexp_extract(m.cap, '(\\d+)', 1)))""")
def refer_edges(spark, d):
    b = _blocks(spark, d)
    chunks = N.chunk_nodes(b)
    return E.table_edges(chunks, N.table_nodes(b)).unionByName(E.image_edges(chunks, N.image_nodes(b)))


@query("modal_context", f"""WITH b AS ({BLOCKS_}) SELECT 'tbl-' || md5(lower(m.text)) AS id, string_agg(c.text, chr(10) ORDER BY c.seq) AS context FROM b c JOIN b m ON c.doc_name = m.doc_name AND c.type = 'text' AND m.type = 'table'
AND regexp_extract(c.text, 'Table (\\d+)', 1) = regexp_extract(m.cap, '(\\d+)', 1) GROUP BY m.text""")
def modal_context(spark, d):
    b = _blocks(spark, d)
    return N.modal_context(N.chunk_nodes(b), N.table_nodes(b), "caption", X.TABLE_LABELS)


@query("document_edges", f"""WITH b AS ({BLOCKS_}) SELECT 'chk-' || md5(lower(text)) AS head, 'belongs_to' AS relation, 'doc-' || md5(lower(doc_name)) AS tail FROM b WHERE type = 'text'
UNION ALL SELECT CASE type WHEN 'table' THEN 'tbl-' WHEN 'image' THEN 'img-' ELSE 'fml-' END || md5(lower(text)), 'locate', 'doc-' || md5(lower(doc_name)) FROM b WHERE type <> 'text'""")
def document_edges(spark, d):
    b = _blocks(spark, d)
    return E.chunk_edges(N.chunk_nodes(b)).unionByName(E.modal_edges(N.table_nodes(b), N.image_nodes(b), N.formula_nodes(b)))


@query("source_groups", "SELECT concat('chk-', c_nationkey) AS src_id, string_agg(c_name, '|' ORDER BY c_custkey) AS names FROM customer GROUP BY c_nationkey")
def source_groups(spark, d):
    rows = frame(spark, d, "SELECT concat('chk-', c_nationkey) AS src_id, c_name AS name, c_custkey AS seq FROM {customer}")
    return N.group_by_source(rows, "name").select("src_id", F.array_join(F.transform("rows", lambda r: r["name"]), "|").alias("names"))


# ---- chunks ---------------------------------------------------------------------------

LINES_SQL = r"""WITH l AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS src_id FROM (SELECT doc_id, i, regexp_replace(parts[i], '^\s+|\s+$', '', 'g') AS t
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))) WHERE t <> '')"""


@query("chunk_lines", LINES_SQL + " SELECT doc_id, src_id, t AS text FROM l")
def chunk_lines(spark, d):
    return C.line_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("chunk_metadata", LINES_SQL + r""" SELECT doc_id, src_id, length(t) AS char_count, CAST(len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS BIGINT) AS word_count,
round(coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY src_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(length(t)) OVER (PARTITION BY doc_id), 6) AS position_ratio,
length(t) BETWEEN 200 AND 1000 AS is_optimal_size FROM l""")
def chunk_metadata(spark, d):
    lines = C.line_chunks(table(spark, d, "documents"), "doc_id", "text")
    return C.with_metadata(lines, "doc_id").drop("text").withColumn("position_ratio", F.round("position_ratio", 6))


@query("hybrid_chunks")
def hybrid_chunks(spark, d):
    return C.with_metadata(C.hybrid_chunks(table(spark, d, "documents"), "doc_id", "text"), "doc_id").drop("text")


# ---- replayed responses and their parsers ---------------------------------------------

RESPONSES = """SELECT concat('chk-', o_orderkey) AS src_id, o_orderkey AS ordinal, concat('entity<|#|>', c_name, '<|#|>person<|#|>buys in ', c_mktsegment, chr(10), 'relation<|#|>', c_name, '<|#|>Order#', o_orderkey, '<|#|>placed<|#|>status ', o_orderstatus, chr(10), 'entity<|#|>broken', chr(10), ' <|COMPLETE|> ') AS response FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""


@query("entity_parse", "SELECT 'ent-' || md5(lower(c_name)) AS id, concat('chk-', o_orderkey) AS src_id, c_name AS name, 'person' AS entity_type, 'buys in ' || c_mktsegment AS \"desc\" FROM orders JOIN customer ON o_custkey = c_custkey")
def entity_parse(spark, d):
    return P.entities(frame(spark, d, RESPONSES)).drop("pos")


@query("relation_parse", "SELECT 'ass-' || md5(lower(c_name || '|placed|Order#' || o_orderkey)) AS id, concat('chk-', o_orderkey) AS src_id, c_name AS head, 'placed' AS relation, concat('Order#', o_orderkey) AS tail, 'status ' || o_orderstatus AS \"desc\" FROM orders JOIN customer ON o_custkey = c_custkey")
def relation_parse(spark, d):
    return P.relations(frame(spark, d, RESPONSES)).drop("pos")


@query("std_map_parse", "SELECT DISTINCT lower(p_type) AS old, split_part(p_type, ' ', 1) AS new FROM part UNION SELECT DISTINCT upper(p_type), split_part(p_type, ' ', 1) FROM part")
def std_map_parse(spark, d):
    rows = frame(spark, d, "SELECT DISTINCT concat('relation_std_map<|#|>', split(p_type, ' ')[0], '<|#|>', lower(p_type), ', ', upper(p_type), chr(10), 'noise') AS response FROM {part}")
    return R.standard_relations(rows)


TAGGED = """SELECT concat('tbl-', p_partkey) AS src_id, p_partkey AS ordinal, CASE WHEN p_partkey % 4 = 0 THEN 'no tags' WHEN p_partkey % 4 = 1 THEN concat('<myjson>{"name": "', p_name, '", "caption": "", "desc": "d"}</myjson>') ELSE concat('text <myjson>{"name": "', p_name, '", "caption": "', p_brand, '", "desc": "size ', p_size, '"}', CASE WHEN p_partkey % 4 = 2 THEN '</myjson> tail' ELSE '.' END) END AS response FROM {part}"""


@query("tagged_json_parse", """SELECT concat('tbl-', p_partkey) AS src_id, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS name, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_brand END AS caption,
CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'd' ELSE concat('size ', p_size) END AS "desc", p_partkey % 4 >= 2 AS ok FROM part""")
def tagged_json_parse(spark, d):
    return P.modal_analysis(frame(spark, d, TAGGED))


@query("alias_map_parse", "SELECT lower(p_name) AS name, max_by(p_name, p_partkey) AS standard FROM part GROUP BY 1")
def alias_map_parse(spark, d):
    rows = frame(spark, d, """SELECT p_partkey AS ordinal, concat('<myjson>[{"name": "', p_name, '", "alias": ["', lower(p_name), '"], "desc": ""}]</myjson>') AS response FROM {part}""")
    return P.alias_map(rows)


@query("json_like_parse", """SELECT event_id, concat('v', user_id) AS name, event_type AS kind FROM events""")
def json_like_parse(spark, d):
    rows = frame(spark, d, """SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('{"name": "v', user_id, '", "kind": "', event_type, '"}') WHEN 1 THEN concat("{'name': 'v", user_id, "', 'kind': '", event_type, "'}")
      ELSE concat('{', chr(10), '"name": "v', user_id, '",', chr(10), 'kind: ', event_type, chr(10), '}') END AS response FROM {events}""")
    found = rows.withColumn("m", P.parse_json("response"))
    return found.select("event_id", F.col("m")["name"].alias("name"), F.col("m")["kind"].alias("kind"))


@query("answer_extract", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN concat('plain ', user_id) ELSE CAST(user_id AS VARCHAR) END AS answer FROM events""")
def answer_extract(spark, d):
    rows = frame(spark, d, """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('```json', chr(10), '{"answer": "', user_id, '"}', chr(10), '```') WHEN 1 THEN concat('{"answer":', user_id, '}')
      WHEN 2 THEN concat('<think>hm</think>', chr(10), user_id, chr(10), 'more') ELSE concat('plain ', user_id) END AS response FROM {events}""")
    return rows.select("event_id", P.answer("response").alias("answer"))


@query("request_replay", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'answer ' || c_custkey END AS response FROM customer""")
def request_replay(spark, d):
    rows = frame(spark, d, "SELECT c_custkey, concat('doc of ', c_name) AS content FROM {customer}").withColumn("types", F.lit("person"))
    asked = MO.requests(rows, "extract", MO.fill(MO.TEMPLATES["extract"], {"types": F.col("types"), "content": F.col("content")}), "m", "c_custkey")
    recorded = asked.where("c_custkey % 2 = 0").select("request_hash", F.concat(F.lit("answer "), "c_custkey").alias("response"), F.lit(1).alias("ordinal"))
    return MO.replay(asked, recorded).select("c_custkey", "response")


# ---- QA -------------------------------------------------------------------------------

PATHS = """SELECT concat('p', c_custkey) AS path_id, 0 AS pos, concat('ent-', c_custkey) AS id, 'Entity' AS type, c_name AS name, '' AS content, c_mktsegment AS desc FROM {customer}
UNION ALL SELECT concat('p', c_custkey), 1, concat('doc-', n_nationkey), 'Document', n_name, concat('about ', n_name), '' FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT concat('p', c_custkey), 2, concat('ent-r', n_regionkey), 'Entity', concat('region ', n_regionkey), '', '' FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""
RELS = "SELECT concat('p', c_custkey) AS path_id, 0 AS pos, c_name AS head, 'in' AS relation, n_name AS tail, 'lives' AS desc FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"


@query("qa_context", """SELECT concat('p', c_custkey) AS path_id, concat('## Path', chr(10), 'entities: ', c_name, ' -> region ', n_regionkey, chr(10), 'relations: (', c_name, ', in, ', n_name, '): lives', chr(10), '## Document', chr(10), 'document: ', n_name, chr(10), 'content: about ', n_name, chr(10),
'## Entity', chr(10), '1. ', c_name, chr(10), 'description: ', c_mktsegment, chr(10), '2. region ', n_regionkey, chr(10), '## Answer', chr(10), c_name) AS context, concat('## Document', chr(10), 'document: ', n_name, chr(10), 'content: about ', n_name) AS need_info FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def qa_context(spark, d):
    return QA.path_contexts(frame(spark, d, PATHS), frame(spark, d, RELS), ["Document"])


QA_TEXT = """SELECT concat('p', c_custkey) AS key, CASE c_custkey % 3 WHEN 0 THEN concat('```json', chr(10), '{"question": "who?", "answer": "', c_name, '", "reasoning_path": ["a", "b"]}', chr(10), '```') WHEN 1 THEN concat('{"question": "who?", "answer": "', c_name, '", "reasoning_path": "a"}') ELSE 'not json' END AS response FROM {customer}"""


@query("qa_parse", """SELECT concat('p', c_custkey) AS key, CASE WHEN c_custkey % 3 < 2 THEN 'who?' END AS question, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS answer, CASE c_custkey % 3 WHEN 0 THEN 'a' || chr(10) || 'b' WHEN 1 THEN 'a' END AS cot, c_custkey % 3 < 2 AS ok FROM customer""")
def qa_parse(spark, d):
    return P.qa(frame(spark, d, QA_TEXT))


@query("qa_validate", """SELECT concat('p', c_custkey) AS path_id, c_custkey % 3 < 2 AS is_valid, CASE WHEN c_custkey % 3 = 2 THEN 'missing fields: q, a, cot, evidence' END AS error, CAST(3 AS BIGINT) AS n_nodes, CAST(1 AS BIGINT) AS hops FROM customer""")
def qa_validate(spark, d):
    records = QA.qa_records(P.qa(frame(spark, d, QA_TEXT)), frame(spark, d, PATHS), frame(spark, d, RELS))
    checked = QA.validate(records)
    return checked.select("path_id", "is_valid", "error", F.size("evidence.nodes").cast("long").alias("n_nodes"), QA.num_hops().alias("hops"))


@query("error_report", "SELECT CASE WHEN c_custkey % 3 = 2 THEN 'MISSING_FIELD' END AS error_type, count(*) AS n FROM customer WHERE c_custkey % 3 = 2 GROUP BY 1")
def error_report(spark, d):
    records = QA.qa_records(P.qa(frame(spark, d, QA_TEXT)), frame(spark, d, PATHS), frame(spark, d, RELS))
    return ST.error_report(QA.validate(records).where("NOT is_valid"))


BLUR_H = f"md5(concat_ws('|', '{SEED}', concat('ent-', c_custkey)))"


@query("entity_blur", f"""SELECT id, chosen AS is_blurry, CASE WHEN chosen THEN CASE kind WHEN 'person' THEN ['a certain researcher', 'a scholar in the field', 'one of the authors'][pick + 1]
WHEN 'company' THEN ['a certain organisation', 'an institution in the field', 'one of the companies'][pick + 1] ELSE 'a certain tool' END END AS blurry_name
FROM (SELECT concat('ent-', c_custkey) AS id, CASE c_custkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'company' ELSE 'tool' END AS kind, CAST('0x' || substr({BLUR_H}, 1, 8) AS BIGINT) / 4294967296.0 < 0.5 AS chosen,
CAST('0x' || substr(md5(concat_ws('|', '{SEED}/template', concat('ent-', c_custkey))), 1, 6) AS BIGINT) % 3 AS pick FROM customer)""")
def entity_blur(spark, d):
    rows = frame(spark, d, "SELECT concat('ent-', c_custkey) AS id, 'Entity' AS type, CASE c_custkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'company' ELSE 'tool' END AS entity_type FROM {customer}")
    return QA.blur(rows, SEED).select("id", "is_blurry", "blurry_name")


# ---- judges and statistics ------------------------------------------------------------

@query("support_vote", "SELECT doc_id, CAST(quality + toxic AS BIGINT) AS support_count, CASE WHEN quality + toxic >= 2 THEN 'supported' ELSE 'unsupported' END AS label FROM labels")
def support_vote(spark, d):
    votes = frame(spark, d, "SELECT doc_id, 0 AS model_index, CAST(quality AS STRING) AS response FROM {labels} UNION ALL SELECT doc_id, 1, concat(' ', toxic, ' ') FROM {labels}")
    return J.support(votes, "doc_id")


@query("difficulty_level", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'simple' WHEN quality = 1 THEN 'medium' ELSE 'hard' END AS level, CASE WHEN quality = 1 THEN 'simple' ELSE 'hard' END AS strong_only FROM labels")
def difficulty_level(spark, d):
    rows = frame(spark, d, "SELECT doc_id, CAST(quality AS STRING) AS s, CAST(toxic AS STRING) AS w, '1' AS a FROM {labels}")
    s, w = J.correct("s", "a"), J.correct("w", "a")
    return rows.select("doc_id", J.difficulty(s, w).alias("level"), J.difficulty(s, w, "strong_only").alias("strong_only"))


@query("complexity_score", "SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN user_id % 5 + 1 WHEN 1 THEN user_id % 5 + 1 ELSE 0 END AS INT) AS score, CASE event_id % 3 WHEN 0 THEN 'because ' || event_type WHEN 1 THEN 'rated: ' || (user_id % 5 + 1) ELSE 'none' END AS reason FROM events")
def complexity_score(spark, d):
    rows = frame(spark, d, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('complexity score: ', user_id % 5 + 1, chr(10), 'reason: because ', event_type) WHEN 1 THEN concat('rated: ', user_id % 5 + 1) ELSE 'none' END AS response FROM {events}")
    return rows.select("event_id", P.complexity_score("response").alias("score"), P.complexity_reason("response").alias("reason"))


NUM_HOPS = "SELECT o_orderkey, o_custkey % 4 AS k FROM {orders}"


@query("num_hops", "SELECT o_orderkey, greatest(o_custkey % 4 - 1, 0) AS num_hops FROM orders")
def num_hops(spark, d):
    rows = frame(spark, d, NUM_HOPS).select("o_orderkey", F.expr("transform(sequence(0, int(k)), i -> if(i = 0, 'doc-x', concat(' ent-', i)))").alias("node_ids"))
    return rows.select("o_orderkey", QA.num_hops().alias("num_hops"))


SCORED = """SELECT d.doc_id, text AS q, lang AS a, source AS cot, concat('task', d.doc_id % 3) AS task_type, CASE WHEN quality IS NULL THEN 'unevaluated' WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS support_label,
CASE WHEN quality IS NULL THEN 'unevaluated' WHEN toxic = 1 THEN 'hard' ELSE 'simple' END AS level, coalesce(quality, 0) * 3 AS score, quality = 1 AS strong_correct, toxic = 1 AS weak_correct, d.doc_id % 5 AS num_hops FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"""
SCORED_ = plain(SCORED)
WORDS = r"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"
TOTAL = "(" + " + ".join(WORDS.replace("{c}", c) for c in ("q", "a", "cot")) + ")"


@query("token_stats", f"""WITH s AS (SELECT {WORDS.replace('{c}', 'q')} AS q_tokens, {TOTAL} AS total_tokens FROM ({SCORED_}))
SELECT 'q_tokens' AS metric, CAST(min(q_tokens) AS DOUBLE) AS low, CAST(max(q_tokens) AS DOUBLE) AS high, round(avg(q_tokens), 6) AS mean, median(q_tokens) AS median FROM s UNION ALL SELECT 'total_tokens', min(total_tokens), max(total_tokens), round(avg(total_tokens), 6), median(total_tokens) FROM s""")
def token_stats(spark, d):
    return ST.describe(ST.token_lengths(frame(spark, d, SCORED)), "q_tokens", "total_tokens").withColumn("mean", F.round("mean", 6))


@query("token_buckets", f"""WITH b AS (SELECT CASE WHEN t <= 64 THEN '0-64' WHEN t <= 128 THEN '65-128' WHEN t <= 256 THEN '129-256' WHEN t <= 512 THEN '257-512' ELSE '513+' END AS key FROM (SELECT {TOTAL} AS t FROM ({SCORED_})))
SELECT u.key, count(b.key) AS n FROM (VALUES ('0-64'), ('65-128'), ('129-256'), ('257-512'), ('513+')) u(key) LEFT JOIN b ON u.key = b.key GROUP BY u.key""")
def token_buckets(spark, d):
    rows = ST.token_lengths(frame(spark, d, SCORED)).select(ST.bucket("total_tokens").alias("b"))
    return ST.distribution(rows, "b", ST.BUCKETS)


@query("task_distribution", f"SELECT u.key, count(s.task_type) AS n FROM (VALUES ('task0'), ('task1'), ('task2'), ('never')) u(key) LEFT JOIN ({SCORED_}) s ON s.task_type = u.key GROUP BY u.key")
def task_distribution(spark, d):
    return ST.distribution(frame(spark, d, SCORED), "task_type", ["task0", "task1", "never"])


@query("correct_rates", f"SELECT round(avg(CAST(strong_correct AS INT)), 6) AS strong_rate, round(avg(CAST(weak_correct AS INT)), 6) AS weak_rate FROM ({SCORED_})")
def correct_rates(spark, d):
    return ST.correct_rates(frame(spark, d, SCORED)).select(F.round("strong_rate", 6).alias("strong_rate"), F.round("weak_rate", 6).alias("weak_rate"))


@query("hop_distribution", f"SELECT CAST(num_hops AS VARCHAR) AS key, count(*) AS n FROM ({SCORED_}) GROUP BY num_hops")
def hop_distribution(spark, d):
    return ST.distribution(frame(spark, d, SCORED), "num_hops")


# ---- evaluation -----------------------------------------------------------------------

#: Whole texts of all documents: against the same text, a benchmark item, or the document before.
PAIRS = """SELECT d.doc_id, concat(coalesce(d.text, ''), CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE ' tail' END) AS pred,
CASE WHEN d.doc_id % 3 = 0 THEN concat(' ', d.text) WHEN d.doc_id % 3 = 1 THEN b.text ELSE o.text END AS gold
FROM {documents} d LEFT JOIN {benchmark} b ON d.doc_id % 3 = 1 AND b.item_id = d.doc_id % (SELECT count(*) FROM {benchmark})
LEFT JOIN {documents} o ON d.doc_id % 3 = 2 AND o.doc_id = d.doc_id - 1"""
PAIRS_ = plain(PAIRS)
NORM = r"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"
TOK = r"list_filter(regexp_split_to_array(" + NORM + r", '\s+'), lambda x: x <> '')"
HARMONIC = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"


def _six(x):
    """Six places, halves (and what misses them by a rounding error) up: the engines' round() differ there."""
    return F.floor(x * 1000000 + 0.500001) / 1000000


@query("em_acc", f"SELECT doc_id, CASE WHEN regexp_replace(pred, '^\\s+|\\s+$', '', 'g') = regexp_replace(gold, '^\\s+|\\s+$', '', 'g') THEN 1.0 ELSE 0.0 END::DOUBLE AS em, CASE WHEN contains({NORM.replace('{c}', 'pred')}, {NORM.replace('{c}', 'gold')}) THEN 1.0 ELSE 0.0 END::DOUBLE AS acc FROM ({PAIRS_})")
def em_acc(spark, d):
    return frame(spark, d, PAIRS).select("doc_id", M.exact_match(F.col("pred"), F.col("gold")).alias("em"), M.accuracy("pred", "gold").alias("acc"))


@query("f1_tokens", f"""SELECT doc_id, floor(CASE WHEN len(g) = 0 THEN 0 ELSE {HARMONIC} END * 1000000 + 0.500001) / 1000000 AS f1 FROM (SELECT *, CASE WHEN len(q) > 0 THEN c / len(q) ELSE 0 END AS p, c / greatest(len(g), 1) AS r FROM (SELECT doc_id, q, g, CAST(len(list_intersect(list_distinct(q), list_distinct(g))) AS DOUBLE) AS c
FROM (SELECT doc_id, {TOK.replace('{c}', 'pred')} AS q, {TOK.replace('{c}', 'gold')} AS g FROM ({PAIRS_}))))""")
def f1_tokens(spark, d):
    return frame(spark, d, PAIRS).select("doc_id", _six(M.token_f1("pred", "gold")).alias("f1"))


def _rouge_sql(n: int) -> str:
    gram = lambda t: t if n == 1 else f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(pred), '[a-z0-9]+') AS q, regexp_extract_all(lower(gold), '[a-z0-9]+') AS g FROM ({PAIRS_})), s AS (SELECT doc_id, {gram('q')} AS q, {gram('g')} AS g FROM t),
a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(q) AS w FROM s) GROUP BY doc_id, w), b AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(g) AS w FROM s) GROUP BY doc_id, w),
c AS (SELECT a.doc_id, sum(least(a.n, b.n)) AS c FROM a JOIN b ON a.doc_id = b.doc_id AND a.w = b.w GROUP BY a.doc_id)
SELECT doc_id, floor({HARMONIC} * 1000000 + 0.500001) / 1000000 AS rouge{n} FROM (SELECT s.doc_id, CAST(coalesce(c, 0) AS DOUBLE) / greatest(len(q), 1) AS p, CAST(coalesce(c, 0) AS DOUBLE) / greatest(len(g), 1) AS r FROM s LEFT JOIN c ON s.doc_id = c.doc_id)"""


@query("rouge_1", _rouge_sql(1))
def rouge_1(spark, d):
    return frame(spark, d, PAIRS).select("doc_id", _six(M.rouge_n("pred", "gold", 1)).alias("rouge1"))


@query("rouge_2", _rouge_sql(2))
def rouge_2(spark, d):
    return frame(spark, d, PAIRS).select("doc_id", _six(M.rouge_n("pred", "gold", 2)).alias("rouge2"))


@query("rouge_l")
def rouge_l(spark, d):
    return frame(spark, d, PAIRS).select("doc_id", _six(M.rouge_l("pred", "gold")).alias("rougeL"))


EVALS = "SELECT event_id AS example_id, concat('model', user_id % 4) AS model_name, event_type AS task_type, concat('q', event_id % 500) AS query, value / 100.0 AS em, value / 50.0 AS acc, value AS f1, value + 1 AS rouge1, value + 2 AS rouge2, value + 3 AS rougeL FROM {events}"
EVALS_ = plain(EVALS)


@query("model_means", "SELECT model_name, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ST.METRICS) + f" FROM ({EVALS_}) GROUP BY model_name")
def model_means(spark, d):
    means = ST.model_means(frame(spark, d, EVALS))
    return means.select("model_name", *(F.round(m, 6).alias(m) for m in ST.METRICS))


@query("model_task_pivot", f"""SELECT m.model_name, round(avg(f1) FILTER (task_type = 'click'), 6) AS click, round(avg(f1) FILTER (task_type = 'purchase'), 6) AS purchase FROM (VALUES ('model3'), ('model1'), ('absent')) m(model_name) LEFT JOIN ({EVALS_}) e ON e.model_name = m.model_name GROUP BY m.model_name""")
def model_task_pivot(spark, d):
    out = ST.model_task_pivot(frame(spark, d, EVALS), "f1", ["click", "purchase"], ["model3", "model1", "absent"])
    return out.select("model_name", F.round("click", 6).alias("click"), F.round("purchase", 6).alias("purchase"))


@query("eval_upsert", f"""SELECT model_name, query, max_by(f1, row(gen, f1)) AS f1 FROM (SELECT model_name, query, f1, 1 AS gen FROM ({EVALS_}) WHERE example_id % 2 = 0 UNION ALL SELECT model_name, query, max(f1), 0 FROM ({EVALS_}) GROUP BY model_name, query) GROUP BY model_name, query""")
def eval_upsert(spark, d):
    e = frame(spark, d, EVALS).select("model_name", "query", "f1", "example_id")
    old = e.groupBy("model_name", "query").agg(F.max("f1").alias("f1"))
    return R.upsert(old, e.where("example_id % 2 = 0").select("model_name", "query", "f1"), "model_name", "query")


@query("eval_pending", f"SELECT m.model_name, e.example_id FROM (SELECT event_id AS example_id FROM events) e, (VALUES ('model0'), ('model1')) m(model_name) WHERE NOT EXISTS (FROM ({EVALS_}) x WHERE x.model_name = m.model_name AND x.example_id = e.example_id)")
def eval_pending(spark, d):
    e = frame(spark, d, EVALS)
    models = spark.createDataFrame([("model0",), ("model1",)], "model_name string")
    return ST.pending(e.select("example_id"), models, e)


# ---- similarity -----------------------------------------------------------------------

COS_SQL = f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), c AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id WHERE list_dot_product(a.x, b.x) >= {THRESHOLD} * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)))"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("cosine_pairs", COS_SQL + " SELECT a, b FROM c")
def cosine_pairs(spark, d):
    return SI.cosine_pairs(_vectors(spark, d), THRESHOLD).select("a", "b")


@query("sim_components", COS_SQL.replace("WITH v", "WITH RECURSIVE v") + ", l AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c), r AS (SELECT id, id AS k FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.k = l.a) SELECT id, min(k) AS component FROM r GROUP BY id")
def sim_components(spark, d):
    return SI.similarity_classes(_vectors(spark, d), THRESHOLD)


@query("greedy_dedup")
def greedy_dedup(spark, d):
    return SI.greedy_dedup(_vectors(spark, d), THRESHOLD)


@query("entity_merge_by_sim", "SELECT 'ent-' || md5(lower(standard)) AS id, standard AS name, array_to_string(list_sort(list_distinct(list(p_name))), '|') AS alias, count(DISTINCT p_brand) AS n_src FROM (SELECT p_name, p_brand, split_part(p_name, ' ', 1) AS standard FROM part WHERE p_name NOT LIKE '%s') GROUP BY standard")
def entity_merge_by_sim(spark, d):
    parts = frame(spark, d, "SELECT p_name AS name, p_brand AS src_id FROM {part}")
    classes = parts.select("name", F.split("name", " ")[0].alias("component"), F.lit(2).alias("size")).distinct()
    aliases = classes.where("name NOT LIKE '%s'").select("name", F.col("component").alias("standard"))
    merged = R.merge_by_standard_name(parts, aliases, classes)
    return merged.select("id", "name", F.array_join("alias", "|").alias("alias"), F.size("src_id_list").cast("long").alias("n_src"))


# ---- export ---------------------------------------------------------------------------

#: All turns of a role in order, one a line; the engines write ordered aggregates differently.
_SIDES = (("user", "q"), ("assistant", "a"), ("system", "cot"))
TURNS = "SELECT conv_id, " + ", ".join(f"listagg(CASE WHEN role = '{r}' THEN text END, '\n') WITHIN GROUP (ORDER BY turn, text) AS {c}" for r, c in _SIDES) + " FROM {conversations} GROUP BY conv_id"
TURNS_ = "SELECT conv_id, " + ", ".join(f"string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = '{r}') AS {c}" for r, c in _SIDES) + " FROM conversations GROUP BY conv_id"
S_, R_ = f"'{EX.SYSTEM}'", "coalesce(cot, '') || chr(10) || chr(10) || 'Answer: ' || coalesce(a, '')"


def _export(name: str, sql: str):
    full = f"SELECT conv_id, {sql} AS json FROM ({TURNS_})"

    @query(f"export_{name}", full)
    def run(spark, d):
        return EX.convert(frame(spark, d, TURNS), name, key="conv_id")


_export("messages", f"to_json({{'messages': [{{'role': 'system', 'content': {S_}}}, {{'role': 'user', 'content': coalesce(q, '')}}, {{'role': 'assistant', 'content': {R_}}}]}})")
_export("sharegpt", f"to_json({{'system': {S_}, 'conversation': [{{'human': coalesce(q, ''), 'assistant': {R_}}}]}})")
_export("query_response", f"to_json({{'system': {S_}, 'query': coalesce(q, ''), 'response': {R_}, 'history': []::VARCHAR[]}})")
_export("alpaca", f"to_json({{'system': {S_}, 'instruction': coalesce(q, ''), 'input': '', 'output': {R_}}})")
