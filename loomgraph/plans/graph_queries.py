"""Queries over the star triples and the typed star graph, each beside its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import edges as E
from loomgraph.operators import graph as G
from loomgraph.operators import nodes as N
from loomgraph.operators import resolve as R
from loomgraph.operators import sampling as S
from loomgraph.operators import traces as T
from loomgraph.plans.fixtures import STAR, TYPED_EDGES, TYPED_NODES, frame, plain, typed_edges
from loomgraph.scratch import materialize

Q: dict = {}
SQL: dict[str, str] = {}
STAR_ = plain(STAR)
NODES_, EDGES_ = plain(TYPED_NODES), plain(TYPED_EDGES)
WITH_TYPED = f"WITH n AS ({NODES_}), e AS ({EDGES_})"
ENT = lambda c: f"'ent-' || md5(lower({c}))"
SEED = "loom"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _typed(spark, d):
    return frame(spark, d, TYPED_NODES), typed_edges(spark, d)


@query("triples_scan", f"SELECT DISTINCT head, relation, tail FROM ({STAR_})")
def triples_scan(spark, d) -> DataFrame:
    return frame(spark, d, STAR).select("head", "relation", "tail").distinct()


@query("assertion_nodes", f"SELECT DISTINCT 'ass-' || md5(lower(concat_ws('|', head, relation, tail))) AS id, head, relation, tail FROM ({STAR_})")
def assertion_nodes(spark, d):
    return N.assertion_nodes(frame(spark, d, STAR))


@query("entity_nodes", f"WITH t AS ({STAR_}) SELECT DISTINCT {ENT('name')} AS id, name FROM (SELECT head AS name FROM t UNION SELECT tail FROM t)")
def entity_nodes(spark, d):
    return N.entity_nodes(frame(spark, d, STAR))


@query("kg_edges", f"SELECT DISTINCT {ENT('head')} AS head, relation, {ENT('tail')} AS tail FROM ({STAR_})")
def kg_edges(spark, d):
    return E.identified(E.deduplicate(E.folded(frame(spark, d, STAR))).select("head", "relation", "tail"))


@query("dangling_edge_filter", f"""WITH t AS ({STAR_}), k AS (SELECT name FROM (SELECT head AS name FROM t UNION SELECT tail FROM t) WHERE name NOT LIKE '%7')
SELECT DISTINCT {ENT('head')} AS head, relation, {ENT('tail')} AS tail FROM t WHERE head IN (SELECT name FROM k) AND tail IN (SELECT name FROM k)""")
def dangling_edge_filter(spark, d):
    t = frame(spark, d, STAR)
    kept = N.entity_nodes(t).where("name NOT LIKE '%7'").select(F.lower("name").alias("id"))
    return E.identified(G.valid_edges(E.folded(t).select("head", "relation", "tail"), kept).distinct())


PARALLEL = "SELECT concat('Part#', l_partkey) AS head, concat('Supplier#', l_suppkey) AS tail, CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'retail' END AS relation, concat('order ', l_orderkey, '/', l_linenumber) AS desc, l_orderkey * 10 + l_linenumber AS seq FROM {lineitem}"
PARALLEL_ = plain(PARALLEL).replace("AS desc", 'AS "desc"')


@query("edge_dedup_last", f'SELECT head, tail, relation, max_by("desc", row(seq, "desc")) AS "desc" FROM ({PARALLEL_}) GROUP BY head, tail, relation')
def edge_dedup_last(spark, d):
    return E.deduplicate(frame(spark, d, PARALLEL)).drop("seq")


@query("graph_collapse", f'SELECT head, tail, max_by(relation, row(seq, relation, "desc")) AS relation, max_by("desc", row(seq, relation, "desc")) AS "desc" FROM ({PARALLEL_}) GROUP BY head, tail')
def graph_collapse(spark, d):
    return G.collapse(frame(spark, d, PARALLEL)).drop("seq")


@query("node_degree", f"{WITH_TYPED} SELECT id, CAST(sum(i) AS BIGINT) AS in_deg, CAST(sum(o) AS BIGINT) AS out_deg FROM (SELECT head AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT tail, 1, 0 FROM e) GROUP BY id")
def node_degree(spark, d):
    return G.degrees(_typed(spark, d)[1])


NEAR = "SELECT DISTINCT a AS id, b AS neighbour, type FROM (SELECT head AS a, tail AS b FROM e UNION SELECT tail, head FROM e) JOIN n ON b = n.id"


@query("neighbor_type_hist", f"{WITH_TYPED} SELECT id, type, count(*) AS n FROM ({NEAR}) GROUP BY id, type")
def neighbor_type_hist(spark, d):
    n, e = _typed(spark, d)
    return G.neighbour_types(e, n)


@query("typed_neighbors", f"{WITH_TYPED} SELECT DISTINCT tail AS id, head AS neighbour, type FROM e JOIN n ON head = n.id WHERE type IN ('Entity', 'Image')")
def typed_neighbors(spark, d):
    n, e = _typed(spark, d)
    return G.typed_neighbours(e, n, "in", ["Entity", "Image"])


@query("node_triples", f"{WITH_TYPED} SELECT 'out' AS side, head AS id, relation, name FROM e JOIN n ON tail = id UNION ALL SELECT 'in', tail, relation, name FROM e JOIN n ON head = id")
def node_triples(spark, d):
    n, e = _typed(spark, d)
    side = lambda df, s: df.select(F.lit(s).alias("side"), "id", "relation", "name")
    return side(G.out_triples(e, n), "out").unionByName(side(G.in_triples(e, n), "in"))


@query("node_relations", f"WITH t AS ({STAR_}) SELECT head AS id, head, relation, tail FROM t UNION ALL SELECT tail, head, relation, tail FROM t")
def node_relations(spark, d):
    return G.node_relations(frame(spark, d, STAR))


@query("object_lookup", f"SELECT head, relation, min_by(tail, row(seq, tail)) AS tail FROM ({STAR_}) GROUP BY head, relation")
def object_lookup(spark, d):
    return G.objects(frame(spark, d, STAR))


@query("graph_summary", f"{WITH_TYPED} SELECT (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS relationship_count")
def graph_summary(spark, d):
    return G.summary(*_typed(spark, d))


@query("node_types", f"SELECT DISTINCT type FROM ({NODES_})")
def node_types(spark, d):
    return G.node_types(_typed(spark, d)[0])


# ---- start nodes, companions, samples -------------------------------------------------

_TASK_ROWS = ", ".join(f"('{t}', {c}, {tb}, {i}, {f})" for t, c, tb, i, f, _ in T.TASKS)
START_SQL = f"""{WITH_TYPED}, near AS ({NEAR}), task(task, c, t, i, f) AS (VALUES {_TASK_ROWS}),
hist AS (SELECT id, count(*) FILTER (type = 'Chunk') AS c, count(*) FILTER (type = 'Table') AS t, count(*) FILTER (type = 'Image') AS i, count(*) FILTER (type = 'Formula') AS f FROM near GROUP BY id),
cand AS (SELECT task.task, n.id, row_number() OVER (PARTITION BY task.task ORDER BY md5(concat_ws('|', '{SEED}', task.task, n.id)), n.id) AS r
  FROM n JOIN hist ON n.id = hist.id, task WHERE n.type = 'Entity' AND hist.c >= task.c AND hist.t >= task.t AND hist.i >= task.i AND hist.f >= task.f)
"""


@query("start_candidates", START_SQL + "SELECT task, id FROM cand WHERE r <= 10")
def start_candidates(spark, d):
    n, e = _typed(spark, d)
    return T.start_candidates(e, n, T.task_info(spark), SEED)


@query("companion_pick", START_SQL + f""", want AS (SELECT task, 'Chunk' AS type, c AS k FROM task UNION ALL SELECT task, 'Table', t FROM task UNION ALL SELECT task, 'Image', i FROM task UNION ALL SELECT task, 'Formula', f FROM task)
SELECT task, start, type, id FROM (SELECT cand.task, cand.id AS start, near.type, near.neighbour AS id, k,
  row_number() OVER (PARTITION BY cand.task, cand.id, near.type ORDER BY md5(concat_ws('|', '{SEED}', cand.id, near.neighbour)), near.neighbour) AS p
  FROM cand JOIN want ON cand.task = want.task JOIN near ON near.id = cand.id AND near.type = want.type WHERE cand.r <= 10) WHERE p <= k""")
def companion_pick(spark, d):
    n, e = _typed(spark, d)
    tasks = T.task_info(spark)
    return T.companions(materialize(T.start_candidates(e, n, tasks, SEED), "starts"), e, n, tasks, SEED)


@query("degree_band_starts", f"""{WITH_TYPED}, g AS (SELECT n.id, count(x.id) AS degree FROM n LEFT JOIN (SELECT head AS id FROM e UNION ALL SELECT tail FROM e) x ON n.id = x.id GROUP BY n.id),
r AS (SELECT *, row_number() OVER (ORDER BY degree DESC, id) - 1 AS k, (count(*) OVER ()) // 4 AS q FROM g)
SELECT 'high' AS band, id, degree FROM r WHERE k < q UNION ALL SELECT 'medium', id, degree FROM r WHERE k >= q AND k < q * 3""")
def degree_band_starts(spark, d):
    n, e = _typed(spark, d)
    return T.degree_bands(e, n)


@query("random_sampler", f"SELECT id FROM (SELECT DISTINCT id FROM ({NODES_})) ORDER BY md5(concat_ws('|', '{SEED}', id)), id LIMIT 100")
def random_sampler(spark, d):
    return S.random_nodes(_typed(spark, d)[0], 100, SEED)


@query("induced_subgraph", f"""{WITH_TYPED}, s AS (SELECT id FROM n ORDER BY md5(concat_ws('|', '{SEED}', id)), id LIMIT 2000)
SELECT head, relation, tail FROM e WHERE head IN (FROM s) AND tail IN (FROM s)""")
def induced_subgraph(spark, d):
    n, e = _typed(spark, d)
    return G.induced_subgraph(e, S.random_nodes(n, 2000, SEED))


@query("bfs_sampler")
def bfs_sampler(spark, d):
    n, e = _typed(spark, d)
    return S.samples(n, e, "bfs", 2, 100, SEED)


@query("acs_sampler")
def acs_sampler(spark, d):
    n, e = _typed(spark, d)
    return S.samples(n, e, "acs", 1, 100, SEED)


def _traces(spark, d, mode):
    n, e = _typed(spark, d)
    tasks = T.task_info(spark)
    starts = materialize(T.start_candidates(e, n, tasks, SEED), "starts")
    e = G.stored(e)
    found = None
    for most in sorted({t[-1] for t in T.TASKS}):
        own = starts.join(F.broadcast(tasks.where(F.col("max_steps") == most).select(F.col("task_type").alias("task"))), "task")
        traces = T.dfs_traces(own.select("id"), e, most, SEED, mode=mode)
        rows = own.join(traces, own.id == traces.start).select("task", "start", F.array_join("path", "->").alias("path"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("dfs_traces")
def dfs_traces(spark, d):
    return _traces(spark, d, "out")


@query("dfs_traces_in")
def dfs_traces_in(spark, d):
    return _traces(spark, d, "in")


@query("dfs_traces_all")
def dfs_traces_all(spark, d):
    return _traces(spark, d, "all")


@query("hub_bridges", f"""{WITH_TYPED}, h AS (SELECT n.id FROM n JOIN (SELECT tail, count(*) AS g FROM e GROUP BY tail) ON n.id = tail WHERE type IN ('Table', 'Image', 'Formula') ORDER BY g DESC, n.id LIMIT 10),
b AS (SELECT DISTINCT head, tail FROM e WHERE tail IN (FROM h)) SELECT a.tail AS hub_a, b.tail AS hub_b, a.head AS bridge FROM b a JOIN b ON a.head = b.head AND a.tail < b.tail""")
def hub_bridges(spark, d):
    n, e = _typed(spark, d)
    return T.bridges(e, n)


# ---- paths ----------------------------------------------------------------------------

PATH_SQL = f"""WITH RECURSIVE t AS (SELECT DISTINCT {ENT('head')} AS head, relation, {ENT('tail')} AS tail FROM ({STAR_})), g AS (SELECT DISTINCT head, tail FROM t),
p(path, last, len) AS (SELECT [head, tail], tail, 1 FROM g WHERE head <> tail UNION ALL SELECT list_append(path, g.tail), g.tail, len + 1 FROM p JOIN g ON last = g.head WHERE len < 3 AND NOT list_contains(path, g.tail))
"""


@query("khop_paths", PATH_SQL + "SELECT array_to_string(path, '->') AS path, CAST(len AS BIGINT) AS len FROM p")
def khop_paths(spark, d):
    """Paths of up to three steps over all relations."""
    # every end is an entity of these triples, so no edge dangles; of parallel edges a path has one
    paths = T.khop_paths(E.identified(E.folded(frame(spark, d, STAR)).select("head", "relation", "tail").distinct()), 3)
    return paths.select(F.array_join("path", "->").alias("path"), F.col("len").cast("long").alias("len"))


@query("path_relations", PATH_SQL + """SELECT array_to_string(path, '->') AS path_id, CAST(i - 1 AS BIGINT) AS pos, t.head, t.relation, t.tail
FROM (SELECT path, unnest(range(1, len(path))) AS i FROM p) JOIN t ON t.head = path[i] AND t.tail = path[i + 1]""")
def path_relations(spark, d):
    """The edges of all paths of up to three steps over all relations."""
    e = E.identified(E.folded(frame(spark, d, STAR)).select("head", "relation", "tail").distinct())
    return T.khop_relations(e, 3).withColumn("pos", F.col("pos").cast("long"))


@query("path_dedup", f"""SELECT DISTINCT {ENT("concat('Part#', l_partkey)")} || '->' || {ENT("concat('Supplier#', l_suppkey)")} AS path FROM lineitem""")
def path_dedup(spark, d):
    e = E.relation_edges(frame(spark, d, PARALLEL))
    return T.deduplicate(e.select(F.array("head", "tail").alias("path"))).select(F.array_join("path", "->").alias("path"))


@query("shortest_path_len", f"""WITH RECURSIVE t AS (SELECT DISTINCT head, tail FROM ({STAR_})), s AS (SELECT DISTINCT head AS src FROM t),
w(src, dst, len) AS (SELECT src, src, 0 FROM s UNION SELECT src, tail, len + 1 FROM w JOIN t ON dst = head WHERE len < 8)
SELECT src, dst, CAST(min(len) AS BIGINT) AS len FROM w GROUP BY src, dst""")
def shortest_path_len(spark, d):
    """From every head over all edges, to any distance; the star has no path of more than five steps."""
    e = frame(spark, d, STAR)
    return G.shortest_paths(e, e.select(F.col("head").alias("src")).distinct(), None).withColumn("len", F.col("len").cast("long"))


# ---- rewrites and merges --------------------------------------------------------------

@query("alias_rewrite", f"""WITH t AS ({STAR_}) SELECT coalesce('Nation of ' || h.r_name, head) AS head, relation, coalesce('Nation of ' || x.r_name, tail) AS tail FROM t
LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) h ON head = h.n_name LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) x ON tail = x.n_name""")
def alias_rewrite(spark, d):
    mapping = frame(spark, d, "SELECT n_name AS old, concat('Nation of ', r_name) AS new FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
    return R.rewrite(frame(spark, d, STAR), mapping, "head", "tail").select("head", "relation", "tail")


@query("relation_rewrite", f"SELECT head, CASE relation WHEN 'in_nation' THEN 'located_in' WHEN 'in_region' THEN 'located_in' ELSE relation END AS relation, tail FROM ({STAR_})")
def relation_rewrite(spark, d):
    mapping = spark.createDataFrame([("in_nation", "located_in"), ("in_region", "located_in")], "old string, new string")
    return R.rewrite(frame(spark, d, STAR), mapping, "relation").select("head", "relation", "tail")


@query("edge_correction", f"""WITH t AS ({STAR_}), x AS (SELECT CASE WHEN head LIKE 'Customer%' THEN 'Customer' ELSE head END AS head, CASE relation WHEN 'in_region' THEN 'located_in' ELSE relation END AS relation, CASE WHEN tail LIKE 'Customer%' THEN 'Customer' ELSE tail END AS tail, seq FROM t)
SELECT head, relation, tail, max(seq) AS seq FROM x GROUP BY head, relation, tail""")
def edge_correction(spark, d):
    t = frame(spark, d, STAR)
    merged = t.where("head LIKE 'Customer%'").select(F.col("head").alias("old"), F.lit("Customer").alias("new")).distinct()
    return E.correct(t, merged, t.sparkSession.createDataFrame([("in_region", "located_in")], "old string, new string"))


@query("missing_entities", f"WITH t AS ({STAR_}) SELECT name FROM (SELECT head AS name FROM t UNION SELECT tail FROM t) WHERE name NOT IN (SELECT c_name FROM customer) AND name NOT IN (SELECT n_name FROM nation)")
def missing_entities(spark, d):
    known = frame(spark, d, "SELECT c_name AS name FROM {customer} UNION ALL SELECT n_name FROM {nation}")
    return R.missing_entities(frame(spark, d, STAR), known)


ASSERT = "SELECT concat('Part#', l_partkey) AS head, l_returnflag AS relation, concat('Supplier#', l_suppkey) AS tail, concat('q', CAST(l_quantity AS INT)) AS desc, concat('Order#', l_orderkey) AS src_id, l_linestatus = 'O' AND l_linenumber > 3 AS from_modal, l_orderkey * 10 + l_linenumber AS seq FROM {lineitem}"


@query("assertion_merge", f"""SELECT head, relation, tail, string_agg("desc", chr(10) ORDER BY seq, "desc") AS "desc", count(DISTINCT src_id) AS n_src FROM ({plain(ASSERT).replace('AS desc', 'AS "desc"')}) GROUP BY head, relation, tail HAVING NOT bool_and(from_modal)""")
def assertion_merge(spark, d):
    merged = R.merge_assertions(frame(spark, d, ASSERT))
    return merged.select("head", "relation", "tail", "desc", F.size("src_id_list").cast("long").alias("n_src"))


PARTS = "SELECT concat('ent-', md5(lower(p_name))) AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, concat('size ', p_size) AS desc, p_brand AS src_id, p_partkey % 5 = 0 AS from_modal, p_partkey AS seq, p_type AS kind FROM {part}"
PARTS_ = plain(PARTS).replace("AS desc", 'AS "desc"')


@query("entity_merge_by_id", f"""SELECT id, arg_min(name, k) AS name, arg_min("desc", k) AS "desc", array_to_string(list_sort(list_distinct(list(name))), '|') AS alias, count(DISTINCT src_id) AS n_src
FROM (SELECT *, CASE WHEN from_modal THEN 1000000000000 ELSE 0 END + seq AS k FROM ({PARTS_})) GROUP BY id""")
def entity_merge_by_id(spark, d):
    parts = frame(spark, d, PARTS).withColumn("alias", F.lit(None).cast("array<string>"))
    merged = R.merge_entities_by_id(parts)
    return merged.select("id", "name", "desc", F.array_join("alias", "|").alias("alias"), F.size("src_id_list").cast("long").alias("n_src"))


@query("attr_merge", f"""SELECT id, k, array_to_string(list_sort(list_distinct(list(v))), '|') AS vs FROM (SELECT id, 'brand' AS k, src_id AS v FROM ({PARTS_}) UNION ALL SELECT id, 'kind', kind FROM ({PARTS_})) GROUP BY id, k""")
def attr_merge(spark, d):
    parts = frame(spark, d, PARTS).select("id", F.create_map(F.lit("brand"), F.array("src_id"), F.lit("kind"), F.array("kind"), F.lit("none"), F.array(F.lit(""))).alias("attr"))
    return R.merge_attributes(parts).select("id", F.explode("attr").alias("k", "vs")).select("id", "k", F.array_join("vs", "|").alias("vs"))


LINES = "SELECT doc_id, text, lang FROM {documents}"


@query("last_wins_nodes", "SELECT 'chk-' || md5(lower(text)) AS id, max(doc_id) AS doc_id, max_by(lang, doc_id) AS lang FROM documents GROUP BY 1")
def last_wins_nodes(spark, d):
    from loomgraph.functions.ids import node_id

    docs = frame(spark, d, LINES).select(node_id("Chunk", "text").alias("id"), "doc_id", "lang", F.col("doc_id").alias("seq"))
    return R.last_wins(docs, ["id"]).drop("seq")


@query("source_edges", f"""WITH a AS (SELECT DISTINCT concat('Order#', l_orderkey) AS o, concat('Part#', l_partkey) AS p FROM lineitem)
SELECT 'ass-' || md5(lower(o || '|contains|' || p)) AS head, 'belongs_to' AS relation, 'chk-' || md5(lower(o)) AS tail FROM a""")
def source_edges(spark, d):
    from loomgraph.functions.ids import node_id

    rows = frame(spark, d, "SELECT DISTINCT concat('Order#', l_orderkey) AS head, 'contains' AS relation, concat('Part#', l_partkey) AS tail FROM {lineitem}")
    made = rows.select(node_id("Assertion", F.concat_ws("|", "head", "relation", "tail")).alias("id"), node_id("Chunk", "head").alias("src_id"), F.lit(None).cast("array<string>").alias("src_id_list"))
    return E.assertion_source_edges(made)


@query("entity_source_edges", """SELECT 'ent-' || md5(lower(c_name)) AS head, CASE WHEN c_custkey % 3 = 0 THEN 'relate_to' ELSE 'locate' END AS relation, concat('src', c_nationkey, '-', c_custkey % 3) AS tail FROM customer""")
def entity_source_edges(spark, d):
    from loomgraph.functions.ids import node_id

    rows = frame(spark, d, "SELECT c_name, concat('src', c_nationkey, '-', c_custkey % 3) AS src_id, c_custkey FROM {customer}").withColumn("id", node_id("Entity", "c_name"))
    sources = frame(spark, d, "SELECT DISTINCT concat('src', c_nationkey, '-', c_custkey % 3) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Table' ELSE 'Chunk' END AS type FROM {customer}")
    return E.entity_source_edges(rows, sources)
