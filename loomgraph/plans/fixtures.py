"""Knowledge-graph views of the star-schema tables, in SQL that both engines read.

Names in braces stand for tables: DataFrames in Spark, views in the oracle.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLACE = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the tables of sf_dir, each a temporary view named after the folder."""
    mark = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    for t in set(PLACE.findall(sql)):
        table(spark, sf_dir, t).createOrReplaceTempView(f"{t}_{mark}")
    return spark.sql(PLACE.sub(lambda m: f"{m[1]}_{mark}", sql))


def plain(sql: str) -> str:
    """For the oracle: table names in place of the braces."""
    return PLACE.sub(r"\1", sql)


STAR = """
SELECT n_name AS head, 'in_region' AS relation, r_name AS tail, CAST(n_nationkey AS BIGINT) AS seq FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT c_name, 'in_nation', n_name, 1000000000000 + c_custkey FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT s_name, 'in_nation', n_name, 2000000000000 + s_suppkey FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT concat('Order#', o_orderkey), 'placed_by', c_name, 3000000000000 + o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL SELECT concat('Order#', l_orderkey), 'contains', concat('Part#', l_partkey), 4000000000000 + l_orderkey * 10 + l_linenumber FROM {lineitem}
UNION ALL SELECT concat('Part#', l_partkey), 'supplied_by', concat('Supplier#', l_suppkey), 5000000000000 + l_orderkey * 10 + l_linenumber FROM {lineitem}
"""


def _id(prefix: str, kind: str, key: str) -> str:
    return f"concat('{prefix}-', md5(lower(concat('{kind}', {key}))))"


DOC, CHK, ENT = _id("doc", "nation", "{k}"), _id("chk", "order", "{k}"), _id("ent", "customer", "{k}")
TBL, IMG, FML = _id("tbl", "part", "{k}"), _id("img", "supplier", "{k}"), _id("fml", "region", "{k}")


def _of(template: str, key: str) -> str:
    return template.replace("{k}", key)


TYPED_NODES = f"""
SELECT {_of(DOC, 'n_nationkey')} AS id, 'Document' AS type, n_name AS name, CAST(n_nationkey AS BIGINT) AS seq FROM {{nation}}
UNION ALL SELECT {_of(CHK, 'o_orderkey')}, 'Chunk', concat('Order#', o_orderkey), o_orderkey FROM {{orders}}
UNION ALL SELECT {_of(ENT, 'c_custkey')}, 'Entity', c_name, c_custkey FROM {{customer}}
UNION ALL SELECT {_of(TBL, 'p_partkey')}, 'Table', p_name, p_partkey FROM {{part}}
UNION ALL SELECT {_of(IMG, 's_suppkey')}, 'Image', s_name, s_suppkey FROM {{supplier}}
UNION ALL SELECT {_of(FML, 'r_regionkey')}, 'Formula', r_name, CAST(r_regionkey AS BIGINT) FROM {{region}}
"""
TYPED_EDGES = f"""
SELECT {_of(CHK, 'o_orderkey')} AS head, 'belongs_to' AS relation, {_of(DOC, 'c_nationkey')} AS tail FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
UNION ALL SELECT {_of(ENT, 'o_custkey')}, 'locate', {_of(CHK, 'o_orderkey')} FROM {{orders}}
UNION ALL SELECT DISTINCT {_of(ENT, 'o_custkey')}, 'relate_to', {_of(TBL, 'l_partkey')} FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT {_of(ENT, 'o_custkey')}, 'relate_to', {_of(IMG, 'l_suppkey')} FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
UNION ALL SELECT {_of(TBL, 'p_partkey')}, 'locate', {_of(DOC, 'p_partkey % 25')} FROM {{part}}
UNION ALL SELECT {_of(IMG, 's_suppkey')}, 'locate', {_of(DOC, 's_nationkey')} FROM {{supplier}}
UNION ALL SELECT {_of(FML, 'n_regionkey')}, 'locate', {_of(DOC, 'min(n_nationkey)')} FROM {{nation}} GROUP BY n_regionkey
UNION ALL SELECT {_of(ENT, 'c_custkey')}, 'relate_to', {_of(FML, 'n_regionkey')} FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
UNION ALL SELECT {_of(ENT, 'a')}, 'co_buys', {_of(ENT, 'b')} FROM (
  SELECT o_custkey AS a, lead(o_custkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS b, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r
  FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey) WHERE r < 3 AND b IS NOT NULL AND a <> b
"""


def _by_keys(column: str, template: str) -> tuple[str, str]:
    """A DISTINCT branch of TYPED_EDGES, and the same rows made distinct by their keys, before these become ids."""
    source = "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
    old = f"SELECT DISTINCT {_of(ENT, 'o_custkey')}, 'relate_to', {_of(template, column)} {source}"
    return old, f"SELECT {_of(ENT, 'a')}, 'relate_to', {_of(template, 'b')} FROM (SELECT DISTINCT o_custkey AS a, {column} AS b {source})"


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of TYPED_EDGES; distinct pairs are found among the keys, a tenth of the ids' bytes."""
    sql = TYPED_EDGES
    for column, template in (("l_partkey", TBL), ("l_suppkey", IMG)):
        old, new = _by_keys(column, template)
        if old not in sql:
            raise ValueError("TYPED_EDGES has changed")
        sql = sql.replace(old, new)
    return frame(spark, sf_dir, sql)
