"""Sinks: node and edge tables, stage checkpoints, JSON lines, GraphML, graph view, reports."""

from __future__ import annotations

import base64
import contextlib
import html
import io
import json
import time
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.edges import deduplicate
from loomgraph.operators.resolve import upsert


def save_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("type").parquet(path)


def save_edges(edges: DataFrame, path: str) -> None:
    deduplicate(edges).write.mode("overwrite").parquet(path)


def stage(spark: SparkSession, path: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table: made and committed once, read again on a resumed run."""
    where = f"{path.rstrip('/')}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def save_json_lines(rows: DataFrame, path: str, column: str = "json") -> None:
    """One object a line, UTF-8."""
    rows.select(column).write.mode("overwrite").text(path)


def split_invalid(checked: DataFrame, path: str) -> DataFrame:
    """Writes invalid rows and a report (counts by error type, three samples); returns the valid ones."""
    bad = checked.where("NOT is_valid")
    bad.write.mode("overwrite").parquet(f"{path}/invalid")
    bad.groupBy("error_type").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/report")
    bad.limit(3).write.mode("overwrite").json(f"{path}/samples")
    return checked.where("is_valid")


def snapshots(spark: SparkSession, path: str) -> list[str]:
    """Whole snapshots below a path, oldest first: folders number-version, by their number."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(s.getPath()) for s in fs.listStatus(base)] if fs.exists(base) else []
    whole = [f for f in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f + "/_SUCCESS"))]
    return sorted(whole, key=lambda f: int(f.rsplit("/", 1)[-1].split("-", 1)[0]))


def merge_evaluations(spark: SparkSession, path: str, new: DataFrame, version: str) -> DataFrame:
    """A new snapshot of the evaluation table: rows of the last one, new ones winning by model and query.

    Earlier snapshots stay as backups. Rows of ``new`` that repeat a model and query: the
    largest counts; a first snapshot takes them as they are.
    """
    before = snapshots(spark, path)
    merged = upsert(spark.read.parquet(before[-1]), new, "model_name", "query") if before else new
    number = int(before[-1].rsplit("/", 1)[-1].split("-", 1)[0]) + 1 if before else 0
    where = f"{path.rstrip('/')}/{number:06d}-{version}"
    merged.write.parquet(where)
    return spark.read.parquet(where)


def save_flat(path: str, *frames: DataFrame) -> None:
    """Typed lists as one node table."""
    from loomgraph.operators.nodes import flatten

    flatten(*frames).write.mode("overwrite").parquet(path)


def save_failed(responses: DataFrame, path: str, column: str = "response") -> DataFrame:
    """Writes the rows without a response to the error sink; returns the others."""
    from loomgraph.operators.nodes import split_failed

    good, bad = split_failed(responses, column)
    bad.write.mode("overwrite").parquet(path)
    return good


def save_statistics(statistics: DataFrame, path: str) -> None:
    """The statistics document, one JSON object a line; it is small by design, so one file."""
    statistics.coalesce(1).write.mode("overwrite").json(path)


def save_standard_maps(path: str, names: DataFrame, relations: DataFrame, responses: DataFrame) -> None:
    """What standardisation said: two maps (old, new) and the raw answers."""
    names.write.mode("overwrite").parquet(f"{path}/entities")
    relations.write.mode("overwrite").parquet(f"{path}/relations")
    responses.write.mode("overwrite").parquet(f"{path}/responses")


def save_pivot(pivot: DataFrame, path: str) -> None:
    """The model by task table as one CSV file with a header; one row a model."""
    pivot.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def open_uri(uri: str):
    """(file system, path) of pyarrow for file:, hdfs:, s3: and the like."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_files(rows: DataFrame, path: str) -> None:
    """(name, data) rows as files below a path; each is whole or absent, also when a task is tried again."""

    def write(frames):
        import uuid

        import pandas as pd

        fs, base = open_uri(path)
        for f in frames:
            for name, data in zip(f["name"], f["data"]):
                target = f"{base}/{name}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                temp = f"{target.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"  # hidden from scans
                with fs.open_output_stream(temp) as out:
                    out.write(bytes(data))
                fs.move(temp, target)
            yield pd.DataFrame({"n": [len(f)]})

    rows.select("name", "data").mapInPandas(write, "n long").agg(F.sum("n")).collect()


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def encode_attribute(value: object) -> str:
    return base64.b64encode(json.dumps(value, ensure_ascii=False).encode()).decode()


def decode_attribute(text: str) -> object:
    return json.loads(base64.b64decode(text))


def graphml_column(*columns: str):
    """base64(JSON) of each attribute, as the graph file holds it."""
    return F.struct(*(F.base64(F.encode(F.to_json(F.array(c)), "UTF-8")).alias(c) for c in columns))


def _plain(value):
    return value.asDict(True) if hasattr(value, "asDict") else value


def save_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML file for tools outside Spark; rows stream through the driver one partition at a time."""
    fs, where = open_uri(path)
    fs.create_dir(where.rsplit("/", 1)[0], recursive=True)  # in a new session nothing else has made it
    with io.TextIOWrapper(fs.open_output_stream(where), encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        keys = [("node", c) for c in nodes.columns if c != "id"] + [("edge", c) for c in edges.columns if c not in ("head", "tail")]
        for i, (kind, name) in enumerate(keys):
            out.write(f'<key id="d{i}" for="{kind}" attr.name={quoteattr(name)} attr.type="string"/>\n')
        place = {k: i for i, k in enumerate(keys)}
        data = lambda kind, row: "".join(f'<data key="d{place[kind, c]}">{encode_attribute(_plain(row[c]))}</data>' for c in row.__fields__ if (kind, c) in place and row[c] is not None)
        out.write('<graph edgedefault="directed">\n')
        for r in nodes.toLocalIterator():
            out.write(f"<node id={quoteattr(r.id)}>{data('node', r)}</node>\n")
        for r in edges.toLocalIterator():
            out.write(f"<edge source={quoteattr(r['head'])} target={quoteattr(r['tail'])}>{data('edge', r)}</edge>\n")
        out.write("</graph>\n</graphml>\n")


def load_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with their attributes decoded, as maps name -> JSON."""
    from xml.etree import ElementTree

    names, nodes, edges = {}, [], []
    fs, where = open_uri(path)
    for _, e in ElementTree.iterparse(fs.open_input_file(where)):
        tag = e.tag.rsplit("}", 1)[-1]
        if tag == "key":
            names[e.get("id")] = e.get("attr.name")
        elif tag in ("node", "edge"):
            attr = {names[d.get("key")]: json.dumps(decode_attribute(d.text), ensure_ascii=False) for d in e if d.text}
            (nodes if tag == "node" else edges).append((e.get("id"), attr) if tag == "node" else (e.get("source"), e.get("target"), attr))
            e.clear()
    return spark.createDataFrame(nodes, "id string, attr map<string,string>"), spark.createDataFrame(edges, "head string, tail string, attr map<string,string>")


#: A colour for each node type.
COLOURS = {"Document": "#4e79a7", "Chunk": "#f28e2b", "Assertion": "#e15759", "Entity": "#76b7b2", "Table": "#59a14f", "Image": "#edc948", "Formula": "#b07aa1"}


def visible_graph(nodes: DataFrame, edges: DataFrame, types: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the shown types (the first ``most`` by id, where given), names cut to 20 characters, and the edges between them."""
    from loomgraph.operators.graph import valid_edges

    shown = nodes.where(F.col("type").isin(types)).select("id", "type", F.substring("name", 1, 20).alias("label"))
    if most is not None:
        shown = shown.orderBy("id").limit(most)
    return shown, valid_edges(edges, shown).select("head", "relation", "tail")


def graph_page(nodes: DataFrame, edges: DataFrame, types: list[str], most: int | None = None) -> str:
    """A self-contained HTML list view with a legend; a page is for people, so callers say how many nodes it may hold."""
    n, e = visible_graph(nodes, edges, types, most)
    legend = "".join(f'<li style="color:{COLOURS[t]}">{t}</li>' for t in types)
    rows = "".join(f'<li id="{escape(r.id)}" style="color:{COLOURS[r.type]}">{escape(r.label or "")}</li>' for r in n.collect())
    links = "".join(f"<li>{html.escape(r['head'])} - {html.escape(r.relation or '')} - {html.escape(r['tail'])}</li>" for r in e.collect())
    return f"<!DOCTYPE html><title>graph</title><ul>{legend}</ul><ul>{rows}</ul><ul>{links}</ul>"


#: Order of a report's categories; others follow by name.
REPORT_ORDER = ["simple", "medium", "hard", "supported", "unsupported", "unevaluated", "0-64", "65-128", "129-256", "257-512", "513+"]


def report_page(statistics: DataFrame) -> str:
    """Bar charts of the distributions in a fixed order; the statistics table is small by design."""
    place = {k: i for i, k in enumerate(REPORT_ORDER)}
    charts: dict[str, list[tuple[str, float]]] = {}
    for r in statistics.where("section = 'distribution'").collect():
        charts.setdefault(r.metric, []).append((r.key, r.value))
    body = ""
    for metric, bars in sorted(charts.items()):
        top = max((v for _, v in bars), default=1) or 1
        body += f"<h2>{html.escape(metric)}</h2>" + "".join(f'<div>{html.escape(str(k))} <span style="display:inline-block;background:#4e79a7;height:1em;width:{300 * v / top:.0f}px"></span> {v:g}</div>' for k, v in sorted(bars, key=lambda b: (place.get(str(b[0]), len(place)), int(b[0]) if str(b[0]).isdigit() else 0, str(b[0]))))
    return f"<!DOCTYPE html><title>report</title>{body}"


@contextlib.contextmanager
def timed(name: str, say: Callable[[str], None] = print) -> Iterator[None]:
    began = time.time()
    yield
    say(f"{name}: {time.time() - began:.1f} s")
