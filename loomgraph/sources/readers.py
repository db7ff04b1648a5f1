"""Scans: triple files, parsed contents, node, edge and graph tables, QA and evaluation records, workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip
from loomgraph.schemas import CONTENT_BLOCK, EDGE, NODE


def triple_file(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Distinct (head, relation, tail) of lines with exactly three fields; no quoting."""
    parts = spark.read.text(path).select(F.split(strip("value"), re.escape(delimiter)).alias("p")).where(F.size("p") == 3)
    return parts.select(*(strip(F.col("p")[i]).alias(c) for i, c in enumerate(("head", "relation", "tail")))).distinct()


def triples(frame: DataFrame) -> DataFrame:
    """Any frame of three columns as triples."""
    if len(frame.columns) != 3:
        raise ValueError("triples have three columns")
    return frame.toDF("head", "relation", "tail").where("head is not null and relation is not null and tail is not null").distinct()


def content_lists(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of <dir>/<doc>/vlm/<doc>_content_list.json: doc_name, pos and the block's fields.

    A caption may be a string or a list; each file is one JSON array, its order is kept.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    loose = "struct<" + CONTENT_BLOCK.replace("array<string>", "string").replace(" string", ": string").replace(" double", ": double") + ">"
    blocks = files.select(F.regexp_replace("file", r"_content_list\.json$", "").alias("doc_name"), F.posexplode(F.from_json("value", f"array<{loose}>")).alias("pos", "b")).select("doc_name", "pos", "b.*")
    listed = lambda c: F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).when(F.col(c).isNotNull(), F.array(c))
    return blocks.withColumns({"table_caption": listed("table_caption"), "image_caption": listed("image_caption"), "seq": F.xxhash64("doc_name").bitwiseAND(0x7FFFFFFF) * 1_000_000 + F.col("pos")})


def page_blocks(pages: DataFrame) -> DataFrame:
    """Text blocks of HTML pages, a stand-in for the layout service: paragraphs, headings and list items, tags removed."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(?:p|h[1-6]|li)\b[^>]*>(.*?)(?=</?(?:p|h[1-6]|li|ul|article|body|div)\b)"), 1)
    clean = F.filter(F.transform(found, lambda t: strip(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " "))), lambda t: t != "")
    return pages.select(F.col("url").alias("doc_name"), F.posexplode(clean).alias("pos", "text")).withColumn("type", F.lit("text"))


def nodes(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """A node table, partitioned by type: the type filter prunes folders."""
    df = spark.read.schema(NODE).parquet(path)
    return df.where(F.col("type").isin(types)) if types else df


def edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGE).parquet(path)


def json_records(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """QA or evaluation records from .json (one array) or .jsonl; other suffixes are errors.

    Adds ``present``, the keys of each record, as a missing key and a null differ.
    """
    if path.endswith(".jsonl"):
        raw = spark.read.text(path).where(strip("value") != "").select(F.col("value").alias("record"))
    elif path.endswith(".json"):
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("record"))
    else:
        raise ValueError(f"{path}: neither .json nor .jsonl")
    out = raw.select(F.from_json("record", schema).alias("r"), F.json_object_keys("record").alias("present")).select("r.*", "present")
    if required:
        short = out.where(F.size(F.array_except(F.array(*map(F.lit, required)), "present")) > 0)
        if not short.isEmpty():
            raise ValueError(f"records lack some of {required}")
    return out


def workbook_first_column(data: bytes) -> list[str]:
    """Texts of the first sheet's first column of an .xlsx file."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]
        out = []
        for cell in ElementTree.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}c"):
            if re.match(r"A\d+$", cell.get("r", "")):
                value = cell.findtext("m:v", namespaces=ns)
                if cell.get("t") == "s":
                    value = shared[int(value)]
                elif cell.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{{{ns['m']}}}t"))
                if value:
                    out.append(value)
        return out


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Text blocks of workbooks: doc_name, pos, type, text."""

    def cells(frames):
        for f in frames:
            rows = [(name.rsplit("/", 1)[-1], i, "text", t) for name, data in zip(f["path"], f["content"]) for i, t in enumerate(workbook_first_column(data))]
            yield pd.DataFrame(rows, columns=["doc_name", "pos", "type", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "doc_name string, pos int, type string, text string")


def convert_files(spark: SparkSession, path: str, convert, pattern: str = "*") -> DataFrame:
    """Hook for outside converters (office files, layout analysis): convert(name, bytes) -> list of block dicts.

    A file that fails gives no blocks and its error.
    """

    def run(frames):
        for f in frames:
            rows = []
            for name, data in zip(f["path"], f["content"]):
                try:
                    rows += [(name, i, b.get("type"), b.get("text"), None) for i, b in enumerate(convert(name, data))]
                except Exception as e:
                    rows.append((name, -1, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_name", "pos", "type", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "doc_name string, pos int, type string, text string, error string")


def ontology_types(spark: SparkSession, path: str) -> list[str]:
    """Type names of {"Ontology": {name: {}}}; a small file read by the driver."""
    text = spark.read.text(path, wholetext=True).select(F.json_object_keys(F.get_json_object("value", "$.Ontology"))).first()
    return list(text[0]) if text and text[0] else []


def with_seq(rows: DataFrame, *order: str) -> DataFrame:
    """Numbers rows within their first order column; for sources without an order of their own."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(order[0]).orderBy(*order)).cast("long"))
