"""Parsers of model responses: delimited lines, tagged JSON, tolerant JSON, QA, scores."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from loomgraph.functions.ids import node_id
from loomgraph.functions.text import strip

#: Delimiters of the extraction format and tags around JSON.
DELIMITER, COMPLETE = "<|#|>", "<|COMPLETE|>"
TAG_OPEN, TAG_CLOSE = "<myjson>", "</myjson>"


def _fields(responses: DataFrame, tag: str, n: int) -> DataFrame:
    lines = responses.select("src_id", "ordinal", F.posexplode(F.split("response", "\n")).alias("pos", "line")).withColumn("line", strip("line"))
    kept = lines.where((F.col("line") != "") & (F.col("line") != COMPLETE))
    parts = kept.withColumn("p", F.transform(F.split("line", r"<\|#\|>"), strip))
    return parts.where((F.size("p") == n) & (F.col("p")[0] == tag))


def last_response(responses: DataFrame) -> DataFrame:
    """Of several responses to one source the last."""
    return responses.groupBy("src_id").agg(F.max_by("response", "ordinal").alias("response"), F.max("ordinal").alias("ordinal"))


def entities(responses: DataFrame) -> DataFrame:
    """Lines entity, name, type, desc -> entity rows."""
    p = _fields(last_response(responses), "entity", 4)
    return p.select(node_id("Entity", F.col("p")[1]).alias("id"), "src_id", F.col("p")[1].alias("name"), F.col("p")[2].alias("entity_type"), F.col("p")[3].alias("desc"), "pos")


def relations(responses: DataFrame) -> DataFrame:
    """Lines relation, head, tail, relation, desc -> assertion rows."""
    p = _fields(last_response(responses), "relation", 5)
    head, tail, rel = F.col("p")[1], F.col("p")[2], F.col("p")[3]
    return p.select(
        node_id("Assertion", F.concat_ws("|", head, rel, tail)).alias("id"), "src_id", head.alias("head"), rel.alias("relation"), tail.alias("tail"), F.col("p")[4].alias("desc"), "pos"
    )


def between_tags(c: Column | str, opening: str = TAG_OPEN, closing: str = TAG_CLOSE) -> Column:
    """Text between the tags; empty without an opening tag, all but the last character without a closing one."""
    c = F.col(c) if isinstance(c, str) else c
    at = F.instr(c, opening)
    rest = F.substr(c, at + len(opening))
    end = F.instr(rest, closing)
    inner = F.when(end > 0, F.substr(rest, F.lit(1), end - 1)).otherwise(F.substr(rest, F.lit(1), F.greatest(F.length(rest) - 1, F.lit(0))))
    return F.when(at > 0, inner).otherwise("")


def modal_analysis(responses: DataFrame, fields: tuple[str, ...] = ("name", "caption", "desc")) -> DataFrame:
    """Tagged JSON with its required fields; rows that lack one (absent or empty) have ok = false."""
    parsed = F.from_json(between_tags("response"), ", ".join(f"{f} string" for f in fields))
    ok = None
    for f in fields:
        has = F.coalesce(F.length(parsed[f]) > 0, F.lit(False))
        ok = has if ok is None else ok & has
    return responses.select("src_id", *(parsed[f].alias(f) for f in fields), ok.alias("ok"))


def alias_map(responses: DataFrame) -> DataFrame:
    """JSON list of {name, alias[], desc} -> (name, standard): of one alias the last standard."""
    rows = responses.select("ordinal", F.posexplode(F.from_json(between_tags("response"), "array<struct<name: string, alias: array<string>, desc: string>>")).alias("pos", "e"))
    pairs = rows.select("ordinal", "pos", F.explode("e.alias").alias("name"), F.col("e.name").alias("standard"))
    return pairs.groupBy("name").agg(F.max_by("standard", F.struct("ordinal", "pos")).alias("standard"))


def tolerant(text: str | None) -> dict[str, str]:
    """Strict JSON, else a Python literal, else one ``key: value`` a line; {} where nothing holds."""
    for read in (json.loads, ast.literal_eval):
        try:
            found = read(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
        if isinstance(found, dict):
            return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in found.items()}
        break
    out = {}
    for line in (text or "").splitlines():
        key, colon, value = line.strip().partition(":")
        if colon and (key := _bare(key)):
            out[key] = _bare(value)
    return out


def _bare(part: str) -> str:
    """Without one opening quote and one closing quote with its comma."""
    part = part.strip()
    part = part[1:] if part[:1] in ("'", '"') else part
    part = part[:-1] if part.endswith(",") else part
    return part[:-1] if part[-1:] in ("'", '"') else part


@F.pandas_udf(MapType(StringType(), StringType()))
def _tolerant(s: pd.Series) -> pd.Series:
    return s.map(tolerant)


def parse_json(c: Column | str) -> Column:
    """map of the text's fields: the JVM's strict parser where it succeeds, else the tolerant one."""
    c = F.col(c) if isinstance(c, str) else c
    strict = F.from_json(c, "map<string,string>")
    return F.coalesce(strict, _tolerant(F.when(strict.isNull(), c)))


def answer(c: Column | str) -> Column:
    """A prediction's answer: the JSON answer field, unquoted; else the line after a closing think tag; else the text."""
    c = F.col(c) if isinstance(c, str) else c
    clean = strip(F.regexp_replace(c, r"```(?:json)?", ""))
    field = strip(F.regexp_extract(clean, r'\{\s*"answer"\s*:(.*?)\}', 1))
    bare = F.regexp_replace(field, r"""^(["'])(.*)\1$""", "$2")
    after = F.regexp_extract(c, r"</think>\s*([^\n]+)", 1)
    has_json = F.regexp_like(clean, F.lit(r'\{\s*"answer"\s*:(.*?)\}'))
    return F.when(has_json, bare).when(after != "", after).otherwise(c)


def qa(responses: DataFrame) -> DataFrame:
    """(key, question, answer, cot, ok) from fenced or plain JSON; a list of steps is newline-joined."""
    clean = F.replace(F.replace(strip("response"), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    plain = F.from_json(clean, "question string, answer string, reasoning_path string")
    listed = F.from_json(clean, "reasoning_path array<string>")["reasoning_path"]
    ok = F.coalesce(F.try_parse_json(clean).isNotNull(), F.lit(False))
    return responses.select(
        "key", F.when(ok, F.coalesce(plain["question"], F.lit(""))).alias("question"), F.when(ok, F.coalesce(plain["answer"], F.lit(""))).alias("answer"),
        F.when(ok, F.coalesce(F.array_join(listed, "\n"), plain["reasoning_path"], F.lit(""))).alias("cot"), ok.alias("ok"),
    )


def complexity_score(c: Column | str) -> Column:
    """1-5 after its label, else the first such digit after a colon or space, else 0."""
    labelled = F.regexp_extract(c, r"(?:复杂度评分|complexity score)[:：]\s*([1-5])", 1)
    loose = F.regexp_extract(c, r"[：:\s]\s*([1-5])", 1)
    return F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(loose, F.lit("")), F.lit("0")).cast("int")


def complexity_reason(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract(c, r"(?s)(?:理由|reason)[:：]\s*(.*)", 1)
    return F.when(F.regexp_like(c, F.lit(r"(?:理由|reason)[:：]")), strip(found)).otherwise(c)
