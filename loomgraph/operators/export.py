"""Fine-tuning formats of QA records, one JSON object a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "You are a helpful assistant. Give an accurate answer to the question."
ANSWER = "\n\nAnswer: "


def _response() -> Column:
    return F.concat(F.coalesce("cot", F.lit("")), F.lit(ANSWER), F.coalesce("a", F.lit("")))


def _question() -> Column:
    return F.coalesce("q", F.lit(""))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages() -> Column:
    return F.to_json(F.struct(F.array(_message("system", F.lit(SYSTEM)), _message("user", _question()), _message("assistant", _response())).alias("messages")))


def sharegpt() -> Column:
    return F.to_json(F.struct(F.lit(SYSTEM).alias("system"), F.array(F.struct(_question().alias("human"), _response().alias("assistant"))).alias("conversation")))


def query_response() -> Column:
    return F.to_json(F.struct(F.lit(SYSTEM).alias("system"), _question().alias("query"), _response().alias("response"), F.array().cast("array<string>").alias("history")))


def alpaca() -> Column:
    return F.to_json(F.struct(F.lit(SYSTEM).alias("system"), _question().alias("instruction"), F.lit("").alias("input"), _response().alias("output")))


FORMATS = {"messages": messages, "sharegpt": sharegpt, "query_response": query_response, "alpaca": alpaca}


def convert(qa: DataFrame, format: str = "messages", mode: str = "sft", key: str | None = None) -> DataFrame:
    """(key,) json of each record; other modes and formats are errors."""
    if mode != "sft":
        raise ValueError(f"mode {mode!r} is not supported")
    if format not in FORMATS:
        raise ValueError(f"format {format!r} is not supported")
    return qa.select(*([key] if key else []), FORMATS[format]().alias("json"))
