"""Labelled rows for fitting, from a fold of the documents: all, or a bounded number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.idfilter import keep_listed
from loomgraph.scratch import materialize

SAMPLE_ROWS = 20_000


def remainder(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int | None = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y): about ``rows`` labelled documents outside the held-out fold, by hash order of their ids; all for None.

    Null labels, ids and texts are left out; of repeated labels the largest counts; of a
    repeated document the least text.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(f"doc_id is not null and {label} is not null")
    usable = usable.where(remainder(modulus) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    if rows is not None:
        share = min(1.0, rows / max(usable.count(), 1))
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 62)) < int(share * (1 << 62)))
    chosen = materialize(usable, "labels")
    texts = keep_listed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"), "doc_id", chosen.select("doc_id"))
    joined = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return materialize(joined, "labelled")
