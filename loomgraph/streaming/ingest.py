"""Incremental ingestion (an extension): triples as they arrive become edges, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.edges import relation_edges


def event_triples(events: DataFrame) -> DataFrame:
    """user - event type - hour of the event, with its time."""
    return events.select(
        F.concat(F.lit("user "), "user_id").alias("head"), F.col("event_type").alias("relation"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("tail"), F.col("ts").cast("timestamp").alias("ts")
    )


def edge_stream(triples: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Edges with duplicates inside the watermark dropped; state is bounded by it."""
    marked = triples.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["head", "relation", "tail"])
    return relation_edges(marked.select("head", "relation", "tail"))


def write_edges(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return edges.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
