"""Distributions over fixed categories, summary numbers, per-model means and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import word_count
from loomgraph.scratch import materialize

BUCKETS = ["0-64", "65-128", "129-256", "257-512", "513+"]
METRICS = ["em", "acc", "f1", "rouge1", "rouge2", "rougeL"]


def distribution(rows: DataFrame, column: str, universe: list | None = None) -> DataFrame:
    """(key, n): counts with every category of the universe present; unseen ones are 0, others are added."""
    counts = rows.groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("n"))
    if not universe:
        return counts
    fixed = rows.sparkSession.createDataFrame([(str(u),) for u in universe], "key string")
    return counts.join(fixed, "key", "full_outer").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def bucket(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c <= 64, BUCKETS[0]).when(c <= 128, BUCKETS[1]).when(c <= 256, BUCKETS[2]).when(c <= 512, BUCKETS[3]).otherwise(BUCKETS[4])


def token_lengths(rows: DataFrame) -> DataFrame:
    """Adds q_tokens, a_tokens, cot_tokens and total_tokens."""
    rows = rows.withColumns({f"{c}_tokens": word_count(c) for c in ("q", "a", "cot")})
    return rows.withColumn("total_tokens", F.col("q_tokens") + F.col("a_tokens") + F.col("cot_tokens"))


def describe(rows: DataFrame, *columns: str) -> DataFrame:
    """(metric, low, high, mean, median) of each column in one pass; all 0 without values."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    entry = lambda c: F.struct(F.lit(c).alias("metric"), zero(F.min(c)).alias("low"), zero(F.max(c)).alias("high"), zero(F.avg(c)).alias("mean"), zero(F.median(c)).alias("median"))
    return rows.agg(F.array(*map(entry, columns)).alias("s")).select(F.inline("s"))


def correct_rates(rows: DataFrame) -> DataFrame:
    """Shares of right strong and weak answers, nulls left out, null if there are none."""
    return rows.agg(F.avg(F.col("strong_correct").cast("int")).alias("strong_rate"), F.avg(F.col("weak_correct").cast("int")).alias("weak_rate"))


def statistics(scored: DataFrame, task_types: list[str]) -> DataFrame:
    """The whole statistics document in long form: section, metric, key, value."""
    rows = token_lengths(scored).withColumn("bucket", bucket("total_tokens"))
    rows = materialize(rows.select("bucket", "task_type", "support_label", "level", "score", "num_hops", "q_tokens", "a_tokens", "cot_tokens", "total_tokens", "strong_correct", "weak_correct"), "lengths")  # read once for each metric
    universes = {
        "task_type": task_types, "support_label": ["supported", "unsupported", "unevaluated"], "level": ["simple", "medium", "hard", "unevaluated"],
        "score": [0, 1, 2, 3, 4, 5], "bucket": BUCKETS, "num_hops": None,
    }
    out = None
    for c, universe in universes.items():
        own = distribution(rows, c, universe).select(F.lit("distribution").alias("section"), F.lit(c).alias("metric"), "key", F.col("n").cast("double").alias("value"))
        out = own if out is None else out.unionByName(own)
    numbers = describe(rows, "q_tokens", "a_tokens", "cot_tokens", "total_tokens", "num_hops", "score")
    long = numbers.select(F.lit("summary").alias("section"), "metric", F.stack(F.lit(4), F.lit("min"), "low", F.lit("max"), "high", F.lit("mean"), "mean", F.lit("median"), "median").alias("key", "value"))
    rates = correct_rates(rows).select(F.stack(F.lit(2), F.lit("strong_correct"), "strong_rate", F.lit("weak_correct"), "weak_rate").alias("metric", "value"))
    return out.unionByName(long).unionByName(rates.select(F.lit("rate").alias("section"), "metric", F.lit("mean").alias("key"), "value"))


def model_means(rows: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    return rows.groupBy("model_name").agg(*(F.avg(m).alias(m) for m in metrics))


def model_task_pivot(rows: DataFrame, metric: str, tasks: list[str], models: list[str] | None = None) -> DataFrame:
    """One row a model, one column a task; models of the fixed order that have no rows are null."""
    out = rows.groupBy("model_name").pivot("task_type", tasks).agg(F.avg(metric))
    if models:
        order = rows.sparkSession.createDataFrame([(m,) for m in models], "model_name string")
        out = order.join(out, "model_name", "left")
    return out


def pending(examples: DataFrame, models: DataFrame, done: DataFrame) -> DataFrame:
    """(model_name, example_id) not evaluated yet; models: a short list, one row each."""
    every = examples.select("example_id").crossJoin(F.broadcast(models.select("model_name")))
    return every.join(done.select("model_name", "example_id"), ["model_name", "example_id"], "left_anti")


def error_report(invalid: DataFrame) -> DataFrame:
    return invalid.groupBy("error_type").agg(F.count("*").alias("n"))
