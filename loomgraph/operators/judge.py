"""Verdicts from model answers: support by vote, difficulty, complexity, and one scored record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip
from loomgraph.operators.parse import complexity_reason, complexity_score


def vote(c: str) -> Column:
    """A judge's 1; anything else is 0."""
    return F.when(strip(F.coalesce(c, F.lit(""))) == "1", 1).otherwise(0)


def support(votes: DataFrame, key: str, mode: str = "majority_vote", models: list[int] | None = None) -> DataFrame:
    """(key, support_count, label) from (key, model_index, response)."""
    if models is not None:
        votes = votes.where(F.col("model_index").isin(models))
    if mode == "single":
        counted = votes.groupBy(key).agg(F.min_by(vote("response"), "model_index").cast("long").alias("support_count"), F.lit(1).cast("long").alias("n"))
    elif mode == "majority_vote":
        counted = votes.groupBy(key).agg(F.sum(vote("response")).cast("long").alias("support_count"), F.count("*").alias("n"))
    else:
        raise ValueError(mode)
    ok = F.col("support_count") >= F.floor(F.col("n") / 2) + 1
    return counted.select(key, "support_count", F.when(ok, "supported").otherwise("unsupported").alias("label"))


def difficulty(strong: Column, weak: Column, mode: str = "strong_weak") -> Column:
    if mode == "strong_weak":
        return F.when(strong & weak, "simple").when(strong & ~weak, "medium").otherwise("hard")
    if mode in ("strong_only", "weak_only"):
        return F.when(strong if mode == "strong_only" else weak, "simple").otherwise("hard")
    return F.lit("unevaluated")


def correct(answer: str, gold: str) -> Column:
    return F.coalesce(F.col(answer) == F.col(gold), F.lit(False))


def score_records(records: DataFrame, key: str, votes: DataFrame | None = None, answers: DataFrame | None = None, reviews: DataFrame | None = None, mode: str = "strong_weak") -> DataFrame:
    """Joins the judges that are enabled; the others' columns hold placeholders.

    answers: (key, strong, weak); reviews: (key, response).
    """
    out = records
    if votes is not None:
        out = out.join(support(votes, key).withColumnRenamed("label", "support_label"), key, "left")
    else:
        out = out.withColumns({"support_count": F.lit(None).cast("long"), "support_label": F.lit(None).cast("string")})
    out = out.withColumn("support_label", F.coalesce("support_label", F.lit("unevaluated")))
    if answers is not None:
        out = out.join(answers, key, "left").withColumns({"strong_correct": correct("strong", "a"), "weak_correct": correct("weak", "a")})
        out = out.withColumn("level", difficulty(F.col("strong_correct"), F.col("weak_correct"), mode)).drop("strong", "weak")
    else:
        out = out.withColumns({"strong_correct": F.lit(None).cast("boolean"), "weak_correct": F.lit(None).cast("boolean"), "level": F.lit("unevaluated")})
    if reviews is not None:
        review = reviews.select(key, complexity_score("response").alias("score"), complexity_reason("response").alias("reason"))
        out = out.join(review, key, "left").withColumn("score", F.coalesce("score", F.lit(0)))
    else:
        out = out.withColumns({"score": F.lit(0), "reason": F.lit(None).cast("string")})
    return out
