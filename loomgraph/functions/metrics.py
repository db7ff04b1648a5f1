"""Answer metrics over (prediction, gold) columns; all but ROUGE are JVM expressions."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomgraph.functions.stem import stem
from loomgraph.functions.text import strip, tokens


def _norm(c: Column | str) -> Column:
    return F.lower(strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))


def segments(c: Column | str) -> Column:
    """Lower-case tokens: white-space words, with each CJK character on its own."""
    return tokens(F.regexp_replace(_norm(c), r"([㐀-鿿])", " $1 "))


def exact_match(pred: str, gold: str) -> Column:
    return F.when(strip(F.coalesce(pred, F.lit(""))) == strip(F.coalesce(gold, F.lit(""))), 1.0).otherwise(0.0)


def accuracy(pred: str, gold: str) -> Column:
    """1 if equal or gold lies within pred; an empty gold always does."""
    return F.when(F.contains(_norm(pred), _norm(gold)), 1.0).otherwise(0.0)


def _harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0)


def token_f1(pred: str, gold: str) -> Column:
    """Distinct common tokens over token counts (with repeats) of either side."""
    # a list of one: its element is cut into tokens once, and every use below is of the result
    sides = F.array(F.struct(segments(pred).alias("p"), segments(gold).alias("g")))
    counts = F.transform(sides, lambda s: F.struct(F.size(F.array_intersect(s["p"], s["g"])).cast("double").alias("common"), F.size(s["p"]).alias("p"), F.size(s["g"]).alias("g")))

    def score(s: Column) -> Column:
        common, p, g = s["common"], s["p"], s["g"]
        shared = _harmonic(F.when(p > 0, common / F.greatest(p, F.lit(1))).otherwise(0.0), common / F.greatest(g, F.lit(1)))
        return F.when(g == 0, 0.0).otherwise(shared)

    return F.transform(counts, score)[0]


def _rouge_tokens(text: str, stemming: bool) -> list[str]:
    """Tokens of a normal text, those of more than three letters by their stems where wanted."""
    words = re.findall("[a-z0-9]+", text)
    return [stem(w) if len(w) > 3 else w for w in words] if stemming else words


def _small_batches() -> None:
    """Rows reach Python 500 at a time where the session has Spark's default, as texts may be long."""
    conf = SparkSession.active().conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def rouge_n(pred: str, gold: str, n: int, stemming: bool = False) -> Column:
    """F measure over n-gram multisets of [a-z0-9]+ tokens, linear in the texts' lengths."""
    grams = lambda t: Counter(zip(*(t[i:] for i in range(n))))

    @F.pandas_udf(DoubleType())
    def measure(p: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(p, g):
            x, y = grams(_rouge_tokens(a, stemming)), grams(_rouge_tokens(b, stemming))
            common = (x & y).total()
            out.append(2 * common / (x.total() + y.total()) if common else 0.0)
        return pd.Series(out)

    _small_batches()
    return measure(_norm(pred), _norm(gold))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of one integer a row."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def rouge_l(pred: str, gold: str, stemming: bool = False) -> Column:
    """F measure of the longest common subsequence of [a-z0-9]+ tokens."""

    @F.pandas_udf(DoubleType())
    def measure(p: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(p, g):
            a, b = _rouge_tokens(a, stemming), _rouge_tokens(b, stemming)
            n = lcs(a, b) if a and b else 0
            out.append(2 * n / (len(a) + len(b)) if n else 0.0)
        return pd.Series(out)

    _small_batches()
    return measure(_norm(pred), _norm(gold))
