"""Metrics read each text once, and hand texts, not lists of tokens, to Python in small batches."""

from pyspark.sql import functions as F

from loomgraph.functions import metrics as M
from loomgraph.functions import text as X


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_cut_once(spark):
    df = spark.createDataFrame([("a b b", "b c"), ("", ""), (None, "x"), ("数 a", "数")], "p string, g string")
    out = df.select(M.token_f1("p", "g").alias("f"))
    assert plan(out).count("split(") == 2  # a side each
    assert [round(r.f, 6) for r in out.collect()] == [0.4, 0.0, 0.0, 0.666667]


def test_rouge_gets_texts(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df = spark.createDataFrame([("The cat sat", "the cat"), (None, "x"), ("", "")], "p string, g string")
    one, two = df.select(M.rouge_l("p", "g").alias("f")), df.select(M.rouge_n("p", "g", 1).alias("f"))
    assert "regexp_extract_all" not in plan(one) + plan(two)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) < 10000
    assert [round(r.f, 6) for r in one.collect()] == [round(r.f, 6) for r in two.collect()] == [0.8, 0.0, 0.0]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_strip_has_no_pattern(spark):
    df = spark.createDataFrame([(" \t\n\x0b\f\ra b \r\n",), ("",), (" \n ",), (None,)], "t string").select(X.strip("t").alias("t"))
    assert "regexp" not in plan(df)
    assert [r.t for r in df.collect()] == ["a b", "", "", None]
