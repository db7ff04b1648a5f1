"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the
shared folder as Parquet and hands a scan of it to the next. All stages but the last
return the columns of ``documents``.

* toxicity: documents scored toxic go.
* quality: documents scored of low quality go.
* near_duplicates: of each class of near-equal documents (five words, similarity of 0.8 or
  more) the one with the least doc_id stays. Documents without words are in no class.
* decontamination: passages of the benchmark are cut out of the texts.
* packing: token pieces of the documents in sequences of 4096.

A null text counts as empty throughout; rows with a null doc_id go at the third stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, jaccard_join, packing, quality, toxicity
from loomgraph.scratch import materialize

#: Chunks that a worker of the last stage remembers; fewer than by default, as the stages before have grown the executor.
PACKING_ROOM = 100_000
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _columns(docs)
    fitted = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(toxicity.score(docs, fitted).where(F.col("toxicity") < toxicity.THRESHOLD))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _columns(docs)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(quality.score(docs, model).where(F.col("quality_score") >= quality.THRESHOLD))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _columns(docs).where("doc_id is not null")
    classes = jaccard_join.similarity_classes(docs, width=5, num=80, den=100)
    extra = materialize(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("extra")).distinct(), "extra")
    return _columns(docs.join(extra, docs.doc_id == extra.extra, "left_anti"))


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = decontaminate.find_leaks(_columns(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove=True)
    changed = F.when(F.size("leak_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _columns(cut.withColumn("n_chars", changed))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, "word_bpe_49k.json", end_id=2, room=PACKING_ROOM)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", cut_benchmark_passages),
    ("packing", pack_sequences),
]
#: Scores, tokens and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
