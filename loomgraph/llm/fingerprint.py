"""Document fingerprints: a canonical exact digest.

Canonical form: Unicode NFKC, case folding, NFKC again, white space runs to one space,
ends trimmed. The fingerprint is the 128-bit xxhash of its UTF-8 bytes. Buckets of equal
fingerprints are then compared byte by byte with the text of their least doc_id; a text
that differs gets its own fingerprint (the bucket's, a dash and a SHA-256).

Defined results: null text counts as empty; empty and all-space texts share a fingerprint;
null keys are dropped; repeated rows each give a row; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.idfilter import keep_listed
from loomgraph.llm.token_store import _schema
from loomgraph.llm.workers import mapped
from loomgraph.scratch import materialize


def canonical(text: str) -> bytes:
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.casefold()
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    else:
        text = text.lower()
    return " ".join(text.split()).encode()


def digest(text: str) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(canonical(text))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, fingerprint before the byte comparison."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")

    def make(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(digest, texts), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return rows.transform(mapped, make, "doc_id long, n_chars long, fingerprint string")


def differing(docs: DataFrame, made: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Byte comparison inside equal buckets: (doc_id, own) for each text unlike its bucket's first.

    docs are the texts, made has their doc_id and fingerprint. Only texts of buckets with
    two members or more are dealt out; a hot bucket's rows are split by the adaptive join.
    """
    buckets = made.groupBy("fingerprint").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("fingerprint", "leader")
    buckets = materialize(buckets, "bucket-leaders")  # as a table, so that the join can split a hot bucket
    members = materialize(made.select("doc_id", "fingerprint").join(buckets, "fingerprint").distinct(), "buckets")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = keep_listed(rows, "doc_id", members.select("doc_id")).join(members, "doc_id")
    texts = materialize(texts, "bucket-texts")
    first = materialize(texts.where("doc_id = leader").groupBy("leader").agg(F.min("text").alias("leader_text")), "leader-texts")

    def compare(batches):
        for b in batches:
            ids, own = [], []
            for doc, print_, text_, other in zip(*(b.column(i).to_pylist() for i in range(4))):
                mine = canonical(text_)
                if digest(text_) == print_ and mine != canonical(other):
                    ids.append(doc)
                    own.append(f"{print_}-{hashlib.sha256(mine).hexdigest()}")
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.string())], names=["doc_id", "own"])

    return texts.join(first, "leader").select("doc_id", "fingerprint", "text", "leader_text").transform(mapped, compare, "doc_id long, own string")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint, class_id: the least doc_id of those with equal canonical bytes."""
    made = materialize(fingerprints(docs, key, text), "fingerprints")
    final = _settled(docs, made, key, text)
    least = final.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    return final.join(least, "fingerprint").select("doc_id", "n_chars", "fingerprint", "class_id")


def _settled(docs: DataFrame, made: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """made with the fingerprints that the byte comparison gave; a repeated key with other texts keeps each row's own."""
    other = materialize(differing(docs, made, key, text), "differing")
    if other.isEmpty():
        return made
    own = other.groupBy(F.col("doc_id"), F.split("own", "-")[0].alias("fingerprint")).agg(F.min("own").alias("own"))
    joined = made.join(own, ["doc_id", "fingerprint"], "left").withColumn("fingerprint", F.coalesce("own", "fingerprint")).drop("own")
    return joined.select(*made.columns)


def edited(text: str, after: str) -> str:
    """The last quarter of the text gives way to as much of the next one's beginning."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


EDITED = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, text string"


def _edits(pairs):
    """(kind, part, doc, text, next text or None, kept text) -> a batch."""
    out = []
    for kind, part, doc, text, after, kept in pairs:
        changed = None if after is None else edited(text, after)
        out.append((
            kind, part, doc, len(text), changed and hashlib.sha256(changed.encode()).hexdigest() or (None if after is None else hashlib.sha256(b"").hexdigest()),
            digest(text), None if after is None else digest(changed), None if after is None else digest(after), kept,
        ))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _schema(EDITED))], schema=_schema(EDITED))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.where("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def in_order(batches):
        """Each document with the next of its task; the first and last texts are kept for the seams (kind 1: first, 2: last, 0: else)."""
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), None
        for b in batches:
            made = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if before is None:
                    made.append((1, part, doc, text, None, text))
                else:
                    made.append((0, part, *before, text, None))
                before = doc, text
            if made:
                yield _edits(made)
        if before is not None:
            yield _edits([(2, part, *before, None, before[1])])

    made = materialize(rows.transform(mapped, in_order, EDITED), "edited")
    parts = [r.part for r in made.where("kind = 1").select("part").orderBy("part").collect()]  # one row a task
    seams = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, next_part int")
    last = made.where("kind = 2").select("part", "doc_id", "text")
    first = made.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))

    def at_seams(batches):
        for b in batches:
            if b.num_rows:
                part, doc, text, after = (b.column(i).to_pylist() for i in range(4))
                yield _edits([(0, *x, None) for x in zip(part, doc, text, after)])

    ends = last.join(seams, "part").join(first, "next_part").select("part", "doc_id", "text", "next_text").transform(mapped, at_seams, EDITED)
    ends = materialize(ends, "seams")
    all_ = made.where("kind = 0").unionByName(ends).drop("kind", "part", "text")
    final = _settled(docs, all_)
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return final.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next_fingerprint").alias("near_next"),
    )
