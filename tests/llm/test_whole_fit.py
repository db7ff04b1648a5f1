"""Toxicity is fitted on all labelled rows, its words counted over all texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.llm import toxicity as T

DATA = "/root/testdata/sf0.01"


def test_more_labels_than_a_sample_would_hold(spark):
    rows = spark.range(30_000, numPartitions=4).selectExpr("id AS doc_id", "int(id % 10 = 0) AS toxic", "if(id % 100 = 0, 'zorgle calm', if(id % 2500 = 1, 'calm zorgle', 'calm sea')) AS text")
    fitted = T.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    used = [i for i in range(30_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    n_pos, a, b = sum(i % 10 == 0 for i in used), sum(i % 100 == 0 for i in used), sum(i % 2500 == 1 for i in used)
    assert len(used) > 20_000
    assert math.isclose(fitted.weights["=zorgle"], math.log((a + 0.5) / n_pos) - math.log((b + 0.5) / (len(used) - n_pos)))
    x = [fitted.numbers("zorgle calm" if i % 100 == 0 else "calm zorgle" if i % 2500 == 1 else "calm sea") for i in used]
    x, y = np.array(x), np.array([float(i % 10 == 0) for i in used])
    assert np.allclose(T.logistic(lambda w: T.slopes(x, y, w), y.mean(), 6), fitted.coefficients, atol=1e-5)


def test_words_of_spaced_letters_come_from_all_texts(spark):
    texts = ["a quiet harbour at dawn"] * 5 + ["q u i e t h a r b o u r", "x y z"] + ["vile vile mud"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 7)) for i in range(5, 27)], "doc_id long, toxic int")  # no label where the words are
    fitted = T.fit(docs, labels)
    own = fitted.restorer.model
    assert {"quiet", "harbour"} <= set(own.words) and "vile" not in own.words
    assert T.Restorer(own).text("q u i e t h a r b o u r") == "quiet harbour"
    other = spark.createDataFrame([("v i l e m u d",)], "text string")
    assert T.Restorer(own.within(fitted.texts, other)).text("v i l e m u d") == "vile mud"


def test_words_within_runs_segment_like_all_words(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    docs = docs.unionByName(spark.createDataFrame([("you a i d i o t now",), ("t h e t r a s h, a",), (None,)], "text string"))
    model = T.LanguageModel.fit(docs)
    some = model.within(docs, docs)
    model.learn(docs)
    assert 0 < len(some.words) < len(model.words)
    assert all(model.words[w] == p for w, p in some.words.items())
    spaced = [r.text for r in docs.where(F.col("text").rlike(r"(?U)\w +\w +\w\b")).collect() if T.SPACED.search(r.text.lower())]
    assert len(spaced) > 2
    assert [T.Restorer(some).words(t) for t in spaced] == [T.Restorer(model).words(t) for t in spaced]


def test_full_memories_pass_their_counts_on(monkeypatch):
    monkeypatch.setattr(T, "FULL", 3)
    batch = pa.RecordBatch.from_pydict({"text": ["a b", "a c", None, "d e f", "a"]})
    made = list(T.tally([batch], lambda text: set(text.split())))
    total = Counter()
    for b in made:
        total.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert len(made) == 3 and total == Counter("abacdefa")
    assert {w for b in T.distinct("abacdefa", "w") for w in b.column(0).to_pylist()} == set("abcdef")


def test_features_counted_apart_as_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").selectExpr("text", "toxic AS y").where("text is not null and y in (0, 1)")
    model = T.LanguageModel.fit(docs)
    r, by_hand, n = T.Restorer(model), {}, [0, 0]
    for row in rows.collect():
        n[row.y] += 1
        for f in {f for w in r.words(row.text) for f in T.features(r.word(w))}:
            by_hand.setdefault(f, [0, 0])[1 - row.y] += 1
    counts, tested = T.count_features(rows, spark.sparkContext.broadcast(model), n[1], n[0])
    assert tested == sum(a >= 3 for a, _ in by_hand.values())
    assert all(by_hand[c.f] == [c.a, c.b] for c in counts.collect())
    assert T.significant(counts, n[1], n[0], tested) == T.choose({f: tuple(v) for f, v in by_hand.items() if v[0] >= 3}, n[1], n[0])
