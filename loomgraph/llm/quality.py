"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Each text becomes a fixed vector of statistics. Scaled by the training mean and deviation,
it is mapped by cosines of random directions, which approximate a Gaussian kernel, and the
scaled statistics themselves are appended (so the kernel is Gaussian plus linear). Each
partition sums its own normal equations; the sums of sums are solved once for the ridge
weights. Pool-adjacent-violators over a calibration part (a fifth of the training rows,
held from the ridge) turns scores into probabilities. Fitted on a bounded sample of
labelled rows outside the held-out fold.

Defined results: null text counts as empty, and empty texts are scored like any other;
null keys are kept; repeated rows each give a row; without labels all score 0.5; with one
class only all score its label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.labelled import SAMPLE_ROWS, labelled_sample, remainder
from loomgraph.llm.workers import mapped

DIRECTIONS = 400
RIDGE = 1.0
SEED = 20
#: Counted one by one, as a share of the characters.
SYMBOLS = "!?.,;:|*#%$&@/\\<>{}[]()=_-+\"'0123456789\n"


def statistics(text: str) -> list[float]:
    n = len(text)
    words = text.split()
    m = len(words)
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    lengths = np.fromiter(map(len, words), np.int32, m) if m else np.zeros(1, np.int32)
    distinct = len(set(words))
    same_next = sum(a == b for a, b in zip(words, words[1:]))
    starts = len({w[:4] for w in words})
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    other = int(counts[0xC3:].sum())
    letters = upper + lower + other
    punctuated = sum(x.rstrip()[-1:] in ".!?" for x in full)
    out = [
        np.log1p(n), np.log1p(m), float(lengths.mean()), float(lengths.std()), float(lengths.max()) ** 0.5,
        distinct / max(m, 1), np.log1p(distinct) / max(np.log1p(m), 1e-9), same_next / max(m - 1, 1), starts / max(m, 1),
        upper / max(letters, 1), other / max(letters, 1), letters / max(n, 1), counts[48:58].sum() / max(n, 1),
        np.log1p(len(full)), n / max(len(full), 1) / 200, 1 - len(set(full)) / max(len(full), 1), punctuated / max(len(full), 1),
        float((lengths <= 3).mean()), float((lengths >= 12).mean()), counts[32] / max(n, 1),
    ]
    return out + [float(np.sqrt(counts[ord(c)] / max(n, 1))) for c in SYMBOLS]


class Kernel:
    """Scaled statistics -> cosines of random directions (and a constant)."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, directions: int = DIRECTIONS, width: float | None = None):
        rng = np.random.default_rng(SEED)
        d = len(mean)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(0, 1 / (width or np.sqrt(d)), (d, directions))
        self.b = rng.uniform(0, 2 * np.pi, directions)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -5, 5)
        return np.concatenate([np.ones((len(x), 1)), np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1]), z / np.sqrt(z.shape[1])], 1)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing step function, as (score, probability)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of scores
    for s, t in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([t, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    def __init__(self, kernel: Kernel | None, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
        self.kernel, self.weights, self.knots = kernel, weights, knots

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(texts), self.knots[1][0])
        out = np.empty(len(texts))
        for i in range(0, len(texts), 1000):
            x = np.array([statistics(t) for t in texts[i : i + 1000]])
            out[i : i + 1000] = np.interp(self.kernel(x) @ self.weights, *self.knots)
        return np.clip(out, 0, 1)


def _summed(rows: DataFrame, part) -> np.ndarray:
    """Sum over partitions of the matrix that part(batches) makes of each; row by row, with map-side sums."""

    def rows_of(batches):
        total = part(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = np.sum(np.array(table.column("v").to_pylist()), 0)
        return pa.table({"i": table.column("i")[:1], "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    made = rows.transform(mapped, rows_of, "i long, v array<double>").groupBy("i").applyInArrow(add, "i long, v array<double>").toArrow()
    if not made.num_rows:
        return np.zeros((0, 0))
    made = made.sort_by("i")
    return np.array(made.column("v").to_pylist())


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> Model:
    sample = labelled_sample(docs, labels, "quality", modulus, held_out, rows)
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(None, np.zeros(0), (np.zeros(1), np.array([float(next(iter(n), 0.5))])))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5))
    used = sample.withColumn("calibrates", fold == 0).select("text", "y", "calibrates")

    def vectors(batch) -> np.ndarray:
        return np.array([statistics(t) for t in batch.column(0).to_pylist()])

    def moments(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = vectors(b)
                own = np.stack([np.concatenate([[len(x)], x.sum(0)]), np.concatenate([[len(x)], (x * x).sum(0)])])
                total = own if total is None else total + own
        return total

    first, second = _summed(used, moments)
    mean = first[1:] / first[0]
    kernel = Kernel(mean, np.sqrt(np.maximum(second[1:] / first[0] - mean**2, 0)))
    sent = docs.sparkSession.sparkContext.broadcast(kernel)

    def normal(batches):
        total = None
        for b in batches:
            keep = ~b.column(2).to_numpy(zero_copy_only=False)
            if keep.any():
                z = sent.value(vectors(b)[keep])
                y = b.column(1).to_numpy()[keep].astype(float)
                own = np.concatenate([z.T @ z, (z.T @ y)[:, None]], 1)
                total = own if total is None else total + own
        return total

    sums = _summed(used, normal)
    weights = np.linalg.solve(sums[:, :-1] + RIDGE * np.eye(len(sums)), sums[:, -1])

    def calibrate(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(sent.value(vectors(b)) @ weights), b.column(1)], names=["score", "y"])

    held = used.where("calibrates").transform(mapped, calibrate, "score double, y int").toPandas()
    if not len(held):
        held = used.transform(mapped, calibrate, "score double, y int").toPandas()
    return Model(kernel, weights, isotonic(held["score"].to_numpy(), held["y"].to_numpy(float)))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "quality_score") -> DataFrame:
    """docs with a score column; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)
    schema = T.StructType(docs.schema.fields + [T.StructField(column, T.DoubleType())])

    def run(batches):
        for b in batches:
            scores = sent.value.scores([t or "" for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], names=[*b.schema.names, column])

    return docs.transform(mapped, run, schema)


THRESHOLD = 0.5


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), F.col("quality_score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
