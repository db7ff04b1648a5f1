"""Cosine pairs in cells against all pairs."""

import numpy as np
import pytest

from loomgraph.operators import similarity as SI


def brute(rows, threshold):
    out = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and len(x) == len(y) and a != b:
                n = np.linalg.norm(x) * np.linalg.norm(y)
                if n > 0 and np.dot(x, y) / n >= threshold:
                    out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("threshold", [0.95, 0.6, 0.2])
def test_cells_lose_no_pair(spark, threshold):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(150)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, []), (1003, [1.0, 2.0]), (1004, [1.0, 2.1]), (1005, [float("nan")] * 8), (1006, [1.0, None])]
    plain = [(k, x if x and None not in x and not np.isnan(x).any() else None) for k, x in rows]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    found = [(r.a, r.b) for r in SI.cosine_pairs(vectors, threshold, block=20).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(plain, threshold)


def test_texts_as_ids_and_no_rows(spark):
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    assert [(r.a, r.b) for r in SI.cosine_pairs(vectors, 0.9, block=1).collect()] == [("a", "b")]
    assert SI.cosine_pairs(vectors.where("false"), 0.9).collect() == []
