"""Copies of a vector make no pairs in greedy deduplication, and workers deal vectors out in bounded batches."""

import numpy as np

from loomgraph.operators import similarity as SI


def loop(rows, threshold):
    """rows: (id, vector) by id, ids may repeat."""
    unit = lambda v: np.array(v) / np.linalg.norm(v) if v is not None and np.linalg.norm(v) > 0 else None
    kept = {}
    for i in sorted({k for k, _ in rows}):
        own = [unit(v) for k, v in rows if k == i]
        if not any(a is not None and b is not None and a @ b >= threshold for vs in kept.values() for a in vs for b in own):
            kept[i] = own
    return sorted(kept)


def test_copies_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [[float(x) for x in rng.normal(size=6)] for _ in range(5)]
    near = [x + (0.3 if i == 0 else 0.0) for i, x in enumerate(base[0])]
    rows = [(k, [*base, near][k * 7 % 6]) for k in range(60)] + [(7, base[1]), (90, [0.0] * 6), (91, [0.0] * 6), (92, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    seen, whole = [], SI.cosine_pairs
    monkeypatch.setattr(SI, "cosine_pairs", lambda *a: seen.append(whole(*a).count()) or whole(*a))
    for threshold in (0.95, 0.5):
        assert sorted(r.id for r in SI.greedy_dedup(df, threshold).collect()) == loop(rows, threshold)
    assert max(seen) < 40  # 60 rows in six classes have some 300


def test_dealing_in_bounded_batches(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>").coalesce(1)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = sorted((i, j) for i in range(120) for j in range(i + 1, 120) if u[i] @ u[j] >= 0.35)
    monkeypatch.setattr(SI, "PLACED", 300)
    assert sorted((r.a, r.b) for r in SI.cosine_pairs(df, 0.35, block=16).collect()) == want
    assert [len(p) for p in SI._parts(np.arange(10), 4)] == [4, 4, 2] and [len(p) for p in SI._parts(np.arange(2), 0)] == [1, 1]
