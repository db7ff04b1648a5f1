import random
import re

import pytest

from loomgraph.llm import jaccard_join as J

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, num, den):
    sets = [(d, shingles(t, width)) for d, t in rows]
    least = {d: d for d, _ in rows}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                least[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed, n_bases=6, copies=60):
    """Groups around base texts with few to many edits, shared passages, exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(40)]
    rows = []
    for b in range(n_bases):
        base = [word() for _ in range(rng.choice([9, 11, 12, 60, 150, 300]))] + (passage if b % 2 else [])
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6, 9])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows) * 3 + 1, " ".join(own).upper() if rng.random() < 0.2 else "\n".join(own)))
    rows += [(90_001, None), (90_002, ""), (90_003, " \t\n"), (90_004, "one"), (90_005, "ONE"), (90_006, "one two"), (90_007, "x " * 3000), (90_008, "x x x")]
    return rows


@pytest.mark.parametrize(("width", "num", "den", "rounds"), [(3, 90, 100, 3), (5, 80, 100, 2), (5, 80, 100, 1)])
def test_equals_brute_force(spark, monkeypatch, width, num, den, rounds):
    monkeypatch.setattr(J, "ROUNDS", rounds)
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "DEALT", 500)
    monkeypatch.setattr(J, "TAKEN", 900)
    rows = corpus(num)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("none", "none").selectExpr("doc_id", "text", "'x' AS digest", "1 AS sig", "2 AS component")
    got = sorted(tuple(r) for r in J.similarity_classes(docs.repartition(3), width, num, den).collect())
    assert got == brute(rows, width, num, den)


def test_repeats_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text), (5, text), (2, text), (None, text), (9, "other words here")], "doc_id long, text string")
    got = sorted(tuple(r) for r in J.similarity_classes(docs, 3, 90, 100).collect())
    assert got == [(2, 28, 2), (5, 28, 2), (5, 28, 2), (9, 1, 9)]
    assert J.similarity_classes(docs.where("doc_id < 0"), 3, 90, 100).collect() == []


def test_thresholds_out_of_range():
    import numpy as np

    for num in (50, 100):
        with pytest.raises(ValueError):
            J.Prefix(np.zeros(0, np.uint64), num, 100)


def thue_morse(n, first, second):
    return "".join(second if bin(i).count("1") % 2 else first for i in range(n))


def test_words_that_a_polynomial_would_confuse(spark):
    rest = " and the same words after it on both sides"
    docs = spark.createDataFrame([(1, thue_morse(2048, "a", "b") + rest), (2, thue_morse(2048, "b", "a") + rest)], "doc_id long, text string")
    got = sorted(tuple(r) for r in J.similarity_classes(docs, 3, 90, 100).collect())
    assert got == [(1, 8, 1), (2, 8, 2)]


def test_one_id_with_two_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(3, one), (7, two), (7, one), (9, two)], "doc_id long, text string")
    got = sorted(tuple(r) for r in J.similarity_classes(docs, 3, 90, 100).collect())
    assert got == [(3, 38, 3), (7, 38, 3), (7, 38, 7), (9, 38, 7)]
