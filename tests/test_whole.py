"""Queries over whole inputs against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest

from loomgraph.operators import graph as G
from loomgraph.operators import similarity as SI
from loomgraph.operators import traces as TR
from loomgraph.plans import registry
from loomgraph.plans.fixtures import STAR, frame
from tests.conftest import DATA


@pytest.fixture(scope="module")
def pairs():
    """(pred, gold) by document, made here anew from the tables."""
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall())
    gold = lambda k: " " + texts[k] if k % 3 == 0 else items.get(k % len(items)) if k % 3 == 1 else texts.get(k - 1)
    return {k: (t + ("" if k % 5 == 0 else " tail"), gold(k) or "") for k, t in texts.items()}


def tokens(t):
    return re.findall("[a-z0-9]+", t.lower())


def measure(common, a, b):
    return 2 * common / (a + b) if common else 0.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_metrics_over_whole_texts(spark, pairs):
    q = lambda name: {r.doc_id: r for r in registry.QUERIES[name](spark, DATA).collect()}
    em, f1, r1, r2, rl = map(q, ("em_acc", "f1_tokens", "rouge_1", "rouge_2", "rouge_l"))
    assert set(em) == set(f1) == set(r1) == set(r2) == set(rl) == set(pairs)
    assert sum(len(p) > 300 and len(g) > 300 for p, g in pairs.values()) > len(pairs) / 3
    for k, (p, g) in pairs.items():
        assert em[k].em == float(p.strip() == g.strip()) and em[k].acc == float(g.strip().lower() in p.strip().lower())
        a, b = ([w for w in re.sub("([㐀-鿿])", r" \1 ", t.lower()).split()] for t in (p, g))
        assert abs(f1[k].f1 - (measure(len(set(a) & set(b)), len(a), len(b)) if b else 0.0)) < 2e-6
        a, b = tokens(p), tokens(g)
        assert abs(r1[k].rouge1 - measure((Counter(a) & Counter(b)).total(), len(a), len(b))) < 2e-6
        x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
        assert abs(r2[k].rouge2 - measure((x & y).total(), x.total(), y.total())) < 2e-6
        if len(a) * len(b) < 200_000:
            assert abs(rl[k].rougeL - measure(lcs(a, b), len(a), len(b))) < 2e-6
        elif k % 3 == 0:
            assert abs(rl[k].rougeL - measure(len(b), len(a), len(b))) < 2e-6


def longest(near, start, max_steps, low, high, width, seed):
    """Backtracking search by recursion; near: neighbours of each node."""
    order = lambda *x: hashlib.md5("|".join((seed, *x)).encode()).hexdigest()
    degree = lambda x: len(near.get(x, ()))
    best = [start]

    def walk(path):
        nonlocal best
        if len(path) > len(best):
            best = path
        if len(best) == max_steps + 1 or len(path) == max_steps + 1:
            return
        left = [x for x in near.get(path[-1], ()) if x not in path and low <= degree(x) <= high]
        top = sorted(left, key=lambda x: (-degree(x), order(x), x))[:width]
        for x in sorted(top, key=lambda x: order(start, x)):
            if len(best) < max_steps + 1:
                walk(path + [x])

    walk([start])
    return best


@pytest.mark.parametrize("mode", ["out", "in", "all"])
def test_traces_equal_backtracking(spark, mode):
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)}
    pairs |= {("s", f"dead{i}") for i in range(9)} | {("s", "a"), ("a", "b"), ("b", "c"), ("c", "e"), ("e", "f")}
    near = {}
    for a, b in pairs:
        if mode != "in":
            near.setdefault(a, set()).add(b)
        if mode != "out":
            near.setdefault(b, set()).add(a)
    edges = spark.createDataFrame(sorted(pairs), "head string, tail string")
    ids = sorted({x for p in pairs for x in p})
    starts = spark.createDataFrame([(x,) for x in ids], "id string")
    for low, high, width in ((0, 200, 20), (1, 5, 2)):
        got = {r.start: r.path for r in TR.dfs_traces(starts, edges, 4, "x", low, high, width, mode=mode).collect()}
        want = {x: longest(near, x, 4, low, high, width, "x") for x in ids}
        assert got == {x: p[::-1] if mode == "in" else p for x, p in want.items()}
        if mode == "out" and width == 20:
            assert got["s"] == ["s", "a", "b", "c", "e"]


def test_traces_of_all_tasks(spark):
    rows = registry.QUERIES["dfs_traces"](spark, DATA).collect()
    assert {r.task for r in rows} == {r.task for r in registry.QUERIES["start_candidates"](spark, DATA).collect()}
    assert len({r.task for r in rows}) > 1


@pytest.fixture(scope="module")
def star(spark):
    return {tuple(r) for r in frame(spark, DATA, STAR).select("head", "relation", "tail").collect()}


def test_shortest_paths_of_all_heads(spark, star):
    steps = {}
    for head, _, tail in star:
        steps.setdefault(head, set()).add(tail)
    want = set()
    for src in steps:
        seen = layer = {src}
        n = 0
        while layer:
            want |= {(src, x, n) for x in layer}
            layer = {y for x in layer for y in steps.get(x, ())} - seen
            seen = seen | layer
            n += 1
    rows = registry.QUERIES["shortest_path_len"](spark, DATA).select("src", "dst", "len").collect()
    assert len(rows) == len(want) and set(map(tuple, rows)) == want
    assert {r.src for r in rows} == {x[0] for x in star}


def test_shortest_paths_in_a_loop(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a")], "head string, tail string")
    got = G.shortest_paths(e, e.selectExpr("head AS src"), None).collect()
    assert {(r.src, r.dst): r.len for r in got} == {(a, b): (ord(b) - ord(a)) % 5 for a in "abcde" for b in "abcde"}


def ent(name):
    return "ent-" + hashlib.md5(name.lower().encode()).hexdigest()


def test_paths_over_all_relations(spark, star):
    edges = {(ent(a), r, ent(b)) for a, r, b in star}
    steps, relations = {}, {}
    for a, r, b in edges:
        steps.setdefault(a, set()).add(b)
        relations.setdefault((a, b), set()).add(r)
    paths = layer = {(a, b) for a in steps for b in steps[a] if a != b}
    for _ in range(2):
        layer = {(*p, x) for p in layer for x in steps.get(p[-1], ()) if x not in p}
        paths = paths | layer
    rows = registry.QUERIES["khop_paths"](spark, DATA).collect()
    assert len(rows) == len(paths) and {(r.path, r.len) for r in rows} == {("->".join(p), len(p) - 1) for p in paths}
    want = Counter(("->".join(p), i, a, r, b) for p in paths for i, (a, b) in enumerate(zip(p, p[1:])) for r in relations[a, b])
    got = registry.QUERIES["path_relations"](spark, DATA).select("path_id", "pos", "head", "relation", "tail").toArrow().to_pydict()
    assert Counter(zip(*got.values())) == want
    assert {r for _, _, _, r, _ in want} == {"in_region", "in_nation", "placed_by", "contains", "supplied_by"}


def test_rewrites_over_all_relations(spark):
    rows = [tuple(r) for r in frame(spark, DATA, STAR).select("head", "relation", "tail", "seq").collect()]
    collect = lambda name, *c: registry.QUERIES[name](spark, DATA).select(*c).toArrow().to_pydict()
    got = Counter(zip(*collect("node_relations", "id", "head", "relation", "tail").values()))
    assert got == Counter((x, h, r, t) for h, r, t, _ in rows for x in (h, t))
    nation = dict(duckdb.sql(f"SELECT n_name, 'Nation of ' || r_name FROM '{DATA}/nation.parquet' JOIN '{DATA}/region.parquet' ON n_regionkey = r_regionkey").fetchall())
    got = Counter(zip(*collect("alias_rewrite", "head", "relation", "tail").values()))
    assert got == Counter((nation.get(h, h), r, nation.get(t, t)) for h, r, t, _ in rows)
    customers, last = {h for h, *_ in rows if h.startswith("Customer")}, {}
    for h, r, t, seq in rows:
        key = tuple("Customer" if x in customers else x for x in (h, t)) + ("located_in" if r == "in_region" else r,)
        last[key] = max(last.get(key, 0), seq)
    got = zip(*collect("edge_correction", "head", "tail", "relation", "seq").values())
    assert sorted(got) == sorted((*k, s) for k, s in last.items())


def test_greedy_dedup_leaves_no_row_undecided(spark):
    import math

    rows = [(i, [math.cos(i * math.pi / 18), math.sin(i * math.pi / 18)]) for i in range(9)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    threshold = math.cos(math.pi / 15)
    assert sorted(r.id for r in SI.greedy_dedup(vectors, threshold).collect()) == [0, 2, 4, 6, 8]
    with pytest.raises(RuntimeError):
        SI.greedy_dedup(vectors, threshold, max_rounds=2)
