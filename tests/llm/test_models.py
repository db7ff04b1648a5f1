"""Operators with models: held-out accuracy, brute-force decoding, exact marginals, edge cases."""

import itertools
import math

import numpy as np
import pytest

from loomgraph.llm import html_extract as H
from loomgraph.llm import quality as Q
from loomgraph.llm import toxicity as T

DATA = "/root/testdata/sf0.01"


def held_out(spark, f, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = f(spark, DATA).collect()
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(a == b for a, b in own) / len(own)


def test_quality_held_out(spark):
    assert held_out(spark, Q.op9_quality, "quality") > 0.95


def test_toxicity_held_out(spark):
    assert held_out(spark, T.op6_toxicity, "toxic") > 0.85


@pytest.mark.parametrize("module", [Q, T])
def test_model_edge_cases(spark, module):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\u0000b"), (3, "a\u0000b"), (None, "x"), (5, "word " * 20000)], "doc_id long, text string").selectExpr("*", "1 AS y", "'x' AS toxicity", "'x' AS quality_score")
    column = {"Q": "quality_score"}.get(module.__name__[-7:-6].upper(), "quality_score" if module is Q else "toxicity")
    for labels in ([], [(1, 1, 1)], [(1, 1, 0), (2, 0, 1), (3, None, None), (5, 0, 1), (9, 1, 1)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        rows = module.score(docs, module.fit(docs, table)).collect()
        assert len(rows) == 6 and all(0 <= r[column] <= 1 for r in rows)
    empty = docs.where("doc_id < 0")
    assert module.score(empty, module.fit(empty, table)).collect() == []


def test_isotonic():
    x, y = Q.isotonic(np.array([3.0, 1, 2, 4]), np.array([0.0, 0, 1, 1]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and y.tolist() == [0, 0.5, 1]


def test_restoring(spark):
    model = T.LanguageModel.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    r = T.Restorer(model)
    for word, want in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "stuuuupid": "stupid", "l0ser,": "loser", "tr@sh": "trash", "hello!": "hello", "the": "the"}.items():
        assert r.word(word) == want
    assert r.text("you are an i d i o t") == "you are an idiot"


def test_viterbi_equals_all_spellings(spark):
    model = T.LanguageModel.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    rng = np.random.default_rng(1)
    for _ in range(40):
        word = "".join(rng.choice(list("a1o0s$t.")) for _ in range(rng.integers(1, 6)))
        if any(word[i] == word[i + 1] == word[i + 2] for i in range(len(word) - 2)):
            continue
        options = []
        runs = [(k, len(list(g))) for k, g in itertools.groupby(word)]
        for ch, n in runs:
            own = [(c * n, T.SUBSTITUTE) for c in T.LOOKS_LIKE.get(ch, "")] + ([(ch * n, T.SAME)] if ch.isalpha() else [])
            options.append(own + ([("", T.DROP)] if ch in T.SEPARATORS or not own else []))
        def total(path):
            a = b = 0
            s = sum(c for _, c in path)
            for byte in "".join(p for p, _ in path).encode() + b"\x00":
                y = int(T.BYTE_SYMBOL[byte])
                s += float(model.log[a, b, y])
                a, b = b, y
            return s
        best = max(total(p) for p in itertools.product(*options))
        made = T.restore(word, model)
        spelled = [total(p) for p in itertools.product(*options) if "".join(x for x, _ in p) == made]
        assert math.isclose(max(spelled), best, abs_tol=1e-6)


def test_marginals_equal_enumeration():
    page = "<div class=nav><a>x</a></div><div id=content><p>Some text here. More.</p><p>b</p></div>"
    nodes, pieces = H.parse(page)
    seen, m = H.observe(nodes, pieces), H.model()
    got = m.marginals(nodes, seen)
    total, mass = 0.0, np.zeros(len(nodes))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        s = m.root[y[0]]
        for k, node in enumerate(nodes):
            s += sum(m.unary[f][y[k]] for f in seen[k] if f in m.unary)
            if k:
                s += (m.pair.get(node.tag) or m.pair[""])[2 * y[node.parent] + y[k]]
        total += math.exp(s)
        mass += math.exp(s) * np.array(y)
    assert np.allclose(got, mass / total, atol=1e-9)


def test_extraction_on_other_labelled_pages():
    right = seen = 0
    for page in H.labelled_pages(150, seed=77):
        nodes, pieces = H.parse(page)
        keep, y = H.model().marginals(nodes, H.observe(nodes, pieces)), []
        for node in nodes:
            own = H.attributes(node).get("data-y")
            y.append(int(own) if own is not None else y[node.parent] if node.parent >= 0 else 0)
        for k, text in pieces:
            if text and text.strip():
                seen += len(text)
                right += len(text) * ((keep[k] >= 0.5) == bool(y[k]))
    assert right / seen > 0.9


def test_extraction_edge_cases(spark):
    article = "<html><body><nav><ul><li><a href=x>m</a></li></ul></nav><article><h1>T &amp; U</h1><p>One\n two&nbsp;three.<p><b>Bold<br>x</b> <!-- c --><script>no()</script></article><footer>&copy; f</footer></body></html>"
    rows = [(1, "u", article), (1, "u", article), (2, None, None), (3, "", ""), (None, "n", "plain  text"), (4, "b", "<p <<<>>> </div></p>&#x110000;&bogus;"), (5, "l", "<article>" + "<p>Long text here.</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "3 AS n_chars")
    got = H.extract_text(pages).collect()
    assert len(got) == 7
    by = {(r.page_id, r.url): r.text for r in got}
    assert by[1, "u"] == "T & U\nOne two three.\nBold x" and by[2, None] == "" and by[3, ""] == "" and by[None, "n"] == "plain text"
    assert by[5, "l"].count("\n") == 2999
    assert H.extract_text(pages.where("page_id < 0")).collect() == []
