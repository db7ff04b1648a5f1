"""Broken, very long and adversarial inputs, and results that must not depend on how rows lie."""

import hashlib
import time
import unicodedata

import numpy as np
import pytest

from loomgraph.llm import decontaminate as D
from loomgraph.llm import fingerprint, html_extract, token_count, toxicity, workers
from loomgraph.llm.dom import parse
from tests.llm.test_jaccard_join import thue_morse

BROKEN = ['<a title="x ', "<x ", "<font>", "<title>x", "<![CDATA[ x", "<a b='x", "<li><td>", "<font><p>x", "<dd><option><tr>", "<a x=\">\" y='", "<!-- x", "</p>", "</b", "<a '", "a < b <", "<div><span>"]


@pytest.mark.parametrize("unit", BROKEN)
def test_broken_pages_cost_no_more_than_whole_ones(unit):
    def seconds(size, tail):
        page = unit * (size // len(unit)) + tail
        began = time.process_time()
        parse(page)
        return time.process_time() - began

    for tail in ("", ">", "\"'>"):
        assert seconds(400_000, tail) < 25 * max(seconds(50_000, tail), 0.02)  # squares would be 64 times as long


def test_articles_without_telling_tags():
    for page, want in {
        "<main><h1>Title</h1><p>Short.</p><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></main>": "Title\nShort.\nOne\nTwo",
        "<html><body><div><div>Some text in two bare divs.</div></div></body></html>": "Some text in two bare divs.",
        "<p>a &lt; b</p>": "a < b",
        "<html><body><div><a href=x>Home</a> <a href=y>News</a> <a href=z>Shop</a></div><div><p>A long story began here. It went on for days. Nobody knew why.</p></div></body></html>": "A long story began here. It went on for days. Nobody knew why.",
    }.items():
        assert html_extract.extract(page) == want


def test_extraction_of_pages_with_and_without_sectioning_tags():
    import duckdb

    pages = [p for (p,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL ORDER BY page_id").fetchall()]
    same = sum(html_extract.extract(p) == html_extract.extract(html_extract.SECTIONS.sub(r"<\1div", p)) for p in pages)
    assert len(pages) >= 100 and same >= 0.98 * len(pages)


def test_labelled_pages_of_another_seed():
    wrong = size = 0
    for page in html_extract.labelled_pages(120, seed=77):
        nodes, pieces = parse(page)
        y = []
        for node in nodes:
            own = html_extract.attributes(node).get("data-y")
            y.append(int(own) if own is not None else y[node.parent] if node.parent >= 0 else 0)
        keep = html_extract.model().marginals(nodes, html_extract.observe(nodes, pieces))
        for k, text in pieces:
            if text:
                size += len(text)
                wrong += len(text) * ((keep[k] >= 0.5) != bool(y[k]))
    assert wrong < 0.08 * size


def test_one_language_model_whatever_the_rows_lie(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abc def", "", None, "ghi jkl mno", "é", "x"] * 20)], "doc_id long, text string")
    models = [toxicity.LanguageModel.fit(docs.repartition(n)).log for n in (1, 5)]
    assert np.array_equal(*models)
    joined = toxicity.LanguageModel.fit(spark.createDataFrame([(1, "abx")], "doc_id long, text string")).log
    apart = toxicity.LanguageModel.fit(spark.createDataFrame([(1, "ab"), (2, "x")], "doc_id long, text string")).log
    assert not np.array_equal(joined, apart)


def test_obfuscated_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.LanguageModel.fit(docs)
    model.learn(docs.select("text"))
    r = toxicity.Restorer(model)
    assert r.word("i-d-i-0-t!!") == "idiot"
    assert r.text("i  d  i  o  t") == "idiot"
    assert r.text("y o u i d i o t").split()[-1] == "idiot"  # whether "you" is a word depends on the sample


def test_viterbi_of_unbroken_text_equals_a_plain_one():
    from loomgraph.llm.encode import resolve

    vocabulary = token_count.read_vocabulary(resolve("piece_bpe_32k.model"))
    counter = token_count.Counter(vocabulary)
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 30_000))

    def plain(t):
        """All places at once, without a ring."""
        pieces = {p: s for p, s in vocabulary if not token_count.BYTE.match(p)}
        longest = max(map(len, pieces))
        best = [(0.0, 0)]
        for end in range(1, len(t) + 1):
            found = None
            for k in range(min(longest, end), 0, -1):
                s = pieces.get(t[end - k : end])
                if s is not None and (found is None or best[end - k][0] + s > found[0]):
                    found = best[end - k][0] + s, best[end - k][1] + 1
            best.append(found)
        return best[-1][1]

    assert counter.viterbi(text) == plain(text)


def test_words_alike_only_to_a_polynomial_are_no_leak(spark):
    rest = " and twelve other words that follow it here until the window is"
    docs = spark.createDataFrame([(1, thue_morse(2048, "a", "b") + rest), (2, thue_morse(2048, "b", "a") + rest)], "doc_id long, text string")
    item = spark.createDataFrame([(1, thue_morse(2048, "a", "b") + rest)], "item_id long, text string")
    found = {r.doc_id: list(r.leak_items) for r in D.find_leaks(docs, item).collect()}
    assert found == {1: [1], 2: []}


def test_equal_hashes_are_held_against_the_bytes(monkeypatch):
    """With a hash of lengths only, every text has the hashes of every other."""
    from loomgraph.llm import texthash

    monkeypatch.setattr(texthash, "lane_hashes", lambda folded, begin, end, seed: (end - begin).astype(np.uint64))
    phrases = D.Phrases([(7, "one two six ten")], 3)
    data = np.frombuffer(b"one two six ten. six one ten two", np.uint8)
    shard = D.Shard(phrases)
    shard.add(0, data[:16], np.array([0, 16]))
    shard.add(1, data[16:], np.array([0, 16]))
    assert set(shard.find()) <= {0}


def test_blocks_of_a_large_benchmark_cut_all_spans(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(words[k : k + 13])) for k in (0, 20, 45)], "item_id long, text string")
    whole = {r.doc_id: r.text for r in D.find_leaks(docs, items, remove=True).collect()}
    parts = {r.doc_id: r.text for r in D.find_leaks(docs, items, block_bytes=40, remove=True).collect()}
    assert whole == parts and whole[1].split() == words[13:20] + words[33:45] + words[58:]


def test_fingerprint_query_equals_brute_force(spark, tmp_path):
    texts = ["Straße  und\tmehr", "STRASSE UND MEHR", None, "", "ａｂｃ", "abc", "x" * 9, "one two three four five six", "abcd"]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op4_fingerprint(spark, f"file:{tmp_path}").collect()}
    canonical = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    whole = [t or "" for t in texts]
    assert sorted(got) == [k for k, _ in rows]
    for i, (k, _) in enumerate(rows):
        own, following = whole[i], whole[(i + 1) % len(whole)]
        n = len(own) // 4
        edited = own[: len(own) - n] + following[:n]
        r = got[k]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(canonical(own) == canonical(edited)) == float(r.fingerprint == r.edited_fingerprint)
        assert r.near_next == float(canonical(own) == canonical(following))
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows):
            assert (got[a].fingerprint == got[b].fingerprint) == (canonical(whole[i]) == canonical(whole[j]))


def test_sessions_settings_of_ones_own_stay(spark):
    spark.conf.set(workers.SETTING, "123")
    workers.small_batches(spark)
    assert spark.conf.get(workers.SETTING) == "123"
    spark.conf.unset(workers.SETTING)
    workers.small_batches(spark)
    assert spark.conf.get(workers.SETTING) == workers.RECORDS
