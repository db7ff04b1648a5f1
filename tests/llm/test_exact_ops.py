"""Operators that are exact: held against brute force, round trips and the libraries."""

import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest

from loomgraph.llm import decontaminate as D
from loomgraph.llm import fingerprint as FP
from loomgraph.llm import packing, token_count, token_store, warc
from loomgraph.llm.encode import Encoder, resolve
from loomgraph.llm.fm_index import FMIndex
from loomgraph.llm.perfect_hash import PerfectHash

ODD = ["", " ", "\n\n", "a", "it's I'VE\t\ttabs \r\n x", "<|endoftext|> in text", "日本語 テスト ÉİßΣς", "é ﬁ ①", "x" * 5000, "a b " * 4000, " nb sp em", "😀😁 🤖", "end "]


def table(spark, texts):
    rows = [(i * 2 + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'e' AS lang", "7 AS start", "8 AS key", "9 AS length"), rows


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    for room in (1_000_000, 8):
        e = Encoder(resolve(name), room)
        texts = ODD * 2 + ["the of and " + t for t in ODD]
        want = [struct.pack(f"<{len(i)}I", *i) for i in (e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)]
        assert [e.encode(t) for t in texts] == want
        assert list(e.encode_all(texts)) == want


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    h = PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))
    assert len(PerfectHash.build(np.zeros(0, np.uint64)).slots(keys)) == 5000
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([3, 3], np.uint64))


def test_token_store_round_trip(spark, tmp_path):
    docs, rows = table(spark, [*ODD, None])
    docs = docs.unionByName(docs.where("doc_id in (1, 7)")).unionByName(docs.where("doc_id = 3").selectExpr("CAST(NULL AS BIGINT) doc_id", "text", "lang", "start", "key", "length"))
    manifest = token_store.write_store(docs, "file://" + str(tmp_path / "s"), "byte_bpe_50k.json", 0)
    got = {r.doc_id: r for r in token_store.read_store(spark, manifest).collect()}
    t, at = Encoder(resolve("byte_bpe_50k.json")).tokenizer, 0
    assert len(got) == len(rows)
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        assert token_store.get(manifest, d).tolist() == ids
        at += len(ids)
    assert token_store.get(manifest, 2) is None and token_store.get(manifest, -5) is None
    assert token_store.read_store(spark, token_store.write_store(docs.where("doc_id < 0"), "file://" + str(tmp_path / "e"), "byte_bpe_50k.json", 0)).collect() == []


def test_packing_places_each_token_once(spark):
    docs, rows = table(spark, [*ODD, None, *["word " * n for n in range(1, 60, 7)]])
    out = packing.pack(docs.repartition(3), "word_bpe_49k.json", 2, 128).collect()
    t = Encoder(resolve("word_bpe_49k.json")).tokenizer
    bins = {}
    for d, text in rows:
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 2], 0
        for p in sorted((r for r in out if r.doc_id == d), key=lambda r: r.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(bins) == list(range(len(bins)))
    padding = total = 0
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 128
        total += at
        padding += 0 if at & (at - 1) == 0 else 128 - at
    assert padding < 0.05 * total
    assert packing.pack(docs.where("doc_id < 0"), "word_bpe_49k.json", 2).collect() == []


def test_token_counts_equal_library():
    from tokenizers import Tokenizer, models

    mark = token_count.MARK
    rng = random.Random(3)
    letters = [(c, -float(rng.randint(1, 4))) for c in "abc" + mark]
    pieces = {("".join(rng.choice("abc") for _ in range(rng.randint(2, 4)))): -float(rng.randint(2, 8)) for _ in range(25)}
    vocabularies = [letters + list(pieces.items()), letters + list(pieces.items()) + [(mark + "ab", -3.0), ("a" + mark, -2.0)], token_count.read_vocabulary(resolve("piece_bpe_32k.model"))]
    for v in vocabularies:
        byte = sum(p.startswith("<0x") for p, _ in v) == 256
        low = min(s for _, s in v)
        library = Tokenizer(models.Unigram([("<unk>", max(0.0, low)), *v], unk_id=0, byte_fallback=byte))
        c = token_count.Counter(v, room=50)
        for _ in range(300):
            text = "".join(rng.choice("aabbcc d") for _ in range(rng.randint(0, 40)))
            want = len(library.encode(mark + text.replace(" ", mark)).ids) if text else 0
            assert c.count(text) == want, text
    c = token_count.counter(resolve("piece_bpe_32k.model"))
    for text in ODD:
        assert c.count(text) == (len(library.encode(mark + text.replace(" ", mark)).ids) if text else 0)


def test_token_count_rows(spark):
    docs, _ = table(spark, ["", None, "a b"])
    assert [tuple(r)[:2] for r in token_count.count_tokens(docs, "piece_bpe_32k.model").orderBy("doc_id").collect()] == [(1, 0), (3, 0), (5, 3)]
    assert token_count.count_tokens(docs.where("doc_id < 0"), "piece_bpe_32k.model").collect() == []


def test_fm_index_finds_all():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 3000)
    text[-1] = 0
    index = FMIndex(text, 5)
    for n in (1, 2, 5):
        patterns = rng.integers(1, 5, (40, n))
        for p, low, high in zip(patterns, *index.ranges(patterns)):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def test_decontamination_cases(spark):
    words = [f"w{i}" for i in range(60)]
    item = " ".join(words[:20])
    bench = spark.createDataFrame([(1, item), (10, "tiny Item"), (2, None), (3, " .. "), (None, "other thing"), (4, " ".join(words[5:25]))], "item_id long, text string")
    texts = [f"Before {item.upper()} after", "nothing", None, "", " ".join(words[:12]), "a tiny,ITEM here", f"x {' '.join(words[3:16])} y " + "pad " * 1000, "é" + item]
    docs, rows = table(spark, texts)
    docs = docs.withColumnRenamed("lang", "leak_words")
    for block in (1 << 25, 10):
        got = {r.doc_id: r for r in D.remove_leaks(D.find_leaks(docs, bench, block_bytes=block)).withColumn("n", D.n_hit()).collect()}
        assert len(got) == len(rows)
        hit = [got[d].n for d, _ in rows]
        assert hit == [20, 0, 0, 0, 0, 2, 13, 19]
        assert got[1].text == "Before   after" and got[1].leak_items == [1, 4]
        assert got[3].text == "nothing" and got[5].text is None and got[11].text == "a   here"
    assert all(r.leak_spans == [] for r in D.find_leaks(docs, bench.where("item_id < 0")).collect())
    assert D.find_leaks(docs.where("doc_id < 0"), bench).collect() == []


def test_fingerprints(spark, monkeypatch):
    texts = ["Straße  ﬁne", "STRASSE fine", "strasse\nfine ", None, "", " ", "other", "é", "é"]
    docs, _ = table(spark, texts)
    got = {r.doc_id: r for r in FP.exact_groups(docs).collect()}
    assert [got[d].class_id for d in range(1, 19, 2)] == [1, 1, 1, 7, 7, 7, 13, 15, 15]
    assert [got[d].n_chars for d in range(1, 19, 2)] == [len(t or "") for t in texts]
    assert FP.exact_groups(docs.where("doc_id < 0")).collect() == []
    assert FP.edited("abcdefgh", "XY") == "abcdefXY" and FP.edited("abcdefgh", "X") == "abcdefX" and FP.edited("abc", "X") == "abc"


def test_byte_comparison_splits_a_bucket(spark):
    docs, _ = table(spark, ["one", "two", "one"])
    made = FP.fingerprints(docs).withColumn("fingerprint", FP.F.lit(FP.digest("two")))
    own = {r.doc_id for r in FP.differing(docs, made).collect()}
    assert own == {3}  # the only one with this digest whose bytes differ from the first text's


def test_warc_round_trip_and_salvage(spark, tmp_path):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 5000, "<p>a</p>"]
    pages = spark.createDataFrame([(i * 3 + 2, f"http://x/{i} ü" if i else None, h) for i, h in enumerate(html)] + [(2, None, "<p>a</p>"), (None, "u", "x")], "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS sha1")
    paths = warc.write_archives(pages, "file://" + str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archives(spark, paths).collect()}
    assert sorted(got) == [2, 5, 8, 11, 14, 17, 20]
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {8: 2, 14: 11, 20: 2}
    assert got[17].payload == "é" * 5000 and got[17].payload_bytes == 10000 and got[11].payload_bytes == 0
    assert got[20].payload_digest == warc.sha1_32(b"<p>a</p>") and got[20].payload_bytes == 8
    assert warc.quarantined(spark, paths).collect() == []
    assert warc.write_archives(pages.where("page_id < 0"), "file://" + str(tmp_path / "n")) == [] and warc.read_archives(spark, []).collect() == []


def test_salvage_recovers_around_damage():
    body = lambda i: b"<p>%d</p>" % i * 50
    plain = [warc.record(i, f"http://x/{i}", body(i), warc.sha1_32(body(i)), None) for i in range(30)]
    zipped = [warc.member(r) for r in plain]

    def read(data):
        s = warc.Salvage(io.BytesIO(data), len(data))
        return [r.page_id for r in s], [g[:2] for g in s.gaps]

    rng = random.Random(4)
    for parts in (zipped, plain, [random.Random(5).choice(p) for p in zip(zipped, plain)]):
        whole = b"".join(parts)
        assert read(whole) == (list(range(30)), [])
        ends = np.cumsum([0, *map(len, parts)])
        for _ in range(25):
            k = rng.randrange(30)
            bad = bytearray(whole)
            for at in range(ends[k], ends[k + 1], 37):
                bad[at] ^= 0x5A
            ids, gaps = read(bytes(bad))
            assert set(range(30)) - {k} <= set(ids) | {k} and k not in ids and gaps == [(ends[k], ends[k + 1])]
        assert read(whole[:-7]) == (list(range(29)), [(ends[29], len(whole) - 7)])
        assert read(b"junk" + whole + b"\x1f\x8b\x08tail")[0] == list(range(30))
    assert read(b"") == ([], [])
