"""Obfuscations that reach past one short word: stretched, underscored and spaced letters."""

import pytest

from loomgraph.llm import toxicity as T

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def restorer(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = T.LanguageModel.fit(docs)
    model.learn(docs.select("text"))
    return T.Restorer(model)


def test_long_and_underscored_words(restorer):
    for word, want in {"st" + "u" * 50 + "pid": "stupid", "".join(c * 20 for c in "idiot"): "idiot", "i_d_i_o_t": "idiot", "l_o_s_e_r,": "loser"}.items():
        assert restorer.word(word) == want
    assert len(restorer.word("a1b2c3.x_0" * 20_000)) > 40_000


def test_word_ends_in_spaced_letters(restorer):
    for text, want in {
        "you a i d i o t now": "you a idiot now", "what a s t u p i d l o s e r": "what a stupid loser", "t r a s h": "trash",
        "i d i o t!": "idiot", "t h e": "the", "t h e t r a s h, a": "the trash, a",
    }.items():
        assert restorer.text(text.replace(",", "")) == want.replace(",", "")


def test_segments_are_the_best_of_all(restorer):
    model = restorer.model

    def value(word):
        a = b = 0
        total = T.UNKNOWN
        for byte in word.encode() + b" ":
            s = int(T.BYTE_SYMBOL[byte])
            total += float(model.log[a, b, s])
            a, b = b, s
        return max(total, model.words.get(word, total))

    for run in ("aidiot", "theéat", "xqzno", "stupidlo"):
        ways = [[run]]
        for cuts in range(1, 1 << (len(run) - 1)):
            parts, last = [], 0
            for i in range(1, len(run)):
                if cuts >> (i - 1) & 1:
                    parts.append(run[last:i])
                    last = i
            ways.append(parts + [run[last:]])
        best = max(sum(map(value, w)) for w in ways)
        assert abs(sum(map(value, T.segment(run, model).split(" "))) - best) < 1e-5


def test_every_significant_feature_is_kept(spark):
    many = {f"w{i}": (40, 0) for i in range(2500)} | {f"c{i}": (30, 25) for i in range(300)} | {"rare": (2, 0), "even": (50, 17), "some": (30, 5)}
    found = T.significant(spark.createDataFrame([(f, a, b) for f, (a, b) in many.items()], "f string, a long, b long"), 100, 100)
    assert {f"w{i}" for i in range(2500)} <= set(found)
    assert found == T.choose({f: v for f, v in many.items() if v[0] >= 3}, 100, 100)
