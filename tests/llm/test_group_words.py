"""Words taken from groups of texts are those of each text, and few are looked up."""

import math
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import toxicity as T
from loomgraph.llm import words as W

#: Signs, look-alikes, letters of one to four bytes, white space of one to three, no letters at all.
PIECES = list("aaabbeiost") + ["\u00e9", "\u0301", "\u00df", "\u00e7", "\u03a9", "\u0416", "\u4e2d", "\u01c5", "\U0001d49c", *"|.,!'\"-_$@10", "\u20ac", "\u00b7", "\u201c", "\u201d"]
PIECES += [" "] * 8 + ["  ", "\x00", "\u200b", *(c for c in map(chr, range(0x110000)) if c.isspace())]
PIECES += [" a b c ", " i d i o t!", "aaaa", "\u00e9" * 4, "\u00e9" * 3, "e\u00e9" * 3, "idiot", "Idiot,", "(idiots)", "\u00e9lan", "\u00e9lans", "stupid", "stupidity.", "''''''idiot", "\u00cfD\u0130OT"]


@pytest.fixture(scope="module")
def restorer():
    n = T.SYMBOLS**3
    at = np.arange(0, n, 7)
    model = T.LanguageModel(at, np.random.default_rng(5).integers(1, 50, len(at)))
    model.words, model.longest = {"a": -3.0, "idiot": -5.0, "bc": -4.0}, 5
    return T.Restorer(model)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(6)
    return ["", None, " ", "\u3000", "\u00e9", "a\x00b \x00 idiot\x00"] + ["".join(rng.choice(PIECES, rng.integers(1, 40))) for _ in range(3000)]


def test_words_without_findings_are_not_looked_up(restorer, monkeypatch):
    asked = []
    word = T.Restorer.word
    monkeypatch.setattr(T.Restorer, "word", lambda self, w: asked.append(w) or word(self, w))
    score = T.Score(restorer, {"=idiot": 3.0, "stup": 2.0}, [-3.0, 1, 1, 1, 1, 1])
    names = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "klmnprst" for d in ("era", "una", "\u00edna")]
    found = score.numbers(" ".join(names) + " Idiot, (stupidity) 1d10t")
    assert found[:4] == [1.0, math.log1p(3.0 + 2.0 + 3.0 * (word(restorer, "1d10t") == "idiot")), math.log1p(2 + (word(restorer, "1d10t") == "idiot")), 1.0]
    assert len(asked) < len(names) / 10


def test_places_of_words(texts, monkeypatch):
    monkeypatch.setattr(W, "STEP", 700)
    lower = [(t or "").lower() for t in texts]
    made = W.Words(lower)
    every = W.strings(made.data, made.start, made.end).to_pylist()
    assert [every[i:j] for i, j in zip(made.bounds, made.bounds[1:])] == [t.split() for t in lower]
    assert made.text.tolist() == [k for k, t in enumerate(lower) for _ in t.split()]
    assert made.start.size > 3 * 700
    bare = W.strings(made.data, np.where(made.plain, made.from_, 0), np.where(made.plain, made.to, 0)).to_pylist()
    assert 0 < made.plain.sum() < len(every)
    for word, inner, plain in zip(every, bare, made.plain):
        assert not plain or inner == word.strip(T.EDGE) and inner.isalpha() and not T.SUSPICIOUS.search(inner)
        assert plain or not (word.isascii() and word.isalpha() and not T.SUSPICIOUS.search(word))


def test_numbers_by_hand(restorer, texts):
    weights = {"=idiot": 3.0, "stup": 2.0, "stupidi": 2.5, "=a": 0.25, "=\u00e9": 0.5, "=\u00e9lan": 1.5, "\u00e9lan": 1.25, "abbe": 0.75, "=\u00df": 0.125}
    score = T.Score(restorer, weights, [-3.0, 1, 1, 1, 1, 1])

    def by_hand(text):
        words = T.SPACED.sub(lambda m: T.segment(restorer.word(m[0].replace(" ", "")), restorer.model), (text or "").lower()).split()
        all_ = [max([weights.get(f, 0.0) for f in T.features(restorer.word(w))], default=0.0) for w in words]
        found = [w for w in all_ if w]
        return [1.0, math.log1p(sum(found)), math.log1p(len(found)), float(len(found) > 1), min(1.0, 20 * len(found) / max(len(words), 20)), max(found, default=0.0)]

    want = [by_hand(t) for t in texts]
    assert len({w[5] for w in want}) > 5
    assert list(score.all_numbers(texts)) == want
    assert [score.numbers(t or "") for t in texts[:50]] == want[:50]


def test_features_and_words_of_groups_by_hand(restorer, texts, monkeypatch):
    features, words = Counter(), Counter()
    for t in texts:
        clean = {restorer.word(w) for w in restorer.words(t or "")}
        features.update({f for w in clean for f in T.features(w)})
        words.update(clean - {""})
    for size in (50, W.GROUP):
        monkeypatch.setattr(W, "GROUP", size)
        got, got_words = Counter(), Counter()
        for group in W.groups(texts):
            for found, n in T.feature_counts(group, restorer, restorer.word):
                got.update(dict(zip(found, n.tolist())))
            found, text, which = W.Words([restorer.unspaced(t) for t in group]).pairs(restorer.word)
            assert len(set(zip(text.tolist(), which.tolist()))) == len(which)
            got_words.update(np.array(found.to_pylist(), object)[which].tolist())
        assert got == features and got_words == words


def test_spaced_letters_are_seen_soon(texts):
    rng = np.random.default_rng(7)
    more = ["".join(rng.choice(list("aa\u00e91_   .!\n\u4e2d"), rng.integers(1, 30))) for _ in range(20_000)]
    assert sum(bool(T.SPACED.search(t)) for t in more) > 100
    for t in [t or "" for t in texts] + more:
        assert T.spaced(t) == T.SPACED.findall(t.lower()) and T.spaced_to(" ", t) == T.SPACED.sub(" ", t.lower())
