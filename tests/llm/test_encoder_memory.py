"""The encoder asks the library for each word once, signs apart, and stays equal to it."""

import random
import struct

import pytest

from loomgraph.llm.encode import Encoder, resolve

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.chars = tokenizer, 0

    def encode(self, text, **kw):
        self.chars += len(text)
        return self.tokenizer.encode(text, **kw)

    def encode_batch_fast(self, texts, **kw):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **kw)


def library(e, texts):
    return [struct.pack(f"<{len(i)}I", *i) for i in (e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)]


def test_words_with_signs_are_asked_once():
    e = Encoder(resolve("byte_bpe_50k.json"))
    words = ["".join(random.Random(i).choices("abcdefghij", k=9)) for i in range(200)]
    texts = ["x" + "".join(f" {w}{sign}" for w in words) for sign in ("", ",", ".", "!!", "$$$", ",***", "'s", "42")]
    want = library(e, texts)
    e.plain = e.tokenizer = Counting(e.tokenizer)
    assert list(e.encode_all(texts)) == want
    assert e.tokenizer.chars < 1.5 * len(texts[0])


@pytest.mark.parametrize("name", NAMES)
def test_random_texts_equal_library(name):
    parts = [*"aZé'.,!0 9\n  \n", "'s", "'ll", "don't", "we'LL", "İ", "ß", "é", "≮", "a≠", "a.Σ", "ΑΣ", "日本", "👍🏽", "\0", "\x7f", "\x01", "²", "½", "ª", "ʰ", "٠", "\t", " ", " ", "<|endoftext|>", "word", " the", "ſ", "‍"]
    for room in (600_000, 6):
        e, draw = Encoder(resolve(name), room), random.Random(7)
        for _ in range(60):
            texts = ["".join(draw.choices(parts if draw.random() < 0.3 else parts[:22], k=draw.randrange(25))) for _ in range(20)]
            assert list(e.encode_all(texts)) == library(e, texts)


@pytest.mark.parametrize("name", NAMES)
def test_empty_groups(name):
    e = Encoder(resolve(name))
    assert list(e.encode_all([])) == [] and list(e.encode_all(["", ""])) == [b"", b""]
    assert list(e.encode_all(["", " ", "\n", "", "a", ""])) == library(e, ["", " ", "\n", "", "a", ""])
