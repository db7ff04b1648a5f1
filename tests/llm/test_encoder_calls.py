"""Chunks learned in lower case and without the normalizer have the library's ids."""

import struct

import pytest

from loomgraph.llm.encode import Encoder, resolve

TEXTS = [
    "Word, word. WORD! word?! (word). don't, it's... o'clock; x1. 1. 1, a.b.c, ...", "Straße, STRASSE. İstanbul, Ⱥb. É, é! ǅ, ñ.\n\nEnd:", "a,b, c;d; end.\n next,\nlast",
    "日本, e\u0301, Σ, ΣΑΣ. word\u00a0, tab\t, x", ", . ;", "we'll. I'D! 's, 't. a's, ''s. <|x|>, x--, --x.", "",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ends_and_case(name):
    e = Encoder(resolve(name), room=40)
    want = [struct.pack(f"<{len(i)}I", *i) for i in (e.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS)]
    assert [e.encode(t) for t in TEXTS] == want and list(e.encode_all(TEXTS * 2)) == want * 2


def test_no_normalizer_for_stable_letters():
    e = Encoder(resolve("word_bpe_49k.json"))
    assert e.plain.normalizer is None and e.tokenizer.normalizer is not None
    assert Encoder(resolve("byte_bpe_50k.json")).plain.normalizer is None
