"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character language model (trigrams over folded bytes, summed over all documents) and a
channel of look-alike symbols, dropped separators and repeated letters span a lattice for
each suspicious word; Viterbi picks the best clean word. Letters spaced apart are joined
first, and a second lattice, of the words of all texts and of unknown words by trigrams,
chooses where words end in them. A word of letters only without a run of three has one path and restores to itself.

The restored words are scored by words and word beginnings that separate toxic from other
labelled texts (log-likelihood ratio), summed into a few numbers for a logistic model.
Fitted on every labelled row outside the held-out fold; the language model and the counts
of words cover all texts. Of the counted words only those that lie in spaced letters of the
texts at hand are sent to workers, as no others are asked for. Texts are taken in groups
(words.py); plain words whose first letters begin no chosen feature weigh nothing and are
not looked up.

Defined results: null text counts as empty, empty texts get the score of a text without
findings; null keys are kept; repeated rows each give a row; without usable labels, or
with one class only, all score the share of label 1 (0 without labels).
"""

from __future__ import annotations

import copy
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.columns import slabs, string_buffers
from loomgraph.llm.idfilter import bitmap
from loomgraph.llm.labelled import labelled_sample, remainder
from loomgraph.llm.texthash import FOLD
from loomgraph.llm.words import Beginnings, Words, groups, once, strings
from loomgraph.llm.workers import mapped
from loomgraph.scratch import materialize

#: What a symbol may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
    "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
}
SEPARATORS = ".-_*~'`^·"
EDGE = ".,;:!?\"'()[]{}<>*-_~#%&/\\|+=`^·…“”‘’«»"
#: Costs of the channel (natural logarithms).
SUBSTITUTE, DROP, SHORTEN, SAME = -1.5, -1.0, -0.5, 0.0
SUSPICIOUS = re.compile(r"(.)\1\1|[^\W\d_](?:[^\w\s]|_)+[^\W\d_]|[\d@$!|+(<€£¥]")
SPACED = re.compile(r"(?<!\S)(?:[^\W_] +){2,}[^\W_](?=[.,;:!?]*(?!\S))")
SOON = re.compile(r" [^\W_] +[^\W_](?=[.,;:!?]*(?!\S))")  # in every match of SPACED
UNKNOWN = -8.0  # natural logarithm of the share of words that are not known
SYMBOLS = 156  # 0: the edge of a word, 1-26: a-z, 27-155: bytes of other letters
BYTE_SYMBOL = np.array([b - 96 if 97 <= b <= 122 else 27 + b - 128 if b >= 128 else 0 for b in range(256)], np.int64)[FOLD]
BEGINNINGS = (4, 5, 6, 7, 8)
LEAST_G2, MOST_G2 = 12.0, 27.0  # the threshold grows with the number of tested features between these
ROOM = 150_000
FULL = 300_000  # counted items after which a task passes its counts on


class Memory(dict):
    """Results of a function of words; all are forgotten when there are many."""

    def __init__(self, of: Callable):
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= ROOM:
            self.clear()
        self[word] = out = self.of(word)
        return out


def spaced_to(made: Callable[[re.Match], str] | str, text: str) -> str:
    """The text in lower case with spaced letters replaced."""
    text = text.lower()
    return SPACED.sub(made, text) if SOON.search(text) else text


def spaced(text: str) -> list[str]:
    """Spaced letters of a text, in lower case."""
    text = text.lower()
    return SPACED.findall(text) if SOON.search(text) else []


def tally(batches: Iterable[pa.RecordBatch], items: Callable[[str], set[str]] | None = None, of: Callable[[list[str]], dict[str, int]] | None = None) -> Iterator[pa.RecordBatch]:
    """(item, n): the number of texts with each item; an item may come more than once, to be summed. of: counts of a group of texts, instead of items of each."""
    total: Counter = Counter()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["item", "n"])

    texts = (text or "" for b in batches for text in b.column(0).to_pylist())
    for found in map(of, groups(texts)) if of else map(items, texts):
        total.update(found)
        if len(total) >= FULL:
            yield made()
            total.clear()
    if total:
        yield made()


def distinct(items: Iterable[str], name: str) -> Iterator[pa.RecordBatch]:
    """Batches of the items, without some of the repetitions."""
    seen: set[str] = set()
    for item in items:
        seen.add(item)
        if len(seen) >= FULL:
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], names=[name])
            seen.clear()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], names=[name])


GRAM = 4


def grams(word: str) -> set[str]:
    """All pieces of GRAM letters, or the word, if it is shorter."""
    return {word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1))}


def word_counts(texts: DataFrame, inside: DataFrame | None = None) -> tuple[DataFrame, int]:
    """((item, n), total): the words in three texts or more, spaced letters left out, and the sum of n over all words.

    inside: rows of runs; words with letters side by side that no run has are only summed up.
    """
    kept = None
    if inside is not None:

        def cut(batches):
            pieces = (run[i : i + n] for b in batches for run in b.column(0).to_pylist() for n in range(1, GRAM + 1) for i in range(len(run) - n + 1))
            yield from distinct(pieces, "gram")

        found = inside.transform(mapped, cut, "gram string").distinct().toArrow().column("gram").to_pylist()
        kept = texts.sparkSession.sparkContext.broadcast(frozenset(found))

    def count(batches):
        bare = Memory(lambda word: w if (w := word.strip(EDGE)).isalpha() else "")
        lie, total = kept and kept.value, 0

        def words(texts: list[str]) -> dict[str, int]:
            nonlocal total
            found, _, which = Words([spaced_to(" ", t) for t in texts]).pairs(bare.__getitem__)
            total += len(which)
            n = np.bincount(which, minlength=len(found)).tolist()
            return {w: k for w, k in zip(found.to_pylist(), n) if lie is None or w[:GRAM] in lie and w[-GRAM:] in lie and grams(w) <= lie}

        yield from tally(batches, of=words)
        yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([total], pa.int64())], names=["item", "n"])

    counts = materialize(texts.transform(mapped, count, "item string, n long").groupBy("item").agg(F.sum("n").alias("n")).where("n >= 3 or item = ''"), "words")
    return counts.where("item <> ''"), counts.where("item = ''").agg(F.sum("n")).first()[0] or 0


class LanguageModel:
    """Smoothed log probabilities of a byte after two others."""

    def __init__(self, places: np.ndarray, counts: np.ndarray):
        self.words: dict[str, float] = {}
        self.longest = 0
        table = np.zeros(SYMBOLS**3, np.float32)
        table[places] = counts
        table = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        pair = table.sum(0)
        single = pair.sum(0)
        p1 = (single + 1) / (single.sum() + SYMBOLS)
        p2 = (pair + 5 * p1[None]) / (pair.sum(1, keepdims=True) + 5)
        self.log = np.log((table + 5 * p2[None]) / (table.sum(2, keepdims=True) + 5)).astype(np.float32)

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text") -> "LanguageModel":
        """Trigram counts of every text; each task adds up its own, at most SYMBOLS^3 rows are gathered."""

        def count(batches):
            total = np.zeros(SYMBOLS**3, np.int32)
            for b in batches:
                data, offsets = string_buffers(b.column(0))
                for _, _, part, own in slabs(data, offsets):
                    s = np.insert(BYTE_SYMBOL[part], np.repeat(own, 2), 0)  # no trigram crosses the end of a text
                    three = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                    found, n = np.unique(three[(s[1:-1] > 0) | (s[2:] > 0)], return_counts=True)
                    total[found] += n.astype(np.int32)
            at = np.flatnonzero(total)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["place", "n"])

        rows = docs.select(text).transform(mapped, count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        return cls(rows.column("place").to_numpy(), rows.column("n").to_numpy())

    def know(self, counts: DataFrame, total: int) -> None:
        found = counts.toArrow()
        self.words = dict(zip(found.column("item").to_pylist(), np.log(found.column("n").to_numpy().astype(float) / max(total, 1)).tolist()))
        self.longest = max(map(len, self.words), default=0)

    def learn(self, texts: DataFrame) -> None:
        """Log frequencies of all words in three texts or more, which have to fit in memory."""
        self.know(*word_counts(texts))

    def within(self, texts: DataFrame, asked: DataFrame) -> "LanguageModel":
        """This model with those words of the texts that lie in spaced letters of the asked ones: segment() needs no others."""
        made = copy.copy(self)
        made.words, made.longest = {}, 0
        sent = asked.sparkSession.sparkContext.broadcast(made)

        def joined(batches):
            word = Restorer(sent.value).word
            yield from distinct((word(run.replace(" ", "")) for b in batches for t in b.column(0).to_pylist() for run in spaced(t or "")), "run")

        runs = materialize(asked.transform(mapped, joined, "run string").distinct(), "runs")
        counts, total = word_counts(texts, runs)
        lengths = counts.agg(F.sort_array(F.collect_set(F.length("item")))).first()[0]

        def cut(batches):
            yield from distinct((run[i : i + n] for b in batches for run in b.column(0).to_pylist() for n in lengths for i in range(len(run) - n + 1)), "item")

        made.know(runs.transform(mapped, cut, "item string").distinct().join(counts, "item"), total)
        return made


def restore(word: str, model: LanguageModel) -> str:
    """The best clean spelling of one lower-case word."""
    log = model.log
    runs: list[tuple[str, int]] = []
    for ch in word:
        if runs and runs[-1][0] == ch:
            runs[-1] = ch, runs[-1][1] + 1
        else:
            runs.append((ch, 1))
    # A state's spelling is a chain of (chain before, piece), so that long words cost no copies.
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for k, (ch, n) in enumerate(runs):
        options = [(c, SUBSTITUTE) for c in LOOKS_LIKE.get(ch, "")]
        if ch.isalpha():
            options.append((ch, SAME))
        lengths = [(n, SAME)] if n < 3 else [(1, SHORTEN), (2, SHORTEN)]
        outs = [(c * m, cost + extra * (c == ch or n > 2)) for c, cost in options for m, extra in lengths]
        if ch in SEPARATORS or not options:
            outs.append(("", DROP))
        elif ch == "!" and k == len(runs) - 1:  # or what it says
            outs.append(("", SAME))
        coded = [(piece, BYTE_SYMBOL[list(piece.encode())].tolist(), cost) for piece, cost in outs]
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, made) in best.items():
            for piece, symbols, cost in coded:
                x, y, total = a, b, score + cost
                for s in symbols:
                    total += float(log[x, y, s])
                    x, y = y, s
                if (x, y) not in new or total > new[x, y][0]:
                    new[x, y] = total, (made, piece)
        best = new
    _, made = max(((score + float(log[a, b, 0]), made) for (a, b), (score, made) in best.items()), key=lambda end: end[0])
    pieces = []
    while made:
        made, piece = made
        pieces.append(piece)
    return "".join(reversed(pieces))


def segment(run: str, model: LanguageModel) -> str:
    """The run with spaces where words most likely end: known words by their frequency, others by trigrams."""
    log, n = model.log, len(run)
    symbols = [BYTE_SYMBOL[list(ch.encode())].tolist() for ch in run]

    def spell(before: list[int], s: list[int]) -> float:
        chain = [0, 0, *before][-2:] + s
        return sum(float(log[chain[k], chain[k + 1], chain[k + 2]]) for k in range(len(s)))

    # (score, begin of the last word): of a word ending before a place, of unknown words of one letter or more so far.
    word: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * n
    one, more = (-math.inf, 0), (-math.inf, 0)
    for i in range(n + 1):
        last = symbols[i - 1] if i else []
        two = symbols[i - 2] + last if i > 1 else []
        for (score, begin), before in ((one, last), (more, two)):
            if score > -math.inf:
                word[i] = max(word[i], (score + spell(before, [0]), begin))
        if i == n:
            break
        score = word[i][0]
        for k in range(1, min(model.longest, n - i) + 1):
            p = model.words.get(run[i : i + k])
            if p is not None:
                word[i + k] = max(word[i + k], (score + p, i))
        more = max((one[0] + spell(last, symbols[i]), one[1]), (more[0] + spell(two, symbols[i]), more[1]))
        one = score + UNKNOWN + spell([], symbols[i]), i
    pieces = []
    while n:
        pieces.append(run[word[n][1] : n])
        n = word[n][1]
    return " ".join(reversed(pieces))


class Restorer:
    def __init__(self, model: LanguageModel):
        self.model = model

    def word(self, word: str) -> str:
        bare = word.strip(EDGE)
        if bare.isalpha() and not SUSPICIOUS.search(bare):
            return bare
        inner = word.rstrip(".,;:?\"')]}").lstrip("\"'([{")
        if not any(c.isalpha() or c in LOOKS_LIKE for c in inner) or not SUSPICIOUS.search(inner):
            return bare
        return restore(inner, self.model)

    def unspaced(self, text: str) -> str:
        return spaced_to(lambda m: segment(self.word(m[0].replace(" ", "")), self.model), text)

    def words(self, text: str) -> list[str]:
        return self.unspaced(text).split()

    def text(self, text: str) -> str:
        return " ".join(map(self.word, self.words(text)))


def features(word: str) -> list[str]:
    """See also feature_counts()."""
    return ["=" + word] + [word[:k] for k in BEGINNINGS if len(word) > k] if word else []


class Score:
    """Findings of a text from the chosen features, and its probability. texts: those fitted on."""

    def __init__(self, restorer: Restorer, weights: dict[str, float], coefficients: list[float], texts: DataFrame | None = None):
        self.restorer, self.weights, self.coefficients, self.texts = restorer, weights, np.array(coefficients), texts
        self.known = Memory(self.weight)
        self.begin = Beginnings([f for f in weights if f[0] != "="], [f[1:] for f in weights if f[0] == "="])

    def weight(self, word: str) -> float:
        most, weights = 0.0, self.weights
        for f in features(self.restorer.word(word)):
            if f in weights and weights[f] > most:
                most = weights[f]
        return most

    def numbers(self, text: str) -> list[float]:
        return next(self.all_numbers([text]))

    def all_numbers(self, texts: Iterable[str | None]) -> Iterator[list[float]]:
        for group in groups(texts):
            w = Words([self.restorer.unspaced(t) for t in group])
            at = np.flatnonzero(self.begin.may(w))
            coded = strings(w.data, w.start[at], w.end[at]).dictionary_encode()
            weight = np.array([self.known[word] for word in coded.dictionary.to_pylist()], float)[coded.indices.to_numpy()]
            some = weight != 0
            places, weight = np.searchsorted(at[some], w.bounds).tolist(), weight[some].tolist()
            for size, i, j in zip(np.diff(w.bounds).tolist(), places, places[1:]):
                found, n = weight[i:j], j - i
                yield [1.0, math.log1p(sum(found)), math.log1p(n), float(n > 1), min(1.0, 20 * n / max(size, 20)), max(found, default=0.0)]

    def score(self, text: str) -> float:
        return next(self.scores([text]))

    def scores(self, texts: Iterable[str | None]) -> Iterator[float]:
        for numbers in self.all_numbers(texts):
            yield float(1 / (1 + np.exp(-np.clip(np.dot(self.coefficients, numbers), -35, 35))))


def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient (first row) and curvature of the logistic loss of these rows."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
    return np.vstack([x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x])


def logistic(total: Callable[[np.ndarray], np.ndarray], mean: float, width: int, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Newton's method; total(w): slopes() of all rows."""
    w = np.zeros(width)
    w[0] = math.log((mean + 1e-6) / (1 - mean + 1e-6))
    for _ in range(rounds):
        found = total(w)
        step = np.linalg.solve(found[1:] + ridge * np.eye(width), found[0] + ridge * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def least_g2(tested: int) -> float:
    return min(MOST_G2, max(LEAST_G2, 2 * math.log(max(tested, 2)) - 2))


def choose(counts: dict[str, tuple[int, int]], n_pos: int, n_neg: int, tested: int | None = None) -> dict[str, float]:
    """Features that are significantly more common in toxic texts, with their log odds; tested: how many were looked at."""
    least = least_g2(len(counts) if tested is None else tested)
    chosen = {}
    for f, (a, b) in counts.items():
        if a < 3 or a / n_pos <= 3 * (b + 0.5) / n_neg:
            continue
        rate = (a + b) / (n_pos + n_neg)
        g2 = 2 * (a * math.log(a / (rate * n_pos)) + (b * math.log(b / (rate * n_neg)) if b else 0.0))
        if g2 >= least:
            chosen[f] = math.log((a + 0.5) / n_pos) - math.log((b + 0.5) / n_neg)
    return chosen


def significant(counts: DataFrame, n_pos: int, n_neg: int, tested: int | None = None) -> dict[str, float]:
    """choose() for (f, a, b) rows, of which only those that may pass come to the driver. tested: all with a >= 3, if more than these."""
    counts = materialize(counts.where("a >= 3"), "features")
    g2 = f"2 * (a * ln(a * {n_pos + n_neg}D / ((a + b) * {n_pos}D)) + if(b > 0, b * ln(b * {n_pos + n_neg}D / ((a + b) * {n_neg}D)), 0))"
    near = counts.where(f"a / {n_pos}D > 2.99 * (b + 0.5D) / {n_neg} and {g2} >= {LEAST_G2} - 0.01")
    return choose({r.f: (r.a, r.b) for r in near.collect()}, n_pos, n_neg, counts.count() if tested is None else tested)


def _place(column: str, bits: int) -> F.Column:
    return F.crc32(F.col(column).cast("binary")).bitwiseAND((1 << bits) - 1)


def feature_counts(texts: list[str], restorer: Restorer, clean: Callable[[str], str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """(features, numbers of the texts that have them): features() of all restored words; clean: restorer.word or a memory of it."""
    words, text, which = Words([restorer.unspaced(t) for t in texts]).pairs(clean)
    yield ["=" + w for w in words.to_pylist()], np.bincount(which, minlength=len(words))
    size = pc.utf8_length(words).to_numpy()
    for k in BEGINNINGS:
        longer = size > k
        coded = pc.utf8_slice_codeunits(words.filter(pa.array(longer)), 0, k).dictionary_encode()
        number = np.zeros(len(words), np.int64)
        number[longer] = coded.indices.to_numpy()
        kept = longer[which]
        _, found = once(text[kept], number[which[kept]], len(coded.dictionary))
        yield coded.dictionary.to_pylist(), np.bincount(found, minlength=len(coded.dictionary))


def count_features(rows: DataFrame, model, n_pos: int, n_neg: int) -> tuple[DataFrame, int]:
    """((f, a, b): toxic and other rows with each feature, how many have a >= 3); model: broadcast.

    The test grows as b falls, so features that b = 0 would not let pass are left out; the
    other rows are counted for the rest, and for some more that a bitmap of them lets by.
    """

    def counts(y: int, name: str, kept: tuple | None = None) -> DataFrame:
        table, bits = kept or (None, 0)

        def count(batches):
            r, mask, crc32 = Restorer(model.value), (1 << bits) - 1, zlib.crc32
            marks = table and memoryview(table.value).cast("B")  # bytes of little-endian words

            clean = Memory(r.word).__getitem__

            def chosen(texts: list[str]) -> dict[str, int]:
                made = {f: k for found, n in feature_counts(texts, r, clean) for f, k in zip(found, n.tolist())}
                return made if marks is None else {f: k for f, k in made.items() if marks[(at := crc32(f.encode()) & mask) >> 3] >> (at & 7) & 1}

            yield from tally(batches, of=chosen)

        return rows.where(f"y = {y}").select("text").transform(mapped, count, "f string, n long").groupBy("f").agg(F.sum("n").alias(name))

    toxic = materialize(counts(1, "a").where("a >= 3"), "toxic-features")
    tested = toxic.count()
    able = toxic.where(f"2 * a * ln({n_pos + n_neg}D / {n_pos}D) >= {least_g2(tested)} - 0.01")
    made = bitmap(able.select("f"), _place)
    kept = made and (rows.sparkSession.sparkContext.broadcast(made[0]), made[1])
    other = counts(0, "b", kept)
    return able.join(other, "f", "left").select("f", "a", F.coalesce("b", F.lit(0)).alias("b")), tested


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> Score:
    model = LanguageModel.fit(docs)
    rows = labelled_sample(docs, labels, "toxic", modulus, held_out, rows=None).where("y in (0, 1)").select("text", "y")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        share = n_pos / max(n_pos + n_neg, 1)
        return Score(Restorer(model), {}, [math.log((share + 1e-6) / (1 - share + 1e-6)), 0, 0, 0, 0, 0])
    texts = docs.select("text")
    model = model.within(texts, texts)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    counts, tested = count_features(rows, sent, n_pos, n_neg)
    weights = significant(counts, n_pos, n_neg, tested)

    def numbers(batches):
        s = Score(Restorer(sent.value), weights, [0] * 6)
        for b in batches:
            rows_ = list(s.all_numbers(b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(rows_, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    table = materialize(rows.transform(mapped, numbers, "x array<double>, y int"), "numbers")

    def total(w: np.ndarray) -> np.ndarray:
        def add(batches):
            made = np.zeros((7, 6))
            for b in batches:
                made += slopes(b.column(0).flatten().to_numpy().reshape(-1, 6), b.column(1).to_numpy().astype(float), w)
            yield pa.RecordBatch.from_arrays([pa.array([made.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

        return np.sum(table.transform(mapped, add, "s array<double>").toArrow().column("s").to_pylist(), axis=0).reshape(7, 6)

    return Score(Restorer(model), weights, logistic(total, n_pos / (n_pos + n_neg), 6).tolist(), texts)


def score(docs: DataFrame, fitted: Score, text: str = "text", column: str = "toxicity") -> DataFrame:
    """docs with a score column; a column of that name is replaced."""
    from pyspark.sql import types as T

    model = fitted.restorer.model
    if fitted.weights and not fitted.texts.sameSemantics(docs.select(text)):
        model = model.within(fitted.texts, docs.select(text))
    parts = docs.sparkSession.sparkContext.broadcast((model, fitted.weights, fitted.coefficients.tolist()))
    docs = docs.drop(column)
    schema = T.StructType(docs.schema.fields + [T.StructField(column, T.DoubleType())])

    def run(batches):
        model, weights, coefficients = parts.value
        s = Score(Restorer(model), weights, coefficients)
        for b in batches:
            scores = pa.array(s.scores(b.column(text).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, column])

    return docs.transform(mapped, run, schema)


THRESHOLD = 0.3


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fitted = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, fitted).select("doc_id", (remainder(4) == 2).alias("held_out"), F.col("toxicity").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
