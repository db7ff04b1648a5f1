"""Token counts by a count-only unigram Viterbi.

An Aho-Corasick automaton over the vocabulary names, for every position, all pieces that
end there. Dynamic programming carries two numbers a position: the best score and the
pieces on its path; no segmentation is built. Ties go as in the tokenizers library's
Unigram model: of equal scores, the piece that begins first (the longest) wins, and a
single unknown character costs the least score less 10. Unknown characters count their
UTF-8 bytes where the vocabulary has byte pieces, else a run of them counts once.

Text is prefixed with the space mark and its spaces become marks. As no piece holds a mark
after another character, each "mark run + word" is independent of the others; its count is
remembered (at most ROOM chunks). Vocabularies where that does not hold run whole texts.

Defined results: null and empty text count 0 pieces; null keys are kept (their row counts
as any other); repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.encode import resolve
from loomgraph.llm.workers import mapped, remembers

MARK = "▁"
UNKNOWN_PENALTY = 10.0
ROOM = 400_000
BYTE = re.compile(r"<0x[0-9A-F]{2}>$")
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model; control, unknown and unused pieces match nothing."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], room: int = ROOM):
        import ahocorasick

        self.byte_pieces = sum(bool(BYTE.match(p)) for p, _ in vocabulary) == 256
        matched = [(p, s) for p, s in vocabulary if not (self.byte_pieces and BYTE.match(p))]
        self.automaton = ahocorasick.Automaton()
        for piece, score in matched:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in matched), default=1)
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.by_chunk = not any(MARK in p.lstrip(MARK) for p, _ in matched) and any(p == MARK for p, _ in matched)
        self.room, self.known = room, {}

    def viterbi(self, text: str) -> int:
        """Pieces on the best path; of scores and counts only those of the last ``longest`` places are held."""
        size = self.longest + 1
        score, count, fused = [0.0] * size, [0] * size, [False] * size
        matches = self.automaton.iter(text)
        at, (length, s) = next(matches, (-1, (0, 0.0)))
        for place, char in enumerate(text):
            now = (place + 1) % size
            best, pieces, open_, single = None, 0, False, False
            while at == place:  # longest first: a later one must be better to win
                before = (place + 1 - length) % size
                total = score[before] + s
                if best is None or total > best:
                    best, pieces = total, count[before] + 1
                single |= length == 1
                at, (length, s) = next(matches, (-1, (0, 0.0)))
            if not single:
                before = place % size
                total = score[before] + self.unknown
                if best is None or total > best:
                    more = len(char.encode("utf-8", "replace")) if self.byte_pieces else int(not fused[before])
                    best, pieces, open_ = total, count[before] + more, True
            score[now], count[now], fused[now] = best, pieces, open_
        return count[len(text) % size]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.by_chunk:
            return self.viterbi(text)
        total, known = 0, self.known
        for chunk in CHUNK(text):
            n = known.get(chunk)
            if n is None:
                n = self.viterbi(chunk)
                if len(chunk) <= 64:
                    if len(known) >= self.room:
                        known.clear()
                    known[chunk] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_vocabulary(path))


remembers("token_count", counter.cache_clear)


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars (code points), n_tokens (pieces)."""
    vocabulary = resolve(vocabulary)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches):
        c = counter(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(c.count, texts), pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    return rows.transform(mapped, count, "doc_id long, n_chars long, n_tokens long", keeps="token_count")


def op10_token_count(spark: SparkSession, sf_dir: str, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary)
