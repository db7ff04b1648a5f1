"""Benchmark decontamination with an FM-index per training shard.

Benchmark windows (13 consecutive words; a shorter item is one window) are the phrases.
A shard is a bounded run of a task's documents. Its words become symbols of the
benchmark's vocabulary; a run of such words too short for any window cannot hold an
occurrence and is left out, other words separate. The FM-index over the runs is asked for
all phrases at once by backward search; occurrences come from sampled suffix positions
and are merged into removal spans. Words are compared by hash in the index and by their
bytes wherever a window occurs. Documents are never shuffled.

The benchmark goes to the workers in blocks of at most ``block_bytes`` of text; where it
is larger, documents pass once for each block and the spans add up.

Defined results: null text has no words; null benchmark texts and items without words
have no windows; null item ids are ignored; each input row gives one output row, repeated
ones too; an empty benchmark leaves all clean. Columns named leak_* of the input are
replaced; all others stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.columns import SLAB_BYTES, slabs, string_buffers
from loomgraph.llm.fm_index import FMIndex
from loomgraph.llm.texthash import FOLD, NOT_ALNUM, words
from loomgraph.llm.workers import mapped
from loomgraph.scratch import materialize

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 1 << 21
ADDED = [("leak_words", T.LongType()), ("leak_spans", T.ArrayType(T.LongType())), ("leak_items", T.ArrayType(T.LongType()))]


class Phrases:
    """Windows of benchmark items as places in one array of symbols; made once, then sent.

    About 6 bytes a byte of benchmark text are held.
    """

    def __init__(self, items: list[tuple[int, str]], window: int):
        data, offsets = string_buffers(pa.array([t for _, t in items], pa.large_string()))
        begin, end, row, hashes = words(data, offsets, NOT_ALNUM)
        self.vocabulary, first, symbols = np.unique(hashes, return_index=True, return_inverse=True)
        self.symbols = (symbols + 1).astype(np.int32)
        # the bytes of every known word, against which occurrences are held
        self.ends = np.cumsum((end - begin)[first])
        self.bytes = FOLD[np.frombuffer(b"".join(data[x:y].tobytes() for x, y in zip(begin[first], end[first])), np.uint8)].tobytes()
        counts = np.bincount(row, minlength=len(items))
        lengths = np.minimum(counts, window)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray]] = []
        at = np.cumsum(counts) - counts
        ids = np.array([i for i, _ in items], np.int64)
        for n in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == n)
            many = counts[own] - n + 1
            starts = np.repeat(at[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            self.by_length.append((n, starts.astype(np.int32), np.repeat(ids[own], many)))
        self.shortest = self.by_length[0][0] if self.by_length else 0

    def spelled(self, symbol: int) -> bytes:
        return self.bytes[self.ends[symbol - 2] if symbol > 1 else 0 : self.ends[symbol - 1]]


class Shard:
    """Documents' words as symbols; find() gives hit intervals and items by document."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.where, self.size = phrases, [], [], 0

    def add(self, first_row: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Takes a slab's runs; returns words per row."""
        first, last, row, hashes = words(data, offsets, NOT_ALNUM)
        counts = np.bincount(row, minlength=len(offsets) - 1)
        vocabulary = self.phrases.vocabulary
        if self.phrases.shortest and len(hashes):
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            known = vocabulary[at] == hashes
            # runs of known words within a row
            cut = np.ones(len(known) + 1, bool)
            cut[1:-1] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
            edges = np.flatnonzero(cut)
            begin, end = edges[:-1], edges[1:]
            use = known[begin] & (end - begin >= self.phrases.shortest)
            starts = np.concatenate([[0], np.cumsum(counts)])
            for b, e in zip(begin[use].tolist(), end[use].tolist()):
                raw = FOLD[data[first[b] : last[e - 1]]].tobytes()
                self.where.append((self.size, first_row + int(row[b]), b - int(starts[row[b]]), raw, first[b:e] - first[b], last[b:e] - first[b]))
                self.parts.append((at[b:e] + 1).astype(np.int32))
                self.parts.append(np.zeros(1, np.int32))
                self.size += e - b + 1
        return counts

    def find(self) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        out: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        if not self.parts:
            return out
        index = FMIndex(np.concatenate(self.parts), len(self.phrases.vocabulary) + 1)
        begins = np.array([w[0] for w in self.where])
        for n, starts, items in self.phrases.by_length:
            low, high = index.search(self.phrases.symbols, starts, n)
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            many = high[hit] - low[hit]
            rows = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            phrase = np.repeat(hit, many)
            at = index.locate(rows)
            run = np.searchsorted(begins, at, side="right") - 1
            same: dict[tuple[int, int], bool] = {}
            for p, a, r in zip(phrase.tolist(), at.tolist(), run.tolist()):
                begin, row, word, raw, x, y = self.where[r]
                if (r, a) not in same:  # equal hashes are held against the words' bytes
                    own = self.phrases.symbols[starts[p] : starts[p] + n].tolist()
                    k = a - begin
                    same[r, a] = all(raw[x[k + j] : y[k + j]] == self.phrases.spelled(c) for j, c in enumerate(own))
                if same[r, a]:
                    spans, found = out.setdefault(row, ([], set()))
                    spans.append((word + a - begin, word + a - begin + n))
                    found.add(int(items[p]))
        return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def _annotated(batch: pa.RecordBatch, text: str, phrases: Phrases, schema: pa.Schema) -> pa.RecordBatch:
    data, offsets = string_buffers(batch.column(text))
    n = batch.num_rows
    counts, found = np.zeros(n, np.int64), {}
    shard = Shard(phrases)
    for i, j, part, own in slabs(data, offsets, SLAB_BYTES):
        counts[i:j] = shard.add(i, part, own)
        if shard.size > SHARD_WORDS:
            found |= shard.find()
            shard = Shard(phrases)
    found |= shard.find()
    spans, items = [[] for _ in range(n)], [set() for _ in range(n)]
    names = batch.schema.names
    if "leak_spans" in names:  # from an earlier block
        for k, (s, t) in enumerate(zip(batch.column("leak_spans").to_pylist(), batch.column("leak_items").to_pylist())):
            spans[k], items[k] = list(zip(s[::2], s[1::2])), set(t)
    for k, (s, t) in found.items():
        spans[k] = merge(spans[k] + s)
        items[k] |= t
    added = {
        "leak_words": pa.array(counts), "leak_spans": pa.array([[x for s in own for x in s] for own in spans], pa.list_(pa.int64())),
        "leak_items": pa.array([sorted(t) for t in items], pa.list_(pa.int64())),
    }
    return pa.RecordBatch.from_arrays([added.get(f.name, None) if f.name in added else batch.column(f.name) for f in schema], names=schema.names)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", block_bytes: int = BLOCK_BYTES, remove: bool = False) -> DataFrame:
    """docs with leak_words (words of the text), leak_spans (flat merged word intervals) and leak_items.

    remove: the spans are cut out of the texts, too, in the same pass as the last block.
    """
    docs = docs.drop(*(n for n, _ in ADDED))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    schema = T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t in ADDED])
    names = schema.names
    for k in range(blocks):
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(own, window))

        def annotate(batches, sent=sent, remove=remove and k == blocks - 1):
            for b in batches:
                out = _annotated(b, text, sent.value, pa.schema([(n, pa.null()) for n in names]))
                yield _without_spans(out, text) if remove else out

        docs = docs.transform(mapped, annotate, schema)
        if k < blocks - 1:
            docs = materialize(docs, "leaks")  # one worker a task, however many blocks there are
    return docs


def n_hit() -> F.Column:
    """Words inside removal spans."""
    return F.aggregate(F.col("leak_spans"), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")),
                       lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")), lambda a: a["sum"])


def _without_spans(b: pa.RecordBatch, text: str) -> pa.RecordBatch:
    out = b.column(text).to_pylist()
    for i, s in enumerate(b.column("leak_spans").to_pylist()):
        if s:
            raw = out[i].encode()
            data = np.frombuffer(raw, np.uint8)
            begin, end, _, _ = words(data, np.array([0, len(data)]), NOT_ALNUM, hashed=False)
            parts, at = [], 0
            for x, y in zip(s[::2], s[1::2]):
                parts.append(raw[at : begin[x]])
                at = end[y - 1]
            out[i] = b" ".join([*parts, raw[at:]]).decode()
    return b.set_column(b.schema.get_field_index(text), text, pa.array(out, pa.string()))


def remove_leaks(found: DataFrame, text: str = "text") -> DataFrame:
    """Cuts the removal spans out of the texts; one space stays in place of each."""

    def cut(batches):
        for b in batches:
            yield _without_spans(b, text)

    return found.transform(mapped, cut, found.schema)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_join(F.array_sort(F.transform("leak_items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", F.col("leak_words").alias("n_words"), n_hit().alias("n_hit"), F.size("leak_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


ORACLE_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM low),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE text IS NOT NULL),
il AS (SELECT item_id, w, least(13, len(w)) n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) i FROM il)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM dw, lens)),
hit AS (SELECT doc_id, i, d.n, item_id FROM dwin d JOIN win USING (n, p)),
covered AS (SELECT doc_id, count(DISTINCT k) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) k FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
