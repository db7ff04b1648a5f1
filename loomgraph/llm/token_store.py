"""Token-ID output: raw id payloads in shard files, with a minimal perfect hash index.

A shard file holds, in ascending key order, the ids of its documents (little-endian
unsigned integers, 2 bytes each where every id fits, else 4), then an index: the levels of
a minimal perfect hash over the keys and, in the hash's order, each key's fingerprint,
key, payload offset and length. A reader finds the shard by its key range (the manifest
has one row a shard), the slot by the hash in constant time, and refuses a key whose
fingerprint differs.

Layout: magic, payload, index arrays, JSON footer, footer length (8 bytes), magic.

Defined results: null text counts as empty (its payload is the end id alone); null keys
are dropped; rows that repeat a key keep the least (text) only; an empty table makes a
store without shards; columns other than key and text are not stored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.encode import encoder, resolve
from loomgraph.llm.perfect_hash import PerfectHash, mix
from loomgraph.llm.shared_files import AtomicFile, open_uri
from loomgraph.llm.workers import mapped
from loomgraph.scratch import scratch_path

MAGIC = b"LGTOKEN1"
FINGERPRINT_SEED = 1 << 20
MANIFEST = "shard int, path string, first_key long, last_key long, n_docs long, n_tokens long"


def _write_shard(path: str, shard: int, batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> tuple | None:
    keys, starts, lengths = [], [], []
    tokens = 0
    enc = encoder(vocabulary)
    waiting: deque[int] = deque()

    def texts():
        for b in batches:
            waiting.extend(b.column(0).to_pylist())
            yield from b.column(1).to_pylist()

    rows = ((waiting.popleft(), code) for code in enc.encode_all(texts()))
    width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    end = struct.pack("<I", end_id)
    target, out = f"{path}/shard-{shard:06d}.tok", None
    try:
        for key, code in rows:
            if out is None:
                out = AtomicFile(target).__enter__()
                out.write(MAGIC)
            if keys and key == keys[-1]:
                continue
            code += end
            ids = np.frombuffer(code, "<u4")
            out.write(ids.astype("<u2").tobytes() if width == 2 else code)
            keys.append(key)
            starts.append(tokens)
            lengths.append(len(ids))
            tokens += len(ids)
        if out is None:
            return None
        keys_ = np.array(keys, np.int64)
        hashed = PerfectHash.build(keys_.view(np.uint64))
        slot = hashed.slots(keys_.view(np.uint64))
        order = np.empty(len(keys_), np.int64)
        order[slot] = np.arange(len(keys_))
        arrays = {
            "words": hashed.words, "fingerprints": mix(keys_.view(np.uint64), FINGERPRINT_SEED).astype(np.uint32)[order],
            "keys": keys_[order], "starts": np.array(starts, np.int64)[order], "lengths": np.array(lengths, np.int32)[order],
        }
        footer = {"width": width, "n_docs": len(keys_), "n_tokens": tokens, "sizes": hashed.sizes, "payload": len(MAGIC), "arrays": {}}
        for name, a in arrays.items():
            footer["arrays"][name] = [out.write(a.tobytes()), len(a), a.dtype.str]
        foot = json.dumps(footer).encode()
        out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
    except BaseException as e:
        if out is not None:
            out.__exit__(type(e))
        raise
    out.__exit__(None)
    return shard, target, int(keys_[0]), int(keys_[-1]), len(keys_), tokens


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> list[tuple]:
    """Encodes and writes; returns the manifest, one row a shard in key order.

    Documents are dealt by key range and sorted in each task, so a shard is one task's
    output and keys ascend over the shards. A task streams: it holds one Arrow batch, the
    texts that are encoded together (encode.GROUP_CHARS) and 20 bytes a document.
    """
    vocabulary = resolve(vocabulary)
    rows = (
        docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .where("key is not null").repartitionByRange("key").sortWithinPartitions("key", "text")
    )

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        made = _write_shard(path, shard, batches, vocabulary, end_id)
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in MANIFEST.split(", ")], made))], schema=_schema(MANIFEST))

    return sorted((tuple(r) for r in rows.transform(mapped, write, MANIFEST, keeps="encode").collect()), key=lambda r: r[2])


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


class Shard:
    """One file, opened for keyed access."""

    def __init__(self, path: str):
        fs, where = open_uri(path)
        self.file = fs.open_input_file(where)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no whole token shard")
        n = struct.unpack("<Q", tail[:8])[0]
        self.footer = json.loads(self.file.read_at(n, size - 16 - n))
        self.arrays = {
            k: np.frombuffer(self.file.read_at(count * np.dtype(kind).itemsize, at), kind)
            for k, (at, count, kind) in self.footer["arrays"].items()
        }
        self.hash = PerfectHash(self.footer["sizes"], self.arrays["words"])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where the stored fingerprint or key differs."""
        keys = np.asarray(keys, np.int64)
        slot = self.hash.slots(keys.view(np.uint64))
        safe = np.maximum(slot, 0)
        marks = mix(keys.view(np.uint64), FINGERPRINT_SEED).astype(np.uint32)
        same = (slot >= 0) & (self.arrays["fingerprints"][safe] == marks) if len(self.arrays["keys"]) else np.zeros(len(keys), bool)
        same &= self.arrays["keys"][safe] == keys if len(self.arrays["keys"]) else same
        return np.where(same, slot, -1)

    def ids(self, slot: int) -> np.ndarray:
        width, at = self.footer["width"], self.footer["payload"]
        start, n = int(self.arrays["starts"][slot]), int(self.arrays["lengths"][slot])
        return np.frombuffer(self.file.read_at(n * width, at + start * width), f"<u{width}")

    def close(self) -> None:
        self.file.close()


def get(manifest: list[tuple], key: int) -> np.ndarray | None:
    """Ids of one document, or None: bisects the shards' key ranges, then one hash lookup."""
    firsts = [m[2] for m in manifest]
    i = int(np.searchsorted(firsts, key, side="right")) - 1
    if i < 0 or key > manifest[i][3]:
        return None
    shard = Shard(manifest[i][1])
    try:
        slot = int(shard.find(np.array([key]))[0])
        return None if slot < 0 else shard.ids(slot)
    finally:
        shard.close()


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_store(spark: SparkSession, manifest: list[tuple]) -> DataFrame:
    """Per document, from the files alone: key, ids before it in the whole store, length and crc32.

    Every key is looked up through the hash, as keyed access would.
    """
    base, rows = 0, []
    for m in manifest:
        rows.append((m[1], base))
        base += m[5]
    if not rows:
        return spark.createDataFrame([], READ)
    listed = spark.createDataFrame(rows, "path string, base long").repartition(max(1, min(len(rows), 10_000)))

    def read(batches):
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(path)
                keys = np.sort(shard.arrays["keys"])
                for i in range(0, len(keys), 4096):
                    some = keys[i : i + 4096]
                    slots = shard.find(some)
                    if (slots < 0).any():
                        raise ValueError(f"{path}: the index lost a key")
                    crcs = [zlib.crc32(shard.ids(int(s)).astype("<u4").tobytes()) for s in slots]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(some), pa.array(shard.arrays["starts"][slots] + before),
                        pa.array(shard.arrays["lengths"][slots].astype(np.int64)), pa.array(crcs, pa.int64()),
                    ], schema=_schema(READ))
                shard.close()

    return listed.transform(mapped, read, READ)


def op5_token_store(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_store(spark, write_store(docs, scratch_path(spark, "tokens"), vocabulary, end_id=0))
