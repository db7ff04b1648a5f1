"""N-gram Jaccard self-join with token-combination prefixes, and its connected classes.

A document is its set of word shingles (64-bit hashes), ordered: tokens of the rare class
first, by hash, then those of the frequent class. A prefix takes tokens in that order until
the combinations left by any ``tau`` missing tokens cannot be none: rare ones index alone
and count one each; frequent ones fall into subclasses by hash and index as pairs within a
subclass, a subclass of m counting m - 1. tau is the most tokens of a set that a partner
can lack, so two linked sets share an indexed token or pair. The class function changes
cost only, never results.

Without gathering any group on a driver, or a hot one in a task:

1. Documents with equal sets become one representative.
2. Every representative's prefix is indexed with all tokens counted as rare. Entries travel
   as arrays dealt by token; a token that a stretch of entries holds often is sent past
   the deal, with one mark (of size 0) in it. Groups of up to SMALL members give their pairs.
3. Tokens of larger groups, the MOST largest of them, become the frequent class, and only
   documents with such a token are indexed again: two linked sets whose first common token
   has a small group have met already, else both are here. After ROUNDS of this, larger
   groups give a star: every member with the member of fewest rare tokens.
4. Sizes and parity maps (a lower bound of the sets' difference) rule out most pairs; the
   others are verified on the whole texts, with two independent hashes of every word.
5. Large groups that the links so far leave in several components are dealt out in blocks
   of members outside the star's component against all members, with the same bounds as
   arrays: first a spanning forest of each pair of blocks is verified, then, of what it
   leaves apart, every pair that the bounds allow.
6. Links give components; copies follow their representative.

Defined results: null text has no shingles, and an empty set links with nothing; a text of
fewer words than the width is one shingle; null keys are dropped; repeated rows each give
a row and share a component if their sets are equal; an empty table gives no rows; other
columns are not read. Thresholds from 0.6 up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.columns import slabs, string_buffers
from loomgraph.llm.idfilter import bitmap, holds, keep_listed, place
from loomgraph.llm.perfect_hash import mix
from loomgraph.llm.texthash import SPACE, chain, shingle_rows, words
from loomgraph.llm.workers import mapped
from loomgraph.operators.components import connected_components
from loomgraph.scratch import drop, materialize

SMALL = 8
ROUNDS = 3
BLOCK = 1024
VERIFY_BYTES = 4 << 20
SHARED_CALL = 2_000
#: Entries that a task deals out at a time, and that a task of the other side takes.
DEALT, TAKEN = 1 << 18, 1 << 19
#: Tokens of the frequent class, 8 bytes each, that are sent to the workers.
MOST = 1 << 20
#: A pair's entry has this bit, a single token's has not: it is the token without its last bit.
PAIR = np.uint64(1 << 63)


def single(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint64(1)


class Prefix:
    def __init__(self, frequent: np.ndarray, num: int, den: int):
        """frequent: sorted entries of the tokens of the frequent class."""
        if 10 * num < 6 * den or num >= den:
            raise ValueError("the threshold is to be from 0.6 to below 1")
        self.frequent, self.num, self.den = frequent, num, den

    def _subclasses(self, level: int) -> int:
        return max(1, (self.den - self.num) * (1 << level) // self.den // 2)

    def entries(self, u: np.ndarray) -> tuple[np.ndarray, int]:
        """(index entries, number of rare tokens) of a sorted set."""
        n, num, den = len(u), self.num, self.den
        tokens = single(u)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
            often = self.frequent[at] == tokens
        else:
            often = np.zeros(n, bool)
        rare = tokens[~often]
        if n * (den - num) < num:  # no other set can be near enough
            return np.zeros(0, np.uint64), len(rare)
        need = (den - num) * n // den + 1
        if len(rare) >= need:
            return rare[:need], len(rare)
        common, need = u[often], need - len(rare)
        found = [rare]
        for level in {(-(-num * n // den)).bit_length() - 1, n.bit_length() - 1}:  # its own, and that of smaller partners
            sub = (mix(common, 11) % np.uint64(self._subclasses(level))).astype(np.int64)
            first = np.zeros(len(sub), bool)
            first[np.unique(sub, return_index=True)[1]] = True
            left = np.arange(1, len(sub) + 1) - np.cumsum(first)
            # never beyond the set: at 0.6 or more the subclasses and tau + 1 together are at most n
            m = min(int(np.searchsorted(left, need)) + 1, len(common))
            order = np.argsort(sub[:m], kind="stable")
            s, t = sub[order], common[order]
            for step in range(1, m):
                same = s[:-step] == s[step:]
                if not same.any():
                    break
                a, b = t[:-step][same], t[step:][same]
                found.append(mix(mix(np.minimum(a, b), 20) ^ (np.maximum(a, b) + np.uint64(level)), 21) | PAIR)
        return np.concatenate(found), len(rare)


#: Fewest bits of the parity map of a set: bit b is the parity of the number of its shingles
#: whose hash ends with b. Maps of two sets differ in no more bits than the sets differ in
#: shingles. A map has more bits than its set has shingles, so it never fills up; the halves
#: of a larger map xor to the smaller one.
PARITY_BITS = 10
def digest_of(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def parity(u: np.ndarray) -> bytes:
    bits = 1 << max(PARITY_BITS, len(u).bit_length())
    at = (u & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """Maps of at least ``size`` bytes as rows of 64-bit words, each folded to that size."""
    out = np.empty((len(maps), size // 8), np.uint64)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, np.uint64)
        while len(x) * 8 > size:
            half = len(x) // 2
            x = x[:half] ^ x[half:]
        out[i] = x
    return out


def map_difference(x: bytes, y: bytes) -> int:
    a, b = (x, y) if len(x) <= len(y) else (y, x)
    if len(a) != len(b):
        b = folded([b], len(a)).tobytes()
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


SETS = "doc_id long, n long, digest binary, parity binary, entries binary"
INDEXED = "doc_id long, n long, rare long, entries binary, digest binary"


def indexed_sets(texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Per document (doc_id, text in): size, digest and parity map of the set, entries with all tokens rare."""

    def index(batches):
        prefix = Prefix(np.zeros(0, np.uint64), num, den)
        for b in batches:
            data, offsets = string_buffers(b.column(1))
            for i, j, part, own in slabs(data, offsets):
                _, _, row, h = words(part, own, SPACE)
                made = [
                    (len(u), digest_of(u), parity(u), prefix.entries(u)[0].tobytes())
                    for u in shingle_rows(h, row, j - i, width)
                ]
                n, digest, odd, entries = zip(*made)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(odd, pa.binary()), pa.array(entries, pa.binary()),
                ], names=[c.split()[0] for c in SETS.split(", ")])

    return texts.transform(mapped, index, SETS)


def indexed_again(texts: DataFrame, wanted: DataFrame, frequent: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, rare, entries, digest) of the wanted documents (id, own: its set's digest) under a frequent class."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)
    made = bitmap(wanted.select("id"))
    listed = texts.sparkSession.sparkContext.broadcast(made[0]) if made else None
    rows = texts.select("doc_id", "text", place("doc_id", made[1]) if made else F.lit(0).cast("long"))

    def index(batches):
        prefix = Prefix(sent.value, num, den)
        for b in batches:
            if listed is not None:
                b = b.filter(pa.array(holds(listed.value, b.column(2).to_numpy())))
            data, offsets = string_buffers(b.column(1))
            for i, j, part, own in slabs(data, offsets):
                _, _, row, h = words(part, own, SPACE)
                n, rare, entries, digest = [], [], [], []
                for u in shingle_rows(h, row, j - i, width):
                    sig, few = prefix.entries(u)
                    n.append(len(u))
                    rare.append(few)
                    entries.append(sig.tobytes())
                    digest.append(digest_of(u))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(rare, pa.int64()), pa.array(entries, pa.binary()), pa.array(digest, pa.binary())],
                    names=[c.split()[0] for c in INDEXED.split(", ")],
                )

    found = rows.transform(mapped, index, INDEXED)
    return found.where("octet_length(entries) > 0").join(wanted, (found.doc_id == wanted.id) & (found.digest == wanted.own), "left_semi")


#: What a task of the dealt entries finds: pairs (a, b) of small groups, or entries (token, document) of large ones.
PAIRS, LARGE = 0, 1


def _runs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of equal neighbours, and their lengths."""
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(sig)))


def _cuts(values: np.ndarray, raw: np.ndarray) -> list[bytes]:
    data, at = raw.tobytes(), (np.append(values, len(raw)) * raw.itemsize).tolist()
    return [data[x:y] for x, y in zip(at[:-1], at[1:])]


def meetings(indexed: DataFrame, total: int, num: int, den: int) -> DataFrame:
    """(kind, x, y) of about ``total`` index entries: PAIRS of small groups that sizes allow, and LARGE groups' entries."""
    parts = max(8, -(-total // TAKEN))
    places = np.uint64(8 * parts)

    def deal(batches):
        docs, sizes, sigs, held = [], [], [], 0

        def settle():
            sig = np.frombuffer(b"".join(sigs), np.uint64)
            many = np.fromiter(map(len, sigs), np.int64, len(sigs)) // 8
            doc, n = np.repeat(np.concatenate(docs), many), np.repeat(np.concatenate(sizes), many)
            order = np.argsort(sig, kind="stable")
            sig, doc, n = sig[order], doc[order], n[order]
            begin, length = _runs(sig)
            hot = np.repeat(length > SMALL, length)
            if hot.any():
                marks = sig[begin[length > SMALL]]
                for k in range(0, int(hot.sum()), 1 << 15):
                    own = slice(k, k + (1 << 15))
                    s, d = sig[hot][own], doc[hot][own]
                    yield [int(mix(s[:1] ^ d[:1].view(np.uint64), 31)[0] % places)], [True], [s.tobytes()], [d.tobytes()], [b""]
                sig = np.concatenate([sig[~hot], marks])
                doc = np.concatenate([doc[~hot], np.zeros(len(marks), np.int64)])
                n = np.concatenate([n[~hot], np.zeros(len(marks), np.int32)])
            to = (mix(sig, 30) % places).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to, sig, doc, n = to[order], sig[order], doc[order], n[order]
            begin, _ = _runs(to)
            yield to[begin].tolist(), [False] * len(begin), _cuts(begin, sig), _cuts(begin, doc), _cuts(begin, n)

        def rows():
            for p, hot, s, d, n in settle():
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(hot), *(pa.array(c, pa.binary()) for c in (s, d, n))], names=["place", "hot", "sig", "doc", "n"])

        for b in batches:
            doc, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int32)
            for i, e in enumerate(b.column(2)):
                sigs.append(e.as_buffer())
                docs.append(doc[i : i + 1])
                sizes.append(n[i : i + 1])
                held += len(sigs[-1]) // 8
                if held >= DEALT:
                    yield from rows()
                    docs, sizes, sigs, held = [], [], [], 0
        if held:
            yield from rows()

    def take(batches):
        sigs, docs, sizes = [], [], []

        def out(kind, x, y):
            for k in range(0, len(x), 50_000):
                left, right = x[k : k + 50_000].view(np.int64), y[k : k + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), kind, np.int32)), pa.array(left), pa.array(right)], names=["kind", "x", "y"])

        for b in batches:
            for hot, s, d, n in zip(b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4)):
                s, d = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(d.as_buffer(), np.int64)
                if hot:
                    yield from out(LARGE, s, d)
                else:
                    sigs.append(s.copy())
                    docs.append(d.copy())
                    sizes.append(np.frombuffer(n.as_buffer(), np.int32).copy())
        if not sigs:
            return
        sig, doc, n = np.concatenate(sigs), np.concatenate(docs), np.concatenate(sizes)
        del sigs, docs, sizes
        order = np.argsort(sig, kind="stable")
        sig, doc, n = sig[order], doc[order], n[order].astype(np.int64)
        begin, length = _runs(sig)
        big = np.logical_or.reduceat(n == 0, begin) | (length > SMALL)
        if big.any():
            at = np.repeat(big, length) & (n > 0)
            yield from out(LARGE, sig[at], doc[at])
        few = np.repeat(~big & (length > 1), length)
        sig, doc, n = sig[few], doc[few], n[few]
        found = []
        for step in range(1, SMALL):
            a, b = slice(None, -step), slice(step, None)
            ok = (sig[a] == sig[b]) & (np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num) & (doc[a] != doc[b])
            found.append(np.stack([np.minimum(doc[a][ok], doc[b][ok]), np.maximum(doc[a][ok], doc[b][ok])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield from out(PAIRS, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    dealt = indexed.select("doc_id", "n", "entries").transform(mapped, deal, "place int, hot boolean, sig binary, doc binary, n binary")
    return dealt.repartition(parts, "place").transform(mapped, take, "kind int, x long, y long")


def sets_of(texts: list[str], width: int, seed: int = 3) -> list[np.ndarray]:
    data, offsets = string_buffers(pa.array(texts, pa.large_string()))
    out: list[np.ndarray] = []
    for i, j, part, own in slabs(data, offsets):
        _, _, row, h = words(part, own, SPACE, seed=seed)
        out += shingle_rows(h, row, j - i, width)
    return out


def linked(inter, size_a, size_b, num: int, den: int):
    return den * inter >= num * (size_a + size_b - inter)


def possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that sizes and parity maps do not rule out: near sets differ in (n + m)(den - num) / (den + num) shingles at most."""
    own = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}"))
    joined = pairs.join(own("a"), "a").join(own("b"), "b").where(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}")

    def keep(batches):
        for b in batches:
            if b.num_rows:
                n = b.column(2).to_numpy() + b.column(3).to_numpy()
                differ = np.fromiter(map(map_difference, b.column(4).to_pylist(), b.column(5).to_pylist()), np.int64, b.num_rows)
                yield b.select(["a", "b"]).filter(pa.array(differ * (den + num) <= n * (den - num)))

    return joined.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").transform(mapped, keep, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose whole texts are near enough."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def verify(batches):
        for b in batches:
            size = np.cumsum(pc.add(pc.binary_length(b.column(2)), pc.binary_length(b.column(3))).to_numpy())
            cuts = np.flatnonzero(np.diff(size // VERIFY_BYTES)) + 1
            for k, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                c = b.slice(k, stop - k)
                ids_a, ids_b, ta, tb = (c.column(i).to_pylist() for i in range(4))
                distinct = {t: i for i, t in enumerate(dict.fromkeys(ta + tb))}
                ok = np.ones(len(ids_a), bool)
                for seed in (3, 4):
                    sets = sets_of(list(distinct), width, seed)
                    for i in np.flatnonzero(ok).tolist():
                        x, y = sets[distinct[ta[i]]], sets[distinct[tb[i]]]
                        ok[i] = linked(min(len(x), len(y)), len(x), len(y), num, den) and linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), num, den)
                keep = np.flatnonzero(ok).tolist()
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array([ids_a[i] for i in keep], pa.int64()), pa.array([ids_b[i] for i in keep], pa.int64())], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.transform(mapped, verify, "a long, b long")


def _texts(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whole texts of the documents in pairs."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    out = materialize(keep_listed(rows, "doc_id", wanted).join(wanted, F.col("doc_id") == F.col("id"), "left_semi"), "texts")
    drop(wanted)
    return out


def spanning(x: np.ndarray, y: np.ndarray, score: np.ndarray) -> list[int]:
    """Of edges between components x and y a spanning forest, those of least score first."""
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.get(k, k) != k:
            parent[k] = parent.get(parent[k], parent[k])
            k = parent[k]
        return k

    kept = []
    x, y = x.tolist(), y.tolist()
    for e in np.argsort(score, kind="stable").tolist():
        a, b = root(x[e]), root(y[e])
        if a != b:
            parent[a] = b
            kept.append(e)
    return kept


def block_candidates(table: pa.Table, num: int, den: int, forest: bool) -> pa.Table:
    """Pairs of a block pair, outside members (side 0) with all (side 1), of different components that
    sizes and parity maps allow; with forest only a spanning forest of the components, nearest pairs first."""
    side, doc, comp, n, rare = (table.column(c).to_numpy() for c in ("side", "doc_id", "comp", "n", "rare"))
    maps = table.column("parity").to_pylist()
    held = np.array([len(m) for m in maps])
    paired = table.column("pair").to_numpy(zero_copy_only=False)
    out, rest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    differ = np.zeros((len(out), len(rest)), np.int64)
    lower = np.minimum(held[out][:, None], held[rest][None, :])
    for size in np.unique(lower).tolist():
        p, q = np.flatnonzero(held[out] >= size), np.flatnonzero(held[rest] >= size)
        x, y = folded([maps[k] for k in out[p]], size), folded([maps[k] for k in rest[q]], size)
        own = np.zeros((len(p), len(q)), np.int64)
        for w in range(size // 8):
            own += np.bitwise_count(x[:, w][:, None] ^ y[:, w][None, :])
        at = np.ix_(p, q)
        differ[at] = np.where(lower[at] == size, own, differ[at])
    both = n[out][:, None] + n[rest][None, :]
    common = np.minimum((n - rare)[out][:, None], (n - rare)[rest][None, :])
    ok = (differ * (den + num) <= both * (den - num)) & (comp[out][:, None] != comp[rest][None, :])
    ok &= np.minimum(n[out][:, None], n[rest][None, :]) * den >= np.maximum(n[out][:, None], n[rest][None, :]) * num
    ok &= ~paired[out][:, None] | (common * (num + den) >= both * num)
    i, j = np.nonzero(ok)
    if forest and len(i):
        kept = spanning(comp[out[i]], comp[rest[j]], differ[i, j] / both[i, j])
        i, j = i[kept], j[kept]
    x, y = doc[out[i]], doc[rest[j]]
    return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})


def _across_blocks(groups: DataFrame, comps: DataFrame, sets: DataFrame, num: int, den: int, forest: bool) -> DataFrame | None:
    """Further candidates in large groups whose members are in several components so far.

    A pair of blocks is one call of at most 2 * BLOCK members; small groups share calls.
    """
    own = groups.join(comps, groups.doc_id == comps.id, "left").select(groups["*"], F.coalesce("component", "doc_id").alias("comp"))
    own = materialize(own, "grouped")
    open_ = own.groupBy("sig").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by("comp", F.struct("rare", "doc_id")).alias("star"), F.min("n").alias("least_n"),
    ).where("low <> high").select("sig", "star", "least_n")
    own = own.join(materialize(open_, "open"), "sig")
    # sizes alone leave a member without any partner of its group
    partner = f"greatest(least_n, ceil(n * {num} / {den}))"
    own = materialize(own.where(f"NOT pair OR (n - rare) * {num + den} >= (n + {partner}) * {num}"), "open-groups")
    sizes = own.groupBy("sig").agg(F.count("*").alias("g"), F.sum(F.expr("int(comp <> star)")).alias("u")).where("u > 0")
    sizes = materialize(sizes.select("sig", "g", F.ceil(F.col("g") / BLOCK).alias("nj"), F.ceil(F.col("u") / BLOCK).alias("ni")), "open-sizes")
    total = sizes.agg(F.sum("g")).first()[0]
    if not total:
        return None
    own = own.join(sizes.drop("g"), "sig").join(sets.select("doc_id", "parity"), "doc_id").withColumn("h", F.xxhash64("doc_id"))
    kept = ["sig", "doc_id", "comp", "n", "rare", "pair", "parity", "ni", "nj"]
    steps = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    outside = own.where("comp <> star").select(*kept, F.lit(0).alias("side"), F.pmod("h", "ni").alias("i"), steps("nj").alias("j"))
    every = own.select(*kept, F.lit(1).alias("side"), steps("ni").alias("i"), F.pmod("h", "nj").alias("j"))
    calls = max(1, -(-total // SHARED_CALL))
    shared = F.pmod(F.xxhash64("sig"), F.lit(calls))
    rows = outside.unionByName(every).withColumn("call", F.when(F.col("ni") * F.col("nj") == 1, shared).otherwise(F.xxhash64("sig", "i", "j")))
    rows = rows.drop("ni", "nj")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sig", "ascending"), ("i", "ascending"), ("j", "ascending")])
        key = np.stack([table.column(c).to_numpy() for c in ("sig", "i", "j")])
        cuts = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()
        parts = [block_candidates(table.slice(x, y - x), num, den, forest) for x, y in zip([0, *cuts], [*cuts, table.num_rows])]
        return pa.concat_tables(parts)

    return rows.groupBy("call").applyInArrow(run, "a long, b long").distinct()


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows whose (doc_id, digest) is not in others (other, own); only rows that a bitmap cannot tell apart are shuffled."""
    test = (F.col("doc_id") == F.col("other")) & (F.col("digest") == F.col("own"))
    made = bitmap(others.select("other"))
    if made is None:
        return rows.join(others, test, "left_anti")
    sent = rows.sparkSession.sparkContext.broadcast(made[0])
    names = rows.columns

    def outside(batches):
        for b in batches:
            out = b.filter(pa.array(~holds(sent.value, b.column(len(names)).to_numpy())))
            if out.num_rows:
                yield pa.RecordBatch.from_arrays(out.columns[: len(names)], names=names)

    apart = rows.withColumn("idfilter_place", place("doc_id", made[1])).transform(mapped, outside, rows.schema)
    return apart.unionByName(keep_listed(rows, "doc_id", others.select("other")).join(others, test, "left_anti"))


def similarity_classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
    sets = materialize(indexed_sets(rows, width, num, den), "sets")
    several = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("representative"), F.count("*").alias("copies"))
    several = materialize(several.where("copies > 1").drop("copies"), "several")  # a set held once is its own representative
    members = sets.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(several, "digest", "left")
    members = materialize(members.withColumn("representative", F.coalesce("representative", "doc_id")), "members")
    others = materialize(members.where("doc_id <> representative").select(F.col("doc_id").alias("other"), F.col("digest").alias("own")).distinct(), "others")
    # each of these tables is made by one Python function at most, so that a task has one worker
    indexed = materialize(_without(sets.select("doc_id", "n", F.col("n").alias("rare"), "entries", "digest").where("octet_length(entries) > 0"), others), "indexed")
    met, frequent = [], np.zeros(0, np.uint64)
    for turn in range(ROUNDS):
        total = indexed.agg(F.coalesce(F.sum(F.octet_length("entries")), F.lit(0))).first()[0] // 8
        met.append(materialize(meetings(indexed, total, num, den), "met"))
        large = met[-1].where(f"kind = {LARGE}").select(F.col("x").alias("sig"), F.col("y").alias("doc_id"))
        if turn == ROUNDS - 1:
            break
        counts = large.where("sig >= 0").groupBy("sig").agg(F.count("*").alias("members"))
        found = counts.orderBy(F.desc("members"), "sig").limit(MOST - len(frequent)).select("sig").toArrow()
        if not found.num_rows:
            break
        frequent = np.union1d(frequent, found.column("sig").to_numpy().view(np.uint64))
        members_of = large.select(F.col("doc_id").alias("id")).distinct()
        wanted = materialize(members_of.join(indexed.select(F.col("doc_id").alias("id"), F.col("digest").alias("own")), "id").distinct(), "wanted")
        again = materialize(indexed_again(rows, wanted, frequent, width, num, den), "indexed")
        drop(wanted, indexed)
        indexed = again
    pairs = met[0].where(f"kind = {PAIRS}").select("x", "y")
    for m in met[1:]:
        pairs = pairs.unionByName(m.where(f"kind = {PAIRS}").select("x", "y"))
    pairs = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))
    large = large.join(indexed.select("doc_id", "n", "rare"), "doc_id").withColumn("pair", F.col("sig") < 0)
    large = materialize(large.select("sig", "doc_id", "n", "rare", "pair"), "large")
    leads = large.groupBy("sig").agg(F.min_by("doc_id", F.struct("rare", "doc_id")).alias("star"))
    stars = large.join(leads, "sig").where("doc_id <> star").select(F.least("star", "doc_id").alias("a"), F.greatest("star", "doc_id").alias("b"))
    maps = sets.select("doc_id", "n", "parity")
    candidates = materialize(possible(pairs.unionByName(stars).distinct(), maps, num, den), "candidates")
    drop(*met, indexed, several, others)
    texts = _texts(rows, candidates)
    links = materialize(verified(candidates, texts, width, num, den), "links")
    drop(candidates, texts)
    comps = materialize(connected_components(links), "components")
    for forest in (True, False):  # what the forests join needs no pairs; the rest gets all that the bounds allow
        more = _across_blocks(large, comps, maps, num, den, forest)
        candidates = materialize(more, "candidates") if more is not None else None
        if candidates is None or candidates.isEmpty():
            break
        texts = _texts(rows, candidates)
        further = materialize(verified(candidates, texts, width, num, den), "links")
        drop(candidates, texts)
        joined = materialize(links.unionByName(further), "links")
        drop(links, further)
        links = joined
        comps = materialize(connected_components(links), "components")
    drop(large, sets, links)
    out = members.join(comps, members.representative == comps.id, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "representative").alias("component_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, num=90, den=100)


ORACLE_SQL = r"""
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END s
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) i FROM low WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) n FROM sh GROUP BY doc_id),
near AS (SELECT a.doc_id a, b.doc_id b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id c FROM documents UNION SELECT reach.doc_id, near.b FROM reach JOIN near ON reach.c = near.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) n_shingles, min(c) component_id FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id, n
"""
