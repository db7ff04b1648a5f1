"""Content-addressed ids and seeded orderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Id prefix of each node type.
PREFIX = {"Document": "doc-", "Chunk": "chk-", "Assertion": "ass-", "Entity": "ent-", "Table": "tbl-", "Image": "img-", "Formula": "fml-"}


def node_id(kind: str, *parts: Column | str) -> Column:
    """Prefix and MD5 of the lower-cased concatenation of the key parts; null parts count as empty."""
    text = F.concat(*(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts))
    return F.concat(F.lit(PREFIX[kind]), F.md5(F.lower(text)))


def hash_order(seed: str | int, *parts: Column | str) -> Column:
    """A pseudo-random sort key that any engine can repeat: md5 of seed and parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_fraction(seed: str | int, *parts: Column | str) -> Column:
    """Uniform in [0, 1) from the first 8 hex digits of the md5."""
    return F.conv(F.substring(hash_order(seed, *parts), 1, 8), 16, 10).cast("double") / float(1 << 32)


def packed(c: Column | str) -> Column:
    """A node id as binary, about half as long: prefix and 16 bytes of MD5. Any other string after a zero byte.

    Equal exactly for equal strings; unpacked() gives the string back.
    """
    c = F.col(c) if isinstance(c, str) else c
    digest = F.unhex(F.substring(c, 5, 33))
    plain = (F.octet_length(c) == 36) & (F.substring(c, 1, 1) >= "a") & (F.substring(c, 4, 1) == "-") & (F.lower(c) == c) & digest.isNotNull()
    short = F.concat(F.substring(c, 1, 3).cast("binary"), digest)
    return F.when(plain, short).otherwise(F.concat(F.lit(bytearray(1)), c.cast("binary")))


def unpacked(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    part = lambda start, n: F.substring(c, start, n)
    short = F.concat(part(1, 3).cast("string"), F.lit("-"), F.lower(F.hex(part(4, 16))))
    return F.when(part(1, 1) == F.lit(bytearray(1)), part(2, 2**31 - 1).cast("string")).otherwise(short)
