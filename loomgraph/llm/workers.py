"""Memory of Python workers.

Workers serve task after task and stage after stage, so what one operator holds would add
to what the next one needs. mapped() is mapInArrow with three habits: Arrow batches of at
most RECORDS rows (set on the session, if it has Spark's default of 10,000, since long
texts make those large); memories of other operators are forgotten when a task begins;
freed memory goes back to the system when it ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTING, DEFAULT, RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"
_memories: dict[str, Callable[[], None]] = {}


def remembers(name: str, forget: Callable[[], None]) -> None:
    """A module that keeps memories between tasks says how to forget them."""
    _memories[name] = forget


def keep_only(name: str) -> None:
    for other, forget in _memories.items():
        if other != name:
            forget()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(SETTING, DEFAULT) == DEFAULT:
        spark.conf.set(SETTING, RECORDS)


def mapped(rows: DataFrame, run, schema, keeps: str = "") -> DataFrame:
    """rows.mapInArrow(run, schema) with bounded workers; ``keeps`` names the memories that run itself uses."""
    small_batches(rows.sparkSession)

    def bounded(batches):
        keep_only(keeps)
        yield from run(batches)
        give_back()

    return rows.mapInArrow(bounded, schema)
