"""Places for intermediate tables that every executor and the driver can read.

Everything goes below the folder that the cluster names in ``spark.checkpoint.dir``.
Only where that setting is absent or still Spark's machine-local default, and the master
is local (as in tests), is a folder of our own chosen; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; sets a checkpoint folder where a local session has none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("a cluster has to name a folder that all machines share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; removed by drop() or when the driver ends."""
    path = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    _made.pop(path, None)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns a scan of it.

    Cuts the lineage like checkpoint(), survives lost executors, and lets later scans
    prune columns. A column of NullType is not storable and must be cast first.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Removes tables of materialize() that no plan still to run reads."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path in _made:
            drop_path(t.sparkSession, path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
            elif path.startswith("file:"):  # after spark.stop() local folders still go
                shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)
        except Exception:  # the JVM may be gone: the cluster's own retention applies
            pass
