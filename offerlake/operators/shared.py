"""Tables in the folder that the driver and all executors share. Writing one cuts the lineage: a lost executor costs nothing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; it goes when the application ends in order.

    Where that is unset, a folder of this machine will do for a local session only; on a cluster it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="offerlake-")
        _OWN_DIR[app] = f"{named.rstrip('/')}/offerlake-{app}"
        atexit.register(_end, spark, app)
    return _OWN_DIR[app]


def _end(spark: SparkSession, app: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and context.applicationId == app:
        remove(spark, _OWN_DIR[app])


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def unstash(*tables: DataFrame) -> None:
    """Remove what ``stash`` wrote, once nothing will read it any more."""
    for t in tables:
        remove(t.sparkSession, t.stashed_at)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows dealt over as many tasks as there are cores at least. Spark packs partitions by their bytes, so rows that are few bytes but long work
    would all be one task's; those of a named number stay apart."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
