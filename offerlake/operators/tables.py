"""Changes to parquet tables, as DataFrames of the table after the change. ``Store.change`` writes them bucket by bucket, ``Store.save`` as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stash, unstash

#: The sources that a new store starts with.
DEFAULT_SOURCES = ["forum_a", "blog", "forum_b", "forum_c", "listings"]


def new_rows(batch: DataFrame, table: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of a batch whose key the table lacks, one for each key (unique constraint)."""
    fresh = batch.join(table.select(*keys), keys, "left_anti")
    if not order:
        return fresh.dropDuplicates(keys)
    rest = [c for c in batch.columns if c not in keys]
    best = fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*batch.columns)


def touched(table: DataFrame, batch: DataFrame, keys: list[str], at: Column, column: str = "last_seen_at") -> DataFrame:
    """The table with ``column`` set to ``at`` where the batch has the key again; nothing else changes."""
    seen = batch.select(*keys).distinct().withColumn("_seen", F.lit(True))
    out = table.join(seen, keys, "left").withColumn(column, F.when(F.col("_seen"), at).otherwise(F.col(column)))
    return out.select(*table.columns)


def upserted(table: DataFrame, batch: DataFrame, keys: list[str], always: list[str], on_insert: list[str]) -> DataFrame:
    """Keys of both: ``always`` from the batch, the rest from the table; new keys take ``on_insert`` too."""
    b = batch.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in [*always, *on_insert]], F.lit(True).alias("_has"))
    out = table.withColumn("_had", F.lit(True)).join(b, keys, "full_outer")
    value = {c: F.when(F.col("_has"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in always} | {c: F.when(F.col("_had"), F.col(c)).otherwise(F.col(f"_n_{c}")) for c in on_insert}
    return out.select(*[value.get(c, F.col(c)).alias(c) for c in table.columns])


def assigned(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Update: columns set where the condition holds."""
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def modified(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """(matched, modified): rows the condition holds for, and those of them that the update changes."""
    hit = F.coalesce(where, F.lit(False))
    same = F.lit(True)
    for c, v in values.items():
        same = same & F.col(c).eqNullSafe(v)
    return table.agg(F.count_if(hit).alias("matched"), F.count_if(hit & ~same).alias("modified"))


def without(table: DataFrame, gone: DataFrame, key: str, parent: str) -> DataFrame:
    """Cascade: rows whose parent is gone go."""
    return table.join(gone.select(F.col(parent).alias(key)).distinct(), key, "left_anti")


def emptied(table: DataFrame) -> DataFrame:
    return table.limit(0)


def seeded(sources: DataFrame, names: list[str], now: Column) -> DataFrame:
    """Insert-if-absent of sources by name."""
    spark = sources.sparkSession
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", F.lit(None).cast("string").alias("base_url"), F.lit(True).alias("enabled"), now.alias("created_at"), now.alias("updated_at"))
    return sources.unionByName(new_rows(rows, sources, ["name"]))


def repeated_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness."""
    return table.groupBy(*keys).count().where("count > 1")


#: Buckets of a keyed table; a store may name another number.
BUCKETS = 64
#: Keys of a batch that are broadcast at most (of 100 bytes: 20 MB); beyond that, a shuffle joins them.
MOST_KEYS = 200_000


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def known_keys(batch: DataFrame, history: DataFrame, keys: list[str], most: int = MOST_KEYS) -> DataFrame:
    """Those of the batch's distinct keys that the history has. A semi join over the history comes first, so no more than the batch's keys are ever
    shuffled, and of the history nothing where those are few enough to be broadcast."""
    own = batch.select(*keys)
    few = own.limit(most + 1).count() <= most
    return history.select(*keys).join(F.broadcast(own) if few else own, keys, "left_semi").distinct()


class Store:
    """Tables under one folder, as parquet partitioned by batch and bucket; or, by ``save``, as snapshots, of which the newest counts.

    The rows of a key are in the bucket of its hash, so what looks for keys reads their buckets only. A numbered batch overwrites its own folder: run
    again, it leaves the rows of the last run alone. ``change`` rewrites the buckets of a keyed table that a change touches (dynamic overwrite).

    ``buckets`` is fixed for a store. Each batch and change writes a file for each bucket that it has rows of: choose it by the size of the whole history (some
    hundred MB a bucket), not by that of a batch.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def _snapshots(self, table: str) -> list[str]:
        at = self._path(f"{self.path}/{table}")
        if not self._fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.getPath().getName().startswith("v"))

    def exists(self, table: str) -> bool:
        return bool(self._snapshots(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}/{self._snapshots(table)[-1]}")

    def save(self, table: str, df: DataFrame) -> None:
        """A failed write leaves the old snapshot in place: the new one gets its name last."""
        number = len(self._snapshots(table))
        own = f"{self.path}/{table}/_{uuid.uuid4().hex}"
        df.write.parquet(own)
        if not self._fs.rename(self._path(own), self._path(f"{self.path}/{table}/v{number:012d}")):
            raise OSError(f"could not publish {table}")

    def _schema(self, table: str, df: DataFrame | None = None) -> str | None:
        """The columns of a keyed table as DDL; a table's first rows set them."""
        at = self._path(f"{self.path}/{table}/_columns")
        if not self._fs.exists(at):
            if df is None:
                return None
            out = self._fs.create(at, True)
            out.write(bytearray(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "utf-8"))
            out.close()
        stream = self._fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, table: str, df: DataFrame, keys: list[str], mode: str, folder: str = "") -> None:
        rows = df.withColumn("_bucket", bucket_of(keys, self.buckets)).hint("rebalance", "_bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("_bucket").parquet(f"{self.path}/{table}{folder}")

    def append(self, table: str, df: DataFrame, batch: int, keys: list[str]) -> None:
        """Add the rows of a numbered batch; run again under its number, a batch takes its own place, whatever its rows were before. ``df`` must not
        read that batch of the table."""
        self._schema(table, df)
        self._write(table, df, keys, "static", f"/_batch={batch}")

    def rows(self, table: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """All batches or those numbered below ``before``, and all buckets or some; None for a table that never had a batch."""
        columns = self._schema(table)
        if columns is None:
            return None
        out = self.spark.read.schema(f"{columns}, _batch int, _bucket int").parquet(f"{self.path}/{table}")
        if before is not None:
            out = out.where(F.col("_batch") < before)
        return (out if buckets is None else out.where(F.col("_bucket").isin(buckets))).drop("_batch", "_bucket")

    def buckets_of(self, rows: DataFrame, keys: list[str]) -> list[int]:
        """The buckets that hold the keys of some rows: no more numbers than there are buckets."""
        return sorted(r[0] for r in rows.select(bucket_of(keys, self.buckets)).distinct().collect())

    def known(self, table: str, batch: DataFrame, keys: list[str], before: int | None = None) -> DataFrame | None:
        """Keys of the batch that the table has, found in the batch's buckets alone."""
        history = self.rows(table, before, self.buckets_of(batch, keys))
        return None if history is None else known_keys(batch, history, keys)

    def create(self, table: str, df: DataFrame, keys: list[str]) -> None:
        """A keyed table that changes in place, bucket by bucket."""
        self._schema(table, df)
        self._write(table, df, keys, "dynamic")

    def state(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        out = self.spark.read.schema(f"{self._schema(table)}, _bucket int").parquet(f"{self.path}/{table}")
        return (out if buckets is None else out.where(F.col("_bucket").isin(buckets))).drop("_bucket")

    def change(self, table: str, keys: list[str], touching: DataFrame | Column, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Rewrite the buckets that hold the keys of ``touching`` (rows with the key columns, or a condition on the table's own rows) by ``change``, one of
        this module's changes; the others' files stay as they are. Rows of a bucket go to the same bucket: keys don't change. The buckets come back.

        The new rows are written down before they replace anything, so a change that fails leaves the table as it was; one that ends while
        partitions are swapped is mended by running it again.
        """
        rows = self.state(table).where(touching) if isinstance(touching, Column) else touching
        hit = self.buckets_of(rows, keys)
        if hit:
            new = stash(change(self.state(table, hit)), f"{table}-change")
            left = self.buckets_of(new, keys)
            if not set(left) <= set(hit):
                raise ValueError("a change gave a row a key of another bucket")
            self._write(table, new, keys, "dynamic")
            for bucket in set(hit) - set(left):
                self._fs.delete(self._path(f"{self.path}/{table}/_bucket={bucket}"), True)
            unstash(new)
        return hit
