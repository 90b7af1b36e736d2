"""Threads as a stream: each micro-batch is checked against the whole history, which is append-only tables and not stream state.

Nothing that was written is written again. ``posts`` gets the new posts of a batch, ``owners`` the fingerprints that a batch was
first to show, ``seen`` a stamp for each key of a batch; the last stamp of a key is an aggregate (``last_seen``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import spread_join
from ..operators.shared import stash, unstash
from ..operators.tables import Store, new_rows


def fresh(batch: DataFrame, store: Store, table: str, keys: list[str], order: list[str], number: int | None = None) -> DataFrame:
    """Rows of the batch whose key the table lacks (in batches before ``number``), one for each key. The batch is read first: of the history only the
    key columns of its buckets are read, and a semi join leaves of those what the batch has too, before anything is shuffled."""
    own = stash(batch.select(*keys).distinct(), "batch-keys")
    known = store.known(table, own, keys, number)
    return new_rows(batch, batch.limit(0) if known is None else stash(known, "known-keys"), keys, [F.col(c) for c in order])


def flagged(posts: DataFrame, prints: DataFrame, owners: Callable[[DataFrame], DataFrame | None], keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``posts`` with is_duplicate, and the fingerprints that are new. ``prints``: keys, the columns of ``order`` and fingerprint.

    A post is a duplicate where the history owns a fingerprint of it, or an earlier post of the batch. ``owners`` says which of some fingerprints the
    history has. A fingerprint that many posts share is joined with its owner over several tasks; nulls are left out before any shuffle.
    """
    rank = F.struct(*dict.fromkeys([*order, *keys]))
    prints = prints.where("fingerprint is not null").withColumn("_rank", rank)
    first = stash(prints.groupBy("fingerprint").agg(F.min("_rank").alias("_first"), F.count("*").alias("_posts")), "batch-prints")
    old = owners(first.select("fingerprint"))
    first = first.withColumn("_old", F.lit(False)) if old is None else first.join(old.withColumn("_old", F.lit(True)), "fingerprint", "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
    hit = spread_join(prints, first, ["fingerprint"], "_posts", keys).where(F.col("_old") | (F.col("_first") < F.col("_rank"))).select(*keys).distinct().withColumn("is_duplicate", F.lit(True))
    out = posts.join(hit, keys, "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
    return out, first.where("not _old").select("fingerprint")


def ingest_batch(store: Store, batch: DataFrame, keys: list[str], number: int, *, at: str = "ts", order: list[str] | None = None, fingerprint: str = "fingerprint", table: str = "posts") -> None:
    """New keys are appended, with a duplicate flag against history and batch; every key gets a stamp. A batch that is run again
    under its number is checked against those before it and takes its own place."""
    order = order or [at, *keys]
    new = stash(fresh(batch, store, table, keys, order, number), "fresh")
    prints = new.select(*dict.fromkeys([*keys, *order]), F.col(fingerprint).alias("fingerprint"))
    rows, owners = flagged(new, prints, lambda f: store.known(f"{table}-owners", f, ["fingerprint"], number), keys, order)
    store.append(table, rows, number, keys)
    store.append(f"{table}-owners", owners, number, ["fingerprint"])
    store.append(f"{table}-seen", batch.groupBy(*keys).agg(F.max(at).alias("seen_at")), number, keys)
    unstash(new)


def last_seen(store: Store, keys: list[str], table: str = "posts") -> DataFrame:
    """The posts with last_seen_at, the newest stamp of their key."""
    stamps = store.rows(f"{table}-seen").groupBy(*keys).agg(F.max("seen_at").alias("last_seen_at"))
    return store.rows(table).join(stamps, keys, "left")


def ingest_stream(stream: DataFrame, store: Store, keys: list[str], checkpoint: str, *, minutes: int | None = None, **how):
    """Start the query: every ``minutes``, or, without, once over what is there."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: ingest_batch(store, batch, keys, number, **how))
    return (writer.trigger(processingTime=f"{minutes} minutes") if minutes else writer.trigger(availableNow=True)).start()
