"""Duplicate flags of an endless stream, with the owner of each fingerprint in keyed state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "{key} {kind}, fingerprint string, is_duplicate boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Where a query may chain stateful operators, Spark holds late rows against the watermark of one batch before.
CHAINED = "spark.sql.streaming.statefulOperator.allowMultiple"


class Owner(StatefulProcessor):
    """The first post of a fingerprint is no duplicate, all others are. Of a batch's posts the least one counts as first; no more
    than one row is held, however many posts a batch has of a fingerprint."""

    def __init__(self, key: str, kind: str, days: float | None) -> None:
        self.key, self.kind, self.days = key, kind, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", f"owner {self.kind}", None if self.days is None else int(self.days * 86_400_000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        owner, first, again = self.owner.get() if self.owner.exists() else None, None, False
        for frame in rows:
            names = sorted(frame[self.key].tolist())
            if first is None or names[0] < first:
                names, first = names[1:] + ([] if first is None else [first]), names[0]
            if names:
                yield pd.DataFrame({self.key: names, "fingerprint": key[0], "is_duplicate": True})
        if first is not None:
            yield pd.DataFrame({self.key: [first], "fingerprint": key[0], "is_duplicate": [owner is not None]})
            self.owner.update((first,) if owner is None else owner)  # a sight of it renews what expires

    def close(self) -> None:
        pass


def owned(stream: DataFrame, key: str, fingerprint: str = "fingerprint", *, days: float | None = None) -> DataFrame:
    """key, fingerprint, is_duplicate of the stream's rows that have a fingerprint. ``days`` after its last sight a fingerprint is forgotten; without,
    never. State is kept in RocksDB and in the checkpoint, so a query that starts anew knows all owners."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col(fingerprint).alias("fingerprint")).where("fingerprint is not null")
    return rows.groupBy("fingerprint").transformWithStateInPandas(Owner(key, kind, days), OUT.format(key=key, kind=kind), "Append", "None" if days is None else "ProcessingTime")


def first_sights(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key, where rows come late and in no order: rows more than ``delay`` behind the newest that earlier batches had are left out, and
    a key is remembered that long, so state doesn't grow with the stream. From here on, the session's streams hold late rows against the newest watermark
    and have one stateful operator each."""
    stream.sparkSession.conf.set(CHAINED, "false")
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
