"""Exact removal of repeated word passages, found by difference-cover anchors.

``COVER`` is a difference cover modulo ``PERIOD``: for any two places in two texts some shift below ``PERIOD`` brings both
to cover positions. So two equal runs of ``window`` words have in common an anchor, a run of
``window - PERIOD + 1`` words that starts at a cover position of either text, and only 5 of 21 positions
are hashed at first.

1. Anchors of all texts are hashed; those whose hash occurs more than once, anywhere, are marked.
2. Around a marked anchor the match is extended: every window of ``window`` words that holds it is hashed, and those whose
   hash occurs more than once are repeated.
3. Words under a repeated window are removed.

Counting is done in two steps. A batch sorts its hashes; one that it has twice is known to be repeated and leaves
as a single witness. Witnesses travel packed, by range of hash, to buckets sized from the text's bytes, where they
are sorted again. So a passage that a third of all documents share costs a bucket one witness per batch.
What comes back is places only; text is shuffled once, by document, for both later steps. Rows that repeat both id and text have one name:
a batch hashes the first of them, knows all its windows to be repeated, and a bucket tells each place of a name once.

Words are runs of other than ASCII white space, unchanged. Equality of windows is that of 96-bit
hashes of word sequences. Ids may be of any type. Null texts have no words, texts of fewer
than ``window`` words keep all; repeated rows are repeats of each other; a text may repeat itself; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix64, window_hashes, words_of

WINDOW = 35
# A perfect difference cover.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
BUCKET_BYTES = 32_000_000
#: Hashes, and words of their texts, that a batch holds at most (and one text at least); places are 32-bit numbers through all of them.
FLUSH = 500_000
FLUSH_WORDS = 1 << 30
PACKED = "bucket int, hashes binary, more binary, known binary, places binary, starts array<int>, keys array<long>, keys2 array<int>"
TOLD = "home int, keys binary, keys2 binary, counts binary, places binary"
FOUND = "key long, key2 int, places array<int>"


def cover_positions(n: int) -> np.ndarray:
    """Cover positions below n."""
    if n <= 0:
        return np.empty(0, np.int64)
    at = (np.arange(-(-n // PERIOD))[:, None] * PERIOD + np.array(COVER)).ravel()
    return at[at < n]


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, None]:
    """Places and 64-bit hashes; two anchors of one hash by chance only cost a comparison."""
    width = window - PERIOD + 1
    runs = window_hashes(hashes, width)
    at = cover_positions(len(runs))
    return at, runs[at], None


def windows_around(hashes: np.ndarray, marked: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that hold a marked anchor: places and 96 bits of hash in two arrays."""
    runs = window_hashes(hashes, window)
    if not len(runs):
        return np.empty(0, np.int64), runs, np.empty(0, np.uint32)
    edge = np.zeros(len(runs) + 1, np.int64)
    np.add.at(edge, np.clip(marked - (PERIOD - 1), 0, len(runs)), 1)
    np.add.at(edge, np.clip(marked + 1, 0, len(runs)), -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    with np.errstate(over="ignore"):
        other = window_hashes(mix64(hashes ^ np.uint64(0xD6E8FEB86659FD93)), window)
    return at, runs[at], (other[at] >> np.uint64(32)).astype(np.uint32)


def _groups(h: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash, and a flag for each of them that begins a new one."""
    order = np.argsort(h, kind="stable") if more is None else np.lexsort((more, h))
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if more is not None:
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    return order, new


def _by_doc(owners: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(owners, kind="stable")
    owners, places = owners[order], places[order]
    cuts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]) if len(owners) else []
    for a, b in zip(cuts, [*cuts[1:], len(owners)]):
        yield int(owners[a]), places[a:b]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PACKED.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    cols = list(zip(*rows)) if rows else [()] * 8
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _flush(keys: list, parts: list, several_rows: list[bool], buckets: int) -> pa.RecordBatch:
    """One batch: what it has twice, or what is in a text that it has several rows of, goes out as found, and one witness of each hash
    goes to its bucket. Places are counted through all the batch's texts. What is found of a text always goes to one bucket."""
    starts = np.cumsum([0, *(int(p[0][-1]) + 1 for p in parts)])
    places = np.concatenate([p[0] + s for p, s in zip(parts, starts)]).astype(np.uint32)
    hashes = np.concatenate([p[1] for p in parts])
    more = None if parts[0][2] is None else np.concatenate([p[2] for p in parts])
    copied = np.repeat(several_rows, [len(p[0]) for p in parts])
    order, new = _groups(hashes, more)
    hashes, places, more = hashes[order], places[order], None if more is None else more[order]
    first = np.flatnonzero(new)
    several = (np.diff(np.r_[first, len(hashes)]) > 1) | np.logical_or.reduceat(copied[order], first)
    rows = []

    def row(bucket, h, m, known, place):
        names = np.unique(np.searchsorted(starts, place, "right") - 1)
        rows.append((bucket, h.tobytes(), b"" if m is None else m.tobytes(), known.astype(np.uint8).tobytes(), place.tobytes(), starts[names].astype(np.int32), [keys[i][0] for i in names], [keys[i][1] for i in names]))

    twice = several[np.cumsum(new) - 1]
    if twice.any():  # found here: no hash is needed any more
        told = np.sort(places[twice])
        homes = np.array([key[0] % buckets for key in keys])[np.searchsorted(starts, told, "right") - 1]
        for home, place in _by_doc(homes, told):
            row(home, np.empty(0, np.uint64), None, np.empty(0, bool), place)
    h, m, place = hashes[first], None if more is None else more[first], places[first]
    bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        s = slice(cuts[b], cuts[b + 1])
        row(b, h[s], None if m is None else m[s], several[s], place[s])
    return _packed(rows)


def _hashed(rows: DataFrame, pick: Callable, buckets: int) -> DataFrame:
    """rows (key, key2, text, and places with them) -> packed witnesses. pick: (word hashes, places) -> places, hashes."""
    marked = "places" in rows.columns

    def run(batches):
        words_hash = WordHashes()
        names, parts, copied, size, words_held = {}, [], [], 0, 0
        for batch in batches:
            marks = batch.column(3) if marked else None
            texts = batch.column(2)
            for r, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key in names:
                    copied[names[key]] = True
                    continue
                words = words_of(texts[r].as_py())
                found = pick(words_hash.array(words), marks[r].values.to_numpy().astype(np.int64) if marked else None)
                if not len(found[0]):
                    continue
                if parts and (size + len(found[0]) > FLUSH or words_held + len(words) > FLUSH_WORDS):
                    yield _flush(list(names), parts, copied, buckets)
                    names, parts, copied, size, words_held = {}, [], [], 0, 0
                names[key] = len(parts)
                parts.append(found)
                copied.append(False)
                size += len(found[0])
                words_held += len(words)
        if parts:
            yield _flush(list(names), parts, copied, buckets)

    return rows.mapInArrow(run, PACKED)


class Bucket:
    """What a bucket has got so far: witnesses, and places that batches found, of each name once."""

    def __init__(self) -> None:
        self.names, self.found, self.parts = {}, {}, []

    def add(self, h, more, known, place, starts, k, k2) -> None:
        place = np.frombuffer(place, np.uint32).astype(np.int64)
        own = np.searchsorted(starts, place, "right") - 1
        place = place - np.array(starts, np.int64)[own]
        name = np.array([self.names.setdefault(x, len(self.names)) for x in zip(k, k2)], np.int64)[own]
        if len(h):
            self.parts.append((np.frombuffer(h, np.uint64), np.frombuffer(more, np.uint32), np.frombuffer(known, np.uint8), name, place))
        else:
            for o, p in _by_doc(name, place):
                self.found[o] = np.union1d(self.found[o], p.astype(np.int32)) if o in self.found else p.astype(np.int32)

    def told(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """Places whose hash occurs more than once, packed by the home of their text: a row for each home, whatever the texts."""
        if not self.names:
            return
        k, k2 = (np.array(x, t) for x, t in zip(zip(*self.names), (np.int64, np.int32)))
        own, place = [np.repeat(list(self.found), [len(p) for p in self.found.values()])], list(self.found.values())
        if self.parts:
            h, more, known, name, at = (np.concatenate(x) for x in zip(*self.parts))
            order, new = _groups(h, more if len(more) else None)
            again = (np.diff(np.r_[np.flatnonzero(new), len(h)]) > 1)[np.cumsum(new) - 1]
            told = order[again]
            told = told[known[told] == 0]  # the others were found where they came from
            own.append(name[told])
            place.append(at[told])
        own, place = np.concatenate(own).astype(np.int64), np.concatenate([*place, np.empty(0, np.int64)]).astype(np.int32)
        home = k[own] % buckets
        order = np.lexsort((place, own, home))
        own, place, home = own[order], place[order], home[order]
        rows = []
        for at, mine in _by_doc(home, np.arange(len(home))):
            o = own[mine]
            first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            rows.append((at, k[o[first]].tobytes(), k2[o[first]].tobytes(), np.diff(np.r_[first, len(o)]).astype(np.int32).tobytes(), place[mine].tobytes()))
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4])], names=[f.split()[0] for f in TOLD.split(", ")])


def _merged(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """What all buckets told of a home's texts: a row for each text, its places in order and once."""
    if not rows:
        return
    k, k2, count, place = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in enumerate((np.int64, np.int32, np.int32, np.int32)))
    k, k2 = np.repeat(k, count), np.repeat(k2, count)
    order = np.lexsort((place, k2, k))
    k, k2, place = k[order], k2[order], place[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])]
    once = new | np.r_[True, place[1:] != place[:-1]]
    k, k2, place, new = k[once], k2[once], place[once], new[once]
    first = np.flatnonzero(new)
    places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(place)], pa.int32()), pa.array(place, pa.int32()))
    yield pa.record_batch([pa.array(k[first], pa.int64()), pa.array(k2[first], pa.int32()), places], names=["key", "key2", "places"])


def _repeated(packed: DataFrame, buckets: int) -> DataFrame:
    """Places whose hash occurs more than once, per document. There are as many tasks as buckets, so a task's share does not grow."""

    def count(batches):
        at, have = None, Bucket()
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    yield from have.told(buckets)
                    at, have = bucket, Bucket()
                have.add(*row)
        yield from have.told(buckets)

    def merge(batches):
        at, rows = None, []
        for batch in batches:
            for home, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if home != at:
                    yield from _merged(rows)
                    at, rows = home, []
                rows.append(row)
        yield from _merged(rows)

    told = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, TOLD)
    return told.repartition(buckets, "home").sortWithinPartitions("home").mapInArrow(merge, FOUND)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_removed, text (kept words, joined by one space), removed (ranges of words)."""
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words or more")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col)).alias("key"), F.hash(F.lit(1), F.col(id_col).isNull(), F.col(id_col), F.col(text_col)).alias("key2"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bucket_bytes))

    marked = _repeated(_hashed(rows.select("key", "key2", "text"), lambda h, _: anchors(h, window), buckets), buckets)
    # (doc_id is not needed here, but with it both joins read one and the same shuffle of the rows)
    near = rows.join(marked, ["key", "key2"]).select("key", "key2", "text", "places", "doc_id")
    repeated = _repeated(_hashed(near, lambda h, m: windows_around(h, m, window), buckets), buckets)
    both = rows.join(repeated, ["key", "key2"], "left")

    def cut(batches):
        for batch in batches:
            n_words, n_removed, kept, begins, ends = [], [], [], [], []
            marks = batch.column(2)
            for r, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                gone = np.zeros(0, np.int64)
                if marks[r].is_valid:
                    at = marks[r].values.to_numpy().astype(np.int64)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    under = np.cumsum(edge[:-1]) > 0
                    gone = np.flatnonzero(np.diff(np.r_[False, under, False]))
                    kept.append(b" ".join([w for w, u in zip(words, under.tolist()) if not u]))
                else:
                    kept.append(b" ".join(words))
                begins.append(gone[0::2])
                ends.append(gone[1::2])
                n_words.append(len(words))
                n_removed.append(int((gone[1::2] - gone[0::2]).sum()))
            spans = [pa.array(x, pa.list_(pa.int32())) for x in (begins, ends)]
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *spans], names=["doc_id", "n_words", "n_removed", "text", "begins", "ends"])

    out = both.select("doc_id", "text", "places").mapInArrow(cut, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, text string, begins array<int>, ends array<int>")
    return out.select("doc_id", "n_words", "n_removed", "text", F.arrays_zip("begins", "ends").alias("removed"))
