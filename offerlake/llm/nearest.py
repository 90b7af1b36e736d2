"""Exact nearest neighbours by a block matrix join: int8 product tiles with error bounds, then floats for what survives.

1. Vectors are packed, once, into blocks of at most ``BLOCK_BYTES``, each vector x as s * q + e: q has int8 components, s is a scale of
   its own, and the length of the rest e is kept. Blocks are written down, originals beside the codes.
2. Queries are a part of the blocks' rows, so they grow with the table: they are dealt into groups of at most ``QUERY_BYTES``, blocks
   into groups of their own, and each pair of groups is a cell of a grid, whose size in pairs has a bound. Cells are shuffled; a task
   holds a cell's queries and lets its blocks stream by.
3. Of a tile (``TILE`` queries by a block's rows) one product of codes gives every |s q - s' q'|; by the triangle inequality the true
   distance differs from it by the two rests at most. Pairs whose lower bound lies above the k-th upper bound, or above
   the k-th distance found so far, can't be among the k nearest. All the others are recomputed in double precision.
4. Each query keeps a heap of k; the cells' heaps are merged, by query, as they stream out of a sort.

Products of codes are sums of integers: a float32 product is exact up to 1,040 components, a float64 one beyond. The bounds
allow for rounding, so the result is the exact one; nothing is sampled or capped.

A row takes part if it has an id and a vector that is not null, not all zeros, and free of null and non-finite components; others are
neither queries nor candidates. Vectors of different lengths have no distance and never meet. Every row is a candidate for all
queries but itself: repeated ids and repeated vectors are rows like others (a query id that two rows have gets two lists, in no
particular order). Ties go to the smaller id; a query with fewer candidates than k gets all of them, one without any gets no row. Ids are of an
integer type. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash, unstash

BLOCK_BYTES = 1_000_000
QUERY_BYTES = 64_000_000
#: Pairs of a cell of the grid, at most (but for a block by a group of queries, which is never cut).
CELL_PAIRS = 1 << 30
TILE = 256
#: Doubles that are recomputed at once.
AT_ONCE = 4_000_000
#: Share of a distance that rounding of the bounds may take; double precision needs far less.
SLACK = 1e-12
PACKED = "block long, dim int, n int, n_queries int, ids binary, is_query binary, vectors binary, codes binary, scales binary, rests binary"


class Block:
    """Vectors of one length with their codes. ``rows`` are their places in the block that they come from."""

    def __init__(self, block: int, dim: int, ids, vectors, codes, scales, rests, rows=None) -> None:
        self.block, self.dim, self.ids, self.vectors, self.codes, self.scales, self.rests = block, dim, ids, vectors, codes, scales, rests
        self.rows = np.arange(len(ids)) if rows is None else rows
        wide = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
        self.factor = codes.astype(wide)
        with np.errstate(over="ignore"):
            self.square = scales * scales * np.einsum("ij,ij->i", self.factor, self.factor, dtype=np.float64)

    def some(self, at) -> Block:
        return Block(self.block, self.dim, self.ids[at], self.vectors[at], self.codes[at], self.scales[at], self.rests[at], self.rows[at])


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale for each vector, and an upper bound of the length of what the codes leave."""
    x = vectors.astype(np.float64)
    scales = np.abs(x).max(axis=1) / 127
    codes = np.rint(np.clip(x / np.where(scales > 0, scales, 1)[:, None], -127, 127)).astype(np.int8)
    with np.errstate(over="ignore"):
        rest = x - scales[:, None] * codes
        rests = np.sqrt((rest * rest).sum(axis=1))
        size = np.sqrt((x * x).sum(axis=1))
    return codes, scales, rests + SLACK * size + 1e-300


def bounds(q: Block, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances, queries by candidates."""
    with np.errstate(over="ignore", invalid="ignore"):
        product = (q.factor @ c.factor.T).astype(np.float64)
        product *= -2 * q.scales[:, None]
        product *= c.scales
        size = q.square[:, None] + c.square
        product += size
        size *= SLACK
        rest = q.rests[:, None] + c.rests
        low = np.sqrt(np.maximum(product - size, 0)) * (1 - SLACK) - rest
        high = np.sqrt(np.maximum(product + size, 0)) * (1 + SLACK) + rest
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, in double precision; components are summed in order, whatever else is computed with them."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        diff = a.T.astype(np.float64) - b.T.astype(np.float64)
        for d in diff:
            total += d * d
    return np.sqrt(total)


class Heap:
    """The k least (score, id)."""

    def __init__(self, k: int) -> None:
        self.k, self.items = k, []

    def push(self, score: float, name: int) -> None:
        item = (-score, -name)
        if len(self.items) < self.k:
            heapq.heappush(self.items, item)
        elif item > self.items[0]:
            heapq.heapreplace(self.items, item)

    def worst(self) -> float:
        return -self.items[0][0] if len(self.items) == self.k else math.inf

    def sorted(self) -> list[tuple[float, int]]:
        return sorted((-s, -i) for s, i in self.items)


def search(q: Block, c: Block, heaps: list[Heap], k: int) -> int:
    """Put a tile's pairs into the queries' heaps; how many of them were recomputed."""
    low, high = bounds(q, c)
    if q.block == c.block:
        low[np.arange(len(q.ids)), q.rows] = np.inf
        high[np.arange(len(q.ids)), q.rows] = np.inf
    most = np.array([h.worst() for h in heaps])
    if len(c.ids) > k:
        most = np.minimum(most, np.partition(high, k - 1, axis=1)[:, k - 1])
    near = low <= most[:, None]
    if q.block == c.block:
        near[np.arange(len(q.ids)), q.rows] = False
    left, right = np.nonzero(near)
    if not len(left):
        return 0
    step = max(1, AT_ONCE // q.dim)
    score = np.concatenate([distances(q.vectors[left[a : a + step]], c.vectors[right[a : a + step]]) for a in range(0, len(left), step)])
    order = np.lexsort((c.ids[right], score, left))
    left, right, score = left[order], right[order], score[order]
    first = np.searchsorted(left, left)
    best = np.arange(len(left)) - first < k  # no more of a tile than the heap can hold
    for i, s, name in zip(left[best].tolist(), score[best].tolist(), c.ids[right[best]].tolist()):
        heaps[i].push(s, name)
    return len(left)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(id, is_query, vector) -> blocks."""
    kind = np.float32 if isinstance(rows.schema["vector"].dataType.elementType, T.FloatType) else np.float64
    names = [f.split()[0] for f in PACKED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()] + [pa.binary()] * 6

    def full(dim: int, parts: list[tuple], number: int) -> tuple:
        ids, flags, vectors = (np.concatenate(x) for x in zip(*parts))
        codes, scales, rests = quantised(vectors)
        return (number, dim, len(ids), int(flags.sum()), ids.tobytes(), flags.tobytes(), vectors.tobytes(), codes.tobytes(), scales.tobytes(), rests.tobytes())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            ids, flags, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, starts = vectors.values.to_numpy().astype(kind, copy=False), vectors.offsets.to_numpy()
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                step = max(1, block_bytes // (dim * np.dtype(kind).itemsize))
                for a in range(0, len(at), step):
                    some = at[a : a + step]
                    held.setdefault(dim, []).append((ids[some], flags[some], flat[starts[some][:, None] + np.arange(dim)]))
                    size += len(some) * dim * np.dtype(kind).itemsize
                    if size >= block_bytes:
                        for d, parts in held.items():
                            yield out([full(d, parts, number)])
                            number += 1
                        held, size = {}, 0
        for d, parts in held.items():
            yield out([full(d, parts, number)])
            number += 1

    return rows.mapInArrow(run, PACKED)


def _unpacked(row: dict, kind) -> tuple[Block, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    of = lambda c, t: np.frombuffer(row[c], t).reshape(len(ids), row["dim"])
    block = Block(row["block"], row["dim"], ids, of("vectors", kind), of("codes", np.int8), np.frombuffer(row["scales"], np.float64), np.frombuffer(row["rests"], np.float64))
    return block, np.frombuffer(row["is_query"], bool)


HEAPS = "query_block long, query_row int, query_id long, scores array<double>, ids array<long>"


def nearest(rows: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = BLOCK_BYTES, query_bytes: int = QUERY_BYTES, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows of every row for which ``is_query`` holds."""
    if not isinstance(rows.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise ValueError(f"{id_col} must be of an integer type")
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark = rows.sparkSession
    single = isinstance(rows.schema[vec_col].dataType.elementType, T.FloatType)
    vector = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    kind = np.float32 if single else np.float64
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    blocks = stash(_packed(clean, block_bytes), "nearest-blocks")

    width = F.col("dim") * (5 if single else 9) + 32
    total = blocks.agg(F.count("*").alias("blocks"), F.sum(F.col("n").cast("long")).alias("n"), F.sum("n_queries").alias("q"), F.sum(F.col("n_queries") * width.cast("long")).alias("bytes")).first()
    groups = max(1, math.ceil((total.bytes or 0) / query_bytes))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(1, min(total.blocks, max(math.ceil(parallel / groups), math.ceil((total.n or 0) * ((total.q or 0) / groups) / cell_pairs))))

    def grid(part: int, own: str, other: str, n: int, of: int) -> DataFrame:
        """Rows of blocks, once for each group of the other side. Queries (part 0) come first in a cell."""
        numbered = blocks.withColumn("part", F.lit(part)).withColumn(own, F.pmod(F.xxhash64("block", F.lit(own)), F.lit(n)).cast("int"))
        return numbered.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(of - 1))))

    def only_queries(batches):
        for batch in batches:
            for r in batch.to_pylist():
                asked = np.frombuffer(r["is_query"], bool)
                for c, t in (("vectors", kind), ("codes", np.int8)):
                    r[c] = np.frombuffer(r[c], t).reshape(len(asked), r["dim"])[asked].tobytes()
                for c in ("ids", "scales", "rests"):
                    r[c] = np.frombuffer(r[c], np.int64)[asked].tobytes()  # 8 bytes each
                yield pa.RecordBatch.from_pylist([r], schema=batch.schema)

    asking = blocks.where("n_queries > 0").mapInArrow(only_queries, PACKED)
    asking = asking.withColumn("part", F.lit(0)).withColumn("group", F.pmod(F.xxhash64("block", F.lit("group")), F.lit(groups)).cast("int")).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    cells = asking.unionByName(grid(1, "stripe", "group", stripes, groups))

    def run(batches):
        at, queries = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["group"], r["stripe"]) != at:
                    yield from told(queries)
                    at, queries = (r["group"], r["stripe"]), []
                if r["part"] == 0:
                    asked = np.flatnonzero(np.frombuffer(r["is_query"], bool))
                    block, _ = _unpacked(r, kind)
                    block.rows = asked
                    for a in range(0, len(asked), TILE):
                        tile = block.some(slice(a, a + TILE))
                        queries.append((tile, [Heap(k) for _ in tile.ids]))
                else:
                    block, _ = _unpacked(r, kind)
                    for tile, heaps in queries:
                        if tile.dim == block.dim:
                            search(tile, block, heaps, k)
        yield from told(queries)

    def told(queries: list[tuple[Block, list[Heap]]]) -> Iterator[pa.RecordBatch]:
        for tile, heaps in queries:
            found = [h.sorted() for h in heaps]
            cols = [pa.array([tile.block] * len(heaps), pa.int64()), pa.array(tile.rows, pa.int32()), pa.array(tile.ids, pa.int64()), pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64())), pa.array([[i for _, i in f] for f in found], pa.list_(pa.int64()))]
            yield pa.record_batch(cols, names=[f.split()[0] for f in HEAPS.split(", ")])

    heaps = cells.repartition(max(parallel, groups * stripes), "group", "stripe").sortWithinPartitions("group", "stripe", "part").mapInArrow(run, HEAPS)

    def merge(batches):
        at, heap = None, Heap(k)

        def ranked() -> Iterator[pa.RecordBatch]:
            best = heap.sorted()
            if best:
                yield pa.record_batch([pa.array([at[2]] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([i for _, i in best], pa.int64()), pa.array([s for s, _ in best], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for block, row, name, scores, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or (block, row) != at[:2]:
                    yield from ranked()
                    at, heap = (block, row, name), Heap(k)
                for s, i in zip(scores, ids):
                    heap.push(s, i)
        yield from ranked()

    out = heaps.repartition("query_block", "query_row").sortWithinPartitions("query_block", "query_row").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
    done = stash(out, "nearest")
    unstash(blocks)
    return done
