"""Best-fit packing by a grouping genetic algorithm.

Documents are tokenized, ended with ``end_id`` and cut into pieces of at most ``capacity`` tokens (only
longer ones are cut). Whole pieces of ``capacity`` fill a sequence alone. The rest is dealt by hash into
blocks of about ``block_items`` pieces; a block starts from best-fit decreasing and, unless that already
meets the bound ceil(tokens / capacity), is evolved on ``islands`` islands: crossover injects one parent's
best-filled bins into the other, removes bins with duplicates and best-fits what they displaced; after each
epoch every island's elite moves to the next one. Each block then gives up its worst-filled bins, whose pieces
are dealt into fewer blocks and packed again, until one block is left. So a task holds one block, and all
that grows is the number of blocks.

Null texts count as empty (the end id alone), repeated ids as separate rows of the same id, which may be of any type; an
empty table gives no rows; other columns are not read. Equal lengths are taken in the order of their rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, encoder, stash

CAPACITY = 2048
BLOCK_ITEMS = 4096
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 12
POPULATION = 6
PIECES = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            done = 0
            for ids, counts in enc.encode_column(batch.column(1), end_id):
                doc_ids = batch.column(0).slice(done, len(counts))
                done += len(counts)
                parts = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), parts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, counts[owner] - start)
                data, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.cumsum(length).tolist()
                crcs = [crc32(data[4 * a : 4 * b]) for a, b in zip([0, *ends], ends)]
                yield pa.record_batch([doc_ids.take(pa.array(owner)), pa.array(piece.astype(np.int32)), *(pa.array(x, pa.int64()) for x in (start, length, crcs))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {PIECES}")


def best_fit(sizes: np.ndarray, order, capacity: int, bins: list[int] | None = None, fill: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Put items, in the given order, each into the fullest bin that still has room for it, else into a new one."""
    bins = [-1] * len(sizes) if bins is None else bins
    fill = [] if fill is None else fill
    rooms = sorted((capacity - f, b) for b, f in enumerate(fill) if f < capacity)
    size = sizes.tolist()
    for i in order:
        s = size[i]
        k = bisect_left(rooms, (s, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i] = b
        fill[b] += s
        if room > s:
            insort(rooms, (room - s, b))
    return bins, fill


def fitness(fill, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (the mean of squared fills)."""
    f = np.asarray(fill, float) / capacity
    return (-len(f), float((f * f).mean()) if len(f) else 0.0)


def _refit(bins: np.ndarray, keep: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Number the kept bins anew and best-fit all items outside them, largest first."""
    names, inverse = np.unique(bins[keep], return_inverse=True)
    out = np.full(len(sizes), -1)
    out[keep] = inverse
    fill = np.bincount(inverse, weights=sizes[keep], minlength=len(names)).astype(int).tolist()
    loose = np.flatnonzero(~keep)
    loose = loose[np.argsort(-sizes[loose], kind="stable")]
    return np.array(best_fit(sizes, loose.tolist(), capacity, out.tolist(), fill)[0])


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Inject a random half of a's best-filled bins into b; bins of b that share an item go, their other items are best-fitted."""
    fill = np.bincount(a, weights=sizes)
    good = np.flatnonzero(fill >= np.median(fill))
    taken = np.isin(a, rng.choice(good, max(1, len(good) // 2), replace=False))
    hurt = np.zeros(b.max() + 1, bool)
    hurt[b[taken]] = True
    keep = taken | ~hurt[b]
    return _refit(np.where(taken, a, b + a.max() + 1), keep, sizes, capacity)


def mutate(a: np.ndarray, sizes: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Empty the worst-filled bins and some others, and best-fit their items."""
    fill = np.bincount(a, weights=sizes)
    n = max(2, len(fill) // 20)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill)[:n]] = True
    gone[rng.integers(0, len(fill), n)] = True
    return _refit(a, ~gone[a], sizes, capacity)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, rng) -> list[np.ndarray]:
    """One island's epoch; the population comes back best first. It ends once the bound is met."""
    bound = math.ceil(sizes.sum() / capacity)
    score = lambda x: fitness(np.bincount(x, weights=sizes), capacity)
    ranked = sorted(((score(x), k, x) for k, x in enumerate(population)), key=lambda t: t[0], reverse=True)
    for g in range(generations):
        if -ranked[0][0][0] <= bound:
            break
        i, j = rng.integers(0, len(ranked), 2)
        child = mutate(crossover(ranked[min(i, j)][2], ranked[max(i, j)][2], sizes, capacity, rng), sizes, capacity, rng)
        ranked = sorted([*ranked, (score(child), -g - 1, child)], key=lambda t: t[0], reverse=True)[: len(population)]
    return [x for _, _, x in ranked]


STATE = "block long, island int, done boolean, items array<long>, sizes array<int>, solutions array<array<int>>"


def _starts(frame: pd.DataFrame, *, capacity: int, islands: int, size: int, seed: int) -> pd.DataFrame:
    frame = frame.sort_values(["length", "item"], ascending=[False, True], kind="stable")
    sizes, block = frame["length"].to_numpy(np.int64), int(frame["block"].iloc[0])
    first = np.array(best_fit(sizes, range(len(sizes)), capacity)[0])
    done = first.max() + 1 <= math.ceil(sizes.sum() / capacity)
    rows = []
    for island in range(1 if done else islands):
        rng = np.random.default_rng([seed, block, island])
        population = [first] + [np.array(best_fit(sizes, np.argsort(-sizes * rng.uniform(0.8, 1.2, len(sizes))).tolist(), capacity)[0]) for _ in range(0 if done else size - 1)]
        rows.append((block, island, done, frame["item"].to_numpy(), sizes, [x.tolist() for x in population]))
    return pd.DataFrame(rows, columns=["block", "island", "done", "items", "sizes", "solutions"])


def _epoch(frame: pd.DataFrame, *, capacity: int, islands: int, generations: int, size: int, seed: int) -> pd.DataFrame:
    """Evolve one island (its own row and the elite that came), then keep its row and send its elite on."""
    own = frame.sort_values("solutions", key=lambda c: c.map(len), ascending=False, kind="stable").iloc[0]
    if own["done"]:
        return frame.iloc[:1]
    sizes = np.array(own["sizes"], np.int64)
    population = [np.array(x) for row in frame["solutions"] for x in row]
    population = evolve(sizes, population, capacity, generations, np.random.default_rng([seed, int(own["block"]), int(own["island"])]))[:size]
    out = [dict(own) | {"solutions": [x.tolist() for x in population]}]
    if islands > 1:
        out.append(dict(own) | {"island": (int(own["island"]) + 1) % islands, "solutions": [population[0].tolist()]})
    return pd.DataFrame(out)[list(frame.columns)]


PLACED = "item long, length long, sequence_id long, offset long, loose boolean"


def _best(frame: pd.DataFrame, *, capacity: int, last: bool, level: int) -> pd.DataFrame:
    """The best solution of a block as rows; ``loose`` are the pieces of the bins that it gives up."""
    row = frame.iloc[0]
    sizes = np.array(row["sizes"], np.int64)
    bins = max((np.array(x) for r in frame["solutions"] for x in r), key=lambda x: fitness(np.bincount(x, weights=sizes), capacity))
    fill = np.bincount(bins, weights=sizes)
    loose = np.zeros(len(fill), bool)
    if not last:
        worst = np.argsort(fill, kind="stable")[: 2 + len(fill) // 50]
        loose[worst[fill[worst] < capacity]] = True
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    b = bins[order].astype(np.int64)
    first = np.r_[True, b[1:] != b[:-1]]
    base = (ends - sizes[order])[first][np.cumsum(first) - 1]
    return pd.DataFrame({
        "item": np.array(row["items"])[order], "length": sizes[order],
        "sequence_id": (level + 1 << 56) + (int(row["block"]) << 24) + b, "offset": ends - sizes[order] - base, "loose": loose[b],
    })


def _frames(step: Callable, **how) -> Callable:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return step(frame, **how)

    return run


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, seed: int = 7) -> DataFrame:
    """The pieces (a column ``length`` from 1 to ``capacity``, any others) with a sequence_id and an offset each."""
    items = stash(pieces.withColumn("_item", F.monotonically_increasing_id()), "pack-pieces")
    todo = items.where(F.col("length") < capacity).select(F.col("_item").alias("item"), "length")
    # a whole piece fills a sequence alone; its number stays below those of the blocks
    done = [items.where(F.col("length") >= capacity).select(F.col("_item").alias("item"), F.col("_item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    level = 0
    while left := todo.count():
        blocks = max(1, math.ceil(left / block_items))
        last = blocks == 1
        block = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)).alias("block")
        states = todo.select(block, "item", "length").groupBy("block").applyInPandas(_frames(_starts, capacity=capacity, islands=islands, size=population, seed=seed), STATE)
        for e in range(epochs):
            states = states.groupBy("block", "island").applyInPandas(_frames(_epoch, capacity=capacity, islands=islands, generations=generations, size=population, seed=seed + e), STATE)
        placed = stash(states.groupBy("block").applyInPandas(_frames(_best, capacity=capacity, last=last, level=level), PLACED), "pack-level")
        done.append(placed.where(~F.col("loose")).select("item", "sequence_id", "offset"))
        todo = placed.where("loose").select("item", "length")
        level += 1
        if last:
            break
    places = done[0]
    for d in done[1:]:
        places = places.unionByName(d)
    return items.drop("sequence_id", "offset").join(places.withColumnRenamed("item", "_item"), "_item").drop("_item")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 0, **how) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id), capacity=capacity, **how)
