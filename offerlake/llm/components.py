"""Connected components with DataFrame operations: alternating large-star and small-star rounds.

Each round turns the edges into edges towards smaller neighbours, and ends when a round changes nothing;
the rounds needed grow with the logarithm of a component's size. Every round is written to the shared
folder. A node with very many edges meets only a row with its least neighbour, in several tasks, and the least is found by
partial aggregation, so no group is gathered anywhere. A graph of at most ``ONE_TASK`` edges is a few megabytes: its rounds
run in one partition each, without shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import spread_join
from .common import stash

ONE_TASK = 100_000


def _to_least(pairs: DataFrame, large: bool) -> DataFrame:
    """(u, v) -> (u, v, m) with m the least v of u. Of a large graph, a hub's edges are dealt over several tasks."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges"))
    return spread_join(pairs, stash(least, "least"), ["u"], "edges", ["v"]) if large else pairs.join(least, "u")


def components(edges: DataFrame, *, name: str = "edges", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge (columns ``u`` and ``v``); a component is its least node.

    Nulls and loops are left out; repeated edges count once; no edges give no rows.
    """
    both = edges.where("u is not null and v is not null and u <> v")
    now = stash(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = lambda e: tuple(e.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first())
    seen = mark(now)
    # later rounds have no more edges than the first has nodes, twice its edges at most
    big = seen[0] > ONE_TASK
    read = (lambda e: e) if big else (lambda e: e.coalesce(1))
    now = read(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        # large star: u's larger neighbours go to the least of u and its neighbours
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(ways, big).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = _to_least(read(stash(large, name)), big)
        small = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = read(stash(small.distinct(), name))
        was, seen = seen, mark(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components: no end after {most_rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
