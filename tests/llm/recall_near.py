"""Near-duplicate components against an exact join, at any size: ``python -m tests.llm.recall_near FOLDER``. Not a test: it needs minutes.

The exact side is a prefix filter (two sets of similarity 0.75 share a value among the rarest quarter of each), whose candidates are
compared on their sets unless they are in one component already. It prints how many documents have another component than that, and the time of both.
"""

from __future__ import annotations

import sys
import time

import numpy as np
import pyarrow.parquet as pq


def exact(ids: list[int], sets: list[np.ndarray]) -> dict[int, int]:
    """id -> least id reachable."""
    first: dict[bytes, int] = {}
    own = [first.setdefault(s.tobytes(), i) if len(s) else i for i, s in enumerate(sets)]
    up = list(range(len(sets)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in enumerate(own):
        up[root(i)] = root(j)
    some = np.array([i for i, j in enumerate(own) if i == j and len(sets[i])])
    sizes = np.array([len(sets[i]) for i in some])
    _, value, df = np.unique(np.concatenate([sets[i] for i in some]), return_inverse=True, return_counts=True)
    holder = np.repeat(some, sizes)
    order = np.lexsort((value, df[value], holder))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    put = (place < np.repeat(sizes - (3 * sizes + 3) // 4 + 1, sizes)) & (df[value[order]] > 1)
    v, d = value[order][put], holder[order][put]
    order = np.argsort(v, kind="stable")
    v, d = v[order], d[order]
    seen: set[tuple[int, int]] = set()
    for group in np.split(d, np.flatnonzero(np.diff(v)) + 1):
        members = group.tolist()
        if len({root(i) for i in members}) < 2:
            continue
        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                n, m = len(sets[a]), len(sets[b])
                if 4 * min(n, m) < 3 * max(n, m) or (a, b) in seen or root(a) == root(b):
                    continue
                seen.add((a, b))
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= 75 * (n + m - both):
                    up[root(a)] = root(b)
    least: dict[int, int] = {}
    for i, name in enumerate(ids):
        least[root(i)] = min(name, least.get(root(i), name))
    return {name: least[root(i)] for i, name in enumerate(ids)}


def main(folder: str) -> None:
    from pyspark.sql import SparkSession

    from offerlake.llm.common import WordHashes
    from offerlake.llm.near_dedup import near_duplicates, shingles

    begin = time.time()
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false").getOrCreate()
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "component_id").collect()}
    spark.stop()
    middle = time.time()
    print(f"operator {middle - begin:.0f} s", flush=True)
    rows, held = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]), WordHashes()
    want = exact(rows["doc_id"].to_pylist(), [shingles(t.as_py(), held=held) for t in rows["text"]])
    wrong = sum(got[i] != c for i, c in want.items())
    groups = len(set(want.values()))
    print(f"{folder}: {len(want)} documents in {groups} components, {wrong} with another component; exact {time.time() - middle:.0f} s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
