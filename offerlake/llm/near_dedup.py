"""Near-duplicates by bottom-k sketches of one hash function.

1. Every text becomes the set of hashes of its five-word shingles and a sketch: its ``k`` least hashes. Texts of
   equal words are one text from here on (the copy with the least id stands for all).
2. Inverted lists. Two sets of similarity 0.75 or more share at least ``shared`` sketch values but for a
   probability below 1e-7 (a binomial tail). So, with values in one order, rarest first, two such sketches meet
   already within the first ``size - shared + 1`` values of each: only those are put into lists, which leaves
   out what frequent passages have in common.
3. In each list the text with the most repeated values leads. Members are compared with their leader: first by
   the estimate from the union of the two sketches, then by exact Jaccard on the full sets of both texts.
4. What then lies in one list but not in one component is compared pair by pair, in tiles of ``tile`` x
   ``tile`` sketches; only blocks of like set sizes meet, members of a list's largest component meet only those outside it,
   and a pair counts in the list of the first value that both have. The members of long lists (``SHORT``) first get
   lists anew, from sketches of ``fine_k`` values, which are whole sets for most texts: their shorter prefixes
   leave out texts that differ too much from all others. Only pairs whose estimate passes leave a task. Where both
   sketches are whole sets the pair is decided; the others are verified exactly, each text's best ones first, then all that
   remain between different components.
5. Links are joined into components (``components.py``).

Hot values are counted by partial aggregation, their joins are dealt by document (``spread_join``) or made where the rows are (``split_join``), and a large list is tiled
over many tasks; no group is gathered and all-pairs of a group are never emitted. Text travels only to be verified.

Words are runs of other than ASCII white space, A-Z lower-cased. A text of fewer than ``width`` words is
one shingle, its whole sequence; one without words, or null, has none and is linked with nothing. Rows that repeat
an id stay separate rows and share its fate; where their texts differ, a link of either is a link of the id. A row
without an id takes the component of its copies, or none. Ids may be of any type that has an order. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.joins import split_join, spread_join
from .common import WordHashes, stash, unstash, window_hashes, words_of
from .components import components

WIDTH = 5
SIMILARITY = (75, 100)
K = 64
SHARED = 28
LEAST_ESTIMATE = 0.45
FINE_K, FINE_SHARED, FINE_ESTIMATE = 256, 153, 0.62
#: A list of more members than this is a long one.
SHORT = 12
TILE = 256

#: Words whose hashes a task keeps; they go when it ends.
HELD_WORDS = 150_000


def shingles(text: str | None, width: int = WIDTH, held: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = words_of(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes((WordHashes() if held is None else held).array(words), min(width, len(words))))


def _sequence_hash(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a word sequence."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (h & (2**64 - 1)) - 2**63, (h >> 64) - 2**63


def signatures(docs: DataFrame, *, width: int = WIDTH, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (size of the shingle set), h1 and h2 (of the word sequence), sketch (ascending, as signed longs)."""

    def sign(batches):
        words_hash = WordHashes(HELD_WORDS)
        for batch in batches:
            ids, ns, h1, h2, sketches = batch.column(0), [], [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py(), lower=True)
                hashes = words_hash.array(words)
                own = np.unique(window_hashes(hashes, min(width, len(words)))) if words else hashes
                a, b = _sequence_hash(hashes)
                ns.append(len(own))
                h1.append(a)
                h2.append(b)
                sketches.append((own[:k] ^ np.uint64(1 << 63)).view(np.int64))
            ends = np.cumsum([0] + [len(s) for s in sketches])
            flat = pa.array(np.concatenate(sketches) if sketches else np.empty(0, np.int64))
            yield pa.record_batch([ids, pa.array(ns, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "n", "h1", "h2", "sketch"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sign, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n long, h1 long, h2 long, sketch array<long>")


def inverted_lists(reps: DataFrame, *, k: int = K, shared: int = SHARED) -> DataFrame:
    """value, doc_id, n, lone (sketch values that no other text has): only values that two texts put forward."""
    values = reps.where("n > 0").select("doc_id", F.explode("sketch").alias("value"))
    often = stash(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "near-often")
    rare = split_join(values, often, "value", "df").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("rare"))
    per_text = rare.join(reps.select("doc_id", "n", F.size("sketch").alias("size")), "doc_id")
    # a whole set of fewer than k values shares at least 3/4 of them with a similar one, and half of a sketch at least
    least = F.when(F.col("size") < k, F.least(F.ceil(F.col("size") * 0.75), F.lit(k // 2))).otherwise(F.lit(shared))
    lone = F.col("size") - F.size("rare")
    first = (F.col("size") - least + 1 - lone).cast("int")
    put = per_text.select("doc_id", "n", lone.alias("lone"), F.explode(F.slice("rare", 1, F.greatest(first, F.lit(0)))).alias("v"))
    out = stash(put.select(F.col("v.value").alias("value"), "doc_id", "n", "lone"), "near-lists")
    unstash(often)
    return out


def estimate(a, b, k: int = K) -> float:
    """Jaccard of two sets from their sketches: the share of common values among the least ones of the union."""
    a, b = np.asarray(a), np.asarray(b)
    if not len(a) or not len(b):
        return 0.0
    top = min(a[-1] if len(a) >= k else np.iinfo(np.int64).max, b[-1] if len(b) >= k else np.iinfo(np.int64).max)
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = int(np.searchsorted(a, top, "right")) + int(np.searchsorted(b, top, "right")) - common
    return common / union if union else 0.0


def _estimated(pairs: DataFrame, sketches: DataFrame, least: float, k: int) -> DataFrame:
    """Pairs (a, b) whose estimate passes, with it. Written with built-in functions."""
    s = sketches.select("doc_id", "sketch")
    full = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb")), "b")
    top = lambda c: F.when(F.size(c) >= k, F.element_at(c, -1))
    full = full.select("a", "b", "sa", "sb", F.size(F.array_intersect("sa", "sb")).alias("common"), F.least(top("sa"), top("sb")).alias("top"))
    upto = lambda c: F.when(F.col("top").isNull(), F.size(c)).otherwise(F.size(F.filter(c, lambda x: x <= F.col("top"))))
    full = full.select("a", "b", (F.col("common") / (upto("sa") + upto("sb") - F.col("common"))).alias("est"))
    return full.where(F.col("est") >= least)


def sketches(texts: DataFrame, k: int, width: int) -> DataFrame:
    """doc_id, n and sketch of ``k`` values."""

    def sketch(batches):
        held = WordHashes(HELD_WORDS)
        for batch in batches:
            own, ns = [], []
            for text in batch.column(1):
                x = shingles(text.as_py(), width, held)
                ns.append(len(x))
                own.append(x[:k].copy())  # the whole set goes
            ends = np.cumsum([0] + [len(x) for x in own])
            flat = np.concatenate(own) ^ np.uint64(1 << 63) if own else np.empty(0, np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))], names=["doc_id", "n", "sketch"])

    return texts.select("doc_id", "text").mapInArrow(sketch, f"doc_id {_kind(texts)}, n long, sketch array<long>")


def _kind(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def _placed(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """value, doc_id, band and comp of list members. A band holds sizes within a ratio of a little more than 4/3, so that sets of
    similarity 3/4 or more are in one band or in neighbouring ones."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.34))).cast("int")
    return lists.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("value", "doc_id", band.alias("band"), F.coalesce("component", "doc_id").alias("comp"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Lists that hold several components: value, members, and main (the largest component)."""
    parts = placed.groupBy("value", "comp").agg(F.count("*").alias("c"))
    lists = parts.groupBy("value").agg(F.sum("c").alias("members"), F.max("c").alias("c"), F.max_by("comp", F.struct("c", "comp")).alias("main"))
    return lists.where("members > c").select("value", "members", "main")


def _compared(placed: DataFrame, mixed: DataFrame, lists: DataFrame, sketch: DataFrame, tile: int, least: float, k: int, exact: float, spent: list) -> DataFrame:
    """Pairs (a, b, est, sure) of one list but not one component whose estimate passes. ``spent`` gets the tables that they are made from."""
    rows = spread_join(placed, mixed, ["value"], "members", ["doc_id"]).withColumn("inside", F.col("comp") == F.col("main")).drop("main", "members")
    rows = stash(rows, "near-mixed-rows")
    # how many blocks of ``tile`` rows each band of a list has, of its main component and of the others; few bands exist
    count = rows.groupBy("value", "band").agg(F.count_if("inside").alias("ins"), F.count_if(~F.col("inside")).alias("outs"))
    blocks = lambda c: F.ceil(F.col(c) / tile).cast("int").alias(c)
    bands = count.groupBy("value").agg(F.sum(F.col("ins") + F.col("outs")).alias("members"), F.map_from_entries(F.collect_list(F.struct("band", F.struct(blocks("outs"), blocks("ins"))))).alias("bands"))
    bands = stash(bands, "near-bands")
    spent += [rows, bands]
    rows = spread_join(rows, bands, ["value"], "members", ["doc_id"])
    own = F.element_at("bands", F.col("band"))
    block = F.when(F.col("inside"), own["outs"] + F.pmod(F.xxhash64("doc_id"), own["ins"])).otherwise(F.pmod(F.xxhash64("doc_id"), own["outs"])).cast("int")

    def met(step: int):
        """Blocks of a band that a row meets: one of the main component the others' only, one of the others all."""
        b = F.try_element_at("bands", F.col("band") + step)
        n = F.coalesce(F.when(F.col("inside"), b["outs"]).otherwise(b["outs"] + b["ins"]), F.lit(0))
        numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda x: F.struct((F.col("band") + step).alias("band"), x.alias("block")))

    rows = rows.withColumn("block", block).withColumn("x", F.explode(F.concat(met(-1), met(0), met(1))))
    mine, low, high = F.struct("band", "block"), F.least(F.col("x"), F.struct("band", "block")), F.greatest(F.col("x"), F.struct("band", "block"))
    rows = rows.select("value", "doc_id", "comp", (mine == low).alias("left"), low["band"].alias("i1"), low["block"].alias("i2"), high["band"].alias("j1"), high["block"].alias("j2"))
    # which of a sketch's values were put into lists, one flag for each
    put = lists.groupBy("doc_id").agg(F.collect_list("value").alias("put"))
    own = sketch.join(put, "doc_id").select("doc_id", "n", "sketch", F.transform("sketch", lambda v: F.array_contains("put", v)).alias("put"))
    rows = rows.join(own, "doc_id").select("value", "i1", "i2", "j1", "j2", "doc_id", "comp", "n", "put", "sketch", "left")
    return _tiles(rows, least, k, exact)


def _tiles(spread: DataFrame, least: float, k: int, exact: float) -> DataFrame:
    """Each tile (value, i, j: a band and a block each) holds rows of block i and of block j, and compares those of i with those of j."""
    keys = ["value", "i1", "i2", "j1", "j2"]
    kind, ids_type = _kind(spread), to_arrow_type(spread.schema["doc_id"].dataType)
    spread = spread.repartition(*keys).sortWithinPartitions(*keys)

    def one(key, group):
        value, same = key[0], key[1:3] == key[3:5]
        left = group if same else [g for g in group if g[5]]
        right = group if same else [g for g in group if not g[5]]
        docs = left if same else left + right
        if not left or not right or len(docs) < 2:
            return
        sizes = np.array([len(g[4]) for g in docs])
        if len(docs) <= 24:
            sets = [set(g[4].tolist()) for g in docs]
            common = np.array([[len(a & b) for b in sets] for a in sets])
        else:
            flat = np.concatenate([g[4] for g in docs])
            owner = np.repeat(np.arange(len(docs)), sizes)
            _, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
            many = count[inv] > 1
            names, inv = np.unique(inv[many], return_inverse=True)
            m = np.zeros((len(docs), len(names)), np.float32)
            m[owner[many], inv] = 1
            common = m @ m.T
        comps, ns = np.array([g[1] for g in docs]), np.array([g[2] for g in docs])
        fits = (comps[:, None] != comps) & (common >= least * np.minimum(sizes[:, None], sizes)) & (100 * np.minimum(ns[:, None], ns) >= 75 * np.maximum(ns[:, None], ns))
        for x, y in np.argwhere(np.triu(fits, 1) if same else fits[: len(left), len(left) :]).tolist():
            gx, gy = docs[x], docs[y if same else y + len(left)]
            both = np.intersect1d(gx[3], gy[3], assume_unique=True)
            if len(both) and both[0] != value:
                continue
            e = estimate(gx[4], gy[4], k)
            # two whole sets: the estimate is the similarity, and nothing is left to verify
            sure = gx[2] <= k and gy[2] <= k
            if e >= (exact if sure else least):
                yield (min(gx[0], gy[0]), max(gx[0], gy[0]), e, sure)

    def run(batches):
        key, group = None, []
        for batch in batches:
            cols = [batch.column(c) for c in range(11)]
            names = list(zip(*(c.to_pylist() for c in cols[:5])))
            ids, comps, ns, lefts = (cols[c].to_pylist() for c in (5, 6, 7, 10))
            arrays = [(cols[c].values.to_numpy(zero_copy_only=False), cols[c].offsets.to_numpy()) for c in (8, 9)]
            out = []
            for r, k_ in enumerate(names):
                if k_ != key:
                    if len(group) > 1:
                        out += one(key, group)
                    key, group = k_, []
                put, sketch = (v[o[r] : o[r + 1]] for v, o in arrays)
                group.append((ids[r], comps[r], ns[r], sketch[put.astype(bool)], sketch, lefts[r]))
            yield _pairs(out, ids_type)
        if len(group) > 1:
            yield _pairs(list(one(key, group)), ids_type)

    return spread.mapInArrow(run, f"a {kind}, b {kind}, est double, sure boolean")


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.record_batch([pa.array(cols[0], kind), pa.array(cols[1], kind), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], names=["a", "b", "est", "sure"])


def verify(pairs: DataFrame, texts: DataFrame, *, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar, as edges u, v."""
    t = texts.select("doc_id", "text")
    rows = pairs.select("a", "b").join(t.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    rows = rows.join(t.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    above, below = similarity
    ids_type = to_arrow_type(texts.schema["doc_id"].dataType)

    def check(batches):
        last, held = (None, None), WordHashes(HELD_WORDS)
        for batch in batches:
            us, vs = [], []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):  # texts one at a time
                if b != last[0]:
                    last = (b, shingles(tb.as_py(), width, held))
                x, y = shingles(ta.as_py(), width, held), last[1]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and below * common >= above * (len(x) + len(y) - common):
                    us.append(a)
                    vs.append(b)
            yield pa.record_batch([pa.array(us, ids_type), pa.array(vs, ids_type)], names=["u", "v"])

    return rows.mapInArrow(check, f"u {_kind(texts)}, v {_kind(texts)}")


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, k: int = K, shared: int = SHARED, least_estimate: float = LEAST_ESTIMATE, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id (the least id reachable), kept (it is its own)."""
    if 4 * similarity[0] < 3 * similarity[1]:
        raise ValueError("the sketches are made for a similarity of 3/4 or more")
    sig = stash(signatures(docs, width=width, k=k, id_col=id_col, text_col=text_col), "near-signatures")
    copies = stash(sig.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "near-copies")
    reps = stash(sig.join(copies.select(F.col("rep").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi").select("doc_id", "n", "sketch"), "near-reps")
    lists = inverted_lists(reps, k=k, shared=shared)

    # leaders: of each list, the text with the fewest lone values, then the least id
    lead = lists.groupBy("value").agg(F.min(F.struct("lone", "doc_id")).alias("lead"), F.count("*").alias("members")).where("members > 1")
    lead = stash(lead.select("value", F.col("lead.doc_id").alias("leader"), "members"), "near-leaders")
    led = spread_join(lists, lead, ["value"], "members", ["doc_id"]).where("doc_id <> leader")
    met = stash(led.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct(), "near-met")
    star = stash(_estimated(met, reps, least_estimate, k), "near-star")
    # the texts that any comparison may need: those in a list with others, each of which is led or leads there
    wanted = met.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = stash(rows.join(wanted, "doc_id", "left_semi"), "near-texts")
    unstash(lead, met)
    links = stash(verify(star, texts, width=width, similarity=similarity), "near-links")
    comp = stash(components(links), "near-components")

    # what shares a list but not a component
    placed = stash(_placed(lists, comp), "near-placed")
    mixed = stash(_mixed(placed), "near-mixed")
    exact = similarity[0] / similarity[1]
    spent: list[DataFrame] = []
    pairs = [_compared(placed, mixed.where(F.col("members") <= SHORT), lists, reps, tile, least_estimate, k, exact, spent)]
    long = spread_join(placed, mixed.where(F.col("members") > SHORT), ["value"], "members", ["doc_id"]).select("doc_id").distinct()
    fine = stash(sketches(texts.join(long, "doc_id", "left_semi"), FINE_K, width), "near-fine")
    fine_lists = inverted_lists(fine, k=FINE_K, shared=FINE_SHARED)
    fine_placed = stash(_placed(fine_lists, comp), "near-fine-placed")
    fine_mixed = stash(_mixed(fine_placed), "near-fine-mixed")
    pairs.append(_compared(fine_placed, fine_mixed, fine_lists, fine, tile, FINE_ESTIMATE, FINE_K, exact, spent))
    found = pairs[0].unionByName(pairs[1]).groupBy("a", "b").agg(F.max("est").alias("est"), F.bool_or("sure").alias("sure"))
    found = stash(found.join(star.select("a", "b"), ["a", "b"], "left_anti"), "near-pairs")
    unstash(*spent, reps, lists, placed, mixed, fine, fine_lists, fine_placed, fine_mixed)

    def joined(comp: DataFrame, more: DataFrame) -> DataFrame:
        """Components of what is known so far, as one edge per text, and of new links."""
        if more.isEmpty():
            return comp
        known = comp.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        return stash(components(known.unionByName(more)), "near-components")

    def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs between different components."""
        c = comp.select("node", "component")
        pairs = pairs.join(c.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left").join(c.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
        return stash(pairs.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "est"), "near-pairs")

    comp = joined(comp, found.where("sure").select(F.col("a").alias("u"), F.col("b").alias("v")))
    left = apart(found.where("not sure"), comp)
    # each text's best pair first, twice; then what is left between different components
    for best_only in (True, True, False):
        ends = left.select(F.col("a").alias("x"), "a", "b", "est").unionByName(left.select(F.col("b").alias("x"), "a", "b", "est"))
        best = ends.groupBy("x").agg(F.max(F.struct("est", "a", "b")).alias("m")).select("m.a", "m.b").distinct() if best_only else left.select("a", "b")
        comp = joined(comp, stash(verify(best, texts, width=width, similarity=similarity), "near-links"))
        if best_only:
            left = apart(left.join(best, ["a", "b"], "left_anti"), comp)

    unstash(texts, star, links, found)
    named = stash(copies.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", "rows", F.coalesce("component", "rep").alias("component_id")), "near-named")
    # the copies of a text, and all empty ones, have one key: those of a hot one are dealt over several tasks
    out = spread_join(sig.select("doc_id", "n", "h1", "h2"), named, ["h1", "h2", "n"], "rows", ["doc_id"])
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))
