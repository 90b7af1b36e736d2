"""Toxic passages by maximum-scoring segments.

1. Words (``decontaminate.normal_words``) give tokens: the word, and its stems of 3 to 8 characters, so that endings don't hide a
   word. The first, the second and any later occurrence of a token in a text are tokens of their own, since a word that clean
   texts hold by chance seldom comes again. Tokens get log-odds between toxic and other labelled documents, from the number of
   documents that hold them, with an informative Dirichlet prior; those that stand out (``LEAST_Z``, ``LEAST_ODDS``) make the model. A
   word scores the best of its tokens, all other words score ``DRIFT``, a little below zero.
2. A linear scan (Ruzzo and Tompa) finds all maximal segments of a text's scores.
3. Their scores are calibrated by extreme-value theory (Karlin and Altschul): with lambda from the words' background
   frequencies and K fitted to the sample's other documents, a segment of score s in n words has the expected number
   E = K n exp(-lambda s) by chance. A text's evidence is its best segment's score and the least chance that any number of its
   best segments, taken together, have by the theory's sum statistics; a logistic curve over both gives the document's score.

Labels are learned from a bounded sample (``labelled.MOST_ROWS``), which bounds the vocabulary too; equal texts of one label, and such as share the
least hash of their five-word windows (near copies), count once in it. Null, empty and
wordless texts have no segment and get the score of no evidence; with no labels, or of one class, every score is the
base rate (1/2 with none). Repeated ids stay separate rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, stash, window_hashes
from .decontaminate import normal_words, word_spans
from .labelled import MOST_ROWS, sample

PRIOR = 0.05
LEAST_Z, LEAST_ODDS = 3.0, 1.5
STEMS = range(3, 9)
REPEATS = 3
#: Counters are passed on when they hold so many tokens.
HELD = 200_000
DRIFT = -0.05
LEAST_E = 0.05


def segments(at: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a sequence that is ``drift`` but for ``scores`` at ``at``.

    One pass from left to right over the scored words; a run of drift between two of them is one step.
    """
    kept: list[list] = []  # begin, end, sum before, sum after
    total, last = 0.0, 0
    for p, s in zip(at, scores):
        total += drift * (p - last)
        last = p + 1
        if s <= 0:
            total += s
            continue
        new = [p, p + 1, total, total + s]
        total += s
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(a, b, y - x) for a, b, x, y in kept]


def tokens(word: bytes) -> list[bytes]:
    """A word and its stems, which end in a star."""
    text = word.decode("utf-8", "surrogatepass")
    return [word, *(text[:k].encode("utf-8", "surrogatepass") + b"*" for k in STEMS if k <= len(text))]


def document_tokens(words: list[bytes]) -> list[tuple[bytes, int]]:
    """Each token of a text with the number of its occurrence, ``REPEATS`` at most."""
    count: Counter = Counter()
    for word, n in Counter(words).items():
        for t in tokens(word):
            count[t] += n
    return [(t, k) for t, n in count.items() for k in range(1, min(n, REPEATS) + 1)]


@dataclass
class Toxicity:
    #: token -> score of its first, second and later occurrences; None where that says nothing
    odds: dict[bytes, tuple] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0
    scale: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    known: dict[bytes, list] = field(default_factory=dict, repr=False, compare=False)

    def scored(self, words: list[bytes]) -> tuple[list[int], list[float]]:
        """Places of words that score, and their scores."""
        odds, known, count, at, scores = self.odds, self.known, {}, [], []
        if len(known) > HELD:
            known.clear()
        for i, w in enumerate(words):
            own = known.get(w)
            if own is None:
                own = known[w] = [t for t in tokens(w) if t in odds]
            best = None
            for t in own:
                k = count[t] = count.get(t, -1) + 1
                v = odds[t][min(k, REPEATS - 1)]
                if v is not None and (best is None or v > best):
                    best = v
            if best is not None:
                at.append(i)
                scores.append(best)
        return at, scores

    def found(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Words, and segments (begin, end, score, E), in words."""
        words = normal_words(text)
        at, scores = self.scored(words) if self.odds else ([], [])
        return len(words), [(a, b, s, self.scale * len(words) * float(np.exp(-self.rate * s))) for a, b, s in segments(at, scores, self.drift)]

    @staticmethod
    def evidence(found: list[tuple]) -> tuple[float, float]:
        """The best segment's raw score, and -log10 of the least chance that its r best segments have together, over all r:
        exp(-T) T^(r-1) / (r! (r-1)!) with T the sum of their -ln E."""
        if not found:
            return 0.0, 0.0
        x = sorted((-np.log(max(f[3], 1e-300)) for f in found), reverse=True)
        total, best = 0.0, -np.inf
        for r, v in enumerate(x, 1):
            total += v
            if total <= 0:
                break
            best = max(best, total - (r - 1) * np.log(total) + lgamma(r + 1) + lgamma(r) if total > r - 1 else 0.0)
        best = (x[0] if best == -np.inf else best) / np.log(10)
        return min(max(f[2] for f in found), 30.0) / 10, float(np.clip(best, -3, 30)) / 10

    def score(self, found: list[tuple]) -> float:
        a, b = self.evidence(found)
        w = self.weights
        return float(1 / (1 + np.exp(-(w[0] + w[1] * a + w[2] * b))))


def near_name(text: str | None) -> int:
    """The least hash of a text's five-word windows."""
    words = normal_words(text)
    hashes = window_hashes(WordHashes().array(words), min(5, len(words))) if words else np.zeros(1, np.uint64)
    return int(hashes.min().view(np.int64))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, *, label: str = "toxic", most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Learn from labelled rows for which ``allowed`` holds."""
    chosen = sample(docs, labels, label, allowed, most_rows=most_rows, id_col=id_col, text_col=text_col).select("text", "label").dropDuplicates()

    def name(batches):
        for batch in batches:
            names = pa.array([near_name(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=["text", "label", "name"])

    # of near copies, the least text in order
    rows = stash(chosen.mapInArrow(name, "text string, label int, name long").groupBy("label", "name").agg(F.min("text").alias("text")).select("text", "label"), "toxicity-sample")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    base = (n1 + 0.5) / (n1 + n0 + 1)
    if not n1 or not n0:
        return Toxicity(weights=(float(np.log(base / (1 - base))), 0.0, 0.0))

    def counted(held: dict) -> pa.RecordBatch:
        keys, values = list(held), list(held.values())
        return pa.record_batch([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([v[c] for v in values], pa.int64()) for c in (1, 0))], names=["token", "k", "y1", "y0"])

    def count(batches):
        held: dict = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key in document_tokens(normal_words(text)):
                    if key not in held:
                        held[key] = [0, 0]
                    held[key][y] += 1
                if len(held) >= HELD:
                    yield counted(held)
                    held = {}
        yield counted(held)

    counts = rows.mapInArrow(count, "token binary, k int, y1 long, y0 long").groupBy("token", "k").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    prior = PRIOR * (n1 + n0)
    alpha = prior * (F.col("y1") + F.col("y0")) / (n1 + n0)
    odd = lambda y, n: F.log((F.col(y) + alpha) / (n + prior - F.col(y) - alpha))
    odds = odd("y1", n1) - odd("y0", n0)
    z = odds / F.sqrt(1 / (F.col("y1") + alpha) + 1 / (F.col("y0") + alpha))
    # tokens of a bounded sample
    kept = counts.where("y1 > 0").select("token", "k", odds.alias("odds"), z.alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).collect()
    by_token: dict[bytes, list] = {}
    for r in kept:
        by_token.setdefault(bytes(r["token"]), [None] * REPEATS)[r["k"] - 1] = float(r["odds"])
    out = Toxicity({t: tuple(v) for t, v in sorted(by_token.items())})

    def background(batches):
        for batch in batches:
            seen, n = Counter(), 0
            for text in batch.column(0).to_pylist():
                words = normal_words(text)
                n += len(words)
                seen.update(out.scored(words)[1])
            seen[out.drift] += n - sum(seen.values())
            yield pa.record_batch([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["score", "n"])

    # how often each score comes among the words of the other documents; there are no more scores than tokens in the model
    shares = rows.where("label = 0").select("text").mapInArrow(background, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).orderBy("score").collect()
    words0 = sum(r["n"] for r in shares) or 1
    s, p = np.array([r["score"] for r in shares]), np.array([r["n"] / words0 for r in shares])
    # lambda: the positive root of sum p exp(lambda s) = 1 over the background's scores
    if out.odds and (p * s).sum() < 0 and s.max() > 0:
        lo, hi = 1e-6, 1.0
        while (p * np.exp(hi * s)).sum() < 1 and hi < 50:
            hi *= 2
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
        out.rate = lo

    def look(batches):
        for batch in batches:
            best = [max((f[2] for f in out.found(t)[1]), default=0.0) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(best, pa.float64())], names=["best"])

    # K: the expected number of chance segments matches those seen in other documents above the middle of their best scores
    best = rows.where("label = 0").select("text").mapInArrow(look, "best double").toPandas()["best"].to_numpy()
    least = float(np.quantile(best[best > 0], 0.5)) if (best > 0).any() else 1.0
    out.scale = ((best >= least).sum() + 0.5) / words0 * float(np.exp(out.rate * least))

    def prove(batches):
        for batch in batches:
            proof = [Toxicity.evidence(out.found(t)[1]) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), *(pa.array(c, pa.float64()) for c in (zip(*proof) if proof else ((), ())))], names=["label", "a", "b"])

    # three numbers for each row of the bounded sample
    got = rows.mapInArrow(prove, "label int, a double, b double").toPandas().sort_values(["label", "a", "b"])
    out.weights = tuple(float(w) for w in _logistic(got[["a", "b"]].to_numpy(), got["label"].to_numpy(float)))
    return out


def score(docs: DataFrame, model: Toxicity, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, and passages: (begin, end) in characters with their score and E, of every significant segment and the best one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                _, found = model.found(text)
                scores.append(model.score(found))
                if found:
                    spans, best = word_spans(text), min(found, key=lambda f: f[3])
                    found = [f for f in found if f is best or f[3] < LEAST_E]
                    passages.append([{"begin": int(spans[a, 0]), "end": int(spans[b - 1, 1]), "points": s, "chance": e} for a, b, s, e in found])
                else:
                    passages.append([])
            kinds = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("points", pa.float64()), ("chance", pa.float64())]))
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kinds)], names=["doc_id", "score", "passages"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<begin:int,end:int,points:double,chance:double>>")
