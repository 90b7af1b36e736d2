"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns a text into ``FEATURES`` numbers; ``fit`` collects them for a bounded sample of labelled documents
(``labelled.MOST_ROWS``), cuts each into at most ``BINS`` quantile bins and boosts trees of fixed depth on the
logistic loss, with gradients and Hessians summed per bin by ``numpy.bincount``. The trees are complete, kept as
flat arrays in heap order, so a batch of documents walks each level of all trees with one numpy step.
Scores are probabilities of label 1.

Null and empty texts have all statistics zero and get that leaf's score. Rows without a label are not learned from; with
no labels, or of one class only, every score is the base rate (1/2 with none). Repeated ids stay separate rows; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import utf8
from .labelled import MOST_ROWS, sample

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper", "lower", "digit", "symbol", "punct", "space", "high",
    "lines", "line_bytes", "repeated_lines", "distinct_words", "repeated_triples", "top_word", "shouted", "signed", "byte_entropy", "short_words", "long_words", "ends", "one_byte_run",
)
BINS, TREES, DEPTH, RATE, L2, LEAST = 64, 80, 4, 0.15, 2.0, 8.0

_CLASS = np.full(256, 5, np.int64)  # 0 upper, 1 lower, 2 digit, 3 symbol, 4 space, 5 other punctuation or control, 6 beyond ASCII
for _lo, _hi, _k in ((65, 91, 0), (97, 123, 1), (48, 58, 2), (128, 256, 6)):
    _CLASS[_lo:_hi] = _k
_CLASS[list(b"#*$%&|<>@^~_=+{}[]\\")] = 3
_CLASS[list(b" \t\n\r\x0b\x0c")] = 4


def statistics(text: str | None) -> list[float]:
    raw = utf8(text)
    n = len(raw)
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=7) / n
    p = counts[counts > 0] / n
    m = len(words)
    sizes = np.fromiter(map(len, words), np.int64, m)
    codes = np.fromiter(map(hash, words), np.int64, m)
    _, inverse, times = np.unique(codes, return_inverse=True, return_counts=True)
    triples = inverse[:-2].astype(np.int64) * len(times) ** 2 + inverse[1:-1] * len(times) + inverse[2:] if m > 2 else np.zeros(1, np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    first = np.fromiter((w[0] for w in words), np.int64, m)
    last = np.fromiter((w[-1] for w in words), np.int64, m)
    change = np.flatnonzero(np.r_[True, data[1:] != data[:-1], True])
    return [
        np.log1p(n), np.log1p(m), sizes.mean(), sizes.std(), share[0], share[1], share[2], share[3], share[5], share[4], share[6],
        np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), len(times) / m, 1 - len(np.unique(triples)) / len(triples), times.max() / m,
        float((_CLASS[first] == 0).mean()), float((_CLASS[last] == 3).mean()), float(-(p * np.log2(p)).sum()), float((sizes <= 2).mean()), float((sizes >= 14).mean()), float((_CLASS[last] == 5).mean()), np.log1p(np.diff(change).max()),
    ]


class Trees:
    """Complete trees in heap order: ``feature`` and ``cut`` of inner nodes, ``value`` of leaves."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> None:
        self.base, self.feature, self.cut, self.value = base, feature, cut, value
        self.depth = int(np.log2(value.shape[1])) if value.size else 0

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.value.size:
            return out
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return out + self.value[trees, node - (2**self.depth - 1)].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            out[at : at + 4096] = 1 / (1 + np.exp(-self.margins(x[at : at + 4096])))
        return out


def boost(x: np.ndarray, y: np.ndarray, *, bins: int = BINS, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, l2: float = L2, least: float = LEAST) -> Trees:
    """Fit on the logistic loss. ``least``: rows in a leaf."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Trees(float(np.log(share / (1 - share))), np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)))
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    flat = binned + np.arange(k) * bins
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, inner = np.full(n, base), 2**depth - 1
    feature, cut, value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            key = (flat + (node * k * bins)[:, None]).ravel()
            g, h, c = (np.bincount(key, None if w is None else np.repeat(w, k), width * k * bins).reshape(width, k, bins).cumsum(2) for w in (grad, hess, None))
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(c < least) | (ct - c < least)] = -np.inf
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // bins, best % bins
            ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            at = width - 1 + np.arange(width)
            feature[t, at] = np.where(ok, f, 0)
            cut[t, at] = [edges[i][j] if good and j < len(edges[i]) else np.inf for i, j, good in zip(f, b, ok)]
            node = 2 * node + (ok[node] & (binned[np.arange(n), f[node]] > b[node]))
        g, h = (np.bincount(node, w, inner + 1) for w in (grad, hess))
        value[t] = -rate * g / (h + l2)
        margin += value[t][node]
    return Trees(base, feature, cut, value)


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, *, label: str = "quality", most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Learn from labelled rows for which ``allowed`` holds. Only their statistics come to the driver: 25 numbers a row."""
    rows = sample(docs, labels, label, allowed, most_rows=most_rows, id_col=id_col, text_col=text_col)

    def measure(batches):
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = rows.select("doc_id", "text", "label").mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, x array<double>").toPandas().sort_values("doc_id")
    return boost(np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES)), got["label"].to_numpy(float))


def score(docs: DataFrame, model: Trees, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a column ``out_col``; it replaces one of that name."""
    rows = docs.drop(out_col)
    text = rows.columns.index(text_col)

    def run(batches):
        for batch in batches:
            s = model.scores(_matrix(batch.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(out_col, DoubleType()))


def id_remainder(id_col: str, by: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(by))
