"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns a whole text into a row of numbers. ``fit`` bins them by
quantiles and grows trees of a fixed depth on gradients of the logistic loss,
choosing splits from histograms. The trees are flattened into arrays of equal
size, so that a batch of rows walks down a tree with one indexing step a level.

Labels are learnt from at most ``max_rows`` rows, picked by a hash of the id.

Defined results: a null text counts as empty, an empty one has zero statistics
and a score like any other; labels other than 0 and 1 are not learnt; with no
labels, or one class only, every score is the share of ones (0.5 without any);
repeated rows are repeated; of equal labels of one id one is learnt, on that of
the id's texts whose hash is smallest; labels, language, source and id never
enter a score; a column named as the score is replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

NAMES = (
    "words", "word_length", "distinct", "repeated_next", "commonest", "upper", "digits", "marks", "shouts", "bars", "stops", "commas",
    "wide", "lines", "line_length", "line_copies", "short_words", "long_words", "marked_ends", "packed",
)
UPPER, DIGITS, MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"#$%&*+/<=>@[\\]^_`{}~"


def statistics(text: str | None) -> tuple[float, ...]:
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n, size = len(words), len(b)
    if not n:
        return (0.0,) * len(NAMES)
    length = np.fromiter(map(len, words), np.int64, n)
    h = np.fromiter(map(hash, words), np.int64, n)
    met = Counter(words)
    lines = b.split(b"\n")
    share = lambda drop: (size - len(b.translate(None, drop))) / size
    return (
        float(np.log1p(n)), float(length.mean()), len(met) / n, float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0, max(met.values()) / n,
        share(UPPER), share(DIGITS), share(MARKS), b.count(b"!") / n, b.count(b"|") / n, b.count(b".") / n, b.count(b",") / n,
        share(bytes(range(128, 256))), float(np.log1p(len(lines))), size / len(lines), 1 - len(set(lines)) / len(lines),
        float((length <= 2).mean()), float((length >= 12).mean()), sum(w[-1] in MARKS for w in met) / len(met), len(zlib.compress(b, 1)) / size,
    )


@dataclass
class Forest:
    """Trees of one depth as arrays: for inner node i, its children are 2i+1 and 2i+2."""

    depth: int
    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes; a larger value goes right
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: float = 2.0, l2: float = 1.0) -> Forest:
    inner, leaves, (n, m) = 2**depth - 1, 2**depth, x.shape
    mean = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    forest = Forest(depth, float(np.log(mean / (1 - mean))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if n == 0 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(m)]
    code = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], axis=1)  # value > edge[c] if and only if code > c
    raw = np.full(n, forest.base)
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, limit, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(width)
            for k in range(m):
                cells = at * bins + code[:, k]
                gs = np.cumsum(np.bincount(cells, g, width * bins).reshape(width, bins), axis=1)
                hs = np.cumsum(np.bincount(cells, h, width * bins).reshape(width, bins), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(edges[k]) :] = 0
                top = gain.argmax(axis=1)
                for j in np.flatnonzero(gain[np.arange(width), top] > best + 1e-9):
                    best[j] = gain[j, top[j]]
                    feature[first + j], limit[first + j] = k, edges[k][top[j]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        raw += value[leaf]
        made.append((feature, limit, value))
    forest.feature, forest.limit, forest.leaf = (np.stack(c) for c in zip(*made))
    return forest


def statistics_udf():
    @F.pandas_udf("array<double>")
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([statistics(t) for t in s], dtype="object")

    return measured


def scorer(forest: Forest):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(forest.score(np.array([statistics(t) for t in s]).reshape(-1, len(NAMES))))

    return score


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, max_rows: int = 20_000) -> Forest:
    """Fit on the documents that have a label; at most ``max_rows`` labels, in the order of a hash of their id."""
    order = F.xxhash64(named(label_id), F.lit("quality"))
    usable = labels.where(named(label_id).isNotNull() & named(label_col).isin(0, 1))
    known = usable.select(named(label_id).alias("i"), named(label_col).cast("int").alias("y"), order.alias("o")).distinct()
    picked = known.orderBy("o", "i", "y").limit(max_rows).select("i", "y")
    rows = docs.select(named(id_col).alias("d"), named(text_col).alias("t")).join(F.broadcast(picked), F.col("d") == F.col("i"))
    measured = rows.select("i", "y", F.struct(F.xxhash64("t").alias("h"), statistics_udf()("t").alias("x")).alias("s"))
    found = measured.groupBy("i", "y").agg(F.min("s")["x"].alias("x")).orderBy("i", "y").collect()  # no more rows than picked labels
    return fit(np.array([r["x"] for r in found], float).reshape(-1, len(NAMES)), np.array([r["y"] for r in found], float))


def score_quality(docs: DataFrame, forest: Forest, text_col: str, into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    return docs.withColumn(into, scorer(forest)(named(text_col)))
