"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import common

#: Labelled rows that a fit reads at most, chosen by a hash of their ids.
SAMPLE_ROWS = 15_000
TREES, DEPTH, BINS, RATE, SMOOTH = 120, 5, 64, 0.12, 1.0
PARTS = 8

_KINDS = np.zeros((256, 9), dtype=np.float64)
for _k, _bytes in enumerate((
    range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), (0x20, *range(9, 14)), b".,;:'\"?-()", b"#*%$&@^~+=<>", b"!", b"|_/\\[]{}", range(0x80, 0x100),
)):
    _KINDS[list(_bytes), _k] = 1
_ODD = (_KINDS[:, [5, 6, 7]].sum(1) > 0).astype(np.int64)
_UPPER, _SPACE = _KINDS[:, 0].astype(np.int64), _KINDS[:, 3] > 0
FEATURES = 9 + 2 + 5 + 4 + 4 + 3


def statistics(text: bytes | None) -> np.ndarray:
    """FEATURES numbers of a whole text; those of an empty one are all 0."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    letters = np.frombuffer(text, dtype=np.uint8)
    n = len(letters)
    out[:9] = np.bincount(letters, minlength=256) @ _KINDS / n
    words = text.split()
    m = len(words)
    out[9:11] = np.log1p(n), np.log1p(m)
    if m:
        most = Counter(words).most_common(1)[0][1]
        distinct = len(set(words))
        same = sum(map(operator.eq, words, words[1:])) / m
        pairs = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
        out[11:16] = distinct / m, most / m, same, pairs, np.log(distinct) / np.log(m + 1)
        lengths = np.fromiter(map(len, words), dtype=np.float64, count=m)
        out[16:20] = lengths.mean(), lengths.std(), lengths.max(), (lengths > 12).mean()
    lines = text.split(b"\n")
    out[20:24] = np.log1p(len(lines)), len(set(lines)) / len(lines), m / len(lines), sum(x.isupper() for x in lines) / len(lines)
    at = np.unique(np.linspace(0, n, PARTS, endpoint=False).astype(np.int64))
    width = np.diff(np.append(at, n))
    odd, upper = np.add.reduceat(_ODD[letters], at) / width, np.add.reduceat(_UPPER[letters], at) / width
    before = letters[np.flatnonzero(_SPACE[letters[1:]] & ~_SPACE[letters[:-1]])] if n > 1 else letters[:0]
    out[24:27] = odd.max(), upper.max(), (_ODD[before].mean() if len(before) else 0)
    return out


def statistics_of(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in column]).reshape(-1, FEATURES)


@dataclass
class Forest:
    """Trees as complete binary trees in arrays: node k's children are 2k+1 and 2k+2; leaves hold values."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.leaf) or not len(x):
            return np.full(len(x), self.base)
        trees, rows = np.arange(len(self.leaf)), np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(trees)), dtype=np.int64)
        for _ in range(self.leaf.shape[1].bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.limit[trees, at])
        return self.base + self.leaf[trees, at - self.feature.shape[1]].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, smooth: float = SMOOTH) -> Forest:
    """Logistic boosting on x (rows by features) and y (0 or 1). No rows or one class only: a constant score."""
    rate_of_1 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_1 / (1 - rate_of_1)))
    nodes = (1 << depth) - 1
    if not len(y) or y.min() == y.max():
        return Forest(base, np.zeros((0, nodes), dtype=np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    margin = np.full(len(y), base)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        feature, limit = np.zeros(nodes, dtype=np.int64), np.full(nodes, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best, gain = np.full(width, -1), np.full(width, 1e-6)
            node = (at - first) * bins
            total_g, total_h = np.bincount(at - first, g, width), np.bincount(at - first, h, width)
            whole = total_g**2 / (total_h + smooth)
            for f in range(x.shape[1]):
                low_g = np.bincount(node + binned[:, f], g, width * bins).reshape(width, bins).cumsum(1)
                low_h = np.bincount(node + binned[:, f], h, width * bins).reshape(width, bins).cumsum(1)
                high_g, high_h = total_g[:, None] - low_g, total_h[:, None] - low_h
                gains = low_g**2 / (low_h + smooth) + high_g**2 / (high_h + smooth) - whole[:, None]
                gains[(low_h < 1) | (high_h < 1)] = 0
                gains[:, len(edges[f]) :] = 0
                top = gains.argmax(1)
                better = gains[np.arange(width), top] > gain
                gain[better], best[better] = gains[np.arange(width), top][better], f * bins + top[better]
            for k in np.flatnonzero(best >= 0):
                feature[first + k], limit[first + k] = best[k] // bins, edges[best[k] // bins][best[k] % bins]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
        leaf = rate * np.bincount(at - nodes, g, nodes + 1) / (np.bincount(at - nodes, h, nodes + 1) + smooth)
        margin += leaf[at - nodes]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Forest(base, np.array(features), np.array(limits), np.array(leaves))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, fold: int = 3, held_out: int = 1) -> Forest:
    """Fits on labelled rows whose remainder isn't held_out: sample_rows ids at most, the same on each run.

    labels (doc_id, quality): null labels and ids don't count, several labels of an id count as their
    majority, and several documents of an id as one of them. Only the sample's statistics reach the driver.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    own = own.where(F.col("quality").isNotNull() & (remainder(F.col("doc_id"), fold) != held_out))
    own = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches):
        for batch in batches:
            x = statistics_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])
        common.tidy()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    made = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x array<double>")
    rows = made.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit_forest(np.array([r.x for r in rows]).reshape(-1, FEATURES), np.array([r.y for r in rows], dtype=np.float64))


def score(docs: DataFrame, forest: Forest, fold: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    A null text is scored as an empty one; a null id isn't held out; repeated rows score alike; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            s = forest.score(statistics_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        common.tidy()

    held = F.coalesce(remainder(F.col("doc_id"), fold) == held_out, F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), held.alias("held"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """The rows of docs, whatever their columns, whose text scores least or more."""
    k = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            s = forest.score(statistics_of(batch.column(k).cast(pa.binary())))
            yield batch.filter(pa.array(s >= least))
        common.tidy()

    return docs.mapInArrow(run, docs.schema)
