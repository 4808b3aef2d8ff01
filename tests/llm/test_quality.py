import zlib

import numpy as np

from chronoweave.llm import quality
from chronoweave.llm.queries import op9_quality


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(s) + 0.5


def test_op9_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op9_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    own = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    y, s = map(np.array, zip(*own, strict=True))
    print("held-out accuracy", ((s >= 0.5) == y).mean(), "auc", auc(y, s))
    assert ((s >= 0.5) == y).mean() > 0.95 and auc(y, s) > 0.95


def test_flat_trees_equal_a_walk():
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 4)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit_forest(x, y, trees=10, depth=3)
    margin = np.full(500, forest.base)
    for f, limit, leaf in zip(forest.feature, forest.limit, forest.leaf, strict=True):
        for k, row in enumerate(x):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > limit[at])
            margin[k] += leaf[at - len(f)]
    assert np.allclose(margin, forest.margin(x)) and ((forest.score(x) >= 0.5) == y).mean() > 0.9


def test_a_boosting_step_equals_an_exhaustive_search():
    """The first tree's splits are those of greatest gain among all statistics and edges, level by level, and its leaves Newton steps."""
    r = np.random.default_rng(8)
    x = np.column_stack([r.normal(size=300).round(1), r.integers(0, 4, 300), r.exponential(size=300).round(2)])
    y = ((x[:, 0] + x[:, 1] > 1) ^ (r.random(300) < 0.1)).astype(float)
    bins, smooth, rate = 16, 1.0, 0.3
    forest = quality.fit_forest(x, y, trees=1, depth=2, bins=bins, rate=rate, smooth=smooth)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = y - p, np.full(len(y), p * (1 - p))
    assert forest.base == np.log(p / (1 - p))

    def part(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + smooth)

    def best(rows):
        found = (1e-6, None, None)
        for f in range(3):
            for limit in np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])):
                low, high = rows & (x[:, f] <= limit), rows & (x[:, f] > limit)
                if h[low].sum() >= 1 and h[high].sum() >= 1:
                    found = max(found, (part(low) + part(high) - part(rows), f, limit), key=lambda t: t[0])
        return found

    def gain(rows, f, limit):
        return part(rows & (x[:, f] <= limit)) + part(rows & (x[:, f] > limit)) - part(rows)

    nodes = {0: np.ones(300, dtype=bool)}
    for k in range(3):
        top, f, _ = best(nodes[k])
        own_f, own_limit = forest.feature[0][k], forest.limit[0][k]
        if f is not None:
            assert abs(gain(nodes[k], own_f, own_limit) - top) < 1e-9
        nodes[2 * k + 1], nodes[2 * k + 2] = nodes[k] & (x[:, own_f] <= own_limit), nodes[k] & (x[:, own_f] > own_limit)
    for k in range(4):
        rows = nodes[3 + k]
        assert forest.leaf[0][k] == np.float64(rate * g[rows].sum() / (h[rows].sum() + smooth)) or abs(forest.leaf[0][k] - rate * g[rows].sum() / (h[rows].sum() + smooth)) < 1e-12


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "### ###") for k in range(200)], "doc_id long, text string")
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 == 1]
    right = [(k, k % 2) for k in range(200)]
    wrong = [(k, 1 - k % 2 if k in held else k % 2) for k in range(200)]
    a, b = (quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int")) for rows in (right, wrong))
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.limit, b.limit)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "s"), (1, None, "s"), (None, "a", None), (3, "", "x"), (4, "word " * 50_000, "x"), (5, "\n\n \n", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    forest = quality.fit(docs, none)
    assert [r.score for r in quality.score(docs, forest).collect()] == [0.5] * 6
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 1), (3, 0), (4, 0), (5, 0)], "doc_id long, quality int")
    forest = quality.fit(docs, labels)
    got = quality.score(docs, forest).collect()
    assert len(got) == 6 and [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality.score(docs.limit(0), forest).count() == 0
    assert quality.accepted(docs, forest, 0.0).count() == 6 and quality.accepted(docs, forest).columns == docs.columns
