import numpy as np
import pytest

from chronoweave.llm import nn_descent, rank_aggregation
from chronoweave.llm.queries import op2_rank_aggregation, op10_nn_descent

SCHEMA = "vec_id long, embedding array<float>, score string"
NAN, INF = float("nan"), float("inf")


def brute(rows, every, k, whole):
    rows = {i: v for i, v in rows}
    data = {i: np.floor(1024 * np.array(v, dtype=np.float32).astype(float)) if whole else np.array(v, dtype=np.float32).astype(float) for i, v in rows.items()}
    out = {}
    for q in data:
        if q % every == 0:
            best = sorted((-(data[q] @ v), i) for i, v in data.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def as_lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op2_is_exact(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    assert as_lists(op2_rank_aggregation(spark, f"/root/testdata/{sf}").collect()) == brute(rows, 100, 10, True)


@pytest.mark.parametrize("depths", [(1.0,), (0.01, 0.1, 1.0), (1 / 8, 1 / 4, 1 / 2, 1.0)])
def test_bounds_lose_nothing(depths):
    r = np.random.default_rng(1)
    for n, low in ((1, -3), (7, -3), (300, -2), (800, -50)):
        rows, queries = r.integers(low, -low + 1, (n, 5)).astype(float), r.integers(-3, 4, (20, 5)).astype(float)
        ids, query_ids = np.sort(r.choice(5000, n, replace=False)), r.choice(5000, 20, replace=False)
        query_ids[0] = ids[0]
        a, b, c = rank_aggregation.top_of_shard(ids, rows, query_ids, queries, 10, depths)
        for q, v in zip(query_ids, queries, strict=True):
            want = sorted((-(x @ v), i) for i, x in zip(ids, rows, strict=True) if i != q)[:10]
            assert sorted((-s, i) for s, i in zip(c[a == q], b[a == q], strict=True)) == want


def test_skewed_lists_are_read_in_part():
    """Entries read, a list at a time: less than half where the best rows are high in all lists, no more than all of them where all are alike."""
    r = np.random.default_rng(3)
    rows = np.round(r.pareto(1.2, (4000, 1)) * r.uniform(0.5, 1, (4000, 8)) * 1000)
    lists = rank_aggregation.Lists(rows)
    for w in np.round(np.abs(r.normal(size=(20, 8))) * 100):
        kept, score, read = rank_aggregation.best_of(lists, w, -1)
        assert sorted(-score)[:10] == sorted(-(rows @ w))[:10] and read < rows.size / 2
        assert all(s == rows[i] @ w for i, s in zip(kept, score, strict=True))
    reads = [rank_aggregation.best_of(lists, w, -1)[2] for w in np.eye(8) * 7]
    assert max(reads) <= 4000 / 8
    alike = np.round(r.normal(size=(500, 8)) * 100)
    assert rank_aggregation.best_of(rank_aggregation.Lists(alike), np.ones(8), 3)[2] <= alike.size


def test_op2_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0])]
    odd = [(7, None), (8, [1.0, None]), (9, [NAN, 1.0]), (10, [INF, 1.0]), (11, []), (None, [1.0, 1.0]), (5, [1.0, 2.0])]
    df = spark.createDataFrame([(*x, "s") for x in rows + odd], SCHEMA)
    assert as_lists(rank_aggregation.top_k(df).collect()) == brute(rows, 100, 10, True)
    assert rank_aggregation.top_k(df.limit(0)).count() == 0


def test_op10_finds_the_nearest(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, got = brute(rows, 20, 20, False), as_lists(op10_nn_descent(spark, "/root/testdata/sf0.1").collect())
    assert set(want) == set(got) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    print("recall", hits / (20 * len(want)))
    assert hits >= 0.97 * 20 * len(want)
    data = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    assert all(s == pytest.approx(data[q] @ data[i], rel=1e-12) for q, best in got.items() for i, s in best)


def test_op10_odd_rows(spark):
    same = [(k, [0.6, 0.8]) for k in range(1, 40)]
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (100, [0.5, 0.5]), *[x for x in same if x[0] != 20]]
    odd = [(207, None), (208, [1.0, None]), (209, [NAN, 1.0]), (210, [INF, 1.0]), (211, []), (None, [1.0, 1.0]), (220, [0.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(*x, "s") for x in rows + odd], SCHEMA)
    want, got = brute(rows, 20, 20, False), as_lists(nn_descent.nearest(df).collect())
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert nn_descent.nearest(df.limit(0)).count() == 0


def test_op10_searches_each_length_apart(spark):
    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=3 if k % 3 else 5).round(3).tolist()) for k in range(200)]
    df = spark.createDataFrame([(*x, "s") for x in rows], SCHEMA)
    got = as_lists(nn_descent.nearest(df).collect())
    for n in (3, 5):
        want = brute([x for x in rows if len(x[1]) == n], 20, 20, False)
        assert {q: [i for i, _ in v] for q, v in got.items() if q in want} == {q: [i for i, _ in v] for q, v in want.items()}
    assert len(got) == 10


def test_trees_stay_bounded():
    sample = np.random.default_rng(5).normal(size=(1 << 12, 9)).astype(np.float32)
    (directions, limits), *_ = nn_descent.fit_trees(sample, min(nn_descent.MOST_LEAVES, 10**9 // nn_descent.LEAF_ROWS), 1)
    assert len(limits) == nn_descent.MOST_LEAVES - 1 and np.bincount(nn_descent.leaves_of(sample, (directions, limits))).max() <= 4


def test_op10_finds_long_and_short_vectors(spark):
    """Norms that differ by powers of ten: few rows are nearest to all queries, and one scale for all codes tells the others not apart."""
    r = np.random.default_rng(6)
    data = (r.normal(size=(1500, 12)) * (r.pareto(1.0, (1500, 1)) + 0.01)).astype(np.float32).astype(float)
    rows = list(enumerate(data.tolist()))
    df = spark.createDataFrame([(*x, "s") for x in rows], SCHEMA)
    want, got = brute(rows, 20, 20, False), as_lists(nn_descent.nearest(df).collect())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert set(want) == set(got) and hits >= 0.95 * 20 * len(want)
