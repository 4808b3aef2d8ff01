"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt into shards by a hash of their id, once; queries come in blocks. A shard keeps each
dimension as a list of (value, row) sorted by value. Queries read the lists of their dimensions in turn, a
block of entries from each: from the top where their weight is positive, from the bottom where it is negative.
A row met in a list gains that list's share of its score. Its lower bound takes the list's worst value for
the lists it hasn't been met in, its upper bound the value read last. Reading ends for all other rows when
none of them can reach the k-th best lower bound; it goes on for those few survivors alone until each that is
left has been met in every list, which makes their bounds their scores. No row is ever looked up by its number.
Queries read to the same depths, so what has been read stands in one table for all of them, and their bounds are products with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import common

SCALE = 1024
K = 10
SHARD_ROWS = 1 << 15
#: Queries of a pass, whose vectors are broadcast, and those whose bounds are compared at a time.
QUERY_ROWS, CHUNK = 1 << 12, 128
#: Shards are made at least this many while they keep LEAST_ROWS rows, for parallel work on small tables.
LEAST_SHARDS, LEAST_ROWS = 12, 1 << 11
#: Shares of the lists after which bounds are compared.
DEPTHS = (1 / 64, 1 / 8, 1 / 2, 7 / 8, 1.0)
#: Whether survivors have been met in every list is asked once at most this share of a shard survives.
SURVIVORS = 1 / 32


def usable(vector: str) -> Column:
    """Whether a vector is there, with finite components only."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def by_id(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part; of rows with the same id the least vector."""
    own = vectors.where(F.col("vec_id").isNotNull() & usable("embedding"))
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))


class Lists:
    """A shard's lists, each from its best entry on: the dimensions from the top, then the same from the bottom.

    An entry has its row, and how much better its value is than the list's worst.
    """

    def __init__(self, rows: np.ndarray):
        self.n, self.dims = rows.shape
        up = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
        values = np.take_along_axis(np.ascontiguousarray(rows.T), up, 1)
        self.rows = np.concatenate([up[:, ::-1], up])
        self.worst = np.concatenate([values[:, 0], values[:, -1]])
        self.better = np.abs(np.concatenate([values[:, ::-1], values]) - self.worst[:, None])


def best_of_all(lists: Lists, weights: np.ndarray, own: np.ndarray, k: int = K, depths: tuple[float, ...] = DEPTHS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query (a row of weights; own: its row, or -1) the rows that may be among its k best, with their scores, and how many entries it read."""
    n, width = lists.n, 2 * lists.dims
    w = np.concatenate([np.maximum(weights, 0), np.maximum(-weights, 0)], axis=1).T  # a query reads a list from one end
    base = lists.worst[: lists.dims] @ w[: lists.dims] - lists.worst[lists.dims :] @ w[lists.dims :]
    needed = (w > 0).sum(0)
    gained, met, column = np.zeros((n, width)), np.zeros((n, width)), np.arange(width)[:, None]
    rows, active, at, out = np.arange(n), np.arange(len(weights)), 0, [None] * len(weights)
    alive = np.ones((n, len(weights)), dtype=bool)
    alive[own[own >= 0], np.flatnonzero(own >= 0)] = False
    for depth in depths:
        to = min(n, max(at + 1, int(n * depth)))
        gained[lists.rows[:, at:to], column] = lists.better[:, at:to]
        met[lists.rows[:, at:to], column] = 1
        at = to
        every = len(rows) == n
        left = w[:, active] * lists.better[:, to - 1][:, None]
        low = (gained if every else gained[rows]) @ w[:, active] + base[active]
        high = low + left.sum(0) - (met if every else met[rows]) @ left
        bound = np.where(alive, low, -np.inf)
        if len(rows) > k:
            alive &= high >= np.partition(bound, len(rows) - k, axis=0)[len(rows) - k]
        if at == n:
            done = np.ones(len(active), dtype=bool)
        elif alive.mean() <= SURVIVORS or not needed[active].all():
            done = ~((met[rows] @ (w[:, active] > 0) < needed[active]) & alive).any(0)
        else:
            continue
        for j in np.flatnonzero(done).tolist():
            kept = alive[:, j]
            out[active[j]] = rows[kept], low[kept, j], int(needed[active[j]]) * at
        active, alive = active[~done], alive[:, ~done]
        if not len(active):
            break
        some = alive.any(1)
        rows, alive = rows[some], alive[some]
    return out


def best_of(lists: Lists, weights: np.ndarray, own: int, k: int = K, depths: tuple[float, ...] = DEPTHS) -> tuple[np.ndarray, np.ndarray, int]:
    """best_of_all() of one query."""
    return best_of_all(lists, weights[None], np.array([own]), k, depths)[0]


def top_of_shard(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K, depths: tuple[float, ...] = DEPTHS):
    """Arrays (query, candidate, score) of each query's k best rows of a shard, ties to smaller ids. ids ascend."""
    lists, found = Lists(rows), []
    place = np.minimum(np.searchsorted(ids, query_ids), len(ids) - 1)
    own = np.where(ids[place] == query_ids, place, -1)
    for a in range(0, len(queries), CHUNK):
        for q, (kept, score, _) in enumerate(best_of_all(lists, queries[a : a + CHUNK], own[a : a + CHUNK], k, depths), a):
            best = np.lexsort((ids[kept], -score))[:k]
            found.append((np.full(len(best), query_ids[q]), ids[kept[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3


def _whole(vectors: pa.ChunkedArray, length: int) -> np.ndarray:
    return np.floor(vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length) * SCALE)


def sharded(own: DataFrame, shards: int) -> DataFrame:
    """length, ids, data: a row for each shard of own (vec_id, vector, length), its whole-number vectors in the order of their ids."""

    def pack(table: pa.Table) -> pa.Table:
        table, length = table.sort_by("vec_id"), table["length"][0].as_py()
        ids, data = table["vec_id"].to_numpy().astype("<i8"), _whole(table["vector"], length).astype("<f8")
        return pa.Table.from_arrays([pa.array([length], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["length", "ids", "data"])

    dealt = own.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return dealt.groupBy("length", "shard").applyInArrow(pack, "length int, ids binary, data binary")  # SHARD_ROWS rows or so


def _best_in_shards(shards: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """query_id, vec_id, score of a block of queries (vec_id, vector) of a length in all shards; their vectors are broadcast."""
    rows = asked.select("vec_id", "vector").orderBy("vec_id").toArrow()
    sent = shards.sparkSession.sparkContext.broadcast((rows["vec_id"].to_numpy(), _whole(rows["vector"], length)))

    def run(batches):
        query_ids, queries = sent.value
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(ids.as_py(), "<i8")
                found = top_of_shard(own, np.frombuffer(data.as_py(), "<f8").reshape(len(own), -1), query_ids, queries)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["query_id", "vec_id", "score"])
            common.tidy()

    return shards.where(F.col("length") == length).select("ids", "data").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors (vec_id, embedding) for each id divisible by every.

    Scores are inner products of floor(1024 * component), exact in double precision up to 2^53. Vectors
    that are null, empty or hold null or non-finite components take no part, nor do null ids; rows with
    the same id count once; vectors of other lengths than the query's are no candidates. Fewer candidates
    than k give fewer rows. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    own = common.written(by_id(vectors).withColumn("length", F.size("vector")), "topk")
    n = own.count()
    shards = max(1, -(-n // SHARD_ROWS), min(LEAST_SHARDS, n // LEAST_ROWS))
    # A file for each few shards: as many tasks read them as there are shards.
    dealt = common.written(sharded(own, shards).repartition(shards), "topk-shards")
    queries = own.where(F.col("vec_id") % every == 0)
    found = None
    for length, size in sorted((r.length, r.n) for r in queries.groupBy("length").agg(F.count("*").alias("n")).collect()):  # kinds of vectors
        blocks = -(-size // QUERY_ROWS)
        for b in range(blocks):
            block = queries.where((F.col("length") == length) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b))
            with common.small_batches(spark, 1):
                part = common.written(_best_in_shards(dealt, block, length), "topk-found")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: top_k() on table embeddings, in DuckDB's SQL.
SQL = """
WITH own AS (
  SELECT vec_id, min([CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM own q JOIN own c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
