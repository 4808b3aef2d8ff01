"""SimHash near-duplicates by the general pigeonhole principle.

64 bits are grouped into partitions of correlated bits. Partition i gets a threshold t_i, -1 or more,
such that the t_i + 1 add up to one more than the distance that links: two fingerprints within that
distance then differ in at most t_i bits of some partition i. A dynamic program chooses the thresholds,
and the number of partitions, for the least estimated work. Fingerprints are put where their own bits
of a partition say, visit what is within t_i of them, and are compared in full there.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import common
from chronoweave.llm.components import components

BITS = 64
#: Work for a row put somewhere against that for a comparison, for the plan's estimates.
PUT, COMPARE = 200.0, 1.0
#: The plan is made for this many fingerprints whatever the table's size: the rows put for each are the same at every size
#: (46 for a distance of 4 and even bits), and no plan puts more than MOST_PUT for one.
PLANNED_ROWS, MOST_PUT = 1 << 27, 256
#: A place with more rows of its own than this is compared in pairs of blocks of about so many rows.
BLOCK_ROWS = 1 << 16
SEED = 42


def _shingles(text: bytes | None, shingle: int) -> list[memoryview]:
    """All runs of shingle words, with single blanks between; of fewer words the one run there is."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = memoryview(b" ".join(words))
    if len(words) <= shingle:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    return [joined[a:b] for a, b in zip([0, *(ends[:-shingle] + 1).tolist()], ends[shingle - 1 :].tolist(), strict=True)]


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer; 0 without any."""
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view("<i8")[0])


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The SimHash of a text's shingles, repeats included, by XXH64."""
    import xxhash

    return _majority(np.array([xxhash.xxh64_intdigest(x, SEED) for x in _shingles(text, shingle)], dtype="<u8"))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp of docs (doc_id, text). A null or wordless text has 0; fewer words than a shingle are one shingle."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints (fp) there are, and how many have bits i and j both set, over all of them."""

    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = as_bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
            both += bits.T @ bits
            n += len(bits)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array([*i, -1]), pa.array([*j, -1]), pa.array([*both[i, j].astype(np.int64), n])], ["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.i < 0:
            n = r.n
        else:
            out[r.i, r.j] = out[r.j, r.i] = r.n
    return n, out


def as_bits(fps: np.ndarray) -> np.ndarray:
    """Rows of BITS bits, bit k of the integer in column k."""
    return np.unpackbits(np.ascontiguousarray(fps, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """parts groups of nearly equal size; each grows by the bit most correlated with those it has."""
    ones = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    tied = np.abs(both / max(n, 1) - np.outer(ones, ones)) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        start = min(free, key=lambda b: (-sum(tied[b, c] for c in free if c != b), b))
        group = [start]
        free.discard(start)
        while len(group) < size:
            bit = min(free, key=lambda b: (-tied[b, group].sum(), b))
            group.append(bit)
            free.discard(bit)
        groups.append(sorted(group))
    return groups


def thresholds(ones: np.ndarray, groups: list[list[int]], most: int, n: int = PLANNED_ROWS) -> tuple[float, list[int]]:
    """The least estimated work and the threshold of each group, by dynamic programming over groups and what is left to give."""
    work = []
    for group in groups:
        near = np.array([1.0])  # probability of so many differing bits between two fingerprints
        for b in group:
            p = 2 * ones[b] * (1 - ones[b])
            near = np.convolve(near, [1 - p, p])
        costs = [0.0]
        for t in range(most + 1):
            ways = sum(comb(len(group), r) for r in range(t + 1))
            put = n * ways if t <= len(group) and ways <= MOST_PUT else np.inf
            costs.append(PUT * put + COMPARE * n * n / 2 * near[: t + 1].sum())
        work.append(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in work:
        step: dict[int, tuple[float, list[int]]] = {}
        for given, (total, chosen) in best.items():
            for t, cost in enumerate(costs):
                if given + t <= most + 1 and (given + t not in step or total + cost < step[given + t][0]):
                    step[given + t] = (total + cost, [*chosen, t - 1])
        best = step
    return best[most + 1]


def plan(n: int, both: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds; those with -1 are left out."""
    ones, found = np.diag(both) / max(n, 1), []
    for parts in range(1, most + 2):
        groups = group_bits(n, both, parts)
        found.append((*thresholds(ones, groups, most), groups))
    cost, chosen, groups = min(found, key=lambda x: x[0])
    if not np.isfinite(cost):
        raise ValueError(f"no plan for a distance of {most} puts at most {MOST_PUT} rows for a fingerprint")
    return [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _place(part: int, at: Column):
    return lambda flip: F.struct(F.lit(part).alias("part"), at.bitwiseXOR(flip).alias("place"), (flip != 0).cast("int").alias("visits"))


def places(fps: DataFrame, groups: list[tuple[list[int], int]]) -> DataFrame:
    """part, place, visits (0: its own place) and the columns of fps, for each place of a fingerprint."""
    ways = []
    for k, (bits, t) in enumerate(groups):
        mask = sum(1 << b for b in bits)
        flips = [sum(1 << b for b in c) for r in range(t + 1) for c in combinations(bits, r)]
        at = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        ways.append(F.transform(F.array(*[F.lit(signed(f)) for f in flips]), _place(k, at)))
    return fps.select(*fps.columns, F.explode(F.concat(*ways)).alias("w")).select("w.part", "w.place", "w.visits", *fps.columns)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; counted unsigned, as numpy counts the bits of an absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(rows: np.ndarray, linked) -> list[tuple[int, int]]:
    """Edges that connect what a run's links connect: each row is compared with those not reached before."""
    edges, own = [], rows[:, VISITS] == 0
    waiting = np.ones(len(rows), dtype=bool)
    for seed in range(len(rows)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        front = [seed]
        while front:
            k = front.pop()
            rest = np.flatnonzero(waiting & own) if rows[k, VISITS] else np.flatnonzero(waiting)
            near = rest[linked(rows[rest], rows[k : k + 1])]
            waiting[near] = False
            edges += [(int(rows[k, PRINT]), int(rows[j, PRINT])) for j in near]
            front += near.tolist()
    return edges


#: Columns of a row: its run, whether it visits, and its fingerprint.
RUN, VISITS, PRINT = slice(0, 4), 4, 5


def _compared(most: int, small: int = 48, most_held: int = 4 * BLOCK_ROWS):
    """Reads rows sorted by run (part, place, block pair), and yields edges that connect each run's links."""

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return apart(a[:, PRINT], b[:, PRINT]) <= most

    def edges_of(rows: np.ndarray):
        starts = np.flatnonzero(np.append(True, (rows[1:, RUN] != rows[:-1, RUN]).any(1)))
        sizes = np.diff(np.append(starts, len(rows)))
        run = np.repeat(np.arange(len(starts)), sizes)
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        at = np.flatnonzero((sizes <= small)[run] & (sizes > 1)[run] & (rows[:, VISITS] == 0))
        for shift in range(1, small):
            at = at[at + shift < len(rows)]
            at = at[run[at] == run[at + shift]]
            if not len(at):
                break
            near = at[linked(rows[at], rows[at + shift])]
            pairs.append(np.column_stack([rows[near, PRINT], rows[near + shift, PRINT]]))
        for k in np.flatnonzero(sizes > small):
            pairs.append(np.array(_forest(rows[starts[k] : starts[k] + sizes[k]], linked), dtype=np.int64).reshape(-1, 2))
        found = np.concatenate(pairs)
        found = found[found[:, 0] != found[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def visited(rows: np.ndarray):
        """Edges between the visitors and the own rows of one run, at most one for each part of these that no visitor before has joined."""
        own, root, pairs = rows[rows[:, VISITS] == 0], None, []
        root = np.arange(len(own))
        for row in rows[rows[:, VISITS] != 0]:
            near = np.flatnonzero(linked(own, row[None]))
            parts, first = np.unique(root[near], return_index=True)
            pairs += [(row[PRINT], own[j, PRINT]) for j in near[first] if own[j, PRINT] != row[PRINT]]
            if len(parts) > 1:
                root[np.isin(root, parts)] = parts[0]
        found = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)])
            if not len(rows):
                continue
            rows = rows if held is None else np.concatenate([held, rows])
            last = np.flatnonzero((rows[:, RUN] != rows[-1, RUN]).any(1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield edges_of(rows[:cut])
            held = rows[cut:]
            if len(held) > most_held and held[-1, VISITS]:  # own rows, at most two blocks, have come; visitors needn't stay
                yield visited(held)
                held = held[held[:, VISITS] == 0]
        if held is not None and len(held):
            yield edges_of(held)

    return run


def links(fps: DataFrame, most: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) between different fingerprints (fp) that connect whatever pairs within most bits connect."""
    fps = fps.select("fp")
    n, both = bit_statistics(fps)
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    rows = places(fps, plan(n, both, most))
    # Where many fingerprints share a place, its rows are dealt into blocks and each pair of blocks is compared.
    crowded = rows.where("visits = 0").groupBy("part", "place").count().where(F.col("count") > block_rows)
    crowded = common.written(crowded.select(F.col("part").alias("p"), F.col("place").alias("q"), F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")), "simhash-crowded")
    if crowded.isEmpty():
        spread = rows.withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")})
    else:
        rows = rows.join(crowded, (F.col("part") == F.col("p")) & (F.col("place") == F.col("q")), "left")
        blocks = F.coalesce("blocks", F.lit(1))
        own = F.pmod(F.xxhash64("fp"), blocks).cast("long")
        rows = rows.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long")))})
        spread = rows.select("part", "place", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "visits", "fp")
    spread = spread.select(F.col("part").cast("long"), "place", "x", "y", F.col("visits").cast("long"), "fp")
    dealt = spread.repartition("part", "place", "x", "y").sortWithinPartitions("part", "place", "x", "y", "visits")
    return dealt.mapInArrow(_compared(most, most_held=4 * block_rows), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every row of docs (doc_id, text).

    Fingerprints within most bits are linked; equal ones are one node from the start. Wordless texts
    share fingerprint 0 and link like any other. Repeated rows have equal results; a null doc_id has its
    component's least id, null where it has no other. Other columns are ignored; an empty table gives no rows.
    """
    own = common.written(fingerprints(docs, shingle), "simhash-docs")
    nodes = common.written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes").withColumn("node", F.col("fp"))
    least = _least(nodes, links(nodes.select("fp"), most, block_rows))
    return own.join(nodes.join(least, "node").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _least(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component_id, the least first of all nodes reachable."""
    found = components(common.written(edges, "simhash-links"))
    rooted = nodes.join(found.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    rooted = common.written(rooted, "simhash-roots")
    return rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
