"""A Merkle manifest of a dataset, by Pregel-style supersteps on RDDs.

Rows are leaves. A tree for each source has its leaves in the order of doc_id; every FANOUT consecutive nodes become their
parent, until one node, the subroot, remains. The subroots, in the order of source, are the leaves of the top tree.

Going up, each node sends its digest to its parent, known by tree and number; a parent that has all its children hashes them and
is a node of the next superstep. Going down, each node that has its path (the siblings at its own level and at those above) sends
children theirs. Leaves live with their parent, so a path moves once for FANOUT leaves, and the last superstep folds each
leaf with its path. The nodes and paths of each superstep are tables in the shared folder.

All digests are SHA-256 of the parts' lowercase hex digests, one after another. Keys are (tree, number), so that no tree, however
many rows it has, meets in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.llm import common

FANOUT = 16
SIZE = 32
#: Nodes that a task of a superstep gets.
TASK_NODES = 4096

_RUN = "tree string, idx long, n long, hash binary, children binary, changed binary, ids array<long>"
_PATH = "tree string, idx long, path binary"
_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof binary"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Key = tuple[str | None, int]


def digest(parts: bytes) -> bytes:
    """The digest of raw digests, one after another, as hex text."""
    return hashlib.sha256(parts.hex().encode()).digest()


def leaf(*values: Column) -> Column:
    """The digest of a row's values: "-" for null, else length in bytes, ":" and the value."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def tampered(doc_id: Column, text: Column) -> Column:
    """text with A-Z lower where 5 divides the CRC of the id; null elsewhere, and for a null text or id."""
    return F.when(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.translate(text, _UPPER, _UPPER.lower()))


def leaves_of(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """doc_id, source, hash and changed (the leaf with changed_text, where that isn't null) of docs."""
    col = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    row = lambda text: leaf(col["doc_id"], col["source"], col["lang"], col["n_chars"], text)
    new = F.lit(None).cast("string") if changed_text is None else changed_text
    changed = F.when(new.isNotNull(), row(new))
    return docs.select(col["doc_id"].cast("long").alias("doc_id"), col["source"].cast("string").alias("source"), row(col["text"]).alias("hash"), changed.alias("changed"))


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with idx (from 0, in the order of columns, null first) and n (rows) within each tree.

    Rows are dealt out by ranges of tree and order, and numbered from where each range begins: a tree may take any number of tasks.
    Equal rows are told apart by a number that the table before keeps.
    """
    stable = common.written(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    ranged = common.written(stable.repartitionByRange(tree, *order, "_row").withColumn("_part", F.spark_partition_id()), "merkle-ranges")
    counts = ranged.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    of = Window.partitionBy("_tree")  # a row for each range of the tree
    before = of.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_tree", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(of).alias("n"))
    own = Window.partitionBy(tree, "_part").orderBy(*order, "_row")
    out = ranged.withColumn("_place", F.row_number().over(own) - 1)
    out = out.join(starts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_of")))
    return out.withColumn("idx", F.col("_start") + F.col("_place")).select(*rows.columns, "idx", "n")


def _spot(key) -> int:
    return zlib.crc32(repr(key).encode())


def _met(left: RDD, right: RDD, parts: int) -> RDD:
    """(key, (left's values, right's values)); a key has one of each at most."""
    both = left.mapValues(lambda v: (0, v)).union(right.mapValues(lambda v: (1, v)))
    return both.groupByKey(parts, _spot).mapValues(lambda vs: tuple([v for side, v in vs if side == k] for k in (0, 1)))


def _parts(spark: SparkSession, nodes: int) -> int:
    """Tasks of a superstep with so many nodes."""
    return max(1, -(-nodes // TASK_NODES))


def _hash_runs(item) -> tuple:
    """A parent that has all its children's messages (place, n, digest, changed digest, id) as a row of _RUN."""
    (tree, idx), messages = item
    messages = sorted(messages, key=lambda m: m[0])
    n = messages[0][1]
    if [m[0] for m in messages] != list(range(min(FANOUT, n - FANOUT * idx))):
        raise ValueError(f"node {idx} of {tree} lacks children")
    children = b"".join(m[2] for m in messages)
    return tree, idx, -(-n // FANOUT), children if n == 1 else digest(children), children, b"".join(m[3] for m in messages), [m[4] for m in messages]


def _superstep_up(level: RDD, parts: int) -> RDD:
    """level: ((tree, idx), (n, digest, changed, id)) of nodes that go on. Each sends to its parent; runs of all children are hashed."""
    messages = level.map(lambda v: ((v[0][0], v[0][1] // FANOUT), (v[0][1] % FANOUT, *v[1])))
    return messages.groupByKey(parts, _spot).map(_hash_runs)  # FANOUT messages at most to a key


def _entry(children: bytes, pos: int) -> bytes:
    """A level of a path: the node's place, the number of its siblings, and these."""
    at = SIZE * pos
    return bytes([pos, len(children) // SIZE - 1]) + children[:at] + children[at + SIZE :]


def siblings(path: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and siblings at each level, from the leaf up."""
    at = 0
    while at < len(path):
        end = at + 2 + SIZE * path[at + 1]
        yield path[at], path[at + 2 : end]
        at = end


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a node and its path give."""
    for pos, others in siblings(path):
        node = digest(others[: SIZE * pos] + node + others[SIZE * pos :])
    return node


@dataclass
class Tree:
    """Runs of a forest by level, from the leaves' parents up. A lone leaf is its own parent, without hashing."""

    levels: list[DataFrame]
    nodes: list[int]

    def roots(self) -> DataFrame:
        """tree, level and hash of the trees' last nodes."""
        out = None
        for k, level in enumerate(self.levels):
            own = level.where("n = 1").select("tree", F.lit(k).alias("level"), "hash")
            out = own if out is None else out.unionByName(own)
        return out


def grown(leaves: DataFrame) -> Tree | None:
    """The forest over leaves (tree, idx, n, hash, changed, doc_id); None if there are none."""
    spark = leaves.sparkSession
    most, nodes, trees = leaves.agg(F.max("n"), F.count("*"), F.count(F.when(F.col("idx") == 0, 1))).head()
    if not most:
        return None
    levels, sizes = [], []
    rows = leaves.select("tree", "idx", "n", "hash", "changed", "doc_id").rdd
    level = rows.map(lambda r: ((r.tree, r.idx), (r.n, bytes(r.hash), bytes(r.changed or r.hash), r.doc_id)))
    while True:
        nodes, most = -(-nodes // FANOUT) + trees, -(-most // FANOUT)
        runs = _superstep_up(level, _parts(spark, nodes))
        levels.append(common.written(spark.createDataFrame(runs, _RUN, verifySchema=False), "merkle-level"))
        sizes.append(nodes)
        if most == 1:
            return Tree(levels, sizes)
        rows = levels[-1].where("n > 1").select("tree", "idx", "n", "hash").rdd
        level = rows.map(lambda r: ((r.tree, r.idx), (r.n, bytes(r.hash), b"", None)))


def _keyed(runs: DataFrame) -> RDD:
    return runs.rdd.map(lambda r: ((r.tree, r.idx), (r.n, bytes(r.children), bytes(r.changed), r.ids)))


def _down(item) -> Iterator[tuple[Key, bytes]]:
    """What a node with its path sends its children: theirs. The first SIZE bytes of a path are the tree's root."""
    (tree, idx), (runs, paths) = item
    (path,) = paths
    for _, children, _, _ in runs:
        for pos in range(len(children) // SIZE):
            own = b"" if len(children) == SIZE and path[:SIZE] == children else _entry(children, pos)
            yield (tree, FANOUT * idx + pos), path[:SIZE] + own + path[SIZE:]


def _with_roots(forest: Tree, k: int, above: RDD | None, starts: RDD) -> RDD:
    """Paths of the nodes at level k: those that parents sent, and those of trees that end here, from starts ((tree, path))."""
    roots = forest.levels[k].where("n = 1").select("tree", "hash").rdd.map(lambda r: (r.tree, bytes(r.hash)))
    parts = _parts(forest.levels[k].sparkSession, forest.nodes[k])
    own = _met(roots, starts, parts).flatMap(lambda x: [((x[0], 0), h + p) for h in x[1][0] for p in x[1][1]])
    return own if above is None else own.union(above)


def _paths(forest: Tree, starts: RDD, last) -> RDD:
    """Reverse supersteps from the trees' roots; at the leaves' parents, last makes rows of ((tree, idx), (runs, paths))."""
    spark, above = forest.levels[0].sparkSession, None
    for k in range(len(forest.levels) - 1, -1, -1):
        paths = _with_roots(forest, k, above, starts)
        met = _met(_keyed(forest.levels[k]), paths, _parts(spark, forest.nodes[k]))
        if k == 0:
            return met.flatMap(last)
        sent = met.flatMap(_down).map(lambda x: (x[0][0], x[0][1], x[1]))
        table = common.written(spark.createDataFrame(sent, _PATH, verifySchema=False), "merkle-paths")
        above = table.rdd.map(lambda r: ((r.tree, r.idx), bytes(r.path)))
    raise AssertionError


@dataclass
class Manifest:
    """The forest of sources, the tree over their subroots, and the root."""

    sources: Tree
    top: Tree
    subroots: DataFrame
    root: bytes


def build(leaves: DataFrame) -> Manifest | None:
    """The manifest of leaves_of(); None for an empty table.

    A null source is a tree of its own, before all others; a null id is the first in its source; rows with the same id are in the
    order of their digests, and repeated rows are leaves of their own.
    """
    forest = grown(placed(leaves, "source", ["doc_id", "hash"]).withColumnRenamed("source", "tree"))
    if forest is None:
        return None
    subroots = common.written(forest.roots().select("tree", "hash"), "merkle-subroots")
    ordered = subroots.select(F.lit("").alias("top"), F.col("tree").alias("source"), "hash")
    own = common.written(placed(ordered, "top", ["source"]), "merkle-top")
    top = grown(own.select(F.col("top").alias("tree"), "idx", "n", "hash", F.lit(None).cast("binary").alias("changed"), F.lit(None).cast("long").alias("doc_id")))
    return Manifest(forest, top, own, bytes(top.roots().head().hash))


def proofs(manifest: Manifest, with_proof: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and proof (null unless asked for) of every leaf.

    folded_root is what the changed leaf, or else the leaf, gives with the leaf's siblings.
    """
    spark, root = manifest.subroots.sparkSession, manifest.root

    def at_subroots(item):
        (tree, _), (runs, paths) = item
        (path,) = paths
        for _, children, _, _ in runs:
            for pos in range(len(children) // SIZE):
                own = b"" if len(children) == SIZE and path[:SIZE] == children else _entry(children, pos)
                yield item[0][1] * FANOUT + pos, own + path[SIZE:]

    def at_leaves(item):
        _, (runs, paths) = item
        (path,) = paths
        for _, children, changed, ids in runs:
            for pos, doc_id in enumerate(ids):
                at = slice(SIZE * pos, SIZE * pos + SIZE)
                own = path[SIZE:] if len(children) == SIZE and path[:SIZE] == children else _entry(children, pos) + path[SIZE:]
                given = b"".join(others for _, others in siblings(own))
                folded = fold(changed[at], own)
                yield doc_id, children[at].hex(), path[:SIZE].hex(), root.hex(), digest(given).hex(), folded.hex(), folded == root, own if with_proof else None

    top = _paths(manifest.top, spark.sparkContext.parallelize([("", b"")], 1), at_subroots)
    of_source = _met(manifest.subroots.rdd.map(lambda r: (r.idx, r.source)), top, _parts(spark, manifest.top.nodes[0] * FANOUT))
    starts = common.written(spark.createDataFrame(of_source.map(lambda x: (x[1][0][0], 0, x[1][1][0])), _PATH, verifySchema=False), "merkle-starts")
    rows = _paths(manifest.sources, starts.rdd.map(lambda r: (r.tree, bytes(r.path))), at_leaves)
    return spark.createDataFrame(rows, _PROOF, verifySchema=False)


def verified(docs: DataFrame, changed_text: Column | None = None, with_proof: bool = False) -> DataFrame:
    """proofs() of the manifest of docs (doc_id, source, lang, n_chars, text), folding the rows with changed_text where that isn't null.

    A row for each row of docs, whatever its nulls; texts count whole; other columns don't matter. No rows for an empty table.
    """
    manifest = build(leaves_of(docs, changed_text))
    if manifest is None:
        return docs.sparkSession.createDataFrame([], _PROOF)
    return proofs(manifest, with_proof)


def _level_sql(name: str, below: str) -> str:
    """A table of parents (tree, i, n, h) of the nodes in table below; the last node of a tree stays as it is."""
    return f"{name} AS (SELECT tree, i // {FANOUT} AS i, (max(n) + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {below} GROUP BY tree, i // {FANOUT})"


def _sides_sql(name: str, level: str) -> str:
    """For each node of a level what stands before and after it in its run."""
    part = lambda sign: f"coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (WHERE o.i {sign} a.i), '')"
    return f"{name} AS (SELECT a.tree, a.i, any_value(a.n) AS n, {part('<')} AS before, {part('>')} AS after FROM {level} a JOIN {level} o ON o.tree = a.tree AND o.i // {FANOUT} = a.i // {FANOUT} GROUP BY a.tree, a.i)"


def _sql(levels: int = 5, top: int = 4) -> str:
    """verified() of table documents, for sources of up to 16 ** levels rows and up to 16 ** top sources."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"
    row = lambda text: f"sha256({' || '.join(field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT)"
    parts = [
        f"own AS (SELECT *, CASE WHEN text IS NOT NULL AND {crc} % 5 = 0 THEN translate(text, '{_UPPER}', '{_UPPER.lower()}') ELSE text END AS changed FROM documents)",
        f"leaf AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {row('text')} AS h, {row('changed')} AS folded FROM own)",
        "l0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaf)",
        *[_level_sql(f"l{k + 1}", f"l{k}") for k in range(levels)], *[_sides_sql(f"p{k}", f"l{k}") for k in range(levels)],
        f"t0 AS (SELECT '' AS tree, tree AS source, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM l{levels})",
        *[_level_sql(f"t{k + 1}", f"t{k}") for k in range(top)], *[_sides_sql(f"q{k}", f"t{k}") for k in range(top)],
        "f0 AS (SELECT l0.doc_id, l0.tree, l0.i, l0.h AS leaf, t0.h AS subroot, t0.i AS at, folded, '' AS given FROM l0 JOIN t0 ON t0.source = l0.tree)",
    ]
    step = 0
    for sides, key, of in [(f"p{k}", f"f.i // {FANOUT**k}", "f.tree") for k in range(levels)] + [(f"q{k}", f"f.at // {FANOUT**k}", "''") for k in range(top)]:
        fold = "CASE WHEN s.n = 1 THEN f.folded ELSE sha256(s.before || f.folded || s.after) END"
        parts.append(f"f{step + 1} AS (SELECT f.doc_id, f.tree, f.i, f.leaf, f.subroot, f.at, {fold} AS folded, f.given || s.before || s.after AS given FROM f{step} f JOIN {sides} s ON s.tree = {of} AND s.i = {key})")
        step += 1
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, t{top}.h AS root, sha256(given) AS proof_sha256, folded AS folded_root, folded = t{top}.h AS verified FROM f{step}, t{top}"


#: op13's rows over table documents, in DuckDB's SQL.
SQL = _sql()
