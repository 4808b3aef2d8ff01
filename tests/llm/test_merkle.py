import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import merkle
from chronoweave.llm.common import table
from chronoweave.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def grow(nodes):
    """The root of a list of digests, and for each the levels (place, siblings) of its path."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            own = runs[i // 16]
            paths[k].append((i % 16, own[: i % 16] + own[i % 16 + 1 :]))
        nodes, at = [h(*r) for r in runs], [i // 16 for i in at]
    return nodes[0], paths


def by_hand(rows, tamper=True):
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = grow([leaf(*r) for r in sources[s]])
    root, tops = grow([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, own in zip(sources[s], trees[s][1], strict=True):
            path = own + top
            change = tamper and r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r[0], r[1].translate(LOWER), *r[2:]) if change else leaf(*r)
            for pos, others in path:
                node = h(*others[:pos], node, *others[pos:])
            out.append((r[0], leaf(*r), trees[s][0], root, h(*[x for _, o in path for x in o]), node, node == root))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r)[:7] for r in merkle.verified(docs, merkle.tampered(F.col("doc_id"), F.col("text"))).collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(by_hand(rows), key=key)
    return got


def made(seed, n, sources):
    rng = random.Random(seed)
    return [(i, rng.choice(["Text", "text é", "", None]) and f"{rng.choice('ABc')} {i}", rng.choice(["en", None]), rng.choice(sources), rng.choice([i, None])) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    """Trees of several levels, a source with most rows, sources of one row, more than sixteen sources, a null one."""
    monkeypatch.setattr(merkle, "TASK_NODES", 7)
    rows = made(1, 700, ["hot"] * 30 + [None, "", "é", "Z", "a"]) + [(1000 + i, "Lone", "en", f"s{i:03d}", i) for i in range(40)]
    got = check(spark, rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257])
def test_sizes_at_the_edges_of_runs(spark, n):
    check(spark, [(i, f"T{i}", "en", "one", i) for i in range(n)])


def test_odd_tables(spark):
    long = "Long " * 400_000
    rows = [(None, None, None, None, None), (None, "A", "en", "s", 1), (5, "A", "en", "s", 1), (5, "A", "en", "s", 1), (5, "B", "en", "s", 1), (6, "", "", "", 0), (7, long, "en", "s", 1)]
    check(spark, rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("hash", "idx", "n", "tree", "changed", "leaf", "root", "_part", "_row")})
    assert merkle.verified(docs).count() == len(rows)
    assert merkle.verified(docs.limit(0)).count() == 0


def test_untampered_rows_verify_and_proofs_fold(spark):
    rows = made(2, 120, ["x", "y", None])
    out = merkle.verified(spark.createDataFrame(rows, SCHEMA), with_proof=True).collect()
    assert len(out) == 120 and all(r.verified and r.folded_root == r.root for r in out)
    for r in out:
        assert merkle.fold(bytes.fromhex(r.leaf), bytes(r.proof)).hex() == r.root
        assert h("".join(o.hex() for _, o in merkle.siblings(bytes(r.proof)))) == r.proof_sha256


def test_a_lost_child_is_noticed():
    with pytest.raises(ValueError, match="lacks children"):
        merkle._hash_runs((("s", 0), [(0, 3, b"a" * 32, b"", None), (2, 3, b"b" * 32, b"", None)]))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    out = QUERIES["op13_merkle_manifest"](spark, sf)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect())) == sorted(by_hand(rows))
