import math
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm import simhash
from chronoweave.llm.components import components
from chronoweave.llm.queries import op7_simhash

SF = "/root/testdata/sf0.001"


def brute_print(text, shingle=4):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def check(rows, docs):
    prints = [(d, brute_print(t)) for d, t in docs]
    roots = brute_components(prints, lambda a, b: (a[1] ^ b[1]).bit_count() <= 4)
    least = {}
    for (d, _), r in zip(prints, roots, strict=True):
        least[r] = min(least.get(r, d), d)
    want = sorted((d, f"{p:016x}", least[r]) for (d, p), r in zip(prints, roots, strict=True))
    assert sorted(map(tuple, rows)) == want


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aAbÉé \t\n\xa0\x1c,"), max_size=40))
def test_fingerprint_equals_its_definition(text):
    assert simhash.fingerprint(text.encode(), 4) % (1 << 64) == brute_print(text)


def test_op7_on_a_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(op7_simhash(spark, SF).collect(), docs)


def test_links_of_crowded_fingerprints(spark):
    """Hundreds of fingerprints a few bits apart, chains, and random ones: nothing linked is lost, in blocks or not."""
    r = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(4):
        centre = r.getrandbits(64)
        for _ in range(120):
            prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))))
    at = r.getrandbits(64)
    for _ in range(60):
        prints.add(at)
        at ^= sum(1 << b for b in r.sample(range(64), 4))
    prints |= {r.getrandbits(64) for _ in range(300)}
    prints = [simhash.signed(p) for p in prints]
    want = brute_components(prints, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 4)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for block in (1 << 16, 20, 2):
        edges = simhash.links(df, 4, block)
        got = {row.node: row.root for row in components(edges).collect()}
        mine = [got.get(p, p) for p in prints]
        assert len(set(zip(want, mine, strict=True))) == len(set(want)) == len(set(mine))
        assert all(((e.a ^ e.b) % (1 << 64)).bit_count() <= 4 for e in edges.collect())


def test_every_allocation_finds_every_pair(spark):
    """The general pigeonhole holds for whatever the dynamic program allocates."""
    r = np.random.default_rng(6)
    n, both = 1000, np.full((64, 64), 250.0) + np.diag(np.full(64, 250.0))
    for parts in range(1, 6):
        groups = simhash.group_bits(n, both, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, chosen = simhash.thresholds(np.diag(both) / n, groups, 4)
        assert sum(t + 1 for t in chosen) == 5
        for _ in range(200):
            bits = set(r.choice(64, 4, replace=False).tolist())
            assert any(len(bits & set(g)) <= t for g, t in zip(groups, chosen, strict=True))


def test_plan_is_the_same_at_every_size():
    """Rows put for a fingerprint are bounded, at least one a group, and don't depend on how many fingerprints there are."""
    both = np.full((64, 64), 0.25) + np.diag(np.full(64, 0.25))
    few, many = (simhash.plan(n, both * n, 4) for n in (10**4, 10**10))
    assert few == many and sum(t + 1 for _, t in few) == 5
    assert sum(math.comb(len(bits), r) for bits, t in few for r in range(t + 1)) <= simhash.MOST_PUT * len(few)
    skewed = both.copy()
    skewed[:20] = skewed[:, :20] = 0
    assert {b for bits, _ in simhash.plan(1000, skewed * 1000, 4) for b in bits} <= set(range(64))


def test_odd_documents(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "A B  C d\te"), (9, None), (8, " \n"), (7, "one"), (None, "one"), (4, "x y " * 30_000)]
    df = spark.createDataFrame([(*x, "0") for x in rows], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got[5, simhash.fingerprint(b"a b c d e", 4)] == 3 and got[9, 0] == 8 == got[8, 0] and got[None, simhash.fingerprint(b"one", 4)] == 7
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    alone = simhash.near_duplicates(spark.createDataFrame([(None, "q")], "doc_id long, text string")).collect()
    assert [r.component_id for r in alone] == [None]


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
