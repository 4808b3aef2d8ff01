import re
from collections import defaultdict

import pytest

from chronoweave.llm import mixing
from chronoweave.llm.queries import op3_mixing

SF = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, share=1.5, weights=(3, 1, 2), most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        target |= {s: most * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def check(rows, docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += size(text)
    want = brute_targets(sizes)
    source_of = {d: s for d, _, s in docs}
    taken = defaultdict(int)
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((d, size(t)) for d, t, _ in docs)
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], abs=1e-6, rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, s


def test_op3_on_a_whole_table(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    first, again = op3_mixing(spark, SF).collect(), op3_mixing(spark, SF).collect()
    check(first, docs)
    assert sorted(first) == sorted(again)


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_odd_sources_and_texts(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast_rows)
    docs = [(k, "w " * (k % 40 + 1), "big") for k in range(300)] + [(1000, None, None), (1001, "a\x0bb\xa0c", None), (1002, "", "empty"), (1003, "x " * 5000, "ä"), (1004, "a b c", "ß"), (1005, "a b", "z\U0001f600")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, source string, taken int")
    check(mixing.mix(df).collect(), docs)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d", "s")] * 7 + [(2, "a b c", "t")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 9 and len(set(got)) == 2 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    none = mixing.mix(spark.createDataFrame([(None, None, None)] * 2, "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2


def test_the_documents_taken_are_those_with_the_least_keys(spark):
    """Against a sort of each source by key and a sum along it: whole epochs, then whole documents up to the budget, then what is left of it."""
    rows = [(k, ("w " * (k * 7 % 50 + 1)) + "!" * (k % 5), ["big", "big", "small", None][k % 4]) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = {r.doc_id: (r.source, r.size, r.key) for r in mixing.keyed(docs).collect()}
    sizes = defaultdict(int)
    for source, n, _ in keys.values():
        sizes[source] += n
    want = {}
    for source, target in brute_targets(sizes).items():
        own = sorted((k, d, n) for d, (s, n, k) in keys.items() if s == source)
        epochs = int(target // sizes[source])
        left = round(target) - epochs * sizes[source]
        for _, d, n in own:
            part = min(n, max(left, 0))
            want[d], left = epochs * n + part, left - n
    got = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert len(set(k for _, _, k in keys.values())) == 400 and got == want
    copies = defaultdict(int)
    for r in mixing.mixed(docs).collect():
        copies[r.doc_id] += 1
    assert all(abs(copies[d] * keys[d][1] - want[d]) <= keys[d][1] / 2 for d in want)  # the one at a budget's end is rounded


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:04d}": (k * 37 % 100) ** 2 + 1 for k in range(1500)} | {None: 10**6}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert len(got) == len(want) and all(r.target == pytest.approx(want[r.source], rel=1e-9) for r in got)


def test_copies_follow_the_mix(spark):
    docs = spark.createDataFrame([(k, "w " * 10, f"s{k % 3}", "e") for k in range(60)], "doc_id long, text string, source string, epochs string")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 10
    assert all(abs(got[k] - taken[k]) <= 5 for k in taken) and sum(got.values()) == 900


def test_better_documents_come_first(spark):
    docs = spark.createDataFrame([(k, "w " * 10 if k % 2 else "w### " * 10, "s") for k in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, share=0.5).collect()
    good = sum(r.taken for r in got if r.doc_id % 2)
    assert sum(r.taken for r in got) == 10_000 and good > 6500
