import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import collocations as col
from chronoweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)) if (w := re.findall(r"[^\x20\x09]+", p))]


def by_hand(rows):
    """rows (text, lang) to (lang, rank, phrase, a, l, r, n, score), by the definition."""
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            total[lang] += len(w)
            for n in range(1, 5):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= 30}
        longest = Counter()
        for p, a in often.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longest[p[i : i + n]] = max(longest[p[i : i + n]], a)
        found = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longest[p] < 80 * a:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, r, total[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:2000], 1)]
    return sorted(out)


def check(spark, rows):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, col.collocations(docs).collect())) == by_hand(rows)


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Many blocks and ranges on a small table, as on a large one."""
    monkeypatch.setattr(col, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(col, "RANGE_BYTES", 1500)


def made(seed, n, words):
    rng = random.Random(seed)
    return [(" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n", "\t", "\x0c"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "fr"])) for _ in range(n)]


def test_equals_brute_force(spark, tiny_blocks):
    check(spark, made(1, 300, ["a", "B", "the", "The", "é", "zu", "x y", "of", "ß", "z"]))


def test_hot_words_and_pairs_take_many_ranges(spark, tiny_blocks):
    """A pair that a third of all words belong to, and a text of one word only."""
    words = ["hot pair"] * 4 + [f"w{i}" for i in range(8)]
    check(spark, [*made(2, 300, words), ("same " * 9000, "en")])


def test_odd_tables(spark):
    rows = [(None, "en"), ("", None), (" \t ", "en"), (".,;:!?\n\x0b\r", "en"), ("Word", "en"), ("A  b\tC", None)]
    check(spark, rows)
    check(spark, rows * 40)
    clash = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows * 40)], SCHEMA)
    clash = clash.withColumns({c: F.lit("own") for c in ("phrase", "n", "size", "rank", "a", "l", "r", "score", "part", "body")})
    assert sorted(map(tuple, col.collocations(clash).collect())) == by_hand(rows * 40)
    assert col.collocations(clash.limit(0)).count() == 0
    assert col.collocations(clash.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_very_long_words_and_texts(spark, tiny_blocks):
    long = "q" * 200_000
    check(spark, [(f"{long} end " * 35, "en"), ("x y z. " * 20_000, "en")])


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**18
    rows = [("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big - 7), ("en", "", 0, big)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, size int, n long")
    (r,) = col.scored(counted).collect()
    assert (r.a, r.l, r.r, r.score) == (big, big, big - 7, 2_000_000 * big // (2 * big - 7))


def test_cover_is_exact_at_its_edge(spark):
    rows = [("en", "a b c", 3, 80), ("en", "a b", 2, 100), ("en", "b c", 2, 101), ("en", "a", 1, 200), ("en", "b", 1, 200), ("en", "c", 1, 200)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, size int, n long")
    kept = {r.phrase for r in col.uncovered(col.scored(counted), counted).collect()}
    assert kept == {"a b c", "b c"}


def test_the_stack_counts_all_prefixes():
    rng = random.Random(3)
    for _ in range(200):
        suffixes = sorted({tuple(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 40))}, reverse=True)
        counts = [rng.randrange(1, 9) for _ in suffixes]
        shared = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        want = Counter()
        for s, n in zip(suffixes, counts, strict=True):
            for k in range(1, len(s) + 1):
                want[s[:k]] += n
        edges = {s[:k] for s in (suffixes[0], suffixes[-1]) for k in range(1, len(s) + 1)}
        got = {suffixes[i][:k]: n for i, k, n in col.prefixes(shared, [len(s) for s in suffixes], counts, 10)}
        assert got == {p: n for p, n in want.items() if n >= 10 or p in edges}


def test_packs_come_back_as_they_were():
    rng = random.Random(4)
    text = " ".join(rng.choice(["über", "a", "bb", "ccc."]) for _ in range(500)).encode()
    vocabulary, columns, counts = col.suffixes_of([text])
    words, places, n = col._unpack(*col._pack(vocabulary, columns, counts))
    assert words.to_pylist() == vocabulary.to_pylist() and n.tolist() == counts.tolist()
    assert all(np.array_equal(a, b) for a, b in zip(places, columns, strict=True))


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(col.SQL)
    got = QUERIES["op12_collocations"](spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
