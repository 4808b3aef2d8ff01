import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import line_dedup
from chronoweave.llm.queries import op1_line_dedup

SF = "/root/testdata/sf0.001"


def brute_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % line_dedup.PRIME for x in lines]
    r = [((h[i - 1] if i else 0) * line_dedup.FACTOR + h[i]) % line_dedup.PRIME for i in range(len(h))]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        if i == len(lines) - 1 or (i and r[i] < r[i - 1] and r[i] < r[i + 1]):
            out.append(now)
            now = []
    return out


def brute(docs):
    seen, out = {}, []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        kept, gone = [], []
        for n, c in enumerate(brute_chunks(text)):
            key = "\n".join(c)
            again = len(c) > 1 and any(x.strip(" ") for x in c) and seen.setdefault(key, (doc_id, n)) != (doc_id, n)
            (gone if again else kept).append(c)
        out.append((doc_id, "\n".join("\n".join(c) for c in kept), len(kept) + len(gone), len(gone), sum(map(len, gone))))
    return out


def rows(df):
    return sorted((r.doc_id, r.text, r.chunks, r.removed_chunks, r.removed_lines) for r in df.collect())


def test_op1_on_a_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(op1_line_dedup(spark, SF)) == brute(docs)


def test_shared_passages_at_shifted_places(spark):
    r = random.Random(4)
    line = lambda: " ".join(r.choice("abcdefgh") * 3 for _ in range(6))
    passage = [line() for _ in range(30)]
    docs = [(k, "\n".join([*[line() for _ in range(r.randint(0, 9))], *passage, *[line() for _ in range(r.randint(0, 9))]])) for k in range(60)]
    docs += [(100 + k, "\n".join(["same", "same", "", " "] * 5)) for k in range(3)] + [(200, "\n\n\n"), (201, "\n\n\n"), (300, "one line"), (301, "one line")]
    want = brute(docs)
    assert rows(line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"))) == want
    assert sum(w[4] for w in want[:60]) > 59 * 20


def test_odd_rows(spark):
    text = "\n".join(f"line number {k}" for k in range(20))
    docs = spark.createDataFrame([(None, text, 1), (3, text, 2), (3, text, 3), (4, None, 4), (5, "", 5), (6, text, 6)], "doc_id long, text string, removed_chunks int")
    got = {(r.doc_id, r.removed_chunks > 0): r.text for r in line_dedup.deduplicated(docs).collect()}
    assert got[3, False] == text and got[4, False] is None and got[5, False] == "" and (None, True) in got and (6, True) in got
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0
    assert "other" in line_dedup.deduplicated(docs.selectExpr("*", "1 as other")).columns


def test_no_python_in_the_plan(spark):
    plan = op1_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("lines", [["a"] * 5000])
def test_many_equal_lines_are_one_chunk(spark, lines):
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines))], "doc_id long, text string")
    assert [(r.chunks, r.text) for r in line_dedup.deduplicated(df).orderBy("doc_id").collect()] == [(1, "\n".join(lines)), (1, "")]


def test_rows_without_an_id_or_with_a_shared_one_keep_their_own_lines(spark):
    text = lambda k: "\n".join(f"{k} line {j}" for j in range(12))
    docs = [(1, text("a")), (None, text("a")), (None, text("b")), (7, text("a")), (7, text("c"))]
    got = [(r.doc_id, r.text) for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert {(1, text("a")), (None, text("b")), (7, text("c"))} <= set(got)
    assert len(got) == 5 and [t for _, t in got].count(text("a")) == 1


def brute_passages(docs):
    """Lines (document, number) in a run of lines, two with words and 50 words in all, that stands at an earlier place not overlapping it."""
    every = {d: t.split("\n") for d, t in docs}
    seen, gone = {}, set()
    for d in sorted(every):
        lines = every[d]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines)):
                own = lines[a : b + 1]
                if own[0].split() and own[-1].split() and sum(len(x.split()) for x in own) >= 50:
                    first = seen.setdefault(tuple(own), (d, b))
                    if first[0] != d or a > first[1]:
                        gone |= {(d, k) for k in range(a, b + 1)}
    return gone


def test_repeated_passages_go_to_their_edges(spark):
    r = random.Random(8)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passages = [[line(r.choice([3, 12, 27, 40])) for _ in range(r.randint(2, 7))] for _ in range(12)]
    docs = []
    for k in range(50):
        parts = [[line(r.randint(1, 20)) for _ in range(r.randint(0, 3))] + r.choice([[], [""], ["", " "]]) + r.choice(passages) for _ in range(r.randint(1, 3))]
        docs.append((k, "\n".join(x for p in parts for x in p)))
    docs += [(100, "\n".join(["a b c"] * 60)), (101, "x " * 80), (102, "x " * 80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = line_dedup.repeated_passages(df).collect()
    want = brute_passages(docs)
    assert {(s.doc_id, i) for s in spans for p in s.spans for i in range(p.a, p.b + 1)} == want and len(want) > 150
    chunks = {d: t for d, t, *_ in brute(docs)}
    got = {x.doc_id: x.text for x in line_dedup.without_repeats(df).collect()}
    assert set(got) == set(dict(docs)) and got[101].strip() and got[102].strip()
    left = {d: Counter(t.split("\n")) for d, t in chunks.items()}
    assert all(not Counter(got[d].split("\n")) - left[d] or got[d] == "" for d in got)
    assert sum(len(t) for t in got.values()) < sum(len(t) for t in chunks.values())


def test_chunks_whose_hashes_clash_are_told_apart(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    docs += [(10**6 + k, t) for k, (_, t) in enumerate(docs[:20])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    removed = lambda **o: {(r.doc_id, n) for r in line_dedup.repeated_chunks(df, **o).collect() for n in r.removed}
    assert removed(hash_of=lambda c: F.xxhash64(c) % 7) == removed() != set()


def test_sql_keeps_null_texts_as_the_operator_does(spark, tmp_path):
    import duckdb

    docs = spark.createDataFrame([(1, None), (2, "a\nb"), (3, "")], "doc_id long, text string")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, text, chunks, removed_chunks, removed_lines FROM ({line_dedup.SQL})").fetchall())
    assert rows(line_dedup.deduplicated(docs)) == want


def test_a_very_long_text_of_many_lines(spark):
    text = "\n".join(f"line {k % 5000} of a very long text" for k in range(40_000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert rows(line_dedup.deduplicated(df)) == brute([(1, text), (2, text)])
