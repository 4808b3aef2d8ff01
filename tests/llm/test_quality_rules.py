import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import quality_rules as rules
from chronoweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string"


def by_hand(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    places = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(places),
    }


def exact_tail(n, k, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_statistics_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n\x0b", "a", "a b c", "a b c a b c", "x x x x x", "é ü z # |", "one\n\none\n one\ntwo\ntwo\n\t", "a b c\x0ca b c A\rB"]
    texts += [" ".join(rng.choice("ab cd\n\t#|") for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += [" ".join(rng.choice(["der", "die", "das\n", "und"]) for _ in range(20_000))]  # a very long text
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.s for r in rules.with_statistics(docs, "s").collect()}
    for i, t in enumerate(texts):
        assert {k: got[i][k] for k in rules.COUNTS} == by_hand(t), repr((t or "")[:80])


@pytest.mark.parametrize("p", [0.05, 0.01, 0.3])
def test_binomial_tail_is_exact(spark, p):
    cases = [(n, k) for n in (1, 2, 10, 59, 86, 400, 2000) for k in {0, 1, int(n * p / 2), int(n * p)} if k <= n]
    rows = spark.createDataFrame(cases, "n long, k long").withColumn("p", rules.binomial_tail(F.col("n"), F.col("k"), p)).collect()
    for r in rows:
        assert r.p == (pytest.approx(exact_tail(r.n, r.k, p), rel=1e-9) if r.k < r.n * p else 1.0)


def test_binomial_tail_of_many_rows(spark):
    """Beyond TERMS the sum is bounded from above: never too small, and close."""
    n, p = 10**9, 0.05
    k = int(n * p - 3 * math.sqrt(n * p * (1 - p)))
    got = spark.createDataFrame([(n, k)], "n long, k long").select(rules.binomial_tail(F.col("n"), F.col("k"), p)).head()[0]
    assert got == pytest.approx(0.5 * math.erfc(3 / math.sqrt(2)), rel=0.01)


def labelled(spark, rows):
    """rows: doc_id, stratum, clean, symbols (words: 1,000)."""
    stats = "struct(1000L as n_words, 5000L as word_chars, n as n_symbols, 0L as n_dup_lines, 0L as n_repeat_words, 10L as n_lines, 0L as capitals) as stats"
    df = spark.createDataFrame(rows, "doc_id long, stratum string, clean int, n long")
    return df.selectExpr("doc_id", "stratum", stats), df.selectExpr("doc_id", "clean as quality")


def test_no_stratum_without_evidence_gets_cutoffs(spark):
    """Few labels or labels of one kind certify nothing; enough evidence does, within the bound even where both kinds look alike."""
    rng, rows, i = random.Random(1), [], 0
    for stratum, clean, other, alike in (("much", 3000, 300, False), ("few", 40, 40, False), ("none", 0, 50, False), ("one kind", 500, 0, False), ("alike", 2000, 2000, True)):
        for quality, n in ((1, clean), (0, other)):
            for _ in range(n):
                rows.append((i, stratum, quality, rng.randrange(400) if alike else rng.randrange(20) + 300 * (quality == 0)))
                i += 1
    found = {r.stratum: r for r in rules.fit(*labelled(spark, rows)).collect()}
    assert found["much"].cuts.symbols is not None and found["much"].cuts.capitals is None
    assert 4 * exact_tail(found["much"].n_clean, found["much"].rejected, rules.ALPHA) <= rules.DELTA
    assert found["much"].p_value == pytest.approx(exact_tail(found["much"].n_clean, found["much"].rejected, rules.ALPHA))
    assert found["much"].caught == found["much"].n_other
    assert "few" not in found or found["few"].cuts is None
    assert found["alike"].cuts is None or 4 * exact_tail(found["alike"].n_clean, found["alike"].rejected, rules.ALPHA) <= rules.DELTA
    assert "none" not in found or found["none"].cuts is None
    assert "one kind" not in found or found["one kind"].cuts is None


def test_false_rejection_stays_limited(spark):
    """Over 150 strata whose true risk at each cutoff is known, no more than a share of DELTA or so exceed ALPHA of clean documents."""
    rng, rows, i = random.Random(11), [], 0
    for s in range(150):
        for quality, n, high in ((1, 450, 1000), (0, 150, 1600)):
            for _ in range(n):
                rows.append((i, f"s{s}", quality, rng.randrange(high)))
                i += 1
    found = [r for r in rules.fit(*labelled(spark, rows)).collect() if r.cuts is not None and r.cuts.symbols is not None]
    risk = [(999 - r.cuts.symbols) / 1000 for r in found]  # of a clean document, uniform over 0 .. 999
    assert found and sum(x > rules.ALPHA for x in risk) <= 2


def test_odd_tables(spark):
    long = "word " * 300_000
    rows = [(None, None, None), (1, "", "en"), (1, "", "en"), (2, long, None), (3, "a b c", "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"stats": F.lit(1), "verdict": F.lit("own"), "stratum": F.lit("x"), "quality": F.lit(0), "kept": F.lit("k")})
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (7, 1)], "doc_id long, quality int")
    out = rules.judged(docs, labels, name="v")
    assert out.columns == [*docs.columns, "v"]
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.v.n_words for r in got] == [0, 0, 300_000, 3, 0]
    assert all(r.v.base_failed and not r.v.kept and r.verdict == "own" for r in got)
    assert got[2].v.n_repeat_words == 300_000
    assert rules.kept(docs, labels).columns == docs.columns and rules.kept(docs, labels).count() == 0
    assert rules.judged(docs.limit(0), labels).count() == 0
    assert rules.judged(docs, labels.limit(0)).count() == 5


def test_kept_rows_keep_their_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", 3), (2, "short", "en", 4)], SCHEMA + ", verdict int")
    assert [tuple(r) for r in rules.kept(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()] == [(1, text, "en", 3)]


def test_query_equals_its_sql_and_keeps_clean_documents(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(rules.SQL)
    out = QUERIES["op11_quality_rules"](spark, SF).toPandas()
    assert list(out.columns) == list(want.columns)
    assert sorted(map(tuple, out.itertuples(index=False))) == sorted(want.fetchall())
    label = dict(con.sql("SELECT doc_id, quality FROM labels").fetchall())
    passed = out[~out.base_failed & out.doc_id.isin(label)]
    quality = passed.doc_id.map(label)
    assert passed.kept[quality == 1].mean() >= 1 - rules.ALPHA
    assert passed.kept[quality == 0].mean() <= 0.3
