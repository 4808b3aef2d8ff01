"""Tokens that give back their text, time expressions, and tokens of one tokeniser brought to those of another."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave import scratch
from chronoweave.operators import extract, markup, timegrammar
from chronoweave.plans import texts

DOCS = "doc string, text string"


def test_joined_tokens_are_the_text(spark):
    texts = [
        " \n\nHe wo n't (say) \"that\" he didn't.  She's at 3 p.m. Now!\n\n  They've left\tit \n", "a", "...", "don't can't won't I'd we're o'clock", "Ünïcode ß 日本  x", "1990s 3rd 11/25/1980 14:30 1998-02-13 1998-2000",
        "A.B. Then! \"So?\" 'Yes.' No\r\nline", "x" * 5000,
    ]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)] + [("null", None), ("blank", " \n\t"), ("empty", "")], DOCS)
    toks = extract.token_table(docs)
    assert {r.doc: r.text for r in extract.joined_text(toks).collect()} == {str(k): t for k, t in enumerate(texts)}
    plain = {(r.doc, r.sid, r.idx): r.token for r in extract.tokens(extract.sentences(docs)).collect()}
    rows = toks.collect()
    assert {(r.doc, r.sid, r.idx): r.token for r in rows} == plain
    assert all(texts[int(r.doc)][r.start : r.start + len(r.token)] == r.token for r in rows)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="aB'nt .!?\n\t1-/:é\"(", max_size=40), min_size=1, max_size=20))
def test_any_text_comes_back(spark, texts):
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], DOCS)
    got = {r.doc: r.text for r in extract.joined_text(extract.token_table(docs)).collect()}
    assert got == {str(k): t for k, t in enumerate(texts) if t.strip(" \n\t")}


@pytest.mark.parametrize(("text", "want"), [
    ("It rose in the third quarter of 1998 and on Monday .", [("the third quarter of 1998", "DATE", "1998-Q3"), ("Monday", "DATE", "1998-02-09")]),
    ("In March , three days , 2003 .", [("March", "DATE", "1998-03"), ("three days", "DURATION", "P3D"), ("2003", "DATE", "2003")]),
    ("They march and may fall every Monday or each second week .", [("every Monday", "SET", "XXXX-WXX-1"), ("each second week", "SET", "P2W")]),
    ("On February 30 , on 2/30/98 and 13/13/1998 nothing .", []),
    ("Two and twenty-five years ago , a week ago , early in May 1997 .", [("twenty-five years ago", "DATE", "1973"), ("a week ago", "DATE", "1998-W06"), ("May 1997", "DATE", "1997-05")]),
    ("By 2:30 p.m. or midnight last Friday night .", [("2:30 p.m.", "TIME", "1998-02-13T14:30"), ("midnight", "TIME", "1998-02-13T24:00"), ("last Friday night", "TIME", "1998-02-06TNI")]),
    ("The 1980s , the mid-90s , the year 2000 , 1998-1999 , from 1990 to 1995 .", [("The 1980s", "DATE", "198X"), ("the mid-90s", "DATE", "199X"), ("the year 2000", "DATE", "2000"), ("1998-1999", "DATE", "1998/1999"), ("from 1990 to 1995", "DATE", "1990/1995")]),
])
def test_time_expressions(spark, text, want):
    docs = spark.createDataFrame([("d", text)], DOCS)
    found = extract.tagged_timexes(extract.sentences(docs), spark.createDataFrame([("d", "1998-02-13")], "doc string, value string"))
    assert [(r.text, r.type, r.value) for r in found.orderBy("sid", "idx").collect()] == want


def test_time_expressions_without_a_day_and_without_texts(spark):
    docs = spark.createDataFrame([("d", "Last year , in 1997 and yesterday ."), ("e", None), ("f", "")], DOCS)
    none = spark.createDataFrame([("d", "not a day"), ("e", None)], "doc string, value string")
    rows = extract.tagged_timexes(extract.sentences(docs), none).orderBy("idx").collect()
    assert [(r.id, r.text, r.value) for r in rows] == [("t1", "Last year", None), ("t2", "1997", "1997"), ("t3", "yesterday", None)]
    assert extract.tagged_timexes(extract.sentences(docs.limit(0)), none).count() == 0
    toks = spark.createDataFrame([("d", 0, 7, None), ("d", 0, 8, "May"), ("d", 0, 11, "1998")], "doc string, sid int, idx int, token string")
    assert [(r.idx, r.len, r.value) for r in timegrammar.of_tokens(toks, none).collect()] == [(8, 2, "1998-05")]


def test_spans_move_to_other_tokens(spark):
    """Cuts differ, characters don't: a span gets the foreign tokens that it touches, whatever they are numbered and however sentences are cut."""
    text = 'He said "it\'s a three-day trip (cheap)". Then 1998.'
    docs = spark.createDataFrame([("d", text), ("bad", "a b c")], DOCS)
    own = extract.tokens(extract.sentences(docs))
    foreign = [("He", 0, 0), ("said", 0, 5), ("``", 0, 6), ("it", 0, 7), ("'s", 0, 8), ("a", 0, 9), ("three-day", 0, 10), ("trip", 0, 11), ("-LRB-", 0, 12), ("cheap", 0, 13), ("-RRB-", 0, 14), ("''", 0, 15), (".", 0, 16), ("Then", 3, 1), ("1998.", 3, 2)]
    other = spark.createDataFrame([("d", s, k, t) for t, s, k in foreign] + [("bad", 0, 1, "a"), ("bad", 0, 2, "bcc")], "doc string, sid int, idx int, token string")
    at = {(r.sid, r.token): r.idx for r in own.where("doc = 'd'").collect()}
    spans = [("d", 0, at[0, "three"], 3, "P3D"), ("d", 0, at[0, "("], 3, "cheap"), ("d", 1, at[1, "1998"], 1, "1998"), ("d", 0, at[0, "trip"], 0, "none long"), ("bad", 0, 2, 1, "lost")]
    got = extract.aligned(spark.createDataFrame(spans, "doc string, sid int, idx int, len int, what string"), own, other)
    assert {(r.what, r.sid, r.idx, r.len) for r in got.collect()} == {("P3D", 0, 10, 1), ("cheap", 0, 12, 3), ("1998", 3, 2, 1), ("none long", 0, 11, 1)}
    assert [tuple(r) for r in extract.misaligned(own, other).collect()] == [("bad", 3, 4)]
    assert extract.aligned(got.limit(0), own, other).count() == 0


def test_documents_whose_characters_differ_use_the_taggers_words(spark):
    docs = spark.createDataFrame([("d", "He left in May 1998 .")], DOCS)
    tagged = spark.createDataFrame([("d", 0, k, w, "X") for k, w in enumerate(["He", "has", "left", "May", "1998"], 1)], "doc string, sid int, idx int, token string, pos string")
    times = markup.times_of(docs, tagged, docs.select("doc", F.lit("1999-01-01").alias("value"))).collect()
    assert [(r.sid, r.idx, r.len, r.value) for r in times] == [(0, 4, 2, "1998-05")]


@pytest.mark.parametrize("query", [texts.c08_events_and_times_of_texts, texts.r01_adjacent_verb_and_time])
def test_no_table_of_tokens_or_places_goes_to_the_driver(spark, monkeypatch, query):
    """Tables of tokens look small by their files, and many are made of few rows of events: none is gathered in the driver to be sent to every task."""
    plans, written = [], scratch.written
    show = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(scratch, "written", lambda df, tag="step": plans.append(show(df)) or written(df, tag))
    plans.append(show(query(spark, "/root/testdata/sf0.001")))
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
