from pyspark.sql import functions as F

from chronoweave import __main__ as cli
from chronoweave import scratch
from chronoweave.functions import text
from chronoweave.sources import annotations, timeml
from chronoweave.streaming import documents


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(path).collect())


def test_text_sinks(spark, tmp_path):
    p = str(tmp_path)
    rows = spark.createDataFrame([("d", "e1", "e2", "b", 0, ["x:1", "y:2"]), ("d", "e2", "t1", None, 1, ["x:3"])], "doc string, id1 string, id2 string, label string, ordinal int, features array<string>")
    annotations.write_features_with_pairs(rows.where("label IS NOT NULL"), f"{p}/f")
    assert lines(spark, f"{p}/f/features") == ["d\tb\tx:1\ty:2"] and lines(spark, f"{p}/f/debug") == ["d\te1\te2\tb\tx:1\ty:2"]
    assert [(r.doc, r.label, r.features) for r in annotations.features(spark, f"{p}/f/features").collect()] == [("d", "b", ["x:1", "y:2"])]
    annotations.write_progress(rows, f"{p}/p")
    assert lines(spark, f"{p}/p") == ["0\te1\te2\tb", "1\te2\tt1\t"]
    toks = spark.createDataFrame([("d", 0, 2, "b"), ("d", 0, 1, "a"), ("d", 1, 1, "c")], "doc string, sid int, idx int, token string")
    annotations.write_sentences(toks, f"{p}/s")
    assert lines(spark, f"{p}/s") == ["a b", "c"]
    annotations.write_annotations(rows.where("label IS NOT NULL"), f"{p}/a")
    annotations.write_statistics(spark.createDataFrame([("s", 1)], "sieve string, n int"), f"{p}/st")
    annotations.write_counts(spark.createDataFrame([("k", 3)], "key string, n long"), f"{p}/c")
    annotations.write_events(spark.createDataFrame([(0, 2, "ran", "OCCURRENCE", "PAST")], "sid int, idx int, text string, cls string, tense string"), f"{p}/e")
    assert (lines(spark, f"{p}/a"), lines(spark, f"{p}/c"), lines(spark, f"{p}/e")) == (["e1\te2\tb"], ["k\t3"], ["0\t1\tran\tOCCURRENCE\tPAST"])
    annotations.write_attribute_relation(rows.where("label IS NOT NULL"), f"{p}/w")
    assert lines(spark, f"{p}/w/data") == ["1,2,b"] and "@attribute x string" in lines(spark, f"{p}/w/header")
    annotations.lines_as_files(spark.createDataFrame([("d", "one")], "doc string, value string"), f"{p}/l")
    assert lines(spark, f"{p}/l") == ["<text>one</text>"]


def test_time_markup_is_written_as_it_is_read(spark, tmp_path):
    docs = spark.createDataFrame([("a", "t0", "1998-02-13", 'He <EVENT eid="e1" class="REPORTING">said</EVENT> so.')], "doc string, dct_id string, dct_value string, markup string")
    evs = spark.createDataFrame([("a", "ei1", "e1", "PAST", "NONE")], "doc string, id string, eid string, tense string, aspect string")
    links = spark.createDataFrame([("a", "ei1", "t0", "IS_INCLUDED")], "doc string, id1 string, id2 string, relation string")
    xml = timeml.written(docs, evs, links)
    assert [(r.id, r.tense) for r in timeml.events(xml).collect()] == [("ei1", "PAST")]
    assert [(r.id1, r.id2, r.relation, r.link_type) for r in timeml.links(xml).collect()] == [("ei1", "t0", "IS_INCLUDED", "et")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tml").write_text(xml.first().xml)
    cli.main(["timeml", str(tmp_path / "in"), str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_commands(spark, tmp_path):
    """From plain texts and tagged tokens to marked texts and links, and what is wrong in a folder of markup."""
    p = str(tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("He didn't leave on 1998-02-13.")
    tagged = [("a", 0, k + 1, *w.split("/")) for k, w in enumerate("He/PRP did/VBD n't/RB leave/VB on/IN 1998-02-13/CD ./.".split())]
    spark.createDataFrame(tagged, "doc string, sid int, idx int, token string, pos string").write.parquet(f"{p}/tagged")
    cli.main(["markup", f"{p}/in", f"{p}/marked", "--tagged", f"{p}/tagged"])
    want = 'He <EVENT eid="e1" tense="PAST" aspect="NONE" class="OCCURRENCE">did</EVENT>n\'t <EVENT eid="e2" tense="PRESENT" aspect="NONE" class="OCCURRENCE">leave</EVENT> on <TIMEX3 tid="t1" type="DATE" value="1998-02-13">1998-02-13</TIMEX3>.'
    got = spark.read.parquet(f"{p}/marked").first().markup
    assert got.replace("PAST", "PRESENT") == want.replace("PAST", "PRESENT")
    cli.main(["raw", f"{p}/in", f"{p}/links", "--tagged", f"{p}/tagged", "--sieves", "adjacent_verb_timex"])
    assert [(r.id1, r.id2, r.relation) for r in spark.read.parquet(f"{p}/links").collect()] == [("ei2", "t1", "IS_INCLUDED")]
    cli.main(["tokens", f"{p}/in", f"{p}/tokens"])
    assert lines(spark, f"{p}/tokens") == ["He did n't leave on 1998-02-13 ."]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.tml").write_text("<TimeML>")
    cli.main(["problems", f"{p}/bad", f"{p}/problems"])
    assert [(r.doc, r.problem) for r in spark.read.parquet(f"{p}/problems").collect()] == [("b", "not well-formed")]


def test_outside_taggers(spark):
    toks = spark.createDataFrame([("d", 0, 2, "b"), ("d", 0, 1, "a"), ("d", 1, 1, "c")], "doc string, sid int, idx int, token string")
    got = annotations.tagged_by(toks, ["tr", "a-z", "A-Z"]).collect()
    assert {(r.sid, r.idx, r.token, r.tag) for r in got} == {(0, 1, "a", "A"), (0, 2, "b", "B"), (1, 1, "c", "C")}


def test_documents_as_a_stream(spark, tmp_path):
    spark.createDataFrame([("d", "One two. Three.")], "doc string, text string").write.parquet(str(tmp_path / "in"))
    stream = documents.documents(spark, str(tmp_path / "in"), "doc string, text string")
    documents.each_batch(stream, documents.tokens, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("batch = 0").count() == 5
    assert documents.windowed_counts(stream.withColumn("ts", F.current_timestamp()), "ts", "doc").isStreaming


def test_numbers_follow_the_order_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    assert [(r.x, r.number) for r in scratch.numbered(df, "x").orderBy("x").collect()] == [(k, k) for k in range(1000)]
    assert scratch.numbered(df.limit(0), "x").count() == 0
    r = spark.range(1).select(text.trailing_space(F.lit("a b \n")), text.shown(F.array(*map(F.lit, "abc")), 2)).first()
    assert tuple(r) == (" \n", "a b")
