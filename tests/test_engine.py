import random

import pytest
from pyspark.sql import functions as F

from chronoweave import scratch
from chronoweave.functions import maths, relations, text
from chronoweave.functions import timex as tx
from chronoweave.operators import cascade, closure, evaluate, extract, graphs, learned, pairs, sieves
from chronoweave.sources import annotations, config, infofile, timeml

CHAIN = [("e1", "e2", "BEFORE"), ("e3", "e7", "SIMULTANEOUS"), ("e2", "e3", "INCLUDES"), ("e3", "e4", "AFTER"), ("e5", "e3", "IS_INCLUDED"), ("e10", "e11", "SIMULTANEOUS"), ("e12", "e11", "SIMULTANEOUS")]
FOLLOWS = [
    ("e1", "e3", "BEFORE"), ("e1", "e5", "BEFORE"), ("e1", "e7", "BEFORE"), ("e4", "e5", "BEFORE"), ("e4", "e7", "BEFORE"), ("e2", "e5", "INCLUDES"), ("e2", "e7", "INCLUDES"),
    ("e7", "e5", "INCLUDES"), ("e10", "e12", "SIMULTANEOUS"),
]
TURN = dict(relations.INVERSE_PAIRS) | {b: a for a, b in relations.INVERSE_PAIRS}


def key(a, b, r):
    return (a, b, r) if a < b else (b, a, TURN.get(r, r))


@pytest.mark.parametrize("in_order", [False, True])
def test_closure_of_the_known_chain(spark, in_order):
    links = spark.createDataFrame([("d", k, *x) for k, x in enumerate(CHAIN)], "doc string, ordinal int, id1 string, id2 string, relation string")
    rows = (closure.closure_in_order if in_order else closure.closure)(links).collect()
    assert {key(r.id1, r.id2, r.relation) for r in rows if r.closed} == {key(*x) for x in FOLLOWS}
    assert {key(r.id1, r.id2, r.relation) for r in rows if not r.closed} == {key(*x) for x in CHAIN} and len(rows) == 16


def test_composition_keeps_the_converse_law():
    table = {(a, b): c for a, b, c in relations.COMPOSITION}
    assert len(table) == 17
    for (a, b), c in table.items():
        assert table[TURN.get(b, b), TURN.get(a, a)] == TURN.get(c, c)


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(*columns).first()


def test_time_values(spark):
    rows = {
        "1998": ("1998-02-01 00:00:00", "1998-12-28 23:59:59"), "199": ("1990-02-01 00:00:00", "1999-12-28 23:59:59"), "1998-03": ("1998-03-01 00:00:00", "1998-03-28 23:59:59"),
        "1998-02-13": ("1998-02-13 00:00:00", "1998-02-13 23:59:59"), "1998-02-13T14:30": ("1998-02-13 14:30:00", "1998-02-13 14:30:59"), "1998-02-13TEV": ("1998-02-13 16:00:00", "1998-02-13 19:59:59"),
        "1998-W07": ("1998-02-01 00:00:00", "1998-02-28 23:59:59"), "1998-SU": ("1998-06-21 00:00:00", "1998-09-21 23:59:59"), "1998-WI": ("1998-12-21 00:00:00", "1998-03-19 23:59:59"),
        "1998-H1": ("1998-01-01 00:00:00", "1998-06-28 23:59:59"), "1998-Q3": ("1998-07-01 00:00:00", "1998-09-28 23:59:59"), "PAST_REF": (None, None), "P3D": (None, None), "T10:00": (None, None),
    }
    df = spark.createDataFrame([(v,) for v in rows], "value string")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    s, fixed = tx.span(F.col("value")), tx.span(F.col("value"), compat=False)
    got = {r.value: r for r in df.select("value", show(s.low).alias("low"), show(s.high).alias("high"), show(fixed.low).alias("f"), show(fixed.high).alias("g")).collect()}
    assert {v: (r.low, r.high) for v, r in got.items()} == rows
    assert (got["1998"].f, got["1998"].g) == ("1998-01-01 00:00:00", "1998-12-31 23:59:59") and got["1998-WI"].g == "1999-03-19 23:59:59"


def test_order_of_time_values(spark):
    cases = [
        ("1998", "1999", "BEFORE"), ("1999", "1998", "AFTER"), ("1998", "1998", "SIMULTANEOUS"), ("1998", "1998-03", "INCLUDES"), ("1998-03-05", "1998-03", "IS_INCLUDED"), ("PAST_REF", "1998", "BEFORE"),
        ("1998", "PAST_REF", "AFTER"), ("PRESENT_REF", "1998", None), ("P3D", "1998", None), ("FUTURE_REF", "PAST_REF", "AFTER"),
    ]
    df = spark.createDataFrame(cases, "a string, b string, want string").withColumn("got", tx.ordered_values(F.lit("DATE"), F.col("a"), F.lit("DATE"), F.col("b")))
    assert [r for r in df.collect() if r.want != r.got] == []
    r = one(spark, tx.earlier(F.col("a"), F.col("b")), tx.includes(F.col("c"), F.col("a")), tx.known_relation(F.col("b"), F.col("a")), tx.to_day(F.lit("1998-02-13T10:00")), a="1998-02-13", b="1998-03-01", c="1998-02")
    assert tuple(r) == (True, True, "AFTER", "1998-02-13")


def test_relation_names(spark):
    df = spark.createDataFrame([(r,) for r in relations.RELATIONS], "r string")
    assert all(row[0] == row[1] for row in df.select("r", relations.inverted(relations.inverted(F.col("r")))).collect())
    r = one(spark, relations.normalised(F.lit("during")), relations.normalised(F.lit("is-included")), relations.normalised(F.lit("x")), relations.link_type(F.lit("t1"), F.lit("ei2")), relations.expanded_label(F.lit("ii")))
    assert tuple(r) == ("IS_INCLUDED", "IS_INCLUDED", None, "et", "IS_INCLUDED")
    r = one(spark, *[relations.status(F.lit(a), F.lit(b)) for a, b in ((None, "BEFORE"), ("BEFORE", "IBEFORE"), ("BEFORE", "AFTER"))])
    assert tuple(r) == (0, 1, 2)


def test_words_and_numbers(spark):
    enc = text.encoded_token(F.lit(" "), F.lit('a"b\\'), F.lit(""))
    r = one(spark, text.decoded_token(enc), text.without_punctuation(F.lit("..a-b!")), text.without_determiner(F.lit("The old man")), text.is_number(F.lit("12.5")), text.is_modal(F.lit("Would")), maths.choose(F.lit(5), F.lit(2)), text.grammatical_group(F.lit("nsubjpass")))
    assert tuple(r) == ((" ", 'a"b\\', ""), "a-b", "old man", True, True, 10, "subj")


EVENTS = [
    ("d", 0, 2, "ei1", "said", "VBD", "PAST", "NONE", "REPORTING"), ("d", 0, 5, "ei2", "left", "VBN", "PAST", "PERFECTIVE", "OCCURRENCE"), ("d", 1, 3, "ei3", "will", "VB", "FUTURE", "NONE", "OCCURRENCE"),
    ("d", 1, 6, "ei4", "talks", "NNS", "NONE", "NONE", "OCCURRENCE"),
]
TIMEXES = [("d", 0, 7, 1, "t1", "1998-02-12", "DATE", "1998-02-12"), ("d", 1, 8, 1, "t2", "today", "DATE", "1998-02-13")]


@pytest.fixture(scope="module")
def corpus(spark):
    words = "Officials said they had left on Thursday".split(), "He now will see the talks of today".split()
    tags = "NNS VBD PRP VBD VBN IN NNP".split(), "PRP RB VB VB DT NNS IN NN".split()
    toks = [("d", s, k + 1, w, tags[s][k]) for s in (0, 1) for k, w in enumerate(words[s])]
    deps = [("d", 0, "ccomp", 2, 5, "left"), ("d", 0, "prep_on", 5, 7, "Thursday"), ("d", 1, "dobj", 3, 6, "talks"), ("d", 1, "nn", 6, 8, "today")]
    return cascade.Corpus(
        events=spark.createDataFrame(EVENTS, "doc string, sid int, idx int, id string, text string, pos string, tense string, aspect string, cls string"),
        timexes=spark.createDataFrame(TIMEXES, "doc string, sid int, idx int, len int, id string, text string, type string, value string"),
        dcts=spark.createDataFrame([("d", "t0", "1998-02-13")], "doc string, id string, value string"),
        deps=spark.createDataFrame(deps, "doc string, sid int, reln string, gov_idx int, dep_idx int, dep string"),
        tokens=spark.createDataFrame(toks, "doc string, sid int, idx int, token string, pos string"),
        spans=spark.createDataFrame([("d", 0, 2, 2, 8)], "doc string, sid int, idx int, span_start int, span_end int"),
        clusters=spark.createDataFrame([("d", "c", "ei1"), ("d", "c", "ei3")], "doc string, cluster string, id string"),
        synsets=spark.createDataFrame([("d", "ei1", "say", ["s1"]), ("d", "ei2", "leave", ["s2"]), ("d", "ei3", "say", ["s3"]), ("d", "ei4", "talk", ["s4"]), ("d", "t1", "a", []), ("d", "t2", "a", [])], "doc string, id string, lemma string, synsets array<string>"),
    )


def made(df):
    return {(r.id1, r.id2, r.relation) for r in df.collect()}


def test_rule_sieves(corpus):
    c = corpus
    assert made(sieves.adjacent_verb_timex(c)) == {("ei2", "t1", "IS_INCLUDED")}
    assert made(sieves.time_time(c)) == {("t1", "t2", "BEFORE"), ("t0", "t1", "AFTER"), ("t0", "t2", "SIMULTANEOUS")}
    assert made(sieves.reporting_governs(c)) == {("ei1", "ei2", "AFTER")}
    assert made(sieves.intended_governs(c)) == set()
    assert made(sieves.reichenbach(c)) == {("ei1", "ei2", "AFTER"), ("ei1", "ei3", "BEFORE"), ("ei2", "ei3", "BEFORE")}
    assert made(sieves.clause_dependency(c)) == {("ei1", "ei2", "AFTER"), ("ei3", "ei4", "BEFORE")} - {("ei3", "ei4", "BEFORE")}
    assert made(sieves.same_sense(c)) == {("ei1", "ei3", "VAGUE"), ("t1", "t2", "SIMULTANEOUS")}
    assert made(sieves.event_creation_time(c)) == {("ei1", "t0", "IS_INCLUDED"), ("ei2", "t0", "BEFORE")}
    assert made(sieves.said_at_creation_time(c)) == {("ei1", "t0", "IS_INCLUDED")}
    assert made(sieves.coreferent(c)) == {("ei1", "ei3", "SIMULTANEOUS")}
    assert made(sieves.nominal(c)) == {("ei4", "t2", "IS_INCLUDED")}
    assert made(sieves.reporting_on_creation_day(c, left=1, right=1)) == {("ei1", "t2", "IS_INCLUDED")}
    assert made(sieves.text_order(c)) == {("ei1", "ei2", "BEFORE"), ("ei3", "ei4", "BEFORE")}
    assert made(sieves.same_tense_order(c)) == {("ei1", "ei2", "BEFORE")} and made(sieves.same_tense_order(c, compat=False)) == set()
    assert made(sieves.before_word(c)) == made(sieves.state_governs_state(c)) == made(sieves.reporting_before_quarter(c)) == made(sieves.same_tense_vague(c)) == set()
    assert len(made(sieves.all_vague(c))) == 6 + 8 + 1 + 6 and sieves.dependency_report(c).count() == 2
    both = pairs.same_or_next(c.events)
    gold = sieves.all_vague(c)
    learned_patterns = sieves.learn_vague_patterns(both, gold, least=1)
    assert len(made(sieves.frequent_vague(c, learned_patterns))) == 6


def test_cascade_and_scores(spark, corpus):
    names = sieves.load(["time_time", "reichenbach", "nothing", "all_vague"])
    assert [n for n, _ in names] == ["time_time", "reichenbach", "all_vague"]
    out = cascade.run(corpus, names)
    rows = {(r.id1, r.id2): r for r in out.collect()}
    assert len({frozenset(k) for k in rows}) == len(rows) == 21 and rows["ei1", "ei2"].origin == "reichenbach"
    gold = spark.createDataFrame([("d", "ei2", "ei1", "BEFORE"), ("d", "t1", "t2", "AFTER")], "doc string, id1 string, id2 string, relation string")
    best = cascade.gauntlet(corpus, names, gold).collect()
    assert [(r.sieve, r.correct, r.incorrect) for r in best] == [("reichenbach", 1, 0), ("all_vague", 0, 2), ("time_time", 0, 1)]
    stats = {r.sieve: r for r in cascade.statistics(out, cascade.proposals(corpus, names), gold).collect()}
    assert stats["all_vague"].removed > 0 and stats["reichenbach"].precision_open == 1.0
    score = evaluate.scores(evaluate.compared(out, gold), []).first()
    assert (score.correct, score.incorrect, score.missed) == (1, 1, 0)
    assert cascade.first_wins(cascade.proposals(corpus, names)).count() == 21


def test_closure_is_idempotent_and_blind_to_order(spark):
    r = random.Random(2)
    links = []
    for d in range(4):
        times = {f"e{k}": (a := r.randint(0, 8), a + r.randint(1, 3)) for k in range(9)}
        for a, b in [r.sample(sorted(times), 2) for _ in range(12)]:
            x, y = times[a], times[b]
            rel = "SIMULTANEOUS" if x == y else "BEFORE" if x[1] <= y[0] else "AFTER" if y[1] <= x[0] else "INCLUDES" if x[0] <= y[0] and x[1] >= y[1] else "IS_INCLUDED" if x[0] >= y[0] and x[1] <= y[1] else None
            if rel:
                links.append((f"d{d}", a, b, rel))
    schema = "doc string, id1 string, id2 string, relation string"
    once = closure.closure(spark.createDataFrame(links, schema))
    a = {(x.doc, *key(x.id1, x.id2, x.relation)) for x in once.collect()}
    again = {(x.doc, *key(x.id1, x.id2, x.relation)) for x in closure.closure(once).collect()}
    ordered = closure.closure_in_order(spark.createDataFrame([(*x, k) for k, x in enumerate(links)], schema + ", ordinal int"))
    assert a == again == {(x.doc, *key(x.id1, x.id2, x.relation)) for x in ordered.collect()}


def noisy(seed, docs, nodes, n):
    r = random.Random(seed)
    names = ["BEFORE", "AFTER", "INCLUDES", "IS_INCLUDED", "SIMULTANEOUS", "VAGUE"]
    return [(f"d{d}", f"e{a}", f"e{b}", r.choice(names), k) for d in range(docs) for k in range(n) for a, b in [r.sample(range(nodes), 2)]]


def test_stamps_give_the_closure_in_order(spark):
    """Noisy links, where many pairs can be derived with several relations: the same links, in the same direction, by both ways."""
    more = [("x" + d, *rest) for d, *rest in noisy(6, 1, 60, 70)]
    links = spark.createDataFrame(noisy(5, 3, 24, 40) + more, "doc string, id1 string, id2 string, relation string, ordinal int")
    by = lambda df: {tuple(r) for r in df.select("doc", "id1", "id2", "relation", "closed").collect()}
    assert by(closure.closure_by_stamps(links)) == by(closure.closure_in_order(links))
    assert closure.closure_by_stamps(links.limit(0)).count() == 0


def test_closure_goes_on_from_a_closed_base(spark, tmp_path):
    """Links that come in three lots, each closed over what is there: all that follows, and only new rows are written."""
    schema = "doc string, id1 string, id2 string, relation string"
    chain = [("d", f"e{k}", f"e{k + 1}", "BEFORE") for k in range(12)]
    tables, lots = [], [chain[0::3], chain[1::3], chain[2::3]]
    for lot in lots:
        new = scratch.written(spark.createDataFrame(lot, schema))
        tables += [new, *closure.extended(tables, new)]
    rows = [tuple(r) for t in tables for r in t.select("doc", "id1", "id2").collect()]
    assert len(rows) == len({(d, *sorted((a, b))) for d, a, b in rows}) == 13 * 12 // 2


def test_extraction(spark):
    docs = spark.createDataFrame([("d", "Libya brought the case in 2003 to Britain because of 11/25/1980 and complained.")], "doc string, text string")
    sents = extract.sentences(docs)
    times = extract.tagged_timexes(sents, spark.createDataFrame([("d", "2004-01-05")], "doc string, value string")).orderBy("idx").collect()
    assert sents.count() == 1 and [(t.idx, t.text, t.value, t.id) for t in times] == [(6, "2003", "2003", "t1"), (11, "11/25/1980", "1980-11-25", "t2")]
    toks = extract.tokens(sents)
    assert toks.count() == 14 and "PRE1_libya" in toks.transform(extract.ngram_features).where("idx = 2").first().features
    tagged = spark.createDataFrame([("d", 0, k + 1, w, p) for k, (w, p) in enumerate([("He", "PRP"), ("will", "MD"), ("go", "VB"), (",", ","), ("had", "VBD"), ("gone", "VBN"), ("is", "VBZ")])], "doc string, sid int, idx int, token string, pos string")
    assert {r.idx: r.tense for r in extract.group_tense(tagged).collect()} == {3: "FUTURE", 5: "PAST", 6: "PAST", 7: "PAST"}
    assert [r.idx for r in extract.rule_events(tagged).orderBy("idx").collect()] == [3, 7]


def test_graphs(spark, corpus):
    sents = spark.createDataFrame([("d", 0, "(S (NP (NNS cats)) (VP (VBD said) (SBAR (VP (VBD left)))))"), ("d", 1, "(S (broken")], "doc string, sid int, parse string")
    nodes = graphs.tree_nodes(sents)
    assert [(r.idx, r.token, r.pos) for r in graphs.tagged(nodes).orderBy("idx").collect()] == [(1, "cats", "NNS"), (2, "said", "VBD"), (3, "left", "VBD")]
    assert {(r.idx, r.span_start, r.span_end) for r in graphs.head_spans(nodes).collect()} == {(1, 1, 2), (2, 2, 4), (3, 3, 4)}
    wanted = spark.createDataFrame([("d", 0, 2, 7), ("d", 0, 7, 2), ("d", 1, 3, 1)], "doc string, sid int, from_idx int, to_idx int")
    assert {(r.path, r.length) for r in graphs.dependency_paths(corpus.deps, wanted).collect()} == {("->ccomp->prep_on", 2), ("<-prep_on<-ccomp", 2)}
    up = spark.createDataFrame([("soldier.n", "person.n", 1), ("person.n", "object.n", 1), ("knife.n", "object.n", 1)], "child string, parent string, ordinal int")
    names = spark.createDataFrame([("person.n", "person"), ("object.n", "physical_object")], "synset string, name string")
    senses = spark.createDataFrame([("soldier", "soldier.n"), ("knife", "knife.n")], "lemma string, synset string")
    assert [r.lemma for r in graphs.is_a(senses.select("lemma"), senses, up, graphs.PREDICATES["person_or_group"], names).collect()] == ["soldier"]
    assert graphs.is_a(senses.select("lemma"), senses, up, graphs.PREDICATES["physical_object"], names).count() == 2


def test_learned_sieve(spark, corpus, tmp_path):
    gold = sieves.text_order(corpus)
    sieve = learned.LearnedSieve("event_event_same_sentence", least_count=1)
    assert sieve(corpus) is None
    assert made(sieve.train(corpus, gold.union(spark.createDataFrame([("d", "ei3", "ei4", "AFTER")], gold.schema)).dropDuplicates(["doc", "id1", "id2"]))(corpus)) != set()
    sieve.save(str(tmp_path / "m"))
    assert learned.LearnedSieve("event_event_same_sentence").load(str(tmp_path / "m"))(corpus).count() == 2
    assert learned.ExternalSieve()(corpus) is None


def test_annotation_files(spark, tmp_path):
    (tmp_path / "doc.1.ann").write_text("e1\tt2\tb\n# no\n\ne2 ii e3\ne4\te5\t\n")
    rows = annotations.annotations(spark, str(tmp_path / "doc.1.ann")).orderBy("ordinal").collect()
    assert [(r.doc, r.annotator, r.id1, r.id2, r.label) for r in rows] == [("doc.1", "ann", "e1", "t2", "b"), ("doc.1", "ann", "e2", "e3", "ii"), ("doc.1", "ann", "e4", "e5", None)]
    p = config.Properties.parse(["a=1 // x", "// b=2", "c = {a}/y", "d=true", "l=x, y"])
    assert (p.integer("a"), p.text("b"), p.text("c"), p.flag("d"), p.items("l")) == (1, None, "1/y", True, ["x", "y"])
    assert config.sieve_names(["// X", "Y // z", ""]) == ["Y"]


def test_corpus_files_round_trip(spark, corpus, tmp_path):
    sents = spark.createDataFrame([("d", 0, "Officials said", "(S (NNS Officials) (VBD said))", "nsubj(said-2, Officials-1)"), ("d", 1, "He", None, None)], "doc string, sid int, text string, parse string, deps string")
    links = spark.createDataFrame([("d", "ei1", "ei2", "BEFORE", False, "x")], "doc string, id1 string, id2 string, relation string, closed boolean, origin string")
    infofile.write(infofile.nested(sents, corpus.tokens, corpus.events, corpus.timexes, links, corpus.dcts), str(tmp_path / "x"), "urn:corpus")
    docs = infofile.files(spark, str(tmp_path / "x"))
    assert infofile.sentences(docs).count() == 2 and infofile.tokens(docs).orderBy("sid", "idx").first().token == "Officials" and infofile.tokens(docs).count() == corpus.tokens.count()
    assert {(r.id, r.idx, r.tense) for r in infofile.events(docs).collect()} == {(e[3], e[2], e[6]) for e in EVENTS}
    assert {(r.id, r.value) for r in infofile.timexes(docs).collect()} == {("t1", "1998-02-12"), ("t2", "1998-02-13")} and infofile.creation_times(docs).first().value == "1998-02-13"
    assert tuple(infofile.deps(docs).first()) == ("d", 0, "nsubj", "said", 2, "Officials", 1) and infofile.links(docs).first().relation == "BEFORE" and infofile.tagged(docs).count() == 2


def test_timeml(spark, tmp_path):
    xml = '<TimeML><DCT><TIMEX3 tid="t0" type="DATE" value="1998-02-13"/></DCT><TEXT>He <EVENT eid="e1" class="REPORTING">said</EVENT> so. It <EVENT eid="e2" class="STATE">was</EVENT> <TIMEX3 tid="t1" type="DATE" value="1998-02-12">last Thursday</TIMEX3>.</TEXT><MAKEINSTANCE eiid="ei1" eventID="e1" tense="PAST" aspect="NONE"/><TLINK lid="l1" relType="DURING" eventInstanceID="ei1" relatedToTime="t0"/></TimeML>'
    (tmp_path / "a.tml").write_text(xml)
    (tmp_path / "b.tml").write_text("<TimeML><TEXT>broken")
    docs = timeml.texts(spark, str(tmp_path))
    assert {(r.id, r.sid, r.idx, r.cls, r.tense) for r in timeml.events(docs).collect()} == {("ei1", 0, 2, "REPORTING", "PAST"), ("ei2", 1, 2, "STATE", "NONE")}
    assert [(r.id, r.sid, r.idx, r.len, r.value) for r in timeml.timexes(docs).collect()] == [("t1", 1, 3, 2, "1998-02-12")]
    assert [tuple(r) for r in timeml.creation_times(docs).collect()] == [("a", "t0", "DATE", "1998-02-13")] and [(r.id1, r.id2, r.relation, r.link_type) for r in timeml.links(docs).collect()] == [("ei1", "t0", "SIMULTANEOUS", "et")]


MARKUP = """<?xml version="1.0"?><TimeML><DOCID>x</DOCID><DCT><TIMEX3 tid='t0' type='DATE' value='1998-02-13' functionInDocument='CREATION_TIME'/></DCT>
<TEXT>He did<!-- a comment --> n't <EVENT eid='e9' class='REPORTING'>say</EVENT> &quot;no&quot; at AT&amp;T&nbsp;Inc.
She <EVENT eid="e1" class="STATE">was</EVENT> and <EVENT eid="e2" class="STATE">is</EVENT> there <TIMEX3 tid="t1" type="DATE" value="1998-02-12">last <NG>Thursday</NG></TIMEX3>.</TEXT>
<MAKEINSTANCE eiid='ei9' eventID='e9' tense='PAST' aspect="NONE" polarity='NEG'/><MAKEINSTANCE eiid="ei1" eventID="e9" tense="PRESENT"/><MAKEINSTANCE eiid="ei22" eventID="e0"/><MAKEINSTANCE eiid="ei2" eventID="e0"/>
<TLINK lid='l1' relType='during' eventInstanceID='ei9' relatedToTime='t0'/><TLINK lid="l2" relType="BEFORE" timeID="t1" relatedToTime="t0"/><TLINK lid="l3" relType="AFTER" eventInstanceID="ei77" relatedToEventInstance="ei9"/><TLINK lid="l4" relType="AFTER" timeID="t1"/></TimeML>"""


def test_timeml_as_other_tools_write_it(spark):
    """Single quotes, comments, named characters, tags within tags, ids that clash; a broken document is told of."""
    docs = spark.createDataFrame([("a", MARKUP), ("b", "<TimeML><TEXT>broken"), ("c", None), ("d", "")], "doc string, xml string")
    rows = timeml.parsed(docs)
    for source in (docs, rows):
        got = {r.eid: (r.id, r.eiids, r.sid, r.idx, r.text, r.tense, r.polarity) for r in timeml.events(source).collect()}
        assert got == {"e9": ("ei9", ["ei9", "ei1"], 0, 4, "say", "PAST", "NEG"), "e1": ("ei12", ["ei12"], 1, 2, "was", "NONE", "POS"), "e2": ("ei222", ["ei222"], 1, 4, "is", "NONE", "POS")}
        assert [(r.id, r.sid, r.idx, r.len, r.text, r.value) for r in timeml.timexes(source).collect()] == [("t1", 1, 6, 2, "last Thursday", "1998-02-12")]
        assert {(r.id1, r.id2, r.relation, r.link_type) for r in timeml.links(source).collect()} == {("ei9", "t0", "SIMULTANEOUS", "et"), ("t1", "t0", "BEFORE", "tt"), ("ei77", "ei9", "AFTER", "ee")}
        assert {(r.doc, r.problem, r.what) for r in timeml.errors(source).collect() if r.problem != "not well-formed"} == {("a", "link without two ends", "l4"), ("a", "link of an unknown event", "ei77")}
        assert {r.doc for r in timeml.errors(source).collect() if r.problem == "not well-formed"} == {"b", "d"}
    assert [tuple(r) for r in timeml.creation_times(rows).collect()] == [("a", "t0", "DATE", "1998-02-13")]
    toks = extract.token_table(spark.createDataFrame([("a", 'He did n\'t say "no" at AT&T\u00a0Inc.\nShe was and is there last Thursday.')], "doc string, text string"))
    assert {(r.sid, r.idx): r.token for r in toks.collect()}[1, 2] == "was"


def test_timeml_directories_and_pages(spark, tmp_path):
    for name in ("AQUAINT", "TimeBank", "Other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.tml").write_text("<TimeML><TEXT>x</TEXT></TimeML>")
    assert {r.doc for r in timeml.directory(spark, str(tmp_path)).collect()} == {"AQUAINT", "TimeBank"}
    assert {r.doc for r in timeml.directory(spark, str(tmp_path / "Other")).collect()} == {"Other"}
    page = '<td valign="top"><s>He <e>said<sub>e1</sub> on <t>Monday<sub>t1</sub> in<sub>s3</sub><td valign="top"><s>It <e>was<sub>e2</sub>'
    found = timeml.page_candidates(spark.createDataFrame([("p", page)], "doc string, xml string"))
    assert {(r.id1, r.id2) for r in found.collect()} == {("e1", "t0"), ("t1", "t0"), ("e2", "t0"), ("e1", "t1"), ("e1", "e2"), ("t1", "e2")}


def test_all_pairs_of_a_cluster(spark):
    members = spark.createDataFrame([("d", "c", "e1"), ("d", "c", "e2"), ("d", "c", "e3"), ("d", "k", "e4"), ("f", "c", "e1")], "doc string, cluster string, id string")
    assert {(r.doc, r.id1, r.id2) for r in pairs.within_cluster(members).collect()} == {("d", "e1", "e2"), ("d", "e1", "e3"), ("d", "e2", "e3")}


def test_paths_of_any_length(spark):
    deps = spark.createDataFrame([("d", 0, "dep", k, k + 1) for k in range(12)], "doc string, sid int, reln string, gov_idx int, dep_idx int")
    wanted = spark.createDataFrame([("d", 0, 0, 12)], "doc string, sid int, from_idx int, to_idx int")
    assert [r.length for r in graphs.dependency_paths(deps, wanted).collect()] == [12]
    assert graphs.dependency_paths(deps, wanted, longest=11).count() == 0
