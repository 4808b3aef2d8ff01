import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import cascade, graphs, learned, lexicon, linkfeatures, pairs, tablefunction, trees


@pytest.fixture(scope="module")
def made(spark):
    """Sentences whose two events have the relation that their tree tells: the second inside the first one's phrase is included, beside it before."""
    rng, events, tokens, sents, gold = random.Random(3), [], [], [], []
    for s in range(160):
        inside = rng.random() < 0.5
        words = [rng.choice(["he", "she", "it"]), rng.choice(["saw", "heard", "made"]), rng.choice(["to", "and"]), rng.choice(["run", "go", "stay"])]
        tags = ["PRP", "VBD", "TO", "VB"]
        leaf = [f"({t} {w})" for t, w in zip(tags, words, strict=True)]
        sents.append(("d", s, f"(S (NP {leaf[0]}) (VP {leaf[1]} (S (VP {leaf[2]} {leaf[3]}))))" if inside else f"(S (NP {leaf[0]}) (VP (VP {leaf[1]}) (VP {leaf[2]} {leaf[3]})))"))
        tokens += [("d", s, k + 1, w, t) for k, (w, t) in enumerate(zip(words, tags, strict=True))]
        events += [("d", s, 2, f"a{s}", "PAST", "NONE", "OCCURRENCE"), ("d", s, 4, f"b{s}", "NONE", "NONE", "OCCURRENCE")]
        gold.append(("d", f"b{s}", f"a{s}", "IS_INCLUDED" if inside else "AFTER"))
    nodes = trees.intervals(spark.createDataFrame(sents, "doc string, sid int, parse string"))
    own = cascade.Corpus(
        events=spark.createDataFrame(events, "doc string, sid int, idx int, id string, tense string, aspect string, cls string"),
        tokens=spark.createDataFrame(tokens, "doc string, sid int, idx int, token string, pos string"), nodes=nodes,
    )
    return own, spark.createDataFrame(gold, "doc string, id1 string, id2 string, relation string")


def half(corpus, gold, odd):
    keep = F.substring("id", 2, 9).cast("int") % 2 == int(odd)
    own = cascade.Corpus(events=corpus.events.where(keep), tokens=corpus.tokens, nodes=corpus.nodes)
    return own, gold.where(F.substring("id1", 2, 9).cast("int") % 2 == int(odd))


def share_right(made, gold):
    truth = {(r.id2, r.id1): {"IS_INCLUDED": "INCLUDES", "AFTER": "BEFORE"}[r.relation] for r in gold.collect()}
    rows = made.collect()
    return sum(truth[r.id1, r.id2] == r.relation for r in rows) / len(truth)


def test_paths_gain_on_held_out_pairs(made):
    """What only the tree tells is learned from rich features and not from plain attributes."""
    train, test = half(*made, False), half(*made, True)
    right = {rich: share_right(learned.LearnedSieve("event_event_same_sentence", rich=rich).train(*train)(test[0]), test[1]) for rich in (True, False)}
    assert right[True] > 0.98 and right[True] > right[False] + 0.2


def test_one_against_the_rest(made, tmp_path):
    train, test = half(*made, False), half(*made, True)
    labels = ("BEFORE", "INCLUDES", "SIMULTANEOUS")
    sieve = learned.OneAgainstRest("event_event_same_sentence", labels, {"BEFORE": 0.5, "INCLUDES": 0.5, "SIMULTANEOUS": 0.5})
    assert sieve(test[0]) is None
    sieve.train(*train)
    assert set(sieve.model) == {"BEFORE", "INCLUDES"}  # a label that is never seen has no model
    assert share_right(sieve(test[0]), test[1]) > 0.98
    chances = sieve.probabilities(test[0]).collect()
    assert len(chances) == 160 and all(0 <= r.confidence <= 1 for r in chances)
    only = learned.OneAgainstRest("event_event_same_sentence", labels, only="INCLUDES").train(*train)(test[0]).collect()
    assert {r.relation for r in only} == {"INCLUDES"} and 0 < len(only) < 80
    strict = learned.OneAgainstRest("event_event_same_sentence", labels, {"BEFORE": 2.0, "INCLUDES": 0.5, "SIMULTANEOUS": 0.5}).train(*train)(test[0])
    assert {r.relation for r in strict.collect()} == {"INCLUDES"}  # its threshold keeps a label out
    sieve.labels = ("BEFORE", "INCLUDES")
    sieve.save(str(tmp_path / "m"))
    again = learned.OneAgainstRest("event_event_same_sentence", ("BEFORE", "INCLUDES")).load(str(tmp_path / "m"))
    assert {tuple(r)[:4] for r in again(test[0]).collect()} == {tuple(r)[:4] for r in sieve(test[0]).collect()}


def test_swapped_pairs_turn_their_labels(made):
    corpus, gold = made
    one = linkfeatures.event_pairs(corpus, gold.select("doc", "id1", "id2")).first()
    other = linkfeatures.event_pairs(corpus, gold.select("doc", F.col("id2").alias("id1"), F.col("id1").alias("id2"))).where(f"id2 = '{one.id1}'").first()
    assert one.swapped and not other.swapped and one.features == other.features
    assert {"same sentence", "next event", "1tag:VBD", "2tag-1:TO", "tensematch:no"} <= set(one.features)


def test_vague_patterns_and_templates(spark, made):
    corpus, _ = made
    corpus = cascade.Corpus(events=corpus.events.withColumn("tense", F.when(F.col("idx") == 2, F.when(F.col("sid") % 2 == 0, "PAST").otherwise("PRESENT")).otherwise("NONE")), tokens=corpus.tokens,
                            deps=corpus.events.where("idx = 2").select("doc", "sid", F.when(F.col("sid") % 2 == 0, "xcomp").otherwise("ccomp").alias("reln"), F.lit(2).alias("gov_idx"), F.lit(4).alias("dep_idx")))
    both = pairs.same_sentence(corpus.events).select("doc", "id1", "id2", "tense1")
    gold = both.select("doc", "id1", "id2", F.when(F.col("tense1") == "PAST", "VAGUE").otherwise("BEFORE").alias("relation"))
    vague = learned.LearnedSieve("event_event_vague", least_confidence=0.7, keep=("VAGUE",)).train(corpus, gold)
    assert vague.rows(corpus, gold).select("label").distinct().count() == 2
    features = learned.features_of("event_event_vague", corpus).first().features
    assert len(features) == 14
    inside = vague(corpus).join(gold, ["doc", "id1", "id2"]).collect()
    assert len(inside) == 80 and all(r.id1[0] == "a" for r in inside)
    governed = learned.features_of("event_governs_event", corpus).where("id1 = 'a0'").first().features
    assert len(governed) == 14 and "reln:xcomp" in governed and "tense+aspect+cls:PAST-NONE-NONE-NONE-OCCURRENCE-OCCURRENCE" in governed
    known = learned.LearnedSieve("event_governs_event").train(corpus, gold)(corpus)
    truth = {(r.id1, r.id2): r.relation for r in gold.collect()}
    assert all(truth[r.id1, r.id2] == r.relation for r in known.collect()) and known.count() == 160


def test_tree_intervals_equal_the_parsed_nodes(spark):
    """The same nodes as one pass over the brackets finds, and broken trees have none."""
    texts = ["(ROOT (S (NP (DT The) (NNS men)) (VP (MD will) (VP (VB leave) (PP (IN after) (S (VP (VBG running))))))))", "(S (broken", "(A a) b", "", None, ") (", "(X)", "((S (A a)))"]
    rows = [("d", k, t) for k, t in enumerate(texts)]
    got = {}
    for r in trees.intervals(spark.createDataFrame(rows, "doc string, sid int, parse string")).collect():
        got.setdefault(r.sid, []).append((r.node, r.parent, r.label, r.word, r.span_start, r.span_end))
    for k, t in enumerate(texts):
        want = graphs.parsed(t or "")
        assert sorted(got.get(k, [])) == sorted(want), t


def test_tree_operators(spark):
    tree = "(ROOT (S (NP (DT The) (NNS men)) (VP (MD will) (VP (VB leave) (PP (IN after) (S (VP (VBG running))))))))"
    nodes = trees.intervals(spark.createDataFrame([("d", 0, tree)], "doc string, sid int, parse string"))
    assert {r.idx: r.preposition for r in trees.prepositions(nodes).collect()} == {6: "after"} == {k: p for k in range(1, 7) if (p := graphs.preposition_of(graphs.parsed(tree), k))}
    both = spark.createDataFrame([("d", 0, 2, 4), ("d", 0, 4, 6), ("d", 0, 6, 4), ("d", 0, 4, 4), ("d", 0, 1, 9)], "doc string, sid int, idx1 int, idx2 int")
    got = {(r.idx1, r.idx2): (r.path, r.inner, r.dominates, r.dominated) for r in trees.paths(trees.dominance(both, nodes), nodes).collect()}
    assert got[2, 4] == ("NNS-NP-S-VP-VP-VB", "NP-S-VP-VP", False, False) and got[4, 6] == ("VB-VP-PP-S-VP-VBG", "VP-PP-S-VP", True, False)
    assert got[6, 4][2:] == (False, True) and got[4, 4][0] == "VB" and got[1, 9][0] is None
    spans = spark.createDataFrame([("d", 0, 1, 2), ("d", 0, 2, 2), ("d", 0, 4, 1)], "doc string, sid int, idx int, len int")
    assert {(r.idx, r.len): r.flat for r in trees.in_one_phrase(spans, nodes).collect()} == {(1, 2): True, (2, 2): False, (4, 1): True}
    roots = spark.createDataFrame([("d", 0, 5)], "doc string, sid int, root int")
    assert trees.verbs(nodes, roots).first().verbs == ["leave", "running"] and trees.raw_texts(nodes, roots).first().text == "will leave after running"


def test_ancestors_of_a_long_chain(spark):
    up = spark.createDataFrame([(f"s{k}", f"s{k + 1}", 1) for k in range(60)] + [("s3", "side", 2), ("x", "y", 1), ("y", "x", 1), ("z", "z", 1)], "child string, parent string, ordinal int")
    got = {(r.child, r.ancestor): r.distance for r in graphs.ancestors(up).collect()}
    assert got == {(f"s{a}", f"s{b}"): b - a for a in range(60) for b in range(a + 1, 61)} | {("x", "y"): 1, ("y", "x"): 1}
    names = spark.createDataFrame([("s60", "physical_object"), ("s10", "person")], "synset string, name string")
    senses = spark.createDataFrame([("low", "s0", 1), ("high", "s20", 1), ("both", "s20", 1), ("both", "s0", 2), ("none", "side", 1)], "lemma string, synset string, ordinal int")
    flags = {r.lemma: (r.is_person_or_group, r.is_physical_object, r.is_thing) for r in lexicon.with_predicates(senses.select("lemma").distinct(), senses, up, names).collect()}
    assert flags == {"low": (True, True, False), "high": (False, True, True), "both": (True, True, True), "none": (False, False, False)}


def test_sieve_as_table_function(spark):
    tablefunction.register(spark, "firsts", lambda rows: [(rows[0].id, r.id, "BEFORE", 0.25) for r in rows[1:]] + [(None, "x", "BEFORE")])
    spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, "c"), ("e", 1, "z")], "doc string, idx int, id string").createOrReplaceTempView("entities_of_test")
    got = spark.sql("SELECT * FROM firsts(TABLE(entities_of_test) PARTITION BY doc ORDER BY idx)").collect()
    assert {tuple(r) for r in got} == {("d", "a", "b", "BEFORE", 0.25), ("d", "a", "c", "BEFORE", 0.25)}


def test_direct_paths(spark):
    paths = spark.createDataFrame([("->a->b", 2), ("<-a", 1), ("<-a->b", 2), ("->a<-b", 2), ("->a", 1)], "path string, length int")
    assert {r.path for r in graphs.direct_paths(paths).collect()} == {"->a->b", "<-a", "->a"}
