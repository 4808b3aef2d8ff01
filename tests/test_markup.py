from pyspark.sql import functions as F

from chronoweave.operators import classify, extract, graphs, learned, lexicon, markup, pairs, selection, sieves

TREE = "(ROOT (S (NP (DT The) (NNS men)) (VP (MD will) (VP (VB leave) (PP (IN after) (S (VP (VBG running))))))))"


def test_lemmas(spark):
    known = spark.createDataFrame([("v", "run"), ("v", "be"), ("v", "carry"), ("n", "man"), ("n", "house"), ("n", "device"), ("n", "devices"), ("a", "late")], "part string, lemma string")
    words = [("running", "VBG", "run"), ("runs", "VBZ", "run"), ("were", "VBD", "be"), ("carried", "VBD", "carry"), ("men", "NNS", "man"), ("houses", "NNS", "house"), ("devices", "NNS", "device"), ("later", "JJR", "late"), ("well-run", "VBN", "well-run"), ("the", "DT", "the"), ("people", "NNS", "person")]
    df = spark.createDataFrame(words, "token string, pos string, want string")
    got = {r.token: r.lemma for r in lexicon.lemmatised(df, known).collect()}
    assert got == {w: l for w, _, l in words}
    forms = spark.createDataFrame([("v", "running", "be")], "part string, form string, lemma string")
    assert lexicon.lemmatised(df.where("token = 'running'"), known, forms).first().lemma == "be"


def test_lexical_predicates(spark):
    up = spark.createDataFrame([("soldier.n", "person.n", 1), ("person.n", "object.n", 1), ("house.n", "object.n", 1), ("knife.n", "tool.n", 1)], "child string, parent string, ordinal int")
    names = spark.createDataFrame([("person.n", "person"), ("object.n", "physical_object")], "synset string, name string")
    senses = spark.createDataFrame([("soldier", "soldier.n"), ("knife", "knife.n"), ("house", "house.n")], "lemma string, synset string")
    got = {r.lemma: (r.is_person_or_group, r.is_physical_object) for r in lexicon.with_predicates(senses.select("lemma"), senses, up, names).collect()}
    assert got == {"soldier": (True, True), "knife": (False, False), "house": (False, True)}
    words = spark.createDataFrame([("house",), ("zzz",)], "lemma string")
    assert [r.lemma for r in lexicon.unknown(words, senses).collect()] == ["zzz"]
    assert [r.lemma for r in lexicon.named_entities(senses, spark.createDataFrame([("knife.n",)], "synset string")).collect()] == ["knife"]


def test_trees(spark):
    rows = graphs.parsed(TREE)
    assert graphs.main_verb(rows) == 4 and graphs.main_verb(graphs.parsed("(FRAG (NN talk))")) is None
    assert graphs.path_to_clause(rows, 4) == "S-VP-VP-VB" and graphs.path_between(rows, 2, 4) == "NNS+NP+S-VP-VP-VB"
    assert graphs.preposition_of(rows, 6) == "after" and graphs.preposition_of(rows, 2) is None and graphs.flat_phrases(rows) == [(1, 3)]
    facts = graphs.tree_facts(spark.createDataFrame([("d", 0, TREE), ("d", 1, None)], "doc string, sid int, parse string")).orderBy("idx").collect()
    assert [r.token for r in facts] == ["The", "men", "will", "leave", "after", "running"] and [r.idx for r in facts if r.is_main] == [4]
    events = spark.createDataFrame([("d", 0, 2, "ei1"), ("d", 0, 4, "ei2"), ("d", 1, 1, "ei3"), ("d", 2, 1, "ei4"), ("d", 2, 3, "ei5")], "doc string, sid int, idx int, id string")
    mains = spark.createDataFrame([("d", 0, 4)], "doc string, sid int, idx int")
    assert [(r.id1, r.id2) for r in pairs.main_events(events, mains).collect()] == [("ei2", "ei3")]


def tokens(spark, *texts):
    rows = [("d", s, k + 1, *w.split("/")) for s, t in enumerate(texts) for k, w in enumerate(t.split())]
    return spark.createDataFrame(rows, "doc string, sid int, idx int, token string, pos string")


def test_tenses_of_verb_groups(spark):
    toks = tokens(spark, "He/PRP should/MD leave/VB", "She/PRP has/VBZ gone/VBN", "He/PRP might/MD have/VB left/VBN", "It/PRP wo/MD n't/RB go/VB", "He/PRP may/MD go/VB", "He/PRP could/MD have/VB gone/VBN", "They/PRP saw/VBD")
    got = {(r.sid, r.idx): r.tense for r in extract.group_tense(toks).collect()}
    assert got == {(0, 3): "FUTURE", (1, 2): "PRESENT", (1, 3): "PRESENT", (2, 3): None, (2, 4): "PAST", (3, 4): "FUTURE", (4, 3): None, (5, 3): "FUTURE", (5, 4): "PAST", (6, 2): "PAST"}


def test_texts_to_links(spark):
    docs = spark.createDataFrame([("d", "He left on 1998-02-13. She came on 1998-02-14.")], "doc string, text string")
    toks = tokens(spark, "He/PRP left/VBD on/IN 1998-02-13/CD ./.", "She/PRP came/VBD on/IN 1998-02-14/CD ./.")
    links = {(r.id1, r.id2): r.relation for r in markup.links_of(docs, toks, sieves.load(["adjacent_verb_timex", "time_time"])).collect()}
    assert links["ei1", "t1"] == "IS_INCLUDED" == links["ei2", "t2"] and links["t1", "t2"] == "BEFORE"
    assert {frozenset(k) for k in links} >= {frozenset(("ei1", "ei2")), frozenset(("t0", "t1"))}


def test_event_models(spark):
    toks = tokens(spark, *["He/PRP left/VBD home/NN", "She/PRP came/VBD home/NN", "He/PRP saw/VBD rain/NN"] * 4)
    events = toks.where("pos = 'VBD'").select("doc", "sid", "idx", F.concat(F.lit("ei"), "sid").alias("id"), F.col("token").alias("text"), "pos", F.lit("PAST").alias("tense"), F.lit("NONE").alias("aspect"), F.when(F.col("token") == "saw", "PERCEPTION").otherwise("OCCURRENCE").alias("cls"))
    models = classify.EventModels(1).train(toks, events)
    got = models.extract(toks)
    assert {(r.text, r.tense, r.cls) for r in got.collect()} == {("left", "PAST", "OCCURRENCE"), ("came", "PAST", "OCCURRENCE"), ("saw", "PAST", "PERCEPTION")}
    assert models.label(events.drop("tense"), toks).where("tense = 'PAST'").count() == 12
    assert classify.EventModels().extract(toks).count() == 0


def test_training_of_all_sieves_and_relabelling(spark):
    from chronoweave.operators.cascade import Corpus

    ev = spark.createDataFrame([("d", s, k, f"ei{s}.{k}", "w", "VBD", "PAST", "NONE", "STATE") for s in range(3) for k in (1, 2)], "doc string, sid int, idx int, id string, text string, pos string, tense string, aspect string, cls string")
    c = Corpus(events=ev)
    gold = sieves.text_order(c)
    own = markup.train_all([("learned", learned.LearnedSieve("event_event_same_sentence", least_count=1)), ("order", sieves.text_order)], c, gold)
    old = gold.select("doc", F.col("id2").alias("id1"), F.col("id1").alias("id2"), F.lit("VAGUE").alias("relation"))
    assert {r.relation for r in markup.relabelled(old, c, own).collect()} == {"AFTER"}
    assert selection.of_type(gold, "ee").count() == 3 and selection.is_intra_sentence(gold, ev).count() == 3 and selection.of_neighbours(gold, ev).count() == 0


def test_counts_of_maps(spark):
    row = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)).alias("x"), F.create_map(F.lit("b"), F.lit(5)).alias("y"))
    assert row.select(selection.added_counts("x", "y")).first()[0] == {"a": 1, "b": 7} and row.select(selection.largest_counts("x", "y")).first()[0] == {"a": 1, "b": 5}


def test_predicates_of_nouns(spark):
    nouns = spark.createDataFrame([("d", 0, 2, "ei1", "NN"), ("d", 0, 5, "ei2", "NN")], "doc string, sid int, idx int, id string, pos string")
    deps = spark.createDataFrame([("d", 0, "det", 2, 1, "the"), ("d", 0, "prep_of", 5, 2, "talk")], "doc string, sid int, reln string, gov_idx int, dep_idx int, dep string")
    names = spark.createDataFrame([("d", 0, 6)], "doc string, sid int, end int")
    got = {r.id: (r.definite, r.proper, r.possessive) for r in selection.possessive(nouns, deps, names).collect()}
    assert got == {"ei1": (True, False, True), "ei2": (False, True, False)}


def test_times_of_texts_are_planned_once(spark):
    """Readers of a corpus get its times from a table: with the grammar's expressions in every plan, a sieve's plan outgrew the driver."""
    docs = spark.createDataFrame([("d", "He left on 1998-03-02 .")], "doc string, text string")
    tagged = spark.createDataFrame([("d", 0, k, t, p) for k, (t, p) in enumerate([("He", "PRP"), ("left", "VBD"), ("on", "IN"), ("1998-03-02", "CD"), (".", ".")], 1)], "doc string, sid int, idx int, token string, pos string")
    times = markup.corpus_of(docs, tagged, dcts=spark.createDataFrame([("d", "t0", "1998-03-02")], "doc string, id string, value string"), heuristic=None).timexes
    assert [(r.idx, r.len, r.value) for r in times.collect()] == [(4, 1, "1998-03-02")]
    assert len(times._jdf.queryExecution().optimizedPlan().toString()) < 2000
