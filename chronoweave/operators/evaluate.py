"""Scoring links against gold, annotator agreement, merging of annotations and corpus counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.maths import f1, ratio
from chronoweave.functions.relations import canonical, inverted
from chronoweave.scratch import numbered

#: Labels that scores are given for.
SCORED = ["BEFORE", "AFTER", "SIMULTANEOUS", "INCLUDES", "IS_INCLUDED", "VAGUE"]


def in_text_order(links: DataFrame, places: DataFrame) -> DataFrame:
    """Turns links so that the first id stands first in the text; creation times (places without sid) come last."""
    at = lambda k: places.select("doc", F.col("id").alias(f"id{k}"), F.struct(F.coalesce("sid", F.lit(2**31 - 1)).alias("sid"), F.coalesce("idx", F.lit(0)).alias("idx")).alias(f"at{k}"))
    both = links.join(at(1), ["doc", "id1"]).join(at(2), ["doc", "id2"])
    turn = F.col("at2") < F.col("at1")
    return both.withColumns({"id1": F.when(turn, F.col("id2")).otherwise(F.col("id1")), "id2": F.when(turn, F.col("id1")).otherwise(F.col("id2")), "relation": F.when(turn, inverted(F.col("relation"))).otherwise(F.col("relation"))}).drop("at1", "at2")


def compared(guessed: DataFrame, gold: DataFrame) -> DataFrame:
    """A row for each pair that either side links: guess and truth in id order, null where a side has none."""
    a = canonical(guessed).groupBy("doc", "lo", "hi").agg(F.min("rel").alias("guess"))
    b = canonical(gold).groupBy("doc", "lo", "hi").agg(F.min("rel").alias("truth"))
    return a.join(b, ["doc", "lo", "hi"], "full")


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def scores(rows: DataFrame, by: list[str], guess: str = "guess", truth: str = "truth") -> DataFrame:
    """correct, incorrect, missed, precision, recall and f1 of rows (guess, truth) for each group of by; guesses without truth don't count."""
    g, t = F.col(guess), F.col(truth)
    out = rows.groupBy(*by).agg(_sum(g == t).alias("correct"), _sum(g.isNotNull() & t.isNotNull() & (g != t)).alias("incorrect"), _sum(g.isNull() & t.isNotNull()).alias("missed"), _sum(g.isNotNull() & t.isNull()).alias("no_gold"))
    precision = ratio(F.col("correct"), F.col("correct") + F.col("incorrect"))
    recall = ratio(F.col("correct"), F.col("correct") + F.col("incorrect") + F.col("missed"))
    return out.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def without_vague(rows: DataFrame) -> DataFrame:
    return rows.where((F.coalesce("guess", F.lit("")) != "VAGUE") & (F.coalesce("truth", F.lit("")) != "VAGUE"))


def by_label(rows: DataFrame) -> DataFrame:
    """label, precision, recall and f1: a guess of the label with another truth is a false positive, a truth with another guess a false negative."""
    both = rows.where("guess IS NOT NULL AND truth IS NOT NULL")
    each = both.select(F.explode(F.array_distinct(F.array("guess", "truth"))).alias("label"), "guess", "truth")
    g, t = F.col("guess") == F.col("label"), F.col("truth") == F.col("label")
    out = each.groupBy("label").agg(_sum(g & t).alias("tp"), _sum(g & ~t).alias("fp"), _sum(~g & t).alias("fn"))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def confusion(rows: DataFrame, row: str = "truth", column: str = "guess", values: list[str] | None = None) -> DataFrame:
    """A matrix of counts, 0 where a cell is empty."""
    return rows.groupBy(row).pivot(column, values or SCORED).count().fillna(0)


def majority_baseline(rows: DataFrame) -> DataFrame:
    """label, n, share: the commonest truth; ties to the first by name."""
    counted = rows.where("truth IS NOT NULL").groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.orderBy(F.desc("n"), "label").limit(1).join(F.broadcast(total)).select("label", "n", ratio(F.col("n"), F.col("total")).alias("share"))  # total is one row


def link_kind(id1: Column, id2: Column, made: Column) -> Column:
    """ee, et or tt by the ids' first letters; ed and td where one end is a creation time (made)."""
    events = F.startswith(id1, F.lit("e")).cast("int") + F.startswith(id2, F.lit("e")).cast("int")
    return F.when(events == 2, "ee").when(events == 1, F.when(made, "ed").otherwise("et")).otherwise(F.when(made, "td").otherwise("tt"))


def report(guessed: DataFrame, gold: DataFrame, dcts: DataFrame) -> DataFrame:
    """kind, closed, correct, incorrect, missed, no_gold, precision, recall, f1: over all links, by kind, by whether they were inferred, and by both.

    guessed: doc, id1, id2, relation, closed; gold: doc, id1, id2, relation; dcts: doc, id. Null kind and closed stand for all. Pairs
    that were missed belong to no value of closed, so they count where that is null.
    """
    a = canonical(guessed).groupBy("doc", "lo", "hi").agg(F.min(F.struct("rel", "closed")).alias("g")).select("doc", "lo", "hi", F.col("g.rel").alias("guess"), "g.closed")
    b = canonical(gold).groupBy("doc", "lo", "hi").agg(F.min("rel").alias("truth"))
    made = dcts.groupBy("doc").agg(F.collect_set("id").alias("made"))  # creation times of a document
    rows = a.join(b, ["doc", "lo", "hi"], "full").join(made, "doc", "left")
    is_made = F.coalesce(F.arrays_overlap("made", F.array("lo", "hi")), F.lit(False))
    rows = rows.select(link_kind(F.col("lo"), F.col("hi"), is_made).alias("kind"), "closed", "guess", "truth")
    own = rows.where("closed IS NULL")
    twice = own.select(F.lit(None).cast("string").alias("kind"), "closed", "guess", "truth").unionByName(own.select("kind", "closed", "guess", "truth"))
    known = rows.where("closed IS NOT NULL").withColumn("in", F.explode(F.array(*[F.struct(F.when(F.lit(k), F.col("kind")).alias("k"), F.when(F.lit(c), F.col("closed")).alias("c")) for k in (False, True) for c in (False, True)])))
    return scores(known.select(F.col("in.k").alias("kind"), F.col("in.c").alias("closed"), "guess", "truth").unionByName(twice), ["kind", "closed"])


def dataset_statistics(events: DataFrame, timexes: DataFrame, dcts: DataFrame, links: DataFrame) -> DataFrame:
    """name, n: documents, sentences with entities, events, times, creation times, and links by kind and relation (links ee BEFORE, ...)."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    places = events.select("doc", "sid").unionByName(timexes.select("doc", "sid"))
    docs = places.select("doc").unionByName(dcts.select("doc")).distinct()
    made = dcts.groupBy("doc").agg(F.collect_set("id").alias("made"))
    kind = link_kind(F.col("id1"), F.col("id2"), F.coalesce(F.arrays_overlap("made", F.array("id1", "id2")), F.lit(False)))
    by = links.join(made, "doc", "left").groupBy(F.concat_ws(" ", F.lit("links"), kind, "relation").alias("name")).agg(F.count("*").alias("n"))
    out = one(docs, "documents").unionByName(one(places.distinct(), "sentences")).unionByName(one(events, "events")).unionByName(one(timexes, "times")).unionByName(one(dcts, "creation times"))
    return out.unionByName(by)


def kinds(id1: Column, id2: Column, dct: str = "t0") -> Column:
    """The agreement kinds of a pair: et and tt hold the pairs with the creation time too."""
    e = F.startswith(id1, F.lit("e")).cast("int") + F.startswith(id2, F.lit("e")).cast("int")
    made = (id1 == dct) | (id2 == dct)
    kind = lambda condition, name: F.when(condition, F.lit(name))
    return F.array_compact(F.array(kind(e == 2, "ee"), kind(e == 1, "et"), kind(e == 0, "tt"), kind((e == 1) & made, "eDCT"), kind((e == 0) & made, "tDCT"), kind(made, "xDCT")))


def annotated_by_two(annotations: DataFrame, missing: str = "v") -> DataFrame:
    """doc, ann1, ann2, id1, id2, label1, label2 over all pairs that either of two annotators of a document labels.

    annotations: doc, annotator, id1, id2, label. Each annotator's rows are sent to the other annotators of
    the document; a pair that one of the two left out has the label missing there.
    """
    people = annotations.groupBy("doc").agg(F.sort_array(F.collect_set("annotator")).alias("people"))
    sent = annotations.join(people, "doc").withColumn("other", F.explode("people")).where("other <> annotator")
    sent = sent.withColumns({"ann1": F.least("annotator", "other"), "ann2": F.greatest("annotator", "other")})
    of = lambda who: F.max(F.when(F.col("annotator") == F.col(who), F.col("label")))
    both = sent.groupBy("doc", "ann1", "ann2", "id1", "id2").agg(of("ann1").alias("label1"), of("ann2").alias("label2"))
    return both.fillna(missing, ["label1", "label2"])


def agreement(both: DataFrame, by: list[str]) -> DataFrame:
    """total, matched, mismatched and accuracy of annotated_by_two() for each group of by."""
    out = both.groupBy(*by).agg(F.count("*").alias("total"), _sum(F.col("label1") == F.col("label2")).alias("matched"))
    return out.withColumns({"mismatched": F.col("total") - F.col("matched"), "accuracy": ratio(F.col("matched"), F.col("total"))})


def agreement_by_kind(both: DataFrame, by: list[str]) -> DataFrame:
    return agreement(both.withColumn("kind", F.explode(kinds(F.col("id1"), F.col("id2")))), [*by, "kind"])


def without_joint_vague(both: DataFrame, vague: str = "v") -> DataFrame:
    return both.where((F.col("label1") != vague) | (F.col("label2") != vague))


def merged(annotations: DataFrame, fine: bool = False, vague: str = "v") -> DataFrame:
    """doc, id1, id2, label: the label that more than half of the document's annotators give, else vague.

    With fine, a vague result is mv (all vague), pv (some vague) or nv (none). Documents with one annotator go.
    """
    people = annotations.groupBy("doc").agg(F.countDistinct("annotator").alias("people")).where("people > 1")
    counted = annotations.join(people, "doc").groupBy("doc", "id1", "id2", "label", "people").agg(F.count("*").alias("n"))
    w = F.struct("n", "label")
    best = counted.groupBy("doc", "id1", "id2").agg(F.max(w).alias("best"), F.max("people").alias("people"), F.sum("n").alias("given"), F.sum(F.when(F.col("label") == vague, F.col("n")).otherwise(0)).alias("vague"))
    won = F.col("best.n") * 2 > F.col("people")
    label = F.when(won, F.col("best.label")).otherwise(vague)
    if fine:
        kind = F.when(F.col("vague") >= F.col("people"), "mv").when(F.col("vague") > 0, "pv").otherwise("nv")
        label = F.when(label == vague, kind).otherwise(label)
    return best.select("doc", "id1", "id2", label.alias("label"))


def half_links(links: DataFrame) -> DataFrame:
    """doc, id, other, relation: each link as seen from both ends."""
    forward = links.select("doc", F.col("id1").alias("id"), F.col("id2").alias("other"), "relation")
    return forward.union(links.select("doc", "id2", "id1", inverted(F.col("relation"))))


def central(links: DataFrame, more_than: int) -> DataFrame:
    """doc, id, n of the entities with more than so many links."""
    return half_links(links).groupBy("doc", "id").agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def renamed(annotations: DataFrame, instances: DataFrame) -> DataFrame:
    """Annotations on events as links on instances (doc, eid, eiid); ids without an instance stay."""
    for k in (1, 2):
        names = instances.select("doc", F.col("eid").alias(f"id{k}"), F.col("eiid").alias("to"))
        annotations = annotations.join(names, ["doc", f"id{k}"], "left").withColumn(f"id{k}", F.coalesce("to", f"id{k}")).drop("to")
    return annotations


# The short labels of annotation files and the relations that they stand for.
SHORT = {"a": "AFTER", "b": "BEFORE", "i": "INCLUDES", "ii": "IS_INCLUDED", "s": "SIMULTANEOUS", "v": "VAGUE", "mv": "MUTUAL_VAGUE", "pv": "PARTIAL_VAGUE", "nv": "NONE_VAGUE"}


def link_elements(annotations: DataFrame, instances: DataFrame, times: DataFrame) -> DataFrame:
    """doc, id1, id2, relation, link_type, element, problem of annotations (doc, id1, id2, label): their corpus elements, on instances.

    instances: doc, eid, eiid; times: doc, id. Rows with an unknown event, time or label have no element and say so.
    """
    rows = annotations
    known = times.select("doc", F.col("id").alias("t")).distinct()
    for k in (1, 2):
        own = instances.groupBy("doc", F.col("eid").alias(f"id{k}")).agg(F.min("eiid").alias(f"to{k}"))
        rows = rows.join(own, ["doc", f"id{k}"], "left").join(known.withColumnRenamed("t", f"id{k}").withColumn(f"time{k}", F.col(f"id{k}")), ["doc", f"id{k}"], "left")
    end = lambda k: F.when(F.startswith(f"id{k}", F.lit("e")), F.col(f"to{k}")).otherwise(F.col(f"time{k}"))
    relation = F.lit(None).cast("string")
    for short, name in SHORT.items():
        relation = F.when(F.col("label") == short, name).otherwise(relation)
    rows = rows.withColumns({"e1": end(1), "e2": end(2), "relation": relation, "link_type": link_kind(F.col("id1"), F.col("id2"), F.lit(False))})
    problem = F.when(F.col("e1").isNull() | F.col("e2").isNull(), "unknown id").when(F.col("relation").isNull(), "unknown label")
    element = F.format_string('<tlink event1="%s" event2="%s" relation="%s" closed="false" type="%s"/>', "e1", "e2", "relation", "link_type")
    return rows.select("doc", "id1", "id2", "relation", "link_type", F.when(problem.isNull(), element).alias("element"), problem.alias("problem"))


def trimmed(annotations: DataFrame, ids: DataFrame) -> DataFrame:
    """Annotations whose two ids are both in ids (doc, id)."""
    for k in (1, 2):
        annotations = annotations.join(ids.select("doc", F.col("id").alias(f"id{k}")), ["doc", f"id{k}"], "left_semi")
    return annotations


def aligned(annotations: DataFrame, order: DataFrame) -> DataFrame:
    """order's pairs (doc, id1, id2, ordinal) with the labels given to them, UNKNOWN where there is none."""
    given = annotations.groupBy("doc", "id1", "id2").agg(F.min("label").alias("label"))
    return order.join(given, ["doc", "id1", "id2"], "left").withColumn("label", F.coalesce("label", F.lit("UNKNOWN")))


def split(docs: DataFrame, dev: list[str], test: list[str]) -> DataFrame:
    """docs (doc) with set: the fixed lists, and train for the rest."""
    return docs.withColumn("set", F.when(F.col("doc").isin(*dev), "dev").when(F.col("doc").isin(*test), "test").otherwise("train"))


def folds(docs: DataFrame, k: int, order: str = "doc") -> DataFrame:
    """docs with fold 0 to k - 1 by position; the last fold takes the remainder."""
    rows = numbered(docs, order, "_number")
    size = max(1, rows.count() // k)
    return rows.withColumn("fold", F.least(F.floor(F.col("_number") / size), F.lit(k - 1)).cast("int")).drop("_number")


def window_pair_counts(events: DataFrame, reach: int = 1) -> DataFrame:
    """doc, pairs: the candidate pairs within a sentence and with the next reach sentences, from counts alone."""
    n = events.groupBy("doc", "sid").agg(F.count("*").alias("n"))
    later = None
    for by in range(1, reach + 1):
        m = n.select("doc", (F.col("sid") - by).alias("sid"), F.col("n").alias("m"))
        later = m if later is None else later.union(m)
    across = n.join(later.groupBy("doc", "sid").agg(F.sum("m").alias("m")), ["doc", "sid"], "left")
    return across.groupBy("doc").agg(F.sum(F.expr("n * (n - 1) div 2 + n * coalesce(m, 0)")).alias("pairs"))


def pattern_relations(both: DataFrame, columns: list[str], relations: list[str] | None = None, relation: str = "relation") -> DataFrame:
    """For every subset of columns a row for each of its patterns: any_* (1: left out), n, and each relation's share of it."""
    relations = relations or SCORED
    own = both.where(F.col(relation).isin(*relations))
    counts = [F.count_if(F.col(relation) == r).alias(r) for r in relations]
    counted = own.cube(*columns).agg(F.count("*").alias("n"), *[F.grouping(c).cast("int").alias(f"any_{c}") for c in columns], *counts)
    return counted.withColumns({r: ratio(F.col(r), F.col("n")) for r in relations})


def masked_counts(both: DataFrame, columns: list[str], relation: str = "relation") -> DataFrame:
    """For every subset of columns, counts by relation and each count's share of its pattern; one pass of grouping sets."""
    counted = both.cube(*columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"any_{c}") for c in columns], F.count_if(F.col(relation) == "VAGUE").alias("vague"))
    return counted.withColumn("share", ratio(F.col("vague"), F.col("n")))
