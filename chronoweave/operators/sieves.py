"""Rule sieves: each maps a Corpus to proposed links (doc, id1, id2, relation).

Events have doc, sid, idx, id, text, pos, tense, aspect, cls; timexes doc, sid, idx, len, id, text, type,
value; dcts doc, id, value. Tables of rules are small, fixed DataFrame literals and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import timex as tx
from chronoweave.operators import pairs
from chronoweave.operators.cascade import LINK, Corpus

# The relation of an event to a time expression after a preposition.
PREPOSITIONS = {
    "in": "IS_INCLUDED", "on": "IS_INCLUDED", "over": "IS_INCLUDED", "during": "IS_INCLUDED", "within": "IS_INCLUDED",
    "for": "SIMULTANEOUS", "at": "SIMULTANEOUS", "throughout": "SIMULTANEOUS", "by": "VAGUE", "until": "BEFORE", "from": "AFTER", "after": "AFTER",
}
# Tense of the governing event, tense and aspects of the governed one, relation.
REPORTING_RULES = [
    ("PAST", "PAST", "NONE", "AFTER"), ("PAST", "PAST", "PERFECTIVE", "AFTER"), ("PAST", "PAST", "PROGRESSIVE", "IS_INCLUDED"),
    ("PAST", "PRESENT", "PERFECTIVE", "AFTER"), ("PAST", "PRESENT", "PROGRESSIVE", "IS_INCLUDED"), ("PAST", "PRESENT", "PERFECTIVE_PROGRESSIVE", "IS_INCLUDED"),
    ("PAST", "FUTURE", None, "BEFORE"), ("PRESENT", "PAST", None, "AFTER"), ("PRESENT", "PRESENT", "PERFECTIVE", "AFTER"), ("PRESENT", "FUTURE", None, "BEFORE"),
]
# Rows are the first event's tense and aspect, columns the second's, in this order; - proposes nothing.
REICHENBACH_STATES = ["PAST/NONE", "PAST/PERFECTIVE", "PRESENT/NONE", "PRESENT/PERFECTIVE", "FUTURE/NONE", "FUTURE/PERFECTIVE"]
REICHENBACH = [
    "- AFTER - - BEFORE BEFORE",
    "BEFORE - BEFORE BEFORE BEFORE BEFORE",
    "- AFTER - - BEFORE -",
    "- AFTER - - BEFORE BEFORE",
    "AFTER AFTER AFTER AFTER - -",
    "AFTER AFTER - AFTER - -",
]
# Relation by the marker of an adverbial clause, and by a noun's preposition.
MARKERS = {"until": "BEFORE", "before": "BEFORE", "because": "BEFORE", "once": "AFTER", "after": "AFTER", "since": "AFTER", "when": "VAGUE", "as": "SIMULTANEOUS"}
NOMINAL_TIMEX = {"amod": "SIMULTANEOUS", "nn": "IS_INCLUDED", "poss": "IS_INCLUDED", "prep_in": "IS_INCLUDED"}
NOMINAL_EVENT = {"prep_during": "IS_INCLUDED", "prep_while": "IS_INCLUDED", "prep_before": "BEFORE", "prep_after": "AFTER", "prep_since": "AFTER"}


def _looked_up(column: Column, table: dict[str, str], other: str | None = None) -> Column:
    out = F.lit(other).cast("string")
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def _links(rows: DataFrame, relation: Column | str) -> DataFrame:
    relation = F.lit(relation) if isinstance(relation, str) else relation
    return rows.withColumn("relation", relation).where("relation IS NOT NULL").select(*LINK)


def _is_verb(pos: str) -> Column:
    return F.startswith(F.col(pos), F.lit("VB"))


def adjacent_verb_timex(c: Corpus, between: int = 2, before: bool = True, after: bool = False, governs: bool = True, governed: bool = True) -> DataFrame:
    """A verb and a time expression of its sentence: near each other, or one governing the other."""
    both = pairs.same_sentence(c.events, c.timexes.hint("merge")).where(_is_verb("pos1") & ~tx.is_quarter(F.col("value2")))
    token = lambda name, by: c.tokens.select("doc", F.col("sid").alias("sid1"), (F.col("idx") + by).alias("idx2"), F.col("token").alias(name), F.col("pos").alias(f"{name}_pos"))
    both = both.join(token("prev", 1).hint("merge"), ["doc", "sid1", "idx2"], "left")
    down = pairs.event_of_timex(c.events, c.timexes, c.deps).select("doc", "id1", "id2", F.lit(True).alias("down"))
    tokens = c.timexes.select("doc", F.col("sid").alias("sid1"), F.col("id").alias("id2"), F.explode(F.sequence(F.col("idx"), F.col("idx") + F.greatest(F.col("len"), F.lit(1)) - 1)).alias("gov_idx"))
    heads = c.events.select("doc", F.col("sid").alias("sid1"), F.col("idx").alias("dep_idx"), F.col("id").alias("id1"))
    up = tokens.join(c.deps.withColumnRenamed("sid", "sid1"), ["doc", "sid1", "gov_idx"]).join(heads, ["doc", "sid1", "dep_idx"]).select("doc", "id1", "id2", F.lit(True).alias("up")).distinct()
    both = both.join(down, ["doc", "id1", "id2"], "left").join(up, ["doc", "id1", "id2"], "left")
    d, none = F.col("idx2") - F.col("idx1"), F.lit(None).cast("string")
    now = F.when(F.lower("text2") == "now", F.when(F.col("aspect1") == "PROGRESSIVE", "INCLUDES").otherwise("VAGUE"))
    ahead = F.when((d == 1) | (F.coalesce(F.col("prev_pos"), F.lit("")) != "IN"), "IS_INCLUDED").otherwise(_looked_up(F.col("prev"), PREPOSITIONS, "IS_INCLUDED"))
    behind = F.when(F.col("down").isNull(), "VAGUE").otherwise(F.coalesce(now, F.when(d == -1, "IS_INCLUDED").when(F.col("prev") == "said", "VAGUE").otherwise("IS_INCLUDED")))
    relation = (
        F.when(F.lit(before) & d.between(1, between + 1), ahead)
        .when(F.lit(after) & d.between(-between - 1, -1), behind)
        .when(F.lit(governs) & F.col("down").isNotNull(), F.coalesce(now, F.lit("IS_INCLUDED")))
        .when(F.lit(governed) & F.col("up").isNotNull(), "IS_INCLUDED")
        .otherwise(none)
    )
    return _links(both, relation)


def time_time(c: Corpus, compat: bool = True) -> DataFrame:
    """Pairs of time expressions, creation times first, by their values' ranges."""
    times = tx.spanned(c.timexes, "value", compat)
    columns = ["doc", *[f"{n}{k}" for k in (1, 2) for n in ("id", "type", "value", "low", "high")]]
    text = pairs.same_or_next(times).select(*columns)
    side = lambda df, k: df.select("doc", *[F.col(n).alias(f"{n}{k}") for n in ("id", "type", "value", "low", "high")])
    kind = F.coalesce(F.col("type"), F.lit("DATE")) if "type" in c.dcts.columns else F.lit("DATE")
    made = side(tx.spanned(c.dcts, "value", compat).withColumn("type", kind), 1).join(side(times, 2), "doc")
    return _links(text.unionByName(made.select(*columns)), tx.related_columns())


def _by_tense_rules(c: Corpus, cls: str) -> DataFrame:
    both = pairs.governed(c.events, c.deps).drop("reln")
    if c.spans is not None:
        both = both.unionByName(pairs.dominated(c.events, c.spans), allowMissingColumns=True)
    both = both.where((F.col("cls1") == cls) & (F.col("cls2") != cls)).dropDuplicates(["doc", "id1", "id2"])
    rules = F.broadcast(c.events.sparkSession.createDataFrame(REPORTING_RULES, "t1 string, t2 string, a2 string, relation string"))
    matched = both.join(rules, (F.col("tense1") == F.col("t1")) & (F.col("tense2") == F.col("t2")) & (F.col("a2").isNull() | (F.col("aspect2") == F.col("a2"))))
    return matched.select(*LINK)


def reporting_governs(c: Corpus) -> DataFrame:
    """A reporting event and what it governs, by their tenses."""
    return _by_tense_rules(c, "REPORTING")


def intended_governs(c: Corpus) -> DataFrame:
    """As reporting_governs(), for events of class I_ACTION."""
    return _by_tense_rules(c, "I_ACTION")


def _state(tense: str, aspect: str, simple_past: bool, simple_present: bool, simple_aspect: bool) -> Column:
    t = F.col(tense)
    past, present = (t == "PAST") | (F.lit(simple_past) & (t == "PASTPART")), (t == "PRESENT") | (F.lit(simple_present) & (t == "PRESPART"))
    t = F.when(past, "PAST").when(present, "PRESENT").when(t == "FUTURE", "FUTURE")
    a = F.col(aspect)
    a = F.when((a == "PERFECTIVE") | (F.lit(simple_aspect) & (a == "PERFECTIVE_PROGRESSIVE")), "PERFECTIVE").when(a == "NONE", "NONE")
    return F.concat(t, F.lit("/"), a)


def reichenbach(c: Corpus, window: int = 1, same_sentence: bool = True, contexts: DataFrame | None = None, simple_past: bool = True, simple_present: bool = True, simple_aspect: bool = True) -> DataFrame:
    """Verbs up to window sentences apart by their reference times; with contexts (doc, id1, id2) only those of one context."""
    both = pairs.windowed(c.events.where(_is_verb("pos")), window, same_sentence)
    if contexts is not None:
        timed = contexts.select("doc", F.col("id1").alias("event"), F.col("id2").alias("context"))
        for k in (1, 2):
            both = both.join(timed.select("doc", F.col("event").alias(f"id{k}"), F.col("context").alias(f"context{k}")), ["doc", f"id{k}"], "left")
        both = both.where(F.col("context1").eqNullSafe(F.col("context2")))
    return _by_states(both, simple_past, simple_present, simple_aspect)


def reichenbach_in_contexts(c: Corpus, **simple: bool) -> DataFrame:
    """As reichenbach(), for verbs that share a context: an event and all that it governs."""
    edges = pairs.governed(c.events, c.deps)
    context = edges.select("doc", F.col("id1").alias("ctx"), F.col("id1").alias("id")).union(edges.select("doc", F.col("id1"), F.col("id2"))).distinct()
    shared = pairs.sharing_context(context)
    verbs = c.events.where(_is_verb("pos"))
    side = lambda k: verbs.select("doc", *[F.col(n).alias(f"{n}{k}") for n in ("id", "sid", "idx", "tense", "aspect")])
    both = shared.union(shared.select("doc", F.col("id2"), F.col("id1"))).join(side(1), ["doc", "id1"]).join(side(2), ["doc", "id2"]).where("(sid1, idx1) < (sid2, idx2)")
    return _by_states(both, **simple)


def _by_states(both: DataFrame, simple_past: bool = True, simple_present: bool = True, simple_aspect: bool = True) -> DataFrame:
    rows = [(a, b, r) for a, line in zip(REICHENBACH_STATES, REICHENBACH, strict=True) for b, r in zip(REICHENBACH_STATES, line.split(), strict=True) if r != "-"]
    rules = F.broadcast(both.sparkSession.createDataFrame(rows, "s1 string, s2 string, relation string"))  # a fixed table
    both = both.withColumns({f"s{k}": _state(f"tense{k}", f"aspect{k}", simple_past, simple_present, simple_aspect) for k in (1, 2)})
    return both.join(rules, ["s1", "s2"]).select(*LINK)


def times_in_order(c: Corpus) -> DataFrame:
    """All pairs of a document's time expressions that lie one before the other; PRESENT_REF counts as the creation day."""
    day = c.dcts.groupBy("doc").agg(F.min_by("value", "id").alias("dct"))
    times = c.timexes.select("doc", "sid", "idx", "id", "value").join(day, "doc", "left").withColumn("value", F.when(F.col("value") == "PRESENT_REF", F.coalesce("dct", "value")).otherwise(F.col("value"))).drop("dct")
    side = lambda k: times.select("doc", *[F.col(n).alias(f"{n}{k}") for n in ("sid", "idx", "id", "value")])
    both = side(1).join(side(2), "doc").where("(sid1, idx1, id1) < (sid2, idx2, id2)")
    ahead, behind = tx.earlier(F.col("value1"), F.col("value2")), tx.earlier(F.col("value2"), F.col("value1"))
    out = both.withColumn("ahead", F.when(ahead, True).when(behind, False)).where("ahead IS NOT NULL")
    return out.select("doc", F.when(F.col("ahead"), F.col("id1")).otherwise(F.col("id2")).alias("id1"), F.when(F.col("ahead"), F.col("id2")).otherwise(F.col("id1")).alias("id2"), F.lit("BEFORE").alias("relation"))


def clause_dependency(c: Corpus) -> DataFrame:
    """Event pairs with a dependency, by its name and the events' tense, aspect and class."""
    both = pairs.governed(c.events, c.deps)
    words = c.tokens.select("doc", F.col("sid").alias("sid1"), F.col("idx").alias("dep_idx"), F.lower("token").alias("word"))
    tied = c.deps.withColumnRenamed("sid", "sid1").where(F.col("reln").isin("mark", "advmod", "det")).join(words, ["doc", "sid1", "dep_idx"])
    tied = tied.groupBy("doc", "sid1", F.col("gov_idx").alias("idx2")).agg(*[F.max_by(F.when(F.col("reln") == r, F.col("word")), F.when(F.col("reln") == r, F.col("dep_idx"))).alias(r) for r in ("mark", "advmod", "det")])
    both = both.join(tied, ["doc", "sid1", "idx2"], "left")
    is_ = lambda name, *values: F.col(name).isin(*values)
    none = F.lit(None).cast("string")
    perfect = F.when(is_("aspect1", "NONE") | is_("tense1", "PAST") | is_("cls1", "REPORTING") | is_("cls2", "OCCURRENCE"), "AFTER")
    xcomp = F.when(is_("tense2", "PRESPART"), F.when(is_("cls1", "OCCURRENCE"), "SIMULTANEOUS").otherwise("IS_INCLUDED")).when(is_("cls1", "ASPECTUAL"), "IS_INCLUDED").otherwise("BEFORE")
    ccomp = (
        F.when(is_("tense2", "FUTURE"), "BEFORE")
        .when(is_("aspect2", "PERFECTIVE"), perfect)
        .when(is_("aspect1", "PERFECTIVE"), "VAGUE")
        .when(is_("tense1", "PAST") & is_("tense2", "PAST") & is_("aspect1", "NONE") & is_("aspect2", "NONE"), "AFTER")
        .when(is_("tense2", "PRESENT"), F.when(is_("cls1", "REPORTING") | (is_("cls2", "STATE", "I_STATE") & is_("tense1", "PRESENT") & is_("aspect1", "PROGRESSIVE")), "IS_INCLUDED").otherwise("VAGUE"))
    )
    dobj = F.when(is_("cls1", "ASPECTUAL"), "IS_INCLUDED").when(is_("tense2", "NONE") & is_("aspect2", "NONE"), F.when(F.col("det") == "a", "BEFORE")).otherwise("VAGUE")
    by_name = {
        "xcomp": xcomp, "ccomp": ccomp, "conj_and": F.lit("VAGUE"), "conj_or": F.lit("VAGUE"), "conj_but": F.lit("BEFORE"),
        "nsubj": F.when(is_("cls1", "ASPECTUAL"), "IS_INCLUDED").otherwise("VAGUE"), "dobj": dobj, "advcl": _looked_up(F.coalesce("mark", "advmod"), MARKERS),
    }
    relation = none
    for name, rule in by_name.items():
        relation = F.when(F.col("reln") == name, rule).otherwise(relation)
    return _links(both, relation)


def same_sense(c: Corpus, window: int = 1, same_sentence: bool = True) -> DataFrame:
    """Events that share a synset or lemma are vague to each other; time expressions of one lemma are simultaneous.

    synsets: doc, id, lemma, synsets (array) of events and timexes.
    """
    known = lambda k: c.synsets.select("doc", F.col("id").alias(f"id{k}"), F.col("lemma").alias(f"lemma{k}"), F.col("synsets").alias(f"synsets{k}"))
    both = pairs.windowed(c.events, window, same_sentence).join(known(1), ["doc", "id1"]).join(known(2), ["doc", "id2"])
    coarse = lambda p: F.regexp_extract(p, "^(VB|NN|JJ|RB)", 1)
    same = (coarse(F.col("pos1")) != "") & (coarse(F.col("pos1")) == coarse(F.col("pos2")))
    out = _links(both.where((same & F.arrays_overlap("synsets1", "synsets2")) | (F.col("lemma1") == F.col("lemma2"))), "VAGUE")
    if c.timexes is None:
        return out
    times = pairs.windowed(c.timexes, window, same_sentence).join(known(1), ["doc", "id1"]).join(known(2), ["doc", "id2"])
    return out.unionByName(_links(times.where("lemma1 = lemma2"), "SIMULTANEOUS"))


def reporting_on_creation_day(c: Corpus, left: int = 0, right: int = 0, present: bool = False, by_tense: bool = True) -> DataFrame:
    """Reporting events around a time expression of the creation day happen within it."""
    day = c.dcts.groupBy("doc").agg(F.min_by("value", "id").alias("dct"))
    own = c.timexes.join(day, "doc").where((F.col("value") == tx.to_day(F.col("dct"))) | (F.lit(present) & (F.col("value") == "PRESENT_REF"))).drop("dct")
    events = c.events.where(F.col("cls") == "REPORTING")
    if by_tense:
        events = events.where(~((F.col("tense") == "PAST") & (F.col("aspect") == "PERFECTIVE")))
    out = None
    for by in range(-right, left + 1):
        made = pairs.shifted(events, own, by).select("doc", "id1", "id2")
        out = made if out is None else out.unionByName(made)
    return _links(out, "IS_INCLUDED")


def all_vague(c: Corpus) -> DataFrame:
    return _links(pairs.all_pairs(c.events, c.timexes, c.dcts), "VAGUE")


def event_creation_time(c: Corpus) -> DataFrame:
    """Each event to the creation time, by class, tense and aspect."""
    both = pairs.with_creation_time(c.events, c.dcts)
    relation = (
        F.when(F.col("tense1") == "PAST", F.when(F.col("cls1") == "REPORTING", "IS_INCLUDED").otherwise("BEFORE"))
        .when((F.col("tense1") == "PRESENT") & (F.col("aspect1") == "PERFECTIVE"), "BEFORE")
    )
    return _links(both, relation)


def said_at_creation_time(c: Corpus) -> DataFrame:
    return _links(pairs.with_creation_time(c.events.where(F.lower("text") == "said"), c.dcts), "IS_INCLUDED")


def text_order(c: Corpus) -> DataFrame:
    """Everything of a sentence is before what follows."""
    both = pairs.same_sentence(c.events).select("doc", "id1", "id2")
    return _links(both.unionByName(pairs.same_sentence(c.timexes).select("doc", "id1", "id2")) if c.timexes is not None else both, "BEFORE")


def coreferent(c: Corpus) -> DataFrame:
    return _links(pairs.within_cluster(c.clusters), "SIMULTANEOUS")


def nominal(c: Corpus) -> DataFrame:
    """Nouns by the dependency to a time expression, or from the event that governs them."""
    nouns = c.events.where(F.startswith("pos", F.lit("NN")))
    timed = _links(pairs.event_of_timex(nouns, c.timexes, c.deps), _looked_up(F.col("reln"), NOMINAL_TIMEX))
    own = nouns.select("doc", F.col("id").alias("id2"))
    return timed.unionByName(_links(pairs.governor(c.events, c.deps).join(own, ["doc", "id2"], "left_semi"), _looked_up(F.col("reln"), NOMINAL_EVENT)))


def same_tense_vague(c: Corpus, classes: tuple[str, ...] = ("OCCURRENCE", "STATE", "I_STATE", "REPORTING", "PERCEPTION", "ASPECTUAL"), compat: bool = True) -> DataFrame:
    """Events of neighbouring sentences with equal tense and aspect; compat tests the first event's class only."""
    both = pairs.shifted(c.events, c.events, 1).where("tense1 = tense2 AND aspect1 = aspect2").where(F.col("cls1").isin(*classes))
    return _links(both if compat else both.where(F.col("cls2").isin(*classes)), "VAGUE")


#: Masks over an event pair's attributes: the kept attributes of both events and whether they share a sentence.
MASKS = [tuple(m) for m in (
    ("tense",), ("aspect",), ("cls",), ("tense", "aspect"), ("tense", "cls"), ("aspect", "cls"), ("tense", "aspect", "cls"),
)]


def patterns(both: DataFrame) -> DataFrame:
    """both with one row for each of 14 masks: 7 sets of attributes, with the sentence relation and without."""
    place = F.when(F.col("sid1") == F.col("sid2"), "SAME").otherwise("DIFFERENT")
    made = [F.concat_ws("|", F.lit("+".join(m) + ("@" if s else "")), *[F.coalesce(F.col(f"{a}{k}"), F.lit("-")) for k in (1, 2) for a in m], *([place] if s else [])) for m in MASKS for s in (False, True)]
    return both.withColumn("pattern", F.explode(F.array(*made)))


_ATTRIBUTES = [f"{a}{k}" for a in ("tense", "aspect", "cls") for k in (1, 2)]


def _kinds(both: DataFrame) -> DataFrame:
    """both with sid1 and sid2 0 in one sentence, 0 and 1 elsewhere: what patterns() tells apart, and nothing more, are kinds of pairs."""
    return both.select("doc", "id1", "id2", *_ATTRIBUTES, F.lit(0).alias("sid1"), F.when(F.col("sid1") == F.col("sid2"), 0).otherwise(1).alias("sid2"))


def learn_vague_patterns(both: DataFrame, gold: DataFrame, least_share: float = 0.7, least: int = 50) -> DataFrame:
    """pattern, n, share: patterns of pairs whose gold relation is VAGUE often enough. Pairs are counted by kind before masks are told."""
    labelled = _kinds(both).join(gold.select("doc", "id1", "id2", (F.col("relation") == "VAGUE").alias("vague")), ["doc", "id1", "id2"])
    kinds = labelled.groupBy(*_ATTRIBUTES, "sid1", "sid2").agg(F.count("*").alias("n"), F.count("vague").alias("told"), F.sum(F.col("vague").cast("long")).alias("vague"))
    counted = patterns(kinds).groupBy("pattern").agg(F.sum("n").alias("n"), (F.sum("vague").cast("double") / F.nullif(F.sum("told"), F.lit(0)).cast("double")).alias("share"))
    return counted.where((F.col("share") >= least_share) & (F.col("n") >= least))


def frequent_vague(c: Corpus, learned: DataFrame) -> DataFrame:
    """Pairs with a learned pattern; masks are told once a kind of pairs, not once a pair."""
    key = [*_ATTRIBUTES, "sid1", "sid2"]
    both = _kinds(pairs.same_or_next(c.events))
    kinds = patterns(both.select(*key).distinct()).join(learned.select("pattern"), "pattern", "left_semi").select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    hit = both.join(kinds, same[0] & same[1] & same[2] & same[3] & same[4] & same[5] & same[6] & same[7], "left_semi")
    return _links(hit.select("doc", "id1", "id2").distinct(), "VAGUE")


def reporting_before_quarter(c: Corpus, compat: bool = True) -> DataFrame:
    """A reporting event one or two tokens before a quarter is vague to it; compat looks for the quarter in the text, where it never is."""
    quarter = tx.is_quarter(F.col("text2" if compat else "value2"))
    return _links(pairs.same_sentence(c.events, c.timexes).where(quarter & (F.col("cls1") == "REPORTING") & (F.col("idx2") - F.col("idx1")).between(1, 2)), "VAGUE")


def state_governs_state(c: Corpus) -> DataFrame:
    return _links(pairs.governed(c.events, c.deps).where("cls1 = 'STATE' AND cls2 = 'STATE' AND idx1 < idx2"), "SIMULTANEOUS")


def dependency_report(c: Corpus) -> DataFrame:
    """For inspection only: how often each dependency stands between events of which classes."""
    return pairs.governed(c.events, c.deps).groupBy("reln", "cls1", "cls2", "tense1", "tense2").agg(F.count("*").alias("n"))


def dependency_pairs(c: Corpus) -> DataFrame:
    """doc, sid, id1, id2, reln with both events' words and attributes: what dependency_report() counts, one by one."""
    both = pairs.governed(c.events, c.deps).withColumnRenamed("sid1", "sid")
    names = [f"{n}{k}" for n in ("text", "pos", "tense", "aspect", "cls") for k in (1, 2) if f"{n}{k}" in both.columns]
    return both.select("doc", "sid", "id1", "id2", "reln", *names)


def before_word(c: Corpus, compat: bool = True) -> DataFrame:
    """A present event after the word before: the first follows it. compat asks for two tenses at once, which no event has."""
    tense = (F.col("tense2") == "PRESENT") & (F.col("tense2") == "PRESPART") if compat else F.col("tense2").isin("PRESENT", "PRESPART")
    near = c.tokens.where(F.lower("token") == "before").select("doc", F.col("sid").alias("sid1"), F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + 5)).alias("idx1")).distinct()
    return _links(pairs.same_sentence(c.events).where(tense).join(near, ["doc", "sid1", "idx1"], "left_semi"), "AFTER")


def same_tense_order(c: Corpus, compat: bool = True) -> DataFrame:
    """Events of a sentence with the same tense, in text order; compat doesn't compare aspects."""
    both = pairs.same_sentence(c.events).where("tense1 = tense2")
    return _links(both if compat else both.where("aspect1 = aspect2"), "BEFORE")


#: The sieves by name, as lists of names in configuration files refer to them.
REGISTRY = {f.__name__: f for f in (
    adjacent_verb_timex, time_time, reporting_governs, reichenbach, reichenbach_in_contexts, times_in_order, clause_dependency, same_sense, reporting_on_creation_day, all_vague, event_creation_time,
    said_at_creation_time, text_order, coreferent, nominal, intended_governs, same_tense_vague, frequent_vague, reporting_before_quarter, state_governs_state, before_word, same_tense_order,
)}
#: The cascade by default, most precise first; same_sense needs a lexicon and learned sieves models.
DEFAULT = ["adjacent_verb_timex", "time_time", "reporting_governs", "reichenbach", "clause_dependency", "reporting_on_creation_day", "all_vague"]


def load(names: list[str]) -> list[tuple[str, object]]:
    """Name and sieve for each known name, in order; unknown names are left out."""
    return [(n, REGISTRY[n]) for n in names if n in REGISTRY]
