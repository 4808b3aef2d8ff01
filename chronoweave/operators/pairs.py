"""Candidate pairs of entities within a document: equi-joins on document and shifted sentence, never a cross join.

Entities have doc, sid (sentence, from 0), idx (token, from 1) and id; ord, their place in the document's
order, defaults to (sid, idx). Results have doc, id1, id2 and the ordinals that keep proposals in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    one = a.select("doc", *[F.col(c).alias(f"{c}1") for c in a.columns if c != "doc"])
    two = b.select("doc", *[F.col(c).alias(f"{c}2") for c in b.columns if c != "doc"])
    return one, two


def _before() -> Column:
    return F.struct("sid1", "idx1", "id1") < F.struct("sid2", "idx2", "id2")


def same_sentence(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Pairs of one sentence: of one table in text order, of two tables all of them."""
    one, two = _sides(a, a if b is None else b)
    out = one.join(two.withColumnRenamed("sid2", "sid1"), ["doc", "sid1"]).withColumn("sid2", F.col("sid1"))
    return out.where(_before()) if b is None else out


def shifted(a: DataFrame, b: DataFrame, by: int) -> DataFrame:
    """Pairs whose second sentence is by sentences after the first."""
    one, two = _sides(a, b)
    return one.join(two.withColumn("sid1", F.col("sid2") - by), ["doc", "sid1"])


def same_or_next(a: DataFrame) -> DataFrame:
    return same_sentence(a).unionByName(shifted(a, a, 1))


def windowed(a: DataFrame, window: int, same: bool = True) -> DataFrame:
    """Pairs up to window sentences apart: each first entity is sent to the sentences that its window reaches."""
    one, two = _sides(a, a)
    reach = F.explode(F.sequence(F.col("sid1") + (0 if same else 1), F.col("sid1") + window))
    return one.withColumn("sid2", reach).join(two, ["doc", "sid2"]).where((F.col("sid2") > F.col("sid1")) | _before())


def next_sentence_both_ways(events: DataFrame, timexes: DataFrame) -> DataFrame:
    """Event and timex of neighbouring sentences, in either order."""
    return shifted(events, timexes, 1).unionByName(shifted(events, timexes, -1))


def with_creation_time(entities: DataFrame, dcts: DataFrame) -> DataFrame:
    """Each entity with its document's first creation time. dcts: doc, id (and ord)."""
    first = dcts.groupBy("doc").agg(F.min_by("id", "ord" if "ord" in dcts.columns else "id").alias("id2"))
    return _sides(entities, entities)[0].join(first, "doc")


def all_pairs(events: DataFrame, timexes: DataFrame, dcts: DataFrame) -> DataFrame:
    """doc, id1, id2 of every pair that a link may have, in text order, creation times last."""
    e, t = events.select("doc", "sid", "idx", "id"), timexes.select("doc", "sid", "idx", "id")
    text = same_or_next(e.unionByName(t)).select("doc", "id1", "id2")
    made = with_creation_time(e.unionByName(t), dcts).select("doc", "id1", "id2")
    return text.unionByName(made)


def governed(events: DataFrame, deps: DataFrame) -> DataFrame:
    """Event pairs with a dependency between them. deps: doc, sid, reln, gov_idx, dep_idx."""
    one, two = _sides(events, events)
    edges = deps.select("doc", F.col("sid").alias("sid1"), "reln", F.col("gov_idx").alias("idx1"), F.col("dep_idx").alias("idx2"))
    return one.join(edges, ["doc", "sid1", "idx1"]).join(two.withColumnRenamed("sid2", "sid1"), ["doc", "sid1", "idx2"]).withColumn("sid2", F.col("sid1")).where("id1 <> id2")


def dominated(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Event pairs whose second stands in the phrase that the first heads. spans: doc, sid, idx, span_start, span_end."""
    one, two = _sides(events, events)
    own = spans.select("doc", F.col("sid").alias("sid1"), F.col("idx").alias("idx1"), "span_start", "span_end")
    both = one.join(own, ["doc", "sid1", "idx1"]).join(two.withColumnRenamed("sid2", "sid1"), ["doc", "sid1"])
    return both.where("idx2 >= span_start AND idx2 < span_end AND id1 <> id2").withColumn("sid2", F.col("sid1")).drop("span_start", "span_end")


def event_of_timex(events: DataFrame, timexes: DataFrame, deps: DataFrame) -> DataFrame:
    """doc, id1 (event), id2 (timex), reln: a dependency from the event to a token of the timex; the first one counts."""
    tokens = timexes.select("doc", F.col("sid").alias("sid1"), F.col("id").alias("id2"), F.explode(F.sequence(F.col("idx"), F.col("idx") + F.greatest(F.col("len"), F.lit(1)) - 1)).alias("dep_idx"))
    heads = events.select("doc", F.col("sid").alias("sid1"), F.col("idx").alias("gov_idx"), F.col("id").alias("id1"))
    edges = deps.withColumnRenamed("sid", "sid1")
    found = heads.join(edges, ["doc", "sid1", "gov_idx"]).join(tokens, ["doc", "sid1", "dep_idx"])
    return found.groupBy("doc", "id1", "id2").agg(F.min_by("reln", F.struct("dep_idx", "reln")).alias("reln"))


def governor(events: DataFrame, deps: DataFrame) -> DataFrame:
    """doc, id1 (the event that governs first in text order), reln and id2 (each governed event)."""
    return governed(events, deps).groupBy("doc", "id2").agg(F.min_by(F.struct("id1", "reln"), F.struct("idx1", "reln")).alias("g")).select("doc", "g.id1", "g.reln", "id2")


def nearest_before(entities: DataFrame, others: DataFrame) -> DataFrame:
    """doc, id1 (the nearest entity before), id2 (each other): one pass of a window over both, not a range join."""
    both = entities.select("doc", "sid", "idx", "id", F.lit(0).alias("kind")).unionByName(others.select("doc", "sid", "idx", "id", F.lit(1).alias("kind")))
    order = Window.partitionBy("doc", "sid").orderBy("idx", F.desc("kind"), "id")
    last = F.last(F.when(F.col("kind") == 0, F.col("id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("id1", last).where("kind = 1 AND id1 IS NOT NULL").select("doc", "id1", F.col("id").alias("id2"))


def nearest_after(entities: DataFrame, others: DataFrame) -> DataFrame:
    """doc, id1 (each other), id2 (the nearest entity after)."""
    turned = lambda df: df.withColumn("idx", -F.col("idx"))
    return nearest_before(turned(entities), turned(others)).select("doc", F.col("id2").alias("id1"), F.col("id1").alias("id2"))


def previous(entities: DataFrame) -> DataFrame:
    """doc, id1 (the entity just before in the sentence), id2."""
    w = Window.partitionBy("doc", "sid").orderBy("idx", "id")
    return entities.withColumn("id1", F.lag("id").over(w)).where("id1 IS NOT NULL").select("doc", "id1", F.col("id").alias("id2"))


def main_events(events: DataFrame, mains: DataFrame | None = None) -> DataFrame:
    """The main event of each sentence with that of the next sentence that has one; with mains, of the very next sentence.

    mains (doc, sid, idx) names main verbs, as graphs.tree_facts() finds them: the event there or, if none is, the closest one; a
    sentence of several events without a main verb has no main event. Without mains the first event stands for it.
    """
    own, step = events.withColumn("far", F.lit(0)), F.lead("id1")
    if mains is not None:
        count = F.count("*").over(Window.partitionBy("doc", "sid"))
        own = events.withColumn("n", count).join(mains.select("doc", "sid", F.col("idx").alias("main")), ["doc", "sid"], "left").where("n = 1 OR main IS NOT NULL").withColumn("far", F.coalesce(F.abs(F.col("idx") - F.col("main")), F.lit(0)))
    first = own.groupBy("doc", "sid").agg(F.min_by("id", F.struct("far", "idx", "id")).alias("id1"))
    if mains is None:
        return first.withColumn("id2", step.over(Window.partitionBy("doc").orderBy("sid"))).where("id2 IS NOT NULL").select("doc", "id1", "id2")
    then = first.select("doc", (F.col("sid") - 1).alias("sid"), F.col("id1").alias("id2"))
    return first.join(then, ["doc", "sid"]).select("doc", "id1", "id2")


def closest_timex(paths: DataFrame, dcts: DataFrame, events: DataFrame) -> DataFrame:
    """doc, id1 (event), id2: the timex with the shortest path, dates first, then the leftmost; else the creation time.

    paths: doc, id1, id2, length, type, idx2.
    """
    best = paths.groupBy("doc", "id1").agg(F.min_by("id2", F.struct("length", (F.col("type") != "DATE").cast("int"), "idx2")).alias("near"))
    made = dcts.groupBy("doc").agg(F.min("id").alias("dct"))
    own = events.select("doc", F.col("id").alias("id1")).join(best, ["doc", "id1"], "left").join(made, "doc", "left")
    return own.select("doc", "id1", F.coalesce("near", "dct").alias("id2")).where("id2 IS NOT NULL")


def within_cluster(members: DataFrame) -> DataFrame:
    """doc, id1, id2 of all pairs of a cluster's members (doc, cluster, id). A cluster's mentions are those of one document."""
    one, two = _sides(members.distinct(), members.distinct())
    return one.join(two.withColumnRenamed("cluster2", "cluster1"), ["doc", "cluster1"]).where("id1 < id2").select("doc", "id1", "id2").distinct()


def sharing_context(context: DataFrame) -> DataFrame:
    """doc, id1, id2 of different entities under a context key. context: doc, ctx, id; keys must be local to a sentence."""
    one, two = _sides(context, context)
    return one.join(two.withColumnRenamed("ctx2", "ctx1"), ["doc", "ctx1"]).where("id1 < id2").select("doc", "id1", "id2").distinct()


def unlinked(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """pairs without a link in either direction."""
    key = lambda df: df.withColumns({"lo": F.least("id1", "id2"), "hi": F.greatest("id1", "id2")})
    return key(pairs).join(key(links).select("doc", "lo", "hi"), ["doc", "lo", "hi"], "left_anti").drop("lo", "hi")
