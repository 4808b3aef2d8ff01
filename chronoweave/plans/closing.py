"""Queries of closures and cascades with mixed relations, and of sieves that the made corpus of plans.corpus doesn't reach, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.relations import canonical
from chronoweave.operators import cascade, closure, pairs, selection, sieves
from chronoweave.plans.catalogue import ENTITIES, plain, query
from chronoweave.plans.corpus import CORPUS, LINKS, corpus

# Four days of a user are a document here, in a07b a user is one. A time for each day of a document, before the next day's; it includes the day's first event, and each event is simultaneous with
# the next of its day. Every other day, links are told the other way round. All pairs of a document follow from these links.
_NODES = """{entities}, part AS (SELECT {doc} AS doc, sid, idx, id FROM ent), node AS (SELECT doc, sid, id, CASE WHEN row_number() OVER (PARTITION BY doc, sid ORDER BY idx) = 1 THEN 1 ELSE 2 END AS kind, idx FROM part
  UNION ALL SELECT DISTINCT doc, sid, 't' || sid, 0, -1 FROM part), placed AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY sid) AS day FROM node),
two AS (SELECT a.doc, a.id AS id1, b.id AS id2, greatest(a.kind, b.kind) AS kind, CASE WHEN a.sid < b.sid THEN 'BEFORE' WHEN a.sid > b.sid THEN 'AFTER' WHEN a.kind = 0 THEN 'INCLUDES' WHEN b.kind = 0 THEN 'IS_INCLUDED' ELSE 'SIMULTANEOUS' END AS relation,
  NOT CASE greatest(a.kind, b.kind) WHEN 0 THEN abs(a.day - b.day) = 1 WHEN 1 THEN a.day = b.day ELSE a.day = b.day AND least(a.kind, b.kind) > 0 AND abs(a.idx - b.idx) = 1 END AS closed
  FROM placed a JOIN placed b ON a.doc = b.doc AND a.id < b.id)"""
_WHOLE, _NODES = (_NODES.format(entities=ENTITIES, doc=doc) for doc in ("doc", "doc || '/' || sid // 4"))


def _told(spark: SparkSession, sf_dir: str, whole: bool = False) -> dict[str, DataFrame]:
    """doc, id1, id2, relation of the links given: between times, of times and first events, between events of a day. whole: a user is a document."""
    e = plain(spark, sf_dir)
    if not whole:
        e = e.withColumn("doc", F.concat_ws("/", "doc", F.floor(F.col("sid") / 4).cast("string")))
    time = F.concat(F.lit("t"), F.col("sid").cast("string"))
    days = e.select("doc", "sid", time.alias("id")).distinct()
    odd = F.col("sid") % 2 == 1

    def link(rows: DataFrame, a: str, b: str, relation: str, converse: str) -> DataFrame:
        return rows.select("doc", F.when(odd, F.col(b)).otherwise(F.col(a)).alias("id1"), F.when(odd, F.col(a)).otherwise(F.col(b)).alias("id2"), F.when(odd, converse).otherwise(F.lit(relation)).alias("relation"))

    following = days.withColumn("next", F.lead("id").over(Window.partitionBy("doc").orderBy("sid"))).where("next IS NOT NULL")
    first = e.groupBy("doc", "sid").agg(F.min_by("id", "idx").alias("first")).withColumn("time", time)
    near = e.withColumn("next", F.lead("id").over(Window.partitionBy("doc", "sid").orderBy("idx"))).where("next IS NOT NULL")
    return {"times": link(following, "id", "next", "BEFORE", "AFTER"), "firsts": link(first, "time", "first", "INCLUDES", "IS_INCLUDED"), "events": link(near, "id", "next", "SIMULTANEOUS", "SIMULTANEOUS")}


def _all_told(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    told = _told(spark, sf_dir, whole)
    return told["times"].unionByName(told["firsts"]).unionByName(told["events"])


def _in_id_order(links: DataFrame, *more: str) -> DataFrame:
    return canonical(links).select("doc", F.col("lo").alias("id1"), F.col("hi").alias("id2"), F.col("rel").alias("relation"), *more)


@query(f"WITH {_NODES} SELECT doc, id1, id2, relation, closed FROM two")
def a07_closure_of_mixed_relations(spark, sf_dir):
    return _in_id_order(closure.closure(_all_told(spark, sf_dir)), "closed")


@query(f"WITH {_WHOLE} SELECT doc, id1, id2, relation, closed FROM two")
def a07b_closure_by_stamps(spark, sf_dir):
    links = _all_told(spark, sf_dir, whole=True).withColumn("ordinal", F.row_number().over(Window.partitionBy("doc").orderBy(F.md5(F.concat_ws("|", "id1", "id2")))))
    return _in_id_order(closure.closure_by_stamps(links, closure.GROUPED), "closed")


@query(f"WITH {_NODES} SELECT doc, id1, id2, relation, closed, ['times', 'firsts', 'events'][kind + 1] AS origin FROM two")
def c05_cascade_with_closure(spark, sf_dir):
    told = _told(spark, sf_dir)
    given = [(name, lambda _, links=links: links) for name, links in told.items()]
    return _in_id_order(cascade.run(corpus(spark, sf_dir), given), "closed", "origin")


_STATUS = f"""{ENTITIES}, near AS (SELECT doc, id AS id1, lead(id) OVER (PARTITION BY doc ORDER BY idx) AS id2, event_id AS k FROM ent),
known AS (SELECT *, ['BEFORE', 'INCLUDES', 'SIMULTANEOUS'][1 + k % 3] AS rel FROM near WHERE id2 IS NOT NULL AND k % 4 > 0), new AS (SELECT *, ['BEFORE', 'IBEFORE', 'ENDED_BY', 'SIMULTANEOUS', 'AFTER'][1 + k % 5] AS relation FROM near WHERE id2 IS NOT NULL),
status AS (SELECT new.doc, new.id1, new.id2, relation, CASE WHEN known.doc IS NULL THEN 0 WHEN rel = relation OR (rel = 'BEFORE' AND relation = 'IBEFORE') OR (rel = 'INCLUDES' AND relation = 'ENDED_BY') THEN 1 ELSE 2 END AS status
  FROM new LEFT JOIN known ON known.doc = new.doc AND known.id1 = new.id1)"""
_INVERSE = "CASE relation WHEN 'BEFORE' THEN 'AFTER' WHEN 'AFTER' THEN 'BEFORE' WHEN 'IBEFORE' THEN 'IAFTER' WHEN 'ENDED_BY' THEN 'ENDS' ELSE relation END"


def _known_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Known links of neighbours, and new ones of the same pairs, told the other way round."""
    e = plain(spark, sf_dir).withColumn("k", F.substring("id", 3, 20).cast("long"))
    near = e.withColumn("next", F.lead("id").over(Window.partitionBy("doc").orderBy("idx"))).where("next IS NOT NULL")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("k") % len(values) + 1).cast("int"))
    known = near.where("k % 4 > 0").select("doc", F.col("id").alias("id1"), F.col("next").alias("id2"), pick(["BEFORE", "INCLUDES", "SIMULTANEOUS"]).alias("relation"))
    return known, near.select("doc", F.col("next").alias("id1"), F.col("id").alias("id2"), pick(["AFTER", "IAFTER", "ENDS", "SIMULTANEOUS", "BEFORE"]).alias("relation"))


@query(f"WITH {_STATUS} SELECT doc, id2 AS id1, id1 AS id2, {_INVERSE} AS relation, status FROM status")
def a08_link_status(spark, sf_dir):
    return closure.link_status(*_known_and_new(spark, sf_dir))


@query(f"WITH {_STATUS} SELECT doc, id2 AS id1, id1 AS id2, {_INVERSE} AS relation FROM status WHERE status < 2")
def a09_consistent_links(spark, sf_dir):
    return closure.is_consistent(*_known_and_new(spark, sf_dir))


@query(f"WITH {CORPUS}, made AS (SELECT a.doc, a.id AS id1, b.id AS id2, 'SIMULTANEOUS' AS relation FROM ev a JOIN ev b ON a.doc = b.doc AND a.text = b.text AND a.id < b.id) {LINKS}")
def r12_coreferent(spark, sf_dir):
    c = corpus(spark, sf_dir)
    c.clusters = c.events.select("doc", F.col("text").alias("cluster"), "id")
    return sieves.coreferent(c)


@query(f"""WITH {CORPUS}, s AS (SELECT doc, sid, idx, id, text AS lemma, 's' || k % 13 AS syn, regexp_extract(pos, '^(VB|NN|JJ|RB)', 1) AS part FROM ev), x AS (SELECT doc, sid, idx, id, text AS lemma FROM tx),
made AS (SELECT a.doc, a.id AS id1, b.id AS id2, 'VAGUE' AS relation FROM s a JOIN s b ON a.doc = b.doc AND ((a.sid = b.sid AND (a.idx, a.id) < (b.idx, b.id)) OR b.sid = a.sid + 1) WHERE (a.part <> '' AND a.part = b.part AND a.syn = b.syn) OR a.lemma = b.lemma
  UNION ALL SELECT a.doc, a.id, b.id, 'SIMULTANEOUS' FROM x a JOIN x b ON a.doc = b.doc AND ((a.sid = b.sid AND (a.idx, a.id) < (b.idx, b.id)) OR b.sid = a.sid + 1) WHERE a.lemma = b.lemma) {LINKS}""")
def r06_same_sense(spark, sf_dir):
    c = corpus(spark, sf_dir)
    sense = F.array(F.concat(F.lit("s"), (F.substring("id", 3, 20).cast("long") % 13).cast("string")))
    none = F.array().cast("array<string>")
    c.synsets = c.events.select("doc", "id", F.col("text").alias("lemma"), sense.alias("synsets")).unionByName(c.timexes.select("doc", "id", F.col("text").alias("lemma"), none.alias("synsets")))
    return sieves.same_sense(c)


_MASKED = " UNION ALL ".join(
    f"SELECT doc, id1, id2, '{'+'.join(m)}{'@' if s else ''}' || '|' || " + " || '|' || ".join(f"{a}{k}" for k in (1, 2) for a in m) + (" || '|' || place" if s else "") + " AS pattern FROM two" for m in sieves.MASKS for s in (False, True)
)
_VAGUE_TWO = f"""{CORPUS}, two AS (SELECT a.doc, a.id AS id1, b.id AS id2, a.tense AS tense1, b.tense AS tense2, a.aspect AS aspect1, b.aspect AS aspect2, a.cls AS cls1, b.cls AS cls2, CASE WHEN a.sid = b.sid THEN 'SAME' ELSE 'DIFFERENT' END AS place, (a.k + b.k) % 3 = 0 AND a.cls <> 'STATE' AS other
  FROM ev a JOIN ev b ON a.doc = b.doc AND ((a.sid = b.sid AND a.idx < b.idx) OR b.sid = a.sid + 1)), masked AS ({_MASKED}),
learned AS (SELECT pattern, count(*) AS n, avg((NOT other)::INT) AS share FROM masked JOIN two USING (doc, id1, id2) GROUP BY pattern HAVING count(*) >= 20 AND avg((NOT other)::INT) >= 0.8)"""


def _vague_patterns(spark: SparkSession, sf_dir: str) -> tuple[cascade.Corpus, DataFrame]:
    c = corpus(spark, sf_dir)
    both = pairs.same_or_next(c.events)
    number = lambda n: F.substring(n, 3, 20).cast("long")
    other = ((number("id1") + number("id2")) % 3 == 0) & (F.col("cls1") != "STATE")
    gold = both.select("doc", "id1", "id2", F.when(other, "BEFORE").otherwise("VAGUE").alias("relation"))
    return c, sieves.learn_vague_patterns(both, gold, 0.8, 20)


@query(f"WITH {_VAGUE_TWO} SELECT pattern, n, round(share, 9) AS share FROM learned")
def r16_learned_vague_patterns(spark, sf_dir):
    return _vague_patterns(spark, sf_dir)[1].withColumn("share", F.round("share", 9))


@query(f"WITH {_VAGUE_TWO} SELECT DISTINCT doc, id1, id2, 'VAGUE' AS relation FROM masked WHERE pattern IN (SELECT pattern FROM learned)")
def r16b_frequent_vague(spark, sf_dir):
    return sieves.frequent_vague(*_vague_patterns(spark, sf_dir))


@query(f"""WITH {CORPUS}, quarter AS (SELECT doc, sid, idx, id FROM tx WHERE substr(id, 2)::BIGINT % 2 = 0)
SELECT e.doc, e.id AS id1, q.id AS id2, 'VAGUE' AS relation FROM ev e JOIN quarter q ON q.doc = e.doc AND q.sid = e.sid AND q.idx - e.idx BETWEEN 1 AND 2 WHERE e.cls = 'REPORTING'""")
def r17_reporting_before_quarter(spark, sf_dir):
    c = corpus(spark, sf_dir)
    even = F.substring("id", 2, 20).cast("long") % 2 == 0
    c.timexes = c.timexes.withColumn("value", F.when(even, F.concat(F.substring("value", 1, 4), F.lit("-Q"), F.ceil(F.substring("value", 6, 2).cast("int") / 3).cast("string"))).otherwise(F.col("value")))
    return sieves.reporting_before_quarter(c, compat=False)


@query(f"""WITH {CORPUS}, near AS (SELECT DISTINCT doc, sid, idx + step AS idx FROM tok, (SELECT unnest(range(1, 6)) AS step) WHERE token = 'until')
SELECT a.doc, a.id AS id1, b.id AS id2, 'AFTER' AS relation FROM ev a JOIN ev b ON a.doc = b.doc AND a.sid = b.sid AND (a.idx, a.id) < (b.idx, b.id) SEMI JOIN near n ON n.doc = a.doc AND n.sid = a.sid AND n.idx = a.idx WHERE b.tense IN ('PRESENT', 'PRESPART')""")
def r20_before_word(spark, sf_dir):
    c = corpus(spark, sf_dir)
    c.tokens = c.tokens.withColumn("token", F.when(F.col("token") == "until", "before").otherwise(F.col("token")))
    return sieves.before_word(c, compat=False)


@query(f"""WITH {CORPUS}, word AS (SELECT doc, sid, idx, ['the', 'a', 'this', 'old'][1 + k % 4] AS token FROM tok), h AS (SELECT DISTINCT d.doc, d.sid, d.gov_idx AS idx FROM dep d JOIN word t ON t.doc = d.doc AND t.sid = d.sid AND t.idx = d.dep_idx WHERE d.reln IN ('nn', 'amod', 'poss') AND t.token IN ('the', 'this'))
SELECT ev.doc, ev.id, h.idx IS NOT NULL AS definite FROM ev LEFT JOIN h ON h.doc = ev.doc AND h.sid = ev.sid AND h.idx = ev.idx""")
def p20b_definite_by_determiner(spark, sf_dir):
    c = corpus(spark, sf_dir)
    k = F.substring("id", 3, 20).cast("long")
    every = c.events.select("doc", "sid", "idx", "id").unionByName(c.timexes.select("doc", "sid", "idx", F.concat(F.lit("ei"), F.substring("id", 2, 20)).alias("id")))
    words = every.select("doc", "sid", F.col("idx").alias("dep_idx"), F.element_at(F.array(*map(F.lit, ["the", "a", "this", "old"])), (k % 4 + 1).cast("int")).alias("dep"))
    deps = c.deps.withColumn("reln", F.when(F.col("reln").isin("nn", "amod", "poss"), "det").otherwise(F.col("reln"))).join(words, ["doc", "sid", "dep_idx"])
    return selection.definite(c.events, deps, "det").select("doc", "id", "definite")
