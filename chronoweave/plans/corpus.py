"""The sieves, joins and scores of the temporal engine as queries over a corpus made from table events, each with its SQL.

Every fifth event is a time expression, the others are events whose attributes follow from their ids; neighbouring
tokens of a sentence are joined by a dependency. Names tell the operators: j pairs, r rule sieves, c cascade, a relations,
t time values, e extraction, g reports, p predicates, w windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import relations
from chronoweave.functions import timex as tx
from chronoweave.operators import cascade, closure, evaluate, extract, learned, pairs, selection, sieves
from chronoweave.plans.catalogue import ENTITIES, entities, query

# Attributes of the made corpus, in the order in which remainders choose them.
POS = ["VBD", "VB", "NN", "VBG"]
TENSES = ["PAST", "PRESENT", "FUTURE", "NONE", "PRESPART", "PASTPART"]
ASPECTS = ["NONE", "PERFECTIVE", "PROGRESSIVE", "PERFECTIVE_PROGRESSIVE"]
CLASSES = ["REPORTING", "OCCURRENCE", "STATE", "I_ACTION", "ASPECTUAL"]
RELNS = ["xcomp", "ccomp", "advcl", "dobj", "nsubj", "conj_but", "prep_in", "amod", "poss", "prep_before", "nn"]
WORDS = ["in", "on", "by", "until", "will", "should", "had", "left"]
TAGS = ["IN", "MD", "MD", "VB", "VBN", "RB", "VBD", "NN"]

CORPUS = f"""{ENTITIES}, tok AS (SELECT doc, sid, idx, event_id AS k, {WORDS}[1 + event_id % 8] AS token, {TAGS}[1 + event_id // 2 % 8] AS pos FROM ent),
ev AS (SELECT doc, sid, idx, id, event_id AS k, CASE WHEN event_id % 7 = 1 THEN 'said' ELSE 'w' || event_id % 11 END AS text, {POS}[1 + event_id % 4] AS pos, {TENSES}[1 + event_id // 3 % 6] AS tense,
  {ASPECTS}[1 + event_id // 5 % 4] AS aspect, {CLASSES}[1 + event_id // 2 % 5] AS cls FROM ent WHERE event_id % 5 <> 0),
tx AS (SELECT doc, sid, idx, 1 AS len, 't' || event_id AS id, CASE WHEN event_id % 15 = 0 THEN 'now' ELSE 'day' END AS text, 'DATE' AS type, CASE WHEN event_id % 10 = 0 THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END AS value FROM ent WHERE event_id % 5 = 0),
dct AS (SELECT doc, 't0' AS id, strftime(min(ts), '%Y-%m-%d') AS value FROM ent GROUP BY doc),
dep AS (SELECT doc, sid, {RELNS}[1 + event_id % 11] AS reln, lag(idx) OVER w AS gov_idx, idx AS dep_idx FROM ent WINDOW w AS (PARTITION BY doc, sid ORDER BY idx)),
gov AS (SELECT a.doc, a.id AS id1, b.id AS id2, d.reln, a.cls AS cls1, b.cls AS cls2, a.tense AS tense1, b.tense AS tense2, a.aspect AS aspect1, b.aspect AS aspect2, a.idx AS idx1, b.idx AS idx2, b.pos AS pos2
  FROM dep d JOIN ev a ON a.doc = d.doc AND a.sid = d.sid AND a.idx = d.gov_idx JOIN ev b ON b.doc = d.doc AND b.sid = d.sid AND b.idx = d.dep_idx)"""


def _pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> cascade.Corpus:
    e, k = entities(spark, sf_dir), F.col("event_id")
    div = lambda n: F.floor(k / n)
    own = e.where(k % 5 != 0).select(
        "doc", "sid", "idx", "id", F.when(k % 7 == 1, "said").otherwise(F.concat(F.lit("w"), (k % 11).cast("string"))).alias("text"), _pick(POS, k).alias("pos"),
        _pick(TENSES, div(3)).alias("tense"), _pick(ASPECTS, div(5)).alias("aspect"), _pick(CLASSES, div(2)).alias("cls"),
    )
    times = e.where(k % 5 == 0).select(
        "doc", "sid", "idx", F.lit(1).alias("len"), F.concat(F.lit("t"), k.cast("string")).alias("id"), F.when(k % 15 == 0, "now").otherwise("day").alias("text"), F.lit("DATE").alias("type"),
        F.when(k % 10 == 0, F.date_format("ts", "yyyy-MM")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("value"),
    )
    dcts = e.groupBy("doc").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("value")).select("doc", F.lit("t0").alias("id"), "value")
    toks = e.select("doc", "sid", "idx", _pick(WORDS, k).alias("token"), _pick(TAGS, div(2)).alias("pos"))
    before = pairs.previous(e.withColumn("id", F.col("idx")))  # neighbours of a sentence, by their places
    deps = before.select("doc", F.col("id1").alias("gov_idx"), F.col("id2").alias("dep_idx")).join(e.select("doc", "sid", F.col("idx").alias("dep_idx"), _pick(RELNS, k).alias("reln")), ["doc", "dep_idx"])
    return cascade.Corpus(events=own, timexes=times, dcts=dcts, deps=deps, tokens=toks)


LINKS = "SELECT doc, id1, id2, relation FROM made"


def _rules(name: str, rows: list[tuple]) -> str:
    return f"{name} AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in rows) + ")"


@query(f"WITH {CORPUS} SELECT a.doc, a.id AS id1, b.id AS id2 FROM ev a JOIN ev b ON a.doc = b.doc AND b.sid = a.sid + 1")
def j04_next_sentence_events(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return pairs.shifted(c.events, c.events, 1).select("doc", "id1", "id2")


@query(f"WITH {CORPUS} SELECT a.doc, a.id AS id1, b.id AS id2 FROM ev a JOIN tx b ON a.doc = b.doc AND b.sid = a.sid")
def j05_event_and_time_of_a_sentence(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return pairs.same_sentence(c.events, c.timexes).select("doc", "id1", "id2")


@query(f"WITH {CORPUS} SELECT a.doc, a.id AS id1, b.id AS id2 FROM ev a JOIN tx b ON a.doc = b.doc AND abs(b.sid - a.sid) = 1")
def j06_event_and_time_of_neighbours(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return pairs.next_sentence_both_ways(c.events, c.timexes).select("doc", "id1", "id2")


@query(f"WITH {CORPUS} SELECT doc, id1, id2, reln FROM gov")
def j10_governed_events(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return pairs.governed(c.events, c.deps).select("doc", "id1", "id2", "reln")


@query(f"WITH {CORPUS} SELECT a.doc, a.id AS id1, t.id AS id2, d.reln FROM dep d JOIN ev a ON a.doc = d.doc AND a.sid = d.sid AND a.idx = d.gov_idx JOIN tx t ON t.doc = d.doc AND t.sid = d.sid AND t.idx = d.dep_idx")
def j12_event_governs_time(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return pairs.event_of_timex(c.events, c.timexes, c.deps)


@query(f"WITH {CORPUS} SELECT doc, id1, reln, id2 FROM gov QUALIFY row_number() OVER (PARTITION BY doc, id2 ORDER BY idx1, reln) = 1")
def j13_governor(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return pairs.governor(c.events, c.deps)


@query(f"""WITH {CORPUS}, two AS (SELECT a.doc, a.id AS id1, b.id AS id2 FROM ev a JOIN ev b ON a.doc = b.doc AND ((a.sid = b.sid AND (a.idx, a.id) < (b.idx, b.id)) OR b.sid = a.sid + 1))
SELECT * FROM two WHERE NOT EXISTS (SELECT 1 FROM gov g WHERE g.doc = two.doc AND least(g.id1, g.id2) = least(two.id1, two.id2) AND greatest(g.id1, g.id2) = greatest(two.id1, two.id2))""")
def j20_pairs_without_a_link(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return pairs.unlinked(pairs.same_or_next(c.events), pairs.governed(c.events, c.deps)).select("doc", "id1", "id2")


SPANS = """span AS (SELECT doc, sid, idx, id, CASE WHEN length(value) = 7 THEN strptime(value || '-01', '%Y-%m-%d') ELSE strptime(value, '%Y-%m-%d') END AS low,
  CASE WHEN length(value) = 7 THEN strptime(value || '-28', '%Y-%m-%d') ELSE strptime(value, '%Y-%m-%d') END + INTERVAL 1 DAY - INTERVAL 1 SECOND AS high FROM (SELECT doc, sid, idx, id, value FROM tx UNION ALL SELECT doc, NULL, NULL, id, value FROM dct))"""


@query(f"""WITH {CORPUS}, {SPANS}, two AS (SELECT a.doc, a.id AS id1, b.id AS id2, a.low AS a, a.high AS b, b.low AS c, b.high AS d FROM span a JOIN span b ON a.doc = b.doc AND (((a.sid = b.sid AND a.idx < b.idx) OR b.sid = a.sid + 1) OR (a.sid IS NULL AND b.sid IS NOT NULL))),
made AS (SELECT *, CASE WHEN a = c AND b = d THEN 'SIMULTANEOUS' WHEN b <= c THEN 'BEFORE' WHEN a >= d THEN 'AFTER' WHEN a < c AND b > d THEN 'INCLUDES' WHEN a > c AND b < d THEN 'IS_INCLUDED' WHEN (a < c AND b < d) OR (a > c AND b > d) THEN 'VAGUE' END AS relation FROM two)
{LINKS} WHERE relation IS NOT NULL""")
def r02_time_time(spark, sf_dir):
    return sieves.time_time(corpus(spark, sf_dir))


def _by_rules(cls: str) -> str:
    rules = _rules("rules(t1, t2, a2, relation)", sieves.REPORTING_RULES)
    return f"WITH {CORPUS}, {rules}, made AS (SELECT g.doc, g.id1, g.id2, r.relation FROM gov g JOIN rules r ON g.tense1 = t1 AND g.tense2 = t2 AND (a2 IS NULL OR g.aspect2 = a2) WHERE cls1 = '{cls}' AND cls2 <> '{cls}') {LINKS}"


@query(_by_rules("REPORTING"))
def r03_reporting_governs(spark, sf_dir):
    return sieves.reporting_governs(corpus(spark, sf_dir))


@query(_by_rules("I_ACTION"))
def r14_intended_governs(spark, sf_dir):
    return sieves.intended_governs(corpus(spark, sf_dir))


_STATES = _rules("rules(s1, s2, relation)", [(a, b, r) for a, line in zip(sieves.REICHENBACH_STATES, sieves.REICHENBACH, strict=True) for b, r in zip(sieves.REICHENBACH_STATES, line.split(), strict=True) if r != "-"])
_STATE = """CASE WHEN tense IN ('PAST', 'PASTPART') THEN 'PAST' WHEN tense IN ('PRESENT', 'PRESPART') THEN 'PRESENT' WHEN tense = 'FUTURE' THEN 'FUTURE' END || '/' || CASE WHEN aspect IN ('PERFECTIVE', 'PERFECTIVE_PROGRESSIVE') THEN 'PERFECTIVE' WHEN aspect = 'NONE' THEN 'NONE' END"""


@query(f"""WITH {CORPUS}, {_STATES}, v AS (SELECT *, {_STATE} AS s FROM ev WHERE pos LIKE 'VB%'), two AS (SELECT a.doc, a.id AS id1, b.id AS id2, a.s AS s1, b.s AS s2 FROM v a JOIN v b ON a.doc = b.doc AND (b.sid = a.sid + 1 OR (a.sid = b.sid AND a.idx < b.idx))),
made AS (SELECT doc, id1, id2, relation FROM two JOIN rules USING (s1, s2)) {LINKS}""")
def r04_reichenbach(spark, sf_dir):
    return sieves.reichenbach(corpus(spark, sf_dir))


@query(f"""WITH {CORPUS}, {_STATES}, v AS (SELECT *, {_STATE} AS s FROM ev WHERE pos LIKE 'VB%'), ctx AS (SELECT doc, id1 AS ctx, id1 AS id FROM gov UNION SELECT doc, id1, id2 FROM gov),
two AS (SELECT DISTINCT x.doc, x.id AS id1, y.id AS id2 FROM ctx x JOIN ctx y ON x.doc = y.doc AND x.ctx = y.ctx), made AS (SELECT two.doc, id1, id2, relation FROM two JOIN v a ON a.doc = two.doc AND a.id = id1 JOIN v b ON b.doc = two.doc AND b.id = id2 AND (a.sid, a.idx) < (b.sid, b.idx) JOIN rules ON a.s = s1 AND b.s = s2) {LINKS}""")
def r04b_reichenbach_in_contexts(spark, sf_dir):
    return sieves.reichenbach_in_contexts(corpus(spark, sf_dir))


@query(f"""WITH {CORPUS}, d AS (SELECT tx.* FROM tx JOIN dct USING (doc) WHERE tx.value = dct.value), made AS (SELECT e.doc, e.id AS id1, d.id AS id2, 'IS_INCLUDED' AS relation FROM ev e JOIN d ON e.doc = d.doc AND e.sid BETWEEN d.sid - 1 AND d.sid + 1
  WHERE e.cls = 'REPORTING' AND NOT (e.tense = 'PAST' AND e.aspect = 'PERFECTIVE')) {LINKS}""")
def r07_reporting_on_creation_day(spark, sf_dir):
    return sieves.reporting_on_creation_day(corpus(spark, sf_dir), left=1, right=1)


@query(f"""WITH {CORPUS}, own AS (SELECT doc, sid, idx, id FROM ev UNION ALL SELECT doc, sid, idx, id FROM tx), made AS (
  SELECT a.doc, a.id AS id1, b.id AS id2, 'VAGUE' AS relation FROM own a JOIN own b ON a.doc = b.doc AND ((a.sid = b.sid AND (a.idx, a.id) < (b.idx, b.id)) OR b.sid = a.sid + 1) UNION ALL SELECT doc, own.id, dct.id, 'VAGUE' FROM own JOIN dct USING (doc)) {LINKS}""")
def r08_all_vague(spark, sf_dir):
    return sieves.all_vague(corpus(spark, sf_dir))


@query(f"""WITH {CORPUS}, made AS (SELECT ev.doc, ev.id AS id1, 't0' AS id2, CASE WHEN tense = 'PAST' AND cls = 'REPORTING' THEN 'IS_INCLUDED' WHEN tense = 'PAST' THEN 'BEFORE' WHEN tense = 'PRESENT' AND aspect = 'PERFECTIVE' THEN 'BEFORE' END AS relation FROM ev) {LINKS} WHERE relation IS NOT NULL""")
def r09_event_creation_time(spark, sf_dir):
    return sieves.event_creation_time(corpus(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT doc, id AS id1, 't0' AS id2, 'IS_INCLUDED' AS relation FROM ev WHERE text = 'said'")
def r10_said_at_creation_time(spark, sf_dir):
    return sieves.said_at_creation_time(corpus(spark, sf_dir))


@query(f"""WITH {CORPUS}, made AS (SELECT a.doc, a.id AS id1, b.id AS id2, 'BEFORE' AS relation FROM ev a JOIN ev b ON a.doc = b.doc AND a.sid = b.sid AND a.idx < b.idx
  UNION ALL SELECT a.doc, a.id, b.id, 'BEFORE' FROM tx a JOIN tx b ON a.doc = b.doc AND a.sid = b.sid AND a.idx < b.idx) {LINKS}""")
def r11_text_order(spark, sf_dir):
    return sieves.text_order(corpus(spark, sf_dir))


@query(f"""WITH {CORPUS}, made AS (SELECT a.doc, a.id AS id1, t.id AS id2, CASE d.reln WHEN 'amod' THEN 'SIMULTANEOUS' WHEN 'nn' THEN 'IS_INCLUDED' WHEN 'poss' THEN 'IS_INCLUDED' WHEN 'prep_in' THEN 'IS_INCLUDED' END AS relation
  FROM dep d JOIN ev a ON a.doc = d.doc AND a.sid = d.sid AND a.idx = d.gov_idx AND a.pos LIKE 'NN%' JOIN tx t ON t.doc = d.doc AND t.sid = d.sid AND t.idx = d.dep_idx
  UNION ALL SELECT doc, id1, id2, CASE WHEN reln = 'prep_before' THEN 'BEFORE' END FROM gov WHERE pos2 LIKE 'NN%') {LINKS} WHERE relation IS NOT NULL""")
def r13_nominal(spark, sf_dir):
    return sieves.nominal(corpus(spark, sf_dir))


@query(f"""WITH {CORPUS} SELECT a.doc, a.id AS id1, b.id AS id2, 'VAGUE' AS relation FROM ev a JOIN ev b ON a.doc = b.doc AND b.sid = a.sid + 1 AND a.tense = b.tense AND a.aspect = b.aspect WHERE a.cls <> 'I_ACTION'""")
def r15_same_tense_vague(spark, sf_dir):
    return sieves.same_tense_vague(corpus(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT doc, id1, id2, 'SIMULTANEOUS' AS relation FROM gov WHERE cls1 = 'STATE' AND cls2 = 'STATE' AND idx1 < idx2")
def r18_state_governs_state(spark, sf_dir):
    return sieves.state_governs_state(corpus(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT reln, cls1, cls2, tense1, tense2, count(*) AS n FROM gov GROUP BY ALL")
def r19_dependency_report(spark, sf_dir):
    return sieves.dependency_report(corpus(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT a.doc, a.id AS id1, b.id AS id2, 'BEFORE' AS relation FROM ev a JOIN ev b ON a.doc = b.doc AND a.sid = b.sid AND a.idx < b.idx AND a.tense = b.tense")
def r21_same_tense_order(spark, sf_dir):
    return sieves.same_tense_order(corpus(spark, sf_dir))


_CLAUSE = """CASE reln
  WHEN 'xcomp' THEN CASE WHEN tense2 = 'PRESPART' THEN CASE WHEN cls1 = 'OCCURRENCE' THEN 'SIMULTANEOUS' ELSE 'IS_INCLUDED' END WHEN cls1 = 'ASPECTUAL' THEN 'IS_INCLUDED' ELSE 'BEFORE' END
  WHEN 'ccomp' THEN CASE WHEN tense2 = 'FUTURE' THEN 'BEFORE' WHEN aspect2 = 'PERFECTIVE' THEN CASE WHEN aspect1 = 'NONE' OR tense1 = 'PAST' OR cls1 = 'REPORTING' OR cls2 = 'OCCURRENCE' THEN 'AFTER' END WHEN aspect1 = 'PERFECTIVE' THEN 'VAGUE'
    WHEN tense1 = 'PAST' AND tense2 = 'PAST' AND aspect1 = 'NONE' AND aspect2 = 'NONE' THEN 'AFTER' WHEN tense2 = 'PRESENT' THEN CASE WHEN cls1 = 'REPORTING' OR (cls2 IN ('STATE', 'I_STATE') AND tense1 = 'PRESENT' AND aspect1 = 'PROGRESSIVE') THEN 'IS_INCLUDED' ELSE 'VAGUE' END END
  WHEN 'conj_but' THEN 'BEFORE' WHEN 'nsubj' THEN CASE WHEN cls1 = 'ASPECTUAL' THEN 'IS_INCLUDED' ELSE 'VAGUE' END
  WHEN 'dobj' THEN CASE WHEN cls1 = 'ASPECTUAL' THEN 'IS_INCLUDED' WHEN tense2 = 'NONE' AND aspect2 = 'NONE' THEN NULL ELSE 'VAGUE' END END"""


@query(f"WITH {CORPUS}, made AS (SELECT doc, id1, id2, {_CLAUSE} AS relation FROM gov) {LINKS} WHERE relation IS NOT NULL")
def r05_clause_dependency(spark, sf_dir):
    return sieves.clause_dependency(corpus(spark, sf_dir))


# Two sieves in order; then closure over a forest of such links is checked by q09.
_TWO = """one AS (SELECT doc, id1, id2, 'SIMULTANEOUS' AS relation, 'state' AS sieve, 0 AS rank FROM gov WHERE cls1 = 'STATE' AND cls2 = 'STATE' AND idx1 < idx2
  UNION ALL SELECT a.doc, a.id, b.id, 'BEFORE', 'tense', 1 FROM ev a JOIN ev b ON a.doc = b.doc AND a.sid = b.sid AND a.idx < b.idx AND a.tense = b.tense)"""


def _two(c: cascade.Corpus) -> list:
    return [("state", sieves.state_governs_state), ("tense", sieves.same_tense_order)]


@query(f"WITH {CORPUS}, {_TWO} SELECT doc, id1, id2, relation, false AS closed, sieve AS origin FROM one QUALIFY row_number() OVER (PARTITION BY doc, least(id1, id2), greatest(id1, id2) ORDER BY rank) = 1")
def c01_cascade_without_closure(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return cascade.run(c, _two(c), close=False)


_GOLD = "gold AS (SELECT doc, id1, id2, CASE WHEN idx1 % 3 = 0 THEN 'SIMULTANEOUS' ELSE 'BEFORE' END AS relation FROM gov)"


def _gold(c: cascade.Corpus) -> DataFrame:
    return pairs.governed(c.events, c.deps).select("doc", "id1", "id2", F.when(F.col("idx1") % 3 == 0, "SIMULTANEOUS").otherwise("BEFORE").alias("relation"))


@query(f"""WITH {CORPUS}, {_TWO}, {_GOLD}, m AS (SELECT one.sieve, one.relation AS guess, CASE WHEN g.id1 = one.id1 OR g.relation = 'SIMULTANEOUS' THEN g.relation WHEN g.relation = 'BEFORE' THEN 'AFTER' END AS truth
  FROM one LEFT JOIN gold g ON g.doc = one.doc AND least(g.id1, g.id2) = least(one.id1, one.id2) AND greatest(g.id1, g.id2) = greatest(one.id1, one.id2)),
s AS (SELECT sieve, count(*) AS proposed, count(*) FILTER (WHERE guess = truth) AS correct, count(*) FILTER (WHERE guess <> truth) AS incorrect FROM m GROUP BY sieve)
SELECT *, round(coalesce(correct / nullif(correct + incorrect, 0), 0), 9) AS precision FROM s""")
def c06_gauntlet(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return cascade.gauntlet(c, _two(c), _gold(c)).withColumn("precision", F.round("precision", 9))


@query(f"""WITH {CORPUS}, {_TWO}, l AS (SELECT doc, id1, id2, relation FROM one), n AS (SELECT *, row_number() OVER (PARTITION BY doc, least(id1, id2), greatest(id1, id2) ORDER BY id1, id2, relation) AS n FROM l) SELECT doc, id1, id2, relation FROM n WHERE n = 1""")
def c02_without_repeats(spark, sf_dir):
    c = corpus(spark, sf_dir)
    made = cascade.proposals(c, _two(c)).select("doc", "id1", "id2", "relation").withColumn("ordinal", F.lit(0))
    return cascade.without_repeats(made).select("doc", "id1", "id2", "relation")


_NAMES = "[" + ", ".join(f"'{r}'" for r in relations.RELATIONS) + "]"
_PAIRS = [*relations.INVERSE_PAIRS, *[(b, a) for a, b in relations.INVERSE_PAIRS]]
_INVERSE = "CASE relation " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _PAIRS) + " ELSE relation END"
_NAMED = f"{ENTITIES}, l AS (SELECT doc, 'a' || event_id AS id1, 'b' || event_id AS id2, {_NAMES}[1 + event_id % 17] AS relation, event_id AS k FROM ent)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    return entities(spark, sf_dir).select("doc", F.concat(F.lit("a"), k).alias("id1"), F.concat(F.lit("b"), k).alias("id2"), _pick(relations.RELATIONS, F.col("event_id")).alias("relation"), F.col("event_id").alias("k"))


@query(f"""WITH {_NAMED} SELECT k, {_INVERSE} AS inverse,
  CASE WHEN relation = 'IBEFORE' THEN 'BEFORE' WHEN relation IN ('INCLUDES', 'BEGINS', 'ENDS', 'SIMULTANEOUS') THEN 'OVERLAP' ELSE relation END AS symmetry, CASE WHEN relation IN ('BEFORE', 'IBEFORE') THEN 'BEFORE' ELSE 'NONE' END AS before,
  CASE WHEN relation IN ('BEFORE', 'AFTER', 'NONE', 'BEFORE_OR_OVERLAP', 'OVERLAP_OR_AFTER') THEN relation WHEN relation = 'IBEFORE' THEN 'BEFORE' ELSE 'OVERLAP' END AS tempeval,
  CASE WHEN relation = 'IBEFORE' THEN 'BEFORE' WHEN relation IN ('INCLUDES', 'BEGINS', 'ENDS', 'SIMULTANEOUS') THEN 'OVERLAP' ELSE relation END AS basic FROM l""")
def a03_relation_modes(spark, sf_dir):
    r = F.col("relation")
    return _named(spark, sf_dir).select("k", relations.inverted(r).alias("inverse"), *[relations.reduced(r, m.upper()).alias(m) for m in ("symmetry", "before", "tempeval", "basic")])


@query(f"""WITH {_NAMED} SELECT k, CASE WHEN relation IN ('BEGINS', 'ENDS') THEN id2 ELSE id1 END AS id1, CASE WHEN relation IN ('BEGINS', 'ENDS') THEN id1 ELSE id2 END AS id2, CASE WHEN relation = 'IBEFORE' THEN 'BEFORE' WHEN relation IN ('BEGINS', 'ENDS') THEN 'INCLUDES' ELSE relation END AS relation FROM l""")
def a03b_reduced_links(spark, sf_dir):
    return relations.reduced_links(_named(spark, sf_dir), "REDUCED").select("k", "id1", "id2", "relation")


@query(f"""WITH {_NAMED}, t AS (SELECT *, relation IN ('AFTER', 'IAFTER', 'IS_INCLUDED', 'BEGUN_BY', 'ENDED_BY') AS t FROM l) SELECT k, CASE WHEN t THEN id2 ELSE id1 END AS id1, CASE WHEN t THEN id1 ELSE id2 END AS id2, CASE WHEN t THEN {_INVERSE} ELSE relation END AS relation FROM t""")
def a04_one_direction(spark, sf_dir):
    return relations.one_direction(_named(spark, sf_dir)).select("k", "id1", "id2", "relation")


@query(f"""WITH {CORPUS}, near AS (SELECT doc, lag(id) OVER w AS id1, id AS id2 FROM ev WINDOW w AS (PARTITION BY doc, sid ORDER BY idx)), all_ AS (SELECT a.doc, b.id AS id1, a.id AS id2 FROM ev a JOIN ev b ON a.doc = b.doc AND a.sid = b.sid AND a.idx < b.idx AND (a.idx + b.idx) % 2 = 0)
SELECT doc, id1, id2, 'AFTER' AS relation FROM all_""")
def a10_closure_on_candidates(spark, sf_dir):
    c = corpus(spark, sf_dir)
    asked = pairs.same_sentence(c.events).where("(idx1 + idx2) % 2 = 0").select("doc", F.col("id2").alias("id1"), F.col("id1").alias("id2"))
    return closure.closure_on(asked, pairs.previous(c.events).withColumn("relation", F.lit("BEFORE"))).select("doc", "id1", "id2", "relation")


@query(f"""WITH {CORPUS}, two AS (SELECT a.doc, a.id AS id1, b.id AS id2, a.value AS v, b.value AS w FROM tx a JOIN tx b ON a.doc = b.doc AND b.sid = a.sid + 1)
SELECT doc, id1, id2, CASE WHEN substr(v, 1, 7) < substr(w, 1, 7) OR (substr(v, 1, 7) = substr(w, 1, 7) AND length(v) = 10 AND length(w) = 10 AND v < w) THEN 'BEFORE' WHEN substr(w, 1, 7) < substr(v, 1, 7) OR (substr(v, 1, 7) = substr(w, 1, 7) AND length(v) = 10 AND length(w) = 10 AND w < v) THEN 'AFTER'
  WHEN length(v) = 7 AND length(w) = 10 THEN 'INCLUDES' WHEN length(v) = 10 AND length(w) = 7 THEN 'IS_INCLUDED' ELSE 'SIMULTANEOUS' END AS relation FROM two""")
def t12_known_relation(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return pairs.shifted(c.timexes, c.timexes, 1).select("doc", "id1", "id2", tx.known_relation(F.col("value1"), F.col("value2")).alias("relation"))


@query(f"""WITH {CORPUS}, two AS (SELECT a.doc, a.id AS id1, b.id AS id2, a.value AS v, b.value AS w FROM tx a JOIN tx b ON a.doc = b.doc AND (a.sid, a.idx, a.id) < (b.sid, b.idx, b.id)), o AS (SELECT *, length(v) = 10 AND length(w) = 10 AS days FROM two)
SELECT doc, id1, id2, 'BEFORE' AS relation FROM o WHERE substr(v, 1, 7) < substr(w, 1, 7) OR (substr(v, 1, 7) = substr(w, 1, 7) AND days AND v < w) UNION ALL SELECT doc, id2, id1, 'BEFORE' FROM o WHERE substr(w, 1, 7) < substr(v, 1, 7) OR (substr(v, 1, 7) = substr(w, 1, 7) AND days AND w < v)""")
def t11_times_of_a_document_in_order(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return sieves.times_in_order(c)


@query(f"""WITH {CORPUS}, r AS (SELECT *, pos LIKE 'VB%' OR pos LIKE 'TO%' OR pos LIKE 'RB%' AS part, lag(token) OVER w AS word_before, lag(pos) OVER w AS tag_before FROM tok WINDOW w AS (PARTITION BY doc, sid ORDER BY idx)),
g AS (SELECT *, sum(CASE WHEN part THEN 0 ELSE 1 END) OVER (PARTITION BY doc, sid ORDER BY idx) AS run FROM r), p AS (SELECT * FROM g WHERE part),
v AS (SELECT *, first(word_before) OVER x AS word, first(tag_before) OVER x AS tag, list(pos) FILTER (WHERE pos LIKE 'VB%') OVER x AS verbs FROM p WINDOW x AS (PARTITION BY doc, sid, run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc, sid, idx, CASE WHEN tag = 'MD' AND word IN ('will', 'wo') THEN 'FUTURE' WHEN verbs[1] = 'VBD' OR (verbs[1] = 'VB' AND len(verbs) > 1 AND verbs[2] = 'VBN') THEN 'PAST' WHEN word IN ('should', 'shall', 'could') THEN 'FUTURE' WHEN tag = 'MD' THEN NULL ELSE 'PRESENT' END AS tense FROM v WHERE pos LIKE 'VB%'""")
def e08_group_tense(spark, sf_dir):
    return extract.group_tense(corpus(spark, sf_dir).tokens)


@query(f"""WITH {CORPUS}, n AS (SELECT *, lead(pos) OVER (PARTITION BY doc, sid ORDER BY idx) AS next FROM tok), v AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY sid, idx) AS n FROM n WHERE pos LIKE 'VB%' AND NOT coalesce(next LIKE 'VB%', false))
SELECT doc, sid, idx, 'e' || n AS eid, 'ei' || n AS id, token AS text, pos FROM v""")
def e05_rule_events(spark, sf_dir):
    return extract.rule_events(corpus(spark, sf_dir).tokens)


@query(f"""WITH {CORPUS}, two AS (SELECT a.doc, a.id AS id1, b.id AS id2 FROM ev a JOIN ev b ON a.doc = b.doc AND a.sid = b.sid AND a.idx < b.idx)
SELECT two.*, CASE WHEN EXISTS (SELECT 1 FROM gov g WHERE g.doc = two.doc AND least(g.id1, g.id2) = least(two.id1, two.id2) AND greatest(g.id1, g.id2) = greatest(two.id1, two.id2)) THEN 'OVERLAP' ELSE 'NONE' END AS label FROM two""")
def e15_existence_rows(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return learned.existence_rows(pairs.same_sentence(c.events).select("doc", "id1", "id2"), _gold(c)).select("doc", "id1", "id2", "label")


@query(f"""WITH {CORPUS}, two AS (SELECT a.doc, a.id AS id1, b.id AS id2, a.sid, a.idx AS i, b.idx AS j FROM ev a JOIN ev b ON a.doc = b.doc AND a.sid = b.sid AND a.idx < b.idx)
SELECT doc, id1, id2, (SELECT count(*) FROM ev e WHERE e.doc = two.doc AND e.sid = two.sid AND e.idx > i AND e.idx < j) AS between_, (SELECT count(*) FROM ev e WHERE e.doc = two.doc AND e.sid = two.sid AND e.idx > i AND e.idx < j) = 0 AS sequential FROM two""")
def w01_interlopers(spark, sf_dir):
    return selection.interlopers(corpus(spark, sf_dir).events).withColumnRenamed("between", "between_")


@query(f"WITH {CORPUS}, l AS (SELECT doc, id AS id1, 't0' AS id2 FROM ev WHERE k % 3 = 0 UNION ALL SELECT doc, 't0', id FROM ev WHERE k % 3 = 1) SELECT text AS word, count(*) AS n FROM l JOIN ev ON ev.doc = l.doc AND ev.id = CASE WHEN l.id1 = 't0' THEN l.id2 ELSE l.id1 END GROUP BY text")
def g06_creation_time_links_by_word(spark, sf_dir):
    c = corpus(spark, sf_dir)
    k = F.substring("id", 3, 20).cast("long") % 3
    links = c.events.where(k < 2).select("doc", F.when(k == 0, F.col("id")).otherwise("t0").alias("id1"), F.when(k == 0, "t0").otherwise(F.col("id")).alias("id2"))
    return selection.creation_links_by_word(links, c.events, c.dcts)


@query(f"""WITH {CORPUS}, {_GOLD}, n AS (SELECT g.doc, unnest([g.id1, g.id2]) AS id, g.relation FROM gold g JOIN ev a ON a.doc = g.doc AND a.id = g.id1 WHERE a.tense = 'NONE' AND a.aspect = 'NONE')
SELECT doc, id, count(*) FILTER (WHERE relation = 'BEFORE') AS vague, count(*) AS n FROM n GROUP BY doc, id""")
def g04_vague_by_nominal(spark, sf_dir):
    c = corpus(spark, sf_dir)
    links = _gold(c).withColumn("relation", F.when(F.col("relation") == "BEFORE", "VAGUE").otherwise(F.col("relation")))
    return selection.vague_by_nominal(links, c.events).select("doc", "id", "vague", "n")


@query(f"WITH {CORPUS} SELECT aspect AS value, count(*) AS n FROM ev GROUP BY aspect")
def g04b_attribute_counts(spark, sf_dir):
    return selection.counts_of(corpus(spark, sf_dir).events, "aspect")


@query(f"""WITH {CORPUS}, {_GOLD} SELECT b.pos || '|' || b.cls AS profile, count(*) FILTER (WHERE relation = 'BEFORE') AS "BEFORE", count(*) FILTER (WHERE relation = 'SIMULTANEOUS') AS "SIMULTANEOUS" FROM gold g JOIN ev b ON b.doc = g.doc AND b.id = g.id2 GROUP BY ALL""")
def g13_profiles_by_label(spark, sf_dir):
    c = corpus(spark, sf_dir)
    own = c.events.select("doc", F.col("id").alias("id2"), F.concat_ws("|", "pos", "cls").alias("profile"))
    return selection.profiles(_gold(c).join(own, ["doc", "id2"]), ["BEFORE", "SIMULTANEOUS"])


@query(f"WITH {CORPUS}, {_GOLD} SELECT g.doc, g.id1, g.id2, g.relation FROM gold g JOIN ev a ON a.doc = g.doc AND a.id = g.id1 JOIN ev b ON b.doc = g.doc AND b.id = g.id2 WHERE a.sid = b.sid AND g.relation NOT IN ('NONE', 'OVERLAP') AND abs(a.idx - b.idx) <= 3")
def e12_training_selection(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return selection.training_links(_gold(c), c.events, sentences="same", longest=3).select("doc", "id1", "id2", "relation")


@query(f"""WITH {CORPUS}, h AS (SELECT DISTINCT d.doc, d.sid, d.gov_idx AS idx FROM dep d JOIN tok t ON t.doc = d.doc AND t.sid = d.sid AND t.idx = d.dep_idx WHERE d.reln = 'nn' AND t.token LIKE 'th%')
SELECT ev.doc, ev.id, h.idx IS NOT NULL AS definite FROM ev LEFT JOIN h ON h.doc = ev.doc AND h.sid = ev.sid AND h.idx = ev.idx""")
def p20_definite(spark, sf_dir):
    c = corpus(spark, sf_dir)
    words = c.tokens.select("doc", "sid", F.col("idx").alias("dep_idx"), F.col("token").alias("dep"))
    return selection.definite(c.events, c.deps.join(words, ["doc", "sid", "dep_idx"]), "nn").select("doc", "id", "definite")
