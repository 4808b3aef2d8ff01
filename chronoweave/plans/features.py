"""Queries of trees as intervals, pair features, lexical predicates and sieves as table functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import graphs, lexicon, linkfeatures, pairs, sieves, tablefunction, trees
from chronoweave.plans.catalogue import ENTITIES, plain, query, read
from chronoweave.plans.corpus import CORPUS, corpus
from chronoweave.scratch import written

# The tree of an order: a clause of nested verb phrases, one a line, each with a verb, a noun phrase and the next line's phrase.
_LINES = """line AS (SELECT l_orderkey AS doc, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey")
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(line)).alias("lines"))  # the lines of an order
    phrase = F.transform("lines", lambda x, i: F.concat(F.lit("(VP (VB v"), (i + 1).cast("string"), F.lit(") (NP (DT the) (NN n"), x["l_partkey"].cast("string"), F.lit("))")))
    return rows.select("doc", F.lit(0).alias("sid"), F.concat(F.lit("(S "), F.array_join(phrase, " "), F.expr("repeat(')', size(lines))"), F.lit(")")).alias("parse"))


@query(f"""WITH {_LINES}, node AS (SELECT doc, 0 AS node, 5 * max(n) AS last, -1 AS parent, 1 AS depth, 'S' AS label, NULL AS word, 1 AS span_start, 3 * max(n) + 1 AS span_end FROM line GROUP BY doc
  UNION ALL SELECT doc, 5 * i - 4, 5 * n, CASE WHEN i = 1 THEN 0 ELSE 5 * i - 9 END, i + 1, 'VP', NULL, 3 * i - 2, 3 * n + 1 FROM line UNION ALL SELECT doc, 5 * i - 3, 5 * i - 3, 5 * i - 4, i + 2, 'VB', 'v' || i, 3 * i - 2, 3 * i - 1 FROM line
  UNION ALL SELECT doc, 5 * i - 2, 5 * i, 5 * i - 4, i + 2, 'NP', NULL, 3 * i - 1, 3 * i + 1 FROM line UNION ALL SELECT doc, 5 * i - 1, 5 * i - 1, 5 * i - 2, i + 3, 'DT', 'the', 3 * i - 1, 3 * i FROM line
  UNION ALL SELECT doc, 5 * i, 5 * i, 5 * i - 2, i + 3, 'NN', 'n' || part, 3 * i, 3 * i + 1 FROM line)
SELECT doc, 0 AS sid, node::INT AS node, last::INT AS last, parent::INT AS parent, depth::INT AS depth, label, word, span_start::INT AS span_start, span_end::INT AS span_end FROM node""")
def q30_tree_intervals(spark, sf_dir):
    return trees.intervals(_orders(spark, sf_dir))


@query(f"""WITH {_LINES}, two AS (SELECT a.doc, a.i AS i, b.i AS j FROM line a JOIN line b ON a.doc = b.doc AND abs(a.i - b.i) <= 2),
told AS (SELECT *, CASE WHEN j >= i THEN 'VP' || repeat('-VP', (j - i)::INT) ELSE 'VP' || repeat('-VP', (i - j)::INT) END || '-NP' AS inner_path FROM two)
SELECT doc, (3 * i - 2)::INT AS idx1, (3 * j)::INT AS idx2, 'VB-' || inner_path || '-NN' AS path, inner_path AS "inner", j >= i AS dominates, false AS dominated, (5 * least(i, j) - 4)::INT AS ancestor FROM told""")
def q30b_tree_paths(spark, sf_dir):
    nodes = written(trees.intervals(_orders(spark, sf_dir)), "trees")  # read several times
    tag = trees.leaves(nodes)
    verbs, nouns = (tag.where(F.col("pos") == p).select("doc", "sid", F.col("idx").alias(f"idx{k}"), F.col("node").alias(f"node{k}")) for k, p in ((1, "VB"), (2, "NN")))
    both = verbs.join(nouns.hint("merge"), ["doc", "sid"]).where(F.abs((F.col("idx1") + 2) / 3 - F.col("idx2") / 3) <= 2)
    return trees.related(both, nodes).select("doc", "idx1", "idx2", "path", "inner", "dominates", "dominated", "ancestor")


@query(f"""WITH {_LINES}, verb AS (SELECT a.doc, a.i, list('v' || b.i ORDER BY b.i) AS verbs, string_agg('v' || b.i || ' the n' || b.part, ' ' ORDER BY b.i) AS text FROM line a JOIN line b ON a.doc = b.doc AND b.i >= a.i GROUP BY a.doc, a.i),
before AS (SELECT doc, i, coalesce(sum(length('v' || i) + length('n' || part) + 6) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM line)
SELECT v.doc, (5 * v.i - 4)::INT AS root, array_to_string(verbs, ',') AS verbs, text, b."offset"::INT AS "offset", CASE WHEN v.i > 1 THEN 'VB:NP' END AS arguments FROM verb v JOIN before b ON b.doc = v.doc AND b.i = v.i""")
def q30c_phrases(spark, sf_dir):
    nodes = written(trees.intervals(_orders(spark, sf_dir)), "trees")  # read several times
    roots = nodes.where("label = 'VP'").select("doc", "sid", F.col("node").alias("root"))
    key = ["doc", "sid", "root"]
    out = trees.verbs(nodes, roots).join(trees.raw_texts(nodes, roots).hint("merge"), key).join(trees.character_offsets(nodes).withColumnRenamed("node", "root").hint("merge"), key).join(trees.arguments(nodes).withColumnRenamed("node", "root").hint("merge"), key, "left")
    return out.select("doc", "root", F.array_join("verbs", ",").alias("verbs"), "text", "offset", "arguments")


@query(f"""WITH {CORPUS}, phrase AS (SELECT doc, sid, idx, idx AS a, idx + 1 + idx % 4 AS b FROM ev), dom AS (SELECT x.doc, x.id AS id1, y.id AS id2 FROM ev x JOIN phrase p ON p.doc = x.doc AND p.sid = x.sid AND p.idx = x.idx JOIN ev y ON y.doc = x.doc AND y.sid = x.sid AND y.idx >= p.a AND y.idx < p.b WHERE x.id <> y.id)
SELECT doc, id1, id2 FROM dom""")
def j11_dominated_events(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return pairs.dominated(c.events, _phrases(c.events)).select("doc", "id1", "id2")


def _phrases(events: DataFrame) -> DataFrame:
    return events.select("doc", "sid", "idx", F.col("idx").alias("span_start"), (F.col("idx") + 1 + F.col("idx") % 4).alias("span_end"))


_RULES = "rules(t1, t2, a2, relation) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in sieves.REPORTING_RULES) + ")"


@query(f"""WITH {CORPUS}, {_RULES}, phrase AS (SELECT doc, sid, idx, idx + 1 + idx % 4 AS b FROM ev), one AS (SELECT x.doc, x.id AS id1, y.id AS id2, x.tense AS tense1, y.tense AS tense2, y.aspect AS aspect2, x.cls AS cls1, y.cls AS cls2 FROM ev x JOIN phrase p ON p.doc = x.doc AND p.sid = x.sid AND p.idx = x.idx
  JOIN ev y ON y.doc = x.doc AND y.sid = x.sid AND y.idx >= p.idx AND y.idx < p.b WHERE x.id <> y.id UNION SELECT doc, id1, id2, tense1, tense2, aspect2, cls1, cls2 FROM gov)
SELECT doc, id1, id2, r.relation FROM one JOIN rules r ON tense1 = t1 AND tense2 = t2 AND (a2 IS NULL OR aspect2 = a2) WHERE cls1 = 'REPORTING' AND cls2 <> 'REPORTING'""")
def r03b_reporting_dominates(spark, sf_dir):
    c = corpus(spark, sf_dir)
    c.spans = _phrases(c.events)
    return sieves.reporting_governs(c)


_OWN = f"""{CORPUS}, tw AS (SELECT doc, sid, idx, token, pos, coalesce(lag(pos) OVER w, '<s>') AS l1, coalesce(lag(pos, 2) OVER w, CASE WHEN row_number() OVER w = 2 THEN '<s>' ELSE '<pre-s>' END) AS l2, row_number() OVER w AS place,
  list_filter([lag(lower(token), 2) OVER w, lag(lower(token)) OVER w, lead(lower(token)) OVER w, lead(lower(token), 2) OVER w], lambda x: x IS NOT NULL) AS near FROM tok WINDOW w AS (PARTITION BY doc, sid ORDER BY idx)),
own AS (SELECT e.*, t.pos AS tag, row_number() OVER (PARTITION BY e.doc, e.sid ORDER BY e.idx, e.id) AS n, near, ['tag:' || t.pos, 'tag-1:' || l1, 'tag-2:' || l2, 'tags:' || l1 || '-' || t.pos, 'tense:' || tense, 'aspect:' || aspect, 'cls:' || cls, 'token:' || text] AS own
  FROM ev e JOIN tw t ON t.doc = e.doc AND t.sid = e.sid AND t.idx = e.idx),
way AS (SELECT a.doc, a.sid, a.idx AS i, b.idx AS j, string_agg('->' || d.reln, '' ORDER BY d.dep_idx) AS forth, string_agg('<-' || d.reln, '' ORDER BY d.dep_idx DESC) AS back
  FROM tok a JOIN tok b ON a.doc = b.doc AND a.sid = b.sid AND a.idx < b.idx JOIN dep d ON d.doc = a.doc AND d.sid = a.sid AND d.dep_idx > a.idx AND d.dep_idx <= b.idx GROUP BY ALL)"""
_MATCH = "CASE WHEN a.{0} = b.{0} THEN '{0}match:yes' ELSE '{0}match:no' END"


def _in_order(features: DataFrame) -> DataFrame:
    return features.select("doc", "id1", "id2", "swapped", F.array_join(F.array_sort("features"), " ").alias("features"))


@query(f"""WITH {_OWN} SELECT a.doc, b.id AS id1, a.id AS id2, true AS swapped, array_to_string(list_sort(list_concat(list_transform(a.own, lambda x: '1' || x), list_transform(b.own, lambda x: '2' || x), ['tags:' || a.tag || '-' || b.tag, 'tokens:' || a.text || '-' || b.text,
  'tenses:' || a.tense || '-' || b.tense, {_MATCH.format("tense")}, 'aspects:' || a.aspect || '-' || b.aspect, {_MATCH.format("aspect")}, 'clss:' || a.cls || '-' || b.cls, {_MATCH.format("cls")}, CASE WHEN a.sid = b.sid THEN 'same sentence' ELSE 'other sentence' END],
  CASE WHEN a.sid = b.sid THEN [CASE WHEN b.n - a.n > 1 THEN 'events between' ELSE 'next event' END, 'way:' || forth] ELSE [] END)), ' ') AS features
  FROM own a JOIN own b ON a.doc = b.doc AND ((a.sid = b.sid AND (a.idx, a.id) < (b.idx, b.id)) OR b.sid = a.sid + 1) LEFT JOIN way w ON w.doc = a.doc AND w.sid = a.sid AND a.sid = b.sid AND w.i = a.idx AND w.j = b.idx""")
def e09_event_pair_features(spark, sf_dir):
    c = corpus(spark, sf_dir)
    turned = pairs.same_or_next(c.events).select("doc", F.col("id2").alias("id1"), F.col("id1").alias("id2"))
    return _in_order(linkfeatures.event_pairs(c, turned))


@query(f"""WITH {_OWN}, last AS (SELECT doc, sid, max(idx) AS idx FROM tok GROUP BY ALL), t AS (SELECT x.doc, x.sid, x.idx, x.id, k.token AS word, ['time:' || k.token] || CASE WHEN l.idx = x.idx THEN ['time ends the sentence'] ELSE [] END AS own FROM tx x JOIN tok k ON k.doc = x.doc AND k.sid = x.sid AND k.idx = x.idx JOIN last l ON l.doc = x.doc AND l.sid = x.sid),
two AS (SELECT e.doc, e.id AS id1, t.id AS id2, e.idx AS i, t.idx AS j, e.own AS own1, t.own AS own2, e.text, t.word, (SELECT coalesce(string_agg('_' || k.token, '' ORDER BY k.idx), '') FROM tok k WHERE k.doc = e.doc AND k.sid = e.sid AND k.idx > least(e.idx, t.idx) AND k.idx < greatest(e.idx, t.idx)) AS gap, forth, back
  FROM own e JOIN t ON t.doc = e.doc AND t.sid = e.sid LEFT JOIN way w ON w.doc = e.doc AND w.sid = e.sid AND w.i = least(e.idx, t.idx) AND w.j = greatest(e.idx, t.idx))
SELECT doc, id1, id2, false AS swapped, array_to_string(list_sort(list_concat(own1, own2, CASE WHEN i < j THEN ['event first', 'tokens:' || text || '_' || word, 'event to time way:' || forth] ELSE ['time first', 'tokens:' || word || '_' || text, 'time to event way:' || back] END,
  CASE WHEN abs(i - j) < 5 THEN [CASE WHEN i < j THEN 'between:EVENT' || gap || '_TIME' ELSE 'between:TIME' || gap || '_EVENT' END] ELSE [] END)), ' ') AS features FROM two""")
def e10_event_time_features(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return _in_order(linkfeatures.event_times(c, pairs.same_sentence(c.events, c.timexes)))


@query(f"WITH {_OWN} SELECT doc, id AS id1, 't0' AS id2, false AS swapped, array_to_string(list_sort(list_concat(own, list_transform(near, lambda x: 'bag:' || x))), ' ') AS features FROM own")
def e11_creation_time_features(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return _in_order(linkfeatures.event_creation_times(c, pairs.with_creation_time(c.events, c.dcts)))


# Each part is a word with one sense; parts lie in chains of sixty, the first of which is of its type, and all types are objects.
_TYPES = {"ECONOMY": "person", "LARGE": "location", "SMALL": "time", "MEDIUM": "measure", "STANDARD": "material", "PROMO": "event"}


def _hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Senses, hypernyms and names of synsets made from table part."""
    k = F.col("p_partkey")
    part = read(spark, sf_dir, "part").select(k.cast("string").alias("lemma"), F.concat(F.lit("s"), k.cast("string")).alias("synset"), k.alias("k"), "p_type")
    kind = F.concat(F.lit("type:"), F.col("p_type"))
    up = part.select(F.col("synset").alias("child"), F.when(F.col("k") % 60 > 0, F.concat(F.lit("s"), (F.col("k") - 1).cast("string"))).otherwise(kind).alias("parent"), F.lit(1).alias("ordinal"))
    other = part.select(F.col("synset").alias("child"), F.lit("elsewhere").alias("parent"), F.lit(2).alias("ordinal"))  # second pointers don't count
    types = part.select(kind.alias("child"), F.lit("object").alias("parent"), F.lit(1).alias("ordinal")).distinct()
    names = spark.createDataFrame([(f"type:{t}", name) for t, name in _TYPES.items()] + [("object", "physical_object")], "synset string, name string")
    return part.select("lemma", "synset"), up.unionByName(other).unionByName(types), names


_HEADS = "head AS (SELECT p.p_partkey AS k, b.p_type AS kind FROM part p JOIN part b ON b.p_partkey = p.p_partkey - p.p_partkey % 60)"


@query(f"""WITH {_HEADS} SELECT k::VARCHAR AS lemma, kind = 'ECONOMY' AS is_person_or_group, kind = 'LARGE' AS is_location, true AS is_physical_object, kind = 'SMALL' AS is_time, kind = 'MEDIUM' AS is_measure, kind = 'STANDARD' AS is_material, kind = 'PROMO' AS is_event,
  kind NOT IN ('ECONOMY', 'LARGE') AS is_thing FROM head""")
def p21_lexical_predicates(spark, sf_dir):
    senses, up, names = _hierarchy(spark, sf_dir)
    out = lexicon.with_predicates(senses.select("lemma"), senses, up, names)
    return out.select("lemma", *[f"is_{n}" for n in ("person_or_group", "location", "physical_object", "time", "measure", "material", "event", "thing")])


@query(f"""WITH {_HEADS} SELECT 's' || k AS child, 's' || (k - d) AS ancestor, d AS distance FROM head, LATERAL (SELECT unnest(range(1, k % 60 + 1)) AS d)
UNION ALL SELECT 's' || k, 'type:' || kind, k % 60 + 1 FROM head UNION ALL SELECT 's' || k, 'object', k % 60 + 2 FROM head UNION ALL SELECT DISTINCT 'type:' || p_type, 'object', 1 FROM part""")
def p21b_hypernym_chains(spark, sf_dir):
    return graphs.ancestors(_hierarchy(spark, sf_dir)[1])


def _neighbours(rows: list) -> list[tuple]:
    """A user's sieve: each entity of a sentence before the next one, and classes that are equal simultaneous."""
    near = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a.sid == b.sid]
    return [(a.id, b.id, "SIMULTANEOUS" if a.cls == b.cls else "BEFORE", 1 / (b.idx - a.idx + 1)) for a, b in near]


@query(f"""WITH {ENTITIES}, n AS (SELECT doc, sid, id, cls, lead(id) OVER w AS next, lead(cls) OVER w AS next_cls FROM ent WINDOW w AS (PARTITION BY doc, sid ORDER BY idx))
SELECT doc, id AS id1, next AS id2, CASE WHEN cls = next_cls THEN 'SIMULTANEOUS' ELSE 'BEFORE' END AS relation, 0.5::DOUBLE AS confidence FROM n WHERE next IS NOT NULL""")
def u13_sieve_as_table_function(spark, sf_dir):
    tablefunction.register(spark, "neighbours", _neighbours)
    plain(spark, sf_dir).createOrReplaceTempView("sieve_entities")
    return spark.sql("SELECT doc, id1, id2, relation, confidence FROM neighbours(TABLE(sieve_entities) PARTITION BY doc ORDER BY (sid, idx))")
