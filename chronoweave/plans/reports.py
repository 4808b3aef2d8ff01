"""Queries of reports, markup and word lists, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import text
from chronoweave.operators import evaluate, extract, pairs, sieves
from chronoweave.plans.catalogue import query, read
from chronoweave.plans.corpus import CORPUS, corpus

# Guesses and truths: pairs of a sentence and of entities with the creation time, labelled by their numbers.
_LABELS = ["BEFORE", "AFTER", "SIMULTANEOUS", "VAGUE"]
_LINKED = f"""{CORPUS}, entity AS (SELECT doc, sid, idx, id, k FROM ev UNION ALL SELECT doc, sid, idx, id, substr(id, 2)::BIGINT AS k FROM tx WHERE id <> 't0'),
pair AS (SELECT a.doc, a.id AS id1, b.id AS id2, a.k + b.k AS n FROM entity a JOIN entity b ON a.doc = b.doc AND a.sid = b.sid AND (a.idx, a.id) < (b.idx, b.id) UNION ALL SELECT doc, id, 't0', k FROM entity),
two AS (SELECT doc, id1, id2, CASE WHEN n % 5 > 0 THEN {_LABELS}[1 + n % 4] END AS guess, n % 3 = 0 AS closed, CASE WHEN n % 7 > 0 THEN {_LABELS}[1 + n // 2 % 4] END AS truth,
  CASE WHEN id1 LIKE 'e%' AND id2 LIKE 'e%' THEN 'ee' WHEN id1 LIKE 'e%' OR id2 LIKE 'e%' THEN CASE WHEN id2 = 't0' THEN 'ed' ELSE 'et' END WHEN id2 = 't0' THEN 'td' ELSE 'tt' END AS kind FROM pair)"""


def _linked(spark: SparkSession, sf_dir: str):
    """The corpus, and pairs with guess (null: none), closed and truth."""
    c = corpus(spark, sf_dir)
    every = c.events.select("doc", "sid", "idx", "id").unionByName(c.timexes.select("doc", "sid", "idx", "id").where("id <> 't0'"))
    both = pairs.same_sentence(every).select("doc", "id1", "id2").unionByName(pairs.with_creation_time(every, c.dcts).select("doc", "id1", "id2"))
    number = lambda c: F.coalesce(F.regexp_extract(c, r"(\d+)$", 1).cast("long"), F.lit(0))
    n = number("id1") + F.when(F.col("id2") == "t0", 0).otherwise(number("id2"))
    pick = lambda k: F.element_at(F.array(*map(F.lit, _LABELS)), (k % 4 + 1).cast("int"))
    rows = both.withColumn("n", n)
    return c, rows.select("doc", "id1", "id2", F.when(F.col("n") % 5 > 0, pick(F.col("n"))).alias("guess"), (F.col("n") % 3 == 0).alias("closed"), F.when(F.col("n") % 7 > 0, pick(F.floor(F.col("n") / 2))).alias("truth"))


_COUNTS = """count(*) FILTER (WHERE guess = truth) AS correct, count(*) FILTER (WHERE guess <> truth) AS incorrect, count(*) FILTER (WHERE guess IS NULL) AS missed, count(*) FILTER (WHERE truth IS NULL) AS no_gold"""


@query(f"""WITH {_LINKED}, own AS (SELECT kind, CASE WHEN guess IS NOT NULL THEN closed END AS closed, guess, truth FROM two WHERE guess IS NOT NULL OR truth IS NOT NULL),
g AS (SELECT NULL AS kind, NULL::BOOLEAN AS closed, {_COUNTS} FROM own UNION ALL SELECT kind, NULL, {_COUNTS} FROM own GROUP BY kind UNION ALL SELECT NULL, closed, {_COUNTS} FROM own WHERE closed IS NOT NULL GROUP BY closed UNION ALL SELECT kind, closed, {_COUNTS} FROM own WHERE closed IS NOT NULL GROUP BY ALL)
SELECT kind, closed, correct, incorrect, missed, no_gold, round(CASE WHEN correct + incorrect > 0 THEN correct / (correct + incorrect) ELSE 0 END, 9) AS "precision", round(CASE WHEN correct + incorrect + missed > 0 THEN correct / (correct + incorrect + missed) ELSE 0 END, 9) AS recall FROM g""")
def g01_scores_by_kind_and_closure(spark, sf_dir):
    c, rows = _linked(spark, sf_dir)
    guessed = rows.where("guess IS NOT NULL").select("doc", "id1", "id2", F.col("guess").alias("relation"), "closed")
    gold = rows.where("truth IS NOT NULL").select("doc", "id1", "id2", F.col("truth").alias("relation"))
    out = evaluate.report(guessed, gold, c.dcts)
    return out.select("kind", "closed", "correct", "incorrect", "missed", "no_gold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"""WITH {_LINKED}, place AS (SELECT DISTINCT doc, sid FROM entity)
SELECT 'documents' AS name, count(DISTINCT doc) AS n FROM ent UNION ALL SELECT 'sentences', count(*) FROM place UNION ALL SELECT 'events', count(*) FROM ev UNION ALL SELECT 'times', count(*) FROM tx UNION ALL SELECT 'creation times', count(*) FROM dct
UNION ALL SELECT 'links ' || kind || ' ' || truth, count(*) FROM two WHERE truth IS NOT NULL GROUP BY kind, truth""")
def g01b_dataset_statistics(spark, sf_dir):
    c, rows = _linked(spark, sf_dir)
    return evaluate.dataset_statistics(c.events, c.timexes, c.dcts, rows.where("truth IS NOT NULL").select("doc", "id1", "id2", F.col("truth").alias("relation")))


_SHARES = ", ".join(f"round(count(*) FILTER (WHERE truth = '{r}') / count(*), 9) AS \"{r}\"" for r in _LABELS)


@query(f"""WITH {_LINKED}, e AS (SELECT a.cls AS cls1, b.cls AS cls2, a.tense AS tense1, b.tense AS tense2, truth FROM two JOIN ev a ON a.doc = two.doc AND a.id = two.id1 JOIN ev b ON b.doc = two.doc AND b.id = two.id2 WHERE truth IS NOT NULL)
SELECT cls1, cls2, tense1, tense2, count(*) AS n, grouping(cls1)::INT AS any_cls1, grouping(cls2)::INT AS any_cls2, grouping(tense1)::INT AS any_tense1, grouping(tense2)::INT AS any_tense2, {_SHARES} FROM e GROUP BY CUBE (cls1, cls2, tense1, tense2)""")
def g03_patterns_by_relation(spark, sf_dir):
    c, rows = _linked(spark, sf_dir)
    side = lambda k: c.events.select("doc", F.col("id").alias(f"id{k}"), F.col("cls").alias(f"cls{k}"), F.col("tense").alias(f"tense{k}"))
    both = rows.withColumnRenamed("truth", "relation").join(side(1), ["doc", "id1"]).join(side(2), ["doc", "id2"])
    out = evaluate.pattern_relations(both, ["cls1", "cls2", "tense1", "tense2"], _LABELS)
    return out.withColumns({r: F.round(r, 9) for r in _LABELS})


@query(f"""WITH {CORPUS}, near AS (SELECT doc, id, k, lead(id) OVER (PARTITION BY doc ORDER BY idx) AS next FROM ev), a AS (SELECT doc, 'e' || substr(id, 3) AS id1, CASE WHEN k % 4 = 1 THEN 't0' WHEN k % 4 = 2 THEN 'e' || substr(next, 3) || 'x' ELSE 'e' || substr(next, 3) END AS id2, ['a', 'b', 'ii', 'pv', 'q'][1 + k % 5] AS label, id, next, k FROM near WHERE next IS NOT NULL),
r AS (SELECT *, CASE label WHEN 'a' THEN 'AFTER' WHEN 'b' THEN 'BEFORE' WHEN 'ii' THEN 'IS_INCLUDED' WHEN 'pv' THEN 'PARTIAL_VAGUE' END AS relation, CASE WHEN id2 LIKE 'e%' THEN 'ee' ELSE 'et' END AS link_type, CASE WHEN k % 4 = 2 THEN 'unknown id' WHEN label = 'q' THEN 'unknown label' END AS problem FROM a)
SELECT doc, id1, id2, relation, link_type, CASE WHEN problem IS NULL THEN '<tlink event1="' || id || '" event2="' || CASE WHEN k % 4 = 1 THEN 't0' ELSE next END || '" relation="' || relation || '" closed="false" type="' || link_type || '"/>' END AS element, problem FROM r""")
def g14_link_elements(spark, sf_dir):
    from pyspark.sql import Window

    c = corpus(spark, sf_dir)
    k = F.substring("id", 3, 20).cast("long")
    near = c.events.withColumn("next", F.lead("id").over(Window.partitionBy("doc").orderBy("idx"))).where("next IS NOT NULL")
    eid = lambda x: F.concat(F.lit("e"), F.substring(x, 3, 20))
    label = F.element_at(F.array(*map(F.lit, ["a", "b", "ii", "pv", "q"])), (k % 5 + 1).cast("int"))
    rows = near.select("doc", eid("id").alias("id1"), F.when(k % 4 == 1, "t0").when(k % 4 == 2, F.concat(eid("next"), F.lit("x"))).otherwise(eid("next")).alias("id2"), label.alias("label"))
    return evaluate.link_elements(rows, c.events.select("doc", eid("id").alias("eid"), F.col("id").alias("eiid")), c.dcts.select("doc", "id"))


@query("""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS text FROM conversations),
t AS (SELECT conv_id, turn, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT conv_id, turn, string_split(text, ' ') AS l FROM c WHERE text <> ''))
SELECT conv_id, turn, string_agg(CASE WHEN i % 4 = 1 THEN '<target id="' || i || '" tense="PAST">' || w || '</target>' WHEN i % 4 = 2 THEN '<TIMEX3 tid="t' || i || '" type="DATE" value="1998">' || w || '</TIMEX3>' ELSE w END, ' ' ORDER BY i) AS markup FROM t GROUP BY ALL""")
def k03_marked_texts(spark, sf_dir):
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " +", " "))
    rows = read(spark, sf_dir, "conversations").withColumn("text", plain)
    toks = extract.token_table(rows.select(F.struct("conv_id", "turn").alias("doc"), "text"))
    here = toks.select("doc", "sid", "idx")
    events = here.where("idx % 4 = 1").withColumns({"eid": F.concat(F.lit("e"), F.col("idx").cast("string")), "tense": F.lit("PAST")})
    times = here.where("idx % 4 = 2").withColumns({"len": F.lit(1), "id": F.concat(F.lit("t"), F.col("idx").cast("string")), "type": F.lit("DATE"), "value": F.lit("1998")})
    return extract.marked_texts(toks, events, times, "target", "id", True, ("tense",)).select("doc.conv_id", "doc.turn", "markup")


@query(f"""WITH {CORPUS}, t AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'DURATION' ELSE 'DATE' END AS kind FROM (SELECT *, substr(id, 2)::BIGINT AS k FROM tx))
SELECT doc, arg_min(value, (sid, idx)) FILTER (WHERE kind = 'DATE') AS first_date, true AS dated FROM t GROUP BY doc HAVING count(*) FILTER (WHERE kind = 'DATE') > 0""")
def t15_first_date_and_today(spark, sf_dir):
    c = corpus(spark, sf_dir)
    times = c.timexes.withColumn("type", F.when(F.substring("id", 2, 20).cast("long") % 3 == 0, "DURATION").otherwise("DATE"))
    today = extract.creation_day(times, "today").withColumn("dated", F.col("value") == F.current_date().cast("string")).select("doc", "dated")
    return extract.creation_day(times, "date").withColumnRenamed("value", "first_date").join(today, "doc")


@query(f"WITH {CORPUS} SELECT g.doc, a.sid, g.id1, g.id2, g.reln, a.text AS text1, b.text AS text2, g.tense1, g.tense2, g.cls1, g.cls2 FROM gov g JOIN ev a ON a.doc = g.doc AND a.id = g.id1 JOIN ev b ON b.doc = g.doc AND b.id = g.id2")
def r19b_dependency_pairs(spark, sf_dir):
    return sieves.dependency_pairs(corpus(spark, sf_dir)).drop("pos1", "pos2", "aspect1", "aspect2")


def _listed(column: str, values: list[str]) -> str:
    return f"lower({column}) IN ({', '.join(repr(v) for v in values)})"


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM conversations UNION SELECT unnest(['Nobody', 'that', 'THE', 'person', 'Women', 'some', 'anyone', 'thesis', '']))
SELECT word, {_listed("word", text.PERSON_NOUNS)} AS person, {_listed("word", text.ABSTRACT_PERSONS)} AS abstract, {_listed("word", text.POINTERS)} AS pointer FROM w""")
def p19_word_lists(spark, sf_dir):
    more = spark.createDataFrame([(w,) for w in ("Nobody", "that", "THE", "person", "Women", "some", "anyone", "thesis", "")], "word string")
    words: DataFrame = read(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("word")).union(more).distinct()
    w = F.col("word")
    return words.select("word", text.is_person_noun(w).alias("person"), text.is_abstract_person(w).alias("abstract"), text.is_object_reference(w).alias("pointer"))
