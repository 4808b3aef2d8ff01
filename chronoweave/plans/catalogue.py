"""The queries of the temporal engine on the driver's tables, each with the same query in DuckDB's SQL.

A user of table events stands for a document, a day for a sentence, and the order of (ts, event_id) for
that of tokens; event types stand for event classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import maths, relations
from chronoweave.functions import timex as tx
from chronoweave.operators import cascade, evaluate, extract, pairs
from chronoweave.operators.closure import closure

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

ENTITIES = """
ent AS (SELECT CAST(user_id AS VARCHAR) AS doc, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS sid,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS idx, 'ei' || event_id AS id, event_type AS cls, event_id, ts, value FROM events)"""
SAME = "same AS (SELECT a.doc, a.id AS id1, b.id AS id2, a.cls AS cls1, b.cls AS cls2, a.sid AS sid1, b.sid AS sid2 FROM ent a JOIN ent b ON a.doc = b.doc AND a.sid = b.sid AND a.idx < b.idx)"
NEXT = "near AS (SELECT a.doc, a.id AS id1, b.id AS id2, a.cls AS cls1, b.cls AS cls2, a.sid AS sid1, b.sid AS sid2 FROM ent a JOIN ent b ON a.doc = b.doc AND ((a.sid = b.sid AND a.idx < b.idx) OR b.sid = a.sid + 1))"
# Relation by the classes of a pair, for the toy rule table.
CLASS_RULES = [("signup", "view", "BEFORE"), ("view", "purchase", "BEFORE"), ("purchase", "view", "AFTER"), ("click", "view", "IS_INCLUDED"), ("error", "error", "SIMULTANEOUS"), ("view", "click", "INCLUDES")]
RULES_SQL = "rules(cls1, cls2, relation) AS (VALUES " + ", ".join(str(r) for r in CLASS_RULES) + ")"


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("doc"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("sid"),
        F.row_number().over(order).alias("idx"), F.concat(F.lit("ei"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("cls"), "event_id", "ts", "value",
    )


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("doc", "sid", "idx", "id", "cls")


def class_rules(spark: SparkSession, both: DataFrame) -> DataFrame:
    rules = spark.createDataFrame(CLASS_RULES, "cls1 string, cls2 string, relation string")
    return both.join(F.broadcast(rules), ["cls1", "cls2"])  # a fixed table of rules


@query(f"WITH {ENTITIES}, {SAME} SELECT doc, id1, id2, sid1 FROM same")
def q01_same_sentence_pairs(spark, sf_dir):
    return pairs.same_sentence(plain(spark, sf_dir)).select("doc", "id1", "id2", "sid1")


@query(f"WITH {ENTITIES}, {NEXT} SELECT doc, id1, id2, sid1, sid2 FROM near")
def q02_adjacent_sentence_pairs(spark, sf_dir):
    return pairs.same_or_next(plain(spark, sf_dir)).select("doc", "id1", "id2", "sid1", "sid2")


@query(f"WITH {ENTITIES} SELECT a.doc, a.id AS id1, b.id AS id2 FROM ent a JOIN ent b ON a.doc = b.doc AND b.sid BETWEEN a.sid AND a.sid + 2 AND (b.sid > a.sid OR b.idx > a.idx)")
def q03_windowed_pairs(spark, sf_dir):
    return pairs.windowed(plain(spark, sf_dir), 2).select("doc", "id1", "id2")


@query(f"""WITH {ENTITIES}, dct AS (SELECT doc, arg_min(id, idx) AS id2 FROM ent GROUP BY doc)
SELECT e.doc, e.id AS id1, d.id2, CASE e.cls WHEN 'signup' THEN 'BEFORE' WHEN 'purchase' THEN 'AFTER' WHEN 'view' THEN 'IS_INCLUDED' ELSE 'VAGUE' END AS relation FROM ent e JOIN dct d USING (doc) WHERE e.id <> d.id2""")
def q04_event_creation_time(spark, sf_dir):
    e = plain(spark, sf_dir)
    relation = F.when(F.col("cls1") == "signup", "BEFORE").when(F.col("cls1") == "purchase", "AFTER").when(F.col("cls1") == "view", "IS_INCLUDED").otherwise("VAGUE")
    return pairs.with_creation_time(e, e.select("doc", "id", F.col("idx").alias("ord"))).where("id1 <> id2").select("doc", "id1", "id2", relation.alias("relation"))


@query(f"""WITH {ENTITIES}, v AS (SELECT * FROM ent WHERE cls = 'view'), p AS (SELECT * FROM ent WHERE cls = 'purchase')
SELECT p.doc, (SELECT arg_max(v.id, v.idx) FROM v WHERE v.doc = p.doc AND v.sid = p.sid AND v.idx < p.idx) AS id1, p.id AS id2 FROM p
WHERE EXISTS (SELECT 1 FROM v WHERE v.doc = p.doc AND v.sid = p.sid AND v.idx < p.idx)""")
def q05_nearest_preceding(spark, sf_dir):
    e = plain(spark, sf_dir)
    return pairs.nearest_before(e.where("cls = 'view'"), e.where("cls = 'purchase'"))


@query(f"""WITH {ENTITIES}, l AS (SELECT doc, lag(id) OVER (PARTITION BY doc, sid ORDER BY idx) AS id1, id AS id2 FROM ent) SELECT * FROM l WHERE id1 IS NOT NULL""")
def q05b_previous_event(spark, sf_dir):
    return pairs.previous(plain(spark, sf_dir))


@query(f"""WITH {ENTITIES}, f AS (SELECT doc, sid, arg_min(id, idx) AS id1 FROM ent GROUP BY doc, sid), l AS (SELECT doc, id1, lead(id1) OVER (PARTITION BY doc ORDER BY sid) AS id2 FROM f)
SELECT * FROM l WHERE id2 IS NOT NULL""")
def q05c_main_events(spark, sf_dir):
    return pairs.main_events(plain(spark, sf_dir))


@query("""WITH r AS (
  SELECT l_orderkey, l_linenumber, date_trunc('month', o_orderdate) AS a, date_trunc('month', o_orderdate) + INTERVAL 28 DAY - INTERVAL 1 SECOND AS b,
    date_trunc('day', l_shipdate) AS c, date_trunc('day', l_shipdate) + INTERVAL 1 DAY - INTERVAL 1 SECOND AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN a = c AND b = d THEN 'SIMULTANEOUS' WHEN b <= c THEN 'BEFORE' WHEN a >= d THEN 'AFTER' WHEN a < c AND b > d THEN 'INCLUDES' WHEN a > c AND b < d THEN 'IS_INCLUDED'
  WHEN (a < c AND b < d) OR (a > c AND b > d) THEN 'VAGUE' END AS relation FROM r""")
def q06_timex_interval_order(spark, sf_dir):
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    day = tx.spanned(line.select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("value2")), "value2").withColumnsRenamed({"low": "low2", "high": "high2"})
    month = tx.spanned(o.select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("value1")), "value1").withColumnsRenamed({"low": "low1", "high": "high1"})
    both = day.join(month, "l_orderkey").withColumns({"type1": F.lit("DATE"), "type2": F.lit("DATE")})
    return both.select("l_orderkey", "l_linenumber", tx.related_columns().alias("relation"))


def _values(o: DataFrame) -> DataFrame:
    d = F.col("o_orderdate")
    forms = {"year": F.date_format(d, "yyyy"), "month": F.date_format(d, "yyyy-MM"), "day": F.date_format(d, "yyyy-MM-dd"), "quarter": F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string"))}
    return o.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("value")) for k, v in forms.items()])).alias("v")).select("o_orderkey", "v.form", "v.value")


@query("""WITH v AS (
  SELECT o_orderkey, unnest([{'form': 'year', 'value': strftime(o_orderdate, '%Y'), 'lo': make_date(year(o_orderdate), 2, 1), 'hi': make_date(year(o_orderdate), 12, 28)},
    {'form': 'month', 'value': strftime(o_orderdate, '%Y-%m'), 'lo': make_date(year(o_orderdate), month(o_orderdate), 1), 'hi': make_date(year(o_orderdate), month(o_orderdate), 28)},
    {'form': 'day', 'value': strftime(o_orderdate, '%Y-%m-%d'), 'lo': CAST(o_orderdate AS DATE), 'hi': CAST(o_orderdate AS DATE)},
    {'form': 'quarter', 'value': strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate), 'lo': make_date(year(o_orderdate), quarter(o_orderdate) * 3 - 2, 1), 'hi': make_date(year(o_orderdate), quarter(o_orderdate) * 3, 28)}]) AS v FROM orders)
SELECT o_orderkey, v.form AS form, v.value AS value, strftime(v.lo, '%Y-%m-%d') || ' 00:00:00' AS low, strftime(v.hi, '%Y-%m-%d') || ' 23:59:59' AS high FROM v""")
def q07_timex_range_parse(spark, sf_dir):
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return tx.spanned(_values(read(spark, sf_dir, "orders"))).select("o_orderkey", "form", "value", show("low").alias("low"), show("high").alias("high"))


@query(f"""WITH {ENTITIES}, {NEXT}, {RULES_SQL}, proposed AS (
  SELECT doc, id1, id2, 'SIMULTANEOUS' AS relation, 'same_class' AS sieve, 0 AS rank FROM near WHERE cls1 = cls2 AND sid1 = sid2
  UNION ALL SELECT doc, id1, id2, relation, 'rules', 1 FROM near JOIN rules USING (cls1, cls2) UNION ALL SELECT doc, id1, id2, 'VAGUE', 'vague', 2 FROM near)
SELECT doc, id1, id2, relation, sieve FROM proposed QUALIFY row_number() OVER (PARTITION BY doc, least(id1, id2), greatest(id1, id2) ORDER BY rank, id1, id2, relation) = 1""")
def q08_first_wins_resolve(spark, sf_dir):
    near = pairs.same_or_next(plain(spark, sf_dir))
    own = lambda df, sieve, rank: df.select("doc", "id1", "id2", "relation", F.lit(sieve).alias("sieve"), F.lit(rank).alias("rank"))
    a = own(near.where("cls1 = cls2 AND sid1 = sid2").withColumn("relation", F.lit("SIMULTANEOUS")), "same_class", 0)
    return cascade.first_wins(a.union(own(class_rules(spark, near), "rules", 1)).union(own(near.withColumn("relation", F.lit("VAGUE")), "vague", 2)))


@query(f"""WITH {ENTITIES}, place AS (SELECT *, row_number() OVER (PARTITION BY doc, sid ORDER BY idx) AS n FROM ent)
SELECT a.doc, CASE WHEN b.n = a.n + 1 OR a.id < b.id THEN a.id ELSE b.id END AS id1, CASE WHEN b.n = a.n + 1 OR a.id < b.id THEN b.id ELSE a.id END AS id2,
  CASE WHEN b.n = a.n + 1 OR a.id < b.id THEN 'BEFORE' ELSE 'AFTER' END AS relation, b.n > a.n + 1 AS closed FROM place a JOIN place b ON a.doc = b.doc AND a.sid = b.sid AND a.n < b.n""")
def q09_closure_fixpoint(spark, sf_dir):
    return closure(pairs.previous(plain(spark, sf_dir)).withColumn("relation", F.lit("BEFORE")))


@query(f"""WITH {ENTITIES}, {SAME}, {RULES_SQL}, l AS (SELECT * FROM same JOIN rules USING (cls1, cls2)),
c AS (SELECT *, CASE relation WHEN 'BEFORE' THEN 'AFTER' WHEN 'AFTER' THEN 'BEFORE' WHEN 'INCLUDES' THEN 'IS_INCLUDED' WHEN 'IS_INCLUDED' THEN 'INCLUDES' ELSE relation END AS inverse FROM l)
SELECT doc, least(id1, id2) AS lo, greatest(id1, id2) AS hi, CASE WHEN id1 > id2 THEN inverse ELSE relation END AS rel, relation, inverse,
  CASE WHEN relation IN ('INCLUDES', 'SIMULTANEOUS') THEN 'OVERLAP' ELSE relation END AS symmetric, CASE WHEN relation IN ('INCLUDES', 'IS_INCLUDED', 'SIMULTANEOUS') THEN 'OVERLAP' ELSE relation END AS tempeval FROM c""")
def q10_relation_canonicalise(spark, sf_dir):
    rel = F.col("relation")
    links = relations.canonical(class_rules(spark, pairs.same_sentence(plain(spark, sf_dir))))
    return links.select("doc", "lo", "hi", "rel", "relation", relations.inverted(rel).alias("inverse"), relations.reduced(rel, "SYMMETRY").alias("symmetric"), relations.reduced(rel, "TEMPEVAL").alias("tempeval"))


@query(f"WITH {ENTITIES}, {NEXT}, {RULES_SQL} SELECT doc, id1, id2, relation FROM near JOIN rules USING (cls1, cls2)")
def q11_rule_table_sieve(spark, sf_dir):
    return class_rules(spark, pairs.same_or_next(plain(spark, sf_dir))).select("doc", "id1", "id2", "relation")


@query(f"WITH {ENTITIES}, {NEXT}, {RULES_SQL} SELECT doc, id1, id2, 'VAGUE' AS relation FROM near WHERE (cls1, cls2) NOT IN (SELECT cls1, cls2 FROM rules)")
def q12_all_vague_fill(spark, sf_dir):
    near = pairs.same_or_next(plain(spark, sf_dir)).select("doc", "id1", "id2", "cls1", "cls2")
    open_ = cascade.without_conflicts(near, class_rules(spark, near).select("doc", "id1", "id2"))
    return open_.select("doc", "id1", "id2", F.lit("VAGUE").alias("relation"))


GUESSES = "g AS (SELECT d.lang, CAST(quality AS VARCHAR) AS truth, CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE CAST(toxic AS VARCHAR) END AS guess FROM labels l JOIN documents d USING (doc_id))"


def _guesses(spark, sf_dir):
    own = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return own.select("lang", F.col("quality").cast("string").alias("truth"), F.when(F.col("doc_id") % 7 != 0, F.col("toxic").cast("string")).alias("guess"))


@query(f"""WITH {GUESSES}, c AS (SELECT lang, count(*) FILTER (WHERE guess = truth) AS correct, count(*) FILTER (WHERE guess <> truth) AS incorrect, count(*) FILTER (WHERE guess IS NULL AND truth IS NOT NULL) AS missed, count(*) FILTER (WHERE guess IS NOT NULL AND truth IS NULL) AS no_gold FROM g GROUP BY lang),
p AS (SELECT *, coalesce(correct / nullif(correct + incorrect, 0), 0) AS precision, coalesce(correct / nullif(correct + incorrect + missed, 0), 0) AS recall FROM c)
SELECT lang, correct, incorrect, missed, no_gold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM p""")
def q13_precision_recall(spark, sf_dir):
    return evaluate.scores(_guesses(spark, sf_dir), ["lang"]).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"""WITH {GUESSES}, e AS (SELECT unnest(list_distinct([guess, truth])) AS label, guess, truth FROM g WHERE guess IS NOT NULL AND truth IS NOT NULL),
c AS (SELECT label, count(*) FILTER (WHERE guess = label AND truth = label) AS tp, count(*) FILTER (WHERE guess = label AND truth <> label) AS fp, count(*) FILTER (WHERE guess <> label AND truth = label) AS fn FROM e GROUP BY label),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT label, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM p""")
def q13b_scores_by_label(spark, sf_dir):
    return evaluate.by_label(_guesses(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"""WITH {GUESSES} SELECT truth, count(*) FILTER (WHERE guess = '0') AS "0", count(*) FILTER (WHERE guess = '1') AS "1" FROM g GROUP BY truth""")
def q14_confusion_pivot(spark, sf_dir):
    return evaluate.confusion(_guesses(spark, sf_dir), values=["0", "1"])


# Three annotators: each labels an event pair by a remainder of its ids, the third leaves some out.
NOTES = f"""{ENTITIES}, {SAME}, keyed AS (SELECT *, CAST(substr(id1, 3) AS BIGINT) AS a, CAST(substr(id2, 3) AS BIGINT) AS b FROM same),
notes AS (SELECT doc, 'ann' || k AS annotator, 'e' || a AS id1, CASE WHEN b % 5 = 0 THEN 't0' WHEN b % 5 = 1 THEN 't' || b ELSE 'e' || b END AS id2, ['b', 'a', 'v', 's'][1 + (a + b * k + a // (2 + k)) % 4] AS label
  FROM keyed CROSS JOIN (VALUES (0), (1), (2)) AS people(k) WHERE NOT (k = 2 AND (a + b) % 3 = 0))"""


def _notes(spark, sf_dir):
    e = plain(spark, sf_dir)
    both = pairs.same_sentence(e).select("doc", F.substring("id1", 3, 20).cast("long").alias("a"), F.substring("id2", 3, 20).cast("long").alias("b"))
    each = both.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).where("NOT (k = 2 AND (a + b) % 3 = 0)")
    other = F.when(F.col("b") % 5 == 0, "t0").when(F.col("b") % 5 == 1, F.concat(F.lit("t"), F.col("b").cast("string"))).otherwise(F.concat(F.lit("e"), F.col("b").cast("string")))
    label = F.element_at(F.array(*map(F.lit, "bavs")), ((F.col("a") + F.col("b") * F.col("k") + F.expr("a div (2 + k)")) % 4 + 1).cast("int"))
    return each.select("doc", F.concat(F.lit("ann"), F.col("k").cast("string")).alias("annotator"), F.concat(F.lit("e"), F.col("a").cast("string")).alias("id1"), other.alias("id2"), label.alias("label"))


@query(f"""WITH {NOTES}, n AS (SELECT doc, id1, id2, label, count(*) AS n FROM notes GROUP BY ALL), p AS (SELECT doc, count(DISTINCT annotator) AS people FROM notes GROUP BY doc HAVING people > 1),
best AS (SELECT doc, id1, id2, max(people) AS people, arg_max(label, (n, label)) AS label, max(n) AS n, coalesce(sum(n) FILTER (WHERE label = 'v'), 0) AS vague FROM n JOIN p USING (doc) GROUP BY doc, id1, id2)
SELECT doc, id1, id2, CASE WHEN n * 2 > people AND label <> 'v' THEN label WHEN vague >= people THEN 'mv' WHEN vague > 0 THEN 'pv' ELSE 'nv' END AS label FROM best""")
def q15_majority_merge(spark, sf_dir):
    return evaluate.merged(_notes(spark, sf_dir), fine=True)


@query(f"""WITH {NOTES}, one AS (SELECT doc, annotator, id1, id2, max(label) AS label FROM notes GROUP BY ALL), who AS (SELECT DISTINCT doc, annotator FROM notes),
two AS (SELECT x.doc, x.annotator AS ann1, y.annotator AS ann2 FROM who x JOIN who y ON x.doc = y.doc AND x.annotator < y.annotator),
p AS (SELECT DISTINCT t.*, o.id1, o.id2 FROM two t JOIN one o ON o.doc = t.doc AND o.annotator IN (t.ann1, t.ann2)),
l AS (SELECT p.*, coalesce(x.label, 'v') AS label1, coalesce(y.label, 'v') AS label2 FROM p LEFT JOIN one x ON x.doc = p.doc AND x.annotator = p.ann1 AND x.id1 = p.id1 AND x.id2 = p.id2 LEFT JOIN one y ON y.doc = p.doc AND y.annotator = p.ann2 AND y.id1 = p.id1 AND y.id2 = p.id2),
k AS (SELECT *, unnest(list_filter([CASE WHEN id2 LIKE 'e%' THEN 'ee' END, CASE WHEN id2 LIKE 't%' THEN 'et' END, CASE WHEN id2 = 't0' THEN 'eDCT' END, CASE WHEN id2 = 't0' THEN 'xDCT' END], lambda x: x IS NOT NULL)) AS kind FROM l)
SELECT ann1, ann2, kind, count(*) AS total, count(*) FILTER (WHERE label1 = label2) AS matched, count(*) FILTER (WHERE label1 <> label2) AS mismatched, round(count(*) FILTER (WHERE label1 = label2) / count(*), 9) AS accuracy FROM k GROUP BY ann1, ann2, kind""")
def q16_agreement_by_kind(spark, sf_dir):
    return evaluate.agreement_by_kind(evaluate.annotated_by_two(_notes(spark, sf_dir)), ["ann1", "ann2"]).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH {ENTITIES}, {SAME}, h AS (SELECT doc, id1 AS id, 'BEFORE' AS relation FROM same UNION ALL SELECT doc, id2, 'AFTER' FROM same)
SELECT doc, id, count(*) AS n, count(*) FILTER (WHERE relation = 'AFTER') AS after FROM h GROUP BY doc, id HAVING count(*) > 1""")
def q17_half_link_counts(spark, sf_dir):
    half = evaluate.half_links(pairs.same_sentence(plain(spark, sf_dir)).withColumn("relation", F.lit("BEFORE")))
    return half.groupBy("doc", "id").agg(F.count("*").alias("n"), F.count_if(F.col("relation") == "AFTER").alias("after")).where("n > 1")


@query(f"""WITH {ENTITIES}, {NEXT}, {RULES_SQL}, l AS (SELECT cls1, cls2, CASE WHEN sid1 = sid2 THEN 'SAME' ELSE 'DIFFERENT' END AS place, coalesce(relation, 'VAGUE') AS relation FROM near LEFT JOIN rules USING (cls1, cls2))
SELECT cls1, cls2, place, count(*) AS n, count(*) FILTER (WHERE relation = 'VAGUE') AS vague, CAST(grouping(cls1) AS INT) AS any_cls1, CAST(grouping(cls2) AS INT) AS any_cls2, CAST(grouping(place) AS INT) AS any_place,
  round(count(*) FILTER (WHERE relation = 'VAGUE') / count(*), 9) AS share FROM l GROUP BY CUBE (cls1, cls2, place)""")
def q18_pattern_masks(spark, sf_dir):
    near = pairs.same_or_next(plain(spark, sf_dir)).withColumn("place", F.when(F.col("sid1") == F.col("sid2"), "SAME").otherwise("DIFFERENT"))
    rules = F.broadcast(spark.createDataFrame(CLASS_RULES, "cls1 string, cls2 string, relation string"))
    out = evaluate.masked_counts(near.join(rules, ["cls1", "cls2"], "left").withColumn("relation", F.coalesce("relation", F.lit("VAGUE"))), ["cls1", "cls2", "place"])
    return out.withColumns({"share": F.round("share", 9)} | {c: F.col(c).cast("int") for c in ("any_cls1", "any_cls2", "any_place")})


WORDS = "w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> ''))) AS word FROM documents)"


@query(f"WITH {WORDS}, often AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 20) SELECT doc_id, count(*) AS kept FROM w SEMI JOIN often USING (word) GROUP BY doc_id")
def q19_sparse_feature_cutoff(spark, sf_dir):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " ", -1), lambda w: w != ""))
    each = read(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("word"))
    return maths.frequent(each, ["word"], 20).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("""WITH t AS (SELECT doc_id, generate_subscripts(l, 1) AS idx, unnest(l) AS token FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)),
g AS (SELECT lower(token) AS token, coalesce(lower(lag(token) OVER w), '<s>') AS prev, coalesce(lower(lead(token) OVER w), '</s>') AS next FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT prev, token, next, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 5""")
def q20_token_ngram_window(spark, sf_dir):
    tokens = read(spark, sf_dir, "documents").select(F.split(F.lower("text"), " ", -1).alias("w"))
    # The neighbours of a token stand in the same array, moved by one: no window, no shuffle by document, and no lambda that would split again.
    rest = F.size("w") - 1
    before, after = F.concat(F.array(F.lit("<s>")), F.slice("w", F.lit(1), rest)), F.concat(F.slice("w", F.lit(2), rest), F.array(F.lit("</s>")))
    grams = tokens.select(F.explode(F.arrays_zip(before.alias("prev"), F.col("w").alias("token"), after.alias("next"))).alias("g"))
    return grams.groupBy("g.prev", "g.token", "g.next").agg(F.count("*").alias("n")).where("n >= 5")


@query("""SELECT o_orderkey, unnest(regexp_extract_all(t, '\\d{4}-\\d\\d-\\d\\d|\\d{1,2}/\\d{1,2}/\\d{4}|\\b(?:19|20)\\d\\d\\b')) AS found FROM (
  SELECT o_orderkey, 'It was ordered on ' || strftime(o_orderdate, '%Y-%m-%d') || ' and paid by ' || strftime(o_orderdate, '%m/%d/%Y') || ' or late in ' || strftime(o_orderdate, '%Y') || '.' AS t FROM orders)""")
def q21_regex_timex_extract(spark, sf_dir):
    d = F.col("o_orderdate")
    text = F.concat(F.lit("It was ordered on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" and paid by "), F.date_format(d, "MM/dd/yyyy"), F.lit(" or late in "), F.date_format(d, "yyyy"), F.lit("."))
    sents = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("sid"), text.alias("text"))
    dcts = sents.select("doc", F.lit("2000-01-01").alias("value"))
    return extract.tagged_timexes(sents, dcts).select(F.col("doc").alias("o_orderkey"), F.col("text").alias("found"))


@query("""WITH o AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS doc FROM documents), n AS (SELECT doc, row_number() OVER (ORDER BY doc) - 1 AS n, count(*) OVER () AS c FROM o)
SELECT doc, CASE WHEN doc IN ('d000000003', 'd000000005') THEN 'dev' WHEN doc IN ('d000000007', 'd000000011') THEN 'test' ELSE 'train' END AS "set", CAST(least(n // greatest(c // 10, 1), 9) AS INT) AS fold FROM n""")
def q22_split_and_fold(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("doc"))
    return evaluate.folds(evaluate.split(docs, ["d000000003", "d000000005"], ["d000000007", "d000000011"]), 10)


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def q23_confidence_topk(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(50)


@query(f"""WITH {ENTITIES}, d AS (SELECT doc, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(idx) AS seen FROM ent GROUP BY ALL)
SELECT doc, arg_min(day, seen) AS first_day, arg_max(day, (n, seen)) AS common_day FROM d GROUP BY doc""")
def q24_creation_day(spark, sf_dir):
    t = entities(spark, sf_dir).select("doc", "sid", "idx", F.date_format("ts", "yyyy-MM-dd").alias("value"))
    return extract.creation_day(t).withColumnRenamed("value", "first_day").join(extract.creation_day(t, "common").withColumnRenamed("value", "common_day"), "doc")


@query(f"WITH {ENTITIES}, n AS (SELECT doc, sid, count(*) AS n FROM ent GROUP BY ALL) SELECT a.doc, CAST(sum(a.n * (a.n - 1) // 2 + a.n * coalesce(b.n, 0) + a.n * coalesce(c.n, 0)) AS BIGINT) AS pairs FROM n a LEFT JOIN n b ON a.doc = b.doc AND b.sid = a.sid + 1 LEFT JOIN n c ON a.doc = c.doc AND c.sid = a.sid + 2 GROUP BY a.doc")
def q25_pair_count_windows(spark, sf_dir):
    return evaluate.window_pair_counts(plain(spark, sf_dir), 2)


@query(f"WITH {ENTITIES}, n AS (SELECT doc, cls, count(*) AS n FROM ent GROUP BY ALL), p AS (SELECT doc, n / sum(n) OVER (PARTITION BY doc) AS p FROM n) SELECT doc, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY doc")
def q26_entropy(spark, sf_dir):
    counted = plain(spark, sf_dir).groupBy("doc", "cls").agg(F.count("*").alias("n"))
    return maths.entropy(counted, ["doc"], "n").withColumn("entropy", F.round("entropy", 6))


@query(f"WITH {ENTITIES} SELECT event_id, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS scaled FROM ent WINDOW w AS (PARTITION BY cls, sid)")
def q26b_scale_to_unit(spark, sf_dir):
    return entities(spark, sf_dir).select("event_id", F.round(maths.scaled("value", ["cls", "sid"]), 6).alias("scaled"))


@query(f"""WITH {ENTITIES}, t AS (SELECT doc, sid, id, idx, 1 + event_id % 3 AS len FROM ent WHERE cls IN ('view', 'click')), e AS (SELECT doc, sid, idx FROM ent WHERE cls = 'purchase')
SELECT t.doc, t.id, t.len FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc = t.doc AND e.sid = t.sid AND e.idx BETWEEN t.idx AND t.idx + t.len - 1)""")
def q27_timex_drop_overlap(spark, sf_dir):
    e = entities(spark, sf_dir)
    t = e.where("cls IN ('view', 'click')").select("doc", "sid", "id", "idx", (F.col("event_id") % 3 + 1).alias("len"))
    return extract.outside(t, e.where("cls = 'purchase'")).select("doc", "id", "len")


@query("WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) SELECT first AS id1, doc_id AS id2, 'SIMULTANEOUS' AS relation FROM m WHERE first <> doc_id")
def q28_coref_simultaneous(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    # Copies meet by hash and text; the first of each is found by a minimum that is combined before the shuffle.
    first = docs.groupBy("text").agg(F.min("doc_id").alias("id1"), F.count("*").alias("n")).where("n > 1").select(F.xxhash64("text").alias("h"), F.col("text").alias("t"), "id1")
    both = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(first, "h").where("text = t AND doc_id <> id1")
    return both.select("id1", F.col("doc_id").alias("id2"), F.lit("SIMULTANEOUS").alias("relation"))


@query("""WITH t AS (SELECT conv_id, turn, generate_subscripts(l, 1) AS idx, unnest(l) AS token FROM (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations)),
p AS (SELECT conv_id, turn, idx, CASE WHEN idx > 1 THEN ' ' ELSE '' END || CASE WHEN idx % 5 = 1 THEN '<EVENT id="e' || idx || '">' ELSE '' END || replace(replace(replace(token, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || CASE WHEN idx % 5 = 1 THEN '</EVENT>' ELSE '' END AS p FROM t)
SELECT conv_id, turn, string_agg(p, '' ORDER BY idx) AS markup FROM p GROUP BY ALL""")
def q29_tagged_markup(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("sid"), F.posexplode(F.split("text", " ", -1)).alias("at", "token"))
    toks = turns.select("doc", "sid", (F.col("at") + 1).alias("idx"), "token")
    spans = toks.where("idx % 5 = 1").select("doc", "sid", "idx", F.lit(1).alias("len"), F.lit("EVENT").alias("name"), F.concat(F.lit("e"), F.col("idx").cast("string")).alias("id"))
    return extract.marked_up(toks, spans).select(F.col("doc").alias("conv_id"), F.col("sid").alias("turn"), "markup")
