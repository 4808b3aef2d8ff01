"""Queries of selections, relation names, time values, token features and word functions that no other query runs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import maths, relations, text
from chronoweave.functions import timex as tx
from chronoweave.operators import cascade, classify, evaluate, extract, learned, markup, pairs, selection, sieves
from chronoweave.plans.catalogue import query, read
from chronoweave.plans.corpus import CORPUS, corpus
from chronoweave.plans.reports import _LINKED, _linked

_PLACED = f"{_LINKED}, own AS (SELECT doc, id1, id2, truth AS relation, closed, kind FROM two WHERE truth IS NOT NULL)"
_PLACES = f"""{_PLACED}, far AS (SELECT a.doc, a.id AS id1, b.id AS id2, 'BEFORE' AS relation, a.sid AS sid1, b.sid AS sid2 FROM ev a JOIN ev b ON a.doc = b.doc AND a.id < b.id AND abs(a.sid - b.sid) <= 2)"""


def _links(spark: SparkSession, sf_dir: str) -> tuple[cascade.Corpus, DataFrame]:
    c, rows = _linked(spark, sf_dir)
    return c, rows.where("truth IS NOT NULL").select("doc", "id1", "id2", F.col("truth").alias("relation"), "closed")


def _far(spark: SparkSession, sf_dir: str) -> tuple[cascade.Corpus, DataFrame]:
    c = corpus(spark, sf_dir)
    both = pairs.windowed(c.events, 2).select("doc", F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))
    return c, both.withColumn("relation", F.lit("BEFORE"))


@query(f"WITH {_PLACED} SELECT doc, id1, id2, relation FROM own WHERE NOT closed")
def p01_open_links(spark, sf_dir):
    return selection.open_links(_links(spark, sf_dir)[1]).drop("closed")


@query(f"WITH {_PLACED} SELECT doc, id1, id2, relation FROM own WHERE kind IN ('et', 'ed')")
def p02_links_of_a_kind(spark, sf_dir):
    return selection.of_type(_links(spark, sf_dir)[1], "et").drop("closed")


@query(f"WITH {_PLACED} SELECT doc, id1, id2, relation FROM own WHERE doc NOT IN ('3', '5')")
def p03_without_links_of_documents(spark, sf_dir):
    return selection.without_links(_links(spark, sf_dir)[1], ["3", "5"]).drop("closed")


@query("SELECT event_id, value FROM events WHERE value >= 50")
def p04_confident(spark, sf_dir):
    return selection.confident(read(spark, sf_dir, "events").withColumn("confidence", F.col("value")), 50.0).select("event_id", "value")


@query(f"WITH {CORPUS} SELECT doc, sid, string_agg(id, ' ' ORDER BY idx) AS ids, count(*) AS n FROM ev GROUP BY ALL")
def p05_entities_by_sentence(spark, sf_dir):
    rows = selection.by_sentence(corpus(spark, sf_dir).events.select("doc", "sid", "idx", "id"))
    return rows.select("doc", "sid", F.array_join(F.transform("entities", lambda e: e["id"]), " ").alias("ids"), F.size("entities").cast("long").alias("n"))


@query(f"WITH {_PLACED} SELECT DISTINCT e.doc, e.id, e.text FROM ev e JOIN own ON own.doc = e.doc AND (own.id1 = e.id OR own.id2 = e.id) WHERE own.relation = 'VAGUE'")
def p10_named_entities_of_links(spark, sf_dir):
    c, links = _links(spark, sf_dir)
    ids = links.where("relation = 'VAGUE'").select("doc", F.explode(F.array("id1", "id2")).alias("id"))
    return selection.named(c.events, ids).select("doc", "id", "text")


@query(f"WITH {_PLACES} SELECT doc, id1, id2, CASE WHEN sid1 = sid2 THEN 'within' ELSE 'next' END AS place FROM far WHERE abs(sid1 - sid2) <= 1")
def p16_links_by_sentences(spark, sf_dir):
    c, links = _far(spark, sf_dir)
    within, near = selection.is_intra_sentence(links, c.events), selection.of_neighbours(links, c.events)
    return within.select("doc", "id1", "id2", F.lit("within").alias("place")).unionByName(near.select("doc", "id1", "id2", F.lit("next").alias("place")))


@query(f"WITH {_PLACED} SELECT doc, id1, id2, relation FROM own WHERE kind = 'ed'")
def p16b_links_to_creation_times(spark, sf_dir):
    c, links = _links(spark, sf_dir)
    return selection.to_creation_time(links, c.dcts).drop("closed")


@query(f"WITH {_PLACED} SELECT doc, id1, id2, relation FROM own SEMI JOIN (SELECT doc, id FROM ev WHERE cls <> 'STATE') a ON a.doc = own.doc AND a.id = own.id1 SEMI JOIN (SELECT doc, id FROM ev WHERE cls <> 'STATE') b ON b.doc = own.doc AND b.id = own.id2")
def p14_trimmed_to_known_ids(spark, sf_dir):
    c, links = _links(spark, sf_dir)
    return evaluate.trimmed(links.drop("closed"), c.events.where("cls <> 'STATE'").select("doc", "id"))


@query(f"WITH {_PLACED}, o AS (SELECT doc, id1, id2, row_number() OVER (PARTITION BY doc ORDER BY md5(id1 || id2)) AS ordinal FROM two) SELECT o.doc, o.id1, o.id2, o.ordinal, coalesce(own.relation, 'UNKNOWN') AS label FROM o LEFT JOIN own ON own.doc = o.doc AND own.id1 = o.id1 AND own.id2 = o.id2")
def g15_aligned_to_an_order(spark, sf_dir):
    c, rows = _linked(spark, sf_dir)
    order = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc").orderBy(F.md5(F.concat("id1", "id2")))).cast("long")).select("doc", "id1", "id2", "ordinal")
    return evaluate.aligned(rows.where("truth IS NOT NULL").select("doc", "id1", "id2", F.col("truth").alias("label")), order)


_NAMES = ["before", "during", "During_Inv", "identity", "is-included", "BEGUN-BY", " ends ", "Simultaneous", "nothing", "overlap-or-after", ""]


@query(f"""SELECT event_id, CASE upper(replace(trim(name), '-', '_')) WHEN 'DURING' THEN 'IS_INCLUDED' WHEN 'DURING_INV' THEN 'INCLUDES' WHEN 'IDENTITY' THEN 'SIMULTANEOUS' WHEN 'NOTHING' THEN NULL WHEN '' THEN NULL ELSE upper(replace(trim(name), '-', '_')) END AS relation
  FROM (SELECT event_id, {_NAMES}[1 + event_id % {len(_NAMES)}] AS name FROM events)""")
def a02_normalised_names(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % len(_NAMES) + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", relations.normalised(name).alias("relation"))


_SHORT = list(relations.LABELS)


@query(f"SELECT event_id, {list(relations.LABELS.values())}[1 + event_id % {len(_SHORT)}] AS label FROM events")
def s11_expanded_labels(spark, sf_dir):
    short = F.element_at(F.array(*[F.lit(f" {x.upper()} ") for x in _SHORT]), (F.col("event_id") % len(_SHORT) + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", relations.expanded_label(short).alias("label"))


@query(f"""WITH {CORPUS}, t AS (SELECT *, ['DATE', 'DURATION', 'SET', 'TIME'][1 + k % 4] AS kind, CASE WHEN k % 3 = 0 THEN 'PAST_REF' ELSE value END AS v FROM (SELECT *, substr(id, 2)::BIGINT // 5 AS k FROM tx))
SELECT doc, id, CASE WHEN kind IN ('DURATION', 'SET') OR v = 'PAST_REF' THEN NULL WHEN length(v) = 7 THEN v || '-01 00:00:00' ELSE v || ' 00:00:00' END AS low FROM t""")
def t07_ranges_by_type(spark, sf_dir):
    k = F.floor(F.substring("id", 2, 20).cast("long") / 5)
    kind = F.element_at(F.array(*map(F.lit, ["DATE", "DURATION", "SET", "TIME"])), (k % 4 + 1).cast("int"))
    rows = corpus(spark, sf_dir).timexes.withColumns({"type": kind, "value": F.when(k % 3 == 0, "PAST_REF").otherwise(F.col("value"))})
    return tx.ranged(rows).select("doc", "id", F.date_format("low", "yyyy-MM-dd HH:mm:ss").alias("low"))


_PHRASES = ["a year ago", "Last Year", "two years ago", "the latest quarter", "the quarter", "yesterday"]


@query(f"""WITH e AS (SELECT event_id, month(ts) AS m, year(ts) AS y, {_PHRASES}[1 + event_id % {len(_PHRASES)}] AS phrase, CASE WHEN event_id % {len(_PHRASES)} = 4 THEN 'P3M' ELSE strftime(ts, '%Y-%m-%d') END AS value FROM events),
q AS (SELECT *, CASE WHEN m >= 10 THEN 1 WHEN m <= 3 THEN 2 WHEN m <= 7 THEN 3 ELSE 4 END AS own FROM e), r AS (SELECT *, (own + 1) % 4 + 1 AS quarter FROM q)
SELECT event_id, CASE phrase WHEN 'a year ago' THEN (y - 1) || '-Q' || quarter WHEN 'Last Year' THEN substr(value, 1, 4) WHEN 'two years ago' THEN substr(value, 1, 4) WHEN 'the latest quarter' THEN y || '-Q' || quarter WHEN 'the quarter' THEN y || '-Q' || quarter ELSE value END AS value FROM r""")
def t13_fiscal_quarters(spark, sf_dir):
    k = F.col("event_id") % len(_PHRASES)
    day = F.date_format("ts", "yyyy-MM-dd")
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (k + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", tx.fiscal_fix(phrase, F.when(k == 4, "P3M").otherwise(day), day).alias("value"))


@query("""SELECT event_id, dayname(ts) IN ('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday') AND event_id % 2 = 0 AS is_weekday, CASE WHEN event_id % 3 = 0 THEN 'PRESENT_REF' WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m') END AS day FROM events""")
def t16_days(spark, sf_dir):
    k = F.col("event_id")
    word = F.when(k % 2 == 0, F.date_format("ts", "EEEE")).otherwise(F.concat(F.date_format("ts", "EEEE"), F.lit("s")))
    value = F.when(k % 3 == 0, "PRESENT_REF").when(k % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format("ts", "yyyy-MM"))
    return read(spark, sf_dir, "events").select("event_id", tx.is_day_of_week(word).alias("is_weekday"), tx.to_day(value).alias("day"))


@query(f"""WITH {CORPUS}, w AS (SELECT *, lower(token) AS low, coalesce(lag(lower(token)) OVER s, '<s>') AS w1, coalesce(lag(lower(token), 2) OVER s, '<s>') AS w2, coalesce(lead(lower(token)) OVER s, '</s>') AS n1, coalesce(lead(lower(token), 2) OVER s, '</s>') AS n2,
  coalesce(lag(pos) OVER s, '<s>') AS p1, coalesce(lag(pos, 2) OVER s, '<s>') AS p2 FROM tok WINDOW s AS (PARTITION BY doc, sid ORDER BY idx)), d AS (SELECT doc, sid, idx, list_sort(list(f)) AS more FROM (SELECT doc, sid, gov_idx AS idx, 'DEPG-' || reln AS f FROM dep WHERE gov_idx IS NOT NULL UNION ALL SELECT doc, sid, dep_idx, 'DEPD-' || reln FROM dep WHERE gov_idx IS NOT NULL) GROUP BY ALL)
SELECT w.doc, w.sid, w.idx, array_to_string(list_sort(list_concat([low, w1 || '-' || low, w2 || '-' || w1 || '-' || low, 'PRE-' || w1, 'PRE-' || w2 || '-' || w1, 'POST-' || n1, 'POST-' || n1 || '-' || n2, pos, p1 || '-' || pos, p2 || '-' || p1 || '-' || pos], coalesce(more, []))), ' ') AS features
FROM w LEFT JOIN d ON d.doc = w.doc AND d.sid = w.sid AND d.idx = w.idx""")
def e03_token_features(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return classify.token_features(c.tokens, c.deps).select("doc", "sid", "idx", F.array_join(F.array_sort("features"), " ").alias("features"))


@query(f"""WITH {CORPUS}, word AS (SELECT doc, sid, idx, ['would', 'had', 'MAY', 'not'][1 + k % 4] AS dep FROM tok), m AS (SELECT DISTINCT d.doc, d.sid, d.gov_idx AS idx FROM dep d JOIN word w ON w.doc = d.doc AND w.sid = d.sid AND w.idx = d.dep_idx WHERE d.reln IN ('nsubj', 'dobj') AND lower(w.dep) IN ('would', 'may'))
SELECT ev.doc, ev.id, CASE WHEN m.idx IS NOT NULL THEN 'FUTURE' ELSE ev.tense END AS tense FROM ev LEFT JOIN m ON m.doc = ev.doc AND m.sid = ev.sid AND m.idx = ev.idx""")
def e07_modal_future(spark, sf_dir):
    c = corpus(spark, sf_dir)
    k = F.substring("id", 3, 20).cast("long")
    every = c.events.select("doc", "sid", "idx", "id").unionByName(c.timexes.select("doc", "sid", "idx", F.concat(F.lit("ei"), F.substring("id", 2, 20)).alias("id")))
    words = every.select("doc", "sid", F.col("idx").alias("dep_idx"), F.element_at(F.array(*map(F.lit, ["would", "had", "MAY", "not"])), (k % 4 + 1).cast("int")).alias("dep"))
    deps = c.deps.withColumn("reln", F.when(F.col("reln").isin("nsubj", "dobj"), "aux").otherwise(F.col("reln"))).join(words, ["doc", "sid", "dep_idx"])
    return extract.with_modal_future(c.events, deps).select("doc", "id", "tense")


@query(f"""WITH {CORPUS}, tied AS (SELECT DISTINCT e.doc, e.id FROM ev e JOIN dep d ON d.doc = e.doc AND d.sid = e.sid AND d.gov_idx = e.idx) SELECT doc, id, text FROM ev ANTI JOIN tx ON tx.doc = ev.doc AND tx.sid = ev.sid AND (ev.idx = tx.idx OR ev.idx = tx.idx + 1)""")
def p13_events_outside_times(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return extract.events_outside(c.events, c.timexes.withColumn("len", F.lit(2))).select("doc", "id", "text")


@query(f"""WITH {_LINKED}, order_ AS (SELECT a.doc, a.id AS id1, b.id AS id2 FROM ev a JOIN ev b ON a.doc = b.doc AND a.sid = b.sid AND (a.idx, a.id) < (b.idx, b.id))
SELECT two.doc, two.id1, two.id2, CASE WHEN order_.doc IS NOT NULL THEN 'BEFORE' ELSE two.truth END AS relation FROM two LEFT JOIN order_ ON order_.doc = two.doc AND order_.id1 = two.id1 AND order_.id2 = two.id2 WHERE two.truth IS NOT NULL""")
def e17_relabelled_links(spark, sf_dir):
    c, links = _links(spark, sf_dir)
    c.timexes = None
    return markup.relabelled(links.drop("closed"), c, [("text_order", sieves.text_order)])


@query(f"""WITH {CORPUS}, made AS (SELECT a.doc, a.id AS id1, b.id AS id2, 'BEFORE' AS relation, 'order' AS sieve, 0 AS rank FROM ev a JOIN ev b ON a.doc = b.doc AND a.sid = b.sid AND (a.idx, a.id) < (b.idx, b.id) AND a.tense = b.tense
  UNION ALL SELECT g.doc, g.id1, g.id2, 'SIMULTANEOUS', 'states', 1 FROM gov g WHERE cls1 = 'STATE' AND cls2 = 'STATE' AND idx1 < idx2) SELECT * FROM made""")
def u01_all_proposals(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return cascade.proposals(c, [("order", sieves.same_tense_order), ("states", sieves.state_governs_state)]).select("doc", "id1", "id2", "relation", "sieve", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {_LINKED}, l AS (SELECT *, n % 10 / 10 AS confidence FROM (SELECT doc, id1, id2, row_number() OVER (PARTITION BY doc ORDER BY id1, id2) AS n FROM two WHERE truth IS NOT NULL)) SELECT doc, id1, id2, confidence FROM l ORDER BY confidence DESC, doc, id1, id2 LIMIT 100")
def a06_most_confident_links(spark, sf_dir):
    c, links = _links(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("doc").orderBy("id1", "id2"))
    return relations.by_confidence(links.withColumn("confidence", n % 10 / 10)).select("doc", "id1", "id2", "confidence").limit(100)


_RELNS = ["conj_and", "xcomp", "amod", "nsubjpass", "agent", "dobj", "prep_in", "det"]


@query(f"SELECT event_id, ['conj', 'comp', 'mod', 'subj', 'subj', 'obj', 'prep_in', 'det'][1 + event_id % 8] AS grp, 'd' || event_id AS stem, ['the cat', 'cat', 'An old cat'][1 + event_id % 3] <> 'cat' AS had, 'w' || event_id AS word FROM events")
def f01_words_and_names(spark, sf_dir):
    k = F.col("event_id")
    reln = F.element_at(F.array(*map(F.lit, _RELNS)), (k % len(_RELNS) + 1).cast("int"))
    phrase = F.element_at(F.array(*map(F.lit, ["the cat", "cat", "An old cat"])), (k % 3 + 1).cast("int"))
    name = F.concat(F.lit("d"), k.cast("string"), F.lit(".tml.gz"))
    word = F.concat(F.lit("(\"'w"), k.cast("string"), F.lit(",'\")"))
    return read(spark, sf_dir, "events").select("event_id", text.grammatical_group(reln).alias("grp"), text.stem_of_name(name).alias("stem"), (text.without_determiner(phrase) != phrase).alias("had"), text.without_punctuation(word).alias("word"))


@query("SELECT conv_id, turn, text AS token, ' ' AS before, chr(10) AS after FROM conversations")
def f02_token_triples(spark, sf_dir):
    triple = text.decoded_token(text.encoded_token(F.lit(" "), F.col("text"), F.lit("\n")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", triple.alias("t")).select("conv_id", "turn", "t.token", "t.before", "t.after")


@query("SELECT event_id, n, k, CASE WHEN k > n THEN 0 ELSE (factorial(n) / (factorial(k) * factorial(n - k)))::BIGINT END AS ways FROM (SELECT event_id, (event_id % 15)::INT AS n, (event_id // 15 % 9)::INT AS k FROM events) WHERE k <= n UNION ALL SELECT event_id, n, k, 0 FROM (SELECT event_id, (event_id % 15)::INT AS n, (event_id // 15 % 9)::INT AS k FROM events) WHERE k > n")
def f03_choose(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 15).cast("int").alias("n"), (F.floor(F.col("event_id") / 15) % 9).cast("int").alias("k"))
    return rows.withColumn("ways", maths.choose(F.col("n"), F.col("k")))


@query("""WITH t AS (SELECT user_id, event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS a, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS b FROM events GROUP BY ALL), u AS (SELECT user_id FROM t GROUP BY user_id HAVING sum(a) > 0 AND sum(b) > 0)
SELECT user_id, event_type, a + b AS added, greatest(a, b) AS largest FROM t SEMI JOIN u USING (user_id)""")
def f04_counts_of_two_maps(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("early", F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    counted = rows.groupBy("user_id", "early", "event_type").agg(F.count("*").alias("n")).groupBy("user_id", "early").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    a, b = (counted.where("early" if e else "NOT early").select("user_id", F.col("m").alias(name)) for e, name in ((True, "a"), (False, "b")))
    both = a.join(b, "user_id").select("user_id", selection.added_counts("a", "b").alias("added"), selection.largest_counts("a", "b").alias("largest"))
    return both.select("user_id", F.explode("added").alias("event_type", "added"), "largest").select("user_id", "event_type", "added", F.col("largest")[F.col("event_type")].alias("largest"))


@query(f"""WITH {CORPUS}, two AS (SELECT a.doc, a.id AS id1, b.id AS id2, a.k + b.k AS n FROM ev a JOIN ev b ON a.doc = b.doc AND a.sid = b.sid AND (a.idx, a.id) < (b.idx, b.id)), near AS (SELECT doc, id AS id2, lag(id) OVER w AS id1 FROM ent WINDOW w AS (PARTITION BY doc, sid ORDER BY idx, id))
SELECT two.doc, two.id1, two.id2, CASE WHEN n % 2 = 0 THEN CASE WHEN n % 4 = 0 THEN 'BEFORE' ELSE 'AFTER' END ELSE 'NONE' END AS label FROM two""")
def e14_training_rows(spark, sf_dir):
    c = corpus(spark, sf_dir)
    both = pairs.same_sentence(c.events).select("doc", "id1", "id2")
    number = lambda x: F.substring(x, 3, 20).cast("long")
    n = number("id1") + number("id2")
    # Every other gold link is told the other way round.
    gold = both.where(n % 2 == 0).select("doc", F.when(n % 4 == 0, F.col("id1")).otherwise(F.col("id2")).alias("id1"), F.when(n % 4 == 0, F.col("id2")).otherwise(F.col("id1")).alias("id2"), F.lit("BEFORE").alias("relation"))
    return learned.training_rows(both, gold, keep_none=True)
