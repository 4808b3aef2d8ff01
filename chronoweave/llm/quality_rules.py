"""Quality rules whose cutoffs are certified on labelled holdouts, in DataFrame operations only.

A rule rejects a text whose statistic lies above a cutoff. Cutoffs are chosen for each stratum (a language):

1. Labelled documents that pass the fixed base rules are dealt by a hash of their ids into a proposal part and a holdout part.
2. From the proposal part, each level of LEVELS gets one cutoff a rule: of those that reject at most the level's share of clean
   documents the one that rejects most others, the highest of these. A level is the union of its rules' rejections.
3. On the holdout part, each level is tested, lenient to strict: the hypothesis that it rejects more than ALPHA of clean documents
   is refused when the exact binomial probability of so few rejections is at most DELTA by the number of strata tested. Testing
   stops at the first level that isn't refused (a fixed sequence needs no further correction), and strata share DELTA (Bonferroni).
   So with probability 1 - DELTA, no stratum loses more than ALPHA of its clean documents, whichever of its levels is taken.
4. Of the certified levels, the one whose rejected share of other documents exceeds that of clean ones most is taken.

A stratum without a certified level, for want of labels for instance, has no cutoffs: the base rules alone decide there.
Cutoffs are integers on a grid of GRID edges a rule, so histograms, not documents, are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import common

#: Share of a stratum's clean documents that may be rejected, and the probability that any stratum loses more.
ALPHA, DELTA = 0.05, 0.05
#: Shares of clean documents of the proposal part that one rule may reject, in 1/10,000.
LEVELS = (0, 2, 5, 10, 20, 35, 50, 75, 100, 150, 200, 300)
#: Statistics are multiplied by SCALE and rounded down; cutoffs lie at -GRID .. GRID.
SCALE, GRID = 1000, 100_000
#: One labelled document in PROPOSAL proposes cutoffs, the others test them.
PROPOSAL = 3
#: Strata whose cutoffs are broadcast; beyond that many they are joined by shuffle.
BROADCAST_STRATA = 10_000
#: Terms of a binomial sum that are added one by one; what is left is bounded from above.
TERMS = 100_000

RULES = ("symbols", "repeats", "dup_lines", "long_words", "short_words", "capitals")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\t-\r]+"


def _repeated(sorted_windows: Column) -> Column:
    """Sorted places of the windows (h, i), sorted by h, whose h is there more than once."""
    same = lambda x, k: F.coalesce(F.get(sorted_windows, k)["h"] == x["h"], F.lit(False))
    twice = F.filter(sorted_windows, lambda x, k: same(x, k + 1) | same(x, k - 1))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _covered(places: Column, width: int) -> Column:
    """Words that windows of a width at sorted places cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct column name: COUNTS, n_lines (lines with a word) and capitals (A-Z). A null text counts as empty.

    Windows of three words are told apart by 64 bits of hash within a text.
    """
    text, words, lines, hashes, windows, places = common.fresh(docs, "own_text", "words", "lines", "hashes", "windows", "places")
    out = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumns({
        words: F.filter(F.split(text, SPACE, -1), lambda w: w != ""),
        lines: F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\t-\r]"))),
    })
    out = out.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    at = lambda i: F.get(F.col(hashes), i)
    starts = F.slice(F.col(hashes), F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0)))
    out = out.withColumn(windows, F.sort_array(F.transform(starts, lambda h, i: F.struct(F.xxhash64(h, at(i + 1), at(i + 2)).alias("h"), i.alias("i")))))
    out = out.withColumn(places, _repeated(F.col(windows)))
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _covered(F.col(places), 3),
        "n_lines": F.size(lines),
        "capitals": without("[A-Z]+"),
    }
    return out.withColumn(name, F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])).select(*docs.columns, name)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def values(stats: Column) -> dict[str, Column]:
    """Each rule's statistic as an integer: the higher, the worse."""
    share = lambda of, by: F.call_function("div", SCALE * stats[of], F.greatest(stats[by], F.lit(1).cast("long")))
    length = share("word_chars", "n_words")
    return {
        "symbols": share("n_symbols", "n_words"), "repeats": share("n_repeat_words", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"),
        "long_words": length, "short_words": -length, "capitals": share("capitals", "word_chars"),
    }


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, brought back to n; its relative error is below 1e-14."""
    x = n.cast("double") + 10.0
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    back = F.lit(1.0)
    for k in range(1, 11):
        back = back * (n.cast("double") + float(k))
    return (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - F.log(back)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """The probability of at most k of n at rate p where k < n * p (1 elsewhere), as a sum from its largest term down.

    After TERMS terms, what is left is bounded from above by a geometric series, so that the result never is too small.
    """
    n, k = n.cast("long"), k.cast("long")
    largest = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    step = lambda j: (k - j).cast("double") * (1 - p) / ((n - k + j + 1).cast("double") * p)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    add = lambda a, j: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * step(j)).alias("term"))
    ratio = step(F.least(k, F.lit(TERMS)))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(k, F.lit(TERMS).cast("long"))), start, add, lambda a: a["sum"] + a["term"] / (1 - ratio))
    return F.when(k.cast("double") < n * p, F.least(F.lit(1.0), F.exp(largest) * total)).otherwise(1.0)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (doc_id, stratum, stats) that pass the base rules with clean and held (for the holdout part); an id's label is its majority."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    own = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("clean"))
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % PROPOSAL
    own = own.withColumn("held", part != 0)
    return rows.where(~base_failed(F.col("stats"))).join(own, "doc_id").select("stratum", "clean", "held", F.struct(*[v.alias(r) for r, v in values(F.col("stats")).items()]).alias("v"))


def propose(labelled: DataFrame) -> DataFrame:
    """stratum, level, cuts (a struct of the rules' cutoffs, null where a rule rejects nothing that isn't clean)."""
    each = labelled.where(~F.col("held")).select("stratum", "clean", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"v.{r}").alias("value")) for r in RULES])).alias("x"))
    bins = each.groupBy("stratum", "x.rule", F.greatest(F.least("x.value", F.lit(GRID)), F.lit(-GRID)).alias("value"))
    bins = bins.agg(F.sum(F.col("clean").cast("long")).alias("clean"), F.sum((~F.col("clean")).cast("long")).alias("other"))
    of = Window.partitionBy("stratum", "rule")
    above = of.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * GRID + 1 rows
    # A cutoff at a bin's value rejects the bins above it; each bin but the highest is a cutoff.
    sums = bins.withColumns({"rejected": F.sum("clean").over(above), "caught": F.sum("other").over(above), "total": F.sum("clean").over(of)})
    sums = sums.where("caught > 0").withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))
    best = sums.where("10000 * rejected <= level * total").groupBy("stratum", "level", "rule").agg(F.max(F.struct("caught", "value"))["value"].alias("value"))
    return best.groupBy("stratum", "level").agg(F.struct(*[F.max(F.when(F.col("rule") == r, F.col("value"))).alias(r) for r in RULES]).alias("cuts"))


def _rejects(value: Column, cuts: Column) -> Column:
    """Whether any rule rejects: value and cuts are structs of RULES."""
    out = F.lit(False)
    for r in RULES:
        out = out | F.coalesce(value[r] > cuts[r], F.lit(False))
    return out


def certify(labelled: DataFrame, proposed: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row a stratum that has labels: its level and cuts (null without a certified one) with the counts that certify it."""
    levels = proposed.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("level", "cuts"))).alias("levels"))  # at most len(LEVELS)
    held = joined(labelled.where("held"), levels)
    # The position of the most lenient level that rejects a document; stricter ones reject a superset but for ties, so each is tried.
    tried = held.select("stratum", "clean", F.posexplode_outer(F.transform("levels", lambda x: F.struct(x["level"].alias("level"), _rejects(F.col("v"), x["cuts"]).alias("hit")))).alias("n", "x"))
    hit = F.coalesce(F.col("x.hit"), F.lit(False))
    count = lambda c: F.sum(c.cast("long"))
    sums = tried.groupBy("stratum", F.col("x.level").alias("level")).agg(count(F.col("clean")).alias("n_clean"), count(F.col("clean") & hit).alias("rejected"), count(~F.col("clean")).alias("n_other"), count(~F.col("clean") & hit).alias("caught"))
    strata = sums.groupBy("stratum").agg(F.max("n_clean").alias("n")).where("n > 0").agg(F.count("*").alias("strata"))  # one row
    sums = sums.crossJoin(F.broadcast(strata))
    tested = sums.withColumn("p_value", F.when(F.col("level").isNotNull() & (F.col("n_clean") > 0), binomial_tail(F.col("n_clean"), F.col("rejected"), alpha)).otherwise(1.0))
    tested = tested.withColumn("passes", F.col("p_value") * F.col("strata") <= delta)
    so_far = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # at most len(LEVELS) rows
    gain = F.col("caught") / F.greatest("n_other", F.lit(1)) - F.col("rejected") / F.greatest("n_clean", F.lit(1))
    good = tested.withColumns({"certified": F.min("passes").over(so_far), "gain": gain}).withColumn("usable", F.col("certified") & (F.col("gain") > 0))
    row = F.struct("level", "n_clean", "rejected", "n_other", "caught", "p_value")
    chosen = good.groupBy("stratum").agg(F.max(F.when(F.col("usable"), F.struct(F.col("gain"), -F.col("level"), row.alias("row"))))["row"].alias("row"))
    chosen = chosen.select("stratum", "row.*")
    return chosen.join(proposed, ["stratum", "level"], "left")


def joined(rows: DataFrame, small: DataFrame) -> DataFrame:
    """rows with small's columns for their stratum, where it has any: broadcast up to BROADCAST_STRATA strata, by shuffle beyond."""
    few = small.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    return rows.join(F.broadcast(small) if few else small, "stratum", "left")


def fit(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs by stratum, as a table. rows: doc_id, stratum, stats; labels: doc_id, quality (1: clean).

    Null labels and ids don't count. No labels or no rows: no strata, hence no cutoffs.
    """
    labelled = common.written(_labelled(rows, labels), "rules-labelled")
    proposed = common.written(propose(labelled), "rules-proposed")
    return common.written(certify(labelled, proposed, alpha, delta), "rules-cutoffs")


def verdicts(rows: DataFrame, labels: DataFrame, stratum: str, stats: str, name: str) -> DataFrame:
    """rows with a struct column name in place of stats (of with_statistics()): COUNTS, base_failed, kept and reasons, the rules that reject."""
    key, cuts = common.fresh(rows.withColumn(name, F.lit(0)), "stratum_key", "cuts")
    own = common.written(rows.withColumn(key, F.coalesce(F.col(stratum).cast("string"), F.lit("und"))), "rules-statistics")
    found = fit(own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("stratum"), F.col(stats).alias("stats")), labels)
    found = found.select(F.col("stratum").alias(key), F.col("cuts").alias(cuts))
    few = found.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    out = own.join(F.broadcast(found) if few else found, key, "left")
    reasons = F.array_compact(F.array(*[F.when(v > F.col(cuts)[r], r) for r, v in values(F.col(stats)).items()]))
    failed = base_failed(F.col(stats))
    verdict = F.struct(*[F.col(stats)[c].alias(c) for c in COUNTS], failed.alias("base_failed"), (~failed & (F.size(reasons) == 0)).alias("kept"), reasons.alias("reasons"))
    return out.withColumn(name, verdict).select(*[c for c in rows.columns if c not in (name, stats)], name)


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", name: str = "verdict") -> DataFrame:
    """docs with a struct column name: COUNTS, base_failed, kept and the rules that reject the text (reasons).

    Every row gets a verdict of its own, repeated ones alike; a null text counts as empty (and fails the base rules), a null
    stratum is "und", a null id has no label. Other columns stay as they are, but for one called name, which is replaced; an empty
    table gives no rows.
    """
    (stats,) = common.fresh(docs.withColumn(name, F.lit(0)), "stats")
    return verdicts(with_statistics(docs, stats), labels, stratum, stats, name).select(*[c for c in docs.columns if c != name], name)


def kept(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs, with their columns, that the base rules and the certified cutoffs keep."""
    (name,) = common.fresh(docs, "verdict")
    return judged(docs, labels, stratum, name).where(F.col(name)["kept"]).drop(name)


def _sql() -> str:
    value = {
        "symbols": "n_symbols * 1000 // greatest(n_words, 1)", "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)",
        "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)", "long_words": "word_chars * 1000 // greatest(n_words, 1)",
        "short_words": "-(word_chars * 1000 // greatest(n_words, 1))", "capitals": "n_capitals * 1000 // greatest(word_chars, 1)",
    }
    each = " UNION ALL ".join(f"SELECT doc_id, stratum, clean, held, '{r}' AS rule, greatest(least({v}, {GRID}), -{GRID}) AS grid, {v} AS value FROM labelled" for r, v in value.items())
    every = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {v} AS value FROM stats WHERE NOT base_failed" for r, v in value.items())
    levels = ", ".join(f"({x})" for x in LEVELS)
    return rf"""
WITH own AS (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM own),
triple AS (SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM triple) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT i) AS n FROM twice GROUP BY doc_id),
counted AS (SELECT s.doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeats r ON s.doc_id = r.doc_id),
stats AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
label AS (SELECT doc_id, avg(quality) >= 0.5 AS clean, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {PROPOSAL} <> 0 AS held
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT s.*, clean, held FROM stats s JOIN label USING (doc_id) WHERE NOT base_failed),
each AS ({each}),
bins AS (SELECT stratum, rule, grid, sum(clean::INT) AS clean, sum((NOT clean)::INT) AS other FROM each WHERE NOT held GROUP BY ALL),
sums AS (SELECT *, sum(clean) OVER a AS rejected, sum(other) OVER a AS caught, sum(clean) OVER (PARTITION BY stratum, rule) AS total
  FROM bins WINDOW a AS (PARTITION BY stratum, rule ORDER BY grid DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level(level) AS (VALUES {levels}),
cut AS (SELECT stratum, level, rule, max((caught, grid))[2] AS cut FROM sums, level WHERE caught > 0 AND 10000 * rejected <= level * total GROUP BY ALL),
hit AS (SELECT DISTINCT e.doc_id, c.level FROM each e JOIN cut c ON e.stratum = c.stratum AND e.rule = c.rule AND e.value > c.cut WHERE held),
tried AS (SELECT l.stratum, x.level, l.clean, h.doc_id IS NOT NULL AS hit FROM labelled l JOIN (SELECT DISTINCT stratum, level FROM cut) x ON l.stratum = x.stratum
  LEFT JOIN hit h ON h.doc_id = l.doc_id AND h.level = x.level WHERE held),
tested AS (SELECT stratum, level, sum(clean::INT)::BIGINT AS n, sum((clean AND hit)::INT)::BIGINT AS k, sum((NOT clean)::INT)::BIGINT AS m, sum((NOT clean AND hit)::INT)::BIGINT AS caught FROM tried GROUP BY ALL),
p AS (SELECT *, CASE WHEN n = 0 OR k >= n * {ALPHA} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}::DOUBLE) + (n - i) * ln(1 - {ALPHA}::DOUBLE)))) END AS p FROM tested),
strata AS (SELECT count(DISTINCT stratum) AS strata FROM labelled WHERE held AND clean),
sure AS (SELECT *, min((p * strata <= {DELTA})::INT) OVER (PARTITION BY stratum ORDER BY level) = 1 AS certified, caught / greatest(m, 1) - k / greatest(n, 1) AS gain FROM p, strata),
chosen AS (SELECT stratum, -max((gain, -level))[2] AS level FROM sure WHERE certified AND gain > 0 GROUP BY stratum),
rejected AS (SELECT DISTINCT v.doc_id FROM ({every}) v JOIN chosen ON v.stratum = chosen.stratum JOIN cut c ON c.stratum = v.stratum AND c.level = chosen.level AND c.rule = v.rule AND v.value > c.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM stats
"""


#: op11's rows over documents and labels, in DuckDB's SQL.
SQL = _sql()
