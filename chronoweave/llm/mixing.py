"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's key is an exponential number divided by its quality weight; documents with small keys
come first. Each source's target is met by complete epochs over the source and then by the documents
with the smallest keys up to the rest of the budget. The key at which a source's budget ends is found
digit by digit from sums over (source, digit), so that no task ever holds or sorts a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import common

SHARE = 1.5
WEIGHTS = (3.0, 1.0, 2.0)
MOST = 2.0
DIGIT_BITS, DIGITS = 12, 4
#: A table of sources up to this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 100_000


def quality_weight(text: Column, size: Column) -> Column:
    """A weight in (0, 1]: one over one plus the signs for each word, beyond the common ones."""
    signs = F.coalesce(F.regexp_count(text, F.lit(r"[!#-&*+/<-@\[-`{-~]")), F.lit(0))
    return F.lit(1.0) / (F.lit(1.0) + signs / F.greatest(size, F.lit(1)))


def key(weight: Column, *identity: Column, seed: int = 42) -> Column:
    """The exponential key as an integer of DIGITS digits that keeps its order."""
    u = common.unsigned_hash01(F.lit(seed), *identity)
    return F.least(((F.lit(1.0) - F.pow(u, F.lit(1.0) / weight)) * (1 << DIGIT_BITS * DIGITS)).cast("long"), F.lit((1 << DIGIT_BITS * DIGITS) - 1))


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes with n, each source's number from 0 by code point, null last: ranges of sources are counted, then numbered from where each begins."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = common.written(sizes.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(starts, "_part").withColumn("n", F.col("_start") + place).drop("_part", "_start")


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes: a row (source, source_size) for each source. Adds target, epochs and rest, the words beyond whole epochs.

    Sources weigh weights in turn by code point, null last. Targets are the level at which
    min(most * size, level * weight) add up to share of all sizes: sources beyond most times their size
    stop there and the rest is shared out by weight again, until none is above. A round is one sum over all sources.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n"), F.lit(len(weights))) + 1).cast("int"))
    ranked = common.written(numbered(sizes).select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("top")), "mix-ranked")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0] * share
    level, stopped = 0.0, -1
    while True:
        # A source whose top by weight is at most the level has stopped; levels only rise.
        over = F.col("top") / F.col("w") <= level * (1 + 1e-12) if stopped >= 0 else F.lit(False)
        r = ranked.agg(F.coalesce(F.sum(F.when(over, F.col("top"))), F.lit(0.0)).alias("full"), F.sum(F.when(~over, F.col("w"))).alias("open"), F.count(F.when(over, 1)).alias("n")).head()
        if r.n == stopped or r.open is None:
            break
        level, stopped = (total - r.full) / r.open, r.n
    out = ranked.select("source", "source_size", F.least(F.col("top"), F.lit(float(level)) * F.col("w")).alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return out.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.round("target").cast("long") - F.col("epochs") * F.col("source_size"), F.lit(0)))


def _joined(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    plan = F.broadcast(plan) if n_sources <= BROADCAST_ROWS else plan
    return rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def plan(rows: DataFrame, **options) -> tuple[DataFrame, int]:
    """rows: (source, size, key). The plan of each source, of: its name, and how many sources there are.

    cut is the key at which the source's budget ends: documents with smaller keys are taken whole,
    and those with this very key share left of their cut_size words.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    out = common.written(source_targets(sizes, **options).select(F.col("source").alias("of"), "source_size", "target", "epochs", "rest", F.lit(0).cast("long").alias("cut"), F.col("rest").alias("left"), F.lit(0).cast("long").alias("cut_size")), "mix-plan")
    n = out.count()
    for k in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - k)
        here = _joined(rows, out.select("of", "cut", "left"), n).where(F.shiftright("key", shift + DIGIT_BITS) == F.shiftright("cut", shift + DIGIT_BITS))
        digits = here.groupBy("source", F.shiftright("key", shift).alias("digit")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        by = Window.partitionBy("source").orderBy("digit")
        digits = digits.withColumns({"before": F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "last": F.lead("digit").over(by).isNull()})
        # The digit in which the budget ends: the first whose words go beyond it, or else the last.
        ends = digits.where((F.col("before") <= F.col("left")) & ((F.col("before") + F.col("words") > F.col("left")) | F.col("last")))
        ends = ends.groupBy("source").agg(F.min(F.struct("digit", "before", "words")).alias("end")).select(F.col("source").alias("at"), "end")
        ends = F.broadcast(ends) if n <= BROADCAST_ROWS else ends
        step = out.join(ends, F.col("of").eqNullSafe(F.col("at")), "left").select(
            "of", "source_size", "target", "epochs", "rest",
            F.coalesce(F.shiftleft(F.col("end.digit"), shift), F.col("cut")).alias("cut"),
            (F.col("left") - F.coalesce(F.col("end.before"), F.lit(0))).alias("left"),
            F.coalesce(F.col("end.words"), F.lit(0)).cast("long").alias("cut_size"),
        )
        last, out = out, common.written(step, "mix-plan")
        common.drop(spark, last)
    return out, n


def keyed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, source, size and key of docs (doc_id, text, source)."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), quality_weight(text, size).alias("weight"), F.xxhash64(text).alias("hash"))
    return rows.select("doc_id", "source", "size", key(F.col("weight"), F.col("doc_id"), F.col("hash"), seed=seed).alias("key"))


def taken() -> Column:
    """Words that the mix takes of a row (size, key) joined with its source's plan."""
    part = F.when(F.col("key") < F.col("cut"), F.col("size")).when((F.col("key") == F.col("cut")) & (F.col("cut_size") > 0), F.floor(F.col("size") * F.least(F.col("left") / F.col("cut_size"), F.lit(1.0)))).otherwise(0)
    return (F.col("epochs") * F.col("size") + part).cast("long")


def mix(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs (doc_id, text, source).

    A null text has size 0; a null source is a source of its own, the last; rows of an empty table
    are none. Fully equal rows have the same key and are treated alike; other columns are ignored.
    """
    rows = common.written(keyed(docs, seed), "mix-rows")
    plans, n = plan(rows, **options)
    return _joined(rows, plans, n).select("doc_id", "size", "source_size", "target", taken().alias("taken"))


def mixed(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """docs as the mix has them: each row as often as it is taken; the row at a budget's end is taken if at least half of it fits.

    Null texts have no words and null sources are one; an empty table gives none; other columns, whatever their names, stay.
    """
    size, weight, hashed, ordinal, name = common.fresh(docs, "size", "weight", "hash", "key", "of")
    rows = common.written(keyed(docs, seed), "mix-rows")
    plans, n = plan(rows, **options)
    plans = plans.select(F.col("of").alias(name), "epochs", "cut", "left", "cut_size")
    text, number = F.col("text").cast("string"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(common.WORD)), F.lit(0)).cast("long")
    plan_row = F.struct(*plans.columns)
    own = docs.withColumns({size: number}).withColumns({weight: quality_weight(text, F.col(size)), hashed: F.xxhash64(text)})
    own = own.withColumn(ordinal, key(F.col(weight), F.col("doc_id").cast("long"), F.col(hashed), seed=seed))
    (of,) = common.fresh(own, "plan")
    side = plans.select(plan_row.alias(of))
    both = own.join(F.broadcast(side) if n <= BROADCAST_ROWS else side, F.col("source").cast("string").eqNullSafe(F.col(f"{of}.{name}")))
    p = F.col(of)
    more = (F.col(ordinal) < p["cut"]) | ((F.col(ordinal) == p["cut"]) & (p["cut_size"] > 0) & (p["left"] * 2 >= p["cut_size"]))
    times = (p["epochs"] + more.cast("long")).cast("int")
    (copy,) = common.fresh(both, "copy")
    return both.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
