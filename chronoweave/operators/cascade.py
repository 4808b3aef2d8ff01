"""The cascade of sieves: proposals in order of precision, the first sieve to label a pair wins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.maths import ratio
from chronoweave.functions.relations import canonical
from chronoweave.operators.closure import extended, united
from chronoweave.scratch import written

LINK = ["doc", "id1", "id2", "relation"]


@dataclass
class Corpus:
    """The tables that sieves read; those a corpus lacks are None."""

    events: DataFrame
    timexes: DataFrame | None = None
    dcts: DataFrame | None = None
    deps: DataFrame | None = None
    tokens: DataFrame | None = None
    spans: DataFrame | None = None
    clusters: DataFrame | None = None
    synsets: DataFrame | None = None
    nodes: DataFrame | None = None


Sieve = Callable[[Corpus], DataFrame | None]


def _pair(df: DataFrame) -> DataFrame:
    return df.withColumns({"lo": F.least("id1", "id2"), "hi": F.greatest("id1", "id2")})


def without_repeats(links: DataFrame, order: str = "ordinal") -> DataFrame:
    """The first link of each unordered pair by order; links without ids go."""
    w = Window.partitionBy("doc", "lo", "hi").orderBy(order, "id1", "id2", "relation")
    valid = _pair(links.where("coalesce(id1, '') <> '' AND coalesce(id2, '') <> ''"))
    return valid.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "lo", "hi")


def without_conflicts(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """proposed without pairs that current has a link for, whatever its relation."""
    return _pair(proposed).join(_pair(current).select("doc", "lo", "hi"), ["doc", "lo", "hi"], "left_anti").drop("lo", "hi")


def proposals(corpus: Corpus, sieves: list[tuple[str, Sieve]]) -> DataFrame | None:
    """All sieves' proposals with sieve and rank. Sieves don't read each other's links, so they need no order here."""
    out = None
    for rank, (name, sieve) in enumerate(sieves):
        made = sieve(corpus)
        if made is None:  # a learned sieve without a model
            continue
        made = made.select(*LINK, F.lit(name).alias("sieve"), F.lit(rank).alias("rank"))
        out = made if out is None else out.unionByName(made)
    return out


def first_wins(proposed: DataFrame) -> DataFrame:
    """One link for each unordered pair: that of the sieve with the least rank, its first by ids."""
    best = F.min_by(F.struct("id1", "id2", "relation", "sieve"), F.struct("rank", "id1", "id2", "relation")).alias("l")
    return _pair(proposed).groupBy("doc", "lo", "hi").agg(best).select("doc", "l.*")


def run(corpus: Corpus, sieves: list[tuple[str, Sieve]], close: bool = True) -> DataFrame:
    """doc, id1, id2, relation, closed, origin: each sieve adds what is open, and the closure of all links follows it.

    What a sieve adds and what follows from that are tables of their own, written once: links of earlier sieves are read, never
    rewritten, and the closure goes on from the new ones.
    """
    tables: list[DataFrame] = []
    named = lambda df, name, closed: df.select(*LINK, F.lit(closed).alias("closed"), F.lit(name).alias("origin"))
    for name, sieve in sieves:
        made = sieve(corpus)
        if made is None:
            continue
        made = without_repeats(made.select(*LINK).withColumn("ordinal", F.lit(0)), "ordinal").select(*LINK)
        kept = without_conflicts(made, united(tables)) if tables else made
        kept = written(named(kept, name, False), "sieve")
        inferred = [named(t, name, True) for t in extended(tables, kept)] if close and not kept.isEmpty() else []
        tables += [kept, *inferred]
    return united(tables) if tables else None


def against_gold(proposed: DataFrame, gold: DataFrame) -> DataFrame:
    """proposed with outcome: correct, incorrect (the gold pair has another relation) or no_gold."""
    truth = canonical(gold).select("doc", "lo", "hi", F.col("rel").alias("gold_rel"))
    outcome = F.when(F.col("gold_rel").isNull(), "no_gold").when(F.col("gold_rel") == F.col("rel"), "correct").otherwise("incorrect")
    return canonical(proposed).join(truth, ["doc", "lo", "hi"], "left").withColumn("outcome", outcome)


def gauntlet(corpus: Corpus, sieves: list[tuple[str, Sieve]], gold: DataFrame) -> DataFrame:
    """Precision of each sieve alone against gold, best first."""
    scored = against_gold(proposals(corpus, sieves), gold)
    hits, misses = F.sum((F.col("outcome") == "correct").cast("long")), F.sum((F.col("outcome") == "incorrect").cast("long"))
    out = scored.groupBy("sieve").agg(F.count("*").alias("proposed"), hits.alias("correct"), misses.alias("incorrect"))
    return out.withColumn("precision", ratio(F.col("correct"), F.col("correct") + F.col("incorrect"))).orderBy(F.desc("precision"), "sieve")


def statistics(links: DataFrame, proposed: DataFrame, gold: DataFrame) -> DataFrame:
    """For each sieve: links proposed, removed as taken already, inferred after it, and its precision, open and closed."""
    kept = against_gold(links.withColumnRenamed("origin", "sieve"), gold).groupBy("sieve").agg(
        F.sum((~F.col("closed")).cast("long")).alias("kept"), F.sum(F.col("closed").cast("long")).alias("inferred"),
        *[F.sum(((F.col("outcome") == o) & (F.col("closed") == c)).cast("long")).alias(f"{o}_{n}") for o in ("correct", "incorrect", "no_gold") for c, n in ((False, "open"), (True, "closed"))],
    )
    made = proposed.groupBy("sieve").agg(F.count("*").alias("proposed"))
    out = made.join(kept, "sieve", "left").fillna(0).withColumn("removed", F.col("proposed") - F.col("kept"))
    return out.withColumns({f"precision_{n}": ratio(F.col(f"correct_{n}"), F.col(f"correct_{n}") + F.col(f"incorrect_{n}")) for n in ("open", "closed")})
