"""Choosing links, events and training pairs, and small reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.relations import link_type
from chronoweave.operators import pairs


def open_links(links: DataFrame) -> DataFrame:
    """Links that no closure made."""
    return links.where(~F.coalesce("closed", F.lit(False)))


def of_type(links: DataFrame, kind: str) -> DataFrame:
    """Links between two events (ee), an event and a time (et), or two times (tt)."""
    return links.where(link_type(F.col("id1"), F.col("id2")) == kind)


def without_links(links: DataFrame, docs: list[str] | None = None) -> DataFrame:
    """No links of some documents, or of any."""
    return links.where(~F.col("doc").isin(*docs)) if docs is not None else links.limit(0)


def confident(links: DataFrame, least: float) -> DataFrame:
    return links.where(F.col("confidence") >= least)


def by_sentence(entities: DataFrame) -> DataFrame:
    """doc, sid, entities: the entities of each sentence in text order."""
    rest = [c for c in entities.columns if c not in ("doc", "sid", "idx")]
    return entities.groupBy("doc", "sid").agg(F.array_sort(F.collect_list(F.struct("idx", *rest))).alias("entities"))


def named(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Entities whose (doc, id) are in ids."""
    return entities.join(ids.select("doc", "id").distinct(), ["doc", "id"], "left_semi")


def with_places(links: DataFrame, entities: DataFrame) -> DataFrame:
    """links with sid1, idx1, sid2, idx2 of their ends."""
    for k in (1, 2):
        links = links.join(entities.select("doc", F.col("id").alias(f"id{k}"), F.col("sid").alias(f"sid{k}"), F.col("idx").alias(f"idx{k}")), ["doc", f"id{k}"])
    return links


def is_intra_sentence(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Links within a sentence."""
    return with_places(links, entities).where("sid1 = sid2")


def of_neighbours(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Links between neighbouring sentences."""
    return with_places(links, entities).where("abs(sid1 - sid2) = 1")


def to_creation_time(links: DataFrame, dcts: DataFrame) -> DataFrame:
    """Links of an event and its document's creation time."""
    made = dcts.select("doc", F.col("id").alias("made"))
    hit = ((F.col("id1") == F.col("made")) & F.startswith("id2", F.lit("e"))) | ((F.col("id2") == F.col("made")) & F.startswith("id1", F.lit("e")))
    return links.join(made, "doc").where(hit).drop("made")


def training_links(links: DataFrame, entities: DataFrame, kinds: tuple[str, ...] = ("ee", "et"), sentences: str = "any", longest: int | None = None, closed: bool = False, drop: tuple[str, ...] = ("NONE", "OVERLAP"), origins: tuple[str, ...] | None = None) -> DataFrame:
    """Links to learn from: by kind, by how their sentences lie (same, neighbour, different or any), by distance in tokens within one, by origin and relation."""
    out = with_places(links, entities).where(link_type(F.col("id1"), F.col("id2")).isin(*kinds) & ~F.col("relation").isin(*drop))
    apart = F.abs(F.col("sid1") - F.col("sid2"))
    out = out.where({"same": apart == 0, "neighbour": apart == 1, "different": apart > 0, "any": F.lit(True)}[sentences])
    if longest is not None:
        out = out.where((apart > 0) | (F.abs(F.col("idx1") - F.col("idx2")) <= longest))
    if "closed" in links.columns and not closed:
        out = open_links(out)
    return out.where(F.col("origin").isin(*origins)) if origins is not None else out


def interlopers(events: DataFrame) -> DataFrame:
    """doc, id1, id2, between, sequential: pairs of a sentence and how many events stand between them, from their numbers in it."""
    place = F.row_number().over(Window.partitionBy("doc", "sid").orderBy("idx", "id"))
    both = pairs.same_sentence(events.select("doc", "sid", "idx", "id", place.alias("place")))
    between = (F.col("place2") - F.col("place1") - 1).cast("long")
    return both.select("doc", "id1", "id2", between.alias("between"), (between == 0).alias("sequential"))


def counts_of(events: DataFrame, attribute: str) -> DataFrame:
    """value, n of an attribute, such as the modality."""
    return events.groupBy(F.col(attribute).alias("value")).agg(F.count("*").alias("n"))


def vague_by_nominal(links: DataFrame, events: DataFrame) -> DataFrame:
    """doc, id, vague, n, text: how many links of pairs whose first event has neither tense nor aspect are vague, for both ends."""
    first = events.where("tense = 'NONE' AND aspect = 'NONE'").select("doc", F.col("id").alias("id1"))
    own = links.join(first, ["doc", "id1"], "left_semi")
    ends = own.select("doc", F.explode(F.array("id1", "id2")).alias("id"), (F.col("relation") == "VAGUE").alias("is_vague"))
    return ends.groupBy("doc", "id").agg(F.count_if("is_vague").alias("vague"), F.count("*").alias("n")).join(events.select("doc", "id", "text"), ["doc", "id"])


def creation_links_by_word(links: DataFrame, events: DataFrame, dcts: DataFrame) -> DataFrame:
    """word, n: how often an event's word is linked to the creation time, commonest first."""
    own = to_creation_time(links, dcts).select("doc", F.when(F.startswith("id1", F.lit("e")), F.col("id1")).otherwise(F.col("id2")).alias("id"))
    return own.join(events.select("doc", "id", F.col("text").alias("word")), ["doc", "id"]).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word")


def profiles(rows: DataFrame, labels: list[str]) -> DataFrame:
    """For each feature profile (column profile) how often each relation stands with it."""
    return rows.groupBy("profile").pivot("relation", labels).count().fillna(0)


def definite(entities: DataFrame, deps: DataFrame, reln: str = "det") -> DataFrame:
    """entities with definite: whether a determiner in th hangs on them. deps: doc, sid, reln, gov_idx, dep (the word)."""
    hit = deps.where((F.col("reln") == reln) & F.startswith("dep", F.lit("th"))).select("doc", "sid", F.col("gov_idx").alias("idx"), F.lit(True).alias("definite")).distinct()
    return entities.join(hit, ["doc", "sid", "idx"], "left").withColumn("definite", F.coalesce("definite", F.lit(False)))


def proper(entities: DataFrame, names: DataFrame) -> DataFrame:
    """entities with proper: whether a named span (doc, sid, end, exclusive) ends in them."""
    hit = names.select("doc", "sid", (F.col("end") - 1).alias("idx"), F.lit(True).alias("proper")).distinct()
    return entities.join(hit, ["doc", "sid", "idx"], "left").withColumn("proper", F.coalesce("proper", F.lit(False)))


def possessive(entities: DataFrame, deps: DataFrame, names: DataFrame) -> DataFrame:
    """entities with possessive: nouns that are possessors, or stand after of and are definite or names."""
    own = proper(definite(entities, deps), names)
    ties = deps.where(F.col("reln").isin("poss", "prep_of")).groupBy("doc", "sid", F.col("dep_idx").alias("idx")).agg(F.bool_or(F.col("reln") == "poss").alias("poss"), F.bool_or(F.col("reln") == "prep_of").alias("of"))
    hit = F.startswith("pos", F.lit("NN")) & (F.coalesce("poss", F.lit(False)) | (F.coalesce("of", F.lit(False)) & (F.col("definite") | F.col("proper"))))
    return own.join(ties, ["doc", "sid", "idx"], "left").withColumn("possessive", hit).drop("poss", "of")


def nominative(entities: DataFrame, nominal_lemmas: DataFrame) -> DataFrame:
    """Nouns (pos, lemma) whose lemma is in nominal_lemmas: a nominalisation or an event noun."""
    return entities.where(F.startswith("pos", F.lit("N"))).join(nominal_lemmas.select("lemma").distinct(), "lemma", "left_semi")


def first_of(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def merged_lists(*lists: DataFrame) -> DataFrame:
    """All rows of tables with the same columns, repeats kept."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out


def added_counts(a, b):
    """The sum of two maps of counts; a key that one of them lacks counts 0 there."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def largest_counts(a, b):
    """For each key the larger of two maps' counts."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))
