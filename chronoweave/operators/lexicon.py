"""Lemmas of tagged words from a lexicon of lemmas, by endings taken off, and predicates over a word's senses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.graphs import PREDICATES, ancestors

# For each part of speech the endings that a form may have and what stands there in the lemma, in order of trial.
ENDINGS = {
    "v": [("", ""), ("s", ""), ("ies", "y"), ("ied", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "n": [("es", "e"), ("men", "man"), ("", ""), ("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("ies", "y")],
    "a": [("", ""), ("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
}
# Forms that no ending explains, for a lexicon without a table of its own.
IRREGULAR = [("v", "were", "be"), ("v", "was", "be"), ("v", "is", "be"), ("v", "are", "be"), ("v", "been", "be"), ("v", "had", "have"), ("v", "has", "have"), ("v", "said", "say"), ("v", "went", "go"), ("v", "left", "leave"), ("n", "people", "person")]


def lemmatised(words: DataFrame, lexicon: DataFrame, irregular: DataFrame | None = None) -> DataFrame:
    """words (token, pos) with lemma: verbs, nouns and adjectives by the lexicon (part, lemma), all others and unknown words as they are.

    Words with a hyphen or slash have no lemma of their own. irregular: part, form, lemma, tried before endings. All candidates of
    a word meet the lexicon in one equi-join; the first in the order of trial stays.
    """
    spark = words.sparkSession
    irregular = irregular if irregular is not None else spark.createDataFrame(IRREGULAR, "part string, form string, lemma string")
    part = F.when(F.startswith("pos", F.lit("VB")), "v").when(F.startswith("pos", F.lit("N")), "n").when(F.startswith("pos", F.lit("J")), "a")
    forms = words.select(F.lower("token").alias("form"), part.alias("part")).where("part IS NOT NULL").distinct()
    forms = forms.where(~F.col("form").contains("-") & ~F.col("form").contains("/"))
    ways = [
        F.when((F.col("part") == p) & F.endswith("form", F.lit(old)) & (F.length("form") >= max(2, len(old))), F.struct(F.lit(k + 1).alias("turn"), F.concat(F.expr(f"left(form, length(form) - {len(old)})"), F.lit(new)).alias("lemma")))
        for p, pairs in ENDINGS.items() for k, (old, new) in enumerate(pairs)
    ]
    doubled = r"([b-df-hj-np-tv-z])\1(ing|ed)$"  # as in running
    ways.append(F.when((F.col("part") == "v") & F.regexp_like("form", F.lit(doubled)), F.struct(F.lit(99).alias("turn"), F.regexp_replace("form", doubled, "$1").alias("lemma"))))
    tried = forms.select("form", "part", F.explode(F.array_compact(F.array(*ways))).alias("w")).select("form", "part", "w.turn", "w.lemma")
    known = tried.join(lexicon.select("part", "lemma").distinct(), ["part", "lemma"])
    known = known.unionByName(forms.join(irregular, ["part", "form"]).select("form", "part", F.lit(0).alias("turn"), "lemma"))
    best = known.groupBy("form", "part").agg(F.min_by("lemma", F.struct("turn", "lemma")).alias("lemma"))
    own = words.withColumns({"_form": F.lower("token"), "_part": part})
    out = own.join(best.withColumnsRenamed({"form": "_form", "part": "_part", "lemma": "_lemma"}), ["_form", "_part"], "left")
    return out.withColumn("lemma", F.coalesce("_lemma", "token")).drop("_form", "_part", "_lemma")


def with_predicates(words: DataFrame, senses: DataFrame, hypernyms: DataFrame, names: DataFrame) -> DataFrame:
    """words (lemma) with a flag for each lexical predicate: is_person_or_group, is_location, is_physical_object, ..., and is_thing.

    senses: lemma, synset and, if it has it, ordinal, the order of a lemma's senses. All predicates come of one walk up the
    hypernyms. is_thing: of the persons, places and physical objects among the first sense's ancestors and the next ones',
    from below, the first is a physical object.
    """
    lemmas = words.select("lemma").distinct()
    order = F.col("ordinal") if "ordinal" in senses.columns else F.lit(0)
    own = senses.select("lemma", "synset", order.alias("turn")).join(lemmas, "lemma", "left_semi")
    up = ancestors(hypernyms)
    chain = own.join(up.withColumnRenamed("child", "synset"), "synset").select("lemma", "turn", "synset", "ancestor", "distance")
    chain = chain.unionByName(own.select("lemma", "turn", "synset", F.col("synset").alias("ancestor"), F.lit(0).cast("long").alias("distance")))
    wanted = sorted({t for targets in PREDICATES.values() for t in targets} | {"person"})
    met = chain.join(names.where(F.col("name").isin(*wanted)).select(F.col("synset").alias("ancestor"), "name"), "ancestor")
    place = F.struct("turn", "synset", "distance", F.col("name") == "physical_object")
    kind = F.col("name").isin("person", *PREDICATES["location"], "physical_object")
    flags = {f"is_{name}": F.bool_or(F.col("name").isin(*targets)) for name, targets in PREDICATES.items()}
    thing = F.coalesce(F.min_by(F.col("name") == "physical_object", F.when(kind, place)), F.lit(False))
    found = met.groupBy("lemma").agg(*[f.alias(n) for n, f in flags.items()], thing.alias("is_thing"))
    out = words.join(found, "lemma", "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in (*flags, "is_thing")})


def unknown(words: DataFrame, senses: DataFrame) -> DataFrame:
    """Words (lemma) without any sense."""
    return words.join(senses.select("lemma").distinct(), "lemma", "left_anti")


def named_entities(senses: DataFrame, instances: DataFrame) -> DataFrame:
    """lemma of words all of whose senses are instances of something. instances: synset."""
    flagged = senses.join(instances.select("synset", F.lit(True).alias("instance")).distinct(), "synset", "left")
    return flagged.groupBy("lemma").agg(F.bool_and(F.coalesce("instance", F.lit(False))).alias("all")).where("all").select("lemma")


def nominalisations(nouns: DataFrame, derivations: DataFrame) -> DataFrame:
    """lemma, verb: nouns with a verb that they derive from. derivations: lemma, verb."""
    return nouns.select("lemma").distinct().join(derivations.select("lemma", "verb").distinct(), "lemma")
