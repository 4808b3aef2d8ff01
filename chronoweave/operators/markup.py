"""From texts to links in one call, and training of all learned sieves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave import scratch
from chronoweave.functions.relations import inverted
from chronoweave.operators import cascade, extract, timegrammar
from chronoweave.operators.classify import EventModels
from chronoweave.operators.learned import LearnedSieve


def corpus_of(docs: DataFrame, tagged: DataFrame, models: EventModels | None = None, deps: DataFrame | None = None, dcts: DataFrame | None = None, heuristic: str | None = "first") -> cascade.Corpus:
    """The corpus of docs (doc, text): events, then time expressions without those that hold an event, then creation times.

    tagged (doc, sid, idx, token, pos) are the texts' tokens with tags from any tagger. Events come from models, or from the rule for
    verb groups with tense alone. Documents without a creation time in dcts (doc, id, value) get one by heuristic ("first" or
    "common" day named), if one is given.
    """
    if models is not None:
        events = models.extract(tagged, deps)
    else:
        events = extract.rule_events(tagged).join(extract.group_tense(tagged).hint("merge"), ["doc", "sid", "idx"], "left").withColumns({"aspect": F.lit("NONE"), "cls": F.lit("OCCURRENCE")})
    known = dcts if dcts is not None else docs.select("doc", F.lit("t0").alias("id"), F.lit(None).cast("string").alias("value")).limit(0)
    events = scratch.written(events, "events")
    times = scratch.written(extract.outside(times_of(docs, tagged, known.select("doc", "value")), events), "times")
    if heuristic is not None:
        guessed = extract.creation_day(times, heuristic).join(known.select("doc"), "doc", "left_anti")
        known = known.select("doc", "id", "value").unionByName(guessed.select("doc", F.lit("t0").alias("id"), "value"))
    none = tagged.select("doc", "sid").limit(0).withColumns({"reln": F.lit(""), "gov_idx": F.lit(0), "dep_idx": F.lit(0), "dep": F.lit("")})
    return cascade.Corpus(events=events, timexes=times, dcts=known, deps=deps if deps is not None else none, tokens=tagged)


def times_of(docs: DataFrame, tagged: DataFrame, dcts: DataFrame) -> DataFrame:
    """doc, sid, idx, len, id, text, type, value, mod of the time expressions of docs, in the numbers of tagged tokens.

    They are found in the texts and brought to the tagger's tokens by characters; in documents whose tagged tokens lack or add
    characters, they are found in these tokens themselves.
    """
    # Each step is a table: what a grammar's expressions make is planned once, not again for each of its readers.
    sents = extract.sentences(docs)
    own = scratch.written(extract.tokens(sents), "tokens")
    bad = scratch.written(extract.misaligned(own, tagged).select("doc"), "misaligned")
    none = bad.isEmpty()
    good = sents if none else sents.join(bad.hint("merge"), "doc", "left_anti")
    there = extract.aligned(scratch.written(extract.tagged_timexes(good, dcts), "times"), own, tagged, sound=True)
    if none:
        return there
    return there.unionByName(scratch.written(timegrammar.of_tokens(tagged.join(bad.hint("merge"), "doc", "left_semi"), dcts), "times"))


def links_of(docs: DataFrame, tagged: DataFrame, sieves: list, **options) -> DataFrame:
    """doc, id1, id2, relation, closed, origin: texts to links."""
    return cascade.run(corpus_of(docs, tagged, **options), sieves)


def train_all(sieves: list, corpus: cascade.Corpus, gold: DataFrame) -> list:
    """The same sieves, those that learn trained on gold."""
    return [(name, s.train(corpus, gold) if isinstance(s, LearnedSieve) else s) for name, s in sieves]


def relabelled(links: DataFrame, corpus: cascade.Corpus, sieves: list) -> DataFrame:
    """Known pairs (doc, id1, id2) with the relations that sieves, first to last, give them; pairs that none labels keep theirs."""
    made = cascade.proposals(corpus, sieves)
    if made is None:
        return links
    best = cascade.first_wins(made).select("doc", "id1", "id2", F.col("relation").alias("new"))
    both = best.unionByName(best.select("doc", F.col("id2").alias("id1"), F.col("id1").alias("id2"), inverted(F.col("new")).alias("new")))
    own = links.join(both, ["doc", "id1", "id2"], "left").withColumn("relation", F.coalesce("new", "relation"))
    return own.select(*links.columns)
