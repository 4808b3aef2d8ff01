"""Command line: python -m chronoweave COMMAND INPUT OUTPUT [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import cascade, evaluate, extract, learned, markup, sieves
from chronoweave.sources import annotations, infofile, timeml

COMMANDS = {
    "links": "label a corpus file by the sieves", "gauntlet": "score each sieve alone against a corpus file's links", "evaluate": "label a corpus file and score that against its links, by kind of link",
    "train": "train a learned sieve (--kind) on a corpus file and save its model", "count": "numbers of documents, sentences, entities and links of a corpus file", "pairs": "numbers of candidate pairs of a corpus file (--window sentences)",
    "timeml": "the links of a folder of TimeML documents", "problems": "what is wrong in a folder of TimeML documents", "tokens": "tokens of a folder of plain texts, one a line for outside taggers",
    "markup": "plain texts, with tagged tokens (--tagged, a table of doc, sid, idx, token, pos), to texts with events and times marked", "raw": "plain texts, with tagged tokens, to links",
}


def corpus_of(spark: SparkSession, path: str) -> cascade.Corpus:
    docs = infofile.files(spark, path)
    tagged = infofile.tagged(docs)
    events = infofile.events(docs)
    events = events.join(tagged.select("doc", "sid", "idx", "pos"), ["doc", "sid", "idx"], "left") if "pos" not in events.columns else events
    return cascade.Corpus(events=events, timexes=infofile.timexes(docs), dcts=infofile.creation_times(docs), deps=infofile.deps(docs), tokens=tagged)


def _gold(spark: SparkSession, path: str) -> DataFrame:
    return infofile.links(infofile.files(spark, path)).select("doc", "id1", "id2", "relation")


def _texts(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, cascade.Corpus]:
    docs, tagged = timeml.raw_text(spark, a.input), spark.read.parquet(a.tagged)
    return docs, markup.corpus_of(docs, tagged, heuristic=a.heuristic)


def made(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """What a command's output is; None where it writes by itself."""
    named = sieves.load(a.sieves)
    if a.command == "timeml":
        return timeml.links(timeml.directory(spark, a.input))
    if a.command == "problems":
        return timeml.errors(timeml.directory(spark, a.input))
    if a.command == "tokens":
        annotations.write_sentences(extract.tokens(extract.sentences(timeml.raw_text(spark, a.input))), a.output)
        return None
    if a.command == "markup":
        docs, corpus = _texts(spark, a)
        toks = extract.token_table(docs)
        events = extract.aligned(corpus.events.withColumn("len", F.lit(1)), corpus.tokens, toks)
        return extract.marked_texts(toks, events, extract.aligned(corpus.timexes, corpus.tokens, toks))
    if a.command == "raw":
        return cascade.run(_texts(spark, a)[1], named)
    corpus = corpus_of(spark, a.input)
    if a.command == "gauntlet":
        return cascade.gauntlet(corpus, named, _gold(spark, a.input))
    if a.command == "evaluate":
        return evaluate.report(cascade.run(corpus, named), _gold(spark, a.input), corpus.dcts)
    if a.command == "count":
        return evaluate.dataset_statistics(corpus.events, corpus.timexes, corpus.dcts, _gold(spark, a.input))
    if a.command == "pairs":
        return evaluate.window_pair_counts(corpus.events, a.window)
    if a.command == "train":
        learned.LearnedSieve(a.kind).train(corpus, _gold(spark, a.input)).save(a.output)
        return None
    return cascade.run(corpus, named)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="chronoweave", epilog="; ".join(f"{k}: {v}" for k, v in COMMANDS.items()))
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--sieves", nargs="*", default=sieves.DEFAULT)
    parser.add_argument("--tagged", help="table of tagged tokens")
    parser.add_argument("--heuristic", default="first", choices=["first", "common", "date", "today"], help="what stands for a text's creation time")
    parser.add_argument("--kind", default="event_event_same_sentence", choices=sorted(learned.PAIRS))
    parser.add_argument("--window", type=int, default=1)
    a = parser.parse_args(arguments)
    out = made(SparkSession.builder.getOrCreate(), a)
    if out is not None:
        out.write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
