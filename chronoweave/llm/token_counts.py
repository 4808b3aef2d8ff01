"""Exact token counts from a length histogram and its suffix sums."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import tokens

#: Lengths that one window task adds up; the sums of whole blocks are added up apart.
BLOCK = 4096


def histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """n_tokens (with the end id), n_docs: partial histograms by task, then one sum for each length.

    A null text counts as empty (1 token); repeated rows count each; an empty table gives no rows.
    """
    path = tokenizer or tokens.default_path()

    def run(batches):
        count, seen = tokens.encoder(path).count, Counter()
        for batch in batches:
            seen.update(count(text.as_py()) + 1 for text in batch.column(0))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    parts = docs.select(F.col("text").cast("string").cast("binary")).mapInArrow(run, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length: documents and tokens at least that long, tokens kept if all texts are cut to it, and its quantile.

    The sums run in two levels, blocks of lengths and lengths within a block, so that no task reads
    more than BLOCK lengths or the list of blocks.
    """
    hist = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    size = F.col("n_tokens") * F.col("n_docs")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(size).alias("tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(every).alias("total_docs"),
        F.sum("tokens").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = hist.withColumns({"docs_within": F.sum("n_docs").over(within), "tokens_within": F.sum(size).over(within)}).join(blocks, "block")
    at_least, tokens_at_least = F.col("docs_after") + F.col("docs_within"), F.col("tokens_after") + F.col("tokens_within")
    at_most = F.col("total_docs") - at_least + F.col("n_docs")
    return summed.select(
        "n_tokens", "n_docs", at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"),
        (F.col("total_tokens") - tokens_at_least + F.col("n_tokens") * at_least).alias("truncated_tokens"),
        at_most.alias("docs_at_most"), "total_docs", "total_tokens", (at_most / F.col("total_docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """total, truncated: tokens of all documents, and tokens if each is cut to limit; for any limit, not just lengths that occur."""
    longer = F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)
    kept = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return sums.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("total"), F.coalesce(F.sum(kept), F.lit(0)).alias("truncated"), F.coalesce(F.sum(longer), F.lit(0)).alias("docs_cut"))
