"""Line deduplication over content-defined chunks of lines, in DataFrame operations only.

Each line has a hash below PRIME; a rolling polynomial hash covers a line and the ROLL - 1 before it.
A chunk ends after a line whose rolling hash is less than those of both its neighbours: that depends
on a few lines around it alone, so that text put in or taken out elsewhere shifts no boundary, and
chunks have two lines at least (but for a text's last). Chunks of several lines that stand somewhere
before, in the order of doc_id and place, and equal byte for byte, are removed.

Chunks at both edges of a repeated passage differ from those of its first place. without_repeats(), the
pipeline's stage, also removes passages to their very edges; deduplicated() keeps to chunks, as its SQL has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import common

PRIME = (1 << 31) - 1
FACTOR = 1_000_003
ROLL = 2
#: Words of a passage that goes wherever its chunks' boundaries lie.
PASSAGE_WORDS = 50


def line_hash(line: Column) -> Column:
    """The first 31 bits or so of the line's MD5, below PRIME: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long") % PRIME


def _rolled(hashes: Column):
    def at(_, i: Column) -> Column:
        total = F.lit(0).cast("long")
        for back in range(ROLL - 1, -1, -1):
            total = (total * FACTOR + F.when(i >= back, F.get(hashes, i - back)).otherwise(0)) % PRIME
        return total

    return F.transform(hashes, at)


def _ends(rolled: Column) -> Column:
    """Whether a chunk ends after line i."""
    return F.transform(rolled, lambda r, i: (i == F.size(rolled) - 1) | ((i > 0) & (r < F.get(rolled, i - 1)) & (r < F.get(rolled, i + 1))))


def with_chunks(docs: DataFrame, text: str, lines: str, bounds: str) -> DataFrame:
    """Adds lines, the lines of column text, and bounds: the number of lines up to each chunk's end."""
    hashed, rolled, ends = common.fresh(docs, "line_hashes", "rolled", "ends")
    out = docs.withColumn(lines, F.split(F.col(text).cast("string"), "\n", -1))
    out = out.withColumn(hashed, F.transform(lines, line_hash)).withColumn(rolled, _rolled(F.col(hashed))).withColumn(ends, _ends(F.col(rolled)))
    numbers = F.transform(ends, lambda e, i: F.when(e, i + 1))
    return out.withColumn(bounds, F.filter(numbers, lambda n: n.isNotNull())).drop(hashed, rolled, ends)


def _chunk(lines: Column, bounds: Column, k: Column) -> Column:
    """The lines of chunk k."""
    start = F.when(k > 0, F.get(bounds, k - 1)).otherwise(0)
    return F.slice(lines, start + 1, F.get(bounds, k) - start)


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def repeated_chunks(docs: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, text_hash and removed: the numbers of the chunks to remove from each document that has any.

    Chunks' bytes move once, to count them by hash and bytes; equal ones are counted by task before. A
    hash that stands for one run of bytes only is safe to remove by: the rest works on hashes and numbers.
    Chunks whose hash stands for several, if there are any, are told apart by their bytes.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("text_hash"))
    lines, bounds = F.col("lines"), F.col("bounds")

    def described(_: Column, i: Column) -> Column:
        own = _chunk(lines, bounds, i)
        return F.struct(i.alias("n"), F.size(own).alias("size"), F.exists(own, lambda x: F.length(F.trim(x)) > 0).alias("some"), F.array_join(own, "\n").alias("chunk"))

    each = with_chunks(raw, "text", "lines", "bounds").select("doc_id", "text_hash", F.explode(F.transform("bounds", described)).alias("c"))
    each = each.where((F.col("c.size") > 1) & F.col("c.some")).select("doc_id", "text_hash", "c.n", hash_of(F.col("c.chunk")).alias("hash"), "c.chunk")
    places = common.written(each.select("doc_id", "text_hash", "n", "hash"), "line-places")
    same = each.groupBy("hash", "chunk").agg(F.count("*").alias("places"))
    same = same.groupBy("hash").agg(F.count("*").alias("variants"), F.sum("places").alias("places")).where("places > 1")
    same = common.written(same.where("variants > 1 OR places > variants").select("hash", "variants"), "line-hashes")
    again = _again(places.join(same.where("variants = 1"), "hash", "left_semi"), ["hash"])
    clashes = same.where("variants > 1")
    if not clashes.isEmpty():
        again = again.unionByName(_again(each.join(clashes, "hash", "left_semi"), ["hash", "chunk"]))
    return again.groupBy("doc_id", "text_hash").agg(F.collect_set("n").alias("removed"))


def _again(places: DataFrame, key: list[str]) -> DataFrame:
    """doc_id, text_hash, n of the places of a key but its first; null ids come last."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"), F.col("n").alias("n"))
    firsts = places.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1").drop("places")
    firsts = common.written(firsts, "line-firsts")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("n") == F.col("first.n"))
    return places.join(firsts, key).where(~is_first).select("doc_id", "text_hash", "n")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks taken out of text, and the columns chunks, removed_chunks and removed_lines.

    The first place of a chunk, by doc_id (null last), hash of the text and number, stays. Rows with the same
    doc_id and text are one document and treated alike; different texts under one id, or without one, are
    documents of their own. A null text stays null, with no
    chunks; an empty one is a chunk of one line, which is never removed; chunks of blank lines stay.
    Other columns, those named like the added ones too (which are replaced), are kept as they are.
    """
    out = docs.drop("chunks", "removed_chunks", "removed_lines")
    lines, bounds, removed, of, hashed, of_text = common.fresh(out, "lines", "bounds", "removed", "of", "text_hash", "of_text")
    gone = repeated_chunks(docs).select(F.col("doc_id").alias(of), F.col("text_hash").alias(of_text), F.col("removed").alias(removed))
    out = out.withColumn(hashed, _text_hash())
    own = out.join(gone.hint("merge"), out.doc_id.cast("long").eqNullSafe(gone[of]) & (out[hashed] == gone[of_text]), "left").drop(of, of_text, hashed)
    own = with_chunks(own, "text", lines, bounds)
    row, ends = F.col(removed), F.col(bounds)
    kept = F.filter(F.transform(ends, lambda _, i: F.when(~F.array_contains(row, i), F.array_join(_chunk(F.col(lines), ends, i), "\n"))), lambda c: c.isNotNull())
    size = F.aggregate(F.transform(row, lambda k: F.get(ends, k) - F.when(k > 0, F.get(ends, k - 1)).otherwise(0)), F.lit(0), lambda a, b: a + b)
    return own.withColumns({
        "text": F.when(row.isNull(), F.col("text").cast("string")).otherwise(F.array_join(kept, "\n")),
        "chunks": F.coalesce(F.size(ends), F.lit(0)).cast("long"),
        "removed_chunks": F.coalesce(F.size(row), F.lit(0)).cast("long"),
        "removed_lines": F.coalesce(size, F.lit(0)).cast("long"),
    }).drop(lines, bounds, removed)


def _spans(worded: Column) -> Column:
    """First and last line (a, b) of the shortest passages that begin or end with each line; worded: i, w of the lines with words."""

    def shortest(near: Column) -> Column:
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"), F.lit(-1).alias("at"))
        enough = lambda p: (p["words"] >= PASSAGE_WORDS) & (p["lines"] > 1)
        found = F.aggregate(near, start, lambda p, x: F.when(enough(p), p).otherwise(F.struct((p["words"] + x["w"]).alias("words"), (p["lines"] + 1).alias("lines"), x["i"].alias("at"))))
        return F.when(enough(found), found["at"])

    def both(x: Column, u: Column) -> Column:
        low = F.greatest(u - PASSAGE_WORDS, F.lit(0))
        after, before = F.slice(worded, u + 1, F.lit(PASSAGE_WORDS + 1)), F.reverse(F.slice(worded, low + 1, u - low + 1))
        return F.array(F.struct(x["i"].alias("a"), shortest(after).alias("b")), F.struct(shortest(before).alias("a"), x["i"].alias("b")))

    spans = F.filter(F.flatten(F.transform(worded, both)), lambda s: s["a"].isNotNull() & s["b"].isNotNull())
    # As one number each: numbers are told apart by a hash, structs by pairs.
    numbers = F.array_distinct(F.transform(spans, lambda s: F.shiftleft(s["a"].cast("long"), 32).bitwiseOR(s["b"].cast("long"))))
    return F.transform(numbers, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("a"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b")))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and spans (a, b): first and last lines of what repeats an earlier passage.

    A passage has two lines with words and PASSAGE_WORDS words at least. Any repeated one is covered by the
    shortest ones that begin or end with each of its lines, so those alone are looked up, by 128 bits of MD5.
    The first place stays, and so does what overlaps it in its own text.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("text_hash"))
    lines = raw.withColumn("lines", F.split("text", "\n", -1))
    words = lambda x: F.size(F.filter(F.split(x, r"[\x20\t-\r]+", -1), lambda w: w != ""))
    worded = lines.withColumn("worded", F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), words(x).alias("w"))), lambda s: s["w"] > 0))
    spans = worded.withColumn("spans", _spans(F.col("worded")))
    key = lambda s: F.unhex(F.md5(F.array_join(F.slice("lines", s["a"] + 1, s["b"] - s["a"] + 1), "\n")))
    each = spans.select("doc_id", "text_hash", F.explode(F.transform("spans", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), key(s).alias("key")))).alias("s"))
    each = common.written(each.select("doc_id", "text_hash", "s.a", "s.b", "s.key"), "line-passages")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "a")
    firsts = each.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    overlaps = own & (F.col("a") <= F.col("first.a") + F.col("b") - F.col("a"))
    again = each.join(common.written(firsts, "line-passage-firsts"), "key").where(~overlaps)
    return again.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with text freed of repeated chunks, as deduplicated() has them, and of repeated passages to their edges."""
    columns = docs.columns
    lines, bounds, removed, spans, hashed, row = common.fresh(docs, "lines", "bounds", "removed", "spans", "text_hash", "row_id")
    chunks, passages = ("chunk_id", "chunk_hash", removed), ("passage_id", "passage_hash", spans)
    out = docs.withColumns({hashed: _text_hash(), row: F.col("doc_id").cast("long")})
    for (of, of_text, name), found in ((chunks, repeated_chunks(docs)), (passages, repeated_passages(docs))):
        of, of_text = common.fresh(out, of, of_text)
        found = found.toDF(of, of_text, name).hint("merge")
        out = out.join(found, F.col(row).eqNullSafe(F.col(of)) & (F.col(hashed) == F.col(of_text)), "left").drop(of, of_text)
    out = with_chunks(out, "text", lines, bounds)
    ends = F.col(bounds)
    of_chunks = F.transform(removed, lambda k: F.sequence(F.when(k > 0, F.get(ends, k - 1)).otherwise(0), F.get(ends, k) - 1))
    of_passages = F.transform(spans, lambda s: F.sequence(s["a"], s["b"]))
    none = F.array().cast("array<array<int>>")
    gone = F.flatten(F.concat(F.coalesce(of_chunks, none), F.coalesce(of_passages, none)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n")
    changed = F.col(removed).isNotNull() | F.col(spans).isNotNull()
    return out.withColumn("text", F.when(changed, text).otherwise(F.col("text").cast("string"))).select(*columns)


#: deduplicated() on table documents, in DuckDB's SQL.
SQL = f"""
WITH line AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line, len(l) AS total
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) % {PRIME} AS h FROM line),
rolled AS (SELECT *, (coalesce(lag(h) OVER w, 0) % {PRIME} * {FACTOR} + h) % {PRIME} AS r FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ended AS (SELECT *, i = total - 1 OR coalesce(r < lag(r) OVER w AND r < lead(r) OVER w, false) AS ends FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM ended),
chunk AS (SELECT doc_id, n, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS chunk, bool_or(length(trim(line, ' ')) > 0) AS filled FROM numbered GROUP BY doc_id, n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk, size > 1 AND filled ORDER BY doc_id, n) > 1 AND size > 1 AND filled AS gone FROM chunk)
SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS text, count(*) AS chunks,
  count(*) FILTER (WHERE gone) AS removed_chunks, CAST(coalesce(sum(size) FILTER (WHERE gone), 0) AS BIGINT) AS removed_lines
FROM ranked GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0, 0 FROM documents WHERE text IS NULL
"""
