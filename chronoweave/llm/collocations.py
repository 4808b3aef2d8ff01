"""Collocations by Suffix-sigma: phrases are counted as prefixes of sorted suffixes of at most MAX_N words.

Each word starts a suffix that ends with its piece of text or after MAX_N words. Tasks count equal suffixes of a block of texts,
and send them on by language and first word; ranges, not hashes, of (language, first word, later words) are dealt out, so that a
frequent first word or pair of words takes several tasks. A task sorts what it gets and counts all prefixes with one stack: a
suffix opens its words, and those that it doesn't share with the next one are popped, their counts added to the word below.
Prefixes of a task's first and last suffix may go on in its neighbours: those are sent out whatever their count and added up.

Where the ranges lie follows from a bounded sample of texts; that moves work, not results.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import common

MAX_N = 4
#: Occurrences of a candidate, its share (in 100) that a longer one must have to cover it, and rows of each language.
LEAST, COVER, TOP = 30, 80, 2000
#: What a score of 1 is multiplied by.
UNIT = 2_000_000
#: Bytes of text whose suffixes a task counts at once, and bytes of text by range.
BLOCK_BYTES, RANGE_BYTES = 10 << 20, 12 << 20
#: Ranges at most, documents whose suffixes are sampled, suffixes by range kept of those, and bytes kept of their words.
RANGES, SAMPLE_DOCS, SAMPLES, SAMPLE_WORD = 20_000, 4000, 40, 64

_BLANK, _END = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _END
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PACK = "part int, lang string, n_words int, n_suffixes int, n_bytes long, body binary"
_PHRASE = "lang string, phrase binary, size int, n long"

Suffix = tuple[bytes, ...]


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a text, A-Z lower, and the number of the piece that each is in."""
    raw = np.frombuffer(text, dtype=np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])])
    return words, np.searchsorted(np.flatnonzero(kind == _END), starts)


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in order of bytes, and each word's place among them, from 1."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1, dtype=np.int32)
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _sorted_places(columns: list[np.ndarray], n_words: int) -> np.ndarray:
    """Places of suffixes (a column of ranks for each word, 0 after the last one) in their order."""
    bits = int(n_words).bit_length()
    pairs = [(columns[k].astype(np.int64) << bits) | columns[k + 1] for k in range(0, MAX_N, 2)]
    return np.lexsort(pairs[::-1])


def suffixes_of(texts: list[bytes]) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """The distinct suffixes of texts, sorted, as ranks among the sorted words, and their counts."""
    words, piece = words_of(b"\n".join(texts))
    vocabulary, first = _ranked(words)
    columns = [first]
    for k in range(1, MAX_N):
        later = np.zeros_like(first)
        later[: max(len(first) - k, 0)] = np.where(piece[:-k] == piece[k:], first[k:], 0)
        columns.append(later)
    order = _sorted_places(columns, len(vocabulary))
    columns = [c[order] for c in columns]
    starts = np.flatnonzero(_shared(columns) < MAX_N) if len(first) else np.zeros(0, dtype=np.int64)
    return vocabulary, [c[starts] for c in columns], np.diff(np.append(starts, len(first)))


def _shared(columns: list[np.ndarray]) -> np.ndarray:
    """How many columns, from the first, each row shares with the one before (MAX_N: all); 0 for the first row."""
    out, same = np.zeros(len(columns[0]), dtype=np.int8), np.ones(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        same &= c[1:] == c[:-1]
        out[1:] += same
    return out


def place_of(cut: Suffix, vocabulary: list[bytes], columns: list[np.ndarray]) -> int:
    """The number of sorted suffixes before cut."""
    low, high = 0, len(columns[0])
    for word, column in zip(cut, columns, strict=False):
        rank = bisect_left(vocabulary, word) + 1
        known = rank <= len(vocabulary) and vocabulary[rank - 1] == word
        own = column[low:high]
        low, high = low + int(np.searchsorted(own, rank, "left")), low + int(np.searchsorted(own, rank + known, "left"))
        if not known:
            break
    return low


def _pack(vocabulary: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> tuple[int, int, int, bytes]:
    """Suffixes with their own words, compressed: the words' lengths and bytes, the columns of places in these and the counts."""
    own = np.unique(np.concatenate(columns))
    own = own[own > 0]
    words = vocabulary.take(pa.array(own - 1))
    places = np.zeros(int(own[-1]) + 1, dtype=np.int32)
    places[own] = np.arange(1, len(own) + 1, dtype=np.int32)
    lengths = pc.binary_length(words).to_numpy().astype("<i4").tobytes()
    raw = lengths + b"".join(places[c].astype("<i4").tobytes() for c in columns) + counts.astype("<i8").tobytes() + b"".join(words.to_pylist())
    return len(own), len(counts), len(raw), pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(n_words: int, n_suffixes: int, n_bytes: int, body: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(body, n_bytes, asbytes=True)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i4", n_words))]).astype(np.int64)
    columns = np.frombuffer(raw, "<i4", MAX_N * n_suffixes, 4 * n_words).reshape(MAX_N, n_suffixes)
    at = 4 * (n_words + MAX_N * n_suffixes)
    counts = np.frombuffer(raw, "<i8", n_suffixes, at)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_words, [None, pa.py_buffer(offsets), pa.py_buffer(raw[at + 8 * n_suffixes :])]), columns, counts


def prefixes(shared: list[int], sizes: list[int], counts: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place, size, count) of the prefixes of sorted suffixes that occur least times, and of all prefixes of the first and last suffix.

    place: any suffix with that prefix. shared: words that each suffix shares with the one before.
    """
    out, stack, first = [], [], sizes[0] if sizes else 0
    for i, (keep, size, n) in enumerate(zip(shared, sizes, counts, strict=True)):
        while len(stack) > keep:
            own, count = len(stack), stack.pop()
            if count >= least or own <= first:
                out.append((i - 1, own, count))
            if stack:
                stack[-1] += count
        if keep < first and i:
            first = keep  # no longer open: a prefix of this size that comes later is another one
        stack.extend([0] * (size - len(stack)))
        stack[-1] += n
    while stack:
        own, count = len(stack), stack.pop()
        out.append((len(shared) - 1, own, count))
        if stack:
            stack[-1] += count
    return out


def _pack_rows(lang: str, texts: list[bytes], cuts: list[tuple[str, Suffix]]):
    """A row for each range that suffixes of texts lie in."""
    vocabulary, columns, counts = suffixes_of(texts)
    if not len(counts):
        return
    key = lang.encode()
    base = sum(of.encode() < key for of, _ in cuts)
    words = vocabulary.to_pylist()
    edges = [0, *(place_of(cut, words, columns) for of, cut in cuts if of == lang), len(counts)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            yield (base + k, lang, *_pack(vocabulary, [c[a:b] for c in columns], counts[a:b]))


def _packs(texts: DataFrame, cuts: list[tuple[str, Suffix]]) -> DataFrame:
    """Suffix counts of texts (lang, text) by range, a block of texts at a time."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("n_words", pa.int32()), ("n_suffixes", pa.int32()), ("n_bytes", pa.int64()), ("body", pa.binary())])

    def rows(pending: dict[str, list[bytes]]):
        for lang in sorted(pending):
            for row in _pack_rows(lang, pending[lang], cuts):
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    def run(batches):
        pending, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pending.setdefault(lang, []).append(text.as_py())
                size += len(pending[lang][-1]) + 1
                if size >= BLOCK_BYTES:
                    yield from rows(pending)
                    pending, size = {}, 0
        yield from rows(pending)
        common.tidy()

    return texts.mapInArrow(run, _PACK)


def _merged(lang: str, packs: list[tuple]) -> pa.RecordBatch:
    """The phrases that a range's packs of one language hold, and the number of its words as a phrase of size 0."""
    found = [_unpack(*p) for p in packs]
    vocabulary, rank = _ranked(pa.concat_arrays([words for words, _, _ in found]))
    columns, start = [], 0
    for words, own, _ in found:
        columns.append(np.concatenate([[0], rank[start : start + len(words)]]).astype(np.int32)[own])
        start += len(words)
    columns = list(np.concatenate(columns, axis=1))
    counts = np.concatenate([c for _, _, c in found])
    order = _sorted_places(columns, len(vocabulary))[::-1]  # longer suffixes before their prefixes
    columns, counts = [c[order] for c in columns], counts[order]
    sizes = sum((c > 0).astype(np.int8) for c in columns)
    shared = np.minimum(_shared(columns), sizes)
    out = [(0, 0, int(counts.sum())), *prefixes(shared.tolist(), sizes.tolist(), counts.tolist(), LEAST)]
    phrases = [b" ".join(vocabulary[int(c[i]) - 1].as_py() for c in columns[:size]) for i, size, _ in out]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(out)), pa.array(phrases, pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64())], ["lang", "phrase", "size", "n"])


def _count(batches):
    """Rows of one range, language by language, to phrases."""
    lang, packs = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
            if packs and row[0] != lang:
                yield _merged(lang, packs)
                packs = []
            lang = row[0]
            packs.append(row[1:])
    if packs:
        yield _merged(lang, packs)
    common.tidy()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _cuts(texts: DataFrame) -> tuple[int, list[tuple[str, Suffix]]]:
    """A number of ranges that follows the bytes of text, and where all but the first begin, from a sample of suffixes."""
    spark = texts.sparkSession
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).head()
    parts = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))

    def run(batches):
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, piece = words_of(text.as_py())
                first = range(0, len(words), 8)
                own = [[words[j].as_py()[:SAMPLE_WORD] for j in range(i, min(i + MAX_N, len(words))) if piece[j] == piece[i]] for i in first]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.list_(pa.binary()))], ["lang", "suffix"])

    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    sampled = texts.sample(fraction=share, seed=1).mapInArrow(run, "lang string, suffix array<binary>")
    expected = size * share / (6 * 8)  # a word has some six bytes, and one in eight begins a suffix here
    kept = sampled.sample(fraction=min(1.0, SAMPLES * parts / max(expected, 1)), seed=2).limit(4 * SAMPLES * parts).collect()
    keys = sorted((r.lang.encode(), tuple(bytes(w) for w in r.suffix)) for r in kept)
    found = sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []
    return parts, [(lang.decode(), cut) for lang, cut in found]


def phrases(docs: DataFrame) -> DataFrame:
    """lang, phrase, size, n: phrases of 1 to MAX_N words that occur LEAST times, and as size 0 the number of words, as a table.

    A null text is an empty one, a null language is "und"; ids don't matter, and repeated rows count as often as they are there.
    """
    texts = _texts(docs)
    parts, cuts = _cuts(texts)
    dealt = _packs(texts, cuts).repartitionById(parts, F.col("part")).sortWithinPartitions("lang")
    each = dealt.mapInArrow(_count, _PHRASE).groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "size").agg(F.sum("n").alias("n"))
    return common.written(each.where(f"size = 0 OR n >= {LEAST}"), "phrases")


def scored(counted: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words or more in phrases(), with the counts of their weakest cut's parts."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    one = counted.where("size > 0").select("lang", "phrase", "n")
    words, size = F.split("phrase", " ", -1), F.col("size")
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(words, k + 1, size - k), " ").alias("rest"))
    cuts = counted.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), size - 1), cut)).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(one.toDF("lang", "first", "l"), ["lang", "first"]).join(one.toDF("lang", "rest", "r"), ["lang", "rest"])
    score = F.call_function("div", F.lit(UNIT).cast("decimal(38,0)") * wide("a"), wide("l") + wide("r")).cast("long")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def uncovered(candidates: DataFrame, counted: DataFrame) -> DataFrame:
    """candidates without those that a longer phrase with COVER in 100 of their count holds."""
    words, size = F.split("phrase", " ", -1), F.col("size")
    part = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), part))
    longer = counted.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("n").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    both = candidates.join(longer, ["lang", "phrase"], "left")
    return both.where(F.col("longer").isNull() | (100 * wide("longer") < COVER * wide("a"))).drop("longer")


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's TOP phrases. docs: lang, text; other columns don't matter.

    An empty table, or one without a phrase that occurs LEAST times, gives no rows.
    """
    counted = phrases(docs)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    found = common.written(uncovered(scored(counted), counted), "collocations")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= TOP)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= TOP)  # of 64 * TOP rows at most
    totals = counted.where("size = 0").select("lang", "n")
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = " UNION ALL ".join(f"SELECT lang, {n} AS size, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS phrase FROM pieces" for n in range(1, MAX_N + 1))
#: collocations() of table documents, in DuckDB's SQL.
SQL = rf"""
WITH own AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM own)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM ({_PARTS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
cut AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:size], ' ') AS p2 FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
cuts AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, ({UNIT}::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.p1 JOIN f y ON y.lang = c.lang AND y.phrase = c.p2),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, f, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM f WHERE size > 2))),
longer AS (SELECT lang, phrase, max(f) AS f FROM sub GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.f IS NULL OR 100 * x.f::HUGEINT < {COVER} * b.a::HUGEINT)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept k JOIN total t ON t.lang = k.lang
QUALIFY rank <= {TOP}
"""
