"""Token ids of documents in wavelet-matrix files: one compressed file a shard.

A file holds 16 or more bit-planes. Plane 0 has the top bit of each id in order; each next plane has
the next bit, with the ids whose bit was 0 moved stably before those whose bit was 1. Planes are cut
into blocks that are compressed apart, and the header keeps the ones before each block, so that
access, rank, select and counting read one block a plane and not the whole file.

Layout: MAGIC, header length (8 bytes, little-endian), header (JSON), zstd blocks.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.llm import common, tokens

MAGIC = b"CWWAVE1\n"
BLOCK_BITS = 1 << 19
SHARD_TOKENS = 4 << 20
#: Tasks that read files, at most; beyond so many files a task reads several.
READ_TASKS = 20_000


def to_file(ids: np.ndarray, doc_ids: list[int | None], doc_ends: np.ndarray) -> bytes:
    """The file of a shard: ids of all its documents, and where each document ends."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    levels = max(16, int(ids.max()).bit_length() if len(ids) else 0)
    body, planes, at = [], [], 0

    def put(raw: bytes) -> list[int]:
        nonlocal at
        body.append(squeeze(raw))
        at += len(body[-1])
        return [at - len(body[-1]), len(body[-1]), len(raw)]

    seq = ids.astype(np.uint16 if levels == 16 else np.uint32)
    for level in range(levels):
        bit = (seq >> (levels - 1 - level)) & 1 == 1
        packed = np.packbits(bit, bitorder="little")
        step = BLOCK_BITS // 8
        ones = np.add.reduceat(bit, np.arange(0, len(bit), BLOCK_BITS), dtype=np.int64).tolist() if len(bit) else []
        planes.append({"zeros": int(len(seq) - sum(ones)), "ones": ones, "blocks": [put(packed[k : k + step].tobytes()) for k in range(0, len(packed), step)]})
        seq = np.concatenate([seq[~bit], seq[bit]])
    known = np.array([d if d is not None else 0 for d in doc_ids], dtype="<i8")
    nulls = np.packbits(np.array([d is None for d in doc_ids], dtype=bool), bitorder="little")
    header = {
        "n_tokens": len(ids), "n_docs": len(doc_ids), "levels": levels, "planes": planes,
        "doc_ids": put(known.tobytes()), "nulls": put(nulls.tobytes()), "doc_ends": put(np.asarray(doc_ends, dtype="<i8").tobytes()),
    }
    head = json.dumps(header, separators=(",", ":")).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(body)


class WaveletFile:
    """Reads a shard's file. source: bytes, or an object with seek and read."""

    def __init__(self, source):
        import zstandard

        self._unsqueeze = zstandard.ZstdDecompressor().decompress
        self._source, self._cache = source, {}
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a wavelet file")
        n = int.from_bytes(self._read(len(MAGIC), 8), "little")
        head = json.loads(self._read(len(MAGIC) + 8, n))
        self._body = len(MAGIC) + 8 + n
        self.n_tokens, self.n_docs, self.levels, self._planes = head["n_tokens"], head["n_docs"], head["levels"], head["planes"]
        self._before = [np.concatenate([[0], np.cumsum(p["ones"])]).astype(np.int64) for p in self._planes]
        known = np.frombuffer(self._part(head["doc_ids"]), dtype="<i8").tolist()
        nulls = np.unpackbits(np.frombuffer(self._part(head["nulls"]), dtype=np.uint8), bitorder="little")
        self.doc_ids = [None if nulls[k] else d for k, d in enumerate(known)]
        self.doc_ends = np.frombuffer(self._part(head["doc_ends"]), dtype="<i8")

    def _read(self, at: int, n: int) -> bytes:
        if isinstance(self._source, bytes | memoryview):
            return bytes(self._source[at : at + n])
        self._source.seek(at)
        return self._source.read(n)

    def _part(self, where: list[int]) -> bytes:
        at, n, raw = where
        return self._unsqueeze(self._read(self._body + at, n), max_output_size=max(1, raw)) if raw else b""

    def _block(self, level: int, k: int) -> np.ndarray:
        """Block k of a plane as 64-bit words; a few blocks stay in memory."""
        if (level, k) not in self._cache:
            if len(self._cache) >= 4 * self.levels:
                self._cache.clear()
            raw = self._part(self._planes[level]["blocks"][k])
            self._cache[level, k] = np.frombuffer(raw + b"\0" * (-len(raw) % 8), dtype="<u8")
        return self._cache[level, k]

    def _bit(self, level: int, i: int) -> int:
        words, j = self._block(level, i // BLOCK_BITS), i % BLOCK_BITS
        return int(words[j >> 6]) >> (j & 63) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i."""
        k, j = divmod(i, BLOCK_BITS)
        if not j:
            return int(self._before[level][k])
        words = self._block(level, k)
        part = int(words[j >> 6]) & ((1 << (j & 63)) - 1) if j & 63 else 0
        return int(self._before[level][k]) + int(np.bitwise_count(words[: j >> 6]).sum()) + part.bit_count()

    def _select(self, level: int, bit: int, nth: int) -> int:
        """Position of the nth (from 0) one or zero."""
        before = self._before[level] if bit else np.minimum(np.arange(len(self._before[level])) * BLOCK_BITS, self.n_tokens) - self._before[level]
        k = bisect_right(before, nth) - 1
        words = self._block(level, k)
        counts = np.cumsum(np.bitwise_count(words if bit else ~words), dtype=np.int64)
        w = int(np.searchsorted(counts, nth - int(before[k]), side="right"))
        nth -= int(before[k]) + (int(counts[w - 1]) if w else 0)
        word = int(words[w]) if bit else ~int(words[w])
        for _ in range(nth):
            word &= word - 1
        return k * BLOCK_BITS + w * 64 + (word & -word).bit_length() - 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self._planes):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = plane["zeros"] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences before position i end up below the last plane."""
        a, b = 0, i
        for level, plane in enumerate(self._planes):
            x, y = self._rank1(level, a), self._rank1(level, b)
            a, b = (plane["zeros"] + x, plane["zeros"] + y) if token >> (self.levels - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before position i."""
        if token >> self.levels:
            return 0
        a, b = self._range(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n_tokens)

    def select(self, token: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of token."""
        a, b = (0, 0) if token >> self.levels else self._range(token, self.n_tokens)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        i = a + nth
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self._planes[level]["zeros"] if bit else i)
        return i

    def occurrences(self, token: int):
        return (self.select(token, k) for k in range(self.count(token)))

    def ids(self) -> np.ndarray:
        """All ids in order, from the last plane upwards."""
        value = np.zeros(self.n_tokens, dtype=np.uint32)
        for level in range(self.levels - 1, -1, -1):
            plane = self._planes[level]
            raw = b"".join(map(self._part, plane["blocks"]))
            bit = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=self.n_tokens, bitorder="little").view(bool)
            above = np.empty_like(value)
            above[~bit], above[bit] = value[: plane["zeros"]], value[plane["zeros"] :] | np.uint32(1 << (self.levels - 1 - level))
            value = above
        return value

    def document(self, k: int) -> list[int]:
        start = int(self.doc_ends[k - 1]) if k else 0
        return [self.access(i) for i in range(start, int(self.doc_ends[k]))]


def _filesystem(uri: str):
    """A file system that both workers and driver reach, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _writer(folder: str, path: str, shard_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        encode, end = tokens.encoder(path).encode, tokens.END_ID.to_bytes(4, "little")
        part, shard = TaskContext.get().partitionId(), 0
        store, root = _filesystem(folder)
        doc_ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def flush():
            nonlocal shard, held
            ids = np.frombuffer(b"".join(texts), dtype="<u4")
            ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) // 4)
            name = f"part-{part:06d}-{shard:06d}-{uuid.uuid4().hex}.wave"
            # A task that runs again writes under another name; only names in the manifest count.
            with store.open_output_stream(f"{root}/_{name}") as out:
                out.write(to_file(ids, doc_ids, ends))
            store.move(f"{root}/_{name}", f"{root}/{name}")
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "name": name, "n_tokens": len(ids), "n_docs": len(texts)}])
            shard, held = shard + 1, 0
            doc_ids.clear()
            texts.clear()
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = encode(text.as_py()) + end
                doc_ids.append(doc_id)
                texts.append(own)
                held += len(own) // 4
                if held >= shard_tokens:
                    yield flush()
        if texts:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes ids of docs (doc_id, text) in ascending doc_id order (null first) and returns the manifest, a row a file.

    A null text is empty, rows with the same doc_id stand in the order of their texts, and each
    document ends with the end id. Other columns are ignored. An empty table writes no file. The
    manifest is a table in the folder; its start is the number of ids in the files before, from one sum for each range of
    documents.
    """
    spark = docs.sparkSession
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part long, shard long, name string, n_tokens long, n_docs long"
    made = ordered.mapInArrow(_writer(folder, tokenizer or tokens.default_path(), shard_tokens), schema)
    made.write.mode("overwrite").parquet(f"{folder}/files")
    made = spark.read.schema(schema).parquet(f"{folder}/files")
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of documents
    starts = made.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(ranges), F.lit(0)).alias("first"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("first") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))
    made.join(starts, "part").withColumn("start", start).drop("first").write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """part, shard, name, n_tokens, n_docs, start of the files in a folder."""
    return spark.read.schema("part long, shard long, name string, n_tokens long, n_docs long, start long").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files of a folder."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, at = _filesystem(folder)
                with own.open_input_file(f"{at}/{row['name']}") as f:
                    file = WaveletFile(f)
                    raw = file.ids().astype("<u4").tobytes()
                starts = np.concatenate([[0], file.doc_ends[:-1]])
                parts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), file.doc_ends.tolist(), strict=True)]
                columns = [pa.array(file.doc_ids, pa.int64()), pa.array(starts + row["start"]), pa.array(file.doc_ends - starts), pa.array(list(map(zlib.crc32, parts)), pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(parts, pa.binary())] * with_ids], [*names, *["ids"] * with_ids])

    files = manifest(spark, folder).select("name", "start")
    dealt = files.repartition(max(1, min(READ_TASKS, files.count())))  # a file is a large piece of work
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs to a new folder in the shared one and reads the files back."""
    folder = common.new_path(docs.sparkSession, "token-files")
    write(docs, folder, tokenizer)
    return read(docs.sparkSession, folder)
