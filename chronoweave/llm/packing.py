"""Best-fit-decreasing packing of token sequences into windows of a fixed size.

A buffer of encoded documents is packed at a time, so that memory is bounded whatever a partition
holds. Full windows are cut off first. The rests are placed in decreasing length, each into the open
window with the tightest room, found in a segment tree over remaining capacity. Where all that is
left to place fits into the room of windows already open, pieces are cut to fill it, so that a buffer
pads fewer tokens than LEAST, the smallest power of two used as a window of its own.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import tokens

WINDOW = 2048
BUFFER_TOKENS = 8 << 20
LEAST = 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """A segment tree over remaining capacity 1..window; each node counts the open windows below it."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.n = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        k = capacity + self.size
        while k:
            self.n[k] += by
            k >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.open[capacity].append(window)
            self._add(capacity, 1)

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.open[capacity].pop()

    def tightest(self, need: int) -> int:
        """The least capacity of at least need that an open window has, or 0."""
        n, k = self.n, need + self.size
        if n[k]:
            return need
        while k > 1:
            if not k & 1 and n[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if n[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return 0

    def loosest(self) -> int:
        k = 1
        if not self.n[1]:
            return 0
        while k < self.size:
            k = 2 * k + 1 if self.n[2 * k + 1] else 2 * k
        return k - self.size


def pack_lengths(lengths: np.ndarray, window: int = WINDOW, least: int = LEAST) -> tuple[np.ndarray, int]:
    """Rows (item, start, length, sequence, offset) that place every token once, and the number of sequences."""
    lengths = np.asarray(lengths, dtype=np.int64)
    full, rest = lengths // window, lengths % window
    items = np.repeat(np.arange(len(lengths)), full)
    first = np.cumsum(full) - full
    start = (np.arange(len(items)) - np.repeat(first, full)) * window
    made = len(items)
    whole = np.column_stack([items, start, np.full(made, window), np.arange(made), np.zeros(made, dtype=np.int64)])
    heap = [(-int(rest[i]), int(i), int(full[i]) * window) for i in np.flatnonzero(rest)]
    heapq.heapify(heap)
    left = int(rest.sum())
    tree, size, rows = CapacityTree(window), {}, []
    tail = -(-(left % window) // least) * least
    room = 0
    while tail:  # what doesn't fill a window goes to windows of a power of two
        part = min(window, 1 << (tail.bit_length() - 1))
        size[made] = part
        tree.put(part, made)
        made, tail, room = made + 1, tail - part, room + part
    while heap:
        short, item, at = heapq.heappop(heap)
        n = -short
        capacity = tree.tightest(n)
        if capacity:
            sequence, used = tree.take(capacity), n
        elif left <= room:  # no window needs to be opened any more: fill the loosest one
            capacity = used = tree.loosest()
            sequence = tree.take(capacity)
            heapq.heappush(heap, (used - n, item, at + used))
        else:
            sequence, capacity, used = made, window, n
            size[made] = window
            made, room = made + 1, room + window
        rows.append((item, at, used, sequence, size[sequence] - capacity))
        tree.put(capacity - used, sequence)
        left, room = left - used, room - used
    return np.concatenate([whole, np.array(rows, dtype=np.int64).reshape(-1, 5)]), made


def _packed(path: str, window: int, buffer_tokens: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        encode, end = tokens.encoder(path).encode, tokens.END_ID.to_bytes(4, "little")
        base, done = TaskContext.get().partitionId() << 40, 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def flush():
            nonlocal done, held
            lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) // 4
            rows, made = pack_lengths(lengths, window)
            parts = [texts[i][4 * a : 4 * (a + n)] for i, a, n in rows[:, :3].tolist()]
            columns = [
                pa.array([ids[i] for i in rows[:, 0].tolist()], pa.int64()), pa.array(rows[:, 1]), pa.array(rows[:, 2]),
                pa.array(list(map(zlib.crc32, parts)), pa.int64()), pa.array(lengths[rows[:, 0]]), pa.array(rows[:, 3] + (base + done)), pa.array(rows[:, 4]),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
            done += made
            ids.clear()
            texts.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = encode(text.as_py()) + end
                ids.append(doc_id)
                texts.append(own)
                held += len(own) // 4
                if held >= buffer_tokens:
                    yield flush()
        if ids:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, buffer_tokens: int = BUFFER_TOKENS, with_ids: bool = False) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most window tokens; a row for each piece.

    A null text is empty: the document is its end id alone. A null doc_id stays null. Repeated rows
    are packed as often as they stand there. Other columns of docs are ignored, whatever their names.
    An empty table gives no rows. sequence_id is unique over all partitions, and a task that runs
    again makes the same rows. ids (with_ids) holds the piece as little-endian unsigned 32-bit integers.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return source.mapInArrow(_packed(tokenizer or tokens.default_path(), window, buffer_tokens, with_ids), SCHEMA + (", ids binary" if with_ids else ""))
