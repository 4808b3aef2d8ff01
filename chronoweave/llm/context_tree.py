"""Scoring texts by context-tree weighting over bytes, with a word-unigram base beside it.

A byte is eight binary decisions. Each decision has a node for every context of the 0 to DEPTH bytes
before it; a node's Krichevsky-Trofimov estimate depends on its counts of zeros and ones alone. The
weight of a node against its children is that of context-tree weighting, from the counts of the whole
training corpus: half its own estimate, half the product of what its children weigh. Texts begin after
DEPTH zero bytes. A context not seen in training passes a decision on to the longest one seen.

Texts are packed into shards. A shard hands its different (DEPTH + 1)-grams, with their counts in training
texts, to the leaves of a trie of contexts, two bytes at first and longer where more than LEAF_BYTES
of text follow one. All longer contexts of a leaf's grams are inside the leaf, so a task weighs that part of the tree
by itself; the few shorter ones are weighed and mixed by sums over (context, node). Each leaf then answers
every shard with the logarithms of its grams, and the shard adds them up by text. The model never passes
through the driver, and each text is read twice whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import common

DEPTH = 7
#: Bytes that stand before each piece of a text in its shard.
BEFORE = 8
#: Bytes of context that a leaf has at least, and at most.
SHORTEST, LONGEST = 2, 6
#: Bytes of text after a leaf's context beyond which it is split by one more byte, and contexts of a length that are split at most: of
#: more bytes than both together, leaves get larger, as the driver and tasks know all contexts that are split.
LEAF_BYTES, MOST_SPLIT = 1 << 23, 1 << 16
#: Shards whose grams of a leaf meet in a task; those of more shards are bundled before, and answers are given to bundles.
MOST_SHARDS = 1 << 12
#: Bytes of text in a shard, and grams that are weighed at a time.
SHARD_BYTES, BATCH_GRAMS = 10 << 20, 1 << 19
#: Rows of an Arrow batch: shards, leaves and what they tell each other are large.
BATCH_ROWS = 256
#: Words whose counts are broadcast, and the length of the longest of them: a bound of 12 MB.
FREQUENT, FREQUENT_BYTES = 1 << 17, 64
#: Distinct words that a task adds up before it hands them on.
FLUSH = 1 << 19
END = b"\xff"
#: Logarithms are handed back as 24-bit numbers of steps of 1 / STEPS: no byte is less likely than 10 ** -256.
STEPS = 1 << 16


def normal(text: bytes | None) -> bytes:
    """The bytes that the model scores: words, A-Z lower, with single spaces between, then END."""
    return b" ".join((text or b"").lower().split()) + END


def pieces(scored: bytes, most: int) -> Iterator[tuple[bytes, bytes]]:
    """A text's (BEFORE bytes before, body) in pieces of about most bytes, cut after spaces."""
    at = 0
    while at < len(scored):
        cut = scored.find(b" ", at + most - 1) + 1 if len(scored) - at > most else 0
        end = cut or len(scored)
        yield scored[max(0, at - BEFORE) : at].rjust(BEFORE, b"\0"), scored[at:end]
        at = end


def packed(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """shard, texts, sizes, rows, ids, learns: shards of docs (doc_id, text, learns), one row each."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        part, zip_ = TaskContext.get().partitionId() << 36, zstandard.ZstdCompressor(level=1)
        held, size, row, shard = [], 0, 0, 0

        def flush():
            nonlocal shard, size
            texts, sizes, rows, ids, learns = zip(*held, strict=True)
            out = pa.RecordBatch.from_arrays([
                pa.array([part | shard], pa.int64()), pa.array([zip_.compress(b"".join(texts))], pa.binary()), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([rows], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())), pa.array([learns], pa.list_(pa.bool_())),
            ], ["shard", "texts", "sizes", "rows", "ids", "learns"])
            held.clear()
            shard, size = shard + 1, 0
            common.tidy()
            return out

        for batch in batches:
            for doc_id, text, learns in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for before, body in pieces(normal(text.as_py()), shard_bytes):
                    held.append((before + body, len(body), part | row, doc_id, learns))
                    size += len(body) + BEFORE
                    if size >= shard_bytes:
                        yield flush()
                row += 1
        if held:
            yield flush()

    return docs.mapInArrow(run, "shard long, texts binary, sizes array<int>, rows array<long>, ids array<long>, learns array<boolean>")


def split_words(texts: bytes, sizes: list[int], wanted: list[bool] | None = None) -> tuple[pa.Array, np.ndarray]:
    """The words of a shard's bodies, and how many each of them has; those not wanted have none."""
    bodies, at = [], 0
    for k, size in enumerate(sizes):
        bodies.append(texts[at + BEFORE : at + BEFORE + size].removesuffix(END) if wanted is None or wanted[k] else b"")
        at += BEFORE + size
    parts = pc.split_pattern(pa.array(bodies, pa.binary()), b" ")
    flat = parts.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # nothing stands after a piece's last space, nor in an empty text
    before = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
    return flat.filter(some), np.diff(before[parts.offsets.to_numpy()])


def word_counts(packs: DataFrame) -> DataFrame:
    """word, n over the training texts; a null word counts the texts themselves."""

    def run(batches):
        import zstandard

        unzip, held, size = zstandard.ZstdDecompressor(), [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            for texts, sizes, learns in zip(*(batch.column(k) for k in range(3)), strict=True):
                texts, sizes, learns = unzip.decompress(texts.as_py()), sizes.as_py(), learns.as_py()
                counted = pc.value_counts(split_words(texts, sizes, learns)[0])
                ends = np.cumsum(np.array(sizes) + BEFORE) - 1
                documents = sum(texts[e] == END[0] and learn for e, learn in zip(ends.tolist(), learns, strict=True))
                held.append(pa.table({"word": counted.field("values"), "n": counted.field("counts")}))
                held.append(pa.table({"word": pa.nulls(1, pa.binary()), "n": pa.array([documents], pa.int64())}))
                size += len(counted)
                if size >= FLUSH:
                    held, size = [added()], 0
                    common.tidy()
                    if len(held[0]) >= FLUSH:
                        yield from held.pop().to_batches()
        if held:
            yield from added().to_batches()
            held.clear()
            common.tidy()

    return packs.select("texts", "sizes", "learns").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(words: DataFrame, most: int) -> DataFrame:
    """The commonest words, at most most of them: those whose count lies in classes of counts that hold no more together."""
    own = words.where(F.col("word").isNotNull() & (F.length("word") <= FREQUENT_BYTES)).withColumn("class", F.floor(8 * F.log2("n")).cast("int"))
    least, held = None, 0
    for r in sorted(own.groupBy("class").count().collect(), reverse=True):  # at most 8 * 64 classes
        held += r["count"]
        if held > most:
            break
        least = r["class"]
    return own.where(F.col("class") >= least if least is not None else F.lit(False)).drop("class")


def _inside(texts: bytes, sizes: np.ndarray) -> np.ndarray:
    """Which bytes of a shard, from the ninth on, belong to bodies."""
    own = np.ones(len(texts), dtype=bool)
    at = np.cumsum(np.append(0, sizes[:-1] + BEFORE))
    for k in range(BEFORE):
        own[at + k] = False
    return own[BEFORE:]


def _before(texts: bytes, bytes_: int) -> np.ndarray:
    """The bytes_ bytes before each byte of a shard from the ninth on, the nearest most significant: a view that reads them at once."""
    return np.ndarray(len(texts) - BEFORE, dtype=f"<u{bytes_}", buffer=texts, offset=BEFORE - bytes_, strides=(1,))


class Positions:
    """A shard's bytes by the two bytes before each: pairs (pair, from, to) of order, the bytes' places counted from the ninth of the shard."""

    CHUNK = 1 << 20

    def __init__(self, texts: bytes, sizes: np.ndarray, depth: int):
        self.texts, self.depth, own, pair = texts, depth, _inside(texts, sizes), _before(texts, 2)
        counted, nears = np.zeros(1 << 16, dtype=np.int64), []
        chunks = range(0, len(own), self.CHUNK)
        for c in chunks:
            nears.append(pair[c : c + self.CHUNK][own[c : c + self.CHUNK]])
            counted += np.bincount(nears[-1], minlength=1 << 16)
        ends = np.cumsum(counted)
        free, self.order = (ends - counted).tolist(), np.empty(int(ends[-1]), dtype=np.uint32)
        found = np.flatnonzero(counted)
        self.pairs = list(zip(found.tolist(), (ends - counted)[found].tolist(), ends[found].tolist(), strict=True))
        for c in chunks:
            at, near = np.flatnonzero(own[c : c + self.CHUNK]), nears.pop(0)
            both = np.sort(near.astype(np.uint64) << np.uint64(32) | (at + c).astype(np.uint64))  # pair and place in one number
            near, at = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
            cuts = np.flatnonzero(np.append(True, near[1:] != near[:-1])) if len(near) else near
            for p, a, b in zip(near[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(near)).tolist(), strict=True):
                self.order[free[p] : free[p] + b - a] = at[a:b]
                free[p] += b - a
        self._eight, self._letters = _before(texts, 8), np.frombuffer(texts, dtype=np.uint8)[BEFORE:]

    def sorted_keys(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of order[a:b] in order, and where each stands; of so few that both fit, as one number."""
        key, bits = self.keys(a, b), 64 - 8 * (self.depth - 1)
        if b - a > 1 << bits:
            order = np.argsort(key)
            return key[order], order
        both = np.sort(key << np.uint64(bits) | np.arange(b - a, dtype=np.uint64))
        return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)

    def keys(self, a: int, b: int) -> np.ndarray:
        """The keys of order[a:b]: the bytes before the pair, the nearest first, then the byte itself."""
        at = self.order[a:b]
        out = self._eight[at]
        out &= np.uint64((1 << 48) - 1)
        out >>= np.uint64(8 * (BEFORE - self.depth))
        out <<= np.uint64(8)
        out |= self._letters[at]
        return out


def _width(values: np.ndarray) -> int:
    """Bytes that the largest of integers takes."""
    return max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1


def _planes(values: np.ndarray, width: int) -> bytes:
    """The width low bytes of integers, a plane for each byte, compressed."""
    import zstandard

    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def _values(data: bytes, n: int) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        out[:, : len(raw) // n] = raw.reshape(-1, n).T
    return out.reshape(-1).view("<u8")


def _ascending(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_values(data, n), dtype=np.uint64)


def code_of(context: bytes) -> int:
    """A leaf's name: its context, the nearest byte first, left in LONGEST bytes, and its length."""
    return int.from_bytes(context.ljust(LONGEST, b"\0"), "big") << 8 | len(context)


def context_of(code: int) -> bytes:
    return (code >> 8).to_bytes(LONGEST, "big")[: code & 255]


def cut(keys: np.ndarray, context: bytes, split: set[bytes], depth: int, low: int = 0, high: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """The leaves (context, from, to) of a pair's ascending keys."""
    high = len(keys) if high is None else high
    if context not in split:
        yield context, low, high
        return
    value = (keys[low:high] >> np.uint64(8 * (depth - len(context)))) & np.uint64(255)
    at = np.append(np.flatnonzero(np.append(True, value[1:] != value[:-1])), len(value))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield from cut(keys, context + bytes([int(value[a])]), split, depth, low + a, low + b)


def crowded(packs: DataFrame, depth: int, leaf_bytes: int) -> set[bytes]:
    """The contexts that stand before more than leaf_bytes bytes: at most as many as all bytes over leaf_bytes, for each length, so MOST_SPLIT."""
    split: set[bytes] = set()
    for length in range(SHORTEST, min(LONGEST, depth - 1)):
        inside = np.array(sorted(int.from_bytes(c, "big") for c in split if len(c) == length - 1), dtype=np.uint64)

        hot = np.zeros(1 << 16, dtype=bool)
        hot[[int.from_bytes(c, "big") for c in split if len(c) == SHORTEST]] = True

        def run(batches, length=length, inside=inside, hot=hot):
            import zstandard

            unzip = zstandard.ZstdDecompressor()
            for batch in batches:
                for texts, sizes in zip(batch.column(0), batch.column(1), strict=True):
                    texts = unzip.decompress(texts.as_py())
                    own, pair, eight = _inside(texts, sizes.values.to_numpy()), _before(texts, 2), _before(texts, 8)
                    for c in range(0, len(own), Positions.CHUNK):
                        here = slice(c, c + Positions.CHUNK)
                        if length == SHORTEST:
                            n = np.bincount(pair[here][own[here]], minlength=1 << 16)
                            value = np.flatnonzero(n)
                            n = n[value]
                        else:
                            context = eight[here][np.flatnonzero(own[here] & hot[pair[here]])] >> np.uint64(8 * (BEFORE - length))
                            value, n = np.unique(context[np.isin(context >> np.uint64(8), inside)] if length > 3 else context, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n)], ["context", "n"])

        counted = packs.select("texts", "sizes").mapInArrow(run, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
        new = {r.context.to_bytes(length, "big") for r in counted.where(F.col("n") > leaf_bytes).collect()}
        if not new:
            break
        split |= new
    return split


def grams(packs: DataFrame, split: set[bytes], depth: int) -> DataFrame:
    """code, shard, n, keys, counts: each shard's different grams in each leaf, and their counts in training texts."""

    def run(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor()

        def out(shard: int, rows: list[tuple]) -> pa.RecordBatch:
            code, n, keys, counts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array([shard] * len(code), pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["code", "shard", "n", "keys", "counts"])

        for batch in batches:
            for shard, texts, sizes, learns in zip(*(batch.column(k) for k in range(4)), strict=True):
                sizes = sizes.values.to_numpy()
                own = Positions(unzip.decompress(texts.as_py()), sizes, depth)
                left = np.repeat(~np.array(learns.as_py()), sizes + BEFORE)[BEFORE:]
                rows = []
                for pair, a, b in own.pairs:
                    both = np.sort(own.keys(a, b) << np.uint64(1) | left[own.order[a:b]])
                    key = both >> np.uint64(1)
                    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    count = np.diff(np.append(at, len(both))) - np.add.reduceat(both & np.uint64(1), at).astype(np.int64)
                    keys = key[at]
                    for context, u, v in cut(keys, pair.to_bytes(2, "big"), split, depth):
                        rows.append((code_of(context), v - u, _planes(np.diff(keys[u:v], prepend=np.uint64(0)), depth - 1), _planes(count[u:v], _width(count[u:v]))))
                    if len(rows) >= 256:
                        yield out(shard.as_py(), rows)
                        rows = []
                del own, left
                common.tidy()
                if rows:
                    yield out(shard.as_py(), rows)

    return packs.select("shard", "texts", "sizes", "learns").mapInArrow(run, "code long, shard long, n long, keys binary, counts binary")


_TABLE = 1 << 14
_HALF = np.cumsum(np.append(lgamma(0.5), np.log(np.arange(_TABLE - 1) + 0.5)))
_WHOLE = np.cumsum(np.append(0.0, np.log(np.arange(_TABLE - 1) + 1.0)))


def _log_gamma(n: np.ndarray, plus: float) -> np.ndarray:
    """Logarithm of gamma(n + plus) for counts n; plus is 0.5 or 1."""
    out = (_HALF if plus == 0.5 else _WHOLE)[np.minimum(n, _TABLE - 1)]
    far = np.flatnonzero(n >= _TABLE)
    if len(far):
        z = n[far] + plus
        out[far] = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3)
    return out


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(zeros + ones, 1.0) - 2 * lgamma(0.5)


class Tree:
    """The contexts of length bytes and more of ascending grams (leaf, key) with counts n."""

    def __init__(self, leaf: np.ndarray, key: np.ndarray, n: np.ndarray, length: int, depth: int):
        """leaf numbers are below 2**16 and ascend; all leaves have contexts of length bytes."""
        self.length, self.depth = length, depth
        self.whole, self.own = [None] * (depth + 1), [None] * (depth + 1)
        self.n, self.up = [None] * (depth + 1), [None] * (depth + 1)
        self.leaf = leaf
        # The longest contexts may fill all eight bytes: number them, so that the leaf fits beside the byte.
        first = np.append(True, (key[1:] >> np.uint64(8) != key[:-1] >> np.uint64(8)) | (leaf[1:] != leaf[:-1])) if len(key) else np.zeros(0, dtype=bool)
        self.whole[depth], self.n[depth] = (np.cumsum(first).astype(np.uint64) << np.uint64(8)) | (key & np.uint64(255)), n
        context = key
        now = leaf.astype(np.uint64) << np.uint64(48)
        for d in range(depth - 1, length - 1, -1):
            context = ((context >> np.uint64(16)) << np.uint64(8)) | (context & np.uint64(255))
            self.whole[d], self.up[d + 1] = np.unique(now | context, return_inverse=True)
            self.n[d] = np.bincount(self.up[d + 1], self.n[d + 1], len(self.whole[d])).astype(np.int64)
            now, context = self.whole[d] >> np.uint64(48) << np.uint64(48), self.whole[d] & np.uint64((1 << 48) - 1)

    def _runs(self, d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For decision k at depth d: each gram's node, each node's first gram, its zeros and ones."""
        x = self.whole[d] >> np.uint64(8 - k)
        first = np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(first)
        ones = np.add.reduceat(self.n[d] * ((self.whole[d] >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64), at) if len(at) else at
        return np.cumsum(first) - 1, at, (np.add.reduceat(self.n[d], at) if len(at) else at) - ones, ones

    def upward(self, k: int, shares: bool = True) -> list[tuple]:
        """For decision k, from the longest depth to length: nodes as _runs() has them, their weight and, with shares, their own share of it."""
        out, below = [None] * (self.depth + 1), None
        for d in range(self.depth, self.length - 1, -1):
            of, at, zeros, ones = self._runs(d, k)
            weighed, share = estimate(zeros, ones), np.ones(len(at)) if shares else None
            if d < self.depth:
                more = np.bincount(of[self.up[d + 1][below[1]]], below[4], len(at)) - weighed
                weighed = weighed + np.maximum(more, 0) + np.log1p(np.exp(-np.abs(more))) - log(2)
                share = 1 / (1 + np.exp(np.minimum(more, 700))) if shares else None
            below = out[d] = (of, at, zeros, ones, weighed, share)
        return out

    def leaf_nodes(self) -> Iterator[tuple]:
        """For each decision the nodes of the leaves' own contexts: leaf, node, zeros, ones, weight."""
        for k in range(8):
            _, at, zeros, ones, weighed, _ = self.upward(k, shares=False)[self.length]
            first = self.whole[self.length][at]
            node = ((first & np.uint64(255)) | np.uint64(256)) >> np.uint64(8 - k)
            yield self._leaf_of(at), node.astype(np.int64), zeros, ones, weighed

    def _leaf_of(self, at: np.ndarray) -> np.ndarray:
        return (self.whole[self.length][at] >> np.uint64(48)).astype(np.int64) if self.length < self.depth else self.leaf[at].astype(np.int64)

    def logs(self, shallow) -> np.ndarray:
        """log10 of each gram's byte; shallow(leaf, node) gives what shorter contexts add, and what they leave, of the mixture."""
        out = np.zeros(len(self.n[self.depth]))
        for k in range(8):
            levels = self.upward(k)
            of, at, zeros, ones, _, share = levels[self.length]
            node = (((self.whole[self.length][at] & np.uint64(255)) | np.uint64(256)) >> np.uint64(8 - k)).astype(np.int64)
            before, rest = shallow(self._leaf_of(at), node)
            kt = (ones + 0.5) / (zeros + ones + 1)
            for d in range(self.length + 1, self.depth + 1):
                parent = of[self.up[d][levels[d][1]]]
                of, at, zeros, ones, _, own = levels[d]
                unseen = zeros + ones == 0
                add = rest[parent] * kt[parent]
                before, rest = before[parent] + np.where(unseen, add, add * share[parent]), np.where(unseen, 0, rest[parent] * (1 - share[parent]))
                kt, share = (ones + 0.5) / (zeros + ones + 1), own
            one = before + rest * kt
            bit = ((self.whole[self.depth] >> np.uint64(7 - k)) & np.uint64(1)) == 1
            out += np.log10(np.where(bit, one[of], 1 - one[of]))
        return out


def _merged(rows: list[tuple]) -> tuple:
    """Rows (shard, n, keys, counts) of a leaf as one: its different grams, their counts, and for each shard its size and its grams' places among them."""
    keys = np.concatenate([_ascending(k, n) for _, n, k, _ in rows])
    counts = np.concatenate([_values(c, n) for _, n, _, c in rows])
    union, place = np.unique(keys, return_inverse=True)
    at = np.cumsum([0, *[n for _, n, _, _ in rows]])
    steps = [np.diff(place[a:b], prepend=0) for a, b in zip(at[:-1], at[1:], strict=True)]
    return union, np.bincount(place, counts, len(union)).astype(np.int64), [r[0] for r in rows], [r[1] for r in rows], [_planes(x, _width(x)) for x in steps]


def bundled(table: DataFrame, depth: int, shards: int) -> DataFrame:
    """code, shard (a bundle), n, keys, counts, shards, sizes, members: grams() of many shards, MOST_SHARDS or so of them together.

    A context that all shards know would otherwise bring a row from each of them to one task.
    """
    schema = "code long, shard long, n long, keys binary, counts binary, shards array<long>, sizes array<long>, members array<binary>"

    def run(batches):
        now, rows = None, []

        def out() -> pa.RecordBatch:
            keys, counts, own, sizes, members = _merged(rows)
            columns = [[now[0]], [now[1]], [len(keys)], [_planes(np.diff(keys, prepend=np.uint64(0)), depth - 1)], [_planes(counts, _width(counts))], [own], [sizes], [members]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["code", "shard", "n", "keys", "counts", "shards", "sizes", "members"])

        for batch in batches:
            for code, bundle, *row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (code, bundle) != now and rows:
                    yield out()
                now = code, bundle
                rows.append(tuple(row))
        if rows:
            yield out()

    bundle = F.pmod(F.xxhash64("shard"), F.lit(-(-shards // MOST_SHARDS)))
    dealt = table.withColumn("bundle", bundle).repartition("code", "bundle").sortWithinPartitions("code", "bundle", "shard")
    return dealt.select("code", "bundle", "shard", "n", "keys", "counts").mapInArrow(run, schema)


def unbundled(logs: DataFrame, bundles: DataFrame) -> DataFrame:
    """shard, code, n, logs: answers() to bundles handed on to their shards."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                steps, rows = _values(row["logs"], row["of"]), []
                for shard, n, members in zip(row["shards"], row["sizes"], row["members"], strict=True):
                    rows.append((shard, row["code"], n, _planes(steps[np.cumsum(_values(members, n)).astype(np.int64)], 3)))
                shard, code, n, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(code, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["shard", "code", "n", "logs"])

    told = logs.select("shard", "code", F.col("n").alias("of"), "logs")
    both = bundles.select("shard", "code", "shards", "sizes", "members").join(told, ["shard", "code"])
    return both.select("code", "of", "logs", "shards", "sizes", "members").mapInArrow(run, "shard long, code long, n long, logs binary")


def leaves(table: DataFrame, depth: int) -> DataFrame:
    """One row a leaf: code, its different grams (n, keys, counts), the shards that have some of them (shards, sizes, members), and the nodes of its own context."""
    schema = "code long, n long, keys binary, counts binary, shards array<long>, sizes array<long>, members array<binary>, nodes array<struct<node: int, zeros: long, ones: long, weighed: double>>"
    node_type = pa.list_(pa.struct([("node", pa.int32()), ("zeros", pa.int64()), ("ones", pa.int64()), ("weighed", pa.float64())]))

    def emit(held: list[tuple]) -> pa.RecordBatch:
        leaf = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        tree = Tree(leaf, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), held[0][0] & 255, depth)
        own = [np.concatenate(x) for x in zip(*tree.leaf_nodes(), strict=True)]
        order = np.argsort(own[0], kind="stable")
        own = [x[order] for x in own]
        ends = np.searchsorted(own[0], np.arange(len(held) + 1))
        nodes = pa.StructArray.from_arrays([pa.array(own[1].astype(np.int32)), pa.array(own[2]), pa.array(own[3]), pa.array(own[4])], fields=list(node_type.value_type))
        columns = [
            pa.array([h[0] for h in held], pa.int64()), pa.array([len(h[1]) for h in held], pa.int64()),
            pa.array([_planes(np.diff(h[1], prepend=np.uint64(0)), depth - 1) for h in held], pa.binary()), pa.array([_planes(h[2], _width(h[2])) for h in held], pa.binary()),
            pa.array([h[3] for h in held], pa.list_(pa.int64())), pa.array([h[4] for h in held], pa.list_(pa.int64())), pa.array([h[5] for h in held], pa.list_(pa.binary())),
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), nodes),
        ]
        return pa.RecordBatch.from_arrays(columns, ["code", "n", "keys", "counts", "shards", "sizes", "members", "nodes"])

    def run(batches):
        code, rows, held = None, [], []
        for batch in batches:
            for now, *row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if now != code and rows:
                    held.append((code, *_merged(rows)))
                    rows = []
                    if sum(len(h[1]) for h in held) >= BATCH_GRAMS or (now ^ code) & 255:
                        yield emit(held)
                        held = []
                code = now
                rows.append(tuple(row))
        if rows:
            held.append((code, *_merged(rows)))
        if held:
            yield emit(held)

    dealt = table.repartition("code").sortWithinPartitions(F.col("code").bitwiseAND(F.lit(255)), "code", "shard")
    return dealt.select("code", "shard", "n", "keys", "counts").mapInArrow(run, schema)


def _log_gamma_of(x: Column) -> Column:
    """Stirling's series after seven steps up; right to about 1e-10 from x = 0.5 on."""
    product = x
    for k in range(1, 7):
        product = product * (x + k)
    z = x + 7
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(product)


def shallow(table: DataFrame, longest: int) -> DataFrame:
    """code, mixed (node, before, rest): for each node of a leaf's own context, what shorter contexts add to its mixture and leave of it.

    Sums over (context, node), from the leaves of longest bytes down to no context, and back.
    """
    spark, low = table.sparkSession, lambda d: F.lit((1 << 8 * d) - 1)
    length = F.col("code").bitwiseAND(F.lit(255))
    nearest = F.lit(0).cast("long")
    for k in range(LONGEST):  # the nearest byte least significant
        nearest = nearest.bitwiseOR(F.shiftleft(F.shiftright("code", 8 * (LONGEST - k)).bitwiseAND(F.lit(255)), 8 * k))
    own = table.select("code", length.alias("length"), nearest.alias("context"), F.explode("nodes").alias("v")).select("code", "length", "context", "v.*")
    own = common.written(own, "ctw-leaf-nodes")
    leaf = own.select("length", "context", "node", "zeros", "ones", "weighed")
    inner = {}
    for d in range(longest - 1, -1, -1):
        below = leaf.where(F.col("length") == d + 1).drop("length")
        if d + 1 in inner:
            below = below.unionByName(inner[d + 1].select("context", "node", "zeros", "ones", "weighed"))
        summed = below.groupBy(F.col("context").bitwiseAND(low(d)).alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighed").alias("below"))
        zeros, ones = F.col("zeros").cast("double"), F.col("ones").cast("double")
        kt = _log_gamma_of(zeros + 0.5) + _log_gamma_of(ones + 0.5) - _log_gamma_of(zeros + ones + 1.0) - 2 * lgamma(0.5)
        summed = summed.withColumn("estimate", kt).withColumn("more", F.col("below") - F.col("estimate"))
        weighed = F.greatest("below", "estimate") + F.log1p(F.exp(-F.abs("more"))) - log(2)
        share = 1 / (1 + F.exp(F.least("more", F.lit(700.0))))
        inner[d] = common.written(summed.select("context", "node", "zeros", "ones", weighed.alias("weighed"), share.alias("share")), "ctw-inner")
    chance = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    mixed = inner[0].select("context", "node", "share", chance.alias("kt"), F.lit(0.0).alias("before"), F.lit(1.0).alias("rest"))
    out = None
    for d in range(1, longest + 1):
        parent = mixed.select(F.col("context").alias("of"), F.col("node").alias("at"), F.col("share").alias("own"), F.col("kt").alias("p"), F.col("before").alias("b"), F.col("rest").alias("r"))
        unseen = F.col("zeros") + F.col("ones") == 0
        before = F.col("b") + F.when(unseen, F.col("r") * F.col("p")).otherwise(F.col("r") * F.col("own") * F.col("p"))
        rest = F.when(unseen, F.lit(0.0)).otherwise(F.col("r") * (1 - F.col("own")))

        def under(rows: DataFrame, parent=parent, d=d) -> DataFrame:
            return rows.join(parent.hint("merge"), (F.col("context").bitwiseAND(low(d - 1)) == F.col("of")) & (F.col("node") == F.col("at")))

        done = under(own.where(F.col("length") == d)).select("code", "node", before.alias("before"), rest.alias("rest"))
        out = done if out is None else out.unionByName(done)
        if d < longest:
            mixed = common.written(under(inner[d]).select("context", "node", "share", chance.alias("kt"), before.alias("before"), rest.alias("rest")), "ctw-mixed")
    out = out.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("node", "before", "rest"))).alias("mixed"))
    return common.written(out, "ctw-shallow")


def answers(table: DataFrame, mixed: DataFrame, depth: int) -> DataFrame:
    """shard, code, n, logs: the logarithms of each shard's grams in each leaf, in the grams' order."""

    def run(batches):
        held, size = [], 0

        def flush():
            keys = [_ascending(h["keys"], h["n"]) for h in held]
            counts = [_values(h["counts"], h["n"]).astype(np.int64) for h in held]
            leaf = np.repeat(np.arange(len(held)), [h["n"] for h in held])
            flat = [np.concatenate([np.array([x[name] for x in h["mixed"]]) for h in held]) for name in ("node", "before", "rest")]
            at = np.repeat(np.arange(len(held)), [len(h["mixed"]) for h in held]) * 256 + flat[0]

            def shorter(of: np.ndarray, node: np.ndarray):
                row = np.searchsorted(at, of * 256 + node)
                return flat[1][row], flat[2][row]

            logs = Tree(leaf, np.concatenate(keys), np.concatenate(counts), held[0]["code"] & 255, depth).logs(shorter)
            steps = np.minimum(np.rint(-logs * STEPS), (1 << 24) - 1).astype(np.uint64)
            start, rows = 0, []
            for h in held:
                for shard, n, members in zip(h["shards"], h["sizes"], h["members"], strict=True):
                    rows.append((shard, h["code"], n, _planes(steps[start + np.cumsum(_values(members, n)).astype(np.int64)], 3)))
                start += h["n"]
            held.clear()
            shard, code, n, out = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(code, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["shard", "code", "n", "logs"])

        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if held and (size >= BATCH_GRAMS or (held[0]["code"] ^ row["code"]) & 255 or len(held) >= 1 << 15):
                    yield flush()
                    size = 0
                held.append(row)
                size += row["n"]
        if held:
            yield flush()

    both = table.select("code", "n", "keys", "counts", "shards", "sizes", "members").join(mixed, "code")
    return both.mapInArrow(run, "shard long, code long, n long, logs binary")


def summed(packs: DataFrame, logs: DataFrame, frequent, depth: int) -> DataFrame:
    """row, doc_id, score, n_words, frequent, base, rare of each piece of a text, from its shard's grams and their logarithms."""
    schema = "row long, doc_id long, score double, n_words long, frequent long, base double, rare array<binary>"

    def scored(pack: dict, values: list[np.ndarray]) -> pa.RecordBatch:
        import zstandard

        texts, sizes = zstandard.ZstdDecompressor().decompress(pack["blob"]), np.array(pack["sizes"])
        own, logs, off = Positions(texts, sizes, depth), np.concatenate(values), 0
        out = np.zeros(len(texts) - BEFORE, dtype=np.float32)
        for _, a, b in own.pairs:
            key, order = own.sorted_keys(a, b)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            out[own.order[a:b][order]] = np.repeat(logs[off : off + len(first)], np.diff(np.append(first, len(key))))
            off += len(first)
        score = np.add.reduceat(out, np.cumsum(np.append(0, sizes[:-1] + BEFORE)), dtype=np.float64)
        words, n_words = split_words(texts, pack["sizes"])
        words = words.dictionary_encode()
        value = np.array([table.get(w, 0.0) for table in (frequent.value,) for w in words.dictionary.to_pylist()])
        value = value[words.indices.to_numpy()] if len(words) else np.zeros(0)
        sums = lambda x: np.diff(np.append(0, np.cumsum(x))[np.append(0, np.cumsum(n_words))])
        unknown = value == 0
        n_rare = sums(unknown)
        rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)).astype(np.int32)), words.dictionary.take(words.indices.filter(pa.array(unknown))))
        return pa.RecordBatch.from_arrays([
            pa.array(pack["rows"], pa.int64()), pa.array(pack["ids"], pa.int64()), pa.array(score), pa.array(n_words, pa.int64()), pa.array(n_words - n_rare, pa.int64()),
            pa.array(sums(value)), rare,
        ], ["row", "doc_id", "score", "n_words", "frequent", "base", "rare"])

    def run(batches):
        pack, values = None, []
        for batch in batches:
            code, n = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for k in range(len(batch)):
                if code[k] < 0:
                    if pack is not None:
                        yield scored(pack, values)
                        common.tidy()
                    pack, values = batch.slice(k, 1).to_pylist()[0], []
                else:
                    values.append(_values(batch.column(3)[k].as_py(), n[k]).astype(np.float32) / -STEPS)
        if pack is not None:
            yield scored(pack, values)

    own = packs.select("shard", F.lit(-1).cast("long").alias("code"), F.lit(0).cast("long").alias("n"), F.col("texts").alias("blob"), "sizes", "rows", "ids")
    none = {name: F.lit(None).cast(kind).alias(name) for name, kind in (("sizes", "array<int>"), ("rows", "array<long>"), ("ids", "array<long>"))}
    told = logs.select("shard", "code", "n", F.col("logs").alias("blob"), *none.values())
    dealt = own.unionByName(told).repartition("shard").sortWithinPartitions("shard", "code")
    return dealt.mapInArrow(run, schema)


def scores(docs: DataFrame, learns: Column, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, leaf_bytes: int = LEAF_BYTES, most_frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text); it learns from those where learns is true.

    A null text is empty: its one token is the end. Repeated rows have equal results, a null doc_id
    stays null, a null learns counts as false, other columns are ignored, and an empty table gives no rows.
    Very long texts are scored in pieces that know the bytes before them. Without training texts no token is
    known and each byte has probability 1/256. Contexts have SHORTEST to 8 bytes.
    """
    if not SHORTEST < depth <= 8:
        raise ValueError("a gram's key has at most eight bytes: depth is 3 to 8")
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    packs = common.written(packed(source, shard_bytes), "ctw-texts")
    words = common.written(word_counts(packs), "ctw-words")
    total = words.agg(F.sum("n").alias("n"), F.count("word").alias("distinct"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("documents")).first()
    documents, tokens, distinct = total.documents or 0, total.n or 0, total.distinct + bool(total.documents)
    commonest = {bytes(r.word): float(np.log10(r.n + 0.5)) for r in frequent_words(words, most_frequent).collect()}
    frequent = spark.sparkContext.broadcast(commonest)

    with common.small_batches(spark, BATCH_ROWS):
        bodies, shards = packs.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)), F.count("*")).head()
        split = crowded(packs, depth, max(leaf_bytes, -(-bodies // MOST_SPLIT)))
        table, bundles = grams(packs, split, depth), None
        if shards > MOST_SHARDS:
            bundles = common.written(bundled(table, depth, shards), "ctw-bundles")
            table = bundles.select("code", "shard", "n", "keys", "counts")
        tree = common.written(leaves(table, depth), "ctw-leaves")
        mixed = shallow(tree, max(map(len, split), default=SHORTEST - 1) + 1)
        common.release(spark)
        told = answers(tree, mixed, depth)
        parts = common.written(summed(packs, told if bundles is None else unbundled(told, bundles), frequent, depth), "ctw-scored")
    common.drop(spark, packs, tree, *([bundles] if bundles is not None else []))

    rare = parts.select("row", F.explode("rare").alias("word"))
    found = rare.join(words.where("word IS NOT NULL").withColumnRenamed("n", "c").hint("merge"), "word").groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("c") + 0.5)).alias("logs"))
    sums = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("score", "n_words", "frequent", "base")])
    out = sums.join(found, "row", "left")
    known = F.col("frequent") + F.coalesce("known", F.lit(0))
    scale, end = float(np.log10(tokens + 0.5 * (distinct + 1))), float(np.log10(documents + 0.5))
    base = F.col("base") + F.coalesce("logs", F.lit(0.0)) + (F.col("n_words") - known) * float(np.log10(0.5)) + end - (F.col("n_words") + 1) * scale
    return out.select("doc_id", (F.col("n_words") + 1).alias("n_tokens"), (known + int(documents > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
