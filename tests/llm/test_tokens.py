import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoweave.llm import packing, token_counts, token_files, tokens
from chronoweave.llm.queries import op4_token_files, op5_token_counts, op8_packing

SF = "/root/testdata/sf0.001"
ROWS = [(5, "It's the THE été's 12x ½ á œuf b"), (2, None), (9, ""), (2, "dup"), (None, "no id"), (7, "x " * 9000), (8, "<|endoftext|> A<|STARTOFTEXT|>b")]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokens.default_path())


def brute(plain, text):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAbzé ÉÈß'sd́İą1²½µ.,!\t\n\x0b\x1c\x85\xa0 |<>ÿ×") | st.characters(codec="utf-8"), max_size=60))
def test_pieces_equal_the_whole_text(text):
    own = tokens.encoder(tokens.default_path())
    want = own.whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text.encode()), dtype="<u4").tolist() == want
    assert own.count(text.encode()) == len(want)


def test_a_small_cache_changes_nothing():
    small, large = tokens.PieceEncoder(tokens.default_path(), 3), tokens.encoder(tokens.default_path())
    for text in (b"a b c d e f", b"a g h", b"b, i. j!"):
        assert small.encode(text) == large.encode(text) and small.count(text) == large.count(text)


def test_wavelet_file_answers():
    r = np.random.default_rng(1)
    ids = np.minimum(r.zipf(1.3, 5000), 70000).astype("<u4")
    file = token_files.WaveletFile(token_files.to_file(ids, [None, 3], np.array([4000, 5000])))
    assert file.ids().tolist() == ids.tolist() and file.doc_ids == [None, 3]
    for i in (0, 1, 63, 64, 4999):
        assert file.access(i) == ids[i]
    for t in (1, 2, 70000, 65536, 3):
        where = np.flatnonzero(ids == t)
        assert file.count(t) == len(where) and list(file.occurrences(t))[:50] == where[:50].tolist()
        assert file.rank(t, 777) == (where < 777).sum()
    assert file.document(1) == ids[4000:].tolist() and file.count(1 << 20) == 0
    empty = token_files.WaveletFile(token_files.to_file(ids[:0], [], ids[:0]))
    assert empty.ids().tolist() == [] and empty.count(1) == 0


def test_wavelet_file_of_many_blocks(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BITS", 256)
    ids = np.random.default_rng(2).integers(0, 9, 3000).astype("<u4")
    file = token_files.WaveletFile(token_files.to_file(ids, [1], np.array([3000])))
    assert [file.access(i) for i in range(0, 3000, 37)] == ids[::37].tolist() and file.ids().tolist() == ids.tolist()
    assert list(file.occurrences(4)) == np.flatnonzero(ids == 4).tolist()


def test_token_files_hold_every_document(spark, plain):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, start int")
    got = sorted(token_files.round_trip(docs).collect(), key=lambda r: r.start)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for row, (doc_id, text) in zip(got, order, strict=True):
        ids = brute(plain, text)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.round_trip(docs.limit(0)).count() == 0


@pytest.mark.parametrize("query", [op4_token_files])
def test_op4_on_a_whole_table(spark, plain, query):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    at = 0
    for d in docs:
        ids = brute(plain, d.text)
        assert tuple(got[d.doc_id]) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def check_packing(rows, lengths_of):
    """rows: doc key, start, length, doc_tokens, sequence, offset."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for key, start, length, total, seq, offset in rows:
        by_doc[key].append((start, length, total))
        by_seq[seq].append((offset, length))
    assert set(by_doc) == set(lengths_of)
    for key, parts in by_doc.items():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at and length > 0 and total == lengths_of[key]
            at += length
        assert at == lengths_of[key]
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049, 1, 1], [1100] * 500, [5000] * 3 + [1] * 50, list(range(1, 3000, 7)), [2047] * 40])
def test_best_fit_decreasing_places_each_token_once(lengths):
    rows, made = packing.pack_lengths(np.array(lengths, dtype=np.int64))
    check_packing([(i, a, n, lengths[i], s, o) for i, a, n, s, o in rows.tolist()], dict(enumerate(lengths)))
    assert made <= -(-sum(lengths) // 2048) + 11


def test_tightest_window_wins():
    tree = packing.CapacityTree(2048)
    for w, c in enumerate([500, 90, 100, 2048]):
        tree.put(c, w)
    assert [tree.tightest(n) for n in (1, 90, 91, 101, 501, 2048)] == [90, 90, 100, 500, 2048, 2048] and tree.loosest() == 2048
    assert tree.take(2048) == 3 and tree.tightest(501) == 0 and tree.loosest() == 500


def test_packing_over_small_buffers(spark, plain):
    docs = spark.createDataFrame([(k, t, "x") for k, (_, t) in enumerate(ROWS * 3)], "doc_id long, text string, sequence_id string")
    lengths = {k: len(brute(plain, t)) for k, (_, t) in enumerate(ROWS * 3)}
    ids = {k: brute(plain, t) for k, (_, t) in enumerate(ROWS * 3)}
    for buffer in (100, packing.BUFFER_TOKENS):
        rows = packing.pack(docs, buffer_tokens=buffer, with_ids=True).collect()
        check_packing([(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in rows], lengths)
        for r in rows:
            part = ids[r.doc_id][r.start : r.start + r.length].tobytes()
            assert bytes(r.ids) == part and zlib.crc32(part) == r.ids_crc32
    assert packing.pack(docs.limit(0)).count() == 0
    assert [r.doc_tokens for r in packing.pack(spark.createDataFrame([(None, None)] * 2, "doc_id long, text string")).collect()] == [1, 1]


def test_op8_on_a_whole_table(spark, plain):
    docs = {r.doc_id: brute(plain, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_packing(spark, SF).collect()
    padding = check_packing([(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in rows], {k: len(v) for k, v in docs.items()})
    assert padding <= 0.02 * sum(map(len, docs.values()))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(docs[r.doc_id][r.start : r.start + r.length].tobytes())


def test_length_histogram_and_suffix_sums(spark, plain):
    lengths = [len(brute(plain, r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op5_token_counts(spark, SF).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    a = np.array(lengths)
    for r in random.Random(1).sample(rows, 40):
        n = r.n_tokens
        want = ((a == n).sum(), (a >= n).sum(), a[a >= n].sum(), np.minimum(a, n).sum(), (a <= n).sum(), len(a), a.sum())
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_tokens, r.docs_at_most, r.total_docs, r.total_tokens) == want
        assert r.quantile == (a <= n).mean()
    cut = token_counts.truncated_total(token_counts.suffix_sums(token_counts.histogram(spark.read.parquet(f"{SF}/documents.parquet"))), 1000).first()
    assert (cut.total, cut.truncated, cut.docs_cut) == (a.sum(), np.minimum(a, 1000).sum(), (a > 1000).sum())


def test_counts_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.suffix_sums(token_counts.histogram(none)).count() == 0
    two = spark.createDataFrame([(1, None, 3), (1, None, 3), (2, "a", 3)], "doc_id long, text string, n_docs int")
    assert [(r.n_tokens, r.n_docs, r.docs_at_least) for r in token_counts.suffix_sums(token_counts.histogram(two)).orderBy("n_tokens").collect()] == [(1, 2, 3), (2, 1, 1)]


def test_other_tokenizer_files_are_not_taken_for_the_known_one():
    """A file that splits or lowers in another way gives the ids that its own library gives."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, known = tokens.PieceEncoder(path), tokens.PieceEncoder(tokens.default_path())
    assert known.by_pieces and not other.by_pieces
    for text in ("Hello WORLD  don't 42", "", "Ünïcode\n\ttabs"):
        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(other.encode(text.encode()), dtype="<u4").tolist() == want and other.count(text.encode()) == len(want)


def test_a_manifest_covers_all_files(spark):
    folder = token_files.common.new_path(spark, "token-files")
    docs = spark.createDataFrame([(k, "word " * (k % 7)) for k in range(500)], "doc_id long, text string")
    rows = token_files.write(docs, folder, shard_tokens=50).orderBy("part", "shard").collect()
    assert len(rows) > 20 and sum(r.n_docs for r in rows) == 500
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    got = token_files.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(500)) and got[-1].start + got[-1].n_tokens == at
