import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import context_tree
from chronoweave.llm.context_tree import DEPTH
from chronoweave.llm.queries import op6_context_tree

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


class Brute:
    """Context-tree weighting as it is defined, one node at a time."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        self.tokens = Counter()
        for text in texts:
            self.tokens.update([*words_of(text), None])
            data = b"\0" * DEPTH + b" ".join(words_of(text)) + b"\xff"
            for i in range(DEPTH, len(data)):
                for depth in range(DEPTH + 1):
                    context = data[i - depth : i]
                    for k in range(8):
                        node = (1 << k) | data[i] >> (8 - k)
                        self.n[context, node][data[i] >> (7 - k) & 1] += 1
                        if depth < DEPTH:
                            self.children[context, node].add(data[i - depth - 1 : i])
        self.weighed = {}

    def estimate(self, at):
        a, b = self.n[at]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)

    def below(self, at):
        return sum(self.weight((c, at[1])) for c in self.children[at])

    def weight(self, at):
        if at not in self.weighed:
            e = self.estimate(at)
            self.weighed[at] = e if len(at[0]) == DEPTH else np.logaddexp(e, self.below(at)) - math.log(2)
        return self.weighed[at]

    def one(self, past, node):
        """Probability of a one."""
        p, rest = 0.0, 1.0
        for depth in range(DEPTH + 1):
            at = (past[len(past) - depth :], node)
            if at not in self.n:
                return 0.5 if not depth else p + rest * last
            a, b = self.n[at]
            last = (b + 0.5) / (a + b + 1)
            if depth == DEPTH or (past[len(past) - depth - 1 :], node) not in self.n:
                return p + rest * last
            own = 1 / (1 + math.exp(min(700, self.below(at) - self.estimate(at))))
            p, rest = p + rest * own * last, rest * (1 - own)

    def score(self, text):
        data = b"\0" * DEPTH + b" ".join(words_of(text)) + b"\xff"
        total = 0.0
        for i in range(DEPTH, len(data)):
            for k in range(8):
                p = self.one(data[i - DEPTH : i], (1 << k) | data[i] >> (8 - k))
                total += math.log10(p if data[i] >> (7 - k) & 1 else 1 - p)
        return total

    def base(self, text):
        n, v = sum(self.tokens.values()), len(self.tokens)
        return sum(math.log10((self.tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words_of(text), None])

    def known(self, text):
        return sum(self.tokens[w] > 0 for w in [*words_of(text), None])


def check(rows, brute, texts):
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words_of(t)) + 1, brute.known(t), sum(brute.tokens.values()))
        assert r.base_score == pytest.approx(brute.base(t), rel=1e-9) and r.score == pytest.approx(brute.score(t), rel=1e-5, abs=1e-4)


TRAIN = ["the cat sat on the mat", "The  cat\nate", "été the mat", None, "aaaa bbbb aaaa", "the cat sat on the mat"]


def both(spark, train, others):
    rows = [(k, t, k < len(train), 1.0) for k, t in enumerate([*train, *others])]
    return spark.createDataFrame(rows, "doc_id long, text string, learns boolean, score double"), {r[0]: r[1] for r in rows}


@pytest.mark.parametrize(("shard_bytes", "leaf_bytes", "frequent"), [(1 << 20, 1 << 20, 1 << 16), (40, 12, 3), (64, 3, 0)])
def test_scores_equal_the_definition(spark, shard_bytes, leaf_bytes, frequent):
    """Small shards cut texts into pieces; small leaves split contexts byte by byte."""
    docs, texts = both(spark, TRAIN, ["unseen zebra! the", "", "\x00 ÿ", "the cat " * 50, "the cat sat on the hat"])
    check(context_tree.scores(docs, F.col("learns"), DEPTH, shard_bytes, leaf_bytes, frequent).collect(), Brute(TRAIN), texts)


def test_a_context_that_all_shards_know_is_bundled(spark, monkeypatch):
    """Some dozens of shards with one hot context, whose rows meet a few at a time: the scores are those that one table of them gives."""
    docs, texts = both(spark, [*TRAIN, "the the the the cat the " * 40], ["the cat the", "the the unseen"])
    score = lambda: {r.doc_id: r.score for r in context_tree.scores(docs, F.col("learns"), DEPTH, 40, 12, 3).collect()}
    whole = score()
    monkeypatch.setattr(context_tree, "MOST_SHARDS", 5)
    assert score() == pytest.approx(whole, rel=1e-9)
    monkeypatch.setattr(context_tree, "MOST_SPLIT", 40)  # fewer contexts are split, leaves are larger
    assert score() == pytest.approx(whole, rel=1e-4)
    brute = Brute([*TRAIN, "the the the the cat the " * 40])
    assert whole == pytest.approx({k: brute.score(t) for k, t in texts.items()}, rel=1e-4)


def test_probabilities_add_up_to_one(spark):
    train = ["abracadabra", "abc abd", "zz"]
    brute = Brute(train)
    for past in (b"\0\0\0\0abra", b"racadabr", b"qqqqqqqq", b"xyabxyab"):
        total = 0.0
        for x in range(256):
            p = 1.0
            for k in range(8):
                one = brute.one(past, (1 << k) | x >> (8 - k))
                p *= one if x >> (7 - k) & 1 else 1 - one
            total += p
        assert total == pytest.approx(1, abs=1e-9)


def test_op6_scores_held_out_texts_as_the_figures_say(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_context_tree(spark, SF).collect()
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 5 == 1}
    assert {r.doc_id for r in rows if r.held_out} == held and len(rows) == len(texts)
    tokens = Counter(w for d, t in texts.items() if d not in held for w in [*words_of(t), None])
    n, v = sum(tokens.values()), len(tokens)
    for r in rows:
        own = [*words_of(texts[r.doc_id]), None]
        assert r.base_score == pytest.approx(sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert r.n_known == sum(tokens[w] > 0 for w in own) and r.train_tokens == n
    # The base is no distribution: every unknown word has the chance of one, so 200 documents favour it. README.md has these figures.
    base, score = sum(r.base_score for r in rows if r.held_out), sum(r.score for r in rows if r.held_out)
    assert base == pytest.approx(-78_463, rel=0.01) and score == pytest.approx(-87_076, rel=0.01)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert context_tree.scores(none, F.lit(True)).count() == 0
    docs = spark.createDataFrame([(1, None), (1, None), (None, "ab")], "doc_id long, text string")
    got = context_tree.scores(docs, F.lit(None).cast("boolean")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert {round(r.score / math.log10(1 / 256)) for r in got} == {1, 3}


def test_longer_contexts_beat_the_base_on_a_larger_table(spark):
    rows = op6_context_tree(spark, "/root/testdata/sf0.01").where("held_out").collect()
    print("held out", sum(r.n_tokens for r in rows), sum(r.score for r in rows), sum(r.base_score for r in rows))
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.score for r in rows) == pytest.approx(-314_949, rel=0.01)


def test_texts_longer_than_shards_of_real_size(spark):
    """A text of several shards scores as its pieces do, byte for byte the same as in one shard."""
    words = [f"w{k * 7919 % 5003}" for k in range(60_000)]
    rows = [(1, " ".join(words), False), (2, " ".join(words[:9000]), True), (3, "w1 w2", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learns boolean")
    one, many = (sorted(context_tree.scores(docs, F.col("learns"), shard_bytes=n).collect()) for n in (1 << 22, 1 << 16))
    assert [r.n_tokens for r in one] == [60_001, 9_001, 3]
    assert all(a.score == pytest.approx(b.score, rel=1e-6) and a.n_known == b.n_known for a, b in zip(one, many, strict=True))
