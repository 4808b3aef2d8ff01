"""Learned sieves: hashed string features of pairs, multinomial and one-against-the-rest logistic regression, and a hook for external models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import linkfeatures, pairs
from chronoweave.operators.cascade import Corpus
from chronoweave.operators.evaluate import by_label
from chronoweave.operators.extract import frequent_features, pair_features

#: Features are hashed to so many weights a label: a bound of what a model carries, whatever the number of features.
WEIGHTS = 1 << 18

PAIRS: dict[str, Callable[[Corpus], DataFrame]] = {
    "event_timex_same_sentence": lambda c: pairs.same_sentence(c.events, c.timexes),
    "event_event_dominates": lambda c: pairs.dominated(c.events, c.spans),
    "event_event_same_sentence": lambda c: pairs.same_sentence(c.events),
    "event_creation_time": lambda c: pairs.with_creation_time(c.events, c.dcts),
    "event_timex_next_sentence": lambda c: pairs.next_sentence_both_ways(c.events, c.timexes),
    "event_event_next_sentence": lambda c: pairs.shifted(c.events, c.events, 1),
    "event_event_vague": lambda c: pairs.same_or_next(c.events),
    "event_governs_event": lambda c: pairs.governed(c.events, c.deps),
}

#: Features by kind of pair; those of other kinds are plain attributes. All take the corpus and the pairs.
FEATURES: dict[str, Callable[[Corpus, DataFrame], DataFrame]] = {
    "event_timex_same_sentence": linkfeatures.event_times,
    "event_event_dominates": linkfeatures.event_pairs,
    "event_event_same_sentence": linkfeatures.event_pairs,
    "event_creation_time": linkfeatures.event_creation_times,
    "event_timex_next_sentence": linkfeatures.event_times,
    "event_event_next_sentence": linkfeatures.event_pairs,
    "event_event_vague": lambda c, both: linkfeatures.patterned_pairs(both),
    "event_governs_event": lambda c, both: linkfeatures.governed_pairs(both),
}


def features_of(kind: str, corpus: Corpus, rich: bool = True) -> DataFrame:
    """doc, id1, id2, swapped, features of all pairs of a kind; rich features need the corpus's tokens."""
    both = PAIRS[kind](corpus)
    if rich and corpus.tokens is not None and (kind not in ("event_event_vague", "event_governs_event") or {"tense1", "aspect1", "cls1"} <= set(both.columns)):
        return FEATURES[kind](corpus, both)
    return pair_features(both).withColumn("swapped", F.lit(False))


def training_rows(features: DataFrame, gold: DataFrame, keep_none: bool = False) -> DataFrame:
    """features with the gold label, the pair's direction as in features; pairs without gold are left out, or NONE."""
    from chronoweave.functions.relations import inverted

    both = gold.select("doc", "id1", "id2", F.col("relation").alias("label")).union(gold.select("doc", F.col("id2"), F.col("id1"), inverted(F.col("relation"))))
    both = both.groupBy("doc", "id1", "id2").agg(F.min("label").alias("label"))
    if keep_none:
        return features.join(both, ["doc", "id1", "id2"], "left").withColumn("label", F.coalesce("label", F.lit("NONE")))
    return features.join(both, ["doc", "id1", "id2"])


def train(rows: DataFrame, least: int = 2, regularisation: float = 0.01) -> PipelineModel | None:
    """A model of rows (features, label); None without rows. Features in fewer than least rows are left out."""
    if rows.isEmpty():
        return None
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="skip")
    vector = HashingTF(inputCol="features", outputCol="x", numFeatures=WEIGHTS, binary=True)
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=regularisation, maxIter=50, family="multinomial")
    labels = sorted(r.label for r in rows.select("label").distinct().collect())  # a closed set of relation names
    return Pipeline(stages=[index, vector, model, IndexToString(inputCol="prediction", outputCol="relation", labels=labels)]).fit(_frequent(rows, least))


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    return frequent_features(rows, least) if least > 1 else rows


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """doc, id1, id2, relation, confidence, and swapped where features have it."""
    out = PipelineModel(model.stages[1:]).transform(features)
    return out.select("doc", "id1", "id2", *[c for c in ("swapped",) if c in features.columns], "relation", F.array_max(vector_to_array("probability")).alias("confidence"))


def _turned(links: DataFrame) -> DataFrame:
    """links with relations of swapped pairs inverted: features, and so models, see pairs in the order of the text."""
    from chronoweave.functions.relations import inverted

    return links.withColumn("relation", F.when(F.col("swapped"), inverted(F.col("relation"))).otherwise(F.col("relation"))).drop("swapped")


def _labelled(features: DataFrame, gold: DataFrame, keep_none: bool) -> DataFrame:
    from chronoweave.functions.relations import inverted

    rows = training_rows(features, gold, keep_none)
    return rows.withColumn("label", F.when(F.col("swapped"), inverted(F.col("label"))).otherwise(F.col("label")))


class LearnedSieve:
    """A sieve of one kind of pair: train() it, then call it like a rule sieve. Without a model it proposes nothing.

    keep: the labels to learn, all others count as NONE (the vague sieve learns VAGUE alone).
    """

    def __init__(self, kind: str, least_confidence: float = 0.0, least_count: int = 2, drop: tuple[str, ...] = ("NONE",), keep: tuple[str, ...] = (), rich: bool = True):
        self.kind, self.least_confidence, self.least_count, self.drop, self.keep, self.rich, self.model = kind, least_confidence, least_count, drop, keep, rich, None

    def rows(self, corpus: Corpus, gold: DataFrame) -> DataFrame:
        rows = _labelled(features_of(self.kind, corpus, self.rich), gold, self.kind == "event_governs_event")
        return rows.withColumn("label", F.when(F.col("label").isin(*self.keep), F.col("label")).otherwise("NONE")) if self.keep else rows

    def train(self, corpus: Corpus, gold: DataFrame) -> LearnedSieve:
        self.model = train(self.rows(corpus, gold), self.least_count)
        return self

    def __call__(self, corpus: Corpus) -> DataFrame | None:
        if self.model is None:
            return None
        made = _turned(predict(self.model, features_of(self.kind, corpus, self.rich)))
        return made.where((F.col("confidence") >= self.least_confidence) & ~F.col("relation").isin(*self.drop))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> LearnedSieve:
        self.model = PipelineModel.load(path)
        return self


class OneAgainstRest(LearnedSieve):
    """A model for each label, against all others, each with a threshold of its own.

    A pair gets the most probable of the labels that reach their thresholds (a number for all labels, or one by label), or, with only,
    that label or nothing.
    """

    def __init__(self, kind: str, labels: tuple[str, ...], thresholds: float | dict[str, float] = 0.5, only: str | None = None, least_count: int = 2, rich: bool = True):
        super().__init__(kind, 0.0, least_count, rich=rich)
        self.labels, self.only = labels, only
        self.thresholds = thresholds if isinstance(thresholds, dict) else dict.fromkeys(labels, thresholds)
        self.model: dict[str, PipelineModel] | None = None

    def train(self, corpus: Corpus, gold: DataFrame) -> OneAgainstRest:
        rows = self.rows(corpus, gold)
        there = {r.label for r in rows.select("label").distinct().collect()}  # a closed set of relation names
        made = {t: train(rows.withColumn("label", F.when(F.col("label") == t, t).otherwise("NONE")), self.least_count) for t in self.labels if t in there and len(there) > 1}
        self.model = {t: m for t, m in made.items() if m is not None} or None
        return self

    def probabilities(self, corpus: Corpus) -> DataFrame:
        """doc, id1, id2, label, confidence: each label's probability for each pair, in the pair's direction in the text."""
        features, out = features_of(self.kind, corpus, self.rich), None
        for label, model in self.model.items():
            of = model.stages[0].labels.index(label)
            made = PipelineModel(model.stages[1:]).transform(features).select("doc", "id1", "id2", "swapped", F.lit(label).alias("relation"), vector_to_array("probability")[of].alias("confidence"))
            out = made if out is None else out.unionByName(made)
        return out

    def __call__(self, corpus: Corpus) -> DataFrame | None:
        if self.model is None:
            return None
        least = F.lit(None).cast("double")
        for label, value in self.thresholds.items():
            least = F.when(F.col("relation") == label, value).otherwise(least)
        made = self.probabilities(corpus).where(F.col("confidence") >= least)
        if self.only is not None:
            made = made.where(F.col("relation") == self.only)
        best = made.groupBy("doc", "id1", "id2", "swapped").agg(F.max(F.struct("confidence", "relation")).alias("b")).select("doc", "id1", "id2", "swapped", "b.relation", "b.confidence")
        return _turned(best)

    def save(self, path: str) -> None:
        for label, model in self.model.items():
            model.write().overwrite().save(f"{path}/{label}")

    def load(self, path: str) -> OneAgainstRest:
        self.model = {label: PipelineModel.load(f"{path}/{label}") for label in self.labels}
        return self


class ExternalSieve:
    """A sieve whose links come from elsewhere, as a function of the corpus's tables."""

    def __init__(self, links: Callable[[Corpus], DataFrame | None] | None = None):
        self.links = links

    def __call__(self, corpus: Corpus) -> DataFrame | None:
        return self.links(corpus) if self.links else None


def exists_then_label(exists: PipelineModel, label: PipelineModel, features: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """Links that a first model says exist with at least cutoff, labelled by a second, most confident first."""
    there = predict(exists, features).where((F.col("relation") == "OVERLAP") & (F.col("confidence") >= cutoff))
    kept = features.join(there.select("doc", "id1", "id2", F.col("confidence").alias("exists")), ["doc", "id1", "id2"])
    return predict(label, kept).orderBy(F.desc("confidence"), "doc", "id1", "id2")


def existence_rows(features: DataFrame, gold: DataFrame) -> DataFrame:
    """features labelled OVERLAP where gold links the pair in either direction, NONE elsewhere."""
    key = lambda df: df.withColumns({"lo": F.least("id1", "id2"), "hi": F.greatest("id1", "id2")})
    linked = key(gold).select("doc", "lo", "hi", F.lit("OVERLAP").alias("label")).distinct()
    return key(features).join(linked, ["doc", "lo", "hi"], "left").withColumn("label", F.coalesce("label", F.lit("NONE"))).drop("lo", "hi")


def cross_validated(features: DataFrame, gold: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """guess and truth of every labelled pair, each predicted by a model of the other folds. folds: doc, fold."""
    rows = training_rows(features, gold).join(folds, "doc")
    out = None
    for n in range(k):
        model = train(rows.where(F.col("fold") != n))
        if model is not None:
            made = predict(model, rows.where(F.col("fold") == n)).join(rows.select("doc", "id1", "id2", F.col("label").alias("truth")), ["doc", "id1", "id2"]).withColumnRenamed("relation", "guess")
            out = made if out is None else out.unionByName(made)
    return out


def report(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 by label of rows (guess, truth)."""
    return by_label(rows)
