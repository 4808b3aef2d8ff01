"""Learned events and their attributes: features of tokens, and a model each for event or not, tense, aspect and class."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import is_event_tag
from chronoweave.operators.learned import predict, train

ATTRIBUTES = ("tense", "aspect", "cls")


def token_features(toks: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """doc, sid, idx, features of tagged tokens (doc, sid, idx, token, pos, and lemma, path, is_event where there are such columns)."""
    w = Window.partitionBy("doc", "sid").orderBy("idx")
    low = F.lower("token")
    word = lambda k: F.coalesce((F.lag(low, k) if k > 0 else F.lead(low, -k)).over(w), F.lit("<s>" if k > 0 else "</s>"))
    tag = lambda k: F.coalesce(F.lag("pos", k).over(w), F.lit("<s>"))
    join = lambda *parts: F.concat_ws("-", *parts)
    made = [
        low, join(word(1), low), join(word(2), word(1), low), join(F.lit("PRE"), word(1)), join(F.lit("PRE"), word(2), word(1)), join(F.lit("POST"), word(-1)), join(F.lit("POST"), word(-1), word(-2)),
        F.col("pos"), join(tag(1), F.col("pos")), join(tag(2), tag(1), F.col("pos")),
    ]
    for column, name in (("lemma", "LEM"), ("path", "PATH"), ("is_event", "IS-EVENT")):
        if column in toks.columns:
            made.append(F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{name}-"), F.col(column).cast("string"))))
    out = toks.select("doc", "sid", "idx", F.array_compact(F.array(*made)).alias("features"))
    if deps is None:
        return out
    ends = deps.select("doc", "sid", F.col("gov_idx").alias("idx"), F.concat(F.lit("DEPG-"), "reln").alias("f")).unionByName(deps.select("doc", "sid", F.col("dep_idx").alias("idx"), F.concat(F.lit("DEPD-"), "reln").alias("f")))
    more = ends.groupBy("doc", "sid", "idx").agg(F.sort_array(F.collect_list("f")).alias("more"))  # bounded by a sentence
    return out.join(more, ["doc", "sid", "idx"], "left").withColumn("features", F.concat("features", F.coalesce("more", F.array().cast("array<string>")))).drop("more")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows in the shape that models of pairs have: a token is named by its place."""
    return rows.select("doc", F.col("sid").cast("string").alias("id1"), F.col("idx").cast("string").alias("id2"), *[c for c in rows.columns if c not in ("doc", "sid", "idx")])


@dataclass
class EventModels:
    """train() on tokens and events, then extract() events from tokens or label() the attributes of given ones."""

    least: int = 2
    models: dict[str, PipelineModel | None] = field(default_factory=dict)

    def train(self, toks: DataFrame, events: DataFrame, deps: DataFrame | None = None) -> EventModels:
        rows = token_features(toks, deps).join(toks.where(is_event_tag(F.col("pos"))).select("doc", "sid", "idx"), ["doc", "sid", "idx"], "left_semi")
        own = rows.join(events.select("doc", "sid", "idx", *ATTRIBUTES, F.lit("EVENT").alias("event")), ["doc", "sid", "idx"], "left")
        self.models["event"] = train(_keyed(own.withColumn("label", F.coalesce("event", F.lit("NONE")))), self.least)
        for name in ATTRIBUTES:
            self.models[name] = train(_keyed(own.where(F.col(name).isNotNull()).withColumn("label", F.col(name))), self.least)
        return self

    def _predicted(self, rows: DataFrame, name: str) -> DataFrame | None:
        model = self.models.get(name)
        return None if model is None else predict(model, _keyed(rows)).select("doc", F.col("id1").cast("int").alias("sid"), F.col("id2").cast("int").alias("idx"), F.col("relation").alias(name))

    def label(self, events: DataFrame, toks: DataFrame, deps: DataFrame | None = None) -> DataFrame:
        """events with tense, aspect and cls as the models see them; an attribute without a model is null."""
        rows = token_features(toks, deps).join(events.select("doc", "sid", "idx"), ["doc", "sid", "idx"], "left_semi")
        out = events.drop(*ATTRIBUTES)
        for name in ATTRIBUTES:
            made = self._predicted(rows, name)
            out = out.withColumn(name, F.lit(None).cast("string")) if made is None else out.join(made, ["doc", "sid", "idx"], "left")
        return out

    def extract(self, toks: DataFrame, deps: DataFrame | None = None) -> DataFrame:
        """doc, sid, idx, eid, id, text, pos, tense, aspect, cls of the tokens that the model takes for events, numbered through each document."""
        own = toks.where(is_event_tag(F.col("pos")))
        made = self._predicted(token_features(toks, deps).join(own.select("doc", "sid", "idx"), ["doc", "sid", "idx"], "left_semi"), "event")
        hit = own.limit(0) if made is None else own.join(made.where("event = 'EVENT'").drop("event"), ["doc", "sid", "idx"])
        n = F.row_number().over(Window.partitionBy("doc").orderBy("sid", "idx")).cast("string")
        events = hit.select("doc", "sid", "idx", F.concat(F.lit("e"), n).alias("eid"), F.concat(F.lit("ei"), n).alias("id"), F.col("token").alias("text"), "pos")
        return self.label(events, toks, deps)
