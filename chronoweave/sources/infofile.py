"""Corpus files in XML: documents with sentences, tokens, parses, events, time expressions and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.text import decoded_token, encoded_token


def _attributes(names: str, kinds: dict[str, T.DataType] | None = None) -> T.StructType:
    return T.StructType([T.StructField(f"_{n}", (kinds or {}).get(n, T.StringType())) for n in names.split()])


_EVENT = _attributes("id eiid offset string tense aspect class polarity modality happen lowerBoundDuration upperBoundDuration", {"offset": T.IntegerType()})
_TIMEX = _attributes("tid text offset length anchortid type mod value docFunction temporalFunction", {"offset": T.IntegerType(), "length": T.IntegerType()})
_LINK = _attributes("event1 event2 relation closed type origin", {"closed": T.BooleanType()})
_ENTRY = T.StructType([
    T.StructField("_sid", T.IntegerType()), T.StructField("_file", T.StringType()), T.StructField("sentence", T.StringType()),
    T.StructField("tokens", T.StructType([T.StructField("t", T.ArrayType(T.StringType()))])), T.StructField("parse", T.StringType()), T.StructField("deps", T.StringType()),
    T.StructField("events", T.StructType([T.StructField("event", T.ArrayType(_EVENT))])), T.StructField("timexes", T.StructType([T.StructField("timex", T.ArrayType(_TIMEX))])),
])
#: Declared, as inference would take a single child for a struct.
SCHEMA = T.StructType([T.StructField("_name", T.StringType()), T.StructField("entry", T.ArrayType(_ENTRY)), T.StructField("tlink", T.ArrayType(_LINK)), T.StructField("timex", T.ArrayType(_TIMEX))])


def files(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, as nested as the file has it; the other functions take it apart."""
    return spark.read.format("xml").option("rowTag", "file").option("ignoreNamespace", True).schema(SCHEMA).load(path)


def _entries(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("_name").alias("doc"), F.explode("entry").alias("e"))


def sentences(docs: DataFrame) -> DataFrame:
    return _entries(docs).select("doc", F.col("e._sid").alias("sid"), F.col("e.sentence").alias("text"), F.col("e.parse").alias("parse"))


def tokens(docs: DataFrame) -> DataFrame:
    rows = _entries(docs).select("doc", F.col("e._sid").alias("sid"), F.posexplode("e.tokens.t").alias("at", "t"))
    return rows.select("doc", "sid", (F.col("at") + 1).alias("idx"), decoded_token(F.col("t")).alias("t")).select("doc", "sid", "idx", "t.before", "t.token", "t.after")


def tagged(docs: DataFrame) -> DataFrame:
    """doc, sid, idx, token, pos from the bracketed parses' leaves."""
    leaf = r"\(([^()\s]+) ([^()\s]+)\)"
    both = F.arrays_zip(F.regexp_extract_all("parse", F.lit(leaf), F.lit(1)).alias("pos"), F.regexp_extract_all("parse", F.lit(leaf), F.lit(2)).alias("token"))
    return sentences(docs).select("doc", "sid", F.posexplode(both).alias("at", "b")).select("doc", "sid", (F.col("at") + 1).alias("idx"), F.col("b")["token"].alias("token"), F.col("b")["pos"].alias("pos"))


def deps(docs: DataFrame) -> DataFrame:
    """doc, sid, reln, gov, gov_idx, dep, dep_idx; copied nodes count as the node itself."""
    form = r"^\s*([^(\s]+)\((.+)-(\d+)'*, (.+)-(\d+)'*\)\s*$"
    rows = _entries(docs).select("doc", F.col("e._sid").alias("sid"), F.explode(F.split("e.deps", "\n")).alias("line")).where(F.regexp_like("line", F.lit(form)))
    part = lambda k: F.regexp_extract("line", form, k)
    return rows.select("doc", "sid", part(1).alias("reln"), part(2).alias("gov"), part(3).cast("int").alias("gov_idx"), part(4).alias("dep"), part(5).cast("int").alias("dep_idx"))


def events(docs: DataFrame) -> DataFrame:
    """One row an event; its first instance id is its id."""
    rows = _entries(docs).select("doc", F.col("e._sid").alias("sid"), F.explode("e.events.event").alias("v"))
    ids = F.split("v._eiid", r"[,\s]+")
    return rows.select("doc", "sid", F.col("v._offset").alias("idx"), ids[0].alias("id"), F.col("v._id").alias("eid"), ids.alias("eiids"), F.col("v._string").alias("text"), F.col("v._tense").alias("tense"), F.col("v._aspect").alias("aspect"), F.col("v._class").alias("cls"), F.col("v._polarity").alias("polarity"), F.col("v._modality").alias("modality"))


def _timex(prefix: str) -> list:
    c = lambda n: F.col(f"{prefix}._{n}")
    return [c("offset").alias("idx"), c("length").alias("len"), c("tid").alias("id"), c("text").alias("text"), c("type").alias("type"), c("value").alias("value"), c("mod").alias("mod"), c("anchortid").alias("anchor"), c("docFunction").alias("doc_function"), c("temporalFunction").alias("temporal_function")]


def timexes(docs: DataFrame) -> DataFrame:
    return _entries(docs).select("doc", F.col("e._sid").alias("sid"), F.explode("e.timexes.timex").alias("v")).select("doc", "sid", *_timex("v"))


def creation_times(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("_name").alias("doc"), F.explode("timex").alias("v")).select("doc", *_timex("v"))


def links(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("_name").alias("doc"), F.explode("tlink").alias("v"))
    return rows.select("doc", F.col("v._event1").alias("id1"), F.col("v._event2").alias("id2"), F.col("v._relation").alias("relation"), F.coalesce("v._closed", F.lit(False)).alias("closed"), F.col("v._type").alias("link_type"), F.col("v._origin").alias("origin"))


def nested(sents: DataFrame, toks: DataFrame, evs: DataFrame, txs: DataFrame, lnks: DataFrame, dcts: DataFrame) -> DataFrame:
    """The tables put together again, in the form that files() reads. sents may have parse and deps (text)."""
    def gathered(df: DataFrame, fields: dict, order: str, name: str, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*[v.alias(k) for k, v in fields.items()]).alias("v")))), lambda s: s["v"]).alias(name))

    col = lambda df, n, kind="string": F.col(n) if n in df.columns else F.lit(None).cast(kind)
    e = {"_id": col(evs, "eid"), "_eiid": F.col("id"), "_offset": F.col("idx"), "_string": col(evs, "text"), "_tense": col(evs, "tense"), "_aspect": col(evs, "aspect"), "_class": col(evs, "cls"), "_polarity": col(evs, "polarity"), "_modality": col(evs, "modality")}
    t = lambda df: {"_tid": F.col("id"), "_text": col(df, "text"), "_offset": col(df, "idx", "int"), "_length": col(df, "len", "int"), "_type": col(df, "type"), "_value": F.col("value")}
    key = ["doc", "sid"]
    triples = toks.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", encoded_token(col(toks, "before"), F.col("token"), col(toks, "after")).alias("t")))), lambda s: s["t"]).alias("t"))
    rows = sents.join(triples, key, "left").join(gathered(evs, e, "idx", "event", key), key, "left").join(gathered(txs, t(txs), "idx", "timex", key), key, "left")
    entry = F.struct(F.col("sid").alias("_sid"), F.col("text").alias("sentence"), F.struct("t").alias("tokens"), col(sents, "parse").alias("parse"), col(sents, "deps").alias("deps"), F.struct("event").alias("events"), F.struct("timex").alias("timexes"))
    docs = rows.groupBy("doc").agg(F.array_sort(F.collect_list(entry), lambda a, b: a["_sid"] - b["_sid"]).alias("entry"))
    link = {"_event1": F.col("id1"), "_event2": F.col("id2"), "_relation": F.col("relation"), "_closed": col(lnks, "closed", "boolean"), "_origin": col(lnks, "origin")}
    docs = docs.join(gathered(lnks, link, "id1", "tlink", ["doc"]), "doc", "left").join(gathered(dcts, t(dcts), "id", "timex", ["doc"]), "doc", "left")
    return docs.withColumnRenamed("doc", "_name")


def write(docs: DataFrame, path: str, namespace: str) -> None:
    """One root of files; the name space is the corpus's own, and readers don't look at it."""
    docs.write.format("xml").option("rootTag", f'root xmlns="{namespace}"').option("rowTag", "file").mode("overwrite").save(path)
