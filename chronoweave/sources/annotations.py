"""Annotation tables: pairs with labels as lines, merged files, third-party links and feature files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.relations import expanded_label, normalised

ID = r"[et]i?\d+"
#: Attributes of one attribute-relation table at most: their names go to every task.
MOST_NAMES = 1 << 16


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """doc, annotator, id1, id2, label, ordinal from files named <doc>.<annotator>.

    Lines are "id1 id2 label" or "id1 label id2"; comments, blanks and lines of other forms are left out.
    A missing label is null. ordinal keeps a file's order and is not dense.
    """
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    rows = spark.read.text(path).select("value", name.alias("name"), F.monotonically_increasing_id().alias("ordinal"))
    rows = rows.where(~F.regexp_like("value", F.lit(r"^\s*(#|$)")))
    after, between = rf"^\s*({ID})\s+({ID})(?:\s+([a-z]+))?\s*$", rf"^\s*({ID})\s+([a-z]+)\s+({ID})\s*$"
    last = F.regexp_like("value", F.lit(after))
    part = lambda k, j: F.when(last, F.regexp_extract("value", after, k)).otherwise(F.regexp_extract("value", between, j))
    doc, annotator = F.regexp_extract("name", r"^(.*)\.([^.]*)$", 1), F.regexp_extract("name", r"^(.*)\.([^.]*)$", 2)
    out = rows.where(last | F.regexp_like("value", F.lit(between))).select(doc.alias("doc"), annotator.alias("annotator"), part(1, 1).alias("id1"), part(2, 3).alias("id2"), part(3, 2).alias("label"), "ordinal")
    return out.withColumn("label", F.when(F.col("label") != "", F.col("label")))


def merged(spark: SparkSession, path: str) -> DataFrame:
    """doc, id1, id2, label and relation of a merged file of all documents."""
    rows = spark.read.schema("doc string, id1 string, id2 string, label string").option("sep", "\t").csv(path)
    return rows.withColumn("relation", expanded_label(F.col("label")))


def external_links(spark: SparkSession, path: str) -> DataFrame:
    """doc, id1, id2, relation of lines "doc id1 id2 relation"; doc is the name before its first dot."""
    rows = spark.read.text(path).where(~F.regexp_like("value", F.lit(r"^\s*(#|$)"))).select(F.split(F.trim("value"), r"\s+").alias("p"))
    return rows.where("size(p) >= 4").select(F.substring_index(F.col("p")[0], ".", 1).alias("doc"), F.col("p")[1].alias("id1"), F.col("p")[2].alias("id2"), normalised(F.col("p")[3]).alias("relation"))


def added(links: DataFrame, external: DataFrame) -> DataFrame:
    """links and those external ones whose pair has no link but NONE ones."""
    key = lambda df: df.withColumns({"lo": F.least("id1", "id2"), "hi": F.greatest("id1", "id2"), "stem": F.substring_index("doc", ".", 1)})
    taken = key(links.where("relation <> 'NONE'")).select("stem", "lo", "hi")
    names = links.select("doc", F.substring_index("doc", ".", 1).alias("stem")).distinct()
    new = key(external).dropDuplicates(["stem", "lo", "hi"]).join(taken, ["stem", "lo", "hi"], "left_anti").drop("doc").join(names, "stem")
    return links.select("doc", "id1", "id2", "relation").unionByName(new.select("doc", "id1", "id2", "relation"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """doc, label, features of lines "doc<tab>label<tab>feature..."."""
    parts = F.split("value", r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("doc"), parts[1].alias("label"), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))).alias("features"))


def write_features(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", "doc", "label", F.array_join("features", "\t"))).write.text(path)


def write_annotations(rows: DataFrame, path: str) -> None:
    """Lines "id1<tab>id2<tab>label" in a folder for each document."""
    rows.select("doc", F.concat_ws("\t", "id1", "id2", "label").alias("value")).write.partitionBy("doc").text(path)


def write_statistics(rows: DataFrame, path: str) -> None:
    """A folder of tab-separated rows for each sieve."""
    rows.write.partitionBy("sieve").option("sep", "\t").option("header", True).csv(path)


def write_counts(rows: DataFrame, path: str) -> None:
    rows.select("key", "n").write.option("sep", "\t").csv(path)


def write_events(events: DataFrame, path: str) -> None:
    """sid, token (from 0), text, class and tense, tab-separated."""
    events.select("sid", (F.col("idx") - 1).alias("idx"), "text", "cls", "tense").write.option("sep", "\t").csv(path)


def write_attribute_relation(rows: DataFrame, path: str, name: str = "features") -> None:
    """Feature:value rows (label, features) as an attribute-relation table, its header in a file of its own."""
    values = F.transform("features", lambda f: F.struct(F.substring_index(f, ":", 1).alias("k"), F.element_at(F.split(f, ":"), -1).alias("v")))
    own = rows.select("label", F.map_from_entries(values).alias("m"))
    names = own.select(F.explode(F.map_keys("m")).alias("k")).groupBy("k").count().select("k")
    if names.count() > MOST_NAMES:
        raise ValueError(f"a table of more than {MOST_NAMES} attributes; drop rare features first")
    order = names.agg(F.sort_array(F.collect_list("k")).alias("names"))  # the attributes of one table
    line = F.concat_ws(",", F.transform("names", lambda k: F.coalesce(F.element_at("m", k), F.lit("0"))), "label")
    own.join(F.broadcast(order)).select(line.alias("value")).write.text(f"{path}/data")
    head = order.select(F.concat(F.lit(f"@relation {name}\n"), F.array_join(F.transform("names", lambda k: F.concat(F.lit("@attribute "), k, F.lit(" string"))), "\n"), F.lit("\n@attribute label string\n@data")).alias("value"))
    head.write.text(f"{path}/header")


def lines_as_files(rows: DataFrame, path: str, head: str = "<text>", tail: str = "</text>") -> None:
    """Each line (doc, value) wrapped as a document of its own, in a folder by doc."""
    rows.select("doc", F.format_string(f"{head}%s{tail}", F.col("value")).alias("value")).write.partitionBy("doc").text(path)


def write_progress(rows: DataFrame, path: str) -> None:
    """How far an annotator has come: ordinal, ids and the label given so far, empty where there is none, in a folder for each document."""
    line = F.concat_ws("\t", F.col("ordinal").cast("string"), "id1", "id2", F.coalesce("label", F.lit("")))
    rows.select("doc", line.alias("value")).write.partitionBy("doc").text(path)


def write_sentences(tokens: DataFrame, path: str) -> None:
    """A line of tokens for each sentence (doc, sid, idx, token), as outside taggers read them, in a folder for each document."""
    lines = tokens.groupBy("doc", "sid").agg(F.array_sort(F.collect_list(F.struct("idx", "token"))).alias("t"))
    ordered = lines.repartition("doc").sortWithinPartitions("doc", "sid")
    ordered.select("doc", F.array_join(F.transform("t", lambda t: t["token"]), " ").alias("value")).write.partitionBy("doc").text(path)


def write_features_with_pairs(rows: DataFrame, path: str) -> None:
    """The feature file, and beside it the same rows with their ids, for reading by people."""
    write_features(rows, f"{path}/features")
    rows.select(F.concat_ws("\t", "doc", "id1", "id2", "label", F.array_join("features", "\t"))).write.text(f"{path}/debug")


def tagged_by(tokens: DataFrame, command: list[str]) -> DataFrame:
    """doc, sid, idx, token, tag: what an outside tagger makes of sentences (doc, sid, idx, token).

    command reads a sentence a line, tokens with blanks between, and writes a line of tags for each; it runs once for each task, on every
    executor. A line with another number of tags than tokens, or a command that fails, is an error.
    """
    import subprocess

    lines = tokens.groupBy("doc", "sid").agg(F.array_sort(F.collect_list(F.struct("idx", "token"))).alias("t"))

    def run(batches):
        for batch in batches:
            rows = [r for r in batch.to_pylist() if r["t"]]
            if not rows:
                continue
            given = "".join(" ".join(x["token"] for x in r["t"]) + "\n" for r in rows)
            tags = [line.split() for line in subprocess.run(command, input=given, capture_output=True, text=True, check=True).stdout.splitlines()]
            if [len(r["t"]) for r in rows] != [len(x) for x in tags]:
                raise ValueError(f"{command[0]} gave other numbers of tags than it got tokens")
            yield pa.RecordBatch.from_pylist([{"doc": r["doc"], "sid": r["sid"], **x, "tag": tag} for r, own in zip(rows, tags, strict=True) for x, tag in zip(r["t"], own, strict=True)], schema=kind)

    kind = pa.schema([("doc", pa.string()), ("sid", pa.int32()), ("idx", pa.int32()), ("token", pa.string()), ("tag", pa.string())])
    return lines.mapInArrow(run, "doc string, sid int, idx int, token string, tag string")
