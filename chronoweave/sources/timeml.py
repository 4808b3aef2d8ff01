"""TimeML documents: text with EVENT and TIMEX3 tags in it, instances, links and a creation time."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html.entities import name2codepoint
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.relations import normalised
from chronoweave.operators import pairs
from chronoweave.operators.extract import SENTENCE_END, TOKEN

ROWS = "doc string, kind string, ordinal int, sid int, idx int, len int, id string, text string, attributes map<string,string>"
_TOKEN, _END = re.compile(TOKEN, re.ASCII), re.compile(SENTENCE_END, re.ASCII)
_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")
_TAGS = ("EVENT", "TIMEX3", "MAKEINSTANCE", "TLINK")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """doc, xml: one row a file, named by the file without its ending."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.(tml|xml|txt)$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("doc"), F.col("value").alias("xml"))


def raw_text(spark: SparkSession, path: str) -> DataFrame:
    """doc, text of plain text files."""
    return texts(spark, path).withColumnRenamed("xml", "text")


def parsed_trees(spark: SparkSession, path: str) -> DataFrame:
    """doc, parse of files with a bracketed tree a line; other lines are left out."""
    rows = spark.read.text(path).where(F.startswith("value", F.lit("(")))
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc"), F.col("value").alias("parse"))


def raw_xml(docs: DataFrame) -> DataFrame:
    """doc, text and dct (the creation time's value) by path expressions."""
    return docs.select("doc", F.xpath_string("xml", F.lit("//TEXT")).alias("text"), F.expr("xpath_string(xml, '//DCT/TIMEX3/@value')").alias("dct"))


def directory(spark: SparkSession, base: str) -> DataFrame:
    """texts() of a directory, or of its directories AQUAINT and TimeBank where it has the latter."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/TimeBank")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return texts(spark, base)
    both = [f"{base}/{name}" for name in ("AQUAINT", "TimeBank")]
    return texts(spark, both[0]).unionByName(texts(spark, both[1]))


def _named(xml: str) -> str:
    """xml with HTML's named characters, which XML doesn't know, in place of their names."""
    known = ("amp", "lt", "gt", "quot", "apos")
    return _ENTITY.sub(lambda m: m[0] if m[1] in known or m[1] not in name2codepoint else chr(name2codepoint[m[1]]), xml)


def _walked(xml: str) -> tuple[str, list[tuple]]:
    """The text in TEXT, and (kind, attributes, start, end) of the tags in document order; places are those in TEXT, or -1."""
    parser = ElementTree.XMLPullParser(events=("start", "end"))
    parser.feed(_named(xml))
    parser.close()
    pieces, size, open_tags, found, in_text, in_dct = [], 0, [], [], 0, 0
    for what, node in parser.read_events():
        if what == "start":
            in_text, in_dct = in_text + (node.tag == "TEXT"), in_dct + (node.tag == "DCT")
            if node.tag in _TAGS:
                kind = "DCT" if in_dct and node.tag == "TIMEX3" else node.tag
                open_tags.append(len(found))
                found.append([kind, dict(node.attrib), size if in_text else -1, -1])
            text = node.text if in_text else None
        else:
            if node.tag in _TAGS:
                found[open_tags.pop()][3] = size if in_text else -1
            in_text, in_dct = in_text - (node.tag == "TEXT"), in_dct - (node.tag == "DCT")
            text = node.tail if in_text else None
        if text:
            pieces.append(text)
            size += len(text)
    return "".join(pieces), [tuple(x) for x in found]


def _document(doc: str, xml: str) -> list[dict]:
    """Rows of a document: its tags with the tokens that they cover, sentence by sentence; one of kind ERROR if it isn't well-formed."""
    row = lambda kind, ordinal, **more: {"doc": doc, "kind": kind, "ordinal": ordinal, "sid": None, "idx": None, "len": None, "id": None, "text": None, "attributes": []} | more
    try:
        text, found = _walked(xml)
    except ElementTree.ParseError as e:
        return [row("ERROR", 0, text=str(e))]
    places = [m.span() for m in _TOKEN.finditer(text)]
    starts, ends, cuts = [a for a, _ in places], [b for _, b in places], [m.end() for m in _END.finditer(text)]
    sentence = [bisect_right(cuts, a) for a in starts]  # sentences are numbered by those that hold tokens
    first = [k for k in range(len(starts)) if not k or sentence[k] != sentence[k - 1]]
    instances: dict[str, list[str]] = {}
    for kind, own, _, _ in found:
        if kind == "MAKEINSTANCE" and own.get("eiid"):
            instances.setdefault(own.get("eventID", ""), []).append(own["eiid"])
    used = {x for ids in instances.values() for x in ids}
    rows, made = [], {}
    for ordinal, (kind, own, start, end) in enumerate(found):
        more = {"attributes": list(own.items())}
        if kind in ("EVENT", "TIMEX3"):
            low, high = bisect_right(ends, start), bisect_left(starts, end)  # tokens that end after start and begin before end
            if start < 0 or low >= high:
                continue
            sid = bisect_right(first, low) - 1
            more |= {"sid": sid, "idx": low - first[sid] + 1, "len": high - low, "text": text[start:end]}
        name = own.get({"EVENT": "eid", "MAKEINSTANCE": "eiid", "TLINK": "lid"}.get(kind, "tid"))
        if kind == "EVENT" and name and name not in instances:
            if name not in made:
                eiid = "ei" + name[1:]
                while eiid in used:
                    eiid += "2"
                used.add(eiid)
                made[name] = eiid
            more["attributes"] = [*own.items(), ("synthetic_eiid", made[name])]
        rows.append(row(kind, ordinal, id=name, **more))
    return rows


def parsed(docs: DataFrame) -> DataFrame:
    """ROWS of docs (doc, xml) in one pass: kinds EVENT, TIMEX3, DCT, MAKEINSTANCE, TLINK, and ERROR for a document that isn't well-formed.

    The other readers take docs or what this made of them; write it where several of them are used. A null document has no rows.
    """
    kinds = {n: pa.string() for n in ("doc", "kind", "ordinal", "sid", "idx", "len", "id", "text", "attributes")}
    kinds |= {n: pa.int32() for n in ("ordinal", "sid", "idx", "len")} | {"attributes": pa.map_(pa.string(), pa.string())}
    schema = pa.schema(list(kinds.items()))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["xml"] is not None:
                    yield pa.RecordBatch.from_pylist(_document(r["doc"], r["xml"]), schema=schema)

    return docs.select("doc", "xml").mapInArrow(run, ROWS)


def _of(docs: DataFrame, kind: str) -> DataFrame:
    return (docs if "kind" in docs.columns else parsed(docs)).where(F.col("kind") == kind)


def _attribute(name: str) -> Column:
    value = F.element_at("attributes", name)
    return F.when(value != "", value)


def spans(docs: DataFrame) -> DataFrame:
    """doc, sid, idx, len, kind, id, text, attributes of the tags in the text."""
    rows = docs if "kind" in docs.columns else parsed(docs)
    return rows.where("kind IN ('EVENT', 'TIMEX3')").select("doc", "sid", "idx", "len", "kind", "id", "text", F.map_filter("attributes", lambda k, _: k != "synthetic_eiid").alias("attributes"))


def instances(docs: DataFrame) -> DataFrame:
    names = ["eiid", "eventID", "tense", "aspect", "polarity", "modality", "pos"]
    return _of(docs, "MAKEINSTANCE").select("doc", "ordinal", *[_attribute(n).alias(n) for n in names])


def errors(docs: DataFrame) -> DataFrame:
    """doc, problem, what: documents that aren't well-formed or have several creation times, links that lack an end or name an unknown instance."""
    rows = docs if "kind" in docs.columns else parsed(docs)
    problem = lambda df, name, what: df.select("doc", F.lit(name).alias("problem"), what.alias("what"))
    broken = problem(_of(rows, "ERROR"), "not well-formed", F.col("text"))
    several = problem(_of(rows, "DCT").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1"), "several creation times", F.col("n").cast("string"))
    ends = _of(rows, "TLINK").select("doc", "id", *[_attribute(n).alias(n) for n in ("eventInstanceID", "timeID", "relatedToEventInstance", "relatedToTime")])
    open_ = problem(ends.where("coalesce(eventInstanceID, timeID) IS NULL OR coalesce(relatedToEventInstance, relatedToTime) IS NULL"), "link without two ends", F.col("id"))
    known = events(rows).select("doc", F.explode("eiids").alias("used"))
    used = ends.select("doc", F.explode(F.array_compact(F.array("eventInstanceID", "relatedToEventInstance"))).alias("used")).distinct()
    unknown = problem(used.join(known, ["doc", "used"], "left_anti"), "link of an unknown event", F.col("used"))
    return broken.unionByName(several).unionByName(open_).unionByName(unknown)


def events(docs: DataFrame) -> DataFrame:
    """Events with the ids of their instances and the attributes of the first; one without an instance gets an id of its own, ei and
    its number, with as many 2s after it as make it the document's only one, and no tense and aspect."""
    rows = docs if "kind" in docs.columns else parsed(docs)
    made = instances(rows).groupBy("doc", F.col("eventID").alias("eid")).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("eiid").isNotNull(), F.struct("ordinal", "eiid")))), lambda s: s["eiid"]).alias("eiids"), F.min_by(F.struct("tense", "aspect", "polarity", "modality"), "ordinal").alias("a")
    )
    own = _of(rows, "EVENT").withColumnRenamed("id", "eid").join(made, ["doc", "eid"], "left")
    eiids = F.when(F.size("eiids") > 0, F.col("eiids")).otherwise(F.array(F.element_at("attributes", "synthetic_eiid")))
    none = {"tense": "NONE", "aspect": "NONE", "polarity": "POS", "modality": ""}
    read = [F.when(F.col("a").isNull(), default).otherwise(F.col(f"a.{name}")).alias(name) for name, default in none.items()]
    own = own.withColumn("eiids", eiids)
    return own.select("doc", "sid", "idx", "len", "eid", F.get("eiids", F.lit(0)).alias("id"), "eiids", "text", _attribute("class").alias("cls"), *read)


def timexes(docs: DataFrame) -> DataFrame:
    return spans(docs).where("kind = 'TIMEX3'").select("doc", "sid", "idx", "len", "id", "text", *[_attribute(n).alias(c) for n, c in (("type", "type"), ("value", "value"), ("mod", "mod"), ("functionInDocument", "doc_function"))])


def creation_times(docs: DataFrame) -> DataFrame:
    """doc, id, type, value; of several in a document, which errors() lists, the first counts."""
    rows = _of(docs, "DCT").select("doc", "ordinal", _attribute("tid").alias("id"), _attribute("type").alias("type"), _attribute("value").alias("value"))
    return rows.groupBy("doc").agg(F.min_by(F.struct("id", "type", "value"), "ordinal").alias("t")).select("doc", "t.*")


def links(docs: DataFrame) -> DataFrame:
    """doc, id1, id2, relation, link_type; DURING and IDENTITY count as SIMULTANEOUS here. Links without two ends are in errors()."""
    rows = _of(docs, "TLINK").select("doc", "ordinal", *[_attribute(n).alias(n) for n in ("eventInstanceID", "timeID", "relatedToEventInstance", "relatedToTime", "relType")])
    relation = F.when(F.upper("relType").isin("DURING", "IDENTITY"), "SIMULTANEOUS").otherwise(normalised(F.col("relType")))
    first, second = F.col("eventInstanceID").isNotNull(), F.col("relatedToEventInstance").isNotNull()
    kind = F.when(first & second, "ee").when(first | second, "et").otherwise("tt")
    return rows.select("doc", F.coalesce("eventInstanceID", "timeID").alias("id1"), F.coalesce("relatedToEventInstance", "relatedToTime").alias("id2"), relation.alias("relation"), kind.alias("link_type"), "ordinal").where("id1 IS NOT NULL AND id2 IS NOT NULL")


def written(docs: DataFrame, evs: DataFrame, lnks: DataFrame) -> DataFrame:
    """doc, xml: documents (doc, dct_id, dct_value, markup) with instances of evs and numbered links of lnks."""
    def tags(df: DataFrame, order: str, make) -> DataFrame:
        return df.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), make.alias("t")))).alias("rows"))

    instance = tags(evs, "id", F.format_string('<MAKEINSTANCE eiid="%s" eventID="%s" tense="%s" aspect="%s"/>', "id", "eid", F.coalesce("tense", F.lit("NONE")), F.coalesce("aspect", F.lit("NONE"))))
    end = lambda c, k, e, t: F.when(F.startswith(c, F.lit("t")), F.concat(F.lit(f'{t}="'), c, F.lit('"'))).otherwise(F.concat(F.lit(f'{e}="'), c, F.lit('"')))
    link = tags(lnks, "id1", F.concat_ws(" ", end(F.col("id1"), 1, "eventInstanceID", "timeID"), end(F.col("id2"), 2, "relatedToEventInstance", "relatedToTime"), F.format_string('relType="%s"', "relation")))
    out = docs.join(instance.withColumnRenamed("rows", "made"), "doc", "left").join(link.withColumnRenamed("rows", "tied"), "doc", "left")
    made = F.coalesce(F.array_join(F.transform("made", lambda r: r["t"]), "\n"), F.lit(""))
    tied = F.coalesce(F.array_join(F.transform("tied", lambda r, i: F.concat(F.lit('<TLINK lid="l'), (i + 1).cast("string"), F.lit('" '), r["t"], F.lit("/>"))), "\n"), F.lit(""))
    head = F.format_string('<TimeML>\n<DCT><TIMEX3 tid="%s" type="DATE" value="%s" functionInDocument="CREATION_TIME"/></DCT>\n<TEXT>%s</TEXT>\n', "dct_id", "dct_value", "markup")
    return out.select("doc", F.concat(head, made, F.lit("\n"), tied, F.lit("\n</TimeML>\n")).alias("xml"))


def table_page_pairs(docs: DataFrame) -> DataFrame:
    """doc, sid, id of the events and times of pages with a sentence in each table cell, ids as subscripts."""
    cells = F.filter(F.split("xml", r'<td valign="top">\s*<s>'), lambda c: c.contains("<sub>"))
    rows = docs.select("doc", F.posexplode(cells).alias("sid", "cell"))
    return rows.select("doc", "sid", F.posexplode(F.regexp_extract_all("cell", F.lit(r"<sub>\s*([et]\d+)\s*</sub>"), F.lit(1))).alias("at", "id")).select("doc", "sid", (F.col("at") + 1).alias("idx"), "id")


def page_candidates(docs: DataFrame) -> DataFrame:
    """doc, id1, id2: the pairs of a page to annotate, in the order of its text: each id with t0, with those after it in its sentence and with the next sentence's."""
    ids = table_page_pairs(docs)
    near = pairs.same_or_next(ids).select("doc", "id1", "id2")
    return ids.select("doc", F.col("id").alias("id1"), F.lit("t0").alias("id2")).unionByName(near)


def mention_order(docs: DataFrame) -> DataFrame:
    """doc, id, kind, start of event and time mentions in files that give them by character, in text order."""
    found = F.regexp_extract_all("xml", F.lit(r'(?s)<(?:event|timex2)_mention\b.*?START="\d+"'), F.lit(0))
    rows = docs.select("doc", F.explode(found).alias("m"))
    part = lambda p: F.regexp_extract("m", p, 1)
    return rows.select("doc", part(r'\bID="([^"]*)"').alias("id"), part(r"<(event|timex2)_mention").alias("kind"), part(r'START="(\d+)"').cast("int").alias("start")).orderBy("doc", "start")
