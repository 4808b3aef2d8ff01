"""From texts to tokens, time expressions, tenses and features, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import is_event_tag

#: Words without the n't, 's, 're, ... that end them, numbers with what joins and ends them, and any other character but blanks.
TOKEN = (
    r"[AaPp]\.[Mm]\.|[A-Za-z\u00C0-\u024F]+(?=n't\b)|n't\b|'(?:s|re|ve|ll|d|m)\b|o'clock\b|[A-Za-z\u00C0-\u024F]+"
    r"|\d+(?:[./:-]\d+)*(?:(?:st|nd|rd|th|s)\b)?|[^\sA-Za-z\u00C0-\u024F\d]"
)
#: Where a sentence ends: at a line's end, and after . ! or ? before blanks and a capital or quotation mark.
SENTENCE_END = r"((?<=\S)\s*\n\s*|(?<=[.!?])\s+(?=[A-Z\"']))"
_CUT = "\uFDD0"  # a noncharacter, which no text holds


def _sentences(text: Column) -> Column:
    """The sentences of a text with the blanks that follow them: joined, they are the text."""
    return F.split(F.regexp_replace(text, SENTENCE_END, f"$1{_CUT}"), _CUT, -1)


def sentences(docs: DataFrame) -> DataFrame:
    """doc, sid, text of docs (doc, text): ends after . ! or ? before a blank and a capital, or at a line's end."""
    parts = F.filter(F.transform(_sentences(F.col("text")), lambda s: F.regexp_replace(s, r"\s+$", "")), lambda s: s != "")
    return docs.select("doc", F.posexplode(parts).alias("sid", "text"))


def tokens(sents: DataFrame) -> DataFrame:
    """doc, sid, idx (from 1), token of sents (doc, sid, text)."""
    return sents.select("doc", "sid", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("at", "token")).select("doc", "sid", (F.col("at") + 1).alias("idx"), "token")


def token_lists(docs: DataFrame) -> DataFrame:
    """docs (doc, text, more) with tokens: sid, idx, before (the gap within its sentence), token, after of a text's tokens in order."""
    parts = F.filter(_sentences(F.col("text")), lambda s: F.regexp_like(s, F.lit(r"\S")))
    cut = F.transform(parts, lambda s: F.struct(F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)).alias("w"), F.split(s, TOKEN, -1).alias("gaps")))
    zipped = lambda x: F.arrays_zip(x["w"].alias("token"), F.slice(x["gaps"], F.lit(1), F.size(x["w"])).alias("before"), F.slice(x["gaps"], F.lit(2), F.size(x["w"])).alias("after"))
    named = lambda t, sid, at: F.struct(sid.alias("sid"), (at + 1).alias("idx"), t["before"].alias("before"), t["token"].alias("token"), t["after"].alias("after"))
    return docs.withColumn("tokens", F.flatten(F.transform(cut, lambda x, sid: F.transform(zipped(x), lambda t, at: named(t, sid, at)))))


def token_table(docs: DataFrame) -> DataFrame:
    """doc, sid, idx, before, token, after, start of docs (doc, text): tokens with the blanks around them and their places.

    The first before and all tokens with what follows them, joined in order, give back the text; start counts code points from 0. sid
    and idx are those of sentences() and tokens(). A null text, or one of blanks alone, has no tokens.
    """
    each = token_lists(docs).select("doc", F.explode("tokens").alias("t")).select("doc", "t.sid", (F.col("t.idx") - 1).alias("at"), "t")
    order = Window.partitionBy("doc").orderBy("sid", "at")  # a document's tokens
    to_here = order.rowsBetween(Window.unboundedPreceding, -1)
    lead = F.first(F.length("t.before")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    start = F.coalesce(F.sum(F.length("t.token") + F.length("t.after")).over(to_here), F.lit(0)) + lead
    before = F.when(F.col("at") == 0, F.coalesce(F.lag("t.after").over(order), "t.before")).otherwise(F.col("t.before"))
    return each.select("doc", "sid", (F.col("at") + 1).alias("idx"), before.alias("before"), "t.token", "t.after", start.cast("int").alias("start"))


def joined(tokens: Column) -> Column:
    """The text of all tokens (before, token, after) of a document, in order."""
    return F.concat(F.get(tokens, F.lit(0))["before"], F.array_join(F.transform(tokens, lambda x: F.concat(x["token"], x["after"])), ""))


def joined_text(toks: DataFrame) -> DataFrame:
    """doc, text: what token_table() was made of."""
    rows = toks.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("sid", "idx", "before", "token", "after"))).alias("t"))
    return rows.select("doc", joined(F.col("t")).alias("text"))


# What treebank tokens write in place of brackets and quotation marks.
WRITTEN = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}", "``": '"', "''": '"'}


def _written(token: Column) -> Column:
    """A token as the text has it, without blanks."""
    written = token
    for name, text in WRITTEN.items():
        written = F.when(token == name, F.lit(text)).otherwise(written)
    return F.regexp_replace(written, r"\s+", "")


def _ink(token: Column) -> Column:
    return F.length(_written(token))


def _inked(toks: DataFrame, *keep: str) -> DataFrame:
    """doc, low, high and kept columns: each token's characters, counted through the document without its blanks."""
    order = Window.partitionBy("doc").orderBy("sid", "idx")
    high = F.sum(_ink(F.col("token"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return toks.withColumn("high", high).withColumn("low", F.col("high") - _ink(F.col("token"))).select("doc", "low", "high", *keep)


def aligned(spans: DataFrame, own: DataFrame, foreign: DataFrame, sound: bool = False) -> DataFrame:
    """spans (doc, sid, idx, len, ...) over own tokens, with sid, idx and len in the numbers of foreign tokens of the same texts.

    Both are tables of doc, sid, idx, token. Tokenisers differ in where they cut, not in the characters that aren't blank: counted
    without blanks, places in both are the same. One sorted sweep a document finds the foreign tokens at each span's ends; a span
    gets all that it touches. A document whose characters differ keeps no spans: misaligned() lists those; sound: none of them has spans.
    Joins are merges: tables of tokens look small by their files, and are too large for the driver.
    """
    if not sound:
        spans = spans.join(misaligned(own, foreign).select("doc").hint("merge"), "doc", "left_anti")
    ends = _inked(own, "sid", "idx")
    first, last = ends.select("doc", "sid", "idx", F.col("low").alias("a")), ends.select("doc", "sid", F.col("idx").alias("_last"), F.col("high").alias("b"))
    places = spans.select("doc", "sid", "idx", "len").distinct().withColumn("_last", F.col("idx") + F.greatest(F.col("len"), F.lit(1)) - 1)
    place = F.struct("sid", "idx", "len")
    places = places.join(first.hint("merge"), ["doc", "sid", "idx"]).join(last.hint("merge"), ["doc", "sid", "_last"]).select("doc", place.alias("place"), "a", "b")
    token = F.struct(F.col("sid").cast("int").alias("sid"), F.col("idx").cast("int").alias("idx"))
    none = lambda like: F.lit(None).cast(like)
    kind = places.schema["place"].dataType
    marks = _inked(foreign.withColumn("token_place", token), "token_place").select("doc", F.col("low").alias("at"), F.lit(0).alias("kind"), F.col("token_place").alias("token"), none(kind).alias("place"))
    edges = places.select("doc", "place", F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("a").alias("at")), F.struct(F.lit(2).alias("kind"), (F.col("b") - 1).alias("at")))).alias("e"))
    edges = edges.select("doc", "e.at", "e.kind", none("struct<sid:int,idx:int>").alias("token"), "place")
    # The foreign token that a character is in is the last one to begin up to it.
    sweep = Window.partitionBy("doc").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(edges).withColumn("token", F.last("token", ignorenulls=True).over(sweep)).where("kind > 0")
    end = lambda k: F.max(F.when(F.col("kind") == k, F.col("token")))
    both = found.groupBy("doc", "place").agg(end(1).alias("first"), end(2).alias("last")).select("doc", "place.*", "first", "last")
    ending = foreign.groupBy("doc", F.col("sid").cast("int").alias("_sid")).agg(F.max("idx").cast("int").alias("_end"))
    out = spans.join(both.hint("merge"), ["doc", "sid", "idx", "len"]).withColumn("_sid", F.col("first.sid")).join(ending.hint("merge"), ["doc", "_sid"])
    until = F.when(F.col("last.sid") == F.col("_sid"), F.col("last.idx")).otherwise(F.col("_end"))
    names = {"sid": F.col("_sid"), "idx": F.col("first.idx"), "len": (until - F.col("first.idx") + 1).cast("int")}
    return out.select(*[(names[c] if c in names else F.col(c)).alias(c) for c in spans.columns])


def misaligned(own: DataFrame, foreign: DataFrame) -> DataFrame:
    """doc, own, foreign: documents whose tokens have different numbers of characters (null: no tokens at all), or other letters and digits."""

    def total(toks: DataFrame, name: str) -> DataFrame:
        letters = F.regexp_replace(_written(F.col("token")), r"[^0-9A-Za-z\u00C0-\u024F]", "")
        rows = toks.groupBy("doc").agg(F.sum(_ink(F.col("token"))).alias(name), F.array_sort(F.collect_list(F.struct("sid", "idx", letters.alias("l")))).alias("t"))
        return rows.select("doc", name, F.xxhash64(F.array_join(F.transform("t", lambda x: x["l"]), "")).alias(f"{name}_letters"))  # a document's tokens

    both = total(own, "own").join(total(foreign, "foreign"), "doc", "full")
    return both.where(~F.col("own").eqNullSafe(F.col("foreign")) | ~F.col("own_letters").eqNullSafe(F.col("foreign_letters"))).select("doc", "own", "foreign")


def tagged_timexes(sents: DataFrame, dcts: DataFrame) -> DataFrame:
    """doc, sid, idx, len, id, text, type, value, mod of the time expressions in sents (doc, sid, text), as timegrammar.found()."""
    from chronoweave.operators import timegrammar

    both = {"tokens": F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), "gaps": F.split("text", TOKEN, -1)}
    return timegrammar.found(sents.withColumns(both).select("doc", "sid", "tokens", "gaps"), dcts)


def outside(timexes: DataFrame, events: DataFrame) -> DataFrame:
    """Time expressions that hold no event's token."""
    taken = timexes.withColumn("at", F.explode(F.sequence(F.col("idx"), F.col("idx") + F.greatest("len", F.lit(1)) - 1)))
    hit = taken.join(events.select("doc", "sid", F.col("idx").alias("at")).hint("merge"), ["doc", "sid", "at"]).select("doc", "id").distinct()
    return timexes.join(hit.hint("merge"), ["doc", "id"], "left_anti")


def events_outside(events: DataFrame, timexes: DataFrame) -> DataFrame:
    taken = timexes.select("doc", "sid", F.explode(F.sequence(F.col("idx"), F.col("idx") + F.greatest("len", F.lit(1)) - 1)).alias("idx"))
    return events.join(taken, ["doc", "sid", "idx"], "left_anti")


def rule_events(tagged: DataFrame) -> DataFrame:
    """Verbs of tagged (doc, sid, idx, token, pos) that no other verb follows, numbered through the document."""
    w = Window.partitionBy("doc", "sid").orderBy("idx")
    own = tagged.withColumn("next", F.lead("pos").over(w)).where(is_event_tag(F.col("pos")) & F.startswith("pos", F.lit("VB")) & ~F.startswith(F.coalesce("next", F.lit("")), F.lit("VB")))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("sid", "idx")).cast("string")
    return own.select("doc", "sid", "idx", F.concat(F.lit("e"), n).alias("eid"), F.concat(F.lit("ei"), n).alias("id"), F.col("token").alias("text"), "pos")


def group_tense(tagged: DataFrame) -> DataFrame:
    """doc, sid, idx, tense of each verb, from the run of verbs, TO and adverbs that ends in it and the word before that run.

    will and wo before it make a run FUTURE; a run that begins with a past form, or with a base form and a past participle,
    is PAST; should, shall and could before it make any other FUTURE; other modals leave it open (null); the rest is PRESENT.
    """
    w = Window.partitionBy("doc", "sid").orderBy("idx")
    part = F.regexp_like("pos", F.lit("^(VB|TO|RB)"))
    runs = tagged.withColumns({"run": F.sum((~part).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "word_before": F.lag("token").over(w), "tag_before": F.lag("pos").over(w)}).where(part)
    run = Window.partitionBy("doc", "sid", "run").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    verbs = F.collect_list(F.when(F.startswith("pos", F.lit("VB")), F.col("pos"))).over(run)
    own = runs.withColumns({"verbs": verbs, "word": F.first("word_before").over(run), "tag": F.first("tag_before").over(run)}).where(F.startswith("pos", F.lit("VB")))
    first, second = F.get("verbs", F.lit(0)), F.get("verbs", F.lit(1))
    modal, word = F.coalesce(F.col("tag") == "MD", F.lit(False)), F.coalesce("word", F.lit(""))
    tense = (
        F.when(modal & word.isin("will", "wo"), "FUTURE").when((first == "VBD") | ((first == "VB") & F.coalesce(second == "VBN", F.lit(False))), "PAST")
        .when(word.isin("should", "shall", "could"), "FUTURE").when(~modal, "PRESENT")
    )
    return own.select("doc", "sid", "idx", tense.alias("tense"))


def with_modal_future(events: DataFrame, deps: DataFrame) -> DataFrame:
    """Events with an auxiliary modal are FUTURE."""
    modal = deps.where((F.col("reln") == "aux") & F.lower("dep").isin("would", "could", "might", "may", "should", "'d", "will")).select("doc", "sid", F.col("gov_idx").alias("idx"), F.lit(True).alias("modal")).distinct()
    return events.join(modal, ["doc", "sid", "idx"], "left").withColumn("tense", F.when(F.col("modal"), "FUTURE").otherwise(F.col("tense"))).drop("modal")


def creation_day(timexes: DataFrame, how: str = "first") -> DataFrame:
    """doc, value: the first day named in the document ("first"), the commonest ("common", the last first seen of those tied), the value
    of its first DATE ("date"), or the day that this runs on ("today")."""
    if how == "today":
        return timexes.select("doc").distinct().withColumn("value", F.current_date().cast("string"))
    if how == "date":
        return timexes.where("type = 'DATE'").groupBy("doc").agg(F.min_by("value", F.struct("sid", "idx")).alias("value"))
    day = F.regexp_extract("value", r"^(\d{4}-\d\d-\d\d)", 1)
    days = timexes.withColumn("day", day).where("day <> ''")
    if how == "first":
        return days.groupBy("doc").agg(F.min_by("day", F.struct("sid", "idx")).alias("value"))
    counted = days.groupBy("doc", "day").agg(F.count("*").alias("n"), F.min(F.struct("sid", "idx")).alias("seen"))
    return counted.groupBy("doc").agg(F.max_by("day", F.struct("n", "seen")).alias("value"))


def ngram_features(toks: DataFrame, n: int = 3) -> DataFrame:
    """doc, sid, idx, features: the token and those before and after it, as strings."""
    w = Window.partitionBy("doc", "sid").orderBy("idx")
    edge = lambda by: F.lag(F.lower("token"), by).over(w) if by >= 0 else F.lead(F.lower("token"), -by).over(w)
    back = [F.concat_ws("_", F.lit(f"TOKEN{k}"), *[F.coalesce(edge(j), F.lit("<s>")) for j in range(k, -1, -1)]) for k in range(n)]
    around = [F.concat_ws("_", F.lit(f"PRE{k}"), F.coalesce(edge(k), F.lit("<s>"))) for k in (1, 2)] + [F.concat_ws("_", F.lit(f"POST{k}"), F.coalesce(edge(-k), F.lit("</s>"))) for k in (1, 2)]
    return toks.select("doc", "sid", "idx", F.array(*back, *around).alias("features"))


def pair_features(both: DataFrame, between: DataFrame | None = None) -> DataFrame:
    """doc, id1, id2, features of pairs with attributes text, pos, tense, aspect, cls of both sides, where they have them."""
    names = [c for c in ("text", "pos", "tense", "aspect", "cls", "type", "value") if f"{c}1" in both.columns or f"{c}2" in both.columns]
    one = [F.concat(F.lit(f"{c.upper()}{k}-"), F.col(f"{c}{k}").cast("string")) for c in names for k in (1, 2) if f"{c}{k}" in both.columns]
    two = [F.concat(F.lit(f"{c.upper()}-"), F.col(f"{c}1"), F.lit("_"), F.col(f"{c}2")) for c in names if f"{c}1" in both.columns and f"{c}2" in both.columns]
    same = [F.concat(F.lit(f"{c.upper()}MATCH-"), (F.col(f"{c}1") == F.col(f"{c}2")).cast("string")) for c in ("tense", "aspect", "cls") if f"{c}1" in both.columns and f"{c}2" in both.columns]
    place = [F.when(F.col("sid1") == F.col("sid2"), F.when(F.col("idx1") < F.col("idx2"), "ORDER-before").otherwise("ORDER-after")).otherwise("ORDER-far")] if "sid2" in both.columns else []
    out = both.select("doc", "id1", "id2", F.array_compact(F.array(*one, *two, *same, *place)).alias("features"))
    if between is None:
        return out
    return out.join(between.select("doc", "id1", "id2", F.col("features").alias("more")), ["doc", "id1", "id2"], "left").withColumn("features", F.concat("features", F.coalesce("more", F.array().cast("array<string>")))).drop("more")


def frequent_features(rows: DataFrame, least: int) -> DataFrame:
    """rows with the features that occur least times or more; the counts are added up by task first."""
    each = rows.select("doc", "id1", "id2", F.explode("features").alias("f"))
    often = each.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("f")
    kept = each.join(often, "f", "left_semi").groupBy("doc", "id1", "id2").agg(F.sort_array(F.collect_list("f")).alias("kept"))
    return rows.join(kept, ["doc", "id1", "id2"], "left").withColumn("features", F.coalesce("kept", F.array().cast("array<string>"))).drop("kept")


def marked_up(toks: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, sid, markup: tokens (before, token) with tags around spans (doc, sid, idx, len, name, id). & < > are escaped."""
    opened = spans.groupBy("doc", "sid", "idx").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("len")).alias("n"), "name", "id"))), lambda s: F.concat(F.lit("<"), s["name"], F.lit(' id="'), s["id"], F.lit('">')))).alias("open"))
    closed = spans.withColumn("idx", F.col("idx") + F.col("len") - 1).groupBy("doc", "sid", "idx").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("len", "name"))), lambda s: F.concat(F.lit("</"), s["name"], F.lit(">")))).alias("close"))
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    before = F.coalesce(F.col("before"), F.lit("")) if "before" in toks.columns else F.when(F.col("idx") > 1, " ").otherwise("")
    both = toks.join(opened, ["doc", "sid", "idx"], "left").join(closed, ["doc", "sid", "idx"], "left")
    piece = F.concat(before, F.coalesce("open", F.lit("")), escaped, F.coalesce("close", F.lit("")))
    return both.groupBy("doc", "sid").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("idx", piece.alias("p")))), lambda s: s["p"])).alias("markup"))


def marked_texts(toks: DataFrame, events: DataFrame, timexes: DataFrame, element: str = "EVENT", id_name: str = "eid", numeric: bool = False, attributes: tuple[str, ...] = ("tense", "aspect", "class")) -> DataFrame:
    """doc, markup: the texts of token_table() with elements around events and times.

    element and id_name name an event's element and its id; numeric takes the letter off the id; attributes are those shown of tense,
    aspect and class (column cls). & in the text is escaped.
    """
    shown = {"tense": "tense", "aspect": "aspect", "class": "cls"}
    name = F.when(F.lit(numeric), F.regexp_replace("eid", "^e", "")).otherwise(F.col("eid"))
    parts = [F.concat(F.lit(f' {a}="'), F.coalesce(F.col(shown[a]).cast("string"), F.lit("NONE")), F.lit('"')) for a in attributes]
    events = events.groupBy("doc", "sid", "idx").agg(F.min(F.concat(F.lit(f'<{element} {id_name}="'), name, F.lit('"'), *parts, F.lit(">"))).alias("event"))
    kind = F.concat(*[F.coalesce(F.concat(F.lit(f' {a}="'), F.col(c).cast("string"), F.lit('"')), F.lit("")) for a, c in (("tid", "id"), ("type", "type"), ("value", "value"))])
    opened = timexes.groupBy("doc", "sid", "idx").agg(F.min(F.concat(F.lit("<TIMEX3"), kind, F.lit(">"))).alias("time"))
    closed = timexes.select("doc", "sid", (F.col("idx") + F.greatest("len", F.lit(1)) - 1).alias("idx"), F.lit("</TIMEX3>").alias("end")).distinct()
    key = ["doc", "sid", "idx"]
    rows = toks.join(events, key, "left").join(opened, key, "left").join(closed, key, "left")
    none = F.lit("")
    piece = F.concat(F.coalesce("event", none), F.coalesce("time", none), F.replace("token", F.lit("&"), F.lit("&amp;")), F.when(F.col("event").isNotNull(), f"</{element}>").otherwise(""), F.coalesce("end", none), "after")
    own = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("sid", "idx", "before", piece.alias("piece")))).alias("t"))
    return own.select("doc", F.concat(F.get("t", F.lit(0))["before"], F.array_join(F.transform("t", lambda x: x["piece"]), "")).alias("markup"))
