"""Parse trees as nested intervals, in DataFrame operations.

A node's number is its place in pre-order, and last the number of its last descendant: a node holds another exactly if the other's
number lies from its own to its last. Subtrees, dominance and common ancestors are comparisons of integers in joins by
sentence, and paths are slices of the chains of labels from the root to each token, worked out once a sentence. Joins are merges:
tables of nodes look small by their files, and are too large to send to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc", "sid"]


def intervals(sents: DataFrame) -> DataFrame:
    """doc, sid, node, last, parent (-1: none), depth, label, word, span_start, span_end of bracketed trees (doc, sid, parse).

    Tokens count from 1, spans end before span_end; word is that of a tag's one token, null elsewhere. Sentences whose brackets
    don't match, or with words outside them, have no nodes.
    """
    pieces = sents.select(*KEY, F.posexplode(F.regexp_extract_all("parse", F.lit(r"\(|\)|[^\s()]+"), F.lit(0))).alias("k", "p"))
    at = Window.partitionBy(*KEY).orderBy("k")
    upto, sentence = at.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*KEY)
    is_open, is_close = F.col("p") == "(", F.col("p") == ")"
    is_word = ~is_open & ~is_close & (F.coalesce(F.lag("p").over(at), F.lit("")) != "(")
    bracket = lambda c: c.isNotNull() & ~c.isin("(", ")")
    rows = pieces.withColumns({"opens": F.sum(is_open.cast("int")).over(upto), "closes": F.sum(is_close.cast("int")).over(upto), "words": F.sum(is_word.cast("int")).over(upto)})
    rows = rows.withColumns({"next": F.lead("p").over(at), "after": F.lead("p", 2).over(at)})
    rows = rows.withColumn("depth", F.col("opens") - F.col("closes") + is_close.cast("int"))
    rows = rows.withColumn("sound", (F.min("depth").over(sentence) > 0) & (F.max("opens").over(sentence) == F.max("closes").over(sentence))).where("sound")
    # Brackets of a depth open and close in turn.
    level = Window.partitionBy(*KEY, "depth").orderBy("k")
    ends = rows.where(is_open | is_close).withColumns({"end": F.lead(F.struct("opens", "words")).over(level)}).where(is_open)
    word = F.when(bracket(F.col("next")) & bracket(F.col("after")), F.col("after"))
    nodes = ends.select(*KEY, (F.col("opens") - 1).alias("node"), (F.col("end.opens") - 1).alias("last"), "depth", F.when(bracket(F.col("next")), F.col("next")).otherwise("").alias("label"), word.alias("word"), (F.col("words") + 1).alias("span_start"), (F.col("end.words") + 1).alias("span_end"))
    # A node's parent is the last node of the depth above to begin before it.
    mark = F.explode(F.array(F.struct(F.col("depth").alias("of"), F.lit(True).alias("own")), F.struct((F.col("depth") - 1).alias("of"), F.lit(False).alias("own"))))
    before = Window.partitionBy(*KEY, "m.of").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(F.col("m.own"), F.col("node")), ignorenulls=True).over(before)
    found = nodes.withColumn("m", mark).withColumn("parent", F.coalesce(above, F.lit(-1))).where("NOT m.own")
    return found.select(*KEY, *[F.col(c).cast("int").alias(c) for c in ("node", "last", "parent", "depth")], "label", "word", *[F.col(c).cast("int").alias(c) for c in ("span_start", "span_end")])


def leaves(nodes: DataFrame) -> DataFrame:
    """doc, sid, idx, node, parent, token, pos: the tags of tokens."""
    return nodes.where("word IS NOT NULL").select(*KEY, F.col("span_start").alias("idx"), "node", "parent", F.col("word").alias("token"), F.col("label").alias("pos"))


def subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes below each of roots (doc, sid, root), the root itself included, with column root."""
    tops = nodes.select(*KEY, F.col("node").alias("root"), F.col("last").alias("_last")).join(roots.select(*KEY, "root").distinct(), [*KEY, "root"])
    return nodes.join(tops, KEY).where("node BETWEEN root AND _last").drop("_last")


def _words_below(tags: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc, sid, root, words: the words of tags below each of roots in order; a root without any has no row. A sentence's words are gathered once, for all its roots."""
    words = tags.where("word IS NOT NULL").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("node", "word"))).alias("w"))
    tops = nodes.select(*KEY, F.col("node").alias("root"), "last").join(roots.select(*KEY, "root").distinct().hint("merge"), [*KEY, "root"])
    below = F.transform(F.filter("w", lambda x: x["node"].between(F.col("root"), F.col("last"))), lambda x: x["word"])
    return tops.join(words.hint("merge"), KEY).select(*KEY, "root", below.alias("words")).where("size(words) > 0")


def phrases(nodes: DataFrame) -> DataFrame:
    """doc, sid, idx, span_start, span_end, phrase (its node): the phrase that each token's tag stands in."""
    own = nodes.select(*KEY, F.col("node").alias("phrase"), "span_start", "span_end")
    return leaves(nodes).select(*KEY, "idx", F.col("parent").alias("phrase")).join(own.hint("merge"), [*KEY, "phrase"]).select(*KEY, "idx", "span_start", "span_end", "phrase")


def dominance(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """both (doc, sid, idx1, idx2) with dominates and dominated: whether one token's phrase holds the other."""
    side = lambda k: phrases(nodes).select(*KEY, F.col("idx").alias(f"idx{k}"), F.col("span_start").alias(f"_a{k}"), F.col("span_end").alias(f"_b{k}"))
    out = both.join(side(1).hint("merge"), [*KEY, "idx1"], "left").join(side(2).hint("merge"), [*KEY, "idx2"], "left")
    inside = lambda k, i: F.coalesce((F.col(f"idx{i}") >= F.col(f"_a{k}")) & (F.col(f"idx{i}") < F.col(f"_b{k}")), F.lit(False))
    return out.withColumns({"dominates": inside(1, 2), "dominated": inside(2, 1)}).drop("_a1", "_b1", "_a2", "_b2")


def common_ancestors(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """both (doc, sid, node1, node2) with ancestor: the lowest node that holds both, the last in pre-order of those that do."""
    asked = both.select(*KEY, "node1", "node2").distinct()
    own = nodes.select(*KEY, "node", "last")
    found = asked.join(own.hint("merge"), KEY).where("node <= least(node1, node2) AND last >= greatest(node1, node2)").groupBy(*KEY, "node1", "node2").agg(F.max("node").alias("ancestor"))
    return both.join(found.hint("merge"), [*KEY, "node1", "node2"], "left")


def chains(nodes: DataFrame) -> DataFrame:
    """doc, sid, idx, chain: the nodes (node, label) from the root down to each token's tag."""
    tips = leaves(nodes).select(*KEY, "idx", F.col("node").alias("leaf"))
    above = tips.join(nodes.select(*KEY, "node", "last", "label").hint("merge"), KEY).where("leaf BETWEEN node AND last")
    return above.groupBy(*KEY, "idx").agg(F.array_sort(F.collect_list(F.struct("node", "label"))).alias("chain"))


def _shared(one: Column, two: Column) -> Column:
    """How many nodes two chains begin with in common."""
    return F.size(F.filter(F.arrays_zip(one.alias("a"), two.alias("b")), lambda x: F.coalesce(x["a"]["node"] == x["b"]["node"], F.lit(False))))


def _path(one: Column, two: Column, shared: Column) -> Column:
    """Labels from the tip of one chain up to where both part and down to the tip of the other."""
    up = F.reverse(F.slice(one, shared, F.size(one) - shared + 1))
    down = F.slice(two, shared + 1, F.size(two))
    return F.when(shared > 0, F.transform(F.concat(up, down), lambda x: x["label"]))


def paths(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """both (doc, sid, idx1, idx2) with path, labels joined by -, and inner, the same without the tags at both ends."""
    tips = chains(nodes)
    side = lambda k: tips.select(*KEY, F.col("idx").alias(f"idx{k}"), F.col("chain").alias(f"_chain{k}"))
    out = both.join(side(1).hint("merge"), [*KEY, "idx1"], "left").join(side(2).hint("merge"), [*KEY, "idx2"], "left").withColumn("_path", _path(F.col("_chain1"), F.col("_chain2"), _shared(F.col("_chain1"), F.col("_chain2"))))
    inner = F.array_join(F.slice("_path", F.lit(2), F.greatest(F.size("_path") - 2, F.lit(0))), "-")
    return out.withColumns({"path": F.array_join("_path", "-"), "inner": inner}).drop("_chain1", "_chain2", "_path")


def related(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """both (doc, sid, idx1, idx2) with path and inner as paths() has them, dominates and dominated as dominance(), and the tags' ancestor as common_ancestors().

    All follow from the chains of both tokens, which are worked out in a sentence's row: its nodes are shuffled once, its pairs once.
    """
    own = nodes.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("node", "last", "label", "span_start", "span_end", F.col("word").isNotNull().alias("tag")))).alias("n"))
    above = lambda t: F.filter("n", lambda x: (x["node"] <= t["node"]) & (x["last"] >= t["node"]))
    tips = F.transform(F.filter("n", lambda x: x["tag"]), lambda t: F.struct(t["span_start"].alias("idx"), above(t).alias("chain")))
    rows = both.join(own.select(*KEY, tips.alias("_tips")).hint("merge"), KEY, "left")
    chain = lambda k: F.get(F.filter("_tips", lambda x: x["idx"] == F.col(f"idx{k}")), F.lit(0))["chain"]
    one, two = F.col("_chain1"), F.col("_chain2")
    rows = rows.withColumns({"_chain1": chain(1), "_chain2": chain(2)}).withColumn("_shared", _shared(one, two)).withColumn("_path", _path(one, two, F.col("_shared")))
    phrase = lambda c: F.get(c, F.size(c) - 2)
    inside = lambda c, i: F.coalesce((F.col(i) >= phrase(c)["span_start"]) & (F.col(i) < phrase(c)["span_end"]), F.lit(False))
    inner = F.array_join(F.slice("_path", F.lit(2), F.greatest(F.size("_path") - 2, F.lit(0))), "-")
    found = {"path": F.array_join("_path", "-"), "inner": inner, "dominates": inside(one, "idx2"), "dominated": inside(two, "idx1"), "ancestor": F.get(one, F.col("_shared") - 1)["node"]}
    return rows.select(*both.columns, *[c.alias(name) for name, c in found.items()])


def prepositions(nodes: DataFrame) -> DataFrame:
    """doc, sid, idx, preposition: that of the prepositional phrase that a token's phrase, or the clause around it, stands in; others have no row."""
    up = F.reverse(F.slice("chain", F.lit(1), F.greatest(F.size("chain") - 2, F.lit(0))))  # from two above the tag
    rows = chains(nodes).withColumn("up", up).where("size(up) > 0")
    label = lambda i: F.get("up", i)["label"]
    other = F.array_position(F.transform("up", lambda x: x["label"] != F.get("up", F.lit(0))["label"]), F.lit(True)) - 1
    rows = rows.withColumn("at", F.when(label(F.lit(0)) == "PP", F.lit(0).cast("long")).when(other >= 0, other))
    rows = rows.withColumn("at", F.when(label(F.col("at").cast("int")) == "S", F.col("at") + 1).otherwise(F.col("at")).cast("int")).where(label(F.col("at")) == "PP")
    inner = nodes.where("label = 'IN' AND word IS NOT NULL").groupBy(*KEY, F.col("parent").alias("phrase")).agg(F.min_by("word", "node").alias("preposition"))
    return rows.select(*KEY, "idx", F.get("up", F.col("at"))["node"].alias("phrase")).join(inner, [*KEY, "phrase"]).select(*KEY, "idx", "preposition")


def arguments(nodes: DataFrame) -> DataFrame:
    """doc, sid, node, arguments: the labels of a node's siblings in order, joined by colons; a node without any has no row."""
    own = nodes.where("parent >= 0").select(*KEY, "node", "parent", "label")
    other = own.select(*KEY, "parent", F.col("node").alias("_node"), F.col("label").alias("_label"))
    rows = own.join(other.hint("merge"), [*KEY, "parent"]).where("node <> _node").groupBy(*KEY, "node").agg(F.array_sort(F.collect_list(F.struct("_node", "_label"))).alias("a"))
    return rows.select(*KEY, "node", F.array_join(F.transform("a", lambda x: x["_label"]), ":").alias("arguments"))


def verbs(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc, sid, root, verbs: the verbs below each of roots in order, none left out."""
    return _words_below(nodes.where(F.startswith("label", F.lit("VB"))), nodes, roots).select(*KEY, "root", F.col("words").alias("verbs"))


def raw_texts(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc, sid, root, text, tokens: the words below each of roots joined by blanks, and their number."""
    return _words_below(nodes, nodes, roots).select(*KEY, "root", F.array_join("words", " ").alias("text"), F.size("words").alias("tokens"))


def character_offsets(nodes: DataFrame) -> DataFrame:
    """doc, sid, node, offset: where a node begins in its sentence's words joined by single blanks."""
    before = Window.partitionBy(*KEY).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.select(*KEY, "node", F.coalesce(F.sum(F.coalesce(F.length("word") + 1, F.lit(0))).over(before), F.lit(0)).cast("int").alias("offset"))


def in_one_phrase(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """spans (doc, sid, idx, len) with flat: whether the first and the last token's tags stand in the same phrase."""
    tag = leaves(nodes)
    side = lambda k, name: tag.select(*KEY, F.col("idx").alias(name), F.col("parent").alias(f"_p{k}"))
    ends = spans.withColumn("_end", F.col("idx") + F.greatest("len", F.lit(1)) - 1)
    out = ends.join(side(1, "idx"), [*KEY, "idx"], "left").join(side(2, "_end"), [*KEY, "_end"], "left")
    return out.withColumn("flat", F.coalesce(F.col("_p1") == F.col("_p2"), F.lit(False))).select(*spans.columns, "flat")
