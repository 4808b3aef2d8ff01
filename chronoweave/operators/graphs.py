"""Parse trees, dependency paths and hypernyms."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.scratch import clear, written

NODES = "doc string, sid int, node int, parent int, label string, word string, span_start int, span_end int"


def parsed(tree: str) -> list[tuple[int, int, str, str | None, int, int]]:
    """node, parent, label, word and token span [start, end), tokens from 1, of a bracketed tree; none if it is broken."""
    rows: list[list] = []
    stack: list[int] = []
    token, label_next = 0, False
    for part in tree.replace("(", " ( ").replace(")", " ) ").split():
        if part == "(":
            rows.append([len(rows), stack[-1] if stack else -1, "", None, token + 1, token + 1])
            stack.append(len(rows) - 1)
            label_next = True
        elif part == ")":
            if not stack:
                return []
            rows[stack.pop()][5] = token + 1
            label_next = False
        elif not stack:
            return []
        elif label_next:
            rows[stack[-1]][2], label_next = part, False
        else:
            token += 1
            rows[stack[-1]][3] = part
    return [] if stack else [tuple(r) for r in rows]


def tree_nodes(sents: DataFrame) -> DataFrame:
    """The nodes of each sentence's tree (doc, sid, parse)."""
    schema = pa.schema([("doc", pa.string()), ("sid", pa.int32()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("word", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = [(r["doc"], r["sid"], *n) for r in batch.to_pylist() for n in parsed(r["parse"] or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return sents.select("doc", "sid", "parse").mapInArrow(run, NODES)


def tagged(nodes: DataFrame) -> DataFrame:
    """doc, sid, idx, token, pos: the leaves."""
    return nodes.where("word IS NOT NULL").select("doc", "sid", F.col("span_start").alias("idx"), F.col("word").alias("token"), F.col("label").alias("pos"))


def head_spans(nodes: DataFrame) -> DataFrame:
    """doc, sid, idx, span_start, span_end: the phrase around each leaf, from its grandparent."""
    leaf = nodes.where("word IS NOT NULL").select("doc", "sid", F.col("span_start").alias("idx"), F.col("parent").alias("node"))
    return leaf.join(nodes.select("doc", "sid", "node", "span_start", "span_end"), ["doc", "sid", "node"]).select("doc", "sid", "idx", "span_start", "span_end")


def dependency_paths(deps: DataFrame, wanted: DataFrame, longest: int | None = None) -> DataFrame:
    """doc, sid, from_idx, to_idx, path, length: the shortest path of dependencies, -> down and <- up.

    deps: doc, sid, reln, gov_idx, dep_idx; wanted: doc, sid, from_idx, to_idx. A sentence's graph is small
    and is searched breadth first to its end; paths beyond longest steps, if given, are left out.
    """
    edges = deps.groupBy("doc", "sid").agg(F.sort_array(F.collect_list(F.struct("gov_idx", "dep_idx", "reln"))).alias("edges"))
    asked = wanted.groupBy("doc", "sid").agg(F.collect_set(F.struct("from_idx", "to_idx")).alias("asked"))
    schema = pa.schema([("doc", pa.string()), ("sid", pa.int32()), ("from_idx", pa.int32()), ("to_idx", pa.int32()), ("path", pa.string()), ("length", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                near: dict[int, list[tuple[int, str]]] = {}
                for e in r["edges"]:
                    near.setdefault(e["gov_idx"], []).append((e["dep_idx"], f"->{e['reln']}"))
                    near.setdefault(e["dep_idx"], []).append((e["gov_idx"], f"<-{e['reln']}"))
                for a in r["asked"]:
                    seen, queue = {a["from_idx"]: ""}, deque([(a["from_idx"], 0)])
                    while queue and a["to_idx"] not in seen:
                        at, n = queue.popleft()
                        for to, step in near.get(at, []) if longest is None or n < longest else []:
                            if to not in seen:
                                seen[to] = seen[at] + step
                                queue.append((to, n + 1))
                    if path := seen.get(a["to_idx"]):
                        rows.append({"doc": r["doc"], "sid": r["sid"], **a, "path": path, "length": path.count("->") + path.count("<-")})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return edges.join(asked, ["doc", "sid"]).mapInArrow(run, "doc string, sid int, from_idx int, to_idx int, path string, length int")


def direct_paths(paths: DataFrame) -> DataFrame:
    """The rows of dependency_paths() that never turn: down all the way, or one step up."""
    return paths.where(~F.substring("path", 2, 1_000_000).contains("<-") & (F.startswith("path", F.lit("->")) | (F.col("length") == 1)))


def ancestors(hypernyms: DataFrame) -> DataFrame:
    """child, ancestor, distance: all that the first hypernym pointers lead to, as a table. hypernyms: child, parent, ordinal.

    Pointers are doubled: a round joins the pairs that lie as far apart as it has come with those that are known, so a chain of n
    synsets takes log n rounds, each of which is written. Pointers that lead back where they came from end there.
    """
    first = hypernyms.where("child <> parent").groupBy("child").agg(F.min_by("parent", F.struct("ordinal", "parent")).alias("ancestor"))
    known, reach = [written(first.withColumn("distance", F.lit(1).cast("long")), "ancestors")], 1
    while True:
        every = known[0]
        for table in known[1:]:
            every = every.unionByName(table)
        far = every.where(F.col("distance") == reach).select("child", F.col("ancestor").alias("via"), F.col("distance").alias("d"))
        near = every.select(F.col("child").alias("via"), "ancestor", "distance")
        new = far.join(near, "via").where("child <> ancestor").groupBy("child", "ancestor").agg(F.min(F.col("d") + F.col("distance")).alias("distance"))
        new = written(new.join(every, ["child", "ancestor"], "left_anti"), "ancestors")
        if new.isEmpty():
            clear(hypernyms.sparkSession, new)
            return every
        known.append(new)
        reach *= 2


def is_a(words: DataFrame, senses: DataFrame, hypernyms: DataFrame, targets: list[str], names: DataFrame) -> DataFrame:
    """words (lemma) with a sense below a synset named one of targets. senses: lemma, synset; names: synset, name."""
    up = ancestors(hypernyms).select("child", "ancestor").union(senses.select(F.col("synset").alias("child"), F.col("synset").alias("ancestor")))
    wanted = names.where(F.col("name").isin(*targets)).select(F.col("synset").alias("ancestor"))
    hit = senses.join(up, senses.synset == up.child).join(wanted, "ancestor", "left_semi").select("lemma").distinct()
    return words.join(hit, "lemma", "left_semi")


# The synset names that each lexical predicate looks for among a word's ancestors.
PREDICATES = {
    "person_or_group": ["person", "social_group"], "location": ["location", "road"], "physical_object": ["physical_object"], "time": ["time_period", "time", "time_unit"],
    "structure": ["structure"], "integer": ["integer"], "material": ["material"], "measure": ["measure"], "event": ["event"],
}


def shared_senses(words: DataFrame, senses: DataFrame) -> DataFrame:
    """words (doc, id, lemma) with synsets, the array of their senses."""
    each = senses.groupBy("lemma").agg(F.sort_array(F.collect_set("synset")).alias("synsets"))
    return words.join(each, "lemma", "left").withColumn("synsets", F.coalesce("synsets", F.array().cast("array<string>")))


def _tree(rows: list[tuple]) -> tuple[list[list[int]], dict[int, int]]:
    """Children of each node, and the leaf that stands at each token."""
    below: list[list[int]] = [[] for _ in rows]
    for node, parent, *_ in rows:
        if parent >= 0:
            below[parent].append(node)
    return below, {r[4]: r[0] for r in rows if r[3] is not None}


def main_verb(rows: list[tuple]) -> int | None:
    """The token of a clause's main verb: the last verb of the innermost verb phrase; only plain and inverted clauses have one."""
    below, _ = _tree(rows)
    label = lambda n: rows[n][2]
    at = 0
    if rows and label(0) in ("ROOT", "") and len(below[0]) == 1:
        at = below[0][0]
    while rows and label(at) in ("S", "SINV"):
        phrase = next((n for n in below[at] if label(n) == "VP"), None)
        if phrase is None:
            if not below[at] or label(below[at][0]) != "S":
                return None
            at = below[at][0]
            continue
        while (inner := next((n for n in below[phrase] if label(n) == "VP"), None)) is not None:
            phrase = inner
        verbs = [n for n in below[phrase] if label(n).startswith("VB")]
        return rows[verbs[-1]][4] if verbs else None
    return None


def _up(rows: list[tuple], node: int) -> list[int]:
    out = [node]
    while rows[out[-1]][1] >= 0:
        out.append(rows[out[-1]][1])
    return out


def path_to_clause(rows: list[tuple], token: int) -> str | None:
    """Labels from the nearest clause (S or SBAR), or the root, down to a token's tag."""
    _, leaf = _tree(rows)
    if token not in leaf:
        return None
    labels = []
    for n in _up(rows, leaf[token]):
        labels.append(rows[n][2])
        if len(labels) > 1 and labels[-1] in ("S", "SBAR"):
            break
    return "-".join(reversed(labels))


def path_between(rows: list[tuple], a: int, b: int) -> str | None:
    """Labels from one token's tag up to the node that holds both (+) and down to the other's (-)."""
    _, leaf = _tree(rows)
    if a not in leaf or b not in leaf:
        return None
    up, down = _up(rows, leaf[a]), _up(rows, leaf[b])
    shared = next(n for n in up if n in down)
    return "+".join(rows[n][2] for n in up[: up.index(shared) + 1]) + "".join("-" + rows[n][2] for n in reversed(down[: down.index(shared)]))


def preposition_of(rows: list[tuple], token: int) -> str | None:
    """The preposition whose phrase a token's phrase, or the clause around it, is."""
    _, leaf = _tree(rows)
    above = _up(rows, leaf[token])[2:] if token in leaf else []
    if above and rows[above[0]][2] != "PP":
        first = rows[above[0]][2]
        while above and rows[above[0]][2] == first:
            above = above[1:]
    if above and rows[above[0]][2] == "S":
        above = above[1:]
    if not above or rows[above[0]][2] != "PP":
        return None
    return next((r[3] for r in rows if r[1] == above[0] and r[2] == "IN"), None)


def flat_phrases(rows: list[tuple], label: str = "NP") -> list[tuple[int, int]]:
    """Spans of phrases of a label that hold no other such phrase."""
    inside = {m for r in rows if r[2] == label for m in _up(rows, r[0])[1:]}
    return [(r[4], r[5]) for r in rows if r[2] == label and r[0] not in inside]


def tree_facts(sents: DataFrame) -> DataFrame:
    """doc, sid, idx, token, pos, path, preposition, is_main of every token of parsed sentences (doc, sid, parse)."""
    schema = pa.schema([("doc", pa.string()), ("sid", pa.int32()), ("idx", pa.int32()), ("token", pa.string()), ("pos", pa.string()), ("path", pa.string()), ("preposition", pa.string()), ("is_main", pa.bool_())])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows = parsed(r["parse"] or "")
                main = main_verb(rows)
                out += [{"doc": r["doc"], "sid": r["sid"], "idx": n[4], "token": n[3], "pos": n[2], "path": path_to_clause(rows, n[4]), "preposition": preposition_of(rows, n[4]), "is_main": n[4] == main} for n in rows if n[3] is not None]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return sents.select("doc", "sid", "parse").mapInArrow(run, "doc string, sid int, idx int, token string, pos string, path string, preposition string, is_main boolean")
