"""Transitive closure of temporal links, document by document.

closure() works on all documents at once: each round joins what is new with all there is and keeps, for a
pair not linked yet, one relation by a rule that doesn't depend on row order. extended() does the same for links that join a closed
set. closure_in_order() and closure_by_stamps() derive in the order of the links, which matters where a pair can be derived with
two relations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.relations import COMPOSITION, INVERSE_PAIRS, canonical, composition, inverted, status
from chronoweave.scratch import clear, numbered, written

COMPOSED = sorted({r for row in COMPOSITION for r in row})
LINK = ["doc", "id1", "id2", "relation"]
SCHEMA = "doc string, id1 string, id2 string, relation string, closed boolean"
#: Documents of so many ids at most are closed in one group each: a task then holds tables of their pairs, some 60 bytes a pair.
GROUPED = 1024


def _both_ways(links: DataFrame) -> DataFrame:
    forward = links.select("doc", F.col("id1").alias("src"), F.col("id2").alias("dst"), "relation")
    return forward.union(links.select("doc", "id2", "id1", inverted(F.col("relation"))))


def _reduced(links: DataFrame) -> DataFrame:
    """doc, id1, id2, relation: links with ids, the first by (id1, id2, relation) of each pair."""
    given = canonical(links.where("id1 IS NOT NULL AND id2 IS NOT NULL AND id1 <> id2"))
    return given.groupBy("doc", "lo", "hi").agg(F.min(F.struct("id1", "id2", "relation")).alias("l")).select("doc", "l.id1", "l.id2", "l.relation")


def _pairs_of(links: DataFrame) -> DataFrame:
    return links.select("doc", F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi"))


def united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def extended(base: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """What follows when new links join base, links that are closed already: tables of doc, id1, id2, relation, one a round.

    Only what is new is joined with all there is, and only what it adds is written: the work follows the new links and
    their consequences. base and new must be tables, with one link a pair between them. Of two relations
    derivable for a pair in one round the first by name, in id order, stays.
    """
    rules = F.broadcast(composition(new.sparkSession))  # always 17 rows
    side = lambda df, a, b, r: df.select("doc", F.col("src").alias(a), F.col("dst").alias(b), F.col("relation").alias(r))
    composed = lambda df: _both_ways(df.where(F.col("relation").isin(*COMPOSED)).select(*LINK))
    known, delta, out = [t.select(*LINK) for t in (*base, new)], new.select(*LINK), []
    while True:
        # new o all, and its mirror all o new, which is the converse of the first and needs no join of its own.
        every = united(known)
        steps = side(composed(delta), "x", "m", "r1").join(side(composed(every), "m", "y", "r2"), ["doc", "m"]).where("x <> y").join(rules, ["r1", "r2"])
        found = canonical(steps.select("doc", F.col("x").alias("id1"), F.col("y").alias("id2"), F.col("r3").alias("relation")))
        found = found.groupBy("doc", "lo", "hi").agg(F.min("rel").alias("relation"))
        added = found.join(_pairs_of(every), ["doc", "lo", "hi"], "left_anti")
        delta = written(added.select("doc", F.col("lo").alias("id1"), F.col("hi").alias("id2"), "relation"), "closure")
        if delta.isEmpty():
            clear(new.sparkSession, delta)
            return out
        known.append(delta)
        out.append(delta)


def closure(links: DataFrame) -> DataFrame:
    """links (doc, id1, id2, relation) and all that follow from them (closed = true), one for each pair.

    Links of relations that don't compose are kept and block their pairs. Of two relations derivable for a
    pair in one round the first by name, in id order, stays. The first row of repeated input pairs by
    (id1, id2, relation) stays; null ids don't count.
    """
    known = written(_reduced(links), "closure")
    return united([known.withColumn("closed", F.lit(False)), *(t.withColumn("closed", F.lit(True)) for t in extended([], known))])


def closure_by_stamps(links: DataFrame, grouped: int = 0) -> DataFrame:
    """As closure_in_order(), for documents of any size: derivations are stamped, and the least stamp wins.

    Passes derive from all pairs (i, j) of links, i before j, of which j is new since the pass before. The stamp of a derivation is
    (i, j): for each pair of ids the least one counts, and the links that a pass adds are numbered in the order of their stamps, by
    ranges of these. No task needs a whole document: those of up to grouped ids are closed in a group each, so that no derivation is
    shuffled, and all larger ones by joins.
    """
    given = canonical(links.where("coalesce(id1, '') <> '' AND coalesce(id2, '') <> '' AND id1 <> id2"))
    first = given.groupBy("doc", "lo", "hi").agg(F.min(F.struct(F.col("ordinal").cast("long").alias("ordinal"), "id1", "id2", "relation")).alias("l")).select("doc", "l.*")
    given = written(first.withColumn("closed", F.lit(False)), "stamps")
    if not grouped:
        return _stamped(given)
    ids = given.select("doc", F.explode(F.array("id1", "id2")).alias("id")).distinct()
    large = written(ids.groupBy("doc").count().where(F.col("count") > grouped).select("doc"), "large")
    if large.isEmpty():
        clear(links.sparkSession, large)
        return given.groupBy("doc").applyInArrow(_stamped_document, SCHEMA)
    small = given.join(large, "doc", "left_anti").groupBy("doc").applyInArrow(_stamped_document, SCHEMA)
    return small.unionByName(_stamped(written(given.join(large, "doc", "left_semi"), "stamps")))


def _stamped(given: DataFrame) -> DataFrame:
    """The closure of a table of doc, ordinal, id1, id2, relation, closed, with one link a pair, by joins."""
    rules = F.broadcast(composition(given.sparkSession))
    known, start = [given], None
    while True:
        every = united(known)
        edges = _both_ways_numbered(every.where(F.col("relation").isin(*COMPOSED)))
        later = edges if start is None else _both_ways_numbered(known[-1].where(F.col("relation").isin(*COMPOSED)))
        one = edges.select("doc", F.col("src").alias("x"), F.col("dst").alias("m"), F.col("relation").alias("r1"), F.col("ordinal").alias("i"))
        two = later.select("doc", F.col("src").alias("m"), F.col("dst").alias("y"), F.col("relation").alias("r2"), F.col("ordinal").alias("j"))
        steps = one.join(two, ["doc", "m"]).where("i < j AND x <> y").join(rules, ["r1", "r2"])
        found = steps.groupBy("doc", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.min(F.struct("i", "j", "x", "y", "r3")).alias("d"))
        added = found.join(_pairs_of(every), ["doc", "lo", "hi"], "left_anti").select("doc", "d.*")
        added = written(added, "stamps")
        if added.isEmpty():
            clear(given.sparkSession, added)
            return every.select(*LINK, "closed")
        start = every.agg(F.max("ordinal")).head()[0] + 1
        numbers = numbered(added, ["doc", "i", "j"])
        new = numbers.select("doc", (F.col("number") + start).alias("ordinal"), F.col("x").alias("id1"), F.col("y").alias("id2"), F.col("r3").alias("relation"), F.lit(True).alias("closed"))
        known.append(written(new, "stamps"))
        clear(given.sparkSession, added, numbers)


_PLACE = {r: k for k, r in enumerate(COMPOSED)}
_INVERSE = dict(INVERSE_PAIRS) | {b: a for a, b in INVERSE_PAIRS}
_TURNED = np.array([_PLACE[_INVERSE.get(r, r)] for r in COMPOSED])
_NONE = 1 << 60  # more than any stamp
_RULES = np.full((len(COMPOSED), len(COMPOSED)), _NONE)
for _a, _b, _c in COMPOSITION:
    _RULES[_PLACE[_a], _PLACE[_b]] = _PLACE[_c]


def _stamped_document(links: pa.Table) -> pa.Table:
    """_stamped() of one document, in tables of its pairs of ids. A stamp and the relation derived are one number."""
    links = links.combine_chunks().sort_by("ordinal")
    both = pa.concat_arrays([c for name in ("id1", "id2") for c in links[name].chunks]).dictionary_encode()
    ids, n, given = both.dictionary, len(both.dictionary), len(links)
    lo, hi = both.indices.to_numpy().reshape(2, -1)
    place = pc.fill_null(pc.index_in(links["relation"], pa.array(COMPOSED)), -1).to_numpy()
    at = np.unique(links["ordinal"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    size = n * n + given  # ordinals are below
    known, ordinal, relation = np.eye(n, dtype=bool), np.full((n, n), _NONE), np.zeros((n, n), dtype=np.int8)
    made, start, end = [(lo, hi, place)], 0, int(at[-1]) + 1
    while True:
        known[lo, hi] = known[hi, lo] = True
        edge = place >= 0
        a, b, r = lo[edge], hi[edge], place[edge]
        ordinal[a, b] = ordinal[b, a] = at[edge]
        relation[a, b], relation[b, a] = r, _TURNED[r]
        some = ~known.all(1)  # ids with pairs not linked yet
        best = np.full((n, n), _NONE)
        new = (ordinal >= start) & (ordinal < _NONE) & some
        for m in np.flatnonzero(new.any(1)):
            x, y = np.flatnonzero((ordinal[m] < _NONE) & some), np.flatnonzero(new[m])
            i, j = ordinal[m, x][:, None], ordinal[m, y]
            stamp = np.where(i < j, (i * size + j) * len(COMPOSED) + _RULES[relation[x, m][:, None], relation[m, y]], _NONE)
            into = np.ix_(x, y)
            best[into] = np.minimum(best[into], stamp)
        best[known] = _NONE
        least = np.triu(np.minimum(best, best.T))
        lo, hi = np.nonzero((least > 0) & (least < _NONE))
        if not len(lo):
            break
        stamps = least[lo, hi]
        order = np.argsort(stamps, kind="stable")
        lo, hi, stamps = lo[order], hi[order], stamps[order]
        turn = best[lo, hi] != stamps
        lo, hi = np.where(turn, hi, lo), np.where(turn, lo, hi)
        place = stamps % len(COMPOSED)
        start, end, at = end, end + len(lo), end + np.arange(len(lo))
        made.append((lo, hi, place))
    lo, hi, place = (np.concatenate([m[k] for m in made]) for k in range(3))
    names = pa.concat_arrays([*links["relation"].chunks, pa.array(COMPOSED).take(pa.array(place[given:]))])
    docs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(lo), dtype=np.int32)), links["doc"].chunk(0).slice(0, 1)).cast(pa.string())
    return pa.Table.from_arrays([docs, ids.take(pa.array(lo)), ids.take(pa.array(hi)), names, pa.array(np.arange(len(lo)) >= given)], ["doc", "id1", "id2", "relation", "closed"])


def _both_ways_numbered(links: DataFrame) -> DataFrame:
    forward = links.select("doc", F.col("id1").alias("src"), F.col("id2").alias("dst"), "relation", "ordinal")
    return forward.union(links.select("doc", "id2", "id1", inverted(F.col("relation")), "ordinal"))


def closure_in_order(links: DataFrame) -> DataFrame:
    """As closure(), deriving from pairs of links in the order of column ordinal; the first relation derived stays.

    All pairs of a document's links are tried, in one task: for annotated texts of a few thousand links. closure_by_stamps() gives the
    same for larger documents.
    """
    import pandas as pd

    table = {(a, b): c for a, b, c in COMPOSITION}
    turned = {r: r for r in COMPOSED} | {"BEFORE": "AFTER", "AFTER": "BEFORE", "INCLUDES": "IS_INCLUDED", "IS_INCLUDED": "INCLUDES"}

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, seen = [], set()
        for r in pdf.sort_values("ordinal").itertuples():
            if r.id1 and r.id2 and r.id1 != r.id2 and frozenset((r.id1, r.id2)) not in seen:
                seen.add(frozenset((r.id1, r.id2)))
                rows.append((r.id1, r.id2, r.relation, False))
        start = 0
        while start < len(rows):
            end = len(rows)
            for i in range(end):
                for j in range(max(i + 1, start), end):
                    a, b = rows[i], rows[j]
                    shared = {a[0], a[1]} & {b[0], b[1]}
                    if len(shared) != 1 or a[2] not in turned or b[2] not in turned:
                        continue
                    (m,) = shared
                    x, first = (a[0], a[2]) if a[1] == m else (a[1], turned[a[2]])
                    y, second = (b[1], b[2]) if b[0] == m else (b[0], turned[b[2]])
                    new = table.get((first, second))
                    if new and frozenset((x, y)) not in seen:
                        seen.add(frozenset((x, y)))
                        rows.append((x, y, new, True))
            start = end
        return pd.DataFrame([(pdf["doc"].iloc[0], *r) for r in rows], columns=["doc", "id1", "id2", "relation", "closed"])

    return links.select("doc", "ordinal", "id1", "id2", "relation").groupBy("doc").applyInPandas(close, SCHEMA)


def link_status(known: DataFrame, new: DataFrame) -> DataFrame:
    """new with status 0 (pair not known), 1 (consistent) or 2 (in conflict)."""
    have = canonical(known).select("doc", "lo", "hi", F.col("rel").alias("known_rel"))
    return canonical(new).join(have, ["doc", "lo", "hi"], "left").withColumn("status", status(F.col("known_rel"), F.col("rel"))).drop("lo", "hi", "rel", "known_rel")


def is_consistent(known: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new that no known link of their pair contradicts."""
    return link_status(known, new).where("status < 2").drop("status")


def closure_on(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """The closure's links that candidates (doc, id1, id2) ask for, in the candidates' direction."""
    closed = _both_ways(closure(links)).select("doc", F.col("src").alias("id1"), F.col("dst").alias("id2"), "relation")
    return candidates.join(closed, ["doc", "id1", "id2"])
