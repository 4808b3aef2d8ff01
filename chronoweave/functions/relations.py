"""Temporal relations as column functions: inverses, normal forms, reduced label sets and composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Relation names and their inverses; every name not listed here is its own inverse.
RELATIONS = [
    "BEFORE", "AFTER", "IBEFORE", "IAFTER", "INCLUDES", "IS_INCLUDED", "BEGINS", "BEGUN_BY", "ENDS", "ENDED_BY",
    "SIMULTANEOUS", "NONE", "VAGUE", "UNKNOWN", "OVERLAP", "BEFORE_OR_OVERLAP", "OVERLAP_OR_AFTER",
]
INVERSE_PAIRS = [
    ("BEFORE", "AFTER"), ("IBEFORE", "IAFTER"), ("INCLUDES", "IS_INCLUDED"), ("BEGINS", "BEGUN_BY"), ("ENDS", "ENDED_BY"), ("BEFORE_OR_OVERLAP", "OVERLAP_OR_AFTER"),
]
# X r1 A and A r2 Y give X r3 Y.
COMPOSITION = [
    ("BEFORE", "BEFORE", "BEFORE"), ("BEFORE", "INCLUDES", "BEFORE"), ("BEFORE", "SIMULTANEOUS", "BEFORE"),
    ("AFTER", "AFTER", "AFTER"), ("AFTER", "INCLUDES", "AFTER"), ("AFTER", "SIMULTANEOUS", "AFTER"),
    ("INCLUDES", "INCLUDES", "INCLUDES"), ("INCLUDES", "SIMULTANEOUS", "INCLUDES"),
    ("IS_INCLUDED", "BEFORE", "BEFORE"), ("IS_INCLUDED", "AFTER", "AFTER"), ("IS_INCLUDED", "IS_INCLUDED", "IS_INCLUDED"), ("IS_INCLUDED", "SIMULTANEOUS", "IS_INCLUDED"),
    ("SIMULTANEOUS", "BEFORE", "BEFORE"), ("SIMULTANEOUS", "AFTER", "AFTER"), ("SIMULTANEOUS", "INCLUDES", "INCLUDES"),
    ("SIMULTANEOUS", "IS_INCLUDED", "IS_INCLUDED"), ("SIMULTANEOUS", "SIMULTANEOUS", "SIMULTANEOUS"),
]
# The label sets of each relation mode, as what a relation becomes and what all others become (None: themselves).
MODES: dict[str, tuple[dict[str, str], str | None]] = {
    "FULL": ({}, None),
    "SYMMETRY": ({"IBEFORE": "BEFORE", "INCLUDES": "OVERLAP", "BEGINS": "OVERLAP", "ENDS": "OVERLAP", "SIMULTANEOUS": "OVERLAP"}, None),
    "BEFORE": ({"BEFORE": "BEFORE", "IBEFORE": "BEFORE"}, "NONE"),
    "TEMPEVAL": ({"BEFORE": "BEFORE", "AFTER": "AFTER", "NONE": "NONE", "BEFORE_OR_OVERLAP": "BEFORE_OR_OVERLAP", "OVERLAP_OR_AFTER": "OVERLAP_OR_AFTER", "IBEFORE": "BEFORE"}, "OVERLAP"),
    "REDUCED": ({"IBEFORE": "BEFORE", "BEGINS": "INCLUDES", "ENDS": "INCLUDES"}, None),
    "BASIC": ({"IBEFORE": "BEFORE", "INCLUDES": "OVERLAP", "BEGINS": "OVERLAP", "ENDS": "OVERLAP", "SIMULTANEOUS": "OVERLAP"}, None),
}
# Relations whose ids a mode turns.
TURNED_BY_MODE = {"REDUCED": ["BEGINS", "ENDS"]}
# Relations that a link in one direction never has.
TURNED = ["AFTER", "IAFTER", "IS_INCLUDED", "BEGUN_BY", "ENDED_BY"]
# One-letter labels of annotation files, fine-grained ones included.
LABELS = {"b": "BEFORE", "a": "AFTER", "i": "INCLUDES", "ii": "IS_INCLUDED", "s": "SIMULTANEOUS", "v": "VAGUE", "mv": "MUTUAL_VAGUE", "pv": "PARTIAL_VAGUE", "nv": "NONE_VAGUE"}


def mapped(column: Column, pairs: dict[str, str]) -> Column:
    """column through a small table; values not in it stay."""
    if not pairs:
        return column
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.element_at(table, column), column)


def inverted(relation: Column) -> Column:
    return mapped(relation, dict(INVERSE_PAIRS) | {b: a for a, b in INVERSE_PAIRS})


def normalised(relation: Column) -> Column:
    """Upper case with underscores; DURING, DURING_INV and IDENTITY by the names they stand for; unknown names are null."""
    name = F.upper(F.regexp_replace(F.trim(relation), "-", "_"))
    name = mapped(name, {"DURING": "IS_INCLUDED", "DURING_INV": "INCLUDES", "IDENTITY": "SIMULTANEOUS"})
    return F.when(name.isin(*RELATIONS), name)


def reduced(relation: Column, mode: str) -> Column:
    """The relation's name in a mode; reduced_links() also turns ids where a mode does."""
    table, other = MODES[mode]
    out = mapped(relation, table)
    return out if other is None else F.when(relation.isin(*table), out).when(relation.isNotNull(), F.lit(other))


def turned(links: DataFrame, turn: Column) -> DataFrame:
    """links with their ids exchanged where turn holds."""
    return links.withColumns({"id1": F.when(turn, F.col("id2")).otherwise(F.col("id1")), "id2": F.when(turn, F.col("id1")).otherwise(F.col("id2"))})


def reduced_links(links: DataFrame, mode: str) -> DataFrame:
    """links (id1, id2, relation) in a mode's relations."""
    turn = F.col("relation").isin(*TURNED_BY_MODE.get(mode, [])) if mode in TURNED_BY_MODE else F.lit(False)
    return turned(links, turn).withColumn("relation", reduced(F.col("relation"), mode))


def by_confidence(links: DataFrame) -> DataFrame:
    """links, the most confident first; ties by document and ids."""
    return links.orderBy(F.desc("confidence"), "doc", "id1", "id2")


def expanded_label(label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.lower(F.trim(label)))


def one_direction(links: DataFrame) -> DataFrame:
    """Turns links (id1, id2, relation) whose relation has a forward form."""
    turn = F.col("relation").isin(*TURNED)
    return links.withColumns({"id1": F.when(turn, F.col("id2")).otherwise(F.col("id1")), "id2": F.when(turn, F.col("id1")).otherwise(F.col("id2")), "relation": F.when(turn, inverted(F.col("relation"))).otherwise(F.col("relation"))})


def canonical(links: DataFrame) -> DataFrame:
    """lo, hi and rel: the pair in id order and the relation in that direction; equal for a link and its inverse."""
    swap = F.col("id1") > F.col("id2")
    return links.withColumns({"lo": F.least("id1", "id2"), "hi": F.greatest("id1", "id2"), "rel": F.when(swap, inverted(F.col("relation"))).otherwise(F.col("relation"))})


def agrees(a: Column, b: Column) -> Column:
    """Whether two canonical relations of a pair are the same."""
    return a == b


def status(known: Column, new: Column) -> Column:
    """0: no known relation of the pair; 1: consistent with it; 2: in conflict. Both are canonical."""
    near = lambda x, y: (known.isin(*x) & new.isin(*y)) | (known.isin(*y) & new.isin(*x))
    same = (known == new) | near(["BEFORE"], ["IBEFORE"]) | near(["AFTER"], ["IAFTER"]) | near(["INCLUDES"], ["BEGUN_BY", "ENDED_BY"]) | near(["IS_INCLUDED"], ["BEGINS", "ENDS"])
    return F.when(known.isNull(), 0).when(same, 1).otherwise(2)


def link_type(id1: Column, id2: Column) -> Column:
    """tt, et or ee by the first letter of the ids."""
    times = F.startswith(id1, F.lit("t")).cast("int") + F.startswith(id2, F.lit("t")).cast("int")
    return F.element_at(F.array(F.lit("ee"), F.lit("et"), F.lit("tt")), times + 1)


def composition(spark: SparkSession) -> DataFrame:
    """r1, r2, r3: always these 17 rows."""
    return spark.createDataFrame(COMPOSITION, "r1 string, r2 string, r3 string")
