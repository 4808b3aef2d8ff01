"""Sieves of a user's own as SQL table functions: documents are partitions, and a sieve sees one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

LINKS = "doc string, id1 string, id2 string, relation string, confidence double"

#: Rows of a document, in the order asked for, to (id1, id2, relation) or (id1, id2, relation, confidence).
Annotate = Callable[[list[Row]], Iterable[tuple]]


def register(spark: SparkSession, name: str, annotate: Annotate, doc: str = "doc") -> None:
    """Makes annotate a table function: SELECT * FROM name(TABLE(events) PARTITION BY doc ORDER BY (sid, idx)).

    It gets the rows of a document (column doc) in one list, so a document must fit a task, as for any sieve that sees all of it; rows
    come from any table or subquery. Repeated and null ids are the sieve's own affair; links with a null id or relation are left out.
    """

    class Sieve:
        def __init__(self):
            self.rows = []

        def eval(self, row: Row):
            self.rows.append(row)

        def terminate(self):
            for id1, id2, relation, *confidence in annotate(self.rows) if self.rows else ():
                if None not in (id1, id2, relation):
                    yield str(self.rows[0][doc]), id1, id2, relation, float(confidence[0]) if confidence else 1.0

    spark.udtf.register(name, udtf(Sieve, returnType=LINKS))
