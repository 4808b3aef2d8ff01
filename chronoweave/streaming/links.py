"""Links as a stream: each document's closure is kept as state and goes on with every micro-batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronoweave.functions.relations import COMPOSITION

OUT = "doc string, id1 string, id2 string, relation string, closed boolean"
_TURNED = {"BEFORE": "AFTER", "AFTER": "BEFORE", "INCLUDES": "IS_INCLUDED", "IS_INCLUDED": "INCLUDES", "SIMULTANEOUS": "SIMULTANEOUS", "IBEFORE": "IAFTER", "IAFTER": "IBEFORE", "BEGINS": "BEGUN_BY", "BEGUN_BY": "BEGINS", "ENDS": "ENDED_BY", "ENDED_BY": "ENDS"}


class ClosedDocument(StatefulProcessor):
    """State: for each entity what it is linked to, with the relation. New links are composed with what their ends have, and so is what follows."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.near = handle.getMapState("near", "id string", "links string")

    def _links(self, entity: str) -> dict[str, str]:
        if entity not in self.seen:
            self.seen[entity] = json.loads(self.near.getValue((entity,))[0]) if self.near.containsKey((entity,)) else {}
        return self.seen[entity]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        table = {(a, b): c for a, b, c in COMPOSITION}
        self.seen: dict[str, dict[str, str]] = {}
        changed, out, newest = set(), [], 0
        given = sorted(((r.id1, r.id2, r.relation, r.ts) for r in rows if r.id1 and r.id2 and r.id1 != r.id2 and r.relation), key=lambda x: tuple(map(str, x)))
        for id1, id2, relation, ts in given:
            newest = max(newest, int(ts.timestamp() * 1000))
            queue, closed = [(id1, id2, relation)], False
            while queue:
                a, b, r = queue.pop(0)
                if b in self._links(a):
                    continue
                self._links(a)[b], self._links(b)[a] = r, _TURNED.get(r, r)
                changed |= {a, b}
                out.append(Row(doc=key[0], id1=a, id2=b, relation=r, closed=closed))
                closed = True
                queue += [(a, c, table[r, s]) for c, s in self._links(b).items() if c != a and (r, s) in table and c not in self._links(a)]
                queue += [(c, b, table[_TURNED[s], r]) for c, s in self._links(a).items() if c != b and s in _TURNED and (_TURNED[s], r) in table and b not in self._links(c)]
        for entity in changed:
            self.near.updateValue((entity,), (json.dumps(self.seen[entity]),))
        if newest:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest + self.keep)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.near.clear()
        return iter(())

    def close(self) -> None:
        pass


def closed(links: DataFrame, late: str = "1 hour", keep_ms: int = 86_400_000) -> DataFrame:
    """doc, id1, id2, relation, closed of a stream of links (doc, id1, id2, relation, ts): each new link, and what follows from it, once.

    A pair keeps its first relation; links of a micro-batch count in the order of their ids. Rows later than late behind the newest ts are
    dropped by the watermark; a document without new links for keep_ms of event time is forgotten. Needs the RocksDB
    state store: see configure().
    """
    rows = links.select("doc", "id1", "id2", "relation", "ts").withWatermark("ts", late)
    return rows.groupBy("doc").transformWithState(ClosedDocument(keep_ms), OUT, outputMode="Append", timeMode="EventTime").select(*[F.col(c) for c in ("doc", "id1", "id2", "relation", "closed")])


def configure(spark: SparkSession) -> None:
    """The state store that closed() needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
