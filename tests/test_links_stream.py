import datetime as dt

import pytest

from chronoweave.operators import closure
from chronoweave.streaming import links as stream

SCHEMA = "doc string, id1 string, id2 string, relation string, ts timestamp"
NOON = dt.datetime(2024, 1, 1, 12, tzinfo=dt.UTC)


@pytest.fixture
def feed(spark, tmp_path):
    """Runs a micro-batch of rows (doc, id1, id2, relation, hours after noon) and gives all links so far."""
    stream.configure(spark)

    def run(rows, **options):
        made = [(d, a, b, r, NOON + dt.timedelta(hours=h)) for d, a, b, r, h in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        out = stream.closed(source, **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        query = out.trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
        return [tuple(r) for r in spark.read.schema(stream.OUT).parquet(f"{tmp_path}/out").collect()]

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_batches_give_the_closure_of_all(spark, feed):
    """Links in three micro-batches: the same links as the batch closure of all, each told once."""
    chain = [("d", f"e{k}", f"e{k + 1}", "BEFORE" if k % 3 else "SIMULTANEOUS", 0) for k in range(9)] + [("d", "t", "e0", "INCLUDES", 0), ("f", "a", "b", "AFTER", 0), ("f", "c", "b", "IS_INCLUDED", 0), ("f", "x", "a", "VAGUE", 0)]
    for lot in (chain[0::3], chain[1::3], chain[2::3]):
        rows = feed(lot)
    turned = {"BEFORE": "AFTER", "AFTER": "BEFORE", "INCLUDES": "IS_INCLUDED", "IS_INCLUDED": "INCLUDES"}
    key = lambda d, a, b, r: (d, a, b, r) if a < b else (d, b, a, turned.get(r, r))
    want = closure.closure(spark.createDataFrame([r[:4] for r in chain], "doc string, id1 string, id2 string, relation string")).collect()
    got = [key(*r[:4]) for r in rows]
    assert sorted(got) == sorted(key(r.doc, r.id1, r.id2, r.relation) for r in want)
    assert sum(not r[4] for r in rows) == len(chain)


def test_late_rows_and_forgotten_documents(spark, feed):
    """A row behind the watermark is dropped; a document that rests for longer than it is kept begins anew; null ends don't count."""
    feed([("d", "a", "b", "BEFORE", 0), ("old", "a", "b", "BEFORE", 0), ("d", None, "b", "BEFORE", 0), ("d", "a", "a", "BEFORE", 0)], late="1 hour", keep_ms=2 * 3_600_000)
    feed([("d", "b", "c", "BEFORE", 1), ("other", "x", "y", "BEFORE", 9)], late="1 hour", keep_ms=2 * 3_600_000)  # the watermark moves to 8 hours after noon
    feed([("d", "c", "d", "BEFORE", 1)], late="1 hour", keep_ms=2 * 3_600_000)  # late
    rows = feed([("old", "b", "c", "BEFORE", 9)], late="1 hour", keep_ms=2 * 3_600_000)  # its state is gone
    assert sorted(rows) == [("d", "a", "b", "BEFORE", False), ("d", "a", "c", "BEFORE", True), ("d", "b", "c", "BEFORE", False), ("old", "a", "b", "BEFORE", False), ("old", "b", "c", "BEFORE", False), ("other", "x", "y", "BEFORE", False)]
