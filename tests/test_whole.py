from pyspark.sql import functions as F

from chronoweave import scratch
from chronoweave.operators import closure
from chronoweave.plans import closing
from chronoweave.plans.catalogue import plain

from tests.test_engine import noisy

SF = "/root/testdata/sf0.001"


def test_closure_by_stamps_joins_all_days_of_a_user(spark):
    """A user is one document: every pair of its events and days is linked, however far apart."""
    e = plain(spark, SF)
    sizes = e.groupBy("doc").agg((F.count("*") + F.countDistinct("sid")).alias("n"))
    want = {r.doc: r.n * (r.n - 1) // 2 for r in sizes.collect()}
    got = closing.a07b_closure_by_stamps(spark, SF).groupBy("doc").count()
    assert {r.doc: r["count"] for r in got.collect()} == want


def test_documents_closed_in_groups_have_the_links_of_joins(spark):
    """Noisy links: documents of few ids in a group each, larger ones by joins, and the same links in the same direction whichever way; no derivation is written."""
    links = noisy(7, 4, 24, 40) + [("x" + d, *rest) for d, *rest in noisy(8, 1, 60, 90)] + [("n", "e1", "e1", "BEFORE", 0), ("n", "e1", None, "BEFORE", 1), ("n", "e1", "e2", "OTHER", 2), ("n", "e2", "e3", "BEFORE", 3)]
    links = spark.createDataFrame(links, "doc string, id1 string, id2 string, relation string, ordinal int")
    by = lambda df: sorted(tuple(r) for r in df.select("doc", "id1", "id2", "relation", "closed").collect())
    want = by(closure.closure_in_order(links))
    scratch.clear(spark)
    assert by(closure.closure_by_stamps(links, grouped=100)) == want
    assert len(scratch._made) == 1  # the links given
    assert by(closure.closure_by_stamps(links, grouped=30)) == want
    assert closure.closure_by_stamps(links.limit(0), grouped=30).count() == 0
