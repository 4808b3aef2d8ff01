"""Plans whose rows stay few and narrow where they are shuffled."""

import re

from chronoweave import scratch
from chronoweave.operators import closure, linkfeatures, pairs, sieves
from chronoweave.plans import texts
from chronoweave.plans.corpus import corpus

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def depth(line):
    return len(line) - len(line.lstrip(" :+-"))


def test_masks_are_told_of_kinds_and_not_of_pairs(spark):
    c = corpus(spark, SF)
    both = pairs.same_or_next(c.events)
    learned = sieves.learn_vague_patterns(both, both.selectExpr("doc", "id1", "id2", "'VAGUE' AS relation"), 0.5, 2)
    for df in (learned, sieves.frequent_vague(c, learned)):
        lines = plan(df)
        for k in [k for k, x in enumerate(lines) if "Generate explode" in x]:
            below = next(x for x in lines[k + 1 :] if "Project" not in x)
            assert "Aggregate" in below


def test_pairs_are_narrow_until_their_paths_are_known(spark):
    c = corpus(spark, SF)
    lines = plan(linkfeatures.event_pairs(c, pairs.same_or_next(c.events)))
    k = next(k for k, x in enumerate(lines) if "Join LeftOuter" in x and "at1" in x)
    under = []
    for x in lines[k + 1 :]:
        if depth(x) <= depth(lines[k]):
            break
        under.append(x)
    assert under and not any(re.search(r"\bown[12]?#", x) for x in under if "Project" in x)


def test_tokens_of_a_text_are_not_shuffled(spark):
    assert "Exchange" not in texts.e01_token_table(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_closure_by_stamps_keeps_its_links_alone(spark):
    scratch.clear(spark)
    links = spark.createDataFrame([("d", k, f"e{k}", f"e{k + 1}", "BEFORE") for k in range(4)], "doc string, ordinal long, id1 string, id2 string, relation string")
    assert closure.closure_by_stamps(links).count() == 10
    names = [p.rpartition("/")[2].partition("-")[0] for p in scratch._made]
    assert "ranged" not in names and len(names) == 3  # the links given and those of two passes
