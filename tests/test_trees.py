import pytest

from chronoweave.operators import trees
from chronoweave.plans import features

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [features.q30b_tree_paths, features.q30c_phrases])
def test_trees_are_read_once(spark, query):
    """Readers of nodes share a table: parses aren't cut into nodes again for each, and no table of nodes goes to every task."""
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "BroadcastHashJoin" not in plan


def test_words_below_roots_without_verbs(spark):
    nodes = trees.intervals(spark.createDataFrame([("d", 0, "(S (NP (DT the) (NN man)) (VP (VBD ran)))")], "doc string, sid int, parse string"))
    roots = nodes.select("doc", "sid", nodes["node"].alias("root"))
    assert {r.root: r.verbs for r in trees.verbs(nodes, roots).collect()} == {0: ["ran"], 4: ["ran"], 5: ["ran"]}
    assert {r.root: (r.text, r.tokens) for r in trees.raw_texts(nodes, roots).collect()} == {0: ("the man ran", 3), 1: ("the man", 2), 2: ("the", 1), 3: ("man", 1), 4: ("ran", 1), 5: ("ran", 1)}


def test_related_is_paths_dominance_and_ancestors_at_once(spark):
    """The same as each of them alone, for every two tokens and for one that isn't there; nodes are shuffled a few times, not for each."""
    parses = ["(S (NP (DT the) (NN man)) (VP (VBD saw) (NP (DT a) (NN dog))) (. .))", "(UH oh)", "(S (NP (NN a b)) (VP (VB c)))", "(S (A (B (C c))) (D d))"]
    nodes = trees.intervals(spark.createDataFrame([(f"d{k}", 0, p) for k, p in enumerate(parses)], "doc string, sid int, parse string"))
    side = lambda k: trees.leaves(nodes).select("doc", "sid", "idx", "node").withColumnsRenamed({"idx": f"idx{k}", "node": f"node{k}"})
    both = side(1).join(side(2), ["doc", "sid"]).localCheckpoint()
    both = both.unionByName(spark.createDataFrame([("d0", 0, 1, 1, 99, 99), ("none", 0, 1, 1, 2, 2)], both.schema))
    columns = ["doc", "idx1", "idx2", "path", "inner", "dominates", "dominated", "ancestor"]
    got = {tuple(r) for r in trees.related(both, nodes).select(columns).collect() if r.idx2 != 99 and r.doc != "none"}
    each = trees.common_ancestors(trees.paths(trees.dominance(both, nodes), nodes), nodes).select(columns).collect()
    assert got == {tuple(r) for r in each if r.idx2 != 99 and r.doc != "none"} and len(got) > 40
    absent = [r for r in trees.related(both, nodes).collect() if r.idx2 == 99 or r.doc == "none"]
    assert len(absent) == 2 and all(r.path is None and r.ancestor is None and not r.dominated for r in absent)
    plan = features.q30b_tree_paths(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
