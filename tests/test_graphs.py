import json

import pytest
from pyspark.sql import functions as F

from leafloom.operators import graphs as G


def _graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, i if name is None else name, tag, float(x), 0.0) for x, (i, name, tag) in enumerate(nodes)], "node_id string, name string, tag string, x double, y double")
    return n, spark.createDataFrame(edges, "src string, dst string")


def _names(nodes, edges):
    n = {r.node_id: f"{r['name']}({r.tag})" for r in nodes.collect()}
    return set(n.values()), {(n[e.src], n[e.dst]) for e in edges.collect()}


def test_hanging_actions_swallow_their_nouns(spark):
    n, e = _graph(spark, [("g", "group1", "group"), ("d", "drug", "prepare"), ("h", "block", "action"), ("c", "receptor", "noun"), ("m", "fall", "mechanism"), ("s", "pain", "side_e"), ("l", "lone", "action")], [("g", "d"), ("h", "c"), ("m", "c"), ("c", "s"), ("d", "m")])
    nodes, edges = _names(*G.contract_hanging(n, e))
    assert nodes == {"group1(group)", "drug(prepare)", "block receptor(action)", "fall(mechanism)", "pain(side_e)", "lone(action)"}
    assert ("fall(mechanism)", "block receptor(action)") in edges and ("block receptor(action)", "pain(side_e)") in edges and ("drug(prepare)", "lone(action)") in edges


def test_remaining_nouns_are_swallowed(spark):
    n, e = _graph(spark, [("d", "drug", "prepare"), ("a", "block", "action"), ("x", "alpha", "noun"), ("y", "beta", "noun"), ("s", "pain", "side_e")], [("d", "a"), ("a", "x"), ("x", "y"), ("y", "s")])
    nodes, edges = _names(*G.remove_nouns(n, e))
    assert nodes == {"drug(prepare)", "block alpha beta(action)", "pain(side_e)"}
    assert edges == {("drug(prepare)", "block alpha beta(action)"), ("block alpha beta(action)", "pain(side_e)")}


def test_deletion_with_bypass_goes_through_chains(spark):
    n, e = _graph(spark, [(c, c, "action") for c in "abcde"], [("a", "b"), ("b", "c"), ("c", "d"), ("c", "e"), ("c", "b")])
    left, kept = G.delete_with_bypass(n, e, spark.createDataFrame([("b",), ("c",)], "node_id string"))
    assert {r.node_id for r in left.collect()} == set("ade") and {(r.src, r.dst) for r in kept.collect()} == {("a", "d"), ("a", "e")}


def test_merge_keeps_first_and_is_idempotent(spark):
    n = spark.createDataFrame([(1, "a", "pain", "side_e", 1.0, 0.0), (2, "b", "pain", "side_e", 9.0, 0.0), (2, "c", "drug", "prepare", 0.0, 0.0), (1, "z", None, None, 0.0, 0.0)], "graph_no int, node_id string, name string, tag string, x double, y double")
    e = spark.createDataFrame([(2, "c", "b"), (1, "a", "a"), (1, "a", "z")], "graph_no int, src string, dst string")
    nodes, edges = G.merge_graphs(n, e)
    assert {(r["name"], r.x) for r in nodes.collect()} == {("pain", 1.0), ("drug", 0.0)}
    once = _names(nodes, edges)
    assert once[1] == {("drug(prepare)", "pain(side_e)"), ("pain(side_e)", "pain(side_e)")}
    from pyspark.sql import functions as F

    again = G.merge_graphs(nodes.withColumn("graph_no", F.lit(1)), edges.withColumn("graph_no", F.lit(1)))
    assert _names(*again) == once


def test_levels_cycles_and_export(spark):
    n, e = _graph(spark, [("g", "grp", "group"), ("d", "drug", "prepare"), ("m", "mech", "mechanism"), ("s", "pain", "side_e")], [("g", "d"), ("d", "m"), ("m", "s"), ("d", "s")])
    level, acyclic = G.levels(n, e)
    assert acyclic and {r.node_id: r.level for r in level.collect()} == {"g": 0, "d": 1, "m": 2, "s": 3}
    doc = json.loads(G.node_link_json(n, e).first().document)
    assert doc["maxLevel"] == 4 and doc["name"] == ["drug"] and len(doc["links"]) == 4
    back_n, back_e = G.parse_node_link(G.node_link_json(n, e))
    assert back_n.count() == 4 and back_e.count() == 4
    looped = e.unionByName(spark.createDataFrame([("s", "m"), ("q", "q")], "src string, dst string"))
    more = n.unionByName(spark.createDataFrame([("q", "q", "action", 0.0, 0.0)], n.schema))
    assert not G.levels(more, looped)[1] and G.node_link_json(more, looped) is None
    assert {r.node_id for r in G.cycle_nodes(more, looped).collect()} == {"m", "s", "q"}
    assert {tuple(r.path) for r in G.simple_cycles(looped).collect()} == {("m", "s"), ("q",)}


def test_prune_limit_and_paths(spark):
    n, e = _graph(spark, [("r", "r", "prepare"), ("a", "a", "action"), ("b", "b", "action"), ("s", "s", "side_e"), ("c", "c", "action")], [("r", "a"), ("a", "b"), ("r", "c"), ("c", "s")])
    left, kept = G.prune_leaves(n, e, ["side_e", "prepare"])
    assert {r.node_id for r in left.collect()} == {"r", "c", "s"} and kept.count() == 2
    parents = [(f"p{i:02d}", f"p{i:02d}", "prepare") for i in range(25)]
    wide_n, wide_e = _graph(spark, [*parents, ("t", "t", "side_e")], [(p[0], "t") for p in parents])
    nodes, edges = G.limit_in_degree(wide_n, wide_e, 10, 5)
    assert edges.groupBy("dst").count().agg({"count": "max"}).first()[0] <= 10
    reached = G.reachable(wide_n.filter("tag = 'prepare'").selectExpr("node_id AS seed", "node_id"), edges)
    assert reached.filter("node_id = 't'").count() == 25
    found = G.effects_with_path(n.filter("tag = 'prepare'").select("node_id"), n, e)
    assert [(r.drug, r.effect, r.path) for r in found.collect()] == [("r", "s", ["r", "c", "s"])]
    assert {tuple(r.path) for r in G.simple_paths(n.filter("node_id = 'r'").select("node_id"), e, 2).collect()} == {("r",), ("r", "a"), ("r", "c"), ("r", "a", "b"), ("r", "c", "s")}


def test_main_drugs_and_isolated_effects(spark):
    n, e = _graph(spark, [("g", "g", "group"), ("d", "d", "prepare"), ("k", "k", "prepare"), ("o", "o", "prepare"), ("s", "s", "side_e"), ("x", "x", "action")], [("g", "d"), ("g", "k"), ("x", "k")])
    assert {r.node_id for r in G.main_drugs(n, e).collect()} == {"d", "k"}
    assert {r.node_id for r in G.main_drugs(n, e, strict=True).collect()} == {"d", "o"}
    assert {(r.src, r.dst) for r in G.link_isolated_effects(n, e).collect()} - {(r.src, r.dst) for r in e.collect()} == {("d", "s"), ("k", "s")}


def test_symmetric_edges_collapse(spark):
    rows = [("ab", "action", "b", "side_e"), ("b", "side_e", "ab", "action"), ("b", "side_e", "c", "side_e"), ("ab", "action", "c", "metabol"), ("b", "action", "c", "side_e")]
    out = G.collapse_symmetric(spark.createDataFrame(rows, "source string, source_tag string, target string, target_tag string"))
    assert [tuple(r) for r in out.select("source", "source_tag", "target", "target_tag").collect()] == [("b", "action", "c", "side_e")]


def test_cycles_of_any_length_are_listed(spark, tmp_path):
    """A ring of 13 with a shortcut of 12, and a loop, through the registered query."""
    from leafloom.plans.graph_queries import graph_g16b_simple_cycles

    ring = [(f"n{i:02}", f"n{(i + 1) % 13:02}") for i in range(13)]
    rows = [(a, "action", b, "action") for a, b in [*ring, ("n03", "n05"), ("q", "q"), ("n05", "x")]]
    spark.createDataFrame(rows, "source string, source_tag string, target string, target_tag string").write.parquet(f"{tmp_path}/edge_list.parquet")
    names = [a for a, _ in ring]
    got = [r.path for r in graph_g16b_simple_cycles(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted([" > ".join(names), " > ".join(n for n in names if n != "n04"), "q"])


def test_type_column_marks_rows_that_are_no_link(spark):
    rows = [(" a ", "group", "b", "prepare", None), ("a", "group", "c", "prepare", "Not_link"), ("", "group", "d", "prepare", "x"), (None, "group", "e", "prepare", None)]
    nodes, edges = G.build_graph(spark.createDataFrame(rows, "source string, source_tag string, target string, target_tag string, type string"))
    assert {(r.name, r.tag) for r in nodes.collect()} == {("a", "group"), ("b", "prepare")} and edges.count() == 1


def test_nouns_on_a_cycle_have_no_end(spark):
    nodes = spark.createDataFrame([("p", "p", "action")] + [(f"n{i}", f"n{i}", "noun") for i in range(3)], "node_id string, name string, tag string").selectExpr("*", "0.0D AS x", "0.0D AS y")
    chain = spark.createDataFrame([("p", "n0"), ("n0", "n1"), ("n1", "n2")], "src string, dst string")
    left, _ = G.remove_nouns(nodes, chain)
    assert {r.name for r in left.collect()} == {"p n0 n1 n2"}
    with pytest.raises(ValueError, match="cycle"):
        G.remove_nouns(nodes, chain.union(spark.createDataFrame([("n2", "n0")], "src string, dst string")))


def test_reached_classes_count_as_all_pairs(spark):
    import random

    rng = random.Random(3)
    e = {(f"d{rng.randrange(9)}", f"s{rng.randrange(5)}") for _ in range(20)} | {(f"s{rng.randrange(5)}", f"e{rng.randrange(30)}") for _ in range(50)} | {("d1", "e29"), ("s1", "s2")}
    edges = spark.createDataFrame(sorted(e), "src string, dst string")
    seeds = spark.createDataFrame([(f"d{i}",) for i in range(9)], "node_id string")
    wanted = spark.createDataFrame([(f"e{i}",) for i in range(30)], "node_id string")
    pairs = G.reachable(seeds.selectExpr("node_id AS seed", "node_id"), edges).join(wanted, "node_id")
    got = G.reached_classes(seeds, edges, wanted)
    assert {(r.seed, r.n) for r in got.reached.groupBy("seed").agg(F.sum("size").alias("n")).collect()} == {(r["seed"], r["count"]) for r in pairs.groupBy("seed").count().collect()}
    assert {(r.seed, r.node_id) for r in got.reached.join(got.members, "class").collect()} == {(r.seed, r.node_id) for r in pairs.collect()}


def test_paths_are_counted_without_a_row_each(spark):
    """As listed one by one, on cycles, loops and tails; 4 ** 10 paths through ten layers come from a handful of rows."""
    links = [("r", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "a"), ("c", "d"), ("d", "d"), ("d", "x"), ("x", "y"), ("y", "x"), ("y", "z"), ("r", "z"), ("b", "z")]
    e = spark.createDataFrame(links, "src string, dst string")
    starts = spark.createDataFrame([("r",), ("b",), ("q",)], "node_id string")
    for most in (2, 10):
        listed = {}
        for r in G.simple_paths(starts, e, most).collect():
            listed[len(r.path) - 1] = listed.get(len(r.path) - 1, 0) + 1
        assert {r.n_edges: r.n for r in G.count_simple_paths(starts, e, most).collect()} == listed
    layers = spark.createDataFrame([(f"{k}_{i}", f"{k + 1}_{j}") for k in range(10) for i in range(4 if k else 1) for j in range(4)], "src string, dst string")
    top = spark.createDataFrame([("0_0",)], "node_id string")
    assert {r.n_edges: r.n for r in G.count_simple_paths(top, layers, 10).collect()} == {k: 4**k for k in range(11)}
    assert G.count_simple_paths(top.filter("FALSE"), layers, 10).collect() == []


def test_nodes_below_are_counted_by_sets_of_children(spark):
    """Any graph, cycles too, as by reaching each node; longer ways than ten links count."""
    chain = [(f"c{i}", f"c{i + 1}") for i in range(14)] + [("c14", "s9")]
    links = [("d1", "m1"), ("d1", "m2"), ("d2", "m2"), ("d2", "m1"), ("d3", "m3"), ("d4", "d1"), ("d5", "c0"), ("m1", "s1"), ("m1", "s2"), ("m2", "s2"), ("m2", "m4"), ("m4", "m2"), ("m4", "s3"), ("d6", "s1"), ("d1", "d4"), *chain]
    e = spark.createDataFrame(links, "src string, dst string")
    seeds = spark.createDataFrame([(f"d{i}",) for i in range(1, 8)], "node_id string")
    wanted = spark.createDataFrame([(f"s{i}",) for i in range(1, 10)], "node_id string")
    assert {r.seed: r.n for r in G.reached_counts(seeds, e, wanted).collect()} == {"d1": 3, "d2": 3, "d4": 3, "d5": 1, "d6": 1}
