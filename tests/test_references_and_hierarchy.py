from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leafloom.operators import hierarchy as H
from leafloom.operators import references as B

T = [datetime(2024, m, 1) for m in range(1, 13)]


def _broken(spark, rows, parents):
    r = spark.createDataFrame([("f", *x, "clash") for x in rows], "field string, row_id bigint, key bigint, at timestamp, kind string")
    p = spark.createDataFrame([("f", *x, "clash") for x in parents], "field string, key bigint, born timestamp, gone timestamp, n string")
    return {(x.row_id, x.kind) for x in B.broken_references(r.select("field", "row_id", "key", "at"), p).collect()}


def test_kinds_of_broken_references(spark):
    parents = [(1, T[0], None), (2, T[5], None), (3, T[0], T[4]), (4, T[5], T[8]), (5, T[0], T[2]), (5, T[3], None), (None, T[0], None)]
    rows = [(1, 1, T[3]), (2, 2, T[3]), (3, 2, T[6]), (4, 3, T[4]), (5, 3, T[3]), (6, 9, T[3]), (7, None, T[3]), (8, 4, T[9]), (9, 4, T[3]), (10, 5, T[10]), (11, 3, None), (12, 9, None)]
    assert _broken(spark, rows, parents) == {(2, "late"), (4, "deleted"), (6, "missing"), (8, "deleted"), (9, "late"), (12, "missing")}


def test_repeated_rows_hot_keys_and_empty_tables(spark):
    rows = [(i, 77, T[3]) for i in range(3000)] + [(5000 + i, i, T[3]) for i in range(50)] + [(1, 77, T[3])]
    got = _broken(spark, rows, [(i, T[0], None) for i in range(50)])
    assert len(got) == 3000 and {k for _, k in got} == {"missing"}
    assert _broken(spark, [], []) == set()
    assert _broken(spark, [(1, 1, T[0])], []) == {(1, "missing")}


def _brute(links):
    parent = {}
    for p, c in sorted(links):
        parent.setdefault(c, p)
    out = {}
    for n in {x for link in links for x in link}:
        path = [n]
        while path[-1] in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        if path[-1] in parent:
            ring = path[path.index(parent[path[-1]]) :]
            out[n] = (min(ring), -1)
        else:
            out[n] = (path[-1], len(path) - 1)
    return out


def _links(spark, rows):
    df = spark.createDataFrame([(p, "a", c, "b", "x") for p, c in rows], "source string, source_tag string, target string, target_tag string, parent string")
    return H.filled_links(df)


def test_trees_cycles_blanks_and_repeats(spark):
    rows = [("r", "a"), ("a", "b"), ("a", "c"), ("b", "d"), ("r", "a"), ("x", "x"), ("y", "z"), ("z", "w"), ("w", "y"), ("w", "v"), ("v", "u"), ("p", "q"), (None, "n"), ("n", ""), (" ", "n"), ("o", None), ("m1", "k"), ("m0", "k")]
    good = {(p, c) for p, c in rows if p and c and p.strip() and c.strip()}
    links = _links(spark, rows)
    assert {r.node: (r.root, r.depth) for r in H.hierarchy(links).collect()} == _brute(good)
    assert [(r.child, r.parent) for r in H.extra_parents(links).collect()] == [("k", "m1")]


def test_long_chain_and_broad_root(spark):
    rows = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)] + [("n0000", f"w{i}") for i in range(400)] + [(f"c{i}", f"c{(i + 1) % 50}") for i in range(50)]
    got = {r.node: (r.root, r.depth) for r in H.hierarchy(_links(spark, rows)).collect()}
    assert got == _brute(set(rows))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_any_links(spark, pairs):
    rows = [(f"n{a:02d}", f"n{b:02d}") for a, b in pairs]
    assert {r.node: (r.root, r.depth) for r in H.hierarchy(_links(spark, rows)).collect()} == _brute(set(rows))


def test_paths_and_descendants(spark):
    links = _links(spark, [("r", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("x", "y"), ("y", "x"), ("y", "z")])
    paths = H.tree_paths(links).cache()
    assert {r.node: r.path for r in paths.collect()} == {"r": ["r"], "a": ["r", "a"], "b": ["r", "a", "b"], "c": ["r", "a", "b", "c"], "d": ["r", "a", "b", "c", "d"], "e": ["r", "a", "e"]}
    assert {r.node: r.n_descendants for r in H.subtree_sizes(paths).collect()} == {"r": 5, "a": 4, "b": 2, "c": 1, "d": 0, "e": 0}
    assert ("a", "d", 3) in {(r.ancestor, r.node, r.distance) for r in H.descendants(paths).collect()}


def test_rings_of_any_length_with_tails_and_self_loops(spark):
    rows = [(f"k{n}", f"k{n}") for n in range(40)]
    for n in (2, 3, 4, 6, 7, 8, 12, 16, 24, 41):
        rows += [(f"r{n:02d}_{i:02d}", f"r{n:02d}_{(i + 1) % n:02d}") for i in range(n)]
        rows += [(f"r{n:02d}_{n // 2:02d}", f"a{n}_0")] + [(f"a{n}_{i}", f"a{n}_{i + 1}") for i in range(n)]
    assert {r.node: (r.root, r.depth) for r in H.hierarchy(_links(spark, rows)).collect()} == _brute(set(rows))


def test_no_links(spark):
    links = _links(spark, [(None, "a"), ("", "b")])
    assert H.hierarchy(links).collect() == [] and H.tree_paths(links).collect() == [] and H.descendants(H.tree_paths(links)).collect() == []


def test_discard_frees_the_files_of_a_cut(spark):
    import os

    from leafloom.common import cut, discard

    df = cut(spark.range(5))
    path = df.leafloom_path.removeprefix("file://")
    assert os.path.exists(path)
    discard(df, spark.range(1))
    assert not os.path.exists(path)
