"""Property graphs as two DataFrames: nodes (node_id, name, tag, x, y) and edges (src, dst).

Loops over a graph issue one bounded plan a round, and write its result to the shared folder, so neither the lineage nor
the loss of an executor grows with the rounds. ``graph_id`` is not needed: ids are hashes of natural keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.common import cut

#: Tags of a node.
TAGS = ["absorbtion", "action", "excretion", "group", "prot_link", "mechanism", "metabol", "hormone", "side_e", "prepare", "distribution"]


def node_id(name: Column, tag: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", name, tag), 256).substr(1, 16)


def build_graph(edge_list: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a table (source, source_tag, target, target_tag), unified by trimmed name and tag.

    Rows with an empty end, and rows marked as no link, are left out.
    """
    linked = edge_list.filter("type IS NULL OR type <> 'Not_link'") if "type" in edge_list.columns else edge_list
    rows = linked.select(*[F.trim(c).alias(c) for c in ("source", "source_tag", "target", "target_tag")])
    rows = rows.filter((F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != ""))
    ends = rows.select(F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("source_tag").alias("tag")), F.struct(F.col("target").alias("name"), F.col("target_tag").alias("tag")))).alias("n")).select("n.*").distinct()
    nodes = ends.select(node_id(F.col("name"), F.col("tag")).alias("node_id"), "name", "tag", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    edges = rows.select(node_id(F.col("source"), F.col("source_tag")).alias("src"), node_id(F.col("target"), F.col("target_tag")).alias("dst")).distinct()
    return nodes, edges


def _tagged(edges: DataFrame, nodes: DataFrame, end: str, name: str) -> DataFrame:
    return edges.join(nodes.select(F.col("node_id").alias(end), F.col("tag").alias(name)), end)


def main_drugs(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """Drugs with a parent of tag group; ``strict``: whose parents all are groups (also without parents)."""
    drugs = nodes.filter("tag = 'prepare'").select("node_id")
    parents = _tagged(edges, nodes, "src", "t").groupBy(F.col("dst").alias("node_id")).agg(F.max(F.when(F.col("t") == "group", 1).otherwise(0)).alias("some"), F.min(F.when(F.col("t") == "group", 1).otherwise(0)).alias("all_"))
    if strict:
        return drugs.join(parents, "node_id", "left").filter("all_ IS NULL OR all_ = 1").select("node_id")
    return drugs.join(parents.filter("some = 1"), "node_id", "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame, tags: list[str]) -> DataFrame:
    """Nodes of the tags without a parent."""
    return nodes.filter(F.col("tag").isin(tags)).join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def link_orphans(nodes: DataFrame, edges: DataFrame, tags: list[str]) -> DataFrame:
    """Edges, and one from every main drug to every parentless node of the tags; that product is the result asked for."""
    lost = orphans(nodes, edges, tags).select(F.col("node_id").alias("dst"))
    return edges.unionByName(main_drugs(nodes, edges).select(F.col("node_id").alias("src")).crossJoin(lost)).distinct()


def link_isolated_effects(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return link_orphans(nodes, edges, ["side_e"])


def _rounds(nodes: DataFrame) -> Iterator[int]:
    """As many rounds as a chain of nouns can be long; more mean that nouns form a cycle, which has no end."""
    most = nodes.filter("tag = 'noun'").count() + 1
    yield from range(most)
    raise ValueError(f"nouns still hang after {most} rounds: they lie on a cycle")


def contract_hanging(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hanging actions and mechanisms swallow their noun children: "parent child(tag of the parent)".

    The new node inherits the child's other parents and its children; the hanging parent goes at once, the nouns at the
    end; what still hangs is linked from every main drug.
    """
    nodes, edges = cut(nodes), cut(edges)
    gone = None
    for _ in _rounds(nodes):
        hanging = orphans(nodes, edges, ["action", "mechanism"]).select(F.col("node_id").alias("p"), F.col("name").alias("p_name"), F.col("tag").alias("p_tag"))
        nouns = nodes.filter("tag = 'noun'").select(F.col("node_id").alias("c"), F.col("name").alias("c_name"), "x", "y")
        pairs = cut(hanging.join(edges.select(F.col("src").alias("p"), F.col("dst").alias("c")), "p").join(nouns, "c"))
        if pairs.isEmpty():
            break
        new = pairs.select("p", "c", F.sha2(F.concat_ws("\u0001", "p", "c"), 256).substr(1, 16).alias("node_id"), F.concat_ws(" ", "p_name", "c_name").alias("name"), F.col("p_tag").alias("tag"), "x", "y")
        parents = pairs.select(F.col("p").alias("src")).distinct()
        kept = edges.join(parents, "src", "left_anti")
        into = kept.withColumnRenamed("dst", "c").join(new.select("c", F.col("node_id").alias("dst")), "c").select("src", "dst")
        out = kept.withColumnRenamed("src", "c").join(new.select("c", F.col("node_id").alias("src")), "c").select("src", "dst")
        nodes = cut(nodes.join(parents.withColumnRenamed("src", "node_id"), "node_id", "left_anti").unionByName(new.select("node_id", "name", "tag", "x", "y")))
        edges = cut(kept.unionByName(into).unionByName(out).distinct())
        eaten = pairs.select(F.col("c").alias("node_id")).distinct()
        gone = eaten if gone is None else gone.unionByName(eaten).distinct()
    if gone is not None:
        nodes, edges = drop_nodes(nodes, edges, gone)
    return nodes, link_orphans(nodes, edges, ["action", "mechanism"])


def remove_nouns(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node swallows its noun children, its new nodes theirs; a node of noun children only goes as well."""
    nodes, edges = cut(nodes), cut(edges)
    frontier, gone = nodes.filter("tag IS NULL OR tag <> 'noun'"), nodes.filter("FALSE").select("node_id")
    for _ in _rounds(nodes):
        nouns = nodes.filter("tag = 'noun'").select(F.col("node_id").alias("c"), F.col("name").alias("c_name"), "x", "y")
        out_edges = edges.join(frontier.select(F.col("node_id").alias("src"), F.col("name").alias("p_name"), F.col("tag").alias("p_tag")), "src")
        pairs = cut(out_edges.withColumnRenamed("dst", "c").join(nouns, "c"))
        if pairs.isEmpty():
            break
        only = out_edges.join(nouns.select(F.col("c").alias("dst"), F.lit(1).alias("noun")), "dst", "left").groupBy("src").agg(F.min(F.coalesce("noun", F.lit(0))).alias("all_")).filter("all_ = 1")
        new = cut(pairs.select("src", "c", F.sha2(F.concat_ws("\u0001", "src", "c"), 256).substr(1, 16).alias("node_id"), F.concat_ws(" ", "p_name", "c_name").alias("name"), F.col("p_tag").alias("tag"), "x", "y"))
        into = edges.select("src", F.col("dst").alias("p")).join(new.select(F.col("src").alias("p"), F.col("node_id").alias("dst")), "p").select("src", "dst")
        below = edges.select(F.col("src").alias("c"), "dst").join(new.select("c", F.col("node_id").alias("src")), "c").select("src", "dst")
        gone = cut(gone.unionByName(pairs.select(F.col("c").alias("node_id"))).unionByName(only.select(F.col("src").alias("node_id"))).distinct())
        edges = cut(edges.unionByName(into).unionByName(below).distinct())
        frontier = new.select("node_id", "name", "tag", "x", "y")
        nodes = cut(nodes.unionByName(frontier))
    return drop_nodes(nodes, edges, gone)


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of ``gone`` (node_id) and their edges."""
    left = nodes.join(gone, "node_id", "left_anti")
    kept = edges.join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return left, kept.select("src", "dst")


def merge_by_label(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one label become one, at their mean place; self-loops and repeated edges go."""
    named = nodes.filter(F.col("name").isNotNull())
    new = named.groupBy("name", "tag").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select(node_id(F.col("name"), F.col("tag")).alias("node_id"), "name", "tag", "x", "y")
    to = named.select(F.col("node_id").alias("old"), node_id(F.col("name"), F.col("tag")).alias("new"))
    return new, rewire(edges, to).filter("src <> dst")


def rewire(edges: DataFrame, to: DataFrame) -> DataFrame:
    """Edges between the new ids of ``to`` (old, new), each once; ends without a new id drop the edge."""
    a, b = to.select(F.col("old").alias("src"), F.col("new").alias("s")), to.select(F.col("old").alias("dst"), F.col("new").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def merge_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs (nodes and edges with ``graph_no``) merged by label: the first graph's attributes win, self-loops stay."""
    named = nodes.filter(F.col("name").isNotNull())
    new = named.groupBy("name", "tag").agg(F.min_by(F.struct("x", "y"), F.struct("graph_no", "node_id")).alias("f")).select(node_id(F.col("name"), F.col("tag")).alias("node_id"), "name", "tag", "f.x", "f.y")
    to = named.select("graph_no", F.col("node_id").alias("old"), node_id(F.col("name"), F.col("tag")).alias("new"))
    a, b = to.select("graph_no", F.col("old").alias("src"), F.col("new").alias("s")), to.select("graph_no", F.col("old").alias("dst"), F.col("new").alias("d"))
    return new, edges.join(a, ["graph_no", "src"]).join(b, ["graph_no", "dst"]).select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def merge_keep_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes stay; links go to the first node of each (name, tag); dangling links are dropped."""
    first = nodes.groupBy("name", "tag").agg(F.min_by("node_id", F.struct("graph_no", "node_id")).alias("new"))
    to = nodes.join(first, ["name", "tag"]).select(F.col("node_id").alias("old"), "new").distinct()
    return nodes, rewire(edges.select("src", "dst"), to)


def delete_with_bypass(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of ``gone`` (node_id); their parents are linked to their children, through any chain of them."""
    inner = cut(edges.join(gone.withColumnRenamed("node_id", "src"), "src", "left_semi"))
    inside = inner.join(gone.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst")
    reached = cut(edges.join(gone.withColumnRenamed("node_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst"))
    frontier = reached
    while True:
        step = frontier.withColumnRenamed("dst", "m").join(inside.withColumnRenamed("src", "m"), "m").select("src", "dst").distinct()
        frontier = cut(step.join(reached, ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = cut(reached.unionByName(frontier))
    outer = inner.join(gone.withColumnRenamed("node_id", "dst"), "dst", "left_anti").select("src", "dst")
    bypass = reached.withColumnRenamed("dst", "m").join(outer.withColumnRenamed("src", "m"), "m").select("src", "dst")
    left, kept = drop_nodes(nodes, edges, gone)
    return left, kept.unionByName(bypass).distinct()


def relabel_and_merge(nodes: DataFrame, edges: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names by their canonical form, then merged by label."""
    one = synonyms.groupBy("variant").agg(F.min("canonical").alias("canonical"))
    renamed = nodes.join(one.withColumnRenamed("variant", "name"), "name", "left").withColumn("name", F.coalesce("canonical", "name")).drop("canonical")
    return merge_by_label(renamed, edges)


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, node_id): all nodes reached from each seed, itself included. Only the frontier is joined in a round."""
    edges = edges.select("src", "dst")
    frontier = cut(seeds.select("seed", "node_id").distinct())
    parts, seen = [frontier], frontier
    while True:
        step = frontier.join(edges, frontier["node_id"] == edges["src"]).select("seed", F.col("dst").alias("node_id")).distinct()
        frontier = cut(step.join(seen, ["seed", "node_id"], "left_anti"))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        seen = seen.unionByName(frontier)
    return seen


class Reached(NamedTuple):
    """Reached nodes by class: ``members`` (node_id, class) and ``reached`` (seed, class, size)."""

    members: DataFrame
    reached: DataFrame


def reached_classes(seeds: DataFrame, edges: DataFrame, wanted: DataFrame) -> Reached:
    """What the seeds (node_id) reach among ``wanted`` (node_id), without a row for every pair.

    Each child of a seed is followed once, however many seeds share it. Wanted nodes that are reached from the same
    children are one class; a seed reaches whole classes, so pairs of seed and class stand for all pairs of nodes.
    """
    seeds = seeds.select(F.col("node_id").alias("seed")).distinct()
    children = edges.select(F.col("src").alias("seed"), F.col("dst").alias("child")).join(seeds, "seed", "left_semi").unionByName(seeds.select("seed", F.col("seed").alias("child")).join(wanted.withColumnRenamed("node_id", "seed"), "seed", "left_semi"))
    children = cut(children.distinct())
    below = reachable(children.select(F.col("child").alias("seed"), F.col("child").alias("node_id")).distinct(), edges)
    hits = cut(below.join(wanted, "node_id", "left_semi").select(F.col("seed").alias("child"), "node_id"))
    key = F.xxhash64("child")
    members = cut(hits.groupBy("node_id").agg(F.xxhash64(F.count("*"), F.bit_xor(key), F.sum(key.cast("decimal(38,0)"))).alias("class")))
    sizes = members.groupBy("class").agg(F.count("*").alias("size"))
    by_child = hits.join(members, "node_id").select("child", "class").distinct()
    return Reached(members, children.join(by_child, "child").select("seed", "class").distinct().join(sizes, "class"))


def reached_counts(seeds: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(seed, n): how many of ``wanted`` (node_id) lie one link or more below each seed (node_id); seeds above none are left out.

    Seeds of the same children reach the same, so each set of children is counted once, by ``reached_classes``.
    """
    seeds = seeds.select(F.col("node_id").alias("src")).distinct()
    key = F.xxhash64("dst")
    down = cut(edges.select("src", "dst").distinct().join(seeds, "src", "left_semi"))
    sets = cut(down.groupBy("src").agg(F.hex(F.xxhash64(F.count("*"), F.bit_xor(key), F.sum(key.cast("decimal(38,0)")))).alias("kind")))
    # the sets stand in for their seeds: nodes of their own above the children of one of them
    one = sets.groupBy("kind").agg(F.min("src").alias("src"))
    above = cut(down.join(one, "src").select(F.concat(F.lit("\u0001"), "kind").alias("src"), "dst"))
    counted = reached_classes(above.select(F.col("src").alias("node_id")).distinct(), edges.select("src", "dst").unionByName(above), wanted).reached.groupBy("seed").agg(F.sum("size").alias("n"))
    return sets.select(F.col("src").alias("seed"), F.concat(F.lit("\u0001"), "kind").alias("kind")).join(counted.withColumnRenamed("seed", "kind"), "kind").select("seed", "n")


def ancestors(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    return reachable(seeds, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges both of whose ends are in ``kept`` (node_id)."""
    k = kept.select("node_id").distinct()
    return edges.join(k.withColumnRenamed("node_id", "src"), "src", "left_semi").join(k.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst")


def levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """(node_id, level) by longest path from a root, peeling nodes whose parents all have a level; and whether it is acyclic."""
    edges = cut(edges.select("src", "dst").distinct())
    wait = cut(nodes.select("node_id").join(edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("wait")), "node_id", "left").select("node_id", F.coalesce("wait", F.lit(0)).alias("wait")))
    done, level = None, 0
    while True:
        ready = cut(wait.filter("wait = 0").select("node_id", F.lit(level).alias("level")))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        freed = edges.join(ready.select(F.col("node_id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("freed"))
        wait = cut(wait.filter("wait > 0").join(freed, "node_id", "left").select("node_id", (F.col("wait") - F.coalesce("freed", F.lit(0))).alias("wait")))
        level += 1
    if done is None:
        done = nodes.select("node_id", F.lit(0).alias("level")).filter("FALSE")
    return done, wait.isEmpty()


def parents_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node_id")).agg(F.array_sort(F.collect_set("src")).alias("parents"))


def cycle_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or between cycles: what is left after peeling from both ends."""
    edges = cut(edges.select("src", "dst").distinct())
    have = edges.count()
    while True:
        # two layers from each end a round: half the rounds, each of one plan
        for _ in range(2):
            inner = edges.join(edges.select(F.col("dst").alias("src")), "src", "left_semi").join(edges.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
            edges = inner
        edges = cut(edges)
        left = edges.count()
        if left == have:
            return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        have = left


def simple_cycles(edges: DataFrame, most: int | None = 10) -> DataFrame:
    """(path) of simple cycles of at most ``most`` nodes (None: of any length), each once, starting at its smallest node."""
    out = edges.filter("src = dst").select(F.array("src").alias("path"))
    grow = cut(edges.filter("src < dst").select(F.array("src", "dst").alias("path")))
    size = 2
    while (most is None or size <= most) and not grow.isEmpty():
        next_ = grow.select("path", F.element_at("path", -1).alias("src")).join(edges, "src").select("path", "dst")
        # paths that close or go on, written once
        next_ = cut(next_.filter((F.col("dst") >= F.element_at("path", 1)) & ~F.array_contains(F.slice("path", 2, size), F.col("dst"))))
        out = out.unionByName(next_.filter(F.col("dst") == F.element_at("path", 1)).select("path"))
        grow = next_.filter(F.col("dst") > F.element_at("path", 1)).select(F.concat("path", F.array("dst")).alias("path"))
        size += 1
    return out


def simple_paths(starts: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(path) of all simple paths of at most ``most`` edges from the start nodes, every length."""
    grow = cut(starts.select(F.array("node_id").alias("path")))
    out = grow
    for _ in range(most):
        grow = cut(grow.select("path", F.element_at("path", -1).alias("src")).join(edges, "src").filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        if grow.isEmpty():
            break
        out = out.unionByName(grow)
    return out


def count_simple_paths(starts: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(n_edges, n): how many simple paths of each length ``simple_paths`` has, without a row for each of them.

    Paths that stand at one node with the same nodes of cycles behind them go on alike: they are one row with their
    number. A node on no cycle is never met again and need not be remembered, so without cycles there is a row a node.
    """
    edges = cut(edges.select("src", "dst"))
    ring = cycle_nodes(starts, edges).select(F.col("node_id").alias("dst"), F.lit(True).alias("again"))
    edges = cut(edges.join(ring, "dst", "left").select("src", "dst", F.coalesce("again", F.lit(False)).alias("again")))
    first = starts.select(F.col("node_id").alias("dst")).join(ring, "dst", "left")
    behind = lambda old, again: F.when(again, F.array_sort(F.concat(old, F.array("dst")))).otherwise(old)
    grow = cut(first.select("dst", behind(F.array().cast("array<string>"), F.coalesce("again", F.lit(False))).alias("behind")).groupBy("dst", "behind").agg(F.count("*").alias("n")))
    count = lambda k: grow.groupBy(F.lit(k).alias("n_edges")).agg(F.sum("n").alias("n"))
    out = count(0)
    for k in range(1, most + 1):
        step = edges.join(grow.select(F.col("dst").alias("src"), "behind", "n"), "src").filter(~F.array_contains("behind", F.col("dst")))
        grow = cut(step.select("dst", behind(F.col("behind"), F.col("again")).alias("behind"), "n").groupBy("dst", "behind").agg(F.sum("n").alias("n")))
        if grow.isEmpty():
            break
        out = out.unionByName(count(k))
    return out


def effects_with_path(drugs: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(drug, effect, path): effects below each drug; no path goes on below an effect, the last path by order wins."""
    tags = nodes.select("node_id", "tag")
    onward = edges.join(tags.filter("tag <> 'side_e'").select(F.col("node_id").alias("src")), "src", "left_semi").select("src", "dst")
    paths = simple_paths(drugs, onward, most).withColumn("effect", F.element_at("path", -1)).filter(F.size("path") > 1)
    hits = paths.join(tags.filter("tag = 'side_e'").select(F.col("node_id").alias("effect")), "effect", "left_semi")
    return hits.groupBy(F.element_at("path", 1).alias("drug"), "effect").agg(F.max("path").alias("path"))


def prune_leaves(nodes: DataFrame, edges: DataFrame, protect: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves without a protected tag are removed, again and again."""
    nodes, edges = cut(nodes), cut(edges)
    while True:
        gone = cut(nodes.filter(~F.coalesce("tag", F.lit("")).isin(protect)).join(edges.select(F.col("src").alias("node_id")), "node_id", "left_anti").select("node_id"))
        if gone.isEmpty():
            return nodes, edges
        nodes, edges = (cut(x) for x in drop_nodes(nodes, edges, gone))


def limit_in_degree(nodes: DataFrame, edges: DataFrame, most: int = 10, divider: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes of more than ``most`` parents get layers of intermediate nodes between, until none has more."""
    nodes, edges = cut(nodes), cut(edges)
    level = 0
    while True:
        many = edges.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("dst", F.greatest(F.floor(F.col("n") / divider), F.lit(1)).cast("int").alias("k"))
        many = cut(many)
        if many.isEmpty():
            return nodes, edges
        name = lambda i: F.sha2(F.concat_ws("\u0001", "dst", F.lit(level), i), 256).substr(1, 16)
        # a parent's place among the others: numbered within the node it leads to
        placed = edges.join(many, "dst").withColumn("i", (F.row_number().over(Window.partitionBy("dst").orderBy("src")) - 1) % F.col("k"))
        inter = many.select("dst", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).join(nodes.select(F.col("node_id").alias("dst"), "name", "tag"), "dst")
        new = inter.select(name(F.col("i").cast("string")).alias("node_id"), F.concat(F.lit("inter_"), "name", F.lit("_"), "i").alias("name"), F.concat(F.lit("inter_"), "tag").alias("tag"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        up = placed.select("src", name(F.col("i").cast("string")).alias("dst"))
        down = inter.select(name(F.col("i").cast("string")).alias("src"), "dst")
        edges = cut(edges.join(many, "dst", "left_anti").select("src", "dst").unionByName(up).unionByName(down).distinct())
        nodes = cut(nodes.unionByName(new))
        level += 1


def drop_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), "node_id", "left_semi")


def drop_unknown_effects(nodes: DataFrame, edges: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Side effects outside ``vocabulary`` (term) are deleted with bypass edges."""
    gone = nodes.filter("tag = 'side_e'").withColumn("term", F.lower("name")).join(vocabulary.select(F.lower("term").alias("term")), "term", "left_anti").select("node_id")
    return delete_with_bypass(nodes, edges, cut(gone))


def collapse_symmetric(edges: DataFrame, strategy: str = "shortest") -> DataFrame:
    """Edges (source, target, tags) whose two-way pairs are one node, without loops, aggregated again."""
    from leafloom.operators.relational import aggregate_edges, endpoint_bag, symmetric_pairs

    pairs = symmetric_pairs(edges)
    if strategy == "shortest":
        ranked = pairs.select("low", "high", F.when(F.length("high") < F.length("low"), F.col("high")).otherwise(F.col("low")).alias("canonical"))
    else:
        n = endpoint_bag(edges).groupBy("term").agg(F.count("*").alias("n"))
        with_n = pairs.join(n.select(F.col("term").alias("low"), F.col("n").alias("nl")), "low").join(n.select(F.col("term").alias("high"), F.col("n").alias("nh")), "high")
        ranked = with_n.select("low", "high", F.when(F.col("nh") > F.col("nl"), F.col("high")).otherwise(F.col("low")).alias("canonical"))
    to = ranked.select(F.explode(F.array("low", "high")).alias("term"), "canonical").filter("term <> canonical").groupBy("term").agg(F.min("canonical").alias("canonical"))
    for end in ("source", "target"):
        edges = edges.join(to.withColumnRenamed("term", end), end, "left").withColumn(end, F.coalesce("canonical", end)).drop("canonical")
    return aggregate_edges(edges.filter("source <> target"))


def node_link_json(nodes: DataFrame, edges: DataFrame, weight: int = 5) -> DataFrame | None:
    """One row with the node-link document of the graph with levels and parents; None if it has a cycle."""
    level, acyclic = levels(nodes, edges)
    if not acyclic:
        return None
    rows = nodes.join(level, "node_id").join(parents_of(edges), "node_id", "left")
    item = F.struct(F.col("node_id").alias("id"), "name", F.col("tag").alias("label"), F.lit(weight).alias("weight"), "level", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))
    one = rows.agg(F.array_sort(F.collect_list(item)).alias("nodes"), (F.max("level") + 1).alias("maxLevel"))
    links = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target")))).alias("links"))
    named = main_drugs(nodes, edges).join(nodes, "node_id").agg(F.array_sort(F.collect_list("name")).alias("name"))
    doc = F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "links", "maxLevel", "name")
    return one.crossJoin(links).crossJoin(named).select(F.to_json(doc).alias("document"))


def parse_node_link(documents: DataFrame, column: str = "document") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, with ``graph_no``, of node-link documents."""
    schema = "nodes array<struct<id:string,name:string,label:string,weight:int,level:int,parents:array<string>>>, links array<struct<source:string,target:string>>"
    parsed = documents.withColumn("graph_no", F.monotonically_increasing_id()) if "graph_no" not in documents.columns else documents
    parsed = parsed.select("graph_no", F.from_json(column, schema).alias("d"))
    nodes = parsed.select("graph_no", F.inline("d.nodes")).select("graph_no", F.col("id").alias("node_id"), "name", F.col("label").alias("tag"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return nodes, parsed.select("graph_no", F.inline("d.links")).select("graph_no", F.col("source").alias("src"), F.col("target").alias("dst"))


def layered_layout(level: DataFrame, gap_x: float = 1.0, gap_y: float = 1.0) -> DataFrame:
    """x centred within the level, y falling by level."""
    w, whole = Window.partitionBy("level").orderBy("node_id"), Window.partitionBy("level")
    return level.select("node_id", ((F.row_number().over(w) - (F.count("*").over(whole) + 1) / 2) * gap_x).alias("x"), (-F.col("level") * gap_y).alias("y"))


def shift_new_nodes(base: DataFrame, new: DataFrame, step: float = 100.0) -> DataFrame:
    """New nodes (name, tag) placed to the right of the base, one step apart, as one union."""
    right = base.agg(F.max("x").alias("mx"), F.min("y").alias("my"))
    w = Window.orderBy("name", "tag")  # the few nodes added by hand
    placed = new.select("name", "tag", F.row_number().over(w).alias("i")).crossJoin(F.broadcast(right))
    out = placed.select(node_id(F.col("name"), F.col("tag")).alias("node_id"), "name", "tag", (F.coalesce("mx", F.lit(0.0)) + step * F.col("i")).alias("x"), F.coalesce("my", F.lit(0.0)).alias("y"))
    return base.unionByName(out)


def export_records(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    kind = F.coalesce("relation_type", F.lit("related")) if "relation_type" in edges.columns else F.lit("related")
    return nodes.select("node_id", "name", "tag"), edges.select("src", "dst", kind.alias("relation_type"))


def single_graph_pipeline(nodes: DataFrame, edges: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contract, drop nouns, link isolated effects, unify synonyms."""
    nodes, edges = contract_hanging(nodes, edges)
    nodes, edges = remove_nouns(nodes, edges)
    return relabel_and_merge(nodes, link_isolated_effects(nodes, edges), synonyms)


def multi_graph_pipeline(nodes: DataFrame, edges: DataFrame, vocabulary: DataFrame, most: int = 10, divider: int = 5) -> tuple[DataFrame, DataFrame]:
    """Merge graphs, drop effects outside the vocabulary, prune leaves, limit in-degrees, drop isolates."""
    nodes, edges = merge_graphs(nodes, edges)
    nodes, edges = drop_unknown_effects(nodes, edges, vocabulary)
    nodes, edges = prune_leaves(nodes, edges, ["side_e", "prepare"])
    nodes, edges = limit_in_degree(nodes, edges, most, divider)
    return drop_isolates(nodes, edges), edges
