"""Parent-child links to full hierarchies: root, depth, path, subtree size and descendants of each node, and the cycles.

Leaves are peeled bottom-up, 2^r levels in round r. Every node keeps the ancestor that far above it (at first its parent)
and hands its subtree, as far as it knows it, up to that ancestor; a node that is handed nothing is peeled: its own
subtree is complete. The pointer then moves on to the pointer of the ancestor. A pointer that meets a node whose depth is
known gives the node its root, depth and path, from the top of the tree downwards. A tree of n levels so takes log n
rounds instead of n. What still holds a pointer when nothing more is settled lies on a cycle or below one; the nodes that
are never peeled are the cycles themselves, and the smallest name met on the way round is passed along.

Every round is the same plan at every size: the amounts handed up are added before they are shuffled, and the pointers
are joined with their hot ancestors apart. Nodes that are done stay behind, so a round reads only what is still going on.

Defined results: links with a null or blank end do not count, repeated links count once; a node with several parents
hangs under the first by code point (``extra_parents`` lists the others); nodes on or below a cycle have depth -1 and
the smallest name on the cycle as root; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafloom.common import cut, skew_join, table


def filled_links(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(parent, child) of the links with both ends filled, each once."""
    filled = lambda c: F.col(c).isNotNull() & F.col(c).rlike(r"[^\s\p{Z}]")
    return df.filter(filled(source) & filled(target)).select(F.col(source).alias("parent"), F.col(target).alias("child")).distinct()


def extra_parents(links: DataFrame) -> DataFrame:
    """Links beyond the first parent of a child."""
    first = links.groupBy("child").agg(F.min("parent").alias("first_parent"), F.count("*").alias("n")).filter("n > 1")
    return links.join(first, "child").filter("parent <> first_parent").select("child", "parent")


def _begin(links: DataFrame) -> DataFrame:
    """The state before the first round: nodes without a parent are settled, the others point to their parent.

    ``up`` is the ancestor pointed to (null once settled), ``trail`` the path (settled) or the names between ``up`` and
    the node, ``least`` the smallest name from the node to just below ``up``, ``beyond`` that of ``up`` itself.
    """
    single = links.select("child", "parent").unionByName(links.select(F.col("parent").alias("child"), F.lit(None).cast("string").alias("parent")))
    single = single.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("up"))
    top = F.col("up").isNull()
    return single.select(
        "node", "up", F.when(top, F.col("node")).alias("root"), F.when(top, 0).cast("int").alias("depth"),
        F.col("node").alias("least"), F.lit(None).cast("string").alias("beyond"), F.lit(0).cast("bigint").alias("below"),
        F.when(top, F.array("node")).otherwise(F.array().cast("array<string>")).alias("trail"), F.lit(True).alias("handed"), F.lit(True).alias("news"),
    )


def _round(state: DataFrame, stride: int, pending: int, paths: bool) -> DataFrame:
    """Hand subtrees up by ``stride`` levels and move the pointers on; ``pending`` is the number of pointers."""
    sent = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum(F.col("below") + 1).alias("got"), F.count("*").alias("n"))
    met = state.drop("handed", "news").join(sent, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # an amount handed up counts from the next round on: all of this round are of the stride's levels
    grown = (F.col("below") + F.coalesce("got", F.lit(0))).alias("below")
    above = met.filter("n > 0").select(
        F.col("node").alias("up"), F.col("up").alias("a_up"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"), F.col("least").alias("a_least"), F.col("trail").alias("a_trail"), F.col("n").alias("askers")
    )
    moving = met.filter("up IS NOT NULL").select("node", "up", "least", grown, "trail", (F.col("n") > 0).alias("handed"))
    at = skew_join(moving, above, ["up"], "askers", pending)
    settled = F.col("a_depth").isNotNull()
    trail = F.concat("a_trail", F.when(settled, F.concat("trail", F.array("node"))).otherwise(F.concat(F.array("up"), "trail"))) if paths else F.col("trail")
    moved = at.select(
        "node", F.col("a_up").alias("up"), F.col("a_root").alias("root"), (F.col("a_depth") + stride).cast("int").alias("depth"),
        F.when(settled, F.col("least")).otherwise(F.least("least", "a_least")).alias("least"), F.col("a_least").alias("beyond"), "below", trail.alias("trail"),
        "handed", (~settled & (F.col("a_least") < F.col("least"))).alias("news"),
    )
    done = met.filter("up IS NULL").select("node", "up", "root", "depth", "least", "beyond", grown, "trail", (F.col("n") > 0).alias("handed"), F.lit(False).alias("news"))
    return moved.unionByName(done)


def resolve(links: DataFrame, paths: bool = False) -> DataFrame:
    """(node, root, depth, path, n_descendants) of every end of ``links`` (parent, child).

    ``path`` is empty unless asked for; then the links must hold no cycle (a cycle's interior would become one row).
    ``n_descendants`` is null on and below cycles.
    """
    unsettled = F.col("up").isNotNull()
    figures = [F.count(F.when(unsettled, 1)).alias("pending"), F.count(F.when(unsettled & F.col("handed"), 1)).alias("ringed"), F.count(F.when(unsettled & F.col("handed") & F.col("news"), 1)).alias("news")]

    def write(state: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        return cut(state.observe(seen, *figures)), seen.get

    state, now = write(_begin(links))
    stride, left = 1, []
    # a settled node that no pointer leads to any more has got all there is: it stays behind in the file of its round
    idle = F.col("up").isNull() & ~F.col("handed")
    while now["pending"]:
        before = now
        left.append(state.filter(idle))
        state, now = write(_round(state.filter(~idle), stride, before["pending"], paths))
        stride *= 2
        # nothing settled, nothing peeled, no smaller name: every pointer goes to a cycle whose name is known
        if (now["pending"], now["ringed"], now["news"]) == (before["pending"], before["ringed"], 0):
            break
    return functools.reduce(DataFrame.unionByName, left, state).select(
        "node", F.when(unsettled, F.col("beyond")).otherwise(F.col("root")).alias("root"), F.when(unsettled, -1).otherwise(F.col("depth")).cast("int").alias("depth"),
        (F.col("trail") if paths else F.array().cast("array<string>")).alias("path"), F.when(~unsettled, F.col("below")).alias("n_descendants"),
    )


def hierarchy(links: DataFrame) -> DataFrame:
    """(node, root, depth)."""
    return resolve(links).select("node", "root", "depth")


def tree_paths(links: DataFrame) -> DataFrame:
    """(node, root, depth, path, n_descendants) of the nodes of trees; path is the array of names from the root to the node."""
    found = hierarchy(links)
    # below a node of a tree nothing but trees: the links of such children are all of theirs
    return resolve(links.join(found.filter("depth >= 0").select(F.col("node").alias("child")), "child", "left_semi").select("parent", "child"), paths=True)


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, node, distance), one row a pair: lists of descendants as rows, so that no root's list fills a task.

    They are read off the paths where these lie: the pairs are the result and never shuffled.
    """
    up = paths.select("node", F.col("depth").alias("at"), F.posexplode("path").alias("level", "ancestor"))
    return up.filter("level < at").select("ancestor", "node", (F.col("at") - F.col("level")).alias("distance"))


def subtree_sizes(paths: DataFrame) -> DataFrame:
    """(node, n_descendants), as handed up while peeling."""
    return paths.select("node", "n_descendants")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(filled_links(table(spark, sf_dir, "edge_list")))


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path of every node of a tree with the number of its descendants."""
    paths = tree_paths(filled_links(table(spark, sf_dir, "edge_list")))
    return paths.select("node", "root", "depth", F.array_join("path", " > ").alias("path"), "n_descendants")


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(tree_paths(filled_links(table(spark, sf_dir, "edge_list"))))


def p6_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cycle by its smallest name, with the number of nodes on or below it."""
    return hierarchy(filled_links(table(spark, sf_dir, "edge_list"))).filter("depth = -1").groupBy("root").agg(F.count("*").alias("n_nodes"))


def p6_extra_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that no tree uses, because their child hangs under another parent."""
    return extra_parents(filled_links(table(spark, sf_dir, "edge_list")))


_LINKS = r"""WITH RECURSIVE l AS (
  SELECT min(source) AS p, target AS c FROM edge_list
  WHERE regexp_matches(source, '[^\s\p{Z}]') AND regexp_matches(target, '[^\s\p{Z}]') GROUP BY target),
tree(node, root, depth, path) AS (
  SELECT DISTINCT p, p, 0, p FROM l WHERE p NOT IN (SELECT c FROM l)
  UNION ALL SELECT l.c, t.root, t.depth + 1, t.path || ' > ' || l.c FROM tree t JOIN l ON l.p = t.node)"""
_RINGS = """, rest AS (SELECT c, p FROM l WHERE c NOT IN (SELECT node FROM tree)),
reach(node, anc) AS (SELECT c, p FROM rest UNION SELECT r.node, rest.p FROM reach r JOIN rest ON rest.c = r.anc),
ring AS (SELECT node FROM reach WHERE node = anc),
below AS (SELECT node, min(anc) AS root FROM reach WHERE anc IN (SELECT node FROM ring) GROUP BY node)"""
_PAIRS = """, up(ancestor, node, distance) AS (SELECT p, c, 1 FROM l WHERE c IN (SELECT node FROM tree)
  UNION ALL SELECT l.p, up.node, up.distance + 1 FROM up JOIN l ON l.c = up.ancestor)"""

QUERIES = {"p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants, "p6_cycles": p6_cycles, "p6_extra_parents": p6_extra_parents}
SQL = {
    "p6_found": _LINKS + _RINGS + " SELECT node, root, CAST(depth AS INT) AS depth FROM tree UNION ALL SELECT node, root, -1 FROM below",
    "p6_paths": _LINKS + _PAIRS + " SELECT node, root, CAST(depth AS INT) AS depth, path, coalesce(n, 0) AS n_descendants FROM tree LEFT JOIN (SELECT ancestor, count(*) AS n FROM up GROUP BY ancestor) d ON d.ancestor = tree.node",
    "p6_descendants": _LINKS + _PAIRS + " SELECT ancestor, node, CAST(distance AS INT) AS distance FROM up",
    "p6_cycles": _LINKS + _RINGS + " SELECT root, count(*) AS n_nodes FROM below GROUP BY root",
    "p6_extra_parents": r"""WITH f AS (SELECT DISTINCT source, target FROM edge_list WHERE regexp_matches(source, '[^\s\p{Z}]') AND regexp_matches(target, '[^\s\p{Z}]'))
SELECT target AS child, source AS parent FROM f WHERE source > (SELECT min(g.source) FROM f g WHERE g.target = f.target)""",
}
