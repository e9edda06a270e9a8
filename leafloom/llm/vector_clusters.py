"""Problem 5: clusters of mutually similar records, by mergeable cluster-feature trees and Ward agglomeration.

1. Each part of the vectors builds a cluster-feature tree; its threshold rises until the tree has few leaves. The leaf
   summaries (count, linear sum, square sum) are merged tree by tree, in rounds, into one; Ward agglomeration of its
   leaves divides the space into regions. Regions that hold too many records are divided again, each for itself, so
   neither a task nor the driver holds more than one region's summary.
2. In each region a tree with a fine threshold gives leaves, and constrained Ward agglomeration merges them, nearest first,
   as long as no two leaves of a group are farther apart than similar records can be; a full assignment pass puts every
   record of the region to the nearest of the resulting micro-clusters and measures their radii. A region whose vectors
   are all but equal cannot be divided; it is one micro-cluster, whose features are summed where the records lie.
3. Micro-clusters in different regions, or left apart by Ward, are linked if their radii allow similar records. For that
   each visits the ``visits`` regions nearest to its centroid, level by level (None: every region that any record similar
   to one of its own can lie in, by the half-spaces between centres; exact, but without pruning where vectors are random).
   Linked micro-clusters form candidate clusters.
4. An exact check follows: every record's set of similar records is reduced to its size, smallest id and hash sum. Records
   that agree in all three and are as many as the size are a cluster: all similar to each other and to no record outside.
   A small candidate is one block; in a larger one the micro-clusters are checked against those they are linked with, in
   blocks of bounded size, and pairs of micro-clusters so near that all their records are similar are not compared at all.

Exact copies are one vector. Defined results: unusable vectors (null, all zero, other dimension, NaN) are no records;
ids are unique; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.common import cut, discard, parallel, skew_join
from leafloom.llm.neighbours import SIMILAR_SQL, _units
from leafloom.llm.vectors import DIMENSIONS, distinct_vectors, lists, matrix, members

SIMILAR = 0.85
#: Records of a region (up to twice as many are left together); leaves of a summary tree; trees merged at once.
REGION, LEAVES, FAN_IN = 2_000, 512, 8
#: Regions a micro-cluster visits; records of a block; visitors of a region in a group.
VISITS, BLOCK, VISITORS = 6, 4_096, 50_000
#: Parts a region is divided into at most; records summarised by one tree; a part of this share of its region is not divided again.
SPLIT, PART, INSEPARABLE = 128, 20_000, 0.95
#: Branches of a tree node; radius of a micro-cluster.
BRANCHES, FINE = 48, 0.3


def _gathered(x: np.ndarray, threshold: float) -> np.ndarray:
    """The entry of each row, numbered in order: the first row left takes all that are left within ``threshold`` of it.

    Distances are measured a block of rows at once, and only rows that have another one near are looked at one by one.
    """
    if not threshold:
        return np.arange(len(x))
    of, square = np.full(len(x), -1), (x * x).sum(1)
    for s in range(0, len(x), 512):
        here = slice(s, s + 512)
        near = square[here, None] + square[None, s:] - 2 * x[here] @ x[s:].T <= threshold**2
        near[np.arange(len(near)), np.arange(len(near))] = True
        alone = near.sum(1) == 1
        own = np.nonzero(alone & (of[here] < 0))[0]
        of[s + own] = s + own
        for i in np.nonzero(~alone)[0]:
            if of[s + i] < 0:
                of[s:][near[i] & (of[s:] < 0)] = s + i
    return np.unique(of, return_inverse=True)[1]


class Tree:
    """Cluster-feature tree fed with batches of features (n, linear sum, square sum)."""

    def __init__(self, threshold: float, dimensions: int = DIMENSIONS) -> None:
        self.threshold, self.d = threshold, dimensions
        self.root = self._node(True)

    def _node(self, leaf: bool) -> dict:
        return {"leaf": leaf, "n": np.zeros(0), "ls": np.zeros((0, self.d)), "ss": np.zeros(0), "kids": []}

    def add(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        parts = self._insert(self.root, n, ls, ss)
        while len(parts) > 1:
            top = self._node(False)
            self._hold(top, parts)
            parts = self._split(top)
        self.root = parts[0]

    def _hold(self, node: dict, parts: list[dict]) -> None:
        node["kids"] = parts
        node["n"] = np.array([p["n"].sum() for p in parts])
        node["ls"] = np.array([p["ls"].sum(0) for p in parts])
        node["ss"] = np.array([p["ss"].sum() for p in parts])

    def _nearest(self, node: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = node["ls"] / node["n"][:, None]
        d = (c * c).sum(1) - 2 * x @ c.T
        best = d.argmin(1)
        return best, d[np.arange(len(x)), best] + (x * x).sum(1)

    def _insert(self, node: dict, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> list[dict]:
        x = ls / n[:, None]
        if node["leaf"]:
            rest = np.ones(len(n), bool)
            if len(node["n"]):
                best, d = self._nearest(node, x)
                near = d <= self.threshold**2
                self._absorb(node, best[near], n[near], ls[near], ss[near])
                rest = ~near
            if rest.any():
                of = _gathered(x[rest], self.threshold)
                more = {k: np.zeros((of.max() + 1, *v.shape[1:])) for k, v in (("n", n), ("ls", ls), ("ss", ss))}
                for k, v in (("n", n), ("ls", ls), ("ss", ss)):
                    np.add.at(more[k], of, v[rest])
                    node[k] = np.concatenate([node[k], more[k]])
            return self._split(node)
        best, _ = self._nearest(node, x)
        kids: list[dict] = []
        for i, kid in enumerate(node["kids"]):
            mine = best == i
            kids += self._insert(kid, n[mine], ls[mine], ss[mine]) if mine.any() else [kid]
        self._hold(node, kids)
        return self._split(node)

    @staticmethod
    def _absorb(node: dict, at: np.ndarray, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        np.add.at(node["n"], at, n)
        np.add.at(node["ls"], at, ls)
        np.add.at(node["ss"], at, ss)

    def _split(self, node: dict) -> list[dict]:
        """The node, or as many as its entries need, divided about two entries far apart."""
        if len(node["n"]) <= BRANCHES:
            return [node]
        c = node["ls"] / node["n"][:, None]
        a = int(((c - c.mean(0)) ** 2).sum(1).argmax())
        da = ((c - c[a]) ** 2).sum(1)
        side = da <= ((c - c[int(da.argmax())]) ** 2).sum(1)
        if side.all() or not side.any():
            side = np.arange(len(c)) % 2 == 0
        out = []
        for part in (side, ~side):
            new = self._node(node["leaf"])
            for k in ("n", "ls", "ss"):
                new[k] = node[k][part]
            new["kids"] = [kid for kid, p in zip(node["kids"], part) if p]
            out += self._split(new)
        return out

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node["leaf"]:
                found.append(node)
            stack += node["kids"]
        return tuple(np.concatenate([f[k] for f in found]) for k in ("n", "ls", "ss"))


def summary(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves, at most ``most``, of a tree whose threshold rises and that is built anew from its leaves when it is full."""
    tree = Tree(0.2)
    for n, ls, ss in batches:
        for i in range(0, len(n), 512):
            tree.add(n[i : i + 512], ls[i : i + 512], ss[i : i + 512])
            while len((leaves := tree.leaves())[0]) > most:
                tree = Tree(tree.threshold * 1.15 + 0.02)
                tree.add(*leaves)
    return tree.leaves()


_CF = "region string, salt int, n double, ls array<float>, ss double"


def _cf_table(key: tuple, leaves: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    n, ls, ss = leaves
    return pa.table({"region": pa.array([key[0].as_py()] * len(n), pa.string()), "salt": pa.array([key[1].as_py()] * len(n), pa.int32()), "n": n, "ls": lists(ls), "ss": ss})


def _features(key: tuple, rows: pa.Table) -> pa.Table:
    x = matrix(rows.column("vec")).astype(float)
    return _cf_table(key, summary(iter([(np.ones(len(x)), x, (x * x).sum(1))]), LEAVES))


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    return _cf_table(key, summary(iter([(rows.column("n").to_numpy(), matrix(rows.column("ls")).astype(float), rows.column("ss").to_numpy())]), LEAVES))


def _centres(region: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Ward agglomeration of a region's leaves into the parts it needs, as unit centres."""
        n = rows.column("n").to_numpy()
        c = matrix(rows.column("ls")).astype(float) / n[:, None]
        labels = ward(n, c, int(min(SPLIT, max(2, -(-n.sum() // region)))))
        sums = np.zeros((labels.max() + 1, c.shape[1]))
        np.add.at(sums, labels, c * n[:, None])
        sums /= np.maximum(np.sqrt((sums**2).sum(1, keepdims=True)), 1e-12)
        return pa.table({"region": pa.array([key[0].as_py()] * len(sums), pa.string()), "sub": pa.array(np.arange(len(sums)), pa.int32()), "centre": lists(sums)})

    return run


def ward(n: np.ndarray, centroids: np.ndarray, clusters: int = 1, height: float = np.inf, widest: float | None = None) -> np.ndarray:
    """Labels after merging, nearest first, until ``clusters`` are left or no merge costs at most ``height``.

    The cost of a merge is the Ward distance sqrt(2ab/(a+b)) |ca - cb|, updated by Lance and Williams. With ``widest`` no
    group may hold two of the centroids farther apart than that.
    """
    m = len(n)
    labels, size, alive = np.arange(m), n.astype(float), m
    d = ((centroids[:, None] - centroids[None]) ** 2).sum(2) if m <= 64 else np.maximum((centroids**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * centroids @ centroids.T, 0)
    wide = None if widest is None else d.astype(np.float32)
    d *= 2 * size[:, None] * size / (size[:, None] + size)
    if wide is not None:
        d[wide > widest**2] = np.inf
    np.fill_diagonal(d, np.inf)
    nearest = d.argmin(1) if m > 1 else np.zeros(m, int)
    least = d[np.arange(m), nearest]
    while alive > clusters:
        i = int(least.argmin())
        j = int(nearest[i])
        if not least[i] <= height**2 or np.isinf(least[i]):
            break
        a, b = size[i], size[j]
        new = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)
        if wide is not None:
            wide[i] = wide[:, i] = np.maximum(wide[i], wide[j])
            new[wide[i] > widest**2] = np.inf
        new[[i, j]] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i], labels[labels == j] = a + b, i
        alive -= 1
        nearest[i], least[i] = d[i].argmin(), d[i].min()
        least[j] = np.inf
        stale = np.nonzero((nearest == j) | (nearest == i))[0]
        stale = stale[(stale != i) & (stale != j) & np.isfinite(least[stale])]
        if len(stale):
            nearest[stale] = d[stale].argmin(1)
            least[stale] = d[stale].min(1)
        better = (d[i] < least) & (np.arange(m) != i)
        nearest[better], least[better] = i, d[i][better]
    return np.unique(labels, return_inverse=True)[1]


def split_centres(rows: DataFrame, over: DataFrame, region: int) -> DataFrame:
    """(region, sub, centre) of the regions ``over`` (region, n): trees over salted parts, merged FAN_IN at a time.

    Nothing comes to the driver but the largest number of parts; a region's leaves, at most LEAVES a tree, are one group.
    """
    salted = rows.join(over, "region").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PART)).cast("int"))
    cf = cut(salted.select("region", "salt", "vec").groupBy("region", "salt").applyInArrow(_features, _CF))
    parts = cf.agg(F.max("salt") + 1).first()[0] or 1
    while parts > 1:
        cf = cut(cf.withColumn("salt", (F.col("salt") / FAN_IN).cast("int")).groupBy("region", "salt").applyInArrow(_merge, _CF))
        parts = -(-parts // FAN_IN)
    return cut(cf.groupBy("region").applyInArrow(_centres(region), "region string, sub int, centre array<float>"))


def _nearest_regions(m: np.ndarray, centres: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, centre) of the ``most`` centres nearest to each row."""
    sim = m @ centres.T
    k = min(most, sim.shape[1])
    at = np.argpartition(-sim, k - 1, 1)[:, :k] if k < sim.shape[1] else np.tile(np.arange(k), (len(m), 1))
    return np.repeat(np.arange(len(m)), k), at.ravel()


def _possible_regions(m: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, centre) of all centres that are nearest to some point within ``reach`` of the row: no half-space shuts it out."""
    sim = m.astype(float) @ centres.T.astype(float)
    apart = np.sqrt(np.maximum(((centres[:, None].astype(float) - centres[None]) ** 2).sum(2), 1e-18))
    worst = np.full(sim.shape, -np.inf)
    for i in range(len(centres)):
        worst = np.maximum(worst, np.where(np.arange(len(centres)) == i, -np.inf, (sim[:, [i]] - sim) / apart[i]))
    return np.nonzero(worst <= reach[:, None] + 1e-4)


def _route(columns: list[str], visits: int | None, reach: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table, centres: pa.Table) -> pa.Table:
        m, c = matrix(rows.column("vec")), matrix(centres.column("centre"))
        if not len(m):
            return rows.select(columns)
        if visits is None:
            at, to = _possible_regions(m, c, rows.column("radius").to_numpy() + reach)
        else:
            at, to = _nearest_regions(m, c, visits)
        subs = np.array([f"{key[0].as_py()}.{x}" for x in centres.column("sub").to_pylist()], object)
        out = rows.take(pa.array(at)).select(columns)
        out = out.set_column(columns.index("region"), "region", pa.array(subs[to], pa.string()))
        sim = np.einsum("ij,ij->i", m[at], c[to])
        return out.set_column(columns.index("sim"), "sim", pa.array(sim.astype(float)))

    return run


def route(rows: DataFrame, centres: DataFrame, visits: int | None, reach: float = 0.0, deeper: bool = False) -> DataFrame:
    """Rows (id, region, sim, vec, ...) one level down: to the nearest ``visits`` parts of the regions that are divided.

    None: to every part that can hold a record within ``reach`` and the row's radius. ``deeper``: a row may come from
    several regions, and of all it has come to it keeps the ``visits`` with the nearest centres.
    """
    divided = centres.select("region").distinct()
    sizes = rows.groupBy("region").agg(F.ceil(F.count("*") / PART).cast("int").alias("salts")).join(divided, "region", "left_semi")
    inside = rows.join(sizes, "region").withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int")).drop("salts")
    spread_ = centres.join(sizes, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "sub", "centre")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    down = inside.groupBy("region", "salt").cogroup(spread_.groupBy("region", "salt")).applyInArrow(_route(rows.columns, visits, reach), schema)
    out = rows.join(divided, "region", "left_anti").select(rows.columns).unionByName(down)
    if visits is None or visits == 1 or not deeper:
        return out
    best = Window.partitionBy("id").orderBy(F.desc("sim"), "region")
    return out.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= visits).drop("__r")


def _descend(levels: list[tuple[dict[int, tuple[np.ndarray, np.ndarray]], list[str]]], columns: list[str], visits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = levels[0][1]
    code = {x: i for i, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = matrix(b.column("vec"))
            # regions that were never divided keep a number past the known ones
            own = b.column("region").to_pylist()
            at, to, sim = np.arange(len(m)), np.array([code.get(x, len(names) + i) for i, x in enumerate(own)]), np.array(b.column("sim").to_numpy(), float)
            for depth, (parts, _) in enumerate(levels):
                divided = np.isin(to, list(parts))
                new = [(at[~divided], to[~divided], sim[~divided])]
                inside = np.nonzero(divided)[0]
                inside = inside[np.argsort(to[inside], kind="stable")]
                for g in np.split(inside, np.nonzero(np.diff(to[inside]))[0] + 1) if len(inside) else []:
                    subs, centres = parts[int(to[g[0]])]
                    i, j = _nearest_regions(m[at[g]], centres, visits)
                    new.append((at[g][i], subs[j], np.einsum("ij,ij->i", m[at[g][i]], centres[j]).astype(float)))
                at, to, sim = (np.concatenate(x) for x in zip(*new))
                order = np.lexsort((to, -sim, at))
                at, to, sim = at[order], to[order], sim[order]
                if depth:
                    # of all a row has come to, those with the nearest centres
                    first = np.nonzero(np.concatenate([[True], np.diff(at) > 0]))[0]
                    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                    at, to, sim = at[place < visits], to[place < visits], sim[place < visits]
            out = b.take(pa.array(at))
            region = pa.array([names[x] if x < len(names) else own[x - len(names)] for x in to.tolist()], pa.string())
            yield pa.record_batch([region if c == "region" else pa.array(sim) if c == "sim" else out.column(c) for c in columns], names=columns)

    return run


def descend(rows: DataFrame, levels: list[DataFrame], visits: int) -> DataFrame:
    """``route`` down all ``levels`` at once, where the rows lie: they are not shuffled, and only what is visited last leaves a task.

    The centres are one row a region, and are sent to every worker.
    """
    found = [x.select("region", "sub", "centre").toArrow() for x in levels]
    keys = [(t.column("region").to_pylist(), t.column("sub").to_pylist(), matrix(t.column("centre"))) for t in found]
    names = sorted({x for r, _, _ in keys for x in r} | {f"{x}.{y}" for r, k, _ in keys for x, y in zip(r, k)})
    code = {x: i for i, x in enumerate(names)}
    known = []
    for r, k, c in keys:
        above = np.array([code[x] for x in r], np.int64)
        subs = np.array([code[f"{x}.{y}"] for x, y in zip(r, k)], np.int64)
        known.append(({int(x): (subs[above == x], c[above == x]) for x in np.unique(above)}, names))
    shared = rows.sparkSession.sparkContext.broadcast(known)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    columns = rows.columns
    return rows.mapInArrow(lambda batches: _descend(shared.value, columns, visits)(batches), schema)


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number each of ``n`` is connected with through the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def merge_leaves(n: np.ndarray, c: np.ndarray, widest: float) -> np.ndarray:
    """Labels of leaves (n, centroid) after Ward agglomeration that keeps leaves farther apart than ``widest`` apart.

    It never joins leaves that no chain of such distances connects, so each connected part is agglomerated for itself.
    """
    square = (c * c).sum(1)
    left, right = [], []
    for s in range(0, len(c), 512):
        i, j = np.nonzero(square[s : s + 512, None] + square - 2 * c[s : s + 512] @ c.T <= widest**2 + 1e-9)
        keep = s + i < j
        left.append(s + i[keep])
        right.append(j[keep])
    part = _components(len(c), np.concatenate(left), np.concatenate(right))
    order = np.argsort(part, kind="stable")
    label = part.copy()
    for m in np.split(order, np.nonzero(np.diff(part[order]))[0] + 1):
        if len(m) > 1:
            groups = ward(n[m], c[m], 1, np.inf, widest)
            label[m] = m[np.unique(groups, return_index=True)[1]][groups]
    return np.unique(label, return_inverse=True)[1]


_MICRO = pa.schema([("region", pa.string()), ("leaf", pa.int64()), ("id", pa.int64()), ("vec", pa.list_(pa.float32())), ("n", pa.int64()), ("radius", pa.float64())])


def micro_labels(x: np.ndarray, widest: float) -> np.ndarray:
    """The micro-cluster of each row of ``x``: leaves of a fine tree, merged by Ward, and a full assignment pass."""
    tree = Tree(FINE)
    for i in range(0, len(x), 512):
        tree.add(np.ones(len(x[i : i + 512])), x[i : i + 512], (x[i : i + 512] ** 2).sum(1))
    n, ls, _ = tree.leaves()
    group = merge_leaves(n, ls / n[:, None], widest)
    sums, sizes = np.zeros((group.max() + 1, x.shape[1])), np.zeros(group.max() + 1)
    np.add.at(sums, group, ls)
    np.add.at(sizes, group, n)
    c = sums / sizes[:, None]
    best = np.concatenate([((c * c).sum(1) - 2 * x[i : i + 1024] @ c.T).argmin(1) for i in range(0, len(x), 1024)])
    return np.unique(best, return_inverse=True)[1]


def _fine(widest: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        """Micro-clusters of a region: rows (leaf, id) of its records and one row a micro-cluster with its centroid and radius."""
        x = matrix(group.column("vec")).astype(float)
        leaf = micro_labels(x, widest)
        size = np.bincount(leaf)
        means = np.zeros((len(size), x.shape[1]))
        np.add.at(means, leaf, x)
        means /= size[:, None]
        radius = np.zeros(len(size))
        np.maximum.at(radius, leaf, np.sqrt(((x - means[leaf]) ** 2).sum(1)))
        ids = group.column("id").to_numpy()
        first = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(first, leaf, ids)
        k, n = len(ids), len(ids) + len(size)
        none = lambda many, kind: pa.nulls(many, kind)
        return pa.table(
            [
                pa.array([key[0].as_py()] * n, pa.string()), pa.array(np.concatenate([first[leaf], first])), pa.concat_arrays([pa.array(ids), none(len(size), pa.int64())]),
                pa.concat_arrays([none(k, pa.list_(pa.float32())), lists(means)]), pa.array(np.concatenate([np.zeros(k, np.int64), size])), pa.array(np.concatenate([np.zeros(k), radius])),
            ], schema=_MICRO,
        )

    return run


def _distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            c = matrix(b.column("ls")).astype(float) / b.column("n").to_numpy()[:, None]
            far = np.sqrt(((matrix(b.column("vec")) - c) ** 2).sum(1))
            top = pa.table({"region": b.column("region"), "radius": pa.array(far)}).group_by("region").aggregate([("radius", "max")])
            yield pa.record_batch([top.column("region").combine_chunks(), top.column("radius_max").combine_chunks()], names=["region", "radius"])


def whole_regions(rows: DataFrame) -> DataFrame:
    """The same rows as ``_fine`` for regions that are one micro-cluster each, however many records they hold."""
    sums = rows.select(F.col("region").alias("first_id"), "vec").mapInArrow(_partial, "first_id string, n bigint, ls array<float>")
    sums = cut(sums.groupBy("first_id").applyInArrow(_sum_lists, "first_id string, n bigint, ls array<float>").withColumnRenamed("first_id", "region"))
    first = rows.groupBy("region").agg(F.min("id").alias("leaf"))
    # regions that cannot be divided hold at least REGION records each: far fewer than records
    radius = rows.join(F.broadcast(sums), "region").select("region", "vec", "n", "ls").mapInArrow(_distance, "region string, radius double").groupBy("region").agg(F.max("radius").alias("radius"))
    mean = F.transform("ls", lambda x: (x / F.col("n")).cast("float"))
    leaves = sums.join(radius, "region").join(first, "region").select("region", "leaf", F.lit(None).cast("bigint").alias("id"), mean.alias("vec"), "n", "radius")
    records = rows.join(F.broadcast(first), "region").select("region", "leaf", "id", F.lit(None).cast("array<float>").alias("vec"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("radius"))
    return records.unionByName(leaves)


def _meet(reach: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        """Links (a, b) between the micro-clusters of a region and some of its visitors, or among themselves."""
        c, r, leaf = matrix(group.column("vec")), group.column("radius").to_numpy(), group.column("leaf").to_numpy()
        at_home = group.column("at_home").to_numpy(zero_copy_only=False)
        among = bool(key[1].as_py() == 0)
        home, other = np.nonzero(at_home)[0], np.arange(len(c)) if among else np.nonzero(~at_home)[0]
        square = (c * c).sum(1)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, len(home), 1024):
            h = home[s : s + 1024]
            d = np.sqrt(np.maximum(square[h][:, None] + square[other] - 2 * c[h] @ c[other].T, 0))
            i, j = np.nonzero(d <= reach + r[h][:, None] + r[other] + 1e-4)
            left.append(leaf[h[i]])
            right.append(leaf[other[j]])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.table({"a": a[a != b], "b": b[a != b]})

    return run


def links(at_home: DataFrame, visits: DataFrame, reach: float) -> DataFrame:
    """(a, b) of micro-clusters whose radii allow similar records.

    A region has at most twice REGION micro-clusters of its own; its visitors come in groups of about VISITORS, each with
    a copy of the region's own.
    """
    own = at_home.select("region", F.lit(True).alias("at_home"), "leaf", "vec", "radius")
    guests = visits.select("region", F.lit(False).alias("at_home"), F.col("id").alias("leaf"), "vec", "radius")
    many = visits.groupBy("region").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("groups"))
    # the numbers of groups are a list of regions: one for REGION records
    own = own.join(many, "region", "left").select("*", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)).alias("part")).drop("groups")
    guests = guests.join(many, "region").withColumn("part", F.pmod(F.xxhash64("leaf"), "groups").cast("int")).drop("groups")
    return own.unionByName(guests).groupBy("region", "part").applyInArrow(_meet(reach), "a bigint, b bigint")


def connect(edges: DataFrame) -> DataFrame:
    """(node, component) of the ends of ``edges`` (a, b): the smallest node of each connected part.

    Labels are lowered to those of the neighbours and then to the label's own label, so long chains halve each round.
    """
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    start = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    labels = cut(start.select(F.col("a").alias("node"), F.least("a", "m").alias("component"), "degree"))
    total = labels.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
    while True:
        # a node can be linked with a third of all
        low = skew_join(both, labels.withColumnRenamed("node", "b"), ["b"], "degree", total).groupBy("a").agg(F.min("component").alias("low"))
        step = labels.join(low.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"), "degree")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        sizes = step.groupBy("component").agg(F.count("*").alias("n"))
        on = skew_join(step, jump.join(sizes, "component"), ["component"], "n", total)
        new = cut(on.select("node", F.least("component", "further").alias("component"), "old", "degree"))
        done = new.filter("component <> old").isEmpty()
        discard(labels)
        labels = new
        if done:
            discard(both)
            return new.select("node", "component")


def _signatures(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Signatures in blocks of records that come sorted by ``block``; a block is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            whole = pa.Table.from_batches(held)
            block = whole.column("block").to_numpy()
            end = int(np.searchsorted(block, block[-1]))  # the last block may go on
            if end:
                yield from _blocks(whole.slice(0, end), least)
                held = whole.slice(end).combine_chunks().to_batches()
        if held:
            yield from _blocks(pa.Table.from_batches(held), least)

    return run


_SIGNED = ["id", "copies", "degree", "first_id", "sum_hash"]


def _blocks(rows: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    block, asks, answers = (rows.column(c).to_numpy() for c in ("block", "asks", "answers"))
    ids, copies, hashes, x = rows.column("id").to_numpy(), rows.column("copies").to_numpy(), rows.column("hash").to_numpy(), matrix(rows.column("vec"))
    cuts = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1, [len(block)]])
    out: list[list[np.ndarray]] = [[] for _ in _SIGNED]
    for s, e in zip(cuts[:-1], cuts[1:]):
        q, a = s + np.nonzero(asks[s:e])[0], s + np.nonzero(answers[s:e])[0]
        for i in range(0, len(q), 1024):
            w = q[i : i + 1024]
            near = x[w] @ x[a].T >= least
            # a record always counts itself and its copies
            near |= ids[w][:, None] == ids[a]
            first = np.where(near, ids[a], np.iinfo(np.int64).max).min(1) if len(a) else np.zeros(0, np.int64)
            with np.errstate(over="ignore"):
                sums = np.where(near, hashes[a], 0).sum(1)
            for o, v in zip(out, (ids[w], copies[w], (near * copies[a]).sum(1), first, sums)):
                o.append(v)
    yield pa.record_batch([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out], names=_SIGNED)


def _block_rows(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the blocks of all ``pairs`` (a, b) of cells: chunk i of a asks chunk j of b.

    ``placed`` (cell, chunk, chunks, size, ...); a pair of a cell with itself is listed too.
    """
    size = placed.groupBy("cell").agg(F.first("chunks").alias("chunks"), F.first("size").alias("size"))
    total = size.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    both = pairs.join(size.select(F.col("cell").alias("a"), F.col("chunks").alias("ca"), F.col("size").alias("na")), "a").join(size.select(F.col("cell").alias("b"), F.col("chunks").alias("cb"), F.col("size").alias("nb")), "b")
    columns = ["id", "copies", "vec", "a", "i", "b", "j"]
    rows = placed.select("cell", "chunk", "id", "copies", "vec")
    asking = skew_join(rows, both.select(F.col("a").alias("cell"), "a", "b", "cb", "na"), ["cell"], "na", total)
    asking = asking.select("*", F.col("chunk").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("j")).select(*columns, F.lit(True).alias("asks"), ((F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))).alias("answers"))
    told = skew_join(rows, both.select(F.col("b").alias("cell"), "a", "b", "ca", "nb"), ["cell"], "nb", total)
    told = told.select("*", F.explode(F.sequence(F.lit(0), F.col("ca") - 1)).alias("i"), F.col("chunk").alias("j")).filter("a <> b OR i <> j").select(*columns, F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    return asking.unionByName(told)


def _sums() -> list[Column]:
    """Parts of a record's signature put together."""
    return [F.sum("degree").alias("degree"), F.min("first_id").alias("first_id"), F.expr("bit_xor(sum_hash)").alias("sum_hash")]


def exact_clusters(candidates: DataFrame, least: float = SIMILAR, linked: DataFrame | None = None, micros: DataFrame | None = None) -> DataFrame:
    """(id, first_id) of the distinct vectors in clusters; ``candidates`` (component, id, vec, copies).

    A candidate of at most BLOCK records is one block. A larger one is checked micro-cluster by micro-cluster (then
    ``candidates`` has ``leaf`` too) along ``linked`` (a, b), with pairs that ``micros`` (leaf, vec, radius) prove to be
    all similar answered by their sums; without these it is divided into chunks, each of which asks all. Only numbers
    come out of a block, never pairs.
    """
    sizes = candidates.groupBy("component").agg(F.count("*").alias("m"))
    large = cut(sizes.filter(F.col("m") > BLOCK))
    total = large.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    # candidates of more than BLOCK records are few: at most one for so many records
    small = candidates.join(F.broadcast(large), "component", "left_anti").select(
        "id", "copies", "vec", F.col("component").alias("a"), F.lit(0).alias("i"), F.col("component").alias("b"), F.lit(0).alias("j"), F.lit(True).alias("asks"), F.lit(True).alias("answers")
    )
    blocks, known = small, None
    if total:
        cell = F.col("leaf" if linked is not None else "component").alias("cell")
        rows = cut(candidates.join(F.broadcast(large), "component").select(cell, "id", "vec", "copies"))
        n = rows.groupBy("cell").agg(F.count("*").alias("size"), F.sum("copies").alias("copies"), F.min("id").alias("first_id"), F.expr("bit_xor(xxhash64(id))").alias("sum_hash"))
        n = cut(n.withColumn("chunks", F.ceil(F.col("size") / BLOCK).cast("int")))
        placed = skew_join(rows, n.select("cell", "chunks", "size", F.col("size").alias("weight")), ["cell"], "weight", total).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
        pairs = n.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
        if linked is not None:
            there = n.select("cell")
            across = linked.join(there.withColumnRenamed("cell", "a"), "a", "left_semi").select("a", "b")
            pairs = pairs.unionByName(across.unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        if micros is not None:
            at = lambda end: micros.select(F.col("leaf").alias(end), F.col("vec").alias("v" + end), F.col("radius").alias("r" + end))
            measured = cut(pairs.join(at("a"), "a").join(at("b"), "b").mapInArrow(_all_similar(least), "a bigint, b bigint, sure boolean"))
            pairs = measured.filter("NOT sure").select("a", "b")
            sure = measured.filter("sure").join(n.select(F.col("cell").alias("b"), F.col("copies").alias("degree"), "first_id", "sum_hash"), "b").groupBy(F.col("a").alias("cell")).agg(*_sums())
            known = skew_join(rows.select("cell", "id", "copies"), sure.join(n.select("cell", F.col("size").alias("weight")), "cell"), ["cell"], "weight", total).select(*_SIGNED)
        blocks = blocks.unionByName(_block_rows(placed, pairs))
    keyed = blocks.select(F.xxhash64("a", "i", "b", "j").alias("block"), "asks", "answers", "id", "copies", F.xxhash64("id").alias("hash"), "vec")
    signed = parallel(keyed, "block").sortWithinPartitions("block").mapInArrow(_signatures(least), ", ".join(f"{c} bigint" for c in _SIGNED))
    signed = signed if known is None else signed.unionByName(known)
    signed = signed.groupBy("id", "copies").agg(*_sums())
    agree = signed.groupBy("degree", "first_id", "sum_hash").agg(F.sum("copies").alias("n"))
    agree = agree.filter("n = degree AND n > 1")
    # a cluster can hold a third of all records; its signature is one row
    weights = agree.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return skew_join(signed.drop("copies"), agree, ["degree", "first_id", "sum_hash"], "n", weights).select("id", "first_id")


def _all_similar(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of micro-clusters by whether all their records must be similar: no two can be farther apart than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = np.sqrt(((matrix(b.column("va")).astype(float) - matrix(b.column("vb"))) ** 2).sum(1))
                sure = d + b.column("ra").to_numpy() + b.column("rb").to_numpy() <= np.sqrt(2 - 2 * least) - 1e-3
                yield pa.record_batch([b.column("a"), b.column("b"), pa.array(sure)], names=["a", "b", "sure"])

    return run


def micro_clusters(vectors: DataFrame, region: int = REGION, least: float = SIMILAR) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of ``_fine`` over all vectors (id, vec), and the centres of each level of regions.

    Regions of more than twice the wanted size are divided, level by level. One that hardly falls apart any more (its
    vectors are all but equal) is one micro-cluster.
    """
    rows = cut(vectors.select(F.concat(F.lit("0"), F.substring(F.col("id").cast("string"), 1, 0)).alias("region"), "id", "vec", F.lit(0.0).alias("sim")))
    levels: list[DataFrame] = []
    whole: list[DataFrame] = []
    before = None
    while True:
        over = rows.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * region)
        if before is not None:
            # by name a part belongs to the region it was cut from
            up = before.select(F.col("region").alias("above"), F.col("n").alias("m"))
            over = over.withColumn("above", F.regexp_replace("region", r"\.[0-9]+$", "")).join(up, "above", "left")
            over = over.select("region", "n", (F.col("n") > INSEPARABLE * F.coalesce("m", F.col("n") * 2)).alias("fixed"))
        else:
            over = over.select("region", "n", F.lit(False).alias("fixed"))
        over = cut(over)
        fixed = over.filter("fixed").select("region")
        if not fixed.isEmpty():
            whole.append(cut(rows.join(F.broadcast(fixed), "region", "left_semi")))
            rows = cut(rows.join(F.broadcast(fixed), "region", "left_anti"))
        over = over.filter("NOT fixed").select("region", "n")
        if over.isEmpty():
            break
        centres = split_centres(rows, over, region)
        levels.append(centres)
        old, rows = rows, cut(descend(rows, [centres], 1))
        discard(old)
        before = over
    widest = float(np.sqrt(2 - 2 * least))
    micro = rows.groupBy("region").applyInArrow(_fine(widest), "region string, leaf bigint, id bigint, vec array<float>, n bigint, radius double")
    for part in whole:
        micro = micro.unionByName(whole_regions(part))
    micro = cut(micro)
    discard(rows, *whole)
    return micro, levels


def candidates(vectors: DataFrame, least: float = SIMILAR, region: int = REGION, visits: int | None = VISITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(component, leaf, id, vec, copies): records that may share a cluster with another record; the links and micro-clusters."""
    micro, levels = micro_clusters(vectors.select("id", "vec"), region, least)
    leaves = micro.filter("vec IS NOT NULL").select(F.col("region").alias("home"), "leaf", "vec", "n", "radius")
    reach = float(np.sqrt(2 - 2 * least))
    went = leaves.select(F.substring(F.col("home"), 1, 1).alias("region"), F.col("leaf").alias("id"), "home", "vec", "radius", F.lit(0.0).alias("sim"))
    if visits is not None and levels:
        went = cut(descend(went, levels, visits))
    else:
        for i, centres in enumerate(levels):
            went = route(went if not i else cut(went), centres, visits, reach, deeper=i > 0)
    at_home = leaves.select(F.col("home").alias("region"), "leaf", "vec", "radius")
    linked = cut(links(at_home, went.filter("region <> home"), reach).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    alone = leaves.filter("n > 1").select(F.col("leaf").alias("a"), F.col("leaf").alias("b"))
    parts = connect(linked.unionByName(alone)).withColumnRenamed("node", "leaf")
    sizes = leaves.select("leaf", F.col("n").alias("weight"))
    total = sizes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    # a vector that meets no other is still a candidate if it was entered several times; a micro-cluster can hold a third of all
    named = sizes.join(parts, "leaf", "left")
    records = skew_join(micro.filter("vec IS NULL").select("leaf", "id"), named, ["leaf"], "weight", total).join(vectors, "id")
    found = records.filter("component IS NOT NULL OR copies > 1").select(F.coalesce("component", "leaf").alias("component"), "leaf", "id", "vec", "copies")
    return found, linked, leaves.select("leaf", "vec", "radius")


def clusters(units: DataFrame, least: float = SIMILAR, region: int = REGION, visits: int | None = VISITS) -> DataFrame:
    """(first_id, id) of all records in clusters of two or more; ``visits`` None finds every cluster there is."""
    classes = cut(distinct_vectors(units))
    rows, linked, micros = candidates(classes, least, region, visits)
    found = cut(exact_clusters(cut(rows), least, linked, micros))
    return expand(units, classes, found)


def expand(units: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Clusters of distinct vectors with the copies of each vector."""
    copies = members(units, classes).withColumnRenamed("class_id", "vector_id").withColumnRenamed("id", "member")
    all_ = found.withColumnRenamed("id", "vector_id").join(copies, "vector_id", "left")
    return all_.select("first_id", F.coalesce("member", "vector_id").alias("id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(cut(_units(spark, sf_dir))).filter("id <> first_id").select("first_id", F.col("id").alias("member_id"))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cluster features (n, linear sum) of the clusters met in a batch."""
    for b in batches:
        if b.num_rows:
            codes = b.column("first_id").dictionary_encode()
            at = codes.indices.to_numpy()
            sums = np.zeros((len(codes.dictionary), DIMENSIONS))
            np.add.at(sums, at, matrix(b.column("vec")))
            yield pa.record_batch([codes.dictionary, pa.array(np.bincount(at)), lists(sums)], names=["first_id", "n", "ls"])


def _cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            c = matrix(b.column("ls"))
            near = (matrix(b.column("vec")) * c).sum(1) / np.sqrt((c * c).sum(1))
            yield pa.record_batch([b.column("first_id"), b.column("id"), b.column("n"), pa.array(np.round(near.astype(float), 5))], names=["first_id", "id", "n", "cosine"])


def _sum_lists(key: tuple, group: pa.Table) -> pa.Table:
    total = matrix(group.column("ls")).astype(float).sum(0, keepdims=True)
    return pa.table({"first_id": pa.array([key[0].as_py()], key[0].type), "n": pa.array([int(group.column("n").to_numpy().sum())]), "ls": lists(total)})


def describe(found: DataFrame, units: DataFrame, typical: int = 3) -> DataFrame:
    """(first_id, n_members, rank, id, cosine): each cluster's size and the members nearest to its centroid.

    Sums are made batch by batch, so what is gathered for a cluster is one row a batch, not its members.
    """
    rows = cut(found.join(units, "id").select("first_id", "id", "vec"))
    features = rows.mapInArrow(_partial, "first_id bigint, n bigint, ls array<float>")
    sums = features.groupBy("first_id").applyInArrow(_sum_lists, "first_id bigint, n bigint, ls array<float>")
    scored = cut(rows.join(sums, "first_id").mapInArrow(_cosine, "first_id bigint, id bigint, n bigint, cosine double"))
    salted = Window.partitionBy("first_id", "salt").orderBy(F.desc("cosine"), "id")
    few = scored.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= typical)
    best = Window.partitionBy("first_id").orderBy(F.desc("cosine"), "id")
    return few.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= typical).select("first_id", F.col("n").alias("n_members"), "rank", "id", "cosine")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size and its most typical records."""
    units = cut(_units(spark, sf_dir))
    return describe(clusters(units), units)


QUERIES = {"p5_found": p5_found, "p5_clusters": p5_clusters}
SQL: dict[str, str] = {
    "p5_found": SIMILAR_SQL + ", n AS (SELECT i, list_sort(list_append(list(j), i)) AS near FROM s GROUP BY i), g AS (SELECT near FROM n GROUP BY near HAVING count(*) = len(near)) SELECT near[1] AS first_id, i AS member_id FROM n JOIN g USING (near) WHERE i <> near[1]",
}
