"""Problem 7: the most similar vectors of every vector, by an inverted multi-index.

Both halves of the unit vectors are quantised separately (k-means on a bounded sample); a pair of centroids is a cell
and every vector is an entry of one cell. A query walks the pairs of centroids by summed distance with a heap and
visits the first ``probes`` cells; their entries are reranked by exact cosine. An exact search goes on to every cell
that can hold something as near as the k-th found: by the triangle inequality in both halves no entry of a cell is
nearer than the query's distances to its centroids less the cell's radii. Work is laid out by runs
of cells in the order of their centroids, neighbouring first centroids side by side: a run holds at most about
PART_ENTRIES entries, and a query is sent once to each run that holds a cell it visits. A cell with more entries is a run
of its own, divided into parts that each see its queries, so no entry is ever left out. In a run the entries are loaded
and the queries streamed past them, however many they are.

Exact copies are one entry; they come back with the answers. Defined results: unusable vectors (null, all zero, other
dimension, NaN) are neither queries nor entries; ties go to the smaller id; ids are unique; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.common import cut, parallel, skew_join, spread, table
from leafloom.llm.vectors import DIMENSIONS, distinct_vectors, first_members, lists, matrix, members, unit_vectors

HALF = DIMENSIONS // 2
#: Vectors the centroids are fitted to: at least, for each centroid, and at most.
SAMPLE, SAMPLE_EACH, SAMPLE_MOST = 20_000, 40, 400_000
#: Entries a cell should hold; cells a query visits; entries of a run of cells.
CELL_ENTRIES, PROBES, PART_ENTRIES = 128, 24, 20_000
#: Added to squared distances for the rounding of cosines; bounds (query by cell) computed at once.
SLACK, BOUNDS = 1e-5, 4_000_000


def k_means(points: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmin((centroids**2).sum(1) - 2 * points @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=len(centroids))[:, None]
        centroids = np.where(n > 0, sums / np.maximum(n, 1), centroids)
    return centroids.astype(np.float32)


def nearest_pairs(first: list[float], second: list[float], probes: int) -> list[tuple[int, int]]:
    """Positions in two ascending lists of distances, by rising sum: a heap holds the frontier of the walk."""
    heap, out = [(first[0] + second[0], 0, 0)], []
    while heap and len(out) < probes:
        _, i, j = heapq.heappop(heap)
        out.append((i, j))
        if not j and i + 1 < len(first):
            heapq.heappush(heap, (first[i + 1] + second[0], i + 1, 0))
        if j + 1 < len(second):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
    return out


def _distances(m: np.ndarray, book: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return tuple((h**2).sum(1)[:, None] + (c**2).sum(1) - 2 * h @ c.T for h, c in zip((m[:, :HALF], m[:, HALF:]), book))


def _entries(book) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column("vec"))
            u, v = (d.argmin(1) for d in _distances(m, book.value))
            r1, r2 = (np.sqrt(((h.astype(np.float64) - c[x]) ** 2).sum(1)) for h, c, x in zip((m[:, :HALF], m[:, HALF:]), book.value, (u, v)))
            yield pa.record_batch([pa.array(u, pa.int32()), pa.array(v, pa.int32()), b.column("id"), b.column("vec"), pa.array(r1), pa.array(r2)], names=["u", "v", "id", "vec", "r1", "r2"])

    return run


class Runs:
    """The runs of cells: a cell is numbered first centroid x number of second centroids + second centroid."""

    def __init__(self, width: int, starts: np.ndarray, parts: np.ndarray) -> None:
        self.width, self.starts, self.parts = width, starts, parts  # first cell and number of parts of each run

    def sent(self, ids: pa.Array, m: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Queries (positions ``rows``, ascending, and the ``cells`` each visits) as one row a run and part."""
        run = np.searchsorted(self.starts, cells, "right") - 1
        order = np.lexsort((cells, run, rows))
        rows, run, cells = rows[order], run[order], cells[order]
        first = np.nonzero(np.diff(rows, prepend=-1) | np.diff(run, prepend=-1))[0]
        asked = pa.ListArray.from_arrays(pa.array(np.append(first, len(cells)), pa.int32()), pa.array(cells, pa.int64()))
        times = self.parts[run[first]]
        at = np.repeat(np.arange(len(first)), times)
        part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        who = rows[first][at]
        for s in range(0, len(at), 10_000):
            e = slice(s, s + 10_000)
            yield pa.record_batch([pa.array(run[first][at[e]], pa.int64()), pa.array(part[e], pa.int32()), asked.take(pa.array(at[e])), ids.take(pa.array(who[e])), lists(m[who[e]])], names=["run", "part", "cells", "id", "vec"])


_SENT = "run bigint, part int, cells array<bigint>, id bigint, vec array<float>"


def _queries(book, runs, probes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = runs.value.width
        for b in batches:
            m = matrix(b.column("vec"))
            d1, d2 = _distances(m, book.value)
            o1, o2 = d1.argsort(1)[:, :probes], d2.argsort(1)[:, :probes]
            s1, s2 = np.take_along_axis(d1, o1, 1).tolist(), np.take_along_axis(d2, o2, 1).tolist()
            walks = [nearest_pairs(x, y, probes) for x, y in zip(s1, s2)]
            rows = np.repeat(np.arange(len(m)), [len(w) for w in walks])
            x, y = np.array([c for w in walks for c in w], np.int64).reshape(-1, 2).T
            yield from runs.value.sent(b.column("id"), m, rows, o1[rows, x] * width + o2[rows, y])

    return run


def _bounded(book, runs, cells) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query to all cells that can hold an entry of at least its cosine ``kth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, r1, r2 = cells.value
        wide = tuple(c.astype(np.float64) for c in book.value)
        step = max(1, BOUNDS // len(u))
        for b in batches:
            m, most = matrix(b.column("vec")), 2 - 2 * b.column("kth").to_numpy(zero_copy_only=False) + SLACK
            for s in range(0, len(m), step):
                d1, d2 = (np.sqrt(np.maximum(d, 0)) for d in _distances(m[s : s + step].astype(np.float64), wide))
                low = np.maximum(d1[:, u] - r1, 0) ** 2 + np.maximum(d2[:, v] - r2, 0) ** 2
                rows, at = np.nonzero(low <= most[s : s + step, None])
                yield from runs.value.sent(b.column("id"), m, s + rows, u[at].astype(np.int64) * runs.value.width + v[at])

    return run


class Entries:
    """The entries of one run and part, by cell."""

    def __init__(self, rows: pa.Table) -> None:
        cell = rows.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        self.cell, self.id, self.vec = cell[order], rows.column("id").to_numpy()[order], matrix(rows.column("vec"))[order]

    def rerank(self, rows: pa.RecordBatch, k: int, least: float) -> pa.RecordBatch | None:
        """The ``k`` best entries of each query of a batch among those of the cells it visits."""
        q, q_id, cells = matrix(rows.column("vec")), rows.column("id").to_numpy(), rows.column("cells")
        lengths, v = np.diff(cells.offsets.to_numpy()), cells.flatten().to_numpy()
        asks = np.repeat(np.arange(len(q)), lengths)
        order = np.argsort(v, kind="stable")
        v, asks = v[order], asks[order]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for cell in np.unique(v):
            a, z = np.searchsorted(self.cell, cell), np.searchsorted(self.cell, cell, "right")
            if a == z:
                continue
            who = asks[np.searchsorted(v, cell) : np.searchsorted(v, cell, "right")]
            for s in range(0, len(who), 1024):
                w = who[s : s + 1024]
                sim = np.maximum(q[w] @ self.vec[a:z].T, -1)
                sim[q_id[w][:, None] == self.id[None, a:z]] = -np.inf
                if z - a > 4 * k and (sim >= least).sum() > 4 * k * len(w):
                    # a dense cell: the k-th best bounds what is kept (ties stay)
                    sim[sim < np.partition(sim, z - a - k, axis=1)[:, -k][:, None]] = -np.inf
                i, j = np.nonzero(sim >= least)
                found.append((w[i], a + j, sim[i, j]))
        if not found:
            return None
        i, j, sim = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((self.id[j], -sim, i))
        i, j, sim = i[order], j[order], sim[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = place < k
        return pa.record_batch([pa.array(q_id[i[kept]]), pa.array(self.id[j[kept]]), pa.array(sim[kept].astype(np.float64))], names=["id", "other", "cosine"])


def _rerank(k: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by run, part and kind: the entries of a part are held, the queries after them streamed past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, entries = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("run", "part", "asks")], 1) if b.num_rows else np.zeros((0, 3))
            cuts = np.concatenate([[0], np.nonzero(np.diff(keys, axis=0).any(1))[0] + 1, [len(keys)]]).astype(int)
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                key, asks = (int(keys[s, 0]), int(keys[s, 1])), bool(keys[s, 2])
                if key != at:
                    at, held, entries = key, [], None
                some = b.slice(s, e - s)
                if not asks:
                    held.append(some)
                elif held:
                    entries = entries or Entries(pa.Table.from_batches(held))
                    best = entries.rerank(pa.Table.from_batches([some]).combine_chunks().to_batches()[0], k, least)
                    if best is not None:
                        yield best

    return run


def codebook(entries: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves, fitted to a bounded sample; as many as give cells of about CELL_ENTRIES.

    Neighbouring first centroids get neighbouring numbers: each is followed by the nearest of those left.
    """
    k = max(4, round((total / CELL_ENTRIES) ** 0.5))
    size = min(max(SAMPLE, SAMPLE_EACH * k), SAMPLE_MOST)
    # drawn by a hash where the vectors lie: about as many reach the driver as are wanted, however many partitions there are
    share = int(min(1.0, size / total) * (1 << 30))
    sample = entries.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= share).select("vec").toPandas()
    if not len(sample):
        sample = entries.limit(size).select("vec").toPandas()
    m = np.stack(sample["vec"].to_numpy()).astype(np.float32)
    first, second = k_means(m[:, :HALF], k), k_means(m[:, HALF:], k)
    order, left = [0], np.ones(len(first), bool)
    left[0] = False
    while left.any():
        d = ((first - first[order[-1]]) ** 2).sum(1)
        order.append(int(np.where(left, d, np.inf).argmin()))
        left[order[-1]] = False
    return first[order], second


def cell_runs(placed: DataFrame, width: int, part_entries: int) -> Runs:
    """Runs of cells of at most about ``part_entries`` entries, from counts of all entries (u, v).

    Sums run over the second centroids of one first centroid, then over the first centroids; only the runs, one for so
    many entries or a first centroid, come to the driver.
    """
    n = placed.groupBy("u", "v").agg(F.count("*").alias("n"))
    base = n.groupBy("u").agg(F.sum("n").alias("size")).withColumn("base", F.sum("size").over(Window.orderBy("u")) - F.col("size")).select("u", "base")
    within = Window.partitionBy("u").orderBy("v")
    cells = n.join(F.broadcast(base), "u").withColumn("before", F.col("base") + F.sum("n").over(within) - F.col("n"))
    dense = F.col("n") > part_entries
    cells = cells.select("u", "v", F.when(dense, -1 - F.col("u").cast("bigint") * width - F.col("v")).otherwise(F.floor(F.col("before") / part_entries)).alias("run"), F.when(dense, F.ceil(F.col("n") / part_entries)).otherwise(1).cast("bigint").alias("parts"))
    # a run begins where the number of the cell before it is another; within a first centroid, so no window spans them all
    begins = cells.withColumn("last", F.lag("run").over(within)).filter("last IS NULL OR last <> run")
    rows = begins.select((F.col("u").cast("bigint") * width + F.col("v")).alias("cell"), "run", "parts").toPandas().sort_values("cell")
    new = rows["run"].ne(rows["run"].shift()).to_numpy()
    return Runs(width, rows["cell"].to_numpy(np.int64)[new], rows["parts"].to_numpy(np.int64)[new])


def _placed_entries(runs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column("u").to_numpy().astype(np.int64) * runs.value.width + b.column("v").to_numpy()
            at = np.searchsorted(runs.value.starts, cell, "right") - 1
            part = np.abs(b.column("hash").to_numpy() % runs.value.parts[at])
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(part, pa.int32()), pa.array(cell), b.column("id"), b.column("vec")], names=["run", "part", "cell", "id", "vec"])

    return run


def nearest(entries: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.85, probes: int = PROBES, exact: bool = False, part_entries: int = PART_ENTRIES) -> DataFrame:
    """(id, other, cosine): for each of ``queries`` (id, vec) its ``k`` most similar other ``entries`` (id, vec) found.

    ``exact``: none is missed. The first ``probes`` cells then only bound the search, however many cells there are.
    """
    spark = entries.sparkSession
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "id bigint, other bigint, cosine double")
    centroids = codebook(entries, total)
    book = spark.sparkContext.broadcast(centroids)
    placed = cut(spread(entries.select("id", "vec")).mapInArrow(_entries(book), "u int, v int, id bigint, vec array<float>, r1 double, r2 double"))
    runs = spark.sparkContext.broadcast(cell_runs(placed, len(centroids[1]), part_entries))
    held = placed.select("u", "v", F.xxhash64("id").alias("hash"), "id", "vec").mapInArrow(_placed_entries(runs), "run bigint, part int, cell bigint, id bigint, vec array<float>")
    held = held.select("run", "part", F.lit(False).alias("asks"), "cell", F.lit(None).cast("array<bigint>").alias("cells"), "id", "vec")

    def answers(asked: DataFrame) -> DataFrame:
        asked = asked.select("run", "part", F.lit(True).alias("asks"), F.lit(None).cast("bigint").alias("cell"), "cells", "id", "vec")
        rows = parallel(held.unionByName(asked), "run", "part").sortWithinPartitions("run", "part", "asks")
        best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
        return rows.mapInArrow(_rerank(k, least), "id bigint, other bigint, cosine double").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("id", "other", "cosine")

    found = answers(spread(queries.select("id", "vec")).mapInArrow(_queries(book, runs, probes), _SENT))
    if not exact:
        return found
    radii = placed.groupBy("u", "v").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2")).toPandas().sort_values(["u", "v"])
    cells = spark.sparkContext.broadcast(tuple(radii[c].to_numpy() for c in ("u", "v", "r1", "r2")))
    kth = found.groupBy("id").agg(F.when(F.count("*") == k, F.min("cosine")).otherwise(least).alias("kth"))
    bounded = queries.select("id", "vec").join(kth, "id", "left").select("id", "vec", F.greatest("kth", F.lit(max(least, -1.0))).alias("kth"))
    return answers(parallel(bounded, "id").mapInArrow(_bounded(book, runs, cells), _SENT))


def nearest_records(units: DataFrame, k: int = 5, least: float = 0.85, probes: int = PROBES) -> DataFrame:
    """(id, other, cosine) for every record; copies of one vector are each other's nearest, by id."""
    classes = cut(distinct_vectors(units))
    near = cut(nearest(classes, classes, k, least, probes))
    own = members(units, classes)
    few = cut(first_members(own, k + 1))
    if few.isEmpty():
        return near
    # of a neighbouring class at most its first k + 1 members can be among the k nearest
    others = few.withColumnRenamed("class_id", "other").withColumnRenamed("id", "member").drop("r")
    lists_ = near.join(others, "other", "left").select("id", F.coalesce("member", "other").alias("other"), "cosine")
    copies = few.select("class_id", F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    askers = own.unionByName(near.select(F.col("id").alias("class_id"), "id").distinct().join(own.select("class_id").distinct(), "class_id", "left_anti"))
    by_class = lists_.withColumnRenamed("id", "class_id").unionByName(copies)
    # an asker's list: at most (k + 1) classes of (k + 1) members; a class can hold a third of all records
    sizes = classes.select(F.col("id").alias("class_id"), "copies")
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    each = skew_join(askers, by_class.join(sizes, "class_id"), ["class_id"], "copies", total).filter("id <> other")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return each.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("id", "other", "cosine")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_vectors(table(spark, sf_dir, "effect_vectors"), "side_effect_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_records(cut(_units(spark, sf_dir)))
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p7_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every record whose id is divisible by 100, whatever their cosine, against all records."""
    units = cut(_units(spark, sf_dir))
    return nearest(units, units.filter("id % 100 = 0"), 10, -1.0, 4 * PROBES, exact=True).select("id", "other", F.round("cosine", 4).alias("cosine"))


QUERIES = {"p7_found": p7_found, "p7_searches": p7_searches}
#: All pairs of usable vectors by their cosine, for small tables.
SIMILAR_SQL = """WITH u AS (SELECT side_effect_id AS id, CAST(vec AS DOUBLE[]) AS v FROM effect_vectors
    WHERE len(vec) = 64 AND list_sum(list_transform(vec, lambda x: abs(x))) > 0),
  s AS (SELECT * FROM (SELECT a.id AS i, b.id AS j, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.id <> b.id) WHERE c >= 0.85)"""
SQL: dict[str, str] = {
    "p7_found": SIMILAR_SQL + " SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS r FROM s) WHERE r <= 5",
}
