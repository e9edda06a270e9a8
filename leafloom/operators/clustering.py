"""Clustering and reduction of vectors: k-means, DBSCAN, Ward, HDBSCAN-like, PCA, t-SNE, and their scores."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom.common import cut, discard
from leafloom.operators.similarity import similar_pairs, similarity_components

#: Most rows an operator that needs all of them in one task accepts; it refuses more rather than dropping any.
ONE_TASK = 5_000


def _features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform("vec", lambda x: x.cast("double"))))


def k_means(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, vec, cluster)."""
    rows = _features(df).select("features").cache()
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    rows.unpersist()
    return model.transform(_features(df)).select("id", "vec", "cluster")


def dbscan(df: DataFrame, min_cosine: float, min_samples: int) -> DataFrame:
    """(id, cluster): density clusters by cosine; -1 is noise.

    Core vectors have ``min_samples`` neighbours, themselves included; connected cores are a cluster, other vectors join
    that of their nearest core.
    """
    pairs = cut(similar_pairs(df.select("id", "vec"), None, min_cosine))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    cores = cut(df.select("id").join(both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")), "id", "left").filter(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("id"))
    links = pairs.join(cores.withColumnRenamed("id", "a"), "a", "left_semi").join(cores.withColumnRenamed("id", "b"), "b", "left_semi")
    of_cores = similarity_components(links.select("a", "b"), cores)
    border = both.join(cores.withColumnRenamed("id", "b"), "b", "left_semi").join(cores.withColumnRenamed("id", "a"), "a", "left_anti")
    joined = border.groupBy(F.col("a").alias("id")).agg(F.max_by("b", F.struct("sim", -F.col("b"))).alias("core")).join(of_cores.select(F.col("id").alias("core"), "cluster"), "core").select("id", "cluster")
    return df.select("id").join(of_cores.unionByName(joined), "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _ward(x: np.ndarray, k: int) -> np.ndarray:
    n = len(x)
    labels, size, left = np.arange(n), np.ones(n), n
    d = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    while left > k:
        i, j = sorted(np.unravel_index(int(d.argmin()), d.shape))
        row = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        row[[i, j]] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        size[i] += size[j]
        labels[labels == j] = i
        left -= 1
    return np.unique(labels, return_inverse=True)[1]


def _one_task(df: DataFrame, fn, schema: str) -> DataFrame:
    n = df.count()
    if n > ONE_TASK:
        raise ValueError(f"{n} rows do not fit one task (at most {ONE_TASK}); use the cluster-feature operator")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield fn(pd.concat(parts, ignore_index=True).sort_values("id", ignore_index=True))

    return df.repartition(1).mapInPandas(run, schema)


def agglomerative(df: DataFrame, k: int) -> DataFrame:
    """(id, cluster) by Ward linkage, for sets of checked size."""
    return _one_task(df.select("id", "vec"), lambda p: pd.DataFrame({"id": p["id"], "cluster": _ward(np.stack(p["vec"]).astype(float), k)}), f"id {dict(df.dtypes)['id']}, cluster int")


def _density_tree(x: np.ndarray, min_size: int) -> np.ndarray:
    """Mutual-reachability spanning tree cut where parts of at least ``min_size`` separate with the largest gap."""
    x = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)
    d = 1 - x @ x.T
    core = np.sort(d, axis=1)[:, min(min_size, len(x) - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    seen, best, link, edges = np.zeros(len(x), bool), reach[0].copy(), np.zeros(len(x), int), []
    seen[0] = True
    for _ in range(len(x) - 1):
        j = int(np.where(seen, np.inf, best).argmin())
        edges.append((best[j], link[j], j))
        seen[j] = True
        closer = reach[j] < best
        best[closer], link[closer] = reach[j][closer], j
    edges.sort()
    gaps = np.diff([e[0] for e in edges]) if len(edges) > 1 else np.array([])
    at = edges[int(gaps.argmax())][0] if len(gaps) else np.inf
    parent = np.arange(len(x))
    for w, a, b in edges:
        if w <= at:
            ra, rb = a, b
            while parent[ra] != ra:
                ra = parent[ra]
            while parent[rb] != rb:
                rb = parent[rb]
            parent[max(ra, rb)] = min(ra, rb)
    root = np.arange(len(x))
    for i in range(len(x)):
        while parent[root[i]] != root[i]:
            root[i] = parent[root[i]]
    _, label, n = np.unique(root, return_inverse=True, return_counts=True)
    return np.where(n[label] >= min_size, label, -1)


def density_tree_clusters(df: DataFrame, min_size: int = 5) -> DataFrame:
    """(id, cluster): hierarchical density clusters by cosine, -1 is noise, for sets of checked size."""
    return _one_task(df.select("id", "vec"), lambda p: pd.DataFrame({"id": p["id"], "cluster": _density_tree(np.stack(p["vec"]).astype(float), min_size)}), f"id {dict(df.dtypes)['id']}, cluster int")


def pca(df: DataFrame, n: int | float) -> DataFrame:
    """(id, vec) in the first ``n`` components, or as many as explain the share ``n``; vectors are centred first."""
    rows = _features(df)
    mean = rows.select(Summarizer.mean(F.col("features")).alias("m")).first()[0].toArray().tolist()
    centred = rows.select("id", F.zip_with("vec", F.lit(mean), lambda a, b: a.cast("double") - b).alias("vec"))
    wanted = int(n) if n >= 1 else len(mean)
    model = PCA(k=wanted, inputCol="features", outputCol="out").fit(_features(centred))
    if n < 1:
        wanted = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), n) + 1)
    return model.transform(_features(centred)).select("id", F.slice(vector_to_array("out"), 1, wanted).alias("vec"))


def _tsne(x: np.ndarray, n: int, perplexity: float, rounds: int, seed: int) -> np.ndarray:
    d = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0)
    p = np.zeros_like(d)
    for i in range(len(x)):
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            e = np.exp(-(d[i] - d[i].min()) * beta)
            e[i] = 0
            q = e / max(e.sum(), 1e-12)
            h = -(q[q > 0] * np.log(q[q > 0])).sum()
            if abs(h - np.log(perplexity)) < 1e-4:
                break
            low, high = (beta, high) if h > np.log(perplexity) else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i] = q
    p = np.maximum((p + p.T) / (2 * len(x)), 1e-12)
    y, v = np.random.default_rng(seed).normal(0, 1e-4, (len(x), n)), np.zeros((len(x), n))
    for r in range(rounds):
        num = 1 / (1 + np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1) - 2 * y @ y.T, 0))
        np.fill_diagonal(num, 0)
        w = (p * (4 if r < 100 else 1) - np.maximum(num / num.sum(), 1e-12)) * num
        v = (0.5 if r < 100 else 0.8) * v - 100 * 4 * (np.diag(w.sum(1)) - w) @ y / 4
        y = y + v
    return y - y.mean(0)


def tsne(df: DataFrame, n: int = 2, perplexity: float = 30.0, rounds: int = 300, seed: int = 42) -> DataFrame:
    """(id, vec): exact t-SNE, for sets of checked size."""
    return _one_task(df.select("id", "vec"), lambda p: pd.DataFrame({"id": p["id"], "vec": list(_tsne(np.stack(p["vec"]).astype(float), n, min(perplexity, max(1.0, (len(p) - 1) / 3)), rounds, seed))}), f"id {dict(df.dtypes)['id']}, vec array<double>")


def silhouette(clustered: DataFrame) -> float | None:
    """Squared-Euclidean silhouette without noise; None for fewer than two clusters."""
    kept = clustered.filter("cluster <> -1")
    names = kept.select("cluster").distinct().withColumn("no", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("double"))  # one row a cluster
    rows = _features(kept.join(names, "cluster").select("id", "vec", F.col("no").alias("cluster")))
    if rows.select("cluster").distinct().count() < 2:
        return None
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(rows)


def davies_bouldin(clustered: DataFrame) -> DataFrame:
    """(davies_bouldin, n_clusters) without noise: per-dimension means, then a self join of the centroids."""
    long = clustered.filter("cluster <> -1").select("id", "cluster", F.posexplode("vec").alias("d", "v"))
    means = long.groupBy("cluster", "d").agg(F.avg("v").alias("m"))
    spread = long.join(means, ["cluster", "d"]).groupBy("cluster", "id").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("m"), 2))).alias("dist")).groupBy("cluster").agg(F.avg("dist").alias("s"))
    a, b = (means.select(F.col("cluster").alias(c), "d", F.col("m").alias(m)) for c, m in (("a", "ma"), ("b", "mb")))
    apart = a.join(b, "d").filter("a <> b").groupBy("a", "b").agg(F.sqrt(F.sum(F.pow(F.col("ma") - F.col("mb"), 2))).alias("dist"))
    ratio = apart.join(spread.select(F.col("cluster").alias("a"), F.col("s").alias("sa")), "a").join(spread.select(F.col("cluster").alias("b"), F.col("s").alias("sb")), "b")
    worst = ratio.groupBy("a").agg(F.max(F.try_divide(F.col("sa") + F.col("sb"), F.col("dist"))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"), F.count("*").alias("n_clusters"))


#: The clusterings of a grid: name and a function of (id, vec) to (id, cluster).
CLUSTERERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "k-means 5": lambda df: k_means(df, 5), "k-means 10": lambda df: k_means(df, 10), "dbscan 0.3": lambda df: dbscan(df, 0.3, 4),
    "ward 5": lambda df: agglomerative(df, 5), "ward 10": lambda df: agglomerative(df, 10), "density 5": lambda df: density_tree_clusters(df, 5),
}


def grid_search(df: DataFrame, reductions: dict[str, Callable[[DataFrame], DataFrame] | None], clusterers: dict[str, Callable[[DataFrame], DataFrame]] | list[int], top: int = 5) -> list[tuple[str, str | int, float]]:
    """(reduction, clustering, silhouette) of every combination, best first; each is a distributed job of its own.

    A list of numbers stands for k-means with as many clusters. Noise does not count; a combination with fewer than two clusters has no score and is left out.
    """
    if not isinstance(clusterers, dict):
        clusterers = {k: functools.partial(k_means, k=k) for k in clusterers}
    found = []
    for name, reduce_ in reductions.items():
        reduced = cut(reduce_(df).select("id", "vec") if reduce_ else df.select("id", "vec"))
        for how, cluster in clusterers.items():
            score = silhouette(reduced.join(cluster(reduced).select("id", "cluster"), "id"))
            if score is not None:
                found.append((name, how, score))
        discard(reduced)
    return sorted(found, key=lambda x: (-x[2], x[0], x[1]))[:top]


def cluster_file(clustered: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, count, labels): the labels of each cluster in order."""
    return clustered.join(labels, "id").groupBy("cluster").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("label")).alias("labels"))


def reduce_and_cluster(df: DataFrame, n: int | float, k: int, active: float = 4.0) -> DataFrame:
    """PCA, one place a section, k-means."""
    from leafloom.operators.similarity import append_section

    reduced = pca(df, n).join(df.select("id", "section"), "id").select("id", "section", F.transform("vec", lambda x: x.cast("float")).alias("vec"))
    return k_means(append_section(reduced, active).select("id", "vec"), k).select("id", "cluster")
