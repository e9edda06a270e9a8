"""Pairs of terms for a synonym model, from labelled clusters (cluster, label, group_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _within(labels: DataFrame, condition) -> DataFrame:
    a, b = labels.alias("a"), labels.alias("b")
    return a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.label") < F.col("b.label")) & condition).select(F.col("a.label").alias("a"), F.col("b.label").alias("b")).distinct()


def positive_pairs(labels: DataFrame) -> DataFrame:
    """Labels of one group of a cluster, each pair once."""
    return _within(labels.filter("group_id IS NOT NULL").distinct(), F.col("a.group_id") == F.col("b.group_id"))


def negative_pairs(labels: DataFrame, lexical: bool = True) -> DataFrame:
    """Labels of different groups of a cluster; labels without a group pair with grouped ones, unless they share two words."""
    rows = labels.distinct()
    across = _within(rows, (F.col("a.group_id") != F.col("b.group_id")))
    one_null = F.col("a.group_id").isNull() != F.col("b.group_id").isNull()
    shared = F.size(F.array_intersect(F.split("a.label", " "), F.split("b.label", " ")))
    return across.unionByName(_within(rows, one_null & ((shared < 2) if lexical else F.lit(True)))).distinct().join(positive_pairs(labels), ["a", "b"], "left_anti")


def balanced(positives: DataFrame, negatives: DataFrame, ratio: float = 4.0, seed: int = 42) -> DataFrame:
    """(a, b, y): negatives drawn to ``ratio`` for each positive, by a hash of the pair.

    The draw is a threshold on the hash, so nothing is sorted; the number drawn is within chance of the ratio.
    """
    n_pos, n_neg = positives.count(), negatives.count()
    share = min(1.0, ratio * n_pos / n_neg) if n_neg else 0.0
    drawn = negatives.filter(F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return positives.select("a", "b", F.lit(1).alias("y")).unionByName(drawn.select("a", "b", F.lit(0).alias("y")))


def split_80_10_10(rows: DataFrame, seed: int = 42) -> DataFrame:
    u = F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(1000)) / 1000
    return rows.withColumn("part", F.when(u < 0.8, "train").when(u < 0.9, "valid").otherwise("test"))


def dictionary_clusters(synonyms: DataFrame) -> DataFrame:
    """(cluster, label, group_id): a canonical term and its variants, all in group 1."""
    every = synonyms.select(F.col("canonical").alias("cluster"), F.explode(F.array("canonical", "variant")).alias("label"))
    return every.filter("label IS NOT NULL").distinct().withColumn("group_id", F.lit(1))


def clusters_to_dictionary(labels: DataFrame) -> DataFrame:
    """(canonical, variants): the first label of a cluster and the others."""
    return labels.groupBy("cluster").agg(F.array_sort(F.collect_set("label")).alias("l")).select(F.get("l", F.lit(0)).alias("canonical"), F.slice("l", 2, 10**6).alias("variants"))


def ungrouped(labels: DataFrame) -> DataFrame:
    return labels.filter("group_id IS NULL").select("cluster", "label")
