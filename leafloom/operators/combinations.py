"""Scores of drug combinations from long tables weights (drug_id, se_id, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom.common import cut
from leafloom.functions.scores import compatibility_class, effect_weight


def weight_matrix(drugs: DataFrame, ranks: DataFrame, reports: DataFrame, totals: DataFrame) -> DataFrame:
    """(drug, effect, w) for every drug of the list and every ranked effect; 0 where nothing was reported.

    The grid of drugs and effects is the result itself; counts come in by equality joins.
    """
    grid = drugs.select("drug").distinct().crossJoin(ranks.select("effect", "rank"))
    cases = reports.groupBy("drug", "effect").agg(F.sum("cases").alias("cases"))
    all_ = grid.join(cases, ["drug", "effect"], "left").join(totals.groupBy("drug").agg(F.max("total").alias("total")), "drug", "left")
    return all_.select("drug", "effect", effect_weight(F.col("cases"), F.col("rank"), F.col("total"), F.col("effect")).alias("w"))


def rank_sums(weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """(combo, se_id, rank_sum) of combinations chosen (combo, drug_id); id 0 and repeats do not count."""
    members = chosen.filter("drug_id <> 0").distinct()
    return weights.join(members, "drug_id").groupBy("combo", "se_id").agg(F.sum("w").alias("rank_sum"))


def classify(sums: DataFrame) -> DataFrame:
    """(combo, rank, class): the largest rank sum and its class."""
    return sums.groupBy("combo").agg(F.max("rank_sum").alias("m")).select("combo", F.round("m", 2).alias("rank"), compatibility_class(F.col("m")).alias("class"))


def classified_effects(sums: DataFrame) -> DataFrame:
    """(combo, class, position, se_id, rank): effects by class, highest rounded rank first, then by id."""
    rows = sums.select("combo", "se_id", compatibility_class(F.col("rank_sum")).alias("class"), F.round("rank_sum", 2).alias("rank"))
    w = Window.partitionBy("combo", "class").orderBy(F.desc("rank"), "se_id")
    return rows.withColumn("position", F.row_number().over(w))


def first_effect(sums: DataFrame) -> DataFrame:
    """(combo, class, se_id, rank): the first effect of the combination's own class."""
    effects = sums.select("combo", "se_id", compatibility_class(F.col("rank_sum")).alias("class"), F.round("rank_sum", 2).alias("rank"))
    best = effects.groupBy("combo", "class").agg(F.max_by(F.struct("se_id", "rank"), F.struct("rank", -F.col("se_id"))).alias("b"))
    return classify(sums).select("combo", "class").join(best, ["combo", "class"]).select("combo", "class", "b.se_id", "b.rank")


def pairs(ids: DataFrame) -> DataFrame:
    """All unordered pairs (id1 < id2) of a list of ids."""
    a, b = ids.select(F.col("id").alias("id1")), ids.select(F.col("id").alias("id2"))
    return a.join(b, F.col("id1") < F.col("id2"))


def pair_classes(weights: DataFrame, ids: DataFrame) -> DataFrame:
    """(id1, id2, class, rank) of all pairs that share an effect, joined on the effect and reduced to a maximum."""
    known = weights.join(ids.select(F.col("id").alias("drug_id")).distinct(), "drug_id", "left_semi")
    x = known.select(F.col("drug_id").alias("id1"), "se_id", F.col("w").alias("w1"))
    y = known.select(F.col("drug_id").alias("id2"), "se_id", F.col("w").alias("w2"))
    best = x.join(y, "se_id").filter("id1 < id2").groupBy("id1", "id2").agg(F.max(F.col("w1") + F.col("w2")).alias("m"))
    return best.select("id1", "id2", compatibility_class(F.col("m")).alias("class"), F.round("m", 2).alias("rank"))


def what_if(weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """(combo, drug_id, class) of further drugs that would make a combination class 2 or 3."""
    sums = rank_sums(weights, chosen)
    more = sums.join(weights, "se_id").groupBy("combo", "drug_id").agg(F.max(F.col("rank_sum") + F.col("w")).alias("m"))
    return more.join(chosen.select("combo", "drug_id").distinct(), ["combo", "drug_id"], "left_anti").select("combo", "drug_id", compatibility_class(F.col("m")).alias("class")).filter("class > 1")


def compatible_triples(compatible: DataFrame, excluded: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b, c) in order: a compatible pair and a third id, none of whose pairs is excluded."""
    third = compatible.select("id1", "id2").join(ids.select(F.col("id").alias("id3")), (F.col("id3") != F.col("id1")) & (F.col("id3") != F.col("id2")))
    s = third.select(F.array_sort(F.array("id1", "id2", "id3")).alias("t")).distinct().select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))
    bad = cut(excluded.select(F.least("id1", "id2").alias("x"), F.greatest("id1", "id2").alias("y")).distinct())
    for p, q in (("a", "b"), ("a", "c"), ("b", "c")):
        s = s.join(bad.select(F.col("x").alias(p), F.col("y").alias(q)), [p, q], "left_anti")
    return s.select("a", "b", "c")


def flat_vector(row_no: str, columns: list[str], df: DataFrame) -> DataFrame:
    """Long weights (drug_id, se_id, w) of a headerless matrix with a row number from 0; ids start at 1."""
    return df.select((F.col(row_no) + 1).alias("drug_id"), F.posexplode(F.array(*columns)).alias("p", "w")).select("drug_id", (F.col("p") + 1).alias("se_id"), F.col("w").cast("double").alias("w"))


def _known(dataset: DataFrame, rates: DataFrame, case_sensitive: bool) -> DataFrame:
    """(drug, effect, rate) of a dataset (drug, effect, freq); frequencies without a rate count as 0."""
    key = F.col("freq") if case_sensitive else F.lower("freq")
    of = rates.select(key.alias("k"), "rate").dropDuplicates(["k"])
    return dataset.groupBy("drug", "effect").agg(F.max("freq").alias("freq")).withColumn("k", key).join(of, "k", "left").select("drug", "effect", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def convolution_error(reached: DataFrame, dataset: DataFrame, rates: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(drug, loss, n_common, n_missing) of reached (drug, effect, p) against dataset (drug, effect, freq) and rates (freq, rate).

    Frequencies without a rate count as 0; by default the lookup ignores case.
    """
    known = _known(dataset, rates, case_sensitive).withColumn("there", F.lit(1))
    rows = reached.join(known.select("drug").distinct(), "drug", "left_semi").join(known, ["drug", "effect"], "left")
    return rows.groupBy("drug").agg(F.sum(F.when(F.col("there") == 1, F.pow(F.col("rate") - F.col("p"), 2))).alias("loss"), F.count("there").alias("n_common"), F.count(F.when(F.col("there").isNull(), 1)).alias("n_missing"))


def convolution_error_by_class(reached: DataFrame, members: DataFrame, dataset: DataFrame, rates: DataFrame, p: float, case_sensitive: bool = False) -> DataFrame:
    """As ``convolution_error`` for one probability, from classes of effects: reached (drug, class, size), members (effect, class).

    What a drug reaches and its data lack is only counted, so no row is made for it.
    """
    known = _known(dataset, rates, case_sensitive)
    n = reached.groupBy("drug").agg(F.sum("size").alias("n")).join(known.select("drug").distinct(), "drug", "left_semi")
    hits = known.join(members, "effect").join(reached.select("drug", "class"), ["drug", "class"], "left_semi")
    found = hits.groupBy("drug").agg(F.sum(F.pow(F.col("rate") - p, 2)).alias("loss"), F.count("*").alias("n_common"))
    return n.join(found, "drug", "left").select("drug", "loss", F.coalesce("n_common", F.lit(0)).alias("n_common"), (F.col("n") - F.coalesce("n_common", F.lit(0))).alias("n_missing"))
