"""Scalar and aggregate functions of scores and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effect_weight(cases: Column, rank: Column, total: Column, name: Column | None = None) -> Column:
    """round((cases * rank / total) ^ 0.4, 2); 0 without cases or total, or for a doubtful name."""
    known = (F.coalesce(cases, F.lit(0)) != 0) & (F.coalesce(total, F.lit(0)) != 0) & rank.isNotNull()
    if name is not None:
        known = known & ~F.coalesce(F.contains(name, F.lit("?")), F.lit(False))
    return F.when(known, F.round(F.pow(cases * rank / total, F.lit(0.4)), 2)).otherwise(F.lit(0.0))


def compatibility_class(rank_sum: Column) -> Column:
    """3 incompatible from 1.0, 2 caution from 0.5, else 1."""
    return F.when(rank_sum >= 1.0, 3).when(rank_sum >= 0.5, 2).otherwise(1)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def capped_sum(p: Column) -> Column:
    return F.least(F.sum(p), F.lit(1.0))


def noisy_or(p: Column, scale: float = 1.0) -> Column:
    """1 - product(1 - p), divided by ``scale`` and kept within 0 and 1; exact at p = 1."""
    none = F.when(F.max(p) >= 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.log1p(-F.when(p < 1, p).otherwise(0.0)))))
    return clamp((1 - none) / scale, 0.0, 1.0)


def scaled_sum(p: Column, scale: float) -> Column:
    return clamp(F.sum(p) / scale, 0.0, 1.0)


def log_odds_pool(p: Column, eps: float = 1e-6) -> Column:
    return sigmoid(F.sum(logit(p, eps)))


def configurations(n: int) -> list[str]:
    """Keys of all states of n parents, the first parent as the highest bit: "0,0", "0,1", ..."""
    return [",".join(f"{i:0{n}b}") if n else "" for i in range(2**n)]


def bits(config: Column) -> Column:
    """States of the parents in a key; none for the empty key."""
    return F.when(config == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(config, ","), lambda x: x.cast("int")))


def config_key(states: Column) -> Column:
    return F.array_join(F.transform(states, lambda x: x.cast("string")), ",")


def curriculum_size(progress: Column, most: int) -> Column:
    return (1 + progress * (most - 1)).cast("int")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
