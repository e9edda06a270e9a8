"""Problem 9: sources mixed to target weights by systematic sampling.

Each document of a source is expected in ``factor`` copies: target share x total size / size of the source. The
expected copies are prefix-summed within the source, one random offset is added, and a copy is emitted for each integer
boundary a document crosses. Whole copies cross that many boundaries wherever they begin, so only what is left of the
factor (in units of 2^-32, hence exact) needs sums, and only their place within a unit matters: they are kept modulo one
copy and never overflow, however many copies are drawn. The order within a source is by size, so long and short texts
are drawn evenly. The sums are made per range partition and then shifted by those before it, so no source is collected
into one task.

The total size is, unless given, the largest at which every source present on both sides reaches its share without
being repeated more often than it may; shares of targets without a text are spread over the others. Defined results:
null and empty texts and sources outside the targets give no rows; a target listed twice counts with the sum of its
shares and its smallest cap; an empty table gives no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.common import cut, spread, table
from leafloom.llm.tokens import TOKENIZERS, VOCABULARY, token_counts

UNIT = 1 << 32


def _targets(targets: DataFrame) -> DataFrame:
    return targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def plan_mixture(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(source, target_share, share, max_repeats, source_tokens, factor): one row a target.

    ``share`` is the target share among the sources that have texts; ``factor`` the expected copies of a document.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    both = _targets(targets).join(have, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    there = both.filter("source_tokens > 0").agg(F.sum("target_share").alias("present")).first()[0] or 1.0
    both = both.withColumn("share", F.when(F.col("source_tokens") > 0, F.col("target_share") / there).otherwise(0.0))
    if total_tokens is None:
        total_tokens = both.filter("source_tokens > 0").agg(F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("share"))).first()[0] or 0.0
    factor = F.when(F.col("source_tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("share") * F.lit(float(total_tokens)) / F.col("source_tokens"))).otherwise(0.0)
    return both.withColumn("factor", factor)


def systematic_sample(sized: DataFrame, factors: DataFrame, seed: int = 42) -> DataFrame:
    """(source, doc_id, n_tokens, copies) of the documents drawn at least once; ``factors`` (source, factor)."""
    whole = F.floor("factor")
    units = factors.filter("factor > 0").select("source", whole.alias("whole"), F.round((F.col("factor") - whole) * UNIT).cast("bigint").alias("units"))
    ranged = sized.select("source", "doc_id", "n_tokens").join(F.broadcast(units), "source")  # a list of sources
    ranged = cut(ranged.repartitionByRange("source", "n_tokens", "doc_id").select("*", F.spark_partition_id().alias("part")))
    here = ranged.groupBy("source", "part").agg(F.sum("units").alias("sum_units"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = here.select("source", "part", F.coalesce(F.sum(F.pmod("sum_units", F.lit(UNIT))).over(before), F.lit(0)).alias("start"))
    offset = F.pmod(F.xxhash64("source", F.lit(random.Random(seed).getrandbits(62))), F.lit(UNIT))
    within = Window.partitionBy("source", "part").orderBy("n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.join(F.broadcast(starts), ["source", "part"]).withColumn("upto", F.pmod(F.col("start") + offset, F.lit(UNIT)) + F.sum("units").over(within))
    copies = F.col("whole") + F.shiftright("upto", 32) - F.shiftright(F.col("upto") - F.col("units"), 32)
    return upto.select("source", "doc_id", "n_tokens", copies.alias("copies")).filter("copies > 0")


def numbered_copies(drawn: DataFrame, at_once: int = 10_000) -> DataFrame:
    """(source, doc_id, copy_no, n_tokens): the copies as rows, made in runs so that no row holds a list of all."""
    runs = drawn.select("source", "doc_id", "n_tokens", "copies", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / at_once))).alias("run"))
    nos = F.sequence(F.col("run") * at_once + 1, F.least("copies", (F.col("run") + 1) * at_once))
    return runs.select("source", "doc_id", F.explode(nos).alias("copy_no"), "n_tokens").withColumn("copy_no", F.col("copy_no").cast("int"))


def _sized(documents: DataFrame, targets: DataFrame, folder: str, file: str) -> DataFrame:
    wanted = spread(documents.select("doc_id", "source", "text").filter("text <> ''")).join(_targets(targets).select("source"), "source", "left_semi")
    return cut(token_counts(wanted, ["doc_id", "source"], folder=folder, file=file))


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 42, folder: str = TOKENIZERS, file: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture (source, doc_id, copy_no, n_tokens) and its report, one row a target."""
    sized = _sized(documents, targets, folder, file)
    plan = cut(plan_mixture(sized, targets, total_tokens))
    drawn = systematic_sample(sized, plan, seed)
    mixture = numbered_copies(drawn)
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("n_texts"), F.max("copies").alias("most_copies"))
    everything = Window.partitionBy()  # one row a target: a list, not data
    report = plan.join(got, "source", "left").na.fill(0, ["tokens", "n_texts", "most_copies"])
    report = report.select(
        "source", "target_share", "max_repeats", "tokens", "n_texts", "most_copies",
        F.coalesce(F.try_divide("tokens", F.sum("tokens").over(everything)), F.lit(0.0)).alias("reached_share"),
    )
    return mixture, report


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
