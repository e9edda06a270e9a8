"""References to records that do not exist (yet, or any more), per table, field and period.

Foreign keys are reduced to one row each before anything is shuffled, with the first and last time they were used. Only
those keys go through the left anti-join with the parent keys, and only keys that can be broken at all come back to
their rows, so a key held by a third of all rows never fills a task.

Defined results: null references are no references; a parent key entered several times exists from its first
``created_at`` on, until its last ``deleted_at`` if all its rows are deleted; 'missing' goes before 'late' before
'deleted'; a null time of the reference counts as present (neither late nor deleted); empty tables give no rows (or all
references missing); further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.common import cut, skew_join, table


def broken_references(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """(field, row_id, at, kind) of the broken ones among ``rows`` (field, row_id, key, at); ``parents`` (field, key, born, gone)."""
    rows = rows.filter(F.col("key").isNotNull())
    keys = cut(rows.groupBy("field", "key").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = parents.filter(F.col("key").isNotNull()).groupBy("field", "key").agg(
        F.min("born").alias("born"), F.when(F.count("gone") == F.count("*"), F.max("gone")).alias("gone")
    )
    missing = keys.join(known, ["field", "key"], "left_anti").select("field", "key", "n", F.lit(True).alias("missing"), F.lit(None).cast("timestamp").alias("born"), F.lit(None).cast("timestamp").alias("gone"))
    doubtful = keys.join(known, ["field", "key"]).filter((F.col("born") > F.col("first_at")) | (F.col("gone") <= F.col("last_at")))
    suspects = cut(missing.unionByName(doubtful.select("field", "key", "n", F.lit(False).alias("missing"), F.col("born").cast("timestamp"), F.col("gone").cast("timestamp"))))
    back = skew_join(rows, suspects, ["field", "key"], "n", total)
    kind = F.when(F.col("missing"), "missing").when(F.col("born") > F.col("at"), "late").when(F.col("gone") <= F.col("at"), "deleted")
    return back.select("field", "row_id", "at", kind.alias("kind")).filter("kind IS NOT NULL")


#: Referring table, its id, field, parent table, parent key.
FIELDS = (
    ("drug_side_effects", "row_id", "drug_id", "drugs", "id"),
    ("drug_side_effects", "row_id", "side_effect_id", "side_effects", "id"),
    ("relations", "rel_id", "from_id", "entities", "entity_id"),
    ("relations", "rel_id", "to_id", "entities", "entity_id"),
)


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [table(spark, sf_dir, t).select(F.lit(f"{t}.{f}").alias("field"), F.col(i).alias("row_id"), F.col(f).alias("key"), F.col("added_at").alias("at")) for t, i, f, _, _ in FIELDS]
    parents = [table(spark, sf_dir, p).select(F.lit(f"{t}.{f}").alias("field"), F.col(k).alias("key"), F.col("created_at").alias("born"), F.col("deleted_at").alias("gone")) for t, _, f, p, k in FIELDS]
    out = broken_references(reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, parents))
    return out.select(
        F.substring_index("field", ".", 1).alias("table_name"), F.substring_index("field", ".", -1).alias("field"),
        "row_id", "kind", F.date_format("at", "yyyy-MM").alias("added_month"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(spark, sf_dir)


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references per table, field, kind and month."""
    return _broken(spark, sf_dir).groupBy("table_name", "field", "kind", "added_month").agg(F.count("*").alias("n_rows"))


_SQL = "WITH f AS (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{f}' AS field, r.{i} AS row_id, strftime(r.added_at, '%Y-%m') AS added_month,
  CASE WHEN p.{k} IS NULL THEN 'missing' WHEN p.created_at > r.added_at THEN 'late' WHEN p.deleted_at <= r.added_at THEN 'deleted' END AS kind
  FROM {t} r LEFT JOIN {p} p ON p.{k} = r.{f} WHERE r.{f} IS NOT NULL""" for t, i, f, p, k in FIELDS
) + ") "

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p4_found": _SQL + "SELECT table_name, field, row_id, kind, added_month FROM f WHERE kind IS NOT NULL",
    "p4_report": _SQL + "SELECT table_name, field, kind, added_month, count(*) AS n_rows FROM f WHERE kind IS NOT NULL GROUP BY ALL",
}
