"""Helpers shared by every operator: lineage cuts in shared storage and joins that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can read: ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary one; on a cluster that is an error, since executors could not read
    each other's files in a folder of the driver.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="leafloom-")
        spark.conf.set("spark.checkpoint.dir", path)
        _written.append((spark, path))
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    The lineage ends there, a lost executor costs nothing, and (unlike ``checkpoint()``) the plan runs only once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.leafloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables that ``cut`` returned, once nothing lazy reads them any more."""
    for df in frames:
        path = getattr(df, "leafloom_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written.remove((df.sparkSession, path))
            del df.leafloom_path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            alive = spark._jsc is not None and not spark._jsc.sc().isStopped()
        except Exception:  # noqa: BLE001
            alive = False
        if alive:
            _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallel(df: DataFrame, *by: str | Column) -> DataFrame:
    """Spread a table that arrives in fewer partitions than the cluster has cores."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, 2)
    n = max(wanted, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *by)


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table read in fewer partitions than there are cores (one small file); larger ones stay as they are."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each (new column, column) of ``sums``, the sum of the column up to and with the row in the given order.

    Rows are range-partitioned and summed within their part, then shifted by the parts before it (one row a part), so no
    task sees them all. The parts are written first: both uses must see the same ones. Ties must not matter.
    """
    parts = cut(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__p")))
    here = parts.groupBy("__p").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = here.select("__p", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    within = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(F.broadcast(starts), "__p").select(*df.columns, *[(F.col(f"__{n}") + F.sum(c).over(within)).alias(n) for n, c in sums.items()])


def numbered(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """The rows numbered from 1 in the given order, by ``running_sums``."""
    return running_sums(df.withColumn("__one", F.lit(1)), order, {name: "__one"}).drop("__one")


def skew_join(rows: DataFrame, side: DataFrame, key: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``side`` (one row a key, with the number of ``rows`` of the key in ``weight``).

    Keys that hold more than a thousandth of all rows are fewer than a thousand, so that part of ``side`` is broadcast
    and its rows are never shuffled; all other keys are joined by a shuffle, in which no key can dominate a task.
    ``how`` is "inner" or "left_semi".
    """
    limit = max(total // 1000, 1)
    hot = F.broadcast(side.filter(F.col(weight) > limit).drop(weight))
    rest = side.filter(F.col(weight) <= limit).drop(weight)
    hot_rows = rows.join(hot, key, how)
    cold = rows.join(F.broadcast(side.filter(F.col(weight) > limit).select(*key)), key, "left_anti")
    return hot_rows.unionByName(cold.join(rest, key, how))


def sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """``spark.sql`` in which ``$name`` stands for the given DataFrame (braces keep their meaning in patterns)."""
    made = {}
    for name in sorted(frames, key=len, reverse=True):
        made[name] = f"leafloom_{name}_{uuid.uuid4().hex}"
        frames[name].createOrReplaceTempView(made[name])
        text = text.replace(f"${name}", made[name])
    out = spark.sql(text)
    out.schema  # noqa: B018  analysed here, so that the views may go
    for view in made.values():
        spark.catalog.dropTempView(view)
    return out
