"""Streams over folders of new files: the same transformations as in batch, with watermarks where time matters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafloom.common import _delete, _written, shared_dir


def new_files(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", glob: str | None = None, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def run_available(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Process all files there are, once, and stop. With ``each`` batches go to a function, otherwise into Parquet files.

    The files lie in the shared folder and are written by the tasks, so no row comes to the driver. A complete result
    replaces that of the batch before it; a batch that is repeated overwrites itself.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    done: list[str] = []

    def keep(rows: DataFrame, batch: int) -> None:
        path = f"{at}/out/{batch}"
        rows.write.mode("overwrite").parquet(path)
        old = [x for x in done if x != path]
        done[:] = [path] if mode == "complete" else [*old, path]
        if mode == "complete":
            for x in old:
                _delete(spark, x)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).queryName(name).foreachBatch(each or keep).start().awaitTermination()
    _written.append((spark, at))
    if each:
        return None
    return spark.read.schema(stream.schema).parquet(*done) if done else spark.createDataFrame([], stream.schema)


def counts_per_window(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(window_start, key, n): tumbling counts; events later than ``late`` are left out of closed windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, session_start, n): events of a key at most ``gap`` apart."""
    return stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("session_start"), "n")


def without_repeats(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first of redelivered rows; state is kept no longer than ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
