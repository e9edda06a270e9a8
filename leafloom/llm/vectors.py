"""Shared by the vector operators: usable unit vectors, exact copies, batches as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom.common import skew_join

DIMENSIONS = 64


def matrix(column: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A list column without nulls as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dimensions)


def lists(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(m, np.float32).ravel(), pa.float32()))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        m = matrix(b.column("vec")).astype(np.float64)
        # a scale first, so that very long or short vectors neither overflow nor vanish
        with np.errstate(invalid="ignore", divide="ignore"):
            m /= np.abs(m).max(1, keepdims=True)
            m /= np.sqrt((m * m).sum(1, keepdims=True))
        fine = np.isfinite(m).all(1)
        yield pa.record_batch([b.column("id").filter(pa.array(fine)), lists(m[fine])], names=["id", "vec"])


def unit_vectors(df: DataFrame, id_col: str, vec: str = "vec", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, vec) of the usable vectors scaled to length 1.

    Null and all-zero vectors, vectors of another dimension and vectors with a null, NaN or infinite element are unusable.
    """
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) == dimensions))
    rows = rows.filter(~F.exists(vec, lambda x: x.isNull() | F.isnan(x)) & F.exists(vec, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("vec")).mapInArrow(_unit, "id bigint, vec array<float>")


def distinct_vectors(units: DataFrame) -> DataFrame:
    """(id, vec, copies): each different vector once, under the smallest of its ids; counted before the shuffle."""
    return units.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "vec", "copies")


def members(units: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, id) of all members of the classes (id, vec, copies) with several copies."""
    several = classes.filter("copies > 1").select(F.col("id").alias("class_id"), "vec", "copies")
    total = several.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    # one vector can be a third of all
    return skew_join(units.select("id", "vec"), several, ["vec"], "copies", total).select("class_id", "id").distinct()


def first_members(of: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """The ``most`` smallest ids of each class: within salted parts first, so a class of any size never fills a task."""
    part = Window.partitionBy("class_id", "salt").orderBy("id")
    few = of.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).withColumn("r", F.row_number().over(part)).filter(F.col("r") <= most)
    return few.withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("id"))).filter(F.col("r") <= most).select("class_id", "id", "r")
