"""Problem 1: records that differ only in formatting, collapsed by radix partitioning and per-bucket tries.

Canonical bytes of a record come from built-in expressions. Each input partition first counts its own records in a
trie, so a record copied a billion times leaves at most one row a partition. Buckets are prefixes of the canonical
bytes; a bucket holding more than ``capacity`` rows is split by further bytes, again and again, until each fits or its
rows are all one record. Each bucket is then counted in a trie whose terminals hold the copies and the smallest id.
Records of several tables are collapsed at once, each table (``name``) with prefixes of its own. The capacity only shapes
the work: it grows where more than a bounded number of buckets would come to the driver, and results are the same at any.

Defined results: null equals null and differs from an empty value; values without a letter or digit in ``required`` are
no records; ids may repeat (the smallest is the first, equal ids are not copies of each other); an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.common import cut, parallel, skew_join, table

#: Signs between listed components.
COMPONENT_SEPARATORS = "+,;/"
#: Bytes of one trie edge and of one radix step.
EDGE, RADIX = 8, 4
#: Radix levels counted in one job; buckets over the capacity at most, at each level.
LEVELS, MOST_OVER = 3, 20_000
#: Distinct records a partition keeps in memory before it hands its counts on.
FLUSH = 200_000

_TRIE = pa.schema([("name", pa.string()), ("canon", pa.string()), ("first_id", pa.int64()), ("copies", pa.int64())])


def canonical_value(value: Column) -> Column:
    """Letters, marks and digits of the value in lower case, its listed components in order."""
    parts = F.split(F.lower(value), "[" + "".join("\\" + c for c in COMPONENT_SEPARATORS) + "]")
    return F.array_join(F.array_sort(F.transform(parts, lambda p: F.regexp_replace(p, r"[^\p{L}\p{M}\p{N}]+", ""))), "")


def canonical_record(fields: list[str]) -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(canonical_value(F.col(f)), F.lit("\u0002")) for f in fields])


def canonical_rows(df: DataFrame, name: str, id_col: str, fields: list[str], required: str) -> DataFrame:
    """(name, id, canon) of every row with a letter or digit in ``required``; ``name`` keeps tables apart."""
    return df.filter(F.col(required).rlike(r"[\p{L}\p{N}]")).select(F.lit(name).alias("name"), F.col(id_col).cast("bigint").alias("id"), canonical_record(fields).alias("canon"))


class CountingTrie:
    """Byte trie with terminal counters [copies, smallest id]; an edge carries EDGE bytes."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def add(self, key: bytes, copies: int, first: int) -> None:
        node = self.root
        for i in range(0, len(key), EDGE):
            edge = key[i : i + EDGE]
            below = node.get(edge)
            if below is None:
                below = node[edge] = {}
            node = below
        end = node.get(None)
        if end is None:
            node[None] = [copies, first]
            self.size += 1
        else:
            end[0] += copies
            if first < end[1]:
                end[1] = first

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            key, node = stack.pop()
            for edge, below in node.items():
                if edge is None:
                    yield key, below[0], below[1]
                else:
                    stack.append((key + edge, below))

    def batch(self, name: str) -> pa.RecordBatch:
        rows = list(self)
        return pa.record_batch([pa.array([name] * len(rows), pa.string()), pa.array([k.decode() for k, _, _ in rows], pa.string()), pa.array([f for _, _, f in rows], pa.int64()), pa.array([c for _, c, _ in rows], pa.int64())], schema=_TRIE)


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[str, CountingTrie] = {}
    for b in batches:
        for name, key, first in zip(*(b.column(c).to_pylist() for c in ("name", "canon", "id"))):
            trie = tries.get(name)
            if trie is None:
                trie = tries[name] = CountingTrie()
            trie.add(key.encode(), 1, first)
        if sum(t.size for t in tries.values()) > FLUSH:
            yield from (t.batch(name) for name, t in tries.items())
            tries = {}
    yield from (t.batch(name) for name, t in tries.items())


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows come sorted by bucket and canonical bytes: a trie is handed on between two records once it is large."""
    trie, at, last = CountingTrie(), None, None
    for b in batches:
        for name, bucket, key, first, copies in zip(*(b.column(c).to_pylist() for c in ("name", "bucket", "canon", "first_id", "copies"))):
            if (name, bucket) != at or (trie.size > FLUSH and key != last):
                if trie.size:
                    yield trie.batch(at[0])
                trie, at = CountingTrie(), (name, bucket)
            trie.add(key.encode(), copies, first)
            last = key
    if trie.size:
        yield trie.batch(at[0])


_COUNTED = "name string, canon string, first_id bigint, copies bigint"


def _prefix(level: Column | int) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.hex(F.encode(F.col("canon"), "UTF-8").substr(F.lit(1), level * RADIX))


def radix_buckets(counted: DataFrame, capacity: int, total: int) -> DataFrame:
    """Add ``bucket``: the shortest prefix, in steps of RADIX bytes, of at most ``capacity`` rows.

    Prefixes are counted LEVELS at a time, at first of all rows, then of those whose prefix is over the capacity and that
    have further bytes. Only the prefixes over it leave their table: at most total / capacity a level, and the capacity
    is raised where needed so that this is never more than MOST_OVER.
    """
    capacity = max(capacity, total // MOST_OVER)
    left, level, deep = counted.select("name", "canon", F.lit(1).alias("depth")), 1, None
    while True:
        # a row counts at a level if bytes are left beyond it; a longer prefix never holds more rows than a shorter one
        levels = F.filter(F.sequence(F.lit(level), F.lit(level + LEVELS - 1)), lambda x: F.octet_length("canon") > x * RADIX)
        counts = left.select("name", "canon", F.explode(levels).alias("level")).groupBy("name", "level", _prefix(F.col("level")).alias("prefix")).agg(F.count("*").alias("n"))
        over = cut(counts.filter(F.col("n") > capacity).select("name", "level", "prefix"))
        deep = over if deep is None else deep.unionByName(over)
        last = over.filter(F.col("level") == level + LEVELS - 1)
        if last.isEmpty():
            break
        level += LEVELS
        here = F.broadcast(last.select("name", F.col("prefix").alias("at")))
        left = counted.select("name", "canon").withColumn("at", _prefix(level - 1)).filter(F.octet_length("canon") > (level - 1) * RADIX).join(here, ["name", "at"]).select("name", "canon")
    placed = counted.withColumn("depth", F.lit(1))
    for at in range(1, level + LEVELS):
        # MOST_OVER prefixes at most; a row goes on only from the level before
        some = F.broadcast(deep.filter(F.col("level") == at).select("name", F.col("prefix").alias("p"), F.lit(True).alias("hit")))
        asks = placed.withColumn("p", F.when((F.col("depth") == at) & (F.octet_length("canon") > at * RADIX), _prefix(at)))
        placed = asks.join(some, ["name", "p"], "left").withColumn("depth", F.when(F.col("hit"), at + 1).otherwise(F.col("depth"))).drop("p", "hit")
    return placed.select(*counted.columns, F.concat_ws(":", F.col("depth").cast("string"), _prefix(F.col("depth"))).alias("bucket"))


def collapse(rows: DataFrame, capacity: int = 10_000) -> DataFrame:
    """(name, canon, first_id, copies), one row for each different record of ``rows`` (name, id, canon)."""
    counted = cut(rows.mapInArrow(_count_partition, _COUNTED))
    bucketed = radix_buckets(counted, capacity, counted.count())
    spread = parallel(bucketed, "name", "bucket").sortWithinPartitions("name", "bucket", "canon")
    return spread.mapInArrow(_count_buckets, _COUNTED)


def copies(rows: DataFrame, capacity: int = 10_000) -> DataFrame:
    """(name, canon, first_id, copy_id): one row for each further id of a record."""
    rows = cut(rows)
    classes = cut(collapse(rows, capacity).filter("copies > 1"))
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    return skew_join(rows, classes, ["name", "canon"], "copies", total).filter("id <> first_id").select("name", "canon", "first_id", F.col("id").alias("copy_id")).distinct()


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    drugs = canonical_rows(table(spark, sf_dir, "drugs"), "drugs", "id", ["drug"], "drug")
    effects = canonical_rows(table(spark, sf_dir, "side_effects"), "side_effects", "id", ["drug", "section", "freq", "effect"], "effect")
    return drugs.unionByName(effects)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(_rows(spark, sf_dir)).select(F.col("name").alias("table_name"), "first_id", "copy_id")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each different record with its number of copies."""
    return collapse(_rows(spark, sf_dir)).select(F.col("name").alias("table_name"), "first_id", "copies")


_CANON = """array_to_string(list_sort(list_transform(string_split_regex(lower({0}), '[+,;/]'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g'))), '')"""


def _sql_rows() -> str:
    record = " || chr(1) || ".join(f"coalesce({_CANON.format(c)}, chr(2))" for c in ("drug", "section", "freq", "effect"))
    return f"""WITH r AS (
  SELECT 'drugs' AS table_name, id, {_CANON.format('drug')} AS canon FROM drugs WHERE regexp_matches(drug, '[\\p{{L}}\\p{{N}}]')
  UNION ALL SELECT 'side_effects', id, {record} FROM side_effects WHERE regexp_matches(effect, '[\\p{{L}}\\p{{N}}]')),
c AS (SELECT table_name, canon, min(id) AS first_id, count(*) AS copies FROM r GROUP BY ALL) """


QUERIES = {"p1_found": p1_found, "p1_records": p1_records}
SQL = {
    "p1_found": _sql_rows() + "SELECT DISTINCT r.table_name, c.first_id, r.id AS copy_id FROM r JOIN c USING (table_name, canon) WHERE r.id <> c.first_id",
    "p1_records": _sql_rows() + "SELECT table_name, first_id, copies FROM c",
}
