"""Problem 8: texts of varying length combined into containers of fixed capacity by conflict-constrained best fit.

Items are dealt to shards of bounded size by a hash. In a shard, items go by falling size; open bins stand in order of
their residual space, each with a bitmap of its sources and one of its duplicate clusters. A successor search starts at
the item's size and goes on to larger residuals until it meets the tightest compatible bin; without one a new bin opens.
Copies of one text never share a container, nor do sources named as a conflict. Bins a shard could not fill well are
emptied again and packed together in a second round.

A text is cut only if it alone exceeds the capacity: pieces of the full capacity are containers of their own, the rest
is an item like any other. Defined results: null and empty texts have no tokens and no container; a null source is a
source of its own; equal sizes go by duplicate cluster, source and doc_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.common import cut, spread, table
from leafloom.llm.tokens import TOKENIZERS, VOCABULARY, token_counts

#: Items of a shard, at most about; bins filled less than this share go to the second round.
SHARD_ITEMS, WELL_FILLED = 50_000, 0.95
_PLACED = "container_kind string, capacity bigint, container_id string, doc_id bigint, part_no int, token_start bigint, n_tokens bigint, source string, cluster bigint, fill double"


class Bins:
    """Open bins of one capacity, by residual."""

    def __init__(self, capacity: int, foes: list[int]) -> None:
        self.capacity, self.foes = capacity, foes
        self.at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]  # bins by residual, in order of their coming
        self.filled = 0  # bit r is set while a bin with residual r is open
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.residual: list[int] = []

    def _residuals(self, least: int) -> Iterator[int]:
        """Residuals of open bins from ``least`` on, each the successor of the last."""
        while True:
            above = self.filled >> least
            if not above:
                return
            least += (above & -above).bit_length() - 1
            yield least
            least += 1

    def place(self, size: int, source: int, cluster: int, copies: int) -> list[int]:
        """Bins for ``copies`` items alike in size, source and cluster.

        Each takes the tightest compatible bin. A bin that took one copy is not compatible with the next, so the search
        need not start anew for each.
        """
        out, taken = [], []
        bit, foes = 1 << source, self.foes[source]
        for r in self._residuals(size):
            for i in reversed(self.at[r]):
                if not self.sources[i] & foes and not self.clusters[i] & cluster:
                    taken.append((r, i))
                    if not cluster or len(taken) == copies:
                        break
            if taken and (not cluster or len(taken) == copies):
                break
        for r, i in taken[:copies]:
            self._move(i, r, r - size)
            self.sources[i] |= bit
            self.clusters[i] |= cluster
            out.append(i)
        if not cluster and taken and copies > 1:
            return out + self.place(size, source, cluster, copies - 1)
        while len(out) < copies:
            if not cluster and out:
                return out + self.place(size, source, cluster, copies - len(out))
            i = len(self.residual)
            self.sources.append(bit)
            self.clusters.append(cluster)
            self.residual.append(self.capacity)
            self._move(i, None, self.capacity - size)
            out.append(i)
        return out

    def _move(self, i: int, old: int | None, new: int) -> None:
        if old is not None:
            del self.at[old][i]
            if not self.at[old]:
                self.filled &= ~(1 << old)
        self.residual[i] = new
        if new:
            self.at[new][i] = None
            self.filled |= 1 << new


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, conflicts: tuple = ()) -> list[int]:
    """The bin of each item; items must come by falling size with like items together."""
    names = {s: n for n, s in enumerate(dict.fromkeys(sources))}
    foes = [0] * len(names)
    for a, b in conflicts:
        if a in names and b in names:
            foes[names[a]] |= 1 << names[b]
            foes[names[b]] |= 1 << names[a]
    several: dict = {}
    for c in clusters:
        several[c] = several.get(c, 0) + 1
    bits = {c: 1 << n for n, c in enumerate(c for c, k in several.items() if k > 1)}
    bins, out, i = Bins(capacity, foes), [], 0
    while i < len(sizes):
        j = i + 1
        cluster = bits.get(clusters[i], 0)
        while cluster and j < len(sizes) and (sizes[j], sources[j], clusters[j]) == (sizes[i], sources[i], clusters[i]):
            j += 1
        out += bins.place(sizes[i], names[sources[i]], cluster, j - i)
        i = j
    return out


def _packer(name: str, conflicts: tuple) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["n_tokens", "cluster", "source", "doc_id", "part_no"], ascending=[False, True, True, True, True], na_position="first")
        capacity = int(key[1])
        bins = best_fit(items["n_tokens"].tolist(), [s if isinstance(s, str) else None for s in items["source"]], items["cluster"].tolist(), capacity, conflicts)
        items["fill"] = items.groupby(pd.Series(bins, index=items.index))["n_tokens"].transform("sum") / capacity
        items["container_id"] = [f"{name}-{key[2]}-{b}" for b in bins]
        return items[[f.split(" ")[0] for f in _PLACED.split(", ")]]

    return pack


def _round(items: DataFrame, name: str, shard_items: int, conflicts: tuple) -> DataFrame:
    # the number of shards follows the number of items, counted on what is already written
    most = items.groupBy("container_kind").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    shards = -(-most // shard_items) or 1
    shard = F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(shards)).alias("shard")
    return items.select("*", shard).groupBy("container_kind", "capacity", "shard").applyInPandas(_packer(name, conflicts), _PLACED)


def pack_texts(documents: DataFrame, limits: DataFrame, shard_items: int = SHARD_ITEMS, conflicts: tuple = (), folder: str = TOKENIZERS, file: str = VOCABULARY) -> DataFrame:
    """(container_kind, container_id, doc_id, part_no, token_start, n_tokens), for each kind of container all texts.

    ``limits`` (container_kind, capacity_tokens) is a list of kinds; ``conflicts`` are pairs of sources that must not
    share a container.
    """
    cluster = F.xxhash64(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+", "")).alias("cluster")
    sized = cut(token_counts(spread(documents.select("doc_id", "source", "text").filter("text <> ''")).select("doc_id", "source", cluster, "text"), ["doc_id", "source", "cluster"], folder=folder, file=file).filter("n_tokens > 0"))
    kinds = limits.filter("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    each = sized.crossJoin(F.broadcast(kinds))  # a list of capacities, not data: each kind is a packing of all texts
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.col("capacity")))
    parts = each.select("*", starts.alias("token_start")).withColumn("part_no", (F.col("token_start") / F.col("capacity")).cast("int"))
    parts = parts.withColumn("n_tokens", F.least("capacity", F.col("n_tokens") - F.col("token_start")))
    full = parts.filter("n_tokens = capacity")
    first = cut(_round(parts.filter("n_tokens < capacity").select("container_kind", "capacity", "doc_id", "part_no", "token_start", "n_tokens", "source", "cluster"), "a", shard_items, conflicts))
    second = _round(first.filter(F.col("fill") < WELL_FILLED).drop("container_id", "fill"), "b", shard_items, conflicts)
    columns = ["container_kind", "container_id", "doc_id", "part_no", "token_start", "n_tokens"]
    alone = full.withColumn("container_id", F.concat_ws("-", F.lit("c"), "doc_id", "part_no")).select(columns)
    return alone.unionByName(first.filter(F.col("fill") >= WELL_FILLED).select(columns)).unionByName(second.select(columns))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and used share per kind."""
    limits = table(spark, sf_dir, "pack_limits")
    used = pack_texts(table(spark, sf_dir, "documents"), limits).groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"))
    kinds = used.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"))
    return kinds.join(limits, "container_kind").select("container_kind", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("used_share"))


#: Sources that p8_apart keeps out of each other's containers.
CONFLICTS = (("forum_reports", "smpc_archive"), ("ward_notes", "vet_crossover"))


def audit(packed: DataFrame, documents: DataFrame, limits: DataFrame, conflicts: tuple = ()) -> DataFrame:
    """(container_kind, n_docs, n_overfull, n_torn, n_together, n_conflicts): texts packed, and every broken rule.

    Torn are texts whose pieces leave a gap, overlap or are cut though the text fits; together are containers that hold
    two copies of one text.
    """
    limit = limits.select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    letters = F.xxhash64(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+", ""))
    rows = cut(packed.join(documents.select("doc_id", "source", letters.alias("letters")), "doc_id").join(F.broadcast(limit), "container_kind"))
    of = lambda pair: F.when(F.col("source").isin(*pair), F.col("source"))
    sides = [F.coalesce(F.max(of(pair)) != F.min(of(pair)), F.lit(False)) for pair in conflicts]
    bins = rows.groupBy("container_kind", "container_id").agg(
        (F.sum("n_tokens") > F.max("capacity")).cast("int").alias("over"), F.array(F.lit(False), *sides).alias("met")
    )
    per_bin = bins.groupBy("container_kind").agg(F.sum("over").alias("n_overfull"), F.sum(F.exists("met", lambda x: x).cast("int")).alias("n_conflicts"))
    twice = rows.groupBy("container_kind", "container_id", "letters").agg(F.count("*").alias("n")).groupBy("container_kind").agg(F.sum((F.col("n") > 1).cast("int")).alias("n_together"))
    per_doc = rows.groupBy("container_kind", "doc_id").agg(
        F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("parts"), F.max("capacity").alias("capacity")
    )
    torn = (F.col("end") != F.col("tokens")) | (F.col("parts") != F.ceil(F.col("tokens") / F.col("capacity")))
    docs = per_doc.groupBy("container_kind").agg(F.count("*").alias("n_docs"), F.sum(torn.cast("int")).alias("n_torn"))
    return docs.join(per_bin, "container_kind").join(twice, "container_kind").select("container_kind", "n_docs", "n_overfull", "n_torn", "n_together", "n_conflicts")


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the containers, counted over all of them."""
    documents, limits = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits")
    return audit(pack_texts(documents, limits), documents, limits)


def p8_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a packing that keeps pairs of sources apart."""
    documents, limits = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits")
    return audit(pack_texts(documents, limits, conflicts=CONFLICTS), documents, limits, CONFLICTS)


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p8_check": p8_check, "p8_apart": p8_apart}
_KEPT = "SELECT container_kind, (SELECT count(*) FROM documents WHERE text <> '') AS n_docs, 0 AS n_overfull, 0 AS n_torn, 0 AS n_together, 0 AS n_conflicts FROM pack_limits"
SQL: dict[str, str] = {"p8_check": _KEPT, "p8_apart": _KEPT}
