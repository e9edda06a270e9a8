"""Similarity of terms and vectors: pairs, top-k, threshold clusters, and the rewriting built on them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom.common import cut, parallel
from leafloom.functions.text import clean_term, penalised_similarity
from leafloom.operators.relational import aggregate_edges, endpoint_bag

#: Vectors of a block; the matrix product of two blocks is one task's unit of work.
BLOCK = 2048


def hashed_encoder(dimensions: int = 64, grams: tuple[int, ...] = (2, 3)) -> Callable[[str], np.ndarray]:
    """Signed hashes of character n-grams, which need no training; ``train_encoder`` fits one to the terms."""

    def encode(term: str) -> np.ndarray:
        v = np.zeros(dimensions, np.float32)
        text = f" {term} "
        for n in grams:
            for i in range(len(text) - n + 1):
                h = zlib.crc32(text[i : i + n].encode())
                v[h % dimensions] += 1 if h >> 31 else -1
        norm = float(np.sqrt((v * v).sum()))
        return v / norm if norm else v

    return encode


class TrainedEncoder:
    """Latent semantic encoder: weighted counts of character n-grams in the directions that vary most over the terms.

    Counts of hashed n-grams are damped by their logarithm and weighted by how few terms hold them; ``directions`` are the
    leading eigenvectors of their second moments. Small enough (buckets x dimensions) to travel with a task.
    """

    def __init__(self, weights: np.ndarray, directions: np.ndarray, grams: tuple[int, ...]) -> None:
        self.weights, self.directions, self.grams = weights, directions, grams

    @staticmethod
    def counts(term: str, buckets: int, grams: tuple[int, ...]) -> np.ndarray:
        text = f" {term} "
        at = [zlib.crc32(text[i : i + n].encode()) % buckets for n in grams for i in range(len(text) - n + 1)]
        return np.log1p(np.bincount(at, minlength=buckets)) if at else np.zeros(buckets)

    def __call__(self, term: str) -> np.ndarray:
        v = (self.counts(term, len(self.weights), self.grams) * self.weights) @ self.directions
        norm = float(np.sqrt(v @ v))
        return (v / norm if norm else v).astype(np.float32)


def train_encoder(terms: DataFrame, column: str = "term", dimensions: int = 64, buckets: int = 2048, grams: tuple[int, ...] = (2, 3, 4), most: int = 20_000, seed: int = 42) -> TrainedEncoder:
    """Fit the encoder to at most about ``most`` of the different terms, drawn by a hash where they lie."""
    distinct = cut(terms.select(F.col(column).alias("term")).filter("term IS NOT NULL").distinct())
    share = int(min(1.0, most / max(distinct.count(), 1)) * (1 << 30))
    drawn = [r.term for r in distinct.filter(F.pmod(F.xxhash64("term", F.lit(seed)), F.lit(1 << 30)) <= share).orderBy("term").collect()]
    held, moments = np.zeros(buckets), np.zeros((buckets, buckets))
    rows = [TrainedEncoder.counts(t, buckets, grams) for t in drawn]
    for r in rows:
        held += r > 0
    weights = np.log((1 + len(drawn)) / (1 + held))
    for i in range(0, len(rows), 1024):
        x = np.array(rows[i : i + 1024]) * weights
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        moments += x.T @ x
    directions = np.linalg.eigh(moments)[1][:, ::-1][:, :dimensions]
    return TrainedEncoder(weights, np.ascontiguousarray(directions), grams)


def encode_terms(terms: DataFrame, column: str = "term", encoder: Callable[[str], np.ndarray] | None = None) -> DataFrame:
    """(term, vec) of the distinct non-null terms: each is encoded once, however often it occurs."""
    fn = encoder or hashed_encoder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.record_batch([pa.array(words, pa.string()), pa.array([fn(w).tolist() for w in words], pa.list_(pa.float32()))], names=["term", "vec"])

    return terms.select(F.col(column).alias("term")).filter("term IS NOT NULL").distinct().mapInArrow(run, "term string, vec array<float>")


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column as rows of length 1."""
    whole = column.combine_chunks()
    m = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)


def _block_pairs(least: float, k: int | None, symmetric: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, others = left.column("id"), right.column("other")
        if not len(left) or not len(right):
            return pa.table({"a": ids.slice(0, 0), "b": others.slice(0, 0), "sim": pa.array([], pa.float64())})
        sim = _units(left.column("vec")) @ _units(right.column("other_vec")).T
        keep = sim >= least
        if symmetric and key[0].as_py() == key[1].as_py():
            # a block with itself: each pair once
            keep &= np.arange(len(ids))[:, None] < np.arange(len(ids))
        i, j = np.nonzero(keep)
        if k is not None:
            place = np.empty(len(others), int)
            place[pc.sort_indices(others).to_numpy()] = np.arange(len(others))
            order = np.lexsort((place[j], -sim[i, j], i))
            i, j = i[order], j[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[best], j[best]
        a, b = ids.take(pa.array(i)), others.take(pa.array(j))
        if symmetric:
            low = pc.less(a, b)
            a, b = pc.if_else(low, a, b), pc.if_else(low, b, a)
        return pa.table({"a": a, "b": b, "sim": pa.array(sim[i, j])})

    return run


def similar_pairs(left: DataFrame, right: DataFrame | None, least: float, k: int | None = None) -> DataFrame:
    """(a, b, sim) with cosine of at least ``least``; with ``right``, of each block only the k best of a.

    Vectors (id, vec) are dealt to blocks by a hash; every pair of blocks is multiplied once, as one matrix product.
    Without ``right`` pairs are within ``left``, low id first, and a block meets only those from itself on. Exact for any
    input, and so quadratic: meant for lists of terms, not for records.
    """
    symmetric = right is None
    right = left if symmetric else right
    kind = dict(left.dtypes)["id"]
    n_left = max(1, -(-left.count() // BLOCK))
    n_right = n_left if symmetric else max(1, -(-right.count() // BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    first, last = (block(n_left) if symmetric else F.lit(0).cast("bigint")), (block(n_right) if symmetric else F.lit(n_left - 1).cast("bigint"))
    x = left.select(block(n_left).alias("i"), F.explode(F.sequence(first, F.lit(n_right - 1).cast("bigint"))).alias("j"), "id", "vec")
    y = right.select(F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("i"), block(n_right).alias("j"), F.col("id").alias("other"), F.col("vec").alias("other_vec"))
    return x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInArrow(_block_pairs(least, None if symmetric else k, symmetric), f"a {kind}, b {kind}, sim double")


def find_similar(queries: DataFrame, corpus: DataFrame, least: float, k: int = 1) -> DataFrame:
    """(query, term, sim): the k most similar corpus vectors of each query, of at least ``least``."""
    pairs = similar_pairs(queries, corpus, least, k)
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select(F.col("a").alias("query"), F.col("b").alias("term"), "sim")


def find_similar_terms(queries: DataFrame, corpus: DataFrame, least: float, k: int | None = 1, encoder: Callable | None = None) -> DataFrame:
    """As ``find_similar`` on terms: cleaned, encoded, and penalised where numbers or minerals differ.

    Candidates are taken at the threshold without the penalty, which only lowers it.
    """
    ready = lambda d: encode_terms(d.select(clean_term(F.col("term")).alias("term")), encoder=encoder).withColumnRenamed("term", "id")
    pairs = similar_pairs(ready(queries), ready(corpus), least)
    scored = pairs.withColumn("sim", penalised_similarity(F.col("a"), F.col("b"), F.col("sim"))).filter(F.col("sim") >= least)
    back = lambda d, n: d.select(F.col("term").alias(n), clean_term(F.col("term")).alias("k")).distinct()
    # k None: all of them
    named = back(queries, "query").join(scored, F.col("k") == F.col("a")).drop("k").join(back(corpus, "term"), F.col("k") == F.col("b")).select("query", "term", "sim")
    if k is None:
        return named
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "term")
    return named.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def similarity_components(pairs: DataFrame, nodes: DataFrame, drop_single: bool = False) -> DataFrame:
    """(id, cluster): connected parts of the pairs (a, b), named by their smallest id.

    Labels are lowered to those of neighbours and then to the label's own label until nothing changes.
    """
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("cluster")))
    while True:
        low = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("cluster").alias("low"))
        step = labels.join(low.withColumnRenamed("a", "id"), "id").select("id", F.col("cluster").alias("old"), F.least("cluster", "low").alias("cluster"))
        jump = step.select(F.col("id").alias("cluster"), F.col("cluster").alias("further"))
        new = cut(step.join(jump, "cluster", "left").select("id", F.least("cluster", F.coalesce("further", "cluster")).alias("cluster"), "old"))
        labels = new.select("id", "cluster")
        if new.filter("cluster <> old").isEmpty():
            break
    if drop_single:
        return labels
    return nodes.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def greedy_clusters(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """(id, cluster): in the given order (id, ord) each free item takes all free items similar to it.

    The seeds are the first maximal independent set in that order, and every other item joins its first seed. They come
    in rounds: a free item with no free neighbour before it is a seed; its neighbours are taken.
    """
    links = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().join(order.select(F.col("id").alias("a"), F.col("ord").alias("oa")), "a").join(order.select(F.col("id").alias("b"), F.col("ord").alias("ob")), "b"))
    free = cut(order.select("id", "ord"))
    seeds = None
    while not free.isEmpty():
        live = links.join(free.select(F.col("id").alias("a")), "a", "left_semi").join(free.select(F.col("id").alias("b")), "b", "left_semi")
        held = live.filter("ob < oa").select(F.col("a").alias("id")).distinct()
        new = cut(free.join(held, "id", "left_anti"))
        taken = live.join(new.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id"))
        seeds = new if seeds is None else seeds.unionByName(new)
        free = cut(free.join(new.select("id").unionByName(taken).distinct(), "id", "left_anti"))
    if seeds is None:
        return order.select("id", F.col("id").alias("cluster"))
    joined = links.join(seeds.select(F.col("id").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("id")).agg(F.min_by("b", "ob").alias("cluster"))
    return seeds.select("id", F.col("id").alias("cluster")).unionByName(joined.join(seeds.select("id"), "id", "left_anti"))


def clusterable_terms(edges: DataFrame, tag: str = "prepare") -> tuple[DataFrame, DataFrame]:
    """Terms on no edge with the tag, and the terms on one, which map to themselves."""
    marked = edges.filter((F.col("source_tag") == tag) | (F.col("target_tag") == tag))
    fixed = endpoint_bag(marked).distinct()
    return endpoint_bag(edges).distinct().join(fixed, "term", "left_anti"), fixed


def normalise_edges(edges: DataFrame, least: float = 0.95, encoder: Callable | None = None) -> DataFrame:
    """Edges whose terms are replaced by the most frequent term of their cluster, aggregated, without loops."""
    from leafloom.operators.graphs import collapse_symmetric

    strip = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\([^)]*\)", "")), F.lit("")).alias(c)
    rows = cut(edges.select(strip("source"), "source_tag", strip("target"), "target_tag").filter("source IS NOT NULL AND target IS NOT NULL"))
    terms, _ = clusterable_terms(rows)
    counts = endpoint_bag(rows).groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")
    vectors = cut(encode_terms(terms, encoder=encoder).withColumnRenamed("term", "id"))
    pairs = similar_pairs(vectors, None, least).withColumn("sim", penalised_similarity(F.col("a"), F.col("b"), F.col("sim"))).filter(F.col("sim") >= least)
    order = counts.select(F.col("term").alias("id"), F.struct("term").alias("ord"))
    clusters = greedy_clusters(cut(pairs), order)
    best = clusters.join(counts.withColumnRenamed("term", "id"), "id").groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("id").alias("t"))).alias("b"))
    to = clusters.join(best, "cluster").select(F.col("id").alias("term"), F.col("b.t").alias("canonical"))
    for end in ("source", "target"):
        rows = rows.join(to.withColumnRenamed("term", end), end, "left").withColumn(end, F.coalesce("canonical", end)).drop("canonical")
    return collapse_symmetric(aggregate_edges(rows))


def replace_phrases(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(id, text) with phrases of ``known`` (phrase, canonical) replaced, longest first, without overlaps.

    The n-grams of a text are bounded by its words; only those found in the dictionary come back to it.
    """
    from leafloom.functions.text import word_ngrams

    words = texts.select("id", F.split("text", " ").alias("w"))
    grams = words.select("id", F.inline(word_ngrams(F.col("w"))))
    hits = grams.join(known.groupBy("phrase").agg(F.min("canonical").alias("canonical")), "phrase")
    listed = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((F.col("first") - F.col("last")).alias("neg"), F.col("first"), F.col("last"), F.col("canonical")))).alias("hits"))
    kind = "array<struct<neg:int,first:int,last:int,canonical:string>>"
    free = lambda out, h: ~F.exists(out, lambda o: (h["first"] < o["last"]) & (o["first"] < h["last"]))
    chosen = F.aggregate("hits", F.array().cast(kind), lambda out, h: F.when(free(out, h), F.concat(out, F.array(h))).otherwise(out))
    placed = words.join(listed.select("id", chosen.alias("c")), "id", "left").withColumn("c", F.coalesce("c", F.array().cast(kind)))

    def word(w, i):
        start = F.filter("c", lambda h: h["first"] == i)
        inside = F.exists("c", lambda h: (h["first"] < i) & (i < h["last"]))
        return F.when(F.size(start) > 0, F.element_at(start, 1)["canonical"]).when(~inside, w)

    return placed.select("id", F.array_join(F.array_compact(F.transform("w", word)), " ").alias("text"))


def seeded_subgraph(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, least: float, encoder: Callable | None = None) -> DataFrame:
    """Edges among the nodes similar to a seed term and all nodes below them."""
    from leafloom.operators.graphs import induced, reachable

    hits = find_similar_terms(seeds, nodes.select(F.col("name").alias("term")), least, None, encoder)
    start = nodes.join(hits.select(F.col("term").alias("name")).distinct(), "name", "left_semi").select(F.lit(0).alias("seed"), "node_id")
    return induced(edges, reachable(start, edges))


def connected_pair(a: DataFrame, b: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from one set of terms to the other, in either direction; ``a`` and ``b`` (term) come from ``find_similar_terms``."""
    ends = lambda d, c: d.select(F.col("term").alias(c)).distinct()
    there = edges.join(ends(a, "source"), "source", "left_semi").join(ends(b, "target"), "target", "left_semi")
    back = edges.join(ends(b, "source"), "source", "left_semi").join(ends(a, "target"), "target", "left_semi")
    return there.unionByName(back).distinct()


def standard_index(hits: DataFrame) -> DataFrame:
    """(term, raw_term): raw terms by the standard term they are similar to, once each, as rows."""
    return hits.select("term", F.col("query").alias("raw_term")).distinct()


def append_section(vectors: DataFrame, active: float = 4.0) -> DataFrame:
    """Vectors (id, section, vec) followed by one place a section, in order of the sections; their list is small."""
    sections = vectors.agg(F.array_sort(F.collect_set("section")).alias("sections"))
    flag = F.transform("sections", lambda s: F.when(s == F.col("section"), F.lit(active)).otherwise(0.0).cast("float"))
    return parallel(vectors).crossJoin(F.broadcast(sections)).select("id", "section", F.concat("vec", flag).alias("vec"))


def hard_negatives(anchors: DataFrame, candidates: DataFrame, positives: DataFrame, k: int = 3, least: float = 0.7) -> DataFrame:
    """(anchor, negative, sim): the most similar candidates that are no partner of the anchor."""
    pairs = similar_pairs(anchors, candidates, least).filter("a <> b")
    both = positives.select("a", "b").unionByName(positives.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return pairs.join(both, ["a", "b"], "left_anti").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select(F.col("a").alias("anchor"), F.col("b").alias("negative"), "sim")


def simplify_graph(edges: DataFrame, least: float = 0.99, encoder: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the edge list after its terms are unified by similarity."""
    from leafloom.operators.graphs import build_graph

    return build_graph(normalise_edges(edges, least, encoder))


def normalise_series(terms: DataFrame, least: float = 0.95, encoder: Callable | None = None) -> DataFrame:
    """(term, canonical) of the distinct non-null terms: the first term of each greedy cluster."""
    vectors = cut(encode_terms(terms, encoder=encoder).withColumnRenamed("term", "id"))
    pairs = similar_pairs(vectors, None, least)
    clusters = greedy_clusters(cut(pairs), vectors.select("id", F.col("id").alias("ord")))
    return clusters.select(F.col("id").alias("term"), F.col("cluster").alias("canonical"))
