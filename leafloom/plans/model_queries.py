"""Queries of similarity, clustering, networks, combinations, annotation, pairs, formats and streams."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.common import cut, shared_dir, table
from leafloom.functions import scores as N
from leafloom.functions.rules import apply_sql
from leafloom.functions.text import AT_MOST, TERMS, TIDY
from leafloom.operators import annotation, bayes, clustering, combinations, pairs
from leafloom.operators import relational as R
from leafloom.operators import similarity as E
from leafloom.plans.graph_queries import _E, _graph
from leafloom.plans.relational_queries import _rates, _RATES_SQL
from leafloom.sources import readers, writers
from leafloom.streaming import streams


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("section"), "label")


# ---- similarity and clusters


def sim_e02_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.similar_pairs(_vectors(spark, d).select("id", "vec"), None, 0.4).select("a", "b", F.round("sim", 4).alias("sim"))


def sim_j12_top_k(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select("id", "vec")
    q = v.select((F.col("id") + 1_000_000).alias("id"), "vec")
    return E.find_similar(q, v, 0.3, 3).select("query", "term", F.round("sim", 4).alias("sim"))


def sim_x34_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector with the mean vector of its label."""
    v = _vectors(spark, d)
    mean = v.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return v.join(mean, "label").select("id", F.round(N.cosine(F.col("vec"), F.col("mean")), 4).alias("cosine"))


def sim_e01_encoder(spark: SparkSession, d: str) -> DataFrame:
    """The nearest reference term of each effect, if near, by an encoder fitted to the terms and effects."""
    raw = table(spark, d, "side_effects").filter("effect IS NOT NULL AND trim(effect) <> ''").select(F.lower("effect").alias("term")).distinct()
    terms = table(spark, d, "effect_terms").select("term")
    encoder = E.train_encoder(terms.unionByName(raw))
    return E.find_similar_terms(raw, terms, 0.8, 1, encoder).select("query", "term", F.round("sim", 3).alias("sim"))


def sim_e04_greedy(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    p = E.similar_pairs(v.select("id", "vec"), None, 0.35)
    return E.greedy_clusters(cut(p), v.select("id", F.col("id").alias("ord")))


def sim_e05_components(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return E.similarity_components(E.similar_pairs(v.select("id", "vec"), None, 0.4), v)


def sim_e06_clusterable(spark: SparkSession, d: str) -> DataFrame:
    return E.clusterable_terms(table(spark, d, "edge_list").filter("source <> '' AND target <> ''"))[0]


def sim_e04b_normalised_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges normalised by the similarity of their terms, then tags by mode."""
    return E.normalise_edges(table(spark, d, "edge_list"), 0.95)


def sim_e07_phrases(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "side_effects").filter("effect IS NOT NULL").select("id", F.col("effect").alias("text"))
    return E.replace_phrases(texts, table(spark, d, "synonyms").select(F.col("variant").alias("phrase"), "canonical"))


def sim_e08_sections(spark: SparkSession, d: str) -> DataFrame:
    v = E.append_section(_vectors(spark, d).select("id", "section", "vec"))
    return v.select("id", F.size("vec").alias("n"), F.round(F.aggregate(F.slice("vec", 65, 100), F.lit(0.0), lambda a, x: a + x), 3).alias("flag"))


def sim_j20_connected(spark: SparkSession, d: str) -> DataFrame:
    """Edges between terms similar to two given ones."""
    e = table(spark, d, "edge_list").filter("source <> '' AND target <> ''").select("source", "target")
    terms = R.endpoint_bag(e).distinct()
    near = lambda t: E.find_similar_terms(spark.createDataFrame([(t,)], "term string"), terms, 0.35, None)
    return E.connected_pair(near("класс савинасестатов"), near("лонобонамид ретард"), e)


def sim_j21_standard(spark: SparkSession, d: str) -> DataFrame:
    """Raw effects by the reference term they are similar to."""
    raw = table(spark, d, "side_effects").filter("effect IS NOT NULL AND trim(effect) <> ''").select(F.col("effect").alias("term")).distinct()
    hits = E.find_similar_terms(raw, table(spark, d, "effect_terms").select("term"), 0.9, 1)
    return E.standard_index(hits).groupBy("term").agg(F.count("*").alias("n"))


def sim_t08_negatives(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    same = v.select(F.col("id").alias("a"), "label").join(v.select(F.col("id").alias("b"), "label"), "label").filter("a < b").select("a", "b")
    return E.hard_negatives(v.select("id", "vec"), v.select("id", "vec"), same, 2, 0.2).select("anchor", "negative", F.round("sim", 4).alias("sim"))


def clus_c01_k_means(spark: SparkSession, d: str) -> DataFrame:
    return clustering.k_means(_vectors(spark, d).select("id", "vec"), 5).groupBy("cluster").agg(F.count("*").alias("n"))


def clus_c02_dbscan(spark: SparkSession, d: str) -> DataFrame:
    return clustering.dbscan(_vectors(spark, d).select("id", "vec"), 0.3, 4)


def clus_c03_ward(spark: SparkSession, d: str) -> DataFrame:
    return clustering.agglomerative(_vectors(spark, d).select("id", "vec"), 10).groupBy("cluster").agg(F.count("*").alias("n"))


def clus_c04_density(spark: SparkSession, d: str) -> DataFrame:
    return clustering.density_tree_clusters(_vectors(spark, d).select("id", "vec"), 3)


def clus_c05_pca(spark: SparkSession, d: str) -> DataFrame:
    return clustering.pca(_vectors(spark, d).select("id", "vec"), 0.5).select("id", F.size("vec").alias("n"))


def clus_c08_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return clustering.reduce_and_cluster(_vectors(spark, d).select("id", "section", "vec"), 10, 5).groupBy("cluster").agg(F.count("*").alias("n"))


def clus_a14_davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return clustering.davies_bouldin(_vectors(spark, d).select("id", "vec", F.col("label").alias("cluster"))).select(F.round("davies_bouldin", 4).alias("davies_bouldin"), "n_clusters")


def clus_a14_silhouette(spark: SparkSession, d: str) -> DataFrame:
    score = clustering.silhouette(_vectors(spark, d).select("id", "vec", F.col("label").alias("cluster")))
    return spark.createDataFrame([(score,)], "silhouette double").select(F.round("silhouette", 4).alias("silhouette"))


def clus_c07_tsne(spark: SparkSession, d: str) -> DataFrame:
    """All vectors on a plane."""
    v = _vectors(spark, d)
    return clustering.tsne(v.select("id", "vec"), rounds=60).select("id", F.size("vec").alias("n"))


def clus_c09_grid(spark: SparkSession, d: str) -> DataFrame:
    """The best of all reductions and clusterings by silhouette, best first."""
    v = _vectors(spark, d).select("id", "vec")
    found = clustering.grid_search(v, {"none": None, "pca 8": lambda x: clustering.pca(x, 8)}, clustering.CLUSTERERS, top=5)
    return spark.createDataFrame([(i + 1, *f) for i, f in enumerate(found)], "rank int, reduction string, clustering string, silhouette double")


def clus_c10_cluster_file(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    out = clustering.cluster_file(v.select("id", F.col("label").alias("cluster")), v.select("id", F.col("id").cast("string").alias("label")))
    return out.select("cluster", "count", F.md5(F.array_join("labels", ",")).alias("labels_md5"))


# ---- networks


def _network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections of each drug group's drugs as a network: group, then its sections, with all links.

    Nodes of more than five parents have no table: their marginal is the product of their parents'.
    """
    se = table(spark, d, "side_effects").filter("drug IS NOT NULL AND section IS NOT NULL")
    dr = table(spark, d, "drugs").filter("drug IS NOT NULL AND drug_group IS NOT NULL").select("drug", "drug_group").distinct()
    edges = cut(se.join(dr, "drug").select(F.col("drug_group").alias("src"), F.col("section").alias("dst")).distinct())
    nodes = edges.select(F.col("src").alias("node_id"), F.lit("prepare").alias("tag")).unionByName(edges.select(F.col("dst").alias("node_id"), F.lit("side_e").alias("tag"))).distinct()
    parents = cut(bayes.parent_positions(edges))
    k = nodes.join(parents.groupBy("node").agg(F.count("*").alias("k")).withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("k", F.lit(0)).alias("k"))
    keys = F.create_map(*[x for i in range(6) for x in (F.lit(i), F.array(*[F.lit(c) for c in N.configurations(i)]))])
    rows = k.select(F.col("node_id").alias("node"), "k", F.explode(F.element_at(keys, F.col("k").cast("int"))).alias("config"))
    ones = F.length(F.regexp_replace("config", "[^1]", ""))
    cpt = rows.select("node", "config", F.when(F.col("config") == "", 0.1 + F.length("node") % 7 * 0.1).when(F.col("k") <= 3, 0.05 + 0.3 * ones).otherwise(0.05 + 0.9 * ones / F.col("k")).alias("p"))
    return cut(nodes), parents, cut(cpt)


def bayes_b01_marginals(spark: SparkSession, d: str) -> DataFrame:
    nodes, parents, cpt = _network(spark, d)
    return bayes.marginals(nodes, parents, cpt).select("node", F.round("p", 5).alias("p"))


def bayes_b02_evidence(spark: SparkSession, d: str) -> DataFrame:
    """One scenario a group: that group certain."""
    nodes, parents, cpt = _network(spark, d)
    ev = nodes.filter("tag = 'prepare'").select(F.xxhash64("node_id").alias("scenario"), F.col("node_id").alias("node"), F.lit(1.0).alias("value"))
    out = bayes.marginals(nodes, parents, cpt, cut(ev))
    return out.join(ev.select("scenario", F.col("node").alias("given")), "scenario").select("given", "node", F.round("p", 5).alias("p"))


def bayes_b04_independent(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of more than one parent take the product of their parents."""
    nodes, parents, cpt = _network(spark, d)
    return bayes.marginals(nodes, parents, cpt, most_parents=1).select("node", F.round("p", 5).alias("p"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """(drug, effect, prob): the largest rate of each drug's records of a section."""
    rows = table(spark, d, "side_effects").filter("drug IS NOT NULL AND section IS NOT NULL").select("drug", F.col("section").alias("effect"), F.lower("freq").alias("freq")).join(_rates(spark), "freq")
    return rows.groupBy("drug", "effect").agg(F.max("rate").alias("prob"))


def bayes_b09_pooled_loss(spark: SparkSession, d: str) -> DataFrame:
    """Targets of every drug and every pair of drugs, pooled by log odds, and their sum of squares against 0.1."""
    return bayes.pair_loss(cut(_targets(spark, d)), 0.1).select("n_scenarios", F.round("loss", 4).alias("loss"))


def bayes_b01_whole(spark: SparkSession, d: str) -> DataFrame:
    """Another name of ``bayes_b01_marginals``, whose network has all links too."""
    return bayes_b01_marginals(spark, d)


def bayes_b09_whole_loss(spark: SparkSession, d: str) -> DataFrame:
    """Another name of ``bayes_b09_pooled_loss``, which takes every drug and every pair too."""
    return bayes_b09_pooled_loss(spark, d)


def bayes_b16_export(spark: SparkSession, d: str) -> DataFrame:
    return bayes.export_cpt(_network(spark, d)[2])


def _fitting(spark: SparkSession, d: str) -> tuple[bayes.Network, np.ndarray, np.ndarray]:
    """The network with one scenario a group, and a target of the share of the group's records for every section."""
    network = bayes.Network(*_network(spark, d))
    groups = [i for i, ps in enumerate(network.parents) if not ps]
    evidence = np.full((len(groups), len(network.nodes)), -1.0)
    evidence[np.arange(len(groups)), groups] = 1.0
    targets = np.full(evidence.shape, np.nan)
    for i, ps in enumerate(network.parents):
        if ps:
            targets[:, i] = [0.2 + 0.05 * ((len(network.nodes[i]) + len(network.nodes[g])) % 7) for g in groups]
    return network, evidence, targets


def _losses(spark: SparkSession, losses: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "step int, loss double")


def bayes_b12_numeric(spark: SparkSession, d: str) -> DataFrame:
    """Losses of a descent by finite differences."""
    network, evidence, targets = _fitting(spark, d)
    return _losses(spark, network.fit_numeric(evidence, targets, 5))


def bayes_b13_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Losses of a limited-memory quasi-Newton fit within bounds."""
    network, evidence, targets = _fitting(spark, d)
    return _losses(spark, network.fit_quasi_newton(evidence, targets))


def bayes_b14_schedules(spark: SparkSession, d: str) -> DataFrame:
    """First and last loss of a fit by each schedule, plain and rectified."""
    rows = []
    for schedule in ("cosine", "exponential", "plateau"):
        for rectified in (False, True):
            network, evidence, targets = _fitting(spark, d)
            losses = network.fit(evidence, targets, 60, decay=1e-4, schedule=schedule, rectified=rectified)
            rows.append((schedule, rectified, float(losses[0]), float(losses[-1])))
    return spark.createDataFrame(rows, "schedule string, rectified boolean, first_loss double, last_loss double")


def bayes_b15_validation(spark: SparkSession, d: str) -> DataFrame:
    """Loss on each of three folds of the scenarios before and after a fit to the others, with dropout and a prior."""
    network, evidence, targets = _fitting(spark, d)
    fold = np.arange(len(evidence)) % 3
    found = bayes.cross_validate(network, evidence, targets, fold, epochs=40, prior=0.01, drop_entries=0.1, drop_parents=0.1, patience=10)
    return spark.createDataFrame(found, "fold int, before double, after double")


def bayes_b18b_unflatten(spark: SparkSession, d: str) -> DataFrame:
    """The tables with all values from a parameter vector in which every value is its complement."""
    cpt = _network(spark, d)[2]
    vector = bayes.parameter_vector(cpt).withColumn("p", F.round(1 - F.col("p"), 6))
    return bayes.with_parameters(cpt, vector)


def bayes_b18_parameters(spark: SparkSession, d: str) -> DataFrame:
    return bayes.parameter_vector(_network(spark, d)[2])


# ---- combinations


def _weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of drug groups and sections from the counts of records."""
    se = table(spark, d, "side_effects").filter("drug IS NOT NULL")
    dr = table(spark, d, "drugs").filter("drug IS NOT NULL AND drug_group IS NOT NULL").groupBy("drug").agg(F.min("drug_group").alias("g"))
    rows = se.join(dr, "drug").select("g", F.trim(F.lower("section")).alias("section"))
    total = rows.groupBy("g").agg(F.count("*").alias("total"))
    cases = rows.filter("section IS NOT NULL").groupBy("g", "section").agg(F.count("*").alias("cases")).join(total, "g")
    return cases.select("g", "section", N.effect_weight(F.col("cases"), F.length("section") / 50, F.col("total")).alias("w"))


def comb_n05_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of every group and section, 0 where there is no record."""
    se = table(spark, d, "side_effects").filter("drug IS NOT NULL")
    dr = table(spark, d, "drugs").filter("drug IS NOT NULL AND drug_group IS NOT NULL").groupBy("drug").agg(F.min("drug_group").alias("g"))
    rows = cut(se.join(dr, "drug").select(F.col("g").alias("drug"), F.trim(F.lower("section")).alias("effect")))
    ranks = rows.filter("effect IS NOT NULL").select("effect", (F.length("effect") / 50).alias("rank")).distinct()
    grid = combinations.weight_matrix(rows, ranks, rows.filter("effect IS NOT NULL").groupBy("drug", "effect").agg(F.count("*").alias("cases")), rows.groupBy("drug").agg(F.count("*").alias("total")))
    return grid.select(F.col("drug").alias("drug_group"), F.col("effect").alias("section"), F.coalesce("w", F.lit(0.0)).alias("w"))


def _ids(spark: SparkSession, d: str) -> DataFrame:
    w = cut(_weights(spark, d))
    g, s = R.surrogate_keys(w, "g", "drug_id"), R.surrogate_keys(w, "section", "se_id")
    return cut(w.join(g, "g").join(s, "section").select("drug_id", "se_id", "w"))


def comb_n01_rank_sums(spark: SparkSession, d: str) -> DataFrame:
    """One combination of the first three groups: all effects by class."""
    chosen = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 0), (1, 2)], "combo int, drug_id bigint")
    return combinations.classified_effects(combinations.rank_sums(_ids(spark, d), chosen)).select("class", "position", "se_id", "rank")


def comb_n02_what_if(spark: SparkSession, d: str) -> DataFrame:
    chosen = spark.createDataFrame([(1, 1), (1, 2)], "combo int, drug_id bigint")
    return combinations.what_if(_ids(spark, d), chosen).select("drug_id", "class")


def comb_n03_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = _ids(spark, d)
    return combinations.pair_classes(w, w.select(F.col("drug_id").alias("id")).distinct())


def comb_j11_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All unordered pairs of drug groups by their ids."""
    return combinations.pairs(_ids(spark, d).select(F.col("drug_id").alias("id")).distinct())


def comb_n04_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples with a compatible pair (class 1), none of whose pairs is incompatible (class 3)."""
    w = _ids(spark, d)
    ids = w.select(F.col("drug_id").alias("id")).distinct()
    both = cut(combinations.pair_classes(w, ids))
    return combinations.compatible_triples(both.filter("class = 1"), both.filter("class = 3"), ids)


# ---- annotation and pairs


def ner_f02_spans(spark: SparkSession, d: str) -> DataFrame:
    out = annotation.repaired_spans(table(spark, d, "entities"), table(spark, d, "documents").filter("text IS NOT NULL"))
    return out.select("entity_id", "start_offset", "end_offset", "span_text")


def ner_w05_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return annotation.without_overlaps(table(spark, d, "entities")).select("doc_id", "entity_id")


def ner_f03_bio(spark: SparkSession, d: str) -> DataFrame:
    """Tags of all tokens of annotated documents, counted."""
    ents = table(spark, d, "entities")
    docs = table(spark, d, "documents").join(ents.select("doc_id").distinct(), "doc_id", "left_semi")
    return annotation.bio_tags(cut(annotation.document_tokens(docs)), ents).groupBy("tag").agg(F.count("*").alias("n"))


def ner_f04_segments(spark: SparkSession, d: str) -> DataFrame:
    ents = annotation.without_overlaps(table(spark, d, "entities"))
    docs = table(spark, d, "documents").join(ents.select("doc_id").distinct(), "doc_id", "left_semi")
    seg = annotation.segments(cut(annotation.bio_tags(annotation.document_tokens(docs), ents)))
    return seg.groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def ner_f06_sentences(spark: SparkSession, d: str) -> DataFrame:
    out = annotation.sentence_records(table(spark, d, "documents").filter("text IS NOT NULL"), table(spark, d, "entities"), table(spark, d, "relations"))
    return out.select("doc_id", "sent_no", F.size("entities").alias("n_entities"), "n_relations", "n_missing")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Terms by section as clusters, grouped by their first word; rare words are without a group."""
    t = table(spark, d, "effect_terms").select(F.col("section").alias("cluster"), F.col("term").alias("label"), F.substring_index("term", " ", 1).alias("w"))
    n = F.length("w")
    return t.select("cluster", "label", F.when(n > 4, n).alias("group_id"))


def pair_r01_positive(spark: SparkSession, d: str) -> DataFrame:
    return pairs.positive_pairs(_labels(spark, d))


def pair_r02_negative(spark: SparkSession, d: str) -> DataFrame:
    return pairs.negative_pairs(_labels(spark, d))


def pair_r03_balanced(spark: SparkSession, d: str) -> DataFrame:
    x = _labels(spark, d)
    out = pairs.split_80_10_10(pairs.balanced(pairs.positive_pairs(x), pairs.negative_pairs(x), 1.0))
    return out.groupBy("part", "y").agg(F.count("*").alias("n"))


def pair_r05_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return pairs.dictionary_clusters(table(spark, d, "synonyms"))


def pair_r05b_inverse(spark: SparkSession, d: str) -> DataFrame:
    return pairs.clusters_to_dictionary(pairs.dictionary_clusters(table(spark, d, "synonyms"))).select("canonical", F.size("variants").alias("n"))


# ---- formats and streams


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/format-{uuid.uuid4().hex}"


def src_s03_edge_list(spark: SparkSession, d: str) -> DataFrame:
    """The edge list written as a table with semicolons and read again."""
    path = _folder(spark)
    writers.csv_rows(table(spark, d, "edge_list").na.fill(""), path)
    return readers.edge_list(spark, path).select(*[F.col(c) for c in ("source", "source_tag", "target", "target_tag")])


def src_s07_json(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    writers.json_rows(table(spark, d, "drugs").select("id", "drug", "drug_group"), path)
    whole = _folder(spark)
    # one document: an array of the rows
    spark.read.text(path).coalesce(1).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value")).write.text(whole)
    return readers.json_document(spark, whole, "id bigint, drug string, drug_group string")


def src_s14_graphml(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge graph drawn and read again: its links by the names and tags of their ends."""
    nodes, edges = _graph(spark, d)
    path = _folder(spark)
    # a label reads "name (tag)": names with brackets or white space at their ends would read as others
    plain = cut(nodes.withColumn("name", F.md5("name")))
    writers.graphml_lines(plain, edges).coalesce(1).write.text(path)
    back, back_e = readers.graphml(spark, path)
    end = lambda c, n: back.select(F.col("node_id").alias(c), F.concat_ws("|", "name", "tag").alias(n))
    return back_e.join(end("src", "source"), "src").join(end("dst", "target"), "dst").select("source", "target")


def src_k03_routed(spark: SparkSession, d: str) -> DataFrame:
    """Records written by frequency class in one pass, a folder each, and read back with the class from the folder's name."""
    path = _folder(spark)
    rows = table(spark, d, "side_effects").filter("freq IS NOT NULL").select("id", F.md5("effect").alias("effect_md5"), F.lower(F.trim("freq")).alias("freq"))
    writers.routed_csv(rows, path, "freq")
    return spark.read.schema("id bigint, effect_md5 string, freq string").csv(path, sep=";", header=True)


def src_k10_corpus(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").filter("text IS NOT NULL").select(F.split("text", "\n").alias("l"))
    more = table(spark, d, "side_effects").select(F.array("effect").alias("l"))
    return writers.corpus([(lines, "l"), (more, "l")]).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("n_chars"))


def src_k11_html(spark: SparkSession, d: str) -> DataFrame:
    items = F.array(F.struct(F.lit("жалоба").alias("text"), F.lit(None).cast("string").alias("tag")), F.struct(F.col("effect").alias("text"), F.lit("side_e").alias("tag")))
    return table(spark, d, "side_effects").filter("effect IS NOT NULL").select("id", annotation.marked_html(items).alias("html"))


def src_k14_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Documents of different content, the first by id stays, numbered."""
    files = table(spark, d, "documents").filter("text IS NOT NULL").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), F.col("text").alias("content"))
    return writers.number_files(files)


def src_s10_workbook(spark: SparkSession, d: str) -> DataFrame:
    """Reference terms written as a workbook and read cell by cell."""
    from leafloom.plans.page_queries import publish

    with tempfile.TemporaryDirectory() as folder:
        local = f"{folder}/terms.xlsx"
        writers.workbook_file(table(spark, d, "effect_terms").select("term_id", "term", "section").orderBy("term_id"), local)
        path = publish(spark, local, "terms.xlsx")
    cells = readers.workbook_cells(spark, path).filter("row_no > 0")
    wide = cells.groupBy("row_no").agg(*[F.max(F.when(F.col("col_no") == i, F.col("value"))).alias(c) for i, c in enumerate(("term_id", "term", "section"))])
    return wide.select("row_no", F.col("term_id").cast("int").alias("term_id"), "term", "section")


def _events_folder(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    path = _folder(spark)
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(path)
    return path, e


def stream_s18_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of events by type, as a stream of files."""
    path, e = _events_folder(spark, d)
    s = streams.new_files(spark, path, e.schema)
    return streams.run_available(streams.counts_per_window(s, "ts", "event_type", "1 hour", "2 hours"), f"w{uuid.uuid4().hex}", "complete").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def stream_s18b_sessions(spark: SparkSession, d: str) -> DataFrame:
    path, e = _events_folder(spark, d)
    s = streams.new_files(spark, path, e.schema)
    return streams.run_available(streams.sessions(s, "ts", "user_id", "30 minutes", "1 hour"), f"s{uuid.uuid4().hex}", "complete").withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("sim_", "clus_", "bayes_", "comb_", "ner_", "pair_", "src_", "stream_")) and callable(f)}

_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_P = lambda t: f"SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= {t}"
_LABELS = "x AS (SELECT DISTINCT section AS cluster, term AS label, CASE WHEN length(string_split(term, ' ')[1]) > 4 THEN length(string_split(term, ' ')[1]) END AS group_id FROM effect_terms)"
_WEIGHTS = """r AS (SELECT g, trim(lower(section)) AS section FROM side_effects JOIN (SELECT drug, min(drug_group) AS g FROM drugs WHERE drug IS NOT NULL AND drug_group IS NOT NULL GROUP BY 1) USING (drug)),
w AS (SELECT g, section, round(power(count(*) * (length(section) / 50.0) / (SELECT count(*) FROM r q WHERE q.g = r.g), 0.4), 2) AS w FROM r WHERE section IS NOT NULL GROUP BY 1, 2),
i AS (SELECT dense_rank() OVER (ORDER BY g) AS drug_id, dense_rank() OVER (ORDER BY section) AS se_id, w FROM w)"""
_CLASS = "CASE WHEN {0} >= 1.0 THEN 3 WHEN {0} >= 0.5 THEN 2 ELSE 1 END"
_NET = """c AS (SELECT drug_group AS g, s.section AS s, count(*) AS n FROM side_effects s JOIN (SELECT DISTINCT drug, drug_group FROM drugs WHERE drug IS NOT NULL AND drug_group IS NOT NULL) USING (drug) WHERE s.section IS NOT NULL GROUP BY 1, 2),
e AS (SELECT g, s FROM c),
q AS (SELECT DISTINCT g, CAST(0.1 + length(g) % 7 * 0.1 AS DOUBLE) AS p FROM e)"""
#: The marginal of a section of the parents' values {0}: a table that adds, or the product where there is none.
_MIX = "CASE WHEN count(*) > 5 THEN exp(sum(ln({0}))) WHEN count(*) <= 3 THEN 0.05 + 0.3 * sum({0}) ELSE 0.05 + 0.9 * sum({0}) / count(*) END"
_TABLE = "f AS (SELECT s AS node, array_to_string(list_transform(range(k), lambda j: CAST((c.n >> CAST(k - 1 - j AS INT)) & 1 AS VARCHAR)), ',') AS config FROM (SELECT s, count(*) AS k FROM e GROUP BY 1), range(32) c(n) WHERE k <= 5 AND c.n < (1 << CAST(k AS INT)) UNION ALL SELECT g, '' FROM q)"
_ONES = "length(replace(replace(config, '0', ''), ',', ''))"
_CPT = f"CAST(CASE WHEN config = '' THEN 0.1 + length(node) % 7 * 0.1 WHEN length(replace(config, ',', '')) <= 3 THEN 0.05 + 0.3 * {_ONES} ELSE 0.05 + 0.9 * {_ONES} / length(replace(config, ',', '')) END AS DOUBLE)"
SQL = {
    "sim_e02_pairs": f"SELECT a, b, round(sim, 4) AS sim FROM ({_P(0.4)})",
    "sim_j12_top_k": f"SELECT query, term, round(sim, 4) AS sim FROM (SELECT a.vec_id + 1000000 AS query, b.vec_id AS term, {_COS} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r FROM embeddings a CROSS JOIN embeddings b) WHERE r <= 3 AND sim >= 0.3",
    "sim_e05_components": f"WITH RECURSIVE p AS ({_P(0.4)}), u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(id, o) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.o) SELECT id, min(o) AS cluster FROM r GROUP BY 1",
    "sim_e06_clusterable": "WITH e AS (SELECT * FROM edge_list WHERE source <> '' AND target <> ''), f AS (SELECT source AS t FROM e WHERE source_tag = 'prepare' OR target_tag = 'prepare' UNION SELECT target FROM e WHERE source_tag = 'prepare' OR target_tag = 'prepare') SELECT source AS term FROM e WHERE source NOT IN (SELECT t FROM f) UNION SELECT target FROM e WHERE target NOT IN (SELECT t FROM f)",
    "sim_e08_sections": "SELECT vec_id AS id, CAST(64 + (SELECT count(DISTINCT label) FROM embeddings) AS INT) AS n, 4.0 AS flag FROM embeddings",
    "clus_c10_cluster_file": "SELECT label AS cluster, count(*) AS count, md5(string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY CAST(vec_id AS VARCHAR))) AS labels_md5 FROM embeddings GROUP BY 1",
    "comb_n05_weights": f"WITH {_WEIGHTS}, a AS (SELECT DISTINCT g FROM r), b AS (SELECT DISTINCT section FROM r WHERE section IS NOT NULL) SELECT a.g AS drug_group, b.section, coalesce(w, 0) AS w FROM a CROSS JOIN b LEFT JOIN w ON w.g = a.g AND w.section = b.section",
    "comb_n01_rank_sums": f"WITH {_WEIGHTS}, s AS (SELECT se_id, sum(w) AS m FROM i WHERE drug_id IN (1, 2, 3) GROUP BY 1), k AS (SELECT se_id, {_CLASS.format('m')} AS class, round(m, 2) AS rank FROM s) SELECT class, CAST(row_number() OVER (PARTITION BY class ORDER BY rank DESC, se_id) AS INT) AS position, se_id, rank FROM k",
    "comb_n02_what_if": f"WITH {_WEIGHTS}, s AS (SELECT se_id, sum(w) AS m FROM i WHERE drug_id IN (1, 2) GROUP BY 1), k AS (SELECT drug_id, max(m + w) AS m FROM i JOIN s USING (se_id) WHERE drug_id NOT IN (1, 2) GROUP BY 1) SELECT drug_id, {_CLASS.format('m')} AS class FROM k WHERE m >= 0.5",
    "comb_n03_pairs": f"WITH {_WEIGHTS}, k AS (SELECT a.drug_id AS id1, b.drug_id AS id2, max(a.w + b.w) AS m FROM i a JOIN i b ON a.se_id = b.se_id AND a.drug_id < b.drug_id GROUP BY 1, 2) SELECT id1, id2, {_CLASS.format('m')} AS class, round(m, 2) AS rank FROM k",
    "comb_j11_pairs": f"WITH {_WEIGHTS}, d AS (SELECT DISTINCT drug_id AS id FROM i) SELECT a.id AS id1, b.id AS id2 FROM d a JOIN d b ON a.id < b.id",
    "comb_n04_triples": f"WITH {_WEIGHTS}, d AS (SELECT DISTINCT drug_id AS id FROM i), k AS (SELECT x.drug_id AS p, y.drug_id AS q, {_CLASS.format('max(x.w + y.w)')} AS class FROM i x JOIN i y ON x.se_id = y.se_id AND x.drug_id < y.drug_id GROUP BY 1, 2) SELECT a.id AS a, b.id AS b, c.id AS c FROM d a JOIN d b ON a.id < b.id JOIN d c ON b.id < c.id LEFT JOIN k x ON (x.p, x.q) = (a.id, b.id) LEFT JOIN k y ON (y.p, y.q) = (a.id, c.id) LEFT JOIN k z ON (z.p, z.q) = (b.id, c.id) WHERE 1 IN (coalesce(x.class, 0), coalesce(y.class, 0), coalesce(z.class, 0)) AND 3 NOT IN (coalesce(x.class, 0), coalesce(y.class, 0), coalesce(z.class, 0))",
    "bayes_b01_marginals": f"WITH {_NET} SELECT g AS node, round(p, 5) AS p FROM q UNION ALL SELECT s, round({_MIX.format('p')}, 5) FROM e JOIN q USING (g) GROUP BY 1",
    "bayes_b02_evidence": f"WITH {_NET}, v AS (SELECT x.g AS given, y.g, CASE WHEN x.g = y.g THEN 1.0 ELSE y.p END AS p FROM q x CROSS JOIN q y) SELECT given, g AS node, round(p, 5) AS p FROM v UNION ALL SELECT given, s, round({_MIX.format('least(p, 1 - 1e-6)')}, 5) FROM e JOIN v USING (g) GROUP BY 1, 2",
    "bayes_b04_independent": f"WITH {_NET} SELECT g AS node, round(p, 5) AS p FROM q UNION ALL SELECT s, round(CASE WHEN count(*) > 1 THEN exp(sum(ln(p))) ELSE 0.05 + 0.3 * sum(p) END, 5) FROM e JOIN q USING (g) GROUP BY 1",
    "bayes_b18_parameters": f"WITH {_NET}, {_TABLE} SELECT CAST(row_number() OVER (ORDER BY node, config) - 1 AS INT) AS param_id, node, config, round({_CPT}, 6) AS p FROM f",
    "bayes_b09_pooled_loss": f"WITH t AS (SELECT drug, section AS effect, max(rate) AS prob FROM side_effects s JOIN {_RATES_SQL} ON r.freq = lower(s.freq) WHERE drug IS NOT NULL AND section IS NOT NULL GROUP BY 1, 2), d AS (SELECT DISTINCT drug FROM t), sc AS (SELECT drug AS s, drug FROM d UNION ALL SELECT a.drug || '|' || b.drug, unnest([a.drug, b.drug]) FROM d a JOIN d b ON a.drug < b.drug), p AS (SELECT s, effect, 1 / (1 + exp(-sum(ln(greatest(prob, 1e-6) / (1 - greatest(prob, 1e-6)))))) AS target FROM sc JOIN t USING (drug) GROUP BY 1, 2) SELECT count(DISTINCT s) AS n_scenarios, round(sum((target - 0.1) * (target - 0.1)), 4) AS loss FROM p",
    "pair_r01_positive": f"WITH {_LABELS} SELECT DISTINCT a.label AS a, b.label AS b FROM x a JOIN x b ON a.cluster = b.cluster AND a.group_id = b.group_id AND a.label < b.label",
    "pair_r02_negative": f"WITH {_LABELS} SELECT DISTINCT a.label AS a, b.label AS b FROM x a JOIN x b ON a.cluster = b.cluster AND a.label < b.label WHERE a.group_id <> b.group_id OR ((a.group_id IS NULL) <> (b.group_id IS NULL) AND len(list_intersect(string_split(a.label, ' '), string_split(b.label, ' '))) < 2)",
    "pair_r05_dictionary": "SELECT DISTINCT canonical AS cluster, unnest([canonical, variant]) AS label, 1 AS group_id FROM synonyms",
    "src_s03_edge_list": "SELECT coalesce(source, '') AS source, coalesce(source_tag, '') AS source_tag, coalesce(target, '') AS target, coalesce(target_tag, '') AS target_tag FROM edge_list",
    "src_s07_json": "SELECT id, drug, drug_group FROM drugs",
    "src_k03_routed": "SELECT id, md5(effect) AS effect_md5, lower(trim(freq)) AS freq FROM side_effects WHERE freq IS NOT NULL",
    "src_k10_corpus": "SELECT count(*) AS n, sum(length(l)) AS n_chars FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents UNION ALL SELECT effect FROM side_effects) WHERE l <> ''",
    "src_k11_html": "SELECT id, 'жалоба <mark class=\"side_e\">' || replace(replace(replace(effect, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</mark>' AS html FROM side_effects WHERE effect IS NOT NULL",
    "src_k14_numbered": "SELECT row_number() OVER (ORDER BY name) AS number, name FROM (SELECT min(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS name FROM documents WHERE text IS NOT NULL GROUP BY text)",
    "src_s10_workbook": "SELECT CAST(row_number() OVER (ORDER BY term_id) AS INT) AS row_no, term_id, term, section FROM effect_terms",
    "stream_s18_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_s18b_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k",
}

_EDGE = r"[\s\p{Z},.;:\-]"
SQL["ner_f02_spans"] = rf"""WITH d AS (SELECT e.entity_id, text, start_offset AS s, end_offset AS e FROM entities e JOIN documents USING (doc_id) WHERE text IS NOT NULL AND start_offset >= 0 AND start_offset <= end_offset AND end_offset <= length(text)),
  i AS (SELECT *, substr(text, s + 1, e - s) AS x FROM d),
  j AS (SELECT *, regexp_full_match(x, '{_EDGE}*') AS void, length(regexp_replace(x, '[^("«]', '', 'g')) - length(regexp_replace(x, '[^)"»]', '', 'g')) AS surplus,
    length(regexp_extract(x, '^{_EDGE}*')) AS lead, length(regexp_extract(x, '{_EDGE}*$')) AS trail FROM i),
  k AS (SELECT *, CASE WHEN void THEN s ELSE s + lead END AS l, CASE WHEN void THEN s ELSE e - trail END AS r FROM j),
  m AS (SELECT *, l + CASE WHEN r > l AND surplus > 0 AND substr(text, l + 1, 1) IN ('(', '"', '«') THEN 1 ELSE 0 END AS l1 FROM k),
  n AS (SELECT *, r - CASE WHEN r > l1 AND surplus < 0 AND substr(text, r, 1) IN (')', '"', '»') THEN 1 ELSE 0 END AS r1 FROM m),
  o AS (SELECT entity_id, text, l1 - length(regexp_extract(substr(text, 1, l1), '\p{{L}}*$')) AS l2, r1 + length(regexp_extract(substr(text, r1 + 1), '^\p{{L}}*')) AS r2 FROM n)
SELECT entity_id, CAST(l2 AS INT) AS start_offset, CAST(r2 AS INT) AS end_offset, substr(text, l2 + 1, r2 - l2) AS span_text FROM o"""
SQL |= {"bayes_b01_whole": SQL["bayes_b01_marginals"], "bayes_b09_whole_loss": SQL["bayes_b09_pooled_loss"]}
SQL |= {
    "clus_c02_dbscan": f"""WITH RECURSIVE p AS ({_P(0.3)}), u AS (SELECT a, b, sim FROM p UNION ALL SELECT b, a, sim FROM p), c AS (SELECT vec_id AS id FROM embeddings LEFT JOIN u ON u.a = vec_id GROUP BY 1 HAVING count(b) + 1 >= 4),
  l AS (SELECT a, b FROM u WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)), r(id, o) AS (SELECT id, id FROM c UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.o), k AS (SELECT id, min(o) AS cluster FROM r GROUP BY 1),
  j AS (SELECT a AS id, arg_max(b, (sim, -b)) AS core FROM u WHERE a NOT IN (SELECT id FROM c) AND b IN (SELECT id FROM c) GROUP BY 1)
SELECT vec_id AS id, coalesce(k.cluster, m.cluster, -1) AS cluster FROM embeddings LEFT JOIN k ON k.id = vec_id LEFT JOIN j ON j.id = vec_id LEFT JOIN k m ON m.id = j.core""",
    "clus_a14_silhouette": """WITH d AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM embeddings a CROSS JOIN embeddings b),
  m AS (SELECT i, li, lj, sum(d) AS s, count(*) AS n FROM d GROUP BY 1, 2, 3), k AS (SELECT i, max(CASE WHEN li = lj THEN CASE WHEN n > 1 THEN s / (n - 1) END END) AS a, min(CASE WHEN li <> lj THEN s / n END) AS b FROM m GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM k""",
    "sim_e04_greedy": f"""WITH RECURSIVE p AS ({_P(0.35)}), u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS no FROM embeddings), n AS (SELECT o.id, o.no, list(u.b) FILTER (u.b IS NOT NULL) AS near FROM o LEFT JOIN u ON u.a = o.id GROUP BY 1, 2),
  s(no, taken, seeds) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL SELECT n.no, CASE WHEN list_contains(taken, n.id) THEN taken ELSE list_concat(taken, list_append(coalesce(near, []), n.id)) END, CASE WHEN list_contains(taken, n.id) THEN seeds ELSE list_append(seeds, n.id) END FROM s JOIN n ON n.no = s.no + 1),
  f AS (SELECT unnest(seeds) AS seed FROM s WHERE no = (SELECT max(no) FROM o))
SELECT id, CASE WHEN id IN (SELECT seed FROM f) THEN id ELSE coalesce((SELECT min(u.b) FROM u WHERE u.a = o.id AND u.b IN (SELECT seed FROM f)), id) END AS cluster FROM o""",
    "bayes_b16_export": f"""WITH {_NET}, {_TABLE} SELECT node, '{{' || string_agg(chr(34) || config || chr(34) || ':' || CAST(round({_CPT}, 6) AS VARCHAR), ',' ORDER BY config) || '}}' AS "table" FROM f GROUP BY 1""",
}
#: Words and signs of all texts with their offsets: gaps and tokens alternate.
_POSITIONS = r"""a AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]')) AS token, unnest(string_split_regex(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]')[1:len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]'))]) AS gap, unnest(range(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]')))) AS no FROM documents WHERE doc_id IN (SELECT doc_id FROM entities)),
  tok AS (SELECT doc_id, no, token, CAST(sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY no) AS BIGINT) AS e, length(token) AS n FROM a)"""
SQL |= {
    "ner_f03_bio": f"""WITH {_POSITIONS}, h AS (SELECT tok.doc_id, no, arg_min({{'s': start_offset, 'l': label}}, (start_offset, entity_id)) AS f, min(tok.e - n) AS first FROM tok JOIN entities x ON x.doc_id = tok.doc_id AND tok.e - n >= start_offset AND tok.e <= end_offset GROUP BY 1, 2)
SELECT CASE WHEN f IS NULL THEN 'O' WHEN h.first = f.s THEN 'B-' || coalesce(f.l, '') ELSE 'I-' || coalesce(f.l, '') END AS tag, count(*) AS n FROM tok LEFT JOIN h USING (doc_id, no) GROUP BY 1""",
    "ner_w05_overlaps": """WITH RECURSIVE o AS (SELECT doc_id, entity_id, start_offset AS s, end_offset AS e, row_number() OVER (PARTITION BY doc_id ORDER BY start_offset, end_offset, entity_id) AS no FROM entities),
  w(doc_id, no, ids, ls, le) AS (SELECT doc_id, no, [entity_id], s, e FROM o WHERE no = 1
    UNION ALL SELECT o.doc_id, o.no, CASE WHEN o.s >= le THEN list_append(ids, o.entity_id) WHEN le - ls < o.e - o.s THEN list_append(ids[1:len(ids) - 1], o.entity_id) ELSE ids END,
      CASE WHEN o.s >= le OR le - ls < o.e - o.s THEN o.s ELSE ls END, CASE WHEN o.s >= le OR le - ls < o.e - o.s THEN o.e ELSE le END FROM w JOIN o ON o.doc_id = w.doc_id AND o.no = w.no + 1),
  f AS (SELECT doc_id, arg_max(ids, no) AS ids FROM w GROUP BY 1)
SELECT doc_id, unnest(ids) AS entity_id FROM f""",
    "graph_g26_symmetric": """WITH e AS (SELECT * FROM edge_list WHERE source <> '' AND target <> ''), p AS (SELECT DISTINCT least(a.source, a.target) AS lo, greatest(a.source, a.target) AS hi FROM e a JOIN e b ON a.source = b.target AND a.target = b.source WHERE a.source <> a.target),
  k AS (SELECT lo, hi, CASE WHEN length(hi) < length(lo) THEN hi ELSE lo END AS c FROM p), t AS (SELECT term, min(c) AS c FROM (SELECT lo AS term, c FROM k UNION ALL SELECT hi, c FROM k) WHERE term <> c GROUP BY 1),
  r AS (SELECT coalesce(x.c, source) AS source, source_tag, coalesce(y.c, target) AS target, target_tag FROM e LEFT JOIN t x ON x.term = source LEFT JOIN t y ON y.term = target), f AS (SELECT * FROM r WHERE source <> target),
  a AS (SELECT source, target, arg_min(source_tag, (-n, source_tag)) AS source_tag FROM (SELECT source, target, source_tag, count(*) AS n FROM f WHERE source_tag IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
  b AS (SELECT source, target, arg_min(target_tag, (-n, target_tag)) AS target_tag FROM (SELECT source, target, target_tag, count(*) AS n FROM f WHERE target_tag IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT d.source, d.target, source_tag, target_tag FROM (SELECT DISTINCT source, target FROM f) d LEFT JOIN a ON a.source = d.source AND a.target = d.target LEFT JOIN b ON b.source = d.source AND b.target = d.target""",
}
SQL["src_s14_graphml"] = f"WITH {_E} SELECT DISTINCT md5(s) || '|' || st AS source, md5(t) || '|' || tt AS target FROM e"
SQL["bayes_b18b_unflatten"] = f"WITH {_NET}, {_TABLE} SELECT node, config, round(1 - round({_CPT}, 6), 6) AS p FROM f"
#: A text with a mark behind every sentence; the sign that begins the next one is taken and put back.
_BEGINS = r"[^a-zа-яё_\s\p{Z}\p{P}\p{S}\p{M}\p{C}]|[«„“\"]"
_MARKED = "text"
for _ in range(2):
    _MARKED = rf"regexp_replace({_MARKED}, '([.!?…][»”\")]?[\s\p{{Z}}]+)({_BEGINS})', '\1' || chr(1) || '\2', 'g')"
_MARKED = rf"regexp_replace({_MARKED}, '(\n+)', '\1' || chr(1), 'g')"
SQL["ner_f06_sentences"] = rf"""WITH RECURSIVE f AS ({SQL['ner_f02_spans']}), x AS (SELECT e.doc_id, f.entity_id, f.start_offset AS s, f.end_offset AS e FROM f JOIN entities e USING (entity_id)),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, entity_id) AS no FROM x),
  w(doc_id, no, ids, ls, le) AS (SELECT doc_id, no, [entity_id], s, e FROM o WHERE no = 1
    UNION ALL SELECT o.doc_id, o.no, CASE WHEN o.s >= le THEN list_append(ids, o.entity_id) WHEN le - ls < o.e - o.s THEN list_append(ids[1:len(ids) - 1], o.entity_id) ELSE ids END,
      CASE WHEN o.s >= le OR le - ls < o.e - o.s THEN o.s ELSE ls END, CASE WHEN o.s >= le OR le - ls < o.e - o.s THEN o.e ELSE le END FROM w JOIN o ON o.doc_id = w.doc_id AND o.no = w.no + 1),
  k AS (SELECT doc_id, unnest(ids) AS entity_id FROM (SELECT doc_id, arg_max(ids, no) AS ids FROM w GROUP BY 1)),
  p AS (SELECT doc_id, unnest(string_split(m, chr(1))) AS piece, unnest(range(len(string_split(m, chr(1))))) AS i FROM (SELECT doc_id, {_MARKED} AS m FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM entities))),
  q AS (SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM p),
  z AS (SELECT doc_id, b - length(piece) AS a, b, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sent_no FROM q WHERE regexp_matches(piece, '[^\s\p{{Z}}]')),
  c AS (SELECT x.entity_id, x.doc_id, z.sent_no FROM x JOIN k USING (doc_id, entity_id) JOIN z ON z.doc_id = x.doc_id AND z.a <= x.s AND x.s < z.b),
  l AS (SELECT DISTINCT least(from_id, to_id) AS lo, greatest(from_id, to_id) AS hi FROM relations WHERE from_id IS NOT NULL AND to_id IS NOT NULL),
  n AS (SELECT doc_id, sent_no, count(*) AS n_entities FROM c GROUP BY 1, 2),
  r AS (SELECT u.doc_id, u.sent_no, count(*) AS n FROM relations JOIN c u ON u.entity_id = from_id JOIN c v ON v.entity_id = to_id AND v.doc_id = u.doc_id AND v.sent_no = u.sent_no GROUP BY 1, 2),
  m AS (SELECT u.doc_id, u.sent_no, count(*) AS n FROM c u JOIN c v ON v.doc_id = u.doc_id AND v.sent_no = u.sent_no AND u.entity_id < v.entity_id LEFT JOIN l ON lo = u.entity_id AND hi = v.entity_id WHERE lo IS NULL GROUP BY 1, 2)
SELECT doc_id, CAST(sent_no AS INT) AS sent_no, CAST(n_entities AS INT) AS n_entities, coalesce(r.n, 0) AS n_relations, coalesce(m.n, 0) AS n_missing FROM n LEFT JOIN r USING (doc_id, sent_no) LEFT JOIN m USING (doc_id, sent_no)"""
_KEPT_SPANS = """o AS (SELECT doc_id, entity_id, start_offset AS s, end_offset AS e, row_number() OVER (PARTITION BY doc_id ORDER BY start_offset, end_offset, entity_id) AS no FROM entities),
  w(doc_id, no, ids, ls, le) AS (SELECT doc_id, no, [entity_id], s, e FROM o WHERE no = 1
    UNION ALL SELECT o.doc_id, o.no, CASE WHEN o.s >= le THEN list_append(ids, o.entity_id) WHEN le - ls < o.e - o.s THEN list_append(ids[1:len(ids) - 1], o.entity_id) ELSE ids END,
      CASE WHEN o.s >= le OR le - ls < o.e - o.s THEN o.s ELSE ls END, CASE WHEN o.s >= le OR le - ls < o.e - o.s THEN o.e ELSE le END FROM w JOIN o ON o.doc_id = w.doc_id AND o.no = w.no + 1),
  y AS (SELECT * FROM entities WHERE entity_id IN (SELECT unnest(ids) FROM (SELECT doc_id, arg_max(ids, no) AS ids FROM w GROUP BY 1)))"""
SQL["ner_f04_segments"] = f"""WITH RECURSIVE {_POSITIONS}, {_KEPT_SPANS},
  h AS (SELECT tok.doc_id, tok.no, arg_min({{'s': start_offset, 'l': label}}, (start_offset, entity_id)) AS f, min(tok.e - n) AS first FROM tok JOIN y x ON x.doc_id = tok.doc_id AND tok.e - n >= start_offset AND tok.e <= end_offset GROUP BY 1, 2),
  g AS (SELECT doc_id, no, token, CASE WHEN f IS NULL THEN 'O' WHEN h.first = f.s THEN 'B-' || coalesce(f.l, '') ELSE 'I-' || coalesce(f.l, '') END AS tag FROM tok LEFT JOIN h USING (doc_id, no)),
  b AS (SELECT *, substr(tag, 3) AS kind, CASE WHEN tag LIKE 'I-%' AND substr(tag, 3) = lag(substr(tag, 3)) OVER (PARTITION BY doc_id ORDER BY no) THEN 0 ELSE 1 END AS brk FROM g),
  r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM b),
  q AS (SELECT *, CASE WHEN first_value(tag) OVER (PARTITION BY doc_id, run ORDER BY no) LIKE 'B-%' THEN kind END AS k FROM r),
  v AS (SELECT *, CASE WHEN tag LIKE 'B-%' OR k IS NULL AND lag(k) OVER (PARTITION BY doc_id ORDER BY no) IS NOT NULL OR row_number() OVER (PARTITION BY doc_id ORDER BY no) = 1 THEN 1 ELSE 0 END AS opens FROM q),
  u AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY no) AS island FROM v),
  z AS (SELECT doc_id, island, string_agg(token, ' ' ORDER BY no) AS text, max(k) AS tag FROM u GROUP BY 1, 2)
SELECT tag, count(*) AS n, CAST(sum(length({apply_sql('text', TIDY + TERMS + AT_MOST)})) AS BIGINT) AS n_chars FROM z GROUP BY 1"""
