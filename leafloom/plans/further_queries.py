"""Further queries, one for each remaining operator that has a result of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.common import cut, numbered, spread, table
from leafloom.functions import scores as N
from leafloom.functions import text as T
from leafloom.functions.rules import S
from leafloom.operators import annotation, bayes, combinations, extraction, pairs
from leafloom.operators import graphs as G
from leafloom.operators import relational as R
from leafloom.operators import similarity as E
from leafloom.plans.graph_queries import _E, _L, _N, _chains, _edge_names, _graph
from leafloom.plans.model_queries import _CLASS, _CPT, _LABELS, _MIX, _NET, _TABLE, _WEIGHTS, _folder, _ids, _labels, _network
from leafloom.plans.relational_queries import _RATES_SQL, RATES, _rates
from leafloom.sources import readers, writers

_FILLED = "source <> '' AND target <> ''"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edge_list").filter(_FILLED)


# ---- functions


def fn_x05_lemmatize_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "side_effects").select("id", T.lemmatize_words(F.col("effect"), {"боль": "болеть", "зуд": "зудеть"}).alias("text"))


def fn_x24_translate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "side_effects").select("id", T.translate_term(F.col("freq"), {k: f"class {i}" for i, k in enumerate(RATES)}).alias("freq"))


def fn_x28_report_count(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return per.select("user_id", T.report_count(F.concat(F.lit("<p>There are <strong>"), F.col("n").cast("string"), F.lit(" 007\u200b</strong> reports"))).alias("reports"))


def fn_x29_weight(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", N.effect_weight(F.col("p_size"), F.lit(0.5), F.col("p_retailprice"), F.col("p_name")).alias("w"))


def fn_x30_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_discount").alias("s")).select("l_orderkey", N.compatibility_class(F.round("s", 2)).alias("class"))


def fn_x31_logit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.sigmoid(N.logit(F.col("l_discount"))), 4).alias("p"))


def fn_x32_configurations(spark: SparkSession, d: str) -> DataFrame:
    """All states of up to four parents as keys, and back as bits."""
    rows = spark.createDataFrame([(k, c) for k in range(5) for c in N.configurations(k)], "k int, config string")
    return rows.select("k", "config", F.size(N.bits(F.col("config"))).alias("n_bits"), N.config_key(N.bits(F.col("config"))).alias("key"))


# ---- projections, joins, windows, sets


def proj_p07_complete(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.inline(F.array(extraction.chapter_stats(extraction.chapters(F.col("text"))))))
    # a generated row: a filter on its columns does not run the extraction again
    return R.complete_entries(R.partly_missing(docs, below=14)).groupBy("kept").agg(F.count("*").alias("n"))


def proj_p12_sentence_shape(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text"))
    return docs.select("doc_id", F.size(F.filter(F.split("text", "\n"), T.sentence_shaped)).alias("n"))


def proj_p14_null_group(spark: SparkSession, d: str) -> DataFrame:
    return pairs.ungrouped(_labels(spark, d))


def join_j05_fill_self(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of the edges through a map of long names to their last word."""
    e = _edges(spark, d).select("source", "target")
    names = R.endpoint_bag(e).distinct().filter("term LIKE 'активация %'").select(F.col("term").alias("old"), F.substring_index("term", " ", -1).alias("new"))
    return R.relabel(R.relabel(e, "source", names), "target", names).select("source", "target")


def join_j07_edge_labels(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return R.edge_labels(edges, nodes)


def join_j18_semi_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return R.semi_edges(edges, nodes, nodes.filter("tag = 'mechanism'")).groupBy("dst").agg(F.count("*").alias("n")).join(nodes.select(F.col("node_id").alias("dst"), "name"), "dst").select("name", "n")


def win_w06_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one label among a document's entities."""
    from pyspark.sql import Window

    e = table(spark, d, "entities").select("doc_id", "entity_id", F.coalesce("label", F.lit("-")).alias("label"))
    before = F.lag("label").over(Window.partitionBy("doc_id").orderBy("entity_id"))
    marked = e.withColumn("before", before)
    runs = R.islands(marked, ["doc_id"], "entity_id", F.col("before").isNull() | (F.col("before") != F.col("label")))
    return runs.groupBy("doc_id", "island", "label").agg(F.count("*").alias("n"))


def top_t02_first_effect(spark: SparkSession, d: str) -> DataFrame:
    """The first effect of the own class of every pair of neighbouring groups."""
    w = _ids(spark, d)
    ids = w.select("drug_id").distinct()
    chosen = ids.select(F.col("drug_id").alias("combo"), "drug_id").unionByName(ids.select((F.col("drug_id") - 1).alias("combo"), "drug_id").filter("combo > 0"))
    return combinations.first_effect(combinations.rank_sums(w, chosen)).select("combo", "class", "se_id", "rank")


def top_t05_sorted_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of vectors, the most similar first."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    pairs = E.similar_pairs(v, None, -1.1).select("a", "b", F.round("sim", 4).alias("sim"))
    return numbered(pairs, [F.desc("sim"), "a", "b"]).select("rank", "a", "b", "sim")


def top_t06_longest_first(spark: SparkSession, d: str) -> DataFrame:
    """All accepted names, the longest first."""
    s = table(spark, d, "synonyms").withColumn("size", F.length("variant"))
    return numbered(s, [F.desc("size"), "variant", "canonical"]).select(F.col("rank").cast("int").alias("rank"), "variant")


def set_u02_pair_difference(spark: SparkSession, d: str) -> DataFrame:
    """Reported pairs of drug and effect that the drug's records do not hold."""
    a = table(spark, d, "drug_side_effects").join(table(spark, d, "side_effects").select(F.col("id").alias("side_effect_id"), "section"), "side_effect_id").filter("section IS NOT NULL AND drug_id IS NOT NULL").select("drug_id", "section").distinct()
    b = table(spark, d, "drugs").select(F.col("id").alias("drug_id"), "drug").join(table(spark, d, "side_effects").filter("section IS NOT NULL").select("drug", "section"), "drug").select("drug_id", "section").distinct()
    return a.join(b, ["drug_id", "section"], "left_anti")


def set_u06_bag_union(spark: SparkSession, d: str) -> DataFrame:
    """Two copies of the graph with ids of their own: all nodes stay, links go to the first node of a name and tag."""
    nodes, edges = (cut(x) for x in _graph(spark, d))
    two = nodes.withColumn("graph_no", F.lit(1)).unionByName(nodes.withColumn("graph_no", F.lit(2)).withColumn("node_id", F.concat(F.lit("b"), "node_id")))
    links = edges.unionByName(edges.select(F.concat(F.lit("b"), "src").alias("src"), F.concat(F.lit("b"), "dst").alias("dst")))
    kept, merged = G.merge_keep_nodes(two, links)
    linked = kept.select("node_id", "name", "tag", "graph_no").join(merged.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n_links")), "node_id", "left")
    return linked.select("name", "tag", "graph_no", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def agg_a17_mean_place(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one segment and nation merged into one node at their mean place."""
    c = table(spark, d, "customer")
    nodes = c.select(F.col("c_custkey").cast("string").alias("node_id"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("tag"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    merged, _ = G.merge_by_label(nodes, nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst")))
    return merged.select("name", "tag", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def agg_a13_weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    """Squared errors of rates against 0.1 per drug, weighted by the root of its number of records."""
    se = cut(table(spark, d, "side_effects").filter("drug IS NOT NULL").select(F.xxhash64("drug").alias("scenario"), F.lower("freq").alias("freq")).join(_rates(spark), "freq"))
    guess = se.select("scenario").distinct().select("scenario", F.lit("rate").alias("node"), F.lit(0.1).alias("p"))
    targets = se.select("scenario", F.lit("rate").alias("effect"), F.col("rate").alias("target"))
    return bayes.scenario_loss(guess, targets, True, se.groupBy("scenario").agg(F.count("*").alias("n_drugs"))).select(F.round("loss", 6).alias("loss"))


# ---- graphs


def graph_g11_seeded(spark: SparkSession, d: str) -> DataFrame:
    """Subgraph below the nodes whose names are similar to two seeds."""
    nodes, edges = (cut(x) for x in G.build_graph(_edges(spark, d)))
    seeds = spark.createDataFrame([("класс савинасестатов",), ("группа зобифододон",)], "term string")
    return _edge_names(nodes, E.seeded_subgraph(seeds, nodes, edges, 0.6))


def graph_g12_build(spark: SparkSession, d: str) -> DataFrame:
    """The links of the parent-child table by the names and tags of their unified ends."""
    nodes, edges = G.build_graph(table(spark, d, "edge_list"))
    end = lambda c, n: nodes.select(F.col("node_id").alias(c), F.concat_ws("|", "name", "tag").alias(n))
    return edges.join(end("src", "source"), "src").join(end("dst", "target"), "dst").select("source", "target")


def graph_g14_depth(spark: SparkSession, d: str) -> DataFrame:
    """Number of levels of the knowledge graph."""
    nodes, edges = (cut(x) for x in _graph(spark, d))
    return G.levels(nodes, edges)[0].agg((F.max("level") + 1).alias("max_level"))


def graph_g19_isolates(spark: SparkSession, d: str) -> DataFrame:
    """Nodes left of the graph and of a copy of each node without links."""
    nodes, edges = _graph(spark, d)
    lonely = nodes.unionByName(nodes.withColumn("node_id", F.concat(F.lit("x"), "node_id")).withColumn("name", F.lit("lonely")))
    return G.drop_isolates(lonely, edges).select("name", "tag")


def graph_g27_simplified(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = E.simplify_graph(_edges(spark, d), 0.99)
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))


def graph_g28_shifted(spark: SparkSession, d: str) -> DataFrame:
    """Reference terms placed beside the drugs."""
    base = table(spark, d, "drugs").select(F.col("id").cast("string").alias("node_id"), F.col("drug").alias("name"), F.lit("prepare").alias("tag"), (F.col("id") % 10).cast("double").alias("x"), F.lit(0.0).alias("y"))
    new = table(spark, d, "effect_terms").select(F.col("term").alias("name"), F.lit("side_e").alias("tag"))
    out = G.shift_new_nodes(base, new).filter("tag = 'side_e'")
    return out.select("name", "x", "y")


def graph_g29_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of the links with the names of both ends, from the exported records alone."""
    nodes, edges = G.export_records(*_graph(spark, d))
    return edges.join(nodes.select(F.col("node_id").alias("src"), F.col("name").alias("source")), "src").join(nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("target")), "dst").select("source", "target", "relation_type")


def graph_g30_single(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline of one graph on the parent-child table."""
    nodes, edges = _chains(spark, d)
    nodes, edges = G.single_graph_pipeline(nodes, edges, table(spark, d, "synonyms"))
    return nodes.groupBy("tag").agg(F.count("*").alias("n"))


def graph_g31_multi(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline of several graphs on the knowledge graph."""
    nodes, edges = (cut(x) for x in _graph(spark, d))
    out, _ = G.multi_graph_pipeline(nodes.withColumn("graph_no", F.lit(1)), edges.withColumn("graph_no", F.lit(1)), table(spark, d, "effect_terms"))
    return out.groupBy("tag").agg(F.count("*").alias("n"))


def graph_g32_unsorted(spark: SparkSession, d: str) -> DataFrame:
    """Nodes a topological sort leaves out: on or below a cycle."""
    from leafloom.operators.hierarchy import filled_links, hierarchy

    return hierarchy(filled_links(table(spark, d, "edge_list"))).filter("depth = -1").select("node")


# ---- similarity, networks, combinations


def sim_e09_series(spark: SparkSession, d: str) -> DataFrame:
    return E.normalise_series(table(spark, d, "side_effects").filter("effect IS NOT NULL").select(F.lower("effect").alias("term")), 0.97)


def bayes_b05_groups(spark: SparkSession, d: str) -> DataFrame:
    """Links left without the groups, by name."""
    return _edge_names(*bayes.without_groups(*_graph(spark, d)))


def bayes_b06_initial(spark: SparkSession, d: str) -> DataFrame:
    nodes, parents, _ = _network(spark, d)
    out = bayes.initial_cpt(nodes, parents)
    return out.select("node", "config", F.col("p").between(0, 0.9).alias("within"))


def bayes_b07_doses(spark: SparkSession, d: str) -> DataFrame:
    nodes, parents, cpt = _network(spark, d)
    doses = nodes.filter("tag = 'prepare'").select(F.col("node_id").alias("node"), F.lit(0.25).alias("dose"))
    return bayes.marginals(nodes, parents, cut(bayes.set_doses(cpt, doses))).select("node", F.round("p", 5).alias("p"))


def bayes_b08_single_loss(spark: SparkSession, d: str) -> DataFrame:
    """Loss of each group's own scenario against a target of 0.5 for every section."""
    nodes, parents, cpt = _network(spark, d)
    ev = nodes.filter("tag = 'prepare'").select(F.xxhash64("node_id").alias("scenario"), F.col("node_id").alias("node"), F.lit(1.0).alias("value"))
    p = bayes.marginals(nodes, parents, cpt, cut(ev))
    targets = ev.select("scenario").crossJoin(F.broadcast(nodes.filter("tag = 'side_e'").select(F.col("node_id").alias("effect"), F.lit(0.5).alias("target"))))
    return bayes.scenario_loss(p, targets).select(F.round("loss", 4).alias("loss"), "n_scenarios")


def bayes_b10_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Sets of up to three of the frequency classes."""
    classes = table(spark, d, "frequency_ranges").select(F.col("category").alias("drug"))
    return bayes.drug_scenarios(classes, 3).select("scenario", "n_drugs").distinct().groupBy("n_drugs").agg(F.count("*").alias("n"))


def bayes_b11_pinned(spark: SparkSession, d: str) -> DataFrame:
    nodes, parents, cpt = _network(spark, d)
    targets = parents.select(F.col("parent").alias("drug"), F.col("node").alias("effect"), F.lit(0.5).alias("prob")).filter("length(drug) % 2 = 0")
    out = bayes.pinned_entries(cpt, parents, nodes.filter("tag = 'prepare'").select(F.col("node_id").alias("drug")), targets)
    return out.select("node", "config", "pinned")


def bayes_b15_folds(spark: SparkSession, d: str) -> DataFrame:
    return bayes.folds(table(spark, d, "drugs").select("id"), "id", 5).agg(F.count("*").alias("n"), F.max("fold").alias("last"))


def bayes_b17_conditional(spark: SparkSession, d: str) -> DataFrame:
    _, _, cpt = _network(spark, d)
    wanted = cpt.select("node").distinct().select("node", F.explode(F.array(F.lit(""), F.lit("1"))).alias("config"))
    return bayes.conditional(cpt, wanted).select("node", "config", F.round("p", 6).alias("p"))


def bayes_b19_description(spark: SparkSession, d: str) -> DataFrame:
    nodes, parents, cpt = _network(spark, d)
    states = nodes.filter("tag = 'prepare'").select(F.lit(1).cast("bigint").alias("scenario"), F.col("node_id").alias("drug"), (F.length("node_id") % 2).alias("state"))
    ev = states.select("scenario", F.col("drug").alias("node"), F.col("state").cast("double").alias("value"))
    out = bayes.combination_result(bayes.marginals(nodes, parents, cpt, cut(ev)), states)
    return out.select(F.md5("description").alias("description_md5"), "node", F.round("p", 5).alias("p"))


# ---- extraction, annotation, pairs, formats


def ext_l02_chapter(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text"))
    return docs.select("doc_id", extraction.side_effect_chapter(F.concat(F.lit("\nПобочное действие\n"), "text", F.lit("\nПередозировка"))).alias("c")).select("doc_id", F.length("c").alias("n_chars"))


def ext_l15_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Name by the first source that is there: English, group, Russian."""
    rows = table(spark, d, "drugs").select("id", "drug_en", "drug_group", "drug", F.upper("drug_en").alias("t1"), F.upper("drug_group").alias("t2"), F.upper("drug").alias("t3"))
    return rows.select("id", extraction.first_source(["drug_en", "drug_group", "drug"], ["t1", "t2", "t3"]).alias("name"))


def ext_s19_file_names(spark: SparkSession, d: str) -> DataFrame:
    """Parts of file names made of every drug's id and digests of its name and group."""
    rows = table(spark, d, "drugs").filter("drug IS NOT NULL").select("id", F.concat(F.col("id").cast("string"), F.lit(") "), F.md5("drug"), F.lit("+"), F.md5(F.concat(F.lit("b"), "drug")), F.lit("+["), F.coalesce(F.md5("drug_group"), F.lit("Вода")), F.lit("] _ Торг "), "id", F.lit(" _ 01.02.2024.pdf")).alias("f"))
    return rows.select("id", extraction.file_name_info(F.col("f")).alias("i")).select("id", "i.num_prepare", F.array_join("i.international_name", "|").alias("names"), F.array_join("i.international_name_dlc", "|").alias("dlc"), "i.trade_name", "i.date")


def ext_s21_stage(spark: SparkSession, d: str) -> DataFrame:
    stage = F.element_at(F.array(F.lit("1"), F.lit("2_scan"), F.lit("x")), (F.col("id") % 3 + 1).cast("int"))
    return table(spark, d, "drugs").select("id", extraction.by_stage(stage, F.col("drug"), F.col("drug_en")).alias("text"))


def ner_f05_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Digests of drug and effect joined as one text with the offsets of the effect."""
    items = F.array(F.struct(F.md5("drug").alias("text"), F.lit(None).cast("string").alias("tag")), F.struct(F.md5("effect").substr(F.lit(1), F.pmod(F.col("id"), F.lit(32)).cast("int") + 1).alias("text"), F.lit("side_e").alias("tag")))
    rows = table(spark, d, "side_effects").filter("effect IS NOT NULL AND drug IS NOT NULL").select("id", annotation.segments_to_text(items).alias("t"))
    return rows.select("id", "t.text", F.get("t.label", F.lit(0))["start"].alias("first"), F.get("t.label", F.lit(0))["end"].alias("last"))


def pair_r04_split(spark: SparkSession, d: str) -> DataFrame:
    """Every pair is in one part, training holds most."""
    out = pairs.split_80_10_10(pairs.positive_pairs(_labels(spark, d)))
    return out.agg(F.count("*").alias("n"), (F.sum(F.when(F.col("part") == "train", 1).otherwise(0)) > 0.7 * F.count("*")).alias("mostly_train"))


def src_s01_drug_table(spark: SparkSession, d: str) -> DataFrame:
    """Drugs written with padded headers and the word None, and read clean."""
    path = _folder(spark)
    t = table(spark, d, "drugs").select(F.col("id").cast("string").alias(" id "), F.coalesce(F.regexp_replace("drug_group", f"[{S}]+", " "), F.lit("None")).alias("group  "))
    writers.csv_rows(t, path)
    return readers.csv_table(spark, path)


def src_s05_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A headerless matrix of order sums as long weights."""
    wide = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity")).na.fill(0.0).orderBy("l_returnflag").select("F", "O")
    path = _folder(spark)
    wide.coalesce(1).write.csv(path)
    m = readers.matrix(spark, path, 2)
    return combinations.flat_vector("row_no", ["c0", "c1"], m).groupBy("se_id").agg(F.count("*").alias("n"), F.sum("w").alias("total"))


def src_s06_ids(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    writers.csv_rows(table(spark, d, "effect_terms").select(F.upper("term").alias("item"), F.col("term_id").alias("id")), path)
    return readers.id_table(spark, path)


def src_s08_annotated(spark: SparkSession, d: str) -> DataFrame:
    """Annotated documents written as JSON lines and read back: each text with the sums of its offsets and its relations."""
    e = table(spark, d, "entities").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("entity_id").alias("id"), "start_offset", "end_offset", "label")).alias("entities"))
    r = table(spark, d, "relations").groupBy("doc_id").agg(F.collect_list(F.struct("from_id", "to_id", F.col("rel_type").alias("type"))).alias("relations"))
    path = _folder(spark)
    writers.json_rows(table(spark, d, "documents").select("doc_id", "text").join(e, "doc_id").join(r, "doc_id", "left").drop("doc_id"), path)
    back = readers.json_lines(spark, path)
    total = lambda f: F.aggregate(F.transform("entities", lambda x: x[f].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return back.select(F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.size("entities").alias("n_entities"), total("start_offset").alias("starts"), total("end_offset").alias("ends"), F.coalesce(F.size("relations"), F.lit(0)).alias("n_relations"))


def src_s09_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    writers.lines(table(spark, d, "effect_terms").select(F.concat(F.lit("  "), "term", F.lit(" ")).alias("t")), "t", path)
    return readers.text_lines(spark, path)


def src_s18_files(spark: SparkSession, d: str) -> DataFrame:
    """One file a section of the reference terms: their folders, found without reading them."""
    path = _folder(spark)
    table(spark, d, "effect_terms").repartition(1).write.partitionBy("section").parquet(path)
    return readers.files(spark, path, ".parquet").select(F.url_decode(F.regexp_extract("path", "section=([^/]*)/", 1)).alias("section"), (F.col("length") > 0).alias("filled"))


def src_k08_drawio(spark: SparkSession, d: str) -> DataFrame:
    """Names of the boxes at both ends of every line of the drawing, read from its lines."""
    cells = writers.drawio_lines(*_graph(spark, d))
    get = lambda name: F.regexp_extract("value", f' {name}="([^"]*)"', 1)
    boxes = cut(cells.filter("value LIKE '%vertex=%'").select(F.regexp_extract("value", '^<mxCell id="([^"]*)"', 1).alias("node_id"), get("value").alias("name")))
    links = cells.filter("value LIKE '%edge=%'").select(get("source").alias("src"), get("target").alias("dst"))
    return links.join(boxes.select(F.col("node_id").alias("src"), F.col("name").alias("source")), "src").join(boxes.select(F.col("node_id").alias("dst"), F.col("name").alias("target")), "dst").select("source", "target")


def src_k09_gexf(spark: SparkSession, d: str) -> DataFrame:
    """Links of the knowledge graph as written and read again, by name."""
    nodes, edges = _graph(spark, d)
    path = _folder(spark)
    writers.gexf_lines(nodes, edges).coalesce(1).write.text(path)
    n, e = readers.gexf(spark, path)
    return e.join(n.select(F.col("node_id").alias("src"), F.col("name").alias("source")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("name").alias("target")), "dst").select("source", "target")


def src_k13_stubs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "side_effects").filter("effect IS NOT NULL").select("id", F.split("effect", ",").alias("s"))
    return writers.marking_stubs(t, "s").select("id", F.size("stubs").alias("n"))


def stream_s18c_redelivered(spark: SparkSession, d: str) -> DataFrame:
    """Relations streamed twice: the first of each redelivered row stays."""
    import uuid

    from leafloom.streaming import streams

    path = _folder(spark)
    rows = table(spark, d, "relations").withColumn("added_at", F.col("added_at").cast("timestamp"))
    rows.unionAll(rows).write.parquet(path)
    s = streams.new_files(spark, path, rows.schema)
    return streams.run_available(streams.without_repeats(s, "added_at", ["rel_id"], "10 days"), f"r{uuid.uuid4().hex}").select("rel_id")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("fn_", "proj_", "join_", "win_", "top_", "set_", "agg_", "graph_", "sim_", "bayes_", "comb_", "ext_", "ner_", "pair_", "src_", "stream_")) and callable(f)}

_CLASSES_CASE = "CASE lower(freq) " + " ".join(f"WHEN '{k}' THEN 'class {i}'" for i, k in enumerate(RATES)) + " ELSE freq END"
_FULL = f"{_NET}, {_TABLE}"
_P = _CPT
SQL = {
    "fn_x05_lemmatize_words": f"SELECT id, array_to_string(list_transform(list_filter(string_split_regex(coalesce(effect, ''), '[{S}]+'), lambda w: w <> ''), lambda w: CASE lower(w) WHEN 'боль' THEN 'болеть' WHEN 'зуд' THEN 'зудеть' ELSE w END), ' ') AS text FROM side_effects",
    "fn_x24_translate": f"SELECT id, {_CLASSES_CASE} AS freq FROM side_effects",
    "fn_x28_report_count": "SELECT user_id, 1000 * count(*) + 7 AS reports FROM events GROUP BY 1",
    "fn_x29_weight": "SELECT p_partkey, CASE WHEN contains(p_name, '?') OR p_size = 0 OR p_retailprice = 0 THEN 0.0 ELSE round(power(p_size * CAST(0.5 AS DOUBLE) / p_retailprice, 0.4), 2) END AS w FROM part",
    "fn_x30_class": f"SELECT l_orderkey, {_CLASS.format('s')} AS class FROM (SELECT l_orderkey, round(sum(l_discount), 2) AS s FROM lineitem GROUP BY 1)",
    "fn_x31_logit": "SELECT l_orderkey, l_linenumber, round(least(greatest(l_discount, 1e-6), 1 - 1e-6), 4) AS p FROM lineitem",
    "fn_x32_configurations": "SELECT CAST(k AS INT) AS k, c AS config, CAST(k AS INT) AS n_bits, c AS key FROM (SELECT k, array_to_string(list_transform(range(k), lambda j: CAST((n >> CAST(k - 1 - j AS INT)) & 1 AS VARCHAR)), ',') AS c FROM range(5) a(k), range(16) b(n) WHERE n < (1 << CAST(k AS INT)))",
    "proj_p12_sentence_shape": f"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[.;:]$') AND NOT regexp_matches(x, '^[{S}]*[^{S}]+\\.[{S}]*$'))) AS INT) AS n FROM documents WHERE text IS NOT NULL",
    "proj_p14_null_group": f"WITH {_LABELS} SELECT cluster, label FROM x WHERE group_id IS NULL",
    "join_j05_fill_self": f"SELECT CASE WHEN source LIKE 'активация %' THEN string_split(source, ' ')[-1] ELSE source END AS source, CASE WHEN target LIKE 'активация %' THEN string_split(target, ' ')[-1] ELSE target END AS target FROM edge_list WHERE {_FILLED}",
    "join_j07_edge_labels": f"WITH {_E} SELECT DISTINCT s || '(' || st || ')' AS src_label, t || '(' || tt || ')' AS dst_label FROM e",
    "join_j18_semi_edges": f"WITH {_E} SELECT t AS name, count(DISTINCT s || st) AS n FROM e WHERE tt = 'mechanism' GROUP BY 1",
    "win_w06_islands": "WITH l AS (SELECT doc_id, entity_id, coalesce(label, '-') AS label FROM entities), b AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY doc_id ORDER BY entity_id) THEN 0 ELSE 1 END AS k FROM l), i AS (SELECT *, CAST(sum(k) OVER (PARTITION BY doc_id ORDER BY entity_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM b) SELECT doc_id, island, label, count(*) AS n FROM i GROUP BY ALL",
    "top_t02_first_effect": f"WITH {_WEIGHTS}, c AS (SELECT DISTINCT drug_id AS combo, drug_id FROM i UNION SELECT drug_id - 1, drug_id FROM i WHERE drug_id > 1), s AS (SELECT combo, se_id, sum(w) AS m FROM c JOIN i USING (drug_id) GROUP BY 1, 2), k AS (SELECT combo, se_id, {_CLASS.format('m')} AS class, round(m, 2) AS rank, max({_CLASS.format('m')}) OVER (PARTITION BY combo) AS top FROM s) SELECT combo, class, se_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY rank DESC, se_id) AS r FROM k WHERE class = top) WHERE r = 1",
    "top_t05_sorted_pairs": "SELECT row_number() OVER (ORDER BY s DESC, a, b) AS rank, a, b, s AS sim FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 4) + 0.0 AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)",
    "top_t06_longest_first": "SELECT CAST(row_number() OVER (ORDER BY length(variant) DESC, variant, canonical) AS INT) AS rank, variant FROM synonyms",
    "set_u02_pair_difference": "SELECT DISTINCT drug_id, section FROM drug_side_effects r JOIN side_effects s ON s.id = r.side_effect_id WHERE section IS NOT NULL AND drug_id IS NOT NULL EXCEPT SELECT d.id, s.section FROM drugs d JOIN side_effects s ON s.drug = d.drug WHERE s.section IS NOT NULL",
    "set_u06_bag_union": f"WITH {_E}, {_N}, k AS (SELECT s AS name, st AS tag, count(*) AS n FROM e GROUP BY 1, 2) SELECT name, tag, g AS graph_no, CASE WHEN g = 1 THEN coalesce(n, 0) ELSE 0 END AS n_links FROM n LEFT JOIN k USING (name, tag), (VALUES (1), (2)) x(g)",
    "agg_a17_mean_place": "SELECT c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS tag, round(avg(c_acctbal), 4) AS x, round(avg(c_custkey), 4) AS y FROM customer GROUP BY 1, 2",
    "agg_a13_weighted_loss": f"WITH p AS (SELECT drug, sum((rate - 0.1) * (rate - 0.1)) AS se, count(*) AS n FROM side_effects s JOIN {_RATES_SQL} ON r.freq = lower(s.freq) WHERE drug IS NOT NULL GROUP BY 1) SELECT round(sum(se / sqrt(n)) / sum(1 / sqrt(n)), 6) AS loss FROM p",
    "graph_g12_build": "SELECT DISTINCT concat_ws('|', trim(source), trim(source_tag)) AS source, concat_ws('|', trim(target), trim(target_tag)) AS target FROM edge_list WHERE trim(source) <> '' AND trim(target) <> ''",
    "graph_g14_depth": f"WITH RECURSIVE {_E}, {_N}, v(name, tag, level) AS (SELECT name, tag, 0 FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.t = n.name AND e.tt = n.tag) UNION SELECT e.t, e.tt, v.level + 1 FROM v JOIN e ON e.s = v.name AND e.st = v.tag) SELECT CAST(max(level) + 1 AS INT) AS max_level FROM v",
    "graph_g19_isolates": f"WITH {_E}, {_N} SELECT name, tag FROM n",
    "graph_g28_shifted": "SELECT term AS name, CAST(9 + 100.0 * row_number() OVER (ORDER BY term) AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y FROM effect_terms",
    "graph_g29_records": f"WITH {_E} SELECT s AS source, t AS target, 'related' AS relation_type FROM e",
    "graph_g32_unsorted": f"WITH RECURSIVE {_L}, r(node) AS (SELECT s FROM l WHERE s NOT IN (SELECT t FROM l) UNION SELECT l.t FROM r JOIN l ON l.s = r.node) SELECT DISTINCT t AS node FROM l WHERE t NOT IN (SELECT node FROM r)",
    "bayes_b05_groups": f"WITH {_E} SELECT s AS source, t AS target FROM e WHERE st <> 'group' AND tt <> 'group'",
    "bayes_b06_initial": f"WITH {_FULL} SELECT node, config, true AS within FROM f",
    "bayes_b07_doses": f"WITH {_NET} SELECT g AS node, CAST(0.25 AS DOUBLE) AS p FROM q UNION ALL SELECT s, round(CAST({_MIX.format('CAST(0.25 AS DOUBLE)')} AS DOUBLE), 5) FROM e GROUP BY 1",
    "bayes_b08_single_loss": f"WITH {_NET}, v AS (SELECT x.g AS given, y.g, CASE WHEN x.g = y.g THEN 1.0 ELSE y.p END AS p FROM q x CROSS JOIN q y), m AS (SELECT given, s, {_MIX.format('least(p, 1 - 1e-6)')} AS p FROM e JOIN v USING (g) GROUP BY 1, 2) SELECT round(sum((p - 0.5) * (p - 0.5)), 4) AS loss, count(DISTINCT given) AS n_scenarios FROM m",
    "bayes_b10_scenarios": "SELECT 1 AS n_drugs, count(*) AS n FROM frequency_ranges UNION ALL SELECT 2, count(*) FROM frequency_ranges a JOIN frequency_ranges b ON a.category < b.category UNION ALL SELECT 3, count(*) FROM frequency_ranges a JOIN frequency_ranges b ON a.category < b.category JOIN frequency_ranges c ON b.category < c.category",
    "bayes_b11_pinned": f"WITH {_FULL}, o AS (SELECT s, g, row_number() OVER (PARTITION BY s ORDER BY g) AS i FROM e) SELECT f.node, f.config, coalesce(bool_or(length(o.g) % 2 = 0 AND string_split(f.config, ',')[o.i] = '1'), false) AS pinned FROM f LEFT JOIN o ON o.s = f.node GROUP BY 1, 2",
    "bayes_b15_folds": "SELECT count(*) AS n, 4 AS last FROM drugs",
    "bayes_b17_conditional": f"WITH {_FULL} SELECT w.node, w.config, coalesce((SELECT round({_P}, 6) FROM f WHERE f.node = w.node AND f.config = w.config), 0.0) AS p FROM (SELECT DISTINCT node, unnest(['', '1']) AS config FROM f) w",
    "ext_l15_cascade": "SELECT id, CASE WHEN coalesce(drug_en, '') <> '' THEN upper(drug_en) WHEN coalesce(drug_group, '') <> '' THEN upper(drug_group) WHEN coalesce(drug, '') <> '' THEN upper(drug) END AS name FROM drugs",
    "ext_s19_file_names": "SELECT id, CAST(id AS INT) AS num_prepare, md5(drug) || '|' || md5('b' || drug) AS names, coalesce(md5(drug_group), 'Вода') AS dlc, 'Торг ' || id AS trade_name, '01.02.2024' AS date FROM drugs WHERE drug IS NOT NULL",
    "ext_s21_stage": "SELECT id, CASE id % 3 WHEN 0 THEN drug WHEN 1 THEN drug_en END AS text FROM drugs",
    "ner_f05_offsets": "SELECT id, md5(drug) || ' ' || substr(md5(effect), 1, CAST(id % 32 + 1 AS INT)) AS text, 33 AS first, CAST(34 + id % 32 AS INT) AS last FROM side_effects WHERE effect IS NOT NULL AND drug IS NOT NULL",
    "pair_r04_split": f"WITH {_LABELS} SELECT count(*) AS n, true AS mostly_train FROM (SELECT DISTINCT a.label, b.label AS l2 FROM x a JOIN x b ON a.cluster = b.cluster AND a.group_id = b.group_id AND a.label < b.label)",
    "src_s01_drug_table": f"SELECT CAST(id AS VARCHAR) AS id, regexp_replace(drug_group, '[{S}]+', ' ', 'g') AS \"group\" FROM drugs",
    "src_s05_matrix": "SELECT CAST(se AS INT) AS se_id, count(*) AS n, sum(w) AS total FROM (SELECT l_returnflag, unnest([1, 2]) AS se, unnest([coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0), coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0)]) AS w FROM lineitem GROUP BY 1) GROUP BY 1",
    "src_s06_ids": "SELECT term AS item, term_id AS id FROM effect_terms",
    "src_s08_annotated": "SELECT md5(coalesce(text, '')) AS text_md5, CAST(n AS INT) AS n_entities, starts, ends, CAST(coalesce(m, 0) AS INT) AS n_relations FROM documents JOIN (SELECT doc_id, count(*) AS n, CAST(sum(start_offset) AS BIGINT) AS starts, CAST(sum(end_offset) AS BIGINT) AS ends FROM entities GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS m FROM relations GROUP BY 1) USING (doc_id)",
    "src_s09_lines": "SELECT term AS line FROM effect_terms",
    "src_s18_files": "SELECT DISTINCT section, true AS filled FROM effect_terms",
    "src_k08_drawio": f"WITH {_E} SELECT replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') AS source, replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') AS target FROM e",
    "src_k09_gexf": f"WITH {_E} SELECT s AS source, t AS target FROM e",
    "src_k13_stubs": "SELECT id, CAST(len(string_split(effect, ',')) AS INT) AS n FROM side_effects WHERE effect IS NOT NULL",
    "stream_s18c_redelivered": "SELECT rel_id FROM relations",
}
_VEC = "u AS (SELECT vec_id AS id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS i FROM embeddings)"
SQL |= {
    "bayes_b19_description": f"WITH {_NET} SELECT (SELECT md5(string_agg(g || '=' || CAST(length(g) % 2 AS VARCHAR), ' + ' ORDER BY g || '=' || CAST(length(g) % 2 AS VARCHAR))) FROM q) AS description_md5, g AS node, CAST(length(g) % 2 AS DOUBLE) AS p FROM q UNION ALL SELECT (SELECT md5(string_agg(g || '=' || CAST(length(g) % 2 AS VARCHAR), ' + ' ORDER BY g || '=' || CAST(length(g) % 2 AS VARCHAR))) FROM q), s, round(CAST({_MIX.format('CASE WHEN length(g) % 2 = 1 THEN 1 - 1e-6 ELSE 1e-6 END')} AS DOUBLE), 5) FROM e GROUP BY s",
    "sim_x34_cosine": f"WITH {_VEC}, m AS (SELECT label, i, avg(x) AS y FROM u GROUP BY 1, 2) SELECT id, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 4) AS cosine FROM u JOIN m USING (label, i) GROUP BY id",
    "sim_t08_negatives": "SELECT anchor, negative, round(sim, 4) AS sim FROM (SELECT a.vec_id AS anchor, b.vec_id AS negative, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.label <> b.label) WHERE r <= 2 AND sim >= 0.2",
    "pair_r05b_inverse": "SELECT min(label) AS canonical, CAST(count(DISTINCT label) - 1 AS INT) AS n FROM (SELECT canonical AS cluster, unnest([canonical, variant]) AS label FROM synonyms) GROUP BY cluster",
    "graph_g16b_simple_cycles": f"WITH RECURSIVE {_L}, r(start, node, path, k) AS (SELECT s, t, s, 1 FROM l UNION ALL SELECT start, l.t, path || ' > ' || node, k + 1 FROM r JOIN l ON l.s = r.node WHERE r.node > start AND NOT list_contains(string_split(path, ' > '), r.node)) SELECT path FROM r WHERE node = start",
    "graph_g23_layout": f"WITH RECURSIVE {_E}, {_N}, v(name, tag, level) AS (SELECT name, tag, 0 FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.t = n.name AND e.tt = n.tag) UNION SELECT e.t, e.tt, v.level + 1 FROM v JOIN e ON e.s = v.name AND e.st = v.tag), k AS (SELECT level, count(*) AS n FROM (SELECT name, tag, max(level) AS level FROM v GROUP BY 1, 2) GROUP BY 1) SELECT CAST(-level AS DOUBLE) AS y, n, CAST((1 - n) / 2.0 AS DOUBLE) AS left_x, CAST((n - 1) / 2.0 AS DOUBLE) AS right_x FROM k",
    "clus_a14_davies_bouldin": f"WITH {_VEC}, m AS (SELECT label, i, avg(x) AS y FROM u GROUP BY 1, 2), d AS (SELECT id, label, sqrt(sum((x - y) * (x - y))) AS d FROM u JOIN m USING (label, i) GROUP BY 1, 2), s AS (SELECT label, avg(d) AS s FROM d GROUP BY 1), c AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.y - b.y) * (a.y - b.y))) AS d FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2), w AS (SELECT a, max((x.s + y.s) / d) AS r FROM c JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY 1) SELECT round(avg(r), 4) AS davies_bouldin, count(*) AS n_clusters FROM w",
}
