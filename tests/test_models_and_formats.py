import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafloom.functions import scores as N
from leafloom.operators import bayes as B
from leafloom.operators import clustering as C
from leafloom.operators import combinations as K
from leafloom.operators import pairs as P
from leafloom.operators import relational as R
from leafloom.operators import similarity as E
from leafloom.sources import readers, writers
from leafloom.streaming import streams


def _network(spark):
    nodes = spark.createDataFrame([("a", "prepare"), ("b", "mechanism"), ("c", "side_e"), ("d", "side_e")], "node_id string, tag string")
    parents = spark.createDataFrame([("b", "a", 0), ("d", "b", 0), ("d", "c", 1)], "node string, parent string, pos int")
    cpt = spark.createDataFrame([("a", "", 0.3), ("c", "", 0.6), ("b", "0", 0.1), ("b", "1", 0.8), ("d", "0,0", 0.05), ("d", "0,1", 0.2), ("d", "1,0", 0.5), ("d", "1,1", 0.9)], "node string, config string, p double")
    return nodes, parents, cpt


def _enumerate(evidence):
    tables = {"a": {(): 0.3}, "c": {(): 0.6}, "b": {(0,): 0.1, (1,): 0.8}, "d": {(0, 0): 0.05, (0, 1): 0.2, (1, 0): 0.5, (1, 1): 0.9}}
    ps, total = {"a": (), "c": (), "b": ("a",), "d": ("b", "c")}, dict.fromkeys("abcd", 0.0)
    for bits in itertools.product((0, 1), repeat=4):
        s = dict(zip("abcd", bits))
        w = math.prod((1.0 if s[n] == evidence[n] else 0.0) if n in evidence else (tables[n][tuple(s[p] for p in ps[n])] if s[n] else 1 - tables[n][tuple(s[p] for p in ps[n])]) for n in s)
        for n in s:
            total[n] += w * s[n]
    return total


def test_marginals_equal_enumeration_on_a_polytree(spark):
    nodes, parents, cpt = _network(spark)
    ev = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.0)], "scenario bigint, node string, value double")
    got = {(r.scenario, r.node): r.p for r in B.marginals(nodes, parents, cpt, ev).collect()}
    for s, e in ((1, {"a": 1}), (2, {"b": 0})):
        for n, p in _enumerate(e).items():
            assert got[s, n] == pytest.approx(p, abs=2e-6)
    plain = {r.node: r.p for r in B.marginals(nodes, parents, cpt).collect()}
    assert plain == pytest.approx(_enumerate({}), abs=2e-6)
    net = B.Network(nodes, parents, cpt)
    vector = net.forward(np.array([[1.0 if n == "a" else -1.0 for n in net.nodes]]))[0]
    assert dict(zip(net.nodes, vector)) == pytest.approx(_enumerate({"a": 1}), abs=2e-6)


def test_gradient_and_fit(spark):
    nodes, parents, cpt = _network(spark)
    net = B.Network(nodes, parents, cpt)
    ev = np.array([[1.0 if n == "a" else -1.0 for n in net.nodes], [-1.0] * 4])
    target = np.array([[0.9 if n == "d" else np.nan for n in net.nodes], [0.2 if n == "d" else np.nan for n in net.nodes]])
    loss, grads = net.gradient(ev, target)
    for i, t in enumerate(net.tables):
        for k in range(len(t)):
            keep = t[k]
            t[k] = keep + 1e-6
            up = net.gradient(ev, target)[0]
            t[k] = keep - 1e-6
            down = net.gradient(ev, target)[0]
            t[k] = keep
            assert grads[i][k] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    assert net.fit(ev, target, epochs=80, rate=0.3)[-1] < loss / 2
    other = B.Network(nodes, parents, cpt)
    assert other.fit_projected(ev, target)[-1] < loss


def test_network_helpers(spark):
    nodes, parents, cpt = _network(spark)
    assert {(r.node, r.config) for r in B.initial_cpt(nodes, parents).collect()} == {(r.node, r.config) for r in cpt.collect()}
    assert {r.p for r in B.initial_cpt(nodes, parents).filter("node = 'a'").collect()} == {0.0}
    assert {r.config: round(r.p, 3) for r in B.normalise_cpt(cpt).filter("node = 'b'").collect()} == {"0": 0.111, "1": 0.889}
    assert {r.p for r in B.set_doses(cpt, spark.createDataFrame([("b", 0.4)], "node string, dose double")).filter("node = 'b'").collect()} == {0.4}
    wide = {r.node: r.p for r in B.marginals(nodes, parents, cpt, most_parents=1).collect()}
    assert wide["d"] == pytest.approx(wide["b"] * 0.6, abs=1e-6)
    sc = B.drug_scenarios(spark.createDataFrame([("x",), ("y",), ("z",)], "drug string"), 2)
    assert sc.select("scenario").distinct().count() == 6
    t = spark.createDataFrame([("x", "e", 0.2), ("y", "e", 0.5), ("z", "f", 0.1)], "drug string, effect string, prob double")
    pooled = B.pooled_targets(spark.createDataFrame([(1, "x"), (1, "y")], "scenario int, drug string"), t).first()
    assert pooled.target == pytest.approx(0.2)
    pinned = B.pinned_entries(cpt, parents, spark.createDataFrame([("a",)], "drug string"), spark.createDataFrame([("a", "b", 0.5)], "drug string, effect string, prob double"))
    assert {(r.node, r.config) for r in pinned.filter("pinned").collect()} == {("b", "1")}
    assert B.parameter_vector(cpt).count() == 8 and B.export_cpt(cpt).filter("node = 'b'").first().table == '{"0":0.1,"1":0.8}'
    cyclic = parents.unionByName(spark.createDataFrame([("a", "d", 0)], parents.schema))
    with pytest.raises(ValueError):
        B.marginals(nodes, cyclic, cpt)


def test_combinations(spark):
    w = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.2), (2, 1, 0.3), (2, 2, 0.1), (3, 1, 0.9), (3, 2, 0.0), (4, 1, 0.0), (4, 2, 0.1)], "drug_id bigint, se_id bigint, w double")
    chosen = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 0)], "combo int, drug_id bigint")
    sums = K.rank_sums(w, chosen)
    assert [tuple(r) for r in K.classify(sums).collect()] == [(1, 0.7, 2)]
    assert [(r["class"], r.position, r.se_id) for r in K.classified_effects(sums).orderBy("class").collect()] == [(1, 1, 2), (2, 1, 1)]
    assert [tuple(r) for r in K.first_effect(sums).collect()] == [(1, 2, 1, 0.7)]
    assert {(r.drug_id, r["class"]) for r in K.what_if(w, chosen).collect()} == {(3, 3), (4, 2)}
    ids = w.selectExpr("drug_id AS id").distinct()
    classes = {(r.id1, r.id2): r["class"] for r in K.pair_classes(w, ids).collect()}
    assert len(classes) == 6 and classes[1, 3] == 3 and classes[2, 4] == 1
    good = K.pair_classes(w, ids).filter("class < 3")
    bad = K.pair_classes(w, ids).filter("class = 3")
    assert {tuple(r) for r in K.compatible_triples(good, bad, ids).collect()} == {(1, 2, 4)}
    reached = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.1), ("b", "x", 0.3)], "drug string, effect string, p double")
    data = spark.createDataFrame([("a", "x", "Часто")], "drug string, effect string, freq string")
    rates = spark.createDataFrame([("часто", 0.1)], "freq string, rate double")
    assert [tuple(r) for r in K.convolution_error(reached, data, rates).collect()] == [("a", pytest.approx(0.16), 1, 1)]
    assert K.convolution_error(reached, data, rates, case_sensitive=True).first().loss == pytest.approx(0.25)
    m = K.weight_matrix(spark.createDataFrame([("a",), ("b",)], "drug string"), spark.createDataFrame([("x", 0.5)], "effect string, rank double"), spark.createDataFrame([("a", "x", 20)], "drug string, effect string, cases bigint"), spark.createDataFrame([("a", 100)], "drug string, total bigint"))
    assert {(r.drug, r.w) for r in m.collect()} == {("a", round(0.1**0.4, 2)), ("b", 0.0)}


def _vec(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id bigint, vec array<float>")


def test_similarity_clusters(spark):
    deg = lambda a: [math.cos(math.radians(a)), math.sin(math.radians(a))]
    v = _vec(spark, [(1, deg(0)), (2, deg(10)), (3, deg(20)), (4, deg(90))])
    pairs = E.similar_pairs(v, None, math.cos(math.radians(11)))
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (2, 3)}
    order = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "id bigint, ord int")
    assert {r.id: r.cluster for r in E.greedy_clusters(pairs, order).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.id: r.cluster for r in E.similarity_components(pairs, v).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {(r.query, r.term) for r in E.find_similar(v.filter("id = 1").selectExpr("id + 10 AS id", "vec"), v, 0.5, 2).collect()} == {(11, 1), (11, 2)}
    out = E.append_section(v.withColumn("section", F.when(F.col("id") < 3, "a").otherwise("b")))
    assert [x.vec[-2:] for x in out.orderBy("id").collect()] == [[4, 0], [4, 0], [0, 4], [0, 4]]
    texts = spark.createDataFrame([(1, "сильная боль в ноге днём"), (2, None), (3, "")], "id bigint, text string")
    known = spark.createDataFrame([("боль в ноге", "X"), ("боль", "Y"), ("ноге днём", "Z")], "phrase string, canonical string")
    assert E.replace_phrases(texts, known).filter("id = 1").first().text == "сильная X днём"
    edges = spark.createDataFrame([("боль (1)", "side_e", "тошнота", "side_e"), ("боль", "side_e", "тошнота", "action"), ("группа", "group", "лек", "prepare")], "source string, source_tag string, target string, target_tag string")
    assert {(r.source, r.target) for r in E.normalise_edges(edges).collect()} == {("боль", "тошнота"), ("группа", "лек")}
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    hits = E.find_similar_terms(terms("головная боль"), terms("головная боли", "кашель"), 0.6)
    assert [(r.query, r.term) for r in hits.collect()] == [("головная боль", "головная боли")]


def test_clusterings(spark):
    rng = np.random.default_rng(0)
    points = [(i, rng.normal((i % 3) * 10, 0.2, 4) + [1, (i % 3 == 1) * 20, 0, 0]) for i in range(60)]
    v = _vec(spark, points)
    for out in (C.k_means(v, 3), C.agglomerative(v, 3)):
        got = {r.id: r.cluster for r in out.collect()}
        assert len({got[i] for i in range(60)}) == 3 and all(got[i] == got[i % 3] for i in range(60))
    dirs = _vec(spark, [(i, np.eye(4)[i % 2] + rng.normal(0, 0.01, 4)) for i in range(20)] + [(99, [0, 0, 1, 0])])
    got = {r.id: r.cluster for r in C.dbscan(dirs, 0.95, 3).collect()}
    assert got[99] == -1 and {got[0], got[1]} == {0, 1} and got[2] == 0
    assert len({r.cluster for r in C.density_tree_clusters(dirs, 3).collect()}) >= 2
    assert {len(r.vec) for r in C.pca(v, 0.9).collect()} <= {1, 2} and {len(r.vec) for r in C.tsne(v, 2, 5, 50).collect()} == {2}
    clustered = C.k_means(v, 3)
    assert C.silhouette(clustered) > 0.8 and C.silhouette(clustered.withColumn("cluster", F.lit(1))) is None
    assert C.davies_bouldin(clustered).first().n_clusters == 3
    assert C.grid_search(v, {"none": None}, [2, 3], 1)[0][1] in (2, 3)
    with pytest.raises(ValueError):
        C.agglomerative(spark.range(C.ONE_TASK + 1).select("id", F.array(F.lit(1.0)).alias("vec")), 2)


def test_pairs_and_metrics(spark):
    x = spark.createDataFrame([("c", "a b", 1), ("c", "a c", 1), ("c", "d", 2), ("c", "e", None), ("k", "z", 1)], "cluster string, label string, group_id int")
    assert {tuple(r) for r in P.positive_pairs(x).collect()} == {("a b", "a c")}
    assert {tuple(r) for r in P.negative_pairs(x).collect()} == {("a b", "d"), ("a c", "d"), ("a b", "e"), ("a c", "e"), ("d", "e")}
    scored = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, s double")
    assert R.roc_auc(scored, "y", "s").first().auc == pytest.approx(0.875)
    assert R.roc_auc(scored.filter("y = 0"), "y", "s").first().auc is None
    assert R.best_f1_threshold(scored, "y", "s").first().threshold == 0.8
    assert R.best_f1_threshold(scored.filter("y > 5"), "y", "s").first().threshold == 0.5


def test_formats_round_trip(spark, tmp_path):
    (tmp_path / "drugs.csv").write_text(" name ;stage  ; \n Аб ;1;\nВг; None ;\n", encoding="utf-8")
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "drugs.csv")).collect()] == [("Аб", "1"), ("Вг", None)]
    (tmp_path / "lines.txt").write_text(" a \n\n b\n", encoding="utf-8")
    assert [r.line for r in readers.text_lines(spark, str(tmp_path / "lines.txt")).collect()] == ["a", "b"]
    (tmp_path / "raw.json").write_text('[{"drug_name_ru": "Аб", "drug_name_en": "Ab", "source": "s", "side_e_parts": {"Кожа": {"часто": ["зуд", "сыпь"]}, "Прочее": ["шум"]}}]', encoding="utf-8")
    assert {(r.section, r.freq, r.ord, r.effect) for r in readers.raw_side_effects(spark, str(tmp_path / "raw.json")).collect()} == {("Кожа", "часто", 0, "зуд"), ("Кожа", "часто", 1, "сыпь"), ("Прочее", None, 0, "шум")}
    (tmp_path / "dict.json").write_text('{"бета": ["β", "beta"]}', encoding="utf-8")
    assert {tuple(r) for r in readers.dictionary(spark, str(tmp_path / "dict.json")).collect()} == {("бета", "β"), ("бета", "beta")}
    nodes = spark.createDataFrame([("n1", "боль <a>", "side_e", 1.5, 2.0), ("n2", "лек", "prepare", 0.0, 0.0)], "node_id string, name string, tag string, x double, y double")
    edges = spark.createDataFrame([("n2", "n1")], "src string, dst string")
    for kind, lines, read in (("graphml", writers.graphml_lines, readers.graphml), ("gexf", writers.gexf_lines, readers.gexf)):
        writers.lines(lines(nodes, edges).coalesce(1), "value", str(tmp_path / kind))
        back, back_e = read(spark, str(tmp_path / kind))
        assert {r["name"] for r in back.collect()} == {"боль <a>", "лек"} and back_e.count() == 1
    assert writers.drawio_lines(nodes, edges).count() == 6
    writers.workbook_file(spark.createDataFrame([("a", 1.5), ("b<", 2.0)], "x string, y double"), str(tmp_path / "b.xlsx"))
    cells = readers.workbook_cells(spark, str(tmp_path / "b.xlsx"))
    assert {(r.row_no, r.col_no, r.value) for r in cells.collect()} == {(0, 0, "x"), (0, 1, "y"), (1, 0, "a"), (1, 1, "1.5"), (2, 0, "b<"), (2, 1, "2.0")}
    writers.database_file(nodes.select("node_id", "name"), "nodes", str(tmp_path / "g.db"))
    assert readers.database_table(spark, str(tmp_path / "g.db"), "SELECT name FROM nodes", "name string").count() == 2
    n, e = writers.star_rows(nodes, edges)
    assert n.count() == 2 and e.count() == 1
    files = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "name string, content string")
    assert [(r.number, r.name) for r in writers.number_files(files).orderBy("number").collect()] == [(1, "a"), (2, "c")]
    pdf = b"%PDF-1.4\n1 0 obj\nstream\nBT (\xcf\xee\xe1\xee\xf7-) Tj T* (\xed\xee\xe5) Tj ET\nendstream\n"
    (tmp_path / "d.pdf").write_bytes(pdf)
    assert readers.pdf_texts(spark, str(tmp_path / "d.pdf")).first().text == "Побочное"
    sheet = spark.createDataFrame([("p", "s", r, c, v) for r, c, v in [(0, 1, " Drug A "), (2, 1, "50"), (17, 0, "Pain"), (17, 1, "5"), (18, 0, "Rash"), (0, 2, "Drug B"), (18, 2, "7")]], "path string, sheet string, row_no int, col_no int, value string")
    reports, totals = readers.report_matrix(sheet)
    assert {tuple(r) for r in reports.collect()} == {("drug a", "pain", 5), ("drug b", "rash", 7)} and {tuple(r) for r in totals.collect()} == {("drug a", 50), ("drug b", 0)}


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, CAST(id * 20 AS INT), 0) AS ts, id % 2 AS k FROM range(12)")
    rows.unionAll(rows).write.parquet(str(tmp_path / "in"))
    s = streams.new_files(spark, str(tmp_path / "in"), rows.schema)
    assert streams.run_available(streams.without_repeats(s, "ts", ["id"], "1 day"), "once").count() == 12
    got = streams.run_available(streams.counts_per_window(s, "ts", "k", "1 hour", "1 hour"), "hours", "complete")
    assert got.agg(F.sum("n")).first()[0] == 24
    seen = []
    streams.run_available(s, "x", each=lambda df, _: seen.append(df.count()))
    assert sum(seen) == 24


def test_surrogate_keys_are_dense(spark):
    df = spark.createDataFrame([(f"v{i % 500:03d}",) for i in range(2000)] + [(None,)], "v string")
    got = R.surrogate_keys(df, "v", "id").orderBy("id").collect()
    assert [(r.v, r.id) for r in got] == [(f"v{i:03d}", i + 1) for i in range(500)]


def test_curriculum(spark):
    assert [r.s for r in spark.range(3).select(N.curriculum_size(F.col("id") / 2, F.lit(3)).alias("s")).collect()] == [1, 2, 3]


def test_whole_network_keeps_every_link(spark, tmp_path):
    """Sections of 2, 5 and 7 groups: by enumeration up to five parents, the product beyond."""
    from leafloom.plans.model_queries import bayes_b01_whole

    groups = ["g" * i for i in range(1, 8)]
    of = {"two": groups[:2], "five": groups[:5], "seven": groups}
    spark.createDataFrame([(f"d{g}", g) for g in groups], "drug string, drug_group string").write.parquet(f"{tmp_path}/drugs.parquet")
    spark.createDataFrame([(f"d{g}", s) for s, gs in of.items() for g in gs], "drug string, section string").write.parquet(f"{tmp_path}/side_effects.parquet")
    p = {g: 0.1 + len(g) % 7 * 0.1 for g in groups}
    want = dict(p)
    for s, scale in (("two", 0.3), ("five", 0.9 / 5)):
        want[s] = sum(math.prod(p[g] if x else 1 - p[g] for g, x in zip(of[s], b)) * (0.05 + scale * sum(b)) for b in itertools.product((0, 1), repeat=len(of[s])))
    want["seven"] = math.prod(p.values())
    assert {r.node: r.p for r in bayes_b01_whole(spark, str(tmp_path)).collect()} == pytest.approx(want, abs=2e-5)


def test_pair_loss_is_over_all_drugs(spark, small):
    """Against the scenarios made one by one, over more drugs than the twelve of bayes_b09_pooled_loss."""
    from leafloom.plans.model_queries import _targets, bayes_b09_whole_loss

    rows = [(f"d{i:02}", f"e{j}", (0.0, 0.01, 0.3, 0.3, 0.9)[(i * j + i) % 5]) for i in range(20) for j in range(4) if (i + j) % 3 or not j]
    made = spark.createDataFrame(rows, "drug string, effect string, prob double")
    for targets, got in ((made, B.pair_loss(made, 0.1)), (_targets(spark, small), bayes_b09_whole_loss(spark, small))):
        pooled = B.pooled_targets(B.drug_scenarios(targets.select("drug").distinct(), 2), targets)
        want = pooled.agg(F.count_distinct("scenario").alias("n"), F.sum(F.pow(F.col("target") - 0.1, 2)).alias("loss")).first()
        row = got.first()
        assert row.n_scenarios == want.n > 78 and row.loss == pytest.approx(want.loss, abs=1e-4)


def _tiny(spark):
    nodes = spark.createDataFrame([("a", "prepare"), ("b", "prepare"), ("e", "side_e"), ("f", "side_e")], "node_id string, tag string")
    parents = spark.createDataFrame([("e", "a", 0), ("e", "b", 1), ("f", "e", 0)], "node string, parent string, pos int")
    cpt = spark.createDataFrame([("a", "", 0.3), ("b", "", 0.6)] + [("e", f"{i},{j}", 0.1 + 0.2 * i + 0.3 * j) for i in (0, 1) for j in (0, 1)] + [("f", "0", 0.2), ("f", "1", 0.7)], "node string, config string, p double")
    return B.Network(nodes, parents, cpt)


def test_fits_of_a_network(spark):
    """Gradients agree with differences, every fit lowers the loss, bounds and fixed entries hold."""
    n = _tiny(spark)
    evidence = np.array([[1, -1, -1, -1], [-1, 1, -1, -1], [0, 0, -1, -1], [-1, -1, -1, -1]], float)
    targets = np.array([[np.nan, np.nan, 0.5, 0.4], [np.nan, np.nan, 0.7, np.nan], [np.nan, np.nan, 0.05, 0.1], [np.nan, np.nan, 0.4, 0.3]])
    for dropped in (set(), {(2, 0)}):
        n.dropped = dropped
        for a, b in zip(n.gradient(evidence, targets)[1], n.numeric_gradient(evidence, targets)):
            assert np.allclose(a, b, atol=1e-6)
    n.dropped = set()
    start, first = [t.copy() for t in n.tables], n.loss(evidence, targets)

    def fresh():
        n.tables = [t.copy() for t in start]
        return n

    losses = fresh().fit_quasi_newton(evidence, targets)
    assert all(x >= y for x, y in zip(losses, losses[1:])) and losses[-1] < 0.05 * first and all((t >= 1e-5).all() and (t <= 0.9999999).all() for t in n.tables)
    assert losses[-1] <= fresh().fit_projected(evidence, targets)[-1] + 1e-9
    assert fresh().fit_numeric(evidence, targets, 10)[-1] < first
    for schedule in ("cosine", "exponential", "plateau"):
        for rectified in (False, True):
            assert fresh().fit(evidence, targets, 80, schedule=schedule, rectified=rectified)[-1] < first
    near = fresh().fit(evidence, targets, 80, prior=100.0) and [np.abs(t - s).max() for t, s in zip(n.tables, start)]
    assert max(near) < 0.05
    fixed = [np.ones(len(t), bool) for t in start]
    fresh().fit(evidence, targets, 20, fixed=fixed, decay=0.1)
    assert all(np.allclose(t, s) for t, s in zip(n.tables, start))
    folds = B.cross_validate(fresh(), evidence, targets, np.array([0, 1, 0, 1]), epochs=30, drop_entries=0.2, drop_parents=0.2)
    assert [f for f, _, _ in folds] == [0, 1] and all(np.allclose(t, s) for t, s in zip(n.tables, start))


def test_networks_too_large_for_the_driver_are_refused(spark, monkeypatch):
    monkeypatch.setattr(B, "MOST_PARAMETERS", 5)
    with pytest.raises(ValueError, match="do not fit"):
        _tiny(spark)


def test_results_of_streams_stay_in_files(spark, tmp_path):
    """A result in memory would hold every row in the driver; batches are appended, a complete result is the last one."""
    rows = spark.sql("SELECT id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, CAST(id * 20 AS INT), 0) AS ts, id % 2 AS k FROM range(12)")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    s = streams.new_files(spark, str(tmp_path / "in"), rows.schema, per_trigger=1)
    once = streams.run_available(streams.without_repeats(s, "ts", ["id"], "1 day"), "batches")
    assert once.inputFiles() and sorted(r.id for r in once.collect()) == list(range(12))
    hours = streams.run_available(streams.counts_per_window(s, "ts", "k", "1 hour", "1 day"), "hours_of_batches", "complete")
    assert hours.inputFiles() and hours.agg(F.sum("n"), F.count("*")).first()[:] == (12, 8)
    (tmp_path / "none").mkdir()
    assert streams.run_available(streams.new_files(spark, str(tmp_path / "none"), rows.schema), "none").collect() == []
