import numpy as np
import pytest
from pyspark.sql import functions as F

from leafloom.llm import entry_matching as M
from leafloom.llm import neighbours as N
from leafloom.llm import vector_clusters as C
from leafloom.llm import vectors as V


def _entries(spark):
    terms = ["зуд кожи", "боль колена", "кровоточивость слизистой оболочки носа", "отёк лёгкого"]
    forms = [("effect", t, t) for t in terms] + [("effect", "зуд кожи", "синдром Бабадаба"), ("frequency", "Часто", "Часто"), ("frequency", "Нечасто", "Нечасто"), ("frequency", "Нечасто", "н/ч")]
    return spark.createDataFrame(forms, "field string, entry string, form string")


def test_values_find_their_entry(spark):
    said = {
        "зуд кожи": None, "Зуд  КОЖИ.": "зуд кожи", "зуд кож (у детей)": "зуд кожи", "бль колнеа": "боль колена", "кровоточивсть слизистй обололчки носа": "кровоточивость слизистой оболочки носа",
        "Отек Легкого - отдельные случаи": "отёк лёгкого", "зyд кo​жи": "зуд кожи", "синдром Бабадаба": "зуд кожи", "тревога, потливость": M.UNMATCHED, "???": M.UNMATCHED, " \t": None, "": None, None: None, "x" * 5000: M.UNMATCHED,
    }
    rows = [("effect", i, v, 1) for i, v in enumerate(said)] + [("frequency", 100, "Н/Ч", 1), ("frequency", 101, "часо", 1), ("frequency", 102, "12", 1), ("frequency", 103, "зуд кожи", 1)]
    got = {(r.field, r.row_id): r.entry for r in M.map_to_entries(spark.createDataFrame(rows, "field string, row_id bigint, value string, entry int").select("field", "row_id", "value"), _entries(spark)).collect()}
    want = {("effect", i): e for i, e in enumerate(said.values()) if e}
    assert got == want | {("frequency", 100): "Нечасто", ("frequency", 101): "Часто", ("frequency", 102): M.UNMATCHED, ("frequency", 103): M.UNMATCHED}


def test_empty_inputs_and_repeats(spark):
    none = spark.createDataFrame([], "field string, row_id bigint, value string")
    assert M.map_to_entries(none, _entries(spark)).count() == 0
    rows = spark.createDataFrame([("effect", 1, "зуд кож"), ("effect", 1, "зуд кож")], none.schema)
    assert M.map_to_entries(rows, _entries(spark)).count() == 2
    assert {r.entry for r in M.map_to_entries(rows, _entries(spark).filter("FALSE")).collect()} == {M.UNMATCHED}


def test_pigeonhole_loses_no_pair(spark):
    """Against levenshtein over all pairs, with edits of every kind."""
    rng = np.random.default_rng(3)
    letters = list("абвгд ")
    words = ["".join(rng.choice(letters, 12)).strip() or "а" for _ in range(40)]
    values = set()
    for w in words:
        for _ in range(6):
            x = list(w)
            for _ in range(rng.integers(1, 4)):
                i = rng.integers(0, len(x))
                match rng.integers(0, 3):
                    case 0:
                        x[i] = rng.choice(letters)
                    case 1:
                        x.insert(i, rng.choice(letters))
                    case _:
                        x.pop(i) if len(x) > 3 else None
            values.add("".join(x))
    entries = spark.createDataFrame([("e", w, w) for w in sorted(set(words))], "field string, entry string, form string")
    vals = spark.createDataFrame([("e", v) for v in sorted(values)], "field string, value string")
    got = {r.value for r in M.match_values(vals, entries).collect()}
    folded = entries.selectExpr(f"{M.fold_sql('entry')} AS form").distinct()
    v2 = vals.selectExpr("value", f"{M.fold_sql('value')} AS v")
    brute = v2.crossJoin(folded).filter(f"v <> '' AND levenshtein(v, form) <= {M._edits_sql('length(form)')}").select("value").distinct()
    assert got >= {r.value for r in brute.collect()}


def _vectors(spark, m, ids=None, extra=()):
    ids = list(range(1, len(m) + 1)) if ids is None else ids
    rows = [(i, [float(x) for x in v], "s") for i, v in zip(ids, m)] + list(extra)
    return spark.createDataFrame(rows, "side_effect_id bigint, vec array<float>, id string")


def _world(seed=5, groups=60, size=9, lonely=300):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        c = rng.normal(size=64)
        c /= np.linalg.norm(c)
        rows += [c + rng.normal(size=64) * 0.02 for _ in range(rng.integers(2, size))]
    rows += list(rng.normal(size=(lonely, 64)))
    m = np.array(rows) * rng.uniform(0.3, 5, (len(rows), 1))
    return m[rng.permutation(len(m))]


UNUSABLE = [(9001, None, "s"), (9002, [0.0] * 64, "s"), (9003, [1.0] * 3, "s"), (9004, [float("nan")] * 64, "s"), (9005, [None] * 64, "s")]


def _brute(m, k=5, least=0.85):
    u = m.astype(np.float32)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    pairs = set()
    for i in range(len(m)):
        for j in sorted(range(len(m)), key=lambda x: (-s[i, x], x))[:k]:
            if s[i, j] >= least:
                pairs.add((min(i, j) + 1, max(i, j) + 1))
    near = s >= least
    np.fill_diagonal(near, True)
    found = set()
    for i in range(len(m)):
        n = np.nonzero(near[i])[0]
        if len(n) > 1 and n[0] == i and all((near[j] == near[i]).all() for j in n):
            found |= {(int(n[0]) + 1, int(j) + 1) for j in n[1:]}
    return pairs, found


def test_neighbours_and_clusters_against_brute_force(spark):
    m = _world()
    units = V.unit_vectors(_vectors(spark, m, extra=UNUSABLE), "side_effect_id")
    pairs, found = _brute(m)
    near = {(min(r.id, r.other), max(r.id, r.other)) for r in N.nearest_records(units).collect()}
    assert len(near & pairs) >= 0.97 * len(pairs) and not near - pairs
    got = {(r.first_id, r.id) for r in C.clusters(units, region=150).filter("id <> first_id").collect()}
    assert got == found and found


def test_chains_are_no_clusters(spark):
    t = np.radians([0, 25, 50])
    chain = np.zeros((3, 64))
    chain[:, 0], chain[:, 1] = np.cos(t), np.sin(t)
    pair = np.zeros((2, 64))
    pair[:, 5], pair[1, 6] = 1, 0.1
    units = V.unit_vectors(_vectors(spark, np.concatenate([chain, pair])), "side_effect_id")
    assert {(r.first_id, r.id) for r in C.clusters(units).collect()} == {(4, 4), (4, 5)}


def test_many_copies_of_one_vector(spark):
    """A third of the rows one vector: nothing pairs them all, ties go to the smaller id."""
    m = np.concatenate([np.tile(_world(1, 1, 3, 0)[:1], (200, 1)), _world(2, 5, 5, 50)])
    units = V.unit_vectors(_vectors(spark, m), "side_effect_id")
    near = {(r.id, r.other) for r in N.nearest_records(units).collect()}
    assert {o for i, o in near if i == 1} == {2, 3, 4, 5, 6} and {o for i, o in near if i == 100} == {1, 2, 3, 4, 5}
    got = [(r.first_id, r.id) for r in C.clusters(units).filter("first_id = 1").collect()]
    assert sorted(got) == [(1, i) for i in range(1, 201)]


def test_large_candidates_are_checked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 20)
    rng = np.random.default_rng(8)
    c = rng.normal(size=64)
    m = np.concatenate([c + rng.normal(size=(70, 64)) * 0.02, rng.normal(size=(30, 64))])
    rows = [(1, i + 1, [float(x) for x in v / np.linalg.norm(v)], 1) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "component bigint, id bigint, vec array<float>, copies bigint")
    assert {(r.first_id, r.id) for r in C.exact_clusters(df).collect()} == {(1, i) for i in range(1, 71)}


@pytest.mark.parametrize("rows", [[], UNUSABLE, [(7, [1.0] + [0.0] * 63, "s")]])
def test_nothing_to_compare(spark, rows):
    units = V.unit_vectors(spark.createDataFrame(rows, "side_effect_id bigint, vec array<float>, id string"), "side_effect_id")
    assert N.nearest_records(units).count() == 0
    assert C.clusters(units).count() == 0


def test_tree_features_are_mergeable():
    m = _world(4, 20, 6, 50)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    one = C.summary(iter([(np.ones(len(u)), u, (u * u).sum(1))]), 40)
    parts = [C.summary(iter([(np.ones(len(p)), p, (p * p).sum(1))]), 40) for p in np.array_split(u, 3)]
    both = C.summary(iter([tuple(np.concatenate([p[i] for p in parts]) for i in range(3))]), 40)
    for n, ls, ss in (one, both):
        assert len(n) <= 40 and n.sum() == len(u)
        assert np.allclose(ls.sum(0), u.sum(0)) and np.isclose(ss.sum(), len(u))


def test_ward_merges_the_nearest_first():
    x = np.array([[0.0], [0.1], [5.0], [5.2], [20.0]])
    assert len(set(C.ward(np.ones(5), x, 3))) == 3
    labels = C.ward(np.ones(5), x, 1, height=1.0)
    assert labels[0] == labels[1] and labels[2] == labels[3] and len(set(labels)) == 3


def test_heap_walks_by_rising_sum():
    a, b = [0.0, 0.4, 1.0], [0.0, 0.3, 0.5]
    walked = N.nearest_pairs(a, b, 9)
    sums = [a[i] + b[j] for i, j in walked]
    assert sums == sorted(sums) and len(set(walked)) == 9


def test_exact_search_misses_nothing(spark):
    """Far more cells than are walked first; neighbours far apart; an opposite vector; fewer entries than asked for."""
    rng = np.random.default_rng(11)
    m = rng.normal(size=(1500, 64)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    units = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, vec array<float>")
    got: dict[int, list[float]] = {}
    for r in N.nearest(units, units.filter("id % 20 = 0"), 10, -1.0, 1, exact=True).collect():
        assert abs(r.cosine - s[r.id, r.other]) < 1e-5
        got.setdefault(r.id, []).append(r.cosine)
    assert sorted(got) == list(range(0, 1500, 20))
    assert all(np.allclose(sorted(c), np.sort(s[i])[-10:], atol=1e-5) for i, c in got.items())
    few = spark.createDataFrame([(1, [1.0] + [0.0] * 63), (2, [-1.0] + [0.0] * 63)], "id bigint, vec array<float>")
    assert {(r.id, r.other, r.cosine) for r in N.nearest(few, few, 10, -1.0, 96, exact=True).collect()} == {(1, 2, -1.0), (2, 1, -1.0)}


def test_runs_of_cells_and_divided_cells_lose_nothing(spark):
    """Runs of five entries: cells with more are divided into parts, and the rows stay those of one large run."""
    m = np.concatenate([_world(6, 30, 6, 60), np.random.default_rng(2).normal(size=64) + np.random.default_rng(3).normal(size=(80, 64)) * 0.05])
    units = V.unit_vectors(_vectors(spark, m), "side_effect_id")
    whole = {tuple(r) for r in N.nearest(units, units, 5, 0.5, 40).select("id", "other").collect()}
    assert whole == {tuple(r) for r in N.nearest(units, units, 5, 0.5, 40, part_entries=5).select("id", "other").collect()}
    placed = spark.createDataFrame([(0, 0, i) for i in range(3)] + [(0, 1, i) for i in range(11)] + [(0, 2, 50), (1, 0, 51), (1, 1, 52)], "u int, v int, id bigint")
    runs = N.cell_runs(placed, 3, 5)
    assert runs.starts.tolist()[:3] == [0, 1, 2] and runs.parts.tolist()[:3] == [1, 3, 1]


def test_ward_makes_one_micro_cluster_of_several_leaves(monkeypatch):
    """Three leaves of a fine tree lie within the reach of similar records, a fourth does not: without Ward all four stay apart."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    side = [s * np.eye(64)[i] * 0.24 for i, s in ((0, 1), (1, 1), (2, -1))] + [-np.eye(64)[0] * 0.9]
    x = np.concatenate([centre + s + rng.normal(size=(12, 64)) * 0.002 for s in side])
    merged = C.micro_labels(x, float(np.sqrt(0.3)))
    assert len(set(merged[:36])) == 1 and len(set(merged[36:]) | {merged[0]}) == 2
    monkeypatch.setattr(C, "ward", lambda n, *_: np.arange(len(n)))
    assert len(set(C.micro_labels(x, float(np.sqrt(0.3))))) == 4


def test_ward_keeps_far_ends_apart():
    x = np.arange(8.0)[:, None]
    labels = C.ward(np.ones(8), x, 1, widest=2.0)
    assert all(abs(a - b) <= 2 for a in range(8) for b in range(8) if labels[a] == labels[b]) and len(set(labels)) == 4


def test_parts_are_agglomerated_as_the_whole():
    rng = np.random.default_rng(13)
    c = np.concatenate([k + rng.normal(size=(15, 4)) * 0.2 for k in rng.normal(size=(12, 4)) * 3])
    n = rng.integers(1, 9, len(c)).astype(float)
    pairs = lambda x: {(i, j) for i in range(len(x)) for j in range(len(x)) if x[i] == x[j]}
    assert pairs(C.merge_leaves(n, c, 0.6)) == pairs(C.ward(n, c, 1, np.inf, 0.6))


def test_one_giant_chain_is_checked_along_its_links(spark, monkeypatch):
    """Single linkage joins 240 vectors of a chain, two pairs and a dense ball into one candidate of many blocks."""
    monkeypatch.setattr(C, "BLOCK", 20)
    t = np.radians(np.arange(240) * 20.0 / 9)
    chain = np.zeros((240, 64))
    for i, a in enumerate(t):
        chain[i, i // 40], chain[i, i // 40 + 1] = np.cos((i % 40) * np.pi / 80), np.sin((i % 40) * np.pi / 80)
    rng = np.random.default_rng(5)
    ball = np.eye(64)[20] + rng.normal(size=(70, 64)) * 0.002
    pair = np.eye(64)[30] + np.outer([0, 1], np.eye(64)[31]) * 0.1
    m = np.concatenate([chain, ball, pair])
    _, found = _brute(m)
    units = V.unit_vectors(_vectors(spark, m), "side_effect_id")
    classes = V.distinct_vectors(units)
    rows, linked, micros = C.candidates(classes, region=150)
    one = rows.selectExpr("1L AS component", "leaf", "id", "vec", "copies")
    got = {(r.first_id, r.id) for r in C.exact_clusters(one, linked=linked, micros=micros).collect() if r.first_id != r.id}
    assert got == found and len(found) == 70


def test_every_region_that_can_hold_a_similar_record_is_visited(spark):
    m = _world(9, 40, 5, 60)
    units = V.unit_vectors(_vectors(spark, m), "side_effect_id")
    got = {(r.first_id, r.id) for r in C.clusters(units, region=20, visits=None).filter("id <> first_id").collect()}
    assert got == _brute(m)[1]
    rng = np.random.default_rng(12)
    x, c = rng.normal(size=(300, 3)).astype(np.float32), rng.normal(size=(9, 3)).astype(np.float32)
    for v in (x, c):
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    home = (x @ c.T).argmax(1)
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.3
    seen = set(zip(*(a.tolist() for a in C._possible_regions(x, c, np.full(300, 0.3)))))
    assert all((i, home[j]) in seen for i, j in zip(*np.nonzero(near))) and len(seen) < 300 * 9


def test_all_but_equal_vectors_are_one_micro_cluster(spark):
    """A region that cannot be divided is summed where its records lie."""
    rng = np.random.default_rng(6)
    m = np.concatenate([np.eye(64)[3] + rng.normal(size=(300, 64)) * 1e-4, rng.normal(size=(20, 64))])
    units = V.unit_vectors(_vectors(spark, m), "side_effect_id")
    micro, _ = C.micro_clusters(units, 20)
    assert micro.filter("vec IS NOT NULL").agg(F.max("n")).first()[0] == 300
    assert {(r.first_id, r.id) for r in C.clusters(units, region=20).collect()} == {(1, i) for i in range(1, 301)}


def test_entries_are_gathered_as_one_by_one():
    x = np.random.default_rng(3).normal(size=(1300, 6))
    x[700:900] = x[:200] + 1e-3
    for threshold in (0.0, 0.9, 1.5):
        left, want = list(range(len(x))), np.zeros(len(x), int)
        for number in range(len(x)):
            if not left:
                break
            took = [i for i in left if ((x[i] - x[left[0]]) ** 2).sum() <= threshold**2] if threshold else left[:1]
            want[took] = number
            left = [i for i in left if i not in set(took)]
        assert (C._gathered(x, threshold) == want).all()


def test_descent_visits_what_routing_visits(spark):
    """Level by level, but where the rows lie: no exchange."""
    units = _unit_rows(spark, 900, 5)
    micro, levels = C.micro_clusters(units, region=2)
    assert len(levels) > 1
    rows = units.select(F.lit("0").alias("region"), "id", "vec", F.lit(0.0).alias("sim"))
    went = rows
    for i, centres in enumerate(levels):
        went = C.route(went, centres, 3, deeper=i > 0)
    down = C.descend(rows, levels, 3)
    assert {(r.id, r.region, round(r.sim, 4)) for r in down.collect()} == {(r.id, r.region, round(r.sim, 4)) for r in went.collect()}
    assert "Exchange" not in down._jdf.queryExecution().executedPlan().toString()


def _unit_rows(spark, n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>")
