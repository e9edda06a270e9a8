"""Queries on similar terms against a plain reading of the statement: every term with every other, one by one."""

import numpy as np

from leafloom import plans
from leafloom.functions.text import clean_term, penalised_similarity
from leafloom.operators import similarity as E

ENCODE = E.hashed_encoder()


def _cleaned(spark, terms):
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    return {r.t: r.c for r in df.select("t", clean_term(df.t).alias("c")).collect()}


def _penalised(spark, rows):
    """(a, b, sim) with the penalty where numbers or minerals differ."""
    df = spark.createDataFrame([(a, b, float(s)) for a, b, s in rows], "a string, b string, s double")
    return {(r.a, r.b): r.p for r in df.select("a", "b", penalised_similarity(df.a, df.b, df.s).alias("p")).collect()}


def _hits(spark, queries, corpus, least):
    """For each query all corpus terms of at least ``least``, best first, then by term."""
    clean = _cleaned(spark, set(queries) | set(corpus))
    vec = {c: ENCODE(c).astype(float) for c in set(clean.values())}
    sims = [(clean[q], clean[t], vec[clean[q]] @ vec[clean[t]]) for q in queries for t in corpus]
    p = _penalised(spark, {x for x in sims if x[2] >= least})
    out = {}
    for q in queries:
        found = [(-p[clean[q], clean[t]], t) for t in corpus if p.get((clean[q], clean[t]), 0) >= least]
        out[q] = [t for _, t in sorted(found)]
    return out


def test_raw_terms_by_the_standard_term(spark, small):
    raw = sorted({r.effect for r in spark.read.parquet(f"{small}/side_effects.parquet").collect() if r.effect and r.effect.strip(" ")})
    terms = [r.term for r in spark.read.parquet(f"{small}/effect_terms.parquet").collect()]
    want = {}
    for q, hits in _hits(spark, raw, terms, 0.9).items():
        if hits:
            want[hits[0]] = want.get(hits[0], 0) + 1
    assert {r.term: r.n for r in plans.QUERIES["sim_j21_standard"](spark, small).collect()} == want and want


def test_edges_between_similar_terms(spark, small):
    e = {(r.source, r.target) for r in spark.read.parquet(f"{small}/edge_list.parquet").collect() if r.source and r.target}
    terms = sorted({t for x in e for t in x})
    two = "класс савинасестатов", "лонобонамид ретард"
    near = _hits(spark, two, terms, 0.35)
    want = {(s, t) for s, t in e if (s in near[two[0]] and t in near[two[1]]) or (s in near[two[1]] and t in near[two[0]])}
    assert {(r.source, r.target) for r in plans.QUERIES["sim_j20_connected"](spark, small).collect()} == want
    pair = lambda x, y: (spark.createDataFrame([(x,)], "term string"), spark.createDataFrame([(y,)], "term string"))
    some = sorted(e)[0]
    got = E.connected_pair(*pair(*some), spark.createDataFrame(sorted(e), "source string, target string"))
    assert {(r.source, r.target) for r in got.collect()} == {x for x in e if x in (some, some[::-1])}


def test_series_take_the_first_free_term(spark, small):
    terms = sorted({r.effect.lower() for r in spark.read.parquet(f"{small}/side_effects.parquet").collect() if r.effect is not None})
    m = np.array([ENCODE(t) for t in terms], float)
    norm = np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
    sim = (m / norm) @ (m / norm).T
    of = {}
    for i, t in enumerate(terms):
        if t not in of:
            of[t] = t
            for j in range(len(terms)):
                if sim[i, j] >= 0.97 and terms[j] not in of:
                    of[terms[j]] = t
    got = {r.term: r.canonical for r in plans.QUERIES["sim_e09_series"](spark, small).collect()}
    assert got == of


def test_phrases_longest_first_without_overlaps(spark, small):
    known = {}
    for r in spark.read.parquet(f"{small}/synonyms.parquet").collect():
        known[r.variant] = min(r.canonical, known.get(r.variant, r.canonical))
    want = {}
    for r in spark.read.parquet(f"{small}/side_effects.parquet").collect():
        if r.effect is None:
            continue
        w = r.effect.split(" ")
        spans = sorted((i - j, i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if " ".join(w[i:j]) in known)
        taken = []
        for _, i, j in spans:
            if all(j <= a or b <= i for a, b in taken):
                taken.append((i, j))
        out, i = [], 0
        starts = dict(taken)
        while i < len(w):
            if i in starts:
                out.append(known[" ".join(w[i : starts[i]])])
                i = starts[i]
            else:
                out.append(w[i])
                i += 1
        want[r.id] = " ".join(out)
    assert {r.id: r.text for r in plans.QUERIES["sim_e07_phrases"](spark, small).collect()} == want


def test_seeded_subgraph(spark, small):
    e = {(r.source.strip(" "), r.target.strip(" ")) for r in spark.read.parquet(f"{small}/edge_list.parquet").collect() if r.source and r.target and r.source.strip(" ") and r.target.strip(" ")}
    names = sorted({t for x in e for t in x})
    seen = {t for hits in _hits(spark, ["класс савинасестатов", "группа зобифододон"], names, 0.6).values() for t in hits}
    grow = set(seen)
    while grow:
        grow = {t for s, t in e if s in grow} - seen
        seen |= grow
    got = {(r.source, r.target) for r in plans.QUERIES["graph_g11_seeded"](spark, small).collect()}
    assert got == {(s, t) for s, t in e if s in seen and t in seen}


def test_trained_encoder_knows_misspelt_terms(spark, small):
    """Of terms with a letter left out or doubled, nearly all are nearest to their own among 600; more than by bare hashes."""
    terms = sorted(r.term for r in spark.read.parquet(f"{small}/effect_terms.parquet").collect())
    encoder = E.train_encoder(spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string"))
    odd = [t[: len(t) // 2] + t[len(t) // 2 + 1 :] for t in terms] + [t[: len(t) // 2] + t[len(t) // 2] + t[len(t) // 2 :] for t in terms]

    def share(fn):
        m = np.array([fn(t) for t in terms])
        return np.mean([(m @ fn(o)).argmax() == i % len(terms) for i, o in enumerate(odd)])

    assert share(encoder) > 0.95 and share(encoder) >= share(ENCODE)
    assert np.allclose(np.linalg.norm([encoder(t) for t in terms], axis=1), 1, atol=1e-5)
    empty = E.train_encoder(spark.createDataFrame([], "term string"))
    assert empty("боль").shape == (64,)
    hits = E.find_similar_terms(spark.createDataFrame([(odd[3],)], "term string"), spark.createDataFrame([(t,) for t in terms], "term string"), 0.3, 1, encoder).collect()
    assert [r.term for r in hits] == [terms[3]]
