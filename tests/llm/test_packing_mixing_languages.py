import pytest

from leafloom.llm import languages as G
from leafloom.llm import mixing as X
from leafloom.llm import packing as P
from leafloom.llm.tokens import encoding, token_counts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, cluster string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y") for i, t, lang, s in rows], DOCS)


def test_token_counts_are_those_of_the_tokenizer(spark):
    texts = ["", None, "два слова", "a b  c\n", "x" * 300000]
    got = {r.doc_id: r.n_tokens for r in token_counts(_docs(spark, [(i, t, "ru", "s") for i, t in enumerate(texts)]), ["doc_id"]).collect()}
    e = encoding("/opt/tokenizers", "byte_bpe_multi_50k.tiktoken")
    assert got == {i: len(e.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert e.decode(e.encode_ordinary("два слова")) == "два слова"


def _pack(spark, rows, limits=(("small", 16), ("big", 50)), **kw):
    caps = spark.createDataFrame(list(limits), "container_kind string, capacity_tokens int")
    return P.pack_texts(_docs(spark, rows), caps, **kw).collect()


def test_containers_hold_every_text_once_within_capacity(spark):
    words = ["слово", "text", "Wort", "vārds"]
    rows = [(i, " ".join(words[(i + j) % 4] for j in range(1 + (i * 7) % 23)), "ru", f"s{i % 3}") for i in range(300)] + [(900, None, "ru", "s"), (901, "", "ru", None), (902, "one", "en", None)]
    sizes = {r.doc_id: r.n_tokens for r in token_counts(_docs(spark, rows), ["doc_id"]).collect() if r.n_tokens}
    got = _pack(spark, rows, shard_items=60)
    for kind, cap in (("small", 16), ("big", 50)):
        mine = [r for r in got if r.container_kind == kind]
        filled, parts = {}, {}
        for r in mine:
            filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
            parts.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
        assert max(filled.values()) <= cap and set(parts) == set(sizes)
        for doc, spans in parts.items():
            assert sum(n for _, n in spans) == sizes[doc] and len(spans) == -(-sizes[doc] // cap)
            assert sorted(s for s, _ in spans) == [i * cap for i in range(len(spans))]
        assert sum(filled.values()) / (cap * len(filled)) > 0.9


def test_copies_never_share_a_container(spark):
    rows = [(i, "один и тот же текст", "ru", "a") for i in range(30)] + [(100 + i, f"другой {i}", "ru", "b") for i in range(60)]
    got = [r for r in _pack(spark, rows, shard_items=1000) if r.container_kind == "big" and r.doc_id < 30]
    assert len({r.container_id for r in got}) == 30


def test_sources_in_conflict_stay_apart(spark):
    rows = [(i, f"текст номер {i}", "ru", "ab"[i % 2]) for i in range(40)]
    source = {i: "ab"[i % 2] for i in range(40)}
    together = {}
    for r in _pack(spark, rows, conflicts=(("a", "b"),)):
        together.setdefault((r.container_kind, r.container_id), set()).add(source[r.doc_id])
    assert all(len(s) == 1 for s in together.values())


def test_tightest_compatible_bin():
    # residuals after 7 and 6 are 3 and 4: the 3 goes to the tighter, unless it is a copy of what lies there
    assert P.best_fit([7, 6, 3], ["s"] * 3, [1, 2, 3], 10) == [0, 1, 0]
    assert P.best_fit([7, 6, 3], ["s"] * 3, [1, 2, 1], 10) == [0, 1, 1]
    assert P.best_fit([7, 6, 3], ["a", "b", "c"], [1, 2, 3], 10, (("a", "c"),)) == [0, 1, 1]


def test_nothing_to_pack(spark):
    assert _pack(spark, []) == []
    assert _pack(spark, [(1, "x", "en", "s")], limits=(("none", 0),)) == []


def _mix(spark, rows, targets, **kw):
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixture, report = X.mix_sources(_docs(spark, rows), t, **kw)
    return mixture.collect(), {r.source: r for r in report.collect()}


def test_shares_are_reached_without_too_many_repeats(spark):
    rows = [(i, "текст " * (1 + i % 9), "ru", "big") for i in range(900)] + [(2000 + i, "слово " * (2 + i % 5), "ru", "small") for i in range(60)] + [(5000, "x", "en", "stray"), (5001, None, "ru", "big"), (5002, "y", "ru", None)]
    mixture, report = _mix(spark, rows, [("big", 0.7, 1), ("small", 0.2, 4), ("absent", 0.1, 2)])
    assert abs(report["big"].reached_share - 0.7 / 0.9) < 0.02 and abs(report["small"].reached_share - 0.2 / 0.9) < 0.02
    assert report["absent"].tokens == 0 and {r.source for r in mixture} == {"big", "small"}
    seen = {}
    for r in mixture:
        seen.setdefault((r.source, r.doc_id), []).append(r.copy_no)
    for (source, _), copies in seen.items():
        assert sorted(copies) == list(range(1, len(copies) + 1)) and len(copies) <= {"big": 1, "small": 4}[source]


def test_copies_follow_the_boundaries(spark):
    sized = spark.createDataFrame([("s", i, 5) for i in range(10)], "source string, doc_id bigint, n_tokens bigint")
    got = X.systematic_sample(sized, spark.createDataFrame([("s", 2.5)], "source string, factor double")).collect()
    assert sum(r.copies for r in got) == 25 and {r.copies for r in got} == {2, 3}


def test_more_copies_than_a_number_holds(spark):
    sized = spark.createDataFrame([("s", i, 5) for i in range(10)] + [("t", 1, 1)], "source string, doc_id bigint, n_tokens bigint")
    got = X.systematic_sample(sized, spark.createDataFrame([("s", 3e8 + 0.25), ("t", 2.0**40)], "source string, factor double")).collect()
    assert sum(r.copies for r in got if r.source == "s") in (3 * 10**9 + 2, 3 * 10**9 + 3) and [r.copies for r in got if r.source == "t"] == [2**40]
    few = spark.createDataFrame([("s", 7, 5, 25_001)], "source string, doc_id bigint, n_tokens bigint, copies bigint")
    assert sorted(r.copy_no for r in X.numbered_copies(few).collect()) == list(range(1, 25_002))


def test_given_total_is_capped(spark):
    rows = [(1, "a b c", "en", "s"), (2, "d e f", "en", "t")]
    mixture, report = _mix(spark, rows, [("s", 0.5, 2), ("t", 0.5, 3)], total_tokens=10**9)
    assert report["s"].most_copies == 2 and report["t"].most_copies == 3


def test_nothing_to_mix(spark):
    mixture, report = _mix(spark, [], [("s", 1.0, 1)])
    assert mixture == [] and report["s"].tokens == 0


@pytest.fixture(scope="module")
def field(spark):
    from leafloom.common import table

    return G.train(G.training_sample(table(spark, "/root/testdata/sf0.01", "documents"), 60))


def test_held_out_accuracy(spark, field):
    """Labels of long documents not drawn for training; a share of them is wrong on purpose."""
    from leafloom.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("lang IN ('ru', 'en', 'de', 'lv', 'uk') AND n_chars > 4000")
    got = G.detect(docs.select("doc_id", "lang", "text").withColumnRenamed("lang", "label"), field, ["label"]).select("label", "lang").collect()
    assert len(got) > 50 and sum(r.label == r.lang for r in got) > 0.9 * len(got)


def test_lines_and_odd_texts(spark, field):
    ru, en, lv = "Хранить в сухом месте при температуре не выше 25 градусов.", "Store the first-aid box in a dry place and away from children.", "Uzglabāt sausā vietā, bērniem nepieejamā vietā."
    rows = [(1, f"{ru}\n\n12,5 / 7\n{en}\nБакализин"), (2, ru), (3, None), (4, ""), (5, " \n "), (6, "12 / 7"), (7, lv), (8, (en + " ") * 3000), (9, "Пpи пеpедозиpовке возможны тошнота и pвота, нужно наблюдение.")]
    got = {r.doc_id: r for r in G.detect(_docs(spark, [(i, t, "ru", "s") for i, t in rows]).select("doc_id", "text"), field, ["doc_id"]).collect()}
    assert set(got) == {1, 2, 7, 8, 9}
    assert got[1].line_langs[0] == "ru" and got[1].line_langs[3] == "en" and len(got[1].line_langs) == 5
    assert (got[2].lang, got[7].lang, got[8].lang, got[9].lang) == ("ru", "lv", "en", "ru") and got[2].line_langs is None
    assert all(0.2 <= r.confidence <= 1 for r in got.values())


def test_segments_have_a_confidence(spark, small):
    got = G.p10_segments(spark, small).collect()
    by = {}
    for r in got:
        assert 0 < r.confidence <= 1 and r.lang in G.LANGUAGES
        by.setdefault(r.doc_id, {})[r.seg_no] = r.lang
    assert by and all(set(lines) == set(range(len(lines))) and len(set(lines.values())) > 1 for lines in by.values())
    assert {(d, n, lang) for d, lines in by.items() for n, lang in lines.items()} == {(r.doc_id, r.seg_no, r.lang) for r in G.p10_found(spark, small).filter("seg_no >= 0").collect()}


def test_audit_sees_broken_rules(spark):
    docs = _docs(spark, [(1, "a b", "en", "x"), (2, "A-B", "en", "y"), (3, "c", "en", "y")])
    limits = spark.createDataFrame([("k", 4)], "container_kind string, capacity_tokens int")
    packed = spark.createDataFrame([("k", "1", 1, 0, 0, 3), ("k", "1", 2, 0, 0, 3), ("k", "2", 3, 0, 1, 1), ("k", "2", 3, 1, 2, 1)], "container_kind string, container_id string, doc_id bigint, part_no int, token_start bigint, n_tokens bigint")
    assert [tuple(r) for r in P.audit(packed, docs, limits, (("x", "y"),)).collect()] == [("k", 3, 1, 1, 2, 1)]


def test_no_labelled_rows(spark):
    assert G.training_sample(_docs(spark, [])) == []
    f = G.train([])
    assert G.detect(_docs(spark, [(1, "слово", "ru", "s")]).select("doc_id", "text"), f, ["doc_id"]).count() == 1


def test_marginals_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    e, a, b = rng.uniform(0.1, 1, (1, 4, G.K)), rng.uniform(0.1, 1, (G.K, G.K)), rng.uniform(0.1, 1, (G.K, G.K))
    breaks = np.array([[True, False, True, False]])
    post, _, _ = G.marginals(e, breaks, np.ones((1, 4), bool), a, b)
    want = np.zeros((4, G.K))
    for y in itertools.product(range(G.K), repeat=4):
        w = np.prod([e[0, t, y[t]] for t in range(4)]) * np.prod([(b if breaks[0, t] else a)[y[t - 1], y[t]] for t in range(1, 4)])
        for t in range(4):
            want[t, y[t]] += w
    assert np.allclose(post[0], want / want.sum(1, keepdims=True))
