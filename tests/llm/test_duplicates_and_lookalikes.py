import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.llm import format_duplicates as D
from leafloom.llm import lookalikes as L


def _copies(spark, rows, schema="id bigint, drug string, other string", **kw):
    df = spark.createDataFrame(rows, schema)
    canon = D.canonical_rows(df, "t", "id", ["drug"], "drug")
    return {(r.first_id, r.copy_id) for r in D.copies(canon, **kw).collect()}


def test_formats_components_nulls_and_ties(spark):
    rows = [(1, "Аб+Вг", "x"), (2, " вг / АБ. ", "x"), (3, "Аб", "x"), (4, "аб!", "x"), (5, None, "x"), (6, "", "x"), (7, " - ", "x"), (8, "Аб-5", "x"), (9, "аб5", "x"), (4, "аб!", "x")]
    assert _copies(spark, rows) == {(1, 2), (3, 4), (8, 9)}


def test_empty_table(spark):
    assert _copies(spark, []) == set()


def test_null_equals_null_but_not_empty(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "A", None), (3, "a", "")], "id bigint, effect string, freq string")
    got = D.copies(D.canonical_rows(df, "t", "id", ["effect", "freq"], "effect")).collect()
    assert {(r.first_id, r.copy_id) for r in got} == {(1, 2)}


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 9, "q"), (2, "A ", 8, "q")], "id bigint, drug string, copies int, canon string")
    assert D.copies(D.canonical_rows(df, "t", "id", ["drug"], "drug")).count() == 1


def test_buckets_split_until_they_fit(spark):
    """A hot prefix, a hot record and very long keys; small buckets give the same classes as a plain count."""
    names = [f"общееначало{i % 97:03d}" for i in range(3000)] + ["горячий"] * 1500 + ["я" * 5000, "Я" * 5000 + "."]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id bigint, drug string")
    rows = D.canonical_rows(df, "t", "id", ["drug"], "drug")
    got = {r.canon: (r.first_id, r.copies) for r in D.collapse(rows, capacity=5).collect()}
    want = {r.canon: (r.f, r.n) for r in rows.groupBy("canon").agg(F.min("id").alias("f"), F.count("*").alias("n")).collect()}
    assert got == want
    counted = rows.mapInArrow(D._count_partition, D._COUNTED)
    sizes = D.radix_buckets(counted, 5, counted.count()).groupBy("bucket").agg(F.count_distinct("canon").alias("d"), F.count("*").alias("n")).collect()
    assert all(r.n <= 5 or r.d == 1 for r in sizes)


def test_trie_counts():
    t = D.CountingTrie()
    for k, i in ((b"", 4), (b"ab", 3), (b"ab", 1), (b"abcdefghij", 2)):
        t.add(k, 1, i)
    assert sorted(t) == [(b"", 1, 4), (b"ab", 2, 1), (b"abcdefghij", 1, 2)]


def _forms(spark, rows):
    df = spark.createDataFrame(rows, "table_name string, row_id bigint, text string, forms string")
    return {r.row_id: (r.text, r.changed) for r in L.consistent_texts(df).collect()}


def test_one_consistent_form(spark):
    clean = "сухость кожи и покраснение, gadījumā mouth office Kranken"
    rows = [
        (1, clean), (2, "сyxость кожи"), (3, "gadījumā mouth"), (4, "ｍｏｕｔｈ２"), (5, "су​хость"), (6, "сухость кожи"), (7, "oﬃce"),
        (8, "сухость‑кожи"), (9, "β-блокатор CYP3A4 м² ½ №5 «так» — “x”"), (10, "Krаnken"), (11, ""), (12, None), (13, "QT и Т"), (14, "word " * 40000 + "сyxость"),
    ]
    got = _forms(spark, [("t", i, t, "x") for i, t in rows])
    assert got[2] == ("сухость кожи", True)
    assert got[3][0] == "gadījumā mouth" and got[4][0] == "mouth2" and got[5][0] == "сухость" and got[6][0] == "сухость кожи"
    assert got[7][0] == "office" and got[8][0] == "сухость-кожи" and got[10][0] == "Kranken"
    assert got[14] == ("word " * 40000 + "сухость", True)
    for i in (1, 9, 11, 12, 13):
        assert got[i] == (dict(rows)[i], False)


def test_vocabulary_decides_over_the_table():
    v = L.Vocabulary()
    v.add("cop", 5)
    v.add("сор", 2)
    assert v.best("cоp") == "cop"
    assert v.best("xyz") is None
    assert v.best("coq", budget=1.0) == "cop"


def test_the_walk_takes_words_as_they_stand():
    """Wide and joined forms, invisible signs and separate accents cost nothing, an accent more or less keeps the look."""
    v = L.Vocabulary()
    for w, n in (("mouth", 3), ("office", 3), ("сухость", 3), ("gadījumā", 3), ("район", 4), ("надежный", 9), ("папа", 9)):
        v.add(w, n)
    free = {"ｍｏｕｔｈ": "mouth", "oﬃce": "office", "сyxо\u200bсть": "сухость", "gadi\u0304juma\u0304": "gadījumā", "раи\u0306oн": "район"}
    for word, want in free.items():
        assert v.best(word, budget=0.0) == want, word
    assert v.best("нaдёжный", budget=0.0) is None and v.best("нaдёжный") == "надёжный"
    assert v.best("пaпа\u0301") == "папа\u0301" and v.best("пaп") is None


def test_spelling_comes_from_the_trie_and_not_from_the_table(spark):
    """All letters of these words have twins, most of them Cyrillic: only the vocabulary can tell that they are Latin."""
    rows = [("t", i, "the cop axe") for i in range(5)] + [("t", 90, "cор"), ("t", 91, "ахe"), ("t", 92, "\u200bcо\u200bр,")]
    got = _forms(spark, [(*r, "x") for r in rows])
    assert got[90] == ("cop", True) and got[91] == ("axe", True) and got[92] == ("cop,", True)
    assert L.by_table("cор") == "сор" and L.by_table("ахe") == "ахе"


def test_many_buckets_give_the_same_spellings(spark):
    words = spark.createDataFrame([(L.coarse_key(w), w, n) for w, n in (("cop", 5), ("сор", 2), ("мама", 3), ("axe", 1))], "key string, word string, n bigint")
    tokens = spark.createDataFrame([("cор",), ("мaма",), ("aхe",), ("слoво",)], "token string")
    one = {r.word: r.spelling for r in L.spellings(tokens, words).collect()}
    assert one == {r.word: r.spelling for r in L.spellings(tokens, words, 1).collect()} == {"cор": "cop", "мaма": "мама", "aхe": "axe", "слoво": "слово"}


def test_no_texts(spark):
    assert L.changed_tokens(spark.createDataFrame([], "table_name string, row_id bigint, text string")).count() == 0


@given(st.text(max_size=40))
def test_rewriting_is_stable(text):
    once = [L.rewrite(t, {}) for t in text.split(" ")]
    assert [L.rewrite(t, {}) for t in once] == once
    for t in L.suspicious_tokens(text):
        assert t in text


@pytest.mark.parametrize("word", ["сyxость", "Krаnken", "пｐｅдплｅчья"])
def test_table_forces_one_alphabet(word):
    out = L.by_table(word)
    assert len({unicodedata.name(c).split()[0] for c in out}) == 1
