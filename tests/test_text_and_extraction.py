import pytest
from pyspark.sql import functions as F

from leafloom.functions import scores as N
from leafloom.functions import text as T
from leafloom.operators import annotation as A
from leafloom.operators import extraction as X


def _one(spark, column, text=""):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


CASES = [
    (T.normalize_text, "a , b .\n\n\nc ( d ) x - y T 1/2 С max ≤ 5 « q » w / e", "a, b.\nc (d) x-y T1/2 Cmax ≤5 «q» w/e".replace("c (d)", "c (d)")),
    (T.remove_brackets, "a(b\nc)d[e]f{g}h", "adfh"),
    (T.remove_brackets_deep, "a(b[c)d]e}f(g", "aef"),
    (T.remove_matched_brackets, "a(b(c)d)e[f", "ae[f"),
    (T.remove_unmatched_brackets, "a) b (c", " b "),
    (T.remove_parentheses, " (x) ", None),
    (lambda c: T.expand_abbreviations(c, {"бл": "блокатор", "β-бл": "бета-бл"}), "β-бл βx", "бета-блокатор βx"),
    (T.fix_terms, "Сmax и Т1/2, t max (см. раздел 5) Стр 4 из 9", "Cmax и T1/2, Tmax  "),
    (T.join_broken_lines, "побоч- \nное\nдействие", "побочное\nдействие"),
    (T.dosage_form, "Таблетки, 5 мг/мл (п/о) с ароматом мяты", "таблетки "),
    (T.bullets, " • a –— b ;\n\n c", "- a - b;\nc"),
    (lambda c: T.truncate_after(c, ["СТОП", "конец"]), "до Стоп после", "до"),
    (T.sorted_key, "b+a", "a+b"),
    (T.letters_only, "Аб-1 в", "абв"),
    (T.ascii_only, "aжb", "ab"),
    (T.protect_entities, "a&lt;b", "a__LT__b"),
    (lambda c: T.lemmatize(c, {"боли": "боль"}), "Боли , колена", "боль, колена"),
    (T.clear_text, "Головная  боль * (см. раздел 4), тошнота / рвота :\nмало\nконец строки,", "Головная боль , тошнота/рвота:мало\nконец строки"),
]


@pytest.mark.parametrize("fn,text,want", CASES, ids=range(len(CASES)))
def test_text_functions(spark, fn, text, want):
    assert _one(spark, fn(F.col("t")), text) == want


@pytest.mark.parametrize("fn", [c[0] for c in CASES], ids=range(len(CASES)))
def test_text_functions_take_null_and_empty(spark, fn):
    assert _one(spark, fn(F.col("t")), None) is None
    _one(spark, fn(F.col("t")), "")


def test_lists_and_parsers(spark):
    one = lambda c, t: _one(spark, c(F.col("t")), t)
    assert one(T.numbers, "5 мг и 2.5, 3.") == [5.0, 2.5, 3.0]
    assert one(T.minerals, "препараты калия и Магния (железо)") == ["калий", "магний"]
    assert one(T.split_items, "a, b; 2,5 мг. c") == ["a", "b", "2,5 мг", "c"]
    assert one(T.list_items, " A ;; b ") == ["a", "b"] and one(T.list_items, "-") == [] and one(T.list_items, None) == []
    assert tuple(one(T.label_and_tag, "боль (сильная) (side_e)")) == ("боль (сильная)", "side_e")
    assert tuple(one(T.label_and_tag, "без тега")) == (None, None)
    assert tuple(one(T.group_line, "Cardiac (12%, 345 ADRs)")) == ("Cardiac", 12, 345) and one(T.group_line, "x")["name"] is None
    assert tuple(one(T.effect_line, "Pain (7)")) == ("Pain", 7)
    assert one(T.report_count, "There are <strong>55 324</strong> reports") == 55324
    assert [x.phrase for x in _one(spark, T.word_ngrams(F.split("t", " ")), "a b c")] == ["a", "a b", "a b c", "b", "b c", "c"]
    assert _one(spark, T.detokenize(T.tokens(F.col("t"))), "да , ( нет ) .") == "да, (нет)."
    assert one(lambda c: T.sentences(c), "Первое предложение. Второе одно; третье\nСлово.\nЧетвёртое: ") == ["Первое предложение."]
    group = one(T.pharm_group_and_atc, "Фармакотерапевтическая группа: антибиотики; прочие.\nКод АТХ: J01CA04\nМеханизм действия Подавляет рост.")
    assert group.pharm_group == ["антибиотики", "прочие"] and group.atc_code == "J01CA04" and group.rest == "Подавляет рост."


def test_similarity_rules(spark):
    cap = lambda a, b: _one(spark, T.capped_similarity(F.lit(a), F.lit(b), F.lit(0.99)))
    assert cap("cyp3a4", "cyp2d6") == 0.85 and cap("натрий", "калий") == 0.88 or cap("натрий", "калий") <= 0.88
    pen = lambda a, b: _one(spark, T.penalised_similarity(F.lit(a), F.lit(b), F.lit(0.97)))
    assert round(pen("доза 5", "доза 6"), 6) == 0.92 and pen("доза 5", "доза") == 0.97 and round(pen("калий 5", "магний 6"), 6) == 0.92


def test_scores(spark):
    rows = spark.createDataFrame([(0.5,), (0.5,), (1.0,)], "p double")
    got = rows.agg(N.noisy_or(F.col("p")).alias("n"), N.capped_sum(F.col("p")).alias("c"), N.scaled_sum(F.col("p"), 4.0).alias("s")).first()
    assert (got.n, got.c, got.s) == (1.0, 1.0, 0.5)
    assert _one(spark, N.effect_weight(F.lit(10), F.lit(0.5), F.lit(100))) == round(0.05**0.4, 2)
    assert _one(spark, N.effect_weight(F.lit(10), F.lit(0.5), F.lit(0))) == 0.0 and _one(spark, N.effect_weight(F.lit(1), F.lit(1.0), F.lit(1), F.lit("a?"))) == 0.0
    assert [_one(spark, N.compatibility_class(F.lit(x))) for x in (0.49, 0.5, 0.99, 1.0)] == [1, 2, 2, 3]
    assert N.configurations(0) == [""] and N.configurations(2) == ["0,0", "0,1", "1,0", "1,1"]


def test_side_effects_of_a_leaflet(spark):
    text = "Введение\nНарушения сердца\nчасто: аритмия, тахикардия; редко: обморок 5.\nКожа\nсыпь, зуд, такие как волдыри.\nНарушения сердца\nочень редко: шок"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "нет заголовков")], "id int, t string")
    got = [(r.section, r.freq, r.effect) for r in X.side_effect_rows(df, "t", ["Нарушения сердца", "Кожа"], ["id"]).orderBy("section", "freq", "ord").collect()]
    assert ("Нарушения сердца", "часто", "аритмия") in got and ("Нарушения сердца", "редко", "обморок") in got
    # the repeated header adds to the section before it
    assert any(s == "Кожа" and e == "шок" for s, _, e in got)


def test_last_and_first_write_win(spark):
    rows = spark.createDataFrame([("B+a", "Боль", "часто", 1), ("b+A", "боль", "редко", 2), ("c", "зуд", None, 1)], "drug string, effect string, freq string, ord int")
    assert {tuple(r) for r in X.drug_effect_freq(rows).collect()} == {("a+b", "боль", "редко"), ("c", "зуд", "Частота неизвестна")}
    assert {tuple(r) for r in X.drug_effect_freq(rows, last_wins=False, need_freq=True).collect()} == {("a+b", "боль", "часто")}


def test_sections_chapters_and_file_names(spark):
    leaflet = "Лекарственная форма\nтаблетки\nСостав\nx\nПротивопоказания: аллергия; - астма, язва\nСпособ применения и дозы\nПобочное действие\nтошнота\nПередозировка\nнет"
    row = X.sections(spark.createDataFrame([(leaflet,)], "t string"), "t", []).first()
    assert row.dosage_form == "таблетки" and row.text_side_e == "тошнота" and row.contraindications == "аллергия; - астма, язва" and row.group is None
    smpc = "4.1 Показания к применению\nболь 4.3 Противопоказания\nастма\n4.8. Нежелательные реакции\nрвота\nСообщение о подозреваемых нежелательных реакциях\nпишите 5.1 Фармакодинамика\nx"
    chapters = _one(spark, X.chapters(F.col("t")), smpc)
    assert chapters["Показания к применению"] == "боль" and chapters["Нежелательные реакции"] == "рвота" and chapters["Фармакодинамические свойства"] == "x"
    stats = _one(spark, X.chapter_stats(X.chapters(F.col("t"))), smpc)
    assert stats.found_count == 4 and stats.not_found_count == 9
    info = _one(spark, X.file_name_info(F.col("t")), "12) Аб+Вг+[Д+Е] _ Торг® _ 02.11.2022.pdf")
    assert (info.num_prepare, info.international_name, info.international_name_dlc, info.trade_name, info.date) == (12, ["Аб", "Вг"], ["Д", "Е"], "Торг®", "02.11.2022")
    assert _one(spark, X.file_name_info(F.col("t")), "плохо.pdf") is None
    assert _one(spark, X.contraindications(F.col("t")), "Гиперчувствительность к веществу;\n- бронхиальная астма (тяжёлая);\n- возраст до 2,5 лет, язва.") == ["бронхиальная астма", "возраст до 2,5 лет", "язва"]


def test_report_pages(spark):
    html = '<ul><li><span>a</span><span>Cardiac (12%, 30 ADRs)</span></li><li><span>Pain (7)</span></li><li>Rash (2)</li></ul>'
    got = _one(spark, X.report_groups(F.col("t")), html)
    assert [(g.grp, g.effect, g.cases) for g in got] in ([("aCardiac", "Pain", 7), ("aCardiac", "Rash", 2)], [("Cardiac", "Pain", 7), ("Cardiac", "Rash", 2)])
    table = "<table><tr><td>Male</td><td>12</td><td>5%</td></tr><tr><td>x</td><td>n/a</td><td></td></tr><tr><td>y</td></tr></table>"
    assert [tuple(x) for x in _one(spark, X.stat_table(F.col("t")), table)] == [("Male", 12), ("x", 0)]
    assert _one(spark, X.html_section(F.col("t"), "Side effects"), '<h2>Side effects</h2><div class="x">a<sup>1</sup><p>b&amp;c</p></div>') == "ab&c"
    lists = _one(spark, X.heading_lists(F.col("t")), "<h3>Heart</h3><ul><li>Common: a, b</li><li>c</li></ul><h2>end</h2><h3>no</h3><ul><li>z</li></ul>")
    assert [(x.category, x.freq, x.effects) for x in lists] == [("Heart", "Common", ["a", "b"]), ("Heart", None, ["c"])]


def test_annotation_pipeline(spark):
    docs = spark.createDataFrame([(1, "Приём (аспирина) вызывает боль. Зуд прошёл."), (2, ""), (3, None)], "doc_id bigint, text string")
    toks = A.document_tokens(docs).orderBy("doc_id", "token_no").collect()
    assert [t.token for t in toks] == ["Приём", "(", "аспирина", ")", "вызывает", "боль", ".", "Зуд", "прошёл", "."]
    same = A.tokens_with_offsets(docs, "text", ["doc_id"]).orderBy("doc_id", "token_no").collect()
    assert [tuple(t) for t in same] == [tuple(t) for t in toks]
    assert A.repair_spans(docs.first().text, [6], [15]) == [(7, 15)] and A.repair_spans("abc", [1, None], [9, 2]) == [None, None] and A.repair_spans("да, нет", [2], [5]) == [(4, 7)]
    assert A.repair_spans("a (б) - .", [2, 4, 5, 9, 0], [4, 5, 9, 9, 0]) == [(3, 4), (3, 4), (5, 5), (9, 9), (0, 1)] and A.repair_spans("", [0], [0]) == [(0, 0)] and A.repair_spans("..", [0], [2]) == [(0, 0)]
    ents = spark.createDataFrame([(10, 1, 7, 15, "prepare"), (11, 1, 26, 30, "side_e"), (12, 1, 17, 30, "long"), (13, 1, 32, 35, None)], "entity_id bigint, doc_id bigint, start_offset int, end_offset int, label string")
    kept = A.without_overlaps(ents)
    assert {r.entity_id for r in kept.collect()} == {10, 12, 13}
    tags = A.bio_tags(A.document_tokens(docs), kept).orderBy("doc_id", "token_no").collect()
    assert [t.tag for t in tags] == ["O", "O", "B-prepare", "O", "B-long", "I-long", "O", "B-", "O", "O"]
    seg = A.segments(A.bio_tags(A.document_tokens(docs), kept.filter("label IS NOT NULL"))).orderBy("segment_no").collect()
    assert [(s.text, s.tag) for s in seg] == [("Приём (", None), ("аспирина", "prepare"), (")", None), ("вызывает боль", "long"), (". Зуд прошёл.", None)]
    rel = spark.createDataFrame([(1, 10, 12)], "rel_id bigint, from_id bigint, to_id bigint")
    recs = A.sentence_records(docs, ents, rel).orderBy("sent_no").collect()
    assert [(r.sent_no, len(r.entities), r.n_relations, r.n_missing) for r in recs] == [(0, 2, 1, 0), (1, 1, 0, 0)]
    items = F.array(F.struct(F.lit("a").alias("text"), F.lit(None).cast("string").alias("tag")), F.struct(F.lit("b<").alias("text"), F.lit("t").alias("tag")), F.struct(F.lit(",").alias("text"), F.lit("").alias("tag")))
    text = _one(spark, A.segments_to_text(items))
    assert text.text == "a b<," and [tuple(x) for x in text.label] == [(2, 4, "t")]
    assert _one(spark, A.marked_html(items)) == 'a <mark class="t">b&lt;</mark> ,'


def test_chapters_are_found_under_any_label(spark, tmp_path):
    """Labels are missing or wrong in places: every text counts, whatever its label."""
    from leafloom.plans.further_queries import proj_p07_complete
    from leafloom.plans.text_queries import ext_l04_chapters

    text = "Показания к применению\nболь\nПротивопоказания\nаллергия"
    rows = [(1, text, "ru"), (2, text, None), (3, text, "bg"), (4, "plain words", "en"), (5, None, "ru")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.found_count for r in ext_l04_chapters(spark, str(tmp_path)).collect()}
    assert sorted(found) == [1, 2, 3, 4] and found[1] == found[2] == found[3] > 0 == found[4]
    assert sum(r.n for r in proj_p07_complete(spark, str(tmp_path)).collect()) == 4


def test_brackets_of_any_depth(spark):
    deep = "a" + "(" * 40 + "x" + ")" * 40 + "b"
    mixed = "a" + "([{" * 30 + "x" + ")]}" * 30 + "b"
    assert _one(spark, T.remove_brackets_deep(F.col("t")), deep) == "ab" and _one(spark, T.remove_matched_brackets(F.col("t")), deep) == "ab"
    assert _one(spark, T.remove_brackets_deep(F.col("t")), mixed) == "ab"
    for text, want in (("a)b(c)d", "abd"), ("a(b[c)d]e", "ae"), ("a(b(c)d", "a"), ("]]a", "a"), ("", ""), ("none", "none")):
        assert _one(spark, T.remove_brackets_deep(F.col("t")), text) == want
    assert _one(spark, T.remove_matched_brackets(F.col("t")), None) is None


def test_letters_of_wide_joined_and_accented_forms(spark):
    assert _one(spark, T.letters_only(F.col("t")), "Éﬁ ｗＩ-де ё й 1") == "efiwiдееи"


def test_lemmas_from_a_table_and_their_corrections(spark):
    from leafloom.operators import relational as R

    words = spark.createDataFrame([(w,) for w in ("тошнота", "тошноты", "тошноты", "зуд", None, "болью", "боль")], "word string")
    lemmas = R.induced_lemmas(words)
    assert {r.word: r.lemma for r in lemmas.collect()} == {"тошнота": "тошноты", "тошноты": "тошноты", "зуд": "зуд", "болью": "боль", "боль": "боль"}
    table = spark.createDataFrame([("капли", "капля"), ("отеки", "отечь")], "word string, lemma string")
    rows = spark.createDataFrame([(1, "Отеки, капли!"), (2, ""), (3, None), (4, "отеки, капли!")], "id int, text string")
    assert {r.id: r.lemmas for r in R.lemmatized(rows, "id", "text", table).collect()} == {1: "отёк , капля !", 2: "", 3: None, 4: "отёк , капля !"}
    assert _one(spark, T.lemmatize(F.col("t"), {"отеки": "отечь"}), "Отеки") == "отёк"
