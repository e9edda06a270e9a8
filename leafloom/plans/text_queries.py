"""Queries of the text functions over whole texts; results are compared by hash and length."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.common import spread, table
from leafloom.functions import text as T
from leafloom.functions.lemmas import LEMMA_CORRECTIONS
from leafloom.functions.rules import S, W, apply_sql, quote, strip, strip_sql
from leafloom.operators import annotation, extraction
from leafloom.operators import relational as R
from leafloom.sources.writers import escape_xml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _on_documents(name: str, fn: Callable[[Column], Column], sql: Callable[[str], str] | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(table(spark, sf_dir, "documents").filter("text IS NOT NULL")).select("doc_id", fn(F.col("text")).alias("v"))
        return rows.select("doc_id", F.md5(F.coalesce("v", F.lit(""))).alias("text_md5"), F.length("v").cast("bigint").alias("n_chars"))

    QUERIES[name] = query
    if sql:
        SQL[name] = f"SELECT doc_id, md5(coalesce(v, '')) AS text_md5, length(v) AS n_chars FROM (SELECT doc_id, {sql('text')} AS v FROM documents WHERE text IS NOT NULL)"


def _entities(expression: str, back: bool = False) -> str:
    for entity, name in T.ENTITIES.items():
        a, b = (name, entity) if back else (entity, name)
        expression = f"replace({expression}, '{a}', '{b}')"
    return expression


def _long_lines(expression: str) -> str:
    return f"array_to_string(list_filter(string_split({expression}, chr(10)), lambda x: length({strip_sql('x')}) >= 5), chr(10))"


def _clear(expression: str) -> str:
    return _long_lines(apply_sql(expression, T.CHAPTER + T.PLAIN_BRACKETS + T.CHAPTER_END + T.CHAPTER_DASHES))


def _fix(expression: str) -> str:
    for wrong, right in T.TERM_SPELLINGS.items():
        expression = f"replace({expression}, '{wrong}', '{right}')"
    return apply_sql(expression, T.TERM_RULES)


def _letters_sql(expression: str) -> str:
    """Letters left of the compatibility decomposition: one for one by a table, the joined forms by replacement."""
    one, several = {}, {}
    for code in [*range(0xA0, 0x3100), *range(0xA640, 0xA800), *range(0xFB00, 0xFB50), *range(0xFE30, 0xFFF0)]:
        if (plain := "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c.isalpha())) != chr(code):
            if len(plain) > 1:
                several[chr(code)] = plain
            elif plain:
                one[chr(code)] = plain
    for joined, plain in several.items():
        if 0xFB00 <= ord(joined) < 0xFB07 or ord(joined) in (0x2116, 0x2122, 0x1C4, 0x132):
            expression = f"replace({expression}, '{joined}', '{plain}')"
    return f"lower(regexp_replace(translate({expression}, '{''.join(one)}', '{''.join(one.values())}'), '[^\\p{{L}}]', '', 'g'))"


def _dosage(expression: str) -> str:
    return f"string_split(replace({strip_sql(apply_sql(f'lower({expression})', T.DOSAGE))}, 'ё', 'е'), 'с ароматом')[1]"


_on_documents("fn_x01_normalize_text", T.normalize_text, lambda e: apply_sql(e, T.TIDY + T.TERMS + T.AT_MOST))
_on_documents("fn_x02_normalize_text_lemma", lambda c: T.normalize_text(c, False), lambda e: apply_sql(e, T.TIDY + T.AT_MOST))
_on_documents("fn_x03_protect_entities", lambda c: T.protect_entities(escape_xml(c)), lambda e: _entities(f"replace(replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"))
_on_documents("fn_x06_remove_brackets", T.remove_brackets, lambda e: apply_sql(e, T.PLAIN_BRACKETS))
_on_documents("fn_x07_remove_brackets_deep", T.remove_brackets_deep, None)
_on_documents("fn_x08_remove_matched_brackets", T.remove_matched_brackets, None)
_on_documents("fn_x09_remove_unmatched_brackets", T.remove_unmatched_brackets, lambda e: apply_sql(e, T.UNMATCHED))
_on_documents("fn_x10_remove_parentheses", T.remove_parentheses, lambda e: "nullif(" + strip_sql(apply_sql(e, [(r"\([^)]*\)", "")])) + ", '')")
_on_documents("fn_x16_clear_text", T.clear_text, _clear)
_on_documents("fn_x16b_clear_text_with_brackets", lambda c: T.clear_text(c, False), lambda e: _long_lines(apply_sql(e, T.CHAPTER + T.CHAPTER_END)))
_on_documents("fn_x19_fix_terms", T.fix_terms, _fix)
_on_documents("fn_x20_join_broken_lines", T.join_broken_lines, lambda e: f"replace(array_to_string(list_transform(string_split({e}, chr(10)), lambda x: {strip_sql('x')}), chr(10)), '-' || chr(10), '')")
_on_documents("fn_x21_dosage_form", T.dosage_form, _dosage)
_on_documents("fn_x25_letters_only", T.letters_only, _letters_sql)
_on_documents("fn_x26_ascii_only", T.ascii_only, lambda e: apply_sql(e, [(r"[^\x00-\x7F]+", "")]))
_on_documents("fn_x37_content_hash", lambda c: F.sha2(c, 256), lambda e: f"sha256({e})")
_on_documents("fn_x38_bullets", T.bullets, lambda e: strip_sql(apply_sql(e, T.BULLETS)))

_STOPS = ["передозиров", "overdos", "überdosierung"]


def _truncate(e: str) -> str:
    at = ", ".join(f"nullif(strpos(lower({e}), '{k}'), 0)" for k in _STOPS)
    return strip_sql(f"CASE WHEN list_min([{at}]) IS NULL THEN {e} ELSE substring({e}, 1, list_min([{at}]) - 1) END")


_on_documents("fn_x17_truncate_after", lambda c: T.truncate_after(c, _STOPS), _truncate)

# ---- functions whose results are lists or numbers


def fn_x13_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").filter("text IS NOT NULL")).select("doc_id", T.numbers(F.col("text")).alias("v"))
    return rows.select("doc_id", F.size("v").cast("bigint").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


def fn_x14_minerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").filter("text IS NOT NULL"))
    salted = F.concat_ws(" ", "text", F.element_at(F.array(F.lit("соли калия"), F.lit("железо и медь")), (F.col("doc_id") % 2 + 1).cast("int")))
    return rows.select("doc_id", F.array_join(T.minerals(salted), ",").alias("minerals"))


def _minerals_sql() -> str:
    salted = "text || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'соли калия' ELSE 'железо и медь' END"
    cleaned = f"regexp_replace(lower({salted}), '\\([^)]*\\)', '', 'g')"
    named = ", ".join(f"CASE WHEN regexp_matches({cleaned}, '(^|[^{W}])({stem})($|[^{W}])') THEN '{name}' END" for name, stem in T.MINERALS.items())
    return f"SELECT doc_id, array_to_string(list_sort(list_filter([{named}], lambda x: x IS NOT NULL)), ',') AS minerals FROM documents WHERE text IS NOT NULL"


def fn_x22_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "side_effects").select("id", F.array_join(T.list_items(F.col("effect")), "|").alias("items"))


def fn_x23_label_and_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels "name (tag)" of edge ends taken apart again."""
    ends = table(spark, sf_dir, "edge_list").filter("source IS NOT NULL").select(F.concat("source", F.lit(" ("), F.coalesce("source_tag", F.lit("")), F.lit(")")).alias("label"))
    return ends.distinct().select("label", T.label_and_tag(F.col("label")).alias("s")).select("label", "s.name", "s.tag")


def fn_x39_split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "side_effects").filter("effect IS NOT NULL").select("id", F.array_join(T.split_items(F.concat("effect", F.lit("; доза 2,5 мг"))), "|").alias("items"))


def fn_x42_word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "effect_terms").select("term_id", F.split("term", " ").alias("w"))
    return words.select("term_id", F.inline(T.word_ngrams(F.col("w"))))


def fn_a21_sorted_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "drugs").select("id", T.sorted_key(F.lower("drug")).alias("name_key"))


def fn_x27_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines "name (p%, n ADRs)" and "name (n)" built from the reports and read back."""
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    group = T.group_line(F.concat("event_type", F.lit(" ("), (F.col("n") % 100).cast("string"), F.lit("%, "), F.col("n").cast("string"), F.lit(" ADRs)")))
    effect = T.effect_line(F.concat("event_type", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    return per.select(group.alias("g"), effect.alias("e")).select("g.name", "g.percent", "g.cases", F.col("e.cases").alias("effect_cases"))


def fn_x18_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document (also a count of sentences)."""
    rows = spread(table(spark, sf_dir, "documents").filter("text IS NOT NULL")).select("doc_id", T.sentences(F.col("text"), parentheses=True).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("text_md5"))


def fn_x35_capped_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps over pairs of synonyms and terms of one section's first words."""
    s = table(spark, sf_dir, "synonyms")
    pairs = s.select(F.concat(F.lit("бета1 "), "canonical").alias("a"), F.concat(F.lit("бета2 блокатор "), "variant").alias("b"))
    return pairs.select("a", "b", T.capped_similarity(F.col("a"), F.col("b"), F.lit(0.99)).alias("sim"))


def fn_x03b_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects cleaned and expanded by the dictionary of accepted names."""
    forms = {r.variant: r.canonical for r in table(spark, sf_dir, "synonyms").collect()}  # a fixed list of 86 rows
    return table(spark, sf_dir, "side_effects").filter("effect IS NOT NULL").select("id", T.clean_term(F.col("effect"), forms).alias("term"))


def fn_x04_lemmatize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by a dictionary of lemmas; here the words of the reference terms cut to their stems."""
    lemmas = {w: w[:-1] for r in table(spark, sf_dir, "effect_terms").select("term").collect() for w in r.term.split() if len(w) > 4}  # a fixed list of 600 rows
    return table(spark, sf_dir, "side_effects").filter("effect IS NOT NULL").select("id", T.lemmatize(F.col("effect"), lemmas).alias("lemmas"))


def fn_x40_detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects cut into tokens and put together again."""
    return table(spark, sf_dir, "side_effects").filter("effect IS NOT NULL").select("id", T.detokenize(T.tokens(F.col("effect"))).alias("text"))


def ext_l01_side_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaflets assembled from all records of each drug and taken apart again; effects stand as letters of their digest."""
    rows = table(spark, sf_dir, "side_effects").filter("drug IS NOT NULL AND section IS NOT NULL AND effect IS NOT NULL").select("drug", strip(F.col("section")).alias("section"), strip(F.replace(F.lower("freq"), F.lit(":"), F.lit(""))).alias("freq"), F.translate(F.md5("effect"), "0123456789", "ghijklmnop").alias("effect"))
    rows = rows.filter(F.col("freq").isin(extraction.FREQUENCY_WORDS))
    classes = [r.section for r in rows.select("section").distinct().collect()]  # the organ classes: a list
    per = rows.groupBy("drug", "section", "freq").agg(F.array_join(F.array_sort(F.collect_set("effect")), ", ").alias("e"))
    blocks = per.groupBy("drug", "section").agg(F.array_join(F.array_sort(F.collect_list(F.concat("freq", F.lit(": "), "e"))), "; ").alias("b"))
    leaflets = blocks.groupBy("drug").agg(F.array_join(F.array_sort(F.collect_list(F.concat("section", F.lit("\n"), "b"))), "\n").alias("text"))
    return extraction.side_effect_rows(leaflets, "text", classes, ["drug"]).select("drug", "section", "freq", "ord", "effect")


def ext_l03_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven sections of every leaflet text, and how many documents have each."""
    out = extraction.sections(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", ["doc_id"])
    return R.coverage(out, list(extraction.SECTIONS))


def ext_l04_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").filter("text IS NOT NULL")).select("doc_id", extraction.chapters(F.col("text")).alias("c"))
    return docs.select("doc_id", F.inline(F.array(extraction.chapter_stats(F.col("c"))))).select("doc_id", "found_count", "not_found_count", F.array_join("not_found_list", "|").alias("missing"))


def ext_l05_contraindications(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").filter("text IS NOT NULL")).select("doc_id", extraction.contraindications(F.col("text")).alias("c"))
    return docs.select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "|")).alias("items_md5"))


def ext_l14_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").filter("text IS NOT NULL")).select("doc_id", extraction.elimination_periods(F.col("text")).alias("e"), extraction.protein_binding(F.col("text")).alias("p"))
    return docs.select("doc_id", F.size("e").alias("n_elimination"), F.size("p").alias("n_binding"))


def ext_l13_drug_effect_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "side_effects").select("drug", "effect", "freq", F.struct("ord", "id").alias("ord"))
    return extraction.drug_effect_freq(rows)


def ext_l16_loader_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As for the star: first by order wins, no post-marketing class, no rows without frequency."""
    rows = table(spark, sf_dir, "side_effects").select("drug", "effect", "freq", F.struct("ord", "id").alias("ord"))
    return extraction.drug_effect_freq(rows, last_wins=False, skip=["пострегистрационный период"], need_freq=True)


def ext_f01_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = annotation.document_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return toks.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.length("token")).alias("n_token_chars"), F.max("token_end").alias("last_end"))


def _freq_sql(pick: str, where: str = "") -> str:
    order = "(ord, id, coalesce(freq, 'Частота неизвестна'))"
    return f"""SELECT drug, effect, {pick}(freq, o) AS freq FROM (
      SELECT array_to_string(list_sort(string_split(lower(drug), '+')), '+') AS drug, lower(effect) AS effect, coalesce(freq, 'Частота неизвестна') AS freq, {order} AS o
      FROM side_effects WHERE drug IS NOT NULL AND effect IS NOT NULL {where}) GROUP BY drug, effect"""


_ITEMS = f"regexp_replace({strip_sql('lower(coalesce(effect, chr(32)))')}, '[{S}]+', ' ', 'g')"
for _name, _fn in list(globals().items()):
    if _name.startswith(("fn_", "ext_")) and callable(_fn):
        QUERIES[_name] = _fn
_BRACKETS = r"[\[\](){}]"
SQL |= {
    # a walk over the brackets: the text after one is kept unless the depth falls below its own later on
    "fn_x07_remove_brackets_deep": rf"""WITH p AS (SELECT doc_id, unnest(list_concat([''], regexp_extract_all(text, '{_BRACKETS}'))) AS sign, unnest(string_split_regex(text, '{_BRACKETS}')) AS piece, unnest(range(len(regexp_extract_all(text, '{_BRACKETS}')) + 1)) AS i FROM documents WHERE text IS NOT NULL),
  s AS (SELECT *, sum(CASE WHEN sign = '' THEN 0 WHEN sign IN ('(', '[', '{{') THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM p),
  d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM s),
  f AS (SELECT *, lag(depth, 1, 0) OVER w AS before, min(depth) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  k AS (SELECT doc_id, string_agg(CASE WHEN sign IN ('(', '[', '{{') AND later < depth OR sign IN (')', ']', '}}') AND before > 0 THEN '' ELSE sign END || CASE WHEN later < depth THEN '' ELSE piece END, '' ORDER BY i) AS t FROM f GROUP BY 1),
  v AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?s)[\[({{].*$', ''), '[\])}}]', '', 'g') AS v FROM k)
SELECT doc_id, md5(v) AS text_md5, length(v) AS n_chars FROM v""",
    "fn_x08_remove_matched_brackets": f"""WITH RECURSIVE r(doc_id, t, n) AS (SELECT doc_id, text, 0 FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, regexp_replace(t, '{T.INNERMOST}', '', 'g'), n + 1 FROM r WHERE regexp_matches(t, '{T.INNERMOST}'))
SELECT doc_id, md5(arg_max(t, n)) AS text_md5, length(arg_max(t, n)) AS n_chars FROM r GROUP BY 1""",
    "fn_x13_numbers": r"SELECT doc_id, len(v) AS n, round(coalesce(list_sum(v), 0), 3) AS total FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '\d+\.?\d*'), lambda x: CAST(x AS DOUBLE)) AS v FROM documents WHERE text IS NOT NULL)",
    "fn_x14_minerals": _minerals_sql(),
    "fn_x22_list_items": f"SELECT id, CASE WHEN {_ITEMS} IN ('', '-') THEN '' ELSE array_to_string(list_filter(list_transform(string_split({_ITEMS}, ';'), lambda x: {strip_sql('x')}), lambda x: x <> ''), '|') END AS items FROM side_effects",
    "fn_x23_label_and_tag": "SELECT DISTINCT source || ' (' || coalesce(source_tag, '') || ')' AS label, CASE WHEN coalesce(source_tag, '') <> '' THEN regexp_replace(source, '[\\s\\p{Z}]+$', '') END AS name, nullif(coalesce(source_tag, ''), '') AS tag FROM edge_list WHERE source IS NOT NULL",
    "fn_x39_split_items": rf"SELECT id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(effect || '; доза 2,5 мг', '(\d)[{S}]*,[{S}]*(\d)', '\1__COMMA__\2', 'g'), '[;:.,]'), lambda x: {strip_sql('replace(x, ' + chr(39) + '__COMMA__' + chr(39) + ', ' + chr(39) + ',' + chr(39) + ')')}), lambda x: x <> ''), '|') AS items FROM side_effects WHERE effect IS NOT NULL",
    "fn_x42_word_ngrams": "SELECT term_id, CAST(i AS INT) AS first, CAST(j AS INT) AS last, array_to_string(w[i + 1:j], ' ') AS phrase FROM (SELECT term_id, string_split(term, ' ') AS w FROM effect_terms), range(0, 9) a(i), range(1, 10) b(j) WHERE i < j AND j <= len(w)",
    "fn_a21_sorted_key": "SELECT id, array_to_string(list_sort(string_split(lower(drug), '+')), '+') AS name_key FROM drugs",
    "fn_x27_report_lines": "SELECT event_type AS name, CAST(n % 100 AS INT) AS percent, n AS cases, n AS effect_cases FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)",
    "ext_l13_drug_effect_freq": _freq_sql("arg_max"),
    "ext_l16_loader_rows": _freq_sql("arg_min", "AND freq IS NOT NULL AND lower(freq) <> 'пострегистрационный период'"),
    "ext_f01_tokens": r"SELECT doc_id, len(t) AS n_tokens, list_sum(list_transform(t, lambda x: length(x))) AS n_token_chars, length(regexp_replace(text, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$', '')) AS last_end FROM (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]') AS t FROM documents) WHERE len(t) > 0",
}


def _sentences_sql(expression: str, parentheses: bool, shaped: bool) -> str:
    """The same rules for the other engine, which knows no lookahead: the sign after the break is taken and put back."""
    end = T.SENTENCE_END.replace("(?=", "(").replace("])", "])", 1)
    clean = apply_sql(expression, ([(r"\(.*?\)", "")] if parentheses else []) + T.SENTENCE_TRASH)
    # twice, since a sign that was taken can begin the next break
    broken = apply_sql(clean, [(end, "$1\n$2"), (end, "$1\n$2")] + T.SENTENCE_BREAKS)
    lines = f"string_split({broken}, chr(10))"
    return f"list_filter({lines}, lambda x: regexp_matches(x, '[.;:]$') AND NOT regexp_matches(x, '^[{S}]*[^{S}]+\\.[{S}]*$'))" if shaped else lines


def _section_sql(name: str, text: str = "text") -> str:
    start, end, flat = extraction.SECTIONS[name]
    pattern = rf"(?s)(?:\n|^)(?:{start})(?:[{S}]*[.:][{S}]*)?(.*?)(?:{end})".replace("(?=", "(?:").replace("'", "''")
    body = strip_sql(f"regexp_extract({text}, '{pattern}', 1)")
    return f"regexp_replace({body}, '[{S}]+', ' ', 'g')" if flat else body


def _sets_sql(low: str) -> dict[str, str]:
    """Sets of a term in lower case, as lists without repeats."""
    held = lambda table: "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains({low}, '{k}') THEN '{v}' END" for k, v in table.items()) + "], lambda z: z IS NOT NULL)))"
    return {"greek": held(T.GREEK), "cyp": f"list_sort(list_distinct(regexp_extract_all({low}, 'cyp(\\d+[a-z]+\\d+)', 1)))", "electrolytes": held({e: e for e in T.ELECTROLYTES})}


def _capped_sql(a: str, b: str) -> str:
    x, y = _sets_sql(f"lower({a})"), _sets_sql(f"lower({b})")
    differ = lambda k: f"len({x[k]}) > 0 AND len({y[k]}) > 0 AND {x[k]} <> {y[k]}"
    has = lambda c, p: f"regexp_matches(lower({c}), '{p}')"
    crossed = f"({has(a, 'бета1|beta1')} AND {has(b, 'бета2|beta2')} OR {has(a, 'бета2|beta2')} AND {has(b, 'бета1|beta1')})"
    blocker = f"({has(a, 'блокатор|антагонист|ингибитор')} OR {has(b, 'блокатор|антагонист|ингибитор')})"
    return f"CASE WHEN {differ('greek')} THEN 0.88 WHEN {differ('cyp')} THEN 0.85 WHEN {differ('electrolytes')} THEN 0.83 WHEN {crossed} AND {blocker} THEN 0.80 WHEN {crossed} THEN 0.84 ELSE 0.99 END"


_PHARMACO = "CASE WHEN strpos(text, 'Фармакокинетика') > 0 THEN substr(text, strpos(text, 'Фармакокинетика')) ELSE text END"
_MATCHES = lambda patterns: " AND ".join(f"regexp_matches(x, '{p.replace('(?iu)', '(?i)')}')" for p in patterns)
SQL |= {
    "fn_x18_sentences": f"SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, md5(array_to_string(s, chr(10))) AS text_md5 FROM (SELECT doc_id, {_sentences_sql('text', True, True)} AS s FROM documents WHERE text IS NOT NULL)",
    "fn_x35_capped_similarity": f"SELECT a, b, CAST({_capped_sql('a', 'b')} AS DOUBLE) AS sim FROM (SELECT 'бета1 ' || canonical AS a, 'бета2 блокатор ' || variant AS b FROM synonyms)",
    "fn_x40_detokenize": r"""SELECT id, CASE WHEN len(t) = 0 THEN '' ELSE list_reduce(t, lambda a, x: CASE WHEN a = '' THEN x WHEN regexp_matches(x, '^[.,;:!?)\]}»%]') OR regexp_matches(a, '[(\[{«]$') THEN a || x ELSE a || ' ' || x END) END AS text FROM (SELECT id, regexp_extract_all(effect, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]') AS t FROM side_effects WHERE effect IS NOT NULL)""",
    "ext_l03_sections": "WITH x AS (SELECT " + ", ".join(f"{_section_sql(n)} AS {n}_" for n in extraction.SECTIONS) + " FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS field, count(nullif({n}_, '')) AS present, count(*) - count(nullif({n}_, '')) AS missing FROM x" for n in extraction.SECTIONS),
    "ext_l14_elimination": f"SELECT doc_id, CAST(len(list_filter(s, lambda x: {_MATCHES(R.ELIMINATION)})) AS INT) AS n_elimination, CAST(len(list_filter(s, lambda x: {_MATCHES(R.PROTEIN_BINDING)})) AS INT) AS n_binding FROM (SELECT doc_id, {_sentences_sql(_PHARMACO, False, True)} AS s FROM documents WHERE text IS NOT NULL)",
    "ext_l02_chapter": "SELECT doc_id, CAST(length(nullif(x, '')) AS INT) AS n_chars FROM (SELECT doc_id, " + _clear(_section_sql("text_side_e", "chr(10) || 'Побочное действие' || chr(10) || text || chr(10) || 'Передозировка'")) + " AS x FROM documents WHERE text IS NOT NULL)",
}


def _chapters_sql() -> str:
    """(doc_id, found, missing): headers that stand in a text by themselves, numbered or not."""
    expected = [c for c in extraction.CHAPTERS if c not in extraction.TRASH_CHAPTERS]
    said = lambda c: "|".join(extraction._flexible(n.lower()) for n in [c, *extraction.CHAPTERS[c]])
    hits = ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^{W}])([{S}]*(\\d+(\\.\\d+)*)[{S}]*)?({said(c)})($|[^{W}])') THEN '{c}' END" for c in expected)
    names = "[" + ", ".join(f"'{c}'" for c in expected) + "]"
    return f"SELECT doc_id, found, list_filter({names}, lambda x: NOT list_contains(found, x)) AS missing FROM (SELECT doc_id, list_filter([{hits}], lambda x: x IS NOT NULL) AS found FROM documents WHERE text IS NOT NULL)"


SQL["ext_l04_chapters"] = f"SELECT doc_id, CAST(len(found) AS INT) AS found_count, CAST(len(missing) AS INT) AS not_found_count, array_to_string(missing, '|') AS missing FROM ({_chapters_sql()})"
SQL["proj_p07_complete"] = f"SELECT len(found) = 13 OR len(found) = 12 AND missing = ['Фармакокинетические свойства'] AS kept, count(*) AS n FROM ({_chapters_sql()}) WHERE len(missing) BETWEEN 1 AND 13 GROUP BY 1"


def _contraindications_sql() -> str:
    """Steps of the extractor over lists, after all pairs of brackets are taken out."""
    stems = " OR ".join(f"contains(lower(x), '{stem.lower()}')" for stem in R.STOP_STEMS)
    part = rf"string_split_regex({strip_sql(apply_sql('t', T.BULLETS))}, '\n-|;[{S}]*-|:[{S}]*-|;\n')"
    kept = rf"regexp_replace(x, '(\d)[{S}]*,[{S}]*(\d)', '\1__COMMA__\2', 'g')"
    item = strip_sql("replace(y, '__COMMA__', ',')")
    tidy = strip_sql(apply_sql("x", T.UNMATCHED + [(rf"^[^\p{{L}}\p{{N}}_{S}()]+", ""), (rf"[^\p{{L}}\p{{N}}_{S}()]+$", "")]))
    return f"""WITH RECURSIVE r(doc_id, t, n) AS (SELECT doc_id, text, 0 FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, regexp_replace(t, '{T.INNERMOST}', '', 'g'), n + 1 FROM r WHERE regexp_matches(t, '{T.INNERMOST}')),
  a AS (SELECT doc_id, arg_max(t, n) AS t FROM r GROUP BY 1),
  f AS (SELECT doc_id, list_filter(list_transform({part}, lambda x: {strip_sql(f"regexp_replace(x, '[{S}]+', ' ', 'g')")}), lambda x: x <> '') AS fs FROM a),
  b AS (SELECT doc_id, list_filter(flatten(list_transform(fs, lambda x: {_sentences_sql('x', False, False)})), lambda x: x <> '' AND NOT ({stems})) AS ss FROM f),
  i AS (SELECT doc_id, flatten(list_transform(ss, lambda x: list_filter(list_transform(string_split_regex({kept}, '[;:.,]'), lambda y: {item}), lambda y: y <> ''))) AS xs FROM b),
  k AS (SELECT doc_id, list_filter(list_transform(xs, lambda x: {tidy}), lambda x: x <> '' AND NOT ({stems}) AND length(x) <= 60) AS xs FROM i),
  u AS (SELECT doc_id, list_filter(xs, lambda x, j: list_position(xs, x) = j) AS xs FROM k)
SELECT doc_id, CAST(len(xs) AS INT) AS n, md5(array_to_string(xs, '|')) AS items_md5 FROM u"""


def _lemmas_sql() -> str:
    fixed = "CASE w " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in LEMMA_CORRECTIONS.items()) + " ELSE w END"
    tokens = r"regexp_extract_all(effect, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]')"
    joined = apply_sql("t", T.TIDY + T.AT_MOST)
    return f"""WITH m AS (SELECT DISTINCT w AS word, substr(w, 1, length(w) - 1) AS lemma FROM (SELECT unnest(string_split_regex(term, '[{S}]+')) AS w FROM effect_terms) WHERE length(w) > 4),
  e AS (SELECT id, lower(unnest({tokens})) AS word, unnest(range(len({tokens}))) AS i FROM side_effects WHERE effect IS NOT NULL), l AS (SELECT id, i, coalesce(lemma, e.word) AS w FROM e LEFT JOIN m USING (word)),
  j AS (SELECT id, string_agg({fixed}, ' ' ORDER BY i) AS t FROM l GROUP BY 1)
SELECT id, coalesce({joined}, effect) AS lemmas FROM (SELECT id, effect, CASE WHEN effect = '' THEN '' ELSE coalesce(t, '') END AS t FROM side_effects LEFT JOIN j USING (id) WHERE effect IS NOT NULL)"""


_FREQ = strip_sql("replace(lower(freq), ':', '')")
SQL |= {
    "ext_l01_side_effects": f"WITH n AS (SELECT DISTINCT drug, {strip_sql('section')} AS section, {_FREQ} AS freq, translate(md5(effect), '0123456789', 'ghijklmnop') AS effect FROM side_effects WHERE drug IS NOT NULL AND section IS NOT NULL AND effect IS NOT NULL) SELECT drug, section, freq, CAST(row_number() OVER (PARTITION BY drug, section, freq ORDER BY effect) - 1 AS INT) AS ord, effect FROM n WHERE freq IN ({', '.join(map(quote, extraction.FREQUENCY_WORDS))})",
    "ext_l05_contraindications": _contraindications_sql(),
    "fn_x04_lemmatize": _lemmas_sql(),
}
#: The accepted names one after the other, the longest first; a letter beside a name keeps it as it is.
SQL["fn_x03b_abbreviations"] = rf"""WITH RECURSIVE f AS (SELECT row_number() OVER (ORDER BY length(variant) DESC, variant) AS no, '(?i)(^|[^a-zA-Zа-яА-Я])' || regexp_escape(variant) || '($|[^a-zA-Zа-яА-Я])' AS p, '\1' || replace(canonical, '\', '\\') || '\2' AS c FROM synonyms),
  r(id, t, no) AS (SELECT id, {strip_sql("regexp_replace(lower(effect), '\\([^)]*\\)', '', 'g')")}, CAST(0 AS BIGINT) FROM side_effects WHERE effect IS NOT NULL UNION ALL SELECT id, regexp_replace(t, p, c, 'g'), f.no FROM r JOIN f ON f.no = r.no + 1)
SELECT id, arg_max(t, no) AS term FROM r GROUP BY 1"""
