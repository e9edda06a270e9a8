"""Scalar text functions: normalisation, brackets, terms, parsers. Every function takes and returns columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafloom.functions.lemmas import LEMMA_CORRECTIONS
from leafloom.functions.rules import S, W, Rules, apply, strip

#: Spacing rules of leaflet text, in order.
TIDY: Rules = [
    (" +,", ","), (r" +\.", "."), (" +:", ":"), (" +;", ";"), (" -", "-"), ("- ", "-"), (r" \+ ", "+"), (r" +\)", ")"), (r"\( +", "("), (r",\.", "."), ("\n\n+", "\n"),
    (rf"\[[{S}]+", "["), (rf"[{S}]+\]", "]"), (rf"«[{S}]+", "«"), (rf"[{S}]+»", "»"), (rf"[{S}]*/[{S}]*", "/"),
]
#: Pharmacokinetic terms broken by a space, Latin or Cyrillic initial.
TERMS: Rules = [(rf"[TТ][{S}]+1/2", "T1/2"), (rf"[CС][{S}]+max", "Cmax")]
AT_MOST: Rules = [("≤ +", "≤")]
#: HTML entities and their stand-ins.
ENTITIES = {"&gt;": "__GT__", "&lt;": "__LT__", "&amp;": "__AMP__", "&quot;": "__QUOT__", "&apos;": "__APOS__"}
#: Bracket rules.
PLAIN_BRACKETS: Rules = [(r"(?s)\(.*?\)", ""), (r"(?s)\[.*?\]", ""), (r"(?s)\{.*?\}", "")]
INNERMOST = r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}"
UNMATCHED: Rules = [(r"\([^)]*$", ""), (r"\[[^\]]*$", ""), (r"\{[^}]*$", ""), (r"^[^(]*\)", ""), (r"^[^\[]*\]", ""), (r"^[^{]*\}", ""), (r"[()\[\]{}]", "")]
#: Cleaning of a chapter of side effects; the last part works on lines.
CHAPTER: Rules = [("\r\n", " "), (" ", " "), ("ё", "е"), (r"\(см\.[^)]*\)", "")]
CHAPTER_END: Rules = [("[*§]", ""), (rf"[{S}]*/[{S}]*", "/"), (rf"[{S}]*:[{S}]*", ":"), (rf",[{S}]*$", ""), (r"[ \t\f\r\x0B\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+", " ")]
CHAPTER_DASHES: Rules = [("‑", "-"), (rf"[{S}]*-[{S}]*", "-")]
#: Spellings of pharmacokinetic terms, wrong to right.
TERM_SPELLINGS = {"Тmax": "Tmax", "Тmin": "Tmin", "Сmax": "Cmax", "Сmin": "Cmin", "Сss": "Css", "Т1/2": "T1/2", "Т½": "T1/2", "Стах": "Cmax", "Cмах": "Cmax"}
#: Mixed spellings, page numbers and references to sections.
TERM_RULES: Rules = [
    ("(?i)[ТтTt] ?max", "Tmax"), ("(?i)[СсCc] ?max", "Cmax"), ("(?i)[СсCc] ?min", "Cmin"), ("(?i)[ТтTt] ?min", "Tmin"), ("[ТтTt] ?(1/2|½)", "T1/2"),
    (rf"[Сс]([Тт][Рр]?|\.)[{S}]*\d+([{S}]*[Ии][Зз][{S}]*\d+)?", ""),
    (rf"\([Сс][Мм]\.[{S}]*([Пп][Оо][Дд])?[Рр][Аа][Зз][Дд][Ее][Лл][а-яА-Я]*[{S}]*[^)]*\)", ""),
    (rf"[Сс][Мм]\.([{S}]+[Тт][Аа][Кк][Жж][Ее])?([{S}]*([Пп][Оо][Дд])?[Рр][Аа][Зз][Дд][Ее][Лл][а-яА-Я]*)?[{S}]*«[^»]{{0,80}}»", ""),
    (rf"\(см\.[{S}][^)]{{0,78}}\)", ""),
]
#: Dosage units; what follows an aroma is cut.
DOSAGE: Rules = [(rf"\d+(?:\.\d+)?(?:[{S}]*(?:мг|мл|г|%|мкг|ед)/?[{S}]*(?:мг|мл|г|%|мкг|ед)?)", ""), (r"\([^)]*\)", ""), (rf"[^{W}{S}]", ""), (rf"[{S}]+", " ")]
#: Dashes and bullets.
BULLETS: Rules = [("[–•]", "-"), ("[-–−—]+", "-"), (rf"[{S}]*;", ";"), (rf"[{S}]*\n[{S}]*", "\n")]
#: Tables and references that are dropped before sentences are split.
SENTENCE_TRASH: Rules = [
    (r"(?m)^Таблица.*\d+$", ""), (r"(?m)^RxList\.com.*$", ""), (r",? показаны в таблице \d+", ""), (r"представлен(?:а|о|ы)? в таблице \d+", ""),
    (r"приведен(?:а|о|ы)? в таблице \d+", ""), (rf"\((см\.[{S}]*раздел.*?)\)", ""), (r"Результаты представлены в таблице \d+.", ""),
    (" +,", ","), (r" +\.", "."), (" +:", ":"), (" +;", ";"), (r",\.", "."), (" +", " "), (r"в т\. ч\.", "в т.ч."),
]
#: A sentence ends at its sign before a space and an upper-case letter, a digit or an opening quote.
SENTENCE_END = rf"([.!?…][»”\")]?)[{S}]+(?=[\p{{Lu}}\p{{N}}«„“\"])"
#: Further breaks after abbreviations.
SENTENCE_BREAKS: Rules = [("\n\n+", "\n"), ("\n,", ","), (r" ч\. ", " ч.\n"), (r"/ч\. ", "/ч.\n"), (r" тел\. ", " тел.\n"), (r" с\. ", " с.\n")]
#: Stems by mineral.
MINERALS = {
    "калий": "кали[еиьяюймо]м?", "магний": "магни[еиьяюймо]м?", "натрий": "натри[еиьяюймо]м?", "кальций": "кальц[иеиьяюймо]м?", "железо": "желез[аоиью]м?",
    "цинк": "цинк[аеуом]?", "медь": "медь|меди|медью", "селен": "селен[аеуом]?", "марганец": "марган[еиьяюйцеом]м?", "хром": "хром[аеуом]?",
}
#: Headers of the pharmacotherapeutic group and the ATC code.
ATC_HEADER = rf"(?:[Кк][Оо][Дд])[{S}]+[АAаa][ТTтt][ХXхx]:"
MECHANISM = rf"Механизм[{S}]+действия(?:[{S}]+и[{S}]+фармакодинамические[{S}]+(?:свойства|эффекты))?|Фармакодинамические[{S}]+эффекты"


def normalize_text(text: Column, terms: bool = True) -> Column:
    """Spaces before and around punctuation; with ``terms`` also T1/2 and Cmax."""
    return apply(text, TIDY + (TERMS if terms else []) + AT_MOST)


def protect_entities(text: Column) -> Column:
    for entity, name in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(name))
    return text


def restore_entities(text: Column) -> Column:
    for entity, name in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(entity))
    return text


def tokens(text: Column) -> Column:
    """Words and single signs."""
    return F.regexp_extract_all(text, F.lit(rf"([{W}]+|[^{W}{S}])"))


def corrected(lemma: Column) -> Column:
    """The lemma, or the right one where an analyser is known to be wrong."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEMMA_CORRECTIONS.items() for x in kv]), lemma), lemma)


def lemmatize(text: Column, lemmas: dict[str, str] | Column) -> Column:
    """Each token by its lemma, corrected, then spacing; null and empty text stay as they are.

    ``lemmas`` is a map, small by nature; a dictionary of any size is joined by ``relational.lemmatized``.
    """
    table = lemmas if isinstance(lemmas, Column) else F.create_map(*[F.lit(x) for kv in (lemmas or {"": ""}).items() for x in kv])
    joined = F.array_join(F.transform(tokens(protect_entities(text)), lambda t: corrected(F.coalesce(F.element_at(table, F.lower(t)), F.lower(t)))), " ")
    return F.when(text.isNull() | (text == ""), text).otherwise(restore_entities(normalize_text(joined, terms=False)))


def remove_brackets(text: Column) -> Column:
    return apply(text, PLAIN_BRACKETS)


def _until_stable(texts: pd.Series, pattern: str) -> pd.Series:
    """Texts without what the pattern finds, again and again until it finds nothing; most have no bracket at all."""
    find, some = re.compile(pattern), re.compile(r"[\[({]")

    def clean(text: str | None) -> str | None:
        hits = 1 if text and some.search(text) else 0
        while hits:
            text, hits = find.subn("", text)
        return text

    return texts.map(clean)


def _without_mixed(texts: pd.Series) -> pd.Series:
    """One walk over the brackets of a text: each closing one meets the last one open, of whatever kind."""
    find = re.compile(r"[\[(\{\])}]")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        opened, gone = [], []
        for m in find.finditer(text):
            if m.group() in "[({":
                opened.append(m.start())
            elif opened:
                start = opened.pop()
                while gone and gone[-1][0] > start:
                    gone.pop()
                gone.append((start, m.end()))
        at, kept = 0, []
        for s, e in gone:
            kept.append(text[at:s])
            at = e
        return "".join([*kept, text[at:]])

    return texts.map(clean)


def remove_brackets_deep(text: Column) -> Column:
    """Without bracketed text of any kind, however deep; an unclosed bracket drops the rest, a stray one only itself.

    One Arrow pass, since no replacement rule follows nesting of any depth.
    """
    return apply(F.pandas_udf(_without_mixed, "string")(text), [(r"(?s)[\[({].*$", ""), (r"[\])}]", "")])


def remove_matched_brackets(text: Column) -> Column:
    """Without pairs of one kind and what they hold, innermost first, until none is left."""
    return F.pandas_udf(lambda texts: _until_stable(texts, INNERMOST), "string")(text)


def remove_unmatched_brackets(text: Column) -> Column:
    return apply(text, UNMATCHED)


def remove_parentheses(text: Column) -> Column:
    """Without parentheses; empty becomes null."""
    return F.nullif(strip(F.regexp_replace(text, r"\([^)]*\)", "")), F.lit(""))


def expand_abbreviations(text: Column, forms: dict[str, str]) -> Column:
    """Each variant, longest first, by its full form where no letter stands next to it; outputs can be expanded again."""
    for variant in sorted(forms, key=lambda v: (-len(v), v)):
        by = forms[variant].replace("\\", "\\\\").replace("$", "\\$")
        text = F.regexp_replace(text, rf"(?iu)(?<![a-zA-Zа-яА-Я])\Q{variant}\E(?![a-zA-Zа-яА-Я])", by)
    return text


def clean_term(text: Column, forms: dict[str, str] | None = None) -> Column:
    return expand_abbreviations(strip(F.regexp_replace(F.lower(text), r"\([^)]*\)", "")), forms or {})


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+\.?\d*)")), lambda x: x.cast("double"))


def minerals(text: Column) -> Column:
    """Sorted names of the minerals named in any form."""
    cleaned = F.regexp_replace(F.lower(text), r"\([^)]*\)", "")
    named = [F.when(cleaned.rlike(rf"(^|[^{W}])({stem})($|[^{W}])"), F.lit(name)) for name, stem in MINERALS.items()]
    return F.array_sort(F.array_compact(F.array(*named)))


def sets_differ(a: Column, b: Column) -> Column:
    """Both non-empty and not the same set."""
    key = lambda c: F.array_sort(F.array_distinct(c))
    return (F.size(a) > 0) & (F.size(b) > 0) & (key(a) != key(b))


def long_lines(text: Column, least: int = 5) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.length(strip(x)) >= least), "\n")


def clear_text(text: Column, brackets: bool = True) -> Column:
    """A chapter of side effects without references, brackets, odd spaces and short lines; keeps brackets on request."""
    rules = CHAPTER + (PLAIN_BRACKETS if brackets else []) + CHAPTER_END + (CHAPTER_DASHES if brackets else [])
    return long_lines(apply(text, rules))


def truncate_after(text: Column, keywords: list[str]) -> Column:
    """Text before the first of the keywords, in any case."""
    low = F.lower(text)
    at = F.array_min(F.array_compact(F.array(*[F.nullif(F.instr(low, k.lower()), F.lit(0)) for k in keywords])))
    return strip(F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1)))


def fix_terms(text: Column) -> Column:
    for wrong, right in TERM_SPELLINGS.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return apply(text, TERM_RULES)


def join_broken_lines(text: Column) -> Column:
    """A line that ends in a hyphen goes on in the next one."""
    stripped = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    return F.regexp_replace(stripped, "-\n", "")


def dosage_form(text: Column) -> Column:
    out = F.replace(strip(apply(F.lower(text), DOSAGE)), F.lit("ё"), F.lit("е"))
    return F.when(F.instr(out, "с ароматом") > 0, F.substring_index(out, "с ароматом", 1)).otherwise(out)


def list_items(text: Column) -> Column:
    """Items of a list with semicolons, in lower case; a dash is an empty list."""
    clean = F.regexp_replace(strip(F.lower(F.coalesce(text, F.lit("")))), rf"[{S}]+", " ")
    return F.when(clean.isin("", "-"), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(clean, ";"), strip), lambda x: x != ""))


def label_and_tag(label: Column) -> Column:
    """struct(name, tag) of "name (tag)"; both null otherwise."""
    pattern = rf"^(?s)(.*?)[{S}]*\(([^)]+)\)$"
    hit = label.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(label, pattern, 1)).alias("name"), F.when(hit, F.regexp_extract(label, pattern, 2)).alias("tag"))


def translate_term(text: Column, dictionary: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (dictionary or {"": ""}).items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(text)), text)


def decomposed(text: Column) -> Column:
    """Compatibility decomposition (NFKD): plain letters, then their accents; the engine has no function for it."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t)), "string")(text)


def letters_only(text: Column) -> Column:
    """The plain letters in lower case: wide and joined forms are taken apart and accents dropped."""
    return F.lower(F.regexp_replace(decomposed(text), r"[^\p{L}]", ""))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]+", "")


def group_line(text: Column) -> Column:
    """struct(name, percent, cases) of "name (p%, n ADRs)"."""
    pattern, visible = rf"(.+)[{S}]+\((\d+)%,[{S}]*(\d+)[{S}]+ADRs\)", ascii_only(text)
    part = lambda n: F.nullif(F.regexp_extract(visible, pattern, n), F.lit(""))
    return F.struct(strip(part(1)).alias("name"), part(2).cast("int").alias("percent"), part(3).cast("bigint").alias("cases"))


def effect_line(text: Column) -> Column:
    """struct(name, cases) of "name (n)"."""
    pattern, visible = rf"(.+)[{S}]*\((\d+)\)[{S}]*", ascii_only(text)
    return F.struct(strip(F.nullif(F.regexp_extract(visible, pattern, 1), F.lit(""))).alias("name"), F.nullif(F.regexp_extract(visible, pattern, 2), F.lit("")).cast("bigint").alias("cases"))


def report_count(html: Column) -> Column:
    visible = F.regexp_replace(html, r"[\x{202F}\x{200B}\x{200C}\x{200E}\x{2060}]", "")
    digits = F.regexp_extract(visible, r"There (?:is|are)\s*<strong>([\d\s]+)</strong>\s*reports?", 1)
    return F.nullif(F.regexp_replace(digits, r"\s", ""), F.lit("")).cast("bigint")


def bullets(text: Column) -> Column:
    return strip(apply(text, BULLETS))


def split_items(text: Column) -> Column:
    """Parts between ; : . and commas, but not at a comma within a number."""
    kept = F.regexp_replace(text, rf"(\d)[{S}]*,[{S}]*(\d)", "$1__COMMA__$2")
    parts = F.transform(F.split(kept, "[;:.,]"), lambda x: strip(F.replace(x, F.lit("__COMMA__"), F.lit(","))))
    return F.filter(parts, lambda x: x != "")


def sentences(text: Column, parentheses: bool = False, shaped: bool = True) -> Column:
    """Array of sentences; ``parentheses`` drops them first, ``shaped`` keeps only lines that end like a sentence."""
    clean = apply(text, ([(r"\(.*?\)", "")] if parentheses else []) + SENTENCE_TRASH)
    lines = F.split(apply(F.regexp_replace(clean, SENTENCE_END, "$1\n"), SENTENCE_BREAKS), "\n")
    return F.filter(lines, sentence_shaped) if shaped else lines


def sentence_shaped(line: Column) -> Column:
    return line.rlike(r"[.;:]$") & ~line.rlike(rf"^[{S}]*[^{S}]+\.[{S}]*$")


def sorted_key(name: Column) -> Column:
    """Names joined by +, in order."""
    return F.array_join(F.array_sort(F.split(name, r"\+")), "+")


def pharm_group_and_atc(text: Column) -> Column:
    """struct(pharm_group array, atc_code, rest) of a chapter on pharmacodynamics."""
    group = F.regexp_extract(text, rf"(?isu)Фармакотерапевтическая[{S}]+группа:[{S}]*(.*?)(?=[{S}]*(?:{ATC_HEADER}|{MECHANISM}|\z))", 1)
    flat = F.regexp_replace(strip(F.regexp_replace(group, rf"[{S}]+", " ")), r"\.+$", "")
    code = F.nullif(F.regexp_extract(text, rf"{ATC_HEADER}[{S}]*([A-ZА-Яa-zа-я][0-9][A-ZА-Яa-zа-я0-9]{{2,6}})", 1), F.lit(""))
    after = F.regexp_extract(text, rf"(?s){ATC_HEADER}[{S}]*[A-ZА-Яa-zа-я][0-9][A-ZА-Яa-zа-я0-9]{{2,6}}[^\n]*\n?(.*)$", 1)
    mechanism = F.regexp_extract(text, rf"(?isu)((?:{MECHANISM}).*)$", 1)
    rest = strip(F.when(code.isNotNull(), after).when(mechanism != "", mechanism).otherwise(text))
    rest = F.coalesce(F.nullif(strip(F.regexp_replace(rest, rf"(?isu)^(?:{MECHANISM})[{S}]*", "")), F.lit("")), rest)
    return F.struct(F.filter(F.transform(F.split(flat, ";"), strip), lambda x: x != "").alias("pharm_group"), code.alias("atc_code"), rest.alias("rest"))


def word_ngrams(words: Column) -> Column:
    """All runs of words: array of struct(first, last, phrase), last exclusive."""
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.struct(i.alias("first"), j.alias("last"), F.array_join(F.slice(words, i + 1, j - i), " ").alias("phrase")))))


def detokenize(words: Column) -> Column:
    """Tokens joined as text: no space before a closing sign or after an opening one."""
    step = lambda out, t: F.when(out == "", t).when(t.rlike(r"^[.,;:!?)\]}»%]") | out.rlike(r"[(\[{«]$"), F.concat(out, t)).otherwise(F.concat(out, F.lit(" "), t))
    return F.aggregate(words, F.lit(""), step)


def greek_cyp_electrolytes(text: Column) -> Column:
    """struct of the sets that rule out a synonym: Greek letters, CYP enzymes, electrolytes, beta types."""
    low = F.lower(text)
    named = lambda table: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in table.items()]))))
    return F.struct(
        named(GREEK).alias("greek"), F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(r"cyp(\d+[a-z]+\d+)")))).alias("cyp"),
        named({e: e for e in ELECTROLYTES}).alias("electrolytes"),
        low.rlike("бета1|beta1").alias("beta1"), low.rlike("бета2|beta2").alias("beta2"), low.rlike("блокатор|антагонист|ингибитор").alias("blocker"),
    )


#: Names of Greek letters, and stems of electrolytes.
GREEK = {"альфа": "α", "альфa": "α", "alpha": "α", "а": "α", "бета": "β", "бетa": "β", "beta": "β", "в": "β", "гамма": "γ", "гаммa": "γ", "gamma": "γ", "дельта": "δ", "дельтa": "δ", "delta": "δ"}
ELECTROLYTES = ("натри", "кали", "магни", "кальц", "хлорид", "фосфат", "магнез")


def capped_similarity(a: Column, b: Column, similarity: Column) -> Column:
    """Similarity of two terms, capped where their Greek letters, enzymes, electrolytes or beta types differ."""
    x, y = greek_cyp_electrolytes(a), greek_cyp_electrolytes(b)
    crossed = (x["beta1"] & y["beta2"]) | (x["beta2"] & y["beta1"])
    cap = lambda v: F.least(similarity, F.lit(v))
    return (
        F.when(sets_differ(x["greek"], y["greek"]), cap(0.88)).when(sets_differ(x["cyp"], y["cyp"]), cap(0.85)).when(sets_differ(x["electrolytes"], y["electrolytes"]), cap(0.83))
        .when(crossed & (x["blocker"] | y["blocker"]), cap(0.80)).when(crossed, cap(0.84)).otherwise(similarity)
    )


def penalised_similarity(a: Column, b: Column, similarity: Column, penalty: float = 0.05) -> Column:
    """Less by the penalty, at least 0, where both terms name numbers or minerals and these differ."""
    differ = sets_differ(numbers(a), numbers(b)) | sets_differ(minerals(a), minerals(b))
    return F.when(differ, F.greatest(F.lit(0.0), similarity - penalty)).otherwise(similarity)




def lemmatize_words(text: Column, lemmas: dict[str, str]) -> Column:
    """Words between spaces by their lemma; null becomes empty."""
    table = F.create_map(*[F.lit(x) for kv in (lemmas or {"": ""}).items() for x in kv])
    words = F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{S}]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, F.lower(w)), w)), " ")
