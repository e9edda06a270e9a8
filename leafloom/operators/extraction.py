"""Text to tables: sections, side effects with frequencies, chapters, contraindications, report pages.

Every extractor is an expression within the row; texts are cut by sentinel characters, so no row is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.functions.rules import S, strip
from leafloom.operators.relational import ELIMINATION, PROTEIN_BINDING, STOP_STEMS, all_match, contains_any

_CUT, _END = "\u0001", "\u0002"

#: Frequency words of a leaflet, in order.
FREQUENCY_WORDS = ["частота не известна", "частота неизвестна", "очень часто", "очень частые", "очень редко", "очень редкие", "часто", "частые", "редко", "редкие", "нечасто", "нечастые"]
#: What may follow a frequency word.
AFTER_FREQUENCY = r"(?=\n|\s*:|-|\*|\d| –| -|\n—|\n-| —|\n:| —| \(| )"
#: Words that open a list of examples.
EXAMPLE_WORDS = ["включая", "такие как", "в том числе"]
UNKNOWN_FREQUENCY = "Частота неизвестна"


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def _pieces(text: Column, pattern: str) -> Column:
    """array of struct(head, body): the text cut before every match of the pattern, what precedes the first left out."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_CUT}$1{_END}"), _CUT)
    return F.transform(F.filter(parts, lambda p: F.contains(p, F.lit(_END))), lambda p: F.struct(F.substring_index(p, _END, 1).alias("head"), F.substring_index(p, _END, -1).alias("body")))


def _items(text: Column, lead: str) -> Column:
    cleaned = lambda x: strip(F.regexp_replace(F.regexp_replace(x, lead, ""), rf"[{S}:0-9]+$", ""))
    kept = F.filter(F.split(text, rf"[;,][{S}]*"), lambda x: (strip(x) != "") & ~strip(x).rlike(r"^\d+$"))
    return F.transform(kept, cleaned)


def side_effects_of(text: Column, classes: list[str]) -> Column:
    """array of struct(section, freq, effects): organ classes at line starts, frequency words within them.

    A repeated header does not open a section; its text goes to the section before it. A repeated frequency word
    replaces the earlier list; without any frequency word the section is one list with a null frequency.
    """
    heads = _any(sorted(classes, key=lambda c: (-len(c), c)))
    pieces = _pieces(text, rf"(?m)^({heads})[{S}]*")
    flat = F.transform(pieces, lambda p: F.struct(p["head"].alias("head"), strip(F.regexp_replace(p["body"], "\n", " ")).alias("body")))

    def grouped(flat: Column, names: Column) -> Column:
        opens = F.transform(names, lambda n, i: F.array_position(names, n) == i + 1)
        home = bind(opens, lambda o: F.transform(names, lambda n, i: F.array_max(F.filter(F.sequence(F.lit(0), i), lambda j: F.get(o, j)))))
        body = lambda h, s: F.array_join(F.filter(F.transform(F.filter(F.sequence(F.lit(0), F.size(flat) - 1), lambda i: F.get(h, i) == F.array_position(names, s).cast("int") - 1), lambda i: F.get(flat, i)["body"]), lambda b: b != ""), " ")
        return F.when(F.size(flat) > 0, bind(home, lambda h: F.transform(F.array_distinct(names), lambda s: F.struct(s.alias("section"), body(h, s).alias("body")))))

    sections = bind(flat, lambda f: bind(F.transform(f, lambda p: p["head"]), lambda n: grouped(f, n)))

    def per_section(s: Column) -> Column:
        return bind(_pieces(F.lower(s["body"]), rf"({_any(FREQUENCY_WORDS)}){AFTER_FREQUENCY}"), lambda marks: with_marks(s, marks))

    def with_marks(s: Column, marks: Column) -> Column:
        words = F.transform(marks, lambda m: m["head"])
        last = F.filter(marks, lambda m, i: ~F.array_contains(F.slice(words, i + 2, F.size(words) + 1), m["head"]))
        sub = lambda b: F.regexp_replace(F.substring_index(strip(b), ".", 1), rf"[{S}]*\d+;?[{S}]*$|[;{S})]+$", "")
        listed = F.transform(last, lambda m: F.struct(s["section"].alias("section"), m["head"].alias("freq"), _items(sub(m["body"]), r"^[^a-zA-Zа-яА-ЯёЁ«»]+").alias("effects")))
        plain = F.transform(F.filter(F.split(F.substring_index(s["body"], ".", 1), rf"[;,][{S}]*"), lambda x: strip(x) != ""), lambda x: strip(F.regexp_replace(x, r"^[^a-zA-Zа-яА-ЯёЁ]+", "")))
        return F.when(F.size(marks) > 0, listed).otherwise(F.array(F.struct(s["section"].alias("section"), F.lit(None).cast("string").alias("freq"), plain.alias("effects"))))

    kind = "array<struct<section:string,freq:string,effects:array<string>>>"
    return F.coalesce(F.flatten(F.transform(sections, per_section)), F.array().cast(kind))


def split_examples(effects: Column) -> Column:
    """Effects split at "including", "such as"; empty parts dropped."""
    parts = lambda e: F.filter(F.transform(F.split(e, rf"(?iu),?[{S}]*(?:{_any(EXAMPLE_WORDS)})[{S}]+"), strip), lambda x: x != "")
    bare = lambda x: strip(F.regexp_replace(x, rf"(?iu)^(?:{_any([w for w in EXAMPLE_WORDS if ' ' not in w])})[{S}]+", ""))
    return F.filter(F.flatten(F.transform(effects, lambda e: F.transform(parts(e), bare))), lambda x: x != "")


def side_effect_rows(df: DataFrame, text: str, classes: list[str], keep: list[str]) -> DataFrame:
    """(keep, section, freq, ord, effect), one row an effect."""
    found = df.select(*keep, F.inline(side_effects_of(F.col(text), classes)))
    rows = found.select(*keep, "section", "freq", F.posexplode(split_examples(F.col("effects"))).alias("ord", "effect"))
    return rows.filter("effect <> ''")


def drug_effect_freq(rows: DataFrame, last_wins: bool = True, skip: list[str] | None = None, need_freq: bool = False) -> DataFrame:
    """(drug, effect, freq) once a pair: the last (or first) by ``ord`` wins; without frequency it is unknown.

    ``skip`` leaves out frequency classes, ``need_freq`` rows without one. Combined before the shuffle: no key is gathered.
    """
    if need_freq:
        rows = rows.filter("freq IS NOT NULL")
    if skip:
        rows = rows.filter(~F.coalesce(F.lower("freq"), F.lit("")).isin([s.lower() for s in skip]))
    base = rows.filter("drug IS NOT NULL AND effect IS NOT NULL").select(T.sorted_key(F.lower("drug")).alias("drug"), F.lower("effect").alias("effect"), F.coalesce("freq", F.lit(UNKNOWN_FREQUENCY)).alias("freq"), "ord")
    pick = F.max_by if last_wins else F.min_by
    return base.groupBy("drug", "effect").agg(pick("freq", F.struct("ord", "freq")).alias("freq"))


_SIDE_EFFECT_START = rf"(?:Побочн(?:ое|ые)[{S}]*действ(?:ие|ия)|ПОБОЧН(?:ОЕ|ЫЕ)[{S}]*ДЕЙСТВ(?:ИЕ|ИЯ))"
#: Start and end of the sections of a leaflet, and whether line breaks are dropped.
SECTIONS: dict[str, tuple[str, str, bool]] = {
    "group": (rf"Фармакотерапевтическая[{S}]*группа|ФАРМАКОТЕРАПЕВТИЧЕСКАЯ[{S}]*ГРУППА", rf"(?=[{S}]*[‚\-–—]*[{S}]*[КK][^{S}]*?[{S}]+[AА][ТT][ХX])", True),
    "text": (rf"Фармакологические[{S}]*свойства|Фармакологическое[{S}]*действие|ФАРМАКОЛОГИЧЕСКИЕ[{S}]*СВОЙСТВА", rf"\n(?:Показания[{S}]*к[{S}]*применению|Показания[{S}]*к[{S}]*медицинскому[{S}]*применению|ПОКАЗАНИЯ[{S}]*К[{S}]*ПРИМЕНЕНИЮ)", True),
    "text_side_e": (_SIDE_EFFECT_START, r"\n(?:Передозировка|ПЕРЕДОЗИРОВКА)", False),
    "dosage_form": (rf"Лекарственная[{S}]*форма|ЛЕКАРСТВЕННАЯ[{S}]*ФОРМА", r"\n(?:Состав|СОСТАВ|Описание|ОПИСАНИЕ)", True),
    "form_release": (rf"Форма[{S}]*выпуска|ФОРМА[{S}]*ВЫПУСКА", rf"\n(?:Условия[{S}]*хранения|УСЛОВИЯ[{S}]*ХРАНЕНИЯ|Хранение|ХРАНЕНИЕ)", True),
    "contraindications": ("Противопоказания|ПРОТИВОПОКАЗАНИЯ", rf"\n(?=[{S}]*С[{S}]*осторожностью|С[{S}]*ОСТОРОЖНОСТЬЮ|Применение[{S}]*при[{S}]*беременности[{S}]*и[{S}]*в[{S}]*период[{S}]*грудного[{S}]*вскармливания|Способ[{S}]*применения[{S}]*и[{S}]*дозы)", False),
    "caution": (rf"С[{S}]*осторожностью|С[{S}]*ОСТОРОЖНОСТЬЮ", rf"\n(?=[{S}]*Применение[{S}]*при[{S}]*беременности|ПРИМЕНЕНИЕ[{S}]*ПРИ[{S}]*БЕРЕМЕННОСТИ|Способ[{S}]*применения[{S}]*и[{S}]*дозы|Передозировка|ПЕРЕДОЗИРОВКА)", False),
}


def section(text: Column, name: str) -> Column:
    """One section of a leaflet; null if its start or end is missing."""
    start, end, flat = SECTIONS[name]
    pattern = rf"(?s)(?:\n|^)(?:{start})(?:[{S}]*[.:][{S}]*)?(.*?){end}"
    body = strip(F.regexp_extract(text, pattern, 1))
    return F.nullif(F.regexp_replace(body, rf"[{S}]+", " ") if flat else body, F.lit(""))


def sections(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[section(F.col(text), n).alias(n) for n in SECTIONS])


def side_effect_chapter(text: Column) -> Column:
    return F.nullif(T.clear_text(section(text, "text_side_e")), F.lit(""))


#: Chapters of a summary of product characteristics with their other spellings, in order.
CHAPTERS: dict[str, list[str]] = {
    "Наименование лекарственного препарата": ["НАИМЕНОВНИЕ ЛЕКАРСТВЕННОГО ПРЕПАРАТА"],
    "Качественный и количественный состав": ["КАЧЕСТВЕННЬIЙ И КОЛИЧЕСТВЕННЫЙ СОСТАВ", "КАЧЕСТВЕННЫЙ И КОЛИЧЕСТВЕННЬIЙ СОСТАВ", "КАЧЕСТВЕННЬIЙ И КОЛИЧЕСТВЕННЬIЙ СОСТАВ", "КАЧЕСТВЕННЫЙ И КОЛИЧЕСТВЕННЫЙ COСТАВ", "К АЧЕСТВЕННЫЙ И КОЛИЧЕСТВЕННЫЙ СОСТАВ"],
    "Лекарственная форма": [],
    "Клинические данные": ["Клинический данные"],
    "Показания к применению": [],
    "Режим дозирования и способ применения": [],
    "Противопоказания": [],
    "Особые указания и меры предосторожности при применении": [],
    "Взаимодействие с другими лекарственными препаратами и другие виды взаимодействия": ["Взаимодействие с другими лекарственными препаратами", "Взаимодействия с другими лекарственными препаратами", "Взаимодействие с другими лекарственными средствами", "Взаимодействие с другими лекарственными средствами и другие виды", "В заимодействие с другими лекарственными препаратами и другие"],
    "Фертильность, беременность и лактация": ["Фертильность, беременность и лактации", "Фертильность, беременность и лактация", "Беременность и лактация", "Фертильность, беременность и период грудного вскармливания", "Беременность, грудное вскармливание и фертильность", "Фертильность, беременность и кормление грудью"],
    "Влияние на способность управлять транспортными средствами и работать с механизмами": ["Влияние на способность управлять", "Управление транспортными средствами и работа с механизмами", "Влияние на способность управлять транспортными средствами и работать с"],
    "Нежелательные реакции": ["Побочное действие", "Побочные действия"],
    "Передозировка": [],
    "Фармакологические свойства": [],
    "Фармакодинамические свойства": ["Фармакодинамика"],
    "Фармакокинетические свойства": ["Фармакокинетика"],
    "Данные доклинической безопасности": ["Доклинические данные по безопасности"],
    "Фармацевтические свойства": ["ФАРМАЦЕВТИЧЕCКИЕ СВОЙСТВА", "ФАРМАЦЕВТИЧЕКИЕ СВОЙСТВА"],
}
#: Headers that only end the chapter before, and the mark after which reactions are cut.
TRASH_CHAPTERS = ["Клинические данные", "Фармацевтические свойства", "Данные доклинической безопасности", "Фармакологические свойства", "Наименование лекарственного препарата"]
REPORTING_MARK = "\nСообщение о подозреваемых нежелательных реакциях\n"


def contains_any_of(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text, as it is written."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def _flexible(header: str) -> str:
    return rf"[{S}]+".join(re.escape(w) for w in header.split())


def chapters(text: Column) -> Column:
    """map of chapter to text: the first hit of each header, in the canonical order, up to the start of the next one."""
    def hit(low: Column, names: list[str]) -> Column:
        alternatives = "|".join(_flexible(n.lower()) for n in names)
        pattern = rf"(?<![\p{{L}}\p{{N}}_])(?:[{S}]*(?:\d+(?:\.\d+)*)[{S}]*)?(?:{alternatives})(?![\p{{L}}\p{{N}}_])"
        # most texts lack most headers: the pattern is tried only where the longest word of one of them stands
        there = contains_any_of(low, sorted({max(n.lower().split(), key=len) for n in names}))
        start = F.when(there, F.regexp_instr(low, F.lit(pattern))).otherwise(0)
        return F.struct(start.alias("start"), F.when(start > 0, start + F.length(F.regexp_substr(low, F.lit(pattern)))).alias("stop"))

    found = bind(F.lower(text), lambda low: F.filter(F.array(*[F.struct(F.lit(c).alias("name"), hit(low, [c, *v]).alias("at")) for c, v in CHAPTERS.items()]), lambda x: x["at"]["start"] > 0))

    def body(found: Column, i: Column, x: Column) -> Column:
        following = F.get(found, i + 1)
        end = F.coalesce(following["at"]["start"], F.length(text) + 1)
        raw = F.substring(text, x["at"]["stop"], F.greatest(end - x["at"]["stop"], F.lit(0)))
        clean = strip(F.regexp_replace(raw, rf"[{S}\d.]*$", ""))
        return F.when(x["name"] == "Нежелательные реакции", F.substring_index(clean, REPORTING_MARK, 1)).otherwise(clean)

    pairs = bind(found, lambda f: F.transform(f, lambda x, i: F.struct(x["name"].alias("key"), body(f, i, x).alias("value"))))
    return F.map_from_entries(F.filter(pairs, lambda p: ~p["key"].isin(TRASH_CHAPTERS)))


def chapter_stats(found: Column) -> Column:
    """struct(found_count, not_found_count, not_found_list)."""
    expected = F.array(*[F.lit(c) for c in CHAPTERS if c not in TRASH_CHAPTERS])
    missing = lambda keys: F.array_except(expected, keys)
    return bind(F.map_keys(found), lambda k: F.struct(F.size(k).alias("found_count"), F.size(missing(k)).alias("not_found_count"), missing(k).alias("not_found_list")))


def contraindications(text: Column, most: int = 60) -> Column:
    """array of short phrases of a chapter on contraindications."""
    skip = lambda x: contains_any(x, STOP_STEMS)
    parts = F.split(T.bullets(T.remove_matched_brackets(text)), rf"\n-|;[{S}]*-|:[{S}]*-|;\n")
    fragments = F.filter(F.transform(parts, lambda p: strip(F.regexp_replace(p, rf"[{S}]+", " "))), lambda p: p != "")
    said = F.filter(F.flatten(F.transform(fragments, lambda f: T.sentences(f, shaped=False))), lambda s: (s != "") & ~skip(s))
    items = F.flatten(F.transform(said, T.split_items))
    # no pair of brackets is left in the text, so none is in a part of it
    tidy = lambda i: strip(F.regexp_replace(F.regexp_replace(T.remove_unmatched_brackets(i), rf"^[^\p{{L}}\p{{N}}_{S}()]+", ""), rf"[^\p{{L}}\p{{N}}_{S}()]+$", ""))
    return F.array_distinct(F.filter(F.transform(items, tidy), lambda i: (i != "") & ~skip(i) & (F.length(i) <= most)))


def pharmacokinetic_sentences(text: Column) -> Column:
    at = F.instr(text, "Фармакокинетика")
    return T.sentences(F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text))


def protein_binding(text: Column) -> Column:
    return F.filter(pharmacokinetic_sentences(text), lambda s: all_match(s, PROTEIN_BINDING))


def elimination_periods(text: Column) -> Column:
    return F.filter(pharmacokinetic_sentences(text), lambda s: all_match(s, ELIMINATION))


def strip_tags(html: Column) -> Column:
    """Text of a piece of HTML with line breaks where blocks end; superscripts dropped."""
    broken = F.regexp_replace(F.regexp_replace(html, r"(?is)<sup[^>]*>.*?</sup>", ""), r"(?i)<br\s*/?>|</(p|div|li|tr|h\d)>", "\n")
    plain = F.regexp_replace(broken, r"(?s)<[^>]+>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return plain


def html_section(html: Column, heading: str) -> Column:
    """Text of the first block after a heading."""
    body = F.regexp_extract(html, rf"(?isu)<h\d[^>]*>\s*{re.escape(heading)}\s*</h\d>\s*<div[^>]*>(.*?)</div>", 1)
    return F.nullif(strip(strip_tags(body)), F.lit(""))


def report_groups(html: Column) -> Column:
    """array of struct(grp, percent, grp_cases, effect, cases): list items with several spans open a group."""
    items = F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*>(.*?)</li>"))
    read = F.transform(items, lambda i: F.struct((F.size(F.split(i, r"(?i)<span")) > 2).alias("head"), strip(strip_tags(i)).alias("line")))
    lines = F.transform(read, lambda r: F.struct(r["head"].alias("head"), T.group_line(r["line"]).alias("g"), T.effect_line(r["line"]).alias("e")))
    last = lambda ls, i: F.element_at(F.filter(F.slice(ls, 1, i + 1), lambda x: x["head"]), -1)["g"]
    rows = bind(lines, lambda ls: F.transform(ls, lambda x, i: F.struct(F.when(F.exists(F.slice(ls, 1, i + 1), lambda y: y["head"]), last(ls, i)).alias("g"), x["head"].alias("head"), x["e"].alias("e"))))
    kept = F.filter(rows, lambda x: ~x["head"] & x["g"].isNotNull() & x["e"]["name"].isNotNull())
    return F.transform(kept, lambda x: F.struct(x["g"]["name"].alias("grp"), x["g"]["percent"].alias("percent"), x["g"]["cases"].alias("grp_cases"), x["e"]["name"].alias("effect"), x["e"]["cases"].alias("cases")))


def stat_table(html: Column) -> Column:
    """array of struct(label, n): rows of at least three cells; a count that is no number is 0."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>")), lambda c: strip(strip_tags(c))))
    number = lambda c: F.coalesce(F.regexp_extract(T.ascii_only(c), r"^\s*(\d+)\s*$", 1).try_cast("bigint"), F.lit(0))
    return F.transform(F.filter(cells, lambda c: F.size(c) >= 3), lambda c: F.struct(F.get(c, F.lit(0)).alias("label"), number(F.get(c, F.lit(1))).alias("n")))


def report_page(df: DataFrame, html: str = "html", keep: str = "drug_en") -> DataFrame:
    """(keep, report_count, effects, sex, age) of saved report pages."""
    block = lambda name: F.regexp_extract(html, rf'(?is)<div[^>]*dtid="{name}"[^>]*>(.*?)</table>', 1)
    return df.select(keep, T.report_count(F.col(html)).alias("report_count"), report_groups(F.col(html)).alias("effects"), stat_table(block("dashboard-sexdist")).alias("sex"), stat_table(block("dashboard-agegroupdist")).alias("age"))


def heading_lists(html: Column, skip: list[str] | None = None, dictionary: dict[str, str] | None = None) -> Column:
    """array of struct(category, freq, effects) from h3 headings, each followed by a list whose items read "freq: a, b".

    Headings of ``skip`` are left out, everything from the next h2 on too; names are translated where the dictionary has them.
    """
    within = F.regexp_extract(html, r"(?is)^(.*?)(?:<h2|$)", 1)
    heads = F.transform(_pieces(within, r"(?is)<h3[^>]*>(.*?)</h3>"), lambda h: F.struct(strip(strip_tags(h["head"])).alias("head"), h["body"].alias("body")))
    if skip:
        heads = F.filter(heads, lambda h: ~h["head"].isin(skip))
    name = (lambda c: T.translate_term(c, dictionary)) if dictionary else (lambda c: c)
    lines = lambda b: F.transform(F.regexp_extract_all(b, F.lit(r"(?is)<li[^>]*>(.*?)</li>")), lambda i: strip(strip_tags(i)))
    effects = lambda x: F.filter(F.transform(F.split(F.regexp_replace(x, "^[^:]*:", ""), ","), lambda e: name(strip(e))), lambda e: e != "")
    one = lambda h, x: F.struct(name(h["head"]).alias("category"), F.when(F.contains(x, F.lit(":")), name(strip(F.substring_index(x, ":", 1)))).alias("freq"), effects(x).alias("effects"))
    return F.flatten(F.transform(heads, lambda h: F.transform(lines(h["body"]), lambda x: one(h, x))))


def first_source(links: list[str], texts: list[str]) -> Column:
    """The text of the first source whose link is there, even where that text itself is missing."""
    out = F.lit(None).cast("string")
    for link, text in reversed(list(zip(links, texts))):
        out = F.when(F.coalesce(F.col(link), F.lit("")) != "", F.col(text)).otherwise(out)
    return out


def by_stage(stage: Column, text: Column, scan: Column) -> Column:
    """Extracted text in stages 1 and 2, scanned text in 1_scan and 2_scan."""
    return F.when(stage.isin("1", "2"), text).when(stage.isin("1_scan", "2_scan"), scan)


def file_name_info(name: Column) -> Column:
    """struct of "N) A+B+[C+D] _ Trade _ date.pdf"; null if it has not three parts; ~ is an unknown name."""
    rest = strip(F.regexp_replace(name, r"^[^)]*\)", ""))
    parts = F.split(rest, " _ ")
    names = F.nullif(strip(F.get(parts, F.lit(0))), F.lit("~"))
    main = F.regexp_replace(names, r"\+\[[^\]]*\]$", "")
    extra = F.regexp_extract(names, r"\+\[([^\]]*)\]$", 1)
    split = lambda c: F.filter(F.transform(F.split(c, r"\+"), strip), lambda x: x != "")
    info = F.struct(F.regexp_extract(name, r"^\s*(\d+)\s*\)", 1).try_cast("int").alias("num_prepare"), split(main).alias("international_name"), split(extra).alias("international_name_dlc"), strip(F.get(parts, F.lit(1))).alias("trade_name"), F.regexp_replace(strip(F.get(parts, F.lit(2))), r"\.pdf$", "").alias("date"))
    return F.when(F.size(parts) == 3, info)


def leaflet_document(df: DataFrame, name: str = "file_name", text: str = "text") -> DataFrame:
    """File name fields, chapters and their statistics of a summary of product characteristics."""
    out = df.select(file_name_info(F.col(name)).alias("i"), chapters(F.col(text)).alias("chapters"))
    return out.select("i.*", "chapters", chapter_stats(F.col("chapters")).alias("stats"))
