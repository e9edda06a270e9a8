"""Problem 3: freely typed values mapped to a canonical list by a partition-based pigeonhole join, in SQL only.

Each distinct value is folded to a plain form in up to three variants (whole; before the first and before the last
remark sign). The forms of the list and of its synonyms are cut into k + 1 segments. By the pigeonhole principle a
value within k edits of a form holds at least one of its segments unchanged, at most k places away, so an equality join
on (form length, segment number, substring) finds every pair; ``levenshtein`` verifies it. The nearest form wins, then
the earlier variant, the form of nearest length, and the entry first by code point. Values without a match come out of
an anti-join.

Defined results: null and blank values and values that literally are an entry give no row; a value of signs only is
unmatched; repeated ids each give their row; an empty list makes every value unmatched; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession

from leafloom.common import cut, parallel, sql, table

UNMATCHED = "UNMATCHED"
#: Edits allowed for a form, by its least length: (least length, k).
EDITS = ((14, 4), (11, 3), (8, 2), (5, 1), (0, 0))

#: Letters of other alphabets and the Cyrillic letter of the same look, in lower case.
SAME_LOOK = {"a": "а", "b": "в", "c": "с", "e": "е", "h": "н", "i": "і", "j": "ј", "k": "к", "m": "м", "o": "о", "p": "р", "s": "ѕ", "t": "т", "x": "х", "y": "у", "α": "а", "β": "в", "ε": "е", "η": "н", "ι": "і", "κ": "к", "μ": "м", "ν": "v", "ο": "о", "ρ": "р", "τ": "т", "υ": "у", "χ": "х"}


def _translation() -> tuple[str, str]:
    """Wide forms to plain ones, then look-alikes to Cyrillic, letters with a mark to their base, by rule."""
    pairs = {}
    for code in range(0xFF01, 0xFF5F):
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        if plain.isalnum():
            pairs[chr(code)] = SAME_LOOK.get(plain, plain)
    for code in [*range(0xC0, 0x180), *range(0x400, 0x460)]:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if c == c.lower() and base != c:
            pairs[c] = SAME_LOOK.get(base, base)
    pairs |= SAME_LOOK
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _translation()
#: Joined letter forms.
LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"))
_REMARK = r" [-–—:;_] | \\*|;"


def _spread(value: str) -> str:
    for joined, plain in LIGATURES:
        value = f"replace({value}, '{joined}', '{plain}')"
    return value


def fold_sql(value: str) -> str:
    """Lower case, look-alikes folded, marks and invisible signs dropped, all other signs and spaces one blank."""
    return rf"trim(regexp_replace(translate(regexp_replace(lower({_spread(value)}), '[\\p{{M}}\\p{{Cf}}]', ''), '{_FROM}', '{_TO}'), '[^\\p{{L}}\\p{{N}}]+', ' '))"


def _variants_sql(value: str) -> str:
    plain = rf"regexp_replace({value}, '[\\s\\p{{Z}}]+', ' ')"
    bare = rf"regexp_replace(regexp_replace({plain}, '^[^\\p{{L}}\\p{{N}}(\\[（［]+', ''), '([\\p{{L}}\\p{{N}}\\p{{M}}][^(\\[（［]*)[(\\[（［][^)\\]）］]*[)\\]）］]?', '$1 ')"
    first = rf"regexp_extract({bare}, '^(.*?)(?:{_REMARK})', 1)"
    last = rf"regexp_extract({bare}, '^(.*)(?:{_REMARK})', 1)"
    return f"array({', '.join(fold_sql(v) for v in (bare, first, last))})"


def _edits_sql(length: str) -> str:
    return "CASE " + " ".join(f"WHEN {length} >= {least} THEN {k}" for least, k in EDITS) + " END"


_FORMS = f"""
SELECT DISTINCT field, entry, form, length(form) AS len, {_edits_sql('length(form)')} AS k
FROM (SELECT field, entry, {fold_sql('form')} AS form FROM $entries) WHERE form <> ''
"""
_SEGMENTS = """
SELECT field, form, entry, len, k, seg,
  CAST(floor(seg * len / (k + 1)) AS INT) AS start,
  CAST(floor((seg + 1) * len / (k + 1)) - floor(seg * len / (k + 1)) AS INT) AS size
FROM (SELECT *, explode(sequence(0, k)) AS seg FROM $forms)
"""
_PROBES = f"""
SELECT field, value, variant, v, len, explode(sequence(greatest(length(v) - {EDITS[0][1]}, 1), length(v) + {EDITS[0][1]})) AS flen
FROM (SELECT field, value, min(variant) AS variant, v, length(v) AS len
  FROM (SELECT field, value, posexplode(vs) AS (variant, v) FROM (SELECT field, value, {_variants_sql('value')} AS vs FROM $values))
  WHERE v <> '' GROUP BY field, value, v)
"""
_CANDIDATES = """
SELECT DISTINCT p.field, p.value, p.variant, p.v, s.form, s.entry, s.k
FROM (
  SELECT field, value, variant, v, flen, l.seg, l.k, substring(v, at + 1, l.size) AS piece
  FROM (SELECT p.field, p.value, p.variant, p.v, p.flen, l.seg, l.k, l.size,
          explode(sequence(greatest(l.start - l.k, 0), least(l.start + l.k, p.len - l.size))) AS at
        FROM $probes p JOIN $layout l ON p.field = l.field AND p.flen = l.len AND abs(p.len - p.flen) <= l.k
        WHERE p.len - l.size >= greatest(l.start - l.k, 0)) l
) p JOIN $segments s ON p.field = s.field AND p.flen = s.len AND p.seg = s.seg AND p.piece = substring(s.form, s.start + 1, s.size)
"""
_BEST = """
SELECT field, value, min_by(entry, struct(d, variant, gap, entry)) AS entry
FROM (SELECT field, value, variant, entry, k, levenshtein(v, form, k) AS d, abs(length(v) - length(form)) AS gap FROM $candidates)
WHERE d >= 0 GROUP BY field, value
"""


def match_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(field, value, entry) of the distinct ``values`` (field, value) against ``entries`` (field, entry, form)."""
    spark = values.sparkSession
    forms = sql(spark, _FORMS, entries=entries)
    segments = sql(spark, _SEGMENTS, forms=forms)
    layout = sql(spark, "SELECT DISTINCT field, len, k, seg, start, size FROM $segments", segments=segments)
    probes = parallel(sql(spark, _PROBES, values=values))
    candidates = sql(spark, _CANDIDATES, probes=probes, layout=layout, segments=segments)
    return sql(spark, _BEST, candidates=candidates)


_ASKED = r"""
SELECT r.field, r.row_id, r.value FROM $rows r LEFT ANTI JOIN $entries e ON r.field = e.field AND r.value = e.entry
WHERE r.value RLIKE '[^\\p{Z}\\s\\p{Cf}]'
"""
_JUDGED = f"""
SELECT v.field, v.value, v.n, b.entry FROM $values v JOIN $best b ON v.field = b.field AND v.value = b.value
UNION ALL SELECT v.field, v.value, v.n, '{UNMATCHED}' FROM $values v LEFT ANTI JOIN $best b ON v.field = b.field AND v.value = b.value
"""
#: Values of more rows than $limit are few by construction and come back by a broadcast, their rows unshuffled.
_BACK = """
SELECT /*+ BROADCAST(j) */ a.field, a.row_id, a.value, j.entry FROM $asked a JOIN $judged j ON a.field = j.field AND a.value = j.value AND j.n > $limit
UNION ALL SELECT a.field, a.row_id, a.value, j.entry
FROM (SELECT /*+ BROADCAST(h) */ a.* FROM $asked a LEFT ANTI JOIN (SELECT field, value FROM $judged WHERE n > $limit) h ON a.field = h.field AND a.value = h.value) a
JOIN (SELECT * FROM $judged WHERE n <= $limit) j ON a.field = j.field AND a.value = j.value
"""


def judged_values(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(field, value, n, entry or UNMATCHED) of the different values of ``asked``; unmatched ones by an anti-join."""
    spark = asked.sparkSession
    values = cut(sql(spark, "SELECT field, value, count(*) AS n FROM $asked GROUP BY field, value", asked=asked))
    best = cut(match_values(values.select("field", "value"), entries))
    return cut(sql(spark, _JUDGED, values=values, best=best))


def map_to_entries(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(field, row_id, value, entry or UNMATCHED) of ``rows`` (field, row_id, value).

    Values are matched once each. They come back to their rows by a join in which values of more than a thousandth of all
    rows, fewer than a thousand, are broadcast.
    """
    spark = rows.sparkSession
    asked = sql(spark, _ASKED, rows=rows, entries=entries)
    judged = judged_values(asked, entries)
    total = sql(spark, "SELECT coalesce(sum(n), 0) AS n FROM $judged", judged=judged).first()[0]
    return sql(spark, _BACK.replace("$limit", str(max(total // 1000, 1))), asked=asked, judged=judged)


_ENTRIES = """
WITH e AS (SELECT 'effect' AS field, term AS entry FROM $terms UNION ALL SELECT 'frequency', category FROM $ranges)
SELECT field, entry, entry AS form FROM e WHERE entry IS NOT NULL
UNION ALL SELECT e.field, e.entry, s.variant FROM e JOIN $synonyms s ON s.canonical = e.entry WHERE s.variant IS NOT NULL
"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries = sql(spark, _ENTRIES, terms=table(spark, sf_dir, "effect_terms"), ranges=table(spark, sf_dir, "frequency_ranges"), synonyms=table(spark, sf_dir, "synonyms"))
    rows = sql(
        spark,
        "SELECT 'effect' AS field, id AS row_id, effect AS value FROM $se UNION ALL SELECT 'frequency', row_id, frequency FROM $dse",
        se=table(spark, sf_dir, "side_effects"), dse=table(spark, sf_dir, "drug_side_effects"),
    )
    return rows, entries


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_to_entries(*_inputs(spark, sf_dir)).select("field", "row_id", "entry")


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched values with their number of rows."""
    rows, entries = _inputs(spark, sf_dir)
    judged = judged_values(sql(spark, _ASKED, rows=rows, entries=entries), entries)
    return sql(spark, f"SELECT field, value, n FROM $judged WHERE entry = '{UNMATCHED}'", judged=judged)


QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched}


def _duck(expression: str) -> str:
    """The same expression in DuckDB: one backslash, global replacement, its sign for a group."""
    plain = expression.replace("\\\\", "\\").replace("'$1 '", "'\\1 '")
    out, depth, calls = [], 0, []
    for i, c in enumerate(plain):
        if plain.startswith("regexp_replace(", i):
            calls.append(depth + 1)
        if c == "(" and not _quoted(plain, i):
            depth += 1
        if c == ")" and not _quoted(plain, i):
            if calls and calls[-1] == depth:
                out.append(", 'g'")
                calls.pop()
            depth -= 1
        out.append(c)
    return "".join(out)


def _quoted(text: str, at: int) -> bool:
    return text.count("'", 0, at) % 2 == 1


_LETTERS = "абвгдежзийклмнопрстуфхцчшщъыьэюяіјѕ"
#: One byte a letter, as that engine's distance counts bytes.
_BYTES = lambda v: f"translate({v}, '{_LETTERS}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+')"
SQL: dict[str, str] = {
    "p3_found": rf"""WITH e AS (SELECT 'effect' AS field, term AS entry FROM effect_terms UNION ALL SELECT 'frequency', category FROM frequency_ranges),
  n AS (SELECT field, entry, entry AS form FROM e UNION ALL SELECT e.field, e.entry, s.variant FROM e JOIN synonyms s ON s.canonical = e.entry),
  f AS (SELECT DISTINCT field, entry, {_duck(fold_sql('form'))} AS form FROM n),
  r AS (SELECT 'effect' AS field, id AS row_id, effect AS value FROM side_effects UNION ALL SELECT 'frequency', row_id, frequency FROM drug_side_effects),
  a AS (SELECT r.* FROM r LEFT JOIN e ON e.field = r.field AND e.entry = r.value WHERE e.entry IS NULL AND regexp_matches(r.value, '[^\p{{Z}}\s\p{{Cf}}]')),
  v AS (SELECT field, value, {_duck(_variants_sql('value')).replace('array(', '[', 1)[:-1]}] AS vs FROM (SELECT DISTINCT field, value FROM a)),
  p AS (SELECT field, value, unnest([0, 1, 2]) AS variant, unnest(vs) AS v FROM v),
  c AS (SELECT p.field, value, entry, variant, levenshtein({_BYTES('v')}, {_BYTES('form')}) AS d, abs(length(v) - length(form)) AS gap, {_edits_sql('length(form)')} AS k
    FROM p JOIN f ON p.field = f.field AND abs(length(v) - length(form)) <= 4 WHERE v <> '' AND form <> ''),
  b AS (SELECT field, value, arg_min(entry, (d, variant, gap, entry)) AS entry FROM c WHERE d <= k GROUP BY 1, 2)
SELECT a.field, a.row_id, coalesce(b.entry, '{UNMATCHED}') AS entry FROM a LEFT JOIN b ON b.field = a.field AND b.value = a.value""".replace("\\\\", "\\"),
}
SQL["p3_unmatched"] = f"SELECT field, value, count(*) AS n FROM ({SQL['p3_found'].replace('SELECT a.field, a.row_id,', 'SELECT a.field, a.value,')}) WHERE entry = '{UNMATCHED}' GROUP BY 1, 2"
