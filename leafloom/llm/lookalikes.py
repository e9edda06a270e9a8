"""Problem 2: text that looks the same in different characters, brought to one consistent form.

A word is suspicious if it holds a wide or joined form, a separate accent, an invisible sign, an unusual space, a
hyphen that forbids a break, or letters of two alphabets. Every other word belongs to the vocabulary, which is counted
over all texts. Words are grouped by a coarse key (look-alikes folded, marks and ignorables dropped); in each group a
trie of the vocabulary is walked, sign by sign as they stand in the text, by a weighted edit automaton: look-alikes,
special forms, invisible signs and accents that join their letter cost nothing, an accent more or less costs ACCENT (it
stays as written, only the alphabet is taken over), any other edit EDIT, which is more than the budget: it would change
the look. Of the spellings within the budget the cheapest, then the most frequent one is canonical; a word that matches
none is rewritten by table.

Defined results: null and empty texts never change; a text may be of any length and is processed whole; repeated ids
each give a row; typographic quotes and dashes, superscripts, fractions and words of one alphabet are left as they are.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.common import cut, skew_join, spread, table

#: Lower-case letters that look alike in the Latin, Cyrillic and Greek alphabets.
LOOK_ALIKES = ("aаα", "bьЬ", "cсϲ", "dԁ", "eеε", "gɡ", "hһ", "iіι", "jјϳ", "kкκ", "lӏ", "mм", "nпη", "oоοσ", "pрρ", "qԛ", "sѕ", "tтτ", "uυ", "vνѵ", "wѡԝ", "xхχ", "yуγ", "rг", "ïї", "ëё", "öӧ", "äӓ", "ăӑ")
#: Capital letters that look alike.
LOOK_ALIKE_CAPITALS = ("AАΑ", "BВΒ", "CСϹ", "EЕΕ", "HНΗ", "IІΙӀ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "SЅ", "TТΤ", "XХΧ", "YУΥҮ", "ZΖ", "ГΓ", "ПΠ", "ФΦ", "ЛΛ", "ÏЇ", "ËЁ", "ÖӦ", "ÄӒ")
#: Joined letter forms, plain letters.
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj", "ǳ": "dz", "և": "եւ"}
#: Most a spelling may cost; the costs of an accent more or less and of any other edit. Look-alikes and ignorables are free.
BUDGET, ACCENT, EDIT = 0.5, 0.5, 1.0
#: Distinct words a task counts before it hands them on; odd words of a bucket.
FLUSH, BUCKET_WORDS = 100_000, 5_000

_ALPHABETS = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}


def _plain_forms() -> dict[str, str]:
    """Sign by sign: wide, narrow, non-breaking and styled forms, unusual spaces and joined letters to plain ones, by rule."""
    out = dict(JOINED)
    for code in [*range(0xA0, 0x3100), *range(0xA640, 0xA7FF), *range(0xFE00, 0xFFF0), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        kind = unicodedata.category(c)
        how = unicodedata.decomposition(c).partition(">")[0]
        if kind == "Zs" or code in (0x2028, 0x2029):
            out[c] = " "
        elif kind == "Cf" or code in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= code <= 0xFE0F:
            out[c] = ""
        elif how in ("<wide", "<narrow", "<noBreak", "<font"):
            out[c] = unicodedata.normalize("NFKC", c)
    return out | {"\u2011": "-"}


PLAIN = _plain_forms()


def alphabet(c: str) -> str:
    """L, C or G for a letter of the three alphabets, empty for anything else."""
    if c < "ª":
        return "L" if c.isalpha() else ""
    return _ALPHABETS.get(unicodedata.name(c, "").partition(" ")[0], "") if c.isalpha() else ""


def _class_of() -> dict[str, dict[str, str]]:
    """For each letter the letters of the same look, by alphabet."""
    out: dict[str, dict[str, str]] = {}
    for group in LOOK_ALIKES + LOOK_ALIKE_CAPITALS:
        by = {}
        for c in group:
            by.setdefault(alphabet(c), c)
        for c in group:
            out[c] = by
    return out


SAME = _class_of()
_SPECIAL = "".join(sorted(c for c in PLAIN if len(c) == 1))


def _ranges(chars: str) -> list[tuple[int, int]]:
    """First and last code points of the runs in sorted ``chars``."""
    codes, parts, i = [ord(c) for c in chars], [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append((codes[i], codes[j]))
        i = j + 1
    return parts


_RANGES = _ranges(_SPECIAL)
_LATIN, _CYRILLIC, _GREEK = "A-Za-zÀ-ÖØ-öø-ɏ", "Ѐ-ԯ", "Ͱ-ͳͶ-ͽΆ-Ͽ"
_MARK = "̀-ͯ"


def _class() -> str:
    one = lambda n: re.escape(chr(n))
    return "".join(one(a) if a == b else f"{one(a)}-{one(b)}" for a, b in _RANGES)


def _suspicion() -> str:
    pairs = "|".join(f"[{a}][{_MARK}]*[{b}]" for a in (_LATIN, _CYRILLIC, _GREEK) for b in (_LATIN, _CYRILLIC, _GREEK) if a != b)
    return f"[{_MARK}{_class()}]|{pairs}"


#: Finds a suspicious place.
_SUSPICIOUS = re.compile(_suspicion())
_SPECIAL_SIGN = re.compile(f"[{_MARK}{_class()}]")
_TOKEN = re.compile(r"[^ \t\r\n]+")
_IGNORABLE = "".join(sorted(c for c, plain in PLAIN.items() if not plain))
_INVISIBLE = "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _ranges(_IGNORABLE))
#: A word as it stands in the text, with its accents and invisible signs.
_RAW_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARK}{_INVISIBLE}])*")
_CLEAN_WORD = re.compile(r"[^\W\d_]+")


def _simple(token: str) -> str:
    """The token without special forms, accents joined to their letters."""
    return unicodedata.normalize("NFC", "".join(PLAIN.get(c, c) for c in token))


def coarse_key(word: str) -> str:
    """Equal for all words that look alike: letters of one look folded together, marks and ignorables dropped."""
    out = []
    for c in unicodedata.normalize("NFD", _simple(word)):
        if not unicodedata.combining(c):
            by = SAME.get(c)
            out.append(next(iter(by.values())) if by else c)
    return "".join(out)


def by_table(word: str) -> str:
    """The word in the alphabet most of its letters force: letters without a twin decide, then the majority."""
    word = _simple(word)
    votes: Counter[str] = Counter()
    for c in word:
        a = alphabet(c)
        if a:
            votes[a] += 1 if c in SAME else 1000
    if len(votes) < 2:
        return word
    best = max(votes, key=lambda a: (votes[a], a == "C", a))
    return unicodedata.normalize("NFC", "".join(SAME[c].get(best, c) if c in SAME and alphabet(c) not in ("", best) else c for c in word))


class Vocabulary:
    """Trie of canonical spellings with counts, walked by a weighted edit automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[None] = node.get(None, 0) + count

    def best(self, word: str, budget: float = BUDGET) -> str | None:
        """The spelling of a word as it stands in the text: least cost first, then count, then code points; None beyond the budget."""
        units = [p for c in word for p in PLAIN.get(c, c)]
        found: list[tuple[float, int, str]] = []
        stack: list[tuple[dict, int, float, str]] = [(self.root, 0, 0.0, "")]
        while stack:
            node, i, cost, made = stack.pop()
            if i == len(units) and None in node:
                found.append((cost, -node[None], unicodedata.normalize("NFC", made)))
            if cost + EDIT <= budget:
                stack += [(below, i, cost + EDIT, made + edge) for edge, below in node.items() if edge is not None]
                if i < len(units):
                    stack.append((node, i + 1, cost + EDIT, made))
                    stack += [(below, i + 1, cost + EDIT, made + edge) for edge, below in node.items() if edge is not None]
            if i == len(units):
                continue
            if unicodedata.combining(units[i]):
                # an accent the spelling does not have
                if cost + ACCENT <= budget:
                    stack.append((node, i + 1, cost + ACCENT, made + units[i]))
                continue
            twins = _twins(units[i])
            stack += [(node[t], i + 1, cost, made + t) for t in twins if t in node]
            if i + 1 < len(units) and unicodedata.combining(units[i + 1]):
                joined = {j for t in twins if len(j := unicodedata.normalize("NFC", t + units[i + 1])) == 1}
                stack += [(node[t], i + 2, cost, made + t) for j in joined for t in _twins(j) if t in node]
            if cost + ACCENT <= budget:
                # the spelling has an accent more or less on this letter: what is written stays, in its alphabet
                for edge in node:
                    if edge is not None and edge not in twins and (bare := _bare(edge)) and (pair := _twins(bare) & _twins(_bare(units[i]))):
                        own = unicodedata.normalize("NFD", units[i])[1:]
                        same = next(t for t in sorted(pair) if alphabet(t) == alphabet(bare))
                        stack.append((node[edge], i + 1, cost + ACCENT, made + same + own))
        return min(found)[2] if found else None


@functools.lru_cache(maxsize=10_000)
def _twins(c: str) -> frozenset[str]:
    """The letter and those of the same look."""
    return frozenset({c, *SAME.get(c, {}).values()})


@functools.lru_cache(maxsize=10_000)
def _bare(c: str) -> str:
    """The letter without its accents."""
    return unicodedata.normalize("NFD", c)[0]


def suspicious_tokens(text: str) -> list[str]:
    """The runs between ordinary blanks that hold a suspicious place."""
    out, end = [], -1
    for m in _SUSPICIOUS.finditer(text):
        if m.start() < end:
            continue
        start = max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start()), text.rfind("\t", 0, m.start()), text.rfind("\r", 0, m.start())) + 1
        token = _TOKEN.match(text, start)
        end = token.end()
        out.append(token.group())
    return out


def odd_words(token: str) -> list[str]:
    """The words of a suspicious token, as they stand there."""
    return _RAW_WORD.findall(token)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over whole texts (table_name, row_id, text): their suspicious tokens, and the counts of clean words.

    A word is judged once a partition; a text is searched for tokens only if it holds a special sign or an odd word.
    Counts and verdicts are handed on and forgotten when they grow beyond FLUSH.
    """
    counts: Counter[str] = Counter()
    odd: set[str] = set()

    def vocabulary() -> pa.RecordBatch:
        words = [w for w in counts if w not in odd]
        batch = pa.record_batch(
            [pa.nulls(len(words), pa.string()), pa.nulls(len(words), pa.int64()), pa.array(words, pa.string()), pa.array([coarse_key(w) for w in words], pa.string()), pa.array([counts[w] for w in words], pa.int64())],
            names=["table_name", "row_id", "word", "key", "n"],
        )
        counts.clear()
        odd.clear()
        return batch

    for b in batches:
        found = []
        for name, row, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            words = _CLEAN_WORD.findall(text)
            for w in set(words).difference(counts):
                if _SUSPICIOUS.search(w):
                    odd.add(w)
            counts.update(words)
            if _SPECIAL_SIGN.search(text) or not odd.isdisjoint(words):
                found += [(name, row, token) for token in dict.fromkeys(suspicious_tokens(text))]
        if found:
            yield pa.record_batch(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.string()), pa.nulls(len(found), pa.string()), pa.nulls(len(found), pa.int64())],
                names=["table_name", "row_id", "word", "key", "n"],
            )
        if len(counts) > FLUSH:
            yield vocabulary()
    yield vocabulary()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = sorted({w for token in b.column(0).to_pylist() for w in odd_words(token)})
        yield pa.record_batch([pa.array(words, pa.string()), pa.array([coarse_key(w) for w in words], pa.string())], names=["word", "key"])


def _spell(key: tuple, odd: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """One bucket of keys: a trie of its vocabulary, walked once for each odd word."""
    trie = Vocabulary()
    for word, n in zip(known["word"], known["n"]):
        trie.add(word, int(n))
    words = sorted(set(odd["word"]))
    return pd.DataFrame({"word": words, "spelling": [trie.best(w) or by_table(w) for w in words]})


def spellings(tokens: DataFrame, words: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(word, spelling) of every word of the suspicious ``tokens``; ``words`` (key, word, n) are the counts of all texts.

    Only vocabulary whose key an odd word shares is kept, so a bucket's trie is no larger than its odd words' twins; the
    number of buckets follows that of the odd words.
    """
    odd = cut(tokens.select("token").mapInArrow(_words, "word string, key string").distinct())
    buckets = max(1, -(-odd.count() // bucket_words))
    known = words.join(odd.select("key").distinct(), "key", "left_semi").groupBy("key", "word").agg(F.sum("n").alias("n"))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    return odd.select(bucket, "word").groupBy("bucket").cogroup(known.select(bucket, "word", "n").groupBy("bucket")).applyInPandas(_spell, "word string, spelling string")


def rewrite(token: str, spelling: dict[str, str]) -> str:
    """The token in the consistent form: its words by their spelling, what stands between them by table."""
    out, at = [], 0
    for m in _RAW_WORD.finditer(token):
        out += [_simple(token[at : m.start()]), spelling.get(m.group()) or by_table(m.group())]
        at = m.end()
    return "".join([*out, _simple(token[at:])])


def _token_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(token, w) for token in b.column(0).to_pylist() for w in sorted(set(odd_words(token)))]
        yield pa.record_batch([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.string())], names=["token", "word"])


def consistent_tokens(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, form) of the suspicious ``tokens``, each given once."""
    distinct = tokens.select("token")
    words = distinct.mapInArrow(_token_words, "token string, word string").join(spellings(distinct, words), "word")
    # one row a token: its words with their spellings are as few as the token is long
    pairs = words.groupBy("token").agg(F.map_from_entries(F.collect_set(F.struct("word", "spelling"))).alias("spelling"))
    return distinct.join(pairs, "token", "left").mapInArrow(_rewrite_batches, "token string, form string")


def _rewrite_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = b.column("token").to_pylist()
        spelling = [dict(x or ()) for x in b.column("spelling").to_pylist()]
        yield pa.record_batch([pa.array(tokens, pa.string()), pa.array([rewrite(t, s) for t, s in zip(tokens, spelling)], pa.string())], names=["token", "form"])


def changed_tokens(texts: DataFrame) -> DataFrame:
    """(table_name, row_id, token, form) where the consistent form differs from what stands there."""
    scanned = cut(texts.filter("text IS NOT NULL").select("table_name", "row_id", "text").mapInArrow(_scan, "table_name string, row_id bigint, word string, key string, n bigint"))
    tokens = scanned.filter("n IS NULL").select("table_name", "row_id", F.col("word").alias("token"))
    counted = cut(tokens.groupBy("token").agg(F.count("*").alias("rows")))
    forms = consistent_tokens(counted, scanned.filter("n IS NOT NULL").select("key", "word", "n")).filter("form <> token")
    total = counted.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # one token can stand in a third of all texts
    return skew_join(tokens, cut(forms.join(counted, "token")), ["token"], "rows", total)


def consistent_texts(texts: DataFrame) -> DataFrame:
    """(table_name, row_id, text, changed): every text in its consistent form."""
    forms = changed_tokens(texts).groupBy("table_name", "row_id").agg(F.map_from_entries(F.collect_set(F.struct("token", "form"))).alias("forms"))
    joined = texts.select("table_name", "row_id", "text").join(forms, ["table_name", "row_id"], "left")
    gaps = F.split("text", "[^ \\t\\r\\n]+")
    words = F.transform(F.regexp_extract_all("text", F.lit("([^ \\t\\r\\n]+)")), lambda t: F.coalesce(F.element_at("forms", t), t))
    rebuilt = F.array_join(F.flatten(F.zip_with(gaps, words, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return joined.select("table_name", "row_id", F.when(F.col("forms").isNull(), F.col("text")).otherwise(rebuilt).alias("text"), F.col("forms").isNotNull().alias("changed"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = table(spark, sf_dir, "side_effects").select(F.lit("side_effects").alias("table_name"), F.col("id").alias("row_id"), F.col("effect").alias("text"))
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_id"), "text")
    return effects.unionByName(documents).filter(F.col("text").isNotNull())


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_tokens(_texts(spark, sf_dir)).select("table_name", "row_id").distinct()


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form, as a hash and a length, and whether it changed."""
    return consistent_texts(_texts(spark, sf_dir)).select("table_name", "row_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), "changed")


QUERIES = {"p2_found": p2_found, "p2_texts": p2_texts}
SQL: dict[str, str] = {}
