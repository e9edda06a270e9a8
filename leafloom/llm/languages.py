"""Problem 10: the language of each document and of each line of a mixed one, by a linear-chain conditional random field.

A word is described by its affixes, character n-grams and its entry in a lexicon; a label depends on the word and on
the label before, with other transitions across a line break than within a line. Weights and transitions are learned
on a bounded sample of labelled documents (``per_language`` documents of at most ``sample_chars`` characters for each
language); wrong labels in the sample are outvoted beforehand, line by line, by word frequencies. Every document is then
labelled whole by forward-backward: lines are reduced to transfer matrices, which are chained through the document, so
the labels of words far apart still inform each other. A line's language is the one with most of its word characters'
posterior; a line without words takes it from the lines around it.

Defined results: null and blank texts and texts without any letter have no language and give no row; repeated ids each
give their rows; lines are what stands between line feeds, blank lines included; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.common import spread, table
from leafloom.llm.lookalikes import by_table

LANGUAGES = ("ru", "en", "de", "lv", "uk")
K = len(LANGUAGES)
#: The bound of the training sample.
PER_LANGUAGE, SAMPLE_CHARS = 200, 4000
#: Training ends when so many rounds lower the best loss by less than this share; a guard against no end.
WINDOW, SETTLED, MOST_ROUNDS = 10, 0.1, 1_000
#: Words whose emissions a worker remembers; characters it labels at once.
MEMORY, CHUNK = 300_000, 1_500_000
#: A document counts as mixed only if another language's lines hold at least this posterior.
SURE = 0.6

_TOKENS = re.compile(r"[^\W\d_]+|\n")
_BREAK = -1


def features(word: str) -> list[str]:
    """Affixes, n-grams within the word's borders, and the word itself."""
    w = by_table(word).lower()
    framed = f"^{w}$"
    out = ["w:" + w]
    out += ["p:" + w[:n] for n in (1, 2, 3, 4) if len(w) >= n]
    out += ["s:" + w[-n:] for n in (1, 2, 3, 4) if len(w) >= n]
    out += [f"g:{framed[i : i + n]}" for n in (1, 2, 3) for i in range(len(framed) - n + 1)]
    return out


class Field:
    """The learned weights."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, within: np.ndarray, across: np.ndarray) -> None:
        self.index, self.weights, self.within, self.across = index, weights, within, across

    def scores(self, word: str) -> np.ndarray:
        at = [i for f in features(word) if (i := self.index.get(f)) is not None]
        return self.weights[at].sum(0) if at else np.zeros(K, np.float32)


def _padded(sequences: list[tuple[list[int], list[bool]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(w) for w, _ in sequences)
    words = np.zeros((len(sequences), longest), np.int64)
    breaks = np.zeros((len(sequences), longest), bool)
    there = np.zeros((len(sequences), longest), bool)
    for i, (w, b) in enumerate(sequences):
        words[i, : len(w)], breaks[i, : len(w)], there[i, : len(w)] = w, b, True
    return words, breaks, there


def marginals(emissions: np.ndarray, breaks: np.ndarray, there: np.ndarray, within: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of every label, and expected transitions within lines and across line breaks.

    ``emissions`` (sequences, steps, labels), ``within`` and ``across`` are positive factors, not logarithms; ``there`` marks
    the steps of each sequence, from its first on.
    """
    n, steps, _ = emissions.shape
    lengths = there.sum(1)
    # longest first, so that at each step the sequences still going are the first ones
    order = np.argsort(-lengths, kind="stable")
    e, at_break = emissions[order], breaks[order]
    alive = [int((lengths > t).sum()) for t in range(steps)]
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    a = np.full((n, K), 1 / K)
    for t, k in enumerate(alive):
        new = e[:k, t] * (np.where(at_break[:k, t, None], a[:k] @ across, a[:k] @ within) if t else a[:k])
        a[:k] = new / new.sum(1, keepdims=True)
        alpha[:k, t] = a[:k]
    counts = [np.zeros((K, K)), np.zeros((K, K))]
    b = np.ones((n, K))
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        beta[:k, t] = b[:k]
        if t and k:
            eb = e[:k, t] * b[:k]
            for flag, m in ((False, within), (True, across)):
                use = np.nonzero(at_break[:k, t] == flag)[0]
                if len(use):
                    before = alpha[use, t - 1]
                    counts[flag] += m * ((before / ((before @ m) * eb[use]).sum(1, keepdims=True)).T @ eb[use])
            new = np.where(at_break[:k, t, None], eb @ across.T, eb @ within.T)
            b[:k] = new / new.sum(1, keepdims=True)
    post = alpha * beta
    post /= np.maximum(post.sum(2, keepdims=True), 1e-300)
    out = np.empty_like(post)
    out[order] = post
    return out * there[:, :, None], counts[0], counts[1]


def _vote(documents: list[list[list[str]]], labels: list[int]) -> list[list[int]]:
    """The label of each line by word frequencies over the sample; this outvotes wrong labels and finds mixed texts."""
    counts: dict[str, np.ndarray] = {}
    for lines, label in zip(documents, labels):
        for w in {w for line in lines for w in line}:
            counts.setdefault(w, np.zeros(K))[label] += 1
    size = np.bincount(labels, minlength=K) + 1.0
    logs = {w: np.log((c + 0.02) / size) for w, c in counts.items()}
    none = np.zeros(K)
    return [[int(np.argmax(sum((logs[w] for w in line), none))) if line else -1 for line in lines] for lines in documents]


def train(rows: list[tuple[str, str]], settled: float = SETTLED, rate: float = 0.25, ridge: float = 1e-4) -> Field:
    """Fit the field to (text, label) rows by gradient ascent on the likelihood of the voted labels, until it settles."""
    documents = [[[w.lower() for w in re.findall(r"[^\W\d_]+", line)] for line in text.split("\n")] for text, _ in rows]
    voted = _vote(documents, [LANGUAGES.index(label) for _, label in rows])
    vocabulary: dict[str, int] = {}
    sequences, targets = [], []
    for lines, labels in zip(documents, voted):
        words, breaks, gold = [], [], []
        for line, label in zip(lines, labels):
            for j, w in enumerate(line):
                words.append(vocabulary.setdefault(w, len(vocabulary)))
                breaks.append(j == 0)
                gold.append(label)
        if words:
            sequences.append((words, breaks))
            targets.append(gold)
    if not sequences:
        return Field({}, np.zeros((0, K), np.float32), np.full((K, K), 1 / K), np.full((K, K), 1 / K))
    seen: dict[str, int] = {}
    per_word = [features(w) for w in vocabulary]
    for fs in per_word:
        for f in set(fs):
            seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(f for f, n in seen.items() if n > 1 or f[0] == "w")}
    rows_at = np.concatenate([np.full(sum(f in index for f in fs), i) for i, fs in enumerate(per_word)])
    cols_at = np.array([index[f] for fs in per_word for f in fs if f in index])
    words, breaks, there = _padded(sequences)
    gold = np.zeros((*words.shape, K))
    for i, g in enumerate(targets):
        gold[i, np.arange(len(g)), g] = 1
    gold_within, gold_across = np.zeros((K, K)), np.zeros((K, K))
    for (_, b), g in zip(sequences, targets):
        for j in range(1, len(g)):
            (gold_across if b[j] else gold_within)[g[j - 1], g[j]] += 1
    weights = np.zeros((len(index), K))
    trans = [np.eye(K), np.eye(K)]
    past = [np.full(weights.shape, 1e-8), np.full((K, K), 1e-8), np.full((K, K), 1e-8)]
    flat = words[there]
    total = len(flat)
    losses: list[float] = []
    for _ in range(MOST_ROUNDS):
        by_word = np.zeros((len(vocabulary), K))
        for k in range(K):
            by_word[:, k] = np.bincount(rows_at, weights[cols_at, k], len(vocabulary))
        e = np.exp(by_word - by_word.max(1, keepdims=True))[words]
        post, within, across = marginals(e, breaks, there, np.exp(trans[0]), np.exp(trans[1]))
        off = (gold - post)[there]
        losses.append(float(-np.log(np.maximum((gold * post).sum(2)[there], 1e-12)).mean()))
        if len(losses) > 2 * WINDOW and min(losses[-WINDOW:]) > (1 - settled) * min(losses[:-WINDOW]):
            break
        grads = [np.empty_like(weights), (gold_within - within) / total - ridge * trans[0], (gold_across - across) / total - ridge * trans[1]]
        for k in range(K):
            per = np.bincount(flat, off[:, k], len(vocabulary))
            grads[0][:, k] = np.bincount(cols_at, per[rows_at], len(index)) / total - ridge * weights[:, k]
        for x, g, p in zip([weights, *trans], grads, past):
            p *= 0.9
            p += 0.1 * g * g
            x += rate * 0.3 * g / np.sqrt(p + 1e-12)
        rate *= 0.97
    factors = [np.exp(t - t.max()) for t in trans]
    return Field(index, weights.astype(np.float32), *factors)


class Emissions(dict):
    """Row of each word in ``table``; words are scored when first met."""

    def __init__(self, field: Field) -> None:
        super().__init__({"\n": _BREAK})
        self.field, self.rows = field, []

    def __missing__(self, word: str) -> int:
        s = self.field.scores(word)
        self.rows.append(np.exp(np.maximum(s - s.max(), -25)))
        self[word] = len(self.rows) - 1
        return self[word]


def label_lines(texts: list[str], emissions: Emissions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the lines of all texts in turn: the text's number, label posteriors, and word characters.

    Lines are processed side by side, longest first, so that each step is one operation over all lines still going.
    """
    found = [_TOKENS.findall(t) for t in texts]
    counts = np.array([len(f) for f in found])
    ids = np.fromiter((emissions[w] for f in found for w in f), np.int64, int(counts.sum()))
    sizes = np.fromiter((len(w) for f in found for w in f), np.int64, len(ids))
    of_text = np.repeat(np.arange(len(texts)), counts)
    is_break = ids == _BREAK
    # every text begins a line, every break another
    lines_in = np.bincount(of_text[is_break], minlength=len(texts)) + 1
    line_text = np.repeat(np.arange(len(texts)), lines_in)
    line_of = of_text + np.cumsum(is_break)
    keep = ~is_break
    ids, sizes, line_of = ids[keep], sizes[keep], line_of[keep]
    n_lines = len(line_text)
    length = np.bincount(line_of, minlength=n_lines)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    table_ = np.array(emissions.rows, np.float32) if emissions.rows else np.ones((1, K), np.float32)
    order = np.argsort(-length, kind="stable")
    sorted_first, going = first[order], -np.sort(-length)
    within, across = emissions.field.within.astype(np.float32), emissions.field.across.astype(np.float32)
    matrix = np.tile(np.eye(K, dtype=np.float32), (n_lines, 1, 1))
    steps = int(going[0]) if n_lines else 0
    alive = [int(np.searchsorted(-going, -t)) for t in range(steps)]  # lines longer than t
    for t in range(steps):
        k = alive[t]
        m = (matrix[:k].reshape(-1, K) @ (within if t else across)).reshape(k, K, K)
        m *= table_[ids[sorted_first[:k] + t]][:, None, :]
        m /= m.max((1, 2), keepdims=True)
        matrix[:k] = m
    place = np.empty(n_lines, np.int64)
    place[order] = np.arange(n_lines)
    into, out_of = _chain(matrix, place, line_text, lines_in)
    # words: forward from what comes into the line, backward from what comes after it
    alpha = np.empty((len(ids), K), np.float32)
    a = into[order]
    for t in range(steps):
        k = alive[t]
        x = (a[:k] @ (within if t else across)) * table_[ids[sorted_first[:k] + t]]
        x /= x.sum(1, keepdims=True)
        a[:k] = x
        alpha[sorted_first[:k] + t] = x
    posterior = np.zeros((n_lines, K))
    b = out_of[order]
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = sorted_first[:k] + t
        p = alpha[at] * b[:k]
        p /= p.sum(1, keepdims=True)
        posterior[order[:k]] += p * sizes[at][:, None]
        x = (table_[ids[at]] * b[:k]) @ (within if t else across).T
        x /= x.sum(1, keepdims=True)
        b[:k] = x
    chars = posterior.sum(1)
    idle = chars == 0
    posterior[idle] = into[idle] * out_of[idle]
    posterior /= posterior.sum(1, keepdims=True)
    return line_text, posterior, chars


def _chain(matrix: np.ndarray, place: np.ndarray, line_text: np.ndarray, lines_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages into each line from those before it, and from those after it, text by text side by side."""
    n = len(line_text)
    into, out_of = np.empty((n, K), np.float32), np.empty((n, K), np.float32)
    start = np.concatenate([[0], np.cumsum(lines_in)[:-1]])
    order = np.argsort(-lines_in, kind="stable")
    many, start = -np.sort(-lines_in), start[order]
    steps = int(many[0]) if len(many) else 0
    alive = [int(np.searchsorted(-many, -t)) for t in range(steps)]
    a = np.full((len(many), K), 1 / K, np.float32)
    for t in range(steps):
        at = start[: alive[t]] + t
        into[at] = a[: alive[t]]
        x = np.einsum("ij,ijk->ik", a[: alive[t]], matrix[place[at]])
        a[: alive[t]] = x / x.sum(1, keepdims=True)
    b = np.ones((len(many), K), np.float32)
    for t in range(steps - 1, -1, -1):
        at = start[: alive[t]] + t
        out_of[at] = b[: alive[t]]
        x = np.einsum("ijk,ik->ij", matrix[place[at]], b[: alive[t]])
        b[: alive[t]] = x / x.sum(1, keepdims=True)
    return into, out_of


_OUT = pa.schema([("lang", pa.string()), ("confidence", pa.float64()), ("line_langs", pa.list_(pa.string())), ("line_confidences", pa.list_(pa.float64()))])


def _labelled(texts: list[str], emissions: Emissions) -> list[tuple]:
    line_text, posterior, chars = label_lines(texts, emissions)
    best, sure = posterior.argmax(1), posterior.max(1)
    first = np.searchsorted(line_text, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        s = slice(first[i], first[i + 1])
        b, c, p = best[s], chars[s], posterior[s]
        if not c.any():
            out.append((None, None, None, None))
            continue
        total = (p * c[:, None]).sum(0) / c.sum()
        spoken = set(b[(c > 0) & (sure[s] >= SURE)].tolist())
        if len(spoken) < 2:
            main = int(total.argmax())
            out.append((LANGUAGES[main], float(total[main]), None, None))
            continue
        size = np.array([len(x) for x in text.split("\n")])
        main = int(np.bincount(b, size, K).argmax())
        out.append((LANGUAGES[main], float(total[main]), [LANGUAGES[x] for x in b], sure[s].tolist()))
    return out


def _labeller(field) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(field.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                rows = _labelled(texts[at:end], emissions)
                columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)]
                yield pa.record_batch([*(c.slice(at, end - at) for c in batch.columns[:-1]), *columns], names=[*batch.schema.names[:-1], *_OUT.names])
                at = end
                if len(emissions) > MEMORY:
                    emissions = Emissions(field.value)

    return run


def training_sample(documents: DataFrame, per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``per_language`` texts of each language, chosen by a hash of the id; the only rows that reach the driver."""
    usable = documents.filter(F.col("lang").isin(*LANGUAGES) & F.col("n_chars").between(1, sample_chars))
    have = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(min(1.0, 1.2 * per_language / n) * (1 << 30)))) for lang, n in have.items()]) if have else F.lit(0)
    rows = usable.filter(drawn < share).select("text", "lang", "doc_id").orderBy(F.xxhash64("doc_id")).limit(2 * per_language * K).collect()
    out: list[tuple[str, str]] = []
    for lang in LANGUAGES:
        out += [(r.text, lang) for r in rows if r.lang == lang][:per_language]
    return out


def detect(documents: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """``keep`` with lang, confidence and, for mixed documents only, line_langs and line_confidences."""
    spark = documents.sparkSession
    rows = spread(documents.filter(F.col("text").isNotNull()).select(*keep, "text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = spark.sparkContext.broadcast(field)
    return rows.mapInArrow(_labeller(shared), f"{fields}, lang string, confidence double, line_langs array<string>, line_confidences array<double>").filter("lang IS NOT NULL")


def _detected(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return detect(documents.select("doc_id", F.col("lang").alias("label"), "text"), train(training_sample(documents)), keep)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _detected(spark, sf_dir, ["doc_id", "label"])
    # one row a document and one a line, from one pass over the texts
    wrong = F.when(~F.col("label").eqNullSafe(F.col("lang")), F.array(F.struct(F.lit(-1).alias("seg_no"), F.col("lang")))).otherwise(F.array().cast("array<struct<seg_no:int,lang:string>>"))
    lines = F.transform(F.coalesce("line_langs", F.array().cast("array<string>")), lambda x, i: F.struct(i.cast("int").alias("seg_no"), x.alias("lang")))
    return found.select("doc_id", F.inline(F.concat(wrong, lines)))


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document."""
    return _detected(spark, sf_dir, ["doc_id"]).select("doc_id", "lang", "confidence", F.col("line_langs").isNotNull().alias("mixed"))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every line of the documents in several languages."""
    found = _detected(spark, sf_dir, ["doc_id"]).filter("line_langs IS NOT NULL")
    return found.select("doc_id", F.posexplode(F.arrays_zip("line_langs", "line_confidences")).alias("seg_no", "s")).select("doc_id", "seg_no", F.col("s.line_langs").alias("lang"), F.col("s.line_confidences").alias("confidence"))


QUERIES = {"p10_found": p10_found, "p10_documents": p10_documents, "p10_segments": p10_segments}
SQL: dict[str, str] = {}
