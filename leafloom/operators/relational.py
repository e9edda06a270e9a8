"""Projections, joins, aggregations, ordered operators and set operations on the domain tables.

Every function takes DataFrames and returns one; null keys never match, as in SQL, unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.common import cut, numbered, running_sums

# ---- projections and filters


def tag_whitelist(edges: DataFrame, tags: list[str]) -> DataFrame:
    """Edges both of whose ends carry one of the tags."""
    return edges.filter(F.col("source_tag").isin(tags) & F.col("target_tag").isin(tags))


def valid_nodes(edges: DataFrame, tags: list[str]) -> DataFrame:
    """Distinct (name, tag) with a valid tag: ends of links, and side effects that stand alone."""
    ends = edges.select("source", "source_tag", "target", "target_tag")
    linked = edges.filter(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != "") & (F.col("target") != ""))
    nodes = linked.select(F.col("source").alias("name"), F.col("source_tag").alias("tag")).unionByName(linked.select(F.col("target").alias("name"), F.col("target_tag").alias("tag")))
    alone = ends.select(F.col("source").alias("name"), F.col("source_tag").alias("tag")).unionByName(ends.select(F.col("target").alias("name"), F.col("target_tag").alias("tag")))
    alone = alone.filter((F.col("tag") == "side_e") & (F.coalesce("name", F.lit("")) != ""))
    return nodes.unionByName(alone).filter(F.col("tag").isin(tags)).distinct()


def find_by_tag(nodes: DataFrame, tags: str | list[str]) -> DataFrame:
    return nodes.filter(F.col("tag").isin([tags] if isinstance(tags, str) else tags))


def with_source(df: DataFrame, column: str = "source") -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def contains_any(column: Column, stems: list[str]) -> Column:
    """Whether the text holds one of the stems, in any case."""
    return F.exists(F.array(*[F.lit(s.lower()) for s in stems]), lambda s: F.contains(F.lower(column), s))


def all_match(column: Column, patterns: list[str]) -> Column:
    """Whether the text matches every pattern."""
    return reduce(lambda a, b: a & b, (column.rlike(p) for p in patterns))


#: Patterns of sentences on protein binding and on elimination.
PROTEIN_BINDING = [r"(?i)\d+\s*(%|процент)", "(?iu)(связ|binding)", "(?iu)(белк|protein)"]
ELIMINATION = [r"(?iu)(TCmax|T1/2|Период\s+полувыведения)", "(?iu)(составляет|час|минут|секунд|сут)"]
#: Stems that disqualify a contraindication.
STOP_STEMS = ["гиперчувствительност", "чувствительност", "применение", "одновременное применение"]


def complete_entries(df: DataFrame, expected: int = 13, may_miss: str = "Фармакокинетические свойства") -> DataFrame:
    """Adds ``kept``: all chapters found, or all but the one that may miss."""
    one = (F.col("found_count") == expected - 1) & (F.col("not_found_list") == F.array(F.lit(may_miss)))
    return df.withColumn("kept", (F.col("found_count") == expected) | one)


def partly_missing(df: DataFrame, missing: str = "not_found_list", below: int = 13) -> DataFrame:
    return df.filter((F.size(missing) > 0) & (F.size(missing) < below))


def tri_state(column: Column) -> Column:
    return F.when(F.trim(column) == "+", True).when(F.trim(column) == "-", False)


def first_occurrences(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def last_occurrences(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins; only the winner's columns travel, so the aggregate is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(*key, "__v.*")


def min_words(df: DataFrame, column: str, least: int) -> DataFrame:
    """Distinct texts of more than ``least`` words."""
    return df.filter(F.size(F.filter(F.split(column, r"\s+"), lambda w: w != "")) > least).select(column).distinct()


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, missing): one pass, counted before the shuffle."""
    one = df.agg(*[F.count(F.nullif(F.col(f).cast("string"), F.lit(""))).alias(f"p{i}") for i, f in enumerate(fields)], F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"p{i}").alias("present"), (F.col("n") - F.col(f"p{i}")).alias("missing")) for i, f in enumerate(fields)])
    return one.select(F.inline(rows))


def missing_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, missing array) of the rows that lack a field."""
    absent = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields]))
    return df.select(key, absent.alias("missing")).filter(F.size("missing") > 0)


def relabel(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Replace values by ``names`` (old, new); others stay."""
    return df.join(names.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", column)).drop("new")


# ---- joins


def split_known(rows: DataFrame, known: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with and without a partner."""
    keys = known.select(*on).distinct()
    return rows.join(keys, on, "left_semi"), rows.join(keys, on, "left_anti")


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left outer join with a default."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def replace_synonyms(rows: DataFrame, column: str, synonyms: DataFrame) -> DataFrame:
    """Values by their canonical form; others stay. A variant listed twice takes the first canonical form."""
    one = synonyms.groupBy("variant").agg(F.min("canonical").alias("__c")).withColumnRenamed("variant", column)
    return rows.join(one, column, "left").withColumn(column, F.coalesce("__c", column)).drop("__c")


def to_ids(rows: DataFrame, dimension: DataFrame, names: list[str], name: str = "item", ident: str = "id") -> DataFrame:
    """Names to ids by lower-case, trimmed key; rows with an unknown name are dropped."""
    dim = dimension.select(F.lower(F.trim(name)).alias("__k"), F.col(ident).alias("__id")).dropDuplicates(["__k"])
    for n in names:
        rows = rows.withColumn("__k", F.lower(F.trim(n))).join(dim, "__k").withColumn(f"{n}_id", F.col("__id")).drop("__k", "__id")
    return rows


def edge_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) with the labels of both ends."""
    label = F.concat("name", F.lit("("), "tag", F.lit(")"))
    a = nodes.select(F.col("node_id").alias("src"), label.alias("src_label"))
    b = nodes.select(F.col("node_id").alias("dst"), label.alias("dst_label"))
    return edges.join(a, "src").join(b, "dst").select("src_label", "dst_label")


def symmetric_pairs(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(low, high) of unordered pairs linked both ways; one aggregate instead of a self join."""
    pair = edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), (F.col(a) < F.col(b)).alias("up"))
    both = pair.groupBy("low", "high").agg(F.bool_or("up").alias("u"), F.bool_or(~F.col("up")).alias("d"))
    return both.filter("u AND d").select("low", "high")


def containing_sentence(entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """Entities with the sentence their start lies in; equality on the document keeps the range join local."""
    e, s = entities.alias("e"), sentences.alias("s")
    on = (F.col("e.doc_id") == F.col("s.doc_id")) & (F.col("s.sent_start") <= F.col("e.start_offset")) & (F.col("e.start_offset") < F.col("s.sent_end"))
    return e.join(s, on).select("e.*", "s.sent_no", "s.sent_start", "s.sent_end")


def unlinked_pairs(entities: DataFrame, relations: DataFrame, group: list[str]) -> DataFrame:
    """Pairs of entities of one group (a sentence) linked in neither direction, low id first.

    A group is a sentence, so its pairs are few; documents never pair across sentences.
    """
    ids = entities.groupBy(*group).agg(F.array_sort(F.collect_set("entity_id")).alias("ids")).filter(F.size("ids") > 1)
    pairs = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda b: F.struct(a.alias("low"), b.alias("high")))))
    all_pairs = ids.select(*group, F.inline(pairs))
    linked = relations.filter("from_id IS NOT NULL AND to_id IS NOT NULL").select(F.least("from_id", "to_id").alias("low"), F.greatest("from_id", "to_id").alias("high")).distinct()
    return all_pairs.join(linked, ["low", "high"], "left_anti")


def inverted_index(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the values of each key, once each, as rows, so that a key of a third of all rows is no list."""
    return df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct()


def index_sizes(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, first_value): how many different values a key has, and the smallest."""
    return inverted_index(df, key, value).groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias(f"first_{value}"))


def edges_between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges whose ends hold the two patterns, in either direction."""
    x, y = F.lower("source"), F.lower("target")
    return edges.filter((F.contains(x, F.lit(a.lower())) & F.contains(y, F.lit(b.lower()))) | (F.contains(x, F.lit(b.lower())) & F.contains(y, F.lit(a.lower()))))


def grid_lookup(left: DataFrame, right: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Every pair of two dimensions with its fact, if any. The dimensions are lists; the grid is the result itself."""
    return left.crossJoin(right).join(facts, on, "left")


def semi_edges(edges: DataFrame, nodes: DataFrame, new_targets: DataFrame) -> DataFrame:
    """Edges into newly added nodes, both of whose ends exist."""
    have = nodes.select("node_id")
    out = edges.join(new_targets.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return out.join(have.withColumnRenamed("node_id", "dst"), "dst", "left_semi").join(have.withColumnRenamed("node_id", "src"), "src", "left_semi").select("src", "dst")


# ---- lemmas


def lemma_stem(word: Column) -> Column:
    """What the forms of a word have in common: all of a short word, else all but its last three letters, four at least."""
    return F.when(F.length(word) < 5, word).otherwise(F.substring(word, F.lit(1), F.greatest(F.lit(4), F.length(word) - 3)))


def induced_lemmas(words: DataFrame) -> DataFrame:
    """(word, lemma) of all words of a corpus (word): the most frequent form of a stem stands for its forms.

    The stand-in for a dictionary of lemmas where none is given; of equally frequent forms the shorter, then the first.
    """
    counts = words.filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).withColumn("stem", lemma_stem(F.col("word")))
    best = counts.groupBy("stem").agg(F.min(F.struct((-F.col("n")).alias("n"), F.length("word").alias("l"), F.col("word").alias("w"))).alias("b"))
    return counts.join(best, "stem").select("word", F.col("b.w").alias("lemma"))


def lemmatized(df: DataFrame, key: str, column: str, lemmas: DataFrame) -> DataFrame:
    """(key, lemmas): the words and signs of a text in lower case, each by its lemma (word, lemma) where it has one, corrected.

    Each different text is looked up once; its words meet the table by a join, so a dictionary of any size will do.
    """
    from leafloom.functions.text import corrected, tokens

    texts = df.select(F.col(column).alias("__text")).filter("__text IS NOT NULL").distinct()
    words = texts.select("__text", F.posexplode(tokens(F.lower("__text"))).alias("i", "word")).join(lemmas.select("word", "lemma"), "word", "left")
    joined = words.groupBy("__text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", corrected(F.coalesce("lemma", "word")).alias("w")))), lambda x: x["w"]), " ").alias("lemmas"))
    out = df.join(joined, F.col(column) == F.col("__text"), "left").drop("__text")
    return out.select(key, F.when(F.col(column).isNotNull(), F.coalesce("lemmas", F.lit(""))).alias("lemmas"))


# ---- aggregations


def mode(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, column): the smallest of the most frequent values; two combined aggregates, no window over the rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*key, column).agg(F.count("*").alias("__n"))
    # the least value of the highest count
    return counts.groupBy(*key).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(column).alias("v"))).alias("__b")).select(*key, F.col("__b.v").alias(column))


def aggregate_edges(edges: DataFrame) -> DataFrame:
    """(source, target) once, with the most frequent tags."""
    key = ["source", "target"]
    base = edges.filter(F.col("source").isNotNull() & F.col("target").isNotNull())
    out = base.select(*key).distinct()
    for tag in ("source_tag", "target_tag"):
        out = out.join(mode(base, key, tag), key, "left")
    return out


def canonical_most_frequent(terms: DataFrame, key: str, term: str) -> DataFrame:
    return mode(terms, [key], term)


def canonical_shortest(terms: DataFrame, key: str, term: str) -> DataFrame:
    return terms.groupBy(key).agg(F.min(F.struct(F.length(term).alias("l"), F.col(term).alias("t"))).alias("__b")).select(key, F.col("__b.t").alias(term))


def squared_error(pairs: DataFrame, key: str, value: str, target: str) -> DataFrame:
    """(key, loss, n_common, n_missing); the loss is null without a common row."""
    both = F.col(value).isNotNull() & F.col(target).isNotNull()
    return pairs.groupBy(key).agg(
        F.sum(F.when(both, F.pow(F.col(value) - F.col(target), 2))).alias("loss"), F.count(F.when(both, 1)).alias("n_common"), F.count(F.when(~both, 1)).alias("n_missing"))


def sub_effects(df: DataFrame, group: str, effect: str) -> DataFrame:
    return df.groupBy(group).agg(F.array_sort(F.collect_set(effect)).alias("effects"))


def element_vocabulary(df: DataFrame, array: str) -> DataFrame:
    """Distinct trimmed elements of an array column."""
    return df.select(F.explode(array).alias("term")).select(F.trim("term").alias("term")).filter("term <> ''").distinct()


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and accuracy of binary columns, in one pass."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = df.agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    one = one.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return one.withColumns({"f1": safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "accuracy": safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rank-sum AUC with ties counted half, from counts per distinct score."""
    per = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    below = running_sums(per, ["score"], {"upto": "n"}).withColumn("below", F.col("upto") - F.col("n"))
    return below.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def best_f1_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, f1): the highest F1 over all scores as thresholds; 0.5 and 0 without a positive."""
    per = cut(df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.count("*").alias("k")))
    cum = running_sums(per, [F.desc("threshold")], {"tp": "p", "said": "k"}).crossJoin(F.broadcast(per.agg(F.sum("p").alias("all_p"))))
    f1 = F.when(F.col("all_p") > 0, 2 * F.col("tp") / (F.col("said") + F.col("all_p")))
    return cum.agg(F.max(F.struct(f1.alias("f1"), F.col("threshold"))).alias("b")).select(F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))


# ---- order and top-k


def lead_position(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """The end of a part is the start of the next, or ``end``."""
    return df.withColumn("part_end", F.coalesce(F.lead(start).over(Window.partitionBy(*key).orderBy(start)), F.col(end)))


def carry_forward(df: DataFrame, key: list[str], order: str, column: str) -> DataFrame:
    """Null values take the last value before them."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def islands(df: DataFrame, key: list[str], order: str, breaks: Column) -> DataFrame:
    """Adds ``island``: the number of breaks up to the row."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def longest_spans(df: DataFrame, key: list[str]) -> DataFrame:
    """Spans (start_offset, end_offset, entity_id) by document without overlaps: of two that overlap the longer stays.

    A fold over the spans of one document in order of their start; a document's annotations are few.
    """
    spans = F.array_sort(F.collect_list(F.struct("start_offset", "end_offset", "entity_id")))
    grouped = df.groupBy(*key).agg(spans.alias("spans"))
    kind = "array<struct<start_offset:int,end_offset:int,entity_id:bigint>>"

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        longer = (last["end_offset"] - last["start_offset"]) < (s["end_offset"] - s["start_offset"])
        swapped = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(s))
        return F.when((F.size(out) == 0) | (s["start_offset"] >= F.element_at(out, -1)["end_offset"]), F.concat(out, F.array(s))).when(longer, swapped).otherwise(out)

    return grouped.select(*key, F.inline(F.aggregate("spans", F.array().cast(kind), step)))


def round_robin(df: DataFrame, key: list[str], order: str, k: int) -> DataFrame:
    return df.withColumn("bucket", (F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1) % k)


def top_k(df: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= k)


# ---- sets


def union_minus(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct().exceptAll(c.distinct())


def dictionary_terms(synonyms: DataFrame) -> DataFrame:
    """Keys and values of a synonym table."""
    return synonyms.select(F.explode(F.array("canonical", "variant")).alias("term")).filter("term IS NOT NULL").distinct()


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): values of only one of the two."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def endpoint_bag(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("term")).unionByName(edges.select(F.col("target").alias("term")))


# ---- star schema


def surrogate_keys(df: DataFrame, natural: str, ident: str) -> DataFrame:
    """Distinct values with ids from 1 by value."""
    return numbered(df.filter(F.col(natural).isNotNull()).select(natural).distinct(), [natural], ident)


def load_star(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dimensions drugs (id, drug), side_effects (id, effect) and the fact, first frequency by ``ord`` wins."""
    drugs, effects = surrogate_keys(raw, "drug", "drug_id"), surrogate_keys(raw, "effect", "side_effect_id")
    fact = raw.join(drugs, "drug").join(effects, "effect").groupBy("drug_id", "side_effect_id").agg(F.min_by("freq", F.struct("ord", "freq")).alias("frequency"))
    return drugs, effects, fact
