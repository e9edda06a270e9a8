"""Queries of the relational operators on the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.common import table
from leafloom.functions import scores as N
from leafloom.operators import relational as R
from leafloom.operators.graphs import TAGS

_TAGS_SQL = ", ".join(f"'{t}'" for t in TAGS)
_EFFECTS = "(SELECT DISTINCT drug, effect, freq FROM side_effects WHERE drug IS NOT NULL AND effect IS NOT NULL)"
#: Rate of each frequency class.
RATES = {"очень часто": 0.55, "часто": 0.055, "нечасто": 0.0055, "редко": 0.00055, "очень редко": 0.000055, "частота неизвестна": 0.0}


def _rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RATES.items()), "freq string, rate double")


_RATES_SQL = "(VALUES " + ", ".join(f"('{k}', {v!r})" for k, v in RATES.items()) + ") r(freq, rate)"


def proj_p01_tag_whitelist(spark: SparkSession, d: str) -> DataFrame:
    return R.tag_whitelist(table(spark, d, "edge_list"), ["action", "mechanism", "side_e"])


def proj_p02_valid_nodes(spark: SparkSession, d: str) -> DataFrame:
    return R.valid_nodes(table(spark, d, "edge_list"), TAGS)


def proj_p03_find_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return R.find_by_tag(R.valid_nodes(table(spark, d, "edge_list"), TAGS), ["prepare", "group"])


def proj_p04_with_source(spark: SparkSession, d: str) -> DataFrame:
    return R.with_source(table(spark, d, "documents")).groupBy("source").agg(F.count("*").alias("n"))


def proj_p05_stop_phrases(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.filter(R.contains_any(F.col("text"), ["повышенная чувствительност", "overdose", "гіперчутливіст"])).select("doc_id")


def proj_p06_length_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "side_effects").filter(F.length("effect") <= 60).select("id", "effect")


def proj_p09_tri_state(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("deleted_at").isNull(), "+").when(F.col("drug_group").isNull(), "?").otherwise("-")
    return table(spark, d, "drugs").select("id", R.tri_state(flag).alias("active"))


def proj_p10_protein_binding(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.filter(R.all_match(F.col("text"), ["(?i)\\d+\\s*(%|процент)", "(?i)(CYP|QT)"])).select("doc_id")


def proj_p15_min_words(spark: SparkSession, d: str) -> DataFrame:
    return R.min_words(table(spark, d, "side_effects").filter("effect IS NOT NULL"), "effect", 3)


def proj_p16_coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.coverage(table(spark, d, "side_effects"), ["drug", "section", "freq", "effect", "deleted_at"])


def proj_p16b_missing_fields(spark: SparkSession, d: str) -> DataFrame:
    return R.missing_fields(table(spark, d, "drugs"), "id", ["drug", "drug_en", "drug_group"]).select("id", F.array_join("missing", ",").alias("missing"))


def proj_p17_relabel(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("Сердце и сосуды", "heart"), ("Кожные покровы", "skin")], "old string, new string")
    return R.relabel(table(spark, d, "effect_terms").select("term_id", "section"), "section", names).select("term_id", "section")


def proj_p18_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Terms of six tags; of several tags of a term the last by name counts."""
    n = R.valid_nodes(table(spark, d, "edge_list"), ["action", "mechanism", "metabol", "side_e", "group", "prepare"])
    return R.last_occurrences(n, ["name"], ["tag"])


def win_p13_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "side_effects").filter("effect IS NOT NULL").select("id", "ord", "effect", "drug")
    return R.first_occurrences(t, ["effect"], ["ord", "id"]).select("effect", "id")


def win_w01_first_label(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "entities").filter("label IS NOT NULL AND deleted_at IS NULL").select("doc_id", "label", "start_offset", "entity_id")
    return R.first_occurrences(t, ["doc_id", "label"], ["start_offset", "entity_id"])


def win_w02_lead_position(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "entities").select("doc_id", "entity_id", (F.col("start_offset").cast("bigint") * 1_000_000 + F.col("entity_id")).alias("start_at"))
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars").cast("bigint") * 1_000_000).alias("doc_end"))
    return R.lead_position(t.join(docs, "doc_id"), ["doc_id"], "start_at", "doc_end").select("entity_id", "part_end")


def win_w03_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return R.carry_forward(table(spark, d, "entities").select("doc_id", "entity_id", "label"), ["doc_id"], "entity_id", "label").select("entity_id", "label")


def win_w04_last_write(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "side_effects").filter("effect IS NOT NULL AND drug IS NOT NULL").select("drug", "effect", "freq", "id")
    return R.last_occurrences(t, ["drug", "effect"], ["id"])


def win_w07_round_robin(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edge_list").filter("source <> '' AND target <> ''").select("source", "target").distinct()
    return R.round_robin(e, ["target"], "source", 3)


def win_w08_curriculum(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(150).select("id", N.curriculum_size(F.col("id") / 150, F.lit(7)).alias("size"))


def join_j01_drug_list(spark: SparkSession, d: str) -> DataFrame:
    """Drugs of the list with their records, by lower-case name."""
    drugs = table(spark, d, "drugs").filter("drug IS NOT NULL").select(F.lower("drug").alias("k")).distinct()
    se = table(spark, d, "side_effects").filter("drug IS NOT NULL").select(F.lower("drug").alias("k"), "id")
    return se.join(drugs, "k").select("id", F.col("k").alias("drug"))


def join_j02_common_missing(spark: SparkSession, d: str) -> DataFrame:
    """Terms found among the records, and those missing."""
    terms = table(spark, d, "effect_terms").select(F.col("term").alias("effect"))
    have, lack = R.split_known(terms, table(spark, d, "side_effects").filter("effect IS NOT NULL").select("effect"), ["effect"])
    return have.withColumn("kind", F.lit("common")).unionByName(lack.withColumn("kind", F.lit("missing")))


def join_j03_rates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "side_effects").select("id", F.lower("freq").alias("freq"))
    return R.lookup(t, _rates(spark), "freq", "rate", 0.0).select("id", "rate")


def join_j04_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return R.replace_synonyms(table(spark, d, "side_effects").select("id", "effect"), "effect", table(spark, d, "synonyms")).select("id", "effect")


def join_j06_ids(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "effect_terms").select(F.col("term").alias("item"), F.col("term_id").alias("id"))
    return R.to_ids(table(spark, d, "side_effects").filter("effect IS NOT NULL").select(F.col("id").alias("row_id"), "effect"), dim, ["effect"]).select("row_id", "effect_id")


def join_j08_symmetric(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relations").filter("from_id IS NOT NULL AND to_id IS NOT NULL")
    return R.symmetric_pairs(r, "from_id", "to_id")


def join_j13_sentence_of_entity(spark: SparkSession, d: str) -> DataFrame:
    """Entities by the line of the document they start in."""
    lines = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("l"))
    ends = F.transform("l", lambda x, i: F.struct(i.cast("int").alias("sent_no"), F.length(x).alias("len")))
    pos = lines.select("doc_id", F.inline(ends))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("sent_no").rowsBetween(Window.unboundedPreceding, -1)
    sents = pos.select("doc_id", "sent_no", (F.coalesce(F.sum(F.col("len") + 1).over(w), F.lit(0))).alias("sent_start"), "len").withColumn("sent_end", F.col("sent_start") + F.col("len") + 1)
    return R.containing_sentence(table(spark, d, "entities").select("doc_id", "entity_id", "start_offset"), sents).select("entity_id", "sent_no")


def join_j15_unlinked_pairs(spark: SparkSession, d: str) -> DataFrame:
    ents = table(spark, d, "entities").select("entity_id", "doc_id", (F.col("start_offset") / 200).cast("int").alias("block"))
    return R.unlinked_pairs(ents, table(spark, d, "relations"), ["doc_id", "block"]).select("doc_id", "low", "high")


def join_j16_names_to_drugs(spark: SparkSession, d: str) -> DataFrame:
    """Names of records without a drug of that name, in any case."""
    return R.differences(table(spark, d, "side_effects").select(F.lower("drug").alias("name")), table(spark, d, "drugs").select(F.lower("drug").alias("name")), "name").filter("name IS NOT NULL")


def join_j17_new_effects(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "effect_terms").select(F.lower("term").alias("effect"))
    return R.split_known(table(spark, d, "side_effects").filter("effect IS NOT NULL").select(F.lower("effect").alias("effect")).distinct(), known, ["effect"])[1]


def join_j19_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every section and frequency class with the number of its records."""
    sections = table(spark, d, "effect_terms").select("section").distinct()
    classes = table(spark, d, "frequency_ranges").select(F.col("category").alias("freq"))
    facts = table(spark, d, "side_effects").groupBy("section", "freq").agg(F.count("*").alias("n"))
    return R.grid_lookup(sections, classes, facts, ["section", "freq"]).select("section", "freq", F.coalesce("n", F.lit(0)).alias("n"))


def join_j22_label_documents(spark: SparkSession, d: str) -> DataFrame:
    out = R.index_sizes(table(spark, d, "entities"), "label", "doc_id")
    return out.select("label", F.col("n").cast("int").alias("n_docs"), F.col("first_doc_id").alias("first_doc"))


def join_j23_edges_between(spark: SparkSession, d: str) -> DataFrame:
    return R.edges_between(table(spark, d, "edge_list"), "активация", "синдром").select("source", "target").distinct()


def agg_a01_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate_edges(table(spark, d, "edge_list"))


def agg_a02_most_frequent(spark: SparkSession, d: str) -> DataFrame:
    return R.canonical_most_frequent(table(spark, d, "side_effects").select("section", "effect"), "section", "effect")


def agg_a02b_shortest(spark: SparkSession, d: str) -> DataFrame:
    return R.canonical_shortest(table(spark, d, "side_effects").filter("length(trim(effect)) > 3"), "section", "effect").select("section", "effect")


def agg_a03_squared_error(spark: SparkSession, d: str) -> DataFrame:
    """Rates of records against the middle of their class, per section."""
    se = table(spark, d, "side_effects").select("section", F.lower("freq").alias("freq"))
    ranges = table(spark, d, "frequency_ranges").select(F.lower("category").alias("freq"), ((F.col("min_probability") + F.col("max_probability")) / 2).alias("mid"))
    rows = se.join(_rates(spark), "freq", "left").join(ranges, "freq", "left")
    return R.squared_error(rows, "section", "rate", "mid").select("section", F.round("loss", 6).alias("loss"), "n_common", "n_missing")


def agg_a07_distinct_effects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "side_effects").filter("effect IS NOT NULL").select(F.lower("effect").alias("effect")).distinct()


def agg_a08_sub_effects(spark: SparkSession, d: str) -> DataFrame:
    return R.sub_effects(table(spark, d, "effect_terms"), "section", "term").select("section", F.array_join("effects", "|").alias("effects"))


def agg_a09_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Capped sum, noisy or, scaled sum and pooled log odds of the rates of each effect."""
    rows = table(spark, d, "side_effects").select("effect", F.lower("freq").alias("freq")).filter("effect IS NOT NULL").join(_rates(spark), "freq")
    p = F.col("rate")
    out = rows.groupBy("effect").agg(N.capped_sum(p).alias("capped"), N.noisy_or(p).alias("noisy"), N.scaled_sum(p, 3.0).alias("scaled"), N.log_odds_pool(p).alias("pooled"))
    return out.select("effect", *[F.round(c, 6).alias(c) for c in ("capped", "noisy", "scaled", "pooled")])


def agg_a15_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("event_type") == "purchase").cast("int").alias("y"), (F.col("value") > 50).cast("int").alias("p"))
    return R.confusion(rows, "y", "p").select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def agg_a15b_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("event_type") == "purchase").cast("int").alias("y"), F.round("value", 1).alias("s"))
    return R.roc_auc(rows, "y", "s").select(F.round("auc", 6).alias("auc"))


def agg_a16_best_f1(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("event_type") == "purchase").cast("int").alias("y"), F.round("value", 1).alias("s"))
    return R.best_f1_threshold(rows, "y", "s").select("threshold", F.round("f1", 6).alias("f1"))


def agg_a18_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def agg_a20_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").agg(F.count("*").alias("n_entities"))
    return e.crossJoin(table(spark, d, "relations").agg(F.count("*").alias("n_relations")))


def agg_a23_elements(spark: SparkSession, d: str) -> DataFrame:
    return R.element_vocabulary(table(spark, d, "drugs").filter("drug IS NOT NULL").select(F.split("drug", r"\+").alias("parts")), "parts")


def top_t01_sorted_weights(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "side_effects").filter("effect IS NOT NULL").groupBy("section", "effect").agg(F.count("*").alias("n"))
    return R.top_k(t, ["section"], [F.desc("n"), "effect"], 5)


def top_t09_by_number(spark: SparkSession, d: str) -> DataFrame:
    """The ten longest documents."""
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")


def set_u01_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """Terms and canonical names without those that never occur."""
    a = table(spark, d, "effect_terms").select(F.col("term").alias("v"))
    b = table(spark, d, "synonyms").select(F.col("canonical").alias("v"))
    c = table(spark, d, "side_effects").filter("effect IS NOT NULL").select(F.col("effect").alias("v"))
    return R.union_minus(a, b, c)


def set_u04_expected(spark: SparkSession, d: str) -> DataFrame:
    """Frequency classes a section lacks."""
    have = table(spark, d, "side_effects").groupBy("section").agg(F.collect_set("freq").alias("have"))
    every = table(spark, d, "frequency_ranges").agg(F.array_sort(F.collect_list("category")).alias("every"))
    return have.crossJoin(F.broadcast(every)).select("section", F.array_join(F.array_except("every", "have"), "|").alias("lacking"))


def set_u05_endpoint_bag(spark: SparkSession, d: str) -> DataFrame:
    return R.endpoint_bag(table(spark, d, "edge_list")).groupBy("term").agg(F.count("*").alias("n"))


def set_u07_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return R.dictionary_terms(table(spark, d, "synonyms"))


def set_u08_differences(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "mix_targets").select("source")
    return R.differences(a, table(spark, d, "documents").select("source"), "source")


def star_k05_fact(spark: SparkSession, d: str) -> DataFrame:
    """Fact rows of the star of drugs and effects, first frequency by order."""
    raw = table(spark, d, "side_effects").filter("drug IS NOT NULL AND effect IS NOT NULL").select("drug", "effect", "freq", F.struct("ord", "id").alias("ord"))
    return R.load_star(raw)[2]


def star_k06_edges(spark: SparkSession, d: str) -> DataFrame:
    """Documents' relations with entity labels looked up; unresolved ends are dropped."""
    e = table(spark, d, "entities").select("entity_id", "label")
    r = table(spark, d, "relations")
    a, b = e.select(F.col("entity_id").alias("from_id"), F.col("label").alias("from_label")), e.select(F.col("entity_id").alias("to_id"), F.col("label").alias("to_label"))
    return r.join(a, "from_id").join(b, "to_id").groupBy("from_label", "rel_type", "to_label").agg(F.count("*").alias("n"))


def star_k04_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Records by effect section and frequency class as a matrix."""
    from leafloom.sources.writers import effect_matrix

    classes = [r.category for r in table(spark, d, "frequency_ranges").select("category").orderBy("category").collect()]  # a fixed list names the columns
    rows = table(spark, d, "side_effects").filter("section IS NOT NULL").select(F.lit("all").alias("grp"), F.col("section").alias("effect"), F.col("freq").alias("drug"), F.lit(1).alias("cases"))
    m = effect_matrix(rows, classes)
    return m.select(F.col("effect").alias("section"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(classes)])


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("proj_", "win_", "join_", "agg_", "top_", "set_", "star_")) and callable(f)}
_NONEMPTY = "source <> '' AND target <> ''"
_VALID = f"""SELECT DISTINCT name, tag FROM (
  SELECT source AS name, source_tag AS tag FROM edge_list WHERE {_NONEMPTY} UNION ALL SELECT target, target_tag FROM edge_list WHERE {_NONEMPTY}
  UNION ALL SELECT source, source_tag FROM edge_list WHERE source_tag = 'side_e' AND source <> '' UNION ALL SELECT target, target_tag FROM edge_list WHERE target_tag = 'side_e' AND target <> '')"""
_MODE = "SELECT {k}, {v} FROM (SELECT {k}, {v}, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, {v}) AS r FROM {t} WHERE {v} IS NOT NULL GROUP BY {k}, {v}) WHERE r = 1"
_SCORES = "SELECT CAST(event_type = 'purchase' AS INT) AS y, round(value, 1) AS s FROM events"
SQL = {
    "proj_p01_tag_whitelist": "SELECT * FROM edge_list WHERE source_tag IN ('action', 'mechanism', 'side_e') AND target_tag IN ('action', 'mechanism', 'side_e')",
    "proj_p02_valid_nodes": f"{_VALID} WHERE tag IN ({_TAGS_SQL})",
    "proj_p03_find_by_tag": f"{_VALID} WHERE tag IN ('prepare', 'group')",
    "proj_p04_with_source": "SELECT source, count(*) AS n FROM documents WHERE source <> '' GROUP BY 1",
    "proj_p05_stop_phrases": "SELECT doc_id FROM documents WHERE contains(lower(text), 'повышенная чувствительност') OR contains(lower(text), 'overdose') OR contains(lower(text), 'гіперчутливіст')",
    "proj_p06_length_limit": "SELECT id, effect FROM side_effects WHERE length(effect) <= 60",
    "proj_p09_tri_state": "SELECT id, CASE WHEN deleted_at IS NULL THEN true WHEN drug_group IS NULL THEN NULL ELSE false END AS active FROM drugs",
    "proj_p10_protein_binding": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\d+\s*(%|процент)') AND regexp_matches(text, '(?i)(CYP|QT)')",
    "proj_p15_min_words": r"SELECT DISTINCT effect FROM side_effects WHERE len(list_filter(string_split_regex(effect, '\s+'), lambda x: x <> '')) > 3",
    "proj_p16_coverage": "SELECT f AS field, count(v) AS present, count(*) - count(v) AS missing FROM (SELECT unnest(['drug', 'section', 'freq', 'effect', 'deleted_at']) AS f, unnest([nullif(drug, ''), nullif(section, ''), nullif(freq, ''), nullif(effect, ''), CAST(deleted_at AS VARCHAR)]) AS v FROM side_effects) GROUP BY 1",
    "proj_p16b_missing_fields": "SELECT id, missing FROM (SELECT id, array_to_string(list_filter([CASE WHEN coalesce(drug, '') = '' THEN 'drug' END, CASE WHEN coalesce(drug_en, '') = '' THEN 'drug_en' END, CASE WHEN coalesce(drug_group, '') = '' THEN 'drug_group' END], lambda x: x IS NOT NULL), ',') AS missing FROM drugs) WHERE missing <> ''",
    "proj_p17_relabel": "SELECT term_id, CASE section WHEN 'Сердце и сосуды' THEN 'heart' WHEN 'Кожные покровы' THEN 'skin' ELSE section END AS section FROM effect_terms",
    "proj_p18_vocabulary": f"SELECT name, max(tag) AS tag FROM ({_VALID}) WHERE tag IN ('action', 'mechanism', 'metabol', 'side_e', 'group', 'prepare') GROUP BY name",
    "win_p13_first_occurrence": "SELECT effect, id FROM (SELECT *, row_number() OVER (PARTITION BY effect ORDER BY ord, id) AS r FROM side_effects WHERE effect IS NOT NULL) WHERE r = 1",
    "win_w01_first_label": "SELECT doc_id, label, start_offset, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY start_offset, entity_id) AS r FROM entities WHERE label IS NOT NULL AND deleted_at IS NULL) WHERE r = 1",
    "win_w02_lead_position": "SELECT entity_id, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), e) AS part_end FROM (SELECT entity_id, doc_id, CAST(start_offset AS BIGINT) * 1000000 + entity_id AS s, n_chars * 1000000 AS e FROM entities JOIN documents USING (doc_id))",
    "win_w03_carry_forward": "SELECT entity_id, last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY entity_id ROWS UNBOUNDED PRECEDING) AS label FROM entities",
    "win_w04_last_write": "SELECT drug, effect, freq, id FROM (SELECT *, row_number() OVER (PARTITION BY drug, effect ORDER BY id DESC) AS r FROM side_effects WHERE drug IS NOT NULL AND effect IS NOT NULL) WHERE r = 1",
    "win_w07_round_robin": f"SELECT source, target, CAST((row_number() OVER (PARTITION BY target ORDER BY source) - 1) % 3 AS INT) AS bucket FROM (SELECT DISTINCT source, target FROM edge_list WHERE {_NONEMPTY})",
    "win_w08_curriculum": "SELECT i AS id, CAST(floor(1 + (i / 150.0) * 6) AS INT) AS size FROM range(150) t(i)",
    "join_j01_drug_list": "SELECT id, lower(drug) AS drug FROM side_effects WHERE lower(drug) IN (SELECT lower(drug) FROM drugs WHERE drug IS NOT NULL)",
    "join_j02_common_missing": "SELECT term AS effect, CASE WHEN term IN (SELECT effect FROM side_effects WHERE effect IS NOT NULL) THEN 'common' ELSE 'missing' END AS kind FROM effect_terms",
    "join_j03_rates": f"SELECT id, coalesce(rate, 0.0) AS rate FROM side_effects s LEFT JOIN {_RATES_SQL} ON lower(s.freq) = r.freq",
    "join_j04_synonyms": "SELECT id, coalesce(c, effect) AS effect FROM side_effects LEFT JOIN (SELECT variant, min(canonical) AS c FROM synonyms GROUP BY 1) y ON y.variant = effect",
    "join_j06_ids": "SELECT s.id AS row_id, term_id AS effect_id FROM side_effects s JOIN effect_terms t ON lower(trim(s.effect)) = lower(trim(t.term))",
    "join_j08_symmetric": "SELECT DISTINCT a.from_id AS low, a.to_id AS high FROM relations a JOIN relations b ON a.from_id = b.to_id AND a.to_id = b.from_id WHERE a.from_id < a.to_id",
    "join_j13_sentence_of_entity": "WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS k FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, n, coalesce(sum(k + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, k FROM l) SELECT entity_id, CAST(n AS INT) AS sent_no FROM entities e JOIN s ON s.doc_id = e.doc_id AND s.a <= e.start_offset AND e.start_offset < s.a + s.k + 1",
    "join_j15_unlinked_pairs": "WITH e AS (SELECT entity_id, doc_id, start_offset // 200 AS block FROM entities) SELECT a.doc_id, a.entity_id AS low, b.entity_id AS high FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.block = b.block AND a.entity_id < b.entity_id WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE (r.from_id = a.entity_id AND r.to_id = b.entity_id) OR (r.from_id = b.entity_id AND r.to_id = a.entity_id))",
    "join_j16_names_to_drugs": "WITH a AS (SELECT DISTINCT lower(drug) AS name FROM side_effects WHERE drug IS NOT NULL), b AS (SELECT DISTINCT lower(drug) AS name FROM drugs WHERE drug IS NOT NULL) SELECT name, 'left' AS side FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'right' FROM b WHERE name NOT IN (SELECT name FROM a)",
    "join_j17_new_effects": "SELECT DISTINCT lower(effect) AS effect FROM side_effects WHERE effect IS NOT NULL AND lower(effect) NOT IN (SELECT lower(term) FROM effect_terms)",
    "join_j19_grid": "SELECT s.section, c.category AS freq, count(e.id) AS n FROM (SELECT DISTINCT section FROM effect_terms) s CROSS JOIN frequency_ranges c LEFT JOIN side_effects e ON e.section = s.section AND e.freq = c.category GROUP BY 1, 2",
    "join_j22_label_documents": "SELECT label, CAST(count(DISTINCT doc_id) AS INT) AS n_docs, min(doc_id) AS first_doc FROM entities WHERE label IS NOT NULL GROUP BY 1",
    "join_j23_edges_between": "SELECT DISTINCT source, target FROM edge_list WHERE (contains(lower(source), 'активация') AND contains(lower(target), 'синдром')) OR (contains(lower(source), 'синдром') AND contains(lower(target), 'активация'))",
    "agg_a01_edges": "WITH e AS (SELECT * FROM edge_list WHERE source IS NOT NULL AND target IS NOT NULL), a AS (" + _MODE.format(k="source, target", v="source_tag", t="e") + "), b AS (" + _MODE.format(k="source, target", v="target_tag", t="e") + ") SELECT k.source, k.target, a.source_tag, b.target_tag FROM (SELECT DISTINCT source, target FROM e) k LEFT JOIN a ON a.source = k.source AND a.target = k.target LEFT JOIN b ON b.source = k.source AND b.target = k.target",
    "agg_a02_most_frequent": _MODE.format(k="section", v="effect", t="side_effects"),
    "agg_a02b_shortest": "SELECT section, effect FROM (SELECT section, effect, row_number() OVER (PARTITION BY section ORDER BY length(effect), effect) AS r FROM side_effects WHERE length(trim(effect)) > 3) WHERE r = 1",
    "agg_a03_squared_error": f"SELECT section, round(sum(CASE WHEN rate IS NOT NULL AND mid IS NOT NULL THEN (rate - mid) * (rate - mid) END), 6) AS loss, count(CASE WHEN rate IS NOT NULL AND mid IS NOT NULL THEN 1 END) AS n_common, count(CASE WHEN rate IS NULL OR mid IS NULL THEN 1 END) AS n_missing FROM side_effects s LEFT JOIN {_RATES_SQL} ON lower(s.freq) = r.freq LEFT JOIN (SELECT lower(category) AS c, (min_probability + max_probability) / 2 AS mid FROM frequency_ranges) g ON g.c = lower(s.freq) GROUP BY section",
    "agg_a07_distinct_effects": "SELECT DISTINCT lower(effect) AS effect FROM side_effects WHERE effect IS NOT NULL",
    "agg_a08_sub_effects": "SELECT section, string_agg(term, '|' ORDER BY term) AS effects FROM (SELECT DISTINCT section, term FROM effect_terms) GROUP BY 1",
    "agg_a09_pooling": f"SELECT effect, round(least(sum(rate), 1), 6) AS capped, round(1 - exp(sum(ln(1 - rate))), 6) AS noisy, round(least(sum(rate) / 3, 1), 6) AS scaled, round(1 / (1 + exp(-sum(ln(greatest(rate, 1e-6) / (1 - greatest(rate, 1e-6)))))), 6) AS pooled FROM side_effects s JOIN {_RATES_SQL} ON lower(s.freq) = r.freq WHERE effect IS NOT NULL GROUP BY 1",
    "agg_a15_confusion": "WITH c AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM (SELECT event_type = 'purchase' AS y, value > 50 AS p FROM events)) SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c",
    "agg_a15b_auc": f"WITH t AS ({_SCORES}), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM t) SELECT round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r",
    "agg_a16_best_f1": f"WITH t AS ({_SCORES}), g AS (SELECT s, sum(y) AS p, count(*) AS k FROM t GROUP BY s), c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(k) OVER (ORDER BY s DESC) AS said, (SELECT sum(y) FROM t) AS a FROM g) SELECT s AS threshold, round(2 * tp / (said + a), 6) AS f1 FROM c ORDER BY 2 * tp / (said + a) DESC, s DESC LIMIT 1",
    "agg_a18_group_sizes": "SELECT label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM entities GROUP BY 1",
    "agg_a20_totals": "SELECT (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM relations) AS n_relations",
    "agg_a23_elements": "SELECT DISTINCT trim(p) AS term FROM (SELECT unnest(string_split(drug, '+')) AS p FROM drugs) WHERE trim(p) <> ''",
    "top_t01_sorted_weights": "SELECT section, effect, n, CAST(r AS INT) AS rank FROM (SELECT section, effect, count(*) AS n, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, effect) AS r FROM side_effects WHERE effect IS NOT NULL GROUP BY 1, 2) WHERE r <= 5",
    "top_t09_by_number": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10",
    "set_u01_vocabularies": "SELECT term AS v FROM effect_terms UNION SELECT canonical FROM synonyms EXCEPT SELECT effect FROM side_effects",
    "set_u04_expected": "SELECT section, coalesce(string_agg(category, '|' ORDER BY category), '') AS lacking FROM (SELECT s.section, c.category FROM (SELECT DISTINCT section FROM side_effects) s LEFT JOIN frequency_ranges c ON NOT EXISTS (SELECT 1 FROM side_effects e WHERE e.section IS NOT DISTINCT FROM s.section AND e.freq = c.category)) GROUP BY 1",
    "set_u05_endpoint_bag": "SELECT term, count(*) AS n FROM (SELECT source AS term FROM edge_list UNION ALL SELECT target FROM edge_list) GROUP BY 1",
    "set_u07_dictionary": "SELECT canonical AS term FROM synonyms UNION SELECT variant FROM synonyms",
    "set_u08_differences": "SELECT source, 'left' AS side FROM mix_targets WHERE source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) UNION ALL SELECT DISTINCT source, 'right' FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM mix_targets)",
    "star_k05_fact": "WITH s AS (SELECT * FROM side_effects WHERE drug IS NOT NULL AND effect IS NOT NULL), d AS (SELECT drug, row_number() OVER (ORDER BY drug) AS drug_id FROM (SELECT DISTINCT drug FROM s)), e AS (SELECT effect, row_number() OVER (ORDER BY effect) AS side_effect_id FROM (SELECT DISTINCT effect FROM s)) SELECT drug_id, side_effect_id, freq AS frequency FROM (SELECT drug_id, side_effect_id, freq, row_number() OVER (PARTITION BY s.drug, s.effect ORDER BY ord, id) AS r FROM s JOIN d ON d.drug = s.drug JOIN e ON e.effect = s.effect) WHERE r = 1",
    "star_k06_edges": "SELECT a.label AS from_label, r.rel_type, b.label AS to_label, count(*) AS n FROM relations r JOIN entities a ON a.entity_id = r.from_id JOIN entities b ON b.entity_id = r.to_id GROUP BY ALL",
}
_CLASSES = ["Нечасто", "Очень редко", "Очень часто", "Пострегистрационный период", "Редко", "Часто", "Частота неизвестна"]
SQL["star_k04_matrix"] = "SELECT section, " + ", ".join(f"count(*) FILTER (freq = '{c}') AS c{i}" for i, c in enumerate(_CLASSES)) + " FROM side_effects WHERE section IS NOT NULL GROUP BY 1"
