"""Queries of readers, page extractors, sheets and lemmas: rows are rendered in the format and read back."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.common import cut, shared_dir, table
from leafloom.functions import text as T
from leafloom.functions.lemmas import LEMMA_CORRECTIONS
from leafloom.functions.rules import S, strip, strip_sql
from leafloom.operators import extraction
from leafloom.operators import relational as R
from leafloom.plans.graph_queries import _E, _graph
from leafloom.plans.model_queries import _folder
from leafloom.sources import readers, writers


def publish(spark: SparkSession, local: str, name: str) -> str:
    """Copy a file that the driver has written into the shared folder, where all executors can read it."""
    jvm, target = spark._jvm, f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
    path = jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(f"file://{local}"), path)
    return target


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _joined(items: Column, by: str = "") -> Column:
    """Strings of a group in order, as one."""
    return F.array_join(F.array_sort(F.collect_list(items)), by)


# ---- readers


def src_s02_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers padded with blanks and an unnamed column at the end of every line."""
    path = _folder(spark)
    t = table(spark, d, "drugs").select(F.concat_ws(";", F.col("id").cast("string"), F.coalesce(F.md5("drug_en"), F.lit("None")), F.coalesce(F.col("deleted_at").cast("string"), F.lit("None")), F.lit("")).alias("value"))
    head = spark.createDataFrame([(0, "  id ; drug en;deleted ;")], "part int, value string")
    head.unionByName(t.withColumn("part", F.lit(1))).coalesce(1).orderBy("part").select("value").write.text(path)
    return readers.csv_table(spark, path).select("id", F.col("`drug en`").alias("drug_en"), F.col("deleted").isNotNull().alias("deleted"))


def src_s04_relations(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    writers.csv_rows(table(spark, d, "relations").select("rel_id", "from_id", "to_id", F.coalesce("rel_type", F.lit("None")).alias("rel_type")), path, sep="$")
    return readers.relation_table(spark, path)


def src_s17_database(spark: SparkSession, d: str) -> DataFrame:
    """A database file of the reference terms, asked for the labels of one section."""
    with tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, "terms.db")
        writers.database_file(table(spark, d, "effect_terms").select("term_id", "term", "section"), "entities", local)
        path = publish(spark, local, "terms.db")
    return readers.database_table(spark, path, "SELECT term_id, term FROM entities WHERE section IN (SELECT min(section) FROM entities)", "term_id int, term string")


def src_s20_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """A document that maps canonical terms to lists of variants, as rows."""
    path = _folder(spark)
    groups = table(spark, d, "synonyms").groupBy("canonical").agg(F.collect_list("variant").alias("vs"))
    one = groups.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("canonical", "vs")))).alias("value"))  # a list of 86 rows
    one.coalesce(1).write.text(path)
    return readers.dictionary(spark, path)


def src_s20b_raw(spark: SparkSession, d: str) -> DataFrame:
    """Documents of drugs whose sections hold effects by frequency, or one list without, as rows."""
    se = table(spark, d, "side_effects").filter("drug IS NOT NULL AND section IS NOT NULL AND effect IS NOT NULL").withColumn("freq", F.lower("freq"))
    lists = se.groupBy("drug", "section", "freq").agg(F.array_sort(F.collect_list("effect")).alias("e"))
    with_freq = lists.filter("freq IS NOT NULL").groupBy("drug", "section").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("freq", "e")))).alias("body"))
    plain = lists.filter("freq IS NULL").select("drug", F.concat("section", F.lit(" *")).alias("section"), F.to_json("e").alias("body"))
    per = with_freq.unionByName(plain).groupBy("drug").agg(F.map_from_entries(F.collect_list(F.struct("section", "body"))).alias("side_e_parts"))
    path = _folder(spark)
    per.select(F.to_json(F.array(F.struct(F.col("drug").alias("drug_name_ru"), F.lit("leaflet").alias("source"), "side_e_parts"))).alias("value")).repartition(4).write.option("lineSep", "\u0003").text(path)
    rows = spark.read.option("lineSep", "\u0003").text(path)
    return readers.raw_documents(rows).select("drug", "source", "section", "freq", "ord", "effect")


def src_s22_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge graph written as one GEXF document and loaded by its suffix."""
    nodes, edges = (cut(x) for x in _graph(spark, d))
    path = f"{_folder(spark)}.gexf"
    writers.gexf_lines(nodes, edges).coalesce(1).write.text(path)
    back, links = readers.load_graph(spark, path)
    named = links.join(back.select(F.col("node_id").alias("src"), F.col("name").alias("source")), "src").join(back.select(F.col("node_id").alias("dst"), F.col("name").alias("target")), "dst")
    return named.select("source", "target").distinct()


def src_k02_graph_tables(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of the knowledge graph as two tables, read back and joined."""
    nodes, edges = _graph(spark, d)
    flat = nodes.withColumn("name", F.regexp_replace("name", f"[{S}]+", " "))
    path = _folder(spark)
    writers.nodes_edges_csv(flat.select("node_id", "name", "tag"), edges, path)
    n, e = readers.csv_table(spark, f"{path}/nodes"), readers.csv_table(spark, f"{path}/edges")
    return e.join(n.select(F.col("node_id").alias("src"), F.col("name").alias("source")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("name").alias("target")), "dst").select("source", "target").distinct()


def src_s11_pdf(spark: SparkSession, d: str) -> DataFrame:
    """A document with a page for each reference term, a header and a number in the margins, as lines."""
    out = [b"%PDF-1.4\n1 0 obj<</MediaBox [0 0 595 842]>>endobj\n"]
    for r in table(spark, d, "effect_terms").orderBy("term_id").select("term_id", "term").collect():  # a fixed list
        said = r.term.encode("cp1251", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        page = b"BT 1 0 0 1 50 800 Tm (Header) Tj 1 0 0 1 50 400 Tm (%d ) Tj (%s) Tj 0 -380 Td (page) Tj ET" % (r.term_id, said)
        out.append(b"stream\n" + zlib.compress(page) + b"\nendstream\n")
    with tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, "terms.pdf")
        with open(local, "wb") as f:
            f.write(b"".join(out))
        path = publish(spark, local, "terms.pdf")
    return readers.pdf_texts(spark, path, margin=70).select(F.explode(F.split("text", "\n")).alias("line"))


# ---- sheets


def _cell(row: Column | int, col: Column | int, value: Column) -> list[Column]:
    as_int = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return [F.lit("book").alias("path"), F.lit("sheet").alias("sheet"), as_int(row).alias("row_no"), as_int(col).alias("col_no"), value.cast("string").alias("value")]


def proj_p19_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks from a sheet of three columns: the later of two rows of one key wins, incomplete rows go."""
    t = table(spark, d, "effect_terms")
    row = (F.col("term_id") * 2).cast("int")
    first = [t.select(*_cell(row, 0, F.concat(F.lit(" "), "term"))), t.select(*_cell(row, 1, F.concat(F.lit("EN "), "term_id"))), t.select(*_cell(row, 2, F.col("term_id") / 4))]
    later = t.filter("term_id % 3 = 0")
    again = [later.select(*_cell(row + 1, 0, F.upper("term"))), later.select(*_cell(row + 1, 1, F.lit("EN again"))), later.filter("term_id % 2 = 0").select(*_cell(row + 1, 2, F.lit(0.5)))]
    cells = first[0]
    for part in [*first[1:], *again]:
        cells = cells.unionByName(part)
    return readers.rank_table(cells)


def proj_p20_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of groups by sections (names, totals, counts by position) as rows."""
    se = table(spark, d, "side_effects").filter("drug IS NOT NULL AND section IS NOT NULL")
    dr = table(spark, d, "drugs").filter("drug IS NOT NULL AND drug_group IS NOT NULL").select("drug", "drug_group").distinct()
    n = cut(se.join(dr, "drug").groupBy("drug_group", "section").agg(F.count("*").alias("n")))
    at = cut(n.join(R.surrogate_keys(n, "drug_group", "g"), "drug_group").join(R.surrogate_keys(n, "section", "s"), "section"))
    names, rows = at.select("drug_group", "g").distinct(), at.select("section", "s").distinct()
    cells = at.select(*_cell(F.col("s") + 16, F.col("g"), F.col("n"))).unionByName(names.select(*_cell(0, F.col("g"), F.concat(F.lit(" "), F.upper("drug_group")))))
    cells = cells.unionByName(names.filter("g % 2 = 0").select(*_cell(2, F.col("g"), F.col("g") * 10))).unionByName(rows.select(*_cell(F.col("s") + 16, 0, F.col("section"))))
    reports, totals = readers.report_matrix(cells)
    return reports.join(totals, "drug").select("drug", "effect", "cases", "total")


# ---- pages


def _report_html(spark: SparkSession, d: str) -> DataFrame:
    """A saved report page of each drug group: sections as groups, frequency classes as lines, two tables."""
    se = table(spark, d, "side_effects").filter("drug IS NOT NULL AND section IS NOT NULL AND freq IS NOT NULL")
    dr = table(spark, d, "drugs").filter("drug IS NOT NULL AND drug_group IS NOT NULL").select("drug", F.md5("drug_group").alias("grp")).distinct()
    n = cut(se.join(dr, "drug").groupBy("grp", F.md5("section").alias("sec"), F.md5(F.lower("freq")).alias("eff")).agg(F.count("*").alias("n")))
    item = _text("<li><span>", F.col("eff"), " (", F.col("n"), ")</span></li>")
    parts = n.groupBy("grp", "sec").agg(_joined(item).alias("items"), F.sum("n").alias("sn"))
    head = _text("<li><span>+</span><span>", F.col("sec"), " (", F.col("sn") % 100, "%, ", F.col("sn"), " ADRs)</span></li>")
    pages = parts.groupBy("grp").agg(_joined(F.concat(F.lit("<!--"), F.col("sec"), F.lit("-->"), head, F.col("items"))).alias("list"), F.sum("sn").alias("total"))
    row = lambda label, count: _text("<tr><td>", label, "</td><td> ", count, "</td><td>5%</td></tr>")
    sex = _text('<div dtid="dashboard-sexdist" class="x"><table>', row("Male", F.col("total") * 2), row("Female", F.lit("n/a")), "<tr><td>short</td></tr></table></div>")
    age = _text('<div dtid="dashboard-agegroupdist"><table>', row("18-44", F.col("total") + 1), "</table></div>")
    return pages.select("grp", _text("<p>There are <strong>", F.col("total"), "</strong> reports</p><ul>", F.col("list"), "</ul>", sex, age).alias("html"))


def ext_l07_report_groups(spark: SparkSession, d: str) -> DataFrame:
    out = _report_html(spark, d).select("grp", F.inline(extraction.report_groups(F.col("html"))).alias("section", "percent", "grp_cases", "effect", "cases"))
    return out.select("grp", F.regexp_replace("section", r"^\+", "").alias("section"), "percent", "grp_cases", "effect", "cases")


def ext_l08_stat_table(spark: SparkSession, d: str) -> DataFrame:
    return _report_html(spark, d).select("grp", F.inline(extraction.stat_table(F.col("html"))))


def ext_l09_report_page(spark: SparkSession, d: str) -> DataFrame:
    page = extraction.report_page(_report_html(spark, d), keep="grp")
    return page.select("grp", "report_count", F.size("effects").alias("n_effects"), F.get("sex", F.lit(0))["n"].alias("male"), F.get("sex", F.lit(1))["n"].alias("female"), F.get("age", F.lit(0))["n"].alias("adult"))


def ext_l10_html_section(spark: SparkSession, d: str) -> DataFrame:
    """Effects as a block of a page, with line breaks, a remark in superscript and entities."""
    html = _text("<h1>Page</h1><div>no</div>\n<h2 class='a'> Side effects </h2>\n<div class='b'>", writers.escape_xml(F.col("effect")), "<sup>1</sup><br/>", F.col("id"), "</div><div>more</div>")
    return table(spark, d, "side_effects").filter("effect IS NOT NULL").select("id", extraction.html_section(html, "Side effects").alias("text"))


def ext_l11_heading_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sections as headings with lists "class: effects", translated; general remarks are skipped and the next chapter ends them."""
    n = table(spark, d, "side_effects").filter("drug IS NOT NULL AND section IS NOT NULL AND freq IS NOT NULL").select("drug", strip(F.col("section")).alias("section"), strip(F.replace(F.lower("freq"), F.lit(":"), F.lit(""))).alias("freq"), F.md5(F.coalesce("effect", F.lit(""))).alias("e")).distinct()
    lines = n.groupBy("drug", "section", "freq").agg(_text("<li>", F.col("freq"), ": ", _joined(F.col("e"), ", "), "</li>").alias("line"))
    blocks = lines.groupBy("drug", "section").agg(_text("<h3>", F.col("section"), "</h3><ul>", _joined(F.col("line")), "</ul>").alias("b"))
    pages = blocks.groupBy("drug").agg(_text("<h3>General adverse events</h3><ul><li>none: x</li></ul>", _joined(F.col("b")), "<h2>Next</h2><h3>Late</h3><ul><li>y: z</li></ul>").alias("html"))
    names = {"редко": "rare", "часто": "common"}
    rows = pages.select("drug", F.inline(extraction.heading_lists(F.col("html"), skip=["General adverse events"], dictionary=names)))
    return rows.select("drug", "category", "freq", F.explode("effects").alias("effect"))


def _letters(digest: Column) -> Column:
    """A digest without digits, which a chapter would lose at its end as a page number."""
    return F.translate(digest, "0123456789", "ghijklmnop")


def ext_l17_leaflet_document(spark: SparkSession, d: str) -> DataFrame:
    """A summary of characteristics of each drug: fields of the file name and the chapters found."""
    dr = table(spark, d, "drugs").filter("drug IS NOT NULL").select("id", _letters(F.md5("drug")).alias("k"), F.coalesce(_letters(F.md5("drug_group")), F.lit("none")).alias("g"))
    name = _text(F.col("id"), ") ", F.col("k"), "+[", F.col("g"), "] _ T", F.col("id"), " _ 01.02.2024.pdf")
    text = _text("\nПоказания к применению\n", F.col("k"), "\nПротивопоказания\n", F.col("g"), "\nПередозировка\nнет\n")
    out = extraction.leaflet_document(dr.select("id", name.alias("file_name"), text.alias("text")))
    found = lambda c: F.element_at("chapters", c)
    return out.select("num_prepare", F.element_at("international_name", 1).alias("name"), F.element_at("international_name_dlc", 1).alias("dlc"), "trade_name", found("Показания к применению").alias("indications"), found("Противопоказания").alias("contraindications"), F.col("stats.found_count").alias("n_found"))


def fn_x36_group_and_atc(spark: SparkSession, d: str) -> DataFrame:
    """Groups, code and rest of a chapter on pharmacodynamics."""
    code = F.concat(F.lit("C"), F.lpad((F.col("id") % 100).cast("string"), 2, "0"), F.lit("AA"), F.lpad((F.col("id") % 90).cast("string"), 2, "0"))
    text = _text("Фармакотерапевтическая группа: ", F.md5("drug_group"), "; прочие средства.\nКод АТХ: ", code, "\n", F.md5("drug"))
    out = table(spark, d, "drugs").filter("drug IS NOT NULL AND drug_group IS NOT NULL").select("id", T.pharm_group_and_atc(text).alias("p"))
    return out.select("id", F.array_join("p.pharm_group", "|").alias("groups"), "p.atc_code", "p.rest")


# ---- lemmas


def fn_x04b_induced_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """The words of all effects, each with the form that stands for its group."""
    words = table(spark, d, "side_effects").filter("effect IS NOT NULL").select(F.explode(T.tokens(F.lower("effect"))).alias("word"))
    return R.induced_lemmas(words)


def fn_x05b_lemma_join(spark: SparkSession, d: str) -> DataFrame:
    """Effects with every word by its lemma, from the table of all words by a join."""
    rows = table(spark, d, "side_effects").filter("effect IS NOT NULL").select("id", "effect")
    lemmas = cut(R.induced_lemmas(rows.select(F.explode(T.tokens(F.lower("effect"))).alias("word"))))
    return R.lemmatized(rows, "id", "effect", lemmas).select("id", "lemmas")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("src_", "proj_", "ext_", "fn_")) and callable(f)}
_TOKENS = r"regexp_extract_all(lower(effect), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]')"
_LEMMA = f"""n AS (SELECT w AS word, count(*) AS k FROM (SELECT unnest({_TOKENS}) AS w FROM side_effects WHERE effect IS NOT NULL) GROUP BY 1),
  s AS (SELECT word, k, CASE WHEN length(word) < 5 THEN word ELSE substr(word, 1, greatest(4, length(word) - 3)) END AS stem FROM n),
  m AS (SELECT stem, arg_min(word, (-k, length(word), word)) AS lemma FROM s GROUP BY 1), lem AS (SELECT word, lemma FROM s JOIN m USING (stem))"""
_CORRECTED = "CASE coalesce(lemma, word) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEMMA_CORRECTIONS.items()) + " ELSE coalesce(lemma, word) END"
_PAGE = """g AS (SELECT DISTINCT drug, md5(drug_group) AS grp FROM drugs WHERE drug IS NOT NULL AND drug_group IS NOT NULL),
  n AS (SELECT grp, md5(section) AS sec, md5(lower(freq)) AS eff, count(*) AS n FROM side_effects JOIN g USING (drug) WHERE section IS NOT NULL AND freq IS NOT NULL GROUP BY 1, 2, 3),
  p AS (SELECT grp, sec, CAST(sum(n) AS BIGINT) AS sn FROM n GROUP BY 1, 2), t AS (SELECT grp, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY 1)"""
_RAW = "r AS (SELECT drug, CASE WHEN freq IS NULL THEN section || ' *' ELSE section END AS section, lower(freq) AS freq, effect, row_number() OVER (PARTITION BY drug, section, lower(freq) ORDER BY effect) - 1 AS ord FROM side_effects WHERE drug IS NOT NULL AND section IS NOT NULL AND effect IS NOT NULL)"
_FLAT = lambda e: f"regexp_replace({e}, '[{S}]+', ' ', 'g')"
SQL = {
    "src_s02_headers": f"SELECT CAST(id AS VARCHAR) AS id, md5(drug_en) AS drug_en, deleted_at IS NOT NULL AS deleted FROM drugs",
    "src_s04_relations": "SELECT CAST(rel_id AS VARCHAR) AS rel_id, CAST(from_id AS VARCHAR) AS from_id, CAST(to_id AS VARCHAR) AS to_id, rel_type FROM relations",
    "src_s11_pdf": "SELECT term_id || ' ' || term AS line FROM effect_terms",
    "src_s17_database": "SELECT term_id, term FROM effect_terms WHERE section = (SELECT min(section) FROM effect_terms)",
    "src_s20_dictionary": "SELECT canonical, variant FROM synonyms",
    "src_s20b_raw": f"WITH {_RAW} SELECT drug, 'leaflet' AS source, section, freq, CAST(ord AS INT) AS ord, effect FROM r",
    "src_s22_dispatch": f"WITH {_E} SELECT DISTINCT s AS source, t AS target FROM e",
    "src_k02_graph_tables": f"WITH {_E} SELECT DISTINCT trim({_FLAT('s')}) AS source, trim({_FLAT('t')}) AS target FROM e",
    "proj_p19_ranks": "SELECT term AS effect_ru, CASE WHEN term_id % 6 = 0 THEN 'en again' ELSE 'en ' || term_id END AS effect_en, CASE WHEN term_id % 6 = 0 THEN 0.5 ELSE term_id / 4.0 END AS rank FROM effect_terms",
    "proj_p20_unpivot": f"""WITH n AS (SELECT drug_group, section, count(*) AS n FROM side_effects JOIN (SELECT DISTINCT drug, drug_group FROM drugs WHERE drug IS NOT NULL AND drug_group IS NOT NULL) USING (drug) WHERE section IS NOT NULL GROUP BY 1, 2),
  i AS (SELECT *, dense_rank() OVER (ORDER BY drug_group) AS g FROM n)
SELECT lower(drug_group) AS drug, {strip_sql('lower(section)')} AS effect, n AS cases, CASE WHEN g % 2 = 0 THEN g * 10 ELSE 0 END AS total FROM i""",
    "ext_l07_report_groups": f"WITH {_PAGE} SELECT grp, sec AS section, CAST(sn % 100 AS INT) AS percent, sn AS grp_cases, eff AS effect, n AS cases FROM n JOIN p USING (grp, sec)",
    "ext_l08_stat_table": f"WITH {_PAGE} SELECT grp, unnest(['Male', 'Female', '18-44']) AS label, unnest([total * 2, 0, total + 1]) AS n FROM t",
    "ext_l09_report_page": f"WITH {_PAGE} SELECT grp, total AS report_count, (SELECT CAST(count(*) AS INT) FROM n WHERE n.grp = t.grp) AS n_effects, total * 2 AS male, CAST(0 AS BIGINT) AS female, total + 1 AS adult FROM t",
    "ext_l10_html_section": f"SELECT id, {strip_sql('effect || chr(10) || id')} AS text FROM side_effects WHERE effect IS NOT NULL",
    "ext_l11_heading_lists": f"WITH n AS (SELECT DISTINCT drug, {strip_sql('section')} AS category, {strip_sql("replace(lower(freq), ':', '')")} AS freq, md5(coalesce(effect, '')) AS effect FROM side_effects WHERE drug IS NOT NULL AND section IS NOT NULL AND freq IS NOT NULL) SELECT drug, category, CASE freq WHEN 'редко' THEN 'rare' WHEN 'часто' THEN 'common' ELSE freq END AS freq, effect FROM n",
    "ext_l17_leaflet_document": "SELECT CAST(id AS INT) AS num_prepare, translate(md5(drug), '0123456789', 'ghijklmnop') AS name, coalesce(translate(md5(drug_group), '0123456789', 'ghijklmnop'), 'none') AS dlc, 'T' || id AS trade_name, translate(md5(drug), '0123456789', 'ghijklmnop') AS indications, coalesce(translate(md5(drug_group), '0123456789', 'ghijklmnop'), 'none') AS contraindications, 3 AS n_found FROM drugs WHERE drug IS NOT NULL",
    "fn_x36_group_and_atc": "SELECT id, md5(drug_group) || '|прочие средства' AS groups, 'C' || lpad(CAST(id % 100 AS VARCHAR), 2, '0') || 'AA' || lpad(CAST(id % 90 AS VARCHAR), 2, '0') AS atc_code, md5(drug) AS rest FROM drugs WHERE drug IS NOT NULL AND drug_group IS NOT NULL",
    "fn_x04b_induced_lemmas": f"WITH {_LEMMA} SELECT word, lemma FROM lem",
    "fn_x05b_lemma_join": f"WITH {_LEMMA}, w AS (SELECT id, unnest({_TOKENS}) AS word, unnest(range(len({_TOKENS}))) AS i FROM side_effects WHERE effect IS NOT NULL), j AS (SELECT id, string_agg({_CORRECTED}, ' ' ORDER BY i) AS lemmas FROM w LEFT JOIN lem USING (word) GROUP BY 1) SELECT id, coalesce(lemmas, '') AS lemmas FROM side_effects LEFT JOIN j USING (id) WHERE effect IS NOT NULL",
}
