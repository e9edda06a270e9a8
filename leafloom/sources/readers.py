"""Readers of the domain's file formats. All return DataFrames; schemas are explicit wherever the format allows."""

from __future__ import annotations

import io
import re
import sqlite3
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions.rules import strip

EDGE_LIST = "source string, source_tag string, target string, target_tag string"
ANNOTATED = "text string, entities array<struct<id:bigint,start_offset:int,end_offset:int,label:string>>, relations array<struct<from_id:bigint,to_id:bigint,type:string>>"


def csv_table(spark: SparkSession, path: str, sep: str = ";", null: str = "None") -> DataFrame:
    """All-string table with trimmed headers and cells; unnamed columns go, the null word becomes null."""
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    named = [c for c in raw.columns if c.strip() and not re.fullmatch(r"_c\d+", c.strip())]
    clean = lambda c: F.nullif(strip(F.col(f"`{c}`")), F.lit(null)).alias(c.strip())
    return raw.select(*[clean(c) for c in named])


def edge_list(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    return spark.read.schema(EDGE_LIST).csv(path, sep=sep, header=True).na.fill("")


def relation_table(spark: SparkSession, path: str) -> DataFrame:
    return csv_table(spark, path, sep="$")


def matrix(spark: SparkSession, path: str, columns: int, sep: str = ",") -> DataFrame:
    """(row_no, c0, c1, ...) of a headerless numeric file; rows are numbered in file order within the file."""
    schema = ", ".join(f"c{i} double" for i in range(columns))
    rows = spark.read.schema(schema).csv(path, sep=sep)
    return rows.select((F.monotonically_increasing_id()).alias("row_no"), *rows.columns)


def id_table(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """(item, id): keys in lower case, trimmed; both directions are joins on this table."""
    t = csv_table(spark, path, sep)
    return t.select(F.lower("item").alias("item"), F.col("id").cast("int").alias("id"))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file document, an object or an array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str = ANNOTATED) -> DataFrame:
    return spark.read.schema(schema).json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-blank lines; an empty file is an error."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("line")).filter("line <> ''")
    if rows.isEmpty():
        raise ValueError(f"{path} holds no line")
    return rows


def files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, length) of the files with a suffix, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path).select("path", "length")


def cluster_file(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, label, group_id) of a cluster document."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "clusters map<string,struct<count:int,labels:array<array<string>>>>").alias("d"))
    rows = doc.select(F.explode("d.clusters").alias("cluster", "c")).select("cluster", F.explode("c.labels").alias("l"))
    return rows.select("cluster", F.get("l", F.lit(0)).alias("label"), F.get("l", F.lit(1)).try_cast("int").alias("group_id"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, variant) of a map of canonical terms to variants."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("d"))
    return doc.select(F.explode("d").alias("canonical", "vs")).select("canonical", F.explode("vs").alias("variant"))


def raw_side_effects(spark: SparkSession, path: str) -> DataFrame:
    """(drug, drug_en, source, section, freq, ord, effect) of documents whose sections hold lists or lists by frequency."""
    return raw_documents(spark.read.text(path, wholetext=True))


def raw_documents(documents: DataFrame, column: str = "value") -> DataFrame:
    """The rows of such documents, one a row of ``documents``."""
    outer = "array<struct<drug_name_ru:string,drug_name_en:string,source:string,side_e_parts:map<string,string>>>"
    doc = documents.select(F.explode(F.from_json(column, outer)).alias("d"))
    parts = doc.select("d.drug_name_ru", "d.drug_name_en", "d.source", F.explode("d.side_e_parts").alias("section", "body"))
    by_freq, plain = F.from_json("body", "map<string,array<string>>"), F.from_json("body", "array<string>")
    lists = F.when(F.col("body").startswith("{"), F.map_entries(by_freq)).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("key"), plain.alias("value"))))
    rows = parts.select(F.col("drug_name_ru").alias("drug"), F.col("drug_name_en").alias("drug_en"), "source", "section", F.explode(lists).alias("l"))
    return rows.select("drug", "drug_en", "source", "section", F.col("l.key").alias("freq"), F.posexplode("l.value").alias("ord", "effect"))


def _xml(path: str) -> str:
    """xpath steps that ignore namespaces."""
    return "/".join(f"*[local-name()='{p}']" if p and not p.startswith(("@", "text()")) else p for p in path.split("/"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, node_id, name, tag, x, y) and edges of GraphML drawings; a label reads "name (tag)".

    A node without a shape keeps its id and no label; ids are hashes of file and id, so every run gives the same.
    """
    from leafloom.functions.text import label_and_tag

    doc = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("graph_id"), "value")
    ident = lambda c: F.sha2(F.concat_ws("|", "graph_id", c), 256).substr(1, 16)
    nodes = doc.mapInPandas(_graphml_nodes, "graph_id string, id string, label string, x double, y double")
    label = label_and_tag(F.col("label"))
    nodes = nodes.select("graph_id", ident("id").alias("node_id"), F.coalesce(label["name"], "label").alias("name"), label["tag"].alias("tag"), "x", "y")
    src = F.xpath(F.col("value"), F.lit("//" + _xml("edge") + "/@source"))
    dst = F.xpath(F.col("value"), F.lit("//" + _xml("edge") + "/@target"))
    edges = doc.select("graph_id", F.explode(F.arrays_zip(src.alias("src"), dst.alias("dst"))).alias("e"))
    return nodes, edges.select("graph_id", ident("e.src").alias("src"), ident("e.dst").alias("dst")).distinct()


def _graphml_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    local = lambda e: e.tag.rpartition("}")[2]
    for b in batches:
        rows = []
        for graph, value in zip(b["graph_id"], b["value"]):
            for node in (e for e in ElementTree.fromstring(value).iter() if local(e) == "node"):
                inner = list(node.iter())
                label = next((e.text for e in inner if local(e) == "NodeLabel"), None)
                place = next((e for e in inner if local(e) == "Geometry"), None)
                plain = next((e.text for e in node if local(e) == "data" and e.text and e.text.strip()), None)
                rows.append((graph, node.get("id"), label if label is not None else (plain or node.get("label")), float(place.get("x", 0)) if place is not None else 0.0, float(place.get("y", 0)) if place is not None else 0.0))
        yield pd.DataFrame(rows, columns=["graph_id", "id", "label", "x", "y"])


def gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, name) and edges (src, dst) of GEXF documents."""
    doc = spark.read.text(path, wholetext=True)
    get = lambda p: F.xpath(F.col("value"), F.lit(p))
    node, edge = "//" + _xml("node"), "//" + _xml("edge")
    nodes = doc.select(F.explode(F.arrays_zip(get(node + "/@id").alias("node_id"), get(node + "/@label").alias("name"))).alias("n")).select("n.*")
    return nodes, doc.select(F.explode(F.arrays_zip(get(edge + "/@source").alias("src"), get(edge + "/@target").alias("dst"))).alias("e")).select("e.*")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """By suffix: node-link JSON, GraphML or GEXF."""
    from leafloom.operators.graphs import parse_node_link

    if path.endswith(".json"):
        return parse_node_link(spark.read.text(path, wholetext=True).withColumnRenamed("value", "document"))
    if path.endswith(".graphml"):
        return graphml(spark, path)
    if path.endswith(".gexf"):
        return gexf(spark, path)
    raise ValueError(f"unknown kind of graph file: {path}")


def _sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of workbooks, read from their XML parts."""
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"]):
            book = zipfile.ZipFile(io.BytesIO(content))
            local = lambda e: e.tag.rpartition("}")[2]
            names = set(book.namelist())
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if local(si) == "si"]
            rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            for sheet in (e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if local(e) == "sheet"):
                target = rels[next(v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id" and k != "sheetId")].lstrip("/")
                part = target if target.startswith("xl/") else f"xl/{target}"
                for c in (e for e in ElementTree.fromstring(book.read(part)).iter() if local(e) == "c"):
                    letters, number = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                    col = 0
                    for ch in letters:
                        col = col * 26 + ord(ch) - 64
                    value = next((e.text for e in c.iter() if local(e) in ("v", "t")), None)
                    if c.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    rows.append((path, sheet.get("name"), int(number) - 1, col - 1, value))
        yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "col_no", "value"])


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_no, col_no, value) of all cells of workbooks, one task a file."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_sheets, "path string, sheet string, row_no int, col_no int, value string")


def report_matrix(cells: DataFrame, names_row: int = 0, totals_row: int = 2, first_row: int = 17, effect_col: int = 0) -> tuple[DataFrame, DataFrame]:
    """reports (drug, effect, cases) and totals (drug, total) of a positional sheet; a missing total is 0.

    Names, totals and effects are one row or column of the sheet; cells join to them by position.
    """
    at = lambda row, name: cells.filter(F.col("row_no") == row).select("path", "sheet", "col_no", F.col("value").alias(name))
    names = at(names_row, "drug").filter((F.col("col_no") != effect_col) & (strip(F.coalesce("drug", F.lit(""))) != "")).withColumn("drug", F.lower(strip(F.col("drug"))))
    totals = names.join(at(totals_row, "t"), ["path", "sheet", "col_no"], "left").select("drug", F.coalesce(F.col("t").try_cast("double").cast("bigint"), F.lit(0)).alias("total"))
    body = cells.filter((F.col("row_no") >= first_row) & (F.col("col_no") != effect_col))
    effects = cells.filter((F.col("row_no") >= first_row) & (F.col("col_no") == effect_col)).select("path", "sheet", "row_no", F.lower(strip(F.col("value"))).alias("effect"))
    rows = body.join(effects, ["path", "sheet", "row_no"]).join(names, ["path", "sheet", "col_no"])
    return rows.select("drug", "effect", F.col("value").try_cast("double").cast("bigint").alias("cases")).filter("effect IS NOT NULL AND cases IS NOT NULL"), totals


def rank_table(cells: DataFrame) -> DataFrame:
    """(effect_ru, effect_en, rank) of a sheet of three columns; incomplete rows go, the later of two equal keys wins."""
    wide = cells.groupBy("path", "sheet", "row_no").agg(*[F.max(F.when(F.col("col_no") == i, F.col("value"))).alias(c) for i, c in enumerate(("effect_ru", "effect_en", "rank"))])
    rows = wide.select(F.lower(strip(F.col("effect_ru"))).alias("effect_ru"), F.lower(strip(F.col("effect_en"))).alias("effect_en"), F.col("rank").try_cast("double").alias("rank"), "row_no").dropna()
    return rows.groupBy("effect_ru").agg(F.max_by(F.struct("effect_en", "rank"), "row_no").alias("v")).select("effect_ru", "v.effect_en", "v.rank")


_PDF_TOKEN = re.compile(rb"(?P<text>\((?:\\.|[^()\\])*\))|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+))|(?P<op>T\*|T[dDmL](?![A-Za-z])|'|BT|ET)")
_PDF_BOX = re.compile(rb"/MediaBox\s*\[\s*[-\d.]+\s+[-\d.]+\s+[-\d.]+\s+([-\d.]+)")


def _pdf_string(token: bytes, encoding: str) -> str:
    """A shown string: escapes undone, two-byte text by its mark, else in the given encoding."""
    if token.startswith(b"<"):
        raw = bytes.fromhex(token[1:-1].decode().translate({32: None, 10: None, 13: None, 9: None}))
    else:
        raw = re.sub(rb"\\([0-7]{1,3})|\\(.)", lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1) else m.group(2), token[1:-1], flags=re.DOTALL)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode(encoding, "replace")


def pdf_pages(content: bytes, margin: float = 0.0, encoding: str = "cp1251") -> str:
    """Text of a simple PDF: the strings shown by its (deflated) content streams, a line for each text move.

    Lines nearer than ``margin`` to the upper or lower edge of the page (headers, page numbers) are left out.
    """
    box = _PDF_BOX.search(content)
    height = float(box.group(1)) if box else None
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", content, re.DOTALL):
        data = m.group(1)
        try:
            # what follows the compressed data (the line break before the end mark) is left over
            data = zlib.decompressobj().decompress(data)
        except zlib.error:
            pass
        if b"BT" not in data:
            continue
        y, leading, operands, lines = 0.0, 0.0, [], [(0.0, [])]
        for token in _PDF_TOKEN.finditer(data):
            kind, t = token.lastgroup, token.group()
            if kind == "number":
                operands.append(float(t))
                continue
            if kind in ("text", "hex"):
                lines[-1][1].append(_pdf_string(t, encoding))
                continue
            if t == b"TL" and operands:
                leading = operands[-1]
            elif t == b"Tm" and operands:
                y = operands[-1]
            elif t in (b"Td", b"TD") and operands:
                y += operands[-1]
                leading = -operands[-1] if t == b"TD" else leading
            elif t in (b"T*", b"'"):
                y -= leading
            elif t == b"BT":
                y = 0.0
            if t not in (b"TL", b"ET"):
                lines.append((y, []))
            operands = []
        kept = lambda at: height is None or not margin or margin <= at <= height - margin
        out += ["".join(parts) for at, parts in lines if parts and kept(at)]
    return "\n".join(out).strip()


def pdf_texts(spark: SparkSession, path: str, margin: float = 0.0, encoding: str = "cp1251") -> DataFrame:
    """(path, text) of PDF files, broken lines joined; scanned pages and embedded font encodings need an outside extractor."""
    from leafloom.functions.text import join_broken_lines

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [pdf_pages(c, margin, encoding) for c in b["content"]]})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(run, "path string, text string")
    return raw.select("path", join_broken_lines(F.col("text")).alias("text"))


def _database(query: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db") as f:  # a task's own copy, gone with the task
                    f.write(content)
                    f.flush()
                    with sqlite3.connect(f.name) as db:
                        yield pd.read_sql_query(query, db)

    return run


def database_table(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query on SQLite files, one task a file."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_database(query), schema)


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of pages saved earlier; fetching them is no part of the engine."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


