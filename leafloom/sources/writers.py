"""Writers of the domain's file formats."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_rows(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def parquet_rows(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def routed_csv(df: DataFrame, path: str, column: str) -> None:
    """One folder a class, in one pass."""
    df.write.mode("overwrite").partitionBy(column).csv(path, sep=";", header=True)


def nodes_edges_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    csv_rows(nodes.distinct(), f"{path}/nodes")
    csv_rows(edges.distinct(), f"{path}/edges")


def effect_matrix(reports: DataFrame, drugs: list[str]) -> DataFrame:
    """(grp, effect, one column a drug): sums of cases, 0 where there are none. The drugs name the columns."""
    wide = reports.groupBy("grp", "effect").pivot("drug", drugs).agg(F.sum("cases"))
    return wide.na.fill(0, drugs)


def lines(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def corpus(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """(line): the elements of array columns of several tables, one after the other."""
    out = None
    for df, column in parts:
        rows = df.select(F.explode(column).alias("line")).filter("line IS NOT NULL AND line <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out


def per_drug_files(df: DataFrame, drug: str, text: str, path: str) -> None:
    """One folder a drug; the name is part of the path, so it is written as a partition."""
    df.select(F.col(drug).alias("drug"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("drug").text(path)


def marking_stubs(df: DataFrame, sentences: str) -> DataFrame:
    """Adds ``stubs``: struct(sent, tokens, tags, need_ratio) of each sentence, for annotation."""
    stub = lambda s: F.struct(s.alias("sent"), F.array().cast("array<string>").alias("tokens"), F.array().cast("array<string>").alias("tags"), F.lit(False).alias("need_ratio"))
    return df.withColumn("stubs", F.transform(sentences, stub))


def attribute(value: Column, kind: str) -> Column:
    """A value as XML attribute text: null as "null", lists joined by "; ", maps as "k: v"."""
    if kind.startswith("array"):
        text = F.array_join(F.transform(value, lambda x: x.cast("string")), "; ")
    elif kind.startswith("map"):
        text = F.array_join(F.transform(F.map_entries(value), lambda e: F.concat(e["key"].cast("string"), F.lit(": "), e["value"].cast("string"))), "; ")
    else:
        text = value.cast("string")
    out = escape_xml(F.coalesce(text, F.lit("null")))
    # a reader takes plain white space in an attribute for blanks
    for sign, entity in (("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def escape_xml(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def _document(nodes: DataFrame, edges: DataFrame, head: str, node: Column, middle: str, edge: Column, tail: str) -> DataFrame:
    """(value): the lines of one XML document in order. Lines are sorted by the engine, not gathered in one value."""
    rows = nodes.select(F.lit(1).alias("part"), node.alias("value")).unionByName(edges.select(F.lit(3).alias("part"), edge.alias("value")))
    frame = nodes.sparkSession.createDataFrame([(0, head), (2, middle), (4, tail)], "part int, value string")
    return rows.unionByName(frame).orderBy("part", "value").select("value")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A yEd drawing of nodes (node_id, name, tag, x, y) and edges (src, dst); write with ``lines``."""
    label = escape_xml(F.concat("name", F.lit("("), F.coalesce("tag", F.lit("")), F.lit(")")))
    node = F.concat(F.lit('<node id="'), "node_id", F.lit('"><data key="d0"><y:ShapeNode><y:Geometry x="'), F.col("x").cast("string"), F.lit('" y="'), F.col("y").cast("string"), F.lit('"/><y:NodeLabel>'), label, F.lit('</y:NodeLabel><y:Shape type="ellipse"/></y:ShapeNode></data></node>'))
    edge = F.concat(F.lit('<edge source="'), "src", F.lit('" target="'), "dst", F.lit('"><data key="d1"><y:PolyLineEdge><y:Arrows source="none" target="standard"/></y:PolyLineEdge></data></edge>'))
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:y="http://www.yworks.com/xml/graphml"><key for="node" id="d0" yfiles.type="nodegraphics"/><key for="edge" id="d1" yfiles.type="edgegraphics"/><graph edgedefault="directed" id="G">'
    return _document(nodes, edges, head, node, "", edge, "</graph></graphml>")


def drawio_lines(nodes: DataFrame, edges: DataFrame, scale: float = 1000.0) -> DataFrame:
    """A draw.io page; places are taken from x and y."""
    place = lambda c: (F.col(c) * scale).cast("bigint").cast("string")
    node = F.concat(F.lit('<mxCell id="'), "node_id", F.lit('" value="'), escape_xml(F.col("name")), F.lit('" vertex="1" parent="1"><mxGeometry x="'), place("x"), F.lit('" y="'), place("y"), F.lit('" width="120" height="40" as="geometry"/></mxCell>'))
    edge = F.concat(F.lit('<mxCell id="'), "src", F.lit("-"), "dst", F.lit('" edge="1" parent="1" source="'), "src", F.lit('" target="'), "dst", F.lit('"><mxGeometry relative="1" as="geometry"/></mxCell>'))
    return _document(nodes, edges, '<mxfile><diagram><mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>', node, "", edge, "</root></mxGraphModel></diagram></mxfile>")


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    node = F.concat(F.lit('<node id="'), "node_id", F.lit('" label="'), attribute(F.col("name"), "string"), F.lit('"/>'))
    edge = F.concat(F.lit('<edge id="'), "src", F.lit("-"), "dst", F.lit('" source="'), "src", F.lit('" target="'), "dst", F.lit('"/>'))
    return _document(nodes, edges, '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed"><nodes>', node, "</nodes><edges>", edge, "</edges></graph></gexf>")


def star_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, tag) and edges (id, source_id, target_id); edges with an unknown end are dropped."""
    from leafloom.operators.relational import surrogate_keys

    labelled = nodes.select("node_id", F.concat("name", F.lit("("), F.coalesce("tag", F.lit("")), F.lit(")")).alias("label"), "tag")
    ids = surrogate_keys(labelled, "label", "id")
    by_node = labelled.join(ids, "label")
    rows = edges.join(by_node.select(F.col("node_id").alias("src"), F.col("id").alias("source_id")), "src").join(by_node.select(F.col("node_id").alias("dst"), F.col("id").alias("target_id")), "dst")
    return by_node.select("id", "label", "tag").distinct(), rows.select(F.xxhash64("source_id", "target_id").alias("id"), "source_id", "target_id").distinct()


def number_files(files: DataFrame) -> DataFrame:
    """(number, name) of files (name, content) of different content: the first by name stays, numbered from 1.

    Content is compared by its hash; only names and hashes are shuffled.
    """
    from leafloom.operators.relational import surrogate_keys

    first = files.select("name", F.sha2("content", 256).alias("h")).groupBy("h").agg(F.min("name").alias("name"))
    return surrogate_keys(first, "name", "number").select("number", "name")


def database_file(df: DataFrame, table: str, path: str) -> None:
    """A SQLite table, row batches streamed through the driver; for exports of a size a single file can hold."""
    import sqlite3

    names = ", ".join(f'"{c}"' for c in df.columns)
    with sqlite3.connect(path) as db:
        db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({names})')
        db.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})', (tuple(r) for r in df.toLocalIterator()))


def _workbook(rows: Iterator[tuple], columns: list[str]) -> bytes:
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def ref(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    def line(no: int, values: tuple) -> str:
        cell = lambda i, v: f'<c r="{ref(i)}{no}"><v>{v}</v></c>' if isinstance(v, int | float) else f'<c r="{ref(i)}{no}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
        return f'<row r="{no}">' + "".join(cell(i, v) for i, v in enumerate(values) if v is not None) + "</row>"

    body = "".join(line(n, r) for n, r in enumerate([tuple(columns), *rows], 1))
    out, main, rel = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def workbook_file(df: DataFrame, path: str) -> None:
    """A workbook of one sheet; more rows than a sheet can hold (1,048,576) are refused."""
    if df.count() > 1_048_575:
        raise ValueError("too many rows for one sheet")
    with open(path, "wb") as f:
        f.write(_workbook((tuple(r) for r in df.toLocalIterator()), df.columns))


