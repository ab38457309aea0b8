"""Writing borders into packages: every other part is copied, and a copy whose content differs is refused."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.operators.integrity import unit_fingerprints
from foliary.sources import docx
from foliary.sources.docx import W

# fixed values: the order in which the schema of the format wants a border's siblings, and what it wants before borders
EDGES = ("top", "left", "start", "bottom", "right", "end", "insideH", "insideV")
BEFORE_CELL = ("cnfStyle", "tcW", "gridSpan", "hMerge", "vMerge")


def _borders(cell: ET.Element) -> ET.Element:
    """The cell's borders, made at their place if there are none."""
    own = cell.find(W + "tcPr")
    if own is None:
        own = ET.Element(W + "tcPr")
        cell.insert(0, own)
    found = own.find(W + "tcBorders")
    if found is None:
        found = ET.Element(W + "tcBorders")
        own.insert(sum(x.tag in {W + n for n in BEFORE_CELL} for x in own), found)
    return found


def _set(borders: ET.Element, edge: str, eighths: int) -> None:
    line = borders.find(W + edge)
    if line is None:
        line = ET.Element(W + edge)
        borders.insert(sum(x.tag[len(W) :] in EDGES[: EDGES.index(edge)] for x in borders), line)
    line.set(W + "val", "single" if eighths else "nil")
    line.set(W + "sz", str(eighths))
    if eighths:
        line.set(W + "color", "auto")


def write_borders(content: bytes, operations: list[tuple[int, int, int, str, int]]) -> bytes:
    """The package with (table, row, cell, edge, eighths of a point) written into its body's tables."""
    package = docx.Package(content)
    source = package.read("word/document.xml")
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(source), ("start-ns",)):
        ET.register_namespace(prefix, uri)
    root = docx.parse_xml(source)
    tables = root.find(W + "body").findall(W + "tbl")
    for t, r, c, edge, eighths in operations:
        _set(_borders(tables[t].findall(W + "tr")[r].findall(W + "tc")[c]), edge, eighths)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        for info in package.zip.infolist():
            data = ET.tostring(root, encoding="UTF-8", xml_declaration=True) if info.filename == "word/document.xml" else package.read(info.filename)
            made.writestr(info, data)
    return out.getvalue()


def rewrite(packages: DataFrame, operations: DataFrame) -> DataFrame:
    """doc_id, content, error of each package that operations (doc_id, table_index, row_index, cell_index, edge, to_eighths) change."""
    one = F.struct("table_index", "row_index", "cell_index", "edge", "to_eighths")
    listed = operations.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("operations"))
    schema = T.StructType([packages.schema["doc_id"], T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, errors = [], []
            for content, steps in zip(batch["content"].to_pylist(), batch["operations"].to_pylist(), strict=True):
                try:
                    made.append(write_borders(content, [tuple(s.values()) for s in steps]))
                    errors.append(None)
                except (docx.PackageError, IndexError) as e:
                    made.append(None)
                    errors.append(str(e) if isinstance(e, docx.PackageError) else "table_changed")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made, pa.binary()), pa.array(errors, pa.string())], ["doc_id", "content", "error"])

    return packages.select("doc_id", "content").join(listed, "doc_id").select("doc_id", "content", "operations").mapInArrow(write, schema)


def accepted(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, content, accepted of rewritten packages: only those whose content is what it was, by fingerprint and units."""
    prints = lambda df: unit_fingerprints(docx.fingerprint_units(df)).select("doc_id", F.struct("fingerprint", "unit_count").alias("print"))
    made = after.where("error is null")
    same = prints(before).withColumnRenamed("print", "_was").join(prints(made), "doc_id").where("_was = print").select("doc_id", F.lit(True).alias("_same"))
    return after.select("doc_id", "content").join(same, "doc_id", "left").withColumn("accepted", F.coalesce("_same", F.lit(False))).drop("_same")
