"""Inputs of any kind to sheets: one row a scan, errors as rows."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.errors import FolioError, as_folio_error, summary
from foliospark.functions import pure
from foliospark.functions import text as T
from foliospark.functions.fold import let
from foliospark.schemas import SHEETS
from foliospark.session import prepare
from foliospark.sources.docx import IMAGES, scans
from foliospark.sources.pdf import PdfRenderer

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def inspect(path: str) -> str:
    """directory or file."""
    if os.path.isdir(path):
        return "directory"
    if os.path.isfile(path):
        return "file"
    if os.path.lexists(path):
        raise FolioError("INPUT_UNSUPPORTED_TYPE", f"neither a file nor a folder: {path}")
    raise FolioError("INPUT_READ_FAILED", f"no such input: {path}")


def image_files(folder: str) -> list[str]:
    """Image files right inside a folder, in natural order without case and accents."""
    try:
        with os.scandir(folder) as found:
            names = [e.name for e in found if e.is_file() and os.path.splitext(e.name)[1].lower() in IMAGES]
    except OSError as error:
        raise as_folio_error(error, "INPUT_READ_FAILED", f"cannot read {folder}") from error
    if not names:
        raise FolioError("INPUT_NO_IMAGES", f"no images in {folder}")
    return [os.path.join(folder, n) for n in sorted(names, key=lambda n: (pure.natural_key(n, fold=True), n))]


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content) of the files at a path, or paths, of any store that Spark reads."""
    return spark.read.format("binaryFile").schema(BINARY_FILE).load(path).select("path", "content")


def kind_of(path: Column) -> Column:
    ext = T.extension(path)
    return F.when(ext == ".pdf", "pdf").when(ext == ".docx", "docx").when(ext.isin(*sorted(IMAGES)), "image").otherwise("other")


def _sheets_of(path: str, content: bytes, pdf: PdfRenderer | None) -> list[tuple]:
    name = os.path.basename(path)
    kind = os.path.splitext(name)[1].lower()
    if kind == ".docx":
        return [(n, s, c, None, None) for n, s, c in scans(content, name)]
    if kind in IMAGES:
        return [(name, name, content, None, None)]
    if kind != ".pdf":
        raise FolioError("INPUT_UNSUPPORTED_TYPE", f"not a supported kind: {kind or 'no extension'}")
    if pdf is None:
        raise FolioError("PDF_RENDERER_UNAVAILABLE", "no PDF renderer")
    with tempfile.TemporaryDirectory() as work:  # the renderer of this task reads it, nobody else
        local = os.path.join(work, name)
        with open(local, "wb") as file:
            file.write(content)
        return [(n, name, c, "single", i) for i, (n, c) in enumerate(pdf.pages(local, os.path.join(work, "pages")), 1)]


def sheets(files: DataFrame, pdf: PdfRenderer | None = None) -> DataFrame:
    """Sheets of (path, content): a row per scan, or one row with the file's error.

    A task holds one file and its sheets at a time. Null content is an unreadable file; an empty table gives no sheets.
    """
    prepare(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.string()), ("sheet_number", pa.int32()), ("name", pa.string()), ("source_name", pa.string()), ("content", pa.binary()), ("page_layout", pa.string()), ("pdf_page_number", pa.int32()), ("error", pa.struct([("code", pa.string()), ("message", pa.string())]))])
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                try:
                    if path is None or content is None:
                        raise FolioError("INPUT_READ_FAILED", f"cannot read {path}")
                    rows = [(path, k, *s, None) for k, s in enumerate(_sheets_of(path, content, pdf), 1)]
                except FolioError as error:
                    rows = [(path, 0, None, os.path.basename(path or ""), None, None, None, summary(error))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(read, SHEETS)


def relationships(xml: DataFrame) -> DataFrame:
    """(doc_id, rel_id, target): internal image relationships of (doc_id, rels_xml), the last of an id; relational form of the reader's."""
    value = lambda tag, name: let(F.regexp_extract(tag, rf"(?s)(?<![:\w.-]){name}\s*=\s*([\"'])(.*?)\1", 2), T.xml_decode)
    names = (("Id", "rel_id"), ("Target", "target"), ("Type", "type"), ("TargetMode", "mode"))
    tags = F.regexp_extract_all("rels_xml", F.lit(r"(?i)<Relationship\b[^>]*>"), F.lit(0))
    # attributes are the generator's: as columns beside the filter they would be searched for again in it
    rows = xml.select("doc_id", F.posexplode(F.transform(tags, lambda tag: F.struct(*(value(tag, n).alias(c) for n, c in names)))).alias("pos", "tag"))
    found = rows.select("doc_id", "pos", "tag.*")
    kept = found.where((F.col("rel_id") != "") & (F.col("target") != "") & F.lower("type").endswith("/image") & (F.lower("mode") != "external"))
    return kept.groupBy("doc_id", "rel_id").agg(F.max_by("target", "pos").alias("target"))


def sheet_references(xml: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, sheet_number, target): references of (doc_id, body_xml) in order, joined with their relationships; others drop out."""
    found = xml.select("doc_id", F.posexplode(F.regexp_extract_all("body_xml", F.lit(r"(?i)\b(?:r:embed|r:id)\s*=\s*([\"'])(.*?)\1"), F.lit(2))).alias("pos", "rel_id")).withColumn("rel_id", T.xml_decode(F.col("rel_id")))
    joined = found.join(links, ["doc_id", "rel_id"])
    return joined.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("sheet_number"), "target")
