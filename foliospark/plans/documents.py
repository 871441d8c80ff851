"""Queries from files to documents: kinds of paths, embedded scans, rasters, recognisers' JSON, repair of blocks, whole conversions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import layout as L
from foliospark.operators import relational as R
from foliospark.operators.raster import cropped, decoded, pixels, upscaled
from foliospark.plans import query, table
from foliospark.schemas import BLOCK, BOX, LINE, SHEETS
from foliospark.session import spread
from foliospark.sources import sidecars
from foliospark.sources.loader import kind_of, sheets

NAMES = "(SELECT p_partkey, 'in.put/' || p_brand || CASE p_partkey % 8 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.JPG' WHEN 3 THEN '.tif' WHEN 4 THEN '.txt' WHEN 5 THEN '' WHEN 6 THEN '.webp' ELSE '.tar.png' END AS path FROM part)"


@query(f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 4 THEN 'other' WHEN 5 THEN 'other' ELSE 'image' END AS kind, path[8:] AS base,
CASE p_partkey % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.jpg' WHEN 3 THEN '.tif' WHEN 4 THEN '.txt' WHEN 5 THEN '' WHEN 6 THEN '.webp' ELSE '.png' END AS extension, regexp_replace(path[8:], '[.][^.]*$', '') AS stem FROM {NAMES}""")
def q57_path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, (".PDF", ".docx", ".JPG", ".tif", ".txt", "", ".webp", ".tar.png")))
    path = F.concat(F.lit("in.put/"), "p_brand", F.element_at(ends, (F.col("p_partkey") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", kind_of(path).alias("kind"), T.base_name(path).alias("base"), T.extension(path).alias("extension"), T.stem(path).alias("stem"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files, each of which is more work than its row: a split of the table would be one task's."""
    return spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word-processor files that show one to three images, the last first; some are broken, some lack an image."""
    from foliospark.sources.docx import BODY, LINKS, MEDIA

    namespace = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    for batch in batches:
        for k in batch.column("s_suppkey").to_pylist():  # a file at a time, however many the batch names
            out, n = io.BytesIO(), 1 + k % 3
            if k % 5:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED) as z:
                    z.writestr(BODY, f'<w:d xmlns:w="urn:w" xmlns:r="{namespace}">' + "".join(f'<w:x r:embed="rId{i}"/>' for i in range(n, 0, -1)) + "</w:d>")
                    z.writestr(LINKS, "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Type="x/image" Target="./media/scan{i}.png"/>' for i in range(1, n + 1)) + "</Relationships>")
                    for i in range(1, n + 1 - (k % 7 == 0)):
                        z.writestr(f"{MEDIA}scan{i}.png", bytes(10 * k + i))
            yield pa.record_batch({"path": pa.array([f"/in/{k}.docx"]), "content": pa.array([out.getvalue() if k % 5 else b"no archive"], pa.binary())})


@query("""SELECT '/in/' || s_suppkey || '.docx' AS doc_id, CASE WHEN i = 0 THEN 0 ELSE 2 + s_suppkey % 3 - i END::INT AS sheet_number, CASE WHEN i > 0 THEN 'scan' || i || '.png' END AS name, CASE WHEN i > 0 THEN 10 * s_suppkey + i ELSE 0 END::INT AS size,
CASE WHEN s_suppkey % 5 = 0 THEN 'INPUT_INVALID_ZIP' WHEN s_suppkey % 7 = 0 THEN 'INPUT_IMAGE_MISSING' END AS code FROM supplier, (VALUES (0), (1), (2), (3)) v(i) WHERE CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 THEN i = 0 ELSE i BETWEEN 1 AND 1 + s_suppkey % 3 END""")
def q58_embedded_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = suppliers(spark, sf_dir).mapInArrow(_documents, "path STRING, content BINARY")
    return sheets(files).select("doc_id", "sheet_number", "name", F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"), F.col("error.code").alias("code"))


RASTER = "(SELECT s_suppkey, x, y, (s_suppkey * 13 + x * 37 + y * 59) % 256 AS red, (s_suppkey * 7 + x * 3) % 256 AS green, (y * 101) % 256 AS blue, 3 + s_suppkey % 5 AS width FROM supplier, range(0, 7) a(x), range(0, 4) b(y) WHERE x < 3 + s_suppkey % 5)"


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small rasters, 3 to 7 pixels wide and 4 high."""
    k, width = F.col("s_suppkey"), 3 + F.col("s_suppkey") % 5
    two = lambda v: F.lpad(F.hex((v % 256).cast("int")), 2, "0")

    def pixel(i: Column) -> Column:
        x, y = i % width, F.floor(i / width)
        return F.concat(two(k * 13 + x * 37 + y * 59), two(k * 7 + x * 3), two(y * 101))

    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), width * 4 - 1), pixel), ""))
    return suppliers(spark, sf_dir).select("s_suppkey", F.struct(width.cast("int").alias("width"), F.lit(4).alias("height"), data.alias("data")).alias("image"))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from foliospark.operators.raster import checked, encode_png

    for batch in batches:
        png = [encode_png(checked(v["width"], v["height"], v["data"])) for v in batch.column("image").to_pylist()]
        yield pa.record_batch({"s_suppkey": batch.column("s_suppkey"), "png": pa.array(png, pa.binary())})


@query(f"SELECT s_suppkey, x::INT AS x, y::INT AS y, red::INT AS red, green::INT AS green, blue::INT AS blue FROM {RASTER}")
def q59_png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    png = _rasters(spark, sf_dir).mapInArrow(_encoded, "s_suppkey BIGINT, png BINARY")
    return pixels(png.select("s_suppkey", decoded(F.col("png")).alias("image")), "image", "s_suppkey").drop("light")


@query(f"SELECT s_suppkey, (2 * (x - 1) + i)::INT AS x, (2 * (y - 1) + j)::INT AS y, red::INT AS red, green::INT AS green, blue::INT AS blue FROM {RASTER}, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) WHERE x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 3")
def q60_crop_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _rasters(spark, sf_dir).select("s_suppkey", cropped(F.col("image"), 1, 1, 2, 3).alias("part"))
    return pixels(part.select("s_suppkey", upscaled(F.col("part"), 2).alias("image")), "image", "s_suppkey").drop("light")


PLACED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", n.alias("n"))


def listed(of: Column, n: str = "n") -> Column:
    """The values of a group in the order of n."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(n), of.alias("v")))), lambda x: x["v"])


@query(f"""SELECT l_orderkey, count(*) FILTER (WHERE l_partkey % 5 <> 0)::INT AS n_blocks, coalesce(string_agg(CASE WHEN l_partkey % 2 = 0 THEN 'table' ELSE 'text' END || ':' || l_partkey, ' ' ORDER BY n) FILTER (WHERE l_partkey % 5 <> 0), '') AS blocks,
count(*) FILTER (WHERE l_partkey % 3 <> 0)::INT AS n_cells, coalesce(sum(n * 10) FILTER (WHERE l_partkey % 3 <> 0), 0)::DOUBLE AS tops FROM {PLACED} GROUP BY l_orderkey""")
def q61_structure_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as blocks and cells of a recogniser's JSON, some without a box of four numbers; two files that do not count beside it."""
    y = F.col("n") * 10.0
    box = lambda whole: F.when(whole, F.array(F.lit(0.0), y, F.lit(9.0), y + 5)).otherwise(F.array(F.lit(0.0), y, F.lit(9.0)))
    block = F.struct(F.when(F.col("l_partkey") % 2 == 0, "table").otherwise("text").alias("block_label"), F.col("l_partkey").cast("string").alias("block_content"), box(F.col("l_partkey") % 5 != 0).alias("block_bbox"))
    pages = placed(spark, sf_dir).groupBy("l_orderkey").agg(listed(block).alias("parsing_res_list"), listed(box(F.col("l_partkey") % 3 != 0)).alias("cell_box_list"))
    good = F.to_json(F.struct("parsing_res_list", F.array(F.struct("cell_box_list")).alias("table_res_list")))
    file = lambda i, name, text: F.struct(F.lit(i).alias("walk_index"), F.lit(name).alias("name"), text.alias("json"))
    files = pages.select("l_orderkey", F.explode(F.array(file(0, "RAW_ocr.json", F.lit("{}")), file(1, "page_res.json", good), file(2, "z.json", F.lit("{")))).alias("f")).select("l_orderkey", "f.*")
    found = sidecars.structure(files, ["l_orderkey"])
    said = F.array_join(F.transform("structure_blocks", lambda b: F.concat(b["label"], F.lit(":"), b["content"])), " ")
    return found.select("l_orderkey", F.size("structure_blocks").alias("n_blocks"), said.alias("blocks"), F.size("table_cell_boxes").alias("n_cells"), F.aggregate("table_cell_boxes", F.lit(0.0), lambda a, b: a + b[1]).alias("tops"))


@query(f"SELECT l_orderkey, CASE WHEN bool_or(l_partkey % 11 = 0) THEN 'OCR_INVALID_BLOCK' END AS code, CASE WHEN bool_or(l_partkey % 11 = 0) THEN 'not a box: [5.0,0.0,5.0,' || min(n) FILTER (WHERE l_partkey % 11 = 0) || '.0]' END AS message FROM {PLACED} GROUP BY l_orderkey")
def q62_block_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of a page that has no area."""
    n = F.col("n") * 1.0
    box = F.when(F.col("l_partkey") % 11 == 0, F.array(F.lit(5.0), F.lit(0.0), F.lit(5.0), n)).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(5.0), n))
    pages = placed(spark, sf_dir).groupBy("l_orderkey").agg(listed(F.struct(box.alias("bbox"))).alias("blocks"))
    return pages.select("l_orderkey", L.block_error(F.col("blocks")).alias("e")).select("l_orderkey", "e.code", "e.message")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages, whose repair is dear: a split of the file would be one task's."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")


def _repaired(markdown: Column, raw: Column | None = None, fallback: Column | None = None, blocks: Column | None = None) -> Column:
    from foliospark.operators.repair import repaired

    empty = lambda kind: F.array().cast(f"ARRAY<{kind}>")
    one = F.lit(1.0)
    return repaired(markdown, empty(LINE) if raw is None else raw.cast(f"ARRAY<{LINE}>"), empty(LINE) if fallback is None else fallback.cast(f"ARRAY<{LINE}>"), empty(BLOCK) if blocks is None else blocks.cast(f"ARRAY<{BLOCK}>"), empty(BOX), one, one)


def _line(text: Column, top: Column | float) -> Column:
    top = top if isinstance(top, Column) else F.lit(top)
    return F.struct(text.alias("text"), F.array(F.lit(80.0), top + 5.0, F.lit(680.0), top + 33.0).alias("box"), F.lit(None).cast("double").alias("score"))


@query(f"SELECT l_orderkey, string_agg(CASE WHEN l_partkey % 4 = 0 THEN '~#' || n || '%' ELSE 'Tighten the bolt of part ' || l_partkey END, chr(10) || chr(10) ORDER BY n) AS markdown FROM {PLACED} GROUP BY l_orderkey")
def q63_blocks_read_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of noise, read from the lines inside them; figures stay."""
    noise, y = F.concat(F.lit("~#"), F.col("n").cast("string"), F.lit("%")), F.col("n") * 100.0
    block = F.struct(F.when(F.col("l_partkey") % 4 == 0, "figure").otherwise("text").alias("label"), noise.alias("content"), F.array(F.lit(70.0), y, F.lit(710.0), y + 48).alias("bbox"))
    line = _line(F.concat(F.lit("Tighten the bolt of part "), F.col("l_partkey").cast("string")), y)
    pages = placed(spark, sf_dir).groupBy("l_orderkey").agg(R.ordered_concat(noise, "\n\n", F.col("n")).alias("md"), listed(line).alias("raw"), listed(block).alias("blocks"))
    return pages.select("l_orderkey", _repaired(F.col("md"), F.col("raw"), None, F.col("blocks")).alias("markdown"))


@query("SELECT p_partkey, 'The pump runs at ' || (200 + p_size) || 'V and draws ' || CASE WHEN p_size % 3 = 0 THEN 10 + p_size ELSE 20 + p_size END || 'A at most' AS markdown FROM part")
def q64_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of a sentence: volts are the second one's, and amperes where it has no watts instead."""
    said = lambda volts, amperes, unit: F.concat(F.lit("The pump runs at "), (F.col("p_size") + volts).cast("string"), F.lit("V and draws "), (F.col("p_size") + amperes).cast("string"), unit, F.lit(" at most"))
    first, second = said(100, 10, F.lit("A")), said(200, 20, F.when(F.col("p_size") % 3 == 0, "W").otherwise("A"))
    block = F.struct(F.lit("text").alias("label"), F.lit("x@--").alias("content"), F.array(*map(F.lit, (70.0, 100.0, 710.0, 148.0))).alias("bbox"))
    return parts(spark, sf_dir).select("p_partkey", _repaired(F.lit("x@--"), F.array(_line(first, 100.0)), F.array(_line(second, 100.0)), F.array(block)).alias("markdown"))


@query("""SELECT p_partkey, 'Switch off the ' || p_name || chr(10) || chr(10) || CASE WHEN p_size % 3 = 0 THEN '' ELSE 'Note: ' || p_brand || ' holds its charge for a minute' || chr(10) || chr(10) END || 'Remove the cover then' || CASE WHEN p_size % 3 = 1 THEN ' and the fuse' ELSE '' END AS markdown FROM part""")
def q65_missing_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note that the text lacks goes before the line after it; it is there already in a third, and a third has no such note."""
    size, note = F.col("p_size") % 3, F.concat(F.lit("Note: "), "p_brand", F.lit(" holds its charge for a minute"))
    first, last = F.concat(F.lit("Switch off the "), "p_name"), F.concat(F.lit("Remove the cover then"), F.when(size == 1, " and the fuse").otherwise(""))
    md = F.concat_ws("\n\n", first, F.when(size == 2, note), last)
    lines = F.concat(F.array(_line(first, 100.0)), F.when(size != 0, F.array(_line(note, 150.0))).otherwise(F.array().cast(f"ARRAY<{LINE}>")), F.array(_line(last, 200.0)))
    return parts(spark, sf_dir).select("p_partkey", _repaired(md, lines).alias("markdown"))


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A scan of one page or of two for each supplier; some are no images."""
    from foliospark.operators.raster import encode_png, solid

    for batch in batches:
        keys = batch.column("s_suppkey").to_pylist()
        made = [b"no image" if k % 9 == 0 else encode_png(solid(40 + 80 * (k % 2), 60, 255)) for k in keys]
        names, n = [f"{k}.png" for k in keys], len(keys)
        yield pa.record_batch({"doc_id": pa.array([f"/in/{x}" for x in names]), "sheet_number": pa.array([1] * n, pa.int32()), "name": pa.array(names), "source_name": pa.array(names), "content": pa.array(made, pa.binary()), "page_layout": pa.nulls(n, pa.string()),
                               "pdf_page_number": pa.nulls(n, pa.int32()), "error": pa.nulls(n, pa.struct([("code", pa.string()), ("message", pa.string())]))})


class PageNumbers:
    """A recogniser that reads nothing but which page it is; it fails on a tenth of the scans."""

    def recognize(self, page: dict[str, Any]) -> dict[str, Any]:
        from foliospark.errors import FolioError

        if page["source_image"].startswith("1"):
            raise FolioError("OCR_ENGINE_FAILED", f"not {page['source_image']}")
        return {"markdown": f" page {page['page_number']} {page['side']}\r\n2)more", "raw_lines": [], "warnings": [], "engine": {"name": "numbers", "recognition_model": "none", "device": "cpu"}}


@query("""SELECT '/in/' || s_suppkey || '.png' AS doc_id, CASE WHEN s_suppkey % 9 = 0 OR s_suppkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS page_count, CASE WHEN s_suppkey % 9 = 0 THEN 'IMAGE_DECODE_FAILED' WHEN starts_with(s_suppkey::VARCHAR, '1') THEN 'OCR_ENGINE_FAILED' END AS code,
CASE WHEN s_suppkey % 9 = 0 OR starts_with(s_suppkey::VARCHAR, '1') THEN NULL WHEN s_suppkey % 2 = 0 THEN '<!-- page: 1 -->' || chr(10) || chr(10) || 'page 1 single' || chr(10) || '2\\) more' || chr(10)
ELSE '<!-- page: 1 -->' || chr(10) || chr(10) || 'page 1 left' || chr(10) || '2\\) more' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '<!-- page: 2 -->' || chr(10) || chr(10) || 'page 2 right' || chr(10) || '2\\) more' || chr(10) END AS markdown FROM supplier""")
def q66_converted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans through all stages to documents: cut, preprocessed, recognised by a plug-in, repaired, put together; errors are a column."""
    from foliospark.operators.assemble import documents
    from foliospark.pipeline import final_pages

    scans = suppliers(spark, sf_dir).mapInArrow(_scans, SHEETS)
    return documents(final_pages(scans, PageNumbers())).select("doc_id", "page_count", F.col("error.code").alias("code"), "markdown")



SCOPE = "'2.1 Scope', '1) ' || p_name || ' valves open on loss of pressure at any time', '2) ' || p_brand || ' valves close then and stay closed for good'"
ROWS = "<tr><td>c</td><td>d</td></tr><tr><td>e</td><td>f</td></tr>"


@query(f"""SELECT p_partkey, '<table><tr><td>a</td><td>b</td></tr>{ROWS}</table>' || chr(10) || chr(10) || replace(array_to_string([{SCOPE}], chr(10) || chr(10)), ') ', '\\) ') AS markdown FROM part""")
def q67_text_beside_tables_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A garbled text in a surplus cell gives way to what the page's lines say beside the table, in either reading."""
    from foliospark.operators.repair import repaired

    first = F.concat(F.lit("1) "), "p_name", F.lit(" valves open on loss of pressure at any time"))
    second = F.concat(F.lit("2) "), "p_brand", F.lit(" valves close then and stay closed for good"))
    garbled = F.concat(F.lit("2.1 Sc0pe "), F.replace(first, F.lit("loss of"), F.lit("l0s 0f")), F.lit(" "), F.replace(second, F.lit("stay closed"), F.lit("stay c1osed")))
    md = F.concat(F.lit('<table><tr><td>a</td><td>b</td><td rowspan="3">'), garbled, F.lit(f"</td></tr>{ROWS}</table>"))
    at = lambda text, x, y, w: F.struct(text.alias("text"), F.array(*(F.lit(float(v)) for v in (x, y, x + w, y + 30))).alias("box"), F.lit(None).cast("double").alias("score"))
    lines = F.array(at(F.lit("a"), 60, 110, 60), at(F.lit("Scope"), 690, 152, 90), at(F.lit("2.1"), 620, 150, 50), at(F.element_at(F.split(first, " valves "), 1), 620, 200, 200), at(F.concat(F.lit("valves "), F.element_at(F.split(first, " valves "), 2)), 620, 240, 300), at(second, 620, 300, 300), at(F.lit("below"), 620, 700, 90))
    cells = F.array(*(F.array(*map(F.lit, b)) for b in ((50.0, 100.0, 200.0, 120.0), (200.0, 100.0, 350.0, 120.0), (50.0, 120.0, 200.0, 140.0), (600.0, 90.0, 960.0, 360.0))))
    empty = lambda kind: F.array().cast(f"ARRAY<{kind}>")
    even, none = F.col("p_size") % 2 == 0, empty(LINE)
    one = F.lit(1.0)
    rows = parts(spark, sf_dir).withColumn("lines", lines.cast(f"ARRAY<{LINE}>"))
    return rows.select("p_partkey", repaired(md, F.when(even, F.col("lines")).otherwise(none), F.when(even, none).otherwise(F.col("lines")), empty(BLOCK), cells, one, one).alias("markdown"))


@query("SELECT p_partkey, 'alpha beta gamma delta' || chr(10) || chr(10) || p_name || ' in between' || chr(10) || chr(10) || 'omega sigma theta kappa' AS markdown FROM part")
def q68_aligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand somewhere else than their blocks, and in another scale: those of known text are anchors for those between."""
    low, wide = F.col("p_size") * 7.0, F.col("p_partkey") % 5 + 1.0
    middle = F.concat("p_name", F.lit(" in between"))
    block = lambda text, y: F.struct(F.lit("text").alias("label"), F.lit(text).alias("content"), F.array(*map(F.lit, (70.0, y, 710.0, y + 48.0))).alias("bbox"))
    blocks = F.array(block("alpha beta gamma delta", 100.0), block("&%", 200.0), block("omega sigma theta kappa", 300.0))
    lines = F.array(_line(F.lit("omega sigma theta kappa"), low + 200 * wide), _line(F.lit("alpha beta gamma delta"), low), _line(middle, low + 100 * wide))
    md = F.lit("alpha beta gamma delta\n\n&%\n\nomega sigma theta kappa")
    return parts(spark, sf_dir).select("p_partkey", _repaired(md, lines, None, blocks).alias("markdown"))


@query("SELECT p_partkey, '전원 스위치가 ' || CASE WHEN p_size % 2 = 0 THEN 'Off' ELSE 'Of' END || ' 위치에 있으면 ' || p_brand || ' 점등' AS markdown FROM part")
def q69_consensus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word that lacks a letter is corrected where both readings have it whole."""
    text = lambda word: F.concat(F.lit("전원 스위치가 "), word, F.lit(" 위치에 있으면 "), "p_brand", F.lit(" 점등"))
    said, first, second = text(F.lit("Of")), text(F.lit("Off")), text(F.when(F.col("p_size") % 2 == 0, "Off").otherwise("On"))
    block = F.struct(F.lit("text").alias("label"), said.alias("content"), F.array(*map(F.lit, (70.0, 100.0, 710.0, 148.0))).alias("bbox"))
    return parts(spark, sf_dir).select("p_partkey", _repaired(said, F.array(_line(first, 100.0)), F.array(_line(second, 100.0)), F.array(block)).alias("markdown"))


@query(f"""SELECT s_suppkey, (2 * x + i)::INT AS x, (2 * y + j)::INT AS y, CASE WHEN greatest(red, green, blue) - least(red, green, blue) > 18 THEN red WHEN red * 0.2126::DOUBLE + green * 0.7152::DOUBLE + blue * 0.0722::DOUBLE <= 150 THEN 0 ELSE 255 END::INT AS red,
CASE WHEN greatest(red, green, blue) - least(red, green, blue) > 18 THEN blue WHEN red * 0.2126::DOUBLE + green * 0.7152::DOUBLE + blue * 0.0722::DOUBLE <= 150 THEN 0 ELSE 255 END::INT AS blue
FROM (SELECT s_suppkey, x, y, (x * 60 + y * 23 + s_suppkey) % 256 AS red, (x * 60 + y * 23 + s_suppkey) % 256 AS green, least(255, (x * 60 + y * 23 + s_suppkey) % 256 + s_suppkey % 40) AS blue FROM supplier, range(0, 4) a(x), range(0, 3) b(y)), (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)""")
def q70_text_safe_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral pixels become black or white, tinted ones stay, and small rasters are doubled."""
    from foliospark.operators.raster import suppressed

    two = lambda v: F.lpad(F.hex(v.cast("int")), 2, "0")
    base = lambda i: ((i % 4) * 60 + F.floor(i / 4) * 23 + F.col("s_suppkey")) % 256
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(two(base(i)), two(base(i)), two(F.least(F.lit(255), base(i) + F.col("s_suppkey") % 40)))), ""))
    image = F.struct(F.lit(4).alias("width"), F.lit(3).alias("height"), data.alias("data"))
    rows = suppliers(spark, sf_dir).select("s_suppkey", suppressed(image, "text-safe").alias("image"))
    return pixels(rows, "image", "s_suppkey").select("s_suppkey", "x", "y", "red", "blue")


class CountedPages:
    """A PDF renderer that gives as many pages as the file has bytes; none is an error."""

    def pages(self, path: str, folder: str | None = None) -> list[tuple[str, bytes]]:
        import os

        from foliospark.errors import FolioError

        n = os.path.getsize(path)
        if not n:
            raise FolioError("PDF_NO_PAGES", "no pages")
        return [(f"page-{i:04d}.png", bytes(i)) for i in range(1, n + 1)]


@query("""SELECT '/in/' || s_suppkey || '.pdf' AS doc_id, i::INT AS sheet_number, i::INT AS size, i > 0 AS read, coalesce(CASE WHEN i > 0 THEN 'page-000' || i || '.png' END, '') AS name, CASE WHEN i = 0 THEN 'PDF_NO_PAGES' ELSE '' END AS code
FROM supplier, range(0, 6) t(i) WHERE CASE WHEN s_suppkey % 6 = 0 THEN i = 0 ELSE i BETWEEN 1 AND s_suppkey % 6 END""")
def q71_pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = suppliers(spark, sf_dir).select(F.concat(F.lit("/in/"), F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("path"), F.repeat(F.lit("%"), (F.col("s_suppkey") % 6).cast("int")).cast("binary").alias("content"))
    found = sheets(files, CountedPages())
    single = (F.col("page_layout") == "single") & (F.col("pdf_page_number") == F.col("sheet_number"))
    none = F.lit("")
    return found.select("doc_id", "sheet_number", F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"), F.coalesce(single, F.lit(False)).alias("read"), F.coalesce("name", none).alias("name"), F.coalesce("error.code", none).alias("code"))
