"""From files to documents: sheets, pages, preprocessing, recognition, repair, assembly, and what is written."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.errors import FolioError, summary
from foliospark.functions import text as T
from foliospark.operators import batch as B
from foliospark.operators.assemble import documents, folder_names, manifests, materialized
from foliospark.operators.codecs import decode_image
from foliospark.operators.raster import encode_png, split_pages, suppress
from foliospark.recognize import MOST_BYTES, MOST_PAGES, ProcessRecognizer, Recognizer, WorkerRecognizer, recognized
from foliospark.schemas import ERROR
from foliospark.session import materialize, prepare, spread
from foliospark.sinks import write_files
from foliospark.sources.loader import files, image_files, sheets
from foliospark.sources.pdf import PdfRenderer

Progress = Callable[[dict[str, Any]], None]
Codec = Callable[[bytes], np.ndarray]


@dataclass(frozen=True)
class Settings:
    split_ratio: float | None = None
    page_layout: str = "auto"
    watermark_mode: str = "text-safe"
    device: str = "cpu"
    paddle_command: str = "paddleocr"
    paddle_python: str | None = None

    def recorded(self) -> dict[str, object]:
        names = {"split_ratio": "splitRatio", "page_layout": "pageLayout", "watermark_mode": "watermarkMode", "paddle_command": "paddleCommand", "paddle_python": "paddlePython"}
        return {names.get(k, k): v for k, v in asdict(self).items()}


_ERROR = pa.struct([("code", pa.string()), ("message", pa.string())])
_PAGE = {
    "doc_id": pa.string(), "sheet_number": pa.int32(), "side_index": pa.int32(), "side": pa.string(), "source_image": pa.string(), "source_document": pa.string(), "pdf_page_number": pa.int32(), "page_layout": pa.string(),
    "source_width": pa.int32(), "source_height": pa.int32(), "split_column": pa.int32(), "page_png": pa.binary(), "recovery_png": pa.binary(), "page_width": pa.int32(), "page_height": pa.int32(),
    "recovery_width": pa.int32(), "recovery_height": pa.int32(), "error": _ERROR,
}
PAGES = f"doc_id STRING, sheet_number INT, side_index INT, side STRING, source_image STRING, source_document STRING, pdf_page_number INT, page_layout STRING, source_width INT, source_height INT, split_column INT, page_png BINARY, recovery_png BINARY, page_width INT, page_height INT, recovery_width INT, recovery_height INT, error {ERROR}"


def _batch(rows: list[dict[str, Any]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row.get(k) for row in rows], t) for k, t in _PAGE.items()], list(_PAGE))


def sheet_pages(sheet: dict[str, Any], settings: Settings, codec: Codec) -> Iterator[dict[str, Any]]:
    """A sheet's pages: decoded, cut in two if it shows two, and preprocessed; in mode text-safe for structure and for recovery apart."""
    row = {"doc_id": sheet["doc_id"], "sheet_number": sheet["sheet_number"], "source_image": sheet["name"], "source_document": sheet["source_name"], "pdf_page_number": sheet["pdf_page_number"]}
    image = codec(sheet["content"])
    height, width = image.shape[:2]
    layout = settings.page_layout
    if layout == "auto":
        layout = "two-up" if settings.split_ratio is not None else sheet["page_layout"] or ("single" if width <= height else "two-up")
    at, parts = (None, [image]) if layout == "single" else split_pages(image, settings.split_ratio)
    safe = settings.watermark_mode == "text-safe"
    for k, part in enumerate(parts):
        page = suppress(part, "conservative" if safe else settings.watermark_mode)
        extra = suppress(part, "text-safe") if safe else None
        yield row | {
            "side_index": k, "side": "single" if layout == "single" else ("left", "right")[k], "page_layout": layout, "source_width": width, "source_height": height, "split_column": at,
            "page_png": encode_png(page), "page_width": page.shape[1], "page_height": page.shape[0],
            "recovery_png": None if extra is None else encode_png(extra), "recovery_width": None if extra is None else extra.shape[1], "recovery_height": None if extra is None else extra.shape[0],
        }


def prepared(sheets: DataFrame, settings: Settings = Settings(), codec: Codec = decode_image) -> DataFrame:
    """Sheets to numbered, preprocessed pages; a sheet that fails is one page with its error. One image is in memory at a time; encoded pages go on in batches, by count and bytes."""
    prepare(sheets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict[str, Any]] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                sheet = batch.slice(i, 1).to_pylist()[0]
                rows: list[dict[str, Any]] = []
                error = sheet["error"]
                if error is None:
                    try:
                        rows = list(sheet_pages(sheet, settings, codec))
                    except FolioError as e:
                        error = summary(e)
                rows = rows or [{"doc_id": sheet["doc_id"], "sheet_number": sheet["sheet_number"], "side_index": 0, "side": "single", "source_image": sheet["name"], "source_document": sheet["source_name"], "error": error}]
                made += rows
                size += sum(len(row.get(k) or b"") for row in rows for k in ("page_png", "recovery_png"))
                if len(made) >= MOST_PAGES or size >= MOST_BYTES:
                    yield _batch(made)
                    made, size = [], 0
        if made:
            yield _batch(made)

    # written once, so that numbering looks at keys alone and no picture goes through the window
    found = materialize(sheets.mapInArrow(run, PAGES), "prepared")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_number", "side_index"))
    keys = found.select("doc_id", "sheet_number", "side_index", number.alias("page_number"))
    return found.join(keys, ["doc_id", "sheet_number", "side_index"], "left")


def final_pages(sheets: DataFrame, recognizer: Recognizer, settings: Settings = Settings(), codec: Codec = decode_image) -> DataFrame:
    """All stages up to final pages. Preprocessed pages are written first: recognition is dear, and a lost task repeats only its own pages."""
    pages = prepared(sheets, settings, codec)
    dealt = spread(pages, "doc_id", "page_number")  # a page is a task's unit of work, whatever file it came from and however few bytes it has
    return materialized(materialize(recognized(dealt, recognizer), "recognized"))


def convert(spark: SparkSession, path: str | list[str] | DataFrame, recognizer: Recognizer, settings: Settings = Settings(), *, pdf: PdfRenderer | None = None, codec: Codec = decode_image) -> dict[str, DataFrame]:
    """Every file at a path or paths (a file, a folder, a pattern; any store), or of (path, content): tables pages, documents and manifests."""
    prepare(spark)
    started = datetime.now(timezone.utc)
    found = path if isinstance(path, DataFrame) else files(spark, path)
    pages = materialize(final_pages(sheets(found, pdf), recognizer, settings, codec), "final")
    stamp = lambda t: F.lit(t.isoformat(timespec="milliseconds").replace("+00:00", "Z"))
    inputs = found.select(F.col("path").alias("doc_id"), F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("sha256"), stamp(started).alias("started_at"), stamp(datetime.now(timezone.utc)).alias("completed_at"))
    return {"pages": pages, "documents": documents(pages), "manifests": manifests(pages, inputs, settings.recorded())}


def default_recognizer(settings: Settings) -> Recognizer:
    """The program that the settings name, run for each page; with a Python of its own, the bundled worker under it, which is kept."""
    recovery = settings.watermark_mode == "text-safe"
    if settings.paddle_python is None:
        return ProcessRecognizer(settings.paddle_command, device=settings.device, recovery=recovery, bridge=False)
    worker = os.path.join(os.path.dirname(os.path.abspath(__file__)), "recognition_worker.py")
    return WorkerRecognizer(settings.paddle_python, (worker,), device=settings.device, recovery=recovery)


def local_path(path: str) -> str:
    """A path as the driver knows it: without the scheme of local files."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _manifest_text(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for manifests_ in column:
        yield pa.array([json_text(m) for m in manifests_.to_pylist()], pa.string())


def output_files(tables: dict[str, DataFrame], folders: DataFrame) -> DataFrame:
    """(path, content, source_path) of every document that did not fail: its Markdown, its manifest and its assets, in its folder."""
    good = tables["documents"].where("error is null").select("doc_id", "markdown").join(folders, "doc_id").join(tables["manifests"], "doc_id")
    text = lambda ending, c: F.struct(F.concat(_inside("folder"), T.stem(F.col("doc_id")), F.lit(ending)).alias("path"), c.cast("binary").alias("content"))
    both = F.array(text(".md", F.col("markdown")), text(".manifest.json", F.arrow_udf(_manifest_text, "string")(F.col("manifest"))))
    texts = good.select(F.explode(both).alias("f")).select("f.path", "f.content", F.lit(None).cast("string").alias("source_path"))
    own = tables["pages"].where(F.size("asset_paths") > 0).select("doc_id", "asset_paths", "assets").join(good.select("doc_id", "folder"), "doc_id")
    assets = own.select("folder", F.explode(F.arrays_zip("asset_paths", "assets")).alias("a")).select(F.concat(_inside("folder"), F.col("a.asset_paths")).alias("path"), F.col("a.assets.content").alias("content"), F.col("a.assets.source_path").alias("source_path"))
    return texts.unionByName(assets)


def _inside(folder: str) -> Column:
    return F.when(F.col(folder) == "", "").otherwise(F.concat(folder, F.lit("/")))


def write_outputs(tables: dict[str, DataFrame], folders: DataFrame, output: str) -> DataFrame:
    """(doc_id, folder, markdown, manifest, error): every document that did not fail, written by the executors to its folder.

    ``folders``: (doc_id, folder). Files come into being all together, when the job commits; a job that fails leaves none.
    """
    write_files(output_files(tables, folders), output)
    name = lambda ending: F.when(F.col("error").isNull(), F.concat(_inside("folder"), T.stem(F.col("doc_id")), F.lit(ending)))
    return tables["documents"].select("doc_id", "error").join(folders, "doc_id").select("doc_id", "error", "folder", name(".md").alias("markdown"), name(".manifest.json").alias("manifest"))


def json_text(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def run(spark: SparkSession, input_path: str, output: str, settings: Settings = Settings(), *, recognizer: Recognizer | None = None, pdf: PdfRenderer | None = None, codec: Codec = decode_image, progress: Progress | None = None) -> dict[str, Any]:
    """One input to its Markdown, manifest and assets in a folder. A failed page fails the input."""
    say = progress or (lambda event: None)
    input_path, output = os.path.abspath(input_path), os.path.abspath(output)
    say({"type": "input:start", "input_path": input_path})
    if not os.path.isfile(input_path):
        raise FolioError("INPUT_READ_FAILED", f"cannot read {input_path}")
    tables = convert(spark, input_path, recognizer or default_recognizer(settings), settings, pdf=pdf or PdfRenderer(settings.paddle_python or "python"), codec=codec)
    document = tables["documents"].select("doc_id", "error").first()
    if document["error"]:
        raise FolioError(document["error"]["code"], document["error"]["message"])
    pages = tables["pages"].select("page_number", "sheet_number", "side", F.coalesce(F.size("asset_paths"), F.lit(0)).alias("n")).orderBy("page_number").collect()
    say({"type": "input:complete", "sheet_count": len({p["sheet_number"] for p in pages})})
    done = write_outputs(tables, tables["documents"].select("doc_id", F.lit("").alias("folder")), output).first()
    for page in pages:
        say({"type": "page:start", "page_number": page["page_number"], "side": page["side"]})
        say({"type": "page:complete", "page_number": page["page_number"], "asset_count": max(0, page["n"])})
    markdown, manifest = (os.path.join(output, done[c]) for c in ("markdown", "manifest"))
    with open(manifest, encoding="utf-8") as file:
        found = json.load(file)
    say({"type": "complete", "markdown_path": markdown, "manifest_path": manifest})
    return {"markdown_path": markdown, "manifest_path": manifest, "manifest": found}


def run_folder(spark: SparkSession, folder: str, output: str, settings: Settings = Settings(), *, one: Callable[..., dict[str, Any]] | None = None, recognizer: Recognizer | None = None, pdf: PdfRenderer | None = None, codec: Codec = decode_image, progress: Progress | None = None) -> dict[str, Any]:
    """The images of a folder, all in one job, each to a folder of its own; a failed file is a result, and the others go on.

    With ``one``, a function like :func:`run`, files are done one after the other by it.
    """
    say = progress or (lambda event: None)
    folder, output = os.path.abspath(folder), os.path.abspath(output)
    started = now()
    found = image_files(folder)
    names = folder_names(found)
    os.makedirs(output, exist_ok=True)
    say({"type": "batch:start", "file_count": len(found)})
    if one:
        results = _one_by_one(spark, found, names, output, settings, one, say)
    else:
        tables = convert(spark, found, recognizer or default_recognizer(settings), settings, pdf=pdf, codec=codec)
        own = spark.createDataFrame(list(zip(found, names, strict=True)), "path string, folder string")
        ids = tables["documents"].select("doc_id", F.regexp_replace("doc_id", "^file:/+", "/").alias("path"))
        done = {local_path(r["doc_id"]): r for r in write_outputs(tables, ids.join(own, "path").select("doc_id", "folder"), output).collect()}
        results = []
        for k, (path, name) in enumerate(zip(found, names, strict=True), 1):
            here, row = {"file_number": k, "file_count": len(found), "input_path": path}, done.get(path)
            result = {"input": os.path.basename(path), "status": "succeeded", "outputDirectory": name, "markdown": row and row["markdown"], "manifest": row and row["manifest"]}
            error = summary(FolioError("INPUT_READ_FAILED", f"cannot read {path}")) if row is None else row["error"] and row["error"].asDict()
            if error:
                result |= {"status": "failed", "error": error}
            say({"type": "batch:file:start", **here})
            say({"type": "batch:file:error", **here, "error": error} if error else {"type": "batch:file:complete", **here})
            results.append(result)
    schema = f"file_number INT, input_directory STRING, input STRING, status STRING, markdown STRING, manifest STRING, error {ERROR}"
    table = spark.createDataFrame([(k, folder, r["input"], r["status"], r["markdown"], r["manifest"], (r["error"]["code"], r["error"]["message"]) if "error" in r else None) for k, r in enumerate(results, 1)], schema)
    row = B.summaries(table, ["input_directory"]).first()
    totals = {k: row[k] for k in ("discovered", "succeeded", "failed")}
    whole = {"schemaVersion": 1, "inputDirectory": folder, "outputDirectory": output, "startedAt": started, "completedAt": now(), "totals": totals, "results": results}
    paths = [os.path.join(output, n) for n in ("batch-summary.md", "batch-summary.json")]
    for path, text in zip(paths, (row["summary"], json_text(whole)), strict=True):
        with open(path, "w", encoding="utf-8", newline="") as file:
            file.write(text)
    say({"type": "batch:complete", "summary": whole})
    return {"summary_markdown_path": paths[0], "summary_json_path": paths[1], "summary": whole, "has_failures": totals["failed"] > 0}


def _one_by_one(spark: SparkSession, found: list[str], names: list[str], output: str, settings: Settings, one: Callable[..., dict[str, Any]], say: Progress) -> list[dict[str, Any]]:
    results: list[dict[str, Any]] = []
    for k, (path, name) in enumerate(zip(found, names, strict=True), 1):
        here = {"file_number": k, "file_count": len(found), "input_path": path}
        say({"type": "batch:file:start", **here})
        result: dict[str, Any] = {"input": os.path.basename(path), "status": "succeeded", "outputDirectory": name, "markdown": None, "manifest": None}
        try:
            done = one(spark, path, os.path.join(output, name), settings, progress=lambda e, here=here: say({**e, "batch": here}))
            result |= {k: os.path.relpath(done[p], output).replace(os.sep, "/") for k, p in (("markdown", "markdown_path"), ("manifest", "manifest_path"))}
            say({"type": "batch:file:complete", **here})
        except Exception as error:  # one file's failure is its result
            result |= {"status": "failed", "error": summary(error)}
            say({"type": "batch:file:error", **here, "error": result["error"]})
        results.append(result)
    return results
