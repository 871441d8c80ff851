"""Assembly: pages to documents, asset names, manifests."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.relational import concatenated
from foliospark.operators.repair import repaired


def reserve(names: Iterable[str]) -> list[str]:
    """Each name once, in any case: one that is taken gets -2, -3, ... before its extension until it is free."""
    used: set[str] = set()
    out = []
    for name in names:
        stem, ext = posixpath.splitext(name)
        free, k = name, 2
        while free.lower() in used:
            free, k = f"{stem}-{k}{ext}", k + 1
        used.add(free.lower())
        out.append(free)
    return out


def folder_names(files: list[str]) -> list[str]:
    """Output folders of files: stems, with the extension where stems repeat in any case."""
    parts = [posixpath.splitext(posixpath.basename(f)) for f in files]
    stems = [s.lower() for s, _ in parts]
    wanted = [f"{s}-{e[1:].lower()}" if stems.count(s.lower()) > 1 else s for s, e in parts]
    used: set[str] = set()
    out = []
    for base in wanted:
        free, k = base, 2
        while free.lower() in used:
            free, k = f"{base}-{k}", k + 1
        used.add(free.lower())
        out.append(free)
    return out


def _targets(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for paths, pages in columns:
        out = []
        for found, n in zip(paths.to_pylist(), pages.to_pylist(), strict=True):
            out.append([f"assets/page-{n:04d}/{x}" for x in reserve(posixpath.basename(p.replace("\\", "/")) for p in found or [])])
        yield pa.array(out, pa.list_(pa.string()))


def asset_targets(source_paths: Column, page_number: Column) -> Column:
    """Where each asset of a page goes, in order of reference; a fold, as a numbered name may meet a real one."""
    return F.arrow_udf(_targets, "array<string>")(source_paths, page_number)


def relinked(markdown: Column, references: Column, targets: Column) -> Column:
    """Every reference in the text replaced by its target, one after the other."""
    pairs = F.arrays_zip(references.alias("a"), targets.alias("b"))
    return F.aggregate(pairs, markdown, lambda text, p: F.replace(text, p["a"], p["b"]))


def materialized(recognized: DataFrame) -> DataFrame:
    """Recognised pages to final pages: engine Markdown, or blocks where there is none; repaired; assets renamed and relinked."""
    from foliospark.operators.layout import rendered

    has = F.coalesce("markdown", F.lit("")) != ""
    blocks = recognized.withColumn("_blocks", F.when(~has, rendered(F.coalesce("layout_blocks", F.array().cast(recognized.schema["layout_blocks"].dataType)))))
    body = blocks.withColumn("markdown", F.when(has, T.normalize_markdown(F.col("markdown"))).otherwise(F.col("_blocks.markdown"))).withColumn("error", F.coalesce("error", "_blocks.error"))
    fixed = body.withColumn("markdown", repaired(*(F.col(c) for c in ("markdown", "raw_lines", "fallback_lines", "structure_blocks", "table_cell_boxes", "raw_scale", "fallback_scale"))))
    none = F.array().cast("array<string>")
    named = fixed.withColumn("_refs", F.coalesce("assets.reference", none)).withColumn("_files", F.coalesce("assets.source_path", none)).withColumn("asset_paths", asset_targets(F.col("_files"), F.col("page_number")))
    return named.withColumn("markdown", relinked(F.col("markdown"), F.col("_refs"), F.col("asset_paths"))).drop("_blocks", "_refs", "_files")


def numbered(pages: DataFrame, document: str = "doc_id", *order: str) -> DataFrame:
    """Page numbers from 1 through a document, by sheet and side."""
    return pages.withColumn("page_number", F.row_number().over(Window.partitionBy(document).orderBy(*order)))


def documents(pages: DataFrame, document: str = "doc_id") -> DataFrame:
    """(doc_id, page_count, markdown, error): one text a document. A document with a failed page has failed: its first error, no text."""
    failed = pages.where("error is not null").groupBy(document).agg(F.min_by("error", "page_number").alias("error"))
    return concatenated(pages, document, "page_number", "markdown").join(failed, document, "left").withColumn("markdown", F.when(F.col("error").isNull(), F.col("markdown")))


def manifests(pages: DataFrame, inputs: DataFrame, settings: dict[str, object], document: str = "doc_id") -> DataFrame:
    """(doc_id, manifest): one struct a document. ``inputs``: (doc_id, path, sha256, started_at, completed_at)."""
    size = lambda w, h: F.when(F.col(w).isNotNull(), F.struct(F.col(w).alias("width"), F.col(h).alias("height")))
    page = F.struct(
        F.col("page_number").alias("pageNumber"), F.col("sheet_number").alias("sheetNumber"), "side", F.col("source_image").alias("sourceImage"), F.col("source_document").alias("sourceDocument"), F.col("pdf_page_number").alias("pdfPageNumber"),
        F.col("page_layout").alias("pageLayout"), size("source_width", "source_height").alias("sourceSize"), size("page_width", "page_height").alias("pageSize"), size("recovery_width", "recovery_height").alias("recoveryPageSize"),
        F.col("split_column").alias("splitColumn"), F.col("asset_paths").alias("assets"), "warnings",
        F.struct(F.col("engine.name").alias("name"), F.col("engine.recognition_model").alias("recognitionModel"), F.col("engine.device").alias("device")).alias("engine"),
    )
    # sheets are counted in the pages: a distinct count beside them would move all pages twice, by document and sheet and by document
    grouped = pages.groupBy(document).agg(F.sort_array(F.collect_list(page)).alias("pages"))
    sheets = F.size(F.array_compact(F.array_distinct(F.col("pages.sheetNumber"))))
    name = T.stem(F.col("path"))
    fixed = F.struct(*(F.lit(v).cast("double" if k == "splitRatio" else "string").alias(k) for k, v in settings.items()))
    return grouped.join(inputs, document).select(document, F.struct(
        F.lit(1).alias("schemaVersion"), F.struct("path", "sha256").alias("input"), F.struct(F.concat(name, F.lit(".md")).alias("markdown"), F.concat(name, F.lit(".manifest.json")).alias("manifest")).alias("output"),
        fixed.alias("settings"), F.col("started_at").alias("startedAt"), F.col("completed_at").alias("completedAt"), sheets.alias("sheetCount"), F.size("pages").alias("pageCount"), "pages",
    ).alias("manifest"))
