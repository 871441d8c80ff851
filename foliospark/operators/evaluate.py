"""Evaluation of a document against what it should say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import pure
from foliospark.functions import text as T

#: The phrases of the acceptance document.
MARKERS = ("월간 품질 점검 보고서", "QA-2026-0720", "A-01", "B-07", "회색 워터마크 대비", "설비 운영 현황", "설비 점검 현황", "OCR-1", "SCAN-2", "운영 요약", "TABLE-SIDE-TEXT")
TABLE_PHRASE, AFTER_PHRASE, ROW_CELLS, COLUMN_CELLS, STAMP = "설비 점검 현황", "운영 요약", ("A-01", "OCR-1"), ("검사 구분", "설비 점검 현황"), "SAMPLE"


def merged_cell_has(markdown: Column, attribute: str, phrase: str) -> Column:
    """Whether a cell whose ``attribute`` begins with 2 to 9 has the phrase; cells are only looked for in a text that has markup."""
    return F.when(markdown.contains("<"), _merged_cell_has(markdown, attribute, phrase)).when(markdown.isNotNull(), False)


def _merged_cell_has(markdown: Column, attribute: str, phrase: str) -> Column:
    cells = F.regexp_extract_all(markdown, F.lit(r"(?is)<t[dh]\b[^>]*>.*?</t[dh]>"), F.lit(0))
    spans = F.filter(cells, lambda c: c.rlike(rf"(?is)^<t[dh]\b[^>]*\b{attribute}\s*=\s*[\"']?[2-9]"))
    inner = F.transform(spans, lambda c: T.comparable_text(F.regexp_replace(c, r"(?is)^<t[dh]\b[^>]*>|</t[dh]>$", ""), normalize=False))
    return F.exists(inner, lambda t: t.contains(pure.comparable(phrase)))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once, however often they are used; a plain projection would be written into each use."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def evaluated(pairs: DataFrame, *, actual: str = "actual", expected: str = "expected", stamp: str | None = None, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """Adds criteria, metrics and passed to rows of actual and expected Markdown. ``stamp``: a column with the watermark's text."""
    md = F.col(actual)
    rows = _once(pairs, _a=T.comparable_text(md), _e=T.comparable_text(F.col(expected)))
    rows = _once(rows, _cer=T.character_error_rate(F.col("_e"), F.col("_a")))
    wanted = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(pure.comparable(m)).alias("c")) for m in markers))
    stamps = F.filter(F.array(F.lit(STAMP), F.coalesce(F.col(stamp), F.lit("")) if stamp else F.lit("")), lambda s: s != "")
    rows = rows.withColumn("_hit", F.transform(F.filter(wanted, lambda x: F.col("_a").contains(x["c"])), lambda x: x["m"]))
    rows = rows.withColumn("_leaks", F.filter(stamps, lambda s: F.lower("_a").contains(F.lower(T.comparable_text(s, normalize=False)))))
    at = lambda phrase: F.instr(F.col("_a"), pure.comparable(phrase))
    recall = F.size("_hit") / len(markers)
    pages, tables = F.regexp_count(md, F.lit(r"(?i)<!--\s*page:\s*\d+\s*-->")), F.regexp_count(md, F.lit(r"(?i)<table\b"))
    # fixed values: the names of criteria and metrics, and their bounds
    criteria = {
        "twoPages": pages == 2,
        "textCerAtMost25Percent": F.col("_cer") <= 0.25,
        "requiredMarkerRecallAtLeast80Percent": recall >= 0.8,
        "twoTables": tables >= 2,
        "rowspanPreserved": merged_cell_has(md, "rowspan", ROW_CELLS[0]) & merged_cell_has(md, "rowspan", ROW_CELLS[1]),
        "colspanPreserved": merged_cell_has(md, "colspan", COLUMN_CELLS[0]) & merged_cell_has(md, "colspan", COLUMN_CELLS[1]),
        "tableBeforeAdjacentText": (at(TABLE_PHRASE) > 0) & (at(AFTER_PHRASE) > 0) & (at(TABLE_PHRASE) < at(AFTER_PHRASE)),
        "atLeastTwoFigureAssets": F.size(T.image_references(md)) >= 2,
        "watermarkSuppressed": F.size("_leaks") == 0,
    }
    metrics = F.struct(
        F.round("_cer", 4).alias("characterErrorRate"), F.round(recall, 4).alias("requiredMarkerRecall"), F.col("_hit").alias("matchedMarkers"), F.array_except(F.array(*map(F.lit, markers)), F.col("_hit")).alias("missingMarkers"),
        pages.alias("pageCount"), tables.alias("tableCount"), F.size(T.image_references(md)).alias("figureAssetCount"), T.image_references(md).alias("figureAssets"), F.col("_leaks").alias("leakedWatermarks"),
    )
    passed = F.lit(True)
    for c in criteria.values():
        passed = passed & c
    return rows.withColumn("criteria", F.struct(*(c.alias(k) for k, c in criteria.items()))).withColumn("metrics", metrics).withColumn("passed", passed).drop("_a", "_e", "_cer", "_hit", "_leaks")


def report(row: dict) -> dict:
    """One evaluated row as the report that is written: pass, criteria, metrics."""
    return {"pass": row["passed"], "criteria": row["criteria"], "metrics": row["metrics"]}

