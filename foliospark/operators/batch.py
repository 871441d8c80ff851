"""Batches: one result a file, totals, and the summary that is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.relational import ordered_concat

# Words of the summary.
TITLE, FOLDER, ALL, DONE, FAILED, OPEN = "# OCR 일괄 처리 요약", "입력 폴더", "전체", "성공", "실패", "열기"
HEADER = "| # | 입력 이미지 | 상태 | Markdown | Manifest | 오류 |\n| ---: | --- | --- | --- | --- | --- |"


def totals(results: DataFrame, *group: str) -> DataFrame:
    return results.groupBy(*group).agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))


def _link(path: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("-")).otherwise(F.concat(F.lit(f"[{OPEN}](<"), T.encode_uri(path), F.lit(">)")))


def summary_row(number: Column) -> Column:
    """A result as a row of the summary's table."""
    problem = F.when(F.col("error").isNull(), F.lit("-")).otherwise(F.concat_ws(": ", "error.code", "error.message"))
    state = F.when(F.col("status") == "succeeded", F.lit(DONE)).otherwise(F.lit(FAILED))
    cells = (number.cast("string"), T.table_cell(F.col("input")), state, _link(F.col("markdown")), _link(F.col("manifest")), T.table_cell(problem))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def summaries(results: DataFrame, group: list[str], number: str = "file_number", folder: str = "input_directory") -> DataFrame:
    """(group, discovered, succeeded, failed, summary): one Markdown summary a batch. ``folder`` is among the group's columns."""
    rows = results.withColumn("_row", summary_row(F.col(number)))
    found = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), ordered_concat(F.col("_row"), "\n", F.col(number)).alias("_rows"))
    count = lambda word, c: F.concat(F.lit(f"- {word}: "), F.col(c).cast("string"))
    head = F.concat_ws("\n", F.lit(TITLE + "\n"), F.concat(F.lit(f"- {FOLDER}: `"), F.col(folder).cast("string"), F.lit("`")), count(ALL, "discovered"), count(DONE, "succeeded"), F.concat(count(FAILED, "failed"), F.lit("\n")), F.lit(HEADER))
    return found.withColumn("summary", F.concat(head, F.lit("\n"), F.col("_rows"), F.lit("\n"))).drop("_rows")
