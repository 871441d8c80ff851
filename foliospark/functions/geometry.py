"""Boxes (x0, y0, x1, y1) as Column expressions, and the spatial join of lines with regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from foliospark.operators.spatial import points_in_rectangles


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_box(box: Column) -> Column:
    return F.coalesce((F.size(box) == 4) & F.forall(box, finite), F.lit(False))


def valid_box(box: Column) -> Column:
    """Four finite numbers that enclose something."""
    return F.coalesce(finite_box(box) & (box[2] > box[0]) & (box[3] > box[1]), F.lit(False))


def checked_box(box: Column) -> Column:
    """An error where the box is not valid, else null."""
    return F.when(~valid_box(box), F.struct(F.lit("OCR_INVALID_BLOCK").alias("code"), F.concat(F.lit("not a box: "), F.coalesce(F.to_json(box), F.lit("null"))).alias("message")))


def center_x(box: Column) -> Column:
    return (box[0] + box[2]) / 2


def center_y(box: Column) -> Column:
    return (box[1] + box[3]) / 2


def height(box: Column) -> Column:
    return box[3] - box[1]


def width(box: Column) -> Column:
    return box[2] - box[0]


def scaled(box: Column, scale: Column) -> Column:
    """All coordinates divided by a scale that is a number above 0, else left."""
    by = F.when(finite(scale) & (scale > 0), scale).otherwise(F.lit(1.0))
    return F.transform(box, lambda c: c / by)


def vertical_overlap(a: Column, b: Column) -> Column:
    """Shared height over the lower of the two heights."""
    return F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1])) / F.least(height(a), height(b))


def widened(region: Column, left: float, right: float, above: float, below: float) -> tuple[Column, Column, Column, Column]:
    return region[0] - left, region[1] - above, region[2] + right, region[3] + below


def tall_regions(cells: DataFrame, page: list[str], box: str = "box") -> DataFrame:
    """Cells of a page that stand out: 2.5 times the median height, at least 80, and 60 wide."""
    b = F.col(box)
    found = cells.where(valid_box(b)).withColumn("_median", F.median(height(b)).over(Window.partitionBy(*page)))
    return found.where((height(b) >= F.greatest(F.lit(80.0), 2.5 * F.col("_median"))) & (width(b) >= 60)).drop("_median")


def lines_in_regions(lines: DataFrame, regions: DataFrame, page: list[str], *, box: str = "box", region: str = "region", tested: Observation | None = None) -> DataFrame:
    """Lines with a text and a box whose center is in a table region of their page, a little widened."""
    text = lines.where(valid_box(F.col(box)) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return _held(text, regions, page, box, widened(F.col(region), 8, 8, 12, 24), tested)


def lines_in_blocks(lines: DataFrame, blocks: DataFrame, page: list[str], *, box: str = "box", block: str = "block", tolerance: float = 4, tested: Observation | None = None) -> DataFrame:
    """Lines whose box has its center in a block of their page, or within ``tolerance`` of it."""
    return _held(lines.where(F.size(box) == 4), blocks, page, box, widened(F.col(block), tolerance, tolerance, tolerance, tolerance), tested)


def _held(lines: DataFrame, rectangles: DataFrame, page: list[str], box: str, sides: tuple[Column, Column, Column, Column], tested: Observation | None) -> DataFrame:
    return points_in_rectangles(lines, rectangles, page, (center_x(F.col(box)), center_y(F.col(box))), sides, tested)


def interpolated(y: Column, y0: Column, y1: Column, to0: Column, to1: Column) -> Column:
    """y taken from [y0, y1] to [to0, to1]; a shift where the interval is a point."""
    span = y1 - y0
    return F.when(F.abs(span) < 0.001, y + to0 - y0).otherwise(to0 + (y - y0) / span * (to1 - to0))
