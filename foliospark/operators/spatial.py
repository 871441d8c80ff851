"""Points in rectangles by a grid of many levels: an index that is partitioned by an equi-join, in place of all pairs of a page.

A rectangle belongs to the level whose cells are as wide and as high as the next powers of two of its own sides, so it
touches at most three by three cells, whatever its size. A point is in one cell of each level that its page has, and levels
are as few as there are orders of size. A pair meets once: in the point's cell of the rectangle's level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

_KEYS = ["_wide", "_high", "_column", "_row"]


def _level(side: Column) -> Column:
    return F.ceil(F.log2(F.greatest(side, F.lit(1e-300)))).cast("int")


def _cell(at: Column, level: Column) -> Column:
    """The number of the cell that holds a coordinate. It never falls where the coordinate rises, so no rounding parts a pair."""
    return F.floor(at / F.pow(F.lit(2.0), level))


def points_in_rectangles(points: DataFrame, rectangles: DataFrame, page: list[str], point: tuple[Column, Column], rectangle: tuple[Column, Column, Column, Column], tested: Observation | None = None) -> DataFrame:
    """Rows of ``points`` joined with those of ``rectangles`` on the same page that hold them, borders included.

    ``point`` is (x, y) of the left side, ``rectangle`` (x0, y0, x1, y1) of the right side. Returns the page's columns,
    then the other ones of either side. Null or non-finite coordinates, rectangles whose ends are swapped and null pages
    join with nothing; repeated rows each count. ``tested`` observes as ``pairs`` how many pairs met in a cell.
    """
    x, y = point
    x0, y0, x1, y1 = rectangle
    real = lambda *c: F.forall(F.array(*c), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rest = {side: [c for c in df.columns if c not in page] for side, df in (("_p", points), ("_r", rectangles))}
    packed = lambda df, side: F.struct(*[F.col(f"`{c}`") for c in rest[side]] or [F.lit(0).alias("_")]).alias(side)
    at = points.select(*page, packed(points, "_p"), x.cast("double").alias("_x"), y.cast("double").alias("_y")).where(real(F.col("_x"), F.col("_y")))
    sides = [c.cast("double").alias(n) for n, c in zip(("_x0", "_y0", "_x1", "_y1"), (x0, y0, x1, y1), strict=True)]
    held = rectangles.select(*page, packed(rectangles, "_r"), *sides).where(real(*(F.col(n) for n in ("_x0", "_y0", "_x1", "_y1"))) & F.expr("_x0 <= _x1 and _y0 <= _y1"))
    held = held.withColumns({"_wide": _level(F.col("_x1") - F.col("_x0")), "_high": _level(F.col("_y1") - F.col("_y0"))})
    levels = held.groupBy(*page).agg(F.collect_set(F.struct("_wide", "_high")).alias("_levels"))
    probes = at.join(levels, page).withColumn("_l", F.explode("_levels")).select(*page, "_p", "_x", "_y", F.col("_l._wide").alias("_wide"), F.col("_l._high").alias("_high"))
    probes = probes.withColumns({"_column": _cell(F.col("_x"), F.col("_wide")), "_row": _cell(F.col("_y"), F.col("_high"))})
    cells = held.withColumn("_column", F.explode(F.sequence(_cell(F.col("_x0"), F.col("_wide")), _cell(F.col("_x1"), F.col("_wide")))))
    cells = cells.withColumn("_row", F.explode(F.sequence(_cell(F.col("_y0"), F.col("_high")), _cell(F.col("_y1"), F.col("_high")))))
    pairs = probes.join(cells, [*page, *_KEYS])
    if tested is not None:
        pairs = pairs.observe(tested, F.count(F.lit(1)).alias("pairs"))
    found = pairs.where(F.col("_x").between(F.col("_x0"), F.col("_x1")) & F.col("_y").between(F.col("_y0"), F.col("_y1")))
    return found.select(*page, *[F.col(f"{side}.`{c}`") for side, columns in rest.items() for c in columns])
