"""Lines of a page: visual rows, paragraphs, numbered paragraphs, and alignment with the structure's coordinates.

Page-level folds, whose next step depends on running values. Rows and numbered paragraphs are expressions over an array of
lines (``rows_of``, ``numbered_of``); the Python forms serve the steps of a page's repair, and are what tests hold them against.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import pure
from foliospark.functions.fold import let, runs, scan
from foliospark.functions.geometry import center_y, finite_box, height, valid_box
from foliospark.functions.text import numbered_marker, strip
from foliospark.operators.layout import valid

_S = f"[{pure.SPACE}]"
_STARTS = re.compile(rf"[0-9]{{1,3}}\)|[0-9]+(?:\.[0-9]+)+(?:{_S}|$)|[0-9]+\.(?![0-9])")
_DIGITS = frozenset("0123456789")
NOTE = re.compile(rf"(?:※{_S}*)?note\b", re.I | re.A)

Line = dict[str, Any]


def middle(line: Line) -> float:
    return (line["box"][1] + line["box"][3]) / 2


def by_top(line: Line) -> tuple[float, float]:
    return line["box"][1], line["box"][0]


def text_of(line: Line) -> str:
    text = line.get("text")
    return pure.strip(text) if isinstance(text, str) else ""


def scaled_lines(lines: list[Line] | None, scale: float | None) -> list[Line]:
    by = scale if isinstance(scale, (int, float)) and math.isfinite(scale) and scale > 0 else 1
    if by == 1:
        return lines or []
    return [{**x, "box": [v / by for v in x["box"]] if isinstance(x.get("box"), (list, tuple)) else x.get("box")} for x in lines or []]


def in_region(lines: list[Line], region: list[float]) -> list[Line]:
    """Lines with their center in a table region, from top to bottom."""
    x0, y0, x1, y1 = region[0] - 8, region[1] - 12, region[2] + 8, region[3] + 24
    found = [x for x in lines if text_of(x) and valid(x.get("box")) and x0 <= (x["box"][0] + x["box"][2]) / 2 <= x1 and y0 <= middle(x) <= y1]
    return sorted(found, key=lambda x: (middle(x), x["box"][0]))


def visual_rows(lines: list[Line]) -> list[str]:
    """Texts of lines that stand side by side, from lines in vertical order.

    A line joins the last row if its center is within 10, or 0.6 of the lower of the two heights, of the row's mean
    center; mean and largest height run along.
    """
    rows: list[list[Line]] = []
    total = tallest = 0.0
    for line in lines:
        y, h = middle(line), line["box"][3] - line["box"][1]
        if rows and abs(y - total / len(rows[-1])) <= max(10.0, 0.6 * min(h, tallest)):
            rows[-1].append(line)
            total, tallest = total + y, max(tallest, h)
        else:
            rows.append([line])
            total, tallest = y, h
    return [" ".join(text_of(x) for x in sorted(row, key=lambda x: x["box"][0])) for row in rows]


def paragraphs(rows: list[str]) -> str:
    """Rows folded into paragraphs; one begins at a marker, a section number, or the first row."""
    out: list[str] = []
    for row in rows:
        if out and not _STARTS.match(row):
            out[-1] += " " + row
        else:
            out.append(row)
    return "\n\n".join(out)


def _finite(box: Any) -> bool:
    if not isinstance(box, (list, tuple)) or len(box) != 4:
        return False
    return all(map(math.isfinite, box)) if set(map(type, box)) == {float} else all(isinstance(v, (int, float)) and math.isfinite(v) for v in box)


def numbered_paragraphs(lines: list[Line] | None) -> list[tuple[int, str]]:
    """(number, text) of paragraphs that begin with a marker; none if the page has fewer than three markers.

    A paragraph takes the lines up to the next marker, ends at a gap of over 90, and leaves out lines that begin over
    100 to the side.
    """
    texts = [(text, x.get("box")) for x in lines or [] if (text := text_of(x))]
    if sum(text[0] in _DIGITS for text, _ in texts) < 3:
        return []
    found = [(text, box) for text, box in texts if _finite(box)]
    found.sort(key=lambda x: (x[1][1], x[1][0]))
    out: list[tuple[int, list[str]]] = []
    left = bottom = 0.0
    ended = True
    for text, box in found:
        number = pure.number_of(text)
        if number is not None:
            out.append((number, [text]))
            left, bottom, ended = box[0], box[3], False
        elif not ended:
            if box[1] - bottom > 90:
                ended = True
            elif abs(box[0] - left) <= 100:
                out[-1][1].append(text)
                bottom = max(bottom, box[3])
    return [(n, " ".join(t)) for n, t in out] if len(out) >= 3 else []


def starts(blocks: list[dict]) -> list[tuple[str | None, float]]:
    """(beginning of the text, top) of blocks from top to bottom."""
    return [(pure.start_of(b["content"]), b["bbox"][1]) for b in sorted(blocks, key=lambda b: (b["bbox"][1], b["bbox"][0]))]


def anchors(lines: list[Line], blocks: list[tuple[str | None, float]]) -> list[tuple[float, float]]:
    """(line's top, block's top) of blocks (of :func:`starts`) and lines that begin alike, matched in order, each line once."""
    wanted = {key for key, _ in blocks if key is not None}
    places: dict[str, list[int]] = {}
    for i, x in enumerate(lines) if wanted else ():
        if (key := pure.start_of(x["text"])) in wanted:
            places.setdefault(key, []).append(i)
    if not places:
        return []
    out, at = [], 0
    for key, top in blocks:
        found = places.get(key, ())
        if (k := bisect_left(found, at)) < len(found):
            out.append((lines[found[k]]["box"][1], top))
            at = found[k] + 1
    return out


def reach(points: list[tuple[float, float]]) -> list[float]:
    """How far down the segments of anchors reach; anchors need not rise, so it is the running maximum of their ends."""
    return list(accumulate((x for x, _ in points[1:]), max, initial=-math.inf))[1:]


def mapped(y: float, points: list[tuple[float, float]], ends: list[float] | None = None) -> float:
    """y carried over by the segment of anchors that holds it, or the nearest one; ``ends``: :func:`reach` of them."""
    if len(points) < 2:
        return y + points[0][1] - points[0][0]
    ends = reach(points) if ends is None else ends
    k = min(bisect_left(ends, y), len(ends) - 1)
    (x0, to0), (x1, to1) = points[k], points[k + 1]
    return y + to0 - x0 if abs(x1 - x0) < 0.001 else to0 + (y - x0) / (x1 - x0) * (to1 - to0)


def aligned(lines: list[Line], blocks: list[tuple[str | None, float]]) -> list[Line]:
    """Lines, from top to bottom, moved vertically to the coordinates of the blocks (:func:`starts` of eligible ones)."""
    if not lines:
        return lines
    lines = sorted(lines, key=by_top)
    points = anchors(lines, blocks)
    if not points:
        return lines
    out, ends = [], reach(points)
    for x in lines:
        x0, y0, x1, y1 = x["box"]
        y = (y0 + y1) / 2
        shift = mapped(y, points, ends) - y
        out.append({**x, "box": [x0, y0 + shift, x1, y1 + shift]})
    return out


def _texts(lines: Column, keep: Callable[[Column], Column]) -> Column:
    """Lines with a text and a box that ``keep`` allows: text stripped, box, and the place among all."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(strip(F.coalesce(x["text"], F.lit(""))).alias("text"), x["box"].alias("box"), i.alias("i"))), lambda x: (x["text"] != "") & keep(x["box"]))


def rows_of(lines: Column) -> Column:
    """The visual rows of a page's lines, from top to bottom, with the rule of :func:`visual_rows`; lines without text or a box are left out."""
    placed = F.transform(_texts(lines, valid_box), lambda x: F.struct(center_y(x["box"]).cast("double").alias("y"), x["box"][0].cast("double").alias("x"), x["i"].alias("i"), height(x["box"]).cast("double").alias("h"), x["text"].alias("text")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("tallest"))

    def begins(s: Column, x: Column) -> Column:
        return (s["n"] == 0) | (F.abs(x["y"] - s["total"] / F.greatest(s["n"], F.lit(1))) > F.greatest(F.lit(10.0), 0.6 * F.least(x["h"], s["tallest"])))

    def after(s: Column, x: Column) -> Column:
        return let(begins(s, x), lambda new: F.struct(F.when(new, 1).otherwise(s["n"] + 1).alias("n"), F.when(new, x["y"]).otherwise(s["total"] + x["y"]).alias("total"), F.when(new, x["h"]).otherwise(F.greatest(s["tallest"], x["h"])).alias("tallest")))

    def rows(sorted_lines: Column) -> Column:
        beside = lambda row: F.array_sort(F.transform(row, lambda x, k: F.struct(x["x"].alias("x"), k.alias("k"), x["text"].alias("text"))))
        return F.transform(runs(sorted_lines, scan(sorted_lines, start, after, begins, "boolean")), lambda row: F.array_join(F.transform(beside(row), lambda x: x["text"]), " "))

    return F.coalesce(let(F.array_sort(placed), rows), F.array().cast("array<string>"))


def numbered_of(lines: Column) -> Column:
    """Numbered paragraphs of a page's lines, with the rule of :func:`numbered_paragraphs`."""
    placed = F.transform(_texts(lines, finite_box), lambda x: F.struct(x["box"][1].cast("double").alias("y"), x["box"][0].cast("double").alias("x"), x["i"].alias("i"), x["box"][3].cast("double").alias("bottom"), x["text"].alias("text"), numbered_marker(x["text"]).alias("number")))
    start = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("bottom"), F.lit(True).alias("ended"))
    beside = lambda s, x: F.abs(x["x"] - s["left"]) <= 100
    far = lambda s, x: x["y"] - s["bottom"] > 90

    def after(s: Column, x: Column) -> Column:
        begun = F.struct(x["x"].alias("left"), x["bottom"].alias("bottom"), F.lit(False).alias("ended"))
        longer = F.struct(s["left"].alias("left"), F.greatest(s["bottom"], x["bottom"]).alias("bottom"), F.lit(False).alias("ended"))
        over = F.struct(s["left"].alias("left"), s["bottom"].alias("bottom"), F.lit(True).alias("ended"))
        return F.when(x["number"].isNotNull(), begun).when(s["ended"], s).when(far(s, x), over).when(beside(s, x), longer).otherwise(s)

    taken = lambda s, x: x["number"].isNotNull() | (~s["ended"] & ~far(s, x) & beside(s, x))

    def paragraphs_in(sorted_lines: Column) -> Column:
        kept = F.filter(F.arrays_zip(sorted_lines.alias("x"), scan(sorted_lines, start, after, taken, "boolean").alias("taken")), lambda z: z["taken"])
        parts = let(F.transform(kept, lambda z: z["x"]), lambda own: runs(own, F.transform(own, lambda x: x["number"].isNotNull())))
        return F.transform(parts, lambda p: F.struct(p[0]["number"].cast("int").alias("number"), F.array_join(F.transform(p, lambda x: x["text"]), " ").alias("text")))

    none = F.array().cast("array<struct<number: int, text: string>>")
    marks = lambda placed: F.size(F.filter(placed, lambda x: x["number"].isNotNull()))
    return F.coalesce(let(F.array_sort(placed), lambda p: F.when(marks(p) >= 3, paragraphs_in(p)).otherwise(none)), none)
