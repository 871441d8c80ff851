"""Reading order and rendering of layout blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cmp_to_key
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.errors import FolioError, summary
from foliospark.functions import pure
from foliospark.functions.geometry import checked_box

NO_CAPTION = "추출 이미지"  # fixed value: alternative text of figures that have none


def valid(box: Any) -> bool:
    return isinstance(box, (list, tuple)) and len(box) == 4 and all(isinstance(v, (int, float)) and math.isfinite(v) for v in box) and box[2] > box[0] and box[3] > box[1]


def overlap(a: list[float], b: list[float]) -> float:
    return max(0.0, min(a[3], b[3]) - max(a[1], b[1])) / min(a[3] - a[1], b[3] - b[1])


def reading_order(blocks: list[dict], row_overlap: float = 0.3) -> list[dict]:
    """Blocks as they are read.

    Two blocks with a given order keep it. Else blocks that share enough height are in one row, left to right, and
    others go from top to bottom; ties keep the order of input. Sharing a row is not transitive, so what three
    blocks give depends on the sort: it is a stable merge of runs.
    """
    for b in blocks:
        if not valid(b.get("bbox")):
            raise FolioError("OCR_INVALID_BLOCK", f"not a box: {b.get('bbox')}")
    known = [isinstance(b.get("ord"), (int, float)) and math.isfinite(b["ord"]) for b in blocks]

    def before(i: int, j: int) -> float:
        p, q = blocks[i]["bbox"], blocks[j]["bbox"]
        if known[i] and known[j]:
            keys = [(blocks[i]["ord"], blocks[j]["ord"])]
        else:
            row = [(p[0], q[0])] if overlap(p, q) >= row_overlap else []
            keys = [*row, (p[1], q[1]), (p[0], q[0])]
        return next((a - b for a, b in keys if a != b), i - j)

    return [blocks[i] for i in sorted(range(len(blocks)), key=cmp_to_key(before))]


def block_markdown(block: dict) -> str:
    if block.get("markdown"):
        return pure.strip(block["markdown"])
    if block.get("type") == "figure" and block.get("asset_path"):
        return f"![{pure.strip(block.get('alt') or '') or NO_CAPTION}]({block['asset_path']})"
    return pure.strip(block.get("content") or "")


def render(blocks: list[dict] | None, row_overlap: float = 0.3) -> str:
    return "\n\n".join(filter(None, map(block_markdown, reading_order(blocks or [], row_overlap))))


def _orders(boxes: np.ndarray, given: np.ndarray, page: np.ndarray, pages: int, row_overlap: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """(blocks in the order of their pages and in reading order, whether a page's order is certain), of all blocks of a batch at once.

    It is where all blocks have a given order, or none has one and rows are apart: none shares any height with another row,
    and what all blocks of a row share is enough for any two. :func:`reading_order` has the rest.
    """
    x0, y0, x1, y1 = boxes.T
    known = np.isfinite(given)
    sound = np.isfinite(boxes).all(1) & (x1 > x0) & (y1 > y0)
    count = lambda of: np.bincount(page[of], minlength=pages)
    some = count(known)
    every = some == np.bincount(page, minlength=pages)
    certain = (every | (some == 0)) & (count(~sound) == 0)
    rank = np.where(every[page], given, 0.0)
    loose = np.flatnonzero((certain & ~every)[page])
    if len(loose):
        down = loose[np.lexsort((y0[loose], page[loose]))]
        first = np.ones(len(down), bool)
        first[1:] = (page[down][1:] != page[down][:-1]) | (y0[down][1:] >= y1[down][:-1])
        at = np.flatnonzero(first)
        own = page[down][at]
        low, high = np.minimum.reduceat(y1[down], at), np.maximum.reduceat(y1[down], at)
        shared = low - np.maximum.reduceat(y0[down], at)
        bad = shared < row_overlap * (1 + 1e-9) * np.maximum.reduceat((y1 - y0)[down], at)
        bad[:-1] |= (own[1:] == own[:-1]) & (y0[down][at[1:]] < high[:-1])
        certain[own[bad]] = False
        rank[down] = np.cumsum(first)
    beside = ~every[page]
    places = (np.where(beside, y0, 0.0), np.where(beside, x0, 0.0)) if beside.any() else ()
    return np.lexsort((*places, rank, page)), certain


def _boxes(column: pa.Array) -> np.ndarray:
    """Four numbers a block; not numbers where a box has not four."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    four = (np.diff(ends) == 4) & column.is_valid().to_numpy(zero_copy_only=False)
    if len(four) and four.all():
        return flat[ends[0] : ends[-1]].astype(float).reshape(-1, 4)
    boxes = np.full((len(column), 4), math.nan)
    boxes[four] = flat[ends[:-1][four][:, None] + np.arange(4)]
    return boxes


def _texts(blocks: pa.Array) -> pa.Array:
    """:func:`block_markdown` of all blocks of a batch at once."""
    markdown, alt, path, content = (pc.fill_null(blocks.field(f).cast(pa.string()), "") for f in ("markdown", "alt", "asset_path", "content"))
    strip = lambda c: pc.utf8_trim(c, characters=pure._STRIP)
    alt = strip(alt)
    figure = pc.binary_join_element_wise("![", pc.if_else(pc.equal(alt, ""), NO_CAPTION, alt), "](", path, ")", "")
    shown = pc.and_(pc.fill_null(pc.equal(blocks.field("type"), "figure"), False), pc.not_equal(path, ""))
    return pc.if_else(pc.not_equal(markdown, ""), strip(markdown), pc.if_else(shown, figure, strip(content)))


def _rendered(column: pa.Array) -> pa.Array:
    """:func:`render` of each page of a batch."""
    ends = column.offsets.to_numpy() if len(column) else np.zeros(1, np.int32)
    pages, blocks = len(column), column.values.slice(ends[0], ends[-1] - ends[0])
    ends = ends - ends[0]
    given = blocks.field("ord").to_numpy(zero_copy_only=False).astype(float)
    order, certain = _orders(_boxes(blocks.field("bbox")), given, np.repeat(np.arange(pages), np.diff(ends)), pages)
    texts = _texts(blocks).take(pa.array(order))
    said = pc.not_equal(texts, "")
    before = np.concatenate([[0], np.cumsum(said.to_numpy(zero_copy_only=False))]).astype(np.int32)
    out = pc.binary_join(pa.ListArray.from_arrays(pa.array(before[ends]), texts.filter(said)), "\n\n")
    kind = pa.struct([("code", pa.string()), ("message", pa.string())])
    certain &= column.is_valid().to_numpy(zero_copy_only=False)
    if certain.all():
        return pa.StructArray.from_arrays([out, pa.nulls(pages, kind)], ["markdown", "error"])
    alone: list[str | None] = []
    errors: list[dict | None] = [None] * pages
    for i in np.flatnonzero(~certain).tolist():
        try:
            alone.append(render(column[i].as_py()))
        except FolioError as error:
            alone.append(None)
            errors[i] = summary(error)
    out = pc.replace_with_mask(out, pa.array(~certain), pa.array(alone, pa.string()))
    return pa.StructArray.from_arrays([out, pa.array(errors, kind)], ["markdown", "error"])


def rendered(blocks: Column) -> Column:
    """An array of layout blocks to a struct of Markdown and error; the order is found in a vectorised UDF."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(_rendered, columns)

    return F.arrow_udf(run, "markdown string, error struct<code: string, message: string>")(blocks)


def markdown_of(block: Column) -> Column:
    """One block as Markdown, as an expression."""
    from foliospark.functions.text import strip

    alt = strip(F.coalesce(block["alt"], F.lit("")))
    figure = F.concat(F.lit("!["), F.when(alt == "", F.lit(NO_CAPTION)).otherwise(alt), F.lit("]("), block["asset_path"], F.lit(")"))
    return (F.when(F.coalesce(block["markdown"], F.lit("")) != "", strip(block["markdown"]))
            .when((block["type"] == "figure") & (F.coalesce(block["asset_path"], F.lit("")) != ""), figure).otherwise(strip(F.coalesce(block["content"], F.lit("")))))


def block_error(blocks: Column) -> Column:
    """The first error of an array of blocks, null if all boxes are valid."""
    return F.get(F.filter(F.transform(blocks, lambda b: checked_box(b["bbox"])), lambda e: e.isNotNull()), 0)


def effective_layout(layout: str, ratio: float | None, source: Column, width: Column, height: Column) -> Column:
    """single or two-up: what was asked for, else two-up for a given ratio, else the source's own, else by shape."""
    if layout != "auto":
        return F.lit(layout)
    if ratio is not None:
        return F.lit("two-up")
    return F.coalesce(source, F.when(width <= height, F.lit("single")).otherwise(F.lit("two-up")))


def side_label(layout: Column, side: Column) -> Column:
    return F.when(layout == "single", F.lit("single")).otherwise(F.when(side == 0, F.lit("left")).otherwise(F.lit("right")))
