"""HTML tables inside Markdown: body text that recognition pulled into a table goes back beside it."""

from __future__ import annotations

import re
from collections import Counter
from typing import Any

from foliospark.functions import pure
from foliospark.operators.lines import in_region, paragraphs, visual_rows
from foliospark.operators.layout import valid

_S = f"[{pure.SPACE}]"
ROW = re.compile(r"<tr\b[^>]*>.*?</tr>", re.I | re.S | re.A)
CELL = re.compile(r"<t[dh]\b([^>]*)>.*?</t[dh]>", re.I | re.S | re.A)
TABLE = re.compile(rf"(<div\b[^>]*>{_S}*<html><body>{_S}*)?(<table\b.*?</table>)({_S}*</body></html>{_S}*</div>)?", re.I | re.S | re.A)
_SPAN = re.compile(rf"\browspan{_S}*={_S}*[\"']?([0-9]+)", re.I | re.A)
_MARKERS = re.compile(rf"(?:^|{_S})[0-9]+\){_S}*")
_SECTION = re.compile(rf"{_S}+(?=[0-9]+(?:\.[0-9]+)+{_S})")
_NUMBER = re.compile(rf"{_S}+(?=[0-9]+\))")
_LEADING = re.compile(rf"(?:^|\n\n)[0-9]{{1,3}}\){_S}*")


def mode(counts: list[int]) -> int:
    """The most frequent number, of equally frequent ones the smallest; 0 of none."""
    return min(Counter(counts).items(), key=lambda x: (-x[1], x[0]))[0] if counts else 0


def adjacent_text(text: str) -> str:
    return pure.strip(_NUMBER.sub("\n\n", _SECTION.sub("\n\n", text)))


def row_span(attributes: str) -> int:
    m = _SPAN.search(attributes)
    return int(m[1]) if m else 1


def repair_table(table: str) -> tuple[str, list[str]]:
    """The table without body text in surplus cells, and that text.

    In a table of three rows or more, a row with one cell more than most rows have, one of which spans three rows or
    more, loses the first cell of 60 characters with two markers. Replacement is literal.
    """
    rows = ROW.findall(table)
    if len(rows) < 3:
        return table, []
    cells = [list(CELL.finditer(r)) for r in rows]
    usual = mode([len(c) for c in cells])
    taken = []
    for row, found in zip(rows, cells, strict=True):
        if len(found) != usual + 1 or not any(row_span(c[1]) >= 3 for c in found):
            continue
        texts = ((c[0], pure.cell_text(c[0])) for c in found)
        hit = next(((c, t) for c, t in texts if pure.units(t) >= 60 and len(_MARKERS.findall(t)) >= 2), None)
        if hit:
            table = table.replace(row, row.replace(hit[0], "", 1), 1)
            taken.append(adjacent_text(hit[1]))
    return table, taken


def body_regions(boxes: list[Any] | None) -> list[list[float]]:
    """Cells that stand out of a page's: 2.5 times the median height, at least 80, and 60 wide."""
    boxes = [b for b in boxes or [] if valid(b)]
    heights = sorted(b[3] - b[1] for b in boxes)
    if not heights:
        return []
    half = len(heights) // 2
    middle = heights[half] if len(heights) % 2 else (heights[half - 1] + heights[half]) / 2
    return [b for b in boxes if b[3] - b[1] >= max(80, 2.5 * middle) and b[2] - b[0] >= 60] if middle else []


def candidates(channels: list[list[dict]], regions: list[list[float]]) -> list[str]:
    """Texts of the lines in each region, from each channel in turn: what the page has beside its tables."""
    return [paragraphs(visual_rows(in_region(lines, r))) for lines in channels for r in regions]


def best_candidate(text: str, found: list[str]) -> str | None:
    """Of the candidates with two markers, 0.65 to 1.5 of the text's length and similarity 0.65, the most similar; of equals the first."""
    size = len(pure.normalized(text))
    if not size:
        return None
    best: tuple[float, str] | None = None
    for c in found:
        if len(_LEADING.findall(c)) >= 2 and 0.65 <= len(pure.normalized(c)) / size <= 1.5:
            s = pure.similarity(text, c)
            if s >= 0.65 and (best is None or s > best[0]):
                best = s, c
    return best and best[1]


def text_beside_tables(markdown: str, channels: list[list[dict]], boxes: list[Any] | None) -> str:
    """Repairs every table; text taken out follows its table, as the page's lines have it where they have it better."""
    if "<" not in markdown:
        return markdown
    found: list[str] | None = None

    def repair(m: re.Match) -> str:
        nonlocal found
        table, taken = repair_table(m[2])
        if not taken:
            return m[0]
        if found is None:
            found = candidates(channels, body_regions(boxes))
        return "\n\n".join([(m[1] or "") + table + (m[3] or ""), *(best_candidate(t, found) or t for t in taken)])

    return TABLE.sub(repair, markdown)
