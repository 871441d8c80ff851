"""The repair of a recognised page's Markdown from its lines, blocks and table cells.

Five steps, each on the text that the one before leaves: blocks, tables, markers, notes, numbered paragraphs.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import pure
from foliospark.functions.values import values
from foliospark.operators.lines import NOTE, Line, aligned, by_top, numbered_paragraphs, scaled_lines, starts, text_of
from foliospark.operators.tables import text_beside_tables

_S = f"[{pure.SPACE}]"
#: Labels of blocks that are not running text.
NOT_TEXT = frozenset(("table", "image", "figure", "chart", "seal", "formula", "number"))
_MARKUP = re.compile(r"<(?:table|img)\b", re.I | re.A)
_MEASURE = re.compile(rf"\b([0-9]{{1,3}}){_S}*(k?V|m?A|W|Hz|%|°C|℃)", re.I | re.A)
_WORD = re.compile(r"\b[A-Za-z]{2,}\b", re.A)
_WHOLE_TABLE = re.compile(r"(<table\b.*?</table>)", re.I | re.S | re.A)
_MARKER = re.compile(r"(^|\n)([\t ]{0,3})([0-9]{1,3})\)[\t ]*")
_LEADING = re.compile(rf"^{_S}*([0-9]{{1,3}})\){_S}*")
_ANY_NUMBER = re.compile(rf"\b([0-9]{{1,3}}){_S}*\\?\)", re.A)


def eligible(block: dict) -> bool:
    """Blocks of running text: with a box, of no special label, and without table or image markup."""
    box, content = block.get("bbox"), block.get("content")
    return block.get("label") not in NOT_TEXT and isinstance(content, str) and isinstance(box, (list, tuple)) and len(box) == 4 and not ("<" in content and _MARKUP.search(content))


def by_middle(lines: list[Line]) -> tuple[list[float], list[tuple[float, tuple[float, float, int], Line]]]:
    """Heights of the lines' centers in ascending order, and of each line there the center's x, its place from top to bottom and itself."""
    found = []
    for i, x in enumerate(lines):
        b = x.get("box")
        if isinstance(b, (list, tuple)) and len(b) == 4 and (y := (b[1] + b[3]) / 2) == y:
            found.append((y, (b[0] + b[2]) / 2, (b[1], b[0], i), x))
    found.sort(key=lambda f: f[0])
    return [f[0] for f in found], [f[1:] for f in found]


def lines_in_block(lines: tuple[list[float], list[tuple[float, tuple[float, float, int], Line]]], box: list[float], slack: float = 4) -> str:
    """The text of lines (of :func:`by_middle`) with their center in the block, read from top to bottom."""
    heights, rest = lines
    if not heights:
        return ""
    near = rest[bisect_left(heights, box[1] - slack) : bisect_right(heights, box[3] + slack)]
    found = [(top, x) for middle, top, x in near if box[0] - slack <= middle <= box[2] + slack]
    found.sort(key=lambda f: f[0])
    return " ".join(filter(None, (text_of(x) for _, x in found)))


def choose(primary: str, fallback: str) -> str:
    """The primary reading, with measurements as the fallback reads them if the two are alike and have as many."""
    if not primary or not fallback:
        return primary or fallback
    a, b = pure.normalized(primary), pure.normalized(fallback)
    if len(b) < 0.75 * len(a) or not pure.similar(a, b, 0.72):
        return primary
    mine, theirs = list(_MEASURE.finditer(primary)), list(_MEASURE.finditer(fallback))
    if len(mine) != len(theirs):
        return primary
    out, at = [], 0
    for m, t in zip(mine, theirs, strict=True):
        if t[2].lower() == m[2].lower():
            out += primary[at : m.start()], t[0]
            at = m.end()
    return "".join([*out, primary[at:]])


def agree(source: str, primary: str, fallback: str) -> str:
    """The source with Latin words corrected by one letter to words that both readings have."""
    if not primary or not fallback:
        return source
    theirs = {w.lower() for w in _WORD.findall(fallback)}
    shared = [(w, low) for w in dict.fromkeys(_WORD.findall(primary)) if (low := w.lower()) in theirs]

    def correct(m: re.Match) -> str:
        word, size = m[0].lower(), len(m[0])
        return next((w for w, low in shared if size <= len(w) <= size + 1 and pure.one_apart(word, low)), m[0])

    return _WORD.sub(correct, source) if shared else source


def replacement(source: str, primary: str, fallback: str) -> str | None:
    """What to write instead of a block's text; None to leave it."""
    if not fallback and primary in ("", source):  # nothing else is said
        return None
    short, number = pure.normalized(source), pure.number_of(primary)
    note = bool(NOTE.match(source))
    if note or len(short) < 12 or (number is not None and number != pure.number_of(source)):
        new = fallback if note and fallback else choose(primary, fallback)
    else:
        new = agree(source, primary, fallback)
    kept = pure.normalized(new)
    return new if len(kept) >= max(4, 0.45 * len(short)) and kept != short else None


def repair_blocks(markdown: str, primary: list[Line], fallback: list[Line], blocks: list[dict] | None) -> str:
    """Each block's text, where the page still has it, is replaced by what the lines inside the block say."""
    text_blocks = [b for b in blocks or [] if eligible(b)]
    if not text_blocks:
        return markdown
    begun = starts(text_blocks)
    channels = [by_middle(aligned(lines, begun)) for lines in (primary, fallback)]
    for b in text_blocks:
        source = pure.strip(b["content"])
        if source and source in markdown:
            new = replacement(source, *(lines_in_block(lines, b["bbox"]) for lines in channels))
            if new is not None:
                markdown = markdown.replace(source, new, 1)
    return markdown


def escape_markers(markdown: str) -> str:
    """``1)`` at the start of a line outside tables becomes ``1\\) ``, so that Markdown does not renumber it."""
    if ")" not in markdown:
        return markdown
    return "".join(part if i % 2 else _MARKER.sub(r"\1\2\3\\) ", part) for i, part in enumerate(_WHOLE_TABLE.split(markdown)))


@functools.lru_cache(1000)
def _marked(number: int) -> re.Pattern:
    return re.compile(rf"(?:\n|{pure.LINE_START})[\t ]{{0,3}}{number}{_S}*\\?\)[\t ]*")


def marker_place(markdown: str, number: int) -> int:
    m = _marked(number).search(markdown)
    return m.start() if m else -1


def add_notes(markdown: str, lines: list[Line]) -> str:
    """Notes that the text lacks go before the first of the lines after them that it has."""
    if not any(NOTE.match(text_of(x)) for x in lines):
        return markdown
    found = sorted((x for x in lines if text_of(x) and isinstance(x.get("box"), (list, tuple))), key=by_top)
    texts = [text_of(x) for x in found]
    begun = [pure.start_of(t, 12) for t in texts]
    plain = pure.normalized(markdown)
    for i, note in enumerate(texts):
        if NOTE.match(note) and (begun[i] is None or begun[i] not in plain):
            k = next((k for t in begun[i + 1 :] if t is not None and (k := plain.find(t)) >= 0), -1)
            if k >= 0:
                at = pure.place_of(markdown, k)
                markdown = f"{markdown[:at]}{note}\n\n{markdown[at:]}"
                plain = plain[:k] + pure.normalized(note) + plain[k:]
    return markdown


def add_numbered(markdown: str, lines: list[Line]) -> str:
    """Numbered paragraphs that the text lacks go before the next number that begins a line of it, else to its end."""
    numbered = numbered_paragraphs(lines)
    present = {int(n) for n in _ANY_NUMBER.findall(markdown)} if numbered else set()
    for number, text in numbered:
        if number in present:
            continue
        text = _LEADING.sub(r"\1\\) ", text)
        at = next((p for p in (marker_place(markdown, n) for n in sorted(present) if n > number) if p >= 0), -1)
        markdown = f"{markdown[:at]}{text}\n\n{markdown[at:]}" if at >= 0 else f"{markdown.rstrip(pure._STRIP)}\n\n{text}"
        present.add(number)
    return markdown


def repair(markdown: str, raw_lines: list[Line] | None = None, fallback_lines: list[Line] | None = None, structure_blocks: list[dict] | None = None, table_cell_boxes: list[Any] | None = None, raw_scale: float | None = 1, fallback_scale: float | None = 1) -> str:
    raw, fallback = scaled_lines(raw_lines, raw_scale), scaled_lines(fallback_lines, fallback_scale)
    if structure_blocks:
        boxed = [[x for x in lines if isinstance(x.get("text"), str) and isinstance(x.get("box"), (list, tuple)) and len(x["box"]) == 4] for lines in (raw, fallback)]
        markdown = repair_blocks(markdown, *boxed, structure_blocks)
    markdown = text_beside_tables(markdown, [raw, fallback], table_cell_boxes)
    return add_numbered(add_notes(escape_markers(markdown), raw), raw)


def _repairing(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for batch in columns:
        yield pa.array([None if row[0] is None else repair(*row) for row in zip(*map(values, batch), strict=True)], pa.string())


def repaired(markdown: Column, raw_lines: Column, fallback_lines: Column, structure_blocks: Column, table_cell_boxes: Column, raw_scale: Column, fallback_scale: Column) -> Column:
    """:func:`repair` of a recognised page; a row is a page, so the fold over its text stays in one vectorised UDF."""
    run = F.arrow_udf(_repairing, "string")
    return run(markdown, raw_lines, fallback_lines, structure_blocks, table_cell_boxes, raw_scale, fallback_scale)
