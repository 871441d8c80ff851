"""``python -m foliospark.fixtures FOLDER``: a synthetic scan of two pages, with and without a watermark, and what it says.

One description of shapes gives the drawing (SVG) and the pixels. There is no font here, so text is drawn as bars of its
length: enough for cutting, watermark suppression and file formats; recognition needs a rasteriser for the SVG.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import os
import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from xml.sax.saxutils import escape

import numpy as np

from foliospark.operators.evaluate import MARKERS
from foliospark.operators.raster import encode_png

# Sizes of the acceptance scan in pixels at 300 dpi, and where and how its watermark stands.
PAGE, GUTTER, HEIGHT = 2480, 120, 3508
WIDTH = 2 * PAGE + GUTTER
STAMPS, STAMP_TONE, STAMP_OPACITY = ((470, -7), (3100, 7)), 0x70, 0.28
GUTTER_TONE = (0xF2, 0xF4, 0xF7)


@dataclass
class Box:
    x: float
    y: float
    width: float
    height: float
    fill: tuple[int, int, int] | None = None
    line: int = 0

    def svg(self) -> str:
        fill = "none" if self.fill is None else "#%02x%02x%02x" % self.fill
        return f'<rect x="{self.x:g}" y="{self.y:g}" width="{self.width:g}" height="{self.height:g}" fill="{fill}"' + (f' stroke="#222222" stroke-width="{self.line}"' if self.line else "") + "/>"

    def draw(self, image: np.ndarray, scale: float) -> None:
        x0, y0, x1, y1 = (round(v * scale) for v in (self.x, self.y, self.x + self.width, self.y + self.height))
        if self.fill is not None:
            image[y0:y1, x0:x1] = self.fill
        if self.line:
            w = max(1, round(self.line * scale))
            for part in (image[y0 : y0 + w, x0:x1], image[y1 - w : y1, x0:x1], image[y0:y1, x0 : x0 + w], image[y0:y1, x1 - w : x1]):
                part[:] = 0x22


@dataclass
class Text:
    """A line of text that begins at x on the base line y; turned by an angle about that place."""

    x: float
    y: float
    text: str
    size: float = 40
    tone: int = 0x18
    opacity: float = 1.0
    angle: float = 0.0

    def svg(self) -> str:
        turn = f' transform="rotate({self.angle:g} {self.x:g} {self.y:g})"' if self.angle else ""
        return f'<text x="{self.x:g}" y="{self.y:g}" font-size="{self.size:g}" fill="#{self.tone:02x}{self.tone:02x}{self.tone:02x}" opacity="{self.opacity:g}"{turn}>{escape(self.text)}</text>'

    def draw(self, image: np.ndarray, scale: float) -> None:
        """A bar for each letter; spaces are left out."""
        slope, step = math.tan(math.radians(self.angle)), 0.55 * self.size
        for i, letter in enumerate(self.text):
            if letter == " ":
                continue
            x, y = self.x + i * step, self.y + i * step * slope
            x0, x1, y0, y1 = (round(v * scale) for v in (x, x + 0.6 * step, y - 0.7 * self.size, y))
            part = image[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]
            part[:] = np.floor(part * (1 - self.opacity) + self.tone * self.opacity + 0.5)


@dataclass
class Drawing:
    """Shapes from back to front."""

    shapes: list[Box | Text] = field(default_factory=list)

    def paragraph(self, x: float, y: float, rows: list[str], size: float = 40) -> float:
        for i, row in enumerate(rows):
            self.shapes.append(Text(x, y + i * size * 1.6, row, size))
        return y + len(rows) * size * 1.6

    def table(self, x: float, y: float, widths: list[int], cells: list[tuple[int, int, int, int, str]], height: int = 90) -> None:
        """Cells as (column, row, columns, rows, text)."""
        left = [sum(widths[:i]) for i in range(len(widths) + 1)]
        for column, row, across, down, text in cells:
            self.shapes.append(Box(x + left[column], y + row * height, left[column + across] - left[column], down * height, (255, 255, 255), 3))
            self.shapes.append(Text(x + left[column] + 20, y + row * height + 60, text, 36))

    def chart(self, x: float, y: float, values: list[int]) -> None:
        for i, v in enumerate(values):
            self.shapes.append(Box(x + i * 160, y + 400 - v, 110, v, (60, 110, 180)))
        self.shapes.append(Box(x - 20, y + 400, len(values) * 160 + 20, 6, (34, 34, 34)))

    def flow(self, x: float, y: float, steps: list[str]) -> None:
        for i, step in enumerate(steps):
            self.shapes += [Box(x + i * 520, y, 400, 150, (230, 238, 248), 3), Text(x + i * 520 + 30, y + 90, step, 36)]
            if i:
                self.shapes.append(Box(x + i * 520 - 120, y + 72, 120, 6, (34, 34, 34)))

    def svg(self) -> str:
        body = "\n".join(s.svg() for s in self.shapes)
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" viewBox="0 0 {WIDTH} {HEIGHT}">\n<rect width="100%" height="100%" fill="#ffffff"/>\n{body}\n</svg>\n'

    def pixels(self, scale: float = 1.0) -> np.ndarray:
        image = np.full((round(HEIGHT * scale), round(WIDTH * scale), 3), 255, np.uint8)
        for s in self.shapes:
            s.draw(image, scale)
        return image


TITLE, NUMBER, ROW, OTHER, NOTE, HEADING, TABLE, MERGED, SCAN, AFTER, BESIDE = MARKERS
WORDS = ["All readings were taken at rest and at full load.", "Values in grey are those of the month before.", "Cells that span rows belong to every row beside them."]


def left_page(d: Drawing, x: float) -> None:
    d.paragraph(x + 200, 760, [TITLE, NUMBER], 64)
    d.table(x + 200, 1000, [500, 500, 500], [(0, 0, 2, 1, "검사 구분"), (2, 0, 1, 1, "OK"), (0, 1, 1, 2, ROW), (1, 1, 1, 1, "12"), (2, 1, 1, 1, "yes"), (1, 2, 1, 1, "15"), (2, 2, 1, 1, "yes"), (0, 3, 1, 1, OTHER), (1, 3, 1, 1, "9"), (2, 3, 1, 1, "no")])
    d.paragraph(x + 200, 1520, [NOTE, *WORDS])
    d.flow(x + 200, 2000, ["draw", "read", "compare", "file"])


def right_page(d: Drawing, x: float) -> None:
    d.paragraph(x + 200, 760, [HEADING], 64)
    d.table(x + 200, 900, [400, 400, 400], [(0, 0, 3, 1, TABLE), (0, 1, 1, 2, MERGED), (1, 1, 1, 1, SCAN), (2, 1, 1, 1, "3"), (1, 2, 1, 1, "sum"), (2, 2, 1, 1, "7")])
    d.paragraph(x + 1500, 960, [BESIDE])
    d.paragraph(x + 200, 1400, [AFTER, *WORDS])
    d.chart(x + 250, 1900, [120, 260, 180, 340, 300])


def stamps(d: Drawing, x: float, text: str) -> None:
    for y, angle in STAMPS:
        d.shapes.append(Text(x + 250, y, text, 70, STAMP_TONE, STAMP_OPACITY, angle))


def drawing(stamp: str | None = None) -> Drawing:
    """Both pages with the gutter between them, stamped if there is a text for it."""
    d = Drawing([Box(PAGE, 0, GUTTER, HEIGHT, GUTTER_TONE)])
    for x, page in ((0, left_page), (PAGE + GUTTER, right_page)):
        page(d, x)
        if stamp:
            stamps(d, x, stamp)
    return d


def expected_markdown() -> str:
    tables = [
        f'<table><tr><td colspan="2">검사 구분</td><td>OK</td></tr><tr><td rowspan="2">{ROW}</td><td>12</td><td>yes</td></tr><tr><td>15</td><td>yes</td></tr><tr><td>{OTHER}</td><td>9</td><td>no</td></tr></table>',
        f'<table><tr><td colspan="3">{TABLE}</td></tr><tr><td rowspan="2">{MERGED}</td><td>{SCAN}</td><td>3</td></tr><tr><td>sum</td><td>7</td></tr></table>',
    ]
    pages = [[f"# {TITLE}", NUMBER, tables[0], NOTE, *WORDS, "![flow](assets/page-0001/flow.png)"], [f"# {HEADING}", tables[1], BESIDE, f"## {AFTER}", *WORDS, "![chart](assets/page-0002/chart.png)"]]
    return "\n\n---\n\n".join("\n\n".join([f"<!-- page: {i} -->", *p]) for i, p in enumerate(pages, 1)) + "\n"


_OFFICE = "http://schemas.openxmlformats.org"
_KINDS = f"{_OFFICE}/officeDocument/2006/relationships"


def build_docx(png: bytes) -> bytes:
    """A word-processor file that shows one scan."""
    links = lambda *found: f'<Relationships xmlns="{_OFFICE}/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{_KINDS}/{kind}" Target="{to}"/>' for i, kind, to in found) + "</Relationships>"
    kinds = "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in (("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml"), ("png", "image/png")))
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_OFFICE}/package/2006/content-types">{kinds}<Override PartName="/word/document.xml" ContentType="{main}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{main}.styles+xml"/></Types>',
        "_rels/.rels": links(("rId1", "officeDocument", "word/document.xml"), ("rId2", "extended-properties", "docProps/app.xml")),
        "docProps/app.xml": f'<Properties xmlns="{_OFFICE}/officeDocument/2006/extended-properties"/>',
        "word/document.xml": f'<w:document xmlns:w="{_OFFICE}/wordprocessingml/2006/main" xmlns:r="{_KINDS}" xmlns:a="{_OFFICE}/drawingml/2006/main"><w:body><w:p><w:r><w:drawing><a:blip r:embed="rId1"/></w:drawing></w:r></w:p></w:body></w:document>',
        "word/_rels/document.xml.rels": links(("rId1", "image", "media/scan.png"), ("rId2", "styles", "styles.xml")),
        "word/styles.xml": f'<w:styles xmlns:w="{_OFFICE}/wordprocessingml/2006/main"/>',
        "word/media/scan.png": png,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def stamp_text(at: datetime) -> str:
    """What is stamped on a page: that it is a sample, and when, in Korean time."""
    return f"SAMPLE {at.astimezone(timezone(timedelta(hours=9))):%Y-%m-%d %H:%M:%S} KST"


def files(stamp: str, scale: float = 1.0) -> Iterator[tuple[str, bytes]]:
    """(name, content) of each file; equal arguments, equal bytes."""
    made = {}
    for name, text in (("clean", None), ("watermarked", stamp)):
        d = drawing(text)
        made[f"two-up-{name}.svg"] = d.svg().encode()
        made[f"two-up-{name}.png"] = encode_png(d.pixels(scale))
    made["two-up-watermarked.docx"] = build_docx(made["two-up-watermarked.png"])
    made["expected.md"] = expected_markdown().encode()
    about = {"schemaVersion": 1, "width": round(WIDTH * scale), "height": round(HEIGHT * scale), "gutter": {"left": round(PAGE * scale), "width": round(GUTTER * scale)}, "watermark": {"text": stamp, "placements": [{"y": y, "angle": a} for y, a in STAMPS]}, "files": {n: hashlib.sha256(c).hexdigest() for n, c in made.items()}}
    made["fixture-manifest.json"] = (json.dumps(about, indent=2, ensure_ascii=False) + "\n").encode()
    yield from made.items()


def generate(folder: str, at: datetime, scale: float = 1.0) -> list[str]:
    os.makedirs(folder, exist_ok=True)
    paths = []
    for name, content in files(stamp_text(at), scale):
        paths.append(os.path.join(folder, name))
        with open(paths[-1], "wb") as file:
            file.write(content)
    return paths


if __name__ == "__main__":
    print("\n".join(generate(sys.argv[1], datetime.now(timezone.utc))))
