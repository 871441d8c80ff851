"""What recognisers leave beside a page: JSON of text lines and structure, Markdown, and the images it shows."""

from __future__ import annotations

import json
import math
import os
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.errors import FolioError
from foliospark.functions import geometry as G
from foliospark.schemas import BLOCK, BOX, LINE

_OCR = "STRUCT<rec_texts: ARRAY<STRING>, rec_boxes: ARRAY<ARRAY<DOUBLE>>, rec_scores: ARRAY<DOUBLE>>"
_READINGS = f"overall_ocr_res: {_OCR}, fallback_ocr_res: {_OCR}"
_PART = f"{_READINGS}, parsing_res_list: ARRAY<STRUCT<block_label: STRING, block_content: STRING, block_bbox: ARRAY<DOUBLE>>>, table_res_list: ARRAY<STRUCT<cell_box_list: ARRAY<ARRAY<DOUBLE>>>>"
JSON = f"STRUCT<res: STRUCT<{_PART}>, {_PART}>"
RAW = "raw_ocr.json"


def zipped_lines(ocr: Column) -> Column:
    """The parallel arrays of one reading as lines; those without text or a box of four numbers drop out."""
    rows = F.transform(ocr["rec_texts"], lambda t, i: F.struct(t.alias("text"), F.get(ocr["rec_boxes"], i).alias("box"), F.get(ocr["rec_scores"], i).alias("score")))
    kept = F.filter(rows, lambda x: x["text"].isNotNull() & G.finite_box(x["box"]))
    return F.when(ocr["rec_boxes"].isNotNull(), kept).otherwise(F.lit(None)).cast(f"ARRAY<{LINE}>")


def parsed(files: DataFrame) -> DataFrame:
    """Adds j to (.., json): its fields, whether or not they are inside ``res``; null where the text is not JSON."""
    j = F.from_json("json", JSON)
    fields = [c.split(":")[0].strip() for c in ("overall_ocr_res:", "fallback_ocr_res:", "parsing_res_list:", "table_res_list:")]
    return files.withColumn("_j", j).withColumn("j", F.struct(*(F.coalesce(F.col(f"_j.res.{f}"), F.col(f"_j.{f}")).alias(f) for f in fields))).drop("_j")


def text_lines(files: DataFrame, page: list[str]) -> DataFrame:
    """(page, raw_lines, fallback_lines): per page the first file with a line, ``raw_ocr.json`` before others, then in walk order.

    ``files``: (page, walk_index, name, json).
    """
    j = F.from_json("json", f"STRUCT<res: STRUCT<{_READINGS}>, {_READINGS}>")
    both = lambda j: [F.coalesce(j["res"][f], j[f]) for f in ("overall_ocr_res", "fallback_ocr_res")]
    lines = lambda raw, fallback: F.struct(zipped_lines(raw).alias("raw_lines"), F.coalesce(zipped_lines(fallback), F.array().cast(f"ARRAY<{LINE}>")).alias("fallback_lines"))
    # a generator, as a filter on columns beside it would parse each file again
    kept = F.inline(F.filter(F.transform(F.array(j), lambda j: lines(*both(j))), lambda r: F.size(r["raw_lines"]) > 0))
    rows = files.select(*page, "walk_index", "name", kept)
    first = F.row_number().over(Window.partitionBy(*page).orderBy((F.lower("name") == RAW).desc(), "walk_index"))
    found = rows.withColumn("_k", first).where("_k = 1")
    return found.select(*page, "raw_lines", "fallback_lines")


def structure(files: DataFrame, page: list[str]) -> DataFrame:
    """(page, structure_blocks, table_cell_boxes) of the first file in walk order that is not ``raw_ocr.json``; empty where it is broken."""
    first = F.row_number().over(Window.partitionBy(*page).orderBy("walk_index"))
    rows = parsed(files.where(F.lower("name") != RAW).withColumn("_k", first).where("_k = 1"))
    blocks = F.transform("j.parsing_res_list", lambda b: F.struct(b["block_label"].alias("label"), b["block_content"].alias("content"), b["block_bbox"].alias("bbox")))
    blocks = F.filter(blocks, lambda b: b["label"].isNotNull() & b["content"].isNotNull() & G.finite_box(b["bbox"]))
    cells = F.filter(F.flatten(F.transform("j.table_res_list", lambda t: F.coalesce(t["cell_box_list"], F.array().cast(f"ARRAY<{BOX}>")))), G.finite_box)
    return rows.select(*page, F.coalesce(blocks, F.array()).cast(f"ARRAY<{BLOCK}>").alias("structure_blocks"), F.coalesce(cells, F.array()).cast(f"ARRAY<{BOX}>").alias("table_cell_boxes"))


def walk(folder: str) -> list[str]:
    """All files below a folder, in directory order."""
    out = []
    with os.scandir(folder) as found:
        for e in found:
            out += walk(e.path) if e.is_dir() else [e.path] if e.is_file() else []
    return out


def _box(box: Any) -> bool:
    return isinstance(box, list) and len(box) == 4 and all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in box)


def _lines(ocr: Any) -> list[dict]:
    ocr = ocr if isinstance(ocr, dict) else {}
    texts, boxes, scores = ocr.get("rec_texts"), ocr.get("rec_boxes"), ocr.get("rec_scores") or []
    if not isinstance(texts, list) or not isinstance(boxes, list):
        return []
    scores = scores + [None] * (len(texts) - len(scores))
    return [{"text": t, "box": [float(v) for v in b], "score": s} for t, b, s in zip(texts, boxes, scores, strict=False) if isinstance(t, str) and _box(b)]


def _json(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
    except (OSError, ValueError):
        return {}
    found = found if isinstance(found, dict) else {}
    return found["res"] if isinstance(found.get("res"), dict) else found


def read_folder(folder: str, recovery: bool = True) -> dict[str, Any]:
    """A recogniser's output folder: exactly one Markdown file, the assets it shows, and with ``recovery`` lines and structure."""
    files = walk(folder)
    markdown = [f for f in files if f.lower().endswith(".md")]
    if len(markdown) != 1:
        raise FolioError("OCR_MARKDOWN_NOT_FOUND", f"{len(markdown)} Markdown files, not 1", folder=folder)
    with open(markdown[0], encoding="utf-8", newline="") as file:
        text = file.read()
    out: dict[str, Any] = {"markdown": text, "raw_lines": [], "fallback_lines": [], "structure_blocks": [], "table_cell_boxes": [], "assets": assets(text, markdown[0], folder)}
    if recovery:
        found = sorted((f for f in files if f.lower().endswith(".json")), key=lambda f: os.path.basename(f).lower() != RAW)
        for f in found:
            j = _json(f)
            lines = _lines(j.get("overall_ocr_res"))
            if lines:
                out |= {"raw_lines": lines, "fallback_lines": _lines(j.get("fallback_ocr_res"))}
                break
        j = next((_json(f) for f in files if f.lower().endswith(".json") and os.path.basename(f).lower() != RAW), {})
        blocks, tables = ([x for x in j.get(k) or [] if isinstance(x, dict)] for k in ("parsing_res_list", "table_res_list"))
        out["structure_blocks"] = [{"label": b["block_label"], "content": b["block_content"], "bbox": [float(v) for v in b["block_bbox"]]} for b in blocks if isinstance(b.get("block_label"), str) and isinstance(b.get("block_content"), str) and _box(b.get("block_bbox"))]
        out["table_cell_boxes"] = [[float(v) for v in b] for t in tables for b in t.get("cell_box_list") or [] if _box(b)]
    return out


def assets(markdown: str, at: str, folder: str) -> list[dict[str, str]]:
    """Local images that the Markdown file ``at`` shows, each once; they must exist and be inside the folder."""
    import re

    shown = [m[1] for m in re.finditer(r"!\[[^\]]*\]\(([^)\s]+)(?:\s+[\"'][^\"']*[\"'])?\)", markdown)]
    shown += [m[2] for m in re.finditer(r"<img\b[^>]*\bsrc\s*=\s*([\"'])(.*?)\1[^>]*>", markdown, re.I)]
    out, root = [], os.path.abspath(folder)
    for reference in dict.fromkeys(shown):
        if re.match(r"[a-z]+:|#|/", reference, re.I) or reference.startswith("\\"):
            continue
        path = os.path.abspath(os.path.join(os.path.dirname(at), unquote(reference)))
        if path != root and not path.startswith(root + os.sep):
            raise FolioError("OCR_UNSAFE_ASSET_PATH", f"an image outside the output: {reference}")
        if not os.path.exists(path):
            raise FolioError("OCR_ASSET_MISSING", f"no such image: {reference}")
        out.append({"reference": reference, "source_path": path})
    return out
