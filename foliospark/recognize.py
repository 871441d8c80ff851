"""Recognisers: the part that reads text from pixels is a plug-in."""

from __future__ import annotations

import atexit
import json
import os
import selectors
import subprocess
import tempfile
import time
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.errors import FolioError, as_folio_error, summary
from foliospark.schemas import RECOGNIZED
from foliospark.session import prepare
from foliospark.sources.pdf import Runner, run_process
from foliospark.sources.sidecars import read_folder

#: Pages and bytes that a task puts into one batch; a batch for each page cost more than small pages did.
MOST_PAGES, MOST_BYTES = 256, 4 << 20
MODEL = "korean_PP-OCRv5_mobile_rec"  # fixed value: the default model's name


class Recognizer(Protocol):
    """Reads one page; runs on executors, so it must be picklable. Keys of the result: those of ``RECOGNIZED``."""

    def recognize(self, page: dict[str, Any]) -> dict[str, Any]: ...


class ReplayRecognizer:
    """Returns what an earlier run left in ``root``/page-NNNN (or ``root``/document/page-NNNN)."""

    def __init__(self, root: str, recovery: bool = True, engine: dict[str, str] | None = None) -> None:
        self.root, self.recovery = root, recovery
        self.engine = engine or {"name": "replay", "recognition_model": MODEL, "device": "cpu"}

    def recognize(self, page: dict[str, Any]) -> dict[str, Any]:
        stem = os.path.splitext(os.path.basename(page["doc_id"]))[0]
        places = (os.path.join(self.root, stem, f"page-{page['page_number']:04d}"), os.path.join(self.root, f"page-{page['page_number']:04d}"))
        folder = next((p for p in places if os.path.isdir(p)), places[-1])
        if not os.path.isdir(folder):
            raise FolioError("OCR_MARKDOWN_NOT_FOUND", f"nothing recorded in {folder}")
        return {**read_folder(folder, self.recovery), "warnings": [], "engine": self.engine}


# The structure program's options, and those of them that it takes with each page.
FLAGS = {
    "use_doc_orientation_classify": True,
    "use_doc_unwarping": True,
    "use_textline_orientation": True,
    "use_region_detection": True,
    "use_table_recognition": True,
    "use_formula_recognition": False,
    "use_seal_recognition": False,
    "use_chart_recognition": False,
}
PAGE_FLAGS = ("use_doc_orientation_classify", "use_doc_unwarping", "use_chart_recognition")


def _laid_out(page: dict[str, Any], work: str) -> tuple[str, str, str]:
    """(image, image for recovery, output folder) of a page in a task's own folder."""
    image, raw, out = (os.path.join(work, n) for n in ("input.png", "raw-input.png", "ocr"))
    os.makedirs(out)
    for path, data in ((image, page["page_png"]), (raw, page.get("recovery_png"))):
        if data:
            with open(path, "wb") as file:
                file.write(data)
    return image, raw if page.get("recovery_png") else image, out


def _found(out: str, recovery: bool, warnings: list[str], model: str, device: str) -> dict[str, Any]:
    """What a program has left, its pictures by value."""
    found = read_folder(out, recovery)
    for a in found["assets"]:
        with open(a["source_path"], "rb") as file:
            a["content"] = file.read()
    return {**found, "warnings": warnings, "engine": {"name": "PP-StructureV3", "recognition_model": model, "device": device}}


class ProcessRecognizer:
    """Runs a structure-recognition program on each page, and reads what it leaves.

    Models are loaded anew for each page; :class:`WorkerRecognizer` keeps them. ``bridge``: the program knows --save_raw_ocr and --raw_ocr_input; a stock program does not, and is not given them.
    """

    def __init__(self, command: str = "paddleocr", arguments: tuple[str, ...] = (), *, device: str = "cpu", model: str = MODEL, recovery: bool = False, bridge: bool = True, timeout: float = 1800, runner: Runner = run_process) -> None:
        self.command, self.arguments, self.device, self.model = command, arguments, device, model
        self.recovery, self.bridge, self.timeout, self.runner = recovery, bridge, timeout, runner

    def build(self, image: str, out: str, raw: str | None = None) -> list[str]:
        args = ["pp_structurev3", "-i", image, "--save_path", out, "--device", self.device, "--text_recognition_model_name", self.model]
        for name, value in FLAGS.items():
            args += [f"--{name}", str(value)]
        if self.bridge:
            args += ["--save_raw_ocr", str(self.recovery).lower()]
            args += ["--raw_ocr_input", raw or image] if self.recovery else []
        return args

    def recognize(self, page: dict[str, Any]) -> dict[str, Any]:
        with tempfile.TemporaryDirectory() as work:  # of this task alone
            image, raw, out = _laid_out(page, work)
            done = self.runner(self.command, [*self.arguments, *self.build(image, out, raw)], cwd=out, timeout=self.timeout)
            return _found(out, self.recovery, [done.stderr.strip()] if done.stderr.strip() else [], self.model, self.device)


_kept: dict[tuple[str, ...], subprocess.Popen] = {}  # of this Python worker, which Spark uses again for other tasks


@atexit.register
def _stop_kept() -> None:
    for process in _kept.values():
        process.kill()


def _answer(process: subprocess.Popen, line: bytes, timeout: float) -> bytes | None:
    """The program's line in answer to one; empty if it has ended, None if there is none in time."""
    try:
        process.stdin.write(line)
        process.stdin.flush()
    except OSError:
        return b""
    got, until = b"", time.monotonic() + timeout
    with selectors.DefaultSelector() as ready:
        ready.register(process.stdout, selectors.EVENT_READ)
        while not got.endswith(b"\n"):
            if not ready.select(max(0.0, until - time.monotonic())):
                return None
            part = os.read(process.stdout.fileno(), 1 << 16)
            if not part:
                return b""
            got += part
    return got


class WorkerRecognizer:
    """Keeps a recognition program running in each Python worker of Spark and sends it page after page, so its models are loaded once.

    The program takes a line of JSON for each page and answers with one (see :mod:`foliospark.recognition_worker`). One that
    does not answer in time, or ends, fails its page, is stopped, and is started anew for the next.
    """

    def __init__(self, command: str, arguments: tuple[str, ...] = (), *, device: str = "cpu", model: str = MODEL, recovery: bool = False, timeout: float = 1800) -> None:
        self.command, self.arguments, self.device, self.model, self.recovery, self.timeout = command, arguments, device, model, recovery, timeout

    def _process(self) -> subprocess.Popen:
        key = (self.command, *self.arguments)
        if key not in _kept:
            try:
                _kept[key] = subprocess.Popen(key, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
            except FileNotFoundError as error:
                raise FolioError("OCR_ENGINE_NOT_FOUND", f"no such program: {self.command}") from error
            except OSError as error:
                raise FolioError("OCR_ENGINE_START_FAILED", f"cannot start {self.command}") from error
        return _kept[key]

    def _drop(self) -> None:
        process = _kept.pop((self.command, *self.arguments), None)
        if process:
            process.kill()
            process.wait()

    def recognize(self, page: dict[str, Any]) -> dict[str, Any]:
        with tempfile.TemporaryDirectory() as work:  # of this task alone
            image, raw, out = _laid_out(page, work)
            structure = {k: v for k, v in FLAGS.items() if k not in PAGE_FLAGS}
            request = {"image": image, "folder": out, "common": {"device": self.device, "text_recognition_model_name": self.model}, "structure": structure, "page": {k: FLAGS[k] for k in PAGE_FLAGS}}
            if self.recovery:
                request["recovery"] = raw
            line = _answer(self._process(), json.dumps(request).encode() + b"\n", self.timeout)
            if not line:
                self._drop()
                raise FolioError("OCR_ENGINE_TIMEOUT", f"no answer after {self.timeout} s: {self.command}") if line is None else FolioError("OCR_ENGINE_FAILED", f"{self.command} has ended")
            answer = json.loads(line)
            if "error" in answer:
                raise FolioError("OCR_ENGINE_FAILED", answer["error"])
            return _found(out, self.recovery, [], self.model, self.device)


_LINE = pa.struct([("text", pa.string()), ("box", pa.list_(pa.float64())), ("score", pa.float64())])
_BLOCK = pa.struct([("label", pa.string()), ("content", pa.string()), ("bbox", pa.list_(pa.float64()))])
_LAYOUT = pa.struct([("bbox", pa.list_(pa.float64())), ("ord", pa.float64()), *((k, pa.string()) for k in ("type", "markdown", "content", "asset_path", "alt"))])
_ERROR = pa.struct([("code", pa.string()), ("message", pa.string())])
_TYPES = {
    "markdown": pa.string(), "layout_blocks": pa.list_(_LAYOUT), "raw_lines": pa.list_(_LINE), "fallback_lines": pa.list_(_LINE), "structure_blocks": pa.list_(_BLOCK), "table_cell_boxes": pa.list_(pa.list_(pa.float64())),
    "assets": pa.list_(pa.struct([("reference", pa.string()), ("source_path", pa.string()), ("content", pa.binary())])), "warnings": pa.list_(pa.string()), "engine": pa.struct([(k, pa.string()) for k in ("name", "recognition_model", "device")]), "error": _ERROR,
}
RECOGNIZED_WITH_ASSETS = RECOGNIZED.replace("source_path: STRING>", "source_path: STRING, content: BINARY>")


def recognized(pages: DataFrame, recognizer: Recognizer) -> DataFrame:
    """Pages with what the recogniser reads on them, one page at a time; a failure is the page's error, not the job's.

    ``pages`` has doc_id, page_number, page_png, recovery_png, page_width, recovery_width, error; all columns but the
    pixels are kept, and raw_scale and fallback_scale added.
    """
    prepare(pages.sparkSession)
    kept = [c for c in pages.columns if c not in ("page_png", "recovery_png", "error")]

    def read(page: dict[str, Any]) -> dict[str, Any]:
        if page["error"] is not None:
            return {"error": page["error"]}
        try:
            return recognizer.recognize(page)
        except Exception as error:  # whatever a plug-in raises belongs to its page
            return {"error": summary(as_folio_error(error, "UNEXPECTED_ERROR", str(error)))}

    def together(rows: pa.RecordBatch, results: list[dict[str, Any]]) -> pa.RecordBatch:
        arrays = [rows.column(c) for c in kept] + [pa.array([r.get(k) for r in results], t) for k, t in _TYPES.items()]
        scales = pa.array([r["raw_scale"] for r in results], pa.float64())
        return pa.RecordBatch.from_arrays([*arrays, scales, pa.array([1.0] * len(results))], [*kept, *_TYPES, "raw_scale", "fallback_scale"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, results = 0, 0, []
            for i in range(batch.num_rows):
                page = batch.slice(i, 1).to_pylist()[0]
                result = read(page)
                scale = page["recovery_width"] / page["page_width"] if page.get("recovery_width") and page.get("page_width") else 1.0
                results.append({**result, "raw_scale": scale})
                size += len(result.get("markdown") or "") + sum(len(a.get("content") or b"") for a in result.get("assets") or ())
                if len(results) >= MOST_PAGES or size >= MOST_BYTES:
                    yield together(batch.slice(first, len(results)), results)
                    first, size, results = i + 1, 0, []
            if results:
                yield together(batch.slice(first), results)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in kept)
    return pages.mapInArrow(run, f"{fields}, {RECOGNIZED_WITH_ASSETS}, raw_scale DOUBLE, fallback_scale DOUBLE")
