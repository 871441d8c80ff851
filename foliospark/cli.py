"""Command line: ``python -m foliospark <file or folder> [options]``."""

from __future__ import annotations

import contextlib
import math
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, TextIO

from foliospark.errors import FolioError, diagnostic_tail, summary
from foliospark.sources.loader import inspect

VERSION = "0.1.0"
# Choices of options.
MODES, LAYOUTS = ("off", "conservative", "strong", "text-safe"), ("auto", "single", "two-up")
HELP = """foliospark - scanned documents to Markdown

  foliospark <input.docx | pdf | image | folder> [options]

  -o, --output <folder>       where results go (./output)
      --split-ratio <0..1>    where to cut scans of two pages
      --page-layout <layout>  auto | single | two-up (auto)
      --watermark <mode>      off | conservative | strong | text-safe (text-safe)
      --device <device>       cpu, gpu:0, ... (cpu)
      --paddle-command <path> recognition program (paddleocr)
      --paddle-python <path>  Python that runs the recognition worker
      --keep-work             keep intermediate tables
  -h, --help
  -v, --version
"""


@dataclass
class Options:
    input_path: str | None = None
    output: str = field(default_factory=lambda: os.path.abspath("output"))
    split_ratio: float | None = None
    page_layout: str = "auto"
    watermark_mode: str = "text-safe"
    device: str = "cpu"
    paddle_command: str = "paddleocr"
    paddle_python: str | None = None
    keep_work: bool = False
    help: bool = False
    version: bool = False


def _ratio(raw: str) -> float:
    try:
        value = float(raw)
    except ValueError:
        value = math.nan
    if not 0 < value < 1:
        raise FolioError("CLI_INVALID_SPLIT_RATIO", "--split-ratio takes a number between 0 and 1")
    return value


def _choice(option: str, code: str, allowed: tuple[str, ...]) -> Callable[[str], str]:
    def take(raw: str) -> str:
        if raw not in allowed:
            raise FolioError(code, f"{option} takes one of {', '.join(allowed)}")
        return raw

    return take


_VALUES: dict[str, tuple[str, Callable[[str], Any]]] = {
    "--output": ("output", os.path.abspath),
    "--split-ratio": ("split_ratio", _ratio),
    "--page-layout": ("page_layout", _choice("--page-layout", "CLI_INVALID_PAGE_LAYOUT", LAYOUTS)),
    "--watermark": ("watermark_mode", _choice("--watermark", "CLI_INVALID_WATERMARK_MODE", MODES)),
    "--device": ("device", str),
    "--paddle-command": ("paddle_command", str),
    "--paddle-python": ("paddle_python", os.path.abspath),
}
_FLAGS = {"--keep-work": "keep_work", "--help": "help", "--version": "version"}
_SHORT = {"-o": "--output", "-h": "--help", "-v": "--version"}


def parse(argv: list[str]) -> Options:
    options, rest = Options(), iter(argv)
    for argument in rest:
        name = _SHORT.get(argument, argument)
        if name in _FLAGS:
            setattr(options, _FLAGS[name], True)
        elif name in _VALUES:
            value = next(rest, "")
            if not value or value.startswith("-"):
                raise FolioError("CLI_MISSING_VALUE", f"{argument} needs a value")
            key, take = _VALUES[name]
            setattr(options, key, take(value))
        elif argument.startswith("-"):
            raise FolioError("CLI_UNKNOWN_OPTION", f"no such option: {argument}")
        elif options.input_path is not None:
            raise FolioError("CLI_TOO_MANY_INPUTS", "one input at a time")
        else:
            options.input_path = os.path.abspath(argument)
    if options.page_layout == "single" and options.split_ratio is not None:
        raise FolioError("CLI_INCOMPATIBLE_OPTIONS", "--split-ratio does not go with --page-layout single")
    return options


#: What is said at each event; events that are not here are not shown.
LINES = {
    "batch:start": "{file_count} images",
    "batch:file:start": "{file_number} of {file_count}: {name}",
    "batch:file:complete": "{file_number} of {file_count}: {name} is done",
    "batch:file:error": "{file_number} of {file_count}: {name} failed, {code}",
    "input:complete": "{sheet_count} sheets",
    "page:start": "page {page_number}, {side}",
    "page:complete": "page {page_number} is done, {asset_count} pictures",
}


def progress_line(event: dict[str, Any]) -> str | None:
    """An event as a line, None for those that are not shown; events of a file in a batch say which file it is."""
    line = LINES.get(event["type"])
    if line is None:
        return None
    batch = event.get("batch")
    lead = "({file_number} of {file_count}) ".format(**batch) if batch else ""
    return lead + line.format(**event, name=os.path.basename(event.get("input_path", "")), code=(event.get("error") or {}).get("code"))


def main(argv: list[str], *, single: Callable[..., dict] | None = None, folder: Callable[..., dict] | None = None, look: Callable[[str], str] = inspect, session: Callable[[], Any] | None = None, stdout: TextIO | None = None, stderr: TextIO | None = None) -> int:
    """Exit code: 0 done, 1 failed, 2 no input given."""
    out, err = stdout or sys.stdout, stderr or sys.stderr

    def show(event: dict[str, Any]) -> None:
        line = progress_line(event)
        if line:
            (err if event["type"] == "batch:file:error" else out).write(line + "\n")

    try:
        options = parse(argv)
        if options.help or options.version:
            out.write(HELP if options.help else VERSION + "\n")
            return 0
        if not options.input_path:
            err.write("an input is needed\n\n" + HELP)
            return 2
        from foliospark import pipeline
        from foliospark.session import scope

        kind = look(options.input_path)
        settings = pipeline.Settings(options.split_ratio, options.page_layout, options.watermark_mode, options.device, options.paddle_command, options.paddle_python)
        spark = session() if session else _session()
        with contextlib.nullcontext() if options.keep_work else scope(spark):
            if kind == "directory":
                extra = {"one": single} if single else {}
                result = (folder or pipeline.run_folder)(spark, options.input_path, options.output, settings, progress=show, **extra)
                t = result["summary"]["totals"]
                out.write(f"{t['discovered']} files, {t['succeeded']} done, {t['failed']} failed\n{result['summary_markdown_path']}\n{result['summary_json_path']}\n")
                if result["has_failures"]:
                    err.write("[BATCH_PARTIAL_FAILURE] some images failed\n")
                return int(result["has_failures"])
            result = (single or pipeline.run)(spark, options.input_path, options.output, settings, progress=show)
            out.write(f"Markdown: {result['markdown_path']}\nManifest: {result['manifest_path']}\n")
            return 0
    except Exception as error:
        found = summary(error)
        err.write(f"[{found['code']}] {found['message']}\n")
        tail = diagnostic_tail(error)
        if tail:
            err.write(tail + "\n")
        return 1


def _session() -> Any:
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("foliospark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
