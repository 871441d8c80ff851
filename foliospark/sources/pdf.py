"""PDF pages through a renderer that runs beside the executor."""

from __future__ import annotations

import os
import re
import subprocess
import sys
import tempfile
from collections.abc import Callable
from typing import NamedTuple

from foliospark.errors import FolioError
from foliospark.functions.pure import natural_key

#: What a failed process means for a PDF.
ERRORS = {"OCR_ENGINE_NOT_FOUND": "PDF_RENDERER_NOT_FOUND", "OCR_ENGINE_START_FAILED": "PDF_RENDERER_START_FAILED", "OCR_ENGINE_TIMEOUT": "PDF_RENDER_TIMEOUT"}


class Finished(NamedTuple):
    exit_code: int
    stdout: str
    stderr: str


def run_process(command: str, arguments: list[str], *, cwd: str | None = None, env: dict[str, str] | None = None, timeout: float = 1800) -> Finished:
    """Runs a program without a shell; failures carry codes and what it wrote."""
    try:
        done = subprocess.run([command, *arguments], cwd=cwd, env={**os.environ, **(env or {})}, capture_output=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired as error:
        raise FolioError("OCR_ENGINE_TIMEOUT", f"no end after {timeout} s: {command}", command=command, args=arguments) from error
    except FileNotFoundError as error:
        raise FolioError("OCR_ENGINE_NOT_FOUND", f"no such program: {command}", command=command, args=arguments) from error
    except (OSError, ValueError) as error:
        raise FolioError("OCR_ENGINE_START_FAILED", f"cannot start {command}", command=command, args=arguments) from error
    out, err = done.stdout.decode("utf-8", "replace"), done.stderr.decode("utf-8", "replace")
    if done.returncode:
        raise FolioError("OCR_ENGINE_FAILED", f"{command} ended with {done.returncode}", command=command, args=arguments, stdout=out, stderr=err, exit_code=done.returncode)
    return Finished(done.returncode, out, err)


Runner = Callable[..., Finished]


class PdfRenderer:
    """Renders pages as ``page-NNNN.png`` with a script that takes --input, --output and --dpi."""

    def __init__(self, command: str = sys.executable, script: str | None = None, *, dpi: int = 300, timeout: float = 600, runner: Runner = run_process) -> None:
        if not 72 <= dpi <= 600:
            raise ValueError("dpi from 72 to 600")
        self.command, self.dpi, self.timeout, self.runner = command, dpi, timeout, runner
        self.script = script or os.path.join(os.path.dirname(__file__), "render_pdf.py")

    def pages(self, path: str, folder: str | None = None) -> list[tuple[str, bytes]]:
        """(name, PNG) of each page in order."""
        with tempfile.TemporaryDirectory() as own:
            out = folder or own
            os.makedirs(out, exist_ok=True)
            try:
                self.runner(self.command, [self.script, "--input", path, "--output", out, "--dpi", str(self.dpi)], cwd=out, timeout=self.timeout)
            except FolioError as error:
                raise FolioError(ERRORS.get(error.code, "PDF_RENDER_FAILED"), f"cannot render {path}", **error.details) from error
            names = sorted((n for n in os.listdir(out) if re.fullmatch(r"page-[0-9]{4}\.png", n, re.I)), key=natural_key)
            if not names:
                raise FolioError("PDF_NO_PAGES", f"no pages of {path}")
            found = []
            for n in names:
                with open(os.path.join(out, n), "rb") as file:
                    found.append((n, file.read()))
            return found
