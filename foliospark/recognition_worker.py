"""A program that loads recognition models once and reads page after page: a line of JSON in, a line of JSON out.

It runs under a Python that has the models, beside a Spark worker, which keeps it (:class:`foliospark.recognize.WorkerRecognizer`).
A request names an image, a folder for what the structure model saves, and options; with ``recovery`` the lines of that
image, and of the page's own beside it, go to ``raw_ocr.json`` in the folder. The answer is ``{}``, or what went wrong.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable, Iterable
from typing import Any, Protocol, TextIO


class Models(Protocol):
    """What a request's options name; tests have their own."""

    def lines(self, image: str) -> Iterable[dict[str, Any]]: ...

    def pages(self, image: str, **options: bool) -> Iterable[Any]: ...


class Installed:
    """The models of the installed package, loaded when they are first needed and kept."""

    def __init__(self, common: dict[str, str], structure: dict[str, bool]) -> None:
        self.common, self.structure = common, structure
        self._plain: Any = None
        self._pages: Any = None

    def lines(self, image: str) -> Iterable[dict[str, Any]]:
        from paddleocr import PaddleOCR

        if self._plain is None:
            self._plain = PaddleOCR(**self.common, use_doc_orientation_classify=False, use_doc_unwarping=False, use_textline_orientation=False)
        return [page.json for page in self._plain.predict(image)]

    def pages(self, image: str, **options: bool) -> Iterable[Any]:
        from paddleocr import PPStructureV3

        if self._pages is None:
            self._pages = PPStructureV3(**self.common, **self.structure)
        return self._pages.predict_iter(image, **options)


def plain_lines(pages: Iterable[dict[str, Any]]) -> dict[str, list[Any]]:
    """The lines of pages as three parallel lists."""
    out: dict[str, list[Any]] = {"rec_texts": [], "rec_boxes": [], "rec_scores": []}
    for page in pages:
        own = page.get("res", page)
        for name, values in out.items():
            values.extend(own.get(name, ()))
    return out


def read_page(request: dict[str, Any], models: Models) -> None:
    folder, image, recovery = request["folder"], request["image"], request.get("recovery")
    os.makedirs(folder, exist_ok=True)
    if recovery:
        found = {"overall_ocr_res": plain_lines(models.lines(recovery)), "fallback_ocr_res": plain_lines(models.lines(image) if recovery != image else ())}
        with open(os.path.join(folder, "raw_ocr.json"), "w", encoding="utf-8") as file:
            json.dump(found, file, ensure_ascii=False)
    for page in models.pages(image, **request.get("page", {})):
        page.save_to_markdown(folder)
        page.save_to_json(folder)


def serve(lines: Iterable[str], out: TextIO, load: Callable[[dict[str, str], dict[str, bool]], Models] = Installed) -> None:
    """Answers requests until there are no more; models are kept as long as their options stay the same."""
    held: tuple[str, Models] | None = None
    for line in lines:
        try:
            request = json.loads(line)
            options = json.dumps([request.get("common", {}), request.get("structure", {})], sort_keys=True)
            if held is None or held[0] != options:
                held = options, load(request.get("common", {}), request.get("structure", {}))
            read_page(request, held[1])
            answer: dict[str, str] = {}
        except Exception as error:  # whatever a model raises belongs to its page
            answer = {"error": f"{type(error).__name__}: {error}"}
        out.write(json.dumps(answer) + "\n")
        out.flush()


if __name__ == "__main__":
    answers = os.fdopen(os.dup(1), "w", encoding="utf-8")
    os.dup2(2, 1)  # what models print is no answer
    serve(sys.stdin, answers)
