"""``python -m foliospark.evaluation ACTUAL EXPECTED MANIFEST REPORT``: holds a document against what it should say.

ACTUAL and EXPECTED are Markdown files, MANIFEST the JSON that tells the watermark's text, REPORT the JSON that is
written. Exit code: 0 passed, 2 did not pass, 1 could not be evaluated.
"""

from __future__ import annotations

import json
import os
import sys
from typing import Any, TextIO

from pyspark.sql import SparkSession

from foliospark.errors import FolioError, as_folio_error
from foliospark.operators.evaluate import evaluated, report
from foliospark.pipeline import json_text, now

#: Where the three inputs and the report are by default.
DEFAULTS = ("output/synthetic-image/two-up-watermarked.md", "test/fixtures/generated/expected.md", "test/fixtures/generated/fixture-manifest.json", "output/synthetic-image/evaluation.json")


def read(path: str) -> str:
    try:
        with open(path, encoding="utf-8") as file:
            return file.read()
    except (OSError, UnicodeDecodeError) as error:
        raise as_folio_error(error, "INPUT_READ_FAILED", f"cannot read {path}") from error


def evaluate_files(spark: SparkSession, actual: str, expected: str, manifest: str) -> dict[str, Any]:
    """The report of three files: schema version, time, files, pass, criteria, metrics."""
    texts = [read(p) for p in (actual, expected, manifest)]
    try:
        mark = json.loads(texts[2]).get("watermark") or {}
    except (ValueError, AttributeError) as error:
        raise as_folio_error(error, "INPUT_READ_FAILED", f"not a manifest: {manifest}") from error
    pair = spark.createDataFrame([(texts[0], texts[1], mark.get("text"))], "actual STRING, expected STRING, stamp STRING")
    found = evaluated(pair, stamp="stamp").drop("actual", "expected", "stamp").first().asDict(recursive=True)
    files = {k: os.path.relpath(p) for k, p in (("actual", actual), ("expected", expected), ("fixtureManifest", manifest))}
    return {"schemaVersion": 1, "evaluatedAt": now(), "files": files, **report(found)}


def main(argv: list[str], *, spark: SparkSession | None = None, stdout: TextIO | None = None, stderr: TextIO | None = None) -> int:
    out, err = stdout or sys.stdout, stderr or sys.stderr
    paths = [*argv[:4], *DEFAULTS[len(argv) :]]
    try:
        if len(argv) > 4:
            raise FolioError("CLI_TOO_MANY_INPUTS", "at most four paths")
        session = spark or SparkSession.builder.appName("foliospark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        found = evaluate_files(session, *paths[:3])
        text = json_text(found)
        os.makedirs(os.path.dirname(os.path.abspath(paths[3])), exist_ok=True)
        with open(paths[3], "w", encoding="utf-8") as file:
            file.write(text)
        out.write(text)
        return 0 if found["pass"] else 2
    except Exception as error:
        err.write(f"{error}\n")
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
