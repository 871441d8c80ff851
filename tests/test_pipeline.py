import hashlib
import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark import cli
from foliospark import pipeline as PL
from foliospark.errors import FolioError
from foliospark.operators import assemble as A
from foliospark.operators import relational as R
from foliospark.operators.raster import encode_png, solid
from foliospark.recognize import ReplayRecognizer
from foliospark.streaming import ingest
from tests.test_sources import docx, recorded, rels


class Fake:
    """Says which page it is; fails on images that are black."""

    def recognize(self, page):
        from foliospark.operators.raster import decode_png

        if not decode_png(page["page_png"]).any():
            raise FolioError("OCR_ENGINE_FAILED", "black page")
        return {"markdown": f"page {page['page_number']} {page['side']}\r\n", "raw_lines": [], "warnings": ["w"], "engine": {"name": "fake", "recognition_model": "m", "device": "cpu"}}


def scan(width, height, tone=255):
    return encode_png(solid(width, height, tone))


def write(path, data):
    path.write_bytes(data)
    return str(path)


def sheets(*images):
    """A word-processor file that shows these images, in this order."""
    names = [f"image{k}.png" for k in range(len(images), 0, -1)]
    links = rels(*((f"rId{k}", f"media/{n}") for k, n in enumerate(names)))
    return docx([f"rId{k}" for k in range(len(images))], links, media=list(zip(names, images)))


def test_sheets_of_both_shapes_in_one_document(spark, tmp_path):
    events = []
    out = PL.run(spark, write(tmp_path / "plan 7.docx", sheets(scan(60, 90), scan(240, 100), scan(70, 70))), str(tmp_path / "new" / "out"), recognizer=Fake(), progress=events.append)
    assert out["markdown_path"].endswith("/plan 7.md") and out["manifest_path"].endswith("/plan 7.manifest.json")
    with open(out["markdown_path"], encoding="utf-8") as f:
        assert f.read() == "\n\n---\n\n".join(f"<!-- page: {k} -->\n\npage {k} {side}" for k, side in enumerate(("single", "left", "right", "single"), 1)) + "\n"
    with open(out["manifest_path"], encoding="utf-8") as f:
        m = json.load(f)
    assert m == out["manifest"] and m["input"]["path"] == str(tmp_path / "plan 7.docx") and m["input"]["sha256"] == hashlib.sha256((tmp_path / "plan 7.docx").read_bytes()).hexdigest()
    assert (m["schemaVersion"], m["sheetCount"], m["pageCount"], m["output"]) == (1, 3, 4, {"markdown": "plan 7.md", "manifest": "plan 7.manifest.json"})
    assert m["settings"] == {"splitRatio": None, "pageLayout": "auto", "watermarkMode": "text-safe", "device": "cpu", "paddleCommand": "paddleocr", "paddlePython": None}
    size = lambda w, h: {"width": w, "height": h}
    assert [(p["sheetNumber"], p["sourceImage"], p["splitColumn"], p["sourceSize"], p["pageSize"], p["recoveryPageSize"]) for p in m["pages"]] == [
        (1, "image3.png", None, size(60, 90), size(60, 90), size(120, 180)), (2, "image2.png", 120, size(240, 100), size(120, 100), size(240, 200)),
        (2, "image2.png", 120, size(240, 100), size(120, 100), size(240, 200)), (3, "image1.png", None, size(70, 70), size(70, 70), size(140, 140)),
    ]
    assert [e["type"] for e in events] == ["input:start", "input:complete", *["page:start", "page:complete"] * 4, "complete"] and events[1]["sheet_count"] == 3


@pytest.mark.parametrize("size, settings, sides, cut", [
    ((300, 100), PL.Settings(split_ratio=0.4), ["left", "right"], 120), ((300, 100), PL.Settings(page_layout="single"), ["single"], None), ((100, 300), PL.Settings(watermark_mode="off"), ["single"], None),
])
def test_settings(spark, tmp_path, size, settings, sides, cut):
    pages = PL.run(spark, write(tmp_path / "a.png", scan(*size)), str(tmp_path / "out"), settings, recognizer=Fake())["manifest"]["pages"]
    assert [p["side"] for p in pages] == sides and {p["splitColumn"] for p in pages} == {cut} and all((p["recoveryPageSize"] is None) == (settings.watermark_mode == "off") for p in pages)


def test_errors_are_columns_of_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {"black second sheet.docx": sheets(scan(60, 90), scan(60, 90, 0)), "fine.docx": sheets(scan(60, 90)), "no image.png": b"text", "no zip.docx": b"text", "odd.xyz": b"text", "uncut.png": scan(120, 40)}
    for name, data in files.items():
        write(tmp_path / "in" / name, data)
    tables = PL.convert(spark, f"file://{tmp_path}/in", Fake(), PL.Settings(split_ratio=0.2))
    got = {os.path.basename(r.doc_id).replace("%20", " "): (r.error and r.error.code, r.markdown is None) for r in tables["documents"].collect()}
    want = {"black second sheet.docx": "IMAGE_NOT_LANDSCAPE", "fine.docx": "IMAGE_NOT_LANDSCAPE", "no image.png": "IMAGE_DECODE_FAILED", "no zip.docx": "INPUT_INVALID_ZIP", "odd.xyz": "INPUT_UNSUPPORTED_TYPE", "uncut.png": "IMAGE_UNSAFE_SPLIT"}
    assert got == {k: (v, True) for k, v in want.items()}
    tables = PL.convert(spark, [str(tmp_path / "in" / n) for n in ("black second sheet.docx", "fine.docx")], Fake())
    got = {os.path.basename(r.doc_id).replace("%20", " "): (r.error and (r.error.code, r.error.message), r.page_count) for r in tables["documents"].collect()}
    assert got == {"black second sheet.docx": (("OCR_ENGINE_FAILED", "black page"), 2), "fine.docx": (None, 1)}
    with pytest.raises(FolioError) as e:
        PL.run(spark, str(tmp_path / "in" / "black second sheet.docx"), str(tmp_path / "out"), recognizer=Fake())
    assert e.value.code == "OCR_ENGINE_FAILED" and not (tmp_path / "out").exists()


FOLDER = {"b10.png": 255, "B2.PNG": 255, "b2.jpeg": None, "c.bmp": 0, "notes.txt": None}


@pytest.mark.parametrize("one_by_one", [False, True])
def test_folders_in_one_job_or_file_by_file(spark, tmp_path, one_by_one):
    (tmp_path / "in").mkdir()
    for name, tone in FOLDER.items():
        write(tmp_path / "in" / name, b"nothing" if tone is None else scan(40, 50, tone))
    events = []
    how = {"one": lambda *a, **k: PL.run(*a, recognizer=Fake(), **k)} if one_by_one else {"recognizer": Fake()}
    out = PL.run_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), progress=events.append, **how)
    assert out["has_failures"] and out["summary"]["totals"] == {"discovered": 4, "succeeded": 2, "failed": 2}
    want = [("b2.jpeg", "b2-jpeg", None, "IMAGE_DECODE_FAILED"), ("B2.PNG", "B2-png", "B2-png/B2.md", None), ("b10.png", "b10", "b10/b10.md", None), ("c.bmp", "c", None, "OCR_ENGINE_FAILED")]
    assert sorted((r["input"], r["outputDirectory"], r["markdown"], r.get("error", {}).get("code")) for r in out["summary"]["results"]) == sorted(want)
    assert [r["input"] for r in out["summary"]["results"]][2:] == ["b10.png", "c.bmp"]
    assert (tmp_path / "out/b10/b10.md").read_text() == "<!-- page: 1 -->\n\npage 1 single\n" and json.loads((tmp_path / "out/B2-png/B2.manifest.json").read_text())["input"]["path"] == str(tmp_path / "in/B2.PNG")
    assert not (tmp_path / "out/c").exists() and json.loads((tmp_path / "out/batch-summary.json").read_text())["totals"] == out["summary"]["totals"]
    lines = (tmp_path / "out/batch-summary.md").read_text().splitlines()
    assert lines[3:6] == ["- 전체: 4", "- 성공: 2", "- 실패: 2"] and "| 3 | b10.png | 성공 | [열기](<b10/b10.md>) | [열기](<b10/b10.manifest.json>) | - |" in lines and "| 4 | c.bmp | 실패 | - | - | OCR_ENGINE_FAILED: black page |" in lines
    kinds = [e["type"] for e in events if e["type"].startswith("batch:")]
    assert kinds[0] == "batch:start" and kinds[-1] == "batch:complete" and kinds.count("batch:file:start") == 4 and kinds.count("batch:file:error") == kinds.count("batch:file:complete") == 2


def test_replay_with_assets(spark, tmp_path):
    recorded(tmp_path / "rec/page-0001")
    out = PL.run(spark, write(tmp_path / "a.png", scan(50, 60)), str(tmp_path / "out"), recognizer=ReplayRecognizer(str(tmp_path / "rec")))
    page = out["manifest"]["pages"][0]
    assert page["assets"] == ["assets/page-0001/one two.png"] and (tmp_path / "out/assets/page-0001/one two.png").read_bytes() == b"IMG"
    with open(out["markdown_path"], encoding="utf-8") as f:
        assert "![도면](assets/page-0001/one two.png)" in f.read()


def test_blocks_where_there_is_no_markdown(spark):
    from foliospark.recognize import RECOGNIZED_WITH_ASSETS

    table, text = ([0.0, 0.0, 10.0, 10.0], None, "table", "<table></table>", None, None, None), ([20.0, 2.0, 30.0, 9.0], None, "text", None, "오른쪽 설명", None, None)
    row = ("d", 1, None, [text, table], [], [], [], [], [("i/a.png", "/x/a.png", None), ("j/A.png", "/y/A.png", None), ("k/a-2.png", "/z/a-2.png", None)], [], None, None, 1.0, 1.0)
    df = spark.createDataFrame([row, (*row[:3], [([0.0] * 4, None, None, None, None, None, None)], *row[4:])], f"doc_id STRING, page_number INT, {RECOGNIZED_WITH_ASSETS}, raw_scale DOUBLE, fallback_scale DOUBLE")
    good, bad = sorted(A.materialized(df).collect(), key=lambda r: r.error is not None)
    assert good.markdown == "<table></table>\n\n오른쪽 설명" and good.asset_paths == ["assets/page-0001/a.png", "assets/page-0001/A-2.png", "assets/page-0001/a-2-2.png"]
    assert bad.error.code == "OCR_INVALID_BLOCK"


NAMES = ["plan.png", "PLAN.png", "plan-2.png", "plan.png", "plan-2-2.png", "Plan-3.PNG", "other.png", "plan.jpg"]


def test_names_that_meet_numbered_ones(spark):
    want = ["plan.png", "PLAN-2.png", "plan-2-2.png", "plan-3.png", "plan-2-2-2.png", "Plan-3-2.PNG", "other.png", "plan.jpg"]
    assert A.reserve(NAMES) == want
    df = spark.createDataFrame([(g, i, n) for g in (1, 2) for i, n in enumerate(NAMES)], "g INT, i INT, n STRING").repartition(5)
    got = {(r.g, r.i): r.unique_name for r in R.unique_names(df, ["g"], "n", "i").collect()}
    assert [got[1, i] for i in range(len(NAMES))] == [got[2, i] for i in range(len(NAMES))] == want
    files = ["x.jpg", "x.png", "X-png.gif", "y.png", "x-png-2.bmp"]
    assert A.folder_names(files) == ["x-jpg", "x-png", "X-png-2", "y", "x-png-2-2"]
    df = spark.createDataFrame(list(enumerate(files)), "i INT, n STRING")
    assert [r.folder for r in R.folder_names(df, "n", "i").orderBy("i").collect()] == A.folder_names(files)


def test_relational_folds_agree_with_page_folds(spark):
    from foliospark.operators.lines import paragraphs

    rows = ["x", "y", "1) a", "b", "3.1 c", "4. d", "4.5", "e"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "page INT, i INT, t STRING")
    assert "\n\n".join(r.text for r in R.paragraph_folds(df, ["page"], "i", "t").orderBy("paragraph").collect()) == paragraphs(rows)
    seg = R.anchor_segments(spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 20.0), (1, 20.0, 30.0), (2, 5.0, 9.0)], "g INT, x DOUBLE, y DOUBLE"), ["g"], "x", "y")
    assert [(r.g, r.lo, r.hi, r.x0, r.x1) for r in seg.orderBy("g", "lo").collect()] == [(1, float("-inf"), 10.0, 0.0, 10.0), (1, 10.0, float("inf"), 10.0, 20.0), (2, float("-inf"), float("inf"), 5.0, 5.0)]


def test_streaming_reads_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    args = (spark, f"file://{src}", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", Fake())
    write(src / "a.png", scan(50, 60))
    ingest(*args).awaitTermination()
    write(src / "b.png", scan(200, 80))
    ingest(*args).awaitTermination()
    pages = spark.read.parquet(f"file://{tmp_path}/out").select(F.regexp_extract("doc_id", "[^/]*$", 0).alias("f"), "markdown").collect()
    assert sorted((r.f, r.markdown) for r in pages) == [("a.png", "page 1 single"), ("b.png", "page 1 left"), ("b.png", "page 2 right")]


# --- command line

def call(argv, **kw):
    out, err = io.StringIO(), io.StringIO()
    got = cli.main(argv, stdout=out, stderr=err, session=lambda: None, look=kw.pop("look", lambda p: "file"), **kw)
    return got, out.getvalue(), err.getvalue()


def test_options():
    o = cli.parse("scan.docx -o converted --split-ratio 0.48 --watermark strong --page-layout two-up --device gpu:0 --paddle-python .venv/python --keep-work".split())
    assert (o.input_path, o.output, o.split_ratio, o.watermark_mode, o.page_layout, o.device, o.keep_work) == (os.path.abspath("scan.docx"), os.path.abspath("converted"), 0.48, "strong", "two-up", "gpu:0", True)
    assert cli.parse([]).watermark_mode == "text-safe" and o.paddle_python == os.path.abspath(".venv/python")
    for argv, code in (("-o", "CLI_MISSING_VALUE"), ("--output -x", "CLI_MISSING_VALUE"), ("--split-ratio 1", "CLI_INVALID_SPLIT_RATIO"), ("--split-ratio x", "CLI_INVALID_SPLIT_RATIO"), ("--watermark x", "CLI_INVALID_WATERMARK_MODE"), ("--page-layout x", "CLI_INVALID_PAGE_LAYOUT"), ("--zip", "CLI_UNKNOWN_OPTION"), ("a b", "CLI_TOO_MANY_INPUTS"), ("--page-layout single --split-ratio 0.5", "CLI_INCOMPATIBLE_OPTIONS")):
        with pytest.raises(FolioError) as e:
            cli.parse(argv.split())
        assert e.value.code == code
        assert call(argv.split())[0] == 1


def test_exit_codes():
    assert call(["-h"])[:2] == (0, cli.HELP) and call(["--version"])[1] == cli.VERSION + "\n"
    got, _, err = call([])
    assert got == 2 and cli.HELP in err

    def one(spark, path, out, settings, progress):
        progress({"type": "page:start", "page_number": 1, "side": "left"})
        progress({"type": "sheet:start"})
        return {"markdown_path": "m", "manifest_path": "j"}

    assert call(["a.png"], single=one) == (0, "page 1, left\nMarkdown: m\nManifest: j\n", "")

    def fail(*a, **k):
        raise FolioError("OCR_ENGINE_FAILED", "no", stderr="x" * 5000 + "tail\n")

    got, _, err = call(["a.png"], single=fail)
    assert got == 1 and err.startswith("[OCR_ENGINE_FAILED] no\n") and err.endswith("tail\n") and len(err) < 4100

    def boom(*a, **k):
        raise ValueError("odd")

    assert call(["a.png"], single=boom)[2] == "[UNEXPECTED_ERROR] odd\n"

    def batch(spark, path, out, settings, progress):
        progress({"type": "batch:file:error", "file_number": 1, "file_count": 2, "input_path": "/x/a.png", "error": {"code": "E"}})
        progress({"type": "input:complete", "sheet_count": 3, "batch": {"file_number": 2, "file_count": 2}})
        return {"summary": {"totals": {"discovered": 2, "succeeded": 1, "failed": 1}}, "summary_markdown_path": "m", "summary_json_path": "j", "has_failures": True}

    got, out, err = call(["dir"], folder=batch, look=lambda p: "directory")
    assert got == 1 and out == "(2 of 2) 3 sheets\n2 files, 1 done, 1 failed\nm\nj\n"
    assert err.startswith("1 of 2: a.png failed, E\n[BATCH_PARTIAL_FAILURE]")


# --- evaluation

def said(*left_out, pages=2, extra=""):
    """A document with all that the acceptance asks for, but for what is left out."""
    parts = {
        "title": "# 월간 품질 점검 보고서 QA-2026-0720 B-07 회색 워터마크 대비", "first": '<table><tr><th colspan="2">검사 구분</th></tr><tr><td rowspan="3">A-01</td><td>1</td></tr></table>', "heading": "# 설비 운영 현황",
        "second": "<table><tr><td rowspan='2'>OCR-1</td><td colspan=4>설비 점검 현황</td></tr></table>", "after": "## 운영 요약", "labels": "SCAN-2 TABLE-SIDE-TEXT", "one": "![f](assets/1.png)", "two": '<img src="assets/2.png">',
    }
    body = [v for k, v in parts.items() if k not in left_out]
    return "\n".join([*(f"<!-- page: {k} -->" for k in range(1, pages + 1)), *body, extra])


@pytest.mark.parametrize("actual, failed", [
    (said(), set()), (said(pages=3), {"twoPages"}), (said("first"), {"twoTables", "rowspanPreserved", "colspanPreserved"}), (said("two"), {"atLeastTwoFigureAssets"}),
    (said("after", extra=""), {"tableBeforeAdjacentText"}), (said(extra="s a m p l e"), {"watermarkSuppressed"}), (said(extra="stamped by Q"), {"watermarkSuppressed"}), (said(extra="z" * 200), {"textCerAtMost25Percent"}),
    (said("title", "heading", "labels"), {"textCerAtMost25Percent", "requiredMarkerRecallAtLeast80Percent"}),
])
def test_each_criterion_fails_for_its_own_reason(spark, tmp_path, actual, failed):
    from foliospark.evaluation import main

    paths = [write(tmp_path / n, text.encode()) for n, text in (("a.md", actual), ("e.md", said()), ("m.json", json.dumps({"watermark": {"text": "Stamped by Q"}})))] + [str(tmp_path / "new/report.json")]
    out, err = io.StringIO(), io.StringIO()
    assert main(paths, spark=spark, stdout=out, stderr=err) == (2 if failed else 0) and not err.getvalue()
    found = json.loads(out.getvalue())
    with open(paths[3], encoding="utf-8") as f:
        assert json.load(f) == found
    assert {k for k, v in found["criteria"].items() if not v} == failed and found["pass"] == (not failed) and found["schemaVersion"] == 1
    assert found["metrics"]["pageCount"] == actual.count("<!-- page") and found["metrics"]["tableCount"] == actual.count("<table")
    if "watermarkSuppressed" in failed:
        assert found["metrics"]["leakedWatermarks"] in (["SAMPLE"], ["Stamped by Q"])


def test_what_cannot_be_evaluated(spark, tmp_path):
    from foliospark.evaluation import main

    good = write(tmp_path / "a.md", b"a")
    for argv in ([good, good, good], [good, str(tmp_path / "gone"), good], [good] * 5):
        err = io.StringIO()
        assert main([*argv, str(tmp_path / "r.json")] if len(argv) < 4 else argv, spark=spark, stdout=io.StringIO(), stderr=err) == 1 and err.getvalue()


def test_empty_texts_and_wide_spans(spark):
    from foliospark.operators.evaluate import evaluated

    df = spark.createDataFrame([('<td rowspan="10">A-01</td>', ""), ("", ""), (None, "x")], "actual STRING, expected STRING")
    assert [r.metrics.characterErrorRate for r in evaluated(df).collect()] == [1.0, 0.0, None]
