import io
import json
import os
import struct
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.errors import FolioError
from foliospark.recognize import ProcessRecognizer
from foliospark.sources import docx as D
from foliospark.sources import loader as LD
from foliospark.sources import pdf as PD
from foliospark.sources import sidecars as SC


def code(f, *args, **kw):
    with pytest.raises(FolioError) as e:
        f(*args, **kw)
    return e.value.code


def rels(*pairs, extra=""):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="http://x/image" Target="{t}"/>' for i, t in pairs) + extra + "</Relationships>"


NAMES = 'xmlns:w="urn:w" xmlns:a="urn:a" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def body(ids):
    return f"<w:document {NAMES}><w:body>" + "".join(f'<w:p><a:blip r:embed="{i}"/></w:p>' for i in ids) + "</w:body></w:document>"


def docx(ids=("rId2", "rId1"), links=None, media=(("first.png", b"FIRST"), ("second.png", b"SECOND")), **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(D.BODY, body(ids))
        z.writestr(D.LINKS, links or rels(("rId1", "media/first.png"), ("rId2", "media/second.png")))
        for n, c in media:
            z.writestr(D.MEDIA + n, c)
        for n, c in parts.items():
            z.writestr(n, c)
    return out.getvalue()


def names(data):
    return [n for n, _, _ in D.scans(data)]


def test_scans_in_reading_order():
    assert [(n, c) for n, _, c in D.scans(docx(), "s.docx")] == [("second.png", b"SECOND"), ("first.png", b"FIRST")]
    assert names(docx(("rId1", "rId1"))) == ["first.png", "first.png"]
    assert names(docx(("rId9", "rId1"))) == ["first.png"]
    assert names(docx((), media=[(n, b"x") for n in ("image10.png", "image2.PNG", "note.txt")])) == ["image2.PNG", "image10.png"]


def test_documents_that_are_refused():
    assert code(D.scans, b"not-a-zip") == "INPUT_INVALID_ZIP"
    assert code(D.scans, docx((), media=())) == "INPUT_NO_IMAGES"
    assert code(D.scans, docx(("rId1",), rels(("rId1", "media/gone.png")))) == "INPUT_IMAGE_MISSING"
    assert code(D.scans, docx(("rId1",), rels(("rId1", "../../etc/x.png")))) == "INPUT_UNSAFE_RELATIONSHIP"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../x", "y")
    assert code(D.Archive, out.getvalue()) == "INPUT_UNSAFE_ZIP_PATH"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("other", "y")
    assert code(D.scans, out.getvalue()) == "INPUT_INVALID_DOCX"


def test_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"abc" * 100)
    data = out.getvalue()
    assert D.Archive(data).read("a") == b"abc" * 100 and code(D.Archive(data).read, "b") == "INPUT_ZIP_ENTRY_MISSING"
    central, end = data.index(b"PK\x01\x02"), data.index(b"PK\x05\x06")

    def patched(at, kind, value):
        raw = bytearray(data)
        struct.pack_into(kind, raw, at, value)
        return bytes(raw)

    assert code(D.Archive, patched(end + 10, "<H", 0xFFFF)) == "INPUT_UNSUPPORTED_ZIP64"
    assert code(D.Archive, patched(central, "<I", 1)) == "INPUT_INVALID_ZIP"
    assert code(D.Archive(patched(central + 8, "<H", 1)).read, "a") == "INPUT_ENCRYPTED_ZIP"
    assert code(D.Archive(patched(central + 10, "<H", 9)).read, "a") == "INPUT_UNSUPPORTED_ZIP_METHOD"
    assert code(D.Archive(patched(central + 24, "<I", 5)).read, "a") == "INPUT_INVALID_ZIP"
    assert code(D.Archive(patched(0, "<I", 5)).read, "a") == "INPUT_INVALID_ZIP"
    assert D.Archive(patched(central + 16, "<I", 0)).read("a") == b"abc" * 100  # checksums are not looked at


def test_relationships_by_namespace():
    external = '<Relationship Id="e" Type="t/image" Target="http://x" TargetMode="EXTERNAL"/><Relationship Id="h" Type="t/hyperlink" Target="y"/>'
    assert D.Links(rels(("a", "m/1.png"), ("a", "m/&amp;2.png"), extra=external).encode()).member == {"a": "m/&2.png"}
    other = f'<w:document {NAMES} xmlns:z="http://purl.oclc.org/ooxml/officeDocument/relationships" xmlns:q="urn:q"><w:x z:id="1" q:embed="no" id="no"/><a:y r:embed="2&amp;" r:link="no"/></w:document>'
    assert D.references(other.encode("utf-16")) == ["1", "2&"]
    links = D.Links(rels(("up", "media/../media/./a.png"), ("out", "../a.png"), ("deep", "x/../../a.png"), ("none", "./"), ("back", "media\\\\b.png")).encode())
    assert links.path("up") == "word/media/a.png" and links.path("back") == "word/media/b.png"
    assert [code(links.path, k) for k in ("out", "deep", "none")] == ["INPUT_UNSAFE_RELATIONSHIP"] * 3
    for broken in (b"", b"<a><b></a>", b"<w:x/>", b"text"):
        assert code(D.references, broken) == "INPUT_INVALID_DOCX"


def test_relational_form_of_references(spark):
    body = "".join(f'<a:blip r:embed="{i}"/>' for i in ("r2", "r9", "r1", "r2"))
    xml = spark.createDataFrame([("d", body, rels(("r1", "m/a&amp;b.png"), ("r2", "m/old.png"), ("r2", "m/2.png"), ("e", "x"))), ("empty", "", "")], "doc_id STRING, body_xml STRING, rels_xml STRING")
    links = LD.relationships(xml.select("doc_id", "rels_xml"))
    assert {(r.rel_id, r.target) for r in links.collect()} == {("r1", "m/a&b.png"), ("r2", "m/2.png"), ("e", "x")}
    found = LD.sheet_references(xml.select("doc_id", "body_xml"), links)
    assert [(r.sheet_number, r.target) for r in found.orderBy("sheet_number").collect()] == [(1, "m/2.png"), (2, "m/a&b.png"), (3, "m/2.png")]


class FakeRenderer:
    def pages(self, path, folder=None):
        assert os.path.exists(path)
        return [("page-0001.png", b"1"), ("page-0002.png", b"2")]


def test_sheets_of_any_input(spark, tmp_path):
    for name, content in (("a.docx", docx()), ("b.PNG", b"image"), ("c.pdf", b"%PDF"), ("d.txt", b"x"), ("e.docx", b"broken")):
        (tmp_path / name).write_bytes(content)
    files = LD.files(spark, f"file://{tmp_path}")
    got = {}
    for r in LD.sheets(files, FakeRenderer()).collect():
        got.setdefault(os.path.basename(r.doc_id), []).append((r.sheet_number, r["name"], r.page_layout, r.pdf_page_number, r.error and r.error.code))
    assert {k: sorted(v) for k, v in got.items()} == {
        "a.docx": [(1, "second.png", None, None, None), (2, "first.png", None, None, None)],
        "b.PNG": [(1, "b.PNG", None, None, None)],
        "c.pdf": [(1, "page-0001.png", "single", 1, None), (2, "page-0002.png", "single", 2, None)],
        "d.txt": [(0, None, None, None, "INPUT_UNSUPPORTED_TYPE")],
        "e.docx": [(0, None, None, None, "INPUT_INVALID_ZIP")],
    }
    assert [r.error.code for r in LD.sheets(files.where("path like '%pdf'")).collect()] == ["PDF_RENDERER_UNAVAILABLE"]
    assert LD.sheets(files.where("false")).collect() == []
    kinds = files.select(F.col("path"), LD.kind_of(F.col("path")).alias("k")).collect()
    assert sorted(r.k for r in kinds) == ["docx", "docx", "image", "other", "pdf"]
    spark.dataSource.register(D.DocxSource)
    own = spark.read.format("docx_scans").load(str(tmp_path))
    assert [(r.sheet_number, r["name"], r.error and r.error.code) for r in own.orderBy("doc_id", "sheet_number").collect()] == [(1, "second.png", None), (2, "first.png", None), (0, None, "INPUT_INVALID_ZIP")]


def test_folders(tmp_path):
    for n in ("zeta.PNG", "alpha.png", "alpha.jpg", "ignore.txt"):
        (tmp_path / n).write_bytes(b"")
    (tmp_path / "sub.png").mkdir()
    assert [os.path.basename(f) for f in LD.image_files(str(tmp_path))] == ["alpha.jpg", "alpha.png", "zeta.PNG"]
    assert code(LD.image_files, str(tmp_path / "sub.png")) == "INPUT_NO_IMAGES" and code(LD.image_files, str(tmp_path / "no")) == "INPUT_READ_FAILED"
    assert LD.inspect(str(tmp_path)) == "directory" and LD.inspect(str(tmp_path / "alpha.png")) == "file" and code(LD.inspect, str(tmp_path / "no")) == "INPUT_READ_FAILED"


def test_processes(tmp_path):
    done = PD.run_process(sys.executable, ["-c", "import sys; print('out'); print('err', file=sys.stderr)"])
    assert (done.exit_code, done.stdout.strip(), done.stderr.strip()) == (0, "out", "err")
    assert code(PD.run_process, "/no/such/program", []) == "OCR_ENGINE_NOT_FOUND"
    assert code(PD.run_process, str(tmp_path), []) == "OCR_ENGINE_START_FAILED"
    assert code(PD.run_process, sys.executable, ["-c", "import time; time.sleep(9)"], timeout=0.2) == "OCR_ENGINE_TIMEOUT"
    with pytest.raises(FolioError) as e:
        PD.run_process(sys.executable, ["-c", "import sys; sys.exit('bad')"])
    assert e.value.code == "OCR_ENGINE_FAILED" and e.value.details["exit_code"] == 1 and "bad" in e.value.details["stderr"]


def test_pdf_renderer(tmp_path):
    seen = []

    def runner(command, args, *, cwd, timeout):
        seen.append((command, args, timeout))
        for n in ("page-0002.png", "page-0001.png", "other.png"):
            with open(os.path.join(args[args.index("--output") + 1], n), "wb") as f:
                f.write(n.encode())

    pages = PD.PdfRenderer("py", "render.py", runner=runner).pages("in.pdf", str(tmp_path / "p"))
    assert [n for n, _ in pages] == ["page-0001.png", "page-0002.png"] and seen[0][1] == ["render.py", "--input", "in.pdf", "--output", str(tmp_path / "p"), "--dpi", "300"] and seen[0][2] == 600
    assert code(PD.PdfRenderer(runner=lambda *a, **k: None).pages, "in.pdf") == "PDF_NO_PAGES"

    def failing(of):
        def run(*a, **k):
            raise FolioError(of)

        return run

    for of, want in {**PD.ERRORS, "OCR_ENGINE_FAILED": "PDF_RENDER_FAILED"}.items():
        assert code(PD.PdfRenderer(runner=failing(of)).pages, "in.pdf") == want
    with pytest.raises(ValueError):
        PD.PdfRenderer(dpi=20)


RAW = {"overall_ocr_res": {"rec_texts": ["a", None, "c", "d"], "rec_boxes": [[0, 0, 1, 1], [0, 0, 1, 1], [0, 0, 1], [1, 2, 3, 4]], "rec_scores": [0.5]}, "fallback_ocr_res": {"rec_texts": ["f"], "rec_boxes": [[1, 1, 2, 2]]}}
STRUCTURE = {"res": {"parsing_res_list": [{"block_label": "text", "block_content": "t", "block_bbox": [0, 0, 9, 9]}, {"block_label": "x", "block_content": None, "block_bbox": [0, 0, 9, 9]}], "table_res_list": [{"cell_box_list": [[0, 0, 1, 1], [0]]}, {}, {"cell_box_list": [[2, 2, 3, 3]]}]}}


def recorded(folder):
    (folder / "imgs").mkdir(parents=True)
    (folder / "imgs/one two.png").write_bytes(b"IMG")
    (folder / "page.md").write_text('x ![도면](imgs/one%20two.png) <img src="imgs/one%20two.png"> ![w](http://a/b.png)', encoding="utf-8")
    (folder / "raw_ocr.json").write_text(json.dumps(RAW))
    (folder / "page_res.json").write_text(json.dumps(STRUCTURE))
    return folder


def test_sidecar_folders(tmp_path):
    got = SC.read_folder(str(recorded(tmp_path / "p")))
    assert got["raw_lines"] == [{"text": "a", "box": [0.0, 0.0, 1.0, 1.0], "score": 0.5}, {"text": "d", "box": [1.0, 2.0, 3.0, 4.0], "score": None}]
    assert [x["text"] for x in got["fallback_lines"]] == ["f"] and [b["content"] for b in got["structure_blocks"]] == ["t"] and got["table_cell_boxes"] == [[0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]]
    assert got["assets"] == [{"reference": "imgs/one%20two.png", "source_path": str(tmp_path / "p/imgs/one two.png")}]
    assert SC.read_folder(str(tmp_path / "p"), recovery=False)["raw_lines"] == []
    (tmp_path / "p/second.md").write_text("")
    assert code(SC.read_folder, str(tmp_path / "p")) == "OCR_MARKDOWN_NOT_FOUND"
    at = str(tmp_path / "p/page.md")
    assert code(SC.assets, "![x](../../up.png)", at, str(tmp_path / "p")) == "OCR_UNSAFE_ASSET_PATH" and code(SC.assets, "![x](gone.png)", at, str(tmp_path / "p")) == "OCR_ASSET_MISSING"


def test_sidecar_tables(spark):
    rows = [(1, 0, "bad.json", "{"), (1, 1, "page_res.json", json.dumps(STRUCTURE)), (1, 2, "RAW_OCR.json", json.dumps(RAW)), (2, 0, "a.json", "{}"), (3, 0, "b.json", json.dumps({"res": RAW}))]
    files = spark.createDataFrame(rows, "page INT, walk_index INT, name STRING, json STRING")
    lines = {r.page: r for r in SC.text_lines(files, ["page"]).collect()}
    assert set(lines) == {1, 3} and [(x.text, x.score) for x in lines[1].raw_lines] == [("a", 0.5), ("d", None)] and [x.text for x in lines[1].fallback_lines] == ["f"]
    found = {r.page: r for r in SC.structure(files.where("name <> 'bad.json'"), ["page"]).collect()}
    assert [b.content for b in found[1].structure_blocks] == ["t"] and found[1].table_cell_boxes == [[0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]] and found[2].structure_blocks == []
    assert SC.structure(files, ["page"]).where("page = 1").first().structure_blocks == []  # the first file is broken


def test_process_recognizer():
    calls = []

    def runner(command, args, *, cwd, timeout):
        calls.append(args)
        with open(os.path.join(cwd, "page.md"), "w") as f:
            f.write("text")
        with open(os.path.join(cwd, "raw_ocr.json"), "w") as f:
            json.dump(RAW, f)
        return PD.Finished(0, "", " warned ")

    page = {"page_png": b"p", "recovery_png": b"r"}
    got = ProcessRecognizer("py", ("bridge.py",), recovery=True, runner=runner).recognize(page)
    assert got["markdown"] == "text" and got["warnings"] == ["warned"] and len(got["raw_lines"]) == 2 and got["engine"]["recognition_model"] == "korean_PP-OCRv5_mobile_rec"
    args = calls[0]
    assert args[:2] == ["bridge.py", "pp_structurev3"] and args[args.index("--raw_ocr_input") + 1].endswith("raw-input.png") and args[args.index("--use_formula_recognition") + 1] == "False"
    stock = ProcessRecognizer(runner=runner, bridge=False).build("i.png", "o")
    assert "--save_raw_ocr" not in stock and "--raw_ocr_input" not in stock


class Models:
    loaded = 0

    def __init__(self, common, structure):
        type(self).loaded += 1
        self.seen = []
        assert common["device"] == "cpu" and structure["use_table_recognition"] and "use_chart_recognition" not in structure

    def lines(self, image):
        self.seen.append(image)
        return [{"res": {"rec_texts": [os.path.basename(image)], "rec_boxes": [[0, 0, 1, 1]], "rec_scores": [1]}}, {"rec_texts": ["b"], "rec_boxes": [[0, 0, 1, 1]], "rec_scores": [0.5]}]

    def pages(self, image, **options):
        assert options == {"use_doc_orientation_classify": True, "use_doc_unwarping": True, "use_chart_recognition": False}
        with open(image, "rb") as f:
            if f.read() == b"bad":
                raise ValueError("no page")
        yield self

    def save_to_markdown(self, folder):
        with open(os.path.join(folder, "page.md"), "w") as f:
            f.write(f"read by {os.getpid()}")

    def save_to_json(self, folder):
        with open(os.path.join(folder, "page_res.json"), "w") as f:
            f.write("{}")


def test_a_worker_answers_each_line_and_keeps_its_models(tmp_path):
    from foliospark import recognition_worker as RW
    from foliospark.recognize import FLAGS, PAGE_FLAGS

    (tmp_path / "i.png").write_bytes(b"good")
    (tmp_path / "bad.png").write_bytes(b"bad")
    request = lambda name, **more: json.dumps({"image": str(tmp_path / name), "folder": str(tmp_path / "out"), "common": {"device": "cpu"}, "structure": {k: v for k, v in FLAGS.items() if k not in PAGE_FLAGS}, "page": {k: FLAGS[k] for k in PAGE_FLAGS}, **more})
    out, Models.loaded = io.StringIO(), 0
    RW.serve([request("i.png", recovery=str(tmp_path / "raw.png")), request("bad.png"), "no json", request("i.png")], out, Models)
    assert [json.loads(x).get("error", "").split(":")[0] for x in out.getvalue().splitlines()] == ["", "ValueError", "JSONDecodeError", ""] and Models.loaded == 1
    raw = json.loads((tmp_path / "out/raw_ocr.json").read_text())
    assert {k: v["rec_texts"] for k, v in raw.items()} == {"overall_ocr_res": ["raw.png", "b"], "fallback_ocr_res": ["i.png", "b"]}
    RW.serve([request("i.png", recovery=str(tmp_path / "i.png"))], out, Models)
    assert json.loads((tmp_path / "out/raw_ocr.json").read_text())["fallback_ocr_res"]["rec_texts"] == []


PROGRAM = """
import os, sys, time
sys.path[:0] = [{root!r}]
from foliospark import recognition_worker as RW
from tests.test_sources import Models
class Slow(Models):
    def pages(self, image, **options):
        with open(image, "rb") as f:
            content = f.read()
        if content == b"slow":
            time.sleep(60)
        if content == b"end":
            os._exit(3)
        return super().pages(image, **options)
RW.serve(sys.stdin, sys.stdout, Slow)
"""


def test_a_kept_program_reads_many_pages_and_is_started_anew(spark, tmp_path):
    from foliospark.pipeline import Settings, default_recognizer
    from foliospark.recognize import WorkerRecognizer, recognized

    assert default_recognizer(Settings(paddle_python="/venv/python")).arguments[0].endswith("recognition_worker.py") and default_recognizer(Settings()).arguments == ()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "program.py").write_text(PROGRAM.format(root=root))
    recognizer = WorkerRecognizer(sys.executable, (str(tmp_path / "program.py"),), recovery=True, timeout=8)
    rows = [("d", k, data, None, 10, 10, None) for k, data in enumerate([b"good", b"good", b"bad", b"good", b"slow", b"good", b"end", b"good"])]
    pages = spark.createDataFrame(rows, "doc_id STRING, page_number INT, page_png BINARY, recovery_png BINARY, page_width INT, recovery_width INT, error STRUCT<code: STRING, message: STRING>").coalesce(1)
    got = {r.page_number: r for r in recognized(pages, recognizer).collect()}
    assert [got[k].error and got[k].error.code for k in range(8)] == [None, None, "OCR_ENGINE_FAILED", None, "OCR_ENGINE_TIMEOUT", None, "OCR_ENGINE_FAILED", None]
    assert len({got[k].markdown for k in (0, 1, 3)}) == 1 and len({got[k].markdown for k in (0, 5, 7)}) == 3  # one process for all, and one more after each failure
    assert len(got[0].raw_lines) == 2 and got[2].error.message == "ValueError: no page"
    with pytest.raises(FolioError) as e:
        WorkerRecognizer("/no/such/program").recognize({"page_png": b"x"})
    assert e.value.code == "OCR_ENGINE_NOT_FOUND"

