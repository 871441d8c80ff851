import io
import os
import struct
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains, StringEndsWith

from foliospark.errors import FolioError
from foliospark.sinks import FileWriter, write_files
from foliospark.sources import docx as D
from foliospark.sources.store import Held, opened
from tests.test_sources import body, docx, rels

FILES = "path STRING, content BINARY, source_path STRING, extra INT"


def tree(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names}


# --- the sink


def test_files_come_all_together_and_replace_those_that_are_there(spark, tmp_path):
    out = tmp_path / "new" / "out"
    (tmp_path / "given.bin").write_bytes(b"copied")
    rows = [(f"d{i % 7}/p {i}/ü.md", f"text {i}".encode(), None, 1) for i in range(40)] + [("top.txt", b"top", None, 2), ("copy.bin", None, str(tmp_path / "given.bin"), 3), ("copy2.bin", None, f"file://{tmp_path}/given.bin", 3), ("empty", None, None, 4)]
    write_files(spark.createDataFrame(rows, FILES).repartition(5), f"file://{out}")
    want = {p: c for p, c, _, _ in rows} | {"copy.bin": b"copied", "copy2.bin": b"copied", "empty": b""}
    assert tree(out) == want and not [n for n in os.listdir(out) if n.startswith(".")]
    write_files(spark.createDataFrame([("top.txt", b"other", None, 0)], FILES), str(out))
    assert tree(out) == want | {"top.txt": b"other"}
    write_files(spark.createDataFrame([], FILES), str(out))
    assert tree(out) == want | {"top.txt": b"other"}


@pytest.mark.parametrize("path", ["../x", "/x", "a/../../x", "", None, "a//b", "a\\..\\b"])
def test_paths_out_of_the_folder_are_refused_and_leave_nothing(spark, tmp_path, path):
    rows = [(f"good{i}", b"x", None, 0) for i in range(8)] + [(path, b"x", None, 0)]
    with pytest.raises(Exception, match="not a path in the output"):
        write_files(spark.createDataFrame(rows, FILES).repartition(3), str(tmp_path / "out"))
    assert tree(tmp_path) == {}


def test_a_missing_source_fails_the_job_and_leaves_nothing(spark, tmp_path):
    rows = [("a", b"x", None, 0), ("b", None, str(tmp_path / "gone"), 0)]
    with pytest.raises(Exception):  # noqa: B017
        write_files(spark.createDataFrame(rows, FILES).repartition(2), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {}


def test_what_was_staged_and_is_gone_is_an_error(tmp_path):
    from foliospark.sinks import Staged

    with pytest.raises(FolioError):
        os.makedirs(tmp_path / "empty")
        FileWriter(str(tmp_path)).commit([None, Staged(str(tmp_path / "empty"), 3)])


RETRIES = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from foliospark.sinks import write_files
out, failures = sys.argv[1], int(sys.argv[2])
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", out + "-shared").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def flaky(batches):
    n = 0
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1)
            n += 1
            if n == 5 and TaskContext.get().partitionId() == 1 and TaskContext.get().attemptNumber() < failures:
                raise ValueError("lost")

rows = spark.range(0, 40, 1, 4).selectExpr("concat('f', id) AS path", "cast(repeat(cast(id AS string), 100000) AS binary) AS content", "cast(null AS string) AS source_path")
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
try:
    write_files(rows.mapInArrow(flaky, "path string, content binary, source_path string"), out)
    print("written")
except Exception as error:
    print("failed", "lost" in str(error))
"""


@pytest.mark.parametrize(("failures", "said", "files"), [(2, "written", 40), (9, "failed True", 0)])
def test_tasks_that_fail_leave_one_set_of_files_and_aborted_jobs_none(tmp_path, failures, said, files):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    out = tmp_path / "out"
    done = subprocess.run([sys.executable, "-c", RETRIES, str(out), str(failures)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert said in done.stdout, done.stdout + done.stderr[-3000:]
    found = tree(out)
    assert len(found) == files and all(c == n[1:].encode() * 100_000 for n, c in found.items())
    assert not out.exists() or not [n for n in os.listdir(out) if n.startswith(".")]


def test_stores_by_uri(tmp_path):
    for given in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        store, at = opened(given)
        assert store.type_name == "local" and at == str(tmp_path)
    store, at = opened("s3a://bucket/a/b?region=eu-west-1")
    assert (store.type_name, at) == ("s3", "bucket/a/b")
    assert Held(b"abcdef").at(4, 10) == b"ef"


# --- the source


def large_document(path, members, size):
    """A document with stored scans of ``size`` bytes each, which are holes in the file but for their first bytes."""
    ids = [f"rId{k}" for k in range(members)]
    fixed = {D.BODY: body(ids).encode(), D.LINKS: rels(*((i, f"media/image{k}.png") for k, i in enumerate(ids))).encode()}
    directory, count = b"", 0
    with open(path, "wb") as f:
        for name, data in [*fixed.items(), *((f"{D.MEDIA}image{k}.png", None) for k in range(members))]:
            n, at, raw = (len(data) if data is not None else size), f.tell(), name.encode()
            f.write(struct.pack("<4s5H3I2H", b"PK\x03\x04", 20, 0, 0, 0, 0, 0, n, n, len(raw), 0) + raw)
            start = f.tell()
            f.write(data if data is not None else b"scan %d" % count)
            f.seek(start + n)
            directory += struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 20, 20, 0, 0, 0, 0, 0, n, n, len(raw), 0, 0, 0, 0, 0, at) + raw
            count += data is None
        at = f.tell()
        f.write(directory + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, members + 2, members + 2, len(directory), at, 0))


def test_one_sheet_of_a_large_archive_costs_its_own_bytes(spark, tmp_path, monkeypatch):
    size = 4 << 20
    large_document(tmp_path / "large.docx", 256, size)
    (tmp_path / "small.docx").write_bytes(docx())
    opened_files = []

    class Counted(D.Ranges):
        def __init__(self, file):
            super().__init__(file)
            opened_files.append(self)

    monkeypatch.setattr(D, "Ranges", Counted)
    reader = D.ScanReader({"path": str(tmp_path)})
    kept = [StringContains(("name",), "x")]
    assert list(reader.pushFilters([EqualTo(("sheet_number",), 200), StringEndsWith(("doc_id",), "large.docx"), *kept])) == kept
    parts = reader.partitions()
    assert len(parts) == 9 and {p.path for p in parts} == {str(tmp_path / "large.docx")}  # 1 GB and a little, by 128 MB
    found = [r for p in parts for r in reader.read(p)]
    assert [(r[1], r[2], len(r[4]), r[4][:8]) for r in found] == [(200, "image199.png", size, b"scan 199")]
    overhead = [f.read for f in opened_files]
    assert sum(overhead) < size + 9 * 200_000 and max(overhead) < size + 200_000  # of 1,073 MB
    # through Spark, where the filter is pushed
    spark.dataSource.register(D.DocxSource)
    df = spark.read.format("docx_scans").load(str(tmp_path)).where("sheet_number = 2 AND doc_id LIKE '%docx'")
    got = sorted((os.path.basename(r.doc_id), r["name"], len(r.content)) for r in df.collect())
    assert got == [("large.docx", "image1.png", size), ("small.docx", "first.png", 5)]


def test_filters_choose_as_spark_would(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"d{k}.docx").write_bytes(b"broken" if k == 3 else docx())
    reader = D.ScanReader({"path": str(tmp_path), "partBytes": "300"})
    rows = lambda r: sorted((os.path.basename(x[0]), x[1], x[7] and x[7][0]) for p in r.partitions() for x in r.read(p))
    every = rows(reader)
    assert len(every) == 11 and ("d3.docx", 0, "INPUT_INVALID_ZIP") in every and len(reader.partitions()) > 6
    for f, keep in (
        (GreaterThan(("sheet_number",), 0), lambda r: r[1] > 0), (LessThanOrEqual(("sheet_number",), 1), lambda r: r[1] <= 1), (In(("sheet_number",), (0, 2)), lambda r: r[1] in (0, 2)),
        (In(("doc_id",), (str(tmp_path / "d3.docx"), str(tmp_path / "d5.docx"))), lambda r: r[0] in ("d3.docx", "d5.docx")), (EqualTo(("sheet_number",), 99), lambda r: False),
    ):
        own = D.ScanReader({"path": str(tmp_path)})
        assert list(own.pushFilters([f])) == [] and rows(own) == [r for r in every if keep(r)]


def test_a_broken_scan_is_a_row_and_the_others_go_on(tmp_path):
    data = docx()
    at = data.index(b"word/media/second.png") - 30
    raw = bytearray(data)
    raw[at : at + 4] = b"XXXX"
    (tmp_path / "a.docx").write_bytes(raw)
    reader = D.ScanReader({"path": str(tmp_path / "a.docx")})
    got = [(r[1], r[2], r[4], r[7] and r[7][0]) for p in reader.partitions() for r in reader.read(p)]
    assert got == [(1, "second.png", None, "INPUT_INVALID_ZIP"), (2, "first.png", b"FIRST", None)]


def test_a_member_is_inflated_to_its_size_and_no_further():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bomb", bytes(50_000_000))
        z.writestr("none", b"")
    raw = bytearray(out.getvalue())
    central = raw.index(b"PK\x01\x02")
    struct.pack_into("<I", raw, central + 24, 1000)
    archive = D.Archive(bytes(raw))
    assert archive.read("none") == b""
    with pytest.raises(FolioError, match="not the size"):
        archive.read("bomb")
