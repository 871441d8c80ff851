import datetime as dt
import os

import pytest

from foliospark.streaming.assemble import assembled

PAGES = "doc_id STRING, page_number INT, page_count INT, seen_at TIMESTAMP, markdown STRING, error STRUCT<code: STRING, message: STRING>"


def at(minutes):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minutes)


@pytest.fixture
def stream(spark, tmp_path):
    """Each call adds a file of pages, starts the query anew on the same checkpoint, and gives what it has put out since."""
    (tmp_path / "in").mkdir()
    seen = set()
    count = [0]

    def add(rows):
        count[0] += 1
        staged = tmp_path / f"staged{count[0]}"
        spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(f"file://{staged}")
        (part,) = [n for n in os.listdir(staged) if n.endswith(".parquet")]
        os.rename(staged / part, tmp_path / "in" / f"{count[0]:03d}.parquet")
        pages = spark.readStream.schema(PAGES).parquet(f"file://{tmp_path}/in")
        query = assembled(pages, timeout=dt.timedelta(minutes=30)).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        every = {(r.doc_id, r.page_count, r.markdown, r.error and r.error.code) for r in spark.read.schema("doc_id STRING, page_count INT, markdown STRING, error STRUCT<code: STRING, message: STRING>").parquet(f"file://{tmp_path}/out").collect()}
        new = every - seen
        assert len(every) == len(seen) + len(new)
        seen.update(new)
        return sorted(new)

    return add


def text(*pages):
    return "\n\n---\n\n".join(f"<!-- page: {n} -->\n\n{t}" for n, t in pages) + "\n"


def test_pages_in_any_order_over_batches_and_restarts(stream):
    assert stream([("a", 2, 3, at(0), "a2", None), ("b", 1, 1, at(0), "b1\r\n", None), ("c", 1, 2, at(1), "c1", None), ("d", 2, 2, at(1), None, ("OCR_ENGINE_FAILED", "black"))]) == [("b", 1, text((1, "b1")), None)]
    assert stream([("a", 3, 3, at(2), "a3", None), ("a", 2, 3, at(2), "a2 again", None), ("b", 1, 1, at(2), "late copy", None)]) == []
    assert stream([("a", 1, 3, at(3), "a1", None), ("d", 1, 2, at(3), "d1", None)]) == [("a", 3, text((1, "a1"), (2, "a2 again"), (3, "a3")), None), ("d", 2, None, "OCR_ENGINE_FAILED")]
    # half an hour after its first page was seen, c comes out as an error
    assert stream([("e", 1, 1, at(90), "e1", None)]) == [("c", 2, None, "OCR_ENGINE_TIMEOUT"), ("e", 1, text((1, "e1")), None)]
    assert stream([("e", 1, 1, at(91), "e1", None)]) == []


def test_batches_of_files_are_reported_as_observed(spark, tmp_path):
    import time

    from foliospark.streaming import ingest
    from tests.test_pipeline import Fake, scan, write

    (tmp_path / "in").mkdir()
    sizes = [os.path.getsize(write(tmp_path / "in" / n, scan(w, 60))) for n, w in (("a.png", 50), ("b.png", 55))]
    events = []
    ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck", Fake(), progress=events.append).awaitTermination()
    for _ in range(100):
        if any(e["type"] == "stream:batch" for e in events):
            break
        time.sleep(0.1)
    assert {"type": "stream:batch", "batch": 0, "files": 2, "bytes": sum(sizes)} in events
