"""Documents out of a stream of pages: each when its last page has come, or as an error when it has not come in time."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliospark.functions import text as T
from foliospark.schemas import ERROR
from foliospark.session import prepare

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PAGE = f"page_number INT, markdown STRING, error {ERROR}"
_OUT = f"doc_id STRING, page_count INT, pages ARRAY<STRUCT<page_number: INT, markdown: STRING, error: {ERROR}>>, error {ERROR}"


class Assembler(StatefulProcessor):
    """State of a document: its pages so far, and once it is out only that it is, until its time-out. A page that comes again replaces itself."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getListState("pages", _PAGE)
        self.about = handle.getValueState("about", "page_count INT, out BOOLEAN")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        came = list(rows)
        about = self.about.get()
        if about is None:
            self.handle.registerTimer(int(min(r["seen_ms"] for r in came)) + self.timeout_ms)
        elif about[1]:
            return  # a page of a document that is out
        held = {p[0]: tuple(p) for p in self.pages.get()} if about is not None else {}
        fresh = {r["page_number"]: (r["page_number"], r["markdown"], r["error"]) for r in came}
        count = max(r["page_count"] for r in came) if about is None else max(about[0], *(r["page_count"] for r in came))
        every = held | fresh
        complete = len(every) >= count
        self.about.update((count, complete))
        if complete:
            if held:
                self.pages.clear()
            yield self._document(key[0], count, every, None)
        elif held:
            self.pages.put(list(every.values()))
        else:
            self.pages.appendList(list(every.values()))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        about = self.about.get()
        if about is not None and not about[1]:
            held = {p[0]: tuple(p) for p in self.pages.get()}
            yield self._document(key[0], about[0], held, ("OCR_ENGINE_TIMEOUT", f"{about[0] - len(held)} of {about[0]} pages have not come"))
        self.pages.clear()
        self.about.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _document(doc_id: str, count: int, pages: dict[int, tuple], late: tuple[str, str] | None) -> Row:
        found = [Row(page_number=p[0], markdown=p[1], error=p[2]) for _, p in sorted(pages.items())]
        error = late or next((tuple(p["error"]) for p in found if p["error"]), None)
        return Row(doc_id=doc_id, page_count=count, pages=[] if error else found, error=Row(code=error[0], message=error[1]) if error else None)


def _ready(spark: SparkSession) -> None:
    """State with timers needs a provider that has them; one that the session names is kept."""
    prepare(spark)
    if not spark._jsparkSession.sessionState().conf().contains(_PROVIDER):
        spark.conf.set(_PROVIDER, _ROCKS)


def assembled(pages: DataFrame, *, timeout: timedelta = timedelta(hours=1), late: str = "10 minutes") -> DataFrame:
    """A stream of (doc_id, page_count, markdown, error) from one of (doc_id, page_number, page_count, seen_at, markdown, error).

    A document is put out once all of its ``page_count`` pages are there, in any order and over any number of batches; a
    page with an error makes it a failed one. A document whose pages have not all come ``timeout`` after the first one was
    seen (by the watermark of ``seen_at``, which stays ``late`` behind; older pages are dropped) comes out with an error, once. Pages that come
    again, also after that, change nothing for as long. State survives restarts from the query's checkpoint.
    """
    _ready(pages.sparkSession)
    ms = int(timeout / timedelta(milliseconds=1))
    keyed = pages.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), F.col("page_count").cast("int").alias("page_count"), "seen_at", F.unix_millis("seen_at").alias("seen_ms"), "markdown", F.col("error").cast(ERROR).alias("error"))
    done = keyed.withWatermark("seen_at", late).groupBy("doc_id").transformWithState(Assembler(ms), _OUT, "Append", "EventTime")
    page = lambda p: F.concat(F.lit("<!-- page: "), p["page_number"].cast("string"), F.lit(" -->\n\n"), T.normalize_markdown(p["markdown"]))
    markdown = F.concat(F.array_join(F.transform("pages", page), "\n\n---\n\n"), F.lit("\n"))
    return done.select("doc_id", "page_count", F.when(F.col("error").isNull(), markdown).alias("markdown"), "error")
