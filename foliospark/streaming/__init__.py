"""Folders that fill up: new files through the same stages, each once."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from foliospark.operators.codecs import decode_image
from foliospark.pipeline import Codec, Settings, final_pages
from foliospark.recognize import Recognizer
from foliospark.session import scope
from foliospark.sources.loader import BINARY_FILE, sheets
from foliospark.sources.pdf import PdfRenderer


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that come into a folder."""
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).load(folder)


class Reporter(StreamingQueryListener):
    """Says what each batch of one query has observed."""

    def __init__(self, spark: SparkSession, say: Callable[[dict[str, Any]], None]) -> None:
        self.spark, self.say, self.query = spark, say, ""

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        if event.name == self.query:
            self.say({"type": "stream:start"})

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get("files")
        if event.progress.name == self.query and seen is not None:
            self.say({"type": "stream:batch", "batch": event.progress.batchId, **seen.asDict()})

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        pass


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, recognizer: Recognizer, settings: Settings = Settings(), *, pdf: PdfRenderer | None = None, codec: Codec = decode_image, each: Callable[[DataFrame, int], None] | None = None, progress: Callable[[dict[str, Any]], None] | None = None) -> StreamingQuery:
    """Converts all files that are there and not yet done, and stops; pages are appended to Parquet at ``out``.

    A batch that runs again after a failure replaces its own part, so pages are written once. ``progress`` is told of each
    batch's files and bytes, which are observed on their way: nothing is read or counted for it.
    """

    def write(batch: DataFrame, number: int) -> None:
        with scope(batch.sparkSession):  # a batch's intermediates go with it
            pages = final_pages(sheets(batch.select("path", "content"), pdf), recognizer, settings, codec)
            pages.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if each:
            each(batch, number)

    stream, name = watch(spark, folder), f"ingest-{uuid.uuid4().hex}"
    if progress:
        reporter = Reporter(spark, progress)
        reporter.query = name
        spark.streams.addListener(reporter)
        stream = stream.observe("files", F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    return stream.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
