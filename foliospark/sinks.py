"""Files as a sink with a commit: ``df.write.format("file_rows").mode("append").save(folder)``.

Each row is a file. Tasks write to a staging folder of their own attempt, so an attempt that fails leaves nothing that
counts; when the job commits, the files of the attempts that did the work are moved to their places, and when it is
aborted, all that was staged goes. A file that is there already is replaced.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from foliospark.errors import FolioError
from foliospark.session import prepare
from foliospark.sources.store import opened

COLUMNS = "path STRING, content BINARY, source_path STRING"
_MOVERS = 16
_CHUNK = 8 << 20


@dataclass
class Staged(WriterCommitMessage):
    folder: str | None  # in the store; None of a task without rows
    files: int


def _checked(path: str | None) -> str:
    steps = (path or "").replace("\\", "/").split("/")
    if not path or steps[0] == "" or any(s in ("", ".", "..") for s in steps):
        raise FolioError("OCR_UNSAFE_ASSET_PATH", f"not a path in the output: {path}")
    return "/".join(steps)


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.job = folder, uuid.uuid4().hex

    def _root(self) -> tuple[pyarrow.fs.FileSystem, str, str]:
        store, base = opened(self.folder)
        return store, base, posixpath.join(base, f".staging-{self.job}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        store, _, staging = self._root()
        task = TaskContext.get()
        own = posixpath.join(staging, f"{task.partitionId()}-{task.taskAttemptId()}")
        made: set[str] = set()
        files = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("path", "content", "source_path")]
            for k in range(batch.num_rows):
                path, content, source = (c[k] for c in columns)  # one file is in memory at a time
                target = posixpath.join(own, _checked(path.as_py()))
                self._make(store, staging, posixpath.dirname(target), made)
                with store.open_output_stream(target) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                    elif source.is_valid:
                        there, at = opened(source.as_py())
                        with there.open_input_stream(at) as given:
                            while block := given.read(_CHUNK):
                                out.write(block)
                files += 1
        return Staged(own if files else None, files)

    @staticmethod
    def _make(store: pyarrow.fs.FileSystem, staging: str, folder: str, made: set[str]) -> None:
        """A folder below the staging folder, step by step, so that a task that goes on after the job's abort cannot bring that back."""
        if folder not in made and folder != staging:
            FileWriter._make(store, staging, posixpath.dirname(folder), made)
            store.create_dir(folder, recursive=False)
            made.add(folder)

    def begin(self) -> FileWriter:
        store, _, staging = self._root()
        store.create_dir(staging, recursive=True)
        return self

    def commit(self, messages: list[Staged | None]) -> None:
        """Moves what was staged, attempt by attempt; only one attempt's list of files is held at a time."""
        store, base, staging = self._root()
        with ThreadPoolExecutor(_MOVERS) as pool:
            for m in messages:
                if m is None or m.folder is None:
                    continue
                found = [f.path for f in store.get_file_info(pyarrow.fs.FileSelector(m.folder, recursive=True)) if f.is_file]
                if not found:
                    raise FolioError("UNEXPECTED_ERROR", f"what a task has staged is gone: {m.folder}")
                targets = [posixpath.join(base, posixpath.relpath(f, m.folder)) for f in found]
                for folder in sorted({posixpath.dirname(t) for t in targets}):
                    store.create_dir(folder, recursive=True)
                list(pool.map(store.move, found, targets))
        self._clear(store, staging)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _, staging = self._root()
        self._clear(store, staging)

    @staticmethod
    def _clear(store: pyarrow.fs.FileSystem, staging: str) -> None:
        for tries in range(10, 0, -1):  # tasks that are being stopped may still put files there
            try:
                if store.get_file_info(staging).type != pyarrow.fs.FileType.NotFound:
                    store.delete_dir(staging)
                return
            except OSError:
                if tries == 1:
                    raise
                time.sleep(0.2)


class FileSink(DataSource):
    """``file_rows``: rows (path, content, source_path), one a file; without content the file at ``source_path`` is copied."""

    @classmethod
    def name(cls) -> str:
        return "file_rows"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise FolioError("UNEXPECTED_ERROR", "a folder is added to, not replaced: use mode append")
        return FileWriter(dict(self.options)["path"]).begin()


def write_files(files: DataFrame, folder: str) -> None:
    """Writes each row of (path, content, source_path) under ``folder``, all of them or none.

    Paths are relative and stay inside; of rows with one path any one wins. Null content and source: an empty file.
    """
    spark = prepare(files.sparkSession)
    spark.dataSource.register(FileSink)
    files.select("path", "content", "source_path").write.format("file_rows").mode("append").save(folder)
