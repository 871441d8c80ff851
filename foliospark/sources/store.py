"""Stores that Python opens by URI."""

from __future__ import annotations

import os
import re

import pyarrow.fs


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path or URI, and the path in it. ``s3a`` and ``s3n``, as Spark names them, are ``s3``; ``file:/x`` is local."""
    local = re.fullmatch(r"file:(?://)?(/.*)", path)
    if local or "://" not in path:
        return pyarrow.fs.LocalFileSystem(), os.path.abspath(local[1] if local else path)
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


class Ranges:
    """Parts of an open file by place, and how many bytes were read of it."""

    def __init__(self, file: pyarrow.NativeFile) -> None:
        self.file, self.size, self.read = file, file.size(), 0

    def at(self, offset: int, n: int) -> bytes:
        got = self.file.read_at(max(0, min(n, self.size - offset)), offset) if offset < self.size else b""
        self.read += len(got)
        return got


class Held:
    """The same of bytes in memory."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def at(self, offset: int, n: int) -> bytes:
        return self.data[offset : offset + n]
