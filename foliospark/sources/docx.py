"""Word-processor files whose pages are embedded scans."""

from __future__ import annotations

import operator
import posixpath
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple
from xml.parsers import expat

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from foliospark.errors import FolioError, as_folio_error, summary
from foliospark.functions.pure import natural_key
from foliospark.schemas import SHEETS
from foliospark.sources.store import Held, Ranges, opened

BODY, LINKS, MEDIA = "word/document.xml", "word/_rels/document.xml.rels", "word/media/"
IMAGES = frozenset((".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp"))
RELATIONS = "/relationships"  # how the namespace of relationship ids ends, in either edition of the format


class Entry(NamedTuple):
    flags: int
    method: int
    packed: int
    size: int
    header: int


_TAIL = 65557  # of a file: the end record with the longest comment


class Archive:
    """A ZIP archive, members by name in directory order; a name that comes again replaces the first.

    Only the end record, the directory and the members asked for are read. Sizes are taken from the directory and
    checked, checksums are not; a member is inflated to its size and no further. ZIP64 and encryption are refused.
    """

    def __init__(self, data: bytes | Ranges) -> None:
        self.file = Held(data) if isinstance(data, bytes) else data
        tail_at = max(0, self.file.size - _TAIL)
        tail = self.file.at(tail_at, _TAIL)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0 or end + 22 > len(tail):
            raise FolioError("INPUT_INVALID_ZIP", "no end of the central directory")
        count, size, at = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or at == 0xFFFFFFFF:
            raise FolioError("INPUT_UNSUPPORTED_ZIP64", "ZIP64 is not supported")
        if at + size > tail_at + end:
            raise FolioError("INPUT_INVALID_ZIP", "broken central directory")
        directory, at = self.file.at(at, size), 0
        self.entries: dict[str, Entry] = {}
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02" or at + 46 > len(directory):
                raise FolioError("INPUT_INVALID_ZIP", "broken central directory")
            flags, method, _, _, _, packed, size, name, extra, note, _, _, _, header = struct.unpack_from("<4H3I5H2I", directory, at + 8)
            self.entries[self.safe(directory[at + 46 : at + 46 + name].decode("utf-8" if flags & 0x800 else "latin-1", "replace"))] = Entry(flags, method, packed, size, header)
            at += 46 + name + extra + note

    @staticmethod
    def safe(name: str) -> str:
        name = name.replace("\\", "/")
        if name.startswith("/") or ".." in name.split("/"):
            raise FolioError("INPUT_UNSAFE_ZIP_PATH", f"a path out of the archive: {name}")
        return name

    def read(self, name: str) -> bytes:
        entry = self.entries.get(name)
        if entry is None:
            raise FolioError("INPUT_ZIP_ENTRY_MISSING", f"no such entry: {name}")
        if entry.flags & 1:
            raise FolioError("INPUT_ENCRYPTED_ZIP", f"encrypted entry: {name}")
        head = self.file.at(entry.header, 30)
        if head[:4] != b"PK\x03\x04" or len(head) < 30:
            raise FolioError("INPUT_INVALID_ZIP", f"broken local header: {name}")
        packed = self.file.at(entry.header + 30 + sum(struct.unpack_from("<HH", head, 26)), entry.packed)
        if len(packed) < entry.packed:
            raise FolioError("INPUT_INVALID_ZIP", f"the archive breaks off in {name}")
        if entry.method not in (0, 8):
            raise FolioError("INPUT_UNSUPPORTED_ZIP_METHOD", f"method {entry.method}: {name}")
        try:
            out = packed if entry.method == 0 else zlib.decompressobj(-15).decompress(packed, entry.size + 1)  # at least one byte: 0 would be no bound
        except zlib.error as error:
            raise FolioError("INPUT_INVALID_ZIP", f"broken entry: {name}") from error
        if len(out) != entry.size:
            raise FolioError("INPUT_INVALID_ZIP", f"not the size of the directory: {name}")
        return out


def elements(xml: bytes, found: Callable[[str, list[tuple[str, str, str]]], None]) -> None:
    """Calls ``found`` with the local name of each element and its attributes (namespace, local name, value), in order."""

    def split(name: str) -> tuple[str, str]:
        space, _, local = name.rpartition(" ")
        return space, local

    def start(name: str, pairs: list[str]) -> None:
        found(split(name)[1], [(*split(k), v) for k, v in zip(pairs[::2], pairs[1::2], strict=True)])

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.ordered_attributes = True
    parser.StartElementHandler = start
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as error:
        raise FolioError("INPUT_INVALID_DOCX", f"broken XML: {error}") from error


class Links:
    """The image relationships of a document's body that stay inside the document: id to member of the archive."""

    def __init__(self, xml: bytes) -> None:
        self.member: dict[str, str] = {}
        elements(xml, self._add)

    def _add(self, name: str, attributes: list[tuple[str, str, str]]) -> None:
        at = {local: value for space, local, value in attributes if not space}
        inside = at.get("TargetMode", "").lower() != "external"
        if name == "Relationship" and at.get("Id") and at.get("Target") and inside and at.get("Type", "").lower().endswith("/image"):
            self.member[at["Id"]] = at["Target"]  # the last of an id holds

    def path(self, ident: str) -> str:
        """Where a target lies; targets count from the body's folder, and may not leave it."""
        inside: list[str] = []
        for step in self.member[ident].replace("\\", "/").split("/"):
            if step == ".." and not inside:
                raise FolioError("INPUT_UNSAFE_RELATIONSHIP", f"a path out of the document: {self.member[ident]}")
            if step == "..":
                inside.pop()
            elif step not in ("", "."):
                inside.append(step)
        if not inside:
            raise FolioError("INPUT_UNSAFE_RELATIONSHIP", f"not a member of the document: {self.member[ident]}")
        return posixpath.join(posixpath.dirname(BODY), *inside)


def references(xml: bytes) -> list[str]:
    """Relationship ids in the order of the body, repeats kept; those of links to other things are among them."""
    out: list[str] = []
    elements(xml, lambda name, attributes: out.extend(v for space, local, v in attributes if local in ("embed", "id") and space.endswith(RELATIONS)))
    return out


def is_image(name: str) -> bool:
    return posixpath.splitext(name)[1].lower() in IMAGES


def scan_members(archive: Archive) -> list[str]:
    """The members that are a document's scans, in reading order; all media in natural order if the body shows none."""
    if BODY not in archive.entries or LINKS not in archive.entries:
        raise FolioError("INPUT_INVALID_DOCX", "no document body or relationships")
    links = Links(archive.read(LINKS))
    paths = [links.path(r) for r in references(archive.read(BODY)) if r in links.member]
    for path in paths:
        if path not in archive.entries:
            raise FolioError("INPUT_IMAGE_MISSING", f"no such image: {path}")
    if not paths:
        paths = sorted((n for n in archive.entries if n.startswith(MEDIA) and is_image(n)), key=natural_key)
    if not paths:
        raise FolioError("INPUT_NO_IMAGES", "no scans in the document")
    return paths


def scans(data: bytes, source: str = "document.docx") -> list[tuple[str, str, bytes]]:
    """(name, source, content) of each embedded scan in reading order."""
    archive = Archive(data)
    return [(posixpath.basename(p), source, archive.read(p)) for p in scan_members(archive)]


_PART = 128 << 20


@dataclass
class Part(InputPartition):
    """Every ``of``-th scan of a file, from ``part`` on."""

    path: str
    part: int
    of: int


_COMPARED = {EqualTo: operator.eq, LessThan: operator.lt, LessThanOrEqual: operator.le, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge}


def _test(f: Filter, column: str) -> Callable[[object], bool] | None:
    """A pushed filter on one of this source's columns as a test of its value, or None."""
    if getattr(f, "attribute", None) != (column,):
        return None
    if isinstance(f, In):
        return lambda v: v in f.value
    if isinstance(f, IsNotNull):
        return lambda v: v is not None
    if isinstance(f, StringStartsWith):
        return lambda v: v is not None and v.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return lambda v: v is not None and v.endswith(f.value)
    compare = _COMPARED.get(type(f))
    return None if compare is None else lambda v: v is not None and compare(v, f.value)


class ScanReader(DataSourceReader):
    """Filters on doc_id choose files, those on sheet_number choose members; others are not read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.part_bytes = options.get("path", ""), int(options.get("partBytes", _PART))
        self.filters: dict[str, list[Filter]] = {"doc_id": [], "sheet_number": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            for column, own in self.filters.items():
                if _test(f, column):
                    own.append(f)
                    break
            else:
                yield f

    def _wanted(self, column: str, value: object) -> bool:
        return all(_test(f, column)(value) for f in self.filters[column])

    def partitions(self) -> list[Part]:
        """A file is one partition, or one for each ``partBytes`` of it; no file is opened for this."""
        store, path = opened(self.folder)
        info = store.get_file_info(path)
        found = [info]
        if info.type == pyarrow.fs.FileType.Directory:
            found = [f for f in store.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file and f.base_name.lower().endswith(".docx")]
        found = sorted((f for f in found if self._wanted("doc_id", f.path)), key=lambda f: natural_key(f.path))
        parts = [(f.path, max(1, -(-(f.size or 0) // self.part_bytes))) for f in found]
        return [Part(name, k, of) for name, of in parts for k in range(of)]

    def read(self, partition: Part) -> Iterator[tuple]:
        name = posixpath.basename(partition.path)
        store, _ = opened(self.folder)
        at, member = 0, None
        try:
            with store.open_input_file(partition.path) as file:
                archive = Archive(Ranges(file))
                for at, member in enumerate(scan_members(archive), 1):
                    if at % partition.of == partition.part and self._wanted("sheet_number", at):
                        yield self._sheet(archive, partition.path, at, member)
        except (FolioError, OSError) as error:
            if partition.part == 0 and self._wanted("sheet_number", 0):  # of the file, so once
                yield partition.path, 0, None, name, None, None, None, _error(error, partition.path)

    @staticmethod
    def _sheet(archive: Archive, path: str, at: int, member: str) -> tuple:
        head = path, at, posixpath.basename(member), posixpath.basename(path)
        try:
            return *head, archive.read(member), None, None, None
        except (FolioError, OSError) as error:
            return *head, None, None, None, _error(error, path)


def _error(error: Exception, path: str) -> tuple[str, str]:
    e = summary(as_folio_error(error, "INPUT_READ_FAILED", f"cannot read {path}"))
    return e["code"], e["message"]


class DocxSource(DataSource):
    """``spark.read.format("docx_scans")``: the scans of the files of a folder, or of one file, in any store that Python opens by URI.

    A scan is a row; a file that cannot be read is one row with its error and sheet_number 0, a broken scan is a row with its
    own. Only directories, bodies and the scans asked for are read, one scan at a time; filters on doc_id and sheet_number
    are pushed here. ``partBytes`` (128 MB): a longer file is read by several tasks. Spark's own stores:
    :func:`foliospark.sources.loader.sheets`.
    """

    @classmethod
    def name(cls) -> str:
        return "docx_scans"

    def schema(self) -> str:
        return SHEETS

    def reader(self, schema: object) -> DataSourceReader:
        return ScanReader(dict(self.options))
