"""WARC records in ZIP packages: a writer, and a reader that range-reads records through directories and indexes.

Packages are files of a store that Python can open by URI; a reader opens the end of the file, the directories, the index
and the ranges that it names, and nothing else. Where a package has no index its WARC files are read in order. Whatever is
broken is a row with an error, and all else is read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import materialize, prepare, settled, work_folder
from foliospark.sources.store import opened

# Signatures of the ZIP format; fixed values.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int  # where its local header begins


class PackageError(ValueError):
    """The package breaks off, is encrypted, or its directories contradict each other."""


def write_package(members: list[tuple[str, bytes]], *, zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ``zip64`` writes ZIP64 fields even where they are not needed."""
    out, central = io.BytesIO(), []
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), out.tell()
        big = zip64 or len(data) >= _MAX32 or at >= _MAX32
        local_extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = _MAX32 if big else len(data)
        out.write(struct.pack("<4s5H3I2H", _LOCAL, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(local_extra)) + raw + local_extra)
        out.write(data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        central.append(struct.pack("<4s6H3I5H2I", _CENTRAL, 45, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if big else at) + raw + extra)
    start, directory, n = out.tell(), b"".join(central), len(central)
    out.write(directory)
    if zip64 or n >= _MAX16 or start >= _MAX32:
        end64 = out.tell()
        out.write(struct.pack("<4sQ2H2I4Q", _END64, 44, 45, 45, 0, 0, n, n, len(directory), start))
        out.write(struct.pack("<4sIQI", _LOCATOR64, 0, end64, 1))
        n, directory_size, start = _MAX16, _MAX32, _MAX32
    else:
        directory_size = len(directory)
    out.write(struct.pack("<4s4H2IH", _END, 0, 0, n, n, directory_size, start, 0))
    return out.getvalue()


class Package:
    """Reads a ZIP file by ranges: ``read(start, size)`` gives bytes, ``length`` is the file's size."""

    def __init__(self, read: Callable[[int, int], bytes], length: int) -> None:
        self._read, self.length = read, length
        try:
            self.members = {m.name: m for m in self._directory()}
        except struct.error as error:
            raise PackageError("a directory breaks off") from error

    def range(self, start: int, size: int) -> bytes:
        if start < 0 or size < 0 or start + size > self.length:
            raise PackageError("range outside the package")
        return self._read(start, size)

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.length - _MAX16 - 22)
        tail = self.range(tail_at, self.length - tail_at)
        found = tail.rfind(_END)
        while found >= 0 and (len(tail) < found + 22 or found + 22 + struct.unpack_from("<H", tail, found + 20)[0] > len(tail)):
            found = tail.rfind(_END, 0, found)
        if found < 0:
            raise PackageError("no end of the central directory")
        _, _, _, n, size, start, _ = struct.unpack_from("<4H2IH", tail, found + 4)
        end = tail_at + found
        if _MAX16 == n or _MAX32 in (size, start):
            locator = self.range(end - 20, 20) if end >= 20 else b""
            if locator[:4] != _LOCATOR64:
                raise PackageError("no ZIP64 locator")
            at = struct.unpack_from("<Q", locator, 8)[0]
            record = self.range(at, 56)
            if record[:4] != _END64:
                raise PackageError("no ZIP64 directory")
            n, size, start = struct.unpack_from("<QQQ", record, 32)
        directory = self.range(start, size)
        at = 0
        for _ in range(n):
            if directory[at : at + 4] != _CENTRAL or at + 46 > len(directory):
                raise PackageError("broken central directory")
            flags, method, _, _, crc, packed, full, name_len, extra_len, note_len, _, _, _, header = struct.unpack_from("<2H2H3I3H2HII", directory, at + 8)
            name = directory[at + 46 : at + 46 + name_len].decode("utf-8" if flags & 0x800 else "cp437", "replace")
            extra = directory[at + 46 + name_len : at + 46 + name_len + extra_len]
            full, packed, header = _wide(extra, full, packed, header)
            if flags & 1:
                raise PackageError("encrypted member")
            yield Member(name, method, crc, packed, full, header)
            at += 46 + name_len + extra_len + note_len

    def start(self, member: Member) -> int:
        """Where the member's data begins, from its local header."""
        head = self.range(member.header, 30)
        if head[:4] != _LOCAL:
            raise PackageError("no local header")
        name_len, extra_len = struct.unpack_from("<2H", head, 26)
        return member.header + 30 + name_len + extra_len

    def read(self, member: Member, offset: int = 0, size: int | None = None) -> bytes:
        """A range of a stored member; a deflated one only whole."""
        if member.method == 8 and offset == 0 and size is None:
            try:
                data = zlib.decompressobj(-15).decompress(self.range(self.start(member), member.packed), member.size + 1)
            except zlib.error as error:
                raise PackageError("a member cannot be decompressed") from error
            if len(data) != member.size:
                raise PackageError("a member has another size than its directory says")
            return data
        if member.method != 0:
            raise PackageError("ranges need a stored member")
        size = member.size - offset if size is None else size
        if offset < 0 or offset + size > member.size:
            raise PackageError("range outside the member")
        return self.range(self.start(member) + offset, size)


def _wide(extra: bytes, full: int, packed: int, header: int) -> tuple[int, int, int]:
    """The three values with those that do not fit 32 bits taken from the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            at += 4
            values = []
            for v in (full, packed, header):
                if v == _MAX32:
                    v = struct.unpack_from("<Q", extra, at)[0]
                    at += 8
                values.append(v)
            return tuple(values)
        at += 4 + size
    return full, packed, header


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: object) -> str:
    """An id as the name of a record; whatever it is made of, it stays within its header."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def _named(urn: str | None) -> str | None:
    """The id of a record's name; of names that are not this module's, the name."""
    if urn is None or urn == "<urn:page>":
        return None
    inner = urn.removeprefix("<").removesuffix(">")
    return unquote(inner.removeprefix("urn:page:")) if inner.startswith("urn:page:") else inner


def write_record(page_id: object, url: str, payload: bytes, digest: str, refers_to: object = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit of record ``refers_to`` whose block has the response's headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    body: bytes


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, sep, v in pairs if sep}


def read_record(data: bytes) -> Record:
    """One record of a WARC file, its HTTP headers and the payload."""
    if not data.startswith(b"WARC/"):
        raise PackageError("not a WARC record")
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = rest[: int(headers.get("content-length", 0))]
    if len(block) < int(headers.get("content-length", 0)):
        raise PackageError("the record breaks off")
    http, _, body = block.partition(b"\r\n\r\n")
    return Record(headers, _headers(http), body)


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c not in "\r\n")


def url_key(url: str) -> str:
    """A URL by which an index is sorted: the host backwards, then the rest, in characters that end no field or line."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
        key = (f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")).lower()
    except ValueError:
        key = url
    return quote(key, safe="!$%&'()*+,-./:;=?@_~") or "-"


class Entry(NamedTuple):
    filename: str
    offset: int
    length: int


def index_lines(text: str) -> Iterator[Entry]:
    """The ranges of an index: lines of key, time and JSON, or of fields that a header line names by letters."""
    order: list[str] = []
    for line in text.split("\n"):  # and at no other character that ends lines elsewhere: a URL may hold those
        line = line.rstrip("\r")
        if not line.strip(" ") or line.startswith("!"):
            continue
        fields = [f for f in line.split(" ") if f]
        if fields[0] == "CDX":
            order = fields[1:]
            continue
        try:
            if len(fields) > 2 and fields[2].startswith("{"):
                at = json.loads(line.lstrip(" ").split(" ", 2)[2])
                yield Entry(str(at["filename"]), int(at["offset"]), int(at["length"]))
            else:
                at = dict(zip(order or list("NbamskrMSVg"), fields, strict=False))
                yield Entry(at["g"], int(at["V"]), int(at["S"]))
        except (ValueError, KeyError, TypeError) as error:
            raise PackageError(f"broken index line: {line[:80]}") from error


def _writing(folder: str, most: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get(), 0
        warc, index = io.BytesIO(), []
        store, path = opened(folder)
        store.create_dir(path, recursive=True)

        def package() -> pa.RecordBatch:
            nonlocal warc, index, count
            lines = "\n".join(f"{key} {time} {json.dumps(x, separators=(',', ':'))}" for key, time, x in sorted(index, key=lambda x: x[:2])) + "\n"
            data = write_package([("archive/data.warc.gz", warc.getvalue()), ("indexes/index.cdxj", lines.encode()), ("datapackage.json", b'{"profile":"data-package","wacz_version":"1.1.1"}')])
            # a task that runs again writes other files, and only those of the one that ends are listed
            name = f"crawl-{task.partitionId():06d}-{count:06d}-{task.taskAttemptId()}.wacz"
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(data)
            n = len(index)
            warc, index, count = io.BytesIO(), [], count + 1
            return pa.record_batch({"package": [f"{folder}/{name}"], "length": pa.array([len(data)], pa.int64()), "records": pa.array([n], pa.int64())})

        for batch in batches:
            ids, urls, first = (batch.column(c).to_pylist() for c in ("page_id", "url", "first"))
            for i in range(batch.num_rows):
                payload = batch.column("payload")[i].as_py() or b""
                refers = first[i] if first[i] is not None and first[i] != ids[i] else None
                url, digest = _clean(urls[i]), payload_digest(payload)
                record = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record.compress(write_record(ids[i], url, payload, digest, refers)) + record.flush()
                kind = "text/html" if refers is None else "warc/revisit"
                index.append((url_key(url), "19700101000000", {"url": url, "mime": kind, "status": "200", "digest": f"sha1:{digest}", "length": str(len(data)), "offset": str(warc.tell()), "filename": "data.warc.gz"}))
                warc.write(data)
                if warc.tell() >= most:
                    yield package()
        if index:
            yield package()

    return write


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, most: int = 8 << 20, level: int = 1) -> DataFrame:
    """(package, length, records): ZIP packages of about ``most`` bytes, written to ``folder``, with gzipped WARC records and a sorted index of their ranges.

    Of records with equal payloads of at least ``least`` bytes that with the smallest id is a response, the others
    revisit it. Pages are moved once, by their digests, to learn which it is. Without a folder one is made in the shared
    folder. A record is in memory as a whole, and a package.
    """
    spark = prepare(pages.sparkSession)
    folder = folder.rstrip("/") if folder else work_folder(spark, "packages")
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    again = base.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"), F.count("page_id").alias("named")).where("first <> last or n > named").select("sha", "first")
    # written, so that both sides of the join are plain exchanges, of which Spark splits a digest's
    rows = base.join(materialize(again, "again"), "sha", "left").select("page_id", "url", "payload", F.when(F.octet_length("payload") >= least, F.col("first")).alias("first"))
    return materialize(rows.mapInArrow(_writing(folder, most, level), "package string, length bigint, records bigint"), "packages")


_ROW = {"package": pa.string(), "page_id": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "url": pa.string(), "payload": pa.binary(), "error": pa.string()}
_RANGE = 4 << 20  # bytes that are read at once where ranges lie side by side


def _row(package: str, raw: bytes) -> tuple:
    """A record's row, or None for records of other kinds."""
    record = read_record(raw)
    kind = record.headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return ()
    body = record.body
    size = int(record.http.get("content-length", len(body)))
    digest = record.headers.get("warc-payload-digest", f"sha1:{payload_digest(body)}").removeprefix("sha1:")
    if kind == "response" and (payload_digest(body) != digest or len(body) != size):
        raise PackageError("a payload differs from its digest")
    ident, refers = (_named(record.headers.get(k)) for k in ("warc-record-id", "warc-refers-to"))
    return package, ident, size, digest, kind, refers, record.headers.get("warc-target-uri"), body, None


_MOST = 1 << 30  # bytes of one record or index


def _whole(raw: bytes) -> bytes:
    if raw[:2] != b"\x1f\x8b":
        return raw
    inflate = zlib.decompressobj(31)
    try:
        data = inflate.decompress(raw, _MOST)
    except zlib.error as error:
        raise PackageError("a record cannot be decompressed") from error
    if not inflate.eof:
        raise PackageError("a record breaks off, or is larger than a record may be")
    return data


def _in_order(package: Package, member: Member) -> Iterator[bytes]:
    """The records of a WARC file without an index, read in ranges; gzipped ones have a member each."""
    at, held, zipped = 0, b"", None
    inflate, out = None, []

    def more() -> bool:
        nonlocal at, held
        n = min(_RANGE, member.size - at)
        if n <= 0:
            return False
        held += package.read(member, at, n)
        at += n
        return True

    while held or more():
        if zipped is None:
            zipped = held[:2] == b"\x1f\x8b"
        if zipped:
            inflate = inflate or zlib.decompressobj(31)
            try:
                out.append(inflate.decompress(held, _RANGE))
            except zlib.error as error:
                raise PackageError("a record cannot be decompressed") from error
            if sum(map(len, out)) > _MOST:
                raise PackageError("a record is larger than a record may be")
            held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if inflate.eof:
                yield b"".join(out)
                inflate, out = None, []
            continue
        held = held.lstrip(b"\r\n")
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if not held:
            continue
        if end < 0:
            raise PackageError("the record breaks off")
        need = end + 4 + int(_headers(held[:end]).get("content-length", 0))
        while len(held) < need and more():
            pass
        yield held[:need]
        held = held[need:]
    if inflate:
        raise PackageError("the record breaks off")


def _records(package: Package) -> Iterator[bytes | PackageError]:
    """The records that a package's indexes name; without one, all of its WARC files'."""
    names = sorted(n for n in package.members if n.startswith("indexes/") and n.removesuffix(".gz").endswith((".cdxj", ".cdx")))
    entries: set[Entry] = set()
    for name in names:
        entries.update(index_lines(_whole(package.read(package.members[name])).decode("utf-8", "replace")))
    if not names:
        for name in sorted(n for n in package.members if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))):
            yield from _in_order(package, package.members[name])
        return
    held, start, filename = b"", 0, None
    todo = sorted(entries)
    for k, at in enumerate(todo):
        try:
            if at.filename != filename or not start <= at.offset or at.offset + at.length > start + len(held):
                member = package.members.get("archive/" + at.filename.removeprefix("archive/"))
                if member is None:
                    raise PackageError(f"no {at.filename}")
                end = at.offset + at.length
                for other in todo[k + 1 :]:  # those that lie beside it
                    if other.filename != at.filename or other.offset != end or end + other.length - at.offset > _RANGE:
                        break
                    end += other.length
                held, start, filename = package.read(member, at.offset, min(end, member.size) - at.offset), at.offset, at.filename
            raw = held[at.offset - start : at.offset - start + at.length]
            if len(raw) < at.length:
                raise PackageError("range outside the member")
            yield _whole(raw)
        except PackageError as error:
            yield error


def package_rows(name: str, read: Callable[[int, int], bytes], length: int) -> Iterator[tuple]:
    """Rows of a package's records; what is broken is a row with an error."""

    def failed(error: Exception) -> tuple:
        return name, None, None, None, None, None, None, None, str(error)

    try:
        for raw in _records(Package(read, length)):
            try:
                if isinstance(raw, PackageError):
                    raise raw
                row = _row(name, raw)
                if row:
                    yield row
            except (PackageError, ValueError) as error:
                yield failed(error)
    except (PackageError, OSError) as error:
        yield failed(error)


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(_ROW)
        return pa.record_batch({n: pa.array(c, k) for (n, k), c in zip(_ROW.items(), cols, strict=True)})

    for batch in batches:
        for uri in batch.column("package").to_pylist():
            rows, held = [], 0
            try:
                store, path = opened(uri)
                with store.open_input_file(path) as file:
                    for row in package_rows(uri, lambda start, size, file=file: file.read_at(size, start), file.size()):
                        rows.append(row)
                        held += len(row[7] or b"")
                        if held > _RANGE:
                            yield batch_of(rows)
                            rows, held = [], 0
            except (OSError, pa.ArrowException) as error:
                rows.append((uri, *[None] * 7, str(error)))
            yield batch_of(rows)


def read_archives(packages: DataFrame) -> DataFrame:
    """A row per record of packages (package: a path or URI): package, page_id (as text), payload_bytes, payload_digest, record_type, refers_to, url, payload (empty for revisits), error.

    Indexes may be of JSON lines or of fields, gzipped or not; without one the WARC files are read in order. A record or
    package that cannot be read is a row with an error. Records other than responses and revisits are passed over.
    """
    prepare(packages.sparkSession)
    return packages.select("package").mapInArrow(_reading, "package string, page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, payload binary, error string")


@settled
def archive_pages(pages: DataFrame, *, id_col: str = "page_id", **options: object) -> DataFrame:
    """Writes pages to packages in the shared folder and reads all records back.

    Returns a row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, error (null; a record that
    cannot be read back is a row with its error alone). Null html counts as empty, a null url as an empty one; urls and ids
    may hold any characters (line ends of a url are left out). Rows that repeat the smallest id of a payload are responses too. Rows with a null id
    are responses, or revisits if a row with an id has their payload. Extra columns are ignored; no pages, no records.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    records = read_archives(write_archives(pages, id_col=id_col, **options))
    return records.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "error")
