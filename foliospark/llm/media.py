"""Media columns in Matroska: a writer, a parser to packet tables, and features of what was read back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import materialize, prepare

# Element ids of the format; fixed values.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, CUES, CUE_POINT, CUE_AT, GROUP = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7, 0xA0
SCALE, DURATION, NUMBER, DEFAULT_DURATION, CODEC, RATE, TIME, SIMPLE_BLOCK, BLOCK, BLOCK_DURATION, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0x2AD7B1, 0x4489, 0xD7, 0x23E383, 0x86, 0xB5, 0xE7, 0xA3, 0xA1, 0x9B, 0xB3, 0xF7, 0xF1
_TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}
UNKNOWN = -1


def number(value: int, least: int = 1) -> bytes:
    """A variable-length size: the leading zeros of the first byte give the length."""
    n = least
    while value >= (1 << 7 * n) - 1:
        n += 1
    return ((1 << 7 * n) | value).to_bytes(n, "big")


def signed(value: int) -> bytes:
    """A variable-length signed size difference of EBML lacing."""
    n = 1
    while not -(1 << 7 * n - 1) < value < 1 << 7 * n - 1:
        n += 1
    return ((1 << 7 * n) | (value + (1 << 7 * n - 1) - 1)).to_bytes(n, "big")


def element(ident: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + number(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """Frames of one block; lacing 0: one frame, 1: Xiph, 2: equal sizes, 3: EBML differences."""
    if lacing == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif lacing == 3 and len(frames) > 1:
        head += number(len(frames[0]))
        for a, b in zip(frames[:-2], frames[1:-1], strict=True):
            head += signed(len(b) - len(a))
    return head + b"".join(frames)


def write_matroska(payload: bytes, *, rate: int = 8000, frame: int = 1536, frames: int = 8, cluster: int = 16) -> bytes:
    """``payload`` as unsigned 8-bit mono samples in one track.

    ``frame`` bytes make a packet, ``frames`` packets a laced block (equal sizes; EBML lacing if the last one is
    shorter), ``cluster`` blocks a cluster. Cues name each cluster. The same payload gives the same bytes.
    """
    ms = frame * 1000 // rate
    head = element(EBML, unsigned(0x4286, 1), unsigned(0x42F7, 1), unsigned(0x42F2, 4), unsigned(0x42F3, 8), element(0x4282, b"matroska"), unsigned(0x4287, 4), unsigned(0x4285, 2))
    info = element(INFO, unsigned(SCALE, 1_000_000), element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)))
    track = element(TRACKS, element(TRACK, unsigned(NUMBER, 1), unsigned(0x73C5, 1), unsigned(0x83, 2), unsigned(0x9C, 1), unsigned(DEFAULT_DURATION, ms * 1_000_000), element(CODEC, b"A_PCM/INT/LIT"), element(AUDIO, element(RATE, struct.pack(">d", float(rate))), unsigned(0x9F, 1), unsigned(0x6264, 8))))
    at, body, cues, step = len(info) + len(track), [], [], frame * frames
    for c in range(0, len(payload), step * cluster):
        start, parts = c // frame * ms, []
        parts.append(unsigned(TIME, start))
        for b in range(c, min(len(payload), c + step * cluster), step):
            block = payload[b : b + step]
            packets = [block[i : i + frame] for i in range(0, len(block), frame)]
            lacing = 0 if len(packets) == 1 else 2 if len(packets[-1]) == frame else 3
            parts.append(element(SIMPLE_BLOCK, b"\x81", struct.pack(">hB", b // frame * ms - start, 0x80 | lacing << 1), laced(packets, lacing)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, start), element(CUE_AT, unsigned(CUE_TRACK, 1), unsigned(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, *parts))
        at += len(body[-1])
    return head + element(SEGMENT, info, track, *body, element(CUES, *cues))


class Packet(NamedTuple):
    track: int
    time_ns: int
    start: int  # byte range in the file
    size: int
    cluster: int  # where the packet's cluster begins
    keyframe: bool
    lacing: int


class Media(NamedTuple):
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time in ns, track, where the cluster begins
    whole: bool  # False: the file breaks off or an element makes no sense


def _size(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, next place) of a variable-length number; keep: with its length bit, as ids are."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise IndexError
    value = int.from_bytes(data[at : at + n], "big")
    if keep:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (UNKNOWN if value == (1 << 7 * n) - 1 else value), at + n


def _block(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, byte ranges of frames)."""
    track, at = _size(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if lacing == 0:
        return track, time, flags, [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 3 and n > 1:
        size, at = _size(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            length = 9 - data[at].bit_length()
            step, at = _size(data, at)
            step = (1 << 7 * length) - 1 if step == UNKNOWN else step
            sizes.append(sizes[-1] + step - ((1 << 7 * length - 1) - 1))
    elif lacing == 2:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or lacing == 2 and sizes[-1] != sizes[0]:
        raise IndexError
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, time, flags, out


def parse_matroska(data: bytes) -> Media:
    """Tracks, packets in file order and cues. Sizes may be unknown (to the next element of the same level or above)."""
    media = Media({}, [], [], True)
    scale, segment, cluster, base, track = 1_000_000, 0, 0, 0, {}
    cue: dict[int, int] = {}
    whole = True
    stack: list[tuple[int, int]] = []
    at = 0
    try:
        while at < len(data):
            while stack and stack[-1][1] != UNKNOWN and at >= stack[-1][1]:
                stack.pop()
            begin = at
            ident, at = _size(data, at, keep=True)
            size, at = _size(data, at)
            if ident in _TOP:
                while stack and stack[-1][1] == UNKNOWN and (stack[-1][0] != SEGMENT or ident == SEGMENT):
                    stack.pop()
            end = UNKNOWN if size == UNKNOWN else at + size
            if end > len(data):
                whole = False
                if ident in (SIMPLE_BLOCK, BLOCK):
                    break
            if ident in (SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, CUES, CUE_POINT, CUE_AT, GROUP, EBML):
                stack.append((ident, end))
                if ident == SEGMENT:
                    segment = at
                elif ident == CLUSTER:
                    cluster, base = begin, 0
                elif ident == TRACK:
                    track = {}
                elif ident == CUE_POINT:
                    cue = {}
                continue
            if end == UNKNOWN:
                raise IndexError
            body = data[at:end]
            value = int.from_bytes(body, "big") if len(body) <= 8 else 0
            if ident == SCALE:
                scale = value
            elif ident == NUMBER:
                track["number"] = value
                media.tracks[value] = track
            elif ident == DEFAULT_DURATION:
                track["default_ns"] = value
            elif ident == CODEC:
                track["codec"] = body.rstrip(b"\0").decode("ascii", "replace")
            elif ident == RATE and len(body) in (4, 8):
                track["rate"] = struct.unpack(">f" if len(body) == 4 else ">d", body)[0]
            elif ident == TIME:
                base = value
            elif ident in (SIMPLE_BLOCK, BLOCK):
                number_, rel, flags, frames = _block(data, at, end)
                step = media.tracks.get(number_, {}).get("default_ns", 0)
                for i, (start, length) in enumerate(frames):
                    media.packets.append(Packet(number_, (base + rel) * scale + i * step, start, length, cluster, bool(flags & 0x80) or ident == BLOCK, flags >> 1 & 3))
            elif ident == CUE_TIME:
                cue["time"] = value
            elif ident == CUE_TRACK:
                cue["track"] = value
            elif ident == CUE_CLUSTER:
                media.cues.append((cue.get("time", 0) * scale, cue.get("track", 0), segment + value))
            at = end
    except (IndexError, struct.error):
        whole = False
    return media._replace(whole=whole)


def _payload(text: bytes, unit: int) -> bytes:
    n = max(1, -(-len(text) // unit)) * unit
    return text.ljust(n, b" ")


def _encode(unit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                media = [write_matroska(_payload(x or b"", unit)) for x in part.column("bytes").to_pylist()]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), "media": pa.array(media, pa.large_binary())})

    return encode


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: int = 192) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, filled up with spaces to a positive multiple of ``unit``, as a Matroska file."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("bytes")).withColumn("n_bytes", F.octet_length("bytes").cast("bigint"))
    return base.mapInArrow(_encode(unit), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ident, data in zip(batch.column("doc_id"), batch.column("media").to_pylist(), strict=True):
            media = parse_matroska(data or b"")
            cols = list(zip(*media.packets, strict=True)) or [()] * 7
            cued = {c for _, _, c in media.cues}
            yield pa.record_batch({
                "doc_id": pa.array([ident.as_py()] * len(media.packets), batch.column("doc_id").type), "track": pa.array(cols[0], pa.int64()), "time_ns": pa.array(cols[1], pa.int64()), "start": pa.array(cols[2], pa.int64()), "size": pa.array(cols[3], pa.int64()),
                "cluster": pa.array(cols[4], pa.int64()), "keyframe": pa.array(cols[5], pa.bool_()), "lacing": pa.array(cols[6], pa.int32()), "cued": pa.array([c in cued for c in cols[4]], pa.bool_()),
            })


def packet_table(media: DataFrame) -> DataFrame:
    """A row per packet of (doc_id, media): track, time_ns, byte range (start, size), cluster, keyframe, lacing, cued. Null or broken media: the packets before the break."""
    prepare(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_packets, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, track bigint, time_ns bigint, start bigint, size bigint, cluster bigint, keyframe boolean, lacing int, cued boolean")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            rows = []
            for data in part.column("media").to_pylist():
                data = data or b""
                media = parse_matroska(data)
                payload = b"".join([data[p.start : p.start + p.size] for p in media.packets])
                x = np.frombuffer(payload, np.uint8)
                crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
                clusters = {p.cluster for p in media.packets}
                feature = f"packets={len(media.packets)};clusters={len(clusters)};cues={sum(c[2] in clusters for c in media.cues)};last_ms={media.packets[-1].time_ns // 1_000_000 if media.packets else 0};sum={int(x.sum(dtype=np.int64))};peak={int(x.max(initial=0))};crossings={crossings}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), **{n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)}})


def media_features(media: DataFrame) -> DataFrame:
    """What (doc_id, n_bytes, media) holds, read back through its packets: payload and file sizes and digests, and a feature string."""
    prepare(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: int = 192) -> DataFrame:
    """Stores every text as media in the shared folder, reads it back and describes it.

    Null text counts as empty (one unit of spaces). Repeated rows and null ids: a row each; equal texts give equal
    values. Extra columns are ignored; an empty table gives an empty result. Texts are stored whole.
    """
    return media_features(materialize(to_media(docs, id_col=id_col, text_col=text_col, unit=unit), "media"))
