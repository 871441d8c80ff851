"""Images as strips of rows: scans of any height with a strip in memory at a time.

A strip has whole rows, so it needs nothing of its neighbours: tones are of single pixels, and the cut's windows lie
within a row. What an image needs as a whole are sums of its columns, which are partial aggregates.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliospark.errors import FolioError, summary
from foliospark.operators.raster import crop, decode_png, png_rows, suppress, window_costs
from foliospark.session import prepare

_FIELDS = "width INT, height INT, top INT, rows INT, data BINARY, error STRUCT<code: STRING, message: STRING>"
_ERROR = pa.struct([("code", pa.string()), ("message", pa.string())])
_TYPES = {"width": pa.int32(), "height": pa.int32(), "top": pa.int32(), "rows": pa.int32(), "data": pa.binary(), "error": _ERROR}


def _strip(ident: pa.Array, width: int | None, height: int | None, top: int | None, pixels: np.ndarray | None, error: dict | None = None) -> pa.RecordBatch:
    values = (width, height, top, None if pixels is None else len(pixels), None if pixels is None else np.ascontiguousarray(pixels).tobytes(), error)
    return pa.RecordBatch.from_arrays([ident, *(pa.array([v], t) for v, t in zip(values, _TYPES.values(), strict=True))], ["image_id", *_TYPES])


def strips(images: DataFrame, *, id_col: str = "image_id", content_col: str = "content", rows: int = 256) -> DataFrame:
    """(image_id, width, height, top, rows, data, error): PNG files in strips of ``rows`` rows, as they are inflated.

    A broken file is a row with its error, after the strips that could be read. Interlaced files have no rows until all of
    them is read; these alone are decoded whole. Null content: an error. Ids are unique.
    """
    prepare(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ident, data = batch.column("image_id").slice(k, 1), batch.column("content")[k].as_py()
                try:
                    width, height, parts = png_rows(data or b"", rows)
                    for top, pixels in parts if parts is not None else _cut(decode_png(data), rows):
                        yield _strip(ident, width, height, top, pixels)
                except FolioError as error:
                    yield _strip(ident, None, None, None, None, summary(error))

    base = images.select(F.col(f"`{id_col}`").alias("image_id"), F.col(f"`{content_col}`").alias("content"))
    return base.mapInArrow(run, f"image_id {base.schema['image_id'].dataType.simpleString()}, {_FIELDS}")


def _cut(image: np.ndarray, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    for top in range(0, len(image), rows):
        yield top, image[top : top + rows]


def _mapped(found: DataFrame, work: Callable[[np.ndarray, int, int], tuple[int, int, np.ndarray] | None]) -> DataFrame:
    """Strips through ``work(pixels, height, top)``, which gives the image's new height, the strip's top and its pixels, or None; errors pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                if not one.column("data").is_valid()[0].as_py():
                    yield one
                    continue
                width, height, top, rows = (one.column(c)[0].as_py() for c in ("width", "height", "top", "rows"))
                made = work(np.frombuffer(one.column("data")[0].as_buffer(), np.uint8).reshape(rows, width, 3), height, top)
                if made:
                    yield _strip(one.column("image_id"), made[2].shape[1], made[0], made[1], made[2])

    kept = found.select("image_id", *_TYPES)
    return kept.mapInArrow(run, f"image_id {kept.schema['image_id'].dataType.simpleString()}, {_FIELDS}")


def suppressed_strips(found: DataFrame, mode: str = "conservative") -> DataFrame:
    """Strips with their watermarks suppressed; in mode text-safe small images are doubled, strip by strip."""

    def work(pixels: np.ndarray, height: int, top: int) -> tuple[int, int, np.ndarray]:
        out = suppress(pixels, mode)
        by = len(out) // len(pixels)
        return height * by, top * by, out

    return _mapped(found, work)


def cropped_strips(found: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """The part of each image; strips beside it go. Images that do not hold all of it are errors of their strips."""

    def work(pixels: np.ndarray, full: int, at: int) -> tuple[int, int, np.ndarray] | None:
        if left < 0 or top < 0 or width <= 0 or height <= 0 or left + width > pixels.shape[1] or top + height > full:
            raise FolioError("IMAGE_INVALID_CROP", f"no crop {left},{top} {width} x {height} of {pixels.shape[1]} x {full}")
        lo, hi = max(top, at), min(top + height, at + len(pixels))
        return (height, lo - top, crop(pixels, left, lo - at, width, hi - lo)) if lo < hi else None

    return _mapped(found, work)


def column_costs(found: DataFrame) -> DataFrame:
    """(image_id, width, height, x, dark, edge): of each column that a cut may take, its dark windows and the sum of its edges, from the sums of strips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                width, height, rows = (one.column(c)[0].as_py() for c in ("width", "height", "rows"))
                xs, dark, edge = window_costs(np.frombuffer(one.column("data")[0].as_buffer(), np.uint8).reshape(rows, width, 3))
                n = len(xs)
                ident = pa.concat_arrays([one.column("image_id")] * n) if n else one.column("image_id").slice(0, 0)
                yield pa.record_batch({"image_id": ident, "width": pa.array([width] * n, pa.int32()), "height": pa.array([height] * n, pa.int32()), "x": pa.array(xs, pa.int32()), "dark": pa.array(dark, pa.int64()), "edge": pa.array(edge, pa.float64())})

    good = found.where("data is not null and width > height").select("image_id", *(c for c in _TYPES if c != "error"))
    parts = good.mapInArrow(run, f"image_id {good.schema['image_id'].dataType.simpleString()}, width INT, height INT, x INT, dark BIGINT, edge DOUBLE")
    return parts.groupBy("image_id", "width", "height", "x").agg(F.sum("dark").alias("dark"), F.sum("edge").alias("edge"))


def cut_columns(found: DataFrame, *, search: float = 0.1) -> DataFrame:
    """(image_id, split_column): where a landscape scan of two pages is cut, as by :func:`foliospark.operators.raster.split_column`."""
    costs = column_costs(found)
    center = F.col("width") / 2
    radius = F.greatest(F.lit(1), F.floor(F.col("width") * search + 0.5))
    score: Column = F.col("dark") / F.col("height") * 0.7 + F.col("edge") / (F.col("height") * 255) * 0.25 + F.abs(F.col("x") - center) / radius * 0.05
    return costs.groupBy("image_id").agg(F.min(F.struct(score.alias("score"), "x")).alias("m")).select("image_id", F.col("m.x").alias("split_column"))


def strip_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, difference): the mean absolute difference of two images of one size, from the sums of their strips."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in columns:
            yield pa.array([int(np.abs(np.frombuffer(p.as_buffer(), np.uint8).astype(np.int16) - np.frombuffer(q.as_buffer(), np.uint8)).sum()) for p, q in zip(x, y, strict=True)], pa.int64())

    other = b.select("image_id", "width", "top", "rows", F.col("data").alias("other"))
    pairs = a.join(other, ["image_id", "width", "top", "rows"]).where("data is not null and other is not null")
    summed = pairs.select("image_id", F.octet_length("data").alias("n"), F.arrow_udf(run, "bigint")("data", "other").alias("d"))
    return summed.groupBy("image_id").agg((F.sum("d") / F.sum("n")).alias("difference"))


def assembled_png(found: DataFrame, level: int = 6) -> DataFrame:
    """(image_id, png, error): strips, in any order, as PNG files, compressed one after the other; strips that are missing are an error."""
    kept = found.select("image_id", *_TYPES)
    kind = kept.schema["image_id"].dataType

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, width, height, at, error = None, 0, 0, 0, None
        packer, parts = None, []

        def done() -> pa.RecordBatch:
            problem = error or (None if at == height else {"code": "IMAGE_INVALID_BUFFER", "message": f"{at} of {height} rows"})
            png = None
            if problem is None:
                parts.append(chunk(b"IDAT", packer.flush()))
                png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + b"".join(parts) + chunk(b"IEND", b"")
            return pa.record_batch({"image_id": pa.array([ident], to_arrow_type(kind)), "png": pa.array([png], pa.binary()), "error": pa.array([problem], _ERROR)})

        begun = False
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("image_id", "width", "height", "top", "rows", "error")}
                if not begun or row["image_id"] != ident:
                    if begun:
                        yield done()
                    begun, ident, width, height, at, error = True, row["image_id"], row["width"] or 0, row["height"] or 0, 0, None
                    packer, parts = zlib.compressobj(level), []
                if row["error"] or error or row["top"] != at or row["width"] != width:
                    error = error or row["error"] or {"code": "IMAGE_INVALID_BUFFER", "message": f"no row {at}"}
                    continue
                lines = np.zeros((row["rows"], width * 3 + 1), np.uint8)
                lines[:, 1:] = np.frombuffer(batch.column("data")[k].as_buffer(), np.uint8).reshape(row["rows"], -1)
                packed = packer.compress(lines.tobytes())
                if packed:
                    parts.append(chunk(b"IDAT", packed))
                at += row["rows"]
        if begun:
            yield done()

    ordered = kept.repartition("image_id").sortWithinPartitions("image_id", F.col("top").asc_nulls_first())
    return ordered.mapInArrow(run, f"image_id {kind.simpleString()}, png BINARY, error STRUCT<code: STRING, message: STRING>")
