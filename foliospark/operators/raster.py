"""Rasters: numpy arrays of height x width x 3 inside vectorised UDFs, PNG bytes in tables.

Decoded pixels never are a column of a job's tables: an A3 page at 300 dpi has 53 MB of them, its PNG a fraction.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.errors import FolioError, summary

# Weights of luminance, and the presets of watermark suppression.
LUMINANCE = (0.2126, 0.7152, 0.0722)
PRESETS: dict[str, dict[str, float] | None] = {
    "off": None,
    "conservative": {"minimum_tone": 150, "maximum_tone": 205, "chroma": 18, "strength": 1},
    "strong": {"minimum_tone": 125, "maximum_tone": 190, "chroma": 30, "strength": 1},
    "text-safe": {"binarize": 150, "chroma": 18, "upscale_below": 1400, "upscale": 2},
}


def checked(width: Any, height: Any, data: Any) -> np.ndarray:
    """An image from its size and its RGB bytes."""
    if not (isinstance(width, int) and isinstance(height, int) and width > 0 and height > 0):
        raise FolioError("IMAGE_INVALID_DIMENSIONS", f"not an image size: {width} x {height}")
    pixels = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else np.asarray(data, np.uint8).ravel()
    if pixels.size != width * height * 3:
        raise FolioError("IMAGE_INVALID_BUFFER", f"{pixels.size} bytes for {width} x {height} pixels")
    return pixels.reshape(height, width, 3)


def solid(width: int, height: int, red: int, green: int | None = None, blue: int | None = None) -> np.ndarray:
    return np.broadcast_to(np.array([red, red if green is None else green, red if blue is None else blue], np.uint8), (height, width, 3)).copy()


def luminance(image: np.ndarray) -> np.ndarray:
    return image[..., 0] * LUMINANCE[0] + image[..., 1] * LUMINANCE[1] + image[..., 2] * LUMINANCE[2]


def crop(image: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
    whole = all(isinstance(v, (int, np.integer)) for v in (left, top, width, height))
    if not whole or left < 0 or top < 0 or width <= 0 or height <= 0 or left + width > image.shape[1] or top + height > image.shape[0]:
        raise FolioError("IMAGE_INVALID_CROP", f"no crop {left},{top} {width} x {height} of {image.shape[1]} x {image.shape[0]}")
    return image[top : top + height, left : left + width]


def scale_nearest(image: np.ndarray, factor: int) -> np.ndarray:
    if not isinstance(factor, (int, np.integer)) or factor < 1:
        raise FolioError("IMAGE_INVALID_SCALE", f"not a whole scale: {factor}")
    return image.repeat(factor, 0).repeat(factor, 1)


def split_column(image: np.ndarray, ratio: float | None = None, *, search: float = 0.1, dark: float = 210) -> int:
    """Where to cut a landscape scan of two pages: the column near the middle with least ink, edges and distance."""
    height, width = image.shape[:2]
    if ratio is not None and not 0 < ratio < 1:
        raise FolioError("IMAGE_INVALID_SPLIT_RATIO", f"not within 0 and 1: {ratio}")
    if width <= height:
        raise FolioError("IMAGE_NOT_LANDSCAPE", f"not landscape: {width} x {height}")
    if ratio is not None:
        return int(np.floor(width * ratio + 0.5))
    center = width / 2
    radius = max(1, int(np.floor(width * search + 0.5)))
    xs, ink, edge = window_costs(image, search=search, dark=dark)
    if not len(xs):
        return int(np.floor(center + 0.5))
    return int(xs[np.argmin(ink / height * 0.7 + edge / (height * 255) * 0.25 + np.abs(xs - center) / radius * 0.05)])


def window_costs(image: np.ndarray, *, search: float = 0.1, dark: float = 210) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns near the middle, their dark windows of five pixels, the sums of their edges); those of strips add up to the image's."""
    width = image.shape[1]
    center = width / 2
    radius = max(1, int(np.floor(width * search + 0.5)))
    xs = np.arange(max(1, int(np.floor(center - radius))), min(width - 2, int(np.ceil(center + radius))) + 1)
    if not len(xs):
        return xs, xs, xs.astype(float)
    light = luminance(image[:, np.clip(np.arange(xs[0] - 2, xs[-1] + 3), 0, width - 1)])
    mean = sum(light[:, k : k + len(xs)] for k in range(5)) / 5
    return xs, (mean < dark).sum(0), np.abs(light[:, 1 : 1 + len(xs)] - light[:, 3 : 3 + len(xs)]).sum(0)


def split_pages(image: np.ndarray, ratio: float | None = None, *, least: float = 0.35) -> tuple[int, list[np.ndarray]]:
    at, width = split_column(image, ratio), image.shape[1]
    if min(at, width - at) < width * least:
        raise FolioError("IMAGE_UNSAFE_SPLIT", f"a page of a cut at {at} of {width} is too narrow")
    return at, [image[:, :at], image[:, at:]]


def smoothstep(t: np.ndarray) -> np.ndarray:
    t = np.clip(t, 0, 1)
    return t * t * (3 - 2 * t)


def suppress(image: np.ndarray, mode: str = "conservative", **overrides: float) -> np.ndarray:
    """The image with neutral mid tones lightened, or in mode text-safe with neutral pixels black or white, and small ones doubled."""
    if mode not in PRESETS:
        raise FolioError("IMAGE_INVALID_WATERMARK_MODE", f"no such mode: {mode}")
    preset = PRESETS[mode]
    if preset is None:
        return image.copy()
    p = {**preset, **overrides}
    light = luminance(image)
    neutral = image.max(-1).astype(np.int16) - image.min(-1) <= p["chroma"]
    if "binarize" in p:
        out = np.where(neutral[..., None], np.where(light <= p["binarize"], 0, 255)[..., None], image).astype(np.uint8)
        return scale_nearest(out, int(p["upscale"])) if out.shape[1] < p["upscale_below"] else out
    lift = smoothstep((light - p["minimum_tone"]) / max(1, p["maximum_tone"] - p["minimum_tone"])) * p["strength"]
    lift = np.where(neutral & (light > p["minimum_tone"]), lift, 0.0)[..., None]
    return np.floor(image + (255.0 - image) * lift + 0.5).clip(0, 255).astype(np.uint8)


def mean_difference(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Mean absolute difference of pixels, of those in the mask if given."""
    d = np.abs(a.astype(np.int16) - b)
    d = d[mask] if mask is not None else d
    return float(d.mean()) if d.size else 0.0


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    height, width = image.shape[:2]
    rows = np.empty((height, width * 3 + 1), np.uint8)
    rows[:, 0] = 0
    rows[:, 1:] = image.reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def _unfiltered(raw: bytes, height: int, stride: int, step: int, above_first: np.ndarray | None = None) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    if above_first is not None:
        out[0] = above_first
    for y in range(height):
        kind, line, up = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            lanes = np.zeros(-(-stride // step) * step, np.uint8)
            lanes[:stride] = line
            out[y + 1] = np.cumsum(lanes.reshape(-1, step), 0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            now, above, left = [0] * (stride + step), up.tolist(), line.tolist()
            for i in range(stride):
                a, b = now[i], above[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[i - step] if i >= step else 0
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                now[i + step] = (left[i] + guess) & 255
            out[y + 1] = now[step:]
        else:
            raise FolioError("IMAGE_DECODE_FAILED", "unknown PNG filter")
    return out[1:]


#: First column, first row and steps of the seven passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _samples(raw: bytes, at: int, width: int, height: int, channels: int, depth: int, color: int) -> tuple[np.ndarray, int]:
    """height x width x channels of 8 bits from filtered rows that begin at ``at``, and where they end."""
    stride = (width * channels * depth + 7) // 8
    rows = _unfiltered(raw[at : at + height * (stride + 1)], height, stride, max(1, channels * depth // 8))
    return _bytes_of(rows, width, channels, depth, color), at + height * (stride + 1)


def _bytes_of(rows: np.ndarray, width: int, channels: int, depth: int, color: int) -> np.ndarray:
    height = len(rows)
    if depth == 16:
        rows = rows.reshape(height, -1, 2)[:, :, 0]
    elif depth < 8:
        rows = np.unpackbits(rows, axis=1).reshape(height, -1, depth) @ (1 << np.arange(depth - 1, -1, -1))
        rows = rows[:, : width * channels]
        rows = rows if color == 3 else rows * (255 // ((1 << depth) - 1))
    return rows.reshape(height, -1, channels)[:, :width].astype(np.uint8)


def _rgb(pixels: np.ndarray, color: int, palette: np.ndarray | None) -> np.ndarray:
    if color == 3:
        if palette is None or pixels.max() >= len(palette):
            raise FolioError("IMAGE_DECODE_FAILED", "no palette")
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, -1) if pixels.shape[-1] < 3 else pixels[..., :3].copy()


def png_rows(data: bytes, rows: int) -> tuple[int, int, Iterator[tuple[int, np.ndarray]] | None]:
    """(width, height, strips) of a PNG: strips (top, RGB) of ``rows`` rows while it is inflated; None in their place if it is interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or len(data) < 33 or data[12:16] != b"IHDR":
        raise FolioError("IMAGE_DECODE_FAILED", "not a PNG")
    width, height, depth, color, _, _, interlace = struct.unpack_from(">IIBBBBB", data, 16)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if channels is None or interlace > 1 or not width or not height:
        raise FolioError("IMAGE_DECODE_FAILED", "empty PNG, or of an unknown kind")
    if interlace:
        return width, height, None
    stride = (width * channels * depth + 7) // 8

    def inflated() -> Iterator[bytes | np.ndarray]:
        """The palette, and pieces of the filtered rows."""
        inflate, view, at = zlib.decompressobj(), memoryview(data), 8
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            body = view[at + 8 : at + 8 + size]
            at += size + 12
            if kind == b"PLTE":
                yield np.frombuffer(bytes(body), np.uint8).reshape(-1, 3)
            while kind == b"IDAT" and len(body):
                yield inflate.decompress(body, 1 << 20)
                body = inflate.unconsumed_tail
            if kind == b"IEND":
                break
        yield inflate.flush()

    def strips() -> Iterator[tuple[int, np.ndarray]]:
        palette, above, top, held = None, None, 0, bytearray()
        try:
            for piece in inflated():
                if isinstance(piece, np.ndarray):
                    palette = piece
                    continue
                held += piece
                while top < height and len(held) >= (n := min(rows, height - top)) * (stride + 1):
                    lines = _unfiltered(bytes(held[: n * (stride + 1)]), n, stride, max(1, channels * depth // 8), above)
                    del held[: n * (stride + 1)]
                    above = lines[-1].copy()
                    yield top, _rgb(_bytes_of(lines, width, channels, depth, color), color, palette)
                    top += n
        except (struct.error, zlib.error, ValueError) as error:
            raise FolioError("IMAGE_DECODE_FAILED", "broken PNG") from error
        if top < height:
            raise FolioError("IMAGE_DECODE_FAILED", "the PNG breaks off")

    return width, height, strips()


def decode_png(data: bytes) -> np.ndarray:
    """PNG of any bit depth, interlaced or not, to RGB; transparency is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise FolioError("IMAGE_DECODE_FAILED", "not a PNG")
    at, packed, palette, head = 8, [], None, None
    try:
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed.append(body)
            elif kind == b"IEND":
                break
            at += size + 12
        width, height, depth, color, _, _, interlace = head
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        if interlace > 1 or not width or not height:
            raise FolioError("IMAGE_DECODE_FAILED", "empty PNG, or interlaced in an unknown way")
        raw, end = zlib.decompress(b"".join(packed)), 0
        if interlace:
            pixels = np.zeros((height, width, channels), np.uint8)
            for x, y, across, down in PASSES:
                w, h = -(-(width - x) // across), -(-(height - y) // down)
                if w > 0 and h > 0:
                    pixels[y::down, x::across], end = _samples(raw, end, w, h, channels, depth, color)
        else:
            pixels, _ = _samples(raw, 0, width, height, channels, depth, color)
    except (struct.error, zlib.error, KeyError, TypeError, ValueError) as error:
        raise FolioError("IMAGE_DECODE_FAILED", "broken PNG") from error
    return _rgb(pixels, color, palette)


def _raster_struct(arrays: list[np.ndarray | dict]) -> pa.Array:
    rows = [{"width": a.shape[1], "height": a.shape[0], "data": np.ascontiguousarray(a).tobytes(), "error": None} if isinstance(a, np.ndarray) else {"width": None, "height": None, "data": None, "error": a} for a in arrays]
    return pa.array(rows, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary()), ("error", pa.struct([("code", pa.string()), ("message", pa.string())]))]))


_RESULT = "width int, height int, data binary, error struct<code: string, message: string>"


def _each(work):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for value in column:
                try:
                    v = value.as_py()
                    out.append(work(checked(v["width"], v["height"], v["data"])))
                except FolioError as error:
                    out.append(summary(error))
            yield _raster_struct(out)

    return F.arrow_udf(run, _RESULT)


def suppressed(image: Column, mode: str, **overrides: float) -> Column:
    """A raster column through :func:`suppress`; a struct with the raster or the error."""
    return _each(lambda a: suppress(a, mode, **overrides))(image)


def split_columns(image: Column, ratio: float | None = None) -> Column:
    """Where :func:`split_column` cuts a raster column; null where it cannot be cut."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for v in column.to_pylist():
                try:
                    out.append(None if v is None else split_column(checked(v["width"], v["height"], v["data"]), ratio))
                except FolioError:
                    out.append(None)
            yield pa.array(out, pa.int32())

    return F.arrow_udf(run, "int")(image)


def cropped(image: Column, left: int, top: int, width: int, height: int) -> Column:
    return _each(lambda a: crop(a, left, top, width, height))(image)


def upscaled(image: Column, factor: int) -> Column:
    return _each(lambda a: scale_nearest(a, factor))(image)


def decoded(content: Column) -> Column:
    """Bytes of images of any supported kind to a raster column."""
    from foliospark.operators.codecs import decode_image

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for value in column:
                try:
                    out.append(decode_image(value.as_py() or b""))
                except FolioError as error:
                    out.append(summary(error))
            yield _raster_struct(out)

    return F.arrow_udf(run, _RESULT)(content)


def pixels(rasters: DataFrame, image: str, *keys: str) -> DataFrame:
    """A row per pixel (keys, x, y, red, green, blue, light): the relational form, for small rasters and for tests."""
    r = F.col(image)
    at = F.posexplode(F.sequence(F.lit(0), r["width"] * r["height"] - 1)).alias("_", "i")
    found = rasters.select(*keys, image, at)
    channel = lambda k: F.conv(F.hex(F.substring(F.col(image)["data"], F.col("i") * 3 + k, F.lit(1))), 16, 10).cast("int")
    flat = found.select(*keys, (F.col("i") % r["width"]).cast("int").alias("x"), F.floor(F.col("i") / r["width"]).cast("int").alias("y"), channel(1).alias("red"), channel(2).alias("green"), channel(3).alias("blue"))
    return flat.withColumn("light", light_of(F.col("red"), F.col("green"), F.col("blue")))


def light_of(red: Column, green: Column, blue: Column) -> Column:
    return red * LUMINANCE[0] + green * LUMINANCE[1] + blue * LUMINANCE[2]


def tone_lift(value: Column, light: Column, chroma: Column, mode: str) -> Column:
    """One channel value through the tone presets, as an expression."""
    p = PRESETS[mode]
    t = F.least(F.greatest((light - p["minimum_tone"]) / max(1, p["maximum_tone"] - p["minimum_tone"]), F.lit(0.0)), F.lit(1.0))
    lifted = F.floor(value + (255 - value) * (t * t * (3 - 2 * t)) * p["strength"] + 0.5)
    return F.when((chroma > p["chroma"]) | (light <= p["minimum_tone"]), value.cast("bigint")).otherwise(lifted)


def binarized(value: Column, light: Column, chroma: Column) -> Column:
    p = PRESETS["text-safe"]
    return F.when(chroma > p["chroma"], value).otherwise(F.when(light <= p["binarize"], 0).otherwise(255))
