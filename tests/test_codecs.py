"""Images that the Java runtime encodes, against what it decodes itself."""

import struct
import zlib

import numpy as np
import pytest

from foliospark.errors import FolioError
from foliospark.operators import codecs as C
from foliospark.operators.raster import decode_png


def picture(width=53, height=37, seed=0):
    """Smooth colours with some edges; every value occurs."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    out = np.stack([x * 255 / width, y * 255 / height, 128 + 100 * np.sin(x / 7) * np.cos(y / 5)], -1)
    out[height // 3 : height // 2, width // 4 : width // 2] = rng.integers(0, 256, 3)
    return np.clip(out, 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def java(spark):
    jvm = spark._jvm
    IO, Bytes = jvm.javax.imageio.ImageIO, jvm.java.io.ByteArrayOutputStream
    Image = jvm.java.awt.image.BufferedImage

    def image(pixels, kind):
        height, width = pixels.shape[:2]
        out = Image(width, height, kind)
        grid = spark.sparkContext._gateway.new_array(jvm.int, width * height)
        rgb = pixels.astype(np.int64)
        for i, v in enumerate((rgb[..., 0] << 16 | rgb[..., 1] << 8 | rgb[..., 2]).ravel().tolist()):
            grid[i] = v - (1 << 24)
        out.setRGB(0, 0, width, height, grid, 0, width)
        return out

    def encode(pixels, kind, form, compression=None, progressive=False, quality=None):
        writers = IO.getImageWritersByFormatName(form)
        if not writers.hasNext():
            pytest.skip(f"no writer for {form}")
        writer = writers.next()
        stream = Bytes()
        out = IO.createImageOutputStream(stream)
        writer.setOutput(out)
        how = writer.getDefaultWriteParam()
        if compression or quality is not None:
            how.setCompressionMode(2)
            if compression:
                how.setCompressionType(compression)
            if quality is not None:
                how.setCompressionQuality(quality)
        if progressive:
            how.setProgressiveMode(1)
        writer.write(None, jvm.javax.imageio.IIOImage(image(pixels, kind), None, None), how)
        out.flush()
        return bytes(stream.toByteArray())

    def decode(data):
        found = IO.read(jvm.java.io.ByteArrayInputStream(data))
        width, height = found.getWidth(), found.getHeight()
        if found.getType() == GREY:  # its colours would go through another gamma
            grey = np.array(list(found.getRaster().getSamples(0, 0, width, height, 0, spark.sparkContext._gateway.new_array(jvm.int, width * height))))
            return grey.reshape(height, width, 1).repeat(3, -1).astype(np.uint8)
        flat = np.array(list(found.getRGB(0, 0, width, height, None, 0, width)), np.int64) & 0xFFFFFF
        return np.stack([flat >> 16, flat >> 8 & 255, flat & 255], -1).reshape(height, width, 3).astype(np.uint8)

    return encode, decode


RGB, GREY, BINARY, INDEXED = 5, 10, 12, 13


@pytest.mark.parametrize("size", [(53, 37), (64, 48), (8, 8), (1, 1), (17, 90)])
@pytest.mark.parametrize("kind", [RGB, GREY])
@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg(java, size, kind, progressive):
    encode, decode = java
    data = encode(picture(*size), kind, "jpeg", progressive=progressive, quality=0.9)
    mine, theirs = C.decode_image(data), decode(data)
    difference = mine.astype(int) - theirs
    assert mine.shape == theirs.shape
    if kind == GREY:
        assert np.abs(difference).max() <= 1
    else:  # the other side smooths the colours, which are stored at half the size
        assert np.abs(difference @ [0.299, 0.587, 0.114]).mean() < 3 and np.abs(difference).mean() < (5 if min(size) > 16 else 16)


def test_broken_jpegs(java):
    encode, _ = java
    data = encode(picture(), RGB, "jpeg")
    for bad in (data[:2], data[:100], data[: len(data) // 2], b"\xff\xd8\xff\xd9", data.replace(b"\xff\xc0", b"\xff\xc9")):
        with pytest.raises(FolioError):
            C.decode_image(bad)


@pytest.mark.parametrize("compression", [None, "LZW", "Deflate", "ZLib", "PackBits", "JPEG"])
@pytest.mark.parametrize("kind", [RGB, GREY, BINARY, INDEXED])
def test_tiff(java, kind, compression):
    if compression == "JPEG" and kind in (BINARY, INDEXED):
        pytest.skip("not written so")
    encode, decode = java
    data = encode(picture(61, 45, 3), kind, "tiff", compression)
    mine, theirs = C.decode_image(data), decode(data)
    if compression == "JPEG":
        assert np.abs(mine.astype(int) - theirs).mean() < 5
    else:
        assert (mine == theirs).all()


@pytest.mark.parametrize("kind, compression", [(RGB, None), (INDEXED, None), (BINARY, None), (INDEXED, "BI_RLE8")])
def test_bmp(java, kind, compression):
    encode, decode = java
    data = encode(picture(45, 30, 5), kind, "bmp", compression)
    assert (C.decode_image(data) == decode(data)).all()


@pytest.mark.parametrize("kind", [RGB, INDEXED, BINARY])
@pytest.mark.parametrize("size", [(53, 37), (3, 2), (1, 1), (9, 9)])
def test_interlaced_png(java, kind, size):
    encode, decode = java
    data = encode(picture(*size), kind, "png", progressive=True)
    assert struct.unpack_from(">B", data, 28)[0] == 1 and (decode_png(data) == decode(data)).all() and (C.decode_image(data) == decode(data)).all()


def test_small_codecs():
    assert C._pack_bits(bytes([2, 65, 66, 67, 254, 68, 128, 0, 69])) == b"ABCDDDE"
    assert sorted(C.ZIGZAG.tolist()) == list(range(64)) and C.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]
    top_down = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54, 40, 2, -2, 1, 32, 0, 0, 0, 0, 0, 0) + bytes([1, 2, 3, 0, 4, 5, 6, 0, 7, 8, 9, 0, 10, 11, 12, 0])
    assert C.decode_bmp(top_down).tolist() == [[[3, 2, 1], [6, 5, 4]], [[9, 8, 7], [12, 11, 10]]]
    fives = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54, 40, 1, 1, 1, 16, 0, 0, 0, 0, 0, 0) + struct.pack("<HH", 0x7C00 | 0x1F, 0)
    assert C.decode_bmp(fives).tolist() == [[[255, 0, 255]]]


def test_tiff_of_tiles_planes_and_predictors():
    pixels = picture(40, 24, 9)

    def tiff(order, tags, body):
        entries = sorted(tags.items())
        head, extra, at = b"", b"", 8 + 2 + 12 * len(entries) + 4
        for tag, values in entries:
            raw = struct.pack(f"{order}{len(values)}I", *values)
            if len(raw) > 4:
                head += struct.pack(order + "HHII", tag, 4, len(values), at + len(extra))
                extra += raw
            else:
                head += struct.pack(order + "HHI", tag, 4, len(values)) + raw.ljust(4, b"\0")
        start = at + len(extra)
        return start, lambda: (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", len(entries)) + head + struct.pack(order + "I", 0) + extra + body

    for order in "<>":
        padded = np.zeros((32, 48, 3), np.uint8)
        padded[:24, :40] = pixels
        tiles = [zlib.compress(padded[y : y + 16, x : x + 16].tobytes()) for y in (0, 16) for x in (0, 16, 32)]
        tags = {256: [40], 257: [24], 258: [8], 259: [8], 262: [2], 277: [3], 322: [16], 323: [16], 324: [0] * 6, 325: [len(t) for t in tiles]}
        start, _ = tiff(order, tags, b"")
        tags[324] = [start + sum(map(len, tiles[:k])) for k in range(6)]
        assert (C.decode_image(tiff(order, tags, b"".join(tiles))[1]()) == pixels).all()
        planes = [zlib.compress(np.diff(pixels[..., c], axis=1, prepend=0).astype(np.uint8).tobytes()) for c in range(3)]
        tags = {256: [40], 257: [24], 258: [8], 259: [8], 262: [2], 273: [0] * 3, 277: [3], 278: [24], 279: [len(p) for p in planes], 284: [2], 317: [2]}
        start, _ = tiff(order, tags, b"")
        tags[273] = [start + sum(map(len, planes[:k])) for k in range(3)]
        assert (C.decode_image(tiff(order, tags, b"".join(planes))[1]()) == pixels).all()


@pytest.mark.parametrize("data", [b"", b"BM", b"II*\0", b"RIFF\0\0\0\0WEBPVP8 ", b"GIF89a", b"\x89PNG", b"\xff\xd8"])
def test_what_is_no_image(data):
    with pytest.raises(FolioError) as e:
        C.decode_image(data)
    assert e.value.code == "IMAGE_DECODE_FAILED"
