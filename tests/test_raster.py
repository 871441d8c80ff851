import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.errors import FolioError
from foliospark.operators import layout as L
from foliospark.operators import raster as R


def code(f, *args, **kw):
    with pytest.raises(FolioError) as e:
        f(*args, **kw)
    return e.value.code


def two_up():
    image = R.solid(200, 80, 255)
    for y in range(10, 70, 8):
        image[y, 8:88] = image[y, 112:192] = 30
    return image


def test_splitting():
    at, pages = R.split_pages(two_up())
    assert 95 <= at <= 105 and pages[0].shape[1] + pages[1].shape[1] == 200
    assert R.split_pages(two_up(), 0.45)[0] == 90
    assert code(R.split_pages, two_up(), 0.2) == "IMAGE_UNSAFE_SPLIT"
    assert code(R.split_pages, R.solid(80, 200, 255)) == "IMAGE_NOT_LANDSCAPE"
    assert code(R.split_pages, two_up(), 1.5) == "IMAGE_INVALID_SPLIT_RATIO"


def test_suppression():
    tones = np.array([[[v, v, v] for v in (25, 195, 255)]], np.uint8)
    out = R.suppress(tones)[0, :, 0]
    assert out[0] == 25 and out[1] == 250 and out[2] == 255
    color = np.array([[[190, 120, 120]]], np.uint8)
    assert (R.suppress(color, "strong") == color).all()
    assert (R.suppress(tones, "off") == tones).all()
    grey = R.solid(1, 1, 180)
    assert R.suppress(grey, "strong")[0, 0, 0] > R.suppress(grey)[0, 0, 0]
    safe = R.suppress(np.array([[[90] * 3, [190] * 3, [190, 100, 100]]], np.uint8), "text-safe")
    assert safe.shape == (2, 6, 3) and safe[0, ::2].tolist() == [[0] * 3, [255] * 3, [190, 100, 100]]
    assert code(R.suppress, grey, "none") == "IMAGE_INVALID_WATERMARK_MODE"


def test_watermark_residue_on_a_drawn_page():
    clean = R.solid(300, 400, 255)
    clean[50:60, 20:280] = 10
    marked = clean.copy()
    marked[200:240, 40:260] = 190
    residue = R.mean_difference(R.suppress(marked), clean) / R.mean_difference(marked, clean)
    assert residue < 0.2 and (R.suppress(marked)[50:60] == marked[50:60]).all()
    mask = np.zeros(clean.shape[:2], bool)
    mask[200:240, 40:260] = True
    assert R.mean_difference(marked, clean, mask) == 65


def test_images():
    assert code(R.checked, 0, 4, b"") == "IMAGE_INVALID_DIMENSIONS" and code(R.checked, 2, 2, b"x") == "IMAGE_INVALID_BUFFER"
    image = R.solid(4, 3, 1, 2, 3)
    assert R.crop(image, 1, 1, 2, 2).shape == (2, 2, 3) and code(R.crop, image, 1, 1, 4, 2) == "IMAGE_INVALID_CROP" and code(R.crop, image, 0.5, 0, 1, 1) == "IMAGE_INVALID_CROP"
    assert R.scale_nearest(image, 2).shape == (6, 8, 3) and code(R.scale_nearest, image, 1.5) == "IMAGE_INVALID_SCALE"
    assert R.luminance(R.solid(1, 1, 100, 50, 200))[0, 0] == pytest.approx(100 * 0.2126 + 50 * 0.7152 + 200 * 0.0722)


def png(width, height, depth, color, rows, filters, palette=b""):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(bytes([f]) + r for f, r in zip(filters, rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png():
    image = np.random.default_rng(1).integers(0, 256, (9, 7, 3), np.uint8)
    assert (R.decode_png(R.encode_png(image)) == image).all()
    assert R.decode_png(R.encode_png(R.solid(4, 2, 240))).tobytes() == bytes([240] * 24)

    def filtered(kind, y):
        row, up = image[y].ravel().astype(int), image[y - 1].ravel().astype(int) if y else np.zeros(21, int)
        left, corner = np.append([0, 0, 0], row[:-3]), np.append([0, 0, 0], up[:-3])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        return ((row - [0 * row, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()

    kinds = [y % 5 for y in range(9)]
    assert (R.decode_png(png(7, 9, 8, 2, [filtered(k, y) for y, k in enumerate(kinds)], kinds)) == image).all()
    assert R.decode_png(png(3, 1, 1, 0, [b"\xa0"], [0]))[0, :, 0].tolist() == [255, 0, 255]
    assert R.decode_png(png(2, 1, 8, 3, [b"\x01\x00"], [0], bytes([1, 2, 3, 4, 5, 6])))[0].tolist() == [[4, 5, 6], [1, 2, 3]]
    assert R.decode_png(png(1, 1, 8, 6, [b"\x01\x02\x03\x00"], [0]))[0, 0].tolist() == [1, 2, 3]
    assert R.decode_png(png(1, 1, 16, 4, [b"\x09\x01\xff\xff"], [0]))[0, 0].tolist() == [9, 9, 9]
    for bad in (b"", b"x" * 50, R.encode_png(image)[:60]):
        assert code(R.decode_png, bad) == "IMAGE_DECODE_FAILED"


def test_raster_columns(spark):
    image = two_up()
    rows = [(1, (200, 80, image.tobytes())), (2, (2, 2, b"x"))]
    df = spark.createDataFrame(rows, "k INT, r STRUCT<width: INT, height: INT, data: BINARY>")
    out = {r.k: r.s for r in df.select("k", R.suppressed(F.col("r"), "text-safe").alias("s")).collect()}
    assert bytes(out[1].data) == R.suppress(image, "text-safe").tobytes() and out[2].error.code == "IMAGE_INVALID_BUFFER"
    assert df.where("k = 1").select(R.cropped(F.col("r"), 0, 0, 5, 6).alias("c")).first().c.width == 5
    back = spark.createDataFrame([(R.encode_png(image),), (b"bad",)], "p BINARY").select(R.decoded(F.col("p")).alias("d")).collect()
    assert bytes(back[0].d.data) == image.tobytes() and back[1].d.error.code == "IMAGE_DECODE_FAILED"
    small = spark.createDataFrame([(1, (3, 2, bytes(range(18))))], "k INT, r STRUCT<width: INT, height: INT, data: BINARY>")
    got = R.pixels(small, "r", "k").orderBy("y", "x").collect()
    assert [(p.x, p.y, p.red, p.green, p.blue) for p in got] == [(i % 3, i // 3, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(6)]
    tones = spark.range(256).select(F.col("id").cast("int").alias("v"))
    light = R.light_of(F.col("v"), F.col("v"), F.col("v"))
    for r in tones.select("v", R.tone_lift(F.col("v"), light, F.lit(0), "conservative").alias("l"), R.binarized(F.col("v"), light, F.lit(0)).alias("b")).collect():
        assert r.l == R.suppress(R.solid(1, 1, r.v))[0, 0, 0] and r.b == (0 if r.v <= 150 else 255)


def block(x0, y0, x1, y1, **kw):
    return {"bbox": [float(v) for v in (x0, y0, x1, y1)], **kw}


def test_reading_order():
    body, table = block(320, 60, 600, 180, content="body"), block(20, 40, 300, 220, content="table")
    assert L.render([body, table]) == "table\n\nbody"
    assert L.render([block(10, 200, 100, 230, content="bottom"), block(400, 10, 500, 40, content="top")]) == "top\n\nbottom"
    assert L.render([block(0, 0, 10, 10, ord=2.0, content="second"), block(0, 30, 10, 40, ord=1.0, content="first")]) == "first\n\nsecond"
    assert code(L.render, [block(0, 0, 0, 10)]) == "OCR_INVALID_BLOCK"
    assert L.render(None) == "" and L.block_markdown(block(0, 0, 1, 1, type="figure", asset_path="a.png", alt=" ")) == "![추출 이미지](a.png)"


def test_layout_columns(spark):
    kinds = "b ARRAY<STRUCT<bbox: ARRAY<DOUBLE>, ord: DOUBLE, type: STRING, markdown: STRING, content: STRING, asset_path: STRING, alt: STRING>>"
    rows = [([([320.0, 60.0, 600.0, 180.0], None, "text", None, " body ", None, None), ([20.0, 40.0, 300.0, 220.0], None, "figure", None, None, "i.png", "x")],), ([([0.0, 0.0, 0.0, 1.0], None, None, "m", None, None, None)],), ([],)]
    df = spark.createDataFrame(rows, kinds)
    got = df.select(L.rendered(F.col("b")).alias("r"), F.transform("b", L.markdown_of).alias("m"), L.block_error(F.col("b"))["code"].alias("e")).collect()
    assert [(r.r.markdown, r.r.error and r.r.error.code, r.e) for r in got] == [("![x](i.png)\n\nbody", None, None), (None, "OCR_INVALID_BLOCK", "OCR_INVALID_BLOCK"), ("", None, None)]
    assert got[0].m == ["body", "![x](i.png)"]
    wide = spark.createDataFrame([(5, 9, None), (9, 5, None), (9, 5, "single")], "w INT, h INT, s STRING")
    args = (F.col("s"), F.col("w"), F.col("h"))
    assert [r[0] for r in wide.select(L.effective_layout("auto", None, *args)).collect()] == ["single", "two-up", "single"]
    assert [r[0] for r in wide.select(L.effective_layout("auto", 0.4, *args)).collect()] == ["two-up"] * 3
