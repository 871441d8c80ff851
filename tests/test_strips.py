import os
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from foliospark.errors import FolioError
from foliospark.operators import raster as RA
from foliospark.operators import strips as ST


def two_pages(rng, width, height):
    image = np.full((height, width, 3), 255, np.uint8)
    for _ in range(60):
        x, y = rng.randrange(width), rng.randrange(height)
        if abs(x - width // 2) > width // 14:
            image[y : y + 3, x : x + rng.randrange(4, 20)] = [rng.randrange(256)] * 3 if rng.random() < 0.7 else [rng.randrange(256) for _ in range(3)]
    noise = np.random.default_rng(rng.randrange(10**6)).integers(0, 12, image.shape)
    return (image - noise.clip(0, image)).astype(np.uint8)


def images(seed):
    rng = random.Random(seed)
    return {i: two_pages(rng, w, h) for i, (w, h) in enumerate([(200, 120), (301, 77), (90, 64), (64, 90), (5, 3), (33, 1), (700, 33)])}


def frame(spark, found):
    return spark.createDataFrame([(i, RA.encode_png(a), "clash") for i, a in found.items()], "image_id INT, content BINARY, width STRING").repartition(3)


def pictures(df):
    got = {}
    for r in df.collect():
        assert r.error is None, r
        got[r.image_id] = RA.decode_png(bytes(r.png))
    return got


@pytest.mark.parametrize("rows", [1, 7, 32, 1000])
def test_strips_have_the_cut_and_the_pixels_of_the_whole(spark, rows):
    found = images(rows)
    cut = ST.strips(frame(spark, found), rows=rows)
    assert {i: a.tolist() for i, a in pictures(ST.assembled_png(cut.repartition(5))).items()} == {i: a.tolist() for i, a in found.items()}
    want = {i: RA.split_column(a) for i, a in found.items() if a.shape[1] > a.shape[0] and a.shape[1] > 4}
    assert {r.image_id: r.split_column for r in ST.cut_columns(cut).collect()} == want and len(want) >= 4
    for mode in ("conservative", "text-safe"):
        made = pictures(ST.assembled_png(ST.suppressed_strips(cut, mode)))
        assert all((made[i] == RA.suppress(a, mode)).all() for i, a in found.items())
    difference = {r.image_id: r.difference for r in ST.strip_difference(cut, ST.suppressed_strips(cut)).collect()}
    assert difference == {i: pytest.approx(RA.mean_difference(a, RA.suppress(a))) for i, a in found.items()}


def test_crops_of_strips(spark):
    found = {k: a for k, a in images(3).items() if a.shape[1] >= 64 and a.shape[0] >= 60}
    cut = ST.strips(frame(spark, found), rows=16)
    made = pictures(ST.assembled_png(ST.cropped_strips(cut, 5, 13, 50, 40)))
    assert made and all((made[i] == RA.crop(a, 5, 13, 50, 40)).all() for i, a in found.items())


def variants():
    rng = np.random.default_rng(5)
    for color, channels, depth in ((0, 1, 8), (0, 1, 1), (0, 1, 4), (0, 1, 16), (2, 3, 8), (2, 3, 16), (3, 1, 8), (3, 1, 2), (4, 2, 8), (6, 4, 8)):
        for interlace in (0, 1):
            width, height = 13, 21
            body = b""
            for x, y, across, down in RA.PASSES if interlace else ((0, 0, 1, 1),):
                w, h = -(-(width - x) // across), -(-(height - y) // down)
                if w > 0 and h > 0:
                    stride = (w * channels * depth + 7) // 8
                    body += b"".join(bytes([int(rng.integers(0, 5)) if color != 3 else 0]) + (rng.integers(0, 256, stride).astype(np.uint8) if color != 3 or depth < 8 else rng.integers(0, 4, stride).astype(np.uint8)).tobytes() for _ in range(h))
            chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
            packed = zlib.compress(body)
            yield b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace)) + chunk(b"PLTE", bytes(range(12))) + b"".join(chunk(b"IDAT", packed[i : i + 40]) for i in range(0, len(packed), 40)) + chunk(b"IEND", b"")


def test_every_kind_of_png_in_strips():
    for data in variants():
        whole = RA.decode_png(data)
        for rows in (1, 4, 50):
            width, height, parts = RA.png_rows(data, rows)
            assert (height, width) == whole.shape[:2]
            if parts is not None:
                got = list(parts)
                assert [t for t, _ in got] == list(range(0, height, rows)) and (np.concatenate([p for _, p in got]) == whole).all()


def test_broken_files_are_rows_with_errors(spark):
    good = RA.encode_png(images(1)[0])
    rows = [(1, good[: len(good) // 2]), (2, b"text"), (3, None), (4, good), (5, good[:20])]
    cut = ST.strips(spark.createDataFrame(rows, "image_id INT, content BINARY"), rows=8)
    assert {r.image_id for r in cut.where("error is not null").collect()} == {1, 2, 3, 5}
    made = {r.image_id: (r.png is not None, r.error and r.error.code) for r in ST.assembled_png(cut).collect()}
    assert made == {1: (False, "IMAGE_DECODE_FAILED"), 2: (False, "IMAGE_DECODE_FAILED"), 3: (False, "IMAGE_DECODE_FAILED"), 4: (True, None), 5: (False, "IMAGE_DECODE_FAILED")}
    lost = ST.assembled_png(cut.where("image_id = 4 and top <> 16")).first()
    assert lost.png is None and lost.error.code == "IMAGE_INVALID_BUFFER"
    assert ST.assembled_png(cut.limit(0)).count() == 0 and ST.cut_columns(cut.where("image_id = 2")).count() == 0


def test_memory_does_not_grow_with_the_height():
    peaks = []
    for height in (2_000, 60_000):
        raw = zlib.compressobj(1)
        line = b"\0" + bytes([200, 190, 180]) * 1000
        packed = b"".join(raw.compress(line * 100) for _ in range(height // 100)) + raw.flush()
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1000, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")
        tracemalloc.start()
        seen = sum(len(p) for _, p in RA.png_rows(data, 128)[2])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert seen == height
    assert peaks[1] < 1.5 * peaks[0] < 20 << 20  # of 180 MB of pixels


def test_files_that_end_early_or_are_of_no_known_kind():
    with pytest.raises(FolioError):
        RA.png_rows(b"\x89PNG\r\n\x1a\n" + os.urandom(40), 8)
