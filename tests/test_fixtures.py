import json
from datetime import datetime, timezone
from xml.etree import ElementTree

import numpy as np
import pytest

from foliospark import fixtures as FX
from foliospark.operators import raster as R
from foliospark.sources.docx import scans

SCALE = 0.2
AT = datetime(2026, 3, 1, 16, 30, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    folder = tmp_path_factory.mktemp("fixtures")
    FX.generate(str(folder), AT, SCALE)
    return {p.name: p.read_bytes() for p in folder.iterdir()}


def images(made):
    return [R.decode_png(made[f"two-up-{n}.png"]) for n in ("clean", "watermarked")]


def test_the_cut_is_in_the_gutter(made):
    for image in images(made):
        assert image.shape == (round(FX.HEIGHT * SCALE), round(FX.WIDTH * SCALE), 3)
        at, pages = R.split_pages(image)
        assert abs(at - (FX.PAGE + FX.GUTTER / 2) * SCALE) <= FX.GUTTER / 2 * SCALE and len(pages) == 2


def test_stamps_stand_at_the_top_and_the_bottom_of_each_page(made):
    clean, marked = images(made)
    differs = (clean != marked).any(-1)
    height, width = differs.shape
    third = [differs[a:b] for a, b in ((0, height // 4), (height // 4, 3 * height // 4), (3 * height // 4, height))]
    assert not third[1].any()
    for part in (third[0], third[2]):
        assert part[:, : width // 2].any() and part[:, width // 2 :].any()


def test_suppression_takes_the_stamps_and_leaves_the_text(made):
    clean, marked = images(made)
    mask = (clean != marked).any(-1)
    left = R.mean_difference(R.suppress(marked, "conservative"), clean, mask) / R.mean_difference(marked, clean, mask)
    assert left < 0.05
    dark = R.luminance(clean) < 100
    assert R.mean_difference(R.suppress(marked, "conservative"), clean, dark & ~mask) == 0


def test_files_are_what_they_say(made):
    about = json.loads(made["fixture-manifest.json"])
    assert about["watermark"]["text"] == "SAMPLE 2026-03-02 01:30:00 KST" and dict(FX.files(about["watermark"]["text"], SCALE)) == made
    assert scans(made["two-up-watermarked.docx"]) == [("scan.png", "document.docx", made["two-up-watermarked.png"])]
    for name in ("clean", "watermarked"):
        texts = [e.text for e in ElementTree.fromstring(made[f"two-up-{name}.svg"]).iter() if e.tag.endswith("text")]
        assert set(FX.MARKERS) <= set(texts) and (about["watermark"]["text"] in texts) == (name == "watermarked")


def test_what_is_expected_passes_against_itself(spark, made):
    from foliospark.operators.evaluate import evaluated

    text = made["expected.md"].decode()
    row = evaluated(spark.createDataFrame([(text, text, "SAMPLE 2026-03-02 01:30:00 KST")], "actual STRING, expected STRING, stamp STRING"), stamp="stamp").first()
    assert row.passed and row.metrics.requiredMarkerRecall == 1 and row.metrics.characterErrorRate == 0


def test_shapes():
    d = FX.Drawing([FX.Box(10, 10, 20, 10, (1, 2, 3), 2), FX.Text(40, 30, "a<b", 10)])
    assert 'fill="#010203"' in d.svg() and "a&lt;b" in d.svg()
    image = np.full((50, 80, 3), 255, np.uint8)
    for s in d.shapes:
        s.draw(image, 1.0)
    assert image[15, 20].tolist() == [1, 2, 3] and image[10, 20].tolist() == [0x22] * 3 and image[28, 41].tolist() == [0x18] * 3 and image[45, 70].tolist() == [255] * 3
