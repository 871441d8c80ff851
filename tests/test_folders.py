import json
import os
import random

from pyspark.sql import functions as F

from foliospark import pipeline as PL
from foliospark.folders import convert_folder, named_images, natural_order
from foliospark.functions import pure
from foliospark.operators import assemble as A
from tests.test_pipeline import FOLDER, Fake, scan, write


def test_natural_order_of_names_in_a_plan(spark):
    rng = random.Random(4)
    names = ["page-10.png", "page-2.png", "Page-1.png", "page-002.png", "b", "A", "é1", "e2", "E10", "", "007", "7a", "7", "x9y10", "x9y9"] + ["".join(rng.choice("aB1029-é") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "n STRING").distinct()
    got = [r.n for r in df.orderBy(natural_order(F.col("n")), "n").collect()]
    assert got == sorted(set(names), key=lambda n: (pure.natural_key(n, fold=True), n))


def test_a_folder_is_one_job_with_observed_totals(spark, tmp_path):
    (tmp_path / "in put").mkdir()
    for name, tone in FOLDER.items():
        write(tmp_path / "in put" / name, b"nothing" if tone is None else scan(40, 50, tone))
    totals = convert_folder(spark, f"file://{tmp_path}/in put", f"file://{tmp_path}/out", Fake(), shown=("in put", "out"))
    assert totals == {"discovered": 4, "succeeded": 2, "failed": 2}
    whole = json.loads((tmp_path / "out/batch-summary.json").read_text())
    assert whole["totals"] == totals and (whole["inputDirectory"], whole["outputDirectory"]) == ("in put", "out")
    by_run = PL.run_folder(spark, str(tmp_path / "in put"), str(tmp_path / "other"), recognizer=Fake())["summary"]
    assert whole["results"] == by_run["results"]
    text = lambda f: [x for x in (tmp_path / f / "batch-summary.md").read_text().splitlines() if "입력 폴더" not in x]
    assert text("out") == text("other")
    files = lambda f: sorted(os.path.join(d.removeprefix(str(tmp_path / f)), n) for d, _, ns in os.walk(tmp_path / f) for n in ns)
    assert files("out") == files("other") and not any("staging" in n for n in files("out"))


def test_output_folders_of_images_in_a_plan(spark):
    paths = [f"s3a://b/{n}" for n in ("x.jpg", "x.png", "X-png.gif", "y.png", "x-png-2.bmp", "notes.txt")]
    got = {r.name: r.folder for r in named_images(spark.createDataFrame([(p,) for p in paths], "path STRING")).collect()}
    order = sorted((n.rsplit("/", 1)[1] for n in paths if not n.endswith((".txt", ".gif"))), key=lambda n: (pure.natural_key(n, fold=True), n))
    assert got == dict(zip(order, A.folder_names(order), strict=True))
