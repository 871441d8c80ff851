import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import pure
from foliospark.functions import text as T

ALPHABET = "ab XY1２)3.\n\t\r<>/&;|*_`#-!()[]가힣ㄱ’é\xa0　﻿\\%+"
SNIPPETS = ["<td>", "</td>", "</tr>", "&amp;", "&lt;b&gt;", "&AMP;lt;", "&nbsp;", "&copy;", "<!-- x\ny -->", "![a](b.png)", "[t](u)", "12) ", "3\\)", "# ", "- ", "1. ", "<table><tr>", "</table>", "note", "3.1 "]


def texts(n=250):
    rng = random.Random(n)
    return ["".join(rng.choice(SNIPPETS) if rng.random() < 0.4 else rng.choice(ALPHABET) for _ in range(rng.randrange(25))) for _ in range(n)] + ["", None]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i INT, t STRING").cache()


@pytest.mark.parametrize(
    "column, plain",
    [(T.normalized_text, pure.normalized), (T.comparable_text, pure.comparable), (T.cell_text, pure.cell_text), (T.decode_entities, pure.decode_entities), (T.strip, pure.strip), (T.numbered_marker, pure.number_of)],
)
def test_columns_agree_with_plain_rules(table, column, plain):
    for r in table.select("t", column(F.col("t")).alias("got")).collect():
        assert r.got == (None if r.t is None else plain(r.t)), r.t


def test_marker_columns_agree_with_the_repair(table):
    from foliospark.operators import repair as R
    from foliospark.operators.tables import adjacent_text

    rows = table.where("t is not null").select("t", T.escape_markers(F.col("t")).alias("e"), T.marker_numbers(F.col("t")).alias("n"), T.marker_place(F.col("t"), F.lit(12)).alias("p"), T.adjacent_text(F.col("t")).alias("a"))
    for r in rows.collect():
        assert r.e == R.escape_markers(r.t), r.t
        assert set(r.n) == {int(x) for x in R._ANY_NUMBER.findall(r.t)}, r.t
        assert r.p == R.marker_place(r.t, 12) and r.a == adjacent_text(r.t), r.t


def test_similarity_and_error_rates(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab가") for _ in range(rng.randrange(9))), "".join(rng.choice("ab가") for _ in range(rng.randrange(9)))) for _ in range(150)] + [("a😀", "a"), ("", ""), ("", "x")]
    df = spark.createDataFrame(rows, "a STRING, b STRING")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", T.similarity(a, b).alias("s"), T.similar(a, b, 0.65).alias("g"), T.character_error_rate(a, b).alias("e"), T.same_start(a, b, 2).alias("p")).collect():
        assert r.s == pytest.approx(pure.similarity(r.a, r.b)) and r.g == (pure.similarity(r.a, r.b) >= 0.65)
        assert r.e == pytest.approx(pure.error_rate(r.a, r.b)) and r.p == pure.same_start(r.a, r.b, 2)


def test_names_paths_and_references(spark):
    row = spark.createDataFrame([("a\\b|c\r\nd", "/x/Scan.One.PDF", "a+b%20c", "%zz", "![x](i/a.png) <img src='b.png'> ![y](http://h/c.png) ![z](i/a.png \"t\") ![q](/abs)")], "cell STRING, path STRING, u STRING, bad STRING, md STRING")
    got = row.select(T.table_cell(F.col("cell")), T.base_name(F.col("path")), T.extension(F.col("path")), T.stem(F.col("path")), T.url_decoded(F.col("u")), T.url_decoded(F.col("bad")), T.image_references(F.col("md")), T.local_references(F.col("md")), T.encode_uri(F.lit("a b/한.md")), T.page_id(F.lit(7)), T.round_half_up(F.lit(2.5))).first()
    assert tuple(got) == ("a\\\\b\\|c d", "Scan.One.PDF", ".pdf", "Scan.One", "a+b c", None, ["i/a.png", "http://h/c.png", "i/a.png", "/abs", "b.png"], ["i/a.png", "b.png"], "a%20b/%ED%95%9C.md", "page-0007", 3)
    at = spark.sql("SELECT TIMESTAMP '2026-07-20 09:55:15' AS t").select(T.kst(F.col("t")), T.iso(F.col("t"))).first()
    assert tuple(at) == ("2026-07-20 18:55:15 KST", "2026-07-20T09:55:15.000Z")


def test_natural_order():
    names = ["page-10.png", "page-2.png", "Page-1.png", "b", "A"]
    assert sorted(names, key=pure.natural_key) == ["A", "b", "Page-1.png", "page-2.png", "page-10.png"]
    assert sorted(["zeta.PNG", "alpha.png", "alpha.jpg"], key=lambda n: pure.natural_key(n, fold=True)) == ["alpha.jpg", "alpha.png", "zeta.PNG"]


def test_boxes(spark):
    rows = [([0.0, 0.0, 2.0, 4.0],), ([0.0, 0.0, 0.0, 4.0],), ([0.0, 0.0, 2.0],), ([0.0, 0.0, float("nan"), 4.0],), ([0.0, None, 2.0, 4.0],), (None,)]
    b = F.col("b")
    got = spark.createDataFrame(rows, "b ARRAY<DOUBLE>").select(G.valid_box(b).alias("v"), G.finite_box(b).alias("f"), G.checked_box(b)["code"].alias("e")).collect()
    assert [(r.v, r.f) for r in got] == [(True, True), (False, True), (False, False), (False, False), (False, False), (False, False)]
    assert [r.e for r in got] == [None] + ["OCR_INVALID_BLOCK"] * 5
    one = spark.createDataFrame([([10.0, 20.0, 30.0, 60.0], [0.0, 40.0, 5.0, 100.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    assert tuple(one.select(G.vertical_overlap(F.col("a"), F.col("b")), G.scaled(F.col("a"), F.lit(2.0)), G.scaled(F.col("a"), F.lit(0.0)), G.interpolated(F.lit(5.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(20.0))).first()) == (0.5, [5.0, 10.0, 15.0, 30.0], [10.0, 20.0, 30.0, 60.0], 10.0)


def test_tall_cells_and_lines_in_them(spark):
    cells = spark.createDataFrame([(1, b) for b in ([20.0, 20.0, 180.0, 65.0], [190.0, 20.0, 400.0, 65.0], [20.0, 70.0, 180.0, 115.0], [190.0, 70.0, 400.0, 115.0], [700.0, 35.0, 890.0, 390.0])], "page INT, box ARRAY<DOUBLE>")
    regions = G.tall_regions(cells, ["page"]).withColumnRenamed("box", "region")
    assert [r.region for r in regions.collect()] == [[700.0, 35.0, 890.0, 390.0]]
    lines = spark.createDataFrame([(1, "in", [700.0, 100.0, 860.0, 130.0]), (1, "out", [50.0, 50.0, 300.0, 70.0]), (2, "page", [700.0, 100.0, 860.0, 130.0]), (1, " ", [700.0, 100.0, 860.0, 130.0])], "page INT, text STRING, box ARRAY<DOUBLE>")
    found = G.lines_in_regions(lines, regions, ["page"])
    assert [r.text for r in found.collect()] == ["in"]
