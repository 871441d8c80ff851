import bisect
import random
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from foliospark.functions import fold
from foliospark.functions import geometry as G
from foliospark.operators import lines as N
from foliospark.operators import ordered as O
from foliospark.operators.spatial import points_in_rectangles

# --- folds


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_a_scan_gives_an_output_an_item(spark, n):
    df = spark.createDataFrame([(list(range(n)),)], "a ARRAY<INT>")
    sums = fold.scan(F.col("a"), F.lit(0), lambda s, x: s + x, lambda s, x: s, "int")
    assert df.select(sums).first()[0] == [i * (i - 1) // 2 for i in range(n)]


def test_runs_and_binary_search(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(40):
        a = sorted(rng.randrange(20) for _ in range(rng.randrange(0, 40)))
        rows.append((a, [rng.random() < 0.3 for _ in a], rng.randrange(-2, 22)))
    df = spark.createDataFrame(rows, "a ARRAY<INT>, s ARRAY<BOOLEAN>, v INT")
    for r in df.select("a", "s", "v", fold.runs(F.col("a"), F.col("s")).alias("r"), fold.lower_bound(F.col("a"), F.col("v")).alias("b")).collect():
        want = []
        for x, begins in zip(r.a, r.s, strict=True):
            if begins:
                want.append([])
            if want:
                want[-1].append(x)
        assert r.r == want and r.b == bisect.bisect_left(r.a, r.v)


# --- visual rows and numbered paragraphs


def random_page(rng):
    line = lambda: {"text": rng.choice(["a", " b ", "", None, "3) c", "17)d", "2) ", "x 4)", "x"]) and f"{rng.choice(['', '1) ', '22) '])}w{rng.randrange(99)}" if rng.random() < 0.8 else rng.choice(["", None, " 5) z "]), "box": box(), "score": None}

    def box():
        x, y = rng.randrange(0, 300, 10) * 1.0, rng.randrange(0, 600, 7) * 1.0
        return rng.choice([[x, y, x + rng.randrange(5, 200), y + rng.choice([8.0, 20.0, 45.0, 90.0])]] * 12 + [[x, y, x, y], [x, y, x - 5, y + 5], [x, y, float("nan"), y + 5], [x, y, x + 1], None])

    return [line() for _ in range(rng.randrange(0, 60))]


def test_rows_and_paragraphs_of_random_pages_are_those_of_the_python_folds(spark):
    rng = random.Random(11)
    pages = [random_page(rng) for _ in range(150)] + [[], None]
    df = spark.createDataFrame(list(enumerate(pages)), "p INT, lines ARRAY<STRUCT<text: STRING, box: ARRAY<DOUBLE>, score: DOUBLE>>")
    found = df.select("p", N.rows_of(F.col("lines")).alias("rows"), N.numbered_of(F.col("lines")).alias("paragraphs"))
    assert "Arrow" not in plan_of(found) and "Python" not in plan_of(found)
    marked = 0
    for r in found.collect():
        page = pages[r.p] or []
        kept = [x for x in page if N.text_of(x) and N.valid(x.get("box"))]
        assert r.rows == N.visual_rows(sorted(kept, key=lambda x: (N.middle(x), x["box"][0])))
        want = N.numbered_paragraphs(page)
        marked += bool(want)
        assert [(p.number, p.text) for p in r.paragraphs] == want
    assert marked > 50


def test_a_page_of_many_lines(spark):
    n = 20_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.concat((i % 100).cast("string"), F.lit(") x")).alias("text"), F.array(F.lit(0.0), i * 20.0, F.lit(50.0), i * 20.0 + 15).alias("box"), F.lit(None).cast("double").alias("score"))).alias("lines"))
    began = time.time()
    row = df.select(F.size(N.rows_of(F.col("lines"))).alias("rows"), F.size(N.numbered_of(F.col("lines"))).alias("p")).first()
    assert (row.rows, row.p) == (n, n) and time.time() - began < 60


# --- points in rectangles


def test_points_in_rectangles_of_all_sizes_are_those_of_brute_force(spark):
    rng = random.Random(3)
    size = lambda: 10 ** rng.uniform(-3, 5)
    points = [(rng.choice(["a", "b", None]), i, rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for i in range(400)] + [("a", 900, 0.0, 0.0), ("a", 900, 0.0, 0.0), ("a", 901, float("nan"), 0.0), ("a", 902, None, 1.0), ("b", 903, 8.0, 16.0)]
    rects = []
    for i in range(150):
        x, y = rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)
        rects.append((rng.choice(["a", "b", None]), i, x, y, x + size(), y + size()))
    rects += [("a", 500, 0.0, 0.0, 0.0, 0.0), ("b", 501, 8.0, 16.0, 16.0, 32.0), ("b", 502, 0.0, 0.0, 8.0, 16.0), ("a", 503, 5.0, 5.0, -5.0, 9.0), ("a", 504, float("-inf"), 0.0, 9.0, 9.0), ("a", 505, -1e300, -1e300, 1e300, 1e300)]
    p = spark.createDataFrame(points, "page STRING, i INT, x DOUBLE, _row DOUBLE").repartition(3)
    r = spark.createDataFrame(rects, "page STRING, j INT, _x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE").repartition(3)
    tested = Observation()
    got = points_in_rectangles(p, r, ["page"], (F.col("x"), F.col("_row")), (F.col("_x0"), F.col("y0"), F.col("x1"), F.col("y1")), tested)
    assert got.columns == ["page", "i", "x", "_row", "j", "_x0", "y0", "x1", "y1"]
    real = lambda v: v is not None and abs(v) < float("inf")
    want = sorted((a[1], b[1]) for a in points for b in rects if a[0] == b[0] is not None and all(map(real, a[2:] + b[2:])) and b[2] <= a[2] <= b[4] and b[3] <= a[3] <= b[5])
    assert sorted((g.i, g.j) for g in got.collect()) == want and len(want) > 300
    assert tested.get["pairs"] >= len(want)


def test_a_page_of_a_hundred_thousand_boxes(spark):
    n, m = 100_000, 20_000
    at = lambda c, k, of: F.pmod(F.hash(c, F.lit(k)), F.lit(of)).cast("double")
    x, y = at("id", 1, 100_000), at("id", 2, 100_000)
    lines = spark.range(n).select(F.lit(1).alias("page"), "id", F.col("id").cast("string").alias("text"), F.array(x, y, x + 40, y + 12).alias("box"))
    rx, ry, w, h = at("id", 3, 100_000), at("id", 4, 100_000), at("id", 5, 900) + 100, at("id", 6, 90) + 10
    regions = spark.range(m).select(F.lit(1).alias("page"), F.col("id").alias("region_id"), F.array(rx, ry, rx + w, ry + h).alias("region"))
    tested = Observation()
    began = time.time()
    found = G.lines_in_regions(lines, regions, ["page"], tested=tested).count()
    assert time.time() - began < 60
    assert found > 500 and tested.get["pairs"] < 40 * found < n * m / 1000  # of two thousand million pairs


# --- the last fact before a row


@pytest.mark.parametrize(("strict", "split"), [(True, 10**6), (True, 20), (False, 20)])
def test_last_known_facts_are_those_of_brute_force(spark, strict, split):
    rng = random.Random(split + strict)
    group = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    rows = [(i, group(), rng.choice([None, *range(60)])) for i in range(300)] + [(5, "hot", 7), (5, "hot", 7), (1000, "none", 4)]
    facts = [(group(), rng.choice([None, *range(0, 60, 3)]), rng.randrange(5)) for _ in range(150)] + [("hot", 30, None)]
    r = spark.createDataFrame(rows, "id INT, g STRING, t INT").repartition(4)
    f = spark.createDataFrame(facts, "g STRING, since INT, v INT").repartition(4)
    got = O.last_known(r, f, ["g"], "t", "since", strict=strict, split=split).collect()

    def known(g, t):
        own = [x for x in facts if x[0] == g and x[1] is not None and (x[1] < t if strict else x[1] <= t)] if g is not None and t is not None else []
        return max(own, key=lambda x: (x[1], x[2] is not None, x[2] or 0), default=None)

    assert sorted(((x.id, x.g, x.t, tuple(x.known) if x.known else None) for x in got), key=str) == sorted(((*x, known(*x[1:])) for x in rows), key=str)


def test_a_hot_group_is_cut_and_costs_no_product(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit("u").alias("g"), F.col("id").alias("t"))
    facts = spark.range(0, n, 2).select(F.lit("u").alias("g"), F.col("id").alias("since"))
    began = time.time()
    got = O.last_known(rows, facts, ["g"], "t", "since", split=10_000)
    assert "CartesianProduct" not in plan_of(got) and "NestedLoop" not in plan_of(got)
    wrong = got.where(~F.col("known.since").eqNullSafe(F.when(F.col("t") > 0, F.floor((F.col("t") - 1) / 2) * 2))).count()
    assert wrong == 0 and time.time() - began < 90


# --- matches that keep the order


def greedy(blocks, lines):
    out, at = [], 0
    for b in blocks:
        hit = next((i for i in range(at, len(lines)) if b is not None and lines[i] == b), None)
        out.append(hit)
        at = at if hit is None else hit + 1
    return out


def test_matches_in_order_are_those_of_the_greedy_loop(spark):
    rng = random.Random(8)
    some = lambda: [rng.choice(["a", "b", "c", "d", None]) for _ in range(rng.randrange(0, 30))]
    rows = [(i, some(), some()) for i in range(120)] + [(200, ["a"] * 600, ["a"] * 300 + ["b"] * 300)]
    df = spark.createDataFrame(rows, "i INT, b ARRAY<STRING>, l ARRAY<STRING>")
    found = df.select("i", O.in_order(F.col("b"), F.col("l")).alias("m"))
    assert "Python" not in plan_of(found)
    assert {r.i: r.m for r in found.collect()} == {i: greedy(b, l) for i, b, l in rows}


def test_a_page_with_one_key_costs_a_search_a_block(spark):
    df = spark.range(1).select(F.array_repeat(F.lit("k"), 20_000).alias("b"), F.concat(F.array_repeat(F.lit("x"), 20_000), F.array_repeat(F.lit("k"), 20_000)).alias("l"))
    began = time.time()
    got = df.select(O.in_order(F.col("b"), F.col("l")).alias("m")).first().m
    assert got == list(range(20_000, 40_000)) and time.time() - began < 90


# --- names


def test_names_are_those_of_the_loop_over_all_of_a_group(spark):
    from foliospark.operators import assemble as A
    from foliospark.operators import relational as R

    rng = random.Random(21)
    names, rows = {}, []
    for g in (1, 2, None):
        for i in rng.sample(range(1000), 120):
            name = rng.choice(["plan", "Plan", "map", "fig"]) + "".join(rng.choice(["", "", "-2", "-3", "-2-2"]) for _ in range(2)) + rng.choice([".png", ".PNG", ".jpg"])
            names.setdefault(g, []).append((i, name))
            rows.append((g, i, name, "kept"))
    df = spark.createDataFrame(rows, "g INT, i INT, n STRING, base STRING").repartition(5)
    got = {}
    for r in R.unique_names(df, ["g"], "n", "i").collect():
        assert r.base == "kept"
        got.setdefault(r.g, []).append((r.i, r.unique_name))
    for g, own in names.items():
        own.sort()
        assert sorted(got[g]) == list(zip([i for i, _ in own], A.reserve(n for _, n in own), strict=True))


def test_a_million_equal_names_are_numbered_by_a_window(spark):
    from foliospark.operators import relational as R

    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("i"), F.lit("scan.png").alias("n"))
    got = R.unique_names(df, [], "n", "i")
    assert "collect_list" not in plan_of(got)
    began = time.time()
    assert got.where(F.col("unique_name") != F.when(F.col("i") == 0, "scan.png").otherwise(F.concat(F.lit("scan-"), (F.col("i") + 1).cast("string"), F.lit(".png")))).count() == 0
    met = R.unique_names(df.unionByName(spark.createDataFrame([(n, "scan-7.png")], "i BIGINT, n STRING")), [], "n", "i")  # one name that meets a numbered one
    assert met.select(F.count_distinct(F.lower("unique_name"))).first()[0] == n + 1 and met.where(f"i = {n}").first().unique_name == "scan-7-2.png"
    assert time.time() - began < 120
