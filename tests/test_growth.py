"""What a task holds and does must not grow with the table that it is dealt from."""

import time

import pyarrow as pa

from foliospark import plans
from foliospark.functions import pure
from foliospark.operators.repair import repair

SF = "/root/testdata/sf0.001"


def test_made_documents_are_held_one_at_a_time():
    from foliospark.plans.documents import _documents

    keys = pa.record_batch({"s_suppkey": pa.array(range(20_001, 20_041))})
    sizes = [b.num_rows for b in _documents(iter([keys]))]
    assert sizes == [1] * 40


def test_rows_of_one_split_are_dealt_over_tasks(spark):
    for name in ("q58_embedded_scans", "q64_measurements", "q65_missing_notes", "q67_text_beside_tables_from_lines", "q68_aligned_lines", "q69_consensus_words"):
        found = plans.QUERIES[name](spark, SF)
        assert found.rdd.getNumPartitions() >= 4, name


def _matrix(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_between_equal_ends():
    import random

    r = random.Random(3)
    for _ in range(300):
        a = "".join(r.choice("ab한\U0001f600\U0001f601") for _ in range(r.randrange(40)))
        b = "".join(c if r.random() < 0.8 else r.choice("abc") for c in a)[r.randrange(3) :] + r.choice(("", "a", "\U0001f602"))
        unit = lambda s: s.encode("utf-16-be").hex(" ", 2).split()
        assert pure.distance(a, b) == _matrix(unit(a), unit(b)), (a, b)


def test_a_page_of_many_blocks_and_lines_is_not_their_product():
    n = 2_000
    line = lambda i, text: {"text": text, "box": [80.0, i * 50.0, 600.0, i * 50.0 + 30], "score": None}
    lines = [line(i, f"reading number {i:06d} of the page") for i in range(n)]
    blocks = [{"label": "text", "content": f"gar {i:06d}", "bbox": [70.0, i * 50.0, 610.0, i * 50.0 + 30]} for i in range(n)]
    began = time.process_time()
    out = repair("gar 000007", lines, [], blocks)
    assert out == "reading number 000007 of the page"
    assert time.process_time() - began < 2


def test_a_prefix_is_taken_without_normalising_the_rest(spark):
    from pyspark.sql import functions as F

    from foliospark.functions import text as T

    for text in ("", "ab", "--A b-C.d,E f!g h i", "İK한글 12345678", "\n" * 9 + "0123456789"):
        row = spark.createDataFrame([(text,)], "t string").select(T.start_of(F.col("t")).alias("s"), F.left(T.normalized_text(F.col("t")), F.lit(8)).alias("n")).first()
        assert row.s == row.n, text


def test_a_gate_looks_at_a_band_of_the_matrix(spark):
    from foliospark.plans import readings

    plan = plans.QUERIES["q07_similarity_gate"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein(" in plan and "Some(" in plan
    assert readings(spark, SF).rdd.getNumPartitions() >= 4


def test_texts_without_markup_are_not_searched_for_it(spark):
    from pyspark.sql import functions as F

    from foliospark.functions import text as T

    plan = spark.range(1).select(T.comparable_text(F.col("id").cast("string"), normalize=False))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") >= 4
    texts = ["plain", "a &lt;b&gt; &amp;amp;", "<!-- x [y](z) -->![a](b) [c](d)", "<tr><td>1</td><td>2</td></tr>", "[a<b](c)>", "# h\n- i\n1. j"]
    for t in texts:
        assert spark.createDataFrame([(t,)], "t string").select(T.comparable_text(F.col("t"))).first()[0] == pure.comparable(t), t


def test_nested_values_are_made_a_level_at_a_time():
    from foliospark.functions.values import values
    from foliospark.operators import repair as R

    kind = pa.list_(pa.struct([("text", pa.string()), ("box", pa.list_(pa.float64())), ("score", pa.float64())]))
    line = {"text": "한 a", "box": [1.0, None, float("inf"), 2.0], "score": None}
    some = [[line, None, {"text": None, "box": None, "score": 0.5}], None, [], [line | {"box": [1.0, 2.0, 3.0, 4.0]}]]
    for array in (pa.array(some, kind), pa.array(some * 9, kind)[3:21], pa.array(some, kind)[1:3], pa.array([], kind), pa.array([True, None]), pa.array([1, None, 3])):
        assert values(array) == array.to_pylist()
    assert "to_pylist" not in R._repairing.__code__.co_names  # value by value, the same conversion was half of a page's cost


def test_a_page_of_a_few_lines_is_repaired_in_few_steps():
    """Steps that have nothing to do are not begun: calls are counted, as time depends on the machine."""
    import cProfile
    import pstats

    line = lambda i, text: {"text": text, "box": [80.0, i * 50.0, 600.0, i * 50.0 + 30], "score": None}
    lines = [line(i, f"Tighten the bolt of part {i}") for i in range(4)]
    blocks = [{"label": "text", "content": f"~#{i}%", "bbox": [70.0, i * 50.0, 610.0, i * 50.0 + 30]} for i in range(4)]
    profile = cProfile.Profile()
    assert profile.runcall(repair, "~#0%\n\n~#1%\n\n~#2%\n\n~#3%", lines, [], blocks, [], 1.0, 1.0) == "\n\n".join(x["text"] for x in lines)
    assert pstats.Stats(profile).total_calls < 520
    assert pure.normalized("A-b_C 한 É9") == "abc한9" and pure.normalized("A-b\x7f_C 9") == "abc9" and pure.normalized(None) == ""


def test_pages_of_a_batch_are_ordered_together():
    import random

    from foliospark.errors import FolioError
    from foliospark.operators import layout as L

    r = random.Random(5)
    kind = pa.list_(pa.struct([("bbox", pa.list_(pa.float64())), ("ord", pa.float64()), *((f, pa.string()) for f in ("type", "markdown", "content", "asset_path", "alt"))]))

    def block(i, style):
        x, y = float(r.randrange(4) * 100), float(r.randrange(5) * 60 + r.choice((0, 4, 8) if style < 3 else (0, 20, 45)))
        box = [x, y, x + 90, y + r.choice((40.0, 44.0))]
        if r.random() < 0.01:
            box = r.choice((None, [1.0], [1.0, 2.0, 1.0, 3.0], [1.0, None, 3.0, 4.0], [0.0, 0.0, float("inf"), 1.0]))
        known = r.choice((1.0, 2.0, -0.0, 0.0, float("nan"))) if style == 1 or (style == 2 and r.random() < 0.5) else float(r.randrange(3)) if style == 4 else None
        return {"bbox": box, "ord": known, "type": r.choice(("text", "figure", None)), "markdown": r.choice((None, "", " m ")), "content": r.choice((None, f" block {i}")), "asset_path": r.choice((None, "a.png")), "alt": r.choice((None, " ", "x"))}

    pages = [None if r.random() < 0.02 else [block(i, style) for i in range(r.randrange(7))] for _ in range(400) for style in range(5)]

    def alone(page):
        try:
            return {"markdown": L.render(page), "error": None}
        except FolioError as error:
            return {"markdown": None, "error": L.summary(error)}

    array = pa.array([None, *pages, []], kind)
    for part in (array, array[700:1500], array[:1], array[:0]):
        got = L._rendered(part).to_pylist()
        assert got == [alone(p) for p in part.to_pylist()]


def test_a_clean_page_needs_no_comparison_of_pairs(monkeypatch):
    from foliospark.operators import layout as L

    kind = pa.list_(pa.struct([("bbox", pa.list_(pa.float64())), ("ord", pa.float64()), *((f, pa.string()) for f in ("type", "markdown", "content", "asset_path", "alt"))]))
    block = lambda i, given: {"bbox": [i % 3 * 300.0, i // 3 * 100.0 + i % 3 * 4, i % 3 * 300.0 + 200, i // 3 * 100.0 + i % 3 * 4 + 40], "ord": given, "type": "text", "markdown": None, "content": str(i), "asset_path": None, "alt": None}
    monkeypatch.setattr(L, "overlap", None)
    monkeypatch.setattr(L, "cmp_to_key", None)
    got = L._rendered(pa.array([[block(i, None) for i in (4, 2, 0, 3, 1)], [block(i, -float(i)) for i in (4, 2, 0, 3, 1)]], kind)).to_pylist()
    assert [x["markdown"] for x in got] == ["0\n\n1\n\n2\n\n3\n\n4", "4\n\n3\n\n2\n\n1\n\n0"]


def _optimized(spark, name):
    return plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_manifest_moves_its_pages_once(spark):
    plan = plans.QUERIES["q12_manifest_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan and "merge_collect_list" not in plan


def test_a_file_is_parsed_once(spark):
    plan = _optimized(spark, "q36_sidecar_lines")
    assert plan.count("from_json(") == 1


def test_attributes_of_a_relationship_are_searched_for_once(spark):
    plan = _optimized(spark, "q35_docx_references")
    for name in ("Id", "Target", "Type", "TargetMode"):
        assert plan.count(f"(?<![:\\w.-]){name}\\s") == 1, name


def test_a_stream_takes_three_batches_however_many_files_its_pages_have(spark, tmp_path):
    import glob

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    state = lambda: set(glob.glob(f"{at.removeprefix('file:').replace('//', '/', 1)}/stream-state-*/commits/[0-9]*"))
    spark.read.parquet(f"{SF}/conversations.parquet").repartition(8).write.parquet(f"{tmp_path}/conversations.parquet")
    before = state()
    found = plans.QUERIES["q73_streamed_documents"](spark, str(tmp_path)).count()
    assert found == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    assert 1 <= len(state() - before) <= 4  # three, and one for the watermark


def test_readings_that_are_alike_need_no_distance(monkeypatch):
    import random

    from foliospark.operators import repair as R

    r = random.Random(9)
    for _ in range(2_000):
        a = "".join(r.choice("abc한") for _ in range(r.randrange(14)))
        b = "".join(c if r.random() < 0.8 else r.choice(("", "a", "bc")) for c in a)
        for least in (0.0, 0.5, 0.65, 0.72, 0.75, 0.8, 1.0):
            assert pure.similar(a, b, least) == (pure.similarity(a, b) >= least), (a, b, least)
    assert R.choose("It draws 10A at 110 V of 5%", "1t draws 20 a at 210 W of 6 %") == "It draws 20 a at 110 V of 6 %"
    assert R.choose("It draws 10A at 110V", "It draws 20A at most") == "It draws 10A at 110V"
    monkeypatch.setattr(pure, "distance", None)
    assert R.choose("The pump runs at 101V and draws 11A at most", "The pump runs at 201V and draws 21W at most") == "The pump runs at 201V and draws 11A at most"
    assert R.choose("The pump runs at 101V", "The pump runs at 201V and draws 21W at most") == "The pump runs at 101V"


def test_words_are_corrected_without_distances(monkeypatch):
    import random

    from foliospark.operators import lines as L
    from foliospark.operators import repair as R

    r = random.Random(4)
    for _ in range(3_000):
        a = "".join(r.choice("ab") for _ in range(r.randrange(6)))
        b = "".join(r.choice("ab") for _ in range(len(a) + r.randrange(-1, 3)))
        assert pure.one_apart(a, b) == (0 <= len(b) - len(a) <= 1 and _matrix(a, b) == 1), (a, b)
    long = "·" * 40 + "한 Αb12 İK 345678"
    assert pure.start_of(long) == pure.normalized(long)[:8] and pure.start_of("ab" + "-" * 40) is None
    monkeypatch.setattr(pure, "distance", None)
    assert R.agree("Turn Of the punp at Onn xy off", "Turn Off the pump at On or OFF", "turn off the Pump on") == "Turn Off the pump at Onn xy off"
    page = {"text": "전원 스위치가 Off 위치", "box": [80.0, 105.0, 680.0, 133.0], "score": None}
    block = {"label": "text", "content": "전원 스위치가 Of 위치", "bbox": [70.0, 100.0, 710.0, 148.0]}
    asked, start_of = [], pure.start_of
    monkeypatch.setattr(pure, "start_of", lambda text: asked.append(text) or start_of(text))
    assert repair(block["content"], [page], [page], [block]) == "전원 스위치가 Off 위치"
    assert asked.count(block["content"]) == 1  # not once for each reading
    assert L.anchors([page], [(None, 1.0)]) == []


def test_lines_are_moved_by_a_search_among_anchors_each(monkeypatch):
    import cProfile
    import pstats

    from foliospark.operators import lines as L

    def calls(n):
        lines = [{"text": f"{i:06d} and on", "box": [80.0, i * 70.0, 600.0, i * 70.0 + 30], "score": None} for i in range(n)]
        profile = cProfile.Profile()
        got = profile.runcall(L.aligned, lines, [(pure.start_of(x["text"]), i * 35.0) for i, x in enumerate(lines)])
        assert [x["box"][1] for x in got] == [i * 35.0 - 7.5 for i in range(n)]
        return pstats.Stats(profile).total_calls

    assert calls(600) < 2.2 * calls(300)
    from foliospark.operators import repair as R

    with monkeypatch.context() as m:
        m.setattr(pure, "normalized", None)
        assert R.replacement("it is so", "it is so", "") is None and R.replacement("it is so", "", "") is None
    points = [(0.0, 5.0), (40.0, 10.0), (30.0, 90.0), (80.0, 100.0)]
    assert [L.mapped(y, points, L.reach(points)) for y in (-3, 35, 41, 90)] == [L.mapped(y, points) for y in (-3, 35, 41, 90)]


def test_a_page_is_normalised_once_for_all_its_notes(monkeypatch):
    from foliospark.operators import repair as R

    line = lambda i, text: {"text": text, "box": [80.0, i * 50.0, 600.0, i * 50.0 + 30], "score": None}
    steps = [f"step {i:04d} of the İ work" for i in range(40)]
    notes = [f"Note: {i:04d} holds its charge" for i in range(40)]
    lines = [line(2 * i + k, t) for i in range(40) for k, t in enumerate((notes[i], steps[i]))]
    page, read, normalized = "\n\n".join(steps), [], pure.normalized
    monkeypatch.setattr(pure, "normalized", lambda text: read.append(len(text)) or normalized(text))
    got = R.add_notes(page, lines)
    assert got == "\n\n".join(f"{n}\n\n{s}" for n, s in zip(notes, steps, strict=True))
    assert sum(1 for n in read if n >= len(page)) == 1


def test_small_pages_share_a_batch_and_large_ones_do_not(spark, monkeypatch):
    from foliospark import pipeline, recognize
    from foliospark.operators.raster import encode_png, solid
    from foliospark.plans.documents import PageNumbers
    from foliospark.schemas import SHEETS

    png = bytes(encode_png(solid(120, 60, 255)))
    rows = [(f"/in/{k}.png", 1, f"{k}.png", f"{k}.png", b"none" if k % 9 == 0 else png, None, None, None) for k in range(300)]
    got = {}

    class Frame:  # takes the function that a batch is given to
        sparkSession, columns, schema = spark, pipeline.PAGES.split(), ()

        def mapInArrow(self, run, schema):
            got["run"] = run
            raise StopIteration

    def counts(make, batches):
        try:
            make()
        except StopIteration:
            return [b.num_rows for b in got["run"](iter(batches))]

    sheets = spark.createDataFrame(rows, SHEETS).toArrow().to_batches()
    assert max(counts(lambda: pipeline.prepared(Frame()), sheets)) >= 200
    pages = list(got["run"](iter(sheets)))
    assert sum(b.num_rows for b in pages) == 300 + 300 - len(range(0, 300, 9))
    frame = Frame()
    frame.columns = pages[0].schema.names
    read = counts(lambda: recognize.recognized(frame, PageNumbers()), pages)
    assert sum(read) == sum(b.num_rows for b in pages) and max(read) >= 200
    whole = [r for b in got["run"](iter(pages)) for r in b.select(["doc_id", "side_index"]).to_pylist()]
    assert [(r["doc_id"], r["side_index"]) for r in whole] == [(r["doc_id"], r["side_index"]) for b in pages for r in b.to_pylist()]
    monkeypatch.setattr(pipeline, "MOST_BYTES", 1)
    assert max(counts(lambda: pipeline.prepared(Frame()), sheets)) <= 3  # those of one sheet, and of one without pictures before it


def test_pages_are_dealt_to_the_recogniser_however_few_bytes_they_have(spark, monkeypatch):
    from foliospark import pipeline

    seen = []

    def recognized(pages, recognizer):
        seen.append(pages._jdf.queryExecution().optimizedPlan().toString().splitlines()[0])
        raise StopIteration

    monkeypatch.setattr(pipeline, "recognized", recognized)
    monkeypatch.setattr(pipeline, "prepared", lambda sheets, settings, codec: sheets)
    try:
        pipeline.final_pages(spark.range(3).selectExpr("string(id) AS doc_id", "1 AS page_number"), None)
    except StopIteration:
        pass
    assert "RepartitionByExpression" in seen[0] and seen[0].rstrip().split(", ")[-1].strip("]").isdigit(), seen  # a number that is given is not coalesced


def test_a_numbered_page_is_grouped_as_one_list(spark):
    from foliospark.operators import lines as L

    plan = plans.QUERIES["q43_repair_markdown"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
    boxes = ([1.0, 2.0, 3.0, 4.0], [1, 2, 3, True], [1.0, None, 3.0, 4.0], [1.0, 2.0, float("nan"), 4.0], [1e308] * 4, [1.0, 2.0, "3", 4.0], [1.0], None)
    assert [L._finite(b) for b in boxes] == [True, True, False, False, True, False, False, False]


def test_few_texts_of_a_batch_are_strings_at_once():
    import tracemalloc
    import unicodedata

    from foliospark.functions import text as T

    texts = [None, "", *(f"{i} ﬁ 한 " * 2_000 for i in range(1_000))]
    column = pa.array(texts, pa.string())
    tracemalloc.start()
    (got,) = T._nfkc(iter([column]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # all of them are over 30 MB
    assert got.to_pylist() == [x and unicodedata.normalize("NFKC", x) for x in texts]
    assert [x.to_pylist() for x in T._nfkc(iter([column[:0], column[1:3]]))] == [[], texts[1:2] + [unicodedata.normalize("NFKC", texts[2])]]


def test_blocks_of_a_batch_are_rendered_in_as_many_steps_as_one_page():
    import cProfile
    import pstats

    from foliospark.operators import layout as L

    kind = pa.list_(pa.struct([("bbox", pa.list_(pa.float64())), ("ord", pa.float64()), *((f, pa.string()) for f in ("type", "markdown", "content", "asset_path", "alt"))]))
    odd = (None, "", " ", "x", "\u3000\ufeff\n x  y \u00a0\u2003", "\u180e", "\u200b x", "\U0001f600 ", "\x85\x1c x \x1f")
    texts = [(k, m, c, p, a) for k in ("figure", "text", None) for m in odd for c in odd for p in (None, "", " a b.png ") for a in odd]
    block = lambda i, t: {"bbox": [0.0, 9.0 - i, 8.0, 20.0], "ord": float(-i), **dict(zip(("type", "markdown", "content", "asset_path", "alt"), t, strict=True))}
    pages = [[block(i, t) for i, t in enumerate(texts[at : at + 7])] for at in range(0, len(texts), 7)]

    def steps(column):
        profile = cProfile.Profile()
        got = profile.runcall(L._rendered, column)
        return pstats.Stats(profile).total_calls, got.to_pylist()

    steps(pa.array(pages[:1], kind))  # imports
    few, many = steps(pa.array(pages[:1], kind)), steps(pa.array(pages, kind))
    assert many[1] == [{"markdown": L.render(p), "error": None} for p in pages]
    assert len(pages) > 900 and many[0] <= few[0] + 20, (few[0], many[0])
