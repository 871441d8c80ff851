import random
import time

import numpy as np
import pyarrow as pa

from foliospark import plans
from foliospark.functions import pure


def letters(rng, n):
    return "".join(rng.choice("abcdefgh") for _ in range(n))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_whole_documents_have_an_error_rate(spark, tmp_path):
    rng = random.Random(6)
    passages = [(0, letters(rng, 60)), (1, letters(rng, 90)), (2, letters(rng, 10)), (3, "--"), (4, letters(rng, 40))]
    docs = [(0, passages[0][1]), (1, f"{letters(rng, 1500)} {passages[0][1].upper()}, {letters(rng, 900)}\n{passages[1][1]}"), (2, letters(rng, 3000) + passages[1][1][:24] + letters(rng, 50)), (3, passages[2][1]), (4, ""), (5, None), (6, letters(rng, 2500))]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(passages, "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING").write.parquet(f"{folder}/documents.parquet")
    plain = lambda t: "".join(c for c in (t or "").lower() if c.isascii() and c.isalnum())
    want = {(i, d): round(distance(plain(p), plain(t)) / len(plain(p)), 6) for i, p in passages for d, t in docs if plain(p) and plain(p)[:24] in plain(t)}
    assert {(0, 0), (0, 1), (1, 1), (1, 2), (2, 3)} <= set(want)
    assert {(r.item_id, r.doc_id): r.cer for r in plans.QUERIES["q47_passage_error_rate"](spark, folder).collect()} == want


def test_bounded_distance():
    rng = random.Random(8)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab가😀") for _ in range(rng.randrange(12))) for _ in range(2))
        most = rng.randrange(12)
        assert pure.within(a, b, most) == (distance(a, b) <= most), (a, b, most)


def test_udfs_see_no_rows_that_are_guarded(spark):
    from pyspark.sql import functions as F

    from foliospark.functions import text as T

    def strict(column: pa.Array) -> pa.Array:
        assert not any(x is not None and x.isascii() for x in column.to_pylist())
        return column

    df = spark.createDataFrame([("plain",), ("é",), (None,), ("",)], "t STRING")
    udf = F.arrow_udf(strict, "string")
    got = df.select(T.guarded(udf, F.col("t"), T.is_ascii(F.col("t"))).alias("t")).collect()
    assert sorted((r.t for r in got), key=str) == sorted(["plain", "é", None, ""], key=str)
    for f in (T.nfkc, T.encode_uri, T.comparable_text):
        kept = [r.t for r in df.select(f(F.col("t")).alias("t")).collect()]
        assert kept[0] == "plain" and kept[2] is None and kept[3] == ""


def edited(rng, text, edits, alphabet):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out) + 1), rng.randrange(3)
        if kind == 0 or at == len(out):
            out.insert(at, rng.choice(alphabet))
        elif kind == 1:
            del out[at]
        else:
            out[at] = rng.choice(alphabet)
    return "".join(out)


def test_diagonals_give_the_distance_of_random_pairs():
    from foliospark.functions.distance import diagonals

    rng = random.Random(12)
    codes = lambda s: np.array([ord(c) for c in s], np.uint16)
    for _ in range(400):
        alphabet = rng.choice(["a", "ab", "abcdefgh"])
        a = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        b = edited(rng, a, rng.randrange(25), alphabet) if rng.random() < 0.7 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        want = distance(a, b)
        assert diagonals(codes(a), codes(b)) == want, (a, b)
        for most in {0, want - 1, want, want + 3} - {-1}:
            assert diagonals(codes(a), codes(b), most) == (want if want <= most else None)


def test_long_texts_cost_their_length_times_their_distance(spark):
    from pyspark.sql import functions as F

    from foliospark.functions import text as T

    rng = random.Random(13)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(1_000_000))
    other = edited(rng, text, 1000, "XYZ")
    began = time.time()
    found = pure.distance(text, other)
    assert 950 <= found <= 1000 and time.time() - began < 20
    rows = [(1, text, other), (2, text[:1500], other[:1500]), (3, text[:3000], text[5000:8000]), (4, "", text), (5, text, ""), (6, None, text)]
    got = {r.i: r.r for r in spark.createDataFrame(rows, "i INT, a STRING, b STRING").select("i", T.character_error_rate(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got[1] == found / 1_000_000 and got[2] == pure.distance(text[:1500], other[:1500]) / 1500 and got[3] > 0.5 and (got[4], got[5], got[6]) == (1.0, 1.0, None)
    far = text[:2000], "".join(rng.choice("abc") for _ in range(2000))
    assert pure.distance(*far) == distance(*far)  # beyond what diagonals are for
