import random

import public_tokenizers as P

from foliospark.llm.toxicity import score_toxicity
from tests.llm.test_near import brute
from tests.llm.test_texts import brute_repeats

import corpus_pipeline as C


def tables(spark, folder):
    rng = random.Random(21)
    words = [f"word{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        bad = i % 5 == 0
        if bad:
            text[rng.randrange(len(text)) : 0] = [rng.choice(["odious", "wretched"])] * 2
        elif i % 7 == 0:
            text = [*text, passage, *text[:3]]
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    clean = [r for r in rows if r[0] % 5]
    for k, (_, t) in enumerate(clean[:30]):
        copy = t.split()
        if k % 2:
            copy[len(copy) // 2] = "changed"
        rows.append((1000 + k, " ".join(copy)))
    rows += [(2000, None), (2001, ""), (None, "a row without an id that is kept"), (2002, "many words " * 4000)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_each_stage_does_its_work_on_what_is_left(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns

    before = spark.read.parquet(f"{folder}/documents.parquet")
    scored = {r.doc_id: r.score for r in score_toxicity(before, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    after = {r.doc_id for r in kept["toxicity"].collect()}
    assert after == {d for d, s in scored.items() if s < 0.5}
    assert not any(d is not None and d < 240 and d % 5 == 0 for d in after) and len(after) == 192 + 30 + 4

    rows = [(r.doc_id, r.text) for r in kept["toxicity"].collect()]
    want = {d for d, _, component, keep in brute(rows, 5, 80) if keep or component is None}
    assert {r.doc_id for r in kept["near_dedup"].collect()} == want and want < after

    rows = [(r.doc_id, r.text) for r in kept["near_dedup"].collect()]
    cut = {d: w[4].decode("utf-8", "ignore") for (d, _), w in zip(rows, brute_repeats([t for _, t in rows], 200))}
    got = kept["repeat_dedup"].collect()
    assert {r.doc_id: r.text or "" for r in got} == cut and all(r.n_chars == len(r.text or "") for r in got if r.text is not None)
    assert any(len(cut[d]) < len(t or "") for d, t in rows)

    from foliospark.llm.tokens import ByteBpe

    bpe = ByteBpe(P.path("byte_bpe_50k.json"))
    total = sum(len(bpe.encode(r.text or "")) + 1 for r in got)
    pieces = kept["packing"].collect()
    assert sum(p.length for p in pieces) == total and {p.doc_id for p in pieces} == {r.doc_id for r in got}
    assert sum(r.length for r in C.run(spark, folder).collect()) == total


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    names = ["score", "predicted", "held_out", "_digest", "_id", "_text", "_spans", "digest", "uid", "row", "spans", "own", "id", "g"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *(f"doc_id % 3 AS `{n}`" for n in names))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.where(" or ".join(f"`{n}` <> doc_id % 3" for n in names)).count() == 0 < docs.count()
    assert C.STAGES[-1][1](spark, docs, folder).count() > 0


def test_results_outlive_others_and_nothing_else_is_left(spark, tmp_path):
    import os

    from foliospark.llm.minhash import near_duplicates
    from foliospark.session import scope, shared_dir

    folder = f"file://{tmp_path}"
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    shared = shared_dir(spark).removeprefix("file://")
    with scope(spark):
        before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
        held = near_duplicates(docs)
        assert len(set(os.listdir(shared)) - before) == 1
        pieces = C.run(spark, folder)
        assert len(set(os.listdir(shared)) - before) == 2
        assert held.count() == docs.count() and pieces.count() > 0
        assert spark.sql("SHOW TABLES IN foliospark_work").where("tableName like 'texts%'").count() == 0
    assert set(os.listdir(shared)) == before


def test_stages_can_be_chained_and_called_twice(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    first = C.near_dedup(spark, docs, folder)
    once = ids(first)
    chained = C.repeat_dedup(spark, C.near_dedup(spark, C.toxicity(spark, docs, folder), folder), folder)
    other = C.near_dedup(spark, docs.where("doc_id % 2 = 0"), folder)
    assert ids(first) == once and len(once) < docs.count()  # a second caller on the same folder takes nothing away
    kept = ids(chained)
    assert kept and kept == ids(chained) and set(kept) < set(ids(docs)) and 0 < other.count() < len(once)
    assert chained.groupBy().sum("n_chars").first()[0] < C.near_dedup(spark, C.toxicity(spark, docs, folder), folder).groupBy().sum("n_chars").first()[0]
