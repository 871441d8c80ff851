import random
import re

import numpy as np
import pytest

from foliospark.llm import minhash as M
from foliospark.llm import vectors as V
from foliospark.llm.common import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id BIGINT, text STRING, digest STRING, g INT"


def shingles(text, width=3):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width=3, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)), None if d is None or root(i) not in least else d == least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(n // 6):
        text = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(6):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(text) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 100, " ".join(copy)))
    return rows


def test_groups_are_those_of_brute_force(spark):
    rows = corpus()
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (6, "one two"), (None, rows[0][1]), (None, "lone null id of some words"), (7, "x " * 50_000), (8, "É é"), (9, "é É")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], DOCS)
    for options in ({}, {"block": 4, "set_block": 3}):
        got = sorted((tuple(r) for r in M.near_duplicates(df, **options).collect()), key=str)
        assert got == brute(rows)


def test_chains_and_small_blocks(spark):
    # each text is near the next one only, so that one group is a chain
    words = [f"v{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[4 * k : 4 * k + 120])) for k in range(25)]
    df = spark.createDataFrame([(d, t, "", 0) for d, t in rows], DOCS)
    got = sorted((tuple(r) for r in M.near_duplicates(df, block=6, set_block=4).collect()), key=str)
    assert got == brute(rows) and len({r[2] for r in got}) == 1


def test_five_words_and_eight_tenths(spark):
    rows = corpus(9, 36)
    df = spark.createDataFrame([(d, t, "", 0) for d, t in rows], DOCS)
    got = sorted((tuple(r) for r in M.near_duplicates(df, width=5, percent=80, matches=14).collect()), key=str)
    assert got == brute(rows, 5, 80)


def test_empty_table_and_dropping(spark):
    empty = spark.createDataFrame([], DOCS)
    assert M.near_duplicates(empty).collect() == []
    assert M.drop_near_duplicates(empty).collect() == []
    rows = [(3, "a b c d e f"), (2, "A B C D E F"), (2, "A B C D E F"), (9, ""), (8, None), (None, "a b c d e f"), (None, "z y x w v"), (None, "z y x w v"), (5, "other words are here now")]
    df = spark.createDataFrame([(d, t, "d", 1) for d, t in rows], DOCS)
    out = M.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(2, "A B C D E F"), (9, ""), (8, None), (None, "z y x w v"), (5, "other words are here now")], key=str)


def test_shingle_kernel_matches_plain_sets():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é\t\n\x0b\x0c\x1c\xa0Z") for _ in range(rng.randrange(40))) for _ in range(400)]
    raw = b"".join(t.encode() for t in texts)
    off = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    hashes, at = M.shingle_sets(np.frombuffer(raw, np.uint8), off, 3)
    of = {}
    for i, t in enumerate(texts):
        own = hashes[at[i] : at[i + 1]].tolist()
        assert len(own) == len(shingles(t))
        of.setdefault(shingles(t), own)
        assert of[shingles(t)] == own
    assert len({tuple(v) for v in of.values()}) == len(of)


def test_components(spark):
    rng = random.Random(1)
    nodes = [bytes([i // 256, i % 256]) for i in range(300)]
    path = list(range(200))
    rng.shuffle(path)
    edges = [(nodes[a], nodes[b]) for a, b in zip(path, path[1:])] + [(nodes[200 + i], nodes[250 + i % 3]) for i in range(40)]
    df = spark.createDataFrame(edges, "a BINARY, b BINARY").repartition(7)
    for few in (20_000, 5):
        got = {bytes(r.node): bytes(r.root) for r in components(df, few=few).collect()}
        assert len({got[nodes[i]] for i in path}) == 1
        assert len({got[nodes[250 + i]] for i in range(3)}) == 3 and len(got) == 243
    assert components(spark.createDataFrame([], "a BINARY, b BINARY")).collect() == []


VEC = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, key STRING, cell INT"


def brute_vectors(rows, cosine):
    ok = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    degree = [0] * len(rows)
    for i in ok:
        for j in ok:
            a, b = (np.array(np.float32(rows[k][1]), float) for k in (i, j))
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                degree[i] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], degree[i], least.get(root(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("options", [{}, {"cell": 8, "leaf": 4, "sample": 20}])
def test_vector_links_are_those_of_brute_force(spark, options):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        for c in rng.normal(size=(6, 8)):
            for _ in range(9):
                rows.append((len(rows) + 10, [float(x) for x in c + rng.normal(size=8) * rng.choice([0.05, 0.3])], label))
    rows += [(1, rows[0][1], 0), (2, rows[0][1], None), (3, None, 0), (4, [0.0] * 8, 0), (5, [float("nan")] * 8, 0), (6, [None] + [1.0] * 7, 0), (7, [], 0), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0), (None, rows[1][1], 0), (1, rows[0][1], 0), (0, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], VEC)
    got = V.vector_duplicates(df, cosine=0.93, **options)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=str) == brute_vectors(rows, 0.93)


def test_no_vectors(spark):
    assert V.vector_duplicates(spark.createDataFrame([], VEC)).collect() == []


def test_dual_traversal_prunes_and_misses_nothing():
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(size=(50, 16)) * 0.05 for c in rng.normal(size=(12, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = V.cover_tree(x, 8)
    seen, tested = np.zeros((len(x), len(x)), bool), 0
    for a, b in V.dual_traversal(x, tree, x, tree, 0.95):
        seen[np.ix_(a, b)] = True
        tested += len(a) * len(b)
    assert seen[x @ x.T >= 0.95].all() and tested < 0.3 * len(x) ** 2


def test_nodes_cover_their_members_and_unrelated_vectors_are_not_compared():
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(size=(200, 64)) * 0.02 for c in rng.normal(size=(5, 64))] + [rng.normal(size=(300, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]

    def check(node):
        assert V.angles(x[node.members] @ node.center).max() <= node.radius + V._SLACK
        assert not node.children or sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)
        for c in node.children:
            check(c)

    tree, tally = V.cover_tree(x), V.Tally()
    check(tree)
    linked = sum(len(a) * len(b) for a, b in V.dual_traversal(x, tree, x, tree, 0.93, tally, once=True))
    everything = len(x) * (len(x) - 1) // 2
    # 305 centers meet each other; of 1300 vectors only those of one group are compared
    assert tally.centers < 0.1 * everything and linked == tally.pairs < 0.3 * everything


def test_what_is_tested_is_reported(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in c + rng.normal(size=16) * 0.01], 0) for i, c in enumerate(np.repeat(rng.normal(size=(40, 16)), 10, 0))]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], VEC)
    unit = df.select("vec_id", "embedding", "label").mapInArrow(V._prepare_rows, "vec_id bigint, label string, dims int, key binary, unit binary")
    assert unit.where("key is not null").count() == 400
    said = V.vector_links(unit.select("label", "dims", "key", "unit", V.F.lit(1).cast("bigint").alias("copies")), cosine=0.93, cell=50, sample=100).where("key is null").groupBy().sum("n", "centers", "pairs").first()
    assert 0 < said["sum(pairs)"] < 0.3 * 400 * 399 / 2 and said["sum(n)"] <= 400 * 399 / 2


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_long_words_that_sums_of_powers_confuse_differ(spark):
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer((word + other).encode(), np.uint8)
    sets, at = M.shingle_sets(raw, np.array([0, 2048, 4096]), 3)
    assert len(sets) == 2 and sets[0] != sets[1]
    rows = [(0, word), (1, other), (2, word.upper() + " \n"), (3, f"{word} x y"), (4, f"{other} x y")]
    got = M.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id BIGINT, text STRING, g INT"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def test_exact_shingles_are_those_of_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "b", "cé", "cÉ", "\tx"]) for _ in range(rng.randrange(0, 12))) for _ in range(200)] + ["", " \n", "one", "one two", "ONE  two "]
    raw = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(r) for r in raw]))
    for width in (1, 3, 5):
        code, at = M.exact_shingles(np.frombuffer(b"".join(raw), np.uint8), off, width)
        words = [[w for w in re.split(rb"[ \t-\r]+", r.lower()) if w] for r in raw]
        sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set() for w in words]
        mine = [set(code[at[i] : at[i + 1]].tolist()) for i in range(len(raw))]
        assert [len(s) for s in sets] == [len(s) for s in mine]
        for i in range(0, len(raw), 7):
            for j in range(len(raw)):
                assert len(sets[i] & sets[j]) == len(mine[i] & mine[j])


def test_counts_of_merged_lists_are_collisions():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 3, (60, 12)).astype(np.uint32)
    group = np.repeat([0, 1, 2], 20)
    place = np.full(sig.shape, 127, np.int8)
    place[:, 0], here = 0, np.zeros(60, np.int8)
    sig[:, 0] = 7  # the list's own posting
    a, b, n = M.merged_counts(sig, place, here, group, 5)
    want = {(i, j): int((sig[i] == sig[j]).sum()) for i in range(60) for j in range(i + 1, 60) if group[i] == group[j]}
    assert {(i, j): c for i, j, c in zip(a.tolist(), b.tolist(), n.tolist())} == {k: c for k, c in want.items() if c >= 5}
    edges = M.forest(sig[:20], place[:20], here[:20], None, 5)
    label = list(range(20))
    for i, j in edges:
        assert want[min(i, j), max(i, j)] >= 5 and label[i] != label[j]
        label = [label[i] if x == label[j] else x for x in label]
    assert all(label[i] == label[j] for (i, j), c in want.items() if c >= 5 and j < 20)
    place[:, 1] = 0  # an earlier posting in common: that one's list has the pair
    here[:], place[:, 0] = 1, 1
    a, b, _ = M.merged_counts(sig, place, here, group, 5)
    assert all(sig[i, 1] != sig[j, 1] for i, j in zip(a.tolist(), b.tolist()))


def test_groups_too_large_for_blocks_are_decided_by_lists(spark):
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    template = [word() for _ in range(60)]
    for k in range(12):  # sets of one template that match but are no links, and chains of links among them
        text = list(template)
        for i in rng.sample(range(60), 12):
            text[i] = word()
        for _ in range(6):
            rows.append((len(rows), " ".join(text)))
            text[rng.randrange(60)] = word()
    rows += [(1000, rows[3][1]), (1001, None), (None, rows[5][1])]
    want = sorted(((d, n, c, k) for d, n, c, k in brute(rows)), key=str)
    for options in ({"dense": 0, "set_block": 4, "block": 8}, {"dense": 0}, {}):
        got = M.near_duplicates(spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS), matches=12, coordinates=32, **options).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == want
