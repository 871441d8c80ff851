import base64
import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import html_extract as H
from foliospark.llm import media as MD
from foliospark.llm import packing as PK
from foliospark.llm import sampling as SP
from foliospark.llm import suffix as SF
from foliospark.llm import tokens as TK
from foliospark.llm import toxicity as TX
from foliospark.llm import warc as W

DOCS = "doc_id BIGINT, text STRING, uid STRING, bytes STRING, spans INT, key STRING"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "clash", "clash", 1, "clash") for d, t in rows], DOCS)


# --- repeats

def brute_repeats(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for k, r in enumerate(raw):
        for i in range(len(r) - n + 1):
            seen.setdefault(r[i : i + n], []).append((k, i))
    cover = [bytearray(len(r)) for r in raw]
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                cover[k][i : i + n] = b"\1" * n
    out = []
    for r, c in zip(raw, cover):
        kept = bytes(b for b, x in zip(r, c) if not x)
        spans = sum(1 for i, x in enumerate(c) if x and (i == 0 or not c[i - 1]))
        out.append((len(r), sum(c), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def repeat_texts(seed, n):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcé ") for _ in range(k))
    shared = [word(k) for k in (n - 1, n, n + 1, 2 * n, 5 * n)]
    texts = []
    for _ in range(30):
        texts.append("".join(rng.choice([word(rng.randrange(1, 2 * n)), rng.choice(shared), rng.choice(shared)[: rng.randrange(n // 2, 2 * n)]]) for _ in range(rng.randrange(1, 6))))
    texts += [texts[0], texts[0], None, "", "a" * (3 * n), "ab" * n, word(n)]
    return texts


@pytest.mark.parametrize("n", [20, 40])
def test_repeats_are_those_of_brute_force(spark, n):
    texts = repeat_texts(n, n)
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)]
    got = SF.remove_repeats(docs(spark, rows), min_len=n, keep_bytes=True).collect()
    want = [(d, *w) for (d, _), w in zip(rows, brute_repeats(texts, n))]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=str) == sorted(want, key=str)


def test_repeats_of_many_contexts_and_long_texts(spark, monkeypatch):
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdef") for _ in range(60))
    texts = ["".join(rng.choice("ghijkl") for _ in range(25)) + shared + "".join(rng.choice("mnopq") for _ in range(25)) for _ in range(40)] + ["".join(rng.choice("rstuv") for _ in range(5000)) * 2]
    spans = SF.repeat_spans(SF.distinct_texts(SF.with_digest(docs(spark, list(enumerate(texts))), "doc_id", "text").withColumn("uid", SF.F.substring("digest", 1, 16)), "uid"), min_len=50, group=5, suffixes=60)
    covered = {}
    for r in spans.collect():
        covered.setdefault(bytes(r.uid), set()).update(range(r.s, r.e))
    assert sorted(len(v) for v in covered.values()) == sorted(w[1] for w in brute_repeats(texts, 50) if w[1])


def test_cutting_keeps_columns_and_whole_characters(spark):
    texts = ["é" * 30 + "x", "y" + "é" * 30, "short", None]
    df = docs(spark, list(enumerate(texts)))
    out = SF.cut_repeats(df, min_len=41)
    assert out.columns == df.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["x", "y", "short", None]


def test_maximal_repeats_have_all_occurrences():
    text = b"xabcdeyabcdezabcdw"
    raw = np.frombuffer(text, np.uint8)
    start = np.arange(len(text))
    got = {(n, tuple(sorted(start[m].tolist()))) for n, m in SF.maximal_repeats(raw, start, len(text) - start, 3, start > 0)}
    assert got == {(5, (1, 7)), (4, (1, 7, 13))}


def test_no_texts(spark):
    none = docs(spark, [])
    for out in (SF.remove_repeats(none), SF.cut_repeats(none), MD.media_column(none), TK.count_tokens(none, P.path("word_bpe_49k.json")), PK.pack_documents(none, P.path("byte_bpe_50k.json")), SP.sample_segmentations(none, P.path("piece_bpe_32k.model"))):
        assert out.collect() == []


# --- media

@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=9), st.sampled_from([1, 3]))
def test_lacing(frames, lacing):
    block = b"\x81\x00\x05" + bytes([0x80 | lacing << 1]) + MD.laced(frames, lacing)
    track, time, _, at = MD._block(block, 0, len(block))
    assert (track, time) == (1, 5) and [block[a : a + n] for a, n in at] == frames


@pytest.mark.parametrize("n", [192, 1536, 1536 * 8, 1536 * 8 * 16, 1536 * 8 * 40 + 192 * 5])
def test_matroska_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = MD.write_matroska(payload)
    media = MD.parse_matroska(data)
    assert media.whole and media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["rate"] == 8000
    assert b"".join(data[p.start : p.start + p.size] for p in media.packets) == payload
    assert [p.time_ns for p in media.packets] == [i * 192_000_000 for i in range(len(media.packets))]
    assert {c for _, _, c in media.cues} == {p.cluster for p in media.packets} and all(data[c : c + 4] == b"\x1fC\xb6u" for _, _, c in media.cues)
    broken = MD.parse_matroska(data[:-1000])
    assert not broken.whole or n < 1200
    assert MD.parse_matroska(b"") == MD.Media({}, [], [], True) and not MD.parse_matroska(b"\x00\x01").whole


def test_unknown_sizes():
    track = MD.element(MD.TRACKS, MD.element(MD.TRACK, MD.unsigned(MD.NUMBER, 1)))
    cluster = lambda t: MD.CLUSTER.to_bytes(4, "big") + b"\xff" + MD.unsigned(MD.TIME, t) + MD.element(MD.GROUP, MD.element(MD.BLOCK, b"\x81\x00\x02\x00", b"data%d" % t), MD.unsigned(MD.BLOCK_DURATION, 3))
    media = MD.parse_matroska(MD.SEGMENT.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + track + cluster(1) + cluster(9))
    assert media.whole and [(p.time_ns, p.size) for p in media.packets] == [(3_000_000, 5), (11_000_000, 5)]


def test_media_column(spark):
    rows = [(1, None), (2, ""), (3, "a" * 192), (4, "é" * 5000), (4, "é" * 5000), (None, "x")]
    got = {(r.doc_id, r.n_bytes): r for r in MD.media_column(docs(spark, rows)).collect()}
    for d, t in rows:
        text = (t or "").encode()
        payload = text.ljust(max(1, -(-len(text) // 192)) * 192)
        r = got[d, len(text)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert MD.media_column(docs(spark, rows)).count() == len(rows)
    packets = MD.packet_table(MD.to_media(docs(spark, rows))).where("doc_id = 3").collect()
    assert [(p.track, p.size, p.lacing, p.cued) for p in packets] == [(1, 192, 0, True)]


# --- tokens and packing

FUZZ = "abcDEF 012'’ \t\n<|>endoftext.,!?-_éÉñß¿¡ª²½µ×÷ \xa0\x85\x1cŒœ中あ😀İ"


def fuzz(n):
    rng = random.Random(n)
    return ["".join(rng.choice(FUZZ) for _ in range(rng.randrange(60))) for _ in range(n)] + ["a<|endoftext|>b", "<|startoftext|>x", "it's I'LL don'T 'S !!'s", "", "x" * 5000]


def test_counts_are_the_library_s():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        counter = TK.TokenCounter(P.path(name))
        assert counter.count(fuzz(2000)) == counter._encode(fuzz(2000))


def test_ids_are_the_library_s():
    bpe = TK.ByteBpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in fuzz(2000):
        assert bpe.encode(t) == bpe.library.encode(t, add_special_tokens=False).ids


def test_cache_is_filled_and_used(spark, tmp_path):
    path, cache = P.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    rows = [(1, "a b  c"), (2, "a b\nc"), (3, None), (None, "a b  c"), (4, "word " * 3000)]
    want = {1: 3, 2: 3, 3: 0, None: 3, 4: 3000}
    first = TK.count_tokens(docs(spark, rows), path, cache=cache)
    assert {r.doc_id: r.n_tokens for r in first.collect()} == want and {r.doc_id for r in first.collect() if r.over_limit} == {4}
    store = f"{cache}/tokenizer={TK.tokenizer_version(path)}"
    assert spark.read.parquet(store).count() == 3
    TK.count_tokens(docs(spark, [*rows, (5, "new text")]), path, cache=cache).collect()
    assert spark.read.parquet(store).count() == 4


def test_counts_that_the_cache_has_twice_count_once(spark, tmp_path):
    path, cache = P.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    rows = [(1, "a b  c"), (2, "a b c"), (3, "d")]
    TK.count_tokens(docs(spark, rows), path, cache=cache)
    store = f"{cache}/tokenizer={TK.tokenizer_version(path)}"
    spark.read.parquet(store).write.mode("append").parquet(f"{cache}/copy")
    spark.read.parquet(f"{cache}/copy").write.mode("append").parquet(store)
    assert spark.read.parquet(store).count() == 4
    assert sorted((r.doc_id, r.n_tokens) for r in TK.count_tokens(docs(spark, rows), path, cache=cache).collect()) == [(1, 3), (2, 3), (3, 1)]


def test_windows_keep_what_the_rule_put_there():
    rng = random.Random(9)
    packer, put, out = PK.Packer(1024), 0, []
    for k in range(400):
        out += packer.add(k, np.arange(rng.randrange(1, 1500), dtype="<u4"))
    left = {w: [p[:3] for p in pieces] for at in packer.open for w, pieces in at}
    closed = list(packer.close())
    by = {}
    for doc, start, ids, tokens, window, offset in [*out, *closed]:
        by.setdefault(window, []).append((offset, len(ids)))
        assert ids[0] == start
    for own in by.values():
        total = sum(n for _, n in own)
        assert total == 1024 or total & (total - 1) == 0
    kept = sum((doc, start) in {(d, s) for d, s, _ in left.get(window, [])} for doc, start, _, _, window, _ in closed)
    assert kept >= 0.5 * sum(map(len, left.values())) or len(left) < 8


def test_packing_places_every_id_once(spark):
    rng = random.Random(6)
    rows = [(i if i else None, " ".join(rng.choice(["alpha", "beta", "Überß", "x1"]) for _ in range(rng.choice([0, 1, 50, 900, 3000])))) for i in range(80)] + [(5, "again"), (5, "again"), (6, None)]
    pieces = PK.pack_documents(docs(spark, rows).repartition(3), P.path("byte_bpe_50k.json"), size=1024).collect()
    windows = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        windows.setdefault(p.sequence_id, []).append(p)
    for own in windows.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0
    bpe = TK.ByteBpe(P.path("byte_bpe_50k.json"))
    want, got = {}, {}
    for d, t in rows:
        want.setdefault(d, []).append([*bpe.encode(t or ""), 0])
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
    for d, texts in want.items():
        ids = {}
        for p in got[d]:
            ids.setdefault(p.start, []).extend([np.frombuffer(p.ids, "<u4").tolist()])
        if len(texts) == 1:
            assert sum((ids[s][0] for s in sorted(ids)), []) == texts[0]
        else:
            assert sum(len(x) for v in ids.values() for x in v) == sum(map(len, texts))


def test_sum_of_squares_rule():
    rng = random.Random(2)
    packer = PK.Packer(16)
    for k in range(300):
        n = rng.randrange(1, 16)
        options = [0, *(h for h in range(1, 17 - n) if packer.levels[h])]

        def squares(h):
            levels = packer.levels.copy()
            if h:
                levels[h] -= 1
            if h + n < 16:
                levels[h + n] += 1
            return int((levels**2).sum())

        chosen = packer.choose(n)
        assert chosen in options and squares(chosen) == min(map(squares, options))
        list(packer.add(k, np.zeros(n, "<u4")))
        assert packer.levels.tolist() == [len(x) for x in packer.open]


# --- toxicity

def test_toxicity_learns_from_rows_that_are_not_held_out(spark):
    rng = random.Random(12)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["Wretched", "odious"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(None, "alpha odious"), (1000, None), (1001, ""), (1001, "")]
    df, lab = docs(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id BIGINT, toxic INT")
    out = TX.score_toxicity(df, lab).collect()
    assert len(out) == len(rows)
    truth = dict(labels)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 4 == 2}
    known = [r for r in held if r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in known) >= 0.97 * len(known)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    flipped = spark.createDataFrame([(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, y in labels], "doc_id BIGINT, toxic INT")
    again = {r.doc_id: r.score for r in TX.score_toxicity(df, flipped).collect() if r.doc_id is not None}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out if r.doc_id is not None)


def test_toxicity_without_rows(spark):
    lab = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    assert TX.score_toxicity(docs(spark, []), lab).collect() == []
    assert [r.score for r in TX.score_toxicity(docs(spark, [(1, "x")]), lab).collect()] == [0.5]


# --- archives

@pytest.mark.parametrize("zip64", [False, True])
def test_packages(zip64):
    data = W.write_package([("a.txt", b"hello"), ("é/b", b""), ("c", b"x" * 1000)], zip64=zip64)
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.testzip() is None and z.read("c") == b"x" * 1000
    reads = []
    package = W.Package(lambda s, n: reads.append((s, n)) or data[s : s + n], len(data))
    assert package.read(package.members["a.txt"], 1, 3) == b"ell" and package.read(package.members["é/b"]) == b""
    for start, size in ((990, 20), (-1, 3)):
        with pytest.raises(W.PackageError):
            package.read(package.members["c"], start, size)
    for broken in (b"", b"PK", data[:-30], data[:60]):
        with pytest.raises(W.PackageError):
            W.Package(lambda s, n, d=broken: d[s : s + n], len(broken))


def test_packages_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored", b"abc")
        z.writestr("packed", b"abc" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    data = out.getvalue()
    package = W.Package(lambda s, n: data[s : s + n], len(data))
    assert package.read(package.members["stored"]) == b"abc" and package.read(package.members["packed"]) == b"abc" * 1000


def test_records_come_back(spark):
    rows = [(5, "http://a/\r\nx", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (7, None, None), (8, "http://c", ""), (9, "u", "é\r\n\r\n" * 4000), (None, "n", "<p>one</p>"), (None, "m", "only")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id BIGINT, url STRING, html STRING, payload STRING, first INT")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.archive_pages(df, most=300).collect()), key=str)
    least = {}
    for d, _, h in rows:
        if d is not None:
            least[h or ""] = min(d, least.get(h or "", d))
    want = []
    for d, _, h in rows:
        b, first = (h or "").encode(), least.get(h or "")
        again = first is not None and first != d
        want.append((d, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert W.archive_pages(df.where("false")).collect() == []
    assert W.archive_pages(df, least=11).where("record_type = 'revisit'").count() == 0


def test_archives_of_others_and_broken_ones(spark, tmp_path):
    import gzip

    pages = [(i, f"http://b.example/{i}", f"<p>{i}</p>" * 50) for i in range(5)]
    plain = [W.write_record(i, u, h.encode(), W.payload_digest(h.encode())) for i, u, h in pages]
    zipped = [gzip.compress(x) for x in plain]
    at = np.append(0, np.cumsum([len(x) for x in zipped])).tolist()
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    lines = " CDX N b a m s k r M S V g\n" + "".join(f"example,b)/{i} 2020 u text/html 200 X - - {at[i + 1] - at[i]} {at[i]} data.warc.gz\n" for i in range(5))
    cdxj = "!meta {}\n" + "".join(f'example,b)/{i} 2020 {{"filename":"data.warc.gz","offset":"{at[i]}","length":{at[i + 1] - at[i]}}}\n' for i in reversed(range(5)))
    whole, warc = {r[0] for r in pages}, b"".join(zipped)
    kinds = {
        "plain": [("archive/a.warc", info + b"".join(plain))], "gz": [("archive/a.warc.gz", gzip.compress(info) + warc)], "cdx": [("archive/data.warc.gz", warc), ("indexes/index.cdx.gz", gzip.compress(lines.encode()))],
        "cdxj": [("archive/data.warc.gz", warc), ("indexes/index.cdxj", cdxj.encode())], "lost": [("indexes/index.cdxj", cdxj.encode())], "bad": [("archive/data.warc.gz", warc[: at[2] + 5] + b"\0" * (at[3] - at[2] - 5) + warc[at[3] :]), ("indexes/index.cdxj", cdxj.encode())],
    }
    for name, members in kinds.items():
        (tmp_path / name).write_bytes(W.write_package(members, zip64=name == "cdx"))
    (tmp_path / "cut").write_bytes(W.write_package(kinds["cdxj"])[:-40])
    (tmp_path / "empty").write_bytes(b"")
    names = [*kinds, "cut", "empty", "none"]
    got = {}
    for r in W.read_archives(spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in names], "package STRING")).collect():
        got.setdefault(r.package.rsplit("/", 1)[1], []).append(r)
    for name in ("plain", "gz", "cdx", "cdxj"):
        assert {int(r.page_id) for r in got[name]} == whole and all(r.error is None and bytes(r.payload).decode() == pages[int(r.page_id)][2] for r in got[name]), name
    assert len(got["lost"]) == 5 and all(r.error for r in got["lost"])
    assert {int(r.page_id) for r in got["bad"] if not r.error} == whole - {2} and sum(bool(r.error) for r in got["bad"]) == 1
    assert all(len(got[n]) == 1 and got[n][0].error for n in ("cut", "empty", "none"))


def test_only_named_ranges_are_read():
    big = [W.write_record(i, "u", b"x" * 100_000, W.payload_digest(b"x" * 100_000)) for i in range(200)]
    at = np.append(0, np.cumsum([len(x) for x in big])).tolist()
    index = f'k 1 {{"filename":"a.warc","offset":{at[150]},"length":{at[151] - at[150]}}}\n'
    data = W.write_package([("archive/a.warc", b"".join(big)), ("indexes/index.cdxj", index.encode())])
    read = []
    rows = list(W.package_rows("p", lambda s, n: read.append(n) or data[s : s + n], len(data)))
    assert [r[1] for r in rows] == ["150"] and sum(read) < 200_000 < len(data) // 50


# --- pages

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1><p>Welcome to the site of the people who like to read and write about the many things that they do in the world.</p></header>
<div id="menu"><ul><li><a href=x>Home</a></li><li><a href=y>About us and the rest of it</a></li></ul></div>
<div class="cookie-notice">We use cookies to make the site better for you and for all of the people who visit it. <button>Accept</button></div>
<div id=content><h2>The title of it</h2><p>This is the first paragraph of the article and it has a good number of the words that are in the list of stop words, so that it is long enough to be seen as good &amp; text by the rules that we use for it in this test of the code, and it goes on for a while so as to be over the limit.</p><p>Short  one.</p><p>And then there is a second paragraph of the article which is about as long as the first one was, with some of the same words in it, and it also ends here after it has gone on for a while to be over the limit of two hundred characters that the rules ask for.</p><p>The end.</p></div>
<div class="sidebar"><p>Related: <a href=z>The other thing that we wrote about</a></p></div>
<div id="comments"><p>I like this article of yours and I think that it is the best one that I have read on the site so far, so thank you for all of the work that you have done on it and for the time that it took you to do all of that work for us.</p></div>
<form><p>Sign up for the letter that we send to you once a week with all of the news of the site and of the people who write for it</p><input type=text></form>
<footer>&copy; 2020 All rights</footer></body></html>"""


def test_main_text_by_rules():
    text = H.extract(PAGE)
    assert text.startswith("The title of it This is the first") and "good & text" in text and " Short one. And then" in text and text.endswith("The end.")
    for other in ("Welcome", "Home", "cookies", "Related", "best one", "Sign up", "2020", "var t"):
        assert other not in text
    assert H.extract(None) == H.extract("") == H.extract("<p></p>") == ""
    assert H.extract("<article><h1>A</h1><p>B c.</p></article><div>D</div>") == "A B c."
    assert H.extract('<div class="has-sidebar" data-id="menu"><article><div class="article-header"><h1>A</h1></div><p>B c.</p><div class="comments"><p>D</p></div></article></div>') == "A B c."
    assert H.extract("<article><p>one<p>two<b>x<br>y</p>&lt;z&gt;</article") == "one twox y <z>"


def test_main_text_of_any_markup(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "v", "<div" * 2000, "x"), (3, "v", "<p>" * 20000 + "a", "x"), (4, "w", "<!-- open", "x")]
    out = H.main_text(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, text STRING"))
    got = out.collect()
    assert out.columns == ["page_id", "url", "text", "n_chars"] and len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert H.main_text(out.select("page_id", "url", out.text.alias("html")).where("false")).collect() == []


# --- segmentations

@pytest.fixture(scope="module")
def vocabulary():
    return SP.Vocabulary(P.path("piece_bpe_32k.model"))


def segmentations(v, text):
    pieces = {v.model.id_to_piece(i): i for i in range(259, v.model.vocab_size())}
    text = "▁" + text.replace(" ", "▁")
    out = []

    def go(at, path, w):
        if at == len(text):
            out.append((tuple(path), w))
            return
        if text[at] not in pieces:
            raw = text[at].encode()
            go(at + 1, [*path, *(v.byte_id[f"<0x{b:02X}>"] for b in raw)], w + v.byte_weight * len(raw))
        for end in range(at + 1, min(len(text), at + 16) + 1):
            if text[at:end] in pieces:
                go(end, [*path, pieces[text[at:end]]], w + v.weight[pieces[text[at:end]]])

    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {p: float(np.exp(w - total)) for p, w in out}


def samples(v, texts, keys, k):
    raw = b"".join(t.encode() for t in texts)
    off = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    return list(SP.sample_texts(v, np.frombuffer(raw, np.uint8), off, SP.row_seed(keys, 0), k))


@pytest.mark.parametrize("text", ["ab", "the cat", "x\ny", "  é😀"])
def test_samples_follow_the_law(vocabulary, text):
    law, n = segmentations(vocabulary, text), 6000
    by = {}
    for d, number, ids, log_prob, key, inclusion in samples(vocabulary, [text] * n, list(range(n)), 3):
        path = tuple(int(i) for i in ids)
        assert abs(np.exp(log_prob) - law[path]) < 1e-9
        by.setdefault(d, []).append((path, key, inclusion, log_prob))
    first, second = {}, {}
    for own in by.values():
        assert len({p for p, *_ in own}) == len(own) == min(3, len(law))
        assert [k for _, k, *_ in own] == sorted((k for _, k, *_ in own), reverse=True)
        first[own[0][0]] = first.get(own[0][0], 0) + 1 / n
        if len(own) > 1:
            second[own[1][0]] = second.get(own[1][0], 0) + 1 / n
    assert all(abs(first.get(p, 0) - q) < 0.03 for p, q in law.items())
    if len(law) > 1:
        assert all(abs(second.get(p, 0) - sum(law[f] * q / (1 - law[f]) for f in law if f != p)) < 0.03 for p, q in law.items())
    assert abs(np.mean([sum(np.exp(lp - inc) for _, _, inc, lp in own) for own in by.values()]) - 1) < 0.02


def test_samples_do_not_depend_on_batches(vocabulary):
    texts = ["one two three", "", "four five", "x" * 300, "\n\n", "six"]
    whole = {(d, n): ids.tolist() for d, n, ids, *_ in samples(vocabulary, texts, list("abcdef"), 2)}
    for i, t in enumerate(texts):
        for _, n, ids, *_ in samples(vocabulary, [t], ["abcdef"[i]], 2):
            assert whole[i, n] == ids.tolist()
            assert vocabulary.decode(ids) == t.encode()
    assert {d for d, _ in whole} == {0, 2, 3, 4, 5}


def test_segmentations_of_a_table(spark):
    rows = [(1, "Hello  world\n"), (1, "Hello  world\n"), (None, "ünï 中 😀"), (2, None), (3, ""), (4, "long words " * 3000)]
    got = SP.sample_segmentations(docs(spark, rows), P.path("piece_bpe_32k.model"), k=3).collect()
    assert all(r.decodes and r.log_inclusion <= 0 and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert sorted((r.doc_id or 0, r.sample) for r in got) == sorted([(1, k) for k in range(3)] * 2 + [(d, k) for d in (0, 4) for k in range(3)])
    assert len({bytes(r.ids) for r in got if r.doc_id == 1}) == 3


ODD = ["http://x/{id}", "http://x/a b{}\u2028c", "http://x/\x0b?q={\"a\": 1}", "http://[broken", "http://x/\r\nWARC-Type: revisit", "", None, "{", "! x", " CDX N", "http://x/\x85\x1c"]
IDS = ["None", "a\r\nWARC-Type: revisit", "a b", "{", "<urn:page:1>", "é>", "", "%41", "A", "urn:uuid:1", None]


def test_urls_and_ids_of_any_characters_come_back(spark):
    rows = [(i, u, f"<p>{k % 4}</p>") for k, (i, u) in enumerate(zip(IDS, ODD, strict=True))]
    df = spark.createDataFrame(rows, "page_id STRING, url STRING, html STRING").repartition(2)
    got = {r.page_id: r for r in W.archive_pages(df).collect()}
    assert set(got) == set(IDS) and not any(r.error for r in got.values())
    for i, _, html in rows:
        same = [j for j, _, h in rows if h == html and j is not None]
        first = min(same)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == first else ("revisit", first)), i
        assert got[i].payload_digest == W.payload_digest(html.encode())


def test_revisits_in_a_table_are_those_of_its_sql(spark, tmp_path):
    import duckdb

    from foliospark.llm import queries as Q

    rng = random.Random(31)
    bodies = ["", "é" * 50, *("".join(rng.choice("<p> abc") for _ in range(rng.randrange(5, 3000))) for _ in range(40))]
    rows = [(i, rng.choice(ODD) or f"http://h{i % 7}/{i}", rng.choice([None, *bodies])) for i in rng.sample(range(5000), 600)]
    spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = Q.op7_warc_zip(spark, f"file://{tmp_path}").toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(Q.OP7_SQL).df()
    plain = lambda df: sorted(tuple(None if v != v or v is None else v for v in r) for r in df[sorted(want.columns)].astype(object).itertuples(index=False))
    key = lambda rows_: sorted(rows_, key=str)
    assert key(map(str, plain(got.astype({"refers_to": "Int64"}).astype(object).where(lambda d: d.notna(), None)))) == key(map(str, plain(want.astype({"refers_to": "Int64"}).astype(object).where(lambda d: d.notna(), None))))
    assert (got.record_type == "revisit").sum() > 400


def test_members_and_records_are_inflated_to_their_bounds(monkeypatch):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bomb", bytes(30_000_000))
    raw = bytearray(out.getvalue())
    at = raw.index(b"PK\x01\x02") + 24
    raw[at : at + 4] = (1000).to_bytes(4, "little")
    package = W.Package(lambda s, n: bytes(raw[s : s + n]), len(raw))
    with pytest.raises(W.PackageError, match="another size"):
        package.read(package.members["bomb"])
    monkeypatch.setattr(W, "_MOST", 10_000)
    record = zlib.compressobj(9, zlib.DEFLATED, 31)
    zipped = record.compress(bytes(20_000)) + record.flush()
    with pytest.raises(W.PackageError, match="larger"):
        W._whole(zipped)
    monkeypatch.setattr(W, "_MOST", 20_001)
    assert len(W._whole(zipped)) == 20_000


# --- what hashes alone would not decide

def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def spans_of_one_round(texts, min_len):
    """(uid, s, e) of a round of the steps, run here; each text is a slice of its own."""
    uid = np.arange(2 * len(texts), dtype=np.uint64).view(SF._KEY)
    of = {k: uid[i : i + 1] for i, k in enumerate(x.tobytes() for x in uid)}
    runs = []
    for i, t in enumerate(texts):
        batch = pa.record_batch({"uid": SF.binary_of(uid[i : i + 1]), "text": pa.array([t]), "copies": pa.array([1], pa.int64())})
        runs += list(SF._find_runs(min_len, max(1, min_len * 8 // 25), 4)(iter([batch])))
    held = pa.Table.from_batches(runs).sort_by("bucket").to_batches()
    found = [r for b in SF._classify(4)(iter(held)) for r in b.to_pylist()]
    kind = pa.list_(pa.struct([("x", pa.int64()), ("m", pa.int32()), ("a", pa.int32()), ("h", pa.int64()), ("c", pa.binary()), ("n", pa.int64()), ("solid", pa.bool_()), ("part", pa.int32()), ("parts", pa.int32())]))
    fields = [f.name for f in kind.value_type]
    go = [r for r in found if r["n"] > 1 or r["part"] >= 0 or r["parts"] > 0]
    asked = [[{k: r[k] for k in fields} for r in go if r["uid"] == uid[i].tobytes()] for i in range(len(texts))]
    batch = pa.record_batch({"uid": SF.binary_of(uid[: len(texts)]), "text": pa.array(texts), "asked": pa.array(asked, kind)})
    contexts = pa.Table.from_batches(list(SF._fetch(min_len, 4, 10)(iter([batch])))).sort_by("bucket").to_batches()
    out = [(r["uid"], r["s"], r["e"]) for b in SF._scan(min_len, 1000)(iter(contexts)) for r in b.to_pylist()]
    return [r for r in out if r[2] is not None] + [(r["uid"], r["x"], None) for r in found if r["sure"]], [r for r in out if r[2] is None], of


TWINS = ["x" * 50 + "one passage that two documents share" * 3, "y" * 20 + "one passage that two documents share" * 3, "z" * 300, "twin " * 40, "twin " * 40, "twin " * 40]


def test_only_the_interval_tree_marks_bytes(spark, monkeypatch):
    df = docs(spark, list(enumerate(TWINS)))
    assert SF.remove_repeats(df, min_len=60).groupBy().sum("n_removed").first()[0] > 500
    found, lost, _ = spans_of_one_round(TWINS, 60)
    assert len(found) > 10 and not lost
    monkeypatch.setattr(SF, "maximal_repeats", lambda *a: iter(()))
    found, lost, _ = spans_of_one_round(TWINS, 60)
    assert not found and lost


def test_every_occurrence_is_in_an_array_with_its_own_bytes(monkeypatch):
    seen = []
    tree = SF.maximal_repeats

    def watched(strings, start, length, min_len, at):
        seen.extend((int(s), bytes(strings[s : s + n])) for s, n in zip(start, length, strict=True))
        return tree(strings, start, length, min_len, at)

    monkeypatch.setattr(SF, "maximal_repeats", watched)
    found, _, _ = spans_of_one_round(TWINS[3:], 60)
    twins = [b for _, b in seen if b.startswith(b"twin")]
    assert len({u for u, _, _ in found}) == 3 and len(twins) >= 3 * len({s for u, s, _ in found if u == found[0][0]})


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_right_if_all_digests_are_equal(spark, monkeypatch, seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    shared = [word(150), word(40), word(39), word(90)]
    texts = [word(120) + shared[0] + word(120) for _ in range(3)] + [word(rng.randrange(30)) + rng.choice(shared) + word(rng.randrange(30)) for _ in range(40)]
    texts += [texts[0], texts[5][:-3], "ab" * 200, None, ""]
    monkeypatch.setattr(SF, "digests", lambda raw, start, size: np.zeros((len(start), 2), np.uint64))
    got = SF.remove_repeats(docs(spark, list(enumerate(texts))).repartition(4), min_len=40, keep_bytes=True).collect()
    want = [(d, *w) for d, w in enumerate(brute_repeats(texts, 40))]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == sorted(want)


def test_classes_are_proved_in_arrays_of_any_size():
    rng = random.Random(5)
    strings, start, size, lead, want = b"", [], [], [], []
    for k in range(30):
        first = "".join(rng.choice("abcd") for _ in range(50)).encode()
        members = [first if rng.random() < 0.8 else bytes(rng.choice(b"efgh") for _ in range(50)) for _ in range(rng.randrange(1, 9))]
        for i, b in enumerate([first, *members]):
            start.append(len(strings))
            size.append(50)
            lead.append(i == 0)
            want.append([first, *members].count(b) > 1)
            strings += b
    for most in (1, 3, 7, 1000):
        got = SF.proved(np.frombuffer(strings, np.uint8), np.array(start), np.array(size), np.array(lead), 20, most)
        assert all(g == w for g, w, b in zip(got, want, lead, strict=True) if most == 1000) and not any(g and not w for g, w in zip(got, want, strict=True))


def peak_of(work):
    import tracemalloc

    tracemalloc.start()
    out = work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_a_batch_of_repeats_has_few_words_of_64_bits_at_once():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 123, 8 << 20, dtype=np.uint8)
    start = np.arange(0, len(raw) - 300, 300)
    size = np.full(len(start), 300)
    got, peak = peak_of(lambda: SF._gathered(raw, start, size))
    assert np.array_equal(got, raw[: len(got)]) and peak < 16 << 20  # an index of all of its bytes has 67 MB

    twice = np.concatenate([raw[: 6 << 20], raw[: 6 << 20]])
    start = np.arange(0, len(twice), 256)
    found, peak = peak_of(lambda: list(SF.maximal_repeats(twice, start, np.full(len(start), 256), 200, np.zeros(len(start), bool))))
    assert len(found) == len(start) // 2 and all(n == 256 and len(m) == 2 for n, m in found) and peak < 3 * len(twice)  # rows of all suffixes once, not again in order

    texts = ["".join(map(chr, x)) for x in raw.reshape(-1, 4096)[:2000]]
    spans = pa.array([[{"s": 100, "e": 300}, {"s": 250, "e": 400}] if i % 2 else None for i in range(len(texts))], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
    column = pa.array(texts, pa.string())
    (cut,), peak = peak_of(lambda: list(SF._cut_text(iter([(column, spans)]))))
    assert cut.to_pylist() == [t[:100] + t[400:] if i % 2 else t for i, t in enumerate(texts)] and peak < 32 << 20

    batch = pa.record_batch({"uid": pa.array([i.to_bytes(16, "big") for i in range(len(texts))], pa.binary()), "text": column, "copies": pa.array(np.ones(len(texts), np.int64))})
    _, peak = peak_of(lambda: sum(x.num_rows for x in SF._find_runs(200, 64, 10_000)(iter([batch]))))
    assert peak < 60 << 20


def test_long_texts_may_be_looked_at_in_pieces(monkeypatch):
    rng = np.random.default_rng(9)
    raw = rng.integers(97, 105, 4000, dtype=np.uint8)
    batch = pa.record_batch({"uid": pa.array([b"u" * 16], pa.binary()), "text": pa.array([raw.tobytes().decode()]), "copies": pa.array([1])})

    def windows():
        found = []
        for out in SF._find_runs(40, 12, 8)(iter([batch])):
            for row in out.to_pylist():
                h, x, m, a = (np.frombuffer(row[k], t).tolist() for k, t in (("h", np.uint64), ("x", np.uint32), ("m", np.uint16), ("a", np.uint16)))
                found += [(y[1] + k, y[0], y[3] - k) for y in zip(h, x, m, a, strict=True) for k in range(y[2])]
        return sorted(found)

    whole = windows()
    monkeypatch.setattr(SF, "_LONGEST", 512)
    monkeypatch.setattr(SF, "_AT_ONCE", 256)
    assert windows() == whole and [x for x, _, _ in whole] == list(range(4000 - 39))


@pytest.mark.parametrize("group", [1000, 3, 1])
def test_grams_of_many_contexts_are_split(spark, group):
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    shared = [word(k) for k in (39, 40, 41, 90)]
    texts = [word(rng.randrange(20)) + rng.choice(shared)[rng.randrange(3) :] + word(rng.randrange(20)) for _ in range(60)] + [thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))]
    base, held = SF._texts(docs(spark, list(enumerate(texts))), "doc_id", "text")
    covered = {}
    for r in SF.repeat_spans(held, min_len=40, group=group, suffixes=50).collect():
        covered.setdefault(bytes(r.uid), set()).update(range(r.s, r.e))
    uid = {r.doc_id: bytes(r.uid) for r in base.collect()}
    assert [len(covered.get(uid[i], ())) for i in range(len(texts))] == [w[1] for w in brute_repeats(texts, 40)]


def test_confused_words_have_lattices_of_their_own(vocabulary):
    word = thue_morse(1024)
    texts = [word, word.translate(str.maketrans("ab", "ba"))]
    for d, _, ids, *_ in samples(vocabulary, texts, [0, 1], 2):
        assert vocabulary.decode(ids) == texts[d].encode()


def test_deep_siblings_are_drawn_when_near_ones_do_not_suffice(vocabulary, monkeypatch):
    texts, keys = ["some longer text with words in it, and more of them", "ab", "x"], list(range(3))
    want = [(d, n, ids.tolist(), lp, key) for d, n, ids, lp, key, _ in samples(vocabulary, texts, keys, 40)]
    assert sum(d == 0 for d, *_ in want) == 40
    monkeypatch.setattr(SP, "_NEAR", 0.5)
    assert [(d, n, ids.tolist(), lp, key) for d, n, ids, lp, key, _ in samples(vocabulary, texts, keys, 40)] == want


def test_sampling_finds_every_segmentation(vocabulary):
    for text in ("the", "ab c", "x\ny"):
        law = segmentations(vocabulary, text)
        got = samples(vocabulary, [text], [1], len(law) + 5)
        assert {tuple(ids.tolist()) for _, _, ids, *_ in got} == set(law) and len(got) == len(law) and all(inc == 0 for *_, inc in got)


# --- the classifier against plain Python

def test_features_are_those_of_character_grams():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abÄé 日\n😀Z") for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["", "abc", "ÄÉ Z", "äé z", "  \t "]
    raw = [t.encode() for t in texts]
    row, f = TX.present(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    mine = [set(f[row == i].tolist()) for i in range(len(texts))]
    fold = lambda t: "".join(" " if c in "\t\n\x0b\x0c\r\x85\xa0" else c.lower() for c in t)
    grams = [{t[i : i + n] for n in TX.ORDERS for i in range(len(t) - n + 1)} for t in map(fold, texts)]
    assert all(0 <= len(g) - len(m) <= 1 for g, m in zip(grams, mine)) and mine[-2] == mine[-3]
    more = [len(mine[i] & mine[j]) - len(grams[i] & grams[j]) for i in range(len(texts)) for j in range(i)]
    assert min(more) == 0 and sum(more) < 0.02 * len(more)  # some of four million features stand for two


def test_long_texts_have_the_features_of_the_whole(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdé日") for _ in range(3000)).encode()
    raw, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = TX.present(raw, off)
    monkeypatch.setattr(TX, "_PIECE", 500)
    assert all((a == b).all() for a, b in zip(whole, TX.present(raw, off)))


def test_weights_are_at_the_least_loss():
    rng = np.random.default_rng(4)
    n, k, penalty = 300, 12, 3.0
    x = rng.random((n, k)) < 0.3
    ratio = rng.normal(size=k) + 0.5
    y = (x @ rng.normal(size=k) + rng.normal(size=n) * 0.5 > 0).astype(float)
    w, b = TX.fit_weights([np.flatnonzero(r) for r in x], y, ratio, penalty, rounds=4000)
    z = x * ratio @ w + b
    residual = 1 / (1 + np.exp(-z)) - y
    gradient = np.append((x * ratio).T @ residual + penalty * w, residual.sum())
    assert np.abs(gradient).max() < 1e-3 * n
    early, bias = TX.fit_weights([np.flatnonzero(r) for r in x], y, ratio, penalty)
    loss = lambda w, b: np.logaddexp(0, (1 - 2 * y) * (x * ratio @ w + b)).sum() + penalty / 2 * w @ w
    assert loss(early, bias) < loss(w, b) + 0.02 * n


def test_main_text_of_marked_pages():
    """Pages put together from marked parts: what is marked as the article comes back, and nothing else."""
    rng = random.Random(8)
    stop = ["the", "and", "of", "that", "it", "was", "with", "for", "on", "they"]
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(rng.choice(stop) if rng.random() < 0.4 else word() for _ in range(n)).capitalize() + "."
    for case in range(60):
        parts = [prose(rng.randrange(20, 90)) for _ in range(rng.randrange(3, 9))]
        short = prose(4)
        parts.insert(rng.randrange(1, len(parts)), short)
        tag = rng.choice(["article", "main", "div", "section"])
        menu = "".join(f"<li><a href=/{i}>{word()} {word()}</a></li>" for i in range(6))
        links = f'<div class="{rng.choice(["related", "teasers", "x"])}">' + "".join(f"<p><a href=/{i}>{prose(8)}</a></p>" for i in range(4)) + "</div>"
        page = f'<html><head><title>x</title></head><body><header><p>{prose(12)}</p></header><nav><ul>{menu}</ul></nav><{tag}><h1>{word()} {word()}</h1>' + "".join(f"<p>{p}</p>" for p in parts) + f'</{tag}>{links}<div id="comments"><p>{prose(40)}</p></div><footer>{prose(10)}</footer></body></html>'
        got = H.extract(page)
        assert all(p in got for p in parts), (case, tag)
        assert got.split(" ", 2)[2] == " ".join(parts), (case, tag)


def test_tasks_without_labelled_rows(spark):
    rows = [(i, f"text {'odious' if i % 2 else 'kind'} {i}") for i in range(12)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id BIGINT, toxic INT")
    few = docs(spark, rows).repartition(9).unionByName(docs(spark, [(100 + i, "others") for i in range(20)]).repartition(5))
    assert TX.score_toxicity(few, lab).count() == 32
