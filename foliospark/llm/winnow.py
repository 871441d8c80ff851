"""Benchmark decontamination by winnowing: documents that share a window of words with a benchmark's items.

A window is ``window`` consecutive words of an item. Of the k-grams in a window, k being ``gram``, the one of least hash is
its fingerprint (of equal ones the last), so a document and an item that share a window share its fingerprint, wherever
else they differ. Items shorter than a window are one window of all their words, which is its own fingerprint.

1. The items' fingerprints set bits in a filter of fixed size, whatever the size of the benchmark.
2. Documents are read once. Windows with one fingerprint are a run; a run whose fingerprint is in the filter is kept with
   its words. The filter alone decides nothing: a false hit costs a row, no result.
3. Runs are joined with the fingerprints, and then extended: their windows are joined word by word with those of the items
   that have the fingerprint. Neighbouring windows that occur make up the shared span, of which every word is hit.

Equal texts are worked on once from 2. on. Hashes never decide: windows are equal by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import BYTE_A, U64, mix, powers, prefix_hash, released, slices, text_buffer
from foliospark.llm.suffix import sliding_min
from foliospark.session import materialize, prepare, settled

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_PLACE = U64((1 << 31) - 1)  # of a k-gram, in the low bits of its hash, whose other bits decide which is least
_LONG = 8 << 20  # bytes of one text looked at together; a longer one is cut between words, with the words that windows need
_BITS = 1 << 26


class Words:
    """The words of several texts: lower-cased bytes joined by single spaces, where each begins, and whose it is."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        n = len(offsets) - 1
        raw = _LOWER[raw]
        inside = _IN_WORD[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        starts = self.starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
        size = ends - starts
        self.begin = np.cumsum(size + 1) - (size + 1)  # in ``text``
        self.end = self.begin + size
        self.text = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        at = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        self.text[at] = raw[inside]
        self.row = np.searchsorted(offsets, starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        c = prefix_hash(BYTE_A[self.text])
        self.hashes = mix((c[self.end] - c[self.begin]) * powers(len(self.text) + 1)[1][self.begin])

    def span(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by spaces."""
        return self.text[self.begin[i] : self.end[j - 1]].tobytes()

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on."""
        n = max(0, len(self.hashes) - k + 1)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h += self.hashes[i : i + n] * _WEIGHTS[i % len(_WEIGHTS)]
        return mix(h)

    def runs(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first window, windows) of each run of windows that have their fingerprint at one place."""
        g = self.grams(gram)
        last = window - gram  # k-grams in a window but one
        place = np.arange(len(g), dtype=np.uint64)
        least = sliding_min(g & ~_PLACE | (_PLACE - place), last + 1)  # of equal hashes the last place
        ok = np.flatnonzero(self.row[: len(least)] == self.row[window - 1 : window - 1 + len(least)]) if len(least) else np.zeros(0, np.int64)
        if not len(ok):
            return np.zeros(0, np.uint64), ok, ok
        at = (_PLACE - (least[ok] & _PLACE)).astype(np.int64)
        lead = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)))
        return g[at[lead]], ok[lead], np.diff(np.append(lead, len(ok)))


Piece = tuple[int, Words, int]  # words of the text before it, its words, and how many of them have their windows here


def _pieces(raw: np.ndarray, window: int, most: int) -> Iterator[Piece]:
    """One text in pieces; each has the words that the windows of its own words need."""
    i, before, size = 0, 0, most
    while True:
        j = min(len(raw), i + size)
        while j < len(raw) and len(inside := _IN_WORD[_LOWER[raw[j : j + 4096]]]):  # to the end of a word
            j += len(inside) if inside.all() else int(np.argmin(inside))
            if not inside.all():
                break
        words = Words(raw[i:j], np.array([0, j - i]))
        own = len(words.starts) - (window - 1)
        if j == len(raw):
            yield before, words, len(words.starts)
            return
        if own <= 0:
            size *= 2
            continue
        yield before, words, own
        i, before, size = i + int(words.starts[own]), before + own, most


def _words_of(column: pa.Array, window: int) -> Iterator[tuple[int, int, Iterator[Piece]]]:
    """Slices of texts, from row i to row j; a long text is a slice of its own, of several pieces."""
    raw, off = text_buffer(column)
    for i, j in slices(off):
        if off[j] - off[i] > _LONG and j == i + 1:
            yield i, j, _pieces(raw[off[i] : off[j]], window, _LONG)
        else:
            words = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            yield i, j, iter([(0, words, len(words.starts))])


_RUNS = "key binary, n_words bigint, runs array<struct<h: bigint, at: bigint, n: int, size: int, words: string>>"
_RUN_TYPE = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("size", pa.int32()), ("words", pa.string())]))


def slot(h: np.ndarray) -> np.ndarray:
    """The bit of a fingerprint in the filter."""
    return (h >> U64(64 - (_BITS.bit_length() - 1))).astype(np.int64)


def _item_windows(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item_id, h, slot, size, words) of each window of the items."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, pieces in _words_of(batch.column("text"), window):
                for before, words, own in pieces:
                    h, first, count = words.runs(window, gram)
                    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    rows, prints, spans, size = [words.row[at]], [np.repeat(h, count)], [words.span(k, k + window) for k in at.tolist()], [np.full(len(at), window)]
                    whole = not before and own == len(words.starts)
                    for few in np.unique(words.counts[(words.counts > 0) & (words.counts < window)]).tolist() if whole else []:
                        short = np.flatnonzero(words.counts == few)
                        rows, prints, size = [*rows, short], [*prints, words.grams(few)[words.first[short]]], [*size, np.full(len(short), few)]
                        spans += [words.span(k, k + few) for k in words.first[short].tolist()]
                    item = batch.column("item_id").take(pa.array(np.concatenate(rows) + i))
                    h = np.concatenate(prints)
                    yield pa.record_batch([item, pa.array(h.view(np.int64)), pa.array(slot(h)), pa.array(np.concatenate(size), pa.int32()), pa.array(spans, pa.binary()).cast(pa.string())], ["item_id", "h", "slot", "size", "words"])

    return find


def _document_runs(known: bytes, short: list[int], window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """n_words of each text, and its runs whose fingerprint may be one of the items'."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known, np.uint8)

        def hits(h: np.ndarray) -> np.ndarray:
            s = slot(h)
            return np.flatnonzero(bits[s >> 3] >> (s & 7).astype(np.uint8) & 1)

        for batch in batches:
            for i, j, pieces in _words_of(batch.column("text"), window):
                runs: list[list[dict]] = [[] for _ in range(j - i)]
                counts = np.zeros(j - i, np.int64)
                for before, words, own in pieces:
                    counts += words.counts if own == len(words.starts) else own
                    h, first, count = words.runs(window, gram)
                    k = hits(h)
                    found = [(h[k], first[k], count[k], window)]
                    for few in short:
                        g = words.grams(few)
                        k = hits(g[:own])
                        k = k[words.row[k] == words.row[k + few - 1]]
                        found.append((g[k], k, np.ones(len(k), np.int64), few))
                    for prints, at, n, size in found:
                        for r, x, a, m in zip(words.row[at].tolist(), prints.view(np.int64).tolist(), at.tolist(), n.tolist(), strict=True):
                            runs[r].append({"h": x, "at": before + a - int(words.first[r]), "n": m, "size": size, "words": words.span(a, a + m - 1 + size).decode()})
                yield pa.record_batch([*batch.slice(i, j - i).select(["doc_id", "key"]).columns, pa.array(counts), pa.array(runs, _RUN_TYPE)], ["doc_id", "key", "n_words", "runs"])

    return find


def fingerprint_filter(windows: DataFrame) -> bytes:
    """The filter's bits: what comes to the driver is at most 2**20 words of 64 bits, however many windows there are."""
    t = windows.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(slot & 63)))").alias("bits")).toArrow()
    bits = np.zeros(_BITS // 64, np.int64)
    bits[t.column("word").to_numpy()] = t.column("bits").to_numpy()
    return bits.astype("<i8").tobytes()


def _each_window(words: Column, n: Column, size: Column) -> Column:
    """The windows of a run, each with its number in it."""
    split = F.split(words, " ")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(split, i + 1, size), " ").alias("words")))


@settled
def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Finds the words of ``docs`` that lie inside any occurrence of a window of ``items``.

    A word is a run of digits, letters a to z (A to Z are lower-cased) and characters beyond ASCII. Returns a row per
    document: doc_id, n_words, n_hit (words inside an occurrence), n_items (distinct items with an occurring window),
    items_sha256 (their ids, sorted as strings, comma-joined), contaminated (n_hit > 0).

    Every shared window is found. Null or empty texts and texts without words: no words, no hits, the digest of the empty
    string; items like that have no windows. Items with fewer words than ``window`` are one window. Repeated documents
    each get a row, repeated items are one; an item with a null id marks words but is neither counted nor listed. Null
    document ids stay. A text is worked on in one task, in one piece. Extra columns are ignored; empty tables give no
    rows, or no hits.
    """
    if not 0 < gram <= window:
        raise ValueError("a fingerprint's words are some of the window's")
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    tests = items.select(F.col(f"`{item_id_col}`").cast("string").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    found = materialize(tests.mapInArrow(_item_windows(window, gram), "item_id string, h bigint, slot bigint, size int, words string"), "windows")
    short = sorted(r["size"] for r in found.where(F.col("size") < window).select("size").distinct().collect())  # at most window - 1 numbers
    keyed = base.withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    scanned = keyed.mapInArrow(released(_document_runs(fingerprint_filter(found), short, window, gram)), f"doc_id {kind}, {_RUNS}")
    scanned = materialize(scanned.withColumn("may", F.size("runs") > 0), "runs")
    # of equal texts one goes on, with the runs whose fingerprint is an item's
    hit = scanned.where("may").groupBy("key").agg(F.first("runs").alias("runs")).select("key", F.explode("runs").alias("r")).select("key", "r.*")
    hit = hit.join(found.select("h", "size").distinct(), ["h", "size"], "left_semi")
    placed = hit.select("key", "h", "size", "at", F.explode(_each_window(F.col("words"), F.col("n"), F.col("size"))).alias("w")).select("key", "h", "size", (F.col("at") + F.col("w.i")).alias("at"), F.col("w.words").alias("words"))
    windows = found.groupBy("h", "size", "words").agg(F.count("item_id").alias("items"))
    shared = materialize(placed.join(windows, ["h", "size", "words"]).select("key", "at", "size", "h", "words", "items"), "shared")
    none = F.lit(0).cast("bigint")
    before = F.max(F.col("at") + F.col("size")).over(Window.partitionBy("key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(none, F.col("at") + F.col("size") - F.greatest(F.col("at"), F.coalesce(before, none)))
    counted = shared.select("key", new.alias("new")).groupBy("key").agg(F.sum("new").alias("n_hit"))
    of_items = found.where("item_id is not null").select("h", "size", "words", "item_id").distinct()
    listed = shared.where("items > 0").select("key", "h", "size", "words").distinct().join(of_items, ["h", "size", "words"]).select("key", "item_id").distinct()
    listed = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ",").cast("binary"), 256).alias("items_sha256"))
    marked = materialize(counted.join(listed, "key", "left"), "marked")
    out = scanned.where("may").select("doc_id", "key", "n_words").join(marked, "key", "left").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256")
    clean = scanned.where("not may").select("doc_id", "n_words", *[F.lit(None).cast(t).alias(c) for c, t in (("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"))])
    n_hit = F.coalesce("n_hit", none)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.unionByName(clean).select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", empty).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
