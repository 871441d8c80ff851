"""Removal of long repeats, by the interval tree of an enhanced suffix array.

``maximal_repeats`` is the method: sort suffixes, take the common prefixes of neighbours, scan them with a stack for
the intervals of the common-prefix tree, and output each interval whose occurrences differ in the byte to their left
(or start their text): a maximal repeat with all of its occurrences. Nothing else marks a byte; hashes only deal work out.

A corpus is dealt out so that each task sorts a bounded number of suffixes, and equal windows still meet:

1. Every ``min_len``-byte window picks an anchor, the gram with the least hash in it. Equal windows pick equal grams at
   equal places, so the windows of one anchor, a run, need only be held against the runs of the same gram. A run's
   context is the bytes of its windows.
2. Contexts with one 128-bit digest are a class. A class is a guess that the tree has to prove: every context of it goes
   into a suffix array with its own bytes, beside those of others of the class, and is done if the tree finds all of it to
   be a repeat. Classes within a slice of texts are proved there and then; of others up to 1,000 contexts meet in one
   array, the first one of the class in each. Contexts that the tree does not find equal are taken one by one.
3. The first contexts of a gram's classes meet in one array, where parts of them may be repeats. A gram with one
   class goes no further. A gram with more than ``group`` classes is split: its runs are cut into shorter ones by their
   distance from the anchor, dealt by the bytes that all of their windows have, and go through the same steps again; at last
   by single windows. A run is cut into a bounded number of parts, however common its gram.

Texts are known by 128 bits of their SHA-256. Work is held for one bucket of grams at a time, not for a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import BASE_A, BYTE_A, U64, distinct_texts, mix, packed_rows, powers, prefix_hash, released, slices, text_buffer, with_digest
from foliospark.session import materialize, partitions, prepare, settled

_PLACE = U64((1 << 24) - 1)
_LONGEST = 1 << 20  # bytes of one text looked at together; longer texts are cut into overlapping pieces
_TOGETHER = 8 << 20  # bytes of texts, or of contexts, whose rows are packed together
_AT_ONCE = 1 << 18  # bytes for which there are words of 64 bits at a time
_GOLD = U64(0x9E3779B97F4A7C15)
_FINER = (8, 1)  # windows in the runs of grams that are split, and split again
_CLASS = 1000  # contexts of a class that meet in one array, and the first of the class
_SUFFIXES = 50_000  # in one array


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    if n < w:
        return x[:0]
    y = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    y[:n] = x
    y = y.reshape(-1, w)
    left = np.minimum.accumulate(y, 1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchor_runs(raw: np.ndarray, offsets: np.ndarray, min_len: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, place of the anchor after it, gram hash) of each run of windows with the same anchor."""
    n = len(raw)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < min_len:
        return none
    c = prefix_hash(BYTE_A[raw])
    g = mix((c[gram:] - c[:-gram]) * powers(n)[1][: n - gram + 1])
    del c
    least = sliding_min((g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), min_len - gram + 1)
    open_at = np.zeros(n + 1, np.int8)
    rows = np.flatnonzero(np.diff(offsets) >= min_len)
    open_at[offsets[rows]] += 1
    open_at[offsets[rows + 1] - min_len + 1] -= 1
    x = np.flatnonzero(np.cumsum(open_at[: len(least)], dtype=np.int8))
    if not len(x):
        return none
    place = (least[x] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (x[1:] != x[:-1] + 1)))
    return x[first], np.diff(np.append(first, len(x))), place[first] - x[first], g[place[first]]


def digests(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit digests of raw[start:start + size], as pairs of words."""
    view, digest = memoryview(np.ascontiguousarray(raw)), xxhash.xxh3_128_digest
    joined = b"".join([digest(view[i:j]) for i, j in zip(start.tolist(), (start + size).tolist(), strict=True)])
    return np.frombuffer(joined, np.uint64).reshape(-1, 2)


def maximal_repeats(strings: np.ndarray, start: np.ndarray, length: np.ndarray, min_len: int, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, suffixes) of each maximal repeat of ``min_len`` or more bytes among chosen suffixes.

    Suffix i begins at byte start[i] of ``strings`` and has length[i] bytes; at[i] says whether the byte before it
    belongs to the same string (its left extension). Stack scan over the suffixes in sorted order and the common prefixes
    of neighbours; an interval is output if its left extensions differ.
    """
    n, width = len(start), int(length.max(initial=0))
    if n < 2:
        return
    view = np.lib.stride_tricks.sliding_window_view(np.append(strings, np.zeros(width, np.uint8)), width)
    rows, some = np.empty((n, width), np.uint8), max(1, _AT_ONCE // width)
    for i in range(0, n, some):
        rows[i : i + some] = view[start[i : i + some]]
        rows[i : i + some][np.arange(width)[None, :] >= length[i : i + some, None]] = 0
    order = np.argsort(rows.reshape(-1).view(f"S{width}"), kind="stable")
    rest, lcp = length[order], np.empty(n - 1, np.int64)
    for i in range(0, n - 1, some):
        sorted_ = rows[order[i : i + some + 1]]
        differs = sorted_[1:] != sorted_[:-1]
        lcp[i : i + some] = np.where(differs.any(1), differs.argmax(1), width)
    del rows
    lcp = np.minimum(lcp, np.minimum(rest[1:], rest[:-1]))
    left = np.where(at, strings[np.maximum(start - 1, 0)].astype(np.int64), -1)[order]
    split = np.append(0, np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0)))  # changes of the left extension up to a place
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp.tolist(), 0], 1):
        low = i - 1
        while stack and stack[-1][0] > depth:
            size, low = stack.pop()
            if split[i - 1] > split[low] or left[low] < 0:
                yield size, order[low:i]
        if depth >= min_len and (not stack or stack[-1][0] < depth):
            stack.append((depth, low))


def proved(strings: np.ndarray, start: np.ndarray, size: np.ndarray, lead: np.ndarray, min_len: int, most: int = _SUFFIXES) -> np.ndarray:
    """Which contexts are repeats as a whole, by the tree over their bytes.

    ``lead`` marks the first one of each class. An array has about ``most`` contexts of whole classes; of a class that is
    larger the first one is in each of its arrays.
    """
    ok = np.zeros(len(start), bool)
    heads = np.flatnonzero(lead)
    lo = 0
    while lo < len(start):
        hi = min(len(start), lo + most)
        if hi < len(start) and not lead[hi]:
            head = int(heads[np.searchsorted(heads, hi, "right") - 1])  # of the class that would be cut
            hi = head if head > lo else hi
        take = np.arange(lo, hi)
        if not lead[lo]:
            take = np.append(heads[np.searchsorted(heads, lo, "right") - 1], take)
        best = np.zeros(len(take), np.int64)
        for length, members in maximal_repeats(strings, start[take], size[take], min_len, np.zeros(len(take), bool)):
            best[members] = np.maximum(best[members], length)
        ok[take] |= best >= size[take]
        lo = hi
    return ok


_KEY = np.dtype("V16")
_RUNS = "bucket int, uid binary, x binary, m binary, a binary, h binary, c binary, f binary"


def keys_of(column: pa.Array) -> np.ndarray:
    """A binary column of 16 bytes a row."""
    return text_buffer(column)[0].view(_KEY)


def binary_of(keys: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(keys)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), raw.nbytes // 16, [None, pa.py_buffer(raw)]).cast(pa.binary())


def _dealt(buckets: int, min_len: int, raw: np.ndarray, pos: np.ndarray, uid: np.ndarray, x: np.ndarray, m: np.ndarray, a: np.ndarray, h: np.ndarray, c: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed rows of runs by bucket of their gram, ``pos`` being where they begin in ``raw``.

    Of contexts here that the tree proves to be equal one goes there, known to occur twice (f: 2); the others are done and
    go to buckets from ``buckets`` on.
    """
    if not len(h):
        return
    order = np.lexsort((c[:, 1], c[:, 0]))
    pos, uid, x, m, a, h, c, f = (v[order] for v in (pos, uid, x, m, a, h, c, f))
    lead = np.append(True, (c[1:] != c[:-1]).any(1))
    several = ~lead | np.append(~lead[1:], False)  # contexts of classes with more than one here
    ok = np.zeros(len(h), bool)
    if several.any():
        own = np.flatnonzero(several)
        ok[own] = proved(raw, pos[own], m[own].astype(np.int64) + (min_len - 1), lead[own], min_len)
    lost = np.flatnonzero(~lead & ~ok)
    if len(lost):  # no class of its digest: one of its own
        c[lost, 0] = mix(c[lost, 0] ^ mix(pos[lost].astype(np.uint64) + uid[lost].view(np.uint64).reshape(-1, 2)[:, 0]))
    rest, go = np.flatnonzero(~lead & ok), np.flatnonzero(lead | ~ok)
    spare = buckets + int(c[0, 0] % U64(buckets))
    bucket = np.append((h[go] >> U64(20)).astype(np.int64) % buckets, np.full(len(rest), spare))
    take = np.append(go, rest)
    seen = np.where(ok[take], 2, np.minimum(f[take], 2))
    pairs = np.ascontiguousarray(c[take]).view(_KEY).ravel()
    yield from packed_rows(bucket, uid=uid[take], x=x[take].astype(np.uint32), m=m[take].astype(np.uint16), a=a[take].astype(np.uint16), h=h[take], c=pairs, f=seen.astype(np.uint8))


def _find_runs(min_len: int, gram: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            uid, copies = keys_of(batch.column("uid")), np.minimum(batch.column("copies").to_numpy(), 2)
            for lo, hi in slices(off, _TOGETHER):
                got = []
                for i, j in slices(off[lo : hi + 1], _AT_ONCE):
                    i, j = lo + i, lo + j
                    for p in range(int(off[i]), int(off[j]), _LONGEST) if j == i + 1 else [int(off[i])]:
                        end = min(int(off[j]), p + _LONGEST + min_len - 1) if j == i + 1 else int(off[j])
                        mark = np.array([0, end - p]) if j == i + 1 else off[i : j + 1] - off[i]
                        x, m, a, h = anchor_runs(raw[p:end], mark, min_len, gram)
                        doc = i + np.searchsorted(mark, x, "right") - 1
                        got.append((x + p, uid[doc], x + p - off[doc], m, a, h, digests(raw[p:end], x, m + (min_len - 1)), copies[doc]))
                if got:
                    first, last = int(off[lo]), int(off[hi])
                    pos, *rest = (np.concatenate(v) for v in zip(*got, strict=True))
                    got.clear()
                    yield from _dealt(buckets, min_len, raw[first:last], pos - first, *rest)

    return find


def _buckets(batches: Iterator[pa.RecordBatch], **types: object) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The unpacked rows of one bucket after the other; the batches are sorted by bucket."""
    held: dict[str, list[bytes]] = {k: [] for k in types}
    last = None

    def taken() -> dict[str, np.ndarray]:
        out = {k: np.frombuffer(b"".join(v), types[k]) for k, v in held.items()}
        for v in held.values():
            v.clear()
        return out

    for batch in batches:
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            if last is not None and bucket != last:
                yield last, taken()
            last = bucket
            for k in types:
                held[k].append(batch.column(k)[i].as_py())
    if last is not None:
        yield last, taken()


_CLASSED = "c binary, uid binary, x bigint, m int, a int, h bigint, n bigint, solid boolean, sure boolean, part int, parts int"


def _classify(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs whose windows may be repeats.

    n: classes of the gram, on the first run of each class, 0 on others; sure: proved already; solid: sure, or of a class
    with others; part: the array in which a run has to be proved beside the first one of its class, which is in ``parts`` of them.
    """

    def rows(a: dict[str, np.ndarray], take: np.ndarray, **own: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(take), 100_000):
            t, s = take[i : i + 100_000], slice(i, i + 100_000)
            yield pa.record_batch({"c": binary_of(a["c"][t]), "uid": binary_of(a["uid"][t]), "x": a["x"][t].astype(np.int64), "m": a["m"][t].astype(np.int32), "a": a["a"][t].astype(np.int32), "h": a["h"][t].view(np.int64), **{k: v[s] for k, v in own.items()}})

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, a in _buckets(batches, uid=_KEY, x=np.uint32, m=np.uint16, a=np.uint16, h=np.uint64, c=_KEY, f=np.uint8):
            count = len(a["h"])
            if bucket >= buckets:
                yes, none = np.ones(count, bool), np.full(count, -1, np.int32)
                yield from rows(a, np.arange(count), n=np.zeros(count, np.int64), solid=yes, sure=yes, part=none, parts=none + 1)
                continue
            h, c = a["h"], a["c"].view(np.uint64).reshape(-1, 2)
            order = np.lexsort((a["f"] < 2, c[:, 1], c[:, 0], h))  # of a class first those that are sure
            h, c, sure = h[order], c[order], a["f"][order] > 1
            first = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]).any(1))
            lead = np.flatnonzero(first)
            size = np.diff(np.append(lead, count))
            top = np.flatnonzero(np.append(True, h[lead][1:] != h[lead][:-1]))
            grams = np.diff(np.append(top, len(lead)))
            n = np.zeros(count, np.int64)
            n[lead] = np.repeat(grams, grams)
            within = np.arange(count) - np.repeat(lead, size)  # place in the class
            open_ = np.logical_or.reduceat(~sure, lead) & (size > 1)  # classes with something to prove
            parts = np.zeros(count, np.int32)
            parts[lead] = np.where(open_, -(-(size - 1) // _CLASS), 0)
            part = np.where(first | sure, -1, (within - 1) // _CLASS).astype(np.int32)
            solid = sure | (np.repeat(size, size) > 1)
            go = np.flatnonzero(sure | (part >= 0) | (parts > 0) | (n > 1))
            yield from rows(a, order[go], n=n[go], solid=solid[go], sure=sure[go], part=part[go], parts=parts[go])

    return classify


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... size[i] of them, for each i."""
    at = np.cumsum(size) - size
    return np.repeat(start - at, size) + np.arange(int(size.sum()))


def _gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raw[start[i] : start[i] + size[i]] one after the other, for each i."""
    at = np.append(0, np.cumsum(size))
    out = np.empty(int(at[-1]), raw.dtype)
    for i, j in slices(at, _AT_ONCE):
        out[at[i] : at[j]] = raw[_spread(start[i:j], size[i:j])]
    return out


class Asked:
    """The asks of a slice of texts, in order of the texts; ``x`` is a place in ``raw``."""

    def __init__(self, batch: pa.RecordBatch, raw: np.ndarray, off: np.ndarray, lo: int, hi: int) -> None:
        lists = batch.column("asked").slice(lo, hi - lo)
        at = lists.offsets.to_numpy()
        flat = lists.values.slice(at[0], at[-1] - at[0])
        doc = np.repeat(np.arange(hi - lo), np.diff(at))
        field = lambda k: flat.field(k).to_numpy(zero_copy_only=False)
        self.uid = keys_of(batch.column("uid").slice(lo, hi - lo))[doc]
        self.base = (off[lo:hi] - off[lo])[doc]
        self.x, self.m, self.a = (field(k).astype(np.int64) for k in ("x", "m", "a"))
        self.h, self.n, self.solid = field("h").view(np.uint64), field("n"), field("solid").astype(bool)
        self.part, self.parts = field("part").astype(np.int64), field("parts").astype(np.int64)
        self.c = keys_of(flat.field("c"))
        self.raw = raw[off[lo] : off[hi]]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[Asked]:
    for batch in batches:
        raw, off = text_buffer(batch.column("text"))
        for lo, hi in slices(off, _TOGETHER // 4):
            yield Asked(batch, raw, off, lo, hi)


_CONTEXTS = "bucket int, uid binary, x binary, m binary, h binary, kind binary, bytes binary"
_PARTLY, _HELD, _FIRST, _MEMBER = range(4)  # kinds of contexts: of a gram, where parts may repeat; of a gram, solid; the first of a class; another one


def _fetch(min_len: int, buckets: int, group: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contexts with their bytes, for the arrays of grams with up to ``group`` classes and for those of classes, by bucket of the array's key."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _asked(batches):
            whole = np.flatnonzero((s.n > 1) & (s.n <= group))
            first = np.flatnonzero(s.parts > 0)
            again = np.repeat(first, s.parts[first])
            member = np.flatnonzero(s.part >= 0)
            take = np.concatenate([whole, again, member])
            kind = np.concatenate([np.where(s.solid[whole], _HELD, _PARTLY), np.full(len(again), _FIRST), np.full(len(member), _MEMBER)])
            part = np.concatenate([_spread(np.zeros(len(first), np.int64), s.parts[first]), s.part[member]]).astype(np.uint64)
            classes = np.append(again, member)
            key = np.append(s.h[whole], mix(s.c[classes].view(np.uint64).reshape(-1, 2)[:, 0] ^ mix(s.h[classes]) ^ mix(part * _GOLD)))
            done = np.cumsum(s.m[take] + (min_len - 1))
            for piece in np.split(np.arange(len(take)), np.searchsorted(done, np.arange(_TOGETHER, done[-1], _TOGETHER)) if len(take) else []):
                if not len(piece):
                    continue
                bucket = (key[piece] >> U64(20)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                bucket, piece = bucket[order], piece[order]
                t = take[piece]
                cols = {"uid": s.uid[t], "x": s.x[t].astype(np.uint32), "m": s.m[t].astype(np.uint16), "h": key[piece], "kind": kind[piece].astype(np.uint8)}
                (packed,) = packed_rows(bucket, **cols)
                raw = _gathered(s.raw, s.base[t] + s.x[t], s.m[t] + (min_len - 1))
                mark = np.append(0, np.cumsum(s.m[t] + (min_len - 1)))[np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(t))]
                yield packed.append_column("bytes", pa.array([raw[i:j].tobytes() for i, j in zip(mark[:-1].tolist(), mark[1:].tolist(), strict=True)], pa.binary()))

    return fetch


def _split(min_len: int, buckets: int, windows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs cut where the distance of window and anchor is a multiple of ``windows``, dealt by the bytes that all windows of a part would have."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _asked(batches):
            low = (s.a - s.m + 1) // windows
            parts = s.a // windows - low + 1
            done = np.cumsum(parts)
            most = 200_000
            for piece in np.split(np.arange(len(parts)), np.searchsorted(done, np.arange(most, done[-1], most)) if len(parts) else []):
                own = np.repeat(piece, parts[piece])
                q = _spread(low[piece], parts[piece])
                a = np.minimum(s.a[own], q * windows + (windows - 1))  # of the part's first window
                m = a - np.maximum(s.a[own] - s.m[own] + 1, q * windows) + 1
                x = s.x[own] + s.a[own] - a
                anchor = s.base[own] + s.x[own] + s.a[own]
                first, size = anchor - q * windows, min_len - windows + 1
                c = prefix_hash(BYTE_A[s.raw])
                h = mix((c[first + size] - c[first]) * powers(len(s.raw) + 1)[1][first]) + mix(s.h[own]) * _GOLD + q.astype(np.uint64)
                del c
                yield from _dealt(buckets, min_len, s.raw, s.base[own] + x, s.uid[own], x, m, a, mix(h), digests(s.raw, s.base[own] + x, m + (min_len - 1)), np.ones(len(own), np.int64))

    return split


_FOUND = "uid binary, s bigint, e bigint"


def _scan(min_len: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of repeats in contexts; without an end: a context that is not equal to the first one of its class."""

    def rows(uid: np.ndarray, start: np.ndarray, end: np.ndarray | pa.Array) -> pa.RecordBatch:
        return pa.record_batch({"uid": binary_of(uid), "s": start, "e": end})

    def classes(a: dict[str, np.ndarray], t: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        # a class's first context may be here for several of its parts: the same bytes, which must not be held against themselves
        _, one = np.unique(np.rec.fromarrays([a["uid"][t].view(np.uint64).reshape(-1, 2)[:, 0], a["uid"][t].view(np.uint64).reshape(-1, 2)[:, 1], a["x"][t]]), return_index=True)
        t = t[np.sort(one)]
        h = a["h"][t]
        lead = np.append(True, h[1:] != h[:-1])
        base = np.cumsum(size[t]) - size[t]
        ok = proved(_gathered(a["bytes"], begin[t], size[t]), base, size[t], lead, min_len, most)
        x = a["x"][t].astype(np.int64)
        if ok.any():
            yield rows(a["uid"][t[ok]], x[ok], x[ok] + size[t[ok]])
        if not ok.all():
            yield rows(a["uid"][t[~ok]], x[~ok], pa.nulls(int((~ok).sum()), pa.int64()))

    def chunk(a: dict[str, np.ndarray], t: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        m, h, solid = a["m"][t].astype(np.int64), a["h"][t], a["kind"][t] == _HELD
        size = size[t]
        raw = _gathered(a["bytes"], begin[t], size)
        base = np.cumsum(size) - size
        own = np.repeat(np.arange(len(t)), m)  # the context of each window
        start = _spread(base, m)
        c = prefix_hash(BYTE_A[raw])
        w = mix((c[start + min_len] - c[start]) * powers(len(raw) + 1, BASE_A)[1][start]) ^ mix(h[own] + U64(1))
        del c
        _, inv, count = np.unique(w, return_inverse=True, return_counts=True)
        fresh = np.bincount(inv, weights=~solid[own], minlength=len(count)) > 0
        pick = np.flatnonzero((count > 1)[inv] & fresh[inv])
        pick = pick[np.argsort(w[pick], kind="stable")]
        w, start, own = w[pick], start[pick], own[pick]
        # equal windows stay together
        new = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
        cuts = [0, *new[np.flatnonzero(np.diff(new // most)) + 1].tolist(), len(w)]
        best = np.zeros(len(start), np.int64)  # the longest repeat that starts at each suffix
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            rest = base[own[lo:hi]] + size[own[lo:hi]] - start[lo:hi]
            for length, members in maximal_repeats(raw, start[lo:hi], rest, min_len, start[lo:hi] > base[own[lo:hi]]):
                best[lo + members] = np.maximum(best[lo + members], length)
        hit = np.flatnonzero((best > 0) & ~solid[own])
        if len(hit):
            at = start[hit] + own[hit]  # one byte between contexts
            spans = merged(np.stack([at, at + best[hit]], 1))
            mine = np.searchsorted(base + np.arange(len(t)), spans[:, 0], "right") - 1
            spans += (a["x"][t[mine]].astype(np.int64) - base[mine] - mine)[:, None]
            yield rows(a["uid"][t[mine]], spans[:, 0], spans[:, 1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a in _buckets(batches, uid=_KEY, x=np.uint32, m=np.uint16, h=np.uint64, kind=np.uint8, bytes=np.uint8):
            size = a["m"].astype(np.int64) + (min_len - 1)
            begin = np.cumsum(size) - size
            for which, work in ((a["kind"] < _FIRST, chunk), (a["kind"] >= _FIRST, classes)):
                rows_of = np.flatnonzero(which)
                order = rows_of[np.lexsort((a["kind"][rows_of], a["h"][rows_of]))]
                if not len(order):
                    continue
                lead = np.flatnonzero(np.append(True, a["h"][order][1:] != a["h"][order][:-1]))
                done = np.append(0, np.cumsum(size[order]))[lead]
                cut = lead[np.flatnonzero(np.diff(done // (4 * _AT_ONCE))) + 1].tolist()  # whole groups
                for lo, hi in zip([0, *cut], [*cut, len(order)], strict=True):
                    yield from work(a, order[lo:hi], begin, size)

    return scan


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint, sorted, not adjoining spans of an array of (start, end)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > end[:-1])
    return np.stack([spans[new, 0], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], 1)


def _kept(raw: np.ndarray, off: np.ndarray, pairs: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of texts lo to hi no span covers, and the spans of each text that are left when they are merged; rows have the spans pairs[at[i]:at[i + 1]]."""
    count = np.diff(at[lo : hi + 1])
    base = off[lo:hi] - off[lo]
    spans = pairs[at[lo] : at[hi]] + np.repeat(base + np.arange(hi - lo), count)[:, None]  # one byte between texts
    flag = np.zeros(int(off[hi] - off[lo]) + (hi - lo) + 1, np.int32)
    np.add.at(flag, spans[:, 0], 1)
    np.add.at(flag, spans[:, 1], -1)
    free = np.cumsum(flag, dtype=np.int32) == 0
    starts = np.flatnonzero(free[:-1] & ~free[1:]) + 1
    if len(free) and not free[0]:
        starts = np.append(0, starts)
    n = np.bincount(np.searchsorted(base + np.arange(hi - lo), starts, "right") - 1, minlength=hi - lo)
    keep = np.ones(len(free), bool)
    keep[base[1:] + np.arange(hi - lo - 1)] = False
    keep[-2:] = False
    return free[keep], n


def _spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of all spans of a column of lists, and where each row's begin; null rows have none."""
    flat = column.flatten()
    count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], 1), np.append(0, np.cumsum(count)).astype(np.int64)


def _cut(keep_bytes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            pairs, at = _spans_of(batch.column("spans"))
            for lo, hi in slices(off, _AT_ONCE):
                keep, n = _kept(raw, off, pairs, at, lo, hi)
                left = np.append(0, np.cumsum(keep))[off[lo : hi + 1] - off[lo]]
                rest = memoryview(raw[off[lo] : off[hi]][keep])
                each = [rest[i:j] for i, j in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
                kept = pa.array([bytes(x) for x in each], pa.binary()) if keep_bytes else pa.nulls(hi - lo, pa.binary())
                yield pa.record_batch({"uid": batch.column("uid").slice(lo, hi - lo).cast(pa.binary()), "n_removed": np.diff(off[lo : hi + 1]) - np.diff(left), "n_spans": n.astype(np.int64), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string()), "kept": kept})

    return cut


def _classed(runs: DataFrame, buckets: int, name: str) -> DataFrame:
    return materialize(runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_classify(buckets)), _CLASSED), name)


def repeat_spans(texts: DataFrame, *, min_len: int = 200, group: int = 1000, suffixes: int = _SUFFIXES) -> DataFrame:
    """(uid, s, e): byte spans of the distinct ``texts`` (uid, text, copies) that repeats cover; they may overlap."""
    spark = prepare(texts.sparkSession)
    buckets = 32 * partitions(spark)
    gram = max(1, min_len * 8 // 25)
    held = texts.select("uid", "text")

    def scanned(classed: DataFrame, most: int) -> DataFrame:
        asked = classed.groupBy("uid").agg(F.collect_list(F.struct("x", "m", "a", "h", "c", "n", "solid", "part", "parts")).alias("asked"))
        contexts = held.join(asked, "uid").mapInArrow(released(_fetch(min_len, buckets, most)), _CONTEXTS)
        return materialize(contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(_scan(min_len, suffixes)), _FOUND), "found")

    classed = _classed(texts.select("uid", "text", "copies").mapInArrow(released(_find_runs(min_len, gram, buckets)), _RUNS), buckets, "runs")
    spans = None
    for windows in (*(min(k, max(1, min_len // 4)) for k in _FINER), 0):
        found = scanned(classed.where("n > 1 or part >= 0 or parts > 0"), group if windows else 2**62)
        here = classed.where("sure").select("uid", F.col("x").alias("s"), (F.col("x") + F.col("m") + (min_len - 1)).alias("e")).unionByName(found.where("e is not null"))
        lost = found.where("e is null")
        if not lost.isEmpty():  # equal digests of different contexts: their grams' contexts, each for itself
            grams = lost.join(classed, [lost["uid"] == classed["uid"], lost["s"] == classed["x"]]).select("h").distinct()
            alone = classed.join(grams, "h").withColumns({"n": F.lit(2).cast("bigint"), "solid": F.lit(False), "part": F.lit(-1), "parts": F.lit(0)})
            here = here.unionByName(scanned(alone, 2**62))
        spans = here if spans is None else spans.unionByName(here)
        split = classed.where(F.col("n") > group)
        if not windows or split.isEmpty():
            return spans
        asks = split.groupBy("uid").agg(F.collect_list(F.struct("x", "m", "a", "h", "c", "n", "solid", "part", "parts")).alias("asked"))
        classed = _classed(held.join(asks, "uid").mapInArrow(released(_split(min_len, buckets, windows)), _RUNS), buckets, "runs")
    return spans


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    base = with_digest(docs, id_col, text_col).withColumn("uid", F.substring("digest", 1, 16))
    return base, distinct_texts(base, "uid")


@settled
def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200, keep_bytes: bool = False) -> DataFrame:
    """Cuts every byte covered by a ``min_len``-byte string that starts anywhere else too, in the same text or another.

    Returns a row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with
    ``keep_bytes`` kept (binary; a cut may fall inside a character). Strings are judged on the input.

    Null text counts as empty; texts under ``min_len`` bytes are kept. Repeated rows are repeats of each other. doc_id
    may be null or occur twice. Extra columns are ignored; an empty table gives an empty result. A text is held whole by
    a task that cuts it, with its spans (a span has 16 bytes and stands for one byte at least, mostly for hundreds).
    """
    base, texts = _texts(docs, id_col, text_col)
    spans = repeat_spans(texts, min_len=min_len).groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    some = texts.select("uid", "text").join(spans, "uid").mapInArrow(released(_cut(keep_bytes)), "uid binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    columns = ["doc_id", "uid", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lower(F.hex("digest")).alias("own")] + ([F.col("text").cast("binary").alias("own_bytes")] if keep_bytes else [])
    out = base.select(*columns).join(some, "uid", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"),
                      *([F.coalesce("kept", "own_bytes").alias("kept")] if keep_bytes else []))


def _cut_text(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, lists in columns:
        raw, off = text_buffer(text)
        pairs, at = _spans_of(lists)
        left, parts, total = [np.zeros(1, np.int64)], [], 0
        for lo, hi in slices(off, _AT_ONCE):
            keep, _ = _kept(raw, off, pairs, at, lo, hi)
            part = raw[off[lo] : off[hi]]
            char = np.flatnonzero((part & 0xC0) != 0x80)
            if len(char):  # a character that is cut in part goes whole
                keep = np.repeat(np.logical_and.reduceat(keep, char), np.diff(np.append(char, len(part))))
            parts.append(part[keep].tobytes())
            left.append(total + np.append(0, np.cumsum(keep))[off[lo + 1 : hi + 1] - off[lo]])
            total += len(parts[-1])
        out = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(np.concatenate(left)), pa.py_buffer(b"".join(parts))).cast(pa.string())
        yield pc.if_else(pc.is_valid(text), out, pa.scalar(None, pa.string())) if text.null_count else out


@settled
def _cuts(docs: DataFrame, text_col: str, min_len: int) -> DataFrame:
    """(uid, spans) of the texts that have any."""
    _, texts = _texts(docs, text_col, text_col)
    return repeat_spans(texts, min_len=min_len).groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def cut_repeats(docs: DataFrame, *, text_col: str = "text", min_len: int = 200) -> DataFrame:
    """The rows and columns of ``docs``, the text without the bytes that :func:`remove_repeats` cuts (a character cut in part goes whole).

    Null texts stay null. Columns may have any names. What is kept meanwhile are the spans alone; the rows come from ``docs``.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    uid = F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)
    spans = _cuts(docs, text_col, min_len)
    cut = F.arrow_udf(released(_cut_text), "string")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    joined = docs.select(row.alias("row"), uid.alias("uid")).join(spans, "uid", "left")
    return joined.select(*(cut(F.col("row")[c].cast("string"), F.col("spans")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
