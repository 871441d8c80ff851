"""MinHash near-dedup by an inverted join on signature coordinates.

Every text gives a set of word shingles and ``coordinates`` MinHash values. A posting is a (coordinate, value)
pair. Two sets of similarity s agree on a coordinate with probability s, so a pair is a match if it collides on at
least ``matches`` of them (27 of 48 at the default: a pair of similarity 0.85 has fewer with probability 4e-7, one of 0.5
has as many with 0.24, one of 0.4 with 0.02).

* Prefix: ranked from rare to frequent, two lists with ``matches`` common postings share one among the first
  ``coordinates - matches + 1`` of each. Only those are posted; postings that no other set has are never moved
  twice, and a set with fewer than ``matches`` repeated postings has no partner.
* Counting: the sets of a posting list are posted anew under all their coordinates, and these lists are merged: a
  pair's count is the number of lists that have both. Pairs that share an earlier posting of their prefixes are skipped,
  as that one's list counts them; for long lists, the longest of a set's lists are not merged but looked up for the
  pairs that the others leave within reach.
* Of the matches only a forest of the strongest ones leaves the list; lists longer than ``block`` are dealt out by pairs
  of blocks. The forest's pairs are confirmed on their words. Groups of matches that this joins are done. In any other
  group all pairs of sets from different parts are decided inside tasks (counted through a matrix product over the
  shingles that several sets hold): in blocks of the group, up to ``dense`` sets, which a set is then copied to at most
  ``dense / set_block`` times, and in larger groups in the lists of the rarest shingles. No pairs are emitted but links.

Shingles are 64-bit hashes of their words' hashes; words of over 64 bytes are hashed as a whole. Pairs are confirmed on
the words themselves, and equal sets are known by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import BYTE_A, U64, components, distinct_texts, mix, powers, prefix_hash, released, slices, text_buffer, with_digest
from foliospark.session import materialize, prepare, settled

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED = BYTE_A.copy()
_FOLDED[65:91] = BYTE_A[97:123]
_FOLDED[_IS_SPACE] = 0
_SPACES = bytes(np.flatnonzero(_IS_SPACE).tolist())
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHOLE = 64
_WEIGHTS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5), U64(0x85EBCA77C2B2AE63), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row, in one array with offsets."""
    n_rows = len(offsets) - 1
    word = ~_IS_SPACE[raw]
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = word[:-1]
        before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    starts = np.flatnonzero(word & ~before)
    c = prefix_hash(_FOLDED[raw])
    ends = np.append(starts[1:], len(raw))
    row = np.searchsorted(offsets, starts, "right") - 1
    if len(starts):  # a word ends at its row's end at the latest; the bytes between words weigh nothing
        ends = np.minimum(ends, offsets[row + 1])
    h = mix((c[ends] - c[starts]) * powers(len(raw) + 1)[1][starts])
    for i in np.flatnonzero(ends - starts > _WHOLE).tolist():  # sums of powers fail for some long words
        w = raw[starts[i] : ends[i]].tobytes().strip(_SPACES).lower()
        if len(w) > _WHOLE:
            h[i] = xxhash.xxh3_64_intdigest(w)
    words = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(words)])
    m = len(h)
    full = max(0, m - width + 1)
    s = np.zeros(full, np.uint64)
    for k in range(width):
        s += h[k : k + full] * _WEIGHTS[k]
    keep = row[:full] == row[width - 1 : width - 1 + full] if full else np.zeros(0, bool)
    s, owner = mix(s[keep]), row[:full][keep]
    for few in range(1, width):  # fewer words than the width: the whole sequence is one shingle
        at = first[:-1][words == few]
        if len(at):
            z = np.full(len(at), U64(few * int(_WEIGHTS[-1]) % 2**64), np.uint64)
            for k in range(few):
                z += h[at + k] * _WEIGHTS[k]
            s, owner = np.append(s, mix(z)), np.append(owner, np.flatnonzero(words == few))
    order = np.argsort(owner, kind="stable")
    s, owner = s[order], owner[order]
    size = np.bincount(owner, minlength=n_rows)
    at = np.concatenate([[0], np.cumsum(size)])
    for i in np.flatnonzero(size > 1):
        s[at[i] : at[i + 1]].sort()
    if len(s):
        new = np.append(True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1]))
        s, owner = s[new], owner[new]
    return s, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_rows))])


def exact_shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`shingle_sets`, with numbers in place of hashes: equal ones in these rows are equal shingles, word by word."""
    n_rows = len(offsets) - 1
    word = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.append(False, word[:-1])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.append(word[1:], False))) + 1
    at = np.append(0, np.cumsum(ends - starts))
    data = _LOWER[raw[word]]
    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy().astype(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(row, minlength=n_rows)
    full, kinds = max(0, len(ids) - width + 1), int(ids.max(initial=0)) + 1
    code, live = ids[:full], row[:full] == row[width - 1 : width - 1 + full]
    for k in range(1, width):
        code = np.unique(code * kinds + ids[k : k + full], return_inverse=True)[1]
    code, owner = code[live], row[:full][live]
    first, few, seen = np.append(0, np.cumsum(words)), np.flatnonzero((words > 0) & (words < width)), {}
    for i in few.tolist():  # the whole sequence is one shingle
        seen.setdefault((i, tuple(ids[first[i] : first[i + 1]].tolist())), None)
    short: dict[tuple, int] = {}
    numbers = [short.setdefault(s, len(ids) + len(short)) for _, s in seen]
    code, owner = np.append(code, np.array(numbers, np.int64)), np.append(owner, few)
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])) if len(code) else np.zeros(0, bool)
    return code[new], np.append(0, np.cumsum(np.bincount(owner[new], minlength=n_rows)))


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return rng.integers(0, 2**63, k, dtype=np.uint64) | U64(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def _signer(width: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    mul, add = _coefficients(k)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            for i, j in slices(off):
                s, at = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], width)
                size = np.diff(at)
                has = np.flatnonzero(size)
                sig = np.zeros((j - i, k), np.uint32)
                if len(has):
                    lead = at[:-1][has]
                    for c in range(k):
                        sig[has, c] = np.minimum.reduceat((s * mul[c] + add[c]) >> U64(32), lead).astype(np.uint32)
                yield pa.record_batch({
                    "digest": batch.column("digest").slice(i, j - i).cast(pa.binary()),
                    "n_shingles": pa.array(size, pa.int64()),
                    "set_key": pa.array([xxhash.xxh3_128_digest(s[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                    "sig": pa.array([x.tobytes() for x in sig], pa.binary()),
                    "postings": pa.array([x if n else None for x, n in zip((sig.astype(np.int64) | (np.arange(k, dtype=np.int64) << 32)).tolist(), size.tolist(), strict=True)], pa.list_(pa.int64())),
                })

    return sign


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each batch sorted by ``keys``, cut so that a group of equal keys is never split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if batch.num_rows > 1:
            change = np.zeros(batch.num_rows - 1, bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            last = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        else:
            last = 0
        same = bool(held) and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        c = table.column(k).to_numpy()
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


def _runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of keys, and where the runs of two or more equal ones begin in it and how long they are."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    lead = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(lead, len(k)))
    return order, lead[size > 1], size[size > 1]


def _tree(n: int, a: np.ndarray, b: np.ndarray, count: np.ndarray) -> list[tuple[int, int]]:
    """A strongest spanning forest of weighted pairs."""
    label, out = list(range(n)), []

    def top(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in np.argsort(-count, kind="stable").tolist():
        x, y = int(a[i]), int(b[i])
        r, s = top(x), top(y)
        if r != s:
            label[s] = r
            out.append((x, y))
    return out


def merged_counts(sig: np.ndarray, place: np.ndarray, here: np.ndarray, group: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, count) of the pairs of rows of short lists that collide ``matches`` times and have no earlier posting in common.

    place: the rank of a coordinate's posting in its row's prefix, or 127; here: that of the list's own posting.
    """
    n, k = sig.shape
    coordinate = np.tile(np.arange(k), n)
    value = np.unique((sig.astype(np.uint64) | (np.arange(k, dtype=np.uint64) << U64(32))).ravel(), return_inverse=True)[1]
    order, lead, size = _runs_of(group.repeat(k) * (int(value.max(initial=0)) + 1) + value)
    pairs, ranks = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
    for length in np.unique(size).tolist():  # every pair of each merged list
        x, y = np.triu_indices(length, 1)
        at = lead[size == length]
        i, j = order[(at[:, None] + x).ravel()], order[(at[:, None] + y).ravel()]
        c = coordinate[i]
        i, j = i // k, j // k
        pairs.append(i * n + j)
        ranks.append(np.where(place[j, c] < 127, place[i, c], 127).astype(np.int8))
    pair, rank = np.concatenate(pairs), np.concatenate(ranks)
    if not len(pair):
        return pair, pair, pair
    order = np.argsort(pair, kind="stable")
    pair, rank = pair[order], rank[order]
    lead = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    count, first = np.diff(np.append(lead, len(pair))), np.minimum.reduceat(rank, lead)
    pair = pair[lead]
    keep = (count >= matches) & (first == here[pair // n])
    return pair[keep] // n, pair[keep] % n, count[keep]


def forest(sig: np.ndarray, place: np.ndarray, here: np.ndarray, side: np.ndarray | None, matches: int) -> list[tuple[int, int]]:
    """Edges of a strongest spanning forest of the pairs of one long list that collide ``matches`` times and have no earlier
    posting in common; with sides, of pairs across them. Lists of a row are merged, the longest but looked up."""
    n, k = sig.shape
    _, value = np.unique((sig.astype(np.uint64) | (np.arange(k, dtype=np.uint64) << U64(32))).ravel(), return_inverse=True)
    order = np.argsort(value, kind="stable")
    owner, at = order // k, np.append(0, np.cumsum(np.bincount(value)))
    value = value.reshape(n, k)
    length = np.diff(at)
    aside = matches // 2  # lists that are looked up
    best, by, todo, out = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.ones(n, bool), []
    for _ in range(n):
        v = int(np.argmax(np.where(todo, best, -2)))
        if best[v] >= matches:
            out.append((int(by[v]), v))
        todo[v] = False
        lists = value[v][np.argsort(length[value[v]], kind="stable")].tolist()
        short = [owner[at[x] : at[x + 1]] for x in lists[: k - aside]]
        count = np.bincount(np.concatenate(short), minlength=n)
        near = np.flatnonzero(todo & (count >= matches - aside))
        if side is not None:
            near = near[side[near] != side[v]]
        for x in lists[k - aside :]:
            if not len(near):
                break
            held = owner[at[x] : at[x + 1]]
            place_in = np.searchsorted(held, near)
            count[near] += held[np.minimum(place_in, len(held) - 1)] == near
        near = near[count[near] >= matches]
        for c in np.flatnonzero(place[v] < here[v]).tolist():  # earlier postings of the prefix have lists of their own
            near = near[(sig[near, c] != sig[v, c]) | (place[near, c] == 127)]
        near = near[count[near] > best[near]]
        best[near], by[near] = count[near], v
    return out


def _matcher(matches: int, short: int = 48, rows: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    keys = ["token", "bi", "bj"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            at = group_starts(t, keys)
            node = t.column("digest").to_pylist()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(t.num_rows, -1)
            home, bi, bj, token = (t.column(c).to_numpy() for c in ("home", "bi", "bj", "token"))
            prefix = t.column("prefix").combine_chunks()
            count = prefix.value_lengths().to_numpy()
            place = np.full(sig.shape, 127, np.int8)
            own = np.repeat(np.arange(len(count)), count)
            place[own, prefix.flatten().to_numpy()] = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            here = place[np.arange(len(token)), token >> 32]
            a, b = [], []
            size = np.diff(at)
            few = np.flatnonzero((size > 1) & ((size <= short) & (bi == bj)[at[:-1]]))
            done = np.cumsum(size[few])
            for part in np.split(few, np.searchsorted(done, np.arange(rows, done[-1], rows)) if len(few) else []):
                take = np.concatenate([np.arange(at[g], at[g + 1]) for g in part.tolist()]) if len(part) else np.zeros(0, np.int64)
                x, y, n = merged_counts(sig[take], place[take], here[take], np.repeat(np.arange(len(part)), size[part]), matches)
                for i, j in _tree(len(take), x, y, n):
                    a.append(node[take[i]])
                    b.append(node[take[j]])
            for g in np.flatnonzero((size > 1) & ~((size <= short) & (bi == bj)[at[:-1]])).tolist():
                i, j = int(at[g]), int(at[g + 1])
                for x, y in forest(sig[i:j], place[i:j], here[i:j], home[i:j] if bi[i] != bj[i] else None, matches):
                    a.append(node[i + x])
                    b.append(node[i + y])
            yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return match


def _similar(inter: np.ndarray | int, x: np.ndarray | int, y: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * inter >= percent * (x + y - inter)


def _confirmer(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ra, oa), (rb, ob) = (text_buffer(batch.column(c)) for c in ("text_a", "text_b"))
            ok = np.zeros(batch.num_rows, bool)
            for i, j in slices(oa + ob, 2 << 20):
                raw = np.concatenate([ra[oa[i] : oa[j]], rb[ob[i] : ob[j]]])
                code, at = exact_shingles(raw, np.concatenate([oa[i : j + 1] - oa[i], ob[i + 1 : j + 1] - ob[i] + (oa[j] - oa[i])]), width)
                size = np.diff(at)
                x, y = size[: j - i], size[j - i :]
                pair = np.repeat(np.tile(np.arange(j - i), 2), size)
                key = np.sort(pair * (int(code.max(initial=0)) + 1) + code)
                both = np.bincount(key[1:][key[1:] == key[:-1]] // (int(code.max(initial=0)) + 1), minlength=j - i)
                ok[i:j] = _similar(both, x, y, percent) & (both > 0)
            keep = pa.array(ok)
            yield pa.record_batch({"a": batch.column("a").filter(keep).cast(pa.binary()), "b": batch.column("b").filter(keep).cast(pa.binary())})

    return confirm


def links_in_block(sets: list[np.ndarray], part: np.ndarray, home: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A forest of links between sets of different parts (and, with homes, of different homes) that connects what links connect."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), size)
    _, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[inv]
    owner, col = owner[keep], column[inv[keep]]
    inter = np.zeros((n, n), np.float64)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for lo in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(col, [lo, lo + 4096])
        x = np.zeros((n, min(4096, int(shared.sum()) - lo)), np.float32)
        x[owner[i:j], col[i:j] - lo] = 1
        inter += x @ x.T
    ok = _similar(inter, size[:, None], size[None, :], percent) & (part[:, None] != part[None, :]) & (inter > 0)
    if home is not None:
        ok &= home[:, None] != home[None, :]
    label, out = np.unique(part, return_inverse=True)[1], []
    for a, b in zip(*(v.tolist() for v in np.nonzero(np.triu(ok, 1))), strict=True):
        if label[a] != label[b]:
            out.append((a, b))
            label[label == label[b]] = label[a]
    return out


def _rest(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    keys = ["group", "bi", "bj"]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            at = group_starts(t, keys)
            node, part = t.column("digest").to_pylist(), np.array(t.column("part").to_pylist(), object)
            home, bi, bj = (t.column(c).to_numpy() for c in ("home", "bi", "bj"))
            text = t.column("text").combine_chunks()
            a, b = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if j - i < 2 or len(set(part[i:j])) < 2:
                    continue
                s, p = exact_shingles(*text_buffer(text.slice(i, j - i)), width)
                for x, y in links_in_block([s[p[k] : p[k + 1]] for k in range(j - i)], part[i:j], home[i:j] if bi[i] != bj[i] else None, percent):
                    a.append(node[i + x])
                    b.append(node[i + y])
            yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return confirm


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            for i, j in slices(off):
                s, at = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], width)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(s.view(np.int64)))
                yield pa.record_batch([*(batch.column(c).slice(i, j - i).cast(pa.binary()) for c in ("digest", "group", "part")), lists], ["digest", "group", "part", "shingles"])

    return run


def _listed(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    keys = ["group", "s", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            at = group_starts(t, keys)
            node, part = t.column("digest").to_pylist(), np.array(t.column("part").to_pylist(), object)
            home, bi, bj = (t.column(c).to_numpy() for c in ("home", "bi", "bj"))
            lists = t.column("shingles").combine_chunks()
            flat, off = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            a, b = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if len(set(part[i:j])) > 1:
                    for x, y in links_in_block([flat[off[k] : off[k + 1]] for k in range(i, j)], part[i:j], home[i:j] if bi[i] != bj[i] else None, percent):
                        a.append(node[i + x])
                        b.append(node[i + y])
            yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def links_by_lists(left: DataFrame, *, width: int, percent: int, set_block: int) -> DataFrame:
    """(a, b): links between the parts of groups, for groups of very many sets; ``left`` has digest, text, group and part.

    Two sets that are similar share one of the rarest shingles of each, as many as may be missing and one. Only shingles that
    several parts have are posted; a set whose own shingles alone fill its share has no partner. Sets go to the lists of these
    shingles, so a set is copied no more often than it has of them, however large its group.
    """
    sets = materialize(left.select("digest", "group", "part", "text").mapInArrow(released(_sets(width)), "digest binary, group binary, part binary, shingles array<bigint>"), "sets")
    posted = sets.select("digest", "group", "part", F.explode("shingles").alias("s"))
    shared = posted.groupBy("group", "s").agg(F.count(F.lit(1)).alias("c"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("group", "s", "c")
    own = posted.select("digest", "group", "s").join(shared, ["group", "s"]).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("shared"))
    n = F.size("shingles")
    share = n - F.ceil(n * percent / 100.0 - 1e-9) + 1 - (n - F.size("shared"))
    few = sets.join(own, "digest").withColumn("share", share.cast("int")).where("share > 0").select("digest", "group", "part", F.explode(F.slice("shared", F.lit(1), F.col("share"))).alias("x")).select("digest", "group", "part", "x.s")
    lists = few.join(few.groupBy("group", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["group", "s"])
    dealt = _blocks(lists.join(sets.select("digest", "shingles"), "digest"), "n", set_block)
    order = ["group", "s", "bi", "bj"]
    return dealt.repartition(*order).sortWithinPartitions(*order).select(*order, "home", "digest", "part", "shingles").mapInArrow(released(_listed(percent)), "a binary, b binary")


def _blocks(df: DataFrame, size: str, block: int) -> DataFrame:
    """home: a row's block, by hash; a row is dealt to each pair of blocks that has its own."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (df.withColumn("blocks", blocks).withColumn("home", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).withColumn("other", other)
            .withColumn("bi", F.least("home", "other")).withColumn("bj", F.greatest("home", "other")).drop("blocks", "other"))


def _with_texts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    side = lambda c: members.select(F.col("digest").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def near_duplicate_classes(texts: DataFrame, *, width: int = 3, percent: int = 85, coordinates: int = 48, matches: int = 27, block: int = 1024, set_block: int = 256, dense: int = 16_384) -> DataFrame:
    """(digest, n_shingles, set_key, root): root is null for sets without links; texts is :func:`distinct_texts`."""
    prepare(texts.sparkSession)
    signed = materialize(texts.select("digest", "text").mapInArrow(released(_signer(width, coordinates)), "digest binary, n_shingles bigint, set_key binary, sig binary, postings array<bigint>"), "signed")
    nodes = signed.where("n_shingles > 0").groupBy("set_key").agg(F.min_by(F.struct("digest", "sig", "postings"), "digest").alias("one")).select("one.*")
    posted = nodes.select("digest", F.explode("postings").alias("token"))
    often = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = posted.join(often, "token").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ranked")).where(F.size("ranked") >= matches)
    prefix = ranked.select("digest", F.slice("ranked", F.lit(1), F.size("ranked") - (matches - 1)).alias("p"))
    prefix = prefix.select("digest", F.transform("p", lambda x: F.shiftright(x["token"], 32).cast("tinyint")).alias("prefix"), F.explode("p").alias("q")).select("digest", "prefix", "q.n", "q.token")
    lists = _blocks(prefix.join(nodes.select("digest", "sig"), "digest"), "n", block)
    matched = lists.repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj").select("token", "bi", "bj", "home", "digest", "sig", "prefix").mapInArrow(released(_matcher(matches)), "a binary, b binary")
    matched = materialize(matched.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "matched")
    loose = materialize(components(matched).withColumnRenamed("root", "group"), "groups")
    members = materialize(texts.join(loose, F.col("digest") == F.col("node")).select("digest", "text", "group"), "members")
    sure = materialize(_with_texts(matched, members).mapInArrow(released(_confirmer(width, percent)), "a binary, b binary"), "links")
    strict = components(sure)
    parts = loose.join(strict, "node", "left").select(F.col("node").alias("digest"), "group", F.coalesce("root", "node").alias("part"))
    open_groups = parts.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.min("part").alias("p"), F.max("part").alias("q")).where("members > 2 and p <> q").select("group", "members")
    left = materialize(parts.join(open_groups, "group"), "open")
    texts_of = lambda which: left.where(which).join(members.select("digest", "text"), "digest")
    dealt = _blocks(texts_of(F.col("members") <= dense), "members", set_block)
    more = dealt.repartition("group", "bi", "bj").sortWithinPartitions("group", "bi", "bj").select("group", "bi", "bj", "home", "digest", "part", "text").mapInArrow(released(_rest(width, percent)), "a binary, b binary")
    if not left.where(F.col("members") > dense).isEmpty():
        found = links_by_lists(texts_of(F.col("members") > dense), width=width, percent=percent, set_block=set_block)
        found = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "listed")
        more = more.unionByName(_with_texts(found, members).mapInArrow(released(_confirmer(width, percent)), "a binary, b binary"))
    links = components(materialize(sure.unionByName(more), "links"))
    roots = nodes.select("digest").join(links, F.col("digest") == F.col("node")).select("digest", "root")
    by_set = signed.select("digest", "set_key").join(roots, "digest").select("set_key", "root")
    return signed.select("digest", "n_shingles", "set_key").join(by_set, "set_key", "left")


@settled
def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Groups of documents joined by links of similar shingle sets.

    Words are runs of bytes other than ASCII white space, with A-Z lowered; the set of a text has its distinct
    ``width``-word shingles (64-bit hashes). Returns one row per input row: doc_id, n_shingles, component_id (the
    smallest doc_id of its group), kept (doc_id = component_id).

    Null or blank text: no shingles, linked with nothing. Equal sets are linked. Repeated rows: one row each. Null
    doc_id: never the smallest, component_id of the others if there are any, kept null. Extra columns are ignored;
    an empty table gives an empty result. Texts of any length are read whole.
    """
    base = with_digest(docs, id_col, text_col)
    rows = materialize(_grouped(base, distinct_texts(base), **options), "grouped")
    # written, so that both sides of the join are plain exchanges, of which Spark splits a group's
    least = materialize(rows.where("g is not null").groupBy("g").agg(F.min("doc_id").alias("least")), "least")
    out = rows.where("g is not null").join(least, "g").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    out = out.unionByName(rows.where("g is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _grouped(base: DataFrame, texts: DataFrame, **options: int) -> DataFrame:
    """(doc_id, digest, n_shingles, g): g is equal for rows of one group, null for texts without shingles."""
    classes = near_duplicate_classes(texts, **options)
    alone = F.when(F.col("n_shingles") > 0, F.col("set_key"))
    return base.select("doc_id", "digest").join(classes, "digest").select("doc_id", "digest", "n_shingles", F.coalesce("root", alone).alias("g"))


@settled
def _staying(docs: DataFrame, id_col: str, text_col: str, **options: int) -> DataFrame:
    """(digest, id): of each group of texts the one that stays."""
    base = with_digest(docs, id_col, text_col)
    rows = _grouped(base, distinct_texts(base), **options)
    best = rows.where("g is not null").groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("m"))
    return best.select(F.col("m.digest").alias("digest"), F.col("m.doc_id").alias("id"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows and columns of ``docs`` with one row of each group: that of the smallest doc_id (a null one only if all are).

    Rows without words stay, as they are linked with nothing. Of repeated rows one stays. What is kept meanwhile are the
    digests of the texts that stay; the rows come from ``docs``.
    """
    stay = _staying(docs, id_col, text_col, **options)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    worded = text.rlike(r"[^ \t\n\x0B\f\r]")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    marked = docs.where(worded).select(row.alias("row"), F.col(f"`{id_col}`").alias("own"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    one = marked.join(stay, "digest").where(F.col("own").eqNullSafe(F.col("id"))).dropDuplicates(["digest"])
    return one.select("row.*").unionByName(docs.where(~worded))
