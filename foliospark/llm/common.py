"""Shared parts: distinct texts, text buffers of Arrow batches, 64-bit hashes in numpy, connected components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import materialize, materialize_bucketed

U64 = np.uint64
_rng = np.random.default_rng(20240607)
_ODD = U64(1)
BYTE_A = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + _ODD
BYTE_B = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + _ODD
BASE_A, BASE_B = (U64(int(x) | 1) for x in _rng.integers(2**40, 2**62, 2))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(work: Batches) -> Batches:
    """``work``, after which the Python worker, which waits for other tasks, gives its freed memory back to the system."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int, base: np.uint64 = BASE_A) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, U64(pow(int(base), -1, 2**64)), np.uint64)
        up[0] = down[0] = 1
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[int(base)] = got
    return got


def prefix_hash(values: np.ndarray, base: np.uint64 = BASE_A) -> np.ndarray:
    """c with (c[j] - c[i]) * base**-i a hash of values[i:j] alone."""
    c = np.empty(len(values) + 1, np.uint64)
    c[0] = 0
    np.cumsum(values * powers(len(values), base)[0][: len(values)], out=c[1:])
    return c


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in one array, and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole rows with about ``most`` bytes each; a longer row is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def packed_rows(bucket: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that has any, with its values of every column as bytes."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    lead = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    ends = np.append(lead[1:], len(b)).tolist()
    arrays = {"bucket": pa.array(b[lead], pa.int32())}
    for k, v in columns.items():
        v = v[order]
        arrays[k] = pa.array([v[i:j].tobytes() for i, j in zip(lead.tolist(), ends, strict=True)], pa.binary())
    yield pa.record_batch(arrays)


def unpacked_rows(batches: Iterator[pa.RecordBatch], **types: type) -> dict[str, np.ndarray]:
    got: dict[str, list[bytes]] = {k: [] for k in types}
    for b in batches:
        for k in types:
            got[k] += b.column(k).to_pylist()
    return {k: np.frombuffer(b"".join(got[k]), t) for k, t in types.items()}


def with_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, digest): null text is empty; any other column is left behind."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def distinct_texts(docs: DataFrame, key: str = "digest") -> DataFrame:
    """One row per distinct text of :func:`with_digest`: (key, text, copies), written in buckets of the key, which is the digest or 128 bits of it."""
    return materialize_bucketed(docs.groupBy(key).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "texts", key)


class _Sets:
    """Joined sets of nodes; a set's root is its least node."""

    def __init__(self, edges: Iterator[pa.RecordBatch]) -> None:
        self.parent: dict[bytes, bytes] = {}
        for batch in edges:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                self.parent.setdefault(a, a)
                self.parent.setdefault(b, b)
                a, b = self.root(a), self.root(b)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)

    def root(self, x: bytes) -> bytes:
        top = x
        while self.parent[top] != top:
            top = self.parent[top]
        while self.parent[x] != top:
            self.parent[x], x = top, self.parent[x]
        return top


def _pairs(a: str, b: str, pairs: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(pairs), 20_000):
        part = pairs[i : i + 20_000]
        yield pa.record_batch({a: pa.array([x for x, _ in part], pa.binary()), b: pa.array([y for _, y in part], pa.binary())})


def _union_find(edges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = _Sets(edges)
    yield from _pairs("node", "root", [(x, sets.root(x)) for x in list(sets.parent)])


def _chains(edges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's edges join, as chains: no node has more than two, however many it had."""
    sets = _Sets(edges)
    last: dict[bytes, bytes] = {}
    out = []
    for x in list(sets.parent):
        root = sets.root(x)
        if root in last:
            out.append((last[root], x))
        last[root] = x
    yield from _pairs("a", "b", out)


def components(edges: DataFrame, level: int = 0, *, few: int = 20_000) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b: binary); root is one node of the component.

    What each task's edges join goes on as chains, so that a node with very many links is no hot key.
    Each edge goes to its end of smaller hash, so that a task holds whole neighbourhoods of local minima and
    joins them in memory; a node that several tasks have given roots links these roots, and these links, on a
    constant fraction of the nodes, are solved in the same way. No task holds more than its share of the edges.
    Once ``few`` edges are left, which are counted, one task solves them.
    """
    schema = "node binary, root binary"
    held = materialize(edges.where("a <> b").select("a", "b").mapInArrow(released(_chains), "a binary, b binary"), "edges")
    if held.count() <= few:
        return materialize(held.coalesce(1).mapInArrow(released(_union_find), schema), "components")
    ha, hb = (F.xxhash64(F.col(c), F.lit(level)) for c in ("a", "b"))
    dealt = held.repartition(F.when(ha < hb, F.col("a")).otherwise(F.col("b")))
    found = materialize(dealt.mapInArrow(released(_union_find), schema), "components")
    least = found.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other"))
    links = found.join(least.where("root <> other").select("node", F.col("root").alias("b")), "node").where("root <> b").select(F.col("root").alias("a"), "b").distinct()
    up = components(links, level + 1, few=few).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return least.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
