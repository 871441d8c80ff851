"""Vector codes: product quantisation by rounds of assignments, the nearest entry found by annular norm pruning.

An entry nearer to a vector than d has a norm within d of the vector's. Entries are sorted by norm; a vector begins with the
entry of nearest norm, whose distance bounds an annulus, which binary search turns into an interval of the sorted entries.
Only these are evaluated, from the vector's norm outwards, and the interval shrinks with each better one. Distances are
whole numbers and exact; the bound is widened by more than the norms' rounding, and its ends belong to it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import released, text_buffer
from foliospark.session import materialize, prepare, settled

_WIDER = 1e-6  # of norms and distances, which are rounded to 1e-16 of themselves


class Codebook:
    """The entries of one part position; ``order`` sorts them by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The number and the squared distance of each row's nearest entry; of equally near ones the least number.

        ``tally`` gets how many distances were computed.
        """
        count = len(self.norms)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        after = np.searchsorted(self.norms, norm)
        low, high = np.maximum(after - 1, 0), np.minimum(after, count - 1)
        first = np.where(norm - self.norms[low] <= self.norms[high] - norm, low, high)
        entry = self.order[first]
        best = ((x - self.entries[entry]) ** 2).sum(1)
        evaluated = len(x)
        reach = np.sqrt(best.astype(np.float64)) * (1 + _WIDER) + _WIDER
        begin, end = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        for away in range(1, count):  # places of the sorted entries, outwards from the first
            for place in (first - away, first + away):
                rows = np.flatnonzero((place >= begin) & (place < end))
                gap = np.abs(self.norms[place[rows]] - norm[rows])
                rows = rows[gap <= np.sqrt(best[rows].astype(np.float64)) * (1 + _WIDER) + _WIDER]  # the interval has shrunk meanwhile
                if not len(rows):
                    continue
                evaluated += len(rows)
                other = self.order[place[rows]]
                d = ((x[rows] - self.entries[other]) ** 2).sum(1)
                better = (d < best[rows]) | (d == best[rows]) & (other < entry[rows])
                best[rows[better]], entry[rows[better]] = d[better], other[better]
        if tally is not None:
            tally[0] += evaluated
        return entry, best


def _whole_numbers(scale: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows whose vectors can be coded, the components as whole numbers of 64 bits."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1).astype(np.int64)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are nan
            at = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
            for dims in np.unique(size[(size > 0) & (size % parts == 0)]).tolist():
                rows = np.flatnonzero(size == dims)
                x = flat[at[rows][:, None] + np.arange(dims)]
                most = math.isqrt((2**63 - 1) // dims) // 2  # differences of such components have squares that sum up in 64 bits
                with np.errstate(invalid="ignore", over="ignore"):
                    x = np.floor(x * scale)
                    rows = rows[keep := (np.isfinite(x) & (np.abs(x) < most)).all(1)]
                raw = x[keep].astype(np.int64)
                picked = batch.select(["vec_id", "label"]).take(pa.array(rows))
                packed = pa.array([r.tobytes() for r in raw], pa.binary())
                yield pa.record_batch([*picked.columns, pa.array(np.full(len(rows), dims), pa.int32()), packed], ["vec_id", "label", "dims", "x"])

    return convert


Books = dict[int, list[Codebook]]  # by length of vectors


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield d, rows, text_buffer(batch.column("x").take(pa.array(rows)))[0].view(np.int64).reshape(len(rows), d)


def _sums(books: Books, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sum of the parts that each entry is nearest to: a bounded number of rows, however many vectors it has."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: [np.zeros((len(b.entries), d // parts), np.int64) for b in own] for d, own in books.items()}
        count = {d: [np.zeros(len(b.entries), np.int64) for b in own] for d, own in books.items()}
        for batch in batches:
            for d, _, x in _by_length(batch):
                for part, book in enumerate(books[d]):
                    own = x[:, part * (d // parts) : (part + 1) * (d // parts)]
                    entry, _ = book.nearest(own)
                    count[d][part] += np.bincount(entry, minlength=len(book.entries))
                    np.add.at(total[d][part], entry, own)
        out = [(d, part, e, int(count[d][part][e]), total[d][part][e].tolist()) for d in books for part in range(parts) for e in np.flatnonzero(count[d][part]).tolist()]
        if out:
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["dims", "part", "entry", "n", "sums"])

    return add


def _coder(books: Books, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = [""] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for d, rows, x in _by_length(batch):
                entries = np.zeros((len(rows), parts), np.uint8)
                for part, book in enumerate(books[d]):
                    entries[:, part], distance = book.nearest(x[:, part * (d // parts) : (part + 1) * (d // parts)])
                    error[rows] += distance
                for i, e in zip(rows.tolist(), entries, strict=True):
                    codes[i] = e.tobytes().hex()
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), batch.column("dims"), pa.array(codes), pa.array(error)], ["vec_id", "label", "dims", "code", "error"])

    return code


class Model(NamedTuple):
    books: Books

    def digest(self, dims: int) -> str:
        """SHA-256 of all entries' components by part, entry and position, in decimals joined by commas."""
        return hashlib.sha256(",".join(str(v) for b in self.books[dims] for v in b.entries.ravel().tolist()).encode()).hexdigest()


def fit_codebooks(rows: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6) -> Model:
    """Codebooks of ``rows`` (vec_id, dims, x): begun with the parts of the smallest ids, then refined ``rounds`` times over all rows.

    What comes to the driver is ``entries`` vectors and their sums for each length of vectors.
    """
    lengths = [r["dims"] for r in rows.select("dims").distinct().collect()]
    books: Books = {}
    for d in lengths:
        first = rows.where(F.col("dims") == d).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
        x = np.frombuffer(b"".join(bytes(r["x"]) for r in first), np.int64).reshape(len(first), parts, d // parts)
        books[d] = [Codebook(x[:, p].copy()) for p in range(parts)]
    for _ in range(rounds if books else 0):
        found = rows.mapInArrow(released(_sums(books, parts)), "dims int, part int, entry int, n bigint, sums array<bigint>")
        spread = found.select("dims", "part", "entry", "n", F.posexplode("sums").alias("at", "v"))
        totals = spread.groupBy("dims", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
        fresh = {d: [b.entries.copy() for b in own] for d, own in books.items()}  # an entry that is nearest to nothing stays
        for r in totals:
            fresh[r["dims"]][r["part"]][r["entry"], r["at"]] = r["v"] // r["n"]
        books = {d: [Codebook(e) for e in own] for d, own in fresh.items()}
    return Model(books)


@settled
def vector_codes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """Codes vectors by the number of the nearest entry in each part's codebook.

    Components become floor(``scale`` * x); a vector is cut into ``parts`` equal parts. Returns vec_id, code (two hex
    digits a part), error (squared distances summed over parts), label_error (errors summed over equal labels; null if
    beyond 64 bits), codebooks_sha256.

    Null vectors, empty ones and those with null or non-finite components are dropped; so are lengths that ``parts`` does
    not divide, and components so large that squared distances pass 64 bits (with 64 components: 46,340 in size and up).
    Vectors of different lengths have codebooks of their own. Fewer rows than ``entries``: as many entries as rows.
    Equally near entries: the least number; equal ids among the smallest: the vectors' bytes decide. Repeated rows each
    count. Null labels are one label, null ids come last. Extra columns are ignored; an empty table gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    prepare(vectors.sparkSession)
    base = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    of = {c: base.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    head = f"vec_id {of['vec_id']}, label {of['label']}, dims int"
    rows = materialize(base.mapInArrow(_whole_numbers(scale, parts), f"{head}, x binary"), "whole_numbers")
    model = fit_codebooks(rows, parts=parts, entries=entries, rounds=rounds)
    coded = materialize(rows.mapInArrow(released(_coder(model.books, parts)), f"{head}, code string, error bigint"), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    digest = F.create_map(*[F.lit(v) for d in model.books for v in (d, model.digest(d))]) if model.books else F.create_map(F.lit(0), F.lit(""))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", digest[F.col("dims")].alias("codebooks_sha256"))
