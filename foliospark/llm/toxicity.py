"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import packed_rows, released, slices, text_buffer, unpacked_rows
from foliospark.session import materialize, prepare, scope

ORDERS = range(4, 9)  # characters in an n-gram, letters lowered, white space alike
BITS = 22  # n-grams are hashed into 2**BITS features
_BUCKETS = 32  # tasks that sum counts; there are no more than 2**BITS counts, however large the corpus
_rng = np.random.default_rng(11)
_STEP = [np.uint32(int(x) | 1) for x in _rng.integers(2**20, 2**32, max(ORDERS))]
_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(0x600)], np.uint32)  # Latin, Greek, Cyrillic
_LOWER[[*range(9, 14), 0x85, 0xA0]] = 32


def _code(chars: np.ndarray) -> np.ndarray:
    h = chars.astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    return h * np.uint32(0x85EBCA77) | np.uint32(1)


_PLAIN = _code(_LOWER[:128])


def characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A random word for each character of UTF-8 texts, the same for upper and lower case; and the texts' offsets in them."""
    if not len(raw) or raw.max() < 128:
        return _PLAIN[raw], offsets
    before = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    low = chars < len(_LOWER)
    chars[low] = _LOWER[chars[low]]
    return _code(chars), before[offsets]


def grams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, row) of every n-gram of each order."""
    v, offsets = characters(raw, offsets)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    sums = np.zeros(len(v), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(v) - n + 1
        if m <= 0:
            return
        sums = sums[:m] + v[n - 1 :] * _STEP[n - 1]
        if n in ORDERS:
            h = sums ^ (sums >> np.uint32(15))
            h *= np.uint32((0x2C1B3C6D + 0x9E3779B8 * n) % 2**32)
            inside = row[:m] == row[n - 1 :]
            yield (h >> np.uint32(32 - BITS))[inside], row[:m][inside]


_PIECE = 4 << 20


def present(raw: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, of the chosen features only if given, sorted. A long text alone is looked at in overlapping pieces."""
    pieces = [(raw, offsets)]
    if len(offsets) == 2 and len(raw) > _PIECE:
        starts = np.arange(0, len(raw), _PIECE)
        pieces = []
        for i in starts.tolist():
            j = min(len(raw), i + _PIECE + 4 * max(ORDERS))
            while i and raw[i] & 0xC0 == 0x80:  # from the beginning of a character, which the piece before has too
                i -= 1
            while j < len(raw) and raw[j] & 0xC0 == 0x80:
                j -= 1
            pieces.append((raw[i:j], np.array([0, j - i])))
    keys = np.zeros(0, np.int64)
    for part, off in pieces:
        found = [keys]
        for f, r in grams(part, off):
            if chosen is not None:
                hit = np.flatnonzero(chosen[f])
                f, r = f[hit], r[hit]
            found.append((r.astype(np.int64) << BITS) | f)
        k = np.concatenate(found)
        k.sort()
        keys = k[np.append(True, k[1:] != k[:-1])] if len(k) else k
    return keys >> BITS, keys & ((1 << BITS) - 1)


_COUNTS = "bucket int, feature binary, clean binary, toxic binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by label, in this task; packed by bucket."""
    seen = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        raw, off = text_buffer(batch.column("text"))
        toxic = batch.column("toxic").to_numpy().astype(np.int64)
        for i, j in slices(off, 1 << 18):
            row, f = present(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            for y in (0, 1):
                np.add.at(seen[y], f[toxic[i:j][row] == y], 1)
    f = np.flatnonzero(seen.any(0)).astype(np.int32)
    yield from packed_rows(f % _BUCKETS, feature=f, clean=seen[0, f], toxic=seen[1, f])


def _best(toxic: int, clean: int, most: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the counts of a task's buckets, and of its features the ``most`` that tell the classes apart best (chi-squared)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = unpacked_rows(batches, feature=np.int32, clean=np.int32, toxic=np.int32)
        f, at = np.unique(a["feature"], return_inverse=True)
        c, t = (np.bincount(at, weights=a[k], minlength=len(f)) for k in ("clean", "toxic"))
        chi = (t * (clean - c) - c * (toxic - t)) ** 2 / ((c + t) * (clean + toxic - c - t) + 1)
        keep = np.flatnonzero(c + t >= least)
        keep = keep[np.lexsort((f[keep], -chi[keep]))][:most]
        yield pa.record_batch({"feature": f[keep].astype(np.int64), "c": c[keep], "t": t[keep], "chi": chi[keep]})

    return best


def _select(chosen: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each labelled document's chosen features, by their place among the chosen."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(1 << BITS, bool)
        mask[chosen] = True
        place = np.cumsum(mask) - 1
        for batch in batches:
            raw, off = text_buffer(batch.column("text"))
            for i, j in slices(off):
                row, f = present(raw[off[i] : off[j]], off[i : j + 1] - off[i], mask)
                at = np.searchsorted(row, np.arange(j - i + 1))
                p = place[f].astype(np.uint16)
                yield pa.record_batch({"toxic": batch.column("toxic").slice(i, j - i).cast(pa.int32()), "features": pa.array([p[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary())})

    return select


def fit_weights(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float, rounds: int = 150) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on features of value ratio, by accelerated gradient steps; (weights, bias)."""
    size = np.array([len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    x = ratio[col]
    n = max(1, len(rows))
    step = 4.0 / (np.bincount(row, weights=np.abs(x) * 1.0, minlength=n).max(initial=1.0) * np.abs(ratio).max(initial=1.0) / n + penalty / n + 1.0)
    bound = np.bincount(col, weights=np.abs(x) * np.bincount(row, weights=np.abs(x), minlength=n)[row], minlength=len(ratio)) / n
    pace = 1.0 / (0.25 * bound + penalty / n + 1e-6)  # a diagonal bound on the curvature
    w, b, last_w, last_b = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0
    for t in range(rounds):
        k = t / (t + 3)
        at, bias = w + k * (w - last_w), b + k * (b - last_b)
        z = np.bincount(row, weights=at[col] * x, minlength=n) + bias
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        last_w, last_b = w, b
        w = at - pace * (np.bincount(col, weights=d[row] * x, minlength=len(ratio)) / n + penalty / n * at)
        b = bias - min(step, 1.0) * d.mean()
    return w, b


def _train(ratio: np.ndarray, penalty: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in batches:
            rows += [np.frombuffer(x, np.uint16).astype(np.int64) for x in batch.column("features").to_pylist()]
            y += batch.column("toxic").to_pylist()
        if rows:
            w, b = fit_weights(rows, np.array(y, float), ratio, penalty)
            yield pa.record_batch({"weights": pa.array([(w * ratio).astype(np.float64).tobytes()], pa.binary()), "bias": [b]})

    return train


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 16_000, features: int = 4_096, least: int = 3, penalty: float = 10.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias), learnt from at most ``most_rows`` labelled rows that are not held out.

    The rows are those of least hash of their id, so the sample does not depend on order or partitions. Counts of
    documents with each n-gram are summed over it; of those in ``least`` documents or more, the ``features`` that tell the
    classes apart best (chi-squared) are scaled by their log-count ratio. All that is sent about has a fixed bound: the sample's ids, the chosen features.
    Null labels are ignored. Without rows of both classes the weights are 0.
    """
    key = F.col(f"`{id_col}`")
    with scope(docs.sparkSession):
        sample = labels.where(key.isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(key)).select(key.alias("id"), F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(most_rows)
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        rows = materialize(docs.select(key.alias("id"), text.alias("text")).join(F.broadcast(sample), "id").select("toxic", "text"), "labelled")
        total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        nt, nc = total.get(1, 0), total.get(0, 0)
        none = np.zeros(0, np.int64), np.zeros(0), float(np.log((nt + 1) / (nc + 1)))
        if not nt or not nc:
            return none
        counts = rows.mapInArrow(released(_count), _COUNTS).repartition("bucket").mapInArrow(released(_best(nt, nc, features, least)), "feature bigint, c double, t double, chi double")
        best = counts.orderBy(F.desc("chi"), "feature").limit(features).select("feature", "c", "t").orderBy("feature").collect()
        if not best:
            return none
        chosen = np.array([r["feature"] for r in best])
        ratio = np.log((np.array([r["t"] for r in best]) + 0.5) / (nt + 1)) - np.log((np.array([r["c"] for r in best]) + 0.5) / (nc + 1))
        model = rows.mapInArrow(released(_select(chosen)), "toxic int, features binary").coalesce(1).mapInArrow(released(_train(ratio, penalty)), "weights binary, bias double").first()
        return chosen, np.frombuffer(model["weights"], np.float64), float(model["bias"])


def _score(model: tuple[np.ndarray, np.ndarray, float]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    chosen, weights, bias = model

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = np.zeros(1 << BITS, np.float32)
        w[chosen] = weights
        mask = np.zeros(1 << BITS, bool)
        mask[chosen] = True
        for column in columns:
            raw, off = text_buffer(column)
            z = np.full(len(column), bias)
            for i, j in slices(off):
                row, f = present(raw[off[i] : off[j]], off[i : j + 1] - off[i], mask)
                z[i:j] += np.bincount(row, weights=w[f], minlength=j - i)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, carry: tuple[str, ...] = (), **options: float) -> DataFrame:
    """Scores whole texts. Returns a row per input row: doc_id, held_out, score, predicted, and the columns in ``carry``.

    Labels are learnt from rows that are not held out (crc32 of the id as text, modulo 4, is not 2); scores depend on
    the text alone. Null text counts as empty; an empty text's score is the bias's. Null id: not held out, scored.
    Repeated rows: a row each. Other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    scorer = F.arrow_udf(_score(fit(docs, labels, id_col=id_col, text_col=text_col, **options)), "double")
    key = F.col(f"`{id_col}`")
    out = docs.select(key.alias("doc_id"), is_held_out(key).alias("held_out"), scorer(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("score"), *(F.col(f"`{c}`") for c in carry))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"`{c}`") for c in carry))
