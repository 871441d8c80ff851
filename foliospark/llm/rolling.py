"""Features of the rows that came before: a two-pointer sweep over each source's rows in the order of time.

A source's rows are dealt out by slices of time, so that a source with a third of all rows is the work of many tasks. A
slice's own rows need those of the longest window before it; these come along as guests, which are counted and put out
nowhere. With slices of a quarter of that window a row goes to five slices, without its id and text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from foliospark.llm.common import released
from foliospark.session import prepare

_FEATURES = ("n_events", "sum_chars", "n_langs", "median_chars", "high_chars")


class Window:
    """The rows of the last ``seconds``: what enters at the late end leaves at the early one."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds
        self.rows: deque[tuple[int, int | None, str | None]] = deque()
        self.sizes: list[int] = []  # ascending, repeats kept
        self.langs: dict[str, int] = {}
        self.total = 0

    def enter(self, row: tuple[int, int | None, str | None]) -> None:
        _, size, lang = row
        self.rows.append(row)
        if size is not None:
            insort(self.sizes, size)
            self.total += size
        if lang is not None:
            self.langs[lang] = self.langs.get(lang, 0) + 1

    def leave(self, before: int) -> None:
        """Takes out the rows of times before ``before``."""
        while self.rows and self.rows[0][0] < before:
            _, size, lang = self.rows.popleft()
            if size is not None:
                del self.sizes[bisect_left(self.sizes, size)]
                self.total -= size
            if lang is not None:
                self.langs[lang] -= 1
                if not self.langs[lang]:
                    del self.langs[lang]

    def features(self) -> tuple[int, int, int, int | None, int | None]:
        m = len(self.sizes)
        median, high = (self.sizes[-(-m // 2) - 1], self.sizes[-(-99 * m // 100) - 1]) if m else (None, None)
        return len(self.rows), self.total, len(self.langs), median, high


def _sweep(seconds: Sequence[int], slice_s: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by source, slice and time; a window's contents are all that is held of them."""
    kinds = {"doc_id": id_type, "window_s": pa.int64(), "event_s": pa.int64(), **dict.fromkeys(_FEATURES, pa.int64())}

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, found = None, None, None
        windows: list[Window] = []
        waiting: list[tuple[int, int | None, str | None]] = []  # rows of this very time, which are in no window yet
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("source", "slice", "event_s", "own", "doc_id", "size", "lang")]
            for source, part, at, own, doc, size, lang in zip(*columns, strict=True):
                if key != (source, part):
                    key, now = (source, part), None
                    windows, waiting = [Window(s) for s in seconds], []
                if at != now:
                    for w in windows:
                        for row in waiting:
                            if row[0] >= part * slice_s - w.seconds:  # guests that are too early for the slice's first time never enter
                                w.enter(row)
                        w.leave(at - w.seconds)
                    now, found, waiting = at, None, []
                if own:
                    found = found or [w.features() for w in windows]
                    out += [(doc, w.seconds, at, *f) for w, f in zip(windows, found, strict=True)]
                waiting.append((at, size, lang))
            if out:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    return sweep


def rolling_features(rows: DataFrame, time: Column, *, windows: Sequence[int] = (1800, 86400), slice_s: int | None = None, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", category_col: str = "lang") -> DataFrame:
    """For each row and each of ``windows`` (seconds), features of the rows of its group within as many seconds before it.

    ``time`` is a whole number of seconds; a window holds the group's rows with time - seconds <= theirs < time, so never
    the row itself nor others of its time. Returns per row and window: doc_id, window_s, event_s, n_events (rows),
    sum_chars (code points of their texts), n_langs (distinct categories), median_chars and high_chars (of the m lengths,
    ascending with repeats, number ceil(m / 2) and ceil(99 m / 100)).

    Null text: has no length, the row counts otherwise; empty text: length 0. A window without lengths: sum 0, both ranks
    null. Null category: not counted. Null group: a group of its own. Null time: in no window, and its own are empty.
    Repeated rows each count and each get rows; ties in time do not see each other. Ids may be null. Extra columns are
    ignored; an empty table gives an empty result. A text of any length is one number.

    A task holds the rows of one group's longest window, whatever the group has in all; ``slice_s`` (a quarter of the
    longest window unless given) deals a group over tasks.
    """
    prepare(rows.sparkSession)
    longest = max(windows)
    step = slice_s or max(1, longest // 4)
    base = rows.select(
        F.col(f"`{id_col}`").alias("doc_id"), time.cast("bigint").alias("event_s"), F.col(f"`{group_col}`").cast("string").alias("source"),
        F.length(F.col(f"`{text_col}`").cast("string")).cast("bigint").alias("size"), F.col(f"`{category_col}`").cast("string").alias("lang"),
    )
    kind: DataType = base.schema["doc_id"].dataType


    def slice_of(at: Column) -> Column:  # in whole numbers, also before time 0
        return (at - F.pmod(at, F.lit(step))) / step

    home, last = (slice_of(F.col("event_s") + s).cast("bigint") for s in (0, longest))
    dealt = base.where("event_s is not null").withColumn("home", home).withColumn("slice", F.explode(F.sequence("home", last)))
    own = F.col("slice") == F.col("home")
    dealt = dealt.select("source", "slice", "event_s", own.alias("own"), F.when(own, F.col("doc_id")).alias("doc_id"), "size", "lang")
    schema = f"doc_id {kind.simpleString()}, window_s bigint, event_s bigint, " + ", ".join(f"{c} bigint" for c in _FEATURES)
    swept = dealt.repartition("source", "slice").sortWithinPartitions("source", "slice", "event_s").mapInArrow(released(_sweep(tuple(windows), step, to_arrow_type(kind))), schema)
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    timeless = base.where("event_s is null").select("doc_id", F.explode(F.array(*[F.lit(w).cast("bigint") for w in windows])).alias("window_s"), "event_s", *[(none if c.endswith("_chars") and c != "sum_chars" else zero).alias(c) for c in _FEATURES])
    return swept.unionByName(timeless)
