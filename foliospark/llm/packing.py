"""Packing of token sequences by the online sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import released
from foliospark.llm.tokens import ByteBpe
from foliospark.session import prepare


class Packer:
    """Fills windows of ``size`` tokens online.

    A document's whole windows stand alone; its rest goes into an open window, or a new one, so that afterwards the sum
    of squares of the numbers of open windows at each fill level is least (of equal choices the fullest window).
    ``levels`` has those numbers. A window is put out once it is full.
    """

    def __init__(self, size: int, first_id: int = 0) -> None:
        self.size, self.next = size, first_id
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(size + 1)]

    def _window(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        """Pieces (doc, start, ids, tokens of the doc, window, offset) of windows that are full."""
        total, size = len(ids), self.size
        whole = total - total % size
        for s in range(0, whole, size):
            yield doc, s, ids[s : s + size], total, self._window(), 0
        n = total - whole
        if not n:
            return
        piece = (doc, whole, ids[whole:], total)
        level = self.choose(n)
        if level:
            self.levels[level] -= 1
            window, pieces = self.open[level].pop()
        else:
            window, pieces = self._window(), []
        pieces.append((*piece, window, level))
        if level + n == size:
            yield from pieces
        else:
            self.levels[level + n] += 1
            self.open[level + n].append((window, pieces))

    def choose(self, n: int) -> int:
        """The level of the window to put n tokens into; 0: a new window."""
        top = self.size - n
        cost = np.full(top + 1, np.iinfo(np.int64).max)
        after = 2 * self.levels[n : self.size + 1] + 1  # at level + n, for levels 0 to top
        after[-1] = 0  # a full window is not open
        has = self.levels[: top + 1] > 0
        cost[has] = after[has] - (2 * self.levels[: top + 1][has] - 1)
        cost[0] = after[0]
        return top - int(np.argmin(cost[::-1]))

    def close(self) -> Iterator[tuple]:
        """The windows still open: the emptiest are cut up to fill the fullest, which keep what the rule put there.

        What is left over at last is cut into windows of a power of two, one for each in its size.
        """
        left = [[level, window, pieces] for level, at in enumerate(self.open) for window, pieces in at]  # by rising level
        low = 0
        while low < len(left) - 1:
            level, window, pieces = left.pop()
            while level < self.size and low < len(left):
                giver = left[low]
                doc, start, ids, tokens, _, _ = giver[2].pop()
                n = min(self.size - level, len(ids))
                pieces.append((doc, start + len(ids) - n, ids[len(ids) - n :], tokens, window, level))
                if n < len(ids):
                    giver[2].append((doc, start, ids[: len(ids) - n], tokens, None, None))
                level, giver[0] = level + n, giver[0] - n
                low += not giver[0]
            if level < self.size:
                left.append([level, window, pieces])
                break
            yield from pieces
        for level, _, pieces in left[low:]:
            sizes = [1 << b for b in range(level.bit_length()) if level >> b & 1]
            room = window = offset = 0
            for doc, start, ids, tokens, _, _ in pieces:
                at = 0
                while at < len(ids):
                    if not room:
                        room, window, offset = sizes.pop(), self._window(), 0
                    n = min(room, len(ids) - at)
                    yield doc, start + at, ids[at : at + n], tokens, window, offset
                    at, room, offset = at + n, room - n, offset + n
        self.open = [[] for _ in range(self.size + 1)]
        self.levels[:] = 0


_PIECES = "doc_id {id}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packing(tokenizer: tuple, size: int, end_id: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, tokens, window, offset = zip(*pieces, strict=True) if pieces else [()] * 6
        return pa.record_batch({
            "doc_id": pa.array(doc, id_type), "start": pa.array(start, pa.int64()), "length": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
            "doc_tokens": pa.array(tokens, pa.int64()), "sequence_id": pa.array(window, pa.int64()), "offset": pa.array(offset, pa.int64()),
        })

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, out = None, Packer(size, TaskContext.get().partitionId() << 40), []
        for batch in batches:
            encoder = encoder or ByteBpe(*tokenizer)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encoder.encode(text)
                    ids.append(end_id)
                    out += packer.add(doc, np.array(ids, "<u4"))
                yield batch_of(out)
                out = []
        yield batch_of(list(packer.close()))

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, *, ranks: str | None = None, pattern: str | None = None, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``size`` tokens.

    Each partition packs its own documents in one pass and nothing is shuffled; sequence ids hold the partition's
    number, so a task that runs again gives the same ids. Of windows still open at its end the emptiest are cut up to fill
    the others, and the last one gives windows of powers of two, so that nothing is padded.

    Returns a row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens (with ``end_id``,
    which ends every document), sequence_id, offset. Null text counts as empty and gives the end id alone. Repeated
    rows are packed each; doc_id may be null. Extra columns are ignored; an empty table gives no pieces.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = base.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return base.mapInArrow(released(_packing((tokenizer, ranks, pattern), size, end_id, to_arrow_type(kind))), _PIECES.format(id=kind.simpleString()))
