"""Arrow arrays of nested values as Python lists, a level at a time: pyarrow makes them value by value, at several times the cost."""

from __future__ import annotations

from itertools import pairwise
from typing import Any

import pyarrow as pa


def values(array: pa.Array) -> list[Any]:
    """What ``array.to_pylist()`` gives."""
    kind = array.type
    if not len(array):
        return []
    if pa.types.is_list(kind):
        ends = array.offsets.tolist()
        inner = values(array.values.slice(ends[0], ends[-1] - ends[0]))
        out = [inner[a - ends[0] : b - ends[0]] for a, b in pairwise(ends)]
    elif pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        rows = zip(*(values(array.field(i)) for i in range(kind.num_fields)), strict=True)
        out = [dict(zip(names, row, strict=True)) for row in rows]
    elif pa.types.is_string(kind) or (pa.types.is_float64(kind) and not array.null_count):
        return array.to_numpy(zero_copy_only=False).tolist()
    else:
        return array.to_pylist()
    if array.null_count:
        out = [x if there else None for x, there in zip(out, array.is_valid().to_numpy(zero_copy_only=False), strict=True)]
    return out
