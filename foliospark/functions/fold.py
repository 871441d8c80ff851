"""Folds over arrays inside an expression: running state, runs, and binary search, without Python in the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """The outputs of a fold, one an item: ``out(state before, item)``, of SQL type ``kind``; ``step`` gives the state after it.

    The state is what ``start`` is, and has its type. Outputs are gathered in chunks, so their copying is not quadratic.
    """
    none = F.array().cast(f"array<{kind}>")
    chunks = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _CHUNK).cast("int")), lambda k: F.slice(items, k * _CHUNK + 1, F.lit(_CHUNK))))
    one = lambda s, x: F.struct(step(s["s"], x).alias("s"), F.concat(s["out"], F.array(out(s["s"], x).cast(kind))).alias("out"))

    def chunk(held: Column, part: Column) -> Column:
        before = held["last"]
        return F.struct(F.aggregate(part, F.struct(before["s"].alias("s"), none.alias("out")), one).alias("last"), F.concat(held["done"], F.array(before["out"])).alias("done"))

    begin = F.struct(F.struct(start.alias("s"), none.alias("out")).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    return F.coalesce(F.aggregate(chunks, begin, chunk, lambda held: F.flatten(F.concat(held["done"], F.array(held["last"]["out"])))), none)


def runs(items: Column, starts: Column) -> Column:
    """Items cut before each place where ``starts``, an array of booleans as long, is true; what is before the first one is left out."""
    places = F.filter(F.transform(starts, lambda is_start, i: F.when(is_start, i)), lambda i: i.isNotNull())
    return let(places, lambda at: F.transform(at, lambda i, k: F.slice(items, i + 1, F.coalesce(F.get(at, k + 1), F.size(items)) - i)))


def lower_bound(ascending: Column, value: Column) -> Column:
    """How many items of a sorted array are less than a value, by binary search."""
    n = F.size(ascending)
    halve = lambda s, _: let(F.floor((s["lo"] + s["hi"]) / 2).cast("int"), lambda m: F.when(s["lo"] >= s["hi"], s).when(F.get(ascending, m) < value, F.struct((m + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1.0)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda s: s["lo"])
