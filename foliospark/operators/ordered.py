"""Joins along an order: the last fact before a row, and matches that keep the order of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.fold import let, lower_bound, scan
from foliospark.session import materialize

_PARTS = 256


def last_known(rows: DataFrame, facts: DataFrame, group: list[str], at: str, known_at: str, *, strict: bool = True, split: int = 1_000_000) -> DataFrame:
    """Adds ``known``: of the facts of a row's group the last one before it (or also at its place, if not ``strict``), as a struct; null without one.

    Rows and facts are one sorted union, along which the last fact is carried, so a group costs a sort and never the
    product of its two sides. A group with more than ``split`` rows and facts is dealt over up to 256 ranges of the order, at
    its quantiles; each range begins with what the ranges before it end with. Of facts at one place the greatest is the
    last. Rows with a null group or place know nothing, such facts are not known. Repeated rows are kept. Names that begin
    with two underscores are the join's own.
    """
    key = [f"__{c}" for c in group]
    keys = [F.col(f"`{c}`").alias(k) for c, k in zip(group, key, strict=True)]
    whole = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    left = rows.select(*keys, F.col(f"`{at}`").alias("__at"), F.lit(0 if strict else 1).alias("__kind"), whole(rows).alias("__row"))
    right = facts.select(*keys, F.col(f"`{known_at}`").alias("__at"), F.lit(1 if strict else 0).alias("__kind"), whole(facts).alias("__fact"))
    there = F.forall(F.array(*[F.col(c).isNotNull() for c in (*key, "__at")]), lambda v: v)
    both = left.where(there).unionByName(right.where(there), allowMissingColumns=True)
    hot = both.groupBy(*key).count().where(F.col("count") > split).select(*key)
    quantiles = [k / _PARTS for k in range(1, _PARTS)]
    cuts = both.select(*key, "__at").join(hot, key, "left_semi").groupBy(*key).agg(F.array_distinct(F.percentile_approx("__at", quantiles, 10_000)).alias("__cuts"))
    cuts = materialize(cuts, "cuts")  # quantiles are not the same each time
    dealt = both.join(cuts, key, "left")
    dealt = dealt.withColumn("__part", F.when(F.col("__cuts").isNull(), F.lit(-1)).otherwise(lower_bound(F.col("__cuts"), F.col("__at")))).drop("__cuts")
    # what is known at the beginning of each range of a group that has any
    ends = dealt.where("__part >= 0").groupBy(*key, "__part").agg(F.max(F.when(F.col("__fact").isNotNull(), F.struct("__at", "__fact"))).alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    brought = ends.withColumn("__end", before).where("__end is not null").select(*key, "__part", F.col("__end.__at").alias("__at"), F.lit(-1).alias("__kind"), F.col("__end.__fact").alias("__fact"))
    order = Window.partitionBy(*key, "__part").orderBy(F.col("__kind") >= 0, "__at", "__kind", "__fact").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = dealt.unionByName(brought, allowMissingColumns=True).withColumn("__known", F.last("__fact", ignorenulls=True).over(order)).where("__row is not null")
    lost = left.where(~there).select("__row", F.lit(None).cast(right.schema["__fact"].dataType).alias("__known"))
    return carried.select("__row", "__known").unionByName(lost).select("__row.*", F.col("__known").alias("known"))


def in_order(blocks: Column, lines: Column) -> Column:
    """Matches of two sequences of keys: each block takes the first line with its key after the line of the last match.

    ``blocks`` and ``lines`` are arrays of keys; blocks without such a line are passed over, null keys match nothing.
    Returns an array with a place in ``lines`` (from 0) or null for each block. A line's next occurrence of a key is found
    by binary search in the sorted (key, place) pairs, so a page costs a sort and a search per block.
    """
    pairs = F.array_sort(F.filter(F.transform(lines, lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda p: p["k"].isNotNull()))

    def matched(table: Column) -> Column:
        def found(at: Column, key: Column) -> Column:
            here = F.get(table, lower_bound(table, F.struct(key.alias("k"), at.alias("i"))))
            return F.when(here["k"] == key, here["i"])

        # the match is the state, so it is searched for once: (first place that is free, match of the item before)
        step = lambda s, key: let(found(s["at"], key), lambda hit: F.struct(F.coalesce(hit + 1, s["at"]).alias("at"), hit.alias("hit")))
        start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("hit"))
        after = scan(F.concat(blocks, F.array(F.element_at(blocks, -1))), start, step, lambda s, _: s["hit"], "int")  # one item more, whose output is the last block's match
        return F.slice(after, 2, F.size(blocks))

    return F.when(F.size(blocks) == 0, F.array().cast("array<int>")).otherwise(let(pairs, matched))


def matches_in_order(blocks: DataFrame, lines: DataFrame, page: list[str], key: str, block_order: list[str], line_order: list[str]) -> DataFrame:
    """(page, block, line): :func:`in_order` of the rows of each page, both numbered from 0 in their order, matches alone."""
    keys = lambda df, order, name: df.groupBy(*page).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(key).alias("__k")))), lambda r: r["__k"]).alias(name))
    both = keys(blocks, block_order, "__blocks").join(keys(lines, line_order, "__lines"), page)
    hits = both.select(*page, F.posexplode(in_order(F.col("__blocks"), F.col("__lines"))).alias("block", "line"))
    return hits.where("line is not null")
