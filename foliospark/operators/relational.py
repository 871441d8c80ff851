"""Page-level operators in relational form: aggregates, windows and joins over lines, cells and names."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliospark.functions import text as T


def ordered_concat(c: Column, separator: str, *order: Column) -> Column:
    """Texts of a group joined in the order given, nulls and empty ones left out."""
    kept = F.sort_array(F.collect_list(F.when(F.coalesce(c, F.lit("")) != "", F.struct(*order, c.alias("_text")))))
    return F.array_join(kept["_text"], separator)


def concatenated(pages: DataFrame, document: str, number: str, markdown: str) -> DataFrame:
    """(document, page_count, markdown): pages under numbered comments, rules between them. Numbers begin at 1 in page order."""
    n = F.row_number().over(Window.partitionBy(document).orderBy(number))
    page = F.concat(F.lit("<!-- page: "), n.cast("string"), F.lit(" -->\n\n"), T.normalize_markdown(F.col(markdown)))
    found = pages.select(document, n.alias("_n"), page.alias("_page")).groupBy(document).agg(F.count("_n").alias("page_count"), ordered_concat(F.col("_page"), "\n\n---\n\n", F.col("_n")).alias("markdown"))
    return found.withColumn("markdown", F.concat("markdown", F.lit("\n")))


def smallest_mode(c: Column) -> Column:
    """The most frequent value, of equally frequent ones the smallest; 0 of none."""
    return F.coalesce(F.mode(c, True), F.lit(0))


def paragraph_folds(rows: DataFrame, page: list[str], index: str, text: str) -> DataFrame:
    """(page, paragraph, text): rows of a page folded into paragraphs. A paragraph is an island between starting rows."""
    starts = F.col(text).rlike(rf"^(?:\d{{1,3}}\)|\d+(?:\.\d+)+(?:{T.S}|$)|\d+\.(?!\d))")
    numbered = rows.withColumn("paragraph", F.sum(starts.cast("int")).over(Window.partitionBy(*page).orderBy(index)))
    return numbered.groupBy(*page, "paragraph").agg(ordered_concat(F.col(text), " ", F.col(index)).alias("text"))


def numbered_islands(lines: DataFrame, page: list[str], order: list[str], text: str) -> DataFrame:
    """(page, number, text): lines after a marker up to the next one; only pages with three markers. The gap and side rules are the page fold's."""
    w = Window.partitionBy(*page).orderBy(*order)
    number = T.numbered_marker(F.col(text))
    marked = lines.withColumn("_number", number).withColumn("_island", F.count("_number").over(w)).withColumn("_starts", F.count("_number").over(Window.partitionBy(*page)))
    kept = marked.where((F.col("_starts") >= 3) & (F.col("_island") > 0))
    return kept.groupBy(*page, "_island").agg(F.max("_number").alias("number"), ordered_concat(F.col(text), " ", *(F.col(c) for c in order)).alias("text")).drop("_island")


def missing_numbers(found: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return found.join(present, keys, "left_anti")


def next_present(missing: DataFrame, present: DataFrame, page: list[str], number: str) -> DataFrame:
    """Of each missing number the smallest present one above it, null without one: an as-of lookup forwards.

    Both sides go through one window over the page, so a page with many numbers costs their sum, not their product.
    """
    both = missing.select(*page, F.col(number).alias("n"), F.lit(1).alias("_kind")).unionByName(present.select(*page, F.col(number).alias("n"), F.lit(0).alias("_kind")).distinct())
    ahead = F.min(F.when(F.col("_kind") == 0, F.col("n"))).over(Window.partitionBy(*page).orderBy("n").rangeBetween(1, Window.unboundedFollowing))
    return both.withColumn("next_number", ahead).where("_kind = 1").select(*page, F.col("n").alias(number), "next_number")


def anchor_segments(anchors: DataFrame, group: list[str], at: str, to: str) -> DataFrame:
    """(group, lo, hi, x0, x1, to0, to1): anchors in rising order as segments; the first and last reach to infinity."""
    w = Window.partitionBy(*group).orderBy(at, to)
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    seg = anchors.select(*group, F.col(at).alias("x0"), F.col(to).alias("to0"), F.coalesce(F.lead(at).over(w), F.col(at)).alias("x1"), F.coalesce(F.lead(to).over(w), F.col(to)).alias("to1"), F.row_number().over(w).alias("_k"), n.alias("_n"))
    seg = seg.where((F.col("_k") < F.col("_n")) | (F.col("_n") == 1))
    infinity = float("inf")
    return seg.withColumn("lo", F.when(F.col("_k") == 1, -infinity).otherwise(F.col("x0").cast("double"))).withColumn("hi", F.when(F.col("_k") >= F.col("_n") - 1, infinity).otherwise(F.col("x1").cast("double"))).drop("_k", "_n")


_NUMBERED = r"(?:-\d+)+$"


def _reserved(files: DataFrame, group: list[str], base: Column, ext: Column, index: str, out: str) -> DataFrame:
    """Adds ``out``: base and extension, or base-2, base-3, ... where that is taken, in any case and in the order of ``index``.

    A numbered name can only meet names that are alike but for such numbers. Where all of these are equal, as most are, the
    n-th one gets n, by a window. Others, whose numbered names may meet what files come with, are gone through in order,
    as a stream of sorted rows: a task holds the different names that are taken, and of each the number that is next.
    """
    alike = F.struct(F.lower(F.regexp_replace(base, _NUMBERED, "")).alias("stem"), F.lower(ext).alias("ext"))
    keys = [*(f"g{i}" for i in range(len(group))), "alike"]
    keyed = files.select(F.struct(*(F.col(f"`{c}`") for c in files.columns)).alias("row"), *(F.col(c).alias(f"g{i}") for i, c in enumerate(group)), alike.alias("alike"), F.col(index).alias("at"), base.alias("base"), ext.alias("ext"))
    kinds = keyed.groupBy(*keys).agg((F.min(F.lower("base")) == F.max(F.lower("base"))).alias("_one")).select(*(F.col(k).alias(f"_{k}") for k in keys), "_one")
    together = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    keyed = keyed.join(kinds, together).drop(*(f"_{k}" for k in keys))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    plain = keyed.where("_one").withColumn("_n", n).select("row", F.concat("base", F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""), "ext").alias("free"))
    rows = keyed.where("not _one").select(F.xxhash64(*keys).alias("_key"), *keys, "at", "base", "ext", "row")
    schema = StructType([rows.schema["row"], StructField("free", StringType())])
    met = rows.repartition("_key").sortWithinPartitions("_key", *keys, "at").mapInArrow(_reserving(keys), schema)
    return plain.unionByName(met).select("row.*", F.col("free").alias(out))


def _reserving(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used, following = None, set(), {}
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in keys]
            for *key, base, ext in zip(*columns, batch.column("base").to_pylist(), batch.column("ext").to_pylist(), strict=True):
                if key != group:
                    group, used, following = key, set(), {}
                free = base + ext
                if free.lower() in used:
                    k = following.get(free.lower(), 2)  # all numbers below it are taken
                    while f"{base}-{k}{ext}".lower() in used:
                        k += 1
                    following[free.lower()] = k + 1
                    free = f"{base}-{k}{ext}"
                used.add(free.lower())
                out.append(free)
            yield pa.record_batch({"row": batch.column("row"), "free": pa.array(out, pa.string())})

    return run


def unique_names(files: DataFrame, group: list[str], name: str, index: str) -> DataFrame:
    """Adds unique_name: names that are taken, in any case, get -2, -3, ... before their extension until they are free. ``index`` is unique in a group."""
    ext = F.regexp_extract(F.col(name), r".(\.[^.]*)$", 1)
    base = F.expr(f"left(`{name}`, length(`{name}`) - length(regexp_extract(`{name}`, '.([.][^.]*)$', 1)))")
    return _reserved(files, group, base, ext, index, "unique_name")


def folder_names(files: DataFrame, name: str, index: str) -> DataFrame:
    """Adds folder: a file's stem, with its extension where stems repeat in any case, numbered where those are taken. ``index`` is unique."""
    s, e = T.stem(F.col(name)), F.regexp_replace(T.extension(F.col(name)), r"^\.", "")
    again = F.count(F.lit(1)).over(Window.partitionBy(F.lower(s))) > 1
    base = files.withColumn("_base", F.when(again, F.concat(s, F.lit("-"), e)).otherwise(s))
    return _reserved(base, [], F.col("_base"), F.lit(""), index, "folder").drop("_base")


def from_top(boxes: DataFrame, page: list[str], box: str, *ties: str) -> DataFrame:
    """Adds position: boxes of a page from top to bottom, those of equal tops from left to right."""
    b = F.col(box)
    return boxes.withColumn("position", F.row_number().over(Window.partitionBy(*page).orderBy(b[1], b[0], *ties)))


def words(c: Column) -> Column:
    """Distinct Latin words of two letters or more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}"), F.lit(0)))


def shared_words(left: DataFrame, key: str, text: str, right: DataFrame, other: str) -> DataFrame:
    """(key, word): the words of each left text that any right text has too."""
    theirs = right.select(F.explode(words(F.col(other))).alias("word")).distinct()
    return left.select(key, F.explode(words(F.col(text))).alias("word")).join(theirs, "word", "left_semi")


def with_presence(references: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Adds present: whether a reference's file is there."""
    there = files.select(*keys).distinct().withColumn("present", F.lit(True))
    return references.join(there, keys, "left").withColumn("present", F.col("present").isNotNull())
