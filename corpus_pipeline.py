"""A corpus pipeline over ``documents``: toxicity, MinHash near-dedup, suffix-array dedup, packing.

Stages may be chained and called again at any time: what a stage has written when it returns are its decisions, which stay
until the program or the caller's scope ends. The rows come from the documents that it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.minhash import drop_near_duplicates
from foliospark.llm.queries import packed
from foliospark.llm.suffix import cut_repeats
from foliospark.llm.toxicity import score_toxicity
from foliospark.session import materialize, prepare, settled


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op6 marks as toxic (0.3 or more) go; the labels come from the table beside the documents."""
    row = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    scored = score_toxicity(row, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3, carry=("row",))
    return scored.where("predicted = 0").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return drop_near_duplicates(docs, width=5, percent=80, coordinates=48, matches=24)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte covered by a 200-byte string that occurs twice goes; documents stay, if only with an empty text."""
    cut = cut_repeats(docs, min_len=200)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces in sequences of 1024 tokens."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("repeat_dedup", repeat_dedup), ("packing", packing)]

#: Neither a classifier nor a tokenizer is within SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


@settled
def _all(docs: DataFrame, sf_dir: str) -> DataFrame:
    spark = docs.sparkSession
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on the written result of the one before."""
    return _all(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
