"""A folder of images as one job, from the listing to the summary, in any store that Spark reads and Python opens."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliospark.errors import FolioError
from foliospark.functions import text as T
from foliospark.operators import batch as B
from foliospark.operators import relational as R
from foliospark.operators.codecs import decode_image
from foliospark.pipeline import Codec, Settings, convert, json_text, now, write_outputs
from foliospark.recognize import Recognizer
from foliospark.session import materialize, prepare, scope
from foliospark.sinks import write_files
from foliospark.sources.loader import files, kind_of
from foliospark.sources.pdf import PdfRenderer

SUMMARIES = ("batch-summary.md", "batch-summary.json")


def _folded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        yield pa.array([None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)) for x in column.to_pylist()], pa.string())


def natural_order(name: Column) -> Column:
    """A key by which names sort with runs of digits as numbers, without case and accents: an array of (kind, length, text)."""
    flat = F.lower(T.guarded(F.arrow_udf(_folded, "string"), name, T.is_ascii(name)))
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    part = lambda p: F.when(p.rlike("^[0-9]"), F.struct(F.lit(0).alias("kind"), F.length(digits(p)).alias("n"), digits(p).alias("text"))).otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("n"), p.alias("text")))
    return F.transform(F.regexp_extract_all(flat, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), part)


def _summary_text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        out = []
        for whole in column.to_pylist():
            whole["results"] = [{k: v for k, v in r.items() if k != "error" or v is not None} for r in whole["results"]]
            out.append(json_text(whole))
        yield pa.array(out, pa.string())


def named_images(found: DataFrame) -> DataFrame:
    """(path, name, at, folder) of the images among (path, ...): in natural order of ``at``, each with an output folder of its own."""
    name = T.base_name(F.col("path"))
    return R.folder_names(found.where(kind_of(F.col("path")) == "image").select("path", name.alias("name"), F.struct(natural_order(name).alias("key"), name.alias("name"), "path").alias("at")), "name", "at")


def convert_folder(spark: SparkSession, folder: str, output: str, recognizer: Recognizer, settings: Settings = Settings(), *, pdf: PdfRenderer | None = None, codec: Codec = decode_image, shown: tuple[str, str] | None = None) -> dict[str, int]:
    """Every image right inside ``folder`` to a folder of its own under ``output``, and the batch's summaries.

    A file that fails is a result with its error. Returns the totals, which are observed while the results are written: no
    job is run to count. ``shown``: how the summaries name the two folders. Nothing of the files passes through the driver.
    """
    prepare(spark)
    started, (source, target) = now(), shown or (folder, output)
    with scope(spark):
        found = files(spark, folder)
        named = materialize(named_images(found), "named")
        if named.isEmpty():
            raise FolioError("INPUT_NO_IMAGES", f"no images in {folder}")
        tables = convert(spark, found.join(named.select("path"), "path", "left_semi"), recognizer, settings, pdf=pdf, codec=codec)
        written = write_outputs(tables, named.select(F.col("path").alias("doc_id"), "folder"), output)
        state = F.when(F.col("error").isNull(), "succeeded").otherwise("failed")
        rows = written.join(named.select(F.col("path").alias("doc_id"), "name", "at"), "doc_id")
        counted = Observation("results")
        rows = rows.select(F.lit(source).alias("input_directory"), "at", F.col("name").alias("input"), state.alias("status"), F.col("folder").alias("outputDirectory"), "markdown", "manifest", "error")
        rows = materialize(rows.observe(counted, F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed")), "results")
        totals = dict(counted.get)
        row = F.struct("input", "status", "outputDirectory", "markdown", "manifest", "error")
        numbered = rows.groupBy("input_directory").agg(F.array_sort(F.collect_list(F.struct("at", row.alias("row")))).alias("r"))
        results = numbered.select("input_directory", F.posexplode("r").alias("k", "r")).select("input_directory", (F.col("k") + 1).alias("file_number"), "r.row.*")
        text = B.summaries(results, ["input_directory"]).select("input_directory", F.col("summary").alias("text"))
        whole = F.struct(F.lit(1).alias("schemaVersion"), F.lit(source).alias("inputDirectory"), F.lit(target).alias("outputDirectory"), F.lit(started).alias("startedAt"), F.lit(now()).alias("completedAt"), F.struct(*[F.lit(v).alias(k) for k, v in totals.items()]).alias("totals"), F.transform("r", lambda x: x["row"]).alias("results"))
        both = text.join(numbered.select("input_directory", F.arrow_udf(_summary_text, "string")(whole).alias("json")), "input_directory")
        made = both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("path"), F.col(c).cast("binary").alias("content")) for n, c in zip(SUMMARIES, ("text", "json"), strict=True)])).alias("f"))
        write_files(made.select("f.path", "f.content", F.lit(None).cast("string").alias("source_path")), output)
    return totals
