"""Token ids and counts with public tokenizer files, and a cache of counts by content digest."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import released
from foliospark.session import materialize, prepare, settled, work_folder

#: Characters that the libraries at hand classify alike, whatever their Unicode version.
_PLAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xff]")
_MEMO = 300_000  # words remembered by a task


class TokenCounter:
    """Token counts exactly as ``tokenizers`` gives them, without added special tokens.

    For tokenizers that lower text, drop white space and split words off by a pattern, the count of a text is the sum
    over its words; the counts of words are remembered. Texts with characters outside Latin-1 or with what may be a
    special token's string go to the library whole, as do all texts of other tokenizers.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        norm = [(x["type"], x.get("content")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        fits = norm == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and len(split) == 1 and split[0]["invert"] and split[0]["behavior"] == "Removed"
        self.words = regex.compile(split[0]["pattern"]["Regex"]).findall if fits else None
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.memo: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        whole, split = [], {}
        for i, text in enumerate(texts):
            if not self.words or _PLAIN.search(text) or any(x in text for x in self.special):
                whole.append(i)
            else:
                split[i] = self.words(text.lower())
        if len(self.memo) > _MEMO:
            self.memo.clear()
        new = list(set().union(*split.values()).difference(self.memo)) if split else []
        self.memo.update(zip(new, self._encode(new), strict=True))
        for i, words in split.items():
            out[i] = sum(map(self.memo.__getitem__, words))
        for i, n in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = n
        return out


class ByteBpe:
    """Ids of a byte-level BPE as ``tokenizers`` gives them (special strings inside texts are special).

    With the same vocabulary as ranks, texts of plain characters go through ``tiktoken``, which is several times as
    fast; all others go through ``tokenizers``.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.fast = None
        if ranks_path and pattern:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            special = {x.content: i for i, x in self.library.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        if self.fast and not _PLAIN.search(text):
            return self.fast.encode(text, allowed_special="all")
        return self.library.encode(text, add_special_tokens=False).ids


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the library's version."""
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


def _counting(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or TokenCounter(path)
            n = []
            for i in range(0, batch.num_rows, 512):
                n += counter.count(batch.column("text").slice(i, 512).to_pylist())
            yield pa.record_batch({"key": batch.column("key").cast(pa.binary()), "n_tokens": pa.array(n, pa.int64())})

    return count


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@settled
def count_tokens(docs: DataFrame, tokenizer: str, *, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Tokens of each text, through a cache of counts.

    A count is kept under the tokenizer's version digest and the digest of the normalised content (runs of ASCII white
    space as one space, which word-splitting tokenizers do not tell apart; other tokenizers use the text as it is).
    Distinct contents that the cache lacks are encoded, once each, and appended to it; then rows are joined to it.
    ``cache`` is a folder that all executors share; without one, a new one is made for this call. A key that it has
    several times, as callers at the same time may leave it, counts once.

    Returns a row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Null text counts as empty
    (0 tokens). Repeated rows, null or repeated ids: a row each. Extra columns are ignored; an empty table gives none.
    """
    spark = prepare(docs.sparkSession)
    cache = cache or work_folder(spark, "token-counts")
    version = tokenizer_version(tokenizer)
    store = f"{cache}/tokenizer={version}"
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    content = F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " ") if TokenCounter(tokenizer).words else text
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("key"))
    schema = "key binary, n_tokens bigint"
    wanted = base.groupBy("key").agg(F.first("text").alias("text"))
    if _exists(spark, store):
        wanted = wanted.join(spark.read.schema(schema).parquet(store), "key", "left_anti")
    wanted.mapInArrow(released(_counting(tokenizer)), schema).write.mode("append").parquet(store)
    rows = materialize(base.select("doc_id", "key", F.octet_length("text").cast("bigint").alias("n_bytes")), "rows")
    # callers at the same time may have appended a count each; written, so that both sides of the join are plain exchanges, of which Spark splits a key's
    known = spark.read.schema(schema).parquet(store).groupBy("key").agg(F.max("n_tokens").alias("n_tokens"))
    known = materialize(known.join(rows.select("key").distinct(), "key", "left_semi"), "known")
    return rows.join(known, "key").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
