"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.codes import vector_codes
from foliospark.llm.html_extract import main_text
from foliospark.llm.media import media_column
from foliospark.llm.minhash import near_duplicates
from foliospark.llm.packing import pack_documents
from foliospark.llm.rolling import rolling_features
from foliospark.llm.sampling import sample_segmentations
from foliospark.llm.suffix import remove_repeats
from foliospark.llm.tokens import count_tokens
from foliospark.llm.toxicity import score_toxicity
from foliospark.llm.vectors import vector_duplicates
from foliospark.llm.warc import archive_pages
from foliospark.llm.winnow import decontaminate
from foliospark.session import prepare, settled, work_folder

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""

def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), min_len=200)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(_table(spark, sf_dir, "documents"), unit=192)


@settled
def _token_counts(docs: DataFrame, passages: DataFrame, tokenizer: str) -> DataFrame:
    cache = work_folder(docs.sparkSession, "token-counts")
    count_tokens(passages, tokenizer, cache=cache, id_col="item_id")
    return count_tokens(docs, tokenizer, cache=cache, limit=2048)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, through a cache that has the counts of the benchmark's passages already."""
    return _token_counts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), public_tokenizers.path("word_bpe_49k.json"))


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` in sequences of 1024 tokens, with the digest of their ids in place of the ids."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=ranks, pattern=public_tokenizers.PATTERN, size=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"), least=0)


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sample_segmentations(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=2, with_ids=False)
    return found.drop("ids")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.93)


OP10_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT a AS vec_id, a AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(l.component_id, v.vec_id) AS component_id, v.vec_id = coalesce(l.component_id, v.vec_id) AS kept
FROM v LEFT JOIN degree d ON d.vec_id = v.vec_id LEFT JOIN least l ON l.vec_id = v.vec_id
"""

OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), windows AS (
  SELECT r, i, md5(b[i:i + 199]) AS w FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)
), twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), starts AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM windows JOIN twice USING (w)
), runs AS (SELECT r, island, min(i) AS s, max(i) + 200 AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS island FROM starts) GROUP BY ALL
), gaps AS (
  SELECT r, s, e - s AS size, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 1) AS a FROM runs
), cut AS (
  SELECT g.r, sum(size) AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN g.s > g.a THEN hex(b[g.a:g.s - 1]) ELSE '' END, '' ORDER BY g.s) AS kept, max(s + size) AS last FROM gaps g JOIN d USING (r) GROUP BY g.r
)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN c.r IS NULL THEN d.b ELSE unhex(c.kept || CASE WHEN c.last <= octet_length(d.b) THEN hex(d.b[c.last:]) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN cut c ON c.r = d.r
"""

OP7_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + 5 * (g // 4))::INT, 5))::INT >> (15 - 5 * (g % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to, NULL::VARCHAR AS error
FROM f
"""

def op11_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM item_windows
), places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), found AS (SELECT p.r, p.n, p.i, t.item_id FROM places p JOIN item_windows t ON t.n = p.n AND t.s = p.s
), hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, n, i FROM found)) GROUP BY r
), listed AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(l.n_items, 0)::BIGINT AS n_items, sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h ON h.r = d.r LEFT JOIN listed l ON l.r = d.r
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6)


def _op12_sql(rounds: int = 6) -> str:
    """The rounds one after another, each an assignment and the new means."""
    nearest = "SELECT r, p, min(struct_pack(d := list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT, e := e)) AS best FROM parts JOIN {book} USING (p) GROUP BY r, p"
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(book=f'b{k}')})")
        sums = f"SELECT p, best.e AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, best, v, unnest(range(1, len(v) + 1)) AS i FROM a{k} JOIN parts USING (r, p)) GROUP BY ALL"
        means = f"SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM ({sums}) GROUP BY p, e"
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN ({means}) m USING (p, e))")
    last = f"b{rounds}"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, p, x[(p * len(x)) // 8 + 1:((p + 1) * len(x)) // 8] AS v FROM kept, range(8) t(p)
), b0 AS (SELECT p, r - 1 AS e, v AS c FROM parts WHERE r <= 16
), {", ".join(steps)}, coded AS (
  SELECT r, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM ({nearest.format(book=last)}) GROUP BY r
), digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM {last}
)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept k JOIN coded c USING (r), digest
"""


OP12_SQL = _op12_sql()


def op13_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's time is made up from its id: 60 * floor((doc_id + crc32 mod 1000) / 6)."""
    at = F.col("doc_id") + F.crc32(F.col("doc_id").cast("string").cast("binary")) % 1000
    return rolling_features(_table(spark, sf_dir, "documents"), (at - F.pmod(at, F.lit(6))) * 10, windows=(1800, 86400))


OP13_SQL = r"""
WITH crc AS (
  SELECT source, lang, doc_id, length(text) AS n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) AS h FROM documents
), e AS (SELECT *, (60 * floor((doc_id + h % 1000) / 6))::BIGINT AS event_s FROM crc
), w AS (
  SELECT *, 1800 AS window_s, count(*) OVER a AS n_events, sum(n) OVER a AS s, list(n) OVER a AS ns, list(lang) OVER a AS langs FROM e WINDOW a AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 1800 PRECEDING AND 1 PRECEDING)
  UNION ALL
  SELECT *, 86400, count(*) OVER a, sum(n) OVER a, list(n) OVER a, list(lang) OVER a FROM e WINDOW a AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING)
), o AS (SELECT *, list_sort(list_filter(coalesce(ns, []), lambda x: x IS NOT NULL)) AS q FROM w)
SELECT doc_id, window_s::BIGINT AS window_s, event_s, n_events::BIGINT AS n_events, coalesce(s, 0)::BIGINT AS sum_chars, len(list_distinct(list_filter(coalesce(langs, []), lambda x: x IS NOT NULL)))::BIGINT AS n_langs,
  q[(len(q) + 1) // 2]::BIGINT AS median_chars, q[(99 * len(q) + 99) // 100]::BIGINT AS high_chars
FROM o
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_warc_zip": op7_warc_zip,
    "op8_sentencepiece_sampling": op8_sentencepiece_sampling,
    "op9_html_extraction": op9_html_extraction,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_winnowing_decontamination": op11_winnowing_decontamination,
    "op12_vector_codes": op12_vector_codes,
    "op13_rolling_features": op13_rolling_features,
}
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op4_suffix_array_dedup": OP4_SQL,
    "op7_warc_zip": OP7_SQL,
    "op10_embedding_near_dedup": OP10_SQL,
    "op11_winnowing_decontamination": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_rolling_features": OP13_SQL,
}
