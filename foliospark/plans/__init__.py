"""The registered queries over the test tables, and the SQL that each is held against.

The inputs of the operators are scans and what recognisers leave, which the test tables do not have; each query runs an
operator on a relation of the same shape: turns of a conversation are pages of a document, order lines are boxes or
lines of a page, events are outcomes of files, parts are files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.operators import batch as B
from foliospark.operators import layout as L
from foliospark.operators import relational as R
from foliospark.operators import lines as N
from foliospark.operators.ordered import last_known, matches_in_order
from foliospark.operators.raster import binarized, light_of, pixels, split_columns, suppressed, tone_lift
from foliospark.schemas import ERROR
from foliospark.session import partitions, prepare, spread, work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "q11_page_concat"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPACE_SQL = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NORM = "regexp_replace(lower({0}), '[^0-9a-z가-힣]', '', 'g')"
ENTITIES = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&apos;', ''''), '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"


def nested(start: str, *pairs: tuple[str, str, str]) -> str:
    for pattern, by, flags in pairs:
        start = f"regexp_replace({start}, '{pattern}', '{by}', '{flags}')"
    return start


COMPARABLE = nested(ENTITIES, (r"<!--[\s\S]*?-->", " ", "g"), (r"!\[([^\]]*)\]\([^)]*\)", r" \1 ", "g"), (r"\[([^\]]+)\]\([^)]*\)", r" \1 ", "g"), (r"</(?:td|th)>", " ", "gi"), (r"</tr>", chr(10), "gi"),
                    (r"<[^>]+>", " ", "g"), (r"(?m)^[\t ]{{0,3}}(?:#{{1,6}}|[-*+]|[0-9]+\.)[\t ]+", "", "g"), (r"[*_`~>|]", " ", "g"), (SPACE_SQL.replace("{", "{{").replace("}", "}}") + "+", "", "g"))


@query(f"SELECT doc_id, length({NORM.format('text')})::BIGINT AS norm_len, sha256({NORM.format('text')}) AS norm_sha256 FROM documents")
def q01_normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.normalized_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(n).cast("bigint").alias("norm_len"), F.sha2(n, 256).alias("norm_sha256"))


@query(f"SELECT page_id, length(c)::BIGINT AS len, sha256(c) AS sha FROM (SELECT page_id, {COMPARABLE.format('html')} AS c FROM pages)")
def q02_comparable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "pages").select("page_id", T.comparable_text(F.col("html")).alias("c"))
    return c.select("page_id", F.length("c").cast("bigint").alias("len"), F.sha2("c", 256).alias("sha"))


@query(f"SELECT page_id, sha256({ENTITIES.format('html')}) AS sha, (length({ENTITIES.format('html')}))::BIGINT AS len FROM pages")
def q03_entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.decode_entities(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(d, 256).alias("sha"), F.length(d).cast("bigint").alias("len"))


@query(rf"SELECT page_id, sha256(trim(regexp_replace(regexp_replace({ENTITIES.format('html')}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS sha FROM pages")
def q04_cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.cell_text(F.col("html")), 256).alias("sha"))


@query("""SELECT page_id, len(r)::BIGINT AS n_refs, len(list_distinct(r))::BIGINT AS n_distinct, array_to_string(r, ' ') AS refs
FROM (SELECT page_id, regexp_extract_all(replace(replace(html, '<a href="', '<img src="a'), '="a/', '="'), '<img src="([^"]*)"', 1) AS r FROM pages)""")
def q05_link_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.replace(F.replace(F.col("html"), F.lit('<a href="'), F.lit('<img src="a')), F.lit('="a/'), F.lit('="'))
    rows = table(spark, sf_dir, "pages").select("page_id", shown.alias("h"))
    refs = T.image_references(F.col("h"))
    return rows.select("page_id", F.size(refs).cast("bigint").alias("n_refs"), F.size(T.local_references(F.col("h"))).cast("bigint").alias("n_distinct"), F.array_join(refs, " ").alias("refs"))


LATIN = "regexp_replace(lower({0}), '[^0-9a-z]', '', 'g')"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, said, read, next): each turn's letters, what a poor reading makes of them, and the next turn's."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.regexp_replace(F.lower("text"), "[^0-9a-z]", "").alias("said"))
    dealt = spread(rows.withColumn("next", F.coalesce(F.lead("said").over(w), F.lit(""))), "conv_id", "turn")  # a distance is dear, its row small
    return dealt.select("conv_id", "turn", "said", F.replace(F.replace(F.replace("said", F.lit("rn"), F.lit("m")), F.lit("h"), F.lit("")), F.lit("e"), F.lit("c")).alias("read"), "next")


READINGS = f"""(SELECT conv_id, turn, said, replace(replace(replace(said, 'rn', 'm'), 'h', ''), 'e', 'c') AS read, coalesce(lead(said) OVER (PARTITION BY conv_id ORDER BY turn, text), '') AS next
FROM (SELECT conv_id, turn, text, {LATIN.format('text')} AS said FROM conversations))"""
RATE = "round(CASE WHEN length({0}) = 0 THEN (length({1}) > 0)::INT ELSE levenshtein({0}, {1}) / length({0}) END, 6)::DOUBLE"
GATE = "greatest(length({0}), length({1})) > 0 AND levenshtein({0}, {1}) <= floor((1 - 0.65) * greatest(length({0}), length({1})) + 1e-9)"


@query(f"SELECT conv_id, turn, {RATE.format('said', 'read')} AS cer, {RATE.format('said', 'next')} AS cer_next FROM {READINGS}")
def q06_character_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn, whole, against a poor reading of it and against the next turn."""
    rate = lambda a, b: F.round(T.character_error_rate(F.col(a), F.col(b)), 6)
    return readings(spark, sf_dir).select("conv_id", "turn", rate("said", "read").alias("cer"), rate("said", "next").alias("cer_next"))


@query(f"SELECT conv_id, turn, {GATE.format('said', 'read')} AS same, {GATE.format('said', 'next')} AS same_next FROM {READINGS}")
def q07_similarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = lambda a, b: T.similar(F.col(a), F.col(b), 0.65)
    return readings(spark, sf_dir).select("conv_id", "turn", gate("said", "read").alias("same"), gate("said", "next").alias("same_next"))


@query()
def q47_passage_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, however long, as readings of each passage whose first 24 letters (all, if fewer) they have anywhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower("text"), "[^0-9a-z]", "").alias("t"))
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(F.lower("text"), "[^0-9a-z]", "").alias("p")).where("p <> ''").withColumn("lead", F.left("p", F.lit(24)))
    # a document that has a passage's 24 letters has their anchor; passages that are shorter share a first letter with it
    whole, short = passages.where("length(lead) = 24"), passages.where("length(lead) < 24")
    theirs = whole.select("item_id", F.explode(T.anchors(F.col("lead"))).alias("anchor"))
    pairs = docs.select("doc_id", F.explode(T.anchors(F.col("t"))).alias("anchor")).join(theirs, "anchor").select("doc_id", "item_id").distinct()
    held = pairs.join(docs, "doc_id").join(whole, "item_id").where(F.col("t").contains(F.col("lead")))
    few = docs.select("doc_id", F.explode(F.array_distinct(F.split("t", ""))).alias("c"))
    letter = short.withColumn("c", F.left("p", F.lit(1))).join(few, "c").join(docs, "doc_id").where(F.col("t").contains(F.col("lead")))
    found = held.select("item_id", "doc_id", "p", "t").unionByName(letter.select("item_id", "doc_id", "p", "t"))
    return found.select("item_id", "doc_id", F.round(T.character_error_rate(F.col("p"), F.col("t")), 6).alias("cer"))


@query(f"""SELECT b.item_id, d.doc_id, count(*)::BIGINT AS n_lines FROM (SELECT item_id, {NORM.format('text')} AS n FROM benchmark) b JOIN (SELECT doc_id, {NORM.format('line')} AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) d
ON left(b.n, 8) = left(d.n, 8) WHERE length(b.n) >= 8 AND length(d.n) >= 8 GROUP BY ALL""")
def q08_prefix_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and lines of documents that begin alike: the condition of anchors as an equi-join."""
    key = lambda df, i, c: df.select(i, T.start_of(c).alias("k")).where(F.length("k") >= 8)
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return key(table(spark, sf_dir, "benchmark"), "item_id", F.col("text")).join(key(lines, "doc_id", F.col("line")), "k").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"""SELECT doc_id, round(len(list_filter(['the', 'and', 'der', 'que', 'les', 'was', 'for', 'von', 'una', 'sur', 'not'], lambda m: contains({COMPARABLE.format('text')}, m)))::DOUBLE / 11, 4) AS recall,
array_to_string(list_filter(['the', 'and', 'der', 'que', 'les', 'was', 'for', 'von', 'una', 'sur', 'not'], lambda m: NOT contains({COMPARABLE.format('text')}, m)), ',') AS missing FROM documents""")
def q09_marker_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = ["the", "and", "der", "que", "les", "was", "for", "von", "una", "sur", "not"]
    rows = table(spark, sf_dir, "documents").select("doc_id", T.comparable_text(F.col("text")).alias("c"))
    wanted = F.array(*map(F.lit, markers))
    hit = F.filter(wanted, lambda m: F.col("c").contains(m))
    return rows.select("doc_id", F.round(F.size(hit) / len(markers), 4).alias("recall"), F.array_join(F.array_except(wanted, hit), ",").alias("missing"))


@query("""SELECT conv_id, count(*)::BIGINT AS turns, bool_and(length(text) > 40) AS all_long, bool_or(role = 'system') AS any_system, count(*) FILTER (WHERE length(text) > 200)::BIGINT AS n_long, bool_and(length(text) > 40) AND NOT bool_or(role = 'system') AS pass FROM conversations GROUP BY conv_id""")
def q10_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, some = F.bool_and(F.length("text") > 40), F.bool_or(F.col("role") == "system")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), every.alias("all_long"), some.alias("any_system"), F.count_if(F.length("text") > 200).alias("n_long"), (every & ~some).alias("pass"))


CONCAT_SQL = r"""SELECT conv_id, count(*)::BIGINT AS page_count, length(md)::BIGINT AS md_len, sha256(md) AS md_sha256 FROM (
SELECT conv_id, n, string_agg('<!-- page: ' || n || ' -->' || chr(10) || chr(10) || trim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13)), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) OVER (PARTITION BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) || chr(10) AS md
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)) GROUP BY conv_id, md"""


@query(CONCAT_SQL)
def q11_page_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pages of each document in one Markdown text with page marks."""
    found = R.concatenated(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return found.select("conv_id", "page_count", F.length("markdown").cast("bigint").alias("md_len"), F.sha2("markdown", 256).alias("md_sha256"))


@query(CONCAT_SQL)
def q73_streamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents out of a stream of their pages that come in three batches, each put out when its last page has come."""
    from foliospark.streaming.assemble import assembled

    rows = table(spark, sf_dir, "conversations")
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    sent = rows.join(counts, "conv_id").select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "page_count", F.timestamp_seconds(F.lit(1_704_067_200)).alias("seen_at"), F.col("text").alias("markdown"), F.lit(None).cast(ERROR).alias("error"))
    came = work_folder(spark, "pages")
    n = partitions(spark)  # files of a batch, all of which one trigger takes: batches are three however many pages there are
    for k in range(3):
        sent.where(F.pmod("page_number", F.lit(3)) == (k + 1) % 3).repartition(n).write.mode("append").parquet(f"{came}/batch={k}")
    pages = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", n).parquet(f"{came}/*")
    out, state = work_folder(spark, "stream"), work_folder(spark, "stream-state")
    query = assembled(pages).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema(f"doc_id STRING, page_count INT, markdown STRING, error {ERROR}").parquet(out)
    return done.select(F.col("doc_id").cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("page_count").cast("bigint").alias("page_count"), F.length("markdown").cast("bigint").alias("md_len"), F.sha2("markdown", 256).alias("md_sha256"))



@query("SELECT l_suppkey, count(DISTINCT l_orderkey)::BIGINT AS sheet_count, count(*)::BIGINT AS page_count, count(*) FILTER (WHERE l_linenumber % 2 = 0)::BIGINT AS right_pages FROM lineitem GROUP BY l_suppkey")
def q12_manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pages, orders as sheets, of a document for each supplier: the counts of its manifest."""
    from foliospark.operators.assemble import manifests

    n, none = F.col("l_linenumber"), lambda kind: F.lit(None).cast(kind)
    pages = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), n.alias("page_number"), F.col("l_orderkey").alias("sheet_number"), F.when(n % 2 == 0, "right").otherwise("left").alias("side"), none("string").alias("source_image"), none("string").alias("source_document"), none("int").alias("pdf_page_number"), F.lit("two-up").alias("page_layout"),
        *(none("int").alias(f"{k}_{s}") for k in ("source", "page", "recovery") for s in ("width", "height")), none("int").alias("split_column"), none("array<string>").alias("asset_paths"), none("array<string>").alias("warnings"), none("struct<name: string, recognition_model: string, device: string>").alias("engine"),
    )
    inputs = pages.select("doc_id").distinct().select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), *(F.lit("").alias(c) for c in ("sha256", "started_at", "completed_at")))
    m = F.col("manifest")
    right = F.size(F.filter(m["pages"], lambda x: x["side"] == "right")).cast("bigint")
    return manifests(pages, inputs, {"pageLayout": "auto"}).select(F.col("doc_id").alias("l_suppkey"), m["sheetCount"].cast("bigint").alias("sheet_count"), m["pageCount"].cast("bigint").alias("page_count"), right.alias("right_pages"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of files, a user's as a batch."""
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    link = lambda ext: F.when(~bad, F.concat(F.lit("out dir/"), F.col("event_id").cast("string"), F.lit(ext)))
    return e.select("user_id", "event_id", F.concat(F.lit("a|b"), F.col("event_id").cast("string"), F.lit(".png")).alias("input"), F.when(bad, "failed").otherwise("succeeded").alias("status"), link(".md").alias("markdown"), link(".json").alias("manifest"),
                    F.when(bad, F.struct(F.lit("OCR_ENGINE_FAILED").alias("code"), F.col("event_type").alias("message"))).alias("error"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("file_number"))


@query("SELECT user_id, count(*)::BIGINT AS discovered, count(*) FILTER (WHERE event_type <> 'error')::BIGINT AS succeeded, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS failed FROM events GROUP BY user_id")
def q13_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.totals(outcomes(spark, sf_dir), "user_id")


@query(r"""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id, event_type FROM events), t AS (
SELECT user_id, n, event_type, '| ' || n || ' | a\|b' || event_id || '.png | ' || CASE WHEN event_type = 'error' THEN '실패' ELSE '성공' END || ' | ' ||
CASE WHEN event_type = 'error' THEN '-' ELSE '[열기](<out%20dir/' || event_id || '.md>)' END || ' | ' || CASE WHEN event_type = 'error' THEN '-' ELSE '[열기](<out%20dir/' || event_id || '.json>)' END || ' | ' ||
CASE WHEN event_type = 'error' THEN 'OCR_ENGINE_FAILED: error' ELSE '-' END || ' |' AS line FROM r)
SELECT user_id, sha256('# OCR 일괄 처리 요약' || chr(10) || chr(10) || '- 입력 폴더: `' || user_id || '`' || chr(10) || '- 전체: ' || count(*) || chr(10) || '- 성공: ' || count(*) FILTER (WHERE event_type <> 'error') || chr(10) || '- 실패: ' || count(*) FILTER (WHERE event_type = 'error') || chr(10) || chr(10) ||
'| # | 입력 이미지 | 상태 | Markdown | Manifest | 오류 |' || chr(10) || '| ---: | --- | --- | --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10)) AS summary_sha256, count(*)::BIGINT AS discovered FROM t GROUP BY user_id""")
def q14_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.summaries(outcomes(spark, sf_dir), ["user_id"], folder="user_id")
    return found.select("user_id", F.sha2("summary", 256).alias("summary_sha256"), "discovered")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def q15_input_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("""SELECT l_orderkey, modal::BIGINT AS modal FROM (SELECT l_orderkey, q AS modal, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, q) AS k FROM
(SELECT l_orderkey, (l_partkey % 6)::INT AS q, count(*) AS c FROM lineitem GROUP BY ALL)) WHERE k = 1""")
def q16_modal_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 6).cast("int").alias("q"))
    return rows.groupBy("l_orderkey").agg(R.smallest_mode(F.col("q")).cast("bigint").alias("modal"))


BOXES_SQL = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_linenumber * 40 + l_partkey % 30)::DOUBLE AS x0, ((l_suppkey % 25) * 12)::DOUBLE AS y0,
(l_linenumber * 40 + l_partkey % 30 + 60 + l_partkey % 200)::DOUBLE AS x1, ((l_suppkey % 25) * 12 + 8 + l_quantity::INT * (1 + l_partkey % 5))::DOUBLE AS y1 FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes on a page per order."""
    x0, y0 = F.col("l_linenumber") * 40 + F.col("l_partkey") % 30, (F.col("l_suppkey") % 25) * 12
    sides = (x0, y0, x0 + 60 + F.col("l_partkey") % 200, y0 + 8 + F.col("l_quantity").cast("int") * (1 + F.col("l_partkey") % 5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.array(*(v.cast("double") for v in sides)).alias("box"))


@query(f"SELECT l_orderkey, round(median(y1 - y0), 4) AS median_height, round(avg(x1 - x0), 4) AS mean_width FROM {BOXES_SQL} GROUP BY l_orderkey")
def q17_median_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    return boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.round(F.median(G.height(b)), 4).alias("median_height"), F.round(F.avg(G.width(b)), 4).alias("mean_width"))


TALL_SQL = f"(SELECT * FROM (SELECT *, median(y1 - y0) OVER (PARTITION BY l_orderkey) AS m FROM {BOXES_SQL}) WHERE y1 - y0 >= greatest(80, 2.5 * m) AND x1 - x0 >= 60)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, x0, y0, x1, y1 FROM {TALL_SQL}")
def q18_tall_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.tall_regions(boxes(spark, sf_dir), ["l_orderkey"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", *(F.col("box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query(f"""SELECT r.l_orderkey, r.l_linenumber AS region_line, r.l_partkey AS region_part, count(*)::BIGINT AS n_lines, sum(l.l_partkey)::BIGINT AS parts FROM {TALL_SQL} r JOIN {BOXES_SQL} l ON l.l_orderkey = r.l_orderkey
AND (l.x0 + l.x1) / 2 BETWEEN r.x0 - 8 AND r.x1 + 8 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 - 12 AND r.y1 + 24 GROUP BY ALL""")
def q19_point_in_region_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    regions = G.tall_regions(b, ["l_orderkey"]).select("l_orderkey", F.col("l_linenumber").alias("region_line"), F.col("l_partkey").alias("region_part"), F.col("box").alias("region"))
    lines = b.select("l_orderkey", F.col("l_partkey").cast("string").alias("text"), "l_partkey", "box")
    return G.lines_in_regions(lines, regions, ["l_orderkey"]).groupBy("l_orderkey", "region_line", "region_part").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_partkey").alias("parts"))


@query(f"""SELECT r.l_orderkey, r.l_linenumber AS block_line, r.l_partkey AS block_part, string_agg(l.l_partkey::VARCHAR, ' ' ORDER BY l.y0, l.x0, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS text
FROM {TALL_SQL} r JOIN {BOXES_SQL} l ON l.l_orderkey = r.l_orderkey AND (l.x0 + l.x1) / 2 BETWEEN r.x0 - 4 AND r.x1 + 4 AND (l.y0 + l.y1) / 2 BETWEEN r.y0 - 4 AND r.y1 + 4 GROUP BY ALL""")
def q20_block_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    blocks = G.tall_regions(b, ["l_orderkey"]).select("l_orderkey", F.col("l_linenumber").alias("block_line"), F.col("l_partkey").alias("block_part"), F.col("box").alias("block"))
    found = G.lines_in_blocks(b, blocks, ["l_orderkey"])
    order = (F.col("box")[1].alias("a"), F.col("box")[0].alias("b"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"))
    return found.groupBy("l_orderkey", "block_line", "block_part").agg(R.ordered_concat(F.col("l_partkey").cast("string"), " ", *order).alias("text"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY y0, x0, l_linenumber, l_partkey, l_suppkey, l_extendedprice)::BIGINT AS position FROM {BOXES_SQL}")
def q21_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = R.from_top(boxes(spark, sf_dir), ["l_orderkey"], "box", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("position").cast("bigint").alias("position"))


LINES_SQL = """(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i,
CASE l_partkey % 4 WHEN 0 THEN l_linenumber || ') part ' || l_partkey WHEN 1 THEN '3.' || l_linenumber || ' section' ELSE 'text ' || l_partkey END AS t FROM lineitem)"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as text lines: some with a marker, some with a section number."""
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    number, part = F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
    t = F.when(F.col("l_partkey") % 4 == 0, F.concat(number, F.lit(") part "), part)).when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("3."), number, F.lit(" section"))).otherwise(F.concat(F.lit("text "), part))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", i.alias("i"), t.alias("t"))


@query(rf"""SELECT l_orderkey, paragraph::BIGINT AS paragraph, string_agg(t, ' ' ORDER BY i) AS text FROM (SELECT *, sum(regexp_matches(t, '^(?:[0-9]{{1,3}}\)|[0-9]+(\.[0-9]+)+(\s|$))')::INT) OVER (PARTITION BY l_orderkey ORDER BY i) AS paragraph FROM {LINES_SQL}) GROUP BY ALL""")
def q22_paragraph_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paragraph_folds(page_lines(spark, sf_dir), ["l_orderkey"], "i", "t").withColumn("paragraph", F.col("paragraph").cast("bigint"))


@query(rf"""SELECT l_orderkey, max(n)::INT AS number, string_agg(t, ' ' ORDER BY i) AS text FROM (SELECT *, count(n) OVER (PARTITION BY l_orderkey ORDER BY i) AS island, count(n) OVER (PARTITION BY l_orderkey) AS starts
FROM (SELECT *, try_cast(nullif(regexp_extract(t, '^([0-9]{{1,3}})\)', 1), '') AS INT) AS n FROM {LINES_SQL})) WHERE starts >= 3 AND island > 0 GROUP BY l_orderkey, island""")
def q23_numbered_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numbered_islands(page_lines(spark, sf_dir), ["l_orderkey"], ["i"], "t")


PRESENT_SQL = "(SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_partkey % 3 = 0)"


@query(f"SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM {PRESENT_SQL} p WHERE p.l_orderkey = l.l_orderkey AND p.n = l.l_linenumber)")
def q24_missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), "l_partkey")
    return R.missing_numbers(rows.select("l_orderkey", "n").distinct(), rows.where("l_partkey % 3 = 0").select("l_orderkey", "n"), ["l_orderkey", "n"])


@query(r"""SELECT d.doc_id, count(*)::BIGINT AS n_shared, min(w) AS first_word FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}'))) AS w FROM documents) d
WHERE w IN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) FROM benchmark) GROUP BY d.doc_id""")
def q25_consensus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = R.shared_words(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")
    return shared.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_shared"), F.min("word").alias("first_word"))


@query(f"""SELECT m.l_orderkey, m.n, min(p.n) AS next_number FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_partkey % 3 <> 0) m LEFT JOIN {PRESENT_SQL} p ON p.l_orderkey = m.l_orderkey AND p.n > m.n GROUP BY ALL""")
def q26_next_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), "l_partkey")
    return R.next_present(rows.where("l_partkey % 3 <> 0").select("l_orderkey", "n").distinct(), rows.where("l_partkey % 3 = 0").select("l_orderkey", "n"), ["l_orderkey"], "n")


ANCHORS_SQL = "(SELECT DISTINCT user_id, (epoch_us(ts) // 1000000)::DOUBLE AS x, round(value * 10, 0) AS y FROM events WHERE event_type = 'purchase')"


@query(f"""WITH a AS (SELECT user_id, x, max(y) AS y FROM {ANCHORS_SQL} GROUP BY ALL), s AS (SELECT user_id, x AS x0, y AS t0, lead(x) OVER w AS x1, lead(y) OVER w AS t1, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM a WINDOW w AS (PARTITION BY user_id ORDER BY x, y)),
g AS (SELECT user_id, x0, t0, coalesce(x1, x0) AS x1, coalesce(t1, t0) AS t1, CASE WHEN k = 1 THEN '-inf'::DOUBLE ELSE x0 END AS lo, CASE WHEN k >= n - 1 THEN 'inf'::DOUBLE ELSE x1 END AS hi FROM s WHERE k < n OR n = 1)
SELECT e.event_id, round(CASE WHEN abs(x1 - x0) < 0.001 THEN q + t0 - x0 ELSE t0 + (q - x0) / (x1 - x0) * (t1 - t0) END, 3) AS mapped
FROM (SELECT event_id, user_id, (epoch_us(ts) // 1000000)::DOUBLE AS q FROM events WHERE event_type = 'view') e JOIN g ON g.user_id = e.user_id AND q > lo AND q <= hi""")
def q27_anchor_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").cast("double"))
    anchors = e.where("event_type = 'purchase'").groupBy("user_id", F.col("at").alias("x")).agg(F.max(F.round(F.col("value") * 10, 0)).alias("y"))
    seg = R.anchor_segments(anchors, ["user_id"], "x", "y")
    views = e.where("event_type = 'view'").select("event_id", "user_id", F.col("at").alias("q"))
    hit = last_known(views, seg, ["user_id"], "q", "lo").where("known is not null")
    return hit.select("event_id", F.round(G.interpolated(F.col("q"), *(F.col(f"known.{c}") for c in ("x0", "x1", "to0", "to1"))), 3).alias("mapped"))


MATCH_SQL = """(SELECT l_orderkey, l_partkey % 5 AS k, l_suppkey % 2 AS side, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem)"""


@query(f"""WITH RECURSIVE b AS MATERIALIZED (SELECT l_orderkey, i, k FROM {MATCH_SQL} WHERE side = 0), l AS MATERIALIZED (SELECT l_orderkey, i, k FROM {MATCH_SQL} WHERE side = 1),
s AS (SELECT DISTINCT l_orderkey, -1::BIGINT AS block, NULL::BIGINT AS line, 0::BIGINT AS at FROM b UNION ALL
SELECT * FROM (SELECT s.l_orderkey, s.block + 1 AS block, min(l.i) AS line, coalesce(min(l.i) + 1, s.at) AS at FROM s JOIN b ON b.l_orderkey = s.l_orderkey AND b.i = s.block + 1 LEFT JOIN l ON l.l_orderkey = s.l_orderkey AND l.k = b.k AND l.i >= s.at GROUP BY s.l_orderkey, s.block, s.at))
SELECT l_orderkey, block::INT AS block, line::INT AS line FROM s WHERE line IS NOT NULL""")
def q72_matches_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order from one half of the suppliers as blocks, those from the other half as lines, matched in order by a key that repeats."""
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey") % 5)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return matches_in_order(rows.where("l_suppkey % 2 = 0"), rows.where("l_suppkey % 2 = 1"), ["l_orderkey"], "k", order, order)


@query("""WITH f AS (SELECT p_partkey, p_brand || CASE p_partkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' ELSE '.PNG' END AS name FROM part), s AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext FROM f),
b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY lower(stem)) > 1 THEN stem || '-' || ext ELSE stem END AS base FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY p_partkey) AS k FROM b)
SELECT p_partkey, name, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS folder FROM k""".replace("\\\\", "\\"))
def q28_folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("p_partkey") % 3 == 0, ".png").when(F.col("p_partkey") % 3 == 1, ".jpg").otherwise(".PNG")
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", ext).alias("name"))
    return R.folder_names(files, "name", "p_partkey").select("p_partkey", "name", "folder")


@query("""SELECT l_orderkey, count(*)::BIGINT AS refs, count(*) FILTER (WHERE p.p_partkey IS NULL)::BIGINT AS missing, bool_or(p.p_partkey IS NULL) AS failed
FROM lineitem l LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 2) p ON p.p_partkey = l.l_partkey GROUP BY l_orderkey""")
def q29_missing_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "part").where("p_size > 2").select(F.col("p_partkey").alias("l_partkey"))
    found = R.with_presence(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), there, ["l_partkey"])
    return found.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("refs"), F.count_if(~F.col("present")).alias("missing"), F.bool_or(~F.col("present")).alias("failed"))


@query("""SELECT p_partkey, side, CASE WHEN layout = 'single' THEN 'single' WHEN side = 0 THEN 'left' ELSE 'right' END AS label, layout FROM (SELECT *, coalesce(CASE WHEN p_partkey % 7 = 0 THEN 'single' END, CASE WHEN p_size <= p_partkey % 50 + 1 THEN 'single' ELSE 'two-up' END) AS layout FROM part) JOIN (VALUES (0), (1)) s(side) ON layout = 'two-up' OR side = 0""")
def q30_layout_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", L.effective_layout("auto", None, F.when(F.col("p_partkey") % 7 == 0, "single"), F.col("p_size"), F.col("p_partkey") % 50 + 1).alias("layout"))
    sides = F.explode(F.when(F.col("layout") == "single", F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side")
    return p.select("p_partkey", "layout", sides).select("p_partkey", "side", L.side_label(F.col("layout"), F.col("side")).alias("label"), "layout")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_partkey % 256)::INT AS r, (greatest(0, least(255, l_partkey % 256 + l_suppkey % 41 - 20)))::INT AS g, (greatest(0, least(255, l_partkey % 256 + l_linenumber - 4)))::INT AS b FROM lineitem),
q AS (SELECT *, r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS light, greatest(r, g, b) - least(r, g, b) AS chroma FROM p), s AS (SELECT *, least(greatest((light - 150) / 55, 0.0), 1.0) AS t FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN chroma > 18 OR light <= 150 THEN r ELSE floor(r + (255 - r) * (t * t * (3 - 2 * t)) + 0.5) END::BIGINT AS lifted, CASE WHEN chroma > 18 THEN r WHEN light <= 150 THEN 0 ELSE 255 END::INT AS binary_value FROM s""")
def q31_tone_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey") % 256
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("int")
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", part.cast("int").alias("r"), clip(part + F.col("l_suppkey") % 41 - 20).alias("g"), clip(part + F.col("l_linenumber") - 4).alias("b"))
    r, g, b = (F.col(c) for c in "rgb")
    light, chroma = light_of(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", tone_lift(r, light, chroma, "conservative").alias("lifted"), binarized(r, light, chroma).cast("int").alias("binary_value"))


@query("""WITH px AS (SELECT o_orderkey, x, v * 0.2126::DOUBLE + v * 0.7152::DOUBLE + v * 0.0722::DOUBLE AS light FROM (SELECT o_orderkey, x, ((o_orderkey * 31 + x * x * 7) % 256)::DOUBLE AS v FROM (SELECT o_orderkey FROM orders), range(0, 60) t(x))),
n AS (SELECT o_orderkey, x, light, lag(light, 2) OVER w AS a, lag(light) OVER w AS b, lead(light) OVER w AS d, lead(light, 2) OVER w AS e FROM px WINDOW w AS (PARTITION BY o_orderkey ORDER BY x)),
s AS (SELECT o_orderkey, x, (CASE WHEN ((((a + b) + light) + d) + e) / 5 < 210 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.7::DOUBLE + (abs(b - d) + abs(b - d)) / 510 * 0.25::DOUBLE + abs(x - 30.0::DOUBLE) / 6 * 0.05::DOUBLE AS score FROM n WHERE x BETWEEN 24 AND 36)
SELECT o_orderkey, split_column FROM (SELECT o_orderkey, x::BIGINT AS split_column, row_number() OVER (PARTITION BY o_orderkey ORDER BY score, x) AS k FROM s) WHERE k = 1""")
def q32_gutter_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gutter search on a raster of 60 x 2 pixels an order."""
    value = lambda x: F.lpad(F.hex(((F.col("o_orderkey") * 31 + x * x * 7) % 256).cast("int")), 2, "0")
    row = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda x: F.repeat(value(x), F.lit(3))), "")
    image = F.struct(F.lit(60).alias("width"), F.lit(2).alias("height"), F.unhex(F.repeat(row, F.lit(2))).alias("data"))
    return table(spark, sf_dir, "orders").select("o_orderkey", split_columns(image).cast("bigint").alias("split_column"))


@query(r"""SELECT l_orderkey, sha256(regexp_replace(t, '(^|\n)([\t ]{0,3})([0-9]{1,3})\)[\t ]*', '\1\2\3\\) ', 'g')) AS escaped_sha256, length(regexp_replace(t, '(^|\n)([\t ]{0,3})([0-9]{1,3})\)[\t ]*', '\1\2\3\\) ', 'g'))::BIGINT AS len FROM (SELECT l_orderkey, string_agg(t, chr(10) ORDER BY i) AS t FROM """ + LINES_SQL + " GROUP BY l_orderkey)")
def q33_escape_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = page_lines(spark, sf_dir).groupBy("l_orderkey").agg(R.ordered_concat(F.col("t"), "\n", F.col("i")).alias("t"))
    e = T.escape_markers(F.col("t"))
    return md.select("l_orderkey", F.sha2(e, 256).alias("escaped_sha256"), F.length(e).cast("bigint").alias("len"))


@query("""SELECT p_partkey, '&lt;' || p_name || '&gt; &amp; &quot;' || p_brand || '&quot;' AS escaped, '<' || p_name || '> & "' || p_brand || '"' AS decoded FROM part""")
def q34_xml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<"), "p_name", F.lit('> & "'), "p_brand", F.lit('"'))
    return table(spark, sf_dir, "part").select("p_partkey", T.xml_escape(raw).alias("escaped")).withColumn("decoded", T.xml_decode(F.col("escaped")))


@query("""SELECT o_orderkey, count(*)::BIGINT AS n_sheets, string_agg('media/' || l_partkey || '.png', ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS targets FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 5 <> 0 GROUP BY o_orderkey""")
def q35_docx_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a body's image references, parts as its relationships; one part in five is linked from outside."""
    from foliospark.sources.loader import relationships, sheet_references

    n = F.col("l_partkey").cast("string")
    tag = F.concat(F.lit('<Relationship Id="rId'), n, F.lit('" Type="http://x/image" Target="media/'), n, F.lit('.png"'), F.when(F.col("l_partkey") % 5 == 0, F.lit(' TargetMode="External"')).otherwise(F.lit("")), F.lit("/>"))
    ref = F.concat(F.lit('<a:blip r:embed="rId'), n, F.lit('"/>'))
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    xml = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(R.ordered_concat(ref, "", *order).alias("body_xml"), R.ordered_concat(tag, "", *order).alias("rels_xml"))
    found = sheet_references(xml.select("doc_id", "body_xml"), relationships(xml.select("doc_id", "rels_xml")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return found.join(orders, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_sheets"), R.ordered_concat(F.col("target"), " ", F.col("sheet_number")).alias("targets"))


@query(f"""SELECT l_orderkey, count(*)::BIGINT AS n_lines, string_agg(l_partkey::VARCHAR, ' ' ORDER BY k) AS texts, round(sum(x1 - x0), 4) AS width FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM {BOXES_SQL}) GROUP BY l_orderkey""")
def q36_sidecar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as parallel arrays of a recogniser's JSON, read back; a broken and an empty file come first and are passed over."""
    from foliospark.sources import sidecars

    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "box")
    rows = boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("r"))
    ocr = F.struct(F.transform("r", lambda x: x["l_partkey"].cast("string")).alias("rec_texts"), F.transform("r", lambda x: x["box"]).alias("rec_boxes"))
    files = rows.select("l_orderkey", F.to_json(F.struct(F.struct(ocr.alias("overall_ocr_res")).alias("res"))).alias("good"))
    file = lambda i, name, text: F.struct(F.lit(i).alias("walk_index"), F.lit(name).alias("name"), text.alias("json"))
    kinds = F.explode(F.array(file(0, "a.json", F.lit("{")), file(1, "b.json", F.lit("{}")), file(2, "raw_ocr.json", F.col("good")))).alias("f")
    lines = sidecars.text_lines(files.select("l_orderkey", kinds).select("l_orderkey", "f.*"), ["l_orderkey"])
    width = F.aggregate("raw_lines", F.lit(0.0), lambda a, x: a + G.width(x["box"]))
    return lines.select("l_orderkey", F.size("raw_lines").cast("bigint").alias("n_lines"), F.array_join(F.col("raw_lines.text"), " ").alias("texts"), F.round(width, 4).alias("width"))


@query(f"""SELECT l_orderkey, count(*)::BIGINT AS n_blocks, string_agg(CASE WHEN l_partkey % 3 = 0 THEN '![추출 이미지](imgs/' || l_partkey || '.png)' ELSE 'block ' || l_partkey END, chr(10) || chr(10) ORDER BY k) AS markdown
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM {BOXES_SQL}) GROUP BY l_orderkey""")
def q37_layout_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as layout blocks with a given order, shuffled and rendered as Markdown."""
    figure = F.col("l_partkey") % 3 == 0
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    text = F.col("l_partkey").cast("string")
    none = F.lit(None).cast("string")
    block = F.struct(F.col("box").alias("bbox"), F.col("k").cast("double").alias("ord"), F.when(figure, "figure").otherwise("text").alias("type"), none.alias("markdown"), F.when(~figure, F.concat(F.lit(" block "), text)).alias("content"), F.when(figure, F.concat(F.lit("imgs/"), text, F.lit(".png"))).alias("asset_path"), none.alias("alt"))
    pages = boxes(spark, sf_dir).withColumn("k", k).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(block), False).alias("blocks"))
    return pages.select("l_orderkey", F.size("blocks").cast("bigint").alias("n_blocks"), L.rendered(F.col("blocks"))["markdown"].alias("markdown"))


@query("""WITH f AS (SELECT l_orderkey, 'fig' || (l_partkey % 3) || CASE WHEN l_partkey % 2 = 0 THEN '.png' ELSE '.PNG' END AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem)
SELECT l_orderkey, i::BIGINT AS i, name, CASE WHEN k = 1 THEN name ELSE regexp_replace(name, '[.][^.]*$', '') || '-' || k || regexp_extract(name, '([.][^.]*)$', 1) END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, lower(name) ORDER BY i) AS k FROM f)""")
def q38_asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    name = F.concat(F.lit("fig"), (F.col("l_partkey") % 3).cast("string"), F.when(F.col("l_partkey") % 2 == 0, ".png").otherwise(".PNG"))
    return R.unique_names(table(spark, sf_dir, "lineitem").select("l_orderkey", i.cast("bigint").alias("i"), name.alias("name")), ["l_orderkey"], "name", "i").select("l_orderkey", "i", "name", "unique_name")


@query("""SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') || ' KST' AS kst, 'page-' || lpad((event_id % 10000)::VARCHAR, 4, '0') AS page_id FROM events""")
def q39_time_and_page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.kst(F.col("ts").cast("timestamp")).alias("kst"), T.page_id((F.col("event_id") % 10000).cast("int")).alias("page_id"))


@query(r"""SELECT page_id, url_decode(replace(url, '+', '%2B')) AS decoded, regexp_extract(url, '([^/]*)$', 1) AS base, NOT (starts_with(p, '/') OR list_contains(string_split(p, '/'), '..')) AS safe,
starts_with(url, 'https') AS rooted_safe, length(url) % 3 <> 0 AS deep_safe FROM (SELECT *, replace(url, chr(92), '/') AS p FROM pages)""")
def q40_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.url_decoded(u).alias("decoded"), F.regexp_extract(u, "([^/]*)$", 1).alias("base"), T.safe_entry(u).alias("safe"),
                                                        T.safe_entry(F.when(u.startswith("https"), u).otherwise(F.concat(F.lit("\\"), u))).alias("rooted_safe"), T.safe_entry(F.when(F.length(u) % 3 != 0, u).otherwise(F.concat(u, F.lit("\\..\\x")))).alias("deep_safe"))


@query(rf"""SELECT l_orderkey, list_sort(list_distinct(list_transform(regexp_extract_all(t, '\b([0-9]{{1,3}})\s*\)', 1), lambda x: x::INT)))::VARCHAR AS numbers, len(list_distinct(regexp_extract_all(t, '\b([0-9]{{1,3}})\s*\)', 1)))::BIGINT AS n_numbers
FROM (SELECT l_orderkey, string_agg(t, chr(10) ORDER BY i) AS t FROM {LINES_SQL} GROUP BY l_orderkey)""")
def q41_marker_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = page_lines(spark, sf_dir).groupBy("l_orderkey").agg(R.ordered_concat(F.col("t"), "\n", F.col("i")).alias("t"))
    found = T.marker_numbers(F.col("t"))
    return md.select("l_orderkey", F.concat(F.lit("["), F.array_join(F.array_sort(found), ", "), F.lit("]")).alias("numbers"), F.size(found).cast("bigint").alias("n_numbers"))


@query(f"""SELECT a.l_orderkey, a.l_partkey AS part_a, b.l_partkey AS part_b, round(greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0), 6) AS overlap, (a.x0 / 2 + a.x1 / 2) / 2 AS half_center
FROM {BOXES_SQL} a JOIN {BOXES_SQL} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber""")
def q42_vertical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    left = b.select("l_orderkey", F.col("l_partkey").alias("part_a"), F.col("box").alias("a"), (F.col("l_linenumber") + 1).alias("n"))
    right = b.select("l_orderkey", F.col("l_partkey").alias("part_b"), F.col("box").alias("b"), F.col("l_linenumber").alias("n"))
    return left.join(right, ["l_orderkey", "n"]).select("l_orderkey", "part_a", "part_b", F.round(G.vertical_overlap(F.col("a"), F.col("b")), 6).alias("overlap"), G.center_x(G.scaled(F.col("a"), F.lit(2.0))).alias("half_center"))


#: Of each order's lines, numbered from 1, one in three is missing from the page; what the repair makes of it by its rules:
#: a missing number goes to the line break before the next one, or to the end.
REPAIRED = r"""(SELECT l_orderkey, string_agg(CASE WHEN there THEN (CASE WHEN n = (CASE WHEN lines < 3 THEN first_there ELSE 1 END) THEN '' ELSE chr(10) END) || t || (CASE WHEN n = last_there THEN '' ELSE chr(10) END)
  WHEN lines < 3 THEN '' WHEN n < last_there THEN t || chr(10) || CASE WHEN n = 1 THEN '' ELSE chr(10) END ELSE chr(10) || chr(10) || t END, '' ORDER BY n) AS markdown, string_agg(said, chr(10) || chr(10) ORDER BY n) AS expected
FROM (SELECT *, n || '\) part ' || l_partkey AS t, n || ') part ' || l_partkey AS said, count(*) OVER w AS lines, min(n) FILTER (WHERE there) OVER w AS first_there, max(n) FILTER (WHERE there) OVER w AS last_there
FROM (SELECT l_orderkey, l_partkey, l_partkey % 3 <> 0 AS there, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey)) GROUP BY l_orderkey)"""


def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, markdown, expected): pages that lost one numbered line in three, repaired from the recogniser's lines, and what they say."""
    from foliospark.operators.repair import repaired
    from foliospark.schemas import BLOCK, BOX, LINE

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    # one short list a page: its texts and lines are made of it, so none of them goes through the grouping
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(n.alias("n"), "l_partkey").alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("own"))
    said = lambda x: F.concat(x["n"].cast("string"), F.lit(") part "), x["l_partkey"].cast("string"))
    box = lambda y: F.array(F.lit(100.0), y, F.lit(900.0), y + 30)
    pages = pages.select(
        "l_orderkey", F.array_join(F.transform(F.filter("own", lambda x: x["l_partkey"] % 3 != 0), said), "\n\n").alias("markdown"), F.array_join(F.transform("own", said), "\n\n").alias("expected"),
        F.transform("own", lambda x: F.struct(said(x).alias("text"), box(x["n"] * 50.0).alias("box"), F.lit(None).cast("double").alias("score"))).alias("raw"),
    )
    empty = lambda kind: F.array().cast(f"ARRAY<{kind}>")
    return pages.select("l_orderkey", repaired(F.col("markdown"), F.col("raw"), empty(LINE), empty(BLOCK), empty(BOX), F.lit(1.0), F.lit(1.0)).alias("markdown"), "expected")


@query(f"SELECT l_orderkey, markdown FROM {REPAIRED}")
def q43_repair_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_pages(spark, sf_dir).select("l_orderkey", "markdown")


def comparable_sql(c: str) -> str:
    return COMPARABLE.format(c)


@query(f"""SELECT l_orderkey, false AS passed, levenshtein(e, a) / length(e) <= 0.25 AS "textCerAtMost25Percent", round(levenshtein(e, a) / length(e), 4)::DOUBLE AS "characterErrorRate", 0.0::DOUBLE AS "requiredMarkerRecall", 0 AS "tableCount", true AS "watermarkSuppressed"
FROM (SELECT l_orderkey, {comparable_sql('markdown')} AS a, {comparable_sql('expected')} AS e FROM {REPAIRED})""")
def q44_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired pages of each order against what its lines say: criteria, metrics, verdict."""
    from foliospark.operators.evaluate import evaluated

    found = evaluated(numbered_pages(spark, sf_dir).withColumnRenamed("markdown", "actual"))
    return found.select("l_orderkey", "passed", "criteria.textCerAtMost25Percent", "metrics.characterErrorRate", "metrics.requiredMarkerRecall", "metrics.tableCount", "criteria.watermarkSuppressed")


#: The cut of a scan of 120 x 40 pixels whose six written rows are dark up to column 52 to 56, and grey from 68 to 113.
CUTS = """(WITH px AS (SELECT s_suppkey, x, CASE WHEN x >= 6 AND x < 52 + s_suppkey % 5 THEN 30 WHEN x >= 68 AND x < 114 THEN 190 ELSE 255 END AS v FROM supplier, range(40, 80) t(x)),
n AS (SELECT *, lag(v, 2) OVER w + lag(v) OVER w + v + lead(v) OVER w + lead(v, 2) OVER w AS five, abs(lag(v) OVER w - lead(v) OVER w) AS edge FROM px WINDOW w AS (PARTITION BY s_suppkey ORDER BY x))
SELECT s_suppkey, arg_min(x, ((CASE WHEN five < 1050 THEN 6 ELSE 0 END) / 40 * 0.7 + edge * 6 / (40 * 255) * 0.25 + abs(x - 60) / 12 * 0.05) * 1000000 + x / 1000000) AS cut FROM n WHERE x BETWEEN 48 AND 72 GROUP BY s_suppkey)"""


@query(f"""SELECT s_suppkey::VARCHAR AS doc_id, side + 1 AS page_number, CASE side WHEN 0 THEN 'left' ELSE 'right' END AS side, 'two-up' AS page_layout, cut::INT AS split_column, (CASE side WHEN 0 THEN cut ELSE 120 - cut END)::INT AS page_width, 40 AS page_height,
(2 * CASE side WHEN 0 THEN cut ELSE 120 - cut END)::INT AS recovery_width, 80 AS recovery_height FROM {CUTS}, (VALUES (0), (1)) s(side)""")
def q45_raster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as small scans of two pages: decoded, cut, suppressed, encoded; sizes and where they are cut."""
    from foliospark.pipeline import Settings, prepared
    from foliospark.schemas import SHEETS

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        from foliospark.operators.raster import encode_png

        for batch in batches:
            keys = batch.column("s_suppkey").to_pylist()
            png = []
            for k in keys:
                image = np.full((40, 120, 3), 255, np.uint8)
                image[8:32:4, 6 : 52 + k % 5] = 30
                image[8:32:4, 68:114] = 190
                png.append(encode_png(image))
            n = len(keys)
            yield pa.record_batch({"doc_id": pa.array([str(k) for k in keys]), "sheet_number": pa.array([1] * n, pa.int32()), "name": pa.array([f"{k}.png" for k in keys]), "source_name": pa.array([f"{k}.png" for k in keys]), "content": pa.array(png, pa.binary()),
                                   "page_layout": pa.nulls(n, pa.string()), "pdf_page_number": pa.nulls(n, pa.int32()), "error": pa.nulls(n, pa.struct([("code", pa.string()), ("message", pa.string())]))})

    scans = spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").mapInArrow(draw, SHEETS)
    return prepared(scans, Settings(watermark_mode="text-safe")).select("doc_id", "page_number", "side", "page_layout", "split_column", "page_width", "page_height", "recovery_width", "recovery_height")


GRID = "(SELECT l_orderkey, l_partkey, i, (i - 1) // 3 AS line, (i * 2) % 3 AS place FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem))"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes in rows of three, not quite level, in no order."""
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    x, y = ((F.col("i") * 2) % 3) * 300.0, F.floor((F.col("i") - 1) / 3) * 100.0 + F.col("i") % 3 * 4
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", i.alias("i")).withColumn("box", F.array(x, y, x + 200, y + 40))


@query(f"SELECT l_orderkey, string_agg('block ' || l_partkey, chr(10) || chr(10) ORDER BY line, place) AS markdown FROM {GRID} GROUP BY l_orderkey")
def q49_block_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without a given order, read row by row from left to right."""
    none = F.lit(None).cast("string")
    block = F.struct(F.col("box").alias("bbox"), F.lit(None).cast("double").alias("ord"), F.lit("text").alias("type"), none.alias("markdown"), F.concat(F.lit("block "), F.col("l_partkey").cast("string")).alias("content"), none.alias("asset_path"), none.alias("alt"))
    pages = grid(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(block).alias("blocks"))
    return pages.select("l_orderkey", L.rendered(F.col("blocks"))["markdown"].alias("markdown"))


@query(f"SELECT l_orderkey, string_agg(t, ' / ' ORDER BY line) AS rows FROM (SELECT l_orderkey, line, string_agg(l_partkey::VARCHAR, ' ' ORDER BY place) AS t FROM {GRID} GROUP BY l_orderkey, line) GROUP BY l_orderkey")
def q50_visual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes as lines: those side by side are one visual row."""
    line = F.struct(F.col("l_partkey").cast("string").alias("text"), "box", F.lit(None).cast("double").alias("score"))
    pages = grid(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    return pages.select("l_orderkey", F.array_join(N.rows_of(F.col("lines")), " / ").alias("rows"))


#: Markers 60 apart; every fifth line begins 150 to the side, and the fourth is followed by a gap of 200.
NUMBERED = """(SELECT l_orderkey, i, CASE WHEN l_partkey % 2 = 0 THEN i || ') ' || l_partkey ELSE 'more ' || l_partkey END AS t, l_partkey % 2 = 0 AS marked, CASE WHEN l_partkey % 5 = 0 THEN 250 ELSE 100 END AS x, i * 60 + CASE WHEN i > 4 THEN 200 ELSE 0 END AS y
FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem))"""


@query(f"""WITH p AS (SELECT *, sum(marked::INT) OVER w AS island, sum(marked::INT) OVER (PARTITION BY l_orderkey) AS marks FROM {NUMBERED} WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)),
q AS (SELECT *, first(x) OVER v AS left_x, first(i) OVER v AS first_i FROM p WINDOW v AS (PARTITION BY l_orderkey, island ORDER BY i)),
k AS (SELECT *, marked OR abs(x - left_x) <= 100 AS beside FROM q WHERE marks >= 3 AND island > 0),
b AS (SELECT *, max(CASE WHEN beside THEN y + 40 END) OVER (PARTITION BY l_orderkey, island ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bottom FROM k),
c AS (SELECT *, max((NOT marked AND y - bottom > 90)::INT) OVER (PARTITION BY l_orderkey, island ORDER BY i) AS ended FROM b)
SELECT l_orderkey, max(first_i)::INT AS number, string_agg(t, ' ' ORDER BY i) AS text FROM c WHERE ended = 0 AND beside GROUP BY l_orderkey, island""")
def q51_numbered_paragraphs_of_a_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered paragraphs with the rules of gaps and sides, by the fold over a page."""
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", i.alias("i"))
    part, x = F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 5 == 0, 250.0).otherwise(100.0)
    y = F.col("i") * 60.0 + F.when(F.col("i") > 4, 200.0).otherwise(0.0)
    text = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.col("i").cast("string"), F.lit(") "), part)).otherwise(F.concat(F.lit("more "), part))
    line = F.struct(text.alias("text"), F.array(x, y, x + 300, y + 40).alias("box"), F.lit(None).cast("double").alias("score"))
    pages = rows.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    return pages.select("l_orderkey", F.explode(N.numbered_of(F.col("lines"))).alias("p")).select("l_orderkey", "p.number", "p.text")


@query("""WITH p AS (SELECT s_suppkey, x, y, (s_suppkey * 7 + x * 40 + y * 25) % 256 AS r, least(255, (s_suppkey * 7 + x * 40 + y * 25) % 256 + s_suppkey % 30) AS b FROM supplier, range(0, 6) t(x), range(0, 3) u(y)),
q AS (SELECT *, r * 0.2126::DOUBLE + r * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS light, b - r AS chroma FROM p), s AS (SELECT *, least(greatest((light - 150) / 55, 0.0), 1.0) AS t FROM q)
SELECT s_suppkey, x::INT AS x, y::INT AS y, (CASE WHEN chroma > 18 OR light <= 150 THEN r ELSE floor(r + (255 - r) * (t * t * (3 - 2 * t)) + 0.5) END)::INT AS red, (CASE WHEN chroma > 18 OR light <= 150 THEN b ELSE floor(b + (255 - b) * (t * t * (3 - 2 * t)) + 0.5) END)::INT AS blue FROM s""")
def q52_suppressed_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 6 x 3 pixels, some tinted, through the conservative preset, pixel by pixel."""
    two = lambda v: F.lpad(F.hex(v.cast("int")), 2, "0")
    base = lambda i: (F.col("s_suppkey") * 7 + (i % 6) * 40 + F.floor(i / 6) * 25) % 256
    pixel = lambda i: F.concat(two(base(i)), two(base(i)), two(F.least(F.lit(255), base(i) + F.col("s_suppkey") % 30)))
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(17)), pixel), ""))
    rasters = table(spark, sf_dir, "supplier").select("s_suppkey", suppressed(F.struct(F.lit(6).alias("width"), F.lit(3).alias("height"), data.alias("data")), "conservative").alias("image"))
    return pixels(rasters, "image", "s_suppkey").select("s_suppkey", "x", "y", "red", "blue")


SURPLUS = "'3. terms 3.1 scope 1) ' || p_name || ' is a definition that goes on for quite a while here 2) ' || p_brand || ' too'"


@query(f"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td>e</td><td>f</td></tr></table>' || chr(10) || chr(10) || '3. terms' || chr(10) || chr(10) || '3.1 scope' || chr(10) || chr(10) || '1\\) ' || p_name ||
' is a definition that goes on for quite a while here' || chr(10) || chr(10) || '2\\) ' || p_brand || ' too' ELSE '<table><tr><td>a</td><td>b</td><td rowspan="2">' || {SURPLUS} || '</td></tr><tr><td>c</td><td>d</td></tr><tr><td>e</td><td>f</td></tr></table>' END AS markdown FROM part""".replace("\\\\", "\\"))
def q53_text_beside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with body text in a surplus cell: it leaves those where that cell spans three rows, and stays in the others."""
    from foliospark.operators.repair import repaired
    from foliospark.schemas import BLOCK, BOX, LINE

    text = F.concat(F.lit("3. terms 3.1 scope 1) "), "p_name", F.lit(" is a definition that goes on for quite a while here 2) "), "p_brand", F.lit(" too"))
    span = F.when(F.col("p_size") % 2 == 0, "3").otherwise("2")
    md = F.concat(F.lit('<table><tr><td>a</td><td>b</td><td rowspan="'), span, F.lit('">'), text, F.lit("</td></tr><tr><td>c</td><td>d</td></tr><tr><td>e</td><td>f</td></tr></table>"))
    empty = lambda kind: F.array().cast(f"ARRAY<{kind}>")
    return table(spark, sf_dir, "part").select("p_partkey", repaired(md, empty(LINE), empty(LINE), empty(BLOCK), empty(BOX), F.lit(1.0), F.lit(1.0)).alias("markdown"))


@query("""SELECT p_partkey, '![a](assets/page-' || lpad((p_size)::VARCHAR, 4, '0') || '/' || p_brand || '.png) and ![b](assets/page-' || lpad((p_size)::VARCHAR, 4, '0') || '/' || lower(p_brand) || '-2.png)' AS markdown, CASE WHEN p_size % 2 = 0 THEN '![추출 이미지](x.png)' WHEN p_size % 3 = 0 THEN p_name ELSE '' END AS block FROM part""")
def q54_relinked_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two assets of a page whose names differ in case only, renamed and linked anew; and single blocks as Markdown."""
    from foliospark.operators.assemble import asset_targets, relinked

    files = F.array(F.concat(F.lit("/x/"), "p_brand", F.lit(".png")), F.concat(F.lit("C:\\y\\"), F.lower("p_brand"), F.lit(".png")))
    none = F.lit(None).cast("string")
    block = F.struct(F.when(F.col("p_size") % 2 == 0, "figure").otherwise("text").alias("type"), none.alias("markdown"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), "p_name", F.lit("\n"))).alias("content"), F.when(F.col("p_size") % 2 == 0, "x.png").alias("asset_path"), F.lit(" ").alias("alt"))
    rows = table(spark, sf_dir, "part").select("p_partkey", asset_targets(files, F.col("p_size")).alias("to"), block.alias("block"))
    text = relinked(F.lit("![a](imgs/one.png) and ![b](imgs/two.png)"), F.array(F.lit("imgs/one.png"), F.lit("imgs/two.png")), F.col("to"))
    return rows.select("p_partkey", text.alias("markdown"), L.markdown_of(F.col("block")).alias("block"))


@query(rf"""SELECT l_orderkey, (CASE WHEN instr(chr(10) || t, chr(10) || '3) ') > 0 THEN greatest(instr(chr(10) || t, chr(10) || '3) ') - 2, 0) ELSE -1 END)::INT AS place, length(n) >= 8 AND left(n, 8) = 'part1234' AS same
FROM (SELECT l_orderkey, t, {NORM.format("regexp_replace(t, '^[0-9]+[)] ', '')")} AS n FROM (SELECT l_orderkey, string_agg(t, chr(10) ORDER BY i) AS t FROM {LINES_SQL} GROUP BY l_orderkey))""")
def q55_marker_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = page_lines(spark, sf_dir).groupBy("l_orderkey").agg(R.ordered_concat(F.col("t"), "\n", F.col("i")).alias("t"))
    return md.select("l_orderkey", T.marker_place(F.col("t"), F.lit(3)).cast("int").alias("place"), T.same_start(F.regexp_replace("t", r"^[0-9]+\) ", ""), F.lit("Part 1234!")).alias("same"))


@query("""WITH p AS (SELECT p_partkey, p_size % 4 AS pages, p_size % 3 AS tables, p_size % 5 <> 0 AS ordered, p_size % 7 = 0 AS leaks, p_size % 2 = 0 AS spans FROM part)
SELECT p_partkey, pages = 2 AS "twoPages", tables >= 2 AS "twoTables", ordered AND tables > 0 AS "tableBeforeAdjacentText", NOT leaks AS "watermarkSuppressed", spans AND tables > 0 AS "rowspanPreserved", tables >= 2 AS "atLeastTwoFigureAssets",
round((CASE WHEN tables > 0 THEN 3 ELSE 0 END + CASE WHEN tables > 0 OR ordered THEN 0 ELSE 0 END + 1) / 11, 4)::DOUBLE AS "requiredMarkerRecall" FROM p""")
def q56_evaluation_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made of the acceptance document's phrases, some of them spoilt: the criteria by which they pass."""
    from foliospark.operators.evaluate import evaluated

    n = F.col("p_size")
    times = lambda text, k: F.repeat(text, k.cast("int"))
    cell = F.when(n % 2 == 0, '<td rowspan="2">').otherwise("<td>")
    one = F.concat(F.lit("<table><tr>"), cell, F.lit("A-01</td>"), cell, F.lit("OCR-1</td><td>설비 점검 현황</td></tr></table>\n![f](a.png)\n"))
    tables, after = times(one, n % 3), F.lit("## 운영 요약\n")
    md = F.concat(times(F.lit("<!-- page: 1 -->\n"), n % 4), F.when(n % 5 != 0, F.concat(tables, after)).otherwise(F.concat(after, tables)), F.when(n % 7 == 0, "S A M P L E").otherwise(""))
    found = evaluated(spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", md.alias("actual"), F.lit("x").alias("expected")))
    return found.select("p_partkey", *(f"criteria.{c}" for c in ("twoPages", "twoTables", "tableBeforeAdjacentText", "watermarkSuppressed", "rowspanPreserved", "atLeastTwoFigureAssets")), "metrics.requiredMarkerRecall")


#: The acceptance document's first words, without and with white space, and its syllables as single bytes: the distance in SQL counts bytes.
HEAD, BARE = "월간 품질 점검 보고서 QA-2026-0720 B-07 회색 워터마크 대비 설비 운영 현황 SCAN-2 TABLE-SIDE-TEXT", "월간품질점검보고서QA-2026-0720B-07회색워터마크대비설비운영현황SCAN-2TABLE-SIDE-TEXT"
AS_BYTES = "translate({0}, '월간품질점검보고서회색워터마크대비설운영현황사구분요약', '!#$%&()+,./:;=?@[]FGHJKMPUVW')"


@query(f"""WITH d AS (SELECT p_partkey, p_partkey % 5 = 0 AS short, p_partkey % 3 <> 0 AS tall, p_partkey % 4 <> 0 AS broad, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '{BARE}' END || 'A-01OCR-1검사구분설비점검현황ab운영요약' || replace(repeat(p_name, (p_size % 4)::INT), ' ', '') AS a, '{BARE}A-01OCR-1검사구분설비점검현황ab운영요약' AS e FROM part),
r AS (SELECT *, levenshtein({AS_BYTES.format("e")}, {AS_BYTES.format("a")})::DOUBLE / length(e) AS rate FROM d)
SELECT p_partkey, round(rate, 4) AS "characterErrorRate", round(CASE WHEN short THEN 4 ELSE 11 END / 11.0, 4)::DOUBLE AS "requiredMarkerRecall", true AS "twoPages", rate <= 0.25 AS "textCerAtMost25Percent", NOT short AS "requiredMarkerRecallAtLeast80Percent", true AS "twoTables", tall AS "rowspanPreserved", broad AS "colspanPreserved",
true AS "tableBeforeAdjacentText", true AS "atLeastTwoFigureAssets", true AS "watermarkSuppressed", rate <= 0.25 AND NOT short AND tall AND broad AS passed FROM r""")
def q74_evaluation_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acceptance document read more or less well: without its first words, with cells that are not merged, with a part's name behind it."""
    from foliospark.operators.evaluate import evaluated

    k = F.col("p_partkey")
    rows, columns = F.when(k % 3 != 0, "2").otherwise("1"), F.when(k % 4 != 0, "3").otherwise("1")
    cell = lambda kind, n, text: F.concat(F.lit(f'<td {kind}="'), n, F.lit(f'">{text}</td>'))
    one = lambda *cells: F.concat(F.lit("<table><tr>"), *cells, F.lit("</tr></table>\n\n"))
    body = F.concat(one(cell("rowspan", rows, "A-01"), cell("rowspan", rows, "OCR-1")), F.lit("<!-- page: 2 -->\n\n"), one(cell("colspan", columns, "검사 구분"), cell("colspan", columns, "설비 점검 현황")), F.lit("![a](x.png) ![b](y.png)\n\n## 운영 요약\n"))
    head = F.lit(f"<!-- page: 1 -->\n\n# {HEAD}\n\n")
    read = F.concat(F.when(k % 5 == 0, "<!-- page: 1 -->\n\n").otherwise(head), body, F.repeat("p_name", (F.col("p_size") % 4).cast("int")))
    found = evaluated(spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", read.alias("actual"), F.concat(head, body).alias("expected")))
    return found.select("p_partkey", "metrics.characterErrorRate", "metrics.requiredMarkerRecall", "criteria.*", "passed")


@query("""SELECT n_name, count(*)::BIGINT AS orders, sum(o_totalprice)::DECIMAL(18, 2)::DOUBLE AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def q46_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


from foliospark.plans import documents  # noqa: E402, F401  registers its queries
