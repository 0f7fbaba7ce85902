"""Queries over single functions, sources and sinks; tables that hold other things stand in for their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import pages as P
from folioflow.operators import providers as PR
from folioflow.operators import routing as M
from folioflow.plans import pages as PP
from folioflow.runtime import scratch, table
from folioflow.sources import files as S


def text_segments(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs and sentences of every document."""
    t = table(spark, d, "documents").filter(F.col("text").isNotNull())
    p, s = X.paragraphs(F.col("text")), X.sentences(F.col("text"))
    return t.select("doc_id", F.size(p).cast("bigint").alias("paragraphs"), F.md5(F.array_join(p, "|")).alias("paragraphs_md5"), F.size(s).cast("bigint").alias("sentences"), F.md5(F.array_join(s, "|")).alias("sentences_md5"))


def block_types(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of text blocks by size of type; names and sizes of parts stand in for blocks."""
    size = F.pmod(F.col("p_size"), F.lit(20)) + 2
    layout = P.layout_type(size)
    text = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("- "), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", P.block_type(text, size).alias("block_type"), layout["element_type"].alias("element_type"), layout["level"].alias("level"))


def table_texts(spark: SparkSession, d: str) -> DataFrame:
    """The nations of each region as a table in Markdown and CSV, names with commas and quotes among them."""
    name = F.when(F.col("n_nationkey") % 7 == 0, F.concat(F.lit('a "'), F.col("n_name"), F.lit('", b'))).otherwise(F.col("n_name"))
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), name, F.when(F.col("n_nationkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("x"))).alias("cells"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("rows"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("mark"))), F.col("rows"))
    return rows.select("n_regionkey", P.markdown_table(cells).alias("markdown"), P.csv_table(cells).alias("csv"))


def figure_types(spark: SparkSession, d: str) -> DataFrame:
    """Class and resolution of figures; titles of documents stand in for captions, sizes come from lengths."""
    t = table(spark, d, "documents").filter(F.col("n_chars").isNotNull())
    width = F.pmod(F.col("n_chars"), F.lit(900)) + 1
    return t.select("doc_id", P.figure_type(F.concat_ws(" ", "title", "document_type", F.when(F.col("doc_id") % 4 == 0, "x-ray").when(F.col("doc_id") % 4 == 1, "flow")), width.cast("double"), F.lit(200.0)).alias("figure_type"), P.figure_dpi(width * 5, F.lit(300)).alias("dpi"))


def captions(spark: SparkSession, d: str) -> DataFrame:
    """The caption nearest below an image on each page; parts of a brand and type stand in for the blocks of a page."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Fig. "), F.col("p_name"))).otherwise(F.col("p_name"))
    block = F.struct(text.alias("text"), (F.col("p_size") * 7.0).alias("y0"))
    pages = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.collect_list(block).alias("blocks"))
    return pages.select("p_brand", "p_type", P.nearest_caption(F.col("blocks"), F.lit(100.0)).alias("caption"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Width, height, area and validity of boxes; numbers of line items stand in for corners."""
    b = P.box_area(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 300 + 0.25, F.lit(5.5))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(b["width"], 6).alias("width"), F.round(b["height"], 6).alias("height"), F.round(b["area"], 6).alias("area"), b["valid"].alias("valid"))


def merged_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a document's pages as read by two strategies, confidence weighted by blocks."""
    v = PP._pages(spark, d).filter((F.col("ocr_confidence") >= 0) & F.col("duplicates_found").isNotNull())
    part = F.struct("page_number", (F.col("duplicates_found") + 1).cast("double").alias("blocks"), "ocr_confidence", F.when(F.col("page_number") % 4 == 0, " ").otherwise(F.concat(F.lit("page "), F.col("page_number").cast("string"))).alias("text"))
    g = v.groupBy("document_id").agg(F.array_sort(F.collect_list(part)).alias("x"))
    m = P.merge_strategies(F.transform("x", lambda p: p["text"]), F.transform("x", lambda p: p["blocks"]), F.transform("x", lambda p: p["ocr_confidence"]))
    return g.select("document_id", m["text"].alias("text"), m["confidence"].alias("confidence"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    """Times in words, the scheduler's share and energy a page, from prices of orders."""
    seconds = F.col("o_totalprice") / 10
    over = P.scheduler_overhead(F.col("o_custkey").cast("double"), seconds)
    return table(spark, d, "orders").select("o_orderkey", X.duration(seconds).alias("said"), over["light"].alias("light"), F.round(over["percent"], 6).alias("percent"), F.round(P.energy_per_page(F.lit(65.0), seconds, F.pmod(F.col("o_custkey"), F.lit(9))), 6).alias("joules"))


def pdf_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates in the form of PDF files read back, and malformed ones."""
    said = F.when(F.col("o_orderkey") % 10 == 0, "D:2020").otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+00'00'")))
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(X.pdf_date(said).cast("timestamp")).alias("at_s"))


def archive_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of articles in an archive by the digits of their number."""
    article = F.when(F.col("c_custkey") % 11 == 0, "none").otherwise(F.concat(F.lit("PMC"), (F.col("c_custkey") * 37).cast("string")))
    return table(spark, d, "customer").select("c_custkey", X.archive_url(article, "https://archive.example/pdf").alias("url"))


def unique_files(spark: SparkSession, d: str) -> DataFrame:
    """Of equal files that begin as PDF does the first; texts of documents stand in for contents."""
    t = table(spark, d, "documents").filter(F.col("text").isNotNull())
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, "%PDF-").otherwise("text:"), F.col("text")).cast("binary")
    files = t.select(F.format_string("/in/%08d.pdf", "doc_id").alias("path"), F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))
    return S.unique_downloads(files).select("checksum", "path", "length")


def article_records(spark: SparkSession, d: str) -> DataFrame:
    """Title, journal and year out of stored XML records; what has no title is left out."""
    safe = F.regexp_replace(F.coalesce("title", F.lit("")), "[<>&]", "")
    t = table(spark, d, "documents")
    xml = F.concat(F.lit("<article><journal-title>"), F.coalesce("source", F.lit("")), F.lit("</journal-title><article-title>"), safe, F.lit("</article-title><pub-date><year>"), F.coalesce(F.year("created_at").cast("string"), F.lit("0")), F.lit("</year></pub-date></article>"))
    return S.xml_articles(t.select("doc_id", xml.alias("xml")), "xml").select("doc_id", "title", "journal", "year")


def metadata_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Metadata written as CSV and read back, null as an empty field."""
    path = scratch(spark, "metadata")
    m = PP._meta(spark, d)
    S.write_metadata(m, path)
    back = S.read_metadata(spark, path)
    return back.select("document_id", "file_path", "pages", "estimated_size_mb", "resolution_dpi", "source_type", "language", F.unix_seconds("processing_timestamp").alias("processed_s"))


def cases_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation cases written as JSON and read back."""
    path = scratch(spark, "cases")
    S.write_cases(table(spark, d, "eval_cases"), path)
    return S.read_cases(spark, path)


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Requested files that the metadata cache has, and those it lacks."""
    m = PP._meta(spark, d)
    asked = table(spark, d, "chunks").select(F.col("document_id").alias("document")).distinct().join(m, F.col("document") == F.col("document_id"), "left").select(F.coalesce("file_path", F.concat(F.lit("/none/"), F.col("document"))).alias("file_path"))
    had, lacking = S.cached_or_missing(asked, m.filter(F.col("pages") > 5))
    return had.select("file_path").distinct().select("file_path", F.lit(True).alias("cached")).unionByName(lacking.select("file_path", F.lit(False).alias("cached")))


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The embedding cache after its newer half was put into its older half."""
    c = table(spark, d, "embedding_cache").filter(F.col("cache_key").isNotNull() & F.col("created_at").isNotNull()).select("cache_key", "vector_bytes", "created_at")
    late = F.dayofyear("created_at") % 2 == 1
    both = S.upsert_cache(c.filter(~late), c.filter(late))
    return both.groupBy("cache_key").agg(F.max(F.unix_micros("created_at")).alias("created_us"))


def build_report(spark: SparkSession, d: str) -> DataFrame:
    """Articles with the file that bears their name; every second document is an article."""
    m = PP._meta(spark, d)
    articles = m.filter(F.pmod(F.xxhash64("document_id"), F.lit(1)) == 0).select(F.col("document_id").alias("article_id")).unionByName(spark.createDataFrame([("none",)], "article_id string"))
    return S.build_report(articles, m.select("file_path", "pages")).select("article_id", "file_path", "pages")


def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A log appended to twice, nested columns left out, read back."""
    path = scratch(spark, "log")
    v = table(spark, d, "page_validation").select("document_id", "page_number", "passed", "issue_codes", "duplicates_found")
    S.append_log(v.filter("page_number % 2 = 0"), path)
    S.append_log(v.filter("page_number % 2 = 1"), path)
    back = spark.read.schema("document_id string, page_number int, passed boolean, duplicates_found int").option("header", "true").csv(path)
    return back.groupBy("document_id").agg(F.count("*").alias("lines"), F.count_if("passed").alias("passed"), F.sum("duplicates_found").alias("duplicates"))


def reading_strategies(spark: SparkSession, d: str) -> DataFrame:
    """How many pages are read in which way."""
    return PP.page_types(spark, d).select(M.reading_strategy(F.col("page_type")).alias("strategy")).groupBy("strategy").agg(F.count("*").alias("pages"))


def corpus_selection(spark: SparkSession, d: str) -> DataFrame:
    """Three classes of documents, interleaved, and a pool that is gone round twice and a half times."""
    m = PP._meta(spark, d).filter(F.col("pages") > 0).select("document_id", "pages")
    kinds = [m.filter(F.col("pages") <= 5), m.filter((F.col("pages") > 5) & (F.col("pages") <= 12)), m.filter(F.col("pages") > 12)]
    mixed = PR.interleaved(kinds, "document_id").select("position", "document_id", F.lit("mixed").alias("pool"))
    return mixed.unionByName(PR.cycled(m.select("document_id").filter(F.col("pages") > 30), "document_id", 25).select("position", "document_id", F.lit("cycled").alias("pool")))


def embedding_classes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts of chunks embedded once: length and first places of their vectors."""
    made = PR.embed_texts(PP._chunks(spark, d), "chunk_id", "text", PR.hashing_embedder())
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return made.select("chunk_id", F.size("vector").cast("bigint").alias("places"), total.alias("total"), F.col("vector")[0].cast("double").alias("first"))


_SIGN = "CASE WHEN substr(md5(t), 3, 1) < '8' THEN 1 ELSE -1 END"
_PLACE = "((strpos('0123456789abcdef', substr(md5(t), 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5(t), 2, 1)) - 1) % 64"
_PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array(text, '\\n[\\s\\x0B]*\\n+'), lambda x: {PP._TRIM}), lambda x: x <> '')"
_CELLS = "[CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 7 = 0 THEN 'a \"' || n_name || '\", b' ELSE n_name END, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'x' END]"

QUERIES = {f.__name__: f for f in (
    text_segments, block_types, table_texts, figure_types, captions, boxes, merged_strategies, durations, pdf_dates, archive_urls, unique_files, article_records, metadata_round_trip, cases_round_trip,
    cache_lookup, cache_upsert, build_report, log_round_trip, reading_strategies, corpus_selection, embedding_classes,
)}
SQL = {
    "text_segments": f"SELECT doc_id, len(p) AS paragraphs, md5(array_to_string(p, '|')) AS paragraphs_md5, len(s) AS sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, {_PARAGRAPHS} AS p, {PP._SENTENCES.format('text')} AS s FROM documents WHERE text IS NOT NULL)",
    "block_types": "WITH b AS (SELECT p_partkey, p_size % 20 + 2 AS z, p_partkey % 5 = 0 AS bullet FROM part) SELECT p_partkey, CASE WHEN z >= 14 THEN 'heading' WHEN z <= 8 THEN 'footnote' WHEN bullet THEN 'list_item' ELSE 'text' END AS block_type, CASE WHEN z >= 13 THEN 'heading' WHEN z <= 8.5 THEN 'footnote' ELSE 'paragraph' END AS element_type, CAST(CASE WHEN z >= 16 THEN 1 WHEN z >= 14 THEN 2 WHEN z >= 13 THEN 3 END AS INTEGER) AS level FROM b",
    "table_texts": f"""WITH r AS (SELECT n_regionkey, n_nationkey, {_CELLS} AS c FROM nation) SELECT n_regionkey, '| key | name | mark |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || array_to_string(c, ' | ') || ' |', chr(10) ORDER BY n_nationkey) AS markdown,
  'key,name,mark' || chr(10) || string_agg(array_to_string(list_transform(c, lambda x: CASE WHEN regexp_matches(x, '[",\\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END), ','), chr(10) ORDER BY n_nationkey) AS csv FROM r GROUP BY n_regionkey""",
    "figure_types": "WITH t AS (SELECT doc_id, lower(concat_ws(' ', title, document_type, CASE doc_id % 4 WHEN 0 THEN 'x-ray' WHEN 1 THEN 'flow' END)) AS c, n_chars % 900 + 1 AS w FROM documents WHERE n_chars IS NOT NULL) SELECT doc_id, CASE WHEN regexp_matches(c, 'chart|graph|plot|histogram') THEN 'chart' WHEN regexp_matches(c, 'diagram|flow|schema|architecture') THEN 'diagram' WHEN regexp_matches(c, 'photo|image|picture|scan|x-ray') THEN 'photograph' WHEN w / 200.0::DOUBLE > 2.5 THEN 'chart' ELSE 'unknown' END AS figure_type, greatest(72, CAST(floor(w * 5 / 300.0::DOUBLE * 72) AS INTEGER)) AS dpi FROM t",
    "captions": "WITH b AS (SELECT p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN 'Fig. ' || p_name END AS x, abs(p_size * 7.0::DOUBLE - 100) AS far FROM part) SELECT p_brand, p_type, (min({'far': far, 'x': x}) FILTER (x IS NOT NULL AND far < 50)).x AS caption FROM b GROUP BY 1, 2",
    "boxes": "WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 300 + 0.25::DOUBLE - l_quantity AS w, 5.5::DOUBLE - l_tax * 100 AS h FROM lineitem) SELECT l_orderkey, l_linenumber, round(w, 6) AS width, round(h, 6) AS height, round(w * h, 6) AS area, w > 0 AND h > 0 AS valid FROM b",
    "merged_strategies": f"SELECT document_id, coalesce(string_agg(CASE WHEN page_number % 4 <> 0 THEN 'page ' || page_number END, chr(10) ORDER BY page_number), '') AS text, round(sum((duplicates_found + 1)::DOUBLE * ocr_confidence ORDER BY page_number) / sum((duplicates_found + 1)::DOUBLE), 3) AS confidence FROM ({PP._PG}) WHERE ocr_confidence >= 0 AND duplicates_found IS NOT NULL GROUP BY document_id",
    "durations": "WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice / 10 AS x, CAST(floor(o_totalprice / 10) AS INTEGER) AS s FROM orders) SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS said, CASE WHEN x > 0 THEN o_custkey / x ELSE 0 END < 0.01 AS light, round(CASE WHEN x > 0 THEN o_custkey / x ELSE 0 END * 100, 6) AS percent, round(CASE WHEN o_custkey % 9 > 0 THEN 65.0::DOUBLE * x / (o_custkey % 9) END, 6) AS joules FROM t",
    "pdf_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN epoch_us(o_orderdate) // 1000000 END AS at_s FROM orders",
    "archive_urls": "WITH a AS (SELECT c_custkey, CAST(c_custkey * 37 AS VARCHAR) AS n FROM customer), p AS (SELECT *, CASE WHEN length(n) < 4 THEN lpad(n, 4, '0') ELSE n END AS z FROM a) SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'https://archive.example/pdf/' || right(z, 2) || '/' || left(right(z, 4), 2) || '/PMC' || n || '.pdf' END AS url FROM p",
    "unique_files": "WITH f AS (SELECT printf('/in/%08d.pdf', doc_id) AS path, '%PDF-' || text AS content FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0) SELECT md5(content) AS checksum, min(path) AS path, CAST(min(strlen(content)) AS BIGINT) AS length FROM f GROUP BY 1",
    "article_records": "SELECT doc_id, regexp_replace(title, '[<>&]', '', 'g') AS title, coalesce(source, '') AS journal, CAST(coalesce(year(created_at), 0) AS INTEGER) AS year FROM documents WHERE regexp_replace(coalesce(title, ''), '[<>&]', '', 'g') <> ''",
    "metadata_round_trip": f"SELECT document_id, file_path, pages, estimated_size_mb, resolution_dpi, source_type, language, epoch_us(processing_timestamp) // 1000000 AS processed_s FROM ({PP._META})",
    "cases_round_trip": "SELECT case_id, question, passage, relevant_document_ids, relevant_chunk_ids, category, description FROM eval_cases",
    "cache_lookup": f"WITH m AS ({PP._META}), a AS (SELECT DISTINCT coalesce(m.file_path, '/none/' || c.document_id) AS file_path FROM (SELECT DISTINCT document_id FROM chunks) c LEFT JOIN m ON c.document_id = m.document_id WHERE c.document_id IS NOT NULL) SELECT file_path, file_path IN (SELECT file_path FROM m WHERE pages > 5 AND file_path IS NOT NULL) AS cached FROM a",
    "cache_upsert": "SELECT cache_key, max(epoch_us(created_at)) AS created_us FROM embedding_cache WHERE cache_key IS NOT NULL AND created_at IS NOT NULL GROUP BY 1",
    "build_report": f"WITH m AS ({PP._META}), f AS (SELECT regexp_replace(regexp_extract(file_path, '([^/\\\\]*)$', 1), '\\.[^.]+$', '') AS stem, file_path, pages FROM m) SELECT article_id, file_path, pages FROM (SELECT document_id AS article_id FROM m UNION ALL SELECT 'none') LEFT JOIN f ON article_id = stem",
    "log_round_trip": "SELECT document_id, count(*) AS lines, count(*) FILTER (passed) AS passed, CAST(sum(duplicates_found) AS BIGINT) AS duplicates FROM page_validation WHERE page_number IS NOT NULL GROUP BY 1",
    "reading_strategies": f"WITH {PP._FEAT} SELECT CASE page_type WHEN 'scanned' THEN 'ocr' WHEN 'mixed' THEN 'mixed' ELSE 'direct_text' END AS strategy, count(*) AS pages FROM t GROUP BY 1",
    "corpus_selection": f"""WITH m AS (SELECT document_id, pages FROM ({PP._META}) WHERE pages > 0), c AS (SELECT document_id, CASE WHEN pages <= 5 THEN 0 WHEN pages <= 12 THEN 1 ELSE 2 END AS k FROM m), t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY document_id) AS turn FROM c),
pool AS (SELECT document_id, row_number() OVER (ORDER BY document_id) - 1 AS p FROM m WHERE pages > 30), n AS (SELECT count(*) AS n FROM pool)
SELECT row_number() OVER (ORDER BY turn, k) - 1 AS position, document_id, 'mixed' AS pool FROM t UNION ALL SELECT i, document_id, 'cycled' FROM (SELECT unnest(range(0, 25)) AS i) x, n JOIN pool ON pool.p = i % n""",
    "embedding_classes": f"""WITH x AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM ({PP._CH}) WHERE text IS NOT NULL), v AS (SELECT chunk_id, sum({_SIGN})::DOUBLE AS total, coalesce(sum({_SIGN}) FILTER ({_PLACE} = 0), 0)::DOUBLE AS first FROM x GROUP BY 1)
SELECT c.chunk_id, 64::BIGINT AS places, coalesce(v.total, 0) AS total, coalesce(v.first, 0) AS first FROM ({PP._CH}) c LEFT JOIN v USING (chunk_id) WHERE c.text IS NOT NULL""",
}
