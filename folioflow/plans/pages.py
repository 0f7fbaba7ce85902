"""Queries over pages, documents, metadata and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import chunking as C
from folioflow.operators import pages as P
from folioflow.operators import routing as M
from folioflow.operators import scheduling as Q
from folioflow.plans import telemetry
from folioflow.runtime import table


def _meta(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "doc_metadata")
    return P.first_wins(m, ["document_id"], [F.col("processing_timestamp").asc_nulls_last(), F.col("pages").asc_nulls_last()])


def _pages(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "page_validation")
    return P.first_wins(v, ["document_id", "page_number"], [F.col("validated_at").asc_nulls_last(), F.col("ocr_confidence").asc_nulls_last()])


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return P.first_wins(table(spark, d, "chunks"), ["chunk_id"], [F.col("chunk_index"), F.col("text")])


def doc_summary(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("passed") & (F.col("ocr_confidence") >= 0)
    seconds = F.sum("validation_time_seconds")
    return _pages(spark, d).groupBy("document_id").agg(
        F.count("*").alias("pages"), F.count_if("passed").alias("passed"), F.coalesce(F.round(F.avg(F.when(ok, F.col("ocr_confidence"))), 4), F.lit(1.0)).alias("confidence"),
        F.round(seconds, 6).alias("seconds"), F.round(X.ratio(F.count("*").cast("double"), seconds), 2).alias("pages_per_second"),
    )


def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("passed").isNull(), "pending").when(F.col("passed"), "completed").otherwise("failed")
    return _pages(spark, d).withColumn("state", state).groupBy("document_id").pivot("state", ["completed", "failed", "pending"]).count().na.fill(0)


def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    source = F.coalesce(F.col("source_type"), F.lit("unknown"))
    return _meta(spark, d).groupBy(source.alias("source_type")).agg(F.count("*").alias("documents"), F.sum(F.when(F.col("pages") > 0, F.col("pages"))).alias("pages"), F.round(F.avg(F.when(F.col("pages") > 0, F.col("pages"))), 2).alias("mean_pages"), F.round(F.avg("estimated_size_mb"), 4).alias("mean_mb"))


def metadata_stats(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("pages") > 0, F.col("pages"))
    return _meta(spark, d).agg(
        F.count("*").alias("documents"), F.coalesce(F.sum(p), F.lit(0)).alias("pages"), F.round(F.coalesce(F.avg(p), F.lit(0.0)), 4).alias("mean_pages"), F.coalesce(F.min(p), F.lit(0)).cast("bigint").alias("fewest"), F.coalesce(F.max(p), F.lit(0)).cast("bigint").alias("most"),
        F.round(F.sum("estimated_size_mb"), 2).alias("total_mb"), F.count_if(F.col("source_type") == "digital").alias("digital"), F.count_if(F.col("source_type") == "scanned").alias("scanned"), F.count_if(F.col("source_type").isNull() | (F.col("source_type") == "unknown")).alias("unknown"),
    )


def metadata_names(spark: SparkSession, d: str) -> DataFrame:
    return _meta(spark, d).select("document_id", X.file_stem(F.col("file_path")).alias("stem"), X.file_suffix(F.col("file_path")).alias("suffix"), X.language(F.col("language")).alias("language_code"))


def fulltext(spark: SparkSession, d: str) -> DataFrame:
    return P.full_texts(_chunks(spark, d), "document_id", ["chunk_index", "chunk_id"], "text").select("document_id", F.length("full_text").cast("bigint").alias("characters"), F.md5("full_text").alias("text_md5"))


def headings(spark: SparkSession, d: str) -> DataFrame:
    named = _chunks(spark, d).filter(F.trim(F.coalesce("section_heading", F.lit(""))) != "")
    each = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "section_heading"))), lambda x: x["section_heading"])
    return named.groupBy("document_id").agg(F.slice(each, 1, 50).alias("headings"), F.min_by("section_heading", F.struct("chunk_index", "chunk_id")).alias("title"))


def current_heading(spark: SparkSession, d: str) -> DataFrame:
    return P.running_heading(_chunks(spark, d), "document_id", ["chunk_index", "chunk_id"], "section_heading").select("chunk_id", "current_heading")


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    cut = _chunks(spark, d).select("chunk_id", F.posexplode(X.pages(F.col("text"))).alias("part", "page"))
    return cut.select("chunk_id", F.col("part").cast("bigint").alias("part"), F.length("page").cast("bigint").alias("characters"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), X.chunk_key(F.col("document_id"), F.col("chunk_index")).alias("expected_id"))


def stale_counts(spark: SparkSession, d: str) -> DataFrame:
    n, w = F.length("text"), X.words(F.col("text"))
    return _chunks(spark, d).filter(F.col("text").isNotNull()).select("chunk_id", n.cast("bigint").alias("characters"), (~F.col("character_count").eqNullSafe(n)).alias("stale"), (w > 0).alias("has_words"))


def dup_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).filter(F.col("text").isNotNull()).select("chunk_id", P.duplicate_blocks(F.split("text", "[\n\f]")).cast("bigint").alias("duplicates"))


def page_characters(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, page_number, chars): characters of the chunks' text on each page, form feeds part the pages."""
    part = F.posexplode(F.split("text", "\f")).alias("at", "piece")
    cut = _chunks(spark, d).filter((F.size("page_numbers") > 0) & F.col("text").isNotNull()).select("document_id", "page_numbers", part)
    page = F.get("page_numbers", F.least(F.col("at"), F.size("page_numbers") - 1))
    return cut.groupBy("document_id", page.alias("page_number")).agg(F.sum(F.length("piece")).alias("chars"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Features of every validated page: characters as measured in the chunks.

    The tables hold no image share: the certainty of the recognition stands in for it, and the
    number of repeated blocks for the number of images.
    """
    density = F.when(F.col("ocr_confidence") >= 0, F.round(F.col("ocr_confidence") * 0.9, 4)).otherwise(F.lit(0.05))
    seen = _pages(spark, d).join(page_characters(spark, d), ["document_id", "page_number"], "left")
    return seen.select(
        "document_id", "page_number", density.alias("density"), F.coalesce("chars", F.lit(0)).cast("int").alias("chars"), (F.coalesce("duplicates_found", F.lit(0)) + 1).alias("images"), "ocr_confidence", F.col("confidence_valid").isNull().alias("direct"), "bbox_valid"
    )


def page_types(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d).withColumn("t", P.page_type(F.col("chars"), F.col("density")))
    return f.select("document_id", "page_number", "t.page_type", "t.confidence")


def dominant_type(spark: SparkSession, d: str) -> DataFrame:
    order = ["digital", "scanned", "mixed", "unknown"]
    n = page_types(spark, d).groupBy("document_id").agg(*[F.count_if(F.col("page_type") == x).alias(x) for x in order])
    best = F.greatest(*[F.col(x) for x in order])
    pick = F.when(F.col(order[0]) == best, order[0])
    for x in order[1:]:
        pick = pick.when(F.col(x) == best, x)
    return n.select("document_id", pick.alias("dominant"), best.alias("pages"))


def page_rules(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d).withColumn("t", P.page_type(F.col("chars"), F.col("density"))["page_type"])
    confidence = F.when(F.col("ocr_confidence") >= 0, F.col("ocr_confidence"))
    issues = P.page_issues(F.col("chars"), confidence, F.col("density"), F.col("t"), F.col("direct"), F.col("images") - 1, F.when(F.col("bbox_valid"), 0).otherwise(1))
    return f.select("document_id", "page_number", F.array_join(issues, ",").alias("issues"), P.passed(issues).alias("ok"))


def workload_cost(spark: SparkSession, d: str) -> DataFrame:
    scanned = (F.col("chars") < 20) & ((F.col("density") >= 0.4) | (F.col("images") > 0))
    f = _features(spark, d).withColumn("effort", M.complexity(scanned, F.col("chars"), F.col("density"), F.col("images"), F.lit(700.0 * 900.0)))
    return f.select("document_id", "page_number", "effort", F.round(F.lit(3) * (1.0 + 2.5 * F.col("effort")), 9).alias("units"), F.round(M.intensity(F.lit(700.0), F.lit(900.0), F.col("density"), F.col("effort"), F.col("chars")), 10).alias("intensity"))


def completeness(spark: SparkSession, d: str) -> DataFrame:
    seen = _pages(spark, d).groupBy("document_id").agg(F.count("*").alias("seen"))
    return _meta(spark, d).filter(F.col("pages") > 0).join(seen, "document_id", "left").select("document_id", F.col("pages").cast("bigint").alias("expected"), F.coalesce("seen", F.lit(0)).alias("seen"), (F.coalesce("seen", F.lit(0)) >= F.col("pages")).alias("complete"))


def workload_report(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pages").cast("double")
    std, mean = F.coalesce(F.stddev_samp(p), F.lit(0.0)), F.avg(p)
    cost = F.sum("pages") * 2.0
    a = _meta(spark, d).filter(F.col("pages") > 0).agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), mean.alias("mean"), F.percentile("pages", 0.5).alias("median"), std.alias("std"), cost.alias("cost"))
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0)
    return a.select("documents", "pages", F.round("mean", 4).alias("mean"), "median", F.round("std", 4).alias("std"), F.round(cv, 4).alias("cv"), "cost", Q.difficulty(cv).alias("difficulty"), F.greatest(F.lit(1), F.least(F.lit(64), F.ceil(F.col("cost") / 3600))).cast("bigint").alias("workers"))


def queue_drain(spark: SparkSession, d: str) -> DataFrame:
    return Q.drain_order(_meta(spark, d).filter(F.col("pages") > 0), "pages", "document_id").select("document_id", "pages", "drain")


def dispatch_plan(spark: SparkSession, d: str) -> DataFrame:
    """Each unit of the queue to the available node with the least in flight."""
    nodes = telemetry.worker_states(spark, d).filter("available").select(F.col("node_id").alias("worker_id"), F.col("depth").alias("in_flight"))
    return Q.dispatch(queue_drain(spark, d), nodes).select("document_id", "drain", "worker_id")


def lpt_partition(spark: SparkSession, d: str) -> DataFrame:
    return Q.longest_first_partition(_meta(spark, d), "document_id", "pages", 6)


def partition_stats(spark: SparkSession, d: str) -> DataFrame:
    """How even the partitions of ``lpt_partition`` are, and when they are done at half a page a second."""
    loads = lpt_partition(spark, d).groupBy("worker_id").agg(F.sum("pages").cast("double").alias("load"))
    a = loads.agg(F.var_pop("load").alias("variance"), F.stddev_pop("load").alias("std"), F.avg("load").alias("mean"), F.max("load").alias("most"), F.min("load").alias("least"))
    return a.select(
        F.round("variance", 4).alias("variance"), F.round("std", 4).alias("std"), F.round(P.balance(F.col("std"), F.col("mean")), 4).alias("balance"), F.round(F.when(F.col("least") > 0, F.col("most") / F.col("least")), 4).alias("imbalance"),
        F.round(P.completion_seconds(F.col("most"), F.lit(0.5)), 2).alias("seconds"),
    )


def document_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Totals over documents, and means of their rates, each document counting alike."""
    seconds = F.sum("validation_time_seconds")
    per = _pages(spark, d).groupBy("document_id").agg(F.count("*").cast("double").alias("pages"), seconds.alias("wall"))
    rates = per.select("pages", "wall", X.ratio(F.col("pages"), F.col("wall")).alias("rate"), (F.col("wall") / F.col("pages")).alias("each"))
    return rates.agg(F.count("*").alias("documents"), F.sum("pages").cast("bigint").alias("pages"), F.round(F.sum("wall"), 3).alias("wall_seconds"), F.round(F.avg("rate"), 4).alias("mean_pages_per_second"), F.round(F.avg("each"), 6).alias("mean_page_seconds"))


def issue_log(spark: SparkSession, d: str) -> DataFrame:
    """The issues of a document's pages, in order of pages, as one list, and how many pages have any."""
    each = F.struct("page_number", F.coalesce("issue_codes", F.array().cast("array<string>")).alias("codes"))
    pages = _pages(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list(each)).alias("pages"))
    return pages.select("document_id", F.flatten(F.transform("pages", lambda p: p["codes"])).alias("issues"), F.size(F.filter("pages", lambda p: F.size(p["codes"]) > 0)).cast("bigint").alias("pages_with_issues"))


def extracted_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Pages, resolution, source type and language of each document, read off its first three pages where they aren't given."""
    text = page_characters(spark, d).filter(F.col("page_number") <= 3).groupBy("document_id").agg(F.max("chars").alias("first"))
    m = _meta(spark, d).join(text, "document_id", "left")
    kind = F.when(F.col("source_type").isin("digital", "scanned"), F.col("source_type")).when(F.coalesce("first", F.lit(0)) >= 20, "digital").otherwise("scanned")
    return m.select("document_id", F.greatest(F.lit(1), F.coalesce("pages", F.lit(1))).alias("pages"), F.coalesce("resolution_dpi", F.lit(150)).alias("dpi"), kind.alias("source_type"), X.language(F.col("language")).alias("language_code"))


def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of five sentences of each paragraph: the strategy by sentences."""
    paragraph = F.posexplode(X.paragraphs(F.col("text"))).alias("paragraph_no", "paragraph")
    cut = _chunks(spark, d).filter(F.col("text").isNotNull()).select("chunk_id", paragraph)
    return C.sentence_chunks(cut, ["chunk_id", "paragraph_no"], "paragraph", 5).select("chunk_id", F.col("paragraph_no").cast("bigint").alias("paragraph_no"), "part", "sentences", F.md5("piece").alias("piece_md5"))


def work_units(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).filter(F.col("pages") > 0)
    return m.select("document_id", F.lit(1).alias("start_page"), F.col("pages").alias("end_page"), F.col("pages").alias("priority"))


def page_units(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).filter(F.col("pages") > 0)
    return m.select("document_id", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))


def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    size, overlap = 512, 64
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - overlap) / step).cast("int") - 1)
    t = table(spark, d, "documents").filter(F.length("text") > 0)
    cut = t.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    piece = F.substring("text", F.col("chunk") * step + 1, F.lit(size))
    return cut.select("doc_id", "chunk", F.length(piece).cast("bigint").alias("characters"), F.md5(piece).alias("piece_md5"))


def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    part = F.posexplode(F.split("text", "\f")).alias("part", "page_text")
    cut = _chunks(spark, d).filter(F.col("text").isNotNull()).select("document_id", "chunk_index", part)
    return C.semantic_chunks(cut.select("document_id", (F.col("chunk_index") * 1000 + F.col("part")).alias("page_number"), F.col("page_text").alias("text")))


def chunk_plain(spark: SparkSession, d: str) -> DataFrame:
    return C.plain_text_chunks(table(spark, d, "documents"), "doc_id", "text")


def missing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Anti join: chunks' documents without validated pages; semi join: those with."""
    c = _chunks(spark, d).select("document_id").distinct()
    v = _pages(spark, d).select("document_id").distinct()
    return c.join(v, "document_id", "left_anti").select("document_id", F.lit("missing").alias("state")).unionByName(c.join(v, "document_id", "left_semi").select("document_id", F.lit("present").alias("state")))


def page_set_difference(spark: SparkSession, d: str) -> DataFrame:
    listed = page_units(spark, d).select("document_id", F.col("page").alias("page_number"))
    seen = _pages(spark, d).select("document_id", "page_number")
    return listed.exceptAll(seen).select("document_id", "page_number", F.lit("unseen").alias("state")).unionByName(seen.exceptAll(listed).select("document_id", "page_number", F.lit("unlisted").alias("state")))


_META = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY processing_timestamp NULLS LAST, pages NULLS LAST) AS rn FROM doc_metadata) WHERE rn = 1"
_PG = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY validated_at NULLS LAST, ocr_confidence NULLS LAST) AS rn FROM page_validation) WHERE rn = 1"
_CH = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_index NULLS FIRST, text NULLS FIRST) AS rn FROM chunks) WHERE rn = 1"
_CHARS = f"SELECT document_id, page_numbers[least(i, len(page_numbers))] AS page_number, CAST(sum(length(p[i])) AS BIGINT) AS chars FROM (SELECT document_id, page_numbers, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT document_id, page_numbers, string_split(text, chr(12)) AS p FROM ({_CH}) WHERE len(page_numbers) > 0 AND text IS NOT NULL)) GROUP BY 1, 2"
_FEAT = f"""c AS ({_CHARS}), f AS (SELECT g.document_id, g.page_number, CASE WHEN ocr_confidence >= 0 THEN round(ocr_confidence * 0.9::DOUBLE, 4) ELSE 0.05::DOUBLE END AS density,
  CAST(coalesce(c.chars, 0) AS INTEGER) AS chars, coalesce(duplicates_found, 0) + 1 AS images, ocr_confidence, confidence_valid IS NULL AS direct, bbox_valid FROM ({_PG}) g LEFT JOIN c ON g.document_id = c.document_id AND g.page_number = c.page_number),
t AS (SELECT *, CASE WHEN chars >= 20 AND density < 0.15 THEN 'digital' WHEN chars >= 20 THEN 'mixed' WHEN density >= 0.40 THEN 'scanned' ELSE 'unknown' END AS page_type FROM f)"""
_DRAIN = f"SELECT document_id, pages, row_number() OVER (ORDER BY pages DESC, document_id) AS drain FROM ({_META}) WHERE pages > 0"
_LPT = f"""m AS (SELECT document_id, CAST(pages AS BIGINT) AS pages, row_number() OVER (ORDER BY pages DESC, document_id) AS k FROM ({_META}) WHERE pages > 0),
go AS (WITH RECURSIVE r AS (SELECT 0::BIGINT AS k, list_transform(range(0, least(6, (SELECT count(*) FROM m))), lambda x: 0::BIGINT) AS loads, 0::BIGINT AS w
  UNION ALL SELECT m.k, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + m.pages ELSE x END), CAST(list_position(loads, list_min(loads)) AS BIGINT) FROM r JOIN m ON m.k = r.k + 1) SELECT * FROM r),
fin AS (SELECT arg_max(loads, k) AS loads FROM go),
lpt AS (SELECT m.document_id, m.pages, 'worker_' || lpad(CAST(CASE WHEN fin.loads[go.w] < 10 THEN 0 ELSE go.w - 1 END AS VARCHAR), 2, '0') AS worker_id FROM go JOIN m ON m.k = go.k CROSS JOIN fin)"""
# Sentences as the pattern of ``text.sentences`` splits them: without looking behind, the parts around a bound are put back around a mark.
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[)\\]''\"]*[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+([A-ZÀ-ɏ\\p{{Nd}}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_TRIM = "regexp_replace(x, '^[\\s\\x0B\\x{85}\\x{A0}]+|[\\s\\x0B\\x{85}\\x{A0}]+$', '', 'g')"

QUERIES = {f.__name__: f for f in (
    doc_summary, status_pivot, registry_summary, metadata_stats, metadata_names, fulltext, headings, current_heading, page_texts, chunk_ids, stale_counts, dup_blocks, page_types, dominant_type, page_rules, workload_cost,
    completeness, workload_report, queue_drain, dispatch_plan, lpt_partition, partition_stats, work_units, page_units, chunk_fixed, chunk_semantic, chunk_plain, missing_pages, page_set_difference,
    document_benchmark, issue_log, page_characters, extracted_metadata, chunk_sentences,
)}
SQL = {
    "doc_summary": f"SELECT document_id, count(*) AS pages, count(*) FILTER (passed) AS passed, coalesce(round(avg(ocr_confidence) FILTER (passed AND ocr_confidence >= 0), 4), 1.0) AS confidence, round(sum(validation_time_seconds), 6) AS seconds, round(CASE WHEN sum(validation_time_seconds) > 0 THEN count(*) / sum(validation_time_seconds) ELSE 0 END, 2) AS pages_per_second FROM ({_PG}) GROUP BY document_id",
    "status_pivot": f"SELECT document_id, count(*) FILTER (passed) AS completed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (passed IS NULL) AS pending FROM ({_PG}) GROUP BY document_id",
    "registry_summary": f"SELECT coalesce(source_type, 'unknown') AS source_type, count(*) AS documents, CAST(sum(pages) FILTER (pages > 0) AS BIGINT) AS pages, round(avg(pages) FILTER (pages > 0), 2) AS mean_pages, round(avg(estimated_size_mb), 4) AS mean_mb FROM ({_META}) GROUP BY 1",
    "metadata_stats": f"SELECT count(*) AS documents, CAST(coalesce(sum(pages) FILTER (pages > 0), 0) AS BIGINT) AS pages, round(coalesce(avg(pages) FILTER (pages > 0), 0), 4) AS mean_pages, CAST(min(pages) FILTER (pages > 0) AS BIGINT) AS fewest, CAST(max(pages) FILTER (pages > 0) AS BIGINT) AS most, round(sum(estimated_size_mb), 2) AS total_mb, count(*) FILTER (source_type = 'digital') AS digital, count(*) FILTER (source_type = 'scanned') AS scanned, count(*) FILTER (source_type IS NULL OR source_type = 'unknown') AS unknown FROM ({_META})",
    "metadata_names": f"SELECT document_id, regexp_replace(regexp_extract(file_path, '([^/\\\\]*)$', 1), '\\.[^.]+$', '') AS stem, lower(regexp_extract(file_path, '(\\.[^./\\\\]+)$', 1)) AS suffix, CASE WHEN substring(lower(split_part(language, '-', 1)), 1, 2) <> '' THEN substring(lower(split_part(language, '-', 1)), 1, 2) ELSE 'en' END AS language_code FROM ({_META})",
    "fulltext": f"SELECT document_id, length(t) AS characters, md5(t) AS text_md5 FROM (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index NULLS FIRST, chunk_id) AS t FROM ({_CH}) WHERE trim(coalesce(text, ''), ' ') <> '' GROUP BY document_id)",
    "headings": f"SELECT document_id, list(section_heading ORDER BY chunk_index NULLS FIRST, chunk_id)[1:50] AS headings, first(section_heading ORDER BY chunk_index NULLS FIRST, chunk_id) AS title FROM ({_CH}) WHERE trim(coalesce(section_heading, ''), ' ') <> '' GROUP BY document_id",
    "current_heading": f"SELECT chunk_id, last_value(CASE WHEN section_heading <> '' THEN section_heading END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index NULLS FIRST, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_heading FROM ({_CH})",
    "page_texts": f"SELECT chunk_id, i - 1 AS part, length(p[i]) AS characters FROM (SELECT chunk_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT chunk_id, list_filter(list_transform(string_split(text, chr(12)), lambda x: {_TRIM}), lambda x: x <> '') AS p FROM ({_CH})))",
    "chunk_ids": f"SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index, sha256(document_id || ':' || chunk_index)[1:16] AS expected_id FROM ({_CH})",
    "stale_counts": f"SELECT chunk_id, length(text) AS characters, character_count IS DISTINCT FROM length(text) AS stale, regexp_matches(text, '[^\\s\\x0B\\x{{85}}\\x{{A0}}]') AS has_words FROM ({_CH}) WHERE text IS NOT NULL",
    "dup_blocks": f"SELECT chunk_id, len(b) - len(list_distinct(b)) AS duplicates FROM (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array(text, '[\\n\\f]'), lambda x: lower(trim(x, ' '))), lambda x: x <> '') AS b FROM ({_CH}) WHERE text IS NOT NULL)",
    "page_types": f"WITH {_FEAT} SELECT document_id, page_number, page_type, round(CASE page_type WHEN 'digital' THEN least(1.0::DOUBLE, 0.7::DOUBLE + 0.3::DOUBLE * chars / 1000.0) WHEN 'mixed' THEN 0.8 WHEN 'scanned' THEN least(1.0::DOUBLE, 0.65::DOUBLE + 0.35::DOUBLE * density) ELSE 0.5 END, 4) AS confidence FROM t",
    "dominant_type": f"WITH {_FEAT}, n AS (SELECT document_id, count(*) FILTER (page_type = 'digital') AS a, count(*) FILTER (page_type = 'scanned') AS b, count(*) FILTER (page_type = 'mixed') AS c, count(*) FILTER (page_type = 'unknown') AS e FROM t GROUP BY document_id) SELECT document_id, CASE greatest(a, b, c, e) WHEN a THEN 'digital' WHEN b THEN 'scanned' WHEN c THEN 'mixed' ELSE 'unknown' END AS dominant, greatest(a, b, c, e) AS pages FROM n",
    "page_rules": f"""WITH {_FEAT}, r AS (SELECT document_id, page_number, list_filter([CASE WHEN NOT direct AND ocr_confidence >= 0 AND ocr_confidence < 0.1 THEN 'error:ocr_confidence' END, CASE WHEN NOT direct AND ocr_confidence >= 0.1 AND ocr_confidence < 0.3 THEN 'warning:ocr_confidence' END,
  CASE WHEN chars < 5 AND (page_type <> 'scanned' OR density > 0.3) THEN 'warning:few_characters' END, CASE WHEN images > 1 THEN 'warning:duplicate_blocks' END, CASE WHEN bbox_valid IS NOT TRUE THEN 'warning:empty_boxes' END], lambda x: x IS NOT NULL) AS i FROM t)
SELECT document_id, page_number, coalesce(array_to_string(i, ','), '') AS issues, len(list_filter(i, lambda x: starts_with(x, 'error'))) = 0 AS ok FROM r""",
    "workload_cost": f"""WITH {_FEAT}, e AS (SELECT document_id, page_number, density, chars, round(CASE WHEN chars < 20 AND (density >= 0.4 OR images > 0) THEN greatest(0.1::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + 0.25::DOUBLE * greatest(0, least(1, density)) + 0.15::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (630000.0::DOUBLE - 484704.0) / 484704.0)) + 0.15::DOUBLE * least(1.0::DOUBLE, greatest(0, images - 1) * 0.1::DOUBLE)))
  ELSE least(0.2::DOUBLE, 0.05::DOUBLE + least(0.15::DOUBLE, chars / 4000.0::DOUBLE * 0.15::DOUBLE)) END, 8) AS effort FROM t)
SELECT document_id, page_number, effort, round(3 * (1.0 + 2.5::DOUBLE * effort), 9) AS units, round(least(1, 0.35::DOUBLE * least(1, round(700 * 150 / 72.0::DOUBLE) * round(900 * 150 / 72.0::DOUBLE) / 8415000.0) + 0.25::DOUBLE * greatest(0, least(1, density)) + 0.25::DOUBLE * greatest(0, least(1, effort)) + 0.15::DOUBLE * least(1, chars / 3000.0::DOUBLE)), 10) AS intensity FROM e""",
    "completeness": f"SELECT m.document_id, CAST(m.pages AS BIGINT) AS expected, coalesce(s.seen, 0) AS seen, coalesce(s.seen, 0) >= m.pages AS complete FROM ({_META}) m LEFT JOIN (SELECT document_id, count(*) AS seen FROM ({_PG}) GROUP BY 1) s ON m.document_id = s.document_id WHERE m.pages > 0",
    "workload_report": f"""WITH a AS (SELECT count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, avg(pages) AS mean, quantile_cont(pages, 0.5) AS median, coalesce(stddev_samp(pages), 0) AS std, sum(pages) * 2.0::DOUBLE AS cost FROM ({_META}) WHERE pages > 0)
SELECT documents, pages, round(mean, 4) AS mean, median, round(std, 4) AS std, round(std / mean, 4) AS cv, cost, CASE WHEN std / mean < 0.2 THEN 'low' WHEN std / mean < 0.5 THEN 'medium' ELSE 'high' END AS difficulty, CAST(greatest(1, least(64, ceil(cost / 3600))) AS BIGINT) AS workers FROM a""",
    "queue_drain": _DRAIN,
    "dispatch_plan": f"""WITH s AS ({telemetry.SQL['worker_states']}), q AS ({_DRAIN}), n AS (SELECT count(*) AS n FROM q), slots AS (SELECT node_id, unnest(range(depth, depth + n)) AS level FROM s, n WHERE available),
r AS (SELECT node_id, row_number() OVER (ORDER BY level, node_id) AS drain FROM slots) SELECT q.document_id, q.drain, r.node_id AS worker_id FROM q LEFT JOIN r USING (drain)""",
    "lpt_partition": f"WITH {_LPT} SELECT document_id, pages, worker_id FROM lpt",
    "partition_stats": f"WITH {_LPT}, l AS (SELECT worker_id, CAST(sum(pages) AS DOUBLE) AS load FROM lpt GROUP BY 1), a AS (SELECT var_pop(load) AS variance, stddev_pop(load) AS std, avg(load) AS mean, max(load) AS most, min(load) AS least FROM l) SELECT round(variance, 4) AS variance, round(std, 4) AS std, round(greatest(0, least(1, 1 - std / mean)), 4) AS balance, round(most / least, 4) AS imbalance, round(most / 0.5::DOUBLE, 2) AS seconds FROM a",
    "document_benchmark": f"WITH p AS (SELECT document_id, count(*)::DOUBLE AS pages, sum(validation_time_seconds) AS wall FROM ({_PG}) GROUP BY 1) SELECT count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, round(sum(wall), 3) AS wall_seconds, round(avg(CASE WHEN wall > 0 THEN pages / wall ELSE 0 END), 4) AS mean_pages_per_second, round(avg(wall / pages), 6) AS mean_page_seconds FROM p",
    "issue_log": f"SELECT document_id, flatten(list(coalesce(issue_codes, []) ORDER BY page_number)) AS issues, count(*) FILTER (len(coalesce(issue_codes, [])) > 0) AS pages_with_issues FROM ({_PG}) GROUP BY 1",
    "page_characters": f"SELECT document_id, page_number, chars FROM ({_CHARS})",
    "extracted_metadata": f"SELECT m.document_id, greatest(1, coalesce(m.pages, 1)) AS pages, coalesce(resolution_dpi, 150) AS dpi, CASE WHEN source_type IN ('digital', 'scanned') THEN source_type WHEN coalesce(t.first, 0) >= 20 THEN 'digital' ELSE 'scanned' END AS source_type, CASE WHEN substring(lower(split_part(language, '-', 1)), 1, 2) <> '' THEN substring(lower(split_part(language, '-', 1)), 1, 2) ELSE 'en' END AS language_code FROM ({_META}) m LEFT JOIN (SELECT document_id, max(chars) AS first FROM ({_CHARS}) WHERE page_number <= 3 GROUP BY 1) t ON m.document_id = t.document_id",
    "chunk_sentences": f"""WITH g AS (SELECT chunk_id, i - 1 AS paragraph_no, {_SENTENCES.format('p[i]')} AS s FROM (SELECT chunk_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[\\s\\x0B]*\\n+'), lambda x: {_TRIM}), lambda x: x <> '') AS p FROM ({_CH}) WHERE text IS NOT NULL))),
k AS (SELECT *, unnest(range(0, (len(s) + 4) // 5)) AS part FROM g) SELECT chunk_id, paragraph_no, CAST(part AS INTEGER) AS part, len(s[part * 5 + 1:part * 5 + 5]) AS sentences, md5(array_to_string(s[part * 5 + 1:part * 5 + 5], ' ')) AS piece_md5 FROM k""",
    "work_units": f"SELECT document_id, 1 AS start_page, pages AS end_page, pages AS priority FROM ({_META}) WHERE pages > 0",
    "page_units": f"SELECT document_id, CAST(unnest(range(1, pages + 1)) AS INTEGER) AS page FROM ({_META}) WHERE pages > 0",
    "chunk_fixed": "SELECT doc_id, CAST(c AS INTEGER) AS chunk, length(substring(text, c * 448 + 1, 512)) AS characters, md5(substring(text, c * 448 + 1, 512)) AS piece_md5 FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 64) / 448.0) AS BIGINT)))) AS c FROM documents WHERE length(text) > 0)",
    "missing_pages": "SELECT DISTINCT document_id, CASE WHEN document_id IN (SELECT document_id FROM page_validation) THEN 'present' ELSE 'missing' END AS state FROM chunks",
    "page_set_difference": f"WITH l AS (SELECT document_id, CAST(unnest(range(1, pages + 1)) AS INTEGER) AS page_number FROM ({_META}) WHERE pages > 0), s AS (SELECT document_id, page_number FROM ({_PG})) SELECT *, 'unseen' AS state FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM s) UNION ALL SELECT *, 'unlisted' FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM l)",
}
