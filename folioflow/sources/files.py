"""Readers and writers: directories, uploads, metadata files, logs, state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import file_suffix

METADATA = T.StructType(
    [
        T.StructField("document_id", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("pages", T.IntegerType()), T.StructField("estimated_size_mb", T.DoubleType()),
        T.StructField("resolution_dpi", T.IntegerType()), T.StructField("source_type", T.StringType()), T.StructField("language", T.StringType()), T.StructField("processing_timestamp", T.TimestampType()),
    ]
)
CASES = "case_id string, question string, passage string, relevant_document_ids array<string>, relevant_chunk_ids array<string>, category string, description string"


def scan_directory(spark: SparkSession, root: str, extensions: Sequence[str] = (".pdf", ".txt"), recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of non-empty files with an allowed suffix; the contents are not read.

    A missing root gives no rows.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, length bigint, modificationTime timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    wanted = [e.lower() for e in extensions]
    return files.select("path", "length", "modificationTime").filter((F.col("length") > 0) & file_suffix(F.col("path")).isin(wanted))


def text_uploads(spark: SparkSession, root: str) -> DataFrame:
    """(path, page_number, text): text files decoded as UTF-8, a page per form feed, blank pages left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = F.make_valid_utf8(F.col("content").cast("string"))  # bytes that are no UTF-8 become replacement characters
    pages = files.select("path", F.posexplode(F.split(text, "\f")).alias("at", "page"))
    return pages.select("path", (F.col("at") + 1).alias("page_number"), F.trim("page").alias("text")).filter(F.col("text") != "")


def unique_downloads(files: DataFrame) -> DataFrame:
    """Of ``binaryFile`` rows the PDF files, one of equal contents (the first path)."""
    pdf = files.filter(F.substring("content", 1, 4) == F.lit(b"%PDF"))
    return pdf.select("path", "length", F.md5("content").alias("checksum")).groupBy("checksum").agg(F.min("path").alias("path"), F.first("length").alias("length"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """CSV or JSON metadata; malformed rows are skipped."""
    if path.endswith(".json"):
        return spark.read.schema(METADATA).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path)
    return spark.read.schema(METADATA).option("mode", "DROPMALFORMED").csv(path, header=True)


def write_metadata(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """The eight columns of metadata; null is written as an empty field."""
    out = rows.select([f.name for f in METADATA]).write.mode("overwrite")
    out.option("header", "true").option("nullValue", "").csv(path) if fmt == "csv" else out.json(path)


REPORT = "level string, k int, metric string, value double"


def write_report(metrics: DataFrame, path: str) -> None:
    """Mean metrics (level, k, metric, value) as JSON lines, values to four places."""
    metrics.select("level", "k", "metric", F.round("value", 4).alias("value")).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


def write_state(state: DataFrame, path: str) -> None:
    """A small state table as JSON lines in place of the last one; readers see the old or the new one, by Spark's commit."""
    state.write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_cases(cases: DataFrame, path: str) -> None:
    """Evaluation cases as JSON lines, null fields left out."""
    cases.select([c.split()[0] for c in CASES.split(", ")]).write.mode("overwrite").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from one JSON array a file, or from a folder of JSON lines."""
    return spark.read.schema(CASES).option("multiLine", str(path.endswith(".json")).lower()).json(path)


def cached_or_missing(requested: DataFrame, cached: DataFrame, key: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """Rows of the cache that were asked for, and what of the request the cache lacks."""
    return cached.join(requested.select(key).distinct(), key, "left_semi"), requested.select(key).distinct().join(cached, key, "left_anti")


def build_report(articles: DataFrame, files: DataFrame) -> DataFrame:
    """Articles with the file of the same stem, if any."""
    stem = F.regexp_replace(F.element_at(F.split("file_path", "[/\\\\]"), -1), r"\.[^.]+$", "")
    return articles.join(files.withColumn("article_id", stem), "article_id", "left")


def upsert_cache(cache: DataFrame, new: DataFrame, key: str = "cache_key", at: str = "created_at") -> DataFrame:
    """The cache with new rows in place of older ones of their key; rows of no length are dropped."""
    row = F.struct(F.col(at).alias("_at"), F.struct(*cache.columns).alias("row"))
    both = cache.unionByName(new.select(cache.columns))
    return both.groupBy(F.col(key).alias("_key")).agg(F.max_by(row["row"], row["_at"]).alias("r")).select("r.*")


def append_log(rows: DataFrame, path: str) -> None:
    """Append the columns that are not nested to a CSV log."""
    flat = [f.name for f in rows.schema if not isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)]
    rows.select(flat).write.mode("append").option("header", "true").csv(path)


def xml_articles(rows: DataFrame, xml: str) -> DataFrame:
    """Title, journal and year of stored article records in XML; a record without a title is left out."""
    pick = lambda p: F.xpath_string(F.col(xml), F.lit(p))
    got = rows.withColumn("title", pick("//article-title")).withColumn("journal", pick("//journal-title")).withColumn("year", F.xpath_int(F.col(xml), F.lit("//pub-date/year")))
    return got.filter(F.col("title") != "")
