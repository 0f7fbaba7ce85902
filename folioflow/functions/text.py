"""Scalar text functions as column expressions: tokens, words, paragraphs, sentences, hashes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order; null stays null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: Column) -> Column:
    """Number of words between white space of any kind."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed, empty ones dropped."""
    trimmed = F.transform(F.split(text, r"\n\s*\n+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def sentences(text: Column) -> Column:
    """Split behind ., ! or ? before a capital letter or digit; closing marks in between are dropped."""
    parts = F.split(text, "(?U)(?<=[.!?])(?:[)\\]'\"]*)\\s+(?=[A-ZÀ-ɏ\\d])")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def pages(text: Column) -> Column:
    """Pages between form feeds, trimmed, empty ones dropped."""
    trimmed = F.transform(F.split(text, "\f"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def chunk_key(document: Column, index: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of ``document:index``."""
    return F.substring(F.sha2(F.concat_ws(":", document.cast("string"), index.cast("string")), 256), 1, 16)


def language(tag: Column) -> Column:
    """Two-letter code before the first dash, lower case; English if there is none."""
    code = F.substring(F.lower(F.substring_index(tag, "-", 1)), 1, 2)
    return F.when(code != "", code).otherwise(F.lit("en"))


def file_stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "[/\\\\]"), -1), r"\.[^.]+$", "")


def file_suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def archive_url(article: Column, base: str) -> Column:
    """``base/{last two digits}/{two before}/{id}.pdf``; empty for an id that is no number."""
    digits = F.regexp_replace(article, "^PMC", "")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    tail, before = F.right(padded, F.lit(2)), F.substring(F.right(padded, F.lit(4)), 1, 2)
    return F.when(digits.rlike("^[0-9]+$"), F.concat_ws("/", F.lit(base), tail, before, F.concat(article, F.lit(".pdf")))).otherwise(F.lit(""))


def pdf_date(value: Column) -> Column:
    """Timestamp of ``D:YYYYMMDDhhmmss``; null if it is none."""
    digits = F.regexp_extract(value, r"D:(\d{14})", 1)
    return F.try_to_timestamp(F.when(digits != "", digits), F.lit("yyyyMMddHHmmss"))


def duration(seconds: Column) -> Column:
    """``1h 02m 03s`` style; minutes and seconds only below an hour, seconds only below a minute."""
    s = F.floor(seconds).cast("int")
    h, m, r = (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, zero where the whole is not above zero."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
