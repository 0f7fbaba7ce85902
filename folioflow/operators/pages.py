"""Rules and roll-ups over pages and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import clamp, ratio


def page_type(chars: Column, density: Column) -> Column:
    """Struct (page_type, confidence): from the length of the text layer and the share of images."""
    text = chars >= 20
    kind = F.when(text & (density < 0.15), "digital").when(text, "mixed").when(density >= 0.40, "scanned").otherwise("unknown")
    sure = (
        F.when(kind == "digital", F.least(F.lit(1.0), F.lit(0.7) + F.lit(0.3) * chars / 1000.0))
        .when(kind == "mixed", F.lit(0.80))
        .when(kind == "scanned", F.least(F.lit(1.0), F.lit(0.65) + F.lit(0.35) * density))
        .otherwise(F.lit(0.50))
    )
    return F.struct(kind.alias("page_type"), F.round(sure, 4).alias("confidence"))


def page_issues(chars: Column, confidence: Column, density: Column, kind: Column, direct: Column, duplicates: Column, empty_boxes: Column) -> Column:
    """Array of ``severity:code`` of a page; it passes if no issue is an error."""
    read = ~direct & confidence.isNotNull()
    return F.array_compact(
        F.array(
            F.when(read & (confidence < 0.10), F.lit("error:ocr_confidence")),
            F.when(read & (confidence >= 0.10) & (confidence < 0.30), F.lit("warning:ocr_confidence")),
            F.when((chars < 5) & ((kind != "scanned") | (density > 0.3)), F.lit("warning:few_characters")),
            F.when(duplicates > 0, F.lit("warning:duplicate_blocks")),
            F.when(empty_boxes > 0, F.lit("warning:empty_boxes")),
        )
    )


def passed(issues: Column) -> Column:
    return ~F.exists(issues, lambda x: x.startswith("error"))


def duplicate_blocks(blocks: Column) -> Column:
    """How many blocks repeat an earlier one, blanks and case aside."""
    plain = F.filter(F.transform(blocks, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.size(plain) - F.size(F.array_distinct(plain))


def block_type(text: Column, size: Column) -> Column:
    """heading, footnote, list_item or text, by font size first."""
    return F.when(size >= 14, "heading").when(size <= 8, "footnote").when(F.ltrim(text).rlike(r"^([-•*‣▪]|\d{1,2}[.)])\s"), "list_item").otherwise("text")


def layout_type(size: Column) -> Column:
    """Struct (element_type, level): headings from 13 points in three levels, footnotes up to 8.5."""
    kind = F.when(size >= 13, "heading").when(size <= 8.5, "footnote").otherwise("paragraph")
    level = F.when(kind == "heading", F.when(size >= 16, 1).when(size >= 14, 2).otherwise(3))
    return F.struct(kind.alias("element_type"), level.alias("level"))


def markdown_table(cells: Column) -> Column:
    """Markdown of an array of rows, the first one the header; null for less than two rows or columns."""
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(cells[0], lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(cells, 2, F.size(cells)), line)
    return F.when((F.size(cells) >= 2) & (F.size(cells[0]) >= 2), F.array_join(F.concat(F.array(line(cells[0]), rule), body), "\n"))


def csv_table(cells: Column) -> Column:
    """CSV of an array of rows; fields with comma, quote or line break are quoted."""
    quote = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, lambda row: F.array_join(F.transform(row, lambda c: quote(F.coalesce(c, F.lit("")))), ",")), "\n")


def figure_type(caption: Column, width: Column, height: Column) -> Column:
    """Class of a figure by words of its caption, in this order, then by its shape."""
    c = F.lower(F.coalesce(caption, F.lit("")))
    return (
        F.when(c.rlike("chart|graph|plot|histogram"), "chart")
        .when(c.rlike("diagram|flow|schema|architecture"), "diagram")
        .when(c.rlike("photo|image|picture|scan|x-ray"), "photograph")
        .when(ratio(width, height) > 2.5, "chart")
        .otherwise("unknown")
    )


def nearest_caption(blocks: Column, image_bottom: Column, most: float = 50.0) -> Column:
    """Text of the block (struct text, y0) with a figure word nearest below an image, or null."""
    named = F.filter(blocks, lambda b: F.lower(b["text"]).rlike(r"^(fig|figure|abb|abbildung)\b") & (F.abs(b["y0"] - image_bottom) < most))
    far = F.transform(named, lambda b: F.struct(F.abs(b["y0"] - image_bottom).alias("far"), b["text"].alias("text")))
    return F.array_min(far)["text"]


def merge_strategies(texts: Column, blocks: Column, confidences: Column) -> Column:
    """Struct (text, confidence): non-empty texts joined, confidence weighted by blocks, 3 places."""
    weight = F.aggregate(blocks, F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate(F.zip_with(blocks, confidences, lambda n, c: n * c), F.lit(0.0), lambda a, x: a + x)
    return F.struct(F.array_join(F.filter(texts, lambda t: F.trim(t) != ""), "\n").alias("text"), F.round(ratio(total, weight), 3).alias("confidence"))


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Struct (width, height, area, valid) of a box; valid if both sides are positive."""
    w, h = x1 - x0, y1 - y0
    return F.struct(w.alias("width"), h.alias("height"), (w * h).alias("area"), ((w > 0) & (h > 0)).alias("valid"))


def full_texts(parts: DataFrame, key: str, order: Sequence[str], text: str, separator: str = "\n\n") -> DataFrame:
    """(key, full_text): non-blank parts of each document in order."""
    kept = parts.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    each = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(text).alias("part"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(each, lambda x: x["part"]), separator).alias("full_text"))


def running_heading(segments: DataFrame, document: str, order: Sequence[str], heading: str, out: str = "current_heading") -> DataFrame:
    """The last heading at or before each segment of its document."""
    line = Window.partitionBy(document).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn(out, F.last(F.when(F.col(heading) != "", F.col(heading)), ignorenulls=True).over(line))


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in the given order."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(line)).filter(F.col("_first") == 1).drop("_first")


def utilisation(cpu: Column, memory: Column) -> Column:
    return F.round((0.6 * cpu + 0.4 * memory) / 100.0, 4)


def balance(std: Column, mean: Column) -> Column:
    return F.when(mean > 0, clamp(1.0 - std / mean, 0.0, 1.0)).otherwise(F.lit(1.0))


def completion_seconds(most_pages: Column, pages_per_second: Column) -> Column:
    """When the fullest partition is done; infinite without any speed."""
    return F.when(pages_per_second > 0, most_pages / pages_per_second).otherwise(F.lit(float("inf")))


def scheduler_overhead(scheduling: Column, total: Column) -> Column:
    """Struct (fraction, percent, light): the scheduler's share of the time, and whether it is below one percent."""
    part = ratio(scheduling, total)
    return F.struct(part.alias("fraction"), (part * 100).alias("percent"), (part < 0.01).alias("light"))


def energy_per_page(watts: Column, seconds: Column, pages: Column) -> Column:
    """Joules a page; null without pages."""
    return F.when(pages > 0, watts * seconds / pages)


def figure_dpi(pixels: Column, points: Column) -> Column:
    """Resolution of an image from its pixels and its width on the page, 72 at least."""
    return F.greatest(F.lit(72), F.floor(ratio(pixels, points) * 72).cast("int"))
