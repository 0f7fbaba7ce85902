"""Cost of pages and choice of device, as column expressions; hold of a choice as a fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import clamp
from folioflow.runtime import null_safe_key, written

# A standard page in points, and the pixels of the largest page that counts.
PAGE_AREA = 612.0 * 792.0
MOST_PIXELS = 2550 * 3300
# Fixed value: megabytes of free GPU memory that a page needs.
LEAST_FREE_MB = 256.0


def complexity(scanned: Column, chars: Column, density: Column, images: Column, area: Column) -> Column:
    """Effort of a page between 0 and 1, to 8 places: small for digital ones, by images and size for scans."""
    digital = F.least(F.lit(0.20), 0.05 + F.least(F.lit(0.15), chars / 4000.0 * 0.15))
    large = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (area - PAGE_AREA) / PAGE_AREA))
    split = F.least(F.lit(1.0), F.greatest(F.lit(0), images - 1) * 0.1)
    scan = clamp(0.35 + 0.25 * clamp(density, 0, 1) + 0.15 * large + 0.15 * split, 0.10, 1.0)
    return F.round(F.when(scanned, scan).otherwise(digital), 8)


def work_units(pages: Column, effort: Column) -> Column:
    return F.round(pages * (1.0 + 2.5 * effort), 2)


def intensity(width: Column, height: Column, density: Column, effort: Column, chars: Column, dpi: int = 150) -> Column:
    """Weighted sum of pixels, image share, effort and text of a page, each between 0 and 1."""
    pixels = F.round(width * (dpi / 72.0)) * F.round(height * (dpi / 72.0))
    return clamp(0.35 * clamp(pixels / MOST_PIXELS, 0, 1) + 0.25 * clamp(density, 0, 1) + 0.25 * clamp(effort, 0, 1) + 0.15 * clamp(chars / 3000.0, 0, 1), 0, 1)


def suitability(level: Column, text: Column, gpu: Column, cpu: Column, queue: Column, warm: Column, pages: Column, free_mb: Column | None = None, pixels: Column | None = None) -> Column:
    """Struct (cpu_score, gpu_score, confidence, backend, reason) from intensity, text density and load.

    Less than ``LEAST_FREE_MB`` of free GPU memory counts against the GPU; an unknown amount does not.
    """
    dense = (text > 0.40) & (level > 0.60)
    g = 0.20 + 0.75 * level - F.when(dense, 0.08 * text).otherwise(0.0)
    c = 0.85 - 0.65 * level + F.when(dense, 0.12 * text).otherwise(0.0)
    g = g * F.when(warm, 1.0).otherwise(0.35 + 0.65 * F.least(F.lit(1.0), pages / 15.0))
    busy = F.when(gpu > 80, F.greatest(F.lit(0.2), 1.0 - 0.8 * (gpu - 80) / 20.0)).otherwise(F.lit(1.0))
    if free_mb is not None:
        g = g * F.when(free_mb < LEAST_FREE_MB, 0.30).otherwise(1.0)
    g = g * busy * F.when((queue > 4) & (busy < 0.8), 0.85).otherwise(1.0)
    c = c * F.when(cpu > 85, F.greatest(F.lit(0.2), 1.0 - 0.7 * (cpu - 85) / 15.0)).otherwise(1.0)
    g, c = clamp(g, 0.05, 0.98), clamp(c, 0.05, 0.98)
    sure = clamp(F.abs(g - c) * 1.6 + 0.10, 0.15, 0.99)
    many = pages >= 15
    reason = (
        F.when((g > c) & ~warm & many, "large_batch_amortizes_cold_gpu")
        .when((g > c) & (level >= 0.50), "high_compute_intensity_favors_gpu")
        .when((g > c) & ((F.lit(0) if pixels is None else pixels) >= 1_500_000), "large_pixel_surface_favors_gpu")
        .when(g > c, "gpu_suitability_higher_than_cpu")
        .when(~warm & ~many, "cold_gpu_overhead_unlikely_to_amortize")
        .when(busy < 0.7, "gpu_overloaded_routing_to_cpu")
        .when(dense, "dense_text_layout_favors_cpu")
        .when(level < 0.35, "small_simple_page_favors_cpu")
        .otherwise("cpu_suitability_higher_than_gpu")
    )
    return F.struct(F.round(c, 6).alias("cpu_score"), F.round(g, 6).alias("gpu_score"), F.round(sure, 6).alias("confidence"), F.when(g > c, "GPU").otherwise("CPU").alias("backend"), reason.alias("reason"))


def device_rules(available: Column, cpu: Column, memory: Column, gpu: Column, pages: Column, effort: Column, free_mb: Column | None = None) -> Column:
    """Struct (device, rule): the first rule that holds decides; a null value fulfils none."""
    rules = (
        (available.isNull() | ~available, "CPU", "A"),
        ((cpu < 0) | (memory < 0), "CPU", "B"),
        ((pages <= 1) & (effort <= 0.20), "CPU", "C"),
        (gpu >= 85, "CPU", "D"),
        (F.lit(False) if free_mb is None else free_mb < LEAST_FREE_MB, "CPU", "E"),
        (cpu >= 80, "GPU", "F"),
        (effort >= 0.35, "GPU", "G"),
    )
    device, rule = None, None
    for when, d, r in rules:
        device = F.when(when, d) if device is None else device.when(when, d)
        rule = F.when(when, r) if rule is None else rule.when(when, r)
    return F.struct(device.otherwise("CPU").alias("device"), rule.otherwise("H").alias("rule"))


def held_devices(decisions: DataFrame, source: str, time: str, key: str, device: str, hold_seconds: float = 2.0, release: str | None = None, block_seconds: int = 3600) -> DataFrame:
    """(key, device, held): a device is kept for ``hold_seconds`` after the last switch.

    Where the boolean column ``release`` is true the GPU is let go at once: it is lost or overloaded.
    After a gap of at least ``hold_seconds`` nothing is held any more, so each source is cut there,
    and the pieces that begin in one block of time are folded together. All that a fold needs from
    before is the device in use: each group first tells which device it ends with from each one it
    may begin with, one row a group; those rows are chained by source, and then every group is
    folded from its own beginning. Gaps are looked for within blocks, what crosses their bounds is
    told from one row a block. Only a source that never pauses that long stays one group. Rows
    without time or device are left out; ties in time are ordered by key.
    """
    kind = decisions.schema[key].dataType.simpleString()
    hold, size = int(hold_seconds * 1e6), block_seconds * 1_000_000
    rows = decisions.filter(F.col(time).isNotNull() & F.col(device).isNotNull()).select(
        F.col(key).alias("key"), null_safe_key(F.col(source)).alias("source"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(device).alias("asked"),
        (F.coalesce(F.col(release), F.lit(False)) if release else F.lit(False)).alias("release"),
    ).withColumn("block", F.floor(F.col("at") / size))
    by_block = Window.partitionBy("source").orderBy("block")
    ends = rows.groupBy("source", "block").agg(F.max("at").alias("end")).withColumn("before", F.lag("end").over(by_block)).drop("end")
    line = Window.partitionBy("source", "block").orderBy("at", "key")
    gap = F.col("at") - F.coalesce(F.lag("at").over(line), F.col("before"))
    begun = rows.join(ends, ["source", "block"]).withColumn("begin", F.when(F.coalesce(gap >= hold, F.lit(True)), F.col("at")))
    last = begun.groupBy("source", "block").agg(F.max("begin").alias("begin"))
    carried = last.select("source", "block", F.last("begin", ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    cut = begun.join(carried, ["source", "block"]).withColumn("piece", F.coalesce(F.last("begin", ignorenulls=True).over(line), F.col("carried")))

    def run(pdf: pd.DataFrame, now: str | None) -> list[tuple[str, bool]]:
        switched, out = None, []
        for at, asked, free in zip(pdf["at"], pdf["asked"], pdf["release"], strict=True):
            held = now is not None and asked != now and switched is not None and at - switched < hold and not (free and now == "GPU")
            if asked != now and not held:
                now, switched = asked, at
            out.append((now, held))
        return out

    def ends_with(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "key"])
        begins = sorted(set(pdf["asked"]))
        # an unheard-of device, and none, as the last two
        last = [run(pdf, d)[-1][0] for d in [*begins, "\0", None]]
        return pd.DataFrame({"source": pdf["source"].iloc[:1].tolist(), "begun": pdf["begun"].iloc[:1].tolist(), "begins": [begins], "last": [last]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("begun")
        now, before = None, []
        for begins, last in zip(pdf["begins"], pdf["last"], strict=True):
            before.append(now)
            at = {d: i for i, d in enumerate(begins)}
            now = last[len(last) - 1 if now is None else at.get(now, len(last) - 2)]
        return pd.DataFrame({"source": pdf["source"].to_numpy(), "begun": pdf["begun"].to_numpy(), "now": before})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "key"])
        now = pdf["now"].iloc[0]
        out = run(pdf, None if pd.isna(now) else now)
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "device": [d for d, _ in out], "held": [h for _, h in out]})

    grouped = written(cut.select("key", "source", "at", "asked", "release", F.floor(F.col("piece") / size).alias("begun")), "pieces")
    ends = grouped.groupBy("source", "begun").applyInPandas(ends_with, "source string, begun bigint, begins array<string>, last array<string>")
    known = ends.groupBy("source").applyInPandas(chain, "source string, begun bigint, now string")  # a row a block of time
    return grouped.join(known, ["source", "begun"]).groupBy("source", "begun").applyInPandas(fold, f"key {kind}, device string, held boolean").withColumnRenamed("key", key)


def reading_strategy(kind: Column) -> Column:
    """How a page is read by its type; an unknown one is read directly."""
    return F.when(kind == "scanned", "ocr").when(kind == "mixed", "mixed").otherwise("direct_text")


def executed_device(chosen: Column, failed: Column) -> Column:
    """Struct (device, fallback): a failed accelerator falls back to the processor."""
    back = failed & (chosen != "CPU")
    return F.struct(F.when(back, "CPU").otherwise(chosen).alias("device"), back.alias("fallback"))


def is_costly(seconds_a_page: Column, density: Column) -> Column:
    return (seconds_a_page > 2.0) | (density > 1.5)
