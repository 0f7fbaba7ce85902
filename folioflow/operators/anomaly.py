"""Implausible readings: range, constant-run and spike checks per source.

A source's series is cut into time blocks of a few thousand readings (never one task per
source), each with a margin of neighbouring readings, so that a source that holds a third of
all rows is spread like any other. Per block a robust decomposition is made: seasonal (daily
course, from per-hour medians aggregated in the JVM), trend (running median) and residual; the
generalised extreme studentised deviate test (Rosner 1983) on the residuals gives candidates,
and a candidate is a spike if the whole excursion is short and leaves the levels on both of
its sides by far more than the source's scatter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.runtime import null_safe_key

KINDS = ("impossible", "stuck", "spike")


def _t_quantile(p: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Student's t quantile by the Cornish-Fisher expansion around the normal quantile."""
    inv = NormalDist().inv_cdf
    z = np.array([inv(float(x)) for x in p])
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return z + g1 / dof + g2 / dof**2 + g3 / dof**3


def esd_outliers(residual: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """Mask of the outliers of the generalised ESD test, up to half of the values.

    The order of removal is that of the distance from the median, so that means and standard
    deviations of what is left come from running sums.
    """
    n = len(residual)
    out = np.zeros(n, bool)
    if n < 10:
        return out
    centred = residual - np.median(residual)
    order = np.argsort(-np.abs(centred), kind="stable")
    x = centred[order]
    most = n // 2
    left = n - np.arange(most)
    s1 = x.sum() - np.r_[0.0, np.cumsum(x[: most - 1])]
    s2 = (x**2).sum() - np.r_[0.0, np.cumsum(x[: most - 1] ** 2)]
    mean = s1 / left
    std = np.sqrt(np.maximum(s2 - left * mean**2, 0) / np.maximum(left - 1, 1))
    ratio = np.abs(x[:most] - mean) / np.maximum(std, 1e-12)
    # far down the list the critical value hardly moves: quantiles on a grid, interpolated
    grid = np.unique(np.linspace(0, most - 1, min(most, 64)).astype(int))
    dof = np.maximum(left[grid] - 2.0, 1.0)
    t = _t_quantile(1 - alpha / (2.0 * left[grid]), dof)
    critical = np.interp(np.arange(most), grid, (left[grid] - 1) * t / np.sqrt((dof + t**2) * left[grid]))
    above = np.flatnonzero(ratio > critical)
    if len(above):
        out[order[: above[-1] + 1]] = True
    return out


def running_median(x: np.ndarray, half: int) -> np.ndarray:
    """Median of up to ``2 * half + 1`` values around each one, ends mirrored."""
    if len(x) <= 2 * half:
        return np.full(len(x), np.median(x)) if len(x) else x
    padded = np.r_[x[half:0:-1], x, x[-2 : -half - 2 : -1]]
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)


def run_lengths(value: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Length of the run of equal valid values that each reading belongs to (0 if not valid)."""
    n = len(value)
    if not n:
        return np.zeros(0, int)
    start = np.ones(n, bool)
    start[1:] = ~(valid[1:] & valid[:-1] & (value[1:] == value[:-1]))
    run = np.cumsum(start) - 1
    return np.where(valid, np.bincount(run)[run], 0)


def spikes(
    x: np.ndarray, seasonal: np.ndarray, alpha: float, far: float, longest: int, side: int, half: int
) -> np.ndarray:
    """Mask of the spikes of a series of possible readings in order of time.

    A spike has at least two readings before it and two after it: excursions at the very ends
    of a series are none. A series of fewer than ``2 * side`` readings, or fewer than 10, is
    not tested.
    """
    n = len(x)
    out = np.zeros(n, bool)
    if n < 2 * side:
        return out
    y = x - seasonal
    scatter = 1.4826 * np.median(np.abs(np.diff(y))) / math.sqrt(2)
    step = np.unique(np.abs(np.diff(np.unique(x))))
    scatter = max(scatter, (step[0] if len(step) else 0.0) / 2, 1e-9)
    candidate = esd_outliers(y - running_median(y, half), alpha)
    at = np.flatnonzero(candidate)
    for length in range(1, longest + 1):
        for i in at:
            j = i + length
            if i < 2 or j > n - 2 or not candidate[i:j].all():
                continue
            before, after = np.median(y[max(0, i - side) : i]), np.median(y[j : j + side])
            low, high = y[i:j].min(), y[i:j].max()
            if max(low - max(before, after), min(before, after) - high) > far * scatter:
                out[i:j] = True
    return out


def _blocks(hours: DataFrame, block_rows: int, halo_rows: int) -> DataFrame:
    """(src, unit) -> the blocks that need the unit's rows, as their own or as margin.

    Works on one row per source and time unit only. Blocks are whole units; those of fewer
    rows than the margin are merged into the one before, so that a block's neighbours always
    hold its whole margin.
    """
    line = Window.partitionBy("src").orderBy("unit")
    upto = hours.withColumn("end", F.sum("n").over(line)).withColumn("begin", F.col("end") - F.col("n"))
    first = upto.withColumn("raw", F.floor(F.col("begin") / block_rows))
    sizes = first.groupBy("src", "raw").agg(F.sum("n").alias("size"))
    merged = sizes.withColumn(
        "block",
        F.sum(F.when(F.col("size") >= halo_rows, 1).otherwise(0)).over(Window.partitionBy("src").orderBy("raw")),
    ).select("src", "raw", "block")
    of_block = Window.partitionBy("src", "block")
    placed = (
        first.join(merged, ["src", "raw"])
        .withColumn("b0", F.min("begin").over(of_block))
        .withColumn("b1", F.max("end").over(of_block))
    )
    return placed.select(
        "src",
        "unit",
        F.array_compact(
            F.array(
                F.struct(F.col("block").alias("block"), F.lit(True).alias("own")),
                F.when(F.col("begin") - F.col("b0") < halo_rows, F.struct((F.col("block") - 1).alias("block"), F.lit(False).alias("own"))),
                F.when(F.col("b1") - F.col("end") < halo_rows, F.struct((F.col("block") + 1).alias("block"), F.lit(False).alias("own"))),
            )
        ).alias("places"),
    )


def block_places(rows: DataFrame, block_rows: int, halo_rows: int) -> DataFrame:
    """(src, unit, places) of ``rows`` with columns src and unit: one row a source and unit of time."""
    return _blocks(rows.groupBy("src", "unit").agg(F.count("*").alias("n")), block_rows, halo_rows)


def with_margins(rows: DataFrame, block_rows: int, halo_rows: int, places: DataFrame | None = None) -> DataFrame:
    """``rows`` (with columns src and unit) with ``block`` and ``own``: cut into blocks of time, each with a margin.

    A row is in its own block once and, as a margin, in the block beside it if that is near.
    """
    places = block_places(rows, block_rows, halo_rows) if places is None else places
    placed = rows.join(places, ["src", "unit"]).withColumn("place", F.explode("places"))
    return placed.select(*rows.columns, "place.block", "place.own")


def implausible_readings(
    readings: DataFrame,
    *,
    key: str = "snapshot_id",
    source: str = "node_id",
    time: str = "timestamp",
    metrics: Sequence[str] = ("cpu_percent", "memory_percent"),
    low: float = 0.0,
    high: float = 100.0,
    run: int = 6,
    longest: int = 3,
    far: float = 6.0,
    alpha: float = 0.05,
    side: int = 5,
    trend_half: int = 7,
    unit_seconds: int = 600,
    block_rows: int = 4000,
) -> DataFrame:
    """``(key, metric, kind)`` of every implausible reading, kinds as in ``KINDS``.

    ``impossible`` is below ``low``, above ``high`` or NaN; ``stuck`` is each of ``run`` or
    more readings in a row with the same possible value; ``spike`` is any other possible
    reading in an excursion of at most ``longest`` readings beyond ``far`` times the source's
    scatter from the median of the ``side`` readings on either side.

    Nulls: a null reading is none and ends a constant run; rows with a null time are checked
    for range only; a null source is a source of its own. Repeated rows (same key, source and
    time) count once, the first by value. Ties in time are ordered by key. An empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    metrics = list(metrics)
    halo = max(8 * run, 4 * (trend_half + side), 48)
    if block_rows < 4 * halo:
        raise ValueError(f"block_rows must be at least {4 * halo}")
    key_type = readings.schema[key].dataType.simpleString()
    rows = readings.select(
        F.col(key).alias("key"),
        null_safe_key(F.col(source)).alias("src"),
        F.col(time).cast("timestamp").alias("ts"),
        *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)],
    )
    # outside [low, high]; NaN sorts above every number in Spark
    ranged = [F.when((F.col(f"m{i}") < low) | (F.col(f"m{i}") > high), F.lit(m)) for i, m in enumerate(metrics)]
    untimed = (
        rows.filter(F.col("ts").isNull())
        .select("key", F.explode(F.array_compact(F.array(*ranged))).alias("metric"))
        .select("key", "metric", F.lit("impossible").alias("kind"))
        .distinct()
    )
    timed = rows.filter(F.col("ts").isNotNull()).withColumn("unit", F.floor(F.unix_micros("ts") / (unit_seconds * 1_000_000)))
    hour_of = F.pmod(F.floor(F.col("unit") * unit_seconds / 3600), F.lit(24)).cast("int")
    course = (
        timed.withColumn("hour", hour_of)
        .groupBy("src", "hour")
        .agg(
            *[
                F.percentile_approx(F.when(F.col(f"m{i}").between(low, high), F.col(f"m{i}")), 0.5, 2000).alias(f"c{i}")
                for i in range(len(metrics))
            ],
            F.count_distinct("unit").alias("units"),
        )
    )
    # the course of a day can only be told from more than one day
    told = course.groupBy("src").agg((F.min(F.floor(F.col("units") * unit_seconds / 3600)) >= 2).alias("days"), F.count("*").alias("hours")).filter("days and hours = 24").select("src")
    # 24 rows a source, sent once to each of its blocks
    places = block_places(timed, block_rows, halo)
    blocks = places.select("src", F.explode("places.block").alias("block")).distinct()
    values = [f"c{i}" for i in range(len(metrics))]
    daily = course.join(told, "src", "left_semi").join(blocks, "src").select(F.col("src").alias("source"), F.col("block").alias("in_block"), "hour", *values)
    grouped = with_margins(timed, block_rows, halo, places).select("key", "src", "ts", *[f"m{i}" for i in range(len(metrics))], "block", "own")
    names = metrics

    def one(pdf: pd.DataFrame, course: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "key", *[f"m{i}" for i in range(len(names))]], kind="stable")
        pdf = pdf[~(pdf.duplicated(["ts", "key"]) & pdf["key"].notna())]
        own = pdf["own"].to_numpy(bool)
        course = course.sort_values("hour")
        micros = pdf["ts"].astype("int64").to_numpy() // (1000 if str(pdf["ts"].dtype).startswith("datetime64[ns") else 1)
        hours = (micros / 3.6e9) % 24
        found = []
        for i, name in enumerate(names):
            x = pdf[f"m{i}"].to_numpy("float64")
            # Arrow turns null into NaN: what is NaN but null is told by the flag column
            null = pdf[f"z{i}"].to_numpy(bool)
            possible = ~null & (x >= low) & (x <= high)
            kind = np.where(~null & ~possible, "impossible", "").astype(object)
            stuck = run_lengths(x, possible) >= run
            kind[stuck] = "stuck"
            ok = np.flatnonzero(possible)
            season = np.zeros(len(ok))
            level = course[f"c{i}"].to_numpy("float64")
            if len(level) == 24 and np.isfinite(level).all():
                season = np.interp(hours[ok], np.arange(-1, 26) + 0.5, np.r_[level[-1], level, level[:2]]) - np.median(level)
            hit = spikes(x[ok], season, alpha, far, longest, side, trend_half)
            hit = ok[hit]
            kind[hit[~stuck[hit]]] = "spike"
            at = np.flatnonzero((kind != "") & own)
            found.append(pd.DataFrame({"key": pdf["key"].to_numpy()[at], "metric": name, "kind": kind[at]}))
        return pd.concat(found, ignore_index=True)

    flagged = (
        grouped.select("*", *[F.col(f"m{i}").isNull().alias(f"z{i}") for i in range(len(metrics))])
        .groupBy("src", "block")
        .cogroup(daily.groupBy("source", "in_block"))
        .applyInPandas(one, f"key {key_type}, metric string, kind string")
    )
    return flagged.unionByName(untimed).select(F.col("key").alias(key), "metric", "kind")

