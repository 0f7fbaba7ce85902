"""Statistics of runs: three rules for percentiles, speed-up, regret, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.runtime import null_safe_key


def _bucket(v: Column) -> Column:
    """A coarse integer of a number that keeps the order: 64 steps a power of two, NaN last."""
    size = F.floor(F.log2(F.abs(v)) * 64) + 80_000
    return F.when(F.isnan(v), 1_000_000).when(v > 0, size).when(v < 0, -size).otherwise(0).cast("int")


def percentile_rules(rows: DataFrame, groups: Sequence[str], value: str, p: float) -> DataFrame:
    """(groups..., n, nearest, floor_index, linear): the three rules in use, exact.

    Counts of coarse buckets, pre-aggregated, tell which buckets hold the wanted ranks; only
    the values of those are counted one by one and ranked. Null values are left out, a null
    group is a group, an empty table gives no rows.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    v = rows.filter(F.col(value).isNotNull()).select(*[null_safe_key(F.col(g)).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(value).cast("double").alias("v")).withColumn("bucket", _bucket(F.col("v")))
    coarse = v.groupBy(*keys, "bucket").agg(F.count("*").alias("c"))
    line = Window.partitionBy(*keys).orderBy("bucket")
    upto = coarse.withColumn("end", F.sum("c").over(line)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    last = F.col("n") - 1
    low = F.floor(last * p)
    ranks = (F.greatest(F.lit(0), F.ceil(F.col("n") * p) - 1), F.least(last, F.floor(F.col("n") * p)), low, F.least(last, low + 1))
    wanted = (
        upto.select(*keys, "bucket", "c", "end", "n", F.posexplode(F.array(*[r.cast("bigint") for r in ranks])).alias("rule", "rank"))
        .filter((F.col("end") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("end")))
        .select(*keys, "bucket", "n", "rule", (F.col("rank") - F.col("end") + F.col("c")).alias("rank"))
    )
    fine = v.join(wanted.select(*keys, "bucket").distinct(), [*keys, "bucket"], "left_semi").groupBy(*keys, "bucket", "v").agg(F.count("*").alias("c"))
    inside = fine.withColumn("end", F.sum("c").over(Window.partitionBy(*keys, "bucket").orderBy("v")))
    found = inside.join(wanted, [*keys, "bucket"]).filter((F.col("end") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("end")))
    at = lambda rule: F.max(F.when(F.col("rule") == rule, F.col("v")))
    part = F.max((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p))
    out = found.groupBy(*keys, "n").agg(at(0).alias("nearest"), at(1).alias("floor_index"), (at(2) + part * (at(3) - at(2))).alias("linear"))
    named = [F.when(F.col(k) != "n", F.expr(f"substring({k}, 2)")).cast(rows.schema[g].dataType).alias(g) for g, k in zip(groups, keys, strict=True)]
    return out.select(*named, "n", "nearest", "floor_index", "linear")


def speedup(base: Column, now: Column) -> Column:
    """Base time over new time; one if either is not above zero."""
    return F.when((base > 0) & (now > 0), base / now).otherwise(F.lit(1.0))


def percent_change(base: Column, now: Column) -> Column:
    return F.when(base != 0, (now - base) / base * 100.0).otherwise(F.lit(0.0))


def regret(adaptive: Column, first: Column, second: Column) -> Column:
    """How much longer the adaptive choice takes than the better of two fixed ones, as a share."""
    best = F.least(first, second)
    return F.when(best > 0, (adaptive - best) / best).otherwise(F.lit(0.0))


def coefficient_of_variation(value: Column) -> Column:
    mean = F.avg(value)
    return F.when(mean > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0)) / mean).otherwise(F.lit(0.0))


def cluster_result(pages: Column, wall: Column, busy: Column, workers: Column, base: Column) -> Column:
    """Struct (throughput, overhead_percent, speedup, efficiency) of a run on several workers."""
    gain = speedup(F.coalesce(base, wall), wall)
    return F.struct(
        F.when(wall > 0, pages / wall).otherwise(F.lit(0.0)).alias("throughput"),
        F.when(wall > 0, F.greatest(F.lit(0.0), wall - busy) / wall * 100.0).otherwise(F.lit(0.0)).alias("overhead_percent"),
        gain.alias("speedup"),
        F.when(workers > 0, gain / workers).otherwise(F.lit(0.0)).alias("efficiency"),
    )
