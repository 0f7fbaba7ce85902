"""Percentiles of very large numeric columns by radix selection.

Each double is mapped, in generated JVM code, to a 64-bit integer of the same order: its own
IEEE bits, with those of negatives flipped. Histograms of the integers' leading bits are the
mergeable form: per group and day (or file, or anything else) a count for each leading digit
that occurs; adding the counts of parts gives the histogram of the whole. Reading a target
rank off the leading ``bits`` is off by less than one part in 2**(bits - 12) of the value.
Where the exact value is wanted, further passes count the next digits of only those values
that share the leading digits of a target rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.runtime import table, written

#: Bits of a digit: 4 passes of 16 give the exact value.
DIGIT_BITS = 16
_MANTISSA = 1 << 52


def ordered_bits(x: Column) -> Column:
    """An order-preserving BIGINT of a DOUBLE; equal for -0.0 and 0.0, greatest for NaN.

    Put together from exponent and mantissa, every step exact: the exponent guessed by a
    logarithm is put right by comparing with the powers of two themselves.
    """
    a = F.abs(x.cast("double"))
    guess = F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1.0)))).cast("int")
    guess = F.greatest(F.lit(-1022), F.least(F.lit(1023), guess))
    two = F.lit(2.0)
    low = F.when(F.pow(two, guess) > a, guess - 1).otherwise(guess)
    e = F.greatest(F.lit(-1022), F.when((low < 1023) & (F.pow(two, low + 1) <= a), low + 1).otherwise(low))
    normal = a >= F.lit(2.2250738585072014e-308)
    fraction = F.when(normal, a / F.pow(two, e) - 1.0).otherwise(a / F.lit(2.2250738585072014e-308))
    bits = F.when(normal, e + 1023).otherwise(F.lit(0)).cast("bigint") * F.lit(_MANTISSA) + (fraction * float(_MANTISSA)).cast("bigint")
    bits = F.when(F.isnan(a), F.lit(0x7FF8 << 48)).when(a == float("inf"), F.lit(0x7FF << 52)).otherwise(bits)
    return F.when((x < 0) & ~F.isnan(a), -bits).otherwise(bits)


def from_ordered_bits(b: Column) -> Column:
    """The DOUBLE that ``ordered_bits`` maps to ``b``."""
    a = F.abs(b)
    e = F.shiftright(a, 52).cast("int")
    m = (a.bitwiseAND(F.lit(_MANTISSA - 1))).cast("double") / float(_MANTISSA)
    value = F.when(e == 0, m * F.lit(2.2250738585072014e-308)).otherwise((m + 1.0) * F.pow(F.lit(2.0), e - 1023))
    value = F.when(a == F.lit(0x7FF << 52), F.lit(float("inf"))).when(a > F.lit(0x7FF << 52), F.lit(float("nan"))).otherwise(value)
    return F.when(b < 0, -value).otherwise(value)


def digit_histogram(df: DataFrame, value: str, groups: Sequence[str], parts: Sequence[Column] = (), bits: int = 24) -> DataFrame:
    """The mergeable form: (parts..., groups..., digit, n) with the leading ``bits`` of each value.

    Null values are not counted; NaN counts as the greatest value. Counted per task before
    anything is shuffled, so the size of what moves is that of the histogram.
    """
    digit = F.shiftright(ordered_bits(F.col(value)), 64 - bits)
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*parts, *[F.col(g) for g in groups], digit.alias("digit"))
        .agg(F.count("*").alias("n"))
    )


def merge_histograms(histograms: Sequence[DataFrame] | DataFrame, groups: Sequence[str]) -> DataFrame:
    """The histogram of all rows from those of parts of them."""
    together = histograms if isinstance(histograms, DataFrame) else reduce(DataFrame.unionByName, histograms)
    return together.groupBy(*groups, "digit").agg(F.sum("n").alias("n"))


def _targets(counts: DataFrame, groups: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    """(groups..., p, rank): nearest ranks, counted from 1."""
    total = counts.groupBy(*groups).agg(F.sum("n").alias("total"))
    return total.select(*groups, "total", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])).alias("p")).withColumn(
        "rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("total"))).cast("bigint")
    )


def _follow(counts: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each target the digit that holds its rank, and the rank within it."""
    line = Window.partitionBy(*keys).orderBy("digit")
    upto = counts.withColumn("end", F.sum("n").over(line))
    here = targets.join(upto, list(keys))
    return here.filter((F.col("rank") <= F.col("end")) & (F.col("rank") > F.col("end") - F.col("n"))).withColumn(
        "rank", F.col("rank") - (F.col("end") - F.col("n"))
    ).drop("n", "end")


def percentiles_from_histogram(histogram: DataFrame, groups: Sequence[str], percentiles: Sequence[float], bits: int = 24) -> DataFrame:
    """(groups..., p, n, value, error_bound) from a (merged) histogram of leading digits.

    ``value`` is the middle of the digit's interval, ``error_bound`` half its width: the exact
    percentile (nearest rank) lies within it.
    """
    found = _follow(histogram, _targets(histogram, groups, percentiles), groups)
    low = F.shiftleft(F.col("digit"), 64 - bits)
    a, b = from_ordered_bits(low), from_ordered_bits(low + F.lit((1 << (64 - bits)) - 1))
    return found.select(*groups, "p", F.col("total").alias("n"), ((a + b) / 2).alias("value"), (F.abs(b - a) / 2).alias("error_bound"))


def radix_percentiles(df: DataFrame, value: str, groups: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    """(groups..., p, n, value): exact nearest-rank percentiles per group.

    Four passes of 16 bits; after each, only the digits that hold a target rank are followed,
    so a pass shuffles at most (groups x percentiles x 65536) counts and in practice far
    fewer. The integers are written to the shared folder once. Null values are not counted, a
    null group is a group, an empty table gives no rows.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    # written once: each pass reads group and integer, and nothing is computed again
    rows = written(
        df.filter(F.col(value).isNotNull()).select(
            *[F.coalesce(F.concat(F.lit("v"), F.col(g).cast("string")), F.lit("n")).alias(k) for g, k in zip(groups, keys, strict=True)],
            ordered_bits(F.col(value)).alias("bits"),
        ),
        "bits",
    )
    digit = lambda shift: F.shiftright(F.col("bits"), shift)
    first = rows.groupBy(*keys, digit(64 - DIGIT_BITS).alias("digit")).agg(F.count("*").alias("n"))
    state = _follow(first, _targets(first, keys, percentiles), keys)
    for shift in (32, 16, 0):
        # the digits followed: (groups x percentiles) rows at most, each a prefix of the next digits
        state = state.withColumnRenamed("digit", "prefix")
        wanted = state.select(*keys, "prefix").distinct()
        counts = (
            rows.withColumn("prefix", digit(shift + DIGIT_BITS))
            .join(wanted, [*keys, "prefix"], "left_semi")
            .groupBy(*keys, "prefix", digit(shift).alias("digit"))
            .agg(F.count("*").alias("n"))
        )
        state = _follow(counts, state, [*keys, "prefix"]).drop("prefix")
    return state.select(
        *[F.when(F.col(k) != "n", F.expr(f"substring({k}, 2)")).alias(g) for g, k in zip(groups, keys, strict=True)],
        "p",
        F.col("total").alias("n"),
        from_ordered_bits(F.col("digit")).alias("value"),
    )


def real_device(name: Column) -> Column:
    """One spelling a device: trimmed, upper case, without the number of a unit (GPU.0)."""
    plain = F.regexp_replace(F.upper(F.trim(name)), r"\.\d+$", "")
    return F.when(plain != "", plain)


def device_latencies(decisions: DataFrame) -> DataFrame:
    """(target_device, routing_latency_ms, day) of valid latencies, repeated rows once.

    Valid is a finite value above zero: null, NaN, zero and the sentinel -1 are none. Which
    values were taken in another unit can't be told from the table, so they stay. Rows without
    a device are left out. A row is repeated if id, device, value and day agree: of an id with
    different values each counts, and every row without an id does.
    """
    return (
        decisions.select(
            "decision_id",
            # rows without an id are kept apart, which also spreads them
            F.when(F.col("decision_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)).alias("apart"),
            real_device(F.col("target_device")).alias("target_device"),
            F.col("routing_latency_ms").cast("double").alias("routing_latency_ms"),
            F.to_date("timestamp").alias("day"),
        )
        .filter((F.col("routing_latency_ms") > 0) & (F.col("routing_latency_ms") < float("inf")) & F.col("target_device").isNotNull())
        .dropDuplicates(["decision_id", "apart", "target_device", "routing_latency_ms", "day"])
        .select("target_device", "routing_latency_ms", "day")
    )


PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_device, p, n, value): exact percentiles of valid latencies per real device."""
    valid = device_latencies(table(spark, sf_dir, "routing_decisions"))
    return radix_percentiles(valid, "routing_latency_ms", ["target_device"], PERCENTILES)


def p2_daily_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, target_device, digit, n): the form in which days are kept and combined."""
    valid = device_latencies(table(spark, sf_dir, "routing_decisions"))
    return digit_histogram(valid, "routing_latency_ms", ["target_device"], [F.col("day")])


def p2_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_device, p, n, value, error_bound) of all days, from the days' histograms alone."""
    days = p2_daily_histograms(spark, sf_dir)
    return percentiles_from_histogram(merge_histograms(days, ["target_device"]), ["target_device"], PERCENTILES)


_VALID_SQL = """latencies AS (
  SELECT decision_id, regexp_replace(upper(trim(target_device)), '\\.[0-9]+$', '') AS target_device,
         routing_latency_ms AS v, CAST("timestamp" AS DATE) AS day
  FROM routing_decisions
  WHERE target_device IS NOT NULL AND trim(target_device) <> '' AND routing_latency_ms > 0
    AND NOT isnan(routing_latency_ms) AND routing_latency_ms < CAST('infinity' AS DOUBLE)
), valid AS (
  SELECT DISTINCT * FROM latencies WHERE decision_id IS NOT NULL
  UNION ALL SELECT * FROM latencies WHERE decision_id IS NULL
)"""
_RANKED_SQL = f"""{_VALID_SQL}, ranked AS (
  SELECT target_device, v, row_number() OVER (PARTITION BY target_device ORDER BY v) AS rn,
         count(*) OVER (PARTITION BY target_device) AS n
  FROM valid
), ps AS (SELECT unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS p),
picked AS (SELECT target_device, p, n, v FROM ranked, ps WHERE rn = greatest(1, CAST(ceil(p * n) AS BIGINT)))"""
# The exponent of a value: a guess by logarithm, put right by comparing with powers of two.
_EXPONENT = "CAST(floor(log2(v)) AS INTEGER) + CASE WHEN pow(2::DOUBLE, floor(log2(v))) > v THEN -1 WHEN pow(2::DOUBLE, floor(log2(v)) + 1) <= v THEN 1 ELSE 0 END"

QUERIES = {"p2_percentiles": p2_percentiles, "p2_daily_histograms": p2_daily_histograms, "p2_from_days": p2_from_days}
SQL = {
    "p2_percentiles": f"WITH {_RANKED_SQL} SELECT target_device, p, n, v AS value FROM picked",
    # 24 leading bits: sign, eleven bits of the exponent and twelve of the fraction
    "p2_daily_histograms": f"""WITH {_VALID_SQL}, e AS (SELECT *, {_EXPONENT} AS e FROM valid)
SELECT day, target_device, CAST((e + 1023) * 4096 + floor((v / pow(2::DOUBLE, e) - 1) * 4096) AS BIGINT) AS digit, count(*) AS n FROM e GROUP BY ALL""",
    "p2_from_days": f"""WITH {_RANKED_SQL}, e AS (SELECT *, {_EXPONENT} AS e FROM picked),
b AS (SELECT *, floor(v * pow(2::DOUBLE, 12 - e)) * pow(2::DOUBLE, e - 12) AS low FROM e),
ends AS (SELECT *, low + pow(2::DOUBLE, e - 12) - pow(2::DOUBLE, e - 52) AS high FROM b)
SELECT target_device, p, n, (low + high) / 2 AS value, abs(high - low) / 2 AS error_bound FROM ends""",
}
