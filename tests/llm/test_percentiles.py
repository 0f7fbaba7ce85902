import math
import random
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import percentiles as P


def nearest(v, p):
    s = sorted(v)
    return s[max(1, math.ceil(p * len(s))) - 1]


def test_order_and_round_trip(spark):
    r = random.Random(1)
    x = [0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 8.0, 7.999999999999999] + [r.gauss(0, 1) * 10.0 ** r.randint(-300, 300) for _ in range(400)]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", P.ordered_bits(F.col("x")).alias("b")).withColumn("y", P.from_ordered_bits(F.col("b"))).collect()
    assert all(g.x == g.y for g in got)
    assert [g.x for g in sorted(got, key=lambda g: g.b)] == sorted(x)
    assert all(g.b == struct.unpack("<q", struct.pack("<d", g.x))[0] for g in got if g.x >= 0)
    nan = spark.createDataFrame([(float("nan"),)], "x double").select(P.ordered_bits(F.col("x")).alias("b")).first().b
    assert nan > max(g.b for g in got)


def test_exact_and_merged(spark):
    r = random.Random(2)
    rows = [(g, d, v) for d in ("a", "b", "c") for g in ("x", "y", None) for v in [round(r.expovariate(1), r.choice([1, 5])) for _ in range(r.choice([1, 40, 300]))]] + [("x", "a", None), ("x", "a", -2.5)]
    df = spark.createDataFrame(rows, "g string, day string, v double")
    ps = (0.0, 0.5, 0.9, 1.0)
    exact = {(r.g, r.p): (r.n, r.value) for r in P.radix_percentiles(df, "v", ["g"], ps).collect()}
    for g in ("x", "y", None):
        v = [x for a, _, x in rows if a == g and x is not None]
        assert all(exact[g, p] == (len(v), nearest(v, p)) for p in ps)
    days = P.digit_histogram(df.filter("g is not null"), "v", ["g"], [F.col("day")])
    whole = P.digit_histogram(df.filter("g is not null"), "v", ["g"])
    merged = P.merge_histograms([days.filter(F.col("day") == d).drop("day") for d in "abc"], ["g"])
    assert sorted(map(tuple, merged.select("g", "digit", "n").collect())) == sorted(map(tuple, whole.select("g", "digit", "n").collect()))
    for r in P.percentiles_from_histogram(merged, ["g"], ps).collect():
        assert abs(r.value - exact[r.g, r.p][1]) <= r.error_bound * 1.0001 and r.error_bound <= max(abs(r.value) * 2**-12, 1e-300)


def test_empty_and_invalid(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert P.radix_percentiles(empty, "v", ["g"], [0.5]).count() == 0
    schema = "decision_id string, target_device string, routing_latency_ms double, timestamp timestamp"
    rows = [("1", " gpu.0", 1.0, None), ("1", " gpu.0", 1.0, None), ("2", "GPU", float("nan"), None), ("3", "GPU", -1.0, None), ("4", "GPU", 0.0, None), ("5", None, 3.0, None), ("6", "Gpu", 2.0, None), ("7", "", 2.0, None)]
    got = P.device_latencies(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.target_device, r.routing_latency_ms) for r in got) == [("GPU", 1.0), ("GPU", 2.0)]


def test_null_and_conflicting_ids(spark):
    schema = "decision_id string, target_device string, routing_latency_ms double, timestamp timestamp"
    rows = [(None, "CPU", 1.0, None)] * 3 + [(None, "CPU", 2.0, None), ("1", "CPU", 5.0, None), ("1", "CPU", 7.0, None), ("1", "cpu ", 5.0, None)]
    got = P.device_latencies(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.routing_latency_ms for r in got) == [1.0, 1.0, 1.0, 2.0, 5.0, 7.0]


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False), st.floats(allow_nan=False))
def test_reference_bits_are_monotonic(a, b):
    bits = lambda x: (lambda u: u if u >= 0 else -(u & 0x7FFFFFFFFFFFFFFF))(struct.unpack("<q", struct.pack("<d", x))[0])
    assert (a < b) == (bits(a) < bits(b)) or a == b
