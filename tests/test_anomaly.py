import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators.anomaly import esd_outliers, implausible_readings, run_lengths, spikes

T0 = dt.datetime(2025, 3, 3)
SCHEMA = "snapshot_id bigint, node_id string, cpu_percent double, memory_percent double, timestamp timestamp, src string, block int"


def rows(values, node="a", first=1, step=60):
    return [(first + i, node, v, 50.0 + (i % 7), T0 + dt.timedelta(seconds=step * i), "clash", 9) for i, v in enumerate(values)]


def kinds(df, metric="cpu_percent"):
    return {(r.snapshot_id, r.kind) for r in df.filter(F.col("metric") == metric).collect()}


def test_kinds(spark):
    rng = np.random.default_rng(1)
    v = (20 + rng.normal(0, 0.4, 300)).round(2).tolist()
    v[100], v[101] = 55.0, 56.0
    v[150] = -3.0
    v[160] = float("nan")
    v[200:206] = [20.5] * 6
    v[220:225] = [20.25] * 5
    v[250] = None
    for i in range(260, 300):
        v[i] += 30  # a lasting step
    got = kinds(implausible_readings(spark.createDataFrame(rows(v), SCHEMA)))
    assert got == {(101, "spike"), (102, "spike"), (151, "impossible"), (161, "impossible"), *[(i, "stuck") for i in range(201, 207)]}


def test_null_ends_a_run_and_repeated_rows_count_once(spark):
    v = [10.0 + (i % 5) for i in range(60)]
    v[20:27] = [11.5, 11.5, 11.5, None, 11.5, 11.5, 11.5]
    data = rows(v)
    got = implausible_readings(spark.createDataFrame(data + data, SCHEMA))
    assert kinds(got) == set()


def test_blocks_do_not_matter(spark):
    rng = np.random.default_rng(2)
    v = (40 + rng.normal(0, 1, 3000)).round(2).tolist()
    for i in range(50, 2950, 97):
        v[i] = 90.0
    v[990:1010] = [41.11] * 20
    df = spark.createDataFrame(rows(v), SCHEMA)
    one = kinds(implausible_readings(df, block_rows=100_000))
    many = kinds(implausible_readings(df, block_rows=300))
    assert one == many and len([x for x in one if x[1] == "spike"]) == 30 and len([x for x in one if x[1] == "stuck"]) == 20


def test_nulls_and_empty(spark):
    data = [(1, None, 120.0, None, None, None, None), (2, None, None, 5.0, T0, None, None), (None, "x", -1.0, -1.0, T0, None, None)]
    got = implausible_readings(spark.createDataFrame(data, SCHEMA)).collect()
    assert {(r.snapshot_id, r.metric, r.kind) for r in got} == {(1, "cpu_percent", "impossible"), (None, "cpu_percent", "impossible"), (None, "memory_percent", "impossible")}
    assert implausible_readings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parts():
    assert run_lengths(np.array([1.0, 1, 2, 2, 2]), np.array([True, True, True, False, True])).tolist() == [2, 2, 1, 0, 1]
    x = np.r_[np.random.default_rng(0).normal(0, 1, 500), 15.0]
    assert esd_outliers(x)[-1] and esd_outliers(x).sum() <= 3
    assert not esd_outliers(np.zeros(5)).any()
    assert spikes(np.array([1.0, 1, 1]), np.zeros(3), 0.05, 6, 3, 5, 7).sum() == 0
