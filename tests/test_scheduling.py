import random

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators import benchstats as N
from folioflow.operators import routing as M
from folioflow.operators import scheduling as Q
from folioflow.operators.vectorindex import VectorIndex


def test_global_rank(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1, 1, 1, 2, 3, None])) for i in range(500)]
    got = Q.global_rank(spark.createDataFrame(rows, "id int, pages int"), [F.desc("pages"), F.col("id")]).collect()
    want = sorted(rows, key=lambda x: (-(x[1] or 0), x[0]))
    assert [x.id for x in sorted(got, key=lambda x: x.rank)] == [i for i, _ in want] and sorted(x.rank for x in got) == list(range(1, 501))
    assert Q.global_rank(spark.createDataFrame([], "id int, pages int"), [F.col("id")]).count() == 0


def test_dispatch_is_that_of_one_by_one(spark):
    loads = {"c": 2, "a": 0, "b": 5}
    units = spark.range(1, 31).select(F.col("id").alias("drain"))
    workers = spark.createDataFrame(list(loads.items()), "worker_id string, in_flight int")
    got = {x.drain: x.worker_id for x in Q.dispatch(units, workers).collect()}
    for i in range(1, 31):
        w = min(loads, key=lambda x: (loads[x], x))
        loads[w] += 1
        assert got[i] == w
    assert {x.worker_id for x in Q.dispatch(units, workers.limit(0)).collect()} == {None}


def test_queue_state(spark):
    rows = [(1, 1, "insert", 5), (2, 2, "insert", 7), (3, 1, "remove", None), (4, 1, "insert", 9), (5, 2, "update", 1), (6, 3, "insert", 2), (7, 3, "remove", None)]
    got = Q.queue_state(spark.createDataFrame(rows, "at int, unit int, kind string, priority int"), "unit", ["at"], "kind", "priority").collect()
    assert sorted((x.unit, x.priority, x.arrival.at) for x in got) == [(1, 9, 4), (2, 1, 2)]


def test_recovery_gives_up_after_three(spark):
    losses = spark.createDataFrame([("w", i) for i in range(5)] + [("idle", 9)], "worker_id string, at int")
    held = spark.createDataFrame([("w", i, "u") for i in range(5)] + [("w", 0, "v")], "worker_id string, at int, unit string")
    got = Q.recovery_log(losses, held).collect()
    assert [x.event for x in sorted(got, key=lambda x: x.at) if x.unit == "u"] == ["RETRY_SCHEDULED"] * 3 + ["RETRY_EXHAUSTED"] * 2
    assert {(x.worker_id, x.at, x.retry) for x in got if x.event == "TASKS_RECOVERED"} == {("w", 0, 2), ("w", 1, 1), ("w", 2, 1)}
    assert sum(x.event == "WORKER_LOST" for x in got) == 6


def test_percentile_rules_of_any_numbers(spark):
    r = random.Random(4)
    rows = [(g, v) for g in ("x", None) for v in [r.gauss(0, 1) * 10 ** r.randint(-3, 3) for _ in range(300)] + [0.0] * 40 + [None]]
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {x.g: x for x in N.percentile_rules(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", p).collect()}
        for g in ("x", None):
            v = sorted(b for a, b in rows if a == g and b is not None)
            n = len(v)
            assert got[g].nearest == v[max(0, int(np.ceil(n * p)) - 1)] and got[g].floor_index == v[min(n - 1, int(n * p))]
            assert abs(got[g].linear - np.quantile(v, p)) < 1e-9 * max(1, abs(got[g].linear)) and got[g].n == n
    assert N.percentile_rules(spark.createDataFrame([], "g string, v double"), ["g"], "v", 0.5).count() == 0


def test_hold_over_gaps_blocks_and_release(spark):
    r = random.Random(8)
    rows, t = [], 0
    for i in range(900):
        t += r.choice([1, 1, 2, 5, 700, 5000])
        rows.append((i, "n" if i % 3 else None, t, r.choice(["CPU", "GPU", "NPU"]), r.random() < 0.2))
    df = spark.createDataFrame(rows, "id int, node string, t int, device string, free boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = {x.id: (x.device, x.held) for x in M.held_devices(df, "node", "ts", "id", "device", 4.0, "free", block_seconds=600).collect()}
    for node in ("n", None):
        now = switched = None
        for i, _, at, asked, free in (x for x in rows if x[1] == node):
            held = now is not None and asked != now and switched is not None and at - switched < 4 and not (free and now == "GPU")
            if asked != now and not held:
                now, switched = asked, at
            assert got[i] == (now, held)


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 600)] + rng.normal(size=(600, 16)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None), (1000, [0.0] * 16)], "id int, vector array<double>")
    VectorIndex.build(df, 20).write(str(tmp_path))
    index = VectorIndex.read(spark, str(tmp_path))
    asked = df.filter("id % 50 = 0 and id < 600").select(F.col("id").alias("query"), F.col("vector").alias("query_vector"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    best = {q: set(np.argsort(-(u @ u[q]))[:5].tolist()) for q in range(0, 600, 50)}
    got = index.search(asked, 5, probes=6).collect()
    assert sum(g.id in best[g.query] for g in got) >= 0.9 * 5 * len(best)
    exact = index.search(asked, 5, probes=20).collect()
    assert all(g.id in best[g.query] for g in exact) and len(exact) == 60
    assert not index.without(spark.createDataFrame([(0,)], "id int")).vectors.filter("id = 0").count()
