import datetime as dt

from folioflow.streaming import telemetry as S

T0 = dt.datetime(2025, 3, 3)
SCHEMA = "worker_id string, ts timestamp, cpu_percent double, ram_percent double, queue_depth int, state string"


def beats(worker, seconds):
    return [(worker, T0 + dt.timedelta(seconds=s), 10.0, 20.0, 1, "odd") for s in seconds]


def run(spark, tmp_path, batches, build, mode="append"):
    src = tmp_path / "in"
    src.mkdir()
    out = []
    stream = spark.readStream.schema(SCHEMA).parquet(str(src))
    q = build(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
            del i
            q.processAllAvailable()
    finally:
        q.stop()
    return out


def test_loss_and_return(spark, tmp_path):
    batches = [beats("a", [0, 10, 20]) + beats("b", [0, 15, 30]), beats("a", [50, 60]) + beats("b", [45]), beats("c", [200]), beats("c", [300])]
    got = run(spark, tmp_path, batches, S.lost_workers)
    kinds = [(r.worker_id, r.kind) for r in got]
    assert kinds.count(("a", "RECONNECTED")) == 1 and ("a", "LOST") in kinds
    assert ("b", "RECONNECTED") not in kinds  # gaps of exactly the timeout are none
    assert ("b", "LOST") in kinds  # by the timer, once time has moved on


def test_windows(spark, tmp_path):
    got = run(spark, tmp_path, [beats("a", [0, 60]), beats("b", [400]), beats("b", [4000])], S.windowed_load)
    assert [(r.start, r.queue) for r in sorted(got)][:1] == [(T0, 2)]


def test_latest(spark, tmp_path):
    got = run(spark, tmp_path, [beats("a", [0]), beats("a", [60])], S.latest_by_worker, "update")
    assert got[-1].ts == T0 + dt.timedelta(seconds=60) and got[-1].state == "active"
