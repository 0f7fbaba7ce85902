"""Queries over snapshots, routing decisions and events: monitoring, routing and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from folioflow.operators import benchstats as N
from folioflow.operators import pages as P
from folioflow.operators import routing as M
from folioflow.operators import scheduling as Q
from folioflow.operators.anomaly import implausible_readings, with_margins
from folioflow.runtime import null_safe_key, scratch, table
from folioflow.sources import files as S
from folioflow.streaming import telemetry as T


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_id, metric, kind) of every implausible reading."""
    return implausible_readings(table(spark, sf_dir, "resource_snapshots")).distinct()


def _apart(key: str):  # noqa: ANN202
    """What keeps rows without a key apart while repeated rows come together."""
    return F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)).alias("_apart")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots, rows repeated unchanged once, with plausible readings only; rows without an id all stay."""
    columns = ("snapshot_id", "node_id", "timestamp", "cpu_percent", "memory_percent", "gpu_available", "gpu_utilization_percent", "queue_length", "active_workers", "ram_used_mb")
    s = table(spark, d, "resource_snapshots").select(*columns, _apart("snapshot_id")).dropDuplicates()
    ok = lambda c: F.when(F.col(c).between(0, 100), F.col(c))
    return s.select("snapshot_id", "node_id", F.col("timestamp").alias("ts"), ok("cpu_percent").alias("cpu"), ok("memory_percent").alias("memory"), "gpu_available", F.col("gpu_utilization_percent").alias("gpu"), "queue_length", "active_workers", "ram_used_mb")


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Routing decisions, rows repeated unchanged once; rows without an id all stay."""
    columns = ("decision_id", "node_id", "timestamp", "target_device", "routing_latency_ms", "policy_version", "applied_rule", "page_number", "confidence", "document_id")
    r = table(spark, d, "routing_decisions").select(*columns, _apart("decision_id")).dropDuplicates()
    device = F.regexp_replace(F.upper(F.trim("target_device")), r"\.[0-9]+$", "")
    valid = (F.col("routing_latency_ms") > 0) & (F.col("routing_latency_ms") < float("inf"))
    return r.select("decision_id", "node_id", F.col("timestamp").alias("ts"), device.alias("device"), F.when(valid, F.col("routing_latency_ms")).alias("ms"), "policy_version", "applied_rule", "page_number", "confidence", "document_id")


def _in_blocks(rows: DataFrame, margin: int) -> tuple[DataFrame, WindowSpec]:
    """Rows of a node's series in blocks with a margin, and the line of a block: no node is one task."""
    timed = rows.filter(F.col("ts").isNotNull()).withColumn("src", null_safe_key(F.col("node_id"))).withColumn("unit", F.floor(F.unix_micros("ts") / 600_000_000))
    return with_margins(timed, 100_000, margin), Window.partitionBy("src", "block").orderBy("ts", "snapshot_id")


def worker_latest(spark: SparkSession, d: str) -> DataFrame:
    last = F.max_by(F.struct("snapshot_id", "cpu", "memory", "queue_length"), F.struct("ts", "snapshot_id")).alias("s")
    return _snapshots(spark, d).groupBy("node_id").agg(last).select("node_id", "s.snapshot_id", P.utilisation(F.col("s.cpu"), F.col("s.memory")).alias("utilisation"), F.col("s.queue_length").alias("queue_length"))


def heartbeat_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows, line = _in_blocks(_snapshots(spark, d).select("node_id", "snapshot_id", "ts"), 1)
    gap = (F.unix_micros(F.lead("ts").over(line)) - F.unix_micros("ts")) / 1e6
    return rows.withColumn("gap", gap).filter(F.col("own") & (F.col("gap") > 300)).select("node_id", "snapshot_id", F.round("gap", 3).alias("gap_seconds"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of a node without a gap of ten minutes or more."""
    s = _snapshots(spark, d)
    return s.groupBy("node_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("samples"), F.max("ts").alias("last")).select("node_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("last").alias("last_us"), "samples")


def resource_windows(spark: SparkSession, d: str) -> DataFrame:
    w = _snapshots(spark, d).groupBy(F.window("ts", "5 minutes").alias("w")).agg(
        F.round(F.avg("cpu"), 9).alias("cpu"), F.round(F.avg("memory"), 9).alias("memory"), F.round(F.avg(F.when(F.col("gpu_available"), F.col("gpu"))), 9).alias("gpu"), F.sum("queue_length").alias("queue"), F.count_distinct("node_id").alias("nodes")
    )
    advice = Q.scaling_advice(F.col("cpu"), F.col("queue"), F.col("nodes"))
    return w.select(F.unix_seconds("w.start").alias("start_s"), "cpu", "memory", "gpu", "queue", "nodes", advice["action"].alias("action"), advice["target"].alias("target"))


def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("queue_length") >= 6, "overloaded").when((F.col("active_workers") == 0), "idle").otherwise("active")
    order = F.when(F.col("state") == "active", 0).when(F.col("state") == "idle", 1).otherwise(2)
    return _snapshots(spark, d).withColumn("state", state).groupBy("state").agg(F.count("*").alias("samples"), F.round(F.avg("cpu"), 9).alias("cpu"), F.round(F.avg("memory"), 9).alias("memory"), F.sum("queue_length").alias("queued")).withColumn("place", order)


def moving_average(spark: SparkSession, d: str) -> DataFrame:
    rows, line = _in_blocks(_snapshots(spark, d).select("node_id", "snapshot_id", "ts", "cpu", "queue_length"), 60)
    growth = F.greatest(F.lit(0), F.coalesce(F.col("queue_length") - F.lag("queue_length").over(line), F.lit(0)))
    both = rows.select("own", "snapshot_id", F.round(F.avg("cpu").over(line.rowsBetween(-59, 0)), 9).alias("cpu_60"), growth.alias("queue_growth"))
    return both.filter("own").drop("own")


def recent_samples(spark: SparkSession, d: str) -> DataFrame:
    line = Window.partitionBy("node_id").orderBy(F.desc("ts"), F.desc("snapshot_id"))
    return _snapshots(spark, d).withColumn("age", F.row_number().over(line)).filter(F.col("age") <= 5).select("node_id", "snapshot_id", "age")


def steal_plan(spark: SparkSession, d: str) -> DataFrame:
    """Idle nodes paired with the most loaded ones, first with first; half of a queue moves."""
    last = _snapshots(spark, d).groupBy("node_id").agg(F.max_by("queue_length", F.struct("ts", "snapshot_id")).alias("depth"))
    idle = last.filter(F.col("depth") <= 2).withColumn("place", F.row_number().over(Window.orderBy("depth", "node_id")))
    busy = last.filter(F.col("depth") > 2).withColumn("place", F.row_number().over(Window.orderBy(F.desc("depth"), "node_id")))
    take = F.least(F.greatest(F.lit(1), F.floor(F.col("b.depth") * 0.5)), F.col("b.depth") - 1)
    return idle.alias("a").join(busy.alias("b"), "place").select(F.col("a.node_id").alias("thief"), F.col("b.node_id").alias("victim"), take.cast("bigint").alias("units"))


def recovery_events(spark: SparkSession, d: str) -> DataFrame:
    """Each failure of a unit is retried up to three times, then given up."""
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tries = F.row_number().over(line)
    return table(spark, d, "events").filter(F.col("event_type") == "error").select("event_id", "user_id", tries.alias("attempt")).withColumn("outcome", F.when(F.col("attempt") <= 3, "RETRY_SCHEDULED").otherwise("RETRY_EXHAUSTED"))


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest entries of three logs (a report, hence its limit)."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("entry"), F.col("ts").cast("timestamp").alias("at"), F.lit("event").alias("log"))
    r = _decisions(spark, d).select(F.col("decision_id").alias("entry"), F.col("ts").alias("at"), F.lit("routing").alias("log"))
    s = _snapshots(spark, d).select(F.col("snapshot_id").cast("string").alias("entry"), F.col("ts").alias("at"), F.lit("snapshot").alias("log"))
    return e.unionByName(r).unionByName(s).filter(F.col("at").isNotNull()).orderBy(F.desc("at"), "log", "entry").limit(100).select("entry", F.unix_micros("at").alias("at_us"), "log")


def stage_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.max_by("value", F.struct("ts", "event_id")))


def task_fractions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def event_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    g = F.grouping_id().cast("bigint").alias("level")
    return e.rollup("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), g)


def routing_metrics(spark: SparkSession, d: str) -> DataFrame:
    n = _decisions(spark, d).groupBy("device").agg(F.count("*").alias("decisions"), F.count("ms").alias("timed"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return n.withColumn("share", F.round(F.col("decisions") / F.sum("decisions").over(Window.partitionBy()), 6))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = N.percentile_rules(_decisions(spark, d).filter(F.col("device").isNotNull()), ["device"], "ms", 0.95)
    return p.select("device", "n", "nearest", "floor_index", F.round("linear", 6).alias("linear"))


def run_aggregate(spark: SparkSession, d: str) -> DataFrame:
    r = _decisions(spark, d).filter(F.col("ms").isNotNull())
    first = F.min_by("device", F.when(F.col("device").isNotNull(), F.struct("ts", "decision_id")))  # the first that is known
    return r.groupBy("policy_version", "applied_rule").agg(
        F.count("*").alias("runs"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.round(F.coalesce(F.stddev_samp("ms"), F.lit(0.0)), 4).alias("std_ms"), F.round(N.coefficient_of_variation(F.col("ms")), 4).alias("cv"),
        F.round(F.count_if(F.col("device") == "GPU") / F.count("*") * 100, 6).alias("gpu_percent"), first.alias("first_device"), (F.count("*") < 5).alias("exploratory"),
    )


def policy_compare(spark: SparkSession, d: str) -> DataFrame:
    r = _decisions(spark, d).filter(F.col("ms").isNotNull() & F.col("device").isin("CPU", "GPU", "FALLBACK"))
    w = r.groupBy("policy_version").pivot("device", ["CPU", "FALLBACK", "GPU"]).agg(F.avg("ms"))
    reg = N.regret(F.col("FALLBACK"), F.col("CPU"), F.col("GPU"))
    return w.select("policy_version", F.round("CPU", 9).alias("cpu_ms"), F.round("GPU", 9).alias("gpu_ms"), F.round("FALLBACK", 9).alias("fallback_ms"), F.round(reg, 4).alias("regret"), F.round(N.speedup(F.col("CPU"), F.col("GPU")), 4).alias("speedup"), F.round(N.percent_change(F.col("CPU"), F.col("GPU")), 3).alias("change"))


def device_crossover(spark: SparkSession, d: str) -> DataFrame:
    r = _decisions(spark, d).filter(F.col("ms").isNotNull() & F.col("page_number").isNotNull())
    w = r.groupBy("page_number").agg(F.round(F.avg(F.when(F.col("device") == "CPU", F.col("ms"))), 6).alias("cpu"), F.round(F.avg(F.when(F.col("device") == "GPU", F.col("ms"))), 6).alias("gpu"))
    return w.agg(F.min(F.when(F.col("gpu") < F.col("cpu"), F.col("page_number"))).alias("crossover"), F.count_if(F.col("gpu") < F.col("cpu")).alias("pages_gpu_faster"))


def oracle_agreement(spark: SparkSession, d: str) -> DataFrame:
    r = _decisions(spark, d).filter(F.col("device").isin("CPU", "GPU"))
    best = r.groupBy("policy_version").agg(F.when(F.round(F.avg(F.when(F.col("device") == "GPU", F.col("ms"))), 6) < F.round(F.avg(F.when(F.col("device") == "CPU", F.col("ms"))), 6), "GPU").otherwise("CPU").alias("oracle"))
    return r.join(best, "policy_version").groupBy("policy_version", "oracle").agg(F.round(F.avg((F.col("device") == F.col("oracle")).cast("int")), 6).alias("agreement"))


def device_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules A to H. The table has neither effort nor GPU memory: the id and what is left of 8 GB of RAM stand in."""
    s = _snapshots(spark, d)
    effort = F.round(F.pmod(F.col("snapshot_id"), F.lit(100)) / 100.0, 2)
    free = 8192.0 - F.col("ram_used_mb")
    r = M.device_rules(F.col("gpu_available"), F.coalesce("cpu", F.lit(-1.0)), F.coalesce("memory", F.lit(-1.0)), F.col("gpu"), F.col("active_workers"), effort, free)
    return s.select("snapshot_id", r["device"].alias("device"), r["rule"].alias("rule"))


def device_suitability(spark: SparkSession, d: str) -> DataFrame:
    """Scores of both devices; intensity, text density and GPU memory, which the table lacks, are stood in for as in ``device_rules``."""
    level, text = F.pmod(F.col("snapshot_id"), F.lit(101)) / 101.0, F.pmod(F.col("snapshot_id"), F.lit(37)) / 37.0
    s = _snapshots(spark, d).filter(F.col("cpu").isNotNull() & F.col("gpu").isNotNull())
    r = M.suitability(level, text, F.col("gpu"), F.col("cpu"), F.col("queue_length"), F.col("active_workers") > 2, F.col("active_workers"), 8192.0 - F.col("ram_used_mb"), F.lit(0))
    return s.select("snapshot_id", r["cpu_score"].alias("cpu_score"), r["gpu_score"].alias("gpu_score"), r["confidence"].alias("confidence"), r["backend"].alias("backend"), r["reason"].alias("reason"))


def device_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    """The device held for 30 seconds; rules A and D say that the GPU is lost or overloaded."""
    rows = _decisions(spark, d).withColumn("release", F.col("applied_rule").isin("A", "D"))
    return M.held_devices(rows, "node_id", "ts", "decision_id", "device", 30.0, "release")


def worker_states(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, state, available, depth) as of the newest beat of all: lost, overloaded, idle or active."""
    last = _snapshots(spark, d).groupBy("node_id").agg(F.max_by(F.struct("ts", "queue_length", "active_workers"), F.struct("ts", "snapshot_id")).alias("s")).select("node_id", "s.*")
    now = last.agg(F.max("ts").alias("now"))  # one row
    depth = F.coalesce("queue_length", F.lit(0))
    state = F.when(F.unix_micros("now") - F.unix_micros("ts") > 900_000_000, "lost").when(depth >= 6, "overloaded").when(F.col("active_workers") == 0, "idle").otherwise("active")
    return last.crossJoin(F.broadcast(now)).select("node_id", state.alias("state"), state.isin("idle", "active").alias("available"), depth.cast("bigint").alias("depth"))


def recovery_log(spark: SparkSession, d: str) -> DataFrame:
    """What follows each loss of a node: a gap of more than ten minutes after its decisions of the last minute."""
    beats, line = _in_blocks(_snapshots(spark, d).select("node_id", "snapshot_id", "ts"), 1)
    lost = beats.withColumn("next", F.lead("ts").over(line)).filter(F.col("own") & (F.unix_micros("next") - F.unix_micros("ts") > 600_000_000)).select(F.col("node_id").alias("worker_id"), F.col("ts").alias("at"))
    # minutes make the range join an equal one; both are few rows a minute and node
    minute = lambda c: F.floor(F.unix_micros(c) / 60_000_000)
    near = lost.select("worker_id", "at", F.explode(F.array(minute("at") - 1, minute("at"))).alias("minute"))
    made = _decisions(spark, d).filter(F.col("document_id").isNotNull()).select(F.col("node_id").alias("worker_id"), "ts", "document_id", minute("ts").alias("minute"))
    within = (F.col("ts") <= F.col("at")) & (F.unix_micros("at") - F.unix_micros("ts") <= 60_000_000)
    held = near.join(made, ["worker_id", "minute"]).filter(within).select("worker_id", "at", F.col("document_id").alias("unit"))
    return Q.recovery_log(lost, held).withColumn("at_us", F.unix_micros("at")).drop("at")


def queue_state(spark: SparkSession, d: str) -> DataFrame:
    """A queue of users after all events: an error takes one out, all else puts it in or changes its priority."""
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "insert").otherwise("update"))
    left = Q.queue_state(e, "user_id", ["ts", "event_id"], "kind", "value")
    return Q.global_rank(left, [F.desc("priority"), F.col("arrival"), F.col("user_id")], "place").select("user_id", "priority", "place")


def stage_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Last value of each kind of event and mean, number and errors of all, a row a user."""
    kinds = ["click", "purchase", "signup", "view"]
    last = [F.max_by("value", F.when(F.col("event_type") == k, F.struct("ts", "event_id"))).alias(k) for k in kinds]
    return table(spark, d, "events").groupBy("user_id").agg(*last, F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("events"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Runs (a document under a policy) by rule: the first of a group warms up and counts only if it is alone.

    Medians of runs and of the pooled latencies, their 95th percentile by nearest rank, the
    latency of the group's very first decision as its cold start.
    """
    r = _decisions(spark, d).filter(F.col("ms").isNotNull() & F.col("document_id").isNotNull() & F.col("policy_version").isNotNull() & F.col("applied_rule").isNotNull())
    group = ["policy_version", "applied_rule"]
    first = F.struct("ts", "decision_id")
    runs = r.groupBy(*group, "document_id").agg(F.sum("ms").alias("total"), F.min(first).alias("begun"), F.min_by("ms", first).alias("cold"))
    opening = runs.groupBy(*group).agg(F.min_by("document_id", "begun").alias("warm"), F.count("*").alias("runs"), F.min_by("cold", "begun").alias("cold_start"))
    kept = (F.col("document_id") != F.col("warm")) | (F.col("runs") == 1)
    measured = runs.join(opening, group).filter(kept)
    times = measured.groupBy(*group).agg(
        F.count("*").alias("samples"), F.round(F.avg("total"), 6).alias("mean_ms"), F.round(F.coalesce(F.stddev_samp("total"), F.lit(0.0)), 6).alias("std_ms"), F.round(F.percentile("total", 0.5), 6).alias("median_ms"), F.first("cold_start").alias("cold_start_ms"), (F.count("*") < 5).alias("exploratory"),
    )
    pooled = r.join(opening.select(*group, "warm", "runs"), group).filter(kept)
    latency = N.percentile_rules(pooled, group, "ms", 0.95).select(*group, F.col("nearest").alias("p95_ms"))
    middle = N.percentile_rules(pooled, group, "ms", 0.5).select(*group, F.round("linear", 6).alias("median_latency_ms"))
    return times.join(latency, group).join(middle, group)


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median, least, greatest and 95th percentile (nearest rank) of the latencies of each policy."""
    r = _decisions(spark, d).filter(F.col("ms").isNotNull() & F.col("policy_version").isNotNull())
    plain = r.groupBy("policy_version").agg(F.round(F.avg("ms"), 4).alias("mean_ms"), F.min("ms").alias("least_ms"), F.max("ms").alias("most_ms"))
    p95 = N.percentile_rules(r, ["policy_version"], "ms", 0.95).select("policy_version", F.col("nearest").alias("p95_ms"))
    p50 = N.percentile_rules(r, ["policy_version"], "ms", 0.5).select("policy_version", F.round("linear", 6).alias("median_ms"))
    return plain.join(p95, "policy_version").join(p50, "policy_version")


def cluster_runs(spark: SparkSession, d: str) -> DataFrame:
    """Throughput, overhead, speed-up and efficiency of each node's run, and whether the overhead is below one percent."""
    r = _decisions(spark, d).filter(F.col("ms").isNotNull() & F.col("node_id").isNotNull())
    a = r.groupBy("node_id").agg(F.count("*").alias("pages"), ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6).alias("wall"), (F.round(F.sum("ms"), 6) / 1e3).alias("busy"), F.count_distinct("policy_version").alias("workers"))
    x = N.cluster_result(F.col("pages"), F.col("wall"), F.col("busy"), F.col("workers"), F.lit(None).cast("double"))
    return a.select("node_id", "pages", *[F.round(x[c], 6).alias(c) for c in ("throughput", "overhead_percent", "speedup", "efficiency")], (x["overhead_percent"] < 1).alias("light"))


def executed_devices(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by the device that ran them: what rule A failed falls back to the processor."""
    x = M.executed_device(F.col("device"), F.col("applied_rule") == "A")
    r = _decisions(spark, d).filter(F.col("device").isNotNull() & F.col("applied_rule").isNotNull())
    return r.select(x["device"].alias("device"), x["fallback"].alias("fallback"), M.is_costly(F.col("ms") / 1e3, F.col("confidence") * 2).alias("costly")).groupBy("device", "fallback", "costly").agg(F.count("*").alias("decisions"))


def dashboard_points(spark: SparkSession, d: str) -> DataFrame:
    """The dashboard's state as written and read back: the last 60 points of each node, oldest first."""
    line = Window.partitionBy("node_id").orderBy(F.desc("ts"), F.desc("snapshot_id"))
    last = _snapshots(spark, d).filter(F.col("node_id").isNotNull()).withColumn("age", F.row_number().over(line)).filter(F.col("age") <= 60)
    point = F.struct(F.unix_micros("ts").alias("at_us"), "snapshot_id", "cpu")
    state = last.groupBy("node_id").agg(F.array_sort(F.collect_list(point)).alias("points"))  # sixty a node
    path = scratch(spark, "dashboard")
    S.write_state(state, path)
    kept = S.read_state(spark, path, "node_id string, points array<struct<at_us:bigint,snapshot_id:bigint,cpu:double>>")
    return kept.select("node_id", F.size("points").cast("bigint").alias("points"), F.col("points")[0]["at_us"].alias("from_us"), F.element_at("points", -1)["at_us"].alias("to_us"), F.round(F.aggregate("points", F.lit(0.0), lambda a, x: a + F.coalesce(x["cpu"], F.lit(0.0))), 6).alias("cpu_sum"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events through Structured Streaming: counts and sums per hour and kind, all that is there, then stop."""
    stream = T.read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    totals = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    path = T.run_once(spark, totals, "complete")
    return spark.read.parquet(path).select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """Newest event of each user through Structured Streaming."""
    stream = T.read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = stream.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    return spark.read.parquet(T.run_once(spark, last, "complete")).select("user_id", "last.event_id", "last.event_type")


def stream_returns(spark: SparkSession, d: str) -> DataFrame:
    """Users that come back after six hours without an event, by the stateful stream that also finds their loss."""
    beats = T.read_stream(spark, d, "events").select(F.col("user_id").cast("string").alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"))
    path = T.run_once(spark, T.lost_workers(beats, 21_600.0), "append")
    back = spark.read.schema(T.LOSS_SCHEMA).parquet(path).filter("kind = 'RECONNECTED'")
    return back.select("worker_id", F.unix_micros("at").alias("at_us"), F.round("gap_seconds", 3).alias("gap_seconds"))


def stream_log(spark: SparkSession, d: str) -> DataFrame:
    """Events of three kinds appended to a CSV log by a stream, read back and counted."""
    path = T.append_stream_log(T.read_stream(spark, d, "events").filter(F.col("event_type").isin("error", "signup", "view")), scratch(spark, "log"))
    log = spark.read.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double").option("header", "true").csv(path)
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    """The cache as it stands: the newest row of each key."""
    newest = F.max(F.struct("created_at", "vector_bytes")).alias("row")
    c = table(spark, d, "embedding_cache").filter(F.col("cache_key").isNotNull()).groupBy("cache_key").agg(newest)
    return c.select("cache_key", F.unix_micros("row.created_at").alias("created_us"), F.octet_length("row.vector_bytes").cast("bigint").alias("bytes"), F.coalesce(F.octet_length("row.vector_bytes") != 256, F.lit(True)).alias("corrupt"))


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose text is not in the content-addressed cache."""
    c = table(spark, d, "chunks").filter(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("cache_key")).distinct()
    return c.join(cache_latest(spark, d).filter(~F.col("corrupt")).select("cache_key"), "cache_key", "left_anti").agg(F.count("*").alias("misses"))


def _once(columns: str, name: str, key: str) -> str:
    return f"(SELECT DISTINCT {columns} FROM {name} WHERE {key} IS NOT NULL UNION ALL SELECT {columns} FROM {name} WHERE {key} IS NULL)"


_SN = f"""(SELECT snapshot_id, node_id, "timestamp" AS ts, CASE WHEN cpu_percent >= 0 AND cpu_percent <= 100 AND NOT isnan(cpu_percent) THEN cpu_percent END AS cpu, CASE WHEN memory_percent >= 0 AND memory_percent <= 100 AND NOT isnan(memory_percent) THEN memory_percent END AS memory, gpu_available, gpu_utilization_percent AS gpu, queue_length, active_workers, ram_used_mb
 FROM {_once('snapshot_id, node_id, "timestamp", cpu_percent, memory_percent, gpu_available, gpu_utilization_percent, queue_length, active_workers, ram_used_mb', 'resource_snapshots', 'snapshot_id')})"""
_DE = f"""(SELECT decision_id, node_id, "timestamp" AS ts, regexp_replace(upper(trim(target_device, ' ')), '\\.[0-9]+$', '') AS device, CASE WHEN routing_latency_ms > 0 AND NOT isnan(routing_latency_ms) AND NOT isinf(routing_latency_ms) THEN routing_latency_ms END AS ms, policy_version, applied_rule, page_number, confidence, document_id
 FROM {_once('decision_id, node_id, "timestamp", target_device, routing_latency_ms, policy_version, applied_rule, page_number, confidence, document_id', 'routing_decisions', 'decision_id')})"""
_PCT = """(SELECT device, ms, row_number() OVER (PARTITION BY device ORDER BY ms) - 1 AS r, count(*) OVER (PARTITION BY device) AS n FROM {de} WHERE device IS NOT NULL AND ms IS NOT NULL)""".format(de=_DE)
_SUIT = f"""s AS (SELECT *, (snapshot_id % 101) / 101.0::DOUBLE AS level, (snapshot_id % 37) / 37.0::DOUBLE AS txt, CASE WHEN gpu > 80 THEN greatest(0.2::DOUBLE, 1.0 - 0.8::DOUBLE * (gpu - 80) / 20.0) ELSE 1.0 END AS busy FROM {_SN} WHERE cpu IS NOT NULL AND gpu IS NOT NULL),
g AS (SELECT s.*, greatest(0.05::DOUBLE, least(0.98::DOUBLE, (0.20::DOUBLE + 0.75::DOUBLE * level - CASE WHEN txt > 0.4 AND level > 0.6 THEN 0.08::DOUBLE * txt ELSE 0 END) * CASE WHEN active_workers > 2 THEN 1.0 ELSE 0.35::DOUBLE + 0.65::DOUBLE * least(1.0::DOUBLE, active_workers / 15.0::DOUBLE) END * CASE WHEN 8192.0::DOUBLE - ram_used_mb < 256 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END * busy * CASE WHEN queue_length > 4 AND busy < 0.8 THEN 0.85::DOUBLE ELSE 1.0 END)) AS gs,
  greatest(0.05::DOUBLE, least(0.98::DOUBLE, (0.85::DOUBLE - 0.65::DOUBLE * level + CASE WHEN txt > 0.4 AND level > 0.6 THEN 0.12::DOUBLE * txt ELSE 0 END) * CASE WHEN cpu > 85 THEN greatest(0.2::DOUBLE, 1.0 - 0.7::DOUBLE * (cpu - 85) / 15.0) ELSE 1.0 END)) AS cs FROM s)"""

QUERIES = {f.__name__: f for f in (
    p6_found, worker_latest, heartbeat_gaps, sessions, resource_windows, cluster_stats, moving_average, recent_samples, steal_plan, recovery_events, event_log, stage_pivot, task_fractions, event_rollup, routing_metrics,
    latency_percentiles, run_aggregate, policy_compare, device_crossover, oracle_agreement, device_rules, device_suitability, device_hysteresis, cache_latest, cache_misses,
    worker_states, recovery_log, queue_state, stage_metrics, run_summary, latency_summary, cluster_runs, executed_devices, dashboard_points, stream_windows, stream_latest, stream_returns, stream_log,
)}
SQL = {
    "worker_latest": f"SELECT node_id, s.snapshot_id, round((0.6::DOUBLE * s.cpu + 0.4::DOUBLE * s.memory) / 100, 4) AS utilisation, s.queue_length FROM (SELECT node_id, arg_max({{'snapshot_id': snapshot_id, 'cpu': cpu, 'memory': memory, 'queue_length': queue_length}}, {{'a': ts, 'b': snapshot_id}}) AS s FROM {_SN} GROUP BY node_id)",
    "heartbeat_gaps": f"SELECT node_id, snapshot_id, round(gap, 3) AS gap_seconds FROM (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY node_id ORDER BY ts, snapshot_id)) - epoch_us(ts)) / 1e6 AS gap FROM {_SN}) WHERE gap > 300",
    "sessions": f"WITH a AS (SELECT node_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY node_id ORDER BY ts)) < 600000000 THEN 0 ELSE 1 END AS new FROM {_SN}), b AS (SELECT node_id, ts, sum(new) OVER (PARTITION BY node_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT node_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS samples FROM b GROUP BY node_id, s",
    "resource_windows": f"""WITH w AS (SELECT epoch_us(ts) // 300000000 * 300 AS start_s, round(avg(cpu), 9) AS cpu, round(avg(memory), 9) AS memory, round(avg(gpu) FILTER (gpu_available), 9) AS gpu, CAST(sum(queue_length) AS BIGINT) AS queue, count(DISTINCT node_id) AS nodes FROM {_SN} GROUP BY 1),
a AS (SELECT *, CASE WHEN cpu >= 85 THEN 'scale_out' WHEN cpu <= 20 AND queue = 0 THEN 'scale_in' ELSE 'maintain' END AS action FROM w)
SELECT *, CASE action WHEN 'scale_out' THEN least(nodes + 2, nodes * 2) WHEN 'scale_in' THEN greatest(1, nodes - 1) ELSE nodes END AS target FROM a""",
    "cluster_stats": f"SELECT state, count(*) AS samples, round(avg(cpu), 9) AS cpu, round(avg(memory), 9) AS memory, CAST(sum(queue_length) AS BIGINT) AS queued, CASE state WHEN 'active' THEN 0 WHEN 'idle' THEN 1 ELSE 2 END AS place FROM (SELECT *, CASE WHEN queue_length >= 6 THEN 'overloaded' WHEN active_workers = 0 THEN 'idle' ELSE 'active' END AS state FROM {_SN}) GROUP BY state",
    "moving_average": f"SELECT snapshot_id, round(avg(cpu) OVER (PARTITION BY node_id ORDER BY ts, snapshot_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 9) AS cpu_60, greatest(0, coalesce(queue_length - lag(queue_length) OVER (PARTITION BY node_id ORDER BY ts, snapshot_id), 0)) AS queue_growth FROM {_SN}",
    "recent_samples": f"SELECT node_id, snapshot_id, age FROM (SELECT node_id, snapshot_id, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, snapshot_id DESC) AS age FROM {_SN}) WHERE age <= 5",
    "steal_plan": f"WITH l AS (SELECT node_id, arg_max(queue_length, {{'a': ts, 'b': snapshot_id}}) AS depth FROM {_SN} GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY depth, node_id) AS p FROM l WHERE depth <= 2), b AS (SELECT *, row_number() OVER (ORDER BY depth DESC, node_id) AS p FROM l WHERE depth > 2) SELECT i.node_id AS thief, b.node_id AS victim, CAST(least(greatest(1, floor(b.depth * 0.5)), b.depth - 1) AS BIGINT) AS units FROM i JOIN b USING (p)",
    "recovery_events": "SELECT event_id, user_id, attempt, CASE WHEN attempt <= 3 THEN 'RETRY_SCHEDULED' ELSE 'RETRY_EXHAUSTED' END AS outcome FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')",
    "event_log": f"SELECT entry, epoch_us(moment) AS at_us, log FROM (SELECT CAST(event_id AS VARCHAR) AS entry, CAST(ts AS TIMESTAMPTZ) AS moment, 'event' AS log FROM events UNION ALL SELECT decision_id, ts, 'routing' FROM {_DE} UNION ALL SELECT CAST(snapshot_id AS VARCHAR), ts, 'snapshot' FROM {_SN}) WHERE moment IS NOT NULL ORDER BY moment DESC, log, entry LIMIT 100",
    "stage_pivot": "SELECT user_id, " + ", ".join(f"arg_max(value, {{'a': ts, 'b': event_id}}) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
    "task_fractions": "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type",
    "event_rollup": "SELECT event_type, day, count(*) AS n, round(sum(value), 4) AS total, CAST(grouping(event_type, day) AS BIGINT) AS level FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) GROUP BY ROLLUP (event_type, day)",
    "routing_metrics": f"SELECT device, count(*) AS decisions, count(ms) AS timed, round(avg(ms), 4) AS mean_ms, round(avg(confidence), 6) AS confidence, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {_DE} GROUP BY device",
    "latency_percentiles": f"SELECT device, n, max(ms) FILTER (r = greatest(0, ceil(n * 0.95::DOUBLE) - 1)) AS nearest, max(ms) FILTER (r = least(n - 1, floor(n * 0.95::DOUBLE))) AS floor_index, round(quantile_cont(ms, 0.95), 6) AS linear FROM {_PCT} GROUP BY device, n",
    "run_aggregate": f"SELECT policy_version, applied_rule, count(*) AS runs, round(avg(ms), 4) AS mean_ms, round(coalesce(stddev_samp(ms), 0), 4) AS std_ms, round(coalesce(stddev_samp(ms), 0) / avg(ms), 4) AS cv, round(count(*) FILTER (device = 'GPU') / count(*) * 100, 6) AS gpu_percent, arg_min(device, {{'a': ts, 'b': decision_id}}) FILTER (device IS NOT NULL) AS first_device, count(*) < 5 AS exploratory FROM {_DE} WHERE ms IS NOT NULL GROUP BY 1, 2",
    "policy_compare": f"""WITH w AS (SELECT policy_version, avg(ms) FILTER (device = 'CPU') AS c, avg(ms) FILTER (device = 'GPU') AS g, avg(ms) FILTER (device = 'FALLBACK') AS f FROM {_DE} WHERE ms IS NOT NULL AND device IN ('CPU', 'GPU', 'FALLBACK') GROUP BY 1)
SELECT policy_version, round(c, 9) AS cpu_ms, round(g, 9) AS gpu_ms, round(f, 9) AS fallback_ms, round((f - least(c, g)) / least(c, g), 4) AS regret, round(c / g, 4) AS speedup, round((g - c) / c * 100, 3) AS change FROM w""",
    "device_crossover": f"WITH w AS (SELECT page_number, round(avg(ms) FILTER (device = 'CPU'), 6) AS c, round(avg(ms) FILTER (device = 'GPU'), 6) AS g FROM {_DE} WHERE ms IS NOT NULL AND page_number IS NOT NULL GROUP BY 1) SELECT min(page_number) FILTER (g < c) AS crossover, count(*) FILTER (g < c) AS pages_gpu_faster FROM w",
    "oracle_agreement": f"WITH r AS (SELECT * FROM {_DE} WHERE device IN ('CPU', 'GPU')), b AS (SELECT policy_version, CASE WHEN round(avg(ms) FILTER (device = 'GPU'), 6) < round(avg(ms) FILTER (device = 'CPU'), 6) THEN 'GPU' ELSE 'CPU' END AS oracle FROM r GROUP BY 1) SELECT policy_version, oracle, round(avg(CAST(device = oracle AS INTEGER)), 6) AS agreement FROM r JOIN b USING (policy_version) GROUP BY 1, 2",
    "device_rules": f"""WITH s AS (SELECT *, coalesce(cpu, -1) AS c, coalesce(memory, -1) AS m, round((snapshot_id % 100) / 100.0::DOUBLE, 2) AS e FROM {_SN}),
r AS (SELECT snapshot_id, CASE WHEN gpu_available IS NOT TRUE THEN 'A' WHEN c < 0 OR m < 0 THEN 'B' WHEN active_workers <= 1 AND e <= 0.20 THEN 'C' WHEN gpu >= 85 THEN 'D' WHEN 8192.0::DOUBLE - ram_used_mb < 256 THEN 'E' WHEN c >= 80 THEN 'F' WHEN e >= 0.35 THEN 'G' ELSE 'H' END AS rule FROM s)
SELECT snapshot_id, CASE WHEN rule IN ('F', 'G') THEN 'GPU' ELSE 'CPU' END AS device, rule FROM r""",
    "device_suitability": f"WITH {_SUIT} SELECT snapshot_id, round(cs, 6) AS cpu_score, round(gs, 6) AS gpu_score, round(greatest(0.15::DOUBLE, least(0.99::DOUBLE, abs(gs - cs) * 1.6::DOUBLE + 0.10::DOUBLE)), 6) AS confidence, CASE WHEN gs > cs THEN 'GPU' ELSE 'CPU' END AS backend, CASE WHEN gs > cs AND active_workers <= 2 AND active_workers >= 15 THEN 'large_batch_amortizes_cold_gpu' WHEN gs > cs AND level >= 0.5 THEN 'high_compute_intensity_favors_gpu' WHEN gs > cs THEN 'gpu_suitability_higher_than_cpu' WHEN active_workers <= 2 THEN 'cold_gpu_overhead_unlikely_to_amortize' WHEN busy < 0.7 THEN 'gpu_overloaded_routing_to_cpu' WHEN txt > 0.4 AND level > 0.6 THEN 'dense_text_layout_favors_cpu' WHEN level < 0.35 THEN 'small_simple_page_favors_cpu' ELSE 'cpu_suitability_higher_than_gpu' END AS reason FROM g",
    "cache_latest": "SELECT cache_key, epoch_us(r.created_at) AS created_us, octet_length(r.vector_bytes) AS bytes, coalesce(octet_length(r.vector_bytes) <> 256, true) AS corrupt FROM (SELECT cache_key, max({'created_at': created_at, 'vector_bytes': vector_bytes}) AS r FROM embedding_cache WHERE cache_key IS NOT NULL GROUP BY 1)",
    "cache_misses": "WITH l AS (SELECT cache_key, max({'created_at': created_at, 'vector_bytes': vector_bytes}) AS r FROM embedding_cache WHERE cache_key IS NOT NULL GROUP BY 1) SELECT count(*) AS misses FROM (SELECT DISTINCT sha256(text) AS k FROM chunks WHERE text IS NOT NULL) WHERE k NOT IN (SELECT cache_key FROM l WHERE octet_length(r.vector_bytes) = 256)",
    "device_hysteresis": f"""WITH RECURSIVE n AS (SELECT decision_id, coalesce(node_id, '') AS node, epoch_us(ts) AS moment, device, coalesce(applied_rule IN ('A', 'D'), false) AS free, row_number() OVER (PARTITION BY coalesce(node_id, '') ORDER BY ts, decision_id) AS k FROM {_DE} WHERE ts IS NOT NULL AND device IS NOT NULL),
w AS (SELECT node, k, decision_id, device AS kept, moment AS switched, false AS held FROM n WHERE k = 1
  UNION ALL SELECT n.node, n.k, n.decision_id, CASE WHEN n.device <> w.kept AND n.moment - w.switched < 30000000 AND NOT (n.free AND w.kept = 'GPU') THEN w.kept ELSE n.device END,
    CASE WHEN n.device <> w.kept AND (n.moment - w.switched >= 30000000 OR (n.free AND w.kept = 'GPU')) THEN n.moment ELSE w.switched END, n.device <> w.kept AND n.moment - w.switched < 30000000 AND NOT (n.free AND w.kept = 'GPU')
  FROM w JOIN n ON n.node = w.node AND n.k = w.k + 1) SELECT decision_id, kept AS device, held FROM w""",
    "worker_states": f"""WITH l AS (SELECT node_id, arg_max({{'ts': ts, 'q': queue_length, 'w': active_workers}}, {{'a': ts, 'b': snapshot_id}}) AS s FROM {_SN} GROUP BY 1),
t AS (SELECT node_id, CASE WHEN epoch_us((SELECT max(s.ts) FROM l)) - epoch_us(s.ts) > 900000000 THEN 'lost' WHEN coalesce(s.q, 0) >= 6 THEN 'overloaded' WHEN s.w = 0 THEN 'idle' ELSE 'active' END AS state, CAST(coalesce(s.q, 0) AS BIGINT) AS depth FROM l)
SELECT node_id, state, state IN ('idle', 'active') AS available, depth FROM t""",
    "recovery_log": f"""WITH b AS (SELECT node_id, ts, lead(ts) OVER (PARTITION BY node_id ORDER BY ts, snapshot_id) AS next FROM {_SN} WHERE ts IS NOT NULL), l AS (SELECT DISTINCT node_id AS worker_id, ts FROM b WHERE epoch_us(next) - epoch_us(ts) > 600000000),
h AS (SELECT DISTINCT l.worker_id, l.ts, r.document_id AS unit FROM l JOIN {_DE} r ON r.node_id = l.worker_id AND r.ts <= l.ts AND epoch_us(l.ts) - epoch_us(r.ts) <= 60000000 WHERE r.document_id IS NOT NULL),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY unit ORDER BY ts, worker_id) AS INTEGER) AS retry FROM h)
SELECT worker_id, epoch_us(ts) AS at_us, NULL AS unit, 'WORKER_LOST' AS event, NULL AS retry FROM l UNION ALL SELECT worker_id, epoch_us(ts), unit, CASE WHEN retry <= 3 THEN 'RETRY_SCHEDULED' ELSE 'RETRY_EXHAUSTED' END, retry FROM t
UNION ALL SELECT worker_id, epoch_us(ts), NULL, 'TASKS_RECOVERED', CAST(count(*) AS INTEGER) FROM t WHERE retry <= 3 GROUP BY worker_id, ts""",
    "queue_state": """WITH o AS (SELECT user_id, {'a': ts, 'b': event_id} AS moment, value, event_type = 'error' AS gone FROM events), p AS (SELECT user_id, arg_max({'v': value, 'g': gone}, moment) AS final, max(moment) FILTER (gone) AS gone FROM o GROUP BY user_id),
s AS (SELECT p.user_id, final.v AS priority, min(o.moment) AS arrival FROM p JOIN o ON o.user_id = p.user_id WHERE NOT final.g AND (p.gone IS NULL OR o.moment > p.gone) GROUP BY 1, 2)
SELECT user_id, priority, row_number() OVER (ORDER BY priority DESC NULLS LAST, arrival, user_id) AS place FROM s""",
    "stage_metrics": "SELECT user_id, " + ", ".join(f"arg_max(value, {{'a': ts, 'b': event_id}}) FILTER (event_type = '{k}') AS {k}" for k in ("click", "purchase", "signup", "view")) + ", round(avg(value), 6) AS mean_value, count(*) FILTER (event_type = 'error') AS errors, count(*) AS events FROM events GROUP BY user_id",
    "run_summary": f"""WITH r AS (SELECT * FROM {_DE} WHERE ms IS NOT NULL AND document_id IS NOT NULL AND policy_version IS NOT NULL AND applied_rule IS NOT NULL),
u AS (SELECT policy_version, applied_rule, document_id, sum(ms) AS total, min({{'a': ts, 'b': decision_id}}) AS begun, arg_min(ms, {{'a': ts, 'b': decision_id}}) AS cold FROM r GROUP BY 1, 2, 3),
o AS (SELECT policy_version, applied_rule, arg_min(document_id, begun) AS warm, count(*) AS runs, arg_min(cold, begun) AS cold_start FROM u GROUP BY 1, 2),
t AS (SELECT policy_version, applied_rule, count(*) AS samples, round(avg(total), 6) AS mean_ms, round(coalesce(stddev_samp(total), 0), 6) AS std_ms, round(quantile_cont(total, 0.5), 6) AS median_ms, min(cold_start) AS cold_start_ms, count(*) < 5 AS exploratory FROM u JOIN o USING (policy_version, applied_rule) WHERE document_id <> warm OR runs = 1 GROUP BY 1, 2),
l AS (SELECT policy_version, applied_rule, quantile_disc(ms, 0.95) AS p95_ms, round(quantile_cont(ms, 0.5), 6) AS median_latency_ms FROM r JOIN o USING (policy_version, applied_rule) WHERE document_id <> warm OR runs = 1 GROUP BY 1, 2)
SELECT * FROM t JOIN l USING (policy_version, applied_rule)""",
    "latency_summary": f"SELECT policy_version, round(avg(ms), 4) AS mean_ms, min(ms) AS least_ms, max(ms) AS most_ms, quantile_disc(ms, 0.95) AS p95_ms, round(quantile_cont(ms, 0.5), 6) AS median_ms FROM {_DE} WHERE ms IS NOT NULL AND policy_version IS NOT NULL GROUP BY 1",
    "cluster_runs": f"""WITH a AS (SELECT node_id, count(*) AS pages, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS wall, round(sum(ms), 6) / 1e3 AS busy, count(DISTINCT policy_version) AS workers FROM {_DE} WHERE ms IS NOT NULL AND node_id IS NOT NULL GROUP BY 1),
o AS (SELECT *, CASE WHEN wall > 0 THEN greatest(0, wall - busy) / wall * 100 ELSE 0 END AS over FROM a)
SELECT node_id, pages, round(CASE WHEN wall > 0 THEN pages / wall ELSE 0 END, 6) AS throughput, round(over, 6) AS overhead_percent, 1.0::DOUBLE AS speedup, round(CASE WHEN workers > 0 THEN 1.0::DOUBLE / workers ELSE 0 END, 6) AS efficiency, over < 1 AS light FROM o""",
    "executed_devices": f"SELECT CASE WHEN applied_rule = 'A' AND device <> 'CPU' THEN 'CPU' ELSE device END AS device, applied_rule = 'A' AND device <> 'CPU' AS fallback, (ms / 1e3 > 2.0) OR (confidence * 2 > 1.5) AS costly, count(*) AS decisions FROM {_DE} WHERE device IS NOT NULL AND applied_rule IS NOT NULL GROUP BY 1, 2, 3",
    "dashboard_points": f"SELECT node_id, count(*) AS points, min(epoch_us(ts)) AS from_us, max(epoch_us(ts)) AS to_us, round(sum(coalesce(cpu, 0)), 6) AS cpu_sum FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, snapshot_id DESC) AS age FROM {_SN} WHERE node_id IS NOT NULL) WHERE age <= 60 GROUP BY node_id",
    "stream_windows": "SELECT epoch_us(ts) // 3600000000 * 3600 AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_latest": "SELECT user_id, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type FROM events GROUP BY 1",
    "stream_returns": "SELECT worker_id, at_us, round(gap / 1e6, 3) AS gap_seconds FROM (SELECT CAST(user_id AS VARCHAR) AS worker_id, epoch_us(ts) AS at_us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) WHERE gap > 21600000000",
    "stream_log": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('error', 'signup', 'view') GROUP BY 1",
}
