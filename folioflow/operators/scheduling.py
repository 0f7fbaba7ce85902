"""Partitioning of work by size, and analytics of schedulers."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.runtime import written


def global_rank(rows: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Adds each row's place, from 1, in a total order of all rows.

    The rows are dealt out in ranges of the order and written once; each range is numbered in
    its own task, and the sizes of the ranges before it, one row a range, are added. Ties in
    the order are numbered arbitrarily, so give it a last column that is unique.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    # one row a range
    return dealt.withColumn("_within", within).join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_within")).drop("_range", "_before", "_within")


def longest_first_plan(sizes: dict[int, int], workers: int) -> dict[int, tuple[list[int], list[int]]]:
    """For each size the workers its items go to: a beginning, then a cycle that repeats.

    Items are taken largest first, each to the worker with the least load, the lower number
    if equal. Of equal items only the first few need simulating: once loads are within one
    item of each other the workers take turns, so the plan is short whatever the number of items.
    """
    loads = [(0, w) for w in range(workers)]
    plan: dict[int, tuple[list[int], list[int]]] = {}
    for size in sorted(sizes, reverse=True):
        n = sizes[size]
        heapq.heapify(loads)
        start: list[int] = []
        while n and not (len(start) >= workers and max(loads)[0] - loads[0][0] <= size and sorted(start[-workers:]) == list(range(workers))):
            load, w = heapq.heappop(loads)
            heapq.heappush(loads, (load + size, w))
            start.append(w)
            n -= 1
        cycle: list[int] = []
        if n:
            turns = sorted(loads)
            cycle = [w for _, w in turns]
            full, rest = divmod(n, workers)
            loads = [(load + size * (full + (i < rest)), w) for i, (load, w) in enumerate(turns)]
        plan[size] = (start, cycle)
    return plan


def longest_first_partition(documents: DataFrame, key: str, pages: str, workers: int, smallest: int = 10) -> DataFrame:
    """(key, pages, worker_id) by longest processing time first; documents without pages are left out.

    A partition of fewer than ``smallest`` pages is given to the first one. Equal documents are
    taken in order of key. Only the histogram of page counts reaches the driver.
    """
    spark = documents.sparkSession
    rows = documents.filter(F.col(pages) > 0).select(F.col(key).alias("key"), F.col(pages).cast("bigint").alias("pages"))
    histogram = {r["pages"]: r["n"] for r in rows.groupBy("pages").agg(F.count("*").alias("n")).collect()}  # distinct page counts
    if not histogram:
        return spark.createDataFrame([], f"{key} string, pages bigint, worker_id string")
    workers = min(workers, sum(histogram.values()))
    plan = longest_first_plan(histogram, workers)
    load = [0] * workers
    for size, (start, cycle) in plan.items():
        for w in start:
            load[w] += size
        rest = histogram[size] - len(start)
        for i, w in enumerate(cycle):
            load[w] += size * (rest // len(cycle) + (i < rest % len(cycle)))
    to = [w if w == 0 or load[w] >= smallest else 0 for w in range(workers)]
    table = spark.createDataFrame([(s, [to[w] for w in a], [to[w] for w in c]) for s, (a, c) in plan.items()], "pages bigint, start array<int>, cycle array<int>")
    # the place among equal documents, from the place among all: a size that most documents share is no task of its own
    first = F.broadcast(spark.createDataFrame([(s, sum(n for t, n in histogram.items() if t > s)) for s in histogram], "pages bigint, before bigint"))  # one row a distinct page count
    placed = global_rank(rows, [F.desc("pages"), F.col("key")], "place").join(first, "pages").withColumn("rank", F.col("place") - F.col("before") - 1)
    at = F.when(F.col("rank") < F.size("start"), F.get("start", F.col("rank"))).otherwise(F.get("cycle", F.pmod(F.col("rank") - F.size("start"), F.size("cycle"))))
    return (
        placed.join(F.broadcast(table), "pages")  # one row a distinct page count
        .select(F.col("key").alias(key), "pages", F.format_string("worker_%02d", at).alias("worker_id"))
    )


def drain_order(units: DataFrame, pages: str, arrival: str) -> DataFrame:
    """Order in which a queue hands out units: most pages first, then by arrival."""
    return global_rank(units, [F.desc(pages), F.col(arrival)], "drain")


def least_loaded_plan(loads: dict[str, int]) -> tuple[list[str], list[str]]:
    """The workers that the next units go to, and the cycle that follows once all are equally loaded.

    Each unit goes to the worker with the least in flight, the lower name if equal.
    """
    heap = [(n, w) for w, n in loads.items()]
    heapq.heapify(heap)
    most, start = max(loads.values(), default=0), []
    while heap and heap[0][0] < most:
        n, w = heapq.heappop(heap)
        heapq.heappush(heap, (n + 1, w))
        start.append(w)
    return start, sorted(loads)


def dispatch(units: DataFrame, workers: DataFrame, order: str = "drain") -> DataFrame:
    """``units`` (numbered from 1 by ``order``) with the ``worker_id`` they are handed to.

    ``workers`` is (worker_id, in_flight) of the available ones; none leaves every unit
    without a worker. Only the workers reach the driver, never the units.
    """
    spark = units.sparkSession
    start, cycle = least_loaded_plan({r["worker_id"]: int(r["in_flight"] or 0) for r in workers.select("worker_id", "in_flight").collect()})
    plan = spark.createDataFrame([(start, cycle)], "start array<string>, cycle array<string>")  # one row
    k = F.col(order) - 1
    at = F.when(k < F.size("start"), F.get("start", k.cast("int"))).when(F.size("cycle") > 0, F.get("cycle", F.pmod(k - F.size("start"), F.size("cycle")).cast("int")))
    return units.crossJoin(F.broadcast(plan)).withColumn("worker_id", at).drop("start", "cycle")


def queue_state(operations: DataFrame, unit: str, at: Sequence[str], kind: str, priority: str) -> DataFrame:
    """(unit, priority, arrival) of the units in a priority queue after all its operations.

    ``kind`` is insert, update or remove. The last operation of a unit tells whether it is in the
    queue and how urgent it is; among equals the one that has been in longest since its last
    removal comes first.
    """
    time = F.struct(*at)
    gone = F.max(F.when(F.col(kind) == "remove", time))
    per = operations.groupBy(unit).agg(F.max_by(F.struct(F.col(kind).alias("kind"), F.col(priority).alias("priority")), time).alias("last"), gone.alias("gone"))
    stays = per.filter(F.col("last.kind") != "remove").select(unit, "last.priority", "gone")
    entered = operations.join(stays.select(unit, "gone"), unit).filter(F.col("gone").isNull() | (time > F.col("gone"))).groupBy(unit).agg(F.min(time).alias("arrival"))
    return stays.select(unit, "priority").join(entered, unit)


def recovery_log(losses: DataFrame, held: DataFrame, most: int = 3) -> DataFrame:
    """(worker_id, at, unit, event, retry): what follows each loss of a worker.

    ``losses`` is (worker_id, at); ``held`` (worker_id, at, unit) what it had in flight then.
    A loss is WORKER_LOST; each unit RETRY_SCHEDULED up to ``most`` times and RETRY_EXHAUSTED
    after that; TASKS_RECOVERED closes a loss of which a unit is retried. Units of one moment
    are ordered by worker.
    """
    tries = F.row_number().over(Window.partitionBy("unit").orderBy("at", "worker_id"))
    each = held.select("worker_id", "at", "unit").distinct().withColumn("retry", tries)
    units = each.withColumn("event", F.when(F.col("retry") <= most, "RETRY_SCHEDULED").otherwise("RETRY_EXHAUSTED"))
    lost = losses.select("worker_id", "at").distinct().select("worker_id", "at", F.lit(None).cast("string").alias("unit"), F.lit("WORKER_LOST").alias("event"), F.lit(None).cast("int").alias("retry"))
    again = units.filter(F.col("retry") <= most).groupBy("worker_id", "at").agg(F.count("*").cast("int").alias("retry"))
    closing = again.select("worker_id", "at", F.lit(None).cast("string").alias("unit"), F.lit("TASKS_RECOVERED").alias("event"), "retry")
    return lost.unionByName(units.select("worker_id", "at", F.col("unit").cast("string").alias("unit"), "event", "retry")).unionByName(closing)


def difficulty(cv: Column) -> Column:
    return F.when(cv < 0.2, "low").when(cv < 0.5, "medium").otherwise("high")


def scaling_advice(cpu: Column, queue: Column, workers: Column) -> Column:
    """Struct (action, target): out when the processors are busy, in when idle with nothing queued."""
    action = F.when(cpu >= 85, "scale_out").when((cpu <= 20) & (queue == 0), "scale_in").otherwise("maintain")
    target = F.when(action == "scale_out", F.least(workers + 2, workers * 2)).when(action == "scale_in", F.greatest(F.lit(1), workers - 1)).otherwise(workers)
    return F.struct(action.alias("action"), target.alias("target"))
