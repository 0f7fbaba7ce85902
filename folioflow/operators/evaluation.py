"""Quality of ranked lists: precision, recall, reciprocal rank, nDCG and hit rate at cut-offs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _gain(count: Column) -> Column:
    """Best possible discounted gain of ``count`` relevant results."""
    ranks = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ranks, F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1))


def case_metrics(ranked: DataFrame, relevant: DataFrame, cuts: Sequence[int] = (1, 3, 5), distinct: bool = False) -> DataFrame:
    """(query, k, precision, recall, rr, ndcg, hit) of every query of ``relevant`` (query, ids).

    ``ranked`` is (query, id, rank). Precision divides by k even if fewer were returned; a query
    without results or without relevant ids scores zero. An id ranked twice counts twice, so
    recall and nDCG can pass one, unless ``distinct`` keeps only its best rank.
    """
    if distinct:
        ranked = ranked.groupBy("query", "id").agg(F.min("rank").alias("rank"))
    ids = relevant.select("query", F.array_distinct(F.coalesce("ids", F.array().cast("array<string>"))).alias("ids"))
    hits = ranked.join(ids, "query").filter(F.array_contains("ids", F.col("id"))).select("query", "rank")
    asked = ids.select("query", F.size("ids").alias("relevant"), F.explode(F.array(*[F.lit(int(k)) for k in cuts])).alias("k"))
    inside = F.col("rank") <= F.col("k")
    n = F.count(F.when(inside, 1))
    found = asked.join(hits, "query", "left").groupBy("query", "k", "relevant").agg(
        n.alias("hits"),
        F.min(F.when(inside, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(inside, F.lit(1.0) / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    ideal = _gain(F.least("relevant", "k").cast("int"))
    r = lambda c: F.round(c, 6)
    return found.select(
        "query",
        "k",
        r(F.col("hits") / F.col("k")).alias("precision"),
        r(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(F.lit(0.0))).alias("recall"),
        r(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("rr"),
        r(F.when(ideal > 0, F.col("dcg") / ideal).otherwise(F.lit(0.0))).alias("ndcg"),
        (F.col("hits") > 0).cast("int").alias("hit"),
    )


def mean_metrics(cases: DataFrame) -> DataFrame:
    """(k, metric, value, cases): averages over queries, in long form."""
    wide = cases.groupBy("k").agg(*[F.round(F.avg(m), 4).alias(m) for m in ("precision", "recall", "rr", "ndcg", "hit")], F.count("*").alias("cases"))
    return wide.unpivot(["k", "cases"], ["precision", "recall", "rr", "ndcg", "hit"], "metric", "value").select("k", "metric", "value", "cases")


def candidate_recall(ranked: DataFrame, relevant: DataFrame, depths: Sequence[int] = (5, 10, 15, 20)) -> DataFrame:
    """(depth, recall): mean share of the relevant ids among the first candidates."""
    per = case_metrics(ranked, relevant, depths, distinct=True)
    return per.groupBy(F.col("k").alias("depth")).agg(F.round(F.avg("recall"), 6).alias("recall"))


def change(before: Column, after: Column) -> tuple[Column, Column]:
    """Absolute and relative difference; the relative one is zero from zero."""
    return after - before, F.when(before != 0, (after - before) / before).otherwise(F.lit(0.0))
