"""Sparse, dense and hybrid retrieval over DataFrames.

Queries are a DataFrame of their own, so a batch of queries is one plan. The inverted index is
three tables (postings, lengths, one row of totals); the dense side compares vectors with the
query vectors in the JVM. Ranks are broken by score rounded to six places and then by id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import tokens

#: Rows of a block of queries that is broadcast to the vectors.
BLOCK_QUERIES = 4096
MAX_TOP_K = 50


def check_k(k: int, most: int = MAX_TOP_K) -> int:
    if not 1 <= k <= most:
        raise ValueError(f"k must lie between 1 and {most}")
    return k


@dataclass
class SparseIndex:
    postings: DataFrame  # id, term, tf, dl
    lengths: DataFrame  # id, dl
    totals: DataFrame  # docs, avgdl: one row

    def write(self, path: str) -> None:
        """Persist as Parquet; postings are clustered by term, so a query reads few row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def read(cls, spark, path: str) -> SparseIndex:  # noqa: ANN001
        return cls(*[spark.read.parquet(f"{path}/{x}") for x in ("postings", "lengths", "totals")])


def sparse_index(texts: DataFrame, key: str, text: str, only: DataFrame | None = None) -> SparseIndex:
    """Index rows with a text; ``only`` (column ``term``) keeps the postings of those terms.

    Terms that no query asks for are dropped before anything is shuffled. Null texts are not
    indexed, empty ones count as documents of length zero; repeated keys are indexed as one
    document only if the caller removed the repetitions.
    """
    rows = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), tokens(F.col(text)).alias("terms"))
    lengths = rows.select("id", F.size("terms").alias("dl"))
    totals = lengths.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    each = rows.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    if only is not None:
        each = each.join(only.select("term").distinct(), "term", "left_semi")
    return SparseIndex(each.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")), lengths, totals)


def query_bag(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, term, times): a repeated term counts as often as it is given."""
    return queries.select(F.col(key).alias("query"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))


def bm25(index: SparseIndex, bag: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, id, score) of all documents that hold a term of the query; scores rounded to 6 places."""
    wanted = index.postings.join(bag.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    n, tf, dl = F.col("docs"), F.col("tf").cast("double"), F.col("dl").cast("double")
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.when(F.col("avgdl") > 0, dl / F.col("avgdl")).otherwise(F.lit(0.0))
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm))
    scored = (
        wanted.join(df, "term")
        .crossJoin(F.broadcast(index.totals))  # one row
        .select("id", "term", part.alias("part"))
    )
    return scored.join(bag, "term").groupBy("query", "id").agg(F.round(F.sum(F.col("part") * F.col("times")), 6).alias("score"))


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ("query",), score: str = "score", tie: str = "id", least: float | None = None) -> DataFrame:
    """The k best of each query, ranked from 1."""
    kept = scored if least is None else scored.filter(F.col(score) >= least)
    line = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return kept.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """The vector at length one; an all-zero vector stays as it is."""
    n = norm(v)
    # the length as an array of its own: inside the lambda it would be computed for every component
    return F.zip_with(v, F.array_repeat(F.when(n > 0, n).otherwise(F.lit(1.0)), F.size(v)), lambda x, m: x.cast("double") / m)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine_scores(vectors: DataFrame, queries: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """(query, id, score) of every vector against every query of a stated query set.

    The set (query, query_vector) is compared in blocks that are broadcast; it is no table
    that grows with the vectors.
    """
    unit = vectors.select(F.col(key).alias("id"), normalised(F.col(vector)).alias("v"))
    asked = queries.select("query", normalised(F.col("query_vector")).alias("q"))
    n = asked.count()
    blocks = max(1, -(-n // BLOCK_QUERIES))
    parts = [asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) for i in range(blocks)]
    out = None
    for part in parts:
        scored = unit.join(F.broadcast(part)).select("query", "id", F.round(dot(F.col("v"), F.col("q")), 6).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """(query, id, dense_rank, sparse_rank, dense_score, sparse_score, rrf_score, rank)."""
    d = dense.select("query", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("query", "id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    one = lambda c: F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    fused = d.join(s, ["query", "id"], "full").withColumn("rrf_score", F.round(one("dense_rank") + one("sparse_rank"), 8))
    line = Window.partitionBy("query").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), "id")
    return fused.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)


def lexical_overlap(query: Column, text: Column) -> Column:
    """Deterministic stand-in for a cross encoder: share of the query's distinct terms in the text."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(text))) / F.size(asked)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, score: Column, k: int) -> DataFrame:
    """Reorder each query's candidates by ``score``, the earlier rank breaking ties."""
    scored = candidates.withColumn("rerank_score", F.round(score, 6))
    line = Window.partitionBy("query").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rerank_rank", F.row_number().over(line)).filter(F.col("rerank_rank") <= k)


def adaptive_depth(fused: DataFrame, strong: int = 5, gap: float = 0.005, depths: tuple[int, int, int] = (5, 10, 20)) -> DataFrame:
    """(query, depth): few candidates where both rankings agree on a clear first, more where they don't."""
    agree = (F.col("dense_rank") <= strong) & (F.col("sparse_rank") <= strong)
    first = F.max(F.when(F.col("rank") == 1, F.col("rrf_score")))
    fifth = F.coalesce(F.max(F.when(F.col("rank") == 5, F.col("rrf_score"))), F.min(F.when(F.col("rank") <= 5, F.col("rrf_score"))))
    seen = fused.groupBy("query").agg(
        F.coalesce(F.bool_or(agree & (F.col("rank") == 1)), F.lit(False)).alias("top1"),
        F.coalesce(F.bool_or(agree & (F.col("rank") <= 3)), F.lit(False)).alias("top3"),
        F.round(first - fifth, 8).alias("gap"),
        F.count("*").alias("available"),
    )
    depth = F.when(F.col("top1") & (F.col("gap") >= gap), depths[0]).when(F.col("top3"), depths[1]).otherwise(depths[2])
    return seen.select("query", "gap", F.least(depth, F.col("available")).cast("int").alias("depth"))
