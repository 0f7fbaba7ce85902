"""A stored index of vectors in lists around centroids, for dense search that reads only a few lists.

Centroids are fitted in numpy on a bounded sample; vectors go to their nearest one and are written
partitioned by list, so that a search prunes the lists it does not probe at the scan. Similarity
within the lists is exact, in the JVM. Deleting and adding rewrite only what they touch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import retrieval as R

#: Vectors that centroids are fitted on: the bound of what reaches the driver.
SAMPLE_ROWS = 50_000


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def fit_centroids(vectors: DataFrame, lists: int, vector: str = "vector", rounds: int = 8, seed: int = 3) -> np.ndarray:
    """(lists, dimension) unit centroids of a sample; fewer if there are fewer vectors."""
    rows = vectors.filter(F.col(vector).isNotNull())
    share = max(1, rows.count() // SAMPLE_ROWS)
    some = rows.filter(F.pmod(F.xxhash64(vector), F.lit(share)) == 0).select(vector).limit(SAMPLE_ROWS).toPandas()
    if not len(some):
        return np.zeros((0, 0))
    x = _unit(np.array(some[vector].tolist(), float))
    centres = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        used = np.linalg.norm(total, axis=1) > 0
        centres[used] = _unit(total[used])
    return centres


@dataclass
class VectorIndex:
    """Vectors (id, vector, list) and the centroids of their lists."""

    vectors: DataFrame
    centroids: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, lists: int, key: str = "id", vector: str = "vector") -> VectorIndex:
        """Rows without a vector are left out; an all-zero vector goes to the first list."""
        centres = fit_centroids(vectors, lists, vector)
        rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
        shared = vectors.sparkSession.sparkContext.broadcast(centres)  # lists x dimension numbers

        @F.pandas_udf("int")
        def nearest(column: pd.Series) -> pd.Series:
            return pd.Series((_unit(np.array(column.tolist(), float)) @ shared.value.T).argmax(1) if len(column) else [], dtype="int32")

        return cls(rows.withColumn("list", nearest("vector")), centres)

    def write(self, path: str) -> None:
        spark = self.vectors.sparkSession
        self.vectors.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
        rows = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        """Dimensions that differ from the centroids' are an error, found before any search."""
        centres = spark.read.parquet(f"{path}/centroids").orderBy("list").toPandas()
        index = cls(spark.read.parquet(f"{path}/vectors"), np.array(centres["centroid"].tolist(), float))
        wrong = index.vectors.filter(F.size("vector") != index.centroids.shape[1]).limit(1).count()
        if wrong:
            raise ValueError("the stored vectors have another dimension than the centroids")
        return index

    def without(self, ids: DataFrame) -> VectorIndex:
        """The index without the named ids (column id)."""
        return VectorIndex(self.vectors.join(ids.select("id"), "id", "left_anti"), self.centroids)

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """(query, id, score, rank): the ``k`` most similar vectors in the ``probes`` nearest lists.

        ``queries`` (query, query_vector) is a stated set. Query rows meet vectors in a join by list.
        """
        R.check_k(k)
        spark = self.vectors.sparkSession
        centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "list int, centroid array<double>")
        asked = queries.select("query", R.normalised(F.col("query_vector")).alias("q"))
        near = asked.crossJoin(F.broadcast(centres)).select("query", "q", "list", R.dot(F.col("q"), F.col("centroid")).alias("score"))  # a row a list
        probed = R.top_k(near, probes, tie="list").select("query", "q", "list")
        # each vector is brought to length one before it meets the queries
        unit = self.vectors.select("id", "list", R.normalised(F.col("vector")).alias("v"))
        scored = unit.join(probed, "list").select("query", "id", F.round(R.dot(F.col("v"), F.col("q")), 6).alias("score"))
        return R.top_k(scored, k)
