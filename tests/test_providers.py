import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioflow.operators import benchstats as N
from folioflow.operators import providers as V
from folioflow.operators import routing as M


def test_embedding_uses_the_cache(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", None), ("d", "three")], "id string, text string")
    got = {r.id: r for r in V.embed_texts(rows, "id", "text", V.hashing_embedder(8)).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"].vector == got["b"].vector and len(got["d"].vector) == 8
    cache = spark.createDataFrame([(got["a"].content, [9.0] * 8)], "content string, vector array<float>")
    again = {r.id: r.vector for r in V.embed_texts(rows, "id", "text", V.hashing_embedder(8), cache).collect()}
    assert again["a"] == again["b"] == [9.0] * 8 and again["d"] == got["d"].vector
    q = V.embed_texts(rows, "id", "text", V.hashing_embedder(8), query=True).filter("id = 'd'").first()
    assert q.vector != got["d"].vector


def test_retrievers(spark):
    q = spark.createDataFrame([("q",)], "query string")
    s = spark.createDataFrame([("q", "x", 2.0), ("q", "y", 1.0)], "query string, id string, score double")
    assert [r["id"] for r in V.retriever("hybrid")(q, None, s).orderBy("rank").collect()] == ["x", "y"]
    assert V.retriever("dense")(q, None, s).count() == 0 and V.retriever("sparse", 1)(q, None, s).count() == 1
    for bad in (lambda: V.retriever("dense", 0), lambda: V.retriever("dense", 51), lambda: V.retriever("other")):
        with pytest.raises(ValueError):
            bad()
    scored = V.rescore(s.withColumn("t", F.col("id")), "query", "t", lambda a, b: pd.Series([float(len(x + y)) for x, y in zip(a, b, strict=True)]))
    assert {r.model_score for r in scored.collect()} == {2.0}


def test_small_parts(spark):
    scores = np.log(np.array([[0.1, 0.8, 0.1], [0.1, 0.8, 0.1], [0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]))
    text, p = V.ctc_decode(scores, "#ab")
    assert text == "aab" and abs(p - 0.8) < 1e-9 and V.ctc_decode(np.log(np.array([[0.9, 0.05, 0.05]])), "#ab") == ("", 0.0)
    a, b = V.synthetic_notes(spark, 20).collect(), V.synthetic_notes(spark, 20).collect()
    assert a == b and len({r.note for r in a}) > 10
    pool = spark.createDataFrame([("x",), ("y",)], "name string")
    assert [r.name for r in V.cycled(pool, "name", 5).orderBy("position").collect()] == ["x", "y", "x", "y", "x"]
    assert [r.name for r in V.interleaved([pool, spark.createDataFrame([("z",)], "name string")], "name").orderBy("position").collect()] == ["x", "z", "y"]
    r = spark.range(1).select(N.cluster_result(F.lit(100.0), F.lit(10.0), F.lit(9.0), F.lit(4), F.lit(30.0)).alias("c"), M.executed_device(F.lit("GPU"), F.lit(True)).alias("d"), M.reading_strategy(F.lit("mixed")).alias("s")).first()
    assert (r.c.throughput, r.c.overhead_percent, r.c.speedup, r.c.efficiency) == (10.0, 10.0, 3.0, 0.75) and r.d.fallback and r.s == "mixed"
    with pytest.raises(RuntimeError):
        V.pdf_pages(spark.createDataFrame([], "path string, content binary"))
