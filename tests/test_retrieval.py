import math

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import evaluation as E
from folioflow.operators import generation as G
from folioflow.operators import retrieval as R


def test_tokens_and_words(spark):
    df = spark.createDataFrame([("Patient given 500mg Metformin BD; BP 120/80 mmHg.",), (None,), ("",)], "t string")
    got = [r.x for r in df.select(X.tokens(F.col("t")).alias("x")).collect()]
    assert {"500mg", "metformin", "120", "80", "mmhg"} <= set(got[0]) and got[1] is None and got[2] == []
    s = spark.createDataFrame([('He said "go." Then left. Élan came! 3 more.',)], "t string").select(X.sentences(F.col("t")).alias("x")).first().x
    assert s == ['He said "go.', "Then left.", "Élan came!", "3 more."]


def test_bm25_saturates_and_counts_repeated_terms(spark):
    docs = spark.createDataFrame([("a", "troponin troponin troponin cardiac marker"), ("b", "troponin cardiac marker"), ("c", None), ("d", "")], "id string, text string")
    q = spark.createDataFrame([("q1", "troponin"), ("q2", "troponin troponin"), ("q3", "zzz")], "query string, q string")
    bag = R.query_bag(q, "query", "q")
    hits = R.bm25(R.sparse_index(docs, "id", "text", only=bag), bag, b=0.0)
    s = {(r["query"], r["id"]): r["score"] for r in hits.collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    assert abs(s["q1", "a"] - idf * 3 * 2.5 / 4.5) < 1e-6 and s["q1", "a"] < 3 * s["q1", "b"]
    assert abs(s["q2", "b"] - 2 * s["q1", "b"]) < 2e-6 and not any(k[0] == "q3" for k in s)
    empty = spark.createDataFrame([], docs.schema)
    assert R.bm25(R.sparse_index(empty, "id", "text"), bag).count() == 0


def test_index_persists(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x y y"), ("b", "y z")], "id string, text string")
    R.sparse_index(docs, "id", "text").write(str(tmp_path))
    back = R.SparseIndex.read(spark, str(tmp_path))
    assert {(r["id"], r["term"], r["tf"]) for r in back.postings.collect()} == {("a", "x", 1), ("a", "y", 2), ("b", "y", 1), ("b", "z", 1)}


def test_rrf_order_and_values(spark):
    dense = spark.createDataFrame([("q", "A", 0.9, 1), ("q", "B", 0.8, 2), ("q", "C", 0.7, 3)], "query string, id string, score double, rank int")
    sparse = spark.createDataFrame([("q", "C", 3.0, 1), ("q", "A", 2.0, 2), ("q", "D", 1.0, 3)], "query string, id string, score double, rank int")
    got = R.reciprocal_rank_fusion(dense, sparse, 10).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["A", "C", "B", "D"]
    assert [r["rrf_score"] for r in got] == [round(1 / 61 + 1 / 62, 8), round(1 / 63 + 1 / 61, 8), round(1 / 62, 8), round(1 / 63, 8)]


def test_cosine_handles_zero_vectors_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "id int, vector array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query string, query_vector array<float>")
    got = R.top_k(R.cosine_scores(v, q), 3).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0), (3, 0.0)]


def test_metric_edge_cases(spark):
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("c", "z", 1)], "query string, id string, rank int")
    rel = spark.createDataFrame([("a", ["y", "w"]), ("b", ["k"]), ("c", None)], "query string, ids array<string>")
    m = {(r["query"], r.k): r for r in E.case_metrics(ranked, rel, (1, 5)).collect()}
    assert m["a", 5].precision == 0.2 and m["a", 5].recall == 0.5 and m["a", 5].rr == 0.5 and m["a", 1].hit == 0
    assert abs(m["a", 5].ndcg - round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6)) < 1e-6
    assert (m["b", 5].precision, m["b", 5].recall, m["b", 5].ndcg) == (0, 0, 0) and m["c", 1].recall == 0


def test_context_budget_cuts_once_and_stops(spark):
    rows = [("q", i, 1.0, "x" * n, f"d{i}", "f", [1], None) for i, n in ((1, 60), (2, 70), (3, 10))]
    ev = spark.createDataFrame(rows, "query string, rank int, score double, text string, document_id string, source_file string, page_numbers array<int>, section_heading string")
    got = [(r["rank"], len(r["text"]), r["cut"]) for r in G.context(ev, budget=120, shortest=50).orderBy("rank").collect()]
    assert got == [(1, 60, False), (2, 60, True)]
    assert [r["rank"] for r in G.context(ev, budget=105, shortest=50).collect()] == [1]
    q = spark.createDataFrame([("q", "What about xxxx?"), ("r", "Anything?"), ("s", " ")], "query string, question string")
    status = {r["query"]: r["status"] for r in G.extractive_answers(q, G.context(ev)).collect()}
    assert status == {"q": "ok", "r": "no_results", "s": "empty_query"}
