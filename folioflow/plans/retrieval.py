"""Queries over documents, chunks and vectors: tokens, indexes, searches, fusion, evaluation, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import evaluation as E
from folioflow.operators import generation as G
from folioflow.operators import providers as PR
from folioflow.operators import retrieval as R
from folioflow.operators.vectorindex import VectorIndex
from folioflow.runtime import scratch, table, written
from folioflow.sources import files as S

QUERY = "chronic kidney disease serum creatinine telmisartan kidney"
VECTOR_ID = 7


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = X.tokens(F.col("text"))
    return _documents(spark, d).filter(F.col("text").isNotNull()).select("doc_id", F.size(t).cast("bigint").alias("dl"), F.size(F.array_distinct(t)).cast("bigint").alias("terms"), X.words(F.col("text")).cast("bigint").alias("words"))


def vocab_df(spark: SparkSession, d: str) -> DataFrame:
    index = R.sparse_index(_documents(spark, d), "doc_id", "text")
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    index = R.sparse_index(_documents(spark, d), "doc_id", "text")
    vocabulary = index.postings.agg(F.count_distinct("term").alias("vocabulary"))
    return index.totals.crossJoin(F.broadcast(vocabulary)).select("docs", F.round("avgdl", 6).alias("avgdl"), "vocabulary")  # one row each


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    bag = R.query_bag(spark.createDataFrame([("q", QUERY)], "query_id string, query string"), "query_id", "query")
    index = R.sparse_index(_documents(spark, d), "doc_id", "text", only=bag)
    return R.top_k(R.bm25(index, bag), 10).select(F.col("id").alias("doc_id"), "score", "rank")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.groupBy("chunk_id").agg(F.min_by(F.struct("document_id", "text", "source_file", "page_numbers", "section_heading", "chunk_index"), "text").alias("c")).select("chunk_id", "c.*")


def _case_hits(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    """(query, id, score, rank): BM25 over chunks, the questions of all evaluation cases as queries."""
    bag = R.query_bag(table(spark, d, "eval_cases"), "case_id", "question")
    index = R.sparse_index(_chunks(spark, d), "chunk_id", "text", only=bag)
    return R.top_k(R.bm25(index, bag), k)


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    return _case_hits(spark, d, 5).select(F.col("query").alias("case_id"), F.col("id").alias("chunk_id"), "score", "rank")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return table(spark, d, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_vector"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(R.cosine_scores(_vectors(spark, d), _asked(spark, d)), 10).select("query", F.col("id").alias("vec_id"), "score", "rank")


def cosine_topk_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(R.cosine_scores(_vectors(spark, d).filter(F.col("label").isin(1, 2)), _asked(spark, d)), 5).select("query", F.col("id").alias("vec_id"), "score", "rank")


def cosine_topk_postfilter(spark: SparkSession, d: str) -> DataFrame:
    hits = R.top_k(R.cosine_scores(_vectors(spark, d), _asked(spark, d)), 20)
    kept = hits.join(_vectors(spark, d).select("id", "label"), "id").filter(F.col("label").isin(1, 2)).drop("rank")
    return R.top_k(kept, 20).select("query", F.col("id").alias("vec_id"), "score", "rank")


def dense_lists(spark: SparkSession, d: str) -> DataFrame:
    """The search of ``cosine_topk`` in a stored index of lists, all of them probed: the same rows."""
    path = scratch(spark, "lists")
    VectorIndex.build(_vectors(spark, d), 16).write(path)
    found = VectorIndex.read(spark, path).search(_asked(spark, d), 10, probes=16)
    return found.select("query", F.col("id").alias("vec_id"), "score", "rank")


def dense_lists_few(spark: SparkSession, d: str) -> DataFrame:
    """The same with four of sixteen lists probed and one label deleted: approximate."""
    index = VectorIndex.build(_vectors(spark, d), 16).without(_vectors(spark, d).filter(F.col("label") == 3).select("id"))
    return index.search(_asked(spark, d), 10, probes=4).select("query", F.col("id").alias("vec_id"), "score", "rank")


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = R.normalised(F.col("vector"))
    return _vectors(spark, d).select(F.col("id").alias("vec_id"), F.round(R.norm(F.col("vector")), 6).alias("length"), F.round(R.norm(v), 6).alias("unit_length"), F.round(v[0], 6).alias("first"))


def vector_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).agg(F.count("*").alias("vectors"), F.count_distinct("label").alias("labels"), F.max(F.size("vector")).cast("bigint").alias("dimension"), F.count_if(F.size("vector") != 64).alias("wrong_dimension"))


def vector_delete(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).filter(~F.col("label").eqNullSafe(3)).groupBy("label").agg(F.count("*").alias("vectors"))


def _dense_hits(spark: SparkSession, d: str, k: int = 20, only: Column | None = None) -> DataFrame:
    """(query, id, score, rank): cosine of embedded chunks and questions."""
    chunks = _chunks(spark, d)
    made = PR.embed_texts(chunks if only is None else chunks.filter(only), "chunk_id", "text", PR.hashing_embedder())
    asked = PR.embed_texts(table(spark, d, "eval_cases"), "case_id", "question", PR.hashing_embedder(), query=True)
    return R.top_k(R.cosine_scores(made, asked.select(F.col("case_id").alias("query"), F.col("vector").alias("query_vector")), "chunk_id"), k)


def _hybrid(spark: SparkSession, d: str, k: int, candidates: int = 20) -> DataFrame:
    """Both searches over the same chunks, fused by reciprocal ranks."""
    return R.reciprocal_rank_fusion(_dense_hits(spark, d, candidates), _case_hits(spark, d, candidates), k)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense_hits(spark, d, 5).select(F.col("query").alias("case_id"), F.col("id").alias("chunk_id"), "score", "rank")


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, 10).select(F.col("query").alias("case_id"), F.col("id").alias("chunk_id"), "dense_rank", "sparse_rank", "rrf_score", "rank")


def hybrid_min_score(spark: SparkSession, d: str) -> DataFrame:
    kept = _hybrid(spark, d, 20).filter(F.col("rrf_score") >= 0.016)
    return kept.groupBy(F.col("query").alias("case_id")).agg(F.count("*").alias("kept"), F.count_if(F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull()).alias("both"))


def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search in scanned documents only: the filter goes before both rankings."""
    only = F.col("document_id").like("scan%")
    bag = R.query_bag(table(spark, d, "eval_cases"), "case_id", "question")
    index = R.sparse_index(_chunks(spark, d).filter(only), "chunk_id", "text", only=bag)
    fused = R.reciprocal_rank_fusion(_dense_hits(spark, d, 20, only), R.top_k(R.bm25(index, bag), 20), 5)
    return fused.select(F.col("query").alias("case_id"), F.col("id").alias("chunk_id"), "rrf_score", "rank")


def hybrid_one_side(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search while the dense side is down: the sparse ranking alone is fused."""
    bag = R.query_bag(table(spark, d, "eval_cases"), "case_id", "question")
    scored = R.bm25(R.sparse_index(_chunks(spark, d), "chunk_id", "text", only=bag), bag)
    found = PR.retriever("hybrid", 5)(table(spark, d, "eval_cases"), None, scored)
    return found.select(F.col("query").alias("case_id"), F.col("id").alias("chunk_id"), "rrf_score", "rank")


def adaptive_depth(spark: SparkSession, d: str) -> DataFrame:
    return R.adaptive_depth(_hybrid(spark, d, 40)).withColumnRenamed("query", "case_id")


def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    """The search of ``bm25_batch`` on an index written to the shared folder and read back."""
    path = scratch(spark, "bm25")
    R.sparse_index(_chunks(spark, d), "chunk_id", "text").write(path)
    bag = R.query_bag(table(spark, d, "eval_cases"), "case_id", "question")
    return R.top_k(R.bm25(R.SparseIndex.read(spark, path), bag), 5).select(F.col("query").alias("case_id"), F.col("id").alias("chunk_id"), "score", "rank")


def rag_flow(spark: SparkSession, d: str) -> DataFrame:
    """Question to answer: hybrid search, budgeted context, deterministic answerer, status and sources."""
    texts = _chunks(spark, d).withColumnRenamed("chunk_id", "id")
    hits = _hybrid(spark, d, 5).select("query", "id", "rank", F.col("rrf_score").alias("score"))
    evidence = written(G.context(hits.join(texts, "id"), budget=2500), "evidence")
    answers = G.extractive_answers(_questions(spark, d), evidence)
    sources = evidence.groupBy("query").agg(F.count_distinct("document_id").alias("documents"), F.sum(F.length("text")).alias("characters"))
    return answers.join(sources, "query", "left").select(F.col("query").alias("case_id"), "status", "answer", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("characters", F.lit(0)).alias("characters"))


def retrieval_counters(spark: SparkSession, d: str) -> DataFrame:
    """What an engine counts: questions, questions without result, results a question."""
    found = _case_hits(spark, d, 5).groupBy("query").agg(F.count("*").alias("n"))
    per = _questions(spark, d).join(found, "query", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.count("*").alias("queries"), F.count_if(F.col("n") == 0).alias("empty"), F.round(F.avg("n"), 6).alias("mean_results"))


def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Change of each mean metric from single chunks to whole documents."""
    before = E.mean_metrics(E.case_metrics(_case_hits(spark, d), _relevant(spark, d, "relevant_chunk_ids"))).select("k", "metric", F.col("value").alias("before"))
    after = E.mean_metrics(E.case_metrics(_by_document(spark, d), _relevant(spark, d, "relevant_document_ids"))).select("k", "metric", F.col("value").alias("after"))
    absolute, relative = E.change(F.col("before"), F.col("after"))
    return before.join(after, ["k", "metric"]).select("k", "metric", F.round(absolute, 6).alias("absolute"), F.round(relative, 6).alias("relative"))


def depth_choice(spark: SparkSession, d: str) -> DataFrame:
    """The smallest number of candidates that keeps 95 percent of the recall at the greatest."""
    recall = candidate_recall(spark, d)
    best = recall.agg(F.max_by("recall", "depth").alias("best"))  # one row
    return recall.crossJoin(F.broadcast(best)).filter(F.col("recall") >= 0.95 * F.col("best")).agg(F.min("depth").alias("depth"))


def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The report as written for other tools and read back: (level, k, metric, value), four places."""
    chunk = ir_metrics_chunk(spark, d).select(F.lit("chunk").alias("level"), "k", "metric", "value")
    document = ir_metrics_doc(spark, d).select(F.lit("document").alias("level"), "k", "metric", "value")
    path = scratch(spark, "evaluation")
    S.write_report(chunk.unionByName(document), path)
    return S.read_report(spark, path)


def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "eval_cases").select(F.col("case_id").alias("query"), "question")
    texts = _chunks(spark, d).select(F.col("chunk_id").alias("id"), "text")
    candidates = _case_hits(spark, d, 20).join(texts, "id").join(cases, "query")
    return R.rerank(candidates, R.lexical_overlap(F.col("question"), F.col("text")), 5).select(F.col("query").alias("case_id"), F.col("id").alias("chunk_id"), "rerank_score", F.col("rerank_rank").alias("rank"))



def _relevant(spark: SparkSession, d: str, column: str) -> DataFrame:
    return table(spark, d, "eval_cases").select(F.col("case_id").alias("query"), F.col(column).alias("ids"))


def _by_document(spark: SparkSession, d: str) -> DataFrame:
    """The ranked chunks as ranked documents, repetitions kept."""
    owner = _chunks(spark, d).select(F.col("chunk_id").alias("chunk"), "document_id")
    hits = _case_hits(spark, d).withColumnRenamed("id", "chunk")
    return hits.join(owner, "chunk").select("query", F.col("document_id").alias("id"), "rank")


def ir_case_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.case_metrics(_case_hits(spark, d), _relevant(spark, d, "relevant_chunk_ids")).withColumnRenamed("query", "case_id")


def ir_metrics_chunk(spark: SparkSession, d: str) -> DataFrame:
    return E.mean_metrics(E.case_metrics(_case_hits(spark, d), _relevant(spark, d, "relevant_chunk_ids")))


def ir_metrics_doc(spark: SparkSession, d: str) -> DataFrame:
    return E.mean_metrics(E.case_metrics(_by_document(spark, d), _relevant(spark, d, "relevant_document_ids")))


def candidate_recall(spark: SparkSession, d: str) -> DataFrame:
    return E.candidate_recall(_case_hits(spark, d), _relevant(spark, d, "relevant_chunk_ids"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    texts = _chunks(spark, d).withColumnRenamed("chunk_id", "id")
    return G.context(_case_hits(spark, d, 8).join(texts, "id"), budget=2500)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_cases").select(F.col("case_id").alias("query"), "question")


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select(F.col("query").alias("case_id"), F.col("id").alias("chunk_id"), "rank", F.length("text").cast("bigint").alias("characters"), "cut")


def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    return G.prompts(_questions(spark, d), _evidence(spark, d)).select(F.col("query").alias("case_id"), "has_evidence", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("characters"))


def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    return G.extractive_answers(_questions(spark, d), _evidence(spark, d)).withColumnRenamed("query", "case_id")


def source_refs(spark: SparkSession, d: str) -> DataFrame:
    return G.source_references(_evidence(spark, d)).withColumnRenamed("query", "case_id")


_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_DOCS = f"SELECT doc_id AS id, {_TOK.format('text')} AS terms FROM documents WHERE text IS NOT NULL"
_CHUNKS = "SELECT chunk_id, min(text) AS text, arg_min(document_id, text) AS document_id, arg_min(source_file, text) AS source_file, arg_min(page_numbers, text) AS page_numbers, arg_min(section_heading, text) AS section_heading FROM chunks GROUP BY chunk_id"


def _bm25_sql(docs: str, bag: str, k: int) -> str:
    """CTEs down to ``hits(query, id, score, rank)``."""
    return f"""docs AS ({docs}), lengths AS (SELECT id, len(terms) AS dl FROM docs),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths), bag AS ({bag}),
postings AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM bag) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
parts AS (SELECT p.id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS part
  FROM postings p JOIN dfs USING (term) JOIN lengths USING (id) CROSS JOIN totals),
scored AS (SELECT query, id, round(sum(part * times), 6) AS score FROM parts JOIN bag USING (term) GROUP BY query, id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {k})"""


_CASE_BAG = f"SELECT query, term, count(*) AS times FROM (SELECT case_id AS query, unnest({_TOK.format('question')}) AS term FROM eval_cases) GROUP BY query, term"
_CASE_HITS = _bm25_sql(f"SELECT chunk_id AS id, {_TOK.format('text')} AS terms FROM ({_CHUNKS}) WHERE text IS NOT NULL", _CASE_BAG, 20)
_UNIT = """unit AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings),
asked AS (SELECT id AS query, label AS wanted, v AS q FROM unit WHERE id % 50 = 0)"""
_COS = "round(list_dot_product(v, q), 6)"
_HASHED = "(strpos('0123456789abcdef', substr(md5(term), 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5(term), 2, 1)) - 1"


def _hybrid_sql(only: str = "true", k: int = 20) -> str:
    """CTEs down to ``dense``, ``hits`` and ``fused``."""
    chunks = f"SELECT chunk_id AS id, {_TOK.format('text')} AS terms FROM ({_CHUNKS}) WHERE text IS NOT NULL AND {only}"
    embed = lambda rows, key: f"SELECT {key}, ({_HASHED}) % 64 AS b, sum(CASE WHEN substr(md5(term), 3, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM (SELECT {key}, unnest(terms) AS term FROM {rows}) GROUP BY 1, 2"
    return f"""{_bm25_sql(chunks, _CASE_BAG, k)}, asked AS (SELECT case_id AS query, {_TOK.format(f"'{PR.QUERY_PREFIX}' || question")} AS terms FROM eval_cases WHERE question IS NOT NULL),
dv AS ({embed('docs', 'id')}), qv AS ({embed('asked', 'query')}),
dn AS (SELECT id, sqrt(sum(v * v)) AS n FROM dv GROUP BY id), qn AS (SELECT query, sqrt(sum(v * v)) AS n FROM qv GROUP BY query),
dots AS (SELECT query, id, sum((qv.v / qn.n) * (dv.v / dn.n)) AS s FROM qv JOIN qn USING (query) JOIN dv USING (b) JOIN dn USING (id) WHERE qn.n > 0 AND dn.n > 0 GROUP BY query, id),
scores AS (SELECT a.query, d.id, round(coalesce(s, 0), 6) AS score FROM asked a CROSS JOIN docs d LEFT JOIN dots x ON x.query = a.query AND x.id = d.id),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM scores) WHERE rank <= {k}),
fused AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf_score DESC, dense_rank NULLS LAST, id) AS rank FROM (
  SELECT coalesce(a.query, b.query) AS query, coalesce(a.id, b.id) AS id, a.rank AS dense_rank, b.rank AS sparse_rank,
    round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 8) AS rrf_score
  FROM dense a FULL JOIN hits b ON a.query = b.query AND a.id = b.id))"""


def _metrics_sql(ranked: str, column: str, cuts: str, distinct: bool = False) -> str:
    best = "SELECT query, id, min(rank) AS rank FROM ranked0 GROUP BY query, id" if distinct else "SELECT * FROM ranked0"
    return f"""ranked0 AS ({ranked}), ranked AS ({best}), rel AS (SELECT case_id AS query, list_distinct(coalesce({column}, [])) AS ids FROM eval_cases),
asked AS (SELECT query, len(ids) AS relevant, ids, unnest({cuts}) AS k FROM rel),
found AS (SELECT a.query, a.k, a.relevant, count(*) FILTER (r.rank <= a.k AND list_contains(a.ids, r.id)) AS hits,
  min(CASE WHEN r.rank <= a.k AND list_contains(a.ids, r.id) THEN r.rank END) AS first,
  coalesce(sum(CASE WHEN r.rank <= a.k AND list_contains(a.ids, r.id) THEN 1.0::DOUBLE / log2(r.rank + 1) END), 0) AS dcg
  FROM asked a LEFT JOIN ranked r ON a.query = r.query GROUP BY a.query, a.k, a.relevant),
m AS (SELECT query, k, round(hits::DOUBLE / k, 6) AS precision, round(CASE WHEN relevant > 0 THEN hits::DOUBLE / relevant ELSE 0 END, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr,
  round(CASE WHEN least(relevant, k) > 0 THEN dcg / list_sum(list_transform(range(1, least(relevant, k) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0 END, 6) AS ndcg, CAST(hits > 0 AS INTEGER) AS hit FROM found)"""


_LONG = " UNION ALL ".join(f"SELECT k, '{x}' AS metric, round(avg({x}), 4) AS value, count(*) AS cases FROM m GROUP BY k" for x in ("precision", "recall", "rr", "ndcg", "hit"))
_DOC_RANKED = f"SELECT h.query, c.document_id AS id, h.rank FROM hits h JOIN ({_CHUNKS}) c ON h.id = c.chunk_id"
_TAKEN = """placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM top WHERE score >= 0 AND text IS NOT NULL) WHERE place <= 5),
sums AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM placed),
evidence AS (SELECT query, id, rank, document_id, source_file, page_numbers, section_heading, length(text) > 2500 - used AS cut,
  CASE WHEN length(text) <= 2500 - used THEN text ELSE substring(text, 1, CAST(2500 - used AS BIGINT)) END AS text
  FROM sums WHERE used <= 2500 AND (length(text) <= 2500 - used OR 2500 - used > 50))"""
_TOP = f"top AS (SELECT h.query, h.id, h.score, h.rank, c.* EXCLUDE (chunk_id) FROM {{hits}} h JOIN ({_CHUNKS}) c ON h.id = c.chunk_id WHERE h.rank <= {{k}})"
_EVIDENCE = f"{_CASE_HITS}, {_TOP.format(hits='hits', k=8)}, {_TAKEN}"
_PAGES = "CASE WHEN len(page_numbers) > 0 THEN array_to_string(page_numbers, ', ') ELSE 'N/A' END"
_ANSWERED = f"""per AS (SELECT query, string_agg('(' || document_id || ', p. ' || {_PAGES} || ')', ', ' ORDER BY rank) AS sources,
  arg_min(substring(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], ' '), 1, 150), rank) AS snippet, lower(string_agg(text, chr(10))) AS evidence FROM evidence GROUP BY query),
q AS (SELECT case_id, question, per.*, list_filter(list_distinct(regexp_extract_all(lower(question), '\\b[a-z]{{4,}}\\b')), lambda w: NOT list_contains({G.STOPWORDS!r}, w)) AS content FROM eval_cases LEFT JOIN per ON case_id = query),
s AS (SELECT *, CASE WHEN trim(coalesce(question, '')) = '' THEN 'empty_query' WHEN evidence IS NULL THEN 'no_results' WHEN len(content) > 0 AND len(list_filter(content, lambda w: contains(evidence, w))) = 0 THEN 'insufficient_evidence' ELSE 'ok' END AS status FROM q)
SELECT case_id, status, CASE status WHEN 'ok' THEN 'Based on the retrieved evidence: ' || snippet || '... Sources: ' || sources || '.' WHEN 'insufficient_evidence' THEN 'Insufficient evidence to answer this question.' WHEN 'no_results' THEN 'No relevant documents were found.' END AS answer FROM s"""

QUERIES = {
    "token_stats": token_stats, "vocab_df": vocab_df, "corpus_stats": corpus_stats, "bm25_topk": bm25_topk, "bm25_batch": bm25_batch,
    "cosine_topk": cosine_topk, "cosine_topk_prefilter": cosine_topk_prefilter, "cosine_topk_postfilter": cosine_topk_postfilter, "vector_norms": vector_norms,
    "vector_index_stats": vector_index_stats, "vector_delete": vector_delete, "rrf_fuse": rrf_fuse, "hybrid_min_score": hybrid_min_score, "adaptive_depth": adaptive_depth, "rerank_lexical": rerank_lexical,
    "ir_case_metrics": ir_case_metrics, "ir_metrics_chunk": ir_metrics_chunk, "ir_metrics_doc": ir_metrics_doc, "candidate_recall": candidate_recall,
    "dense_lists": dense_lists, "dense_lists_few": dense_lists_few, "dense_topk": dense_topk, "hybrid_filtered": hybrid_filtered, "hybrid_one_side": hybrid_one_side, "bm25_stored": bm25_stored, "rag_flow": rag_flow,
    "retrieval_counters": retrieval_counters, "metric_deltas": metric_deltas, "depth_choice": depth_choice, "evaluation_report": evaluation_report, "context_budget": context_budget, "prompt_render": prompt_render, "extractive_answer": extractive_answer, "source_refs": source_refs,
}
SQL = {
    "token_stats": f"SELECT doc_id, len({_TOK.format('text')}) AS dl, len(list_distinct({_TOK.format('text')})) AS terms, len(list_filter(regexp_split_to_array(text, '[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL",
    "vocab_df": f"SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(terms) AS term FROM ({_DOCS})) GROUP BY term",
    "corpus_stats": f"WITH docs AS ({_DOCS}) SELECT count(*) AS docs, round(avg(len(terms)), 6) AS avgdl, (SELECT count(DISTINCT term) FROM (SELECT unnest(terms) AS term FROM docs)) AS vocabulary FROM docs",
    "bm25_topk": f"WITH {_bm25_sql(_DOCS, f"SELECT 'q' AS query, term, count(*) AS times FROM (SELECT unnest({_TOK.format(repr(QUERY))}) AS term) GROUP BY term", 10)} SELECT id AS doc_id, score, rank FROM hits",
    "bm25_batch": f"WITH {_CASE_HITS} SELECT query AS case_id, id AS chunk_id, score, rank FROM hits WHERE rank <= 5",
    "cosine_topk": f"WITH {_UNIT} SELECT query, id AS vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, id, {_COS} AS score FROM unit, asked)) WHERE rank <= 10",
    "dense_lists": f"WITH {_UNIT} SELECT query, id AS vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, id, {_COS} AS score FROM unit, asked)) WHERE rank <= 10",
    "cosine_topk_prefilter": f"WITH {_UNIT} SELECT query, id AS vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, id, {_COS} AS score FROM unit, asked WHERE label IN (1, 2))) WHERE rank <= 5",
    "cosine_topk_postfilter": f"WITH {_UNIT}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM (SELECT query, id, label, {_COS} AS score FROM unit, asked)) WHERE r <= 20) SELECT query, id AS vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM h WHERE label IN (1, 2)",
    "vector_norms": f"WITH {_UNIT} SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 6) AS length, round(sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS unit_length, round(v[1], 6) AS first FROM embeddings JOIN unit ON vec_id = id",
    "vector_index_stats": "SELECT count(*) AS vectors, count(DISTINCT label) AS labels, max(len(embedding)) AS dimension, count(*) FILTER (len(embedding) <> 64) AS wrong_dimension FROM embeddings",
    "vector_delete": "SELECT label, count(*) AS vectors FROM embeddings WHERE label IS DISTINCT FROM 3 GROUP BY label",
    "rrf_fuse": f"WITH {_hybrid_sql()} SELECT query AS case_id, id AS chunk_id, dense_rank, sparse_rank, rrf_score, rank FROM fused WHERE rank <= 10",
    "hybrid_min_score": f"WITH {_hybrid_sql()} SELECT query AS case_id, count(*) AS kept, count(*) FILTER (dense_rank IS NOT NULL AND sparse_rank IS NOT NULL) AS both FROM fused WHERE rank <= 20 AND rrf_score >= 0.016 GROUP BY query",
    "adaptive_depth": f"""WITH {_hybrid_sql()}, s AS (SELECT query, coalesce(bool_or(rank = 1 AND dense_rank <= 5 AND sparse_rank <= 5), false) AS top1, coalesce(bool_or(rank <= 3 AND dense_rank <= 5 AND sparse_rank <= 5), false) AS top3,
  round(max(CASE WHEN rank = 1 THEN rrf_score END) - coalesce(max(CASE WHEN rank = 5 THEN rrf_score END), min(CASE WHEN rank <= 5 THEN rrf_score END)), 8) AS gap, count(*) AS available FROM fused WHERE rank <= 40 GROUP BY query)
SELECT query AS case_id, gap, CAST(least(CASE WHEN top1 AND gap >= 0.005 THEN 5 WHEN top3 THEN 10 ELSE 20 END, available) AS INTEGER) AS depth FROM s""",
    "rerank_lexical": f"""WITH {_CASE_HITS}, r AS (SELECT h.query, h.id, h.rank, round(CASE WHEN len(list_distinct({_TOK.format('e.question')})) > 0 THEN len(list_intersect(list_distinct({_TOK.format('e.question')}), {_TOK.format('c.text')}))::DOUBLE / len(list_distinct({_TOK.format('e.question')})) ELSE 0 END, 6) AS rerank_score
  FROM hits h JOIN ({_CHUNKS}) c ON h.id = c.chunk_id JOIN eval_cases e ON h.query = e.case_id)
SELECT query AS case_id, id AS chunk_id, rerank_score, rr AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rerank_score DESC, rank) AS rr FROM r) WHERE rr <= 5""",
    "ir_case_metrics": f"WITH {_CASE_HITS}, {_metrics_sql('SELECT query, id, rank FROM hits', 'relevant_chunk_ids', '[1, 3, 5]')} SELECT query AS case_id, k, precision, recall, rr, ndcg, hit FROM m",
    "ir_metrics_chunk": f"WITH {_CASE_HITS}, {_metrics_sql('SELECT query, id, rank FROM hits', 'relevant_chunk_ids', '[1, 3, 5]')} {_LONG}",
    "ir_metrics_doc": f"WITH {_CASE_HITS}, {_metrics_sql(_DOC_RANKED, 'relevant_document_ids', '[1, 3, 5]')} {_LONG}",
    "candidate_recall": f"WITH {_CASE_HITS}, {_metrics_sql('SELECT query, id, rank FROM hits', 'relevant_chunk_ids', '[5, 10, 15, 20]', True)} SELECT k AS depth, round(avg(recall), 6) AS recall FROM m GROUP BY k",
    "context_budget": f"WITH {_EVIDENCE} SELECT query AS case_id, id AS chunk_id, rank, length(text) AS characters, cut FROM evidence",
    "source_refs": f"WITH {_EVIDENCE} SELECT query AS case_id, document_id, source_file, list_sort(list_distinct(flatten(list(page_numbers)))) AS page_numbers FROM evidence GROUP BY query, document_id, source_file",
    "prompt_render": f"""WITH {_EVIDENCE}, b AS (SELECT query, string_agg('[Source: ' || document_id || ' | File: ' || coalesce(source_file, '') || ' | Pages: ' || {_PAGES} || CASE WHEN section_heading IS NOT NULL AND section_heading <> '' THEN ' | Section: ' || section_heading ELSE '' END || ' | Rank: ' || rank || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS blocks FROM evidence GROUP BY query),
p AS (SELECT case_id, blocks IS NOT NULL AS has_evidence, CASE WHEN blocks IS NOT NULL THEN '{G.RULES}' || chr(10) || chr(10) || '{G.BEGIN}' || chr(10) || blocks || chr(10) || '{G.END}' || chr(10) || chr(10) || 'User Question: ' || question ELSE '{G.NO_RULES}' || chr(10) || chr(10) || 'User Question: ' || question END AS prompt FROM eval_cases LEFT JOIN b ON case_id = query)
SELECT case_id, has_evidence, md5(prompt) AS prompt_md5, length(prompt) AS characters FROM p""",
    "extractive_answer": f"WITH {_EVIDENCE}, {_ANSWERED}",
    "dense_topk": f"WITH {_hybrid_sql()} SELECT query AS case_id, id AS chunk_id, score, rank FROM dense WHERE rank <= 5",
    "hybrid_filtered": f"""WITH {_hybrid_sql("document_id LIKE 'scan%'")} SELECT query AS case_id, id AS chunk_id, rrf_score, rank FROM fused WHERE rank <= 5""",
    "hybrid_one_side": f"WITH {_CASE_HITS} SELECT query AS case_id, id AS chunk_id, round(1.0::DOUBLE / (60 + rank), 8) AS rrf_score, rank FROM hits WHERE rank <= 5",
    "bm25_stored": f"WITH {_CASE_HITS} SELECT query AS case_id, id AS chunk_id, score, rank FROM hits WHERE rank <= 5",
    "rag_flow": f"""WITH {_hybrid_sql()}, found AS (SELECT query, id, rrf_score AS score, rank FROM fused), {_TOP.format(hits='found', k=5)}, {_TAKEN}, answers AS (WITH {_ANSWERED}),
src AS (SELECT query, count(DISTINCT document_id) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM evidence GROUP BY query)
SELECT a.case_id, status, answer, coalesce(documents, 0) AS documents, coalesce(characters, 0) AS characters FROM answers a LEFT JOIN src ON a.case_id = src.query""",
    "retrieval_counters": f"WITH {_CASE_HITS}, n AS (SELECT query, count(*) AS n FROM hits WHERE rank <= 5 GROUP BY query) SELECT count(*) AS queries, count(*) FILTER (coalesce(n, 0) = 0) AS empty, round(avg(coalesce(n, 0)), 6) AS mean_results FROM eval_cases LEFT JOIN n ON case_id = query",
    "depth_choice": f"WITH {_CASE_HITS}, {_metrics_sql('SELECT query, id, rank FROM hits', 'relevant_chunk_ids', '[5, 10, 15, 20]', True)}, c AS (SELECT k AS depth, round(avg(recall), 6) AS recall FROM m GROUP BY k) SELECT min(depth) AS depth FROM c WHERE recall >= 0.95::DOUBLE * (SELECT recall FROM c WHERE depth = 20)",
    "evaluation_report": f"""SELECT 'chunk' AS level, k, metric, value FROM (WITH {_CASE_HITS}, {_metrics_sql('SELECT query, id, rank FROM hits', 'relevant_chunk_ids', '[1, 3, 5]')} {_LONG})
UNION ALL SELECT 'document' AS level, k, metric, value FROM (WITH {_CASE_HITS}, {_metrics_sql(_DOC_RANKED, 'relevant_document_ids', '[1, 3, 5]')} {_LONG})""",
    "metric_deltas": f"""WITH a AS (WITH {_CASE_HITS}, {_metrics_sql('SELECT query, id, rank FROM hits', 'relevant_chunk_ids', '[1, 3, 5]')} {_LONG}), b AS (WITH {_CASE_HITS}, {_metrics_sql(_DOC_RANKED, 'relevant_document_ids', '[1, 3, 5]')} {_LONG})
SELECT k, metric, round(b.value - a.value, 6) AS absolute, round(CASE WHEN a.value <> 0 THEN (b.value - a.value) / a.value ELSE 0 END, 6) AS relative FROM a JOIN b USING (k, metric)""",
}
