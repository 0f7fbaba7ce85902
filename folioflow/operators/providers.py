"""Pluggable models with deterministic offline defaults, and the pipelines built on them.

A provider is a function from pandas to pandas, run in Arrow batches: an embedder (texts to
vectors), a reranker (pairs to scores), an answerer (prompts to answers) or a page reader
(file contents to pages). Anything with a network or a model file is left to the caller.
"""

from __future__ import annotations

import hashlib
import importlib.util
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import retrieval as R
from folioflow.operators.scheduling import global_rank

# Fixed value: what the embedding model expects before a question.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
Embedder = Callable[[pd.Series], list[np.ndarray]]


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Signed counts of hashed words: the same on every machine, no model needed.

    The first two hexadecimal digits of a word's MD5 name its place, the third its sign, so that
    SQL can say it too. At most 256 places.
    """
    known: dict[str, tuple[int, float]] = {}

    def place(word: str) -> tuple[int, float]:
        found = known.get(word)
        if found is None:
            h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
            if len(known) > 200_000:  # memory stays bounded
                known.clear()
            found = known[word] = (int(h[:2], 16) % dimension, 1.0 if h[2] < "8" else -1.0)
        return found

    def embed(texts: pd.Series) -> list[np.ndarray]:
        out = []
        for t in texts:
            v = np.zeros(dimension, "f4")
            for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
                at, sign = place(w)
                v[at] += sign
            out.append(v)
        return out

    return embed


def embed_texts(rows: DataFrame, key: str, text: str, embedder: Embedder, cache: DataFrame | None = None, query: bool = False) -> DataFrame:
    """(key, content, vector): each distinct text is embedded once, those of the cache (content, vector) not at all.

    Only queries get the prefix. Null texts are left out.
    """
    said = F.concat(F.lit(QUERY_PREFIX), F.col(text)) if query else F.col(text)
    keyed = rows.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), said.alias("said")).withColumn("content", F.sha2("said", 256))
    todo = keyed.select("content", "said").dropDuplicates(["content"])
    if cache is not None:
        todo = todo.join(cache.select("content"), "content", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"content": pdf["content"], "vector": embedder(pdf["said"])})

    made = todo.mapInPandas(run, "content string, vector array<float>")
    vectors = made if cache is None else made.unionByName(cache.select("content", "vector"))
    return keyed.select("key", "content").join(vectors, "content").withColumnRenamed("key", key)


def rescore(candidates: DataFrame, question: str, text: str, model: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """``candidates`` with a column ``model_score`` of (question, text) pairs."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return model(a, b)

    return candidates.withColumn("model_score", score(F.col(question), F.col(text)))


def retriever(kind: str, k: int = 5, candidates: int = 20) -> Callable[[DataFrame, DataFrame | None, DataFrame | None], DataFrame]:
    """A search of the named kind over scored rows (query, id, score): dense, sparse or hybrid.

    A side that is missing counts as empty, so hybrid search lives with one of both.
    """
    R.check_k(k)
    if kind not in ("dense", "sparse", "hybrid"):
        raise ValueError(f"unknown kind of retrieval: {kind}")

    def search(queries: DataFrame, dense: DataFrame | None = None, sparse: DataFrame | None = None) -> DataFrame:
        nothing = queries.sparkSession.createDataFrame([], "query string, id string, score double")
        d, s = (nothing if x is None else x for x in (dense, sparse))
        if kind != "hybrid":
            return R.top_k(d if kind == "dense" else s, k)
        return R.reciprocal_rank_fusion(R.top_k(d, candidates), R.top_k(s, candidates), k)

    return search


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page_number, text) of ``binaryFile`` rows, by a PDF library if one is installed."""
    if not importlib.util.find_spec("pypdf"):
        raise RuntimeError("reading PDF files needs pypdf, which is optional")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pypdf

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, i, page.extract_text() or "") for i, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1)]
                except Exception:  # noqa: BLE001 - a file that can't be read has one empty page
                    rows.append((path, 1, ""))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, page_number int, text string")


def sampled_pages(n: int) -> list[int]:
    """Indices of the pages that are looked at closely: every tenth of the document."""
    return list(range(0, n, max(1, n // 10)))


def page_structure(page) -> dict:  # noqa: ANN001
    """Fonts, size, characters and image share of a page object of a PDF library (``resources``, ``mediabox``, ``extract_text``)."""
    resources = page.get("/Resources", {}) or {}
    fonts = sorted({str(f.get("/BaseFont", name)) for name, f in (resources.get("/Font", {}) or {}).items()})
    width, height = float(page.mediabox.width), float(page.mediabox.height)
    objects = (resources.get("/XObject", {}) or {}).values()
    pixels = sum(int(o.get("/Width", 0)) * int(o.get("/Height", 0)) for o in objects if o.get("/Subtype") == "/Image")
    # at 150 dots an inch an image of the page's size covers it
    whole = max(1.0, width / 72 * 150 * height / 72 * 150)
    return {"fonts": fonts, "width": width, "height": height, "characters": len(page.extract_text() or ""), "image_density": min(1.0, pixels / whole)}


def pdf_structure(files: DataFrame) -> DataFrame:
    """(path, pages, fonts, width, height, text_pages, image_density) of PDF files: all pages' text, every tenth's images."""
    if not importlib.util.find_spec("pypdf"):
        raise RuntimeError("reading PDF files needs pypdf, which is optional")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pypdf

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages = pypdf.PdfReader(io.BytesIO(content)).pages
                    seen = [page_structure(pages[i]) for i in sampled_pages(len(pages))]
                    fonts = sorted({f for s in seen for f in s["fonts"]})
                    density = sum(s["image_density"] for s in seen) / max(1, len(seen))
                    rows.append((path, max(1, len(pages)), fonts, seen[0]["width"], seen[0]["height"], sum(s["characters"] > 0 for s in seen), density))
                except Exception:  # noqa: BLE001 - a file that can't be read has one empty page
                    rows.append((path, 1, [], 0.0, 0.0, 0, 0.0))
            yield pd.DataFrame(rows, columns=["path", "pages", "fonts", "width", "height", "text_pages", "image_density"])

    return files.select("path", "content").mapInPandas(read, "path string, pages int, fonts array<string>, width double, height double, text_pages int, image_density double")


def ctc_decode(scores: np.ndarray, alphabet: str, blank: int = 0) -> tuple[str, float]:
    """Greedy reading of (steps, symbols) scores: best symbol a step, repeats and blanks dropped; mean probability."""
    p = np.exp(scores - scores.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    keep = (best != blank) & np.r_[True, best[1:] != best[:-1]]
    return "".join(alphabet[i] for i in best[keep]), float(p[np.arange(len(p)), best][keep].mean()) if keep.any() else 0.0


def synthetic_notes(spark, n: int, seed: int = 1) -> DataFrame:  # noqa: ANN001
    """(id, specialty, note): made-up notes for fixtures, the same for the same seed."""
    pick = lambda what, salt: F.element_at(F.array(*[F.lit(x) for x in what]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(what))) + 1).cast("int"))
    specialty = pick(["cardiology", "neurology", "orthopedics", "pediatrics", "pulmonology", "gastroenterology"], "s")
    finding = pick(["fever", "chest pain", "a dry cough", "ankle swelling", "dizziness", "nausea"], "f")
    plan = pick(["a follow-up visit", "an x-ray", "blood tests", "rest and fluids"], "p")
    days = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(20)) + 1
    note = F.format_string("The patient reported %s for %d days. Examination in %s was unremarkable. We advised %s.", finding, days, specialty, plan)
    return spark.range(n).select("id", specialty.alias("specialty"), note.alias("note"))


def cycled(pool: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows that go round the pool in order, numbered by ``position`` from 0."""
    size = pool.count()
    if not size:
        raise ValueError("the pool is empty")
    numbered = global_rank(pool, [F.col(order)], "_place").withColumn("_place", F.col("_place") - 1)
    return pool.sparkSession.range(n).select(F.col("id").alias("position"), (F.col("id") % size).alias("_place")).join(numbered, "_place").drop("_place")


def interleaved(classes: list[DataFrame], order: str) -> DataFrame:
    """First rows of every class, then the second ones, and so on, numbered by ``position``."""
    placed = None
    for i, c in enumerate(classes):
        part = global_rank(c, [F.col(order)], "_turn").withColumn("_class", F.lit(i))
        placed = part if placed is None else placed.unionByName(part)
    return global_rank(placed, [F.col("_turn"), F.col("_class")], "position").withColumn("position", F.col("position") - 1).drop("_turn", "_class")
