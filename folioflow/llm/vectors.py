"""Most similar vectors for every vector: inverted file, product quantisation, exact reranking.

Spherical k-means centroids and residual codebooks are fitted on the driver from a bounded
sample; every vector is then indexed (its list, its code) and every vector is a query against
the ``probes`` nearest lists. Neighbouring lists form groups: a vector is sent once to each
group that holds a list it probes, and where that is its own group the same row is member and
query. Within a list, asymmetric distance tables rank the members and the best ``rerank`` of them
are compared exactly. Vectors of the same direction form a class whose representative alone is
indexed, so that a vector repeated under a third of all keys costs one index entry; its members
are expanded afterwards, at most ``k`` neighbours each.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.runtime import table, written

#: Rows of the sample that centroids and codebooks are fitted on: so many a list, and its bound. No more lists are made
#: than the bound gives so many rows, so beyond some 9 million vectors lists grow longer instead of more.
ROWS_A_LIST, SAMPLE_ROWS = 32, 200_000
#: Most members, and most queries, of a group of lists that one task compares at once.
BLOCK_ROWS = 8192
#: Lists of a group.
GROUPED = 16


def latest_vectors(cache: DataFrame, key: str = "cache_key", value: str = "vector_bytes", at: str = "created_at") -> DataFrame:
    """(key, bytes) of the newest row of each key; of rows as new, the one with the greatest bytes.

    Rows without a key are left out; a null time is older than any other.
    """
    newest = F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("bytes"))).alias("last")
    return (
        cache.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("string").alias("key"))
        .agg(newest)
        .select("key", F.col("last.bytes").alias("bytes"))
    )


def unit_vectors(rows: DataFrame, dim: int = 64) -> DataFrame:
    """(key, vec, sig): little-endian float32 vectors at length one; sig is equal for equal directions.

    Null values, those of another length, with NaN or infinite components, and all-zero
    ones are left out.
    """

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.frombuffer(b"".join(pdf["bytes"]), "<f4").reshape(-1, dim).astype("f8")
            with np.errstate(invalid="ignore", over="ignore"):
                peak = np.abs(v).max(1)
                ok = np.isfinite(peak) & (peak > 0)
                v, keys = v[ok] / peak[ok, None], pdf["key"].to_numpy()[ok]
                v /= np.linalg.norm(v, axis=1)[:, None]
            sig = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in np.round(v * 1e6).astype("<i4")]
            yield pd.DataFrame({"key": keys, "vec": [x.tobytes() for x in v.astype("<f4")], "sig": sig})

    return rows.filter(F.octet_length("bytes") == 4 * dim).mapInPandas(convert, "key string, vec binary, sig binary")


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n centres with the largest inner product, best first."""
    score = x @ centres.T
    if n == 1:
        return score.argmax(1)[:, None]
    top = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(x), 1))
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)


def _spherical_kmeans(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        of = np.concatenate([_nearest(x[i : i + 4096], centres, 1)[:, 0] for i in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        size = np.linalg.norm(total, axis=1)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def _kmeans(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), n, replace=len(x) < n)].copy()
    for _ in range(rounds):
        of = _codes(x, words)
        count = np.bincount(of, minlength=n)
        total = np.stack([np.bincount(of, x[:, d], n) for d in range(x.shape[1])], 1)
        words[count > 0] = total[count > 0] / count[count > 0, None]
    return words


def _codes(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = (words**2).sum(1) / 2
    return np.concatenate([(x[i : i + 8192] @ words.T - half).argmax(1) for i in range(0, len(x), 8192)])


class Quantiser:
    """Centroids (lists) and the residual codebooks of ``parts`` equal slices of a vector."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = 8, words: int = 256, rounds: int = 6, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.parts = parts
        self.centres = _spherical_kmeans(sample, min(lists, len(sample)), rounds, rng).astype("f4")
        self.groups = self._grouped(rng)
        part = sample[rng.choice(len(sample), min(len(sample), 12_000), replace=False)]
        residual = part - self.centres[_nearest(part, self.centres, 1)[:, 0]]
        self.books = np.stack([_kmeans(s, words, rounds, rng) for s in np.split(residual, parts, axis=1)]).astype("f4")

    def _grouped(self, rng: np.random.Generator) -> np.ndarray:
        """The group of each list: neighbouring centroids together."""
        n = max(1, round(len(self.centres) / GROUPED))
        return _nearest(self.centres, _spherical_kmeans(self.centres, n, 6, rng), 1)[:, 0].astype("i4")

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = x - self.centres[lists]
        return np.stack([_codes(s, self.books[j]) for j, s in enumerate(np.split(residual, self.parts, axis=1))], 1).astype("u1")

    def scores(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products of the queries with the coded members of list ``at``."""
        tables = np.einsum("qjd,jwd->jqw", queries.reshape(len(queries), self.parts, -1), self.books, optimize=True)
        out = np.repeat((queries @ self.centres[at])[:, None], len(codes), 1)
        for j in range(self.parts):
            out += np.take(tables[j], codes[:, j], axis=1)
        return out


def similar_vectors(
    vectors: DataFrame,
    *,
    k: int = 5,
    least: float = -1.0,
    lists: int | None = None,
    probes: int | None = None,
    rerank: int = 48,
    dim: int = 64,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(key, neighbour, similarity, rank): the ``k`` most similar other keys of every key.

    ``vectors`` is the result of ``unit_vectors``. ``least`` leaves out less similar
    neighbours before they are shuffled. Ties are broken by key. One vector or none gives
    no rows. Approximate: the ``probes`` nearest lists are searched, by default as many as the
    square root of their number, which finds nine in ten of the five nearest however far those
    are; of neighbours of cosine 0.90 and more, eight lists find all but a few in a hundred.
    """
    spark = vectors.sparkSession
    keyed = written(vectors, "unit")
    # classes of one direction, by signature and key only
    classes = keyed.groupBy("sig").agg(F.min("key").alias("rep"), F.count("*").alias("size"))
    shared = written(classes.filter("size > 1"), "shared")
    counts = keyed.agg(F.count("*").alias("n")).crossJoin(F.broadcast(shared.agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("more")))).first()  # one row each
    n = counts["n"] - counts["more"]
    empty = "key string, neighbour string, similarity double, rank int"
    if not n:
        return spark.createDataFrame([], empty)
    reps = keyed.join(shared.select("sig", F.col("rep").alias("first")), "sig", "left").filter(F.col("first").isNull() | (F.col("first") == F.col("key"))).select(F.col("key").alias("rep"), "vec")
    lists = lists or max(1, min(n, round(2 * math.sqrt(n))))
    lists = max(1, min(lists, sample_rows // ROWS_A_LIST))
    wanted = min(sample_rows, ROWS_A_LIST * lists)
    share = max(1, keyed.count() // wanted)
    sample = keyed.filter(F.pmod(F.xxhash64("sig"), F.lit(share)) == 0).dropDuplicates(["sig"]).orderBy(F.xxhash64("key")).limit(sample_rows).select("vec").toPandas()
    if not len(sample):
        sample = keyed.limit(sample_rows).select("vec").toPandas()
    x = np.frombuffer(b"".join(sample["vec"]), "<f4").reshape(-1, dim)
    lists = min(lists, len(x))
    model = spark.sparkContext.broadcast(Quantiser(x, lists))  # lists and 256 words of float32 vectors: bounded by the sample
    probes = min(probes or max(8, math.ceil(math.sqrt(lists))), lists)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = model.value
        members, asks = (np.zeros(int(q.groups.max()) + 1, int) for _ in range(2))
        for pdf in batches:
            if len(pdf):
                near = q.groups[_nearest(np.frombuffer(b"".join(pdf["vec"]), "<f4").reshape(-1, dim), q.centres, probes)]
                members += np.bincount(near[:, 0], minlength=len(members))
                near.sort(axis=1)
                asks += np.bincount(near[np.c_[np.ones(len(near), bool), near[:, 1:] != near[:, :-1]]], minlength=len(asks))
        yield pd.DataFrame({"grp": np.arange(len(members)), "members": members, "asks": asks})

    # a row a group and task: how many members and queries each group has
    load = reps.mapInPandas(weigh, "grp int, members bigint, asks bigint").groupBy("grp").agg(F.sum("members").alias("members"), F.sum("asks").alias("asks")).collect()
    cuts = spark.sparkContext.broadcast({r["grp"]: (max(1, -(-r["members"] // BLOCK_ROWS)), max(1, -(-r["asks"] // BLOCK_ROWS))) for r in load})  # two numbers a group

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, blocks = model.value, cuts.value
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.frombuffer(b"".join(pdf["vec"]), "<f4").reshape(-1, dim)
            near = _nearest(v, q.centres, probes)
            codes = q.encode(v, near[:, 0])
            rows = []
            for i, (rep, vec) in enumerate(zip(pdf["rep"], pdf["vec"], strict=True)):
                by: dict[int, list[int]] = {}
                for at, g in zip(near[i].tolist(), q.groups[near[i]].tolist(), strict=True):
                    by.setdefault(g, []).append(at)
                own = int(q.groups[near[i, 0]])
                spread = zlib.crc32(rep.encode())
                for g, probed in by.items():
                    mb, qb = blocks[g]
                    code = codes[i].tobytes() if g == own else None
                    if mb == qb == 1:
                        rows.append((g, 0, 0, rep, vec, code, int(near[i, 0]) if code else -1, probed))
                        continue
                    if code:
                        rows += [(g, spread % mb, b, rep, vec, code, int(near[i, 0]), []) for b in range(qb)]
                    rows += [(g, m, spread % qb, rep, vec, None, -1, probed) for m in range(mb)]
            yield pd.DataFrame(rows, columns=["grp", "m", "q", "rep", "vec", "code", "list", "probed"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        q = model.value
        pdf = pdf.sort_values("rep", kind="stable")
        vec = np.frombuffer(b"".join(pdf["vec"]), "<f4").reshape(-1, dim)
        keys, mine = pdf["rep"].to_numpy(), pdf["list"].to_numpy(int)
        size = np.array([len(x) for x in pdf["probed"]])
        asker = np.repeat(np.arange(len(pdf)), size)
        asked = np.concatenate([np.asarray(x, int) for x in pdf["probed"]]) if size.sum() else np.zeros(0, int)
        found = []
        for at in np.unique(asked):
            m, a = np.flatnonzero(mine == at), asker[asked == at]
            if not len(m):
                continue
            codes = np.frombuffer(b"".join(pdf["code"].iloc[m]), "u1").reshape(len(m), -1)
            r = min(max(rerank, k + 1), len(m))
            for i in range(0, len(a), 1024):
                part = a[i : i + 1024]
                approx = q.scores(vec[part], at, codes)
                top = np.argpartition(-approx, r - 1, axis=1)[:, :r] if r < len(m) else np.tile(np.arange(len(m)), (len(part), 1))
                top.sort(axis=1)
                exact = np.einsum("qd,qrd->qr", vec[part].astype("f8"), vec[m][top].astype("f8"))
                exact[keys[m][top] == keys[part][:, None]] = -np.inf
                best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                sim = np.take_along_axis(exact, best, 1)
                row, col = np.nonzero(np.isfinite(sim) & (sim >= least))
                found.append(pd.DataFrame({"rep": keys[part[row]], "other": keys[m[np.take_along_axis(top, best, 1)[row, col]]], "similarity": sim[row, col]}))
        if not found:
            return pd.DataFrame({"rep": [], "other": [], "similarity": []})
        # of all lists of the group the k best of each query
        both = pd.concat(found, ignore_index=True).sort_values(["rep", "similarity", "other"], ascending=[True, False, True], kind="stable")
        return both[both.groupby("rep").cumcount() < k]

    dealt = reps.mapInPandas(deal, "grp int, m int, q int, rep string, vec binary, code binary, list int, probed array<int>")
    pairs = dealt.groupBy("grp", "m", "q").applyInPandas(compare, "rep string, other string, similarity double")
    best = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("similarity"), "other"))
    near = pairs.withColumn("at", best).filter(F.col("at") <= k).select("rep", "other", "similarity")
    return _expand(keyed, shared, near, k)


def _expand(keyed: DataFrame, shared: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Neighbours of representatives as neighbours of all keys; ``shared`` has the classes of several keys."""
    of_class = keyed.select("sig", "key").join(shared.select("sig", "rep"), "sig").select("rep", "key")
    # the first k + 1 of each such class, for no list of neighbours reaches beyond them
    spread = of_class.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(32)))
    some = F.row_number().over(Window.partitionBy("rep", "salt").orderBy("key"))
    firsts = (
        spread.withColumn("at", some)
        .filter(F.col("at") <= k + 1)
        .groupBy("rep")
        .agg(F.slice(F.sort_array(F.collect_list("key")), 1, k + 1).alias("keys"))
    )
    others = (
        near.join(firsts.withColumnRenamed("rep", "other"), "other", "left")
        .select("rep", "similarity", F.explode(F.coalesce("keys", F.array("other"))).alias("neighbour"))
        .groupBy("rep")
        .agg(F.collect_list(F.struct((-F.col("similarity")).alias("order"), "neighbour")).alias("others"))
    )
    own = F.transform(F.coalesce("keys", F.array().cast("array<string>")), lambda x: F.struct(F.lit(-1.0).alias("order"), x.alias("neighbour")))
    lists = (
        others.join(firsts, "rep", "full")
        .select("rep", F.slice(F.sort_array(F.concat(own, F.coalesce("others", F.array().cast("array<struct<order:double,neighbour:string>>")))), 1, 2 * k + 2).alias("list"))
    )
    # a class of one is its representative: it has a list of its own or no neighbours
    single = lists.join(shared.select("rep"), "rep", "left_anti").select("rep", F.col("rep").alias("key"), "list")
    each = single.unionByName(of_class.join(lists, "rep"))
    kept = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("key")), 1, k)
    return (
        each.select("key", F.posexplode(kept).alias("pos", "x"))
        .select("key", F.col("x.neighbour").alias("neighbour"), (-F.col("x.order")).alias("similarity"), (F.col("pos") + 1).alias("rank"))
    )


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_vectors(latest_vectors(table(spark, sf_dir, "embedding_cache")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key_a, key_b): pairs of cosine 0.90 or more where one is among the five nearest of the other."""
    near = similar_vectors(_cached(spark, sf_dir), k=5, least=0.90, probes=8, rerank=32)
    return near.filter(F.col("similarity") >= 0.90).select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


def p3_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cache_key, neighbour, similarity, rank): the five most similar keys of every key."""
    near = similar_vectors(_cached(spark, sf_dir), k=5)
    return near.select(F.col("key").alias("cache_key"), "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


QUERIES = {"p3_found": p3_found, "p3_similar": p3_similar}
SQL: dict[str, str] = {}
