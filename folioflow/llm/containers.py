"""Filling containers of fixed token capacity with whole documents.

Sizes are token counts under a public tokenizer. What is packed is not the documents but
their histogram of sizes, at most ``capacity`` counts whatever the number of documents:
first the dominance reduction of Martello and Toth (1990) fixes sets that are part of some
best solution, many equal sets at once; best fit decreasing packs the rest, again by counts.
The outcome is a short table of patterns (sizes in a container, how many containers), and the
documents take their places in it by their rank among those of their size, in one join.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.runtime import spread, table, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary splits text before merging (published with it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(key, tokens): the size of every text, 0 where it is null or empty."""
    kind = documents.schema[key].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path, pattern).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "tokens": [len(encode(t)) if t else 0 for t in pdf["text"]]})

    return spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInPandas(count, f"key {kind}, tokens bigint")


@dataclass
class Packing:
    """Patterns of sizes with the number of containers that hold each."""

    capacity: int
    patterns: list[tuple[dict[int, int], int]] = field(default_factory=list)
    fixed: int = 0

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.patterns)


def reduce_by_dominance(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fix sets that dominate every other feasible set with one of their items; takes them out of ``left``.

    A set dominates another with the same item j if each other item of the latter, or a group of
    them, can be exchanged for one item at least as large. With i the largest item that fits
    beside j: {j} dominates if nothing fits; {j, i} if i fills the container, if no two others
    fit beside j, or if no three do and i is at least as large as any two that fit together;
    {j, i, b}, with b the largest item that fits beside both, if no three others fit and b is at
    least as large as the smaller item of any two that fit. Each condition stays true while
    items are taken away, so equal sets are fixed together.
    """
    fixed: list[tuple[dict[int, int], int]] = []
    for j in sorted(left, reverse=True):
        while left.get(j):
            others = _dominating(left, j, capacity)
            if others is None:
                break
            pattern: dict[int, int] = {}
            for s in (j, *others):
                pattern[s] = pattern.get(s, 0) + 1
            n = min(left[s] // each for s, each in pattern.items())
            fixed.append((pattern, n))
            for s, each in pattern.items():
                left[s] -= n * each
                if not left[s]:
                    del left[s]
    return fixed


def _dominating(left: dict[int, int], j: int, capacity: int) -> tuple[int, ...] | None:
    """What goes with item j in a set that dominates all others with j, or None."""
    room = capacity - j
    free = lambda s: left[s] - (s == j)
    fits = sorted((s for s in left if s <= room and free(s)), reverse=True)
    if not fits:
        return ()
    i = fits[0]
    # up to three copies of the smallest items: whether two or three others fit beside j
    least = [s for s in reversed(fits[-3:]) for _ in range(min(3, free(s)))][:3]
    if i == room or len(least) < 2 or least[0] + least[1] > room:
        return (i,)
    if len(least) == 3 and sum(least) <= room:
        return None
    if i >= _best_pair(fits, free, room):
        return (i,)
    beside = next((s for s in fits if s <= room - i and free(s) > (s == i)), None)
    # the larger item of a pair is best the next one: the smaller item is then as large as can be
    smaller = next((s for k, s in enumerate(fits) if s + (s if free(s) > 1 else fits[k - 1] if k else room + 1) <= room), 0)
    return (i, beside) if beside is not None and beside >= smaller else None


def _best_pair(sizes: list[int], free, room: int) -> int:  # noqa: ANN001
    """Largest sum of two items that fits in ``room``, 0 if none; sizes descending."""
    a, b, best = 0, len(sizes) - 1, 0
    while a <= b:
        if a == b and free(sizes[a]) < 2:
            break
        total = sizes[a] + sizes[b]
        if total <= room:
            best = max(best, total)
            if sizes[b] == sizes[a]:
                break
            b -= 1
        else:
            a += 1
    # an item and its copy
    return max([best, *(2 * s for s in sizes if 2 * s <= room and free(s) > 1)])


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing by counts: containers with equal contents are handled as one."""
    open_by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    done: list[tuple[dict[int, int], int]] = []

    def put(pattern: dict[int, int], n: int, room: int) -> None:
        (open_by_room.setdefault(room, []) if room else done).append((pattern, n))

    for size in sorted(left, reverse=True):
        m = left[size]
        while m:
            room = min((r for r in open_by_room if r >= size), default=None)
            if room is None:
                each = capacity // size
                full, rest = divmod(m, each)
                if full:
                    put({size: each}, full, capacity - each * size)
                if rest:
                    put({size: rest}, 1, capacity - rest * size)
                m = 0
                continue
            pattern, n = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
            taken = min(m, n)
            if taken < n:
                put(pattern, n - taken, room)
            put(pattern | {size: pattern.get(size, 0) + 1}, taken, room - size)
            m -= taken
    return done + [x for some in open_by_room.values() for x in some]


def pack(sizes: dict[int, int], capacity: int) -> Packing:
    """Pack ``sizes[s]`` items of each size s in 1..capacity."""
    if any(not 0 < s <= capacity for s in sizes):
        raise ValueError("sizes must lie between 1 and the capacity")
    left = {s: n for s, n in sizes.items() if n > 0}
    fixed = reduce_by_dominance(left, capacity)
    return Packing(capacity, fixed + _best_fit(left, capacity), sum(n for _, n in fixed))


def slots(packing: Packing) -> list[tuple[int, int, int, int, int]]:
    """(size, lowest rank, end of ranks, first container, items a container) of every pattern."""
    taken: dict[int, int] = {}
    first, out = 0, []
    for pattern, n in packing.patterns:
        for size, each in pattern.items():
            low = taken.get(size, 0)
            taken[size] = low + n * each
            out.append((size, low, taken[size], first, each))
        first += n
    return out


def _spread_rank(items: DataFrame, size: Column, salts: int) -> DataFrame:
    """Adds ``rank``, from 0 among the items of a size; a size of very many items is ranked in parts."""
    salted = items.withColumn("size", size).withColumn("salt", F.pmod(F.xxhash64("key", "piece_no"), F.lit(salts)))
    counts = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    line = Window.partitionBy("size").orderBy("salt")
    offsets = counts.select("size", "salt", (F.sum("n").over(line) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("size", "salt").orderBy("key", "piece_no")) - 1
    return salted.withColumn("within", within).join(offsets, ["size", "salt"]).withColumn("rank", F.col("before") + F.col("within"))


def fill_containers(sizes: DataFrame, *, capacity: int = CAPACITY, key: str = "key", tokens: str = "tokens") -> DataFrame:
    """(key, piece_no, first_token, n_tokens, container_id), one row per piece.

    A document within the capacity is one piece; a larger one is cut into pieces of the whole
    capacity and a rest, which is packed like any other item. Documents of no tokens (null or
    empty texts) take no space: they come out in container 0 with 0 tokens. Repeated keys are
    items of their own; a null key is kept. An empty table gives no rows.
    """
    spark = sizes.sparkSession
    kept = sizes.select(F.col(key).alias("key"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("tokens"))
    cut = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)) - 1)
    pieces = kept.select("key", "tokens", F.explode(cut).alias("piece_no")).select(
        "key",
        F.col("piece_no").cast("int").alias("piece_no"),
        (F.col("piece_no") * capacity).alias("first_token"),
        F.least(F.lit(capacity), F.col("tokens") - F.col("piece_no") * capacity).alias("n_tokens"),
    )
    # at most ``capacity`` rows, whatever the number of documents
    histogram = {int(r["n_tokens"]): int(r["n"]) for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    histogram.pop(0, None)
    packing = pack(histogram, capacity)
    places = spark.createDataFrame(
        slots(packing) or [(-1, 0, 0, 0, 1)], "size bigint, low bigint, high bigint, first bigint, each bigint"
    )
    ranked = _spread_rank(pieces.filter(F.col("n_tokens") > 0), F.col("n_tokens"), max(8, total // 500_000))
    placed = ranked.join(
        F.broadcast(places),  # bounded by the capacity: a few patterns a size
        (ranked["size"] == places["size"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    ).select("key", "piece_no", "first_token", "n_tokens", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).alias("container_id"))
    nothing = pieces.filter(F.col("n_tokens") == 0).select("key", "piece_no", "first_token", "n_tokens", F.lit(0).cast("bigint").alias("container_id"))
    return placed.unionByName(nothing).withColumnRenamed("key", key)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece_no, first_token, n_tokens, container_id) of every document."""
    counts = written(token_counts(table(spark, sf_dir, "documents")), "tokens")
    return fill_containers(counts).withColumnRenamed("key", "doc_id")


QUERIES = {"p8_containers": p8_containers}
SQL: dict[str, str] = {}
