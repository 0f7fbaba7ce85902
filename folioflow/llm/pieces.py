"""Splitting oversized items at natural boundaries, by packing a tree of their structure.

The text of an item is parsed into a tree: sections nested by the level of their headings
(markup, number signs, section numbers, underlines, bare heading lines), then pages, blocks
(paragraphs, tables, lists, elements of markup), list items nested by indentation and table
rows, lines, sentences, words. Sibling subtrees are merged while they stay within the limit, and
only a node that is itself oversized is descended into, so that no piece holds the end of one
section and the beginning of another unless it holds both whole. Every piece after the first
begins ``overlap`` characters before its own content, in the piece before it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.runtime import table

LIMIT = 2000
OVERLAP = 64

# Ranks of boundaries, the strongest first: what a boundary of a rank parts are siblings.
# Headings have their level 1..6, a bare heading line the level 7.
BARE, PAGE, BLOCK, ITEM, ROW, LINE, SENTENCE, WORD = 7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 13.0, 14.0

_LINE = re.compile(r"[^\n\f]*(?:[\n\f]|$)")
_SIGNS = re.compile(r"\s{0,3}(#{1,6})\s+\S")
_NUMBERED = re.compile(r"\s{0,3}(\d{1,2}(?:\.\d{1,2}){0,5})\.?\s+[^\W\d_][^\n\f]{0,70}$")
_TITLE = re.compile(r"[^\W\d_][^\n\f]{0,70}$")
_ENDED = re.compile(r"[.!?,;:…。！？।]\s*$")
_UNDERLINE = re.compile(r"\s{0,3}(=+|-{3,})\s*$")
_LIST = re.compile(r"(\s*)(?:[-*+•‣·–]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S")
_TABLE = re.compile(r"\s*\|.*\||[^\t\n]*\t[^\t\n]*\t")
_TAG = re.compile(r"<(/?)(h[1-6]|section|article|div|blockquote|pre|table|thead|tbody|tr|ul|ol|li|dl|dt|dd|p)\b[^<>]*>", re.I)
_SENTENCE = re.compile(r"(?:(?<=[.!?…।])|(?<=[.!?…।][\"'”»)\]]))\s+(?=[\"'“«(¿¡\[]?[^\W_a-zß-öø-ÿ])|(?<=[。！？])(?![」』”’）])")
_WORD = re.compile(r"\s+")


@dataclass
class Node:
    """A span of text whose children, if it has any, cover it without gaps."""

    start: int
    end: int
    rank: float  # of the boundary it begins at
    children: list[Node] = field(default_factory=list)


def _boundaries(text: str) -> dict[int, float]:
    """Where structure begins, and with what rank."""
    out: dict[int, float] = {}

    def mark(at: int, rank: float) -> None:
        if 0 < at < len(text):
            out[at] = min(rank, out.get(at, rank))

    lines = [m.span() for m in _LINE.finditer(text) if m.end() > m.start()]
    before = ""  # the last line that is not blank
    blank, listed, tabled = True, False, False
    for k, (a, b) in enumerate(lines):
        line = text[a:b].rstrip("\n\f")
        fresh = a == 0 or text[a - 1] == "\f"
        mark(a, PAGE if fresh else LINE)
        if not line.strip():
            blank, listed, tabled = True, False, False
            continue
        alone = blank or fresh or bool(_ENDED.search(before))
        signs, numbered = _SIGNS.match(line), _NUMBERED.match(line)
        under = _UNDERLINE.match(text, *lines[k + 1]) if k + 1 < len(lines) else None
        item, row = _LIST.match(line), bool(_TABLE.match(line))
        if signs:
            mark(a, float(len(signs[1])))
        elif under and blank and not item:
            mark(a, 1.0 if under[1][0] == "=" else 2.0)
        elif numbered and alone and not _ENDED.search(line) and ("." in numbered[1] or not item):
            mark(a, 1.0 + numbered[1].count("."))
        elif item:
            # deeper items are parts of the one above; a list is a block of its own
            mark(a, ITEM + min(len(item[1].expandtabs(4)), 40) / 50 if listed or not blank else BLOCK)
        elif row:
            mark(a, ROW if tabled else BLOCK)
        elif alone and _TITLE.match(line) and not _ENDED.search(line) and k + 1 < len(lines):
            mark(a, BARE)
        elif blank or listed != bool(item) and not line[0].isspace() or tabled:
            mark(a, BLOCK)
        before, blank, listed, tabled = line, False, bool(item) or listed and line[0].isspace(), row
    depth = 0
    for tag in _TAG.finditer(text):
        closing, name = bool(tag[1]), tag[2].lower()
        if name[0] == "h" and name[1:].isdigit():
            if not closing:
                mark(tag.start(), float(name[1]))
            continue
        depth = max(0, depth - closing)
        rank = BLOCK + min(depth, 90) / 100
        mark(tag.end() if closing else tag.start(), rank)
        depth += not closing
    return out


def parse(text: str) -> Node:
    """The tree of a text down to lines: at each node the strongest boundaries inside it part its children."""

    def grow(start: int, end: int, rank: float, inside: list[tuple[int, float]]) -> Node:
        node = Node(start, end, rank)
        if inside:
            strongest = min(r for _, r in inside)
            at = [i for i, (_, r) in enumerate(inside) if r == strongest]
            # what stands before the first of them is a part too: a heading with its first lines
            node.children.append(grow(start, inside[at[0]][0], strongest, inside[: at[0]]))
            for i, j in zip(at, [*at[1:], len(inside)], strict=True):
                node.children.append(grow(inside[i][0], inside[j][0] if j < len(inside) else end, strongest, inside[i + 1 : j]))
        return node

    return grow(0, len(text), 0.0, sorted(_boundaries(text).items()))


def _parts(text: str, node: Node) -> list[Node]:
    """Children of an oversized node; of a leaf its sentences, else its words, else nothing."""
    if node.children:
        return node.children
    for pattern, rank in ((_SENTENCE, SENTENCE), (_WORD, WORD)):
        if node.rank < rank:
            cuts = [m.end() for m in pattern.finditer(text, node.start, node.end) if node.start < m.end() < node.end]
            if cuts:
                edges = [node.start, *cuts, node.end]
                return [Node(a, b, rank) for a, b in zip(edges, edges[1:], strict=False)]
    return []


def _pack(text: str, node: Node, limit: int) -> list[tuple[int, int]]:
    """Spans within the limit that cover the node, siblings merged, oversized ones descended into."""
    if node.end - node.start <= limit:
        return [(node.start, node.end)]
    out: list[tuple[int, int]] = []
    joined = False  # whether the last span may take in the next sibling
    parts = _parts(text, node)
    for k, child in enumerate(parts):
        if child.end - child.start <= limit:
            if joined and child.end - out[-1][0] <= limit:
                out[-1] = (out[-1][0], child.end)
            else:
                out.append((child.start, child.end))
            joined = True
            continue
        below = _pack(text, child, limit)
        # a heading stays with the beginning of what it heads, and lines, sentences and words flow on
        flows = child.rank >= LINE or (k == 1 and parts[0].end - parts[0].start <= 200)
        if joined and flows and below[0][1] - out[-1][0] <= limit:
            below[0] = (out.pop()[0], below[0][1])
        out += below
        joined = child.rank >= LINE
    return out or [(x, min(x + limit, node.end)) for x in range(node.start, node.end, limit)]


def split_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, each within the limit; one piece if the text is."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    content = _pack(text, parse(text), limit - overlap)
    while len(content) > 1 and content[0][1] <= overlap:  # would lie in the overlap of the second
        content = [(0, content[1][1]), *content[2:]]
    return [(max(0, a - overlap), b) for a, b in content]


def place(text: str, spans: list[tuple[int, int]], pages: list[int] | None, first_start: int | None) -> list[tuple[list[int] | None, int | None]]:
    """(page_numbers, start_char_in_page) of every piece, from the form feeds between pages."""
    breaks = [m.start() for m in re.finditer("\f", text)]
    out: list[tuple[list[int] | None, int | None]] = []
    for a, b in spans:
        begin = bisect_left(breaks, a)
        last = max(begin, bisect_left(breaks, b - 1))
        if pages is None or not len(pages):
            numbers = None
        else:
            at = [min(i, len(pages) - 1) for i in range(begin, last + 1)]
            numbers = sorted({int(pages[i]) for i in at})
        start = a - breaks[begin - 1] - 1 if begin else None if first_start is None else first_start + a
        out.append((numbers, start))
    return out


def split_oversized(
    chunks: DataFrame,
    *,
    key: str = "chunk_id",
    text: str = "text",
    pages: str = "page_numbers",
    start: str = "start_char_in_page",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(key, piece_no, text, page_numbers, start_char_in_page, start_in_item) of items over the limit.

    Pieces are exact substrings, numbered from 0, of at most ``limit`` characters; joined
    without their overlaps (``overlap`` characters of each but the first) they give the text back. Only items over the limit come out, judged
    by the text itself. Repeated rows of a key count once, of different rows the one with the least
    text, pages and start; rows with a null key count once a text. Null texts give none; null pages or starts stay null. An unbroken text is cut at the
    limit. Other columns are ignored.
    """
    kind = chunks.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("key", kind),
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("piece", T.StringType()),
            T.StructField("page_numbers", T.ArrayType(T.IntegerType())),
            T.StructField("start_char_in_page", T.IntegerType()),
            T.StructField("start_in_item", T.IntegerType()),
        ]
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t, p, s in zip(pdf["key"], pdf["text"], pdf["pages"], pdf["start"], strict=True):
                spans = split_spans(t, limit, overlap)
                places = place(t, spans, p, None if pd.isna(s) else int(s))
                rows += [(k, i, t[a:b], n, at, a) for i, ((a, b), (n, at)) in enumerate(zip(spans, places, strict=True))]
            frame = pd.DataFrame(rows, columns=schema.names)
            frame["start_char_in_page"] = frame["start_char_in_page"].astype("Int32")
            yield frame

    wide = (
        chunks.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(pages).alias("pages"), F.col(start).alias("start"))
        .filter(F.length("text") > limit)
        .withColumn("apart", F.when(F.col("key").isNull(), F.md5("text")))
        .groupBy("key", "apart")
        .agg(F.min(F.struct("text", "pages", "start")).alias("row"))
        .select("key", "row.*")
    )
    return wide.mapInPandas(cut, schema).select(
        F.col("key").alias(key), "piece_no", F.col("piece").alias(text), F.col("page_numbers").alias(pages), F.col("start_char_in_page").alias(start), "start_in_item"
    )


def joined_again(pieces: DataFrame, *, key: str = "chunk_id", text: str = "text", overlap: int = OVERLAP) -> DataFrame:
    """(key, pieces, longest, text): the pieces of each item put together without their overlaps."""
    own = F.when(F.col("piece_no") == 0, F.col(text)).otherwise(F.expr(f"substring({text}, {overlap + 1})"))
    each = F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own"))))  # the pieces of one item
    return pieces.groupBy(key).agg(F.count("*").alias("pieces"), F.max(F.length(text)).alias("longest"), F.array_join(F.transform(each, lambda x: x["own"]), "").alias(text))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id): chunks that came out in more than one piece."""
    return split_oversized(table(spark, sf_dir, "chunks")).filter(F.col("piece_no") == 1).select("chunk_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return split_oversized(table(spark, sf_dir, "chunks"))


def p5_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, within, several, characters, md5) of the oversized chunks, put together from their pieces."""
    whole = joined_again(p5_pieces(spark, sf_dir))
    return whole.select("chunk_id", (F.col("longest") <= LIMIT).alias("within"), (F.col("pieces") > 1).alias("several"), F.length("text").cast("bigint").alias("characters"), F.md5("text").alias("md5"))


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_round_trip": p5_round_trip}
SQL = {
    "p5_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 2000",
    "p5_round_trip": """SELECT chunk_id, true AS within, true AS several, length(text) AS characters, md5(text) AS md5
FROM (SELECT chunk_id, min(text) AS text FROM chunks WHERE length(text) > 2000 GROUP BY chunk_id)""",
}
