"""Splitting documents into overlapping chunks at sentence ends.

The walk over a document is sequential, so it is a Python function over whole documents, as
many documents at a time as an Arrow batch holds; documents are independent of each other.
Only the pages of one document are brought together, in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import sentences

_PARAGRAPH = re.compile(r"\n\s*\n+")
_SENTENCE = re.compile(r"(?<=[.!?])(?:[)\]'\"]*)\s+(?=[A-ZÀ-ɏ\d])")


@dataclass(frozen=True)
class Limits:
    """Sizes in characters: of a chunk, of its overlap, of the least tail, of the largest chunk."""

    size: int = 512
    overlap: int = 64
    least: int = 50
    most: int = 2000


@dataclass
class _Open:
    """The chunk that is being filled."""

    parts: list[str] = field(default_factory=list)
    pages: list[int] = field(default_factory=list)
    heading: str | None = None

    @property
    def text(self) -> str:
        return " ".join(self.parts)

    @property
    def counted(self) -> int:
        return sum(map(len, self.parts))  # joining blanks are not counted

    def add(self, part: str, page: int) -> None:
        self.parts.append(part)
        if page not in self.pages:
            self.pages.append(page)


def hard_split(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut at the last blank of a piece's last fifth if there is one."""
    out = []
    while len(text) > most:
        at = text.rfind(" ", most - most // 5, most)
        at = most if at < 0 else at
        out.append(text[:at])
        text = text[at:].lstrip()
    return [*out, text] if text else out


def cut_at(text: str, size: int) -> tuple[str, str]:
    """What fits in ``size`` up to the last blank, and the rest; an unbroken text is cut at ``size``."""
    at = text.rfind(" ", 0, size)
    return (text[:size], text[size:]) if at <= 0 else (text[:at], text[at + 1 :])


def chunk_pages(pages: list[tuple[int, str | None]], limits: Limits = Limits(), headings: dict[int, str] | None = None) -> list[tuple[str, list[int], str | None]]:
    """(text, page numbers, heading) of the chunks of a document from its pages.

    A chunk is closed before a sentence that would pass ``size`` and begins with the last
    ``overlap`` characters of the one before. A heading belongs to what follows it. A tail
    shorter than ``least`` joins the last chunk. A word of more than ``size - overlap``
    characters is cut, so every text comes to an end.
    """
    done: list[tuple[str, list[int], str | None]] = []
    now = _Open()

    def close(text: str, page: int) -> None:
        done.append((text, sorted(now.pages) or [page], now.heading))
        tail = text[-limits.overlap :].strip() if limits.overlap else ""
        now.parts, now.pages = ([tail], [page]) if tail else ([], [])

    for page, body in sorted(pages, key=lambda x: x[0]):
        if headings and page in headings:
            if now.counted > limits.overlap:
                close(now.text, page)
            now.heading = headings[page]
        for paragraph in _PARAGRAPH.split(body or ""):
            for sentence in _SENTENCE.split(paragraph.strip()):
                for piece in hard_split(sentence.strip(), limits.most):
                    if now.parts and now.counted + len(piece) > limits.size:
                        close(now.text, page)
                    now.add(piece, page)
                    while now.counted >= limits.size:
                        head, rest = cut_at(now.text, limits.size)
                        if len(head) <= limits.overlap:  # nothing but the overlap: cut the word itself
                            head, rest = now.text[: limits.size], now.text[limits.size :]
                        close(head, page)
                        if not rest.strip():
                            break
                        now.add(rest, page)
    rest = now.text
    if rest.strip() and not (done and done[-1][0].endswith(rest)):
        if done and now.counted < limits.least and len(done[-1][0]) + 1 + len(rest) <= limits.most:
            text, numbers, heading = done[-1]
            done[-1] = (f"{text} {rest}", sorted({*numbers, *now.pages}), heading)
        else:
            done.append((rest, sorted(now.pages), now.heading))
    return done


def sentence_chunks(texts: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    """(keys..., part, sentences, piece): every ``n`` sentences of a text joined by blanks, in the JVM; blank texts have none."""
    named = texts.select(*keys, sentences(F.col(text)).alias("all")).filter(F.size("all") > 0)
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / n).cast("int"))).alias("part")
    cut = named.select(*keys, "all", parts).withColumn("some", F.slice("all", F.col("part") * n + 1, n))
    return cut.select(*keys, "part", F.size("some").cast("bigint").alias("sentences"), F.array_join("some", " ").alias("piece"))


def semantic_chunks(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(document_id, chunk_index, chunk_id, text, page_numbers, section_heading, characters, words).

    ``pages`` has document_id, page_number and text, optionally section_heading. Null texts
    count as empty pages; a document of blank pages has no chunks; null document ids are left out.
    """
    has_heading = "section_heading" in pages.columns
    heading = F.col("section_heading") if has_heading else F.lit(None).cast("string")
    page = F.struct(F.col("page_number").cast("int").alias("page"), F.col("text").alias("text"), heading.alias("heading"))
    documents = pages.filter(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))  # the pages of one document

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, ps in zip(pdf["document_id"], pdf["pages"], strict=True):
                named = {p["page"]: p["heading"] for p in ps if p["heading"]}
                for i, (text, numbers, head) in enumerate(chunk_pages([(p["page"] or 0, p["text"]) for p in ps], limits, named)):
                    key = hashlib.sha256(f"{doc}:{i}".encode()).hexdigest()[:16]
                    rows.append((doc, i, key, text, numbers, head, len(text), len(text.split())))
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "chunk_id", "text", "page_numbers", "section_heading", "characters", "words"])

    return documents.mapInPandas(walk, "document_id string, chunk_index int, chunk_id string, text string, page_numbers array<int>, section_heading string, characters int, words int")


def plain_chunks(text: str, limits: Limits = Limits()) -> list[tuple[int, int, str]]:
    """(start, end, text) of the chunks of one text, joining blanks counted; starts found in the text."""
    out: list[tuple[int, int, str]] = []
    now: list[str] = []
    size, start = 0, 0

    def close() -> None:
        nonlocal now, size, start
        chunk = " ".join(now)
        at = text.find(chunk[:50], start)
        at = start if at < 0 else at
        out.append((at, at + len(chunk), chunk))
        start = max(start, at + len(chunk) - limits.overlap)
        tail = chunk[-limits.overlap :].strip()
        now, size = ([tail], len(tail)) if tail else ([], 0)

    for paragraph in _PARAGRAPH.split(text):
        for sentence in _SENTENCE.split(paragraph.strip()):
            for piece in hard_split(sentence.strip(), limits.most):
                if now and size + len(piece) + 1 > limits.size:
                    close()
                now.append(piece)
                size += len(piece) + (len(now) > 1)
    if now and not (out and out[-1][2].endswith(" ".join(now))):
        tail = " ".join(now)
        if out and len(tail) < limits.least:
            a, _, last = out[-1]
            out[-1] = (a, a + len(last) + 1 + len(tail), f"{last} {tail}")
        else:
            close()
    return out


def plain_text_chunks(documents: DataFrame, key: str, text: str, limits: Limits = Limits()) -> DataFrame:
    """(key, chunk_index, start_char, end_char, characters) of every text; null and blank texts have none."""
    kind = documents.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, a, b, len(c)) for k, t in zip(pdf["key"], pdf["text"], strict=True) for i, (a, b, c) in enumerate(plain_chunks(t, limits))]
            yield pd.DataFrame(rows, columns=["key", "chunk_index", "start_char", "end_char", "characters"])

    plain = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.trim("text") != "")
    return plain.mapInPandas(walk, f"key {kind}, chunk_index int, start_char int, end_char int, characters int").withColumnRenamed("key", key)
