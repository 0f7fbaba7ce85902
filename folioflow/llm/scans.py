"""Noise in text from scanned pages: broken words, misread characters, running lines, page numbers.

Lines at the edges of pages are compared within their document: what recurs from page to page
is a running line, a number that counts along with the pages is a page number. Words are judged
against the frequency lexicon of the whole corpus: a symmetric-delete index, joined and never
broadcast, with the form in which confused characters are alike as a further key, gives for each
rare form the frequent words near it; a weighted edit distance, cheap
for pairs of characters that scanners confuse, keeps those that a scanner could have made of the
word, and the word before decides between repairs that are equally near, which also tells on which
of its two lines a broken word was misread. A line that ends in a hyphen is a broken word where
the lexicon knows the joined word better than the compound. Rows found by form alone, with no candidate in the lexicon, are
numbers with letters in place of digits and words with characters that no word has.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.runtime import table, written

# Fixed values: (printed, read) pairs that scanners confuse.
CONFUSED = (
    ("e", "c"), ("n", "ri"), ("i", "¡"), ("i", "!"), ("i", "1"), ("i", "|"), ("i", "l"), ("a", "@"), ("t", "f"), ("s", "5"), ("s", "$"), ("o", "0"),
    ("d", "cl"), ("l", "|"), ("l", "1"), ("l", "!"), ("l", "i"), ("u", "ii"), ("g", "9"), ("h", "b"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("b", "8"), ("b", "6"),
    ("cl", "d"), ("z", "2"), ("q", "9"), ("h", "li"), ("o", "c"), ("c", "e"), ("ri", "n"), ("li", "h"), ("f", "t"),
)
DIGITS = {"l": "1", "I": "1", "|": "1", "!": "1", "o": "0", "O": "0", "s": "5", "S": "5", "b": "6", "z": "2", "Z": "2", "B": "8"}
HYPHENS = "-‐‑¬\xad"
#: Most frequent sound words that are sent to all tasks: its bound.
COMMON_WORDS = 100_000
#: Counters of the table of bigrams, by hash, that is sent to all tasks: its size.
BIGRAM_BUCKETS = 1 << 18
#: Lines at the top and at the bottom of a page that may be running lines or page numbers: what stands deeper inside is body.
EDGE = 3

_COST = {}
for _a, _b in CONFUSED:
    _COST[(_a, _b)] = 0.4
_LINES = re.compile(r"[\n\f]")
_BREAK = re.compile(rf"(\S*[^\W\d_]\S*?)[{HYPHENS}]\s*$")
_JOIN = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}][^\S\n\f]*[\n\f]\s*(?=[^\W\d_]|[@0-9!¡|$][^\W\d_])")
_WORDISH = re.compile(r"[^\W\d_]")
_NUMBER = re.compile(r"[-+<>~]?\d+(?:[.,:/-]\d+)*%?")
_BROKEN_NUMBER = re.compile(r"[-+]?(?=[\dlIOosSbBzZ|!.,/:]*\d)(?=[\d.,/:]*[lIOosSbBzZ|!])[\dlIOosSbBzZ|!]+(?:[.,:/][\dlIOosSbBzZ|!]+)*")
_ODD = re.compile(r"[^\W\d_][@!¡|$][^\W\d_]|^[@¡|$][a-zà-ÿ]{2}|[^\W\d_]{2}[@|$¡]$|[^\W\d_][0-9][^\W\d_]|^[0-9][^\W\d_]{3}|[^\W\d_]{3}[0-9]$")
_FOLD = str.maketrans({"c": "e", "f": "t", "b": "h", "8": "h", "6": "h", "l": "i", "1": "i", "|": "i", "!": "i", "¡": "i", "0": "o", "5": "s", "$": "s", "@": "a", "9": "g"})
_TAIL_NUMBER = re.compile(r"\s{2,}(?:page|pg|p|seite|s|pág|-|–)?\.?\s*\S{1,4}(?:\s*(?:of|/|\|)\s*\S{1,4})?\s*[-–]?$|^(?:page|pg|p)?\.?\s*\S{1,4}\s{2,}", re.I)
_DIGITISH = r"[0-9lIOoSsZzbB|!]{1,4}"
_PAGE = re.compile(rf"(?P<style>page|pg\.?|p\.|seite|s\.|página|pág\.?|[\[(\-–—]+)?\s*(?P<n>{_DIGITISH}|[ivxlcIVXLC]+)\s*[\])\-–—]*\s*(?:(?P<of>of|/|\||von|de|sur)\s*{_DIGITISH})?", re.I)


def core(word: str) -> str:
    """A word without the punctuation around it."""
    word = word.rstrip(".,;:?!\"')]»”“…").lstrip("\"'([«„“”¿")
    if word.startswith("¡") and not word[1:2].islower():
        word = word[1:]
    return word


def _body_words(lines: list[str], skip: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, str, int, str, str]]:
    """(line, core word, 0 or characters of its first part if broken over two lines, the word before, second part)."""
    before, carried = "", None
    for no, line in enumerate(lines):
        if no in skip or not line.strip():
            continue
        words = line.split()
        broken = words[-1][-1] in HYPHENS and _BREAK.search(words[-1])
        last = len(words) - 1 if broken else len(words)
        for i, raw in enumerate(words):
            if i == 0 and carried:
                first, at = carried
                carried = None
                w = core(first + raw)
                yield at, w, len(core(first + "x")) - 1, before, raw
                before = w.lower()
                if i == last:
                    break
                continue
            if i >= last:
                break
            w = core(raw)
            if w:
                yield no, w, 0, before, ""
                before = w.lower()
        if broken and (len(words) > 1 or not carried):
            carried = (words[-1].rstrip(HYPHENS), no)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all words of ``text``, broken words joined; counted per batch before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw: Counter[str] = Counter()
            for text in pdf["text"]:
                raw.update(_JOIN.sub("", text).split())
            seen: Counter[str] = Counter()
            for word, n in raw.items():
                w = core(word).lower()
                if _WORDISH.search(w):
                    seen[w] += n
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return texts.select("text").mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# Both sides of every pair in CONFUSED come out the same, so any number of confusions leaves the key as it is.
_ALIKE = {c: to for chars, to in (("eco0", "e"), ("i¡!1|l", "i"), ("a@", "a"), ("tf", "t"), ("s5$", "s"), ("g9q", "g"), ("z2", "z"), ("hb86u", "ii"), ("n", "ri"), ("m", "rri"), ("d", "ei"), ("w", "vv")) for c in chars}
_ALIKE_TABLE = str.maketrans(_ALIKE)


#: Characters of words that are indexed with deletions too, so that no key is of less than three; all others by their
#: confusion-folded form, which covers every distance that is admitted.
DELETED_FROM, DELETED_UP_TO = 5, 40


def variants(word: str) -> set[str]:
    """The word with nothing, one character, or two neighbouring ones left out, and with confused characters alike."""
    whole = {word, f"={word.translate(_ALIKE_TABLE)}"}
    if not DELETED_FROM <= len(word) <= DELETED_UP_TO:
        return whole
    return {*whole, *(word[:i] + word[i + 1 :] for i in range(len(word))), *(word[:i] + word[i + 2 :] for i in range(len(word) - 1))}


def scan_distance(printed: str, read: str, most: float = 0.9) -> float:
    """Weighted edit distance: 0.4 for a pair that scanners confuse, 1 for any other edit; stops beyond ``most``."""
    a, b = printed, read
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if (a, b) in _COST:
        return _COST[(a, b)]
    n, m = len(a), len(b)
    # every edit moves off the diagonal by one place at most and costs at least 0.4
    band = int(most / 0.4) + 1
    if abs(n - m) > band:
        return 9.0
    d: list[dict[int, float]] = [{} for _ in range(n + 3)]
    d[0][0] = 0.0

    def reach(i: int, j: int, x: float) -> None:
        if x <= most + 1 and x < d[i].get(j, 9.0):
            d[i][j] = x

    for i in range(n + 1):
        for j in range(max(0, i - band), min(m, i + band) + 1):
            x = d[i].get(j, 9.0)
            if x > most:
                continue
            if i < n and j < m:
                reach(i + 1, j + 1, x + (a[i] != b[j]))
            if i < n:
                reach(i + 1, j, x + 1)
            if j < m:
                reach(i, j + 1, x + 1)
            for u, v in ((1, 1), (1, 2), (2, 1)):
                if i + u <= n and j + v <= m and (a[i : i + u], b[j : j + v]) in _COST:
                    reach(i + u, j + v, x + 0.4)
    return d[n].get(m, 9.0)


def corrections(words: DataFrame, total: int, times: float = 8.0) -> DataFrame:
    """(word, repairs): misread forms with the words of least distance they may stand for, the most frequent first.

    A repair is a plain word within 0.9 of the form by ``scan_distance`` and at least ``times``
    as frequent; for a form with characters no word has, at least as frequent. Such a form without
    any repair is listed with none if it is rare. Forms and words meet in a join on what is
    left of both after deletions.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(v, w, n) for w, n in zip(pdf["word"], pdf["n"], strict=True) for v in variants(w) if len(v) > 1]
            yield pd.DataFrame(rows, columns=["variant", "word", "n"])

    plain = F.col("word").rlike(r"^[\p{L}'\-]+$")
    odd = F.col("word").rlike(r"[^\p{L}'\-]")
    shape = "variant string, word string, n bigint"
    rare = words.filter((F.length("word") >= 3) & (odd | (F.col("n") <= max(50, total * 2e-4)))).mapInPandas(explode, shape).select("variant", "word", "n")
    known = words.filter((F.length("word") >= 2) & plain & (F.col("n") >= 2)).mapInPandas(explode, shape).select("variant", F.col("word").alias("repair"), F.col("n").alias("m"))
    rare = rare.withColumn("odd", odd)
    pairs = (
        rare.join(grown(known), "variant")
        .filter((F.col("word") != F.col("repair")) & (F.abs(F.length("word") - F.length("repair")) <= 2) & (F.col("m") >= F.col("n") * F.when(F.col("odd"), 1.0).otherwise(times)))
        .select("word", "repair", "m")
        .distinct()
    )

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cost = np.array([scan_distance(r, w) for w, r in zip(pdf["word"], pdf["repair"], strict=True)])
            yield pdf.assign(cost=cost)[cost <= 0.9]

    close = pairs.mapInPandas(near, "word string, repair string, m bigint, cost double")
    # a likelier reading first: fewer confusions, then the more frequent word; of more confusions than the best has, none
    ordered = F.sort_array(F.collect_list(F.struct(F.col("cost"), (-F.col("m")).alias("m"), "repair")))
    listed = close.groupBy("word").agg(ordered.alias("all")).select(
        "word", F.transform(F.filter("all", lambda x: x["cost"] <= F.col("all")[0]["cost"] + 0.01), lambda x: F.struct(x["repair"].alias("repair"), x["cost"].alias("cost"), (-x["m"]).alias("m"))).alias("repairs")
    )
    strange = words.filter(F.col("word").rlike(r"\p{L}[@!¡|$]\p{L}|\p{L}\p{L}[0-9]\p{L}|\p{L}[0-9]\p{L}\p{L}|^[0-9@]\p{L}{3}|\p{L}{3}[0-9|@$]$") & ~F.col("word").rlike(r"[/.@]\p{L}+\.") & (F.col("n") <= 2 + total * 1e-5))
    alone = strange.select("word").join(grown(listed), "word", "left_anti").withColumn("repairs", F.array().cast("array<struct<repair:string,cost:double,m:bigint>>"))
    return listed.unionByName(alone)


def _bucket(before: str, word: str) -> int:
    return zlib.crc32(f"{before} {word}".encode()) % BIGRAM_BUCKETS


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: never broadcast."""
    return df.hint("merge")


def fold_line(line: str) -> str:
    """A key that a line shares with its damaged copies: page numbers at its ends cut, confused characters alike."""
    low = _TAIL_NUMBER.sub("", line.strip()).lower()
    for a, b in (("rn", "m"), ("vv", "w"), ("ri", "n"), ("cl", "d"), ("ii", "u")):
        low = low.replace(a, b)
    return re.sub(r"[\W_]", "", low.translate(_FOLD))


def _roman(text: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = 0
    for a, b in zip(text, [*text[1:], "i"], strict=True):
        total += -values[a] if values[a] < values[b] else values[a]
    return total if re.fullmatch(r"c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", text) and text else None


def page_number(line: str) -> tuple[int, bool] | None:
    """(number, whether its form says that it numbers a page) of a line that only holds a number."""
    s = line.strip()
    if len(s) > 24:
        return None
    if re.fullmatch(r"(?:\S\s)+\s*\S+(?:\s+\S+)*", s) and re.match(r"(?:[Pp5]\s+[aA@]\s+[gG9]\s+[eEcC])", s):
        s = "page " + re.sub(r"^(?:\S\s+){4}", "", s)
    s = re.sub(r"^p[a@][g9][ec]\b", "page", s, flags=re.I)
    m = _PAGE.fullmatch(s)
    if not m:
        return None
    n = m["n"]
    explicit = bool(m["style"]) or bool(m["of"])
    digits = "".join(DIGITS.get(c, c) for c in n)
    if any(c.isdigit() for c in n) or (explicit and digits.isdigit() and not re.fullmatch(r"[ivxIVX]+", n)):
        return (int(digits), explicit) if digits.isdigit() else None
    value = _roman(n.lower())
    return (value, explicit) if value else None


def scanned_chunks(chunks: DataFrame, metadata: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk_id, document_id, chunk_index, page_numbers, text) of scanned documents, each chunk once: of different rows that of the least text.

    A document is scanned if its metadata say so, or if they say nothing and some of its pages
    carry a recognition check (``confidence_valid`` is null for pages read directly).
    """
    said = metadata.groupBy("document_id").agg(F.max(F.lower(F.trim("source_type"))).alias("said"))
    checked = pages.groupBy("document_id").agg(F.max(F.col("confidence_valid").isNotNull()).alias("checked"))
    scanned = (
        said.join(checked, "document_id", "full")
        .filter((F.col("said") == "scanned") | ((F.col("said").isNull() | ~F.col("said").isin("scanned", "digital")) & F.col("checked")))
        .select("document_id")
    )
    return (
        chunks.select("chunk_id", "document_id", "chunk_index", "page_numbers", "text")
        .filter(F.col("text").isNotNull() & F.col("chunk_id").isNotNull())
        .join(grown(scanned), "document_id", "left_semi")
        .groupBy("chunk_id")
        .agg(F.min(F.struct("text", "document_id", "chunk_index", "page_numbers")).alias("row"))
        .select("chunk_id", "row.document_id", "row.chunk_index", "row.page_numbers", "row.text")
    )


def _edges(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines at the edges of pages, and how often short lines stand inside of them."""

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for cid, doc, idx, numbers, text in zip(pdf["chunk_id"], pdf["document_id"], pdf["chunk_index"], pdf["page_numbers"], pdf["text"], strict=True):
                no = 0
                for k, part in enumerate(text.split("\f")):
                    lines = part.split("\n")
                    full = [(no + i, line) for i, line in enumerate(lines) if line.strip()]
                    no += len(lines)
                    page = -1 if numbers is None or not len(numbers) else int(numbers[min(k, len(numbers) - 1)])
                    inside = [fold_line(x) for _, x in full[EDGE:-EDGE] if len(x) < 60]
                    rows.append(
                        (doc, page, -1 if pd.isna(idx) else int(idx), cid, [{"line_no": i, "line": x} for i, x in full[:EDGE]], [{"line_no": i, "line": x} for i, x in full[-EDGE:][::-1]], inside)
                    )
            yield pd.DataFrame(rows, columns=["document_id", "page", "chunk_index", "chunk_id", "top", "bottom", "inside"])

    pair = "array<struct<line_no:int,line:string>>"
    cut = written(
        scanned.mapInPandas(segments, f"document_id string, page int, chunk_index int, chunk_id string, top {pair}, bottom {pair}, inside array<string>"),
        "segments",
    )
    name = lambda column: F.transform(column, lambda x: F.struct(F.col("chunk_index").alias("chunk_index"), F.col("chunk_id").alias("chunk_id"), x["line_no"].alias("line_no"), x["line"].alias("line")))
    by_page = cut.select("document_id", "page", name("top").alias("top"), name("bottom").alias("bottom")).groupBy("document_id", "page")
    top = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, EDGE)
    bottom = F.slice(F.sort_array(F.flatten(F.collect_list("bottom")), False), 1, EDGE)
    lines = by_page.agg(F.array_union(top, bottom).alias("lines")).select("document_id", "page", F.explode("lines").alias("x"))
    inside = cut.select(F.explode("inside").alias("key")).groupBy("key").agg(F.count("*").alias("inside"))
    return lines.select("document_id", "page", "x.chunk_id", "x.line_no", "x.line"), inside


def page_noise(scanned: DataFrame) -> DataFrame:
    """(chunk_id, line_no, noise_kind) of running lines and page numbers."""
    lines, inside = _edges(scanned)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            number = [page_number(x) for x in pdf["line"]]
            yield pdf.assign(
                key=[fold_line(x) for x in pdf["line"]],
                value=pd.array([n[0] if n else None for n in number], dtype="Int32"),
                explicit=[bool(n and n[1]) for n in number],
            )

    lines = written(lines.mapInPandas(read, "document_id string, page int, chunk_id string, line_no int, line string, key string, value int, explicit boolean"), "edges")
    pages = lines.groupBy("document_id").agg(F.count_distinct("page").alias("pages"))
    at_edge = lines.groupBy("key").agg(F.count("*").alias("edge"))
    recurring = (
        lines.filter(F.col("value").isNull() & (F.length("key") >= 6))
        .groupBy("document_id", "key")
        .agg(F.count_distinct("page").alias("on"))
        .join(grown(pages), "document_id")
        .filter((F.col("on") >= 2) & (F.col("on") >= 0.4 * F.col("pages")))
        .join(grown(at_edge), "key")
        .join(grown(inside), "key", "left")
        .filter(F.coalesce("inside", F.lit(0)) <= 0.5 * F.col("edge"))
        .groupBy("document_id")
        .agg(F.collect_list("key").alias("patterns"))  # each on two fifths of the pages: a dozen at most
    )
    offsets = (
        lines.filter(F.col("value").isNotNull())
        .groupBy("document_id", (F.col("value") - F.col("page")).alias("offset"))
        .agg(F.count("*").alias("n"), F.max("explicit").alias("said"))
        .groupBy("document_id")
        .agg(F.max_by(F.struct("offset", "n"), F.struct(F.col("n"), F.col("said"), -F.abs("offset"))).alias("best"))
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = []
            for key, value, explicit, page, patterns, best in zip(pdf["key"], pdf["value"], pdf["explicit"], pdf["page"], pdf["patterns"], pdf["best"], strict=True):
                kind = None
                if not pd.isna(value):
                    off = int(value) - page
                    if best is not None and ((off == best["offset"] and best["n"] >= 2) or explicit or off == 0):
                        kind = "page_number"
                elif patterns is not None and len(key) >= 5:
                    for p in patterns:
                        short = p.startswith(key) and len(key) >= 10
                        if key == p or short or (abs(len(key) - len(p)) <= 0.2 * len(p) and SequenceMatcher(None, key, p, False).ratio() >= 0.85):
                            kind = "running_line"
                            break
                kinds.append(kind)
            out = pd.DataFrame({"chunk_id": pdf["chunk_id"], "line_no": pdf["line_no"], "noise_kind": kinds})
            yield out[out["noise_kind"].notna()]

    return (
        lines.join(grown(recurring), "document_id", "left")
        .join(grown(offsets), "document_id", "left")
        .select("chunk_id", "line_no", "key", "value", "explicit", "page", "patterns", "best")
        .mapInPandas(judge, "chunk_id string, line_no int, noise_kind string")
    )


def _marks(scanned: DataFrame, noise: DataFrame, common: set[str], contested: set[str]) -> DataFrame:
    """What the lines of the body show: first words, words to look up, broken words, and what stands before contested words.

    ``contested`` are common words that compete with others as repairs. Of them the bigrams are
    counted, per batch: rows of the mark "pair" with a bucket and its count.
    """
    good = scanned.sparkSession.sparkContext.broadcast((common, contested))  # at most COMMON_WORDS words each
    skip = noise.groupBy("chunk_id").agg(F.collect_list("line_no").alias("skip"))
    columns = ["document_id", "chunk_index", "chunk_id", "line_no", "mark", "word", "raw", "part", "before", "second"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rivals = good.value
        # what a written form is worth: False, its core if it has to be looked up, True if it is contested
        worth: dict[str, str | bool] = {}

        def judge(raw: str) -> str | bool:
            w = core(raw)
            odd = len(w) > 1 and not _NUMBER.fullmatch(w) and w.lower() not in known
            if len(worth) > 500_000:  # memory stays bounded
                worth.clear()
            worth[raw] = w if odd else w.lower() in rivals
            return worth[raw]

        for pdf in batches:
            rows = []
            pairs: Counter[int] = Counter()
            for cid, doc, idx, text, skipped in zip(pdf["chunk_id"], pdf["document_id"], pdf["chunk_index"], pdf["text"], pdf["skip"], strict=True):
                lines = _LINES.split(text)
                skip_set = set() if skipped is None else {int(x) for x in skipped}
                at = -1 if pd.isna(idx) else int(idx)
                body = [(i, x.split()) for i, x in enumerate(lines) if i not in skip_set and x.strip()]
                if not body:
                    continue
                rows.append((doc, at, cid, body[0][0], "head", None, body[0][1][0], 0, None, None))
                first_half: tuple[str, int, str] | None = None
                for k, (no, words) in enumerate(body):
                    start, stop = 0, len(words)
                    if first_half:
                        half, on, before = first_half
                        first_half = None
                        start = 1
                        w = core(half + words[0])
                        part = len(core(half + "x")) - 1
                        rows.append((doc, at, cid, on, "broken", w.lower(), w[: max(part, 0)], part, before, words[0]))
                    # most lines end otherwise, which their last character tells
                    broken = _BREAK.search(words[-1]) if words[-1][-1] in HYPHENS else None
                    if broken and stop > start:
                        stop -= 1
                        if k == len(body) - 1:
                            rows.append((doc, at, cid, no, "tail", None, broken[1], 0, None, None))
                        else:
                            first_half = (words[-1].rstrip(HYPHENS), no, core(words[-2]).lower() if stop else "")
                    for i in range(start, stop):
                        w = worth.get(words[i])
                        if w is None:
                            w = judge(words[i])
                        if w:
                            before = core(words[i - 1]).lower() if i else core(body[k - 1][1][-1]).lower() if k else ""
                            if w is True:
                                pairs[_bucket(before, core(words[i]).lower())] += 1
                                continue
                            rows.append((doc, at, cid, no, "word" if k or i else "first", w.lower(), w, 0, before, None))
            rows += [(None, bucket, None, n, "pair", None, None, 0, None, None) for bucket, n in pairs.items()]
            yield pd.DataFrame(rows, columns=columns)

    schema = "document_id string, chunk_index int, chunk_id string, line_no int, mark string, word string, raw string, part int, before string, second string"
    return scanned.join(grown(skip), "chunk_id", "left").mapInPandas(look, schema)


def line_noise(chunks: DataFrame, metadata: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """The tables ``noise`` (chunk_id, noise_kind, line_no) and ``repairs`` (chunk_id, line_no, word, repair, part).

    Also returns the ``scanned`` chunks they are about. Chunks without text or id are left out,
    repeated chunks count once, a document of one page has no running lines, empty tables give
    none. Lines are counted from 0 within a chunk, form feeds part lines as line feeds do.
    """
    scanned = written(scanned_chunks(chunks, metadata, pages), "scanned")
    edges = written(page_noise(scanned), "edge-noise")
    words = written(word_counts(scanned), "words")
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 0
    fixes = written(corrections(words, total), "corrections")
    # what looks like a misread number is a name (B12) only if it is frequent
    named = ~F.upper("word").rlike(f"^(?:{_BROKEN_NUMBER.pattern})$") | (F.col("n") >= max(20, 1e-4 * total))
    sound = words.join(grown(fixes), "word", "left_anti").filter((F.col("n") >= 2) & named).orderBy(F.desc("n"), "word").limit(COMMON_WORDS)
    common = {r["word"] for r in sound.select("word").toLocalIterator()}
    rivals = fixes.filter(F.size("repairs") > 1).select(F.explode("repairs").alias("r")).select(F.col("r.repair").alias("word")).distinct()
    contested = {r["word"] for r in rivals.join(sound.select("word"), "word", "left_semi").toLocalIterator()}  # COMMON_WORDS at most
    marks = written(_marks(scanned, edges, common, contested), "marks")
    # the second half of a word broken at a chunk's end is the first word of the next chunk with a body
    heads = marks.filter(F.col("mark") == "head").select("document_id", "chunk_index", F.col("raw").alias("second"))
    ahead = (
        heads.select("document_id", "second", "chunk_index", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("away"))
        .select("document_id", (F.col("chunk_index") - F.col("away")).alias("chunk_index"), "second", "away")
        .groupBy("document_id", "chunk_index")
        .agg(F.min_by("second", "away").alias("second"))
    )
    tails = marks.filter(F.col("mark") == "tail").drop("second").join(grown(ahead), ["document_id", "chunk_index"], "left").select("chunk_id", "line_no", F.col("raw").alias("first"), "second")
    inner = marks.filter(F.col("mark") == "broken").select("chunk_id", "line_no", F.col("raw").alias("first"), "second")
    hyphens = _broken(inner.unionByName(tails), words, fixes)
    # the first word of a chunk whose predecessor ends in a broken word is no word of its own
    body = heads.select("document_id", "chunk_index")
    behind = (
        body.select("document_id", F.col("chunk_index").alias("previous"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("away"))
        .groupBy("document_id", (F.col("previous") + F.col("away")).alias("chunk_index"))
        .agg(F.max("previous").alias("previous"))
    )
    ends = marks.filter(F.col("mark") == "tail").select("document_id", F.col("chunk_index").alias("previous"))
    rest = behind.join(grown(ends), ["document_id", "previous"], "left_semi").select("document_id", "chunk_index")
    whole = marks.filter(F.col("mark") != "first").unionByName(marks.filter(F.col("mark") == "first").join(grown(rest), ["document_id", "chunk_index"], "left_anti").withColumn("mark", F.lit("word")).select(*marks.columns))
    counted = marks.filter(F.col("mark") == "pair").groupBy("chunk_index").agg(F.sum("line_no").alias("n")).toPandas()  # BIGRAM_BUCKETS rows at most
    bigrams = np.zeros(BIGRAM_BUCKETS, "f4")
    bigrams[counted["chunk_index"].to_numpy(int)] = counted["n"].to_numpy()
    misread = written(_misread(whole, fixes, bigrams), "misread")
    found = (
        edges.select("chunk_id", "noise_kind", "line_no")
        .unionByName(hyphens.select("chunk_id", F.lit("hyphen").alias("noise_kind"), "line_no"))
        .unionByName(misread.select("chunk_id", F.lit("misread").alias("noise_kind"), "line_no"))
        .distinct()
    )
    return {"noise": found, "marks": marks, "misread": misread, "scanned": scanned, "hyphens": hyphens, "edges": edges}


def _broken(halves: DataFrame, words: DataFrame, fixes: DataFrame) -> DataFrame:
    """(chunk_id, line_no) of lines whose last word is broken and not a compound at its own hyphen."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"^[\"'(\[«„“”¿¡]+|[.,;:?!\"')\]»”“…]+$", ""))
    h = halves.filter(F.col("second").isNotNull()).withColumn("a", plain(F.col("first"))).withColumn("b", plain(F.col("second"))).filter((F.col("a") != "") & F.col("b").rlike(r"^\p{L}|^[0-9@!¡|$]\p{L}"))
    wanted = h.select(
        "chunk_id", "line_no", "b",
        F.explode(F.map_from_arrays(F.array(*map(F.lit, ("joined", "compound", "a", "b"))), F.array(F.concat("a", "b"), F.concat_ws("-", "a", "b"), F.col("a"), F.col("b")))).alias("what", "word"),
    )
    best = fixes.select("word", F.try_element_at("repairs", F.lit(1))["m"].alias("m"))
    looked = wanted.join(grown(words), "word", "left").join(grown(best), "word", "left").select("chunk_id", "line_no", "b", "what", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("n"))
    side = looked.groupBy("chunk_id", "line_no").pivot("what", ["joined", "compound", "a", "b"]).agg(F.max("n"))
    # breaking itself counts joined forms, some of every compound: a word is known if it is the likelier of both,
    # or if the halves are not both words
    is_broken = (F.col("joined") > F.col("compound")) & ~((F.col("joined") < 0.02 * F.least("a", "b")) & (F.col("joined") <= 3) & (F.col("compound") > 0))
    return side.filter(is_broken | ((F.col("compound") == 0) & (F.least("a", "b") <= 2))).select("chunk_id", "line_no")


def _misread(marks: DataFrame, fixes: DataFrame, bigrams: np.ndarray) -> DataFrame:
    """(chunk_id, line_no, raw, part, repair): words and numbers with misread characters and what they stand for."""
    single = marks.filter(F.col("mark") == "word").join(grown(fixes), "word").select("chunk_id", "line_no", "raw", "before", "repairs", F.lit(0).alias("part"))
    numbers = marks.filter((F.col("mark") == "word") & F.col("raw").rlike(f"^(?:{_BROKEN_NUMBER.pattern})$") & ~F.col("raw").rlike("^(?:L[0-9]|B[0-9])"))
    numbers = numbers.join(grown(fixes.select("word")), "word", "left_anti").select("chunk_id", "line_no", "raw", "before", F.array().cast(fixes.schema["repairs"].dataType).alias("repairs"), F.lit(0).alias("part"))
    whole = marks.filter(F.col("mark") == "broken").join(grown(fixes), "word").select("chunk_id", "line_no", F.col("word").alias("raw"), "before", "repairs", "part")
    picked = choose_repairs(single.unionByName(numbers).unionByName(whole), bigrams)
    # of a broken word the half that differs from the repair tells the line; without any repair the half with odd characters
    repair = F.when(F.col("raw") != F.col("repair"), F.col("repair")).otherwise(F.regexp_replace("raw", r"[@!¡|$0-9]", " "))
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("raw"))),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substring("raw", i, 1) == F.substring(repair, i, 1)), i).otherwise(acc),
    )
    return picked.withColumn("line_no", F.when((F.col("part") == 0) | (same < F.col("part")), F.col("line_no")).otherwise(F.col("line_no") + 1))


def choose_repairs(misread: DataFrame, bigrams: np.ndarray) -> DataFrame:
    """(chunk_id, line_no, raw, part, repair): of equally near repairs the one that follows the word before most often."""
    counts = misread.sparkSession.sparkContext.broadcast(bigrams)  # BIGRAM_BUCKETS numbers

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw, before, repairs in zip(pdf["raw"], pdf["before"], pdf["repairs"], strict=True):
                if repairs is None or not len(repairs):
                    out.append("".join(DIGITS.get(c, c) for c in raw) if _BROKEN_NUMBER.fullmatch(raw) else raw)
                    continue
                near = [r["repair"] for r in repairs if r["cost"] <= repairs[0]["cost"] + 0.01]
                best = max(near, key=lambda w: counts.value[_bucket(before or "", w)]) if len(near) > 1 else near[0]
                out.append(best.upper() if raw.isupper() and len(raw) > 1 else best.capitalize() if raw[:1].isupper() else best)
            yield pdf[["chunk_id", "line_no", "raw", "part"]].assign(repair=out)

    return misread.mapInPandas(pick, "chunk_id string, line_no int, raw string, part int, repair string")


def paragraphs_of(text: str, drop: set[int], broken: set[int], fixes: dict[int, list[tuple[str, str]]]) -> list[tuple[str, bool]]:
    """(paragraph, whether a word of it is carried on in the next chunk) from the lines of a chunk.

    A paragraph ends at a blank line, after a short line that ends a sentence, and around
    heading lines; running lines and page numbers between its lines do not end it.
    """
    lines = _LINES.split(text)
    kept = [(i, x.rstrip()) for i, x in enumerate(lines) if i not in drop]
    widths = sorted(len(x) for _, x in kept if x.strip())
    usual = widths[len(widths) // 2] if widths else 0
    out: list[str] = []
    now = ""
    glue = ""
    for n, (i, line) in enumerate(kept):
        if not line.strip():
            if now and not glue == "broken":
                out.append(now)
                now, glue = "", ""
            continue
        line = line.strip()
        for raw, repair in fixes.get(i, []):
            line = re.sub(rf"(?<!\w){re.escape(raw)}(?!\w)", lambda _, repair=repair: repair, line, count=1)
        end = line[-1:]
        later = next((x.strip() for _, x in kept[n + 1 :] if x.strip()), "")
        heading = len(line) < 60 and end not in ".,;:?!-" and later[:1].isupper() and (not now or now[-1:] in ".?!")
        if now and heading:
            out.append(now)
            now, glue = "", ""
        if i in broken:
            line = line.rstrip(HYPHENS)
        now = now + ("" if glue else " ") + line if now else line
        glue = "broken" if i in broken else "hyphen" if end in HYPHENS and end else ""
        if heading or (end in ".?!" and len(line) < 0.7 * usual):
            out.append(now)
            now, glue = "", ""
    if now:
        out.append(now)
    return [(p, glue == "broken" and k == len(out) - 1) for k, p in enumerate(out)]


def repaired_paragraphs(chunks: DataFrame, metadata: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, chunk_index, chunk_id, paragraph_no, text, carried_on) of scanned chunks.

    Running lines and page numbers are taken out, broken words joined, misread words and numbers
    repaired, lines joined into paragraphs. ``carried_on`` says that the last word goes on in
    the next chunk. Nulls, empty texts and repeated rows as in ``line_noise``.
    """
    found = line_noise(chunks, metadata, pages)
    scanned, repairs = found["scanned"], found["misread"]
    of = lambda df, name: df.groupBy("chunk_id").agg(F.collect_set("line_no").alias(name))
    # a misread word that is broken over two lines is repaired once its halves are joined
    fixed = repairs.filter(F.col("part") == 0).groupBy("chunk_id").agg(F.collect_list(F.struct("line_no", "raw", "repair")).alias("fixes"))
    rows = scanned.join(of(found["edges"], "drop"), "chunk_id", "left").join(of(found["hyphens"], "broken"), "chunk_id", "left").join(fixed, "chunk_id", "left")

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = lambda x: set() if x is None else {int(i) for i in x}
        for pdf in batches:
            out = []
            for doc, idx, cid, text, drop, broken, fixes in zip(*[pdf[c] for c in ("document_id", "chunk_index", "chunk_id", "text", "drop", "broken", "fixes")], strict=True):
                by: dict[int, list[tuple[str, str]]] = {}
                for f in [] if fixes is None else fixes:
                    by.setdefault(int(f["line_no"]), []).append((f["raw"], f["repair"]))
                out += [(doc, idx, cid, k, p, on) for k, (p, on) in enumerate(paragraphs_of(text, listed(drop), listed(broken), by))]
            frame = pd.DataFrame(out, columns=["document_id", "chunk_index", "chunk_id", "paragraph_no", "text", "carried_on"])
            frame["chunk_index"] = frame["chunk_index"].astype("Int32")
            yield frame

    return rows.select("document_id", "chunk_index", "chunk_id", "text", "drop", "broken", "fixes").mapInPandas(
        mend, "document_id string, chunk_index int, chunk_id string, paragraph_no int, text string, carried_on boolean"
    )


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of all scanned chunks."""
    return repaired_paragraphs(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "doc_metadata"), table(spark, sf_dir, "page_validation"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, noise_kind, line_no) of the noisy lines of scanned chunks."""
    return line_noise(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "doc_metadata"), table(spark, sf_dir, "page_validation"))["noise"]


QUERIES = {"p4_found": p4_found, "p4_paragraphs": p4_paragraphs}
SQL: dict[str, str] = {}
