"""Sentence units of documents in any script, by semi-Markov dynamic programming.

A text is cut into blocks (paragraphs, heading and list lines). Within a block every place
where a sentence may end is a candidate, and the best sequence of whole spans between
candidates is found by dynamic programming. A span is scored jointly: how it opens (first
word), how it closes (last word and mark), how long it is, whether its quotations and
parentheses balance, and whether it is a bare quotation whose clause is still to come.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.runtime import spread, table

# Abbreviations that a sentence does not end with, and those that may end one.
NEVER_LAST = frozenset(
    "dr drs prof mr mrs ms messrs st sr sra srta dra dña ing lic hr fr frl mme mlle mm pr hno fig figs tab abb no nos nr nº vol ed eds ch sec eq ref pp "
    "cf vgl vs approx aprox env ca circa max min resp bzw inkl exkl zzgl evtl ggf sog inj caps syr susp deg dept gen maj col capt lt rev hon "
    "i.e e.g z.b d.h u.a o.ä s.o s.u p.ex c.-à-d p.ej ee.uu".split()
)
MAYBE_LAST = frozenset("etc al ff usw u.s.w a.m p.m b.i.d t.i.d q.i.d q.d o.d i.v i.m s.c p.o b.d t.d.s p.r.n jr inc ltd co bros uhr min hrs hr yr yrs mg ml kg cm mm".split())
GERMAN_ARTICLES = frozenset("der die das dem den des am im vom zum zur beim ab bis".split())
OPEN_MARKS = "\"'«“„‘(「『（【《¿¡["
PAIRS = {"«": 1, "»": -1, "“": 1, "”": -1, "「": 1, "」": -1, "『": 1, "』": -1, "(": 1, ")": -1, "（": 1, "）": -1, "„": 1, "[": 1, "]": -1}

_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = re.compile(r"[^\n]+")
_END_OF_LINE = re.compile(r"[.!?…।॥。！？:;][\s\"'»”“’)\]」』]*$")
_LIST = re.compile(r"\s*(?:[-•*‣·–]\s+|\(?\d{1,3}[.)]\s+|[a-zA-Z]\)\s+)")
# Marks that end a sentence in scripts of their own: Devanagari, East Asian, Arabic and Urdu, Ethiopic, Armenian, Khmer, Burmese, Tibetan.
OWN_MARKS = "।॥。！？｡؟۔።፧፨։។៕၊။༎"
_MARK = re.compile(rf"[.!?…]+|[{OWN_MARKS}]+")
_CLOSERS = re.compile(r"(?:[\"”“»’'）)\]」』]|[\s ]»)*")
_SPACE = re.compile(r"\s*")
_BEFORE_WORD = frozenset(" \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000(«“„\"‘「『[")
_WORD_AFTER = re.compile(r"[^\W_]+")
_THAI = re.compile(r"[฀-๿]")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿\"“(])")
_QUOTES = re.compile(r"[\"«»“”「」『』()（）„\[\]]")
# Thai words that close a sentence or a clause still open, and words that carry one on.
THAI_CLOSING = ("ครับ", "ค่ะ", "คะ", "นะ", "แล้ว", "ด้วย")
THAI_LEADING = ("และ", "หรือ", "ว่า", "คือ", "เช่น", "ได้แก่", "ของ", "ที่", "เป็น", "โดย")
THAI_FOLLOWING = ("และ", "หรือ", "ซึ่ง", "ที่", "โดย", "ว่า", "เป็นต้น", "ฯลฯ")


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of paragraphs, heading lines and list lines.

    Where blank lines part the paragraphs, a single line break is a wrap unless a list item
    begins there. Where there are none, line breaks are wraps if most lines end without a
    mark although they are long, else each line is a block.
    """
    if "\n" not in text:
        return [(0, len(text))]
    parts, at = [], 0
    for gap in _BLANK.finditer(text):
        parts.append((at, gap.start()))
        at = gap.end()
    parts.append((at, len(text)))
    blank = len(parts) > 1
    out = []
    for a, b in parts:
        if text.find("\n", a, b) < 0:
            out.append((a, b))
            continue
        lines = [m.span() for m in _LINE.finditer(text, a, b)]
        listed = [bool(_LIST.match(text, s, e)) for s, e in lines]
        wrapped = blank or _is_wrapped(text, lines, listed)
        start = lines[0][0]
        for k in range(1, len(lines)):
            s, e = lines[k]
            before = text[lines[k - 1][0] : lines[k - 1][1]]
            if listed[k]:
                cut = not wrapped or listed[k - 1] or bool(_END_OF_LINE.search(before))
            else:
                cut = not wrapped
            if cut:
                out.append((start, lines[k - 1][1]))
                start = s
        out.append((start, lines[-1][1]))
    return out


def _is_wrapped(text: str, lines: list[tuple[int, int]], listed: list[bool]) -> bool:
    """Whether the line breaks of a text without blank lines fall inside sentences."""
    open_, all_ = 0, 0
    for k in range(len(lines) - 1):
        if listed[k]:
            continue
        line, after = text[lines[k][0] : lines[k][1]], text[lines[k + 1][0] : lines[k + 1][1]].lstrip()
        all_ += 1
        if _END_OF_LINE.search(line):
            continue
        if after[:1].islower() and not re.match(r"[a-z]+[A-Z]", after):
            open_ += 2
        elif len(line.strip()) >= 45:
            open_ += 1
    return open_ * 2 > all_


def _close(text: str, start: int, begin: int, at: int, mark: str) -> float:
    """Score of a span that closes with ``mark`` at ``at`` after the word from ``begin``, the block beginning at ``start``."""
    first = mark[0]
    if first in OWN_MARKS:
        return 3.0
    if "?" in mark or "!" in mark:
        return 2.5
    if len(mark) > 1 or first == "…":
        return -1.0
    word = text[begin:at]
    if not word:
        return -4.0
    if len(word) > 64:  # longer than anything listed: all that counts is whether it is a row of initials
        return -8.0 if begin <= start and word.isdigit() else -1.0 if len(word) % 2 and word[0::2].isalpha() and not word[1::2].strip(".") else 2.0 - 0.5 * ("." in word)
    if at - len(word) <= start and word.isdigit():
        return -8.0  # a number before a heading or an item
    low = word.lower().rstrip(".")
    if low in NEVER_LAST:
        return -8.0
    if low in MAYBE_LAST:
        return -0.5 if "." in low or low in ("etc", "al", "ff", "jr") else 1.5
    if len(word) == 1 and word.isalpha():
        return -4.0
    if word.isdigit() and len(word) <= 2:
        before = text[max(start, begin - 12) : begin].split()
        if before and before[-1].lower() in GERMAN_ARTICLES:
            return -6.0
        return 1.5
    if "." in low:
        return -1.0 if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", low) else 1.5
    if _THAI.match(word[-1]):
        return -4.0
    return 2.0


def _open(text: str, at: int, gap: int, closed: bool, dots: bool) -> float:
    """Score of a span that opens at ``at`` after ``gap`` blanks; closed: behind a closing mark."""
    c = text[at]
    if c in OPEN_MARKS:
        if c in "\"'(" and not gap:
            return -8.0
        return 1.5 if c != "(" else -0.5
    if c in ",;:)]»”.!?-–—/%":
        return -9.0
    if not gap and c < "ऀ" and not (c.isupper() and at + 1 < len(text) and (text[at + 1].islower() or text[at + 1].isupper() or text[at + 1] == " ")):
        return -12.0
    if c.isdigit():
        return -2.0 if closed else 0.5
    if c.isupper():
        return 1.5
    if c.islower():
        word = _WORD_AFTER.match(text, at)
        if word and any(x.isupper() for x in word[0]):
            return 1.5
        return -7.0 if closed else -4.0 if dots else -1.0
    if c in "とっ":
        return -7.0 if closed else 0.5
    return 1.0


def _candidates(text: str, start: int, end: int) -> list[tuple[int, int, float, bool, bool]]:
    """(end of span, start of the next, score, behind a closing quotation mark, cased script)."""
    found = []
    begin = seen = start  # where the word before a mark begins, and how far the text was looked at for that
    for mark in _MARK.finditer(text, start, end):
        if mark.end() == end:
            break
        stop = _CLOSERS.match(text, mark.end(), end).end()
        closers = text[mark.end() : stop]
        if closers and closers[-1] in "\"'“" and len(closers) > 1 and closers[-2] in "”“":
            stop -= 1
            closers = closers[:-1]
        nxt = _SPACE.match(text, stop, end).end()
        if nxt >= end:
            break
        gap = nxt - stop
        at = mark.start()
        k = at
        while k > seen and text[k - 1] not in _BEFORE_WORD:
            k -= 1
        if k > seen or (k and text[k - 1] in _BEFORE_WORD):
            begin = k
        seen = at
        # a straight mark after a blank opens what follows
        close = _close(text, start, begin, at, mark[0])
        if close <= -6:
            continue
        score = close + _open(text, nxt, gap or (mark[0][0] in OWN_MARKS), bool(closers), len(mark[0]) > 1 and mark[0][0] in ".…")
        if not gap and mark[0][0] in ".!?" and not closers:
            before = text[max(start, mark.start() - 2) : mark.start()]
            if len(before) < 2 or not before.isalpha() or before[-1].isupper():
                score -= 6
        if score > -4.5:
            found.append((stop, nxt, score, bool(closers) and closers[-1] not in ")）]", text[nxt].isupper() or text[nxt].islower()))
    if _THAI.search(text, start, end):
        for gap in _THAI_GAP.finditer(text, start, end):
            found.append((gap.start(), gap.end(), _thai_gap(text, gap.start(), gap.end()), False, False))
        found.sort()
    return found


def _thai_gap(text: str, stop: int, nxt: int) -> float:
    """Score of a blank between Thai words: a sentence's end unless the words around it leave the clause open."""
    score = 2.0
    if text[stop - 1] == "ๆ":
        score -= 1.0
    if text.startswith(THAI_FOLLOWING, nxt):
        score -= 3.0
    if text.endswith(THAI_LEADING, max(0, stop - 8), stop):
        score -= 4.0
    elif text.endswith(THAI_CLOSING, max(0, stop - 8), stop):
        score += 1.0
    return score


def _balance(text: str, start: int, end: int, places: list[int]) -> list[tuple[int, int]] | None:
    """For each place (ascending) the state of the quotation marks before it; None if there are none."""
    marks = [m for m in _QUOTES.finditer(text, start, end)]
    if not marks:
        return None
    german = text.find("„", start, end) >= 0
    out, k, straight, depth = [], 0, 0, 0
    first = start + len(_LIST.match(text, start, end)[0]) if _LIST.match(text, start, end) else start
    for place in places:
        while k < len(marks) and marks[k].start() < place:
            c = marks[k][0]
            if marks[k].start() >= first:
                if c == '"':
                    straight ^= 1
                else:
                    depth += -1 if german and c == "“" else PAIRS[c]
            k += 1
        out.append((straight, depth))
    return out


def _length(n: int) -> float:
    return -3.0 if n < 3 else -0.5 if n < 8 else 0.0 if n < 600 else -(n - 600) / 400.0


def spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The best sequence of spans of a block."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if start >= end:
        return []
    found = _candidates(text, start, end)
    if not found:
        return [(start, end)]
    opens = [start, *[c[1] for c in found]]
    ends = [*[c[0] for c in found], end]
    state = _balance(text, start, end, [*opens, end])
    n = len(ends)
    best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
    upto = [0.0]  # the best score of any beginning so far
    for j in range(1, n + 1):
        close = found[j - 1][2] if j < n else 0.0
        for i in range(j - 1, -1, -1):
            # no longer span can score more: what is left out of a span's score only lowers it
            if upto[i] + close + min(0.0, _length(ends[j - 1] - opens[i])) < best[j] and ends[j - 1] - opens[i] >= 8:
                break
            score = best[i] + close + _length(ends[j - 1] - opens[i])
            if state:
                if state[i] != state[j]:
                    score -= 5.0
                if j < n and found[j - 1][3] and text[opens[i]] in "\"«“„「『" and state[i] == state[j]:
                    # a quotation from first to last: its clause follows, unless a new sentence is plain
                    inner = text[opens[i] + 1 : ends[j - 1] - 1]
                    if not any(x in inner for x in "\"»”」』"):
                        score -= 1.0 if found[j - 1][4] or text[opens[j]] in OPEN_MARKS else 5.0
            if score >= best[j]:
                best[j], back[j] = score, i
        upto.append(max(upto[-1], best[j]))
    out, j = [], n
    while j:
        i = back[j]
        out.append((opens[i], ends[j - 1]))
        j = i
    return out[::-1]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of a text; none for null and blank ones."""
    if not text or not text.strip():
        return []
    return [x for a, b in blocks(text) for x in spans(text, a, b)]


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_no, start_char, end_char): the sentence units of every text, numbered from 1.

    Offsets are 0-based code points, the end exclusive. Null and blank texts give no rows;
    repeated rows and null keys are documents of their own; other columns are ignored. A text
    is handled whole, whatever its length.
    """
    kind = documents.schema[key].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units = [sentences(t) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "starts": [[a for a, _ in u] for u in units], "ends": [[b for _, b in u] for u in units]})

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    cut = spread(rows).mapInPandas(split, f"key {kind}, starts array<int>, ends array<int>")
    return cut.select("key", F.posexplode(F.arrays_zip("starts", "ends")).alias("at", "unit")).select(
        F.col("key").alias(key), (F.col("at") + 1).alias("sentence_no"), F.col("unit.starts").alias("start_char"), F.col("unit.ends").alias("end_char")
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start_char) of every sentence unit of documents."""
    return sentence_units(table(spark, sf_dir, "documents")).select("doc_id", "start_char")


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}
