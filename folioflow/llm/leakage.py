"""Evaluation texts leaking into training text.

Texts become streams of folded letters and digits: case, accents, spacing, punctuation and
look-alike characters are gone. Windows of a stream begin at content-defined places, the same
in a copy wherever it stands. A random walk after Chakraborty, Goldenberg and Koucky (2016)
embeds each window so that edit distance becomes Hamming distance; bit sampling gives each window
a key in each of several LSH tables, and keys of documents meet those of held-out passages in a
join. Documents are read and embedded once, whatever the number of passages. As long as the
passages' keys are few (``BROADCAST_KEYS``) every task has them and nothing of a document is
shuffled; beyond that, what has no key in a bit table of fixed size is dropped and the rest meets
the keys in a join by key. Both ways give the same rows.
A pair of a document and a passage that shares enough windows is then verified exactly: the
edit distance of every block of the passage within the stretch of the document, by the
bit-parallel algorithm of Myers (1999) run over many pairs at once. It runs only where the block
can be near at all: by the q-gram lemma (Jokinen and Ukkonen 1991) a place within ``k`` edits keeps
all but ``k q`` of the block's runs of ``q`` characters, so no place is missed. Only then stock
wording is judged, block by block, by the number of documents that hold it.

Passages too short for windows are looked up by their first folded characters at every place of
every document. No document is ever compared with another.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.runtime import spread, table, written

# Windows, tables and ``least_windows`` are chosen so that of the copies of 40 percent and more that
# the exact verification accepts, with up to every 8th word replaced or 5 percent of the characters
# edited, 99 percent become candidates.
#: Characters of a window, and steps of the walk over it.
WINDOW, STEPS = 40, 80
#: A window begins at about every ``SPARSE``-th character.
SPARSE = 10
#: Coordinates a table samples, and tables.
SAMPLED, TABLES = 14, 8
#: Characters of a verified block of a passage, at most 64.
BLOCK = 40
#: Characters of the runs by which places of blocks are told, and bits of their codes.
GRAM, GRAM_BITS = 3, 12
#: Characters, and blocks, that are verified at once.
CHARACTERS, BLOCKS = 1 << 20, 1 << 12
#: Folded characters by which shorter passages are looked up: the most of these that a passage has.
ANCHORS = (24, 16, 10, 6)
#: Keys, and characters of passages, up to which all tasks get them.
BROADCAST_KEYS, BROADCAST_CHARACTERS = 1_000_000, 16_000_000
#: Bits of the table of the passages' keys: at least and at most, and so many a key in between.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 20, 1 << 27, 64
#: Stock wording: blocks held by so many documents and this share of all, and this many times those that hold the whole passage.
STOCK_DOCUMENTS, STOCK_SHARE, STOCK_TIMES = 20, 0.01, 10
#: Share of a passage from which a copy counts as whole.
WHOLE = 0.8
# Characters that are read as another in copied text.
LOOKALIKES = dict(zip("авекмнорстухіѕјԁɡһԛԝοανρτυικ0135$@|!ıß", "abekmhopctyxlsjdghqwoavptulkolessalllls", strict=False)) | {"i": "l", "l": "l", "ö": "o"}


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Of every BMP code point the folded one, 0 where it is dropped."""
    out = np.zeros(65536, "u2")
    for cp in range(65536):
        if 0xD800 <= cp < 0xE000:
            continue
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4:
            out[cp] = cp
            continue
        for c in unicodedata.normalize("NFKD", chr(cp)).lower():
            c = LOOKALIKES.get(c, c)
            if c.isalnum():
                out[cp] = ord(c) if ord(c) < 65536 else 0
                break
    return out


@lru_cache(maxsize=1)
def _walk_bits() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20160618)
    bits = rng.integers(0, 2, (STEPS, 256), dtype="u1")
    samples = np.stack([np.sort(rng.choice(STEPS, SAMPLED, replace=False)) for _ in range(TABLES)])
    weights = rng.integers(1, 2**63, (TABLES, SAMPLED), dtype="u8") | np.uint64(1)
    return bits, samples, weights


def streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts one after another, and where each text begins (and ends)."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    raw = np.frombuffer(joined, "<u4")
    folded = _fold_table()[np.minimum(raw, 65535)]
    keep = folded != 0
    ends = np.cumsum([len(t) for t in texts])
    upto = np.r_[0, np.cumsum(keep)]
    return folded[keep], np.r_[0, upto[ends]] if len(texts) else np.zeros(1, int)


def window_starts(stream: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, text numbers) of the windows that lie within a text."""
    if len(stream) < WINDOW:
        return np.zeros(0, int), np.zeros(0, int)
    s = stream.astype("u4")
    mixed = (s[:-3] * np.uint32(2654435761)) ^ (s[1:-2] * np.uint32(2246822519)) ^ (s[2:-1] * np.uint32(3266489917)) ^ (s[3:] * np.uint32(668265263))
    mixed ^= mixed >> np.uint32(15)
    starts = np.flatnonzero(mixed % np.uint32(SPARSE) == 0)
    of = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + WINDOW <= bounds[of + 1]
    return starts[inside], of[inside]


def embed(stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(TABLES, windows) of LSH keys of the windows' random-walk embeddings."""
    bits, samples, weights = _walk_bits()
    classes = ((stream.astype("u4") * np.uint32(40503)) >> np.uint32(3)).astype("u1")
    classes = np.r_[classes, np.zeros(1, "u1")]
    keys = np.zeros((TABLES, len(starts)), "u8")
    at, end = starts.astype("i4"), (starts + WINDOW).astype("i4")
    uses: list[list[tuple[int, int]]] = [[] for _ in range(STEPS)]
    for t in range(TABLES):
        for k, step in enumerate(samples[t]):
            uses[step].append((t, k))
    for step in range(STEPS):
        c = classes[at]
        if uses[step]:
            c = np.where(at < end, c, 0)
            wide = c.astype("u8") + np.uint64(1)
            for t, k in uses[step]:
                keys[t] += wide * weights[t, k]
        at += bits[step][c]
        if step >= WINDOW - 1:
            np.minimum(at, end, out=at)
    keys ^= keys >> np.uint64(29)
    return keys


def table_keys(stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(TABLES, windows) of 64-bit keys that differ from table to table."""
    keys = embed(stream, starts)
    keys ^= np.arange(1, TABLES + 1, dtype="u8")[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return keys.view("i8")


def anchor_keys(stream: np.ndarray, size: int) -> np.ndarray:
    """A key of the ``size`` characters from each place on."""
    n = len(stream) - size + 1
    if n <= 0:
        return np.zeros(0, "i8")
    key = np.full(n, np.uint64(size), "u8")
    for i in range(size):
        key *= np.uint64(0x100000001B3)
        key ^= stream[i : i + n].astype("u8") + np.uint64(0x9E3779B9)
    key ^= key >> np.uint64(31)
    return key.view("i8")


def passage_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage number, window, key) of all passages, (windows, anchor) of each: windows of 0 for no key, anchor of 0 for LSH."""
    stream, bounds = streams(texts)
    starts, of = window_starts(stream, bounds)
    windows = np.bincount(of, minlength=len(texts))
    number = np.arange(len(starts)) - np.searchsorted(of, of)
    keys = table_keys(stream, starts)
    rows = [(of, number, k) for k in keys]
    anchor = np.zeros(len(texts), int)
    for i in np.flatnonzero(windows == 0):
        own = stream[bounds[i] : bounds[i + 1]]
        size = next((a for a in ANCHORS if a <= len(own)), 0)
        if size:
            anchor[i], windows[i] = size, 1
            rows.append((np.array([i]), np.array([0]), anchor_keys(own[:size], size)))
    of, number, key = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, "i8"))
    return of, number, key, windows, anchor


def document_keys(texts: list[str], anchors: Iterable[int], held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start within the text's stream, key) of what may be a key of a passage by the bit table ``held``."""
    stream, bounds = streams(texts)
    starts, of = window_starts(stream, bounds)
    out = []
    for key in table_keys(stream, starts):
        at = np.flatnonzero(_held(held, key))
        out.append((of[at], starts[at] - bounds[of[at]], key[at]))
    for size in anchors:
        key = anchor_keys(stream, size)
        at = np.flatnonzero(_held(held, key))
        text = np.searchsorted(bounds, at, "right") - 1
        inside = at + size <= bounds[text + 1]
        out.append((text[inside], (at - bounds[text])[inside], key[at[inside]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _held(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key.view("u8") & np.uint64(len(bits) * 8 - 1)
    return bits[(at >> np.uint64(3)).astype("i8")] >> (at & np.uint64(7)).astype("u1") & 1


def bit_table(keys: DataFrame, size: int, chunk: int = 1 << 16) -> np.ndarray:
    """``size`` bits in bytes, those of the keys (column ``key``) set; put together from the bits of each task."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size // 8, "u1")
        for pdf in batches:
            at = pdf["key"].to_numpy("i8").view("u8") & np.uint64(size - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype("i8"), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype("u1")))
        parts = bits.reshape(-1, min(chunk, len(bits)))
        some = np.flatnonzero(parts.any(1))
        yield pd.DataFrame({"part": some, "bits": [parts[i].tobytes() for i in some]})

    def either(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(x, "u1") for x in pdf["bits"]])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [bits.tobytes()]})

    shape = "part bigint, bits binary"
    out = np.zeros((-(-size // 8 // chunk), min(chunk, size // 8)), "u1")
    for r in keys.mapInPandas(mark, shape).groupBy("part").applyInPandas(either, shape).toLocalIterator():  # size / 8 bytes in all
        out[r["part"]] = np.frombuffer(r["bits"], "u1")
    return out.ravel()


@dataclass
class Passages:
    """The verification patterns of some passages."""

    block_case: np.ndarray
    block_length: np.ndarray
    first: np.ndarray  # of each passage its first block, and one past the last
    symbols: np.ndarray  # code point -> symbol
    patterns: np.ndarray  # (blocks, symbols) bit masks
    grams: np.ndarray  # (blocks, runs) codes of the runs of GRAM characters


def block_lengths(length: int) -> list[int]:
    """Lengths of the blocks of a passage of so many folded characters; a short rest is left out."""
    return [min(BLOCK, length - s) for s in range(0, length, BLOCK) if length - s >= BLOCK // 2 or not s]


def patterns_of(texts: list[str]) -> Passages:
    stream, bounds = streams(texts)
    used = np.unique(stream)
    symbols = np.zeros(65536, "u2")
    symbols[used] = np.arange(1, len(used) + 1)
    lengths = [block_lengths(int(b - a)) for a, b in zip(bounds, bounds[1:], strict=False)]
    case = np.repeat(np.arange(len(texts)), [len(x) for x in lengths])
    length = np.array([n for x in lengths for n in x], int)
    first = np.r_[0, np.cumsum([len(x) for x in lengths])].astype(int)
    # blocks stand at every BLOCK-th character of their passage
    at = bounds[case] + BLOCK * (np.arange(len(case)) - first[case])
    patterns = np.zeros((len(case), len(used) + 1), "u8")
    rows = np.arange(len(case))
    for j in range(BLOCK):
        on = j < length
        patterns[rows[on], symbols[stream[at[on] + j]]] |= np.uint64(1 << j)
    # beyond a shorter block's end its first run again
    within = np.arange(BLOCK - GRAM + 1)
    grams = gram_codes(stream)[at[:, None] + np.where(within <= length[:, None] - GRAM, within, 0)]
    return Passages(case, length, first, symbols, patterns, grams)


def gram_codes(stream: np.ndarray) -> np.ndarray:
    """A code of the run of GRAM characters from each place on; other runs may have it too."""
    s = np.r_[stream, np.zeros(GRAM - 1, stream.dtype)].astype("u4")
    mixed = np.zeros(len(stream), "u4")
    for i, weight in zip(range(GRAM), (2654435761, 2246822519, 3266489917), strict=True):
        mixed += s[i : i + len(stream)] * np.uint32(weight)
    return (mixed >> np.uint32(32 - GRAM_BITS)).astype("i8")


def stretches(text: np.ndarray, case: np.ndarray, start: np.ndarray, window: np.ndarray, windows: np.ndarray, least_windows: float, apart: int) -> pd.DataFrame:
    """(text, case, low, high): stretches of texts in which enough windows of a passage lie; ``windows`` counts those of each case."""
    found = pd.DataFrame({"text": text, "case": case, "start": start, "window": window}).drop_duplicates().sort_values(["text", "case", "start"], kind="stable")
    if not len(found):
        return found.assign(low=0, high=0)[["text", "case", "low", "high"]]
    t, c, at = (found[x].to_numpy() for x in ("text", "case", "start"))
    new = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (at[1:] - at[:-1] > apart + WINDOW)]
    found["stretch"] = np.cumsum(new)
    counts = found.groupby(["text", "case", "stretch"]).agg(n=("window", "nunique"), low=("start", "min"), high=("start", "max")).reset_index()
    have = windows[counts["case"].to_numpy(int)]
    kept = counts[counts["n"].to_numpy() >= np.minimum(np.maximum(2, least_windows * have), have)]
    return kept[["text", "case", "low", "high"]]


def _distances(p: Passages, blocks: np.ndarray, texts: list[np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block the least edit distance to any place of its text, and where that place ends."""
    m = p.block_length[blocks].astype("u8")
    one = np.uint64(1)
    last = m - one
    top = one << last
    down = last.astype("i8")
    peq, row = p.patterns.ravel(), blocks * p.patterns.shape[1]
    longest = max(map(len, texts), default=0)
    # what fills up shorter texts matches nothing, so no distance falls there
    padded = np.zeros((longest, len(texts)), "i8")
    for i, t in enumerate(texts):
        padded[: len(t), i] = t
    # bits above a block's last one are never read, and nothing moves down from them
    pv, mv = np.full(len(blocks), ~np.uint64(0)), np.zeros(len(blocks), "u8")
    score = m.astype("i8")
    best, place = score.copy(), np.zeros(len(blocks), "i4")
    at, better = np.zeros(len(blocks), "i8"), np.zeros(len(blocks), bool)
    eq, xv, xh, ph, mh = (np.zeros(len(blocks), "u8") for _ in range(5))
    for j in range(longest):
        padded[j].take(of, out=at, mode="clip")
        at += row
        peq.take(at, out=eq, mode="clip")
        np.bitwise_or(eq, mv, out=xv)
        np.bitwise_and(eq, pv, out=xh)
        xh += pv
        xh ^= pv
        xh |= eq
        np.bitwise_or(xh, pv, out=ph)
        np.invert(ph, out=ph)
        ph |= mv
        np.bitwise_and(pv, xh, out=mh)
        # the last bit of either tells whether the distance grows or falls
        np.bitwise_and(ph, top, out=eq)
        np.bitwise_and(mh, top, out=xh)
        eq -= xh
        step = eq.view("i8")
        step >>= down
        score += step
        ph <<= one
        mh <<= one
        np.bitwise_or(xv, ph, out=pv)
        np.invert(pv, out=pv)
        pv |= mh
        np.bitwise_and(ph, xv, out=mv)
        np.less(score, best, out=better)
        if better.any():
            np.copyto(best, score, where=better)
            np.copyto(place, j + 1, where=better)
    return best, place


def _copied(distance: np.ndarray, place: np.ndarray, length: np.ndarray, far: float, slack: int, apart: int) -> tuple[float, list[int]]:
    """Share of a passage that a document copies, characters in runs of blocks found in order, and those blocks."""
    n = len(length)
    ok = distance <= far * length
    run = np.zeros(n, bool)
    for i in range(n - 1):
        if ok[i] and ok[i + 1] and abs(place[i + 1] - place[i] - length[i + 1]) <= slack:
            run[i] = run[i + 1] = True
    if n == 1:
        run = ok
    at = np.flatnonzero(run)
    best, back = np.zeros(len(at)), np.full(len(at), -1)
    # edits count against a block: what only follows the same pattern differs in most of its blocks
    weight = length * (1 - 0.75 * distance / (far * length))
    for x, i in enumerate(at):
        before = 0.0
        for y in range(x):
            k = at[y]
            step = place[i] - place[k]
            if 0 < step <= length[k + 1 : i + 1].sum() + apart and best[y] > before:
                before, back[x] = best[y], y
        best[x] = before + weight[i]
    held, x = [], int(best.argmax()) if len(at) else -1
    while x >= 0:
        held.append(int(at[x]))
        x = back[x]
    return float(best.max(initial=0.0)) / max(1, int(length.sum())), held[::-1]


def places(p: Passages, pieces: list[np.ndarray], case: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece number, block, low, high): stretches of the pieces that hold every place within ``far`` of a block of their passage.

    A place within ``k`` edits of a block has at most ``k`` characters more and keeps all but
    ``GRAM * k`` of the block's runs. Places with so many of its runs are counted for eight blocks
    at once, a byte of a number each. ``case`` must be in order.
    """
    most = np.clip((far * p.block_length).astype(int), 0, p.block_length)
    span = BLOCK + int(most.max(initial=0))
    wide = span - GRAM + 1
    # the highest bit of a byte tells whether its count reaches the least
    bias = (128 - np.clip(p.block_length - GRAM + 1 - GRAM * most, 0, 128)).astype("u1")
    begins = np.r_[0, np.cumsum([len(x) for x in pieces])].astype(int)
    codes = gram_codes(np.concatenate(pieces))
    first = np.zeros(len(codes) + 1, bool)
    first[begins] = True
    out = []
    for a, b in _runs(case):
        at, n = begins[a], begins[b] - begins[a]
        mine = codes[at : at + n]
        total = np.zeros(n + wide, "u8")
        for low in range(p.first[case[a]], p.first[case[a] + 1], 8):
            blocks = np.arange(low, min(low + 8, p.first[case[a] + 1]))
            has = np.zeros((1 << GRAM_BITS, 8), "u1")
            has[p.grams[blocks], (blocks - low)[:, None]] = 1
            np.cumsum(has.view("u8").ravel().take(mine), out=total[1 : n + 1])
            total[n + 1 :] = total[n]
            reached = total[wide:] - total[:n]
            add = np.zeros(8, "u1")
            add[: len(blocks)] = bias[blocks]
            reached += add.view("u8")
            reached &= np.uint64(0x8080808080808080)
            some = np.flatnonzero(reached != 0)
            reached = reached[some]
            # runs of such places, none from one piece into the next
            joined = np.where((some[1:] == some[:-1] + 1) & ~first[at + some[1:]], ~np.uint64(0), np.uint64(0))
            start, stop = reached.copy(), reached.copy()
            start[1:] &= ~(reached[:-1] & joined)
            stop[:-1] &= ~(reached[1:] & joined)
            lane, i = np.nonzero(start.view("u1").reshape(-1, 8).T)
            out.append((low + lane, at + some[i], at + some[np.nonzero(stop.view("u1").reshape(-1, 8).T)[1]]))
    block, start, stop = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3
    piece = np.searchsorted(begins, start, "right") - 1
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (piece[1:] != piece[:-1]) | (start[1:] - stop[:-1] > span)
    piece, stop = piece[new], stop[np.r_[new[1:], True][: len(new)]]
    return piece, block[new], start[new] - begins[piece], np.minimum(stop + span, begins[piece + 1]) - begins[piece]


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    return zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(x)].tolist(), strict=True) if len(x) else iter(())


def _beside(ok: np.ndarray, of: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Which blocks have another one beside them in their piece, or are their passage's only one."""
    pair = ok[1:] & ok[:-1] & (of[1:] == of[:-1])
    return (np.r_[pair, False] | np.r_[False, pair] | alone) & ok


def verify(p: Passages, pieces: list[np.ndarray], case: np.ndarray, share: float, far: float, apart: int) -> list[tuple[int, float, list[int]]]:
    """(piece number, share copied, blocks copied) of the pieces of streams that carry their passage."""
    size = np.array([len(x) for x in pieces], int)
    order = np.argsort(case, kind="stable")
    out = []
    part = np.cumsum(size[order]) // CHARACTERS
    for a, b in _runs(part):
        some = order[a:b]
        out += [(int(some[x]), copied, held) for x, copied, held in _verify(p, [pieces[x] for x in some], case[some], share, far, apart)]
    return sorted(out, key=lambda found: (size[found[0]], found[0]))


def _verify(p: Passages, pieces: list[np.ndarray], case: np.ndarray, share: float, far: float, apart: int) -> Iterator[tuple[int, float, list[int]]]:
    count = p.first[case + 1] - p.first[case]
    ends = np.cumsum(count)
    of = np.repeat(np.arange(len(pieces)), count)
    length = p.block_length[np.arange(len(of)) + (p.first[case] - ends + count)[of]]
    alone, whole = count[of] == 1, np.maximum(1, np.bincount(of, length, len(pieces)))

    def enough(run: np.ndarray) -> np.ndarray:
        return np.bincount(of, length * run, len(pieces)) / whole >= share

    piece, block, low, high = places(p, pieces, case, far)
    row = block - p.first[case[piece]] + (ends - count)[piece]
    run = np.zeros(len(of), bool)
    run[row] = True
    run = _beside(run, of, alone)
    kept = run[row] & enough(run)[piece]
    piece, block, low, high, row = (x[kept] for x in (piece, block, low, high, row))
    shortest = np.lexsort((low, piece, high - low))
    piece, block, low, high, row = (x[shortest] for x in (piece, block, low, high, row))
    # blocks with the same stretch share its text
    new = np.ones(len(row), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    text = np.cumsum(new) - 1
    near, place = np.zeros(len(row), int), np.zeros(len(row), int)
    at = 0
    while at < len(row):
        some = slice(at, at + BLOCKS)
        upto = at + max(1, int(np.searchsorted((high - low)[some] * (text[some] - text[at] + 1), CHARACTERS, "right")))
        own = at + np.flatnonzero(np.r_[True, new[at + 1 : upto]])
        texts = [p.symbols[pieces[x][a:b]] for x, a, b in zip(piece[own], low[own], high[own], strict=True)]
        near[at:upto], place[at:upto] = _distances(p, block[at:upto], texts, text[at:upto] - text[at])
        at = upto
    place += low
    # of a block's stretches the nearest, of equally near ones the first
    best = np.lexsort((place, near, row))
    best = best[np.r_[True, row[best][1:] != row[best][:-1]][: len(best)]]
    distance, ended = length.copy(), np.zeros(len(of), int)
    distance[row[best]], ended[row[best]] = near[best], place[best]
    for x in np.flatnonzero(enough(_beside(distance <= far * length, of, alone))):
        mine = slice(ends[x] - count[x], ends[x])
        copied, held = _copied(distance[mine], ended[mine], length[mine], far, BLOCK * 2 // 5, apart)
        if copied >= share:
            yield int(x), copied, held


class Verifier:
    """Verifies stretches of texts; the patterns of the passages last asked for are kept."""

    def __init__(self, share: float, far: float, apart: int):
        self.share, self.far, self.apart = share, far, apart
        self.asked: tuple[str, ...] = ()
        self.patterns: Passages | None = None

    def copies(self, near: pd.DataFrame, texts: list[str], passages: list[str]) -> list[tuple[int, int, float, list[int]]]:
        """(text, case, share copied, blocks copied) of the rows of ``stretches`` that are copies, the fullest of a pair."""
        if not len(near):
            return []
        asked = tuple(sorted({passages[c] for c in near["case"]}))
        if asked != self.asked:
            self.asked, self.patterns = asked, patterns_of(list(asked))
        p, number = self.patterns, {x: n for n, x in enumerate(asked)}
        used = sorted(set(near["text"]))
        stream, bounds = streams([texts[i] for i in used])
        at = {i: n for n, i in enumerate(used)}
        case = np.array([number[passages[c]] for c in near["case"]])
        pieces = []
        for i, low, high, c in zip(near["text"], near["low"], near["high"], case, strict=True):
            a, b = bounds[at[i]], bounds[at[i] + 1]
            # what lies beyond the outermost windows is at most the rest of the passage
            reach = int(p.block_length[p.first[c] : p.first[c + 1]].sum()) + BLOCK
            pieces.append(stream[max(a, a + low - reach) : min(b, a + high + WINDOW + reach)])
        best: dict[tuple[int, int], tuple[float, list[int]]] = {}
        text, of = near["text"].to_numpy(), near["case"].to_numpy()
        for x, copied, held in verify(p, pieces, case, self.share, self.far, self.apart):
            pair = (int(text[x]), int(of[x]))
            if pair not in best or copied > best[pair][0]:
                best[pair] = (copied, held)
        return [(*pair, *found) for pair, found in best.items()]


def _portions(texts: list[str], most: int = 2_000_000) -> Iterator[slice]:
    """Runs of some 2 million characters, whole texts."""
    size, start = 0, 0
    for at, t in enumerate(texts):
        size += len(t)
        if size > most or at == len(texts) - 1:
            yield slice(start, at + 1)
            size, start = 0, at + 1


def _without_stock(found: DataFrame, blocks: DataFrame, documents: DataFrame, least: float) -> DataFrame:
    """Pairs that hold the whole passage, or more of it than wording that very many documents hold."""
    whole = found.groupBy("passage_id").agg(F.count(F.when(F.col("copied") >= WHOLE, 1)).alias("whole"))
    holders = found.select("passage_id", F.explode("held").alias("block")).groupBy("passage_id", "block").agg(F.count("*").alias("holders"))
    many = documents.agg(F.greatest(F.lit(float(STOCK_DOCUMENTS)), F.count("*") * STOCK_SHARE).alias("many"))
    stock = holders.join(whole, "passage_id").crossJoin(F.broadcast(many)).filter((F.col("holders") >= F.col("many")) & (F.col("holders") >= STOCK_TIMES * F.col("whole")))
    stock = stock.groupBy("passage_id").agg(F.collect_list("block").alias("stock")).join(blocks, "passage_id")

    def own(at: str | Column) -> Column:
        return F.aggregate(F.array_except(at, "stock"), F.lit(0), lambda n, b: n + F.get("lengths", b))

    total = own(F.sequence(F.lit(0), F.size("lengths") - 1))
    kept = F.col("stock").isNull() | (F.col("copied") >= WHOLE) | ((own("held") > 0) & (own("held") >= least * total))
    return found.join(stock, "passage_id", "left").filter(kept).select("key", "passage_id", "copied")


def leaked_passages(
    documents: DataFrame,
    cases: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    case_key: str = "case_id",
    passage: str = "passage",
    share: float = 0.35,
    far: float = 0.2,
    least_windows: float = 0.1,
    apart: int = 1200,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """(key, case_key, copied): documents that reproduce a share of a held-out passage in order.

    ``copied`` is the share of the passage's folded characters in runs of blocks that the
    document has within ``far`` edits a character, less for blocks with edits, in the passage's
    order, foreign text of up to ``apart`` characters between them. ``share`` lies a little under
    the wanted 40 percent of words, for a run loses part of a block at either end.

    Blocks of a passage that very many documents hold, far more than hold the whole passage,
    are stock wording; a document that holds less than ``least_windows`` of the other blocks'
    characters is no copy. Wording that passages share counts for each of them.

    Null and blank texts and passages give no rows. A passage without windows is found where the
    document has its first folded characters (as many as 24, 16, 10 or 6); one of less than six
    is no wording to be told. A passage given twice under a key counts once, the first by text;
    the same passage under several keys is reported for each. Repeated documents are documents
    of their own. Texts are read whole.
    """
    spark = documents.sparkSession
    asked = cases.filter(F.col(passage).isNotNull() & F.col(case_key).isNotNull()).groupBy(F.col(case_key).cast("string").alias("case")).agg(F.min(passage).alias("passage"))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["passage"].tolist()
            of, window, key, windows, anchor = passage_keys(texts)
            stream, bounds = streams(texts)
            order = np.argsort(of, kind="stable")
            cut = np.cumsum(windows * np.where(anchor > 0, 1, TABLES))[:-1]
            folded = [stream[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pd.DataFrame(
                {
                    "case": pdf["case"],
                    "passage_id": [hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() for x in folded],
                    "passage": texts,
                    "windows": windows,
                    "anchor": anchor,
                    "lengths": [block_lengths(len(x)) for x in folded],
                    "keys": [[{"window": int(w), "key": int(k)} for w, k in zip(a, b, strict=True)] for a, b in zip(np.split(window[order], cut), np.split(key[order], cut), strict=True)],
                }
            )

    shape = "case string, passage_id string, passage string, windows int, anchor int, lengths array<int>, keys array<struct<window:int,key:bigint>>"
    named = written(spread(asked).mapInPandas(index, shape).filter("windows > 0"), "passages")
    # passages of equal folded wording are one
    distinct = named.groupBy("passage_id").agg(F.min(F.struct("passage", "windows", "anchor", "lengths", "keys")).alias("p")).select("passage_id", "p.*")
    keys = written(distinct.select("passage_id", F.explode("keys").alias("k")).select("passage_id", "k.window", "k.key"), "passage-keys")
    anchors = sorted(r["anchor"] for r in named.select("anchor").distinct().filter("anchor > 0").collect())  # of ANCHORS
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") >= min(ANCHORS))
    rows = spread(rows)
    size = keys.count()
    characters = distinct.agg(F.sum(F.length("passage"))).first()[0] or 0
    how = (share, far, apart, least_windows)
    if size <= broadcast_keys and characters <= BROADCAST_CHARACTERS:
        found = _found_in_tasks(rows, distinct, keys, anchors, kind, *how)
    else:
        found = _found_by_join(rows, distinct, keys, size, anchors, kind, *how)
    found = written(found)
    found = _without_stock(found, distinct.select("passage_id", "lengths"), documents, least_windows)
    return found.join(named.select("passage_id", "case"), "passage_id").select(F.col("key").alias(key), F.col("case").alias(case_key), "copied")


_FOUND = "key {kind}, passage_id string, copied double, held array<int>"


def _found_in_tasks(rows: DataFrame, distinct: DataFrame, keys: DataFrame, anchors: list[int], kind: str, share: float, far: float, apart: int, least_windows: float) -> DataFrame:
    """Copies of passages whose keys all tasks hold: sorted, looked up where a document has them."""
    listed = distinct.select("passage_id", "passage", "windows").toPandas()
    number = {x: i for i, x in enumerate(listed["passage_id"])}
    table = keys.toPandas()
    order = np.argsort(table["key"].to_numpy("i8"), kind="stable")
    index = rows.sparkSession.sparkContext.broadcast(  # BROADCAST_KEYS and BROADCAST_CHARACTERS at most
        (
            listed["passage_id"].tolist(),
            listed["passage"].tolist(),
            listed["windows"].to_numpy(int),
            table["key"].to_numpy("i8")[order],
            np.array([number[x] for x in table["passage_id"]], "i4")[order],
            table["window"].to_numpy("i4")[order],
        )
    )

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, passages, windows, key, case, window = index.value
        bits = np.zeros(LEAST_BITS * 8, "u1")
        at = key.view("u8") & np.uint64(len(bits) * 8 - 1)
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype("i8"), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype("u1")))
        verifier = Verifier(share, far, apart)
        for pdf in batches:
            keyed, texts = pdf["key"].to_numpy(), pdf["text"].tolist()
            for some in _portions(texts):
                of, start, seen = document_keys(texts[some], anchors, bits)
                a = np.searchsorted(key, seen, "left")
                n = np.searchsorted(key, seen, "right") - a
                hit = np.repeat(np.arange(len(seen)), n)
                entry = np.repeat(a, n) + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
                near = stretches(of[hit], case[entry], start[hit], window[entry], windows, least_windows, apart)
                found = verifier.copies(near, texts[some], passages)
                if found:
                    yield pd.DataFrame({"key": keyed[[some.start + t for t, _, _, _ in found]], "passage_id": [ids[c] for _, c, _, _ in found], "copied": [x for _, _, x, _ in found], "held": [h for _, _, _, h in found]})

    return rows.mapInPandas(look, _FOUND.format(kind=kind))


def _found_by_join(rows: DataFrame, distinct: DataFrame, keys: DataFrame, count: int, anchors: list[int], kind: str, share: float, far: float, apart: int, least_windows: float) -> DataFrame:
    """Copies of any number of passages: documents' keys that pass the bit table are joined with theirs."""
    size = LEAST_BITS
    while size < min(MOST_BITS, count * BITS_A_KEY):
        size *= 2
    held = rows.sparkSession.sparkContext.broadcast(bit_table(keys, size))  # MOST_BITS at most

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in _portions(texts):
                of, place, found = document_keys(texts[part], anchors, held.value)
                order = np.argsort(of, kind="stable")
                some, first = np.unique(of[order], return_index=True)
                if len(some):
                    hits = [[{"start": int(a), "key": int(b)} for a, b in zip(x, y, strict=True)] for x, y in zip(np.split(place[order], first[1:]), np.split(found[order], first[1:]), strict=True)]
                    mine = pdf.iloc[part.start + some]
                    yield pd.DataFrame({"row": mine["row"].to_numpy(), "key": mine["key"].to_numpy(), "text": mine["text"].to_numpy(), "hits": hits})

    rows = rows.withColumn("row", F.monotonically_increasing_id())
    touched = written(rows.mapInPandas(look, f"row bigint, key {kind}, text string, hits array<struct<start:int,key:bigint>>"), "touched")
    hits = touched.select("row", F.explode("hits").alias("h")).select("row", "h.start", "h.key")
    # a set of places and windows a document and passage: bounded by the document
    pairs = hits.join(keys, "key").groupBy("row", "passage_id").agg(F.collect_set(F.struct("start", "window")).alias("at"))
    pairs = pairs.join(distinct.select("passage_id", "passage", "windows"), "passage_id").filter(F.size("at") >= F.least(F.lit(2), F.col("windows")))
    candidates = pairs.join(touched.select("row", "key", "text"), "row")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verifier = Verifier(share, far, apart)
        for pdf in batches:
            for begin in range(0, len(pdf), 2000):
                some = pdf.iloc[begin : begin + 2000].reset_index(drop=True)
                at = np.repeat(np.arange(len(some)), [len(x) for x in some["at"]])
                start, window = (np.array([x[name] for places in some["at"] for x in places], int) for name in ("start", "window"))
                near = stretches(at, at, start, window, some["windows"].to_numpy(int), least_windows, apart)
                found = verifier.copies(near, some["text"].tolist(), some["passage"].tolist())
                if found:
                    i = [t for t, _, _, _ in found]
                    yield pd.DataFrame({"key": some["key"].to_numpy()[i], "passage_id": some["passage_id"].to_numpy()[i], "copied": [x for _, _, x, _ in found], "held": [h for _, _, _, h in found]})

    return candidates.select("key", "text", "passage_id", "passage", "windows", "at").mapInPandas(check, _FOUND.format(kind=kind))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, case_id): documents that carry at least 40 percent of a held-out passage."""
    hits = leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases"))
    return hits.select("doc_id", "case_id").distinct()


QUERIES = {"p9_found": p9_found}
SQL: dict[str, str] = {}
