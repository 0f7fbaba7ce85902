"""Personal information inside free text: a linear-chain conditional random field.

Tokens carry features of their shape, of their spelling and of how the whole corpus writes them
in mid-sentence (small, capitalised, hardly ever), and of the tokens up to four places away.
The field is trained by maximum likelihood on the small labelled table of ``labelled``, where
the corpus feature is drawn at random by what a token is; notes are decoded by Viterbi in numpy,
many lines at a time. As features are of single tokens, the score of a token at each place is
looked up once a distinct token.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.labelled import labelled_rows
from folioflow.runtime import spread, table

TYPES = ("name", "email", "phone", "id_number", "address")
LABELS = ("O", *[f"{p}-{t}" for t in TYPES for p in "BI"])
#: Places around a token whose features it sees.
PLACES = (-4, -3, -2, -1, 0, 1, 2, 3)
#: Weight of a token's own features against those of its surroundings, so that form can outvote an unseen context.
OWN = 2.0
#: Places beyond which the spelling of a word, and the word itself, are not looked at.
SPELT_WITHIN, NAMED_WITHIN = 1, 2
#: A word is known if at least so many training lines hold it.
KNOWN = 5
#: Counters of the table of how words are written, a fixed size whatever the corpus.
BUCKETS = 1 << 20
#: Classes of a word: hardly ever in mid-sentence, there mostly small, there mostly capitalised, or almost only at the outset of sentences.
RARE, SMALL, CAPITAL, OUTSET = "rare", "small", "capital", "outset"
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}

# A token carries the blank before it: where a word, number or mark stands alone differs from where it is joined on.
_TOKEN = re.compile(r"[^\S\n]?(?:(?:[^\W\d_]+\d|\d+[^\W\d_])[^\W_]*|[^\W\d_]+(?:[ऀ-ॿ]+)?|[ऀ-ॣॱ-ॿ]+|\d+|\n|[^\w\s]|_)")
_EDGE = "\x00"


def tokens(text: str) -> tuple[list[str], list[int]]:
    """Tokens, each with the blank before it if there is one, and where each begins without it."""
    found = [(m[0], m.end() - len(m[0].lstrip())) if m[0] != "\n" else ("\n", m.start()) for m in _TOKEN.finditer(text)]
    return [t for t, _ in found], [s for _, s in found]


def form(token: str) -> str:
    """What of a token its features depend on: digits by their number only, blanks as joined or not."""
    bare = token if token == "\n" else token.lstrip()
    if not bare.isalpha() and len(bare) > 1 and bare.isalnum() and not bare.isdigit():
        # letters and digits in one: the letters as small or great ones
        bare = "".join("0" if c.isdigit() else "X" if c.isupper() else "x" for c in bare[:16])
    if bare.isdigit():
        bare = ("०" if "०" <= bare[0] <= "९" else "0") * min(len(bare), 13)
    return bare if len(bare) < len(token) or token == "\n" or token == _EDGE else "+" + bare


def features(f: str, written_as: str = RARE) -> list[str]:
    """Names of the features of a form whose word the corpus writes in the given way."""
    if f == _EDGE:
        return ["edge"]
    joined, f = f[0] == "+" and len(f) > 1, f[1:] if f[0] == "+" and len(f) > 1 else f
    c = f[0]
    tie = "joined" if joined else "apart"
    digits = f.count("0")
    if digits and digits < len(f):
        runs = re.sub(r"(.)\1+", r"\1", f)
        return ["mixed", f"mixed{runs}", f"mixed{min(digits, 6)}", f"{tie}mixed", f"mixed{runs}{digits}"]
    if c.isdigit():
        return ["digits", f"digits{len(f)}", f"{tie}digits", f"{tie}digits{len(f)}"]
    if not (c.isalpha() or "ऀ" <= c <= "ॿ"):
        return ["mark", f"mark{f}", f"{tie}mark{f}"]
    low = f.lower()
    if "ऀ" <= c <= "ॿ":
        shape = "deva"
    elif len(f) == 1:
        shape = "X" if f.isupper() else "x"
    else:
        shape = "XX" if f.isupper() else "Xx" if c.isupper() and f[1:].islower() else "xx" if f.islower() else "xX"
    return [f"shape{shape}", f"shape{shape}{min(len(f), 6)}", f"{tie}{shape}", f"word={low}", f"end={low[-3:]}", f"end={low[-2:]}", f"begin={low[:2]}", written_as, f"{written_as}{shape}"]


# A word in mid-sentence: behind a small letter or comma and a blank.
_INSIDE = re.compile(r"(?<=[^\W\d_A-ZÀ-Þ] )[^\W\d_]{2,}|(?<=, )[^\W\d_]{2,}")
_OUTSET = re.compile(r"(?<=[.:?!] )[^\W\d_]{2,}|(?<=\n)[^\W\d_]{2,}")


def _word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def written_words(texts: DataFrame) -> np.ndarray:
    """Of each bucket of words (by hash) the number of its class in ``WRITTEN``.

    Counted over all texts (column ``text``) per batch; what is shuffled and collected is at
    most ``BUCKETS`` counts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield word_counts(pdf["text"])

    counted = texts.filter(F.length("text") > 0).select("text").mapInPandas(count, "bucket int, n bigint, capitals bigint, outset bigint")
    sums = counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "capitals", "outset")])
    return word_classes(sums.filter("n + outset >= 3").toPandas())


WRITTEN = (RARE, SMALL, CAPITAL, OUTSET)


def word_counts(texts: pd.Series) -> pd.DataFrame:
    """(bucket, n, capitals, outset): words in mid-sentence, those of them that are capitalised, words at an outset."""
    inside: Counter[str] = Counter()
    outset: Counter[str] = Counter()
    for text in texts:
        inside.update(_INSIDE.findall(text))
        outset.update(_OUTSET.findall(text))
    rows = [(_word_bucket(w.lower()), n, n if w[0].isupper() else 0, 0) for w, n in inside.items()]
    rows += [(_word_bucket(w.lower()), 0, 0, n) for w, n in outset.items()]
    return pd.DataFrame(rows, columns=["bucket", "n", "capitals", "outset"]).groupby("bucket", as_index=False).sum()


def word_classes(counts: pd.DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS, "u1")
    n, outset = counts["n"].to_numpy(), counts["outset"].to_numpy()
    kind = np.where(2 * counts["capitals"].to_numpy() > n, 2, 1)
    kind = np.where((outset >= 5) & (n < 0.15 * outset), 3, np.where(n < 3, 0, kind))
    out[counts["bucket"].to_numpy(int)] = kind
    return out


class Field:
    """Weights of a linear-chain field over ``LABELS``."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, known: set[str], words: np.ndarray | None = None):
        self.index, self.weights, self.moves, self.known = index, weights, moves, known  # weights: places x features x labels
        self.words = words
        self._begin()

    def of_corpus(self, words: np.ndarray) -> Field:
        """The field with the ways in which a corpus writes its words."""
        return Field(self.index, self.weights, self.moves, self.known, words)

    def written_as(self, word: str) -> str:
        # a script without capitals tells nothing
        return RARE if self.words is None or "ऀ" <= word[:1] <= "ॿ" else WRITTEN[self.words[_word_bucket(word)]]

    def _begin(self) -> None:
        self.rows: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.scores = np.zeros((1024, len(PLACES), len(LABELS)), "f4")
        self.row(_EDGE)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "seen", "scores")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._begin()

    def row(self, f: str) -> int:
        """Number of the form's scores, computed when it is first seen."""
        at = self.rows.get(f)
        if at is None:
            at = len(self.rows)
            if at == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            ids = feature_ids(f, self.written_as(_bare(f)), self.index, self.known)
            self.scores[at] = self.weights[:, ids].sum(1) if ids else 0
            self.rows[f] = at
        return at

    def ids(self, words: list[str]) -> list[int]:
        """Row numbers of tokens, each distinct token's looked up once."""
        found = list(map(self.seen.get, words))
        if None in found:
            for i, at in enumerate(found):
                if at is None:
                    found[i] = self.seen[words[i]] = self.row(form(words[i]))
        return found

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """Label numbers of each line of tokens; empty for a line without any mention."""
        if len(self.rows) > 200_000 or len(self.seen) > 500_000:  # memory stays bounded
            self._begin()
        if not lines:
            return []
        pad = max(map(abs, PLACES))
        gap = [self.rows[_EDGE]] * pad
        flat, starts = list(gap), []
        for words in lines:
            starts.append(len(flat))
            flat += self.ids(words)
            flat += gap
        ids = np.array(flat, "i4")
        e = np.zeros((len(ids) - 2 * pad, len(LABELS)), "f4")
        for k, place in enumerate(PLACES):
            e += self.scores[ids[pad + place : len(ids) - pad + place], k]
        first, size = np.array(starts, int) - pad, np.array([len(w) for w in lines], int)
        inside = np.zeros(len(e) + 1, "i4")
        np.add.at(inside, first, 1)
        np.add.at(inside, first + size, -1)
        inside = np.cumsum(inside)[:-1] > 0
        # a token is none for certain if "none" beats all else by more than its moves, and turning
        # what is carried on after it into a beginning, could make up
        moves = self.moves[_ALLOWED]
        carried = np.r_[(e[:, _INNER] - e[:, _OUTER]).max(1)[1:], 0.0]
        certain = e[:, 0] - e[:, 1:].max(1) > 2 * float(moves.max() - moves.min()) + np.maximum(carried, 0)
        # between such tokens the runs of others are decoded on their own
        open_ = np.diff(np.r_[False, inside & ~certain, False].astype("i1"))
        begin, end = np.flatnonzero(open_ == 1), np.flatnonzero(open_ == -1)
        labels = np.zeros(len(e), "i1")
        edge = np.zeros(len(e) + 1, bool)
        edge[first], edge[first + size] = True, True
        order = np.argsort(end - begin, kind="stable")
        at = 0
        while at < len(order):
            stop, shortest = at + 1, end[order[at]] - begin[order[at]]
            while stop < len(order) and end[order[stop]] - begin[order[stop]] <= max(shortest * 1.3, shortest + 1) and (stop - at) * (end[order[stop]] - begin[order[stop]]) < 60_000:
                stop += 1
            some = order[at:stop]
            a, n = begin[some], end[some] - begin[some]
            steps = np.arange(n.max())
            within = steps < n[:, None]
            scores = np.zeros((len(some), len(steps), len(LABELS)), "f4")
            scores[within] = e[(a[:, None] + steps)[within]]
            scores[:, 0] += np.where(edge[a][:, None], START, self.moves[0])
            scores[np.arange(len(some)), n - 1] += np.where(edge[end[some]][:, None], 0, self.moves[:, 0])
            path = self._viterbi(scores, n)
            labels[(a[:, None] + steps)[within]] = path[within]
            at = stop
        some = np.add.reduceat(labels != 0, first, dtype=int) if len(first) else []
        return [labels[a : a + n] if k else np.zeros(0, "i1") for a, n, k in zip(first, size, some, strict=True)]

    def _viterbi(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(runs, steps) of label numbers of the best paths; steps beyond a run's size count for nothing."""
        n, longest, _ = e.shape
        back = np.zeros((n, longest, len(LABELS)), "i1")
        total = e[:, 0].copy()
        last = total.copy()
        for t in range(1, longest):
            step = total[:, :, None] + self.moves
            back[:, t] = step.argmax(1)
            total = step.max(1) + e[:, t]
            last = np.where((size > t)[:, None], total, last)
        path = np.zeros((n, longest), "i1")
        at = last.argmax(1)
        for t in range(longest - 1, -1, -1):
            inside = t < size
            path[:, t] = np.where(inside, at, 0)
            at = np.where(inside & (t > 0), back[np.arange(n), t, at], at)
        return path


# A mention is continued only by itself, and no line begins inside one.
_ALLOWED = np.array([[b == "O" or b[0] == "B" or a[1:] == b[1:] for b in LABELS] for a in LABELS])
_INNER = np.array([i for i, x in enumerate(LABELS) if x[0] == "I"])
_OUTER = np.array([LABELS.index("B" + LABELS[i][1:]) for i in _INNER])
START = np.where([x[0] == "I" for x in LABELS], -1e4, 0).astype("f4")


def _bare(f: str) -> str:
    return f.lower().lstrip("+ ")


def _features(f: str, written_as: str, known: set[str]) -> list[str]:
    names = features(f, written_as)
    if names[0].startswith("shape") and _bare(f) not in known:
        names = [x for x in names if not x.startswith("word=")] + ["new", f"new{names[0]}"]
    return names


def feature_ids(f: str, written_as: str, index: dict[str, int], known: set[str]) -> list[int]:
    return [index[x] for x in _features(f, written_as, known) if x in index]


def label(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], list[int]]:
    words, starts = tokens(text)
    out = []
    for w, s in zip(words, starts, strict=True):
        kind = "O"
        for t, a, b in spans:
            if a <= s < b:
                kind = ("B-" if s == a else "I-") + t
        out.append(LABELS.index(kind))
        del w
    return words, out


def _drawn(words: list[str], labels: list[int], r: random.Random) -> list[str]:
    """How a corpus would write each word: names mostly capitalised, others by their shape, some too rare to tell."""
    out = []
    for i, (w, k) in enumerate(zip(words, labels, strict=True)):
        bare = w.lstrip()
        inside = i and words[i - 1].lstrip()[-1:] not in ".:!?"
        if "ऀ" <= bare[:1] <= "ॿ":
            out.append(RARE)
        elif LABELS[k][2:] in ("name", "address"):
            out.append(CAPITAL if r.random() < 0.75 else RARE)
        elif bare[:1].isupper():
            out.append((CAPITAL if r.random() < 0.8 else RARE) if inside else r.choice((SMALL, SMALL, OUTSET, RARE)))
        else:
            out.append(SMALL if r.random() < 0.85 else RARE)
    return out


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 90, rate: float = 0.05, shrink: float = 1e-4, seed: int = 5) -> Field:
    """Maximum likelihood by Adam, the gradient from forward and backward sums over all lines at once."""
    data = [label(t, s) for t, s in rows]
    data = [d for d in data if d[0]]
    counts: dict[str, int] = {}
    for words, _ in data:
        for w in {_bare(w) for w in words}:
            counts[w] = counts.get(w, 0) + 1
    known = {w for w, n in counts.items() if n >= KNOWN}
    r = random.Random(seed)
    formed = [([(form(w), c) for w, c in zip(words, _drawn(words, labels, r), strict=True)], labels) for words, labels in data]
    data = formed
    forms = [(_EDGE, RARE), *sorted({f for fs, _ in data for f in fs})]
    number = {f: i for i, f in enumerate(forms)}
    index: dict[str, int] = {}
    for f in forms:
        for x in _features(*f, known):
            index.setdefault(x, len(index))
    ids = [feature_ids(*f, index, known) for f in forms]

    data.sort(key=lambda d: len(d[0]))
    pad, n_labels = max(map(abs, PLACES)), len(LABELS)
    groups = []
    for start in range(0, len(data), 400):
        part = data[start : start + 400]
        longest = max(len(w) for w, _ in part)
        x = np.zeros((len(part), longest + 2 * pad), int)
        y = np.zeros((len(part), longest), int)
        mask = np.zeros((len(part), longest), bool)
        for i, (words, labels) in enumerate(part):
            x[i, pad : pad + len(words)] = [number[w] for w in words]
            y[i, : len(words)] = labels
            mask[i, : len(words)] = True
        groups.append((x, y, mask))
    # what a feature counts at a place
    spelt = np.array([x.startswith(("end=", "begin=")) for x in index])
    named = np.array([x.startswith("word=") for x in index])
    count = np.stack([np.where(spelt & (abs(p) > SPELT_WITHIN) | named & (abs(p) > NAMED_WITHIN), 0.0, OWN if p == 0 else 1.0) for p in PLACES])[:, :, None].astype("f4")
    # far from a token most forms look alike: at each place those with the same features count as one
    places = []
    for k, place in enumerate(PLACES):
        alike: dict[tuple[int, ...], int] = {}
        of = np.array([alike.setdefault(tuple(i for i in f if count[k, i, 0]), len(alike)) for f in ids])
        at_feature = np.concatenate([np.array(f, int) for f in alike])
        at_form = np.repeat(np.arange(len(alike)), [len(f) for f in alike])
        order = np.argsort(at_feature, kind="stable")
        used, cuts = np.unique(at_feature[order], return_index=True)
        seen = []
        for x, y, mask in groups:
            own = of[x[:, pad + place : pad + place + y.shape[1]]]
            sort = np.argsort(own[mask], kind="stable")
            seen.append((own, sort, *np.unique(own[mask][sort], return_index=True)))
        places.append((len(alike), at_feature, np.searchsorted(at_form, np.arange(len(alike))), at_form[order], used, cuts, seen))
    w = np.zeros((len(PLACES), len(index), n_labels), "f4")
    moves = np.zeros((n_labels, n_labels), "f4")
    first = [np.zeros_like(w), np.zeros_like(moves)]
    second = [np.zeros_like(w), np.zeros_like(moves)]
    closed = np.where(_ALLOWED, 0, -1e4).astype("f4")
    for r in range(1, rounds + 1):
        # scores of forms: sums over their features
        scores = [np.add.reduceat((w[k] * count[k])[at], cuts, axis=0) for k, (_, at, cuts, *_) in enumerate(places)]
        g_form = [np.zeros((n, n_labels), "f4") for n, *_ in places]
        g_moves = np.zeros_like(moves)
        m = np.exp(moves) * _ALLOWED
        for g, (_, y, mask) in enumerate(groups):
            n, longest = y.shape
            e = np.zeros((n, longest, n_labels), "f4")
            for k in range(len(PLACES)):
                e += scores[k][places[k][6][g][0]]
            # forward and backward in linear space, each step scaled to sum to one
            seen = np.exp(e - e.max(2, keepdims=True))
            fwd, bwd = np.zeros_like(e), np.ones_like(e)
            scale = np.ones((n, longest), "f4")
            fwd[:, 0] = seen[:, 0] * np.exp(START)
            for t in range(longest):
                if t:
                    fwd[:, t] = np.where(mask[:, t, None], (fwd[:, t - 1] @ m) * seen[:, t], fwd[:, t - 1])
                scale[:, t] = np.where(mask[:, t], fwd[:, t].sum(1), 1)
                fwd[:, t] /= scale[:, t, None]
            for t in range(longest - 2, -1, -1):
                bwd[:, t] = np.where(mask[:, t + 1, None], ((seen[:, t + 1] * bwd[:, t + 1]) @ m.T) / scale[:, t + 1, None], 1)
            p = fwd * bwd * mask[:, :, None]
            p[np.arange(n)[:, None], np.arange(longest), y] -= mask
            flat = p[mask]
            for k in range(len(PLACES)):
                _, sort, forms_here, cuts = places[k][6][g]
                g_form[k][forms_here] += np.add.reduceat(flat[sort], cuts, axis=0)
            on = mask[:, 1:]
            after = (seen[:, 1:] * bwd[:, 1:] / scale[:, 1:, None])[on]
            g_moves += m * (fwd[:, :-1][on].T @ after)
            np.subtract.at(g_moves, (y[:, :-1][on], y[:, 1:][on]), 1)
        g_w = shrink * w
        for k, (_, _, _, by_feature, used, cuts, _) in enumerate(places):
            g_w[k, used] += np.add.reduceat(g_form[k][by_feature], cuts, axis=0) * count[k, used] / len(data)
        for i, (value, slope) in enumerate(((w, g_w), (moves, g_moves / len(data) * _ALLOWED))):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope * slope
            value -= rate * (1 - (r - 1) / rounds) * (first[i] / (1 - 0.9**r)) / (np.sqrt(second[i] / (1 - 0.99**r)) + 1e-7)
    return Field(index, w * count, moves + closed, known)


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on the labelled table, once a process."""
    return train(labelled_rows())


def lines_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines of a text; one that ends in a comma goes on in the next."""
    out: list[tuple[int, int]] = []
    start, at = 0, 0
    for line in text.split("\n"):
        end = at + len(line)
        at = end + 1
        if line.rstrip().endswith(","):
            continue
        out.append((start, end))
        start = at
    if start < at - 1 or (start < len(text)):
        out.append((start, len(text)))
    return [(a, b) for a, b in out if b > a]


def mentions(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int]]]:
    """(type, start, end) of the mentions in each text."""
    lines, where = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        for a, b in lines_of(text):
            words = _TOKEN.findall(text, a, b)
            if words:
                lines.append(words)
                where.append((i, a, b))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, a, b), path in zip(where, field.decode(lines), strict=True):
        at = np.flatnonzero(path)
        if not len(at):
            continue
        spans = [m.span() for m in _TOKEN.finditer(texts[i], a, b)]
        k = 0
        while k < len(at):
            j = k
            kind = LABELS[path[at[k]]][2:]
            while j + 1 < len(at) and at[j + 1] == at[j] + 1 and LABELS[path[at[j + 1]]] == f"I-{kind}":
                j += 1
            start, end = spans[at[k]][0], spans[at[j]][1]
            out[i].append((kind, start + (texts[i][start].isspace()), end))
            k = j + 1
    return out


def _corpus_field(notes: DataFrame, field: Field | None, text: str):  # noqa: ANN202
    """The field with the corpus's ways of writing words, broadcast: weights and tables of fixed sizes."""
    model = field or default_field()
    if model.words is None:
        model = model.of_corpus(written_words(notes.select(F.col(text).alias("text"))))
    return notes.sparkSession.sparkContext.broadcast(model)


def personal_mentions(notes: DataFrame, field: Field | None = None, *, key: str = "id", text: str = "note") -> DataFrame:
    """(key, pii_type, start_char, end_char): every mention of a person's data in the texts.

    Offsets are 0-based code points, the end exclusive. Null and empty texts give none; a
    repeated row counts once; a null key stays null. Texts are handled whole.
    """
    kind = notes.schema[key].dataType.simpleString()
    model = _corpus_field(notes, field, text)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 500):
                part = pdf.iloc[start : start + 500]
                found = mentions(part["text"].tolist(), model.value)
                rows = [(k, *m) for k, ms in zip(part["key"], found, strict=True) for m in ms]
                yield pd.DataFrame(rows, columns=["key", "pii_type", "start_char", "end_char"])

    plain = notes.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    return spread(plain).mapInPandas(find, f"key {kind}, pii_type string, start_char int, end_char int").distinct().withColumnRenamed("key", key)


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each mention replaced by its placeholder, the rest unchanged."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda x: x[1]):
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def redacted_notes(notes: DataFrame, field: Field | None = None, *, text: str = "note") -> DataFrame:
    """The notes, all columns kept, with each mention in ``text`` replaced by a typed placeholder."""
    model = _corpus_field(notes, field, text)

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        texts = [None if pd.isna(t) else t for t in column]
        found = mentions(texts, model.value)
        return pd.Series([t if t is None else redact(t, f) for t, f in zip(texts, found, strict=True)], dtype=object)

    return notes.withColumn(text, clean(F.col(text)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pii_type, start_char) of every mention in the notes."""
    # a place has one mention, so the rows stay distinct without the end
    return personal_mentions(table(spark, sf_dir, "synthetic_notes_medium")).select("id", "pii_type", "start_char")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, note): the notes with typed placeholders, one row per row of the table."""
    return redacted_notes(table(spark, sf_dir, "synthetic_notes_medium").select("id", "note"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
SQL: dict[str, str] = {}
