"""Missing or wrong language labels, by compression.

Text is compressed with the raw-content zstandard dictionary of each language; the language
whose dictionary leaves the least bytes has seen most of its words. Notes are taken sentence by
sentence: the sizes are the costs of a sequence of languages, a change costs extra, so a
sentence whose margin is narrow goes with its neighbours and a segment is a run of one language.

The dictionaries are fitted on the driver from a bounded sample of labelled notes. Labels are
not trusted: a note is used only if short seed texts, and then the dictionaries of the round
before, agree with its label and find none of its sentences plainly in another language.
Words that several languages use about alike (names, places, drugs) tell nothing and are left out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.runtime import spread, table

#: Rows of the labelled sample that the dictionaries are fitted on, and bytes of a dictionary: their bounds.
SAMPLE_ROWS = 1500
DICTIONARY_BYTES = 100_000
#: Bytes by which a sentence must be behind for its note to count as mixed when the dictionaries are fitted.
MIXED = 5.0
#: Bytes that a change of language within a note must save.
CHANGE_COST = 7.0
#: A segment is rejected if the next language takes fewer than so many bytes more, or less than this share of its own size.
REJECT_BYTES, REJECT_SHARE = 2.0, 0.04
UNDECIDED = "und"
LANGUAGES = ("en", "hi", "fr", "de", "es", "pt")
# Spellings of the languages' names; a region or script after a dash is ignored.
NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglês",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "fr": "fr fra fre french français francais französisch francés",
    "de": "de deu ger german deutsch allemand alemán",
    "es": "es spa spanish español espanol castellano spanisch espagnol",
    "pt": "pt por portuguese português portugues portugiesisch portugais",
}
_CODE = {spelling: code for code, spellings in NAMES.items() for spelling in spellings.split()}
_MISSING = ("", "und", "unknown", "none", "null", "mul", "zxx", "xx", "n/a", "-")
# A few lines of each language (Hindi in both scripts) to begin with.
SEEDS = {
    "en": "The patient was seen with fever and pain in the chest for two days, and there was no history of it. She said that the family asked for more time. "
    "It is not known whether this has been the cause, but he will return to the clinic after one week if they have any of these. Blood pressure was normal at rest. "
    "We advised him to take the tablets with his meals. Which of them were given before? Of those who had been followed, only some needed this within three months, although most kept using it.",
    "hi": "मरीज को दो दिन से बुखार और सीने में दर्द की शिकायत है। उन्हें कई साल से यह बीमारी है और वे रोज दवा लेते हैं। परिवार को समझाया गया कि एक हफ्ते बाद फिर से दिखाना है। "
    "जाँच में कोई बात नहीं मिली, पर खाँसी अभी भी है। रात में उल्टी और चक्कर दोनों बढ़ गए थे। हालत में सुधार हुआ।",
    "hi_latn": "mareez ko do din se bukhar aur seene mein dard ki shikayat hai. unko kai saal se yeh bimari hai aur woh roz dawai lete hain. parivar ko samjhaya gaya ki ek hafte baad phir se dikhana hai. "
    "jaanch mein koi baat nahi mili, par khansi abhi bhi hai. raat mein ulti aur chakkar dono badh gaye the. ghar par dawa li lekin aaram nahi mila. haalat mein sudhar hua.",
    "fr": "Le patient présente une fièvre et des douleurs depuis deux jours, sans signe de gravité. La patiente est suivie pour une maladie et prend ce médicament chaque matin. "
    "L'examen ne retrouve pas d'anomalie, mais la toux persiste après une semaine. Un traitement a été débuté pour une durée de trois jours. Nous conseillons un contrôle dans un mois et une surveillance à domicile. Il dit qu'il ne dort pas avec cela. Le service a été prévenu, car son état durait malgré les soins. Parmi les malades, trois ont reçu ceci pendant six heures chez eux.",
    "de": "Der Patient klagt seit zwei Tagen über Fieber und Schmerzen in der Brust. Die Patientin hat seit Jahren eine Krankheit und nimmt täglich ein Mittel ein. Bei der Untersuchung fanden wir keine Auffälligkeiten, "
    "obwohl Husten beschrieben wurde. Die Behandlung wurde nach einer Woche beendet, weil Übelkeit auftrat. Wir empfehlen eine Verlaufskontrolle nach einem Monat. Wegen dieser Beschwerden blieb er drei Nächte auf der Station. Das Bild zeigte keinen Befund, und die Entlassung wurde vorbereitet. Der Blutdruck lag bei normalen Werten. Von den Kranken der Abteilung erhielten einige täglich etwas davon, wobei es verschwand.",
    "es": "El paciente refiere fiebre y dolor en el pecho desde hace dos días. La paciente tiene una enfermedad y toma esto cada mañana. En la exploración no se encuentran hallazgos, pero la tos continúa después de una semana. "
    "Se inició tratamiento durante tres días y el dolor mejoró. Se recomienda una revisión en un mes y control de la tensión. La radiografía mostró una imagen normal, según el servicio de guardia. El hermano también tuvo mareos hace seis horas. Su hija vive con él y responde al teléfono. ¿Cuándo empezó con ello?",
    "pt": "O paciente refere febre e dor no peito há dois dias. A paciente tem uma doença e toma isto todas as manhãs. No exame não foram encontradas alterações, mas a tosse continua depois de uma semana. "
    "Iniciou-se tratamento durante três dias e a dor melhorou. Recomenda-se uma nova consulta em um mês e controle da pressão. A radiografia mostrou uma imagem normal, segundo a equipe de plantão. O irmão também teve tonturas há seis horas. A filha dele mora com ele e atende o telefone. Quando começou com isso?",
}

_LABEL = re.compile(r"^[^\W\d_][^:.!?।\n]{0,40}:\s*")
_SENTENCE = re.compile(r"(?<=[.!?।])[\"'”»)]*\s+(?=[\"“«¿¡(]?[^\W_a-zß-öø-ÿ])|(?<=।)\s*")
_ABBREVIATION = re.compile(r"\b(?:Dr|Dra|Mr|Mrs|Ms|Sr|Sra|Smt|Shri|Prof|Hr|Fr|M|Mme|No|Nr|St|[A-Z])\.\s*$")
_TERMINAL = re.compile(r"[.!?।][\"'”»)]*\s*$")
_WORD = re.compile(r"[^\W\d_]{2,}|[ऀ-ॿ]+")
_MARKS = ".,;:!?()'’-"
_NOISE = re.compile(r"\S*(?:@|\(at\))\s?\S+|[\d०-९]+|[_/\\|#*+=<>()\[\]\"]+")


def language_code(label: str | None) -> str | None:
    """The code of a label in any spelling; '' if it names none of the languages, None if it is missing."""
    if label is None or (isinstance(label, float) and np.isnan(label)):
        return None
    plain = label.strip().lower()
    if plain in _MISSING:
        return None
    return _CODE.get(re.split(r"[-_ (]", plain)[0], "")


def sentences(note: str, least: int = 1) -> list[str]:
    """The sentences of at least so many words of a note, without header lines, section labels and lines of numbers."""
    lines: list[str] = []
    for line in note.split("\n"):
        line = line.strip()
        if line and lines and lines[-1] and lines[-1][-1] in ",-" and not _LABEL.match(line):
            lines[-1] += " " + line
        else:
            lines.append(line)
    out = []
    for line in lines:
        body = _LABEL.sub("", line)
        if not _TERMINAL.search(body) and (body != line or len(_WORD.findall(body)) < 5):
            continue
        parts: list[str] = []
        for part in _SENTENCE.split(body):
            if parts and _ABBREVIATION.search(parts[-1]):
                parts[-1] += " " + part
            else:
                parts.append(part)
        out += [p for p in parts if len(_WORD.findall(p)) >= least]
    return out


def squeeze(text: str) -> bytes:
    """What of a sentence tells its language: lower case, numbers and signs left out."""
    return re.sub(r"\s+", " ", _NOISE.sub(" ", text.lower())).strip().encode()


class Dictionaries:
    """One raw-content dictionary a language; sizes of texts under each of them."""

    def __init__(self, contents: dict[str, bytes], neutral: frozenset[str] = frozenset(), level: int = 3):
        self.contents, self.neutral, self.level = contents, neutral, level
        self.names = list(contents)
        self.codes = [n.partition("_")[0] for n in self.names]
        self._open()

    def _open(self) -> None:
        import zstandard as z

        self.compressors = []
        for content in self.contents.values():
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            self.compressors.append(z.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.seen: dict[bytes, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("compressors", "seen")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def sizes_of(self, sentence: str) -> np.ndarray:
        """``sizes`` of a sentence without its neutral words."""
        text = squeeze(sentence)
        if self.neutral:
            text = " ".join(w for w in text.decode().split(" ") if w.strip(_MARKS) not in self.neutral).encode()
        return self.sizes(text)

    def sizes(self, text: bytes) -> np.ndarray:
        """Compressed bytes under each language (the better of its scripts)."""
        known = self.seen.get(text)
        if known is None:
            each: dict[str, int] = {}
            for code, compressor in zip(self.codes, self.compressors, strict=True):
                n = len(compressor.compress(text))
                each[code] = min(n, each.get(code, n))
            known = np.array([each[c] for c in LANGUAGES], "f4")
            if len(self.seen) >= 100_000:  # repeated sentences are compressed once; memory stays bounded
                self.seen.clear()
            self.seen[text] = known
        return known


def neutral_words(kept: dict[str, Counter[bytes]]) -> frozenset[str]:
    """Words of no language: names, places and drugs, which several languages use about alike."""
    seen: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for name, texts in kept.items():
        total = sum(texts.values()) or 1
        for text, n in texts.items():
            for word in set(text.decode().split(" ")):
                seen[word.strip(_MARKS)][name.partition("_")[0]] += n / total
    return frozenset(w for w, by in seen.items() if len(by) >= 2 and max(by.values()) < 0.75 * sum(by.values()))


def _content(name: str, texts: Counter[bytes], seed: bytes, neutral: frozenset[str]) -> bytes:
    """Sentences that bring new pairs of words, the most frequent ones last, next to the text to compress."""
    pairs: set[tuple[str, str]] = set()
    lines, size = [], len(seed)
    for text, _ in sorted(texts.items(), key=lambda x: (-x[1], x[0])):
        words = [w for w in text.decode().split(" ") if w.strip(_MARKS) not in neutral and not (name == "hi" and w.isascii())]
        new = set(zip(words, words[1:], strict=False)) - pairs
        if not new:
            continue
        pairs |= new
        line = " ".join(words).encode()
        size += len(line) + 1
        if size > DICTIONARY_BYTES:
            break
        lines.append(line)
    return b"\n".join([seed, *reversed(lines)])


def fit(notes: list[str], labels: list[str | None]) -> Dictionaries:
    """Dictionaries from labelled notes, labels checked in every round."""
    rows = [(found, code) for note, label in zip(notes, labels, strict=True) if note and (code := language_code(label)) and (found := sentences(note, 3))]
    seeds = {name: squeeze(text) for name, text in SEEDS.items()}
    now = Dictionaries(seeds)
    for _ in range(3):
        kept: dict[str, Counter[bytes]] = defaultdict(Counter)
        for found, code in rows:
            sizes = np.stack([now.sizes_of(x) for x in found])
            if LANGUAGES[int(sizes.sum(0).argmin())] != code:
                continue
            behind = sizes[:, LANGUAGES.index(code)] - sizes.min(1)
            if (behind >= MIXED).any():
                continue
            for sentence, gap in zip(found, behind, strict=True):
                if gap <= 1:
                    text = squeeze(sentence)
                    kept["hi_latn" if code == "hi" and text.isascii() else code][text] += 1
        neutral = neutral_words(kept)
        now = Dictionaries({name: _content(name, kept[name], seed, neutral) for name, seed in seeds.items()}, neutral)
    return now


def segments(note: str | None, model: Dictionaries, change: float = CHANGE_COST) -> list[tuple[str, float]]:
    """(language, confidence) of each segment of a note, in reading order; ``UNDECIDED`` where the margin is narrow."""
    if not note or not note.strip():
        return []
    units = sentences(note) or [line for line in note.split("\n") if _WORD.search(line)]
    if not units:
        return []
    cost = np.stack([model.sizes_of(u) for u in units])
    total, back = cost[0].copy(), []
    for row in cost[1:]:
        best = int(total.argmin())
        moved = total[best] + change < total
        back.append(np.where(moved, best, np.arange(len(LANGUAGES))))
        total = np.where(moved, total[best] + change, total) + row
    path = [int(total.argmin())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    path.reverse()
    out: list[tuple[str, float]] = []
    start = 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[start]:
            sizes = cost[start:i].sum(0)
            rest = np.delete(sizes, path[start]).min()
            margin = float(rest - sizes[path[start]])
            confidence = min(1.0, max(0.0, 0.5 + margin / float(rest)))
            out.append((UNDECIDED if margin < max(REJECT_BYTES, REJECT_SHARE * float(rest)) else LANGUAGES[path[start]], confidence))
            start = i
    return out


def fit_on(notes: DataFrame, text: str = "note", label: str = "language", key: str = "id", sample_rows: int = SAMPLE_ROWS) -> Dictionaries:
    """``fit`` on at most ``sample_rows`` labelled rows, taken by a hash of their key."""
    labelled = notes.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    share = max(1, labelled.count() // max(1, sample_rows * 9 // 10))
    some = labelled.filter(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select(F.col(text).alias("text"), F.col(label).alias("label")).limit(sample_rows).toPandas()
    return fit(some["text"].tolist(), some["label"].tolist())


def note_languages(notes: DataFrame, model: Dictionaries, *, key: str = "id", text: str = "note", label: str = "language") -> DataFrame:
    """(key, label_code, segment_no, lang, confidence): the segments of every note, numbered from 1.

    ``label_code`` is the code of the label as delivered, '' if it names no known language and
    null if it is missing. Null and blank notes have no segments; a note without sentences is
    judged by its lines. A repeated key counts once, the first row by hash of the text and label; rows with
    a null key are kept apart by their text. A confidence near 0.5 says that another language
    fits about as well.
    """
    kind = notes.schema[key].dataType.simpleString()
    shared = notes.sparkSession.sparkContext.broadcast(model)  # a few dictionaries of DICTIONARY_BYTES

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                {
                    "key": pdf["key"],
                    "of": pdf["of"],
                    "label_code": [language_code(x) for x in pdf["label"]],
                    "found": [[{"lang": lang, "confidence": conf} for lang, conf in segments(note, shared.value)] for note in pdf["text"]],
                }
            )

    rows = notes.select(F.col(key).alias("key"), F.coalesce(F.md5(F.col(text)), F.lit("")).alias("of"), F.col(text).alias("text"), F.col(label).alias("label"))
    judged = spread(rows).mapInPandas(judge, f"key {kind}, of string, label_code string, found array<struct<lang:string,confidence:double>>")
    # what is compared and shuffled is the outcome, not the note
    once = (
        judged.withColumn("apart", F.when(F.col("key").isNull(), F.col("of")))
        .groupBy("key", "apart")
        .agg(F.min(F.struct("of", "label_code", "found")).alias("row"))
    )
    return once.select("key", "row.label_code", F.posexplode("row.found").alias("at", "x")).select(
        F.col("key").alias(key), "label_code", (F.col("at") + 1).alias("segment_no"), F.col("x.lang").alias("lang"), F.col("x.confidence").alias("confidence")
    )


def doubtful_notes(judged: DataFrame, key: str = "id") -> DataFrame:
    """(key, segment_no, lang) of notes whose label is missing or wrong or that mix languages.

    Of ``note_languages`` the decided segments, neighbours of one language around an undecided
    one as one. A note without any decided segment keeps its label, whatever that is.
    """
    kept = judged.filter(F.col("lang") != UNDECIDED)
    # a note has few segments: those of one note come together in one row
    runs = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("segment_no", "lang"))).alias("all"), F.first("label_code").alias("given"))
    langs = F.transform("all", lambda x: x["lang"])
    merged = F.filter(langs, lambda x, i: (i == 0) | (x != F.get(langs, i - 1)))
    wanted = runs.withColumn("langs", merged).filter((F.size("langs") > 1) | F.col("given").isNull() | (F.col("given") != F.col("langs")[0]))
    return wanted.select(key, F.posexplode("langs").alias("at", "lang")).select(key, (F.col("at") + 1).alias("segment_no"), "lang")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "synthetic_notes_medium")
    return note_languages(notes, fit_on(notes))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, segment_no, lang) of notes with a missing or wrong label or several languages."""
    return doubtful_notes(_judged(spark, sf_dir))


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, segment_no, lang, confidence) of every note, ``und`` where the languages come out too close."""
    return _judged(spark, sf_dir).select("id", "segment_no", "lang", F.round("confidence", 4).alias("confidence"))


QUERIES = {"p7_found": p7_found, "p7_segments": p7_segments}
SQL: dict[str, str] = {}
