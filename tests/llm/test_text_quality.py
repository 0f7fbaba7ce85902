import random

import pandas as pd

from folioflow.llm import languages as G
from folioflow.llm import leakage as L
from folioflow.llm import scans as S

WORDS = "river stone garden window bottle castle silver yellow market winter forest bridge candle doctor letter summer mother father orange purple animal button camera dinner engine farmer guitar hammer island jacket".split()


def passage(r, n=90):
    return " ".join(r.choice(WORDS) + (str(r.randint(1, 99)) if r.random() < 0.1 else "") for _ in range(n)).capitalize() + "."


def disturb(r, text):
    words = [w for w in text.split() if r.random() > 0.05]
    out = " ".join(w.upper() if r.random() < 0.2 else w for w in words)
    return out.replace("a", "@", 3).replace("o", "0", 4).replace(" ", "  ", 5).replace("i", "і", 3)


def test_leaks(spark):
    r = random.Random(5)
    held = [(f"c{i}", passage(r)) for i in range(30)]
    docs, truth = [], set()
    for i in range(120):
        body = passage(r, 150)
        if i % 3 == 0:
            c, p = held[i % 30]
            w = p.split()
            part = " ".join(w[: len(w) // 5]) if i % 2 else p if i % 4 else " ".join(w[20:75])
            body = body[:300] + "\n\n" + (disturb(r, part) if i % 4 else part) + " " + body[300:]
            if i % 2 == 0:
                truth.add((i, c))
        docs.append((i, body, "case", 1))
    docs += [(None, held[0][1], None, None), (500, None, None, None), (501, "", None, None), (502, passage(r, 20000) + held[3][1], None, None)]
    truth |= {(None, "c0"), (502, "c3")}
    df = spark.createDataFrame(docs, "doc_id bigint, text string, case_id string, key int")
    cases = spark.createDataFrame([*held, held[0], ("n", None), (None, "x" * 500), ("e", "")], "case_id string, passage string")
    got = {(x.doc_id, x.case_id) for x in L.leaked_passages(df, cases).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 1
    assert L.leaked_passages(df.limit(0), cases).count() == 0 and L.leaked_passages(df, cases.limit(0)).count() == 0


def test_leaks_of_passages_that_share_wording(spark):
    r = random.Random(7)
    one, two, half, stock = passage(r), passage(r), passage(r, 45), passage(r, 60)
    held = [("a", one), ("b", one), ("in", two), ("out", f"{two} {passage(r, 30)}"), ("x", f"{half} {passage(r, 45)}"), ("y", f"{passage(r, 45)} {half}")]
    held += [("s", f"{stock} {passage(r, 40)}"), ("t", f"{passage(r, 40)} {stock}")]
    leaks = [one, two, half, held[3][1], held[6][1], held[7][1]]
    bodies = [f"{passage(r, 60)} {x} {passage(r, 60)}" for x in leaks] + [f"{passage(r, 60)} {stock} {passage(r, 60)}" for _ in range(40)] + [passage(r, 120) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id bigint, text string")
    truth = {(0, "a"), (0, "b"), (1, "in"), (1, "out"), (2, "x"), (2, "y"), (3, "in"), (3, "out"), (4, "s"), (5, "t")}
    cases = spark.createDataFrame(held, "case_id string, passage string")
    for parts, keys in ((1, L.BROADCAST_KEYS), (7, L.BROADCAST_KEYS), (5, 0)):
        got = {(x.doc_id, x.case_id) for x in L.leaked_passages(docs.repartition(parts), cases.repartition(parts), broadcast_keys=keys).collect()}
        # a copy of s holds the stock wording of t, and the other way round: no leak of t's own words
        assert got == truth, (parts, got ^ truth)


def test_short_passages(spark):
    r = random.Random(3)
    held = [("a", "Capital of Alsace is it"), ("b", "Answer: blue-grey."), ("c", "no"), ("d", "seven mules")]
    docs = [(1, passage(r, 30) + " The CAPITAL of  Alsace, is it? " + passage(r, 30)), (2, "answer blue grey"), (3, passage(r, 40)), (4, "no"), (5, "Seven mules and more"), (6, "seven mu")]
    for keys in (L.BROADCAST_KEYS, 0):
        got = L.leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(held, "case_id string, passage string"), broadcast_keys=keys).collect()
        assert sorted((x.doc_id, x.case_id) for x in got) == [(1, "a"), (2, "b"), (5, "d")]


def test_candidates_reach_the_stated_recall():
    import numpy as np

    r = random.Random(11)
    held = [passage(r) for _ in range(150)]
    texts, case = [], []
    for c, whole in enumerate(held):
        for share in (0.4, 0.5, 0.7, 1.0):
            w = whole.split()
            n = int(np.ceil(share * len(w)))
            at = r.randint(0, len(w) - n)
            w = w[at : at + n]
            edited = "".join(x if r.random() > 0.05 else r.choice(["", r.choice("bcdfg"), x + r.choice("klmnp")]) for x in " ".join(w))
            texts += [f"{passage(r, 20)} {x} {passage(r, 20)}" for x in (" ".join(w), " ".join(r.choice(WORDS) if i % 8 == 3 else x for i, x in enumerate(w)), edited)]
            case += [c] * 3
    of, window, key, windows, anchor = L.passage_keys(held)
    assert not anchor.any()
    everything = np.full(1 << 10, 255, "u1")
    text, start, found = L.document_keys(texts, [], everything)
    both = pd.DataFrame({"key": found, "text": text, "start": start}).merge(pd.DataFrame({"key": key, "case": of, "window": window}), on="key")
    near = L.stretches(*[both[c].to_numpy() for c in ("text", "case", "start", "window")], windows, 0.1, 1200)
    have = set(zip(near["text"], near["case"], strict=True))
    p = L.patterns_of(held)
    stream, bounds = L.streams(texts)
    copies = L.verify(p, [stream[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], np.array(case), 0.35, 0.2, 1200)
    want, hit = len(copies), sum((k, case[k]) in have for k, _, _ in copies)
    assert want > 1000 and hit >= 0.99 * want, (hit, want)


def test_blocks_are_compared_only_where_they_can_be_near(monkeypatch):
    import numpy as np

    r = random.Random(23)
    letters = "".join(r.choice("abcdefghkmnp") for _ in range(3000))
    held = [passage(r) for _ in range(12)] + [letters[:700], letters[350:1000], letters[5:12], letters[20:50], "ab" * 60, "漢字" * 30 + letters[:90]]

    def edited(text, rate):
        return "".join(x if r.random() > rate else r.choice(["", r.choice("bcdfg"), x + r.choice("klmnp")]) for x in text)

    texts, case = [], []
    for c, whole in enumerate(held):
        for rate in (0, 0.03, 0.1, 0.16, 0.2, 0.3):
            half = len(whole) // 2
            texts += [
                passage(r, 40) + edited(whole, rate) + passage(r, 40),
                edited(whole[half:], rate) + passage(r, 60) + edited(whole[:half], rate),
                edited(whole[:half], rate) + edited(whole[:half], rate / 2),
                edited(whole[half // 2 : half + 30], rate),
                passage(r, 150),
            ]
            case += [c] * 5
    case = np.array(case)
    p = L.patterns_of(held)
    stream, bounds = L.streams(texts)
    pieces = [stream[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    pieces[-1] = pieces[-1][:0]
    order = np.argsort([len(x) for x in pieces], kind="stable")
    distances, cells, every = L._distances, [], 0

    def counted(p, blocks, texts, of):
        cells.append(sum(len(texts[i]) for i in of))
        return distances(p, blocks, texts, of)

    whole = []
    for x in order:
        blocks = np.arange(p.first[case[x]], p.first[case[x] + 1])
        whole.append((blocks, *distances(p, blocks, [p.symbols[pieces[x]]], np.zeros(len(blocks), int))))
        every += len(blocks) * len(pieces[x])
    monkeypatch.setattr(L, "_distances", counted)
    for far in (0.0001, 0.2, 0.3, 0.5, 1.0):
        for share, apart, size in ((0.0, 1200, 1 << 20), (0.35, 60, 1 << 14)):
            want = []
            for x, (blocks, d, place) in zip(order, whole, strict=True):
                copied, blocks = L._copied(d, place, p.block_length[blocks], far, L.BLOCK * 2 // 5, apart)
                want += [(int(x), copied, blocks)] if copied >= share else []
            cells.clear()
            monkeypatch.setattr(L, "CHARACTERS", size)
            assert L.verify(p, pieces, case, share, far, apart) == want
            if (far, share) == (0.2, 0.35):
                # few words, so that many places are near
                assert len(want) > 100 and 2 * sum(cells) < every, (len(want), sum(cells), every)


def test_edit_distances_are_exact():
    import numpy as np

    def brute(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    r = random.Random(1)
    text = "".join(r.choice("abc") for _ in range(60))
    p = L.patterns_of([text])
    other = "".join(r.choice("abc") for _ in range(80)) + text[10:40] + "cab"
    stream, _ = L.streams([other])
    own, _ = L.streams([text])
    d, _ = L._distances(p, np.arange(len(p.block_case)), [p.symbols[stream]], np.zeros(len(p.block_case), int))
    pieces = [own[s : s + L.BLOCK].tolist() for s in range(0, 60, L.BLOCK)]
    assert d.tolist() == [brute(x, stream.tolist()) for x in pieces]


def test_languages():
    notes = {
        "en": "The patient was seen with fever for two days. She said that the family asked for more time. It is not known whether this has been the cause.",
        "de": "Der Patient klagt seit zwei Tagen über Fieber. Bei der Untersuchung fanden wir keine Auffälligkeiten. Wir empfehlen eine Verlaufskontrolle nach einem Monat.",
        "fr": "Le patient présente une fièvre depuis deux jours. La patiente prend ce médicament chaque matin. Nous conseillons un contrôle dans un mois.",
        "es": "El paciente refiere fiebre desde hace dos días. La paciente toma esto cada mañana. Se recomienda una revisión en un mes.",
        "pt": "O paciente refere febre há dois dias. A paciente toma isto todas as manhãs. Recomenda-se uma nova consulta em um mês.",
        "hi": "मरीज को दो दिन से बुखार है। उन्हें कई साल से यह बीमारी है। हालत में सुधार हुआ।",
    }
    model = G.fit([v for v in notes.values() for _ in range(3)], [k for k in notes for _ in range(3)])
    assert {k: [s for s, _ in G.segments(v, model)] for k, v in notes.items()} == {k: [k] for k in notes}
    assert [s for s, _ in G.segments("Mareez ko do din se bukhar hai. Unko kai saal se yeh bimari hai aur woh roz dawai lete hain.", model)] == ["hi"]
    mixed = f"Patient Name: Ada Byron\nAge/Sex: 40/F\n\nHistory: {notes['en']}\nBefund: {notes['de']}"
    assert [s for s, _ in G.segments(mixed, model)] == ["en", "de"] and all(0 <= c <= 1 for _, c in G.segments(mixed, model))
    assert G.segments(None, model) == G.segments("  ", model) == []
    assert [G.language_code(x) for x in (None, " ", "UND", "eng", "en-IN", "Deutsch", "klingon")] == [None, None, None, "en", "en", "de", ""]


def test_narrow_margins_are_rejected(spark):
    en, de = "The patient was seen with fever for two days and was advised rest by the family.", "Der Patient klagt seit zwei Tagen über Fieber und Schmerzen in der Brust."
    model = G.fit([en, de] * 5, ["en", "de"] * 5)
    for foreign in ("Ο ασθενής ήρθε με πυρετό και πόνο στο στήθος.", "xqzv wklp trgh mnbv sdfg qwrt zxcv."):
        assert [s for s, _ in G.segments(foreign, model)] == [G.UNDECIDED]
    # without a decided segment a label is not called wrong; short sentences are judged with the rest
    df = spark.createDataFrame([(1, "xqzv wklp trgh mnbv.", "fr"), (2, f"{en} Ja. {en}", "en"), (3, de, None)], "id bigint, note string, language string")
    assert [(r.id, r.lang) for r in G.doubtful_notes(G.note_languages(df, model)).collect()] == [(3, "de")]
    assert G.sentences("Seen by all. Muito obrigado.") == ["Seen by all.", "Muito obrigado."]


def test_language_frame(spark):
    schema = "id bigint, note string, language string, key string, label string"
    en, de = "The patient was seen with fever for two days and was advised rest.", "Der Patient klagt seit zwei Tagen über Fieber und Schmerzen in der Brust."
    rows = [(1, en, "en", "k", "l"), (2, en, None, None, None), (3, en, "de", None, None), (4, f"{en} {de}", "en", None, None), (5, None, "en", None, None), (6, "", None, None, None), (3, en, "de", None, None), (None, de, "und", None, None), (7, f"{en} " * 2000, "eng", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = G.doubtful_notes(G.note_languages(df, G.fit_on(df))).collect()
    assert sorted((r.id or -1, r.segment_no, r.lang) for r in got if r.id) == [(2, 1, "en"), (3, 1, "en"), (4, 1, "en"), (4, 2, "de")]
    empty = spark.createDataFrame([], schema)
    assert G.note_languages(empty, G.fit_on(empty)).count() == 0


def test_scan_distance_and_lines():
    assert S.scan_distance("than", "thari") == 0.4 and S.scan_distance("earlier", "e@rlier") == 0.4 and S.scan_distance("hours", "hour") == 1
    assert S.fold_line("Bluewater Hospital - Notes 2020    p. 7") == S.fold_line("BLUEWATER Hosp!tal - Nofes 2020    p. 12")
    assert [S.page_number(x) for x in ("Page 3 of 9", "- 12 -", "[4]", "iv", "P a g e  7", "Bed 3 / 9", "History", "54")] == [(3, True), (12, True), (4, True), (4, False), (7, True), None, None, (54, False)]


def test_two_misread_letters_apart(spark):
    assert all(S.variants(a) & S.variants(b) for a, b in (("treatment", "trcatmcnt"), ("modern", "rnodem"), ("hand", "liancl")))
    assert all(a.translate(S._ALIKE_TABLE) == b.translate(S._ALIKE_TABLE) for a, b in S.CONFUSED)
    assert S.scan_distance("electroencephalogram", "clectroencephalograrn") == 0.8
    words = spark.createDataFrame([("treatment", 900), ("trcatmcnt", 1), ("electroencephalogram", 500), ("clectroencephalograrn", 1), ("garden", 800)], "word string, n bigint")
    got = {r.word: [x.repair for x in r.repairs] for r in S.corrections(words, 2202).collect()}
    assert got == {"trcatmcnt": ["treatment"], "clectroencephalograrn": ["electroencephalogram"]}


def test_scan_noise(spark):
    r = random.Random(9)
    body = lambda: " ".join(r.choice(WORDS) for _ in range(9))
    chunks, want = [], set()
    for d in range(6):
        for page in range(1, 6):
            lines = [f"North Hospital | Log 20{d}0", *[body() for _ in range(8)], f"Page {page} of 5"]
            if page == 2:
                lines[0] = lines[0].replace("i", "!").replace("e", "c")
                lines[3] = body() + " gar-"
                lines[4] = "den " + body()
                lines[5] = body() + " wint" + "cr"
                lines[6] = body() + " silver 1O5"
                want |= {(f"{d}-2", "hyphen", 3), (f"{d}-2", "misread", 5), (f"{d}-2", "misread", 6)}
            if page == 4:
                lines[8] = body() + " cam-"
                lines[5] = body() + " half-"
                lines[6] = "yellow " + body()
                want.add((f"{d}-4", "hyphen", 8))
            if page == 5:
                lines[1] = "era " + body()
            want |= {(f"{d}-{page}", "running_line", 0), (f"{d}-{page}", "page_number", 9)}
            chunks.append((f"{d}-{page}", f"doc{d}", page - 1, [page], "\n".join(lines), "x"))
    chunks.append(("flat", "doc0", 9, [6], "half-yellow half-yellow " * 30, "x"))
    chunks += [chunks[0], ("digital", "doc9", 0, [1], "Page 1\nwintcr", "x"), ("null", "doc1", 8, [6], None, None), ("none", "doc1", 9, None, "", None)]
    c = spark.createDataFrame(chunks, "chunk_id string, document_id string, chunk_index int, page_numbers array<int>, text string, word string")
    m = spark.createDataFrame([(f"doc{d}", "scanned") for d in range(5)] + [("doc5", None), ("doc9", "digital")], "document_id string, source_type string")
    v = spark.createDataFrame([("doc5", 1, True)], "document_id string, page_number int, confidence_valid boolean")
    got = {tuple(x) for x in S.line_noise(c, m, v)["noise"].select("chunk_id", "noise_kind", "line_no").collect() if x.chunk_id != "flat"}
    assert got == want
    mended = {r.chunk_id: r.text for r in S.repaired_paragraphs(c, m, v).orderBy("chunk_id", "paragraph_no").collect()}
    assert "garden " in mended["0-2"] and " winter " in mended["0-2"] and "silver 105" in mended["0-2"] and "half-yellow" in mended["0-4"] and "Hosp" not in mended["0-2"] and "Page" not in mended["0-2"]
    empty = S.line_noise(c.limit(0), m.limit(0), v.limit(0))["noise"]
    assert empty.count() == 0


def test_long_words_and_context(spark):
    import numpy as np

    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    assert S.scan_distance(long, long.replace("i", "!", 1)) == 0.4 and S.scan_distance("a" * 5000 + "e", "a" * 5000 + "c") == 0.4
    words = spark.createDataFrame([(long, 9), (long.replace("i", "!", 1), 1)], "word string, n bigint")
    assert [(r.word, r.repairs[0].repair) for r in S.corrections(words, 1000).collect()] == [(long.replace("i", "!", 1), long)]
    # of two repairs that are equally near the word before decides
    shape = "chunk_id string, line_no int, raw string, before string, repairs array<struct<repair:string,cost:double,m:bigint>>, part int"
    repairs = [{"repair": "dear", "cost": 0.4, "m": 900}, {"repair": "door", "cost": 0.4, "m": 80}, {"repair": "deaf", "cost": 0.8, "m": 9000}]
    rows = [("a", 1, "d3ar", "my", repairs, 0), ("b", 2, "D3ar", "the", repairs, 0), ("c", 3, "1O5", "of", [], 0)]
    table = np.zeros(S.BIGRAM_BUCKETS, "f4")
    table[S._bucket("my", "dear")], table[S._bucket("the", "door")], table[S._bucket("the", "deaf")] = 40, 30, 99
    assert [r.repair for r in S.choose_repairs(spark.createDataFrame(rows, shape), table).orderBy("chunk_id").collect()] == ["dear", "Door", "105"]
    chunk = spark.createDataFrame([("d", 0, "c", [1], "my dear, my DEAR friend\nand my\ndear one")], "document_id string, chunk_index int, chunk_id string, page_numbers array<int>, text string")
    noise = spark.createDataFrame([], "chunk_id string, line_no int, noise_kind string")
    marks = S._marks(chunk, noise, {"my", "and", "one", "friend", "dear"}, {"dear"}).filter("mark = 'pair'").collect()
    assert [(r.chunk_index, r.line_no) for r in marks] == [(S._bucket("my", "dear"), 3)]


def test_paragraphs():
    lines = ["Plan", "The first line of a paragraph is long and it has a bro-", "Running head 12", "ken word in it, and m0re.", "", "A second paragraph that stands alone here for once."]
    got = S.paragraphs_of("\n".join(lines), {2}, {1}, {3: [("m0re", "more")]})
    assert got == [("Plan", False), ("The first line of a paragraph is long and it has a broken word in it, and more.", False), (lines[5], False)]
    assert S.paragraphs_of("ends in a bro-", set(), {0}, {}) == [("ends in a bro", True)] and S.paragraphs_of("", set(), set(), {}) == []
