import random
import re
from pathlib import Path

import pandas as pd
import pytest

from folioflow.llm import labelled, personal


def _scores(field, held):
    hit = wrong = missed = 0
    for (_, truth), got in zip(held, personal.mentions([t for t, _ in held], field), strict=True):
        a, b = {x[:2] for x in truth}, {x[:2] for x in got}
        hit, wrong, missed = hit + len(a & b), wrong + len(b - a), missed + len(a - b)
    return hit / (hit + wrong), hit / (hit + missed)


def test_accuracy_on_templates_never_seen():
    running = labelled.templates()[0]
    kept, held = [x for i, x in enumerate(running) if i % 4], running[::4]
    field = personal.train(labelled.labelled_rows(lines=kept))
    r = random.Random(1234)
    body = [x for x in labelled.templates()[2] if x[-1] in ".?।"]
    rows = [labelled.fill(x, r, body) for _ in range(8) for x in held]
    # a corpus in which the words recur, names mostly capitalised and a quarter of them not at all
    corpus = []
    for text, spans in rows:
        for kind, a, b in spans:
            if kind in ("name", "address") and r.random() < 0.75:
                corpus += [f"we saw {text[a:b].title()}"] * 4
        rest = "".join(c for i, c in enumerate(text) if not any(a <= i < b for _, a, b in spans))
        corpus += [f"and {rest[:1].lower()}{rest[1:]}"] * 4
    known = field.of_corpus(personal.word_classes(personal.word_counts(pd.Series(corpus))))
    precision, recall = _scores(known, rows)
    print(precision, recall)
    assert precision > 0.9 and recall > 0.85, (precision, recall)


def test_no_wording_is_taken_from_the_notes():
    path = Path("/root/testdata/sf0.01/synthetic_notes_medium.parquet")
    if not path.exists():
        pytest.skip("no test data here")
    notes = "\n".join(pd.read_parquet(path, columns=["note"])["note"].dropna())
    parts = [x.strip() for lines in labelled.templates() for t in lines for x in re.split(r"\{\w+\}", t)]
    assert not [x for x in parts if len(x) >= 20 and x in notes]


def test_redaction_keeps_the_rest():
    field = personal.default_field()
    text = "Patient Name: Mr. Talven Morrik\nAge/Sex: 40/M\nAddress: Plot No. 3, Sector 19,\nOld Mill Street, Brenholt 950 000\nContact: +91 55525 67562\n\nHistory: Foley catheter removed on day 1."
    found = personal.mentions([text], field)[0]
    out = personal.redact(text, found)
    assert out == "Patient Name: Mr. [NAME]\nAge/Sex: 40/M\nAddress: [ADDRESS]\nContact: [PHONE]\n\nHistory: Foley catheter removed on day 1."
    assert personal.redact(text, []) == text


def test_viterbi_equals_brute_force():
    import itertools

    import numpy as np

    field = personal.default_field()
    lines = [["Dr", ".", " Ada", " Byron"], [" Call", " 5551234567", " now"], ["mild", " fever", " and", " pain"], [" A1234567"], [" Ada", "'", "s", " aunt"]]
    got = field.decode(lines)
    for words, path in zip(lines, got, strict=True):
        n = len(words)
        ids = [field.row(personal._EDGE)] * 4 + field.ids(words) + [field.row(personal._EDGE)] * 4
        e = np.array([sum(field.scores[ids[4 + t + p], k] for k, p in enumerate(personal.PLACES)) for t in range(n)])
        best = max(itertools.product(range(len(personal.LABELS)), repeat=n), key=lambda p: personal.START[p[0]] + sum(e[i, p[i]] for i in range(n)) + sum(field.moves[p[i - 1], p[i]] for i in range(1, n)))
        assert list(path) == (list(best) if any(best) else []), words
    assert any(len(p) for p in got) and field.decode([]) == []


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    schema = "id bigint, note string, key string, text string, pii_type string"
    line = "Contact: karvo.mensin@mail.example.org\n"
    rows = [(1, None, "k", "t", "p"), (2, "", None, None, None), (None, line, None, None, None), (3, line * 400, None, None, None), (4, line, None, None, None), (4, line, None, None, None)]
    got = personal.personal_mentions(spark.createDataFrame(rows, schema)).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add((r.pii_type, r.start_char))
    assert by[4] == {("email", 9)} and by[None] == {("email", 9)} and len(by[3]) == 400 and set(by) == {3, 4, None}
    clean = personal.redacted_notes(spark.createDataFrame(rows, schema))
    assert clean.columns == ["id", "note", "key", "text", "pii_type"]
    assert {r.note for r in clean.filter("id in (1, 2, 4)").collect()} == {None, "", "Contact: [EMAIL]\n"}
    assert personal.personal_mentions(spark.createDataFrame([], schema)).count() == 0
