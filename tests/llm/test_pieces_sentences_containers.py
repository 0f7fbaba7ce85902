import math

from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import containers as B
from folioflow.llm import pieces as S
from folioflow.llm import sentences as N


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. \n\fÄ9漢#", max_size=900), st.integers(20, 120), st.integers(0, 15))
def test_pieces_round_trip(text, limit, overlap):
    spans = S.split_spans(text, limit, overlap)
    assert all(b - a <= limit for a, b in spans)
    assert "".join(text[(a + overlap if i else a) : b] for i, (a, b) in enumerate(spans)) == text or spans[0][1] <= overlap


def test_pieces_cut_at_boundaries_and_pages():
    text = "Intro\n\n" + "First sentence here. " * 4 + "\n\nPlan\n\n" + "Second part text. " * 4 + "\fNext page begins. " + "More words follow. " * 3
    spans = S.split_spans(text, 110, 10)
    assert all(text[b - 1] in " \n\f" for _, b in spans[:-1])
    places = S.place(text, spans, [4, 5], 7)
    assert places[0] == ([4], 7) and places[-1][0][-1] == 5
    assert S.place("ab\fcd", [(0, 5)], None, None) == [(None, None)]


def test_sections_nest_and_keep_apart():
    part = "Some words of the body follow here. " * 3
    text = f"# One\n\n{part}\n\n## One A\n\n{part}\n\n## One B\n\n{part}{part}\n\n# Two\n\n{part}"
    got = [text[a:b] for a, b in S.split_spans(text, 280, 0)]
    assert [x.split("\n")[0] for x in got] == ["# One", "## One B", "# Two"]
    tree = S.parse(text)
    assert [c.rank for c in tree.children if text[c.start] == "#"] == [1.0, 1.0] and [text[c.start : c.start + 8].strip() for c in tree.children[-2].children][1:] == ["## One A", "## One B"]
    # with room for less, sections are not joined across their bounds
    for piece in (text[a:b] for a, b in S.split_spans(text, 150, 0)):
        assert "#" not in piece.lstrip("#").split("\n", 1)[-1]


def test_lists_tables_and_markup_are_parsed():
    items = "".join(f"- item {i} with words\n  - below {i} more words\n" for i in range(12))
    got = [items[a:b] for a, b in S.split_spans(items, 120, 0)]
    assert all(x.startswith("- item") for x in got) and "".join(got) == items
    rows = "Before the table.\n\n" + "".join(f"| cell {i} | value {i} |\n" for i in range(20))
    assert all(x.startswith(("|", "Before")) and x.rstrip().endswith(("|", ".")) for x in (rows[a:b] for a, b in S.split_spans(rows, 100, 0)))
    html = "<ul>" + "".join(f"<li><p>text {i} of it</p><p>and more {i}</p></li>" for i in range(12)) + "</ul>"
    assert all(x.startswith(("<li>", "<ul>")) for x in (html[a:b] for a, b in S.split_spans(html, 150, 0)))
    numbered = "1 Scope\nBody of it is here.\n1.1 Detail\nMore of it is here now.\n2 Rest\nThe end of it is near."
    assert [numbered[a:b].split("\n")[0] for a, b in S.split_spans(numbered, 70, 0)] == ["1 Scope", "2 Rest"]


def test_long_blank_runs_and_unbroken_text():
    text = "Title\n" + " " * 3000 + "\nBody words. " * 50 + "x" * 900
    spans = S.split_spans(text, 200, 20)
    assert all(b - a <= 200 for a, b in spans) and "".join(text[(a + 20 if i else a) : b] for i, (a, b) in enumerate(spans)) == text


def test_pieces_frame(spark):
    schema = "chunk_id string, text string, page_numbers array<int>, start_char_in_page int, key string, piece string"
    rows = [("a", "x" * 5000, [1], 3, "k", "p"), ("a", "x" * 5000, [1], 3, "k", "p"), (None, "y " * 1500, None, None, None, None), ("b", "short", [1], 0, None, None), ("c", None, [1], 0, None, None), ("d", "", [1], 0, None, None)]
    got = S.split_oversized(spark.createDataFrame(rows, schema)).collect()
    a = sorted([r for r in got if r.chunk_id == "a"], key=lambda r: r.piece_no)
    assert [len(r.text) for r in a] == [1936, 2000, 1192] and a[1].start_char_in_page == 3 + 1936 - 64
    assert {r.chunk_id for r in got} == {"a", None} and S.split_oversized(spark.createDataFrame([], schema)).count() == 0


def units(text):
    return [text[a:b] for a, b in N.sentences(text)]


def test_sentences_of_many_scripts():
    assert units('Dr. Holm saw 5.1 kg of it at 10 p.m. The end. "Is it safe?" was the first thing. "It came at noon. By evening I could not walk," said she. pH was 7.3.') == [
        "Dr. Holm saw 5.1 kg of it at 10 p.m.", "The end.", '"Is it safe?" was the first thing.', '"It came at noon. By evening I could not walk," said she.', "pH was 7.3.",
    ]
    assert units("Am 5. Mai wurde z. B. etwas gegeben. „Darf ich nach Hause?“ fragte sie.") == ["Am 5. Mai wurde z. B. etwas gegeben.", "„Darf ich nach Hause?“ fragte sie."]
    assert units("Il répond : « Je dors mal. » On note cela. ¿Cuándo empezó? ¡No pare!") == ["Il répond : « Je dors mal. »", "On note cela.", "¿Cuándo empezó?", "¡No pare!"]
    assert units("她说：“我睡不好。”“可以回家吗？”家属问。请停药！") == ["她说：“我睡不好。”", "“可以回家吗？”家属问。", "请停药！"]
    assert units("「もう帰ってもいいですか。」と患者は尋ねた。本当か？") == ["「もう帰ってもいいですか。」と患者は尋ねた。", "本当か？"]
    assert units("उन्होंने कहा, \"अब ठीक हूँ।\" मरीज को दर्द है।") == ["उन्होंने कहा, \"अब ठीक हूँ।\"", "मरीज को दर्द है।"]
    assert units("ผู้ป่วยได้รับยา 68 มก. วันละสองครั้ง ญาติขอให้นัดติดตามอาการอีกครั้ง") == ["ผู้ป่วยได้รับยา 68 มก. วันละสองครั้ง", "ญาติขอให้นัดติดตามอาการอีกครั้ง"]


def test_long_spans_are_not_cut():
    authors = ", ".join(f"{chr(65 + i % 26)}. {chr(65 + i % 24)}. Name{chr(97 + i % 26)}" for i in range(90))
    text = f"Seen by {authors} and nobody else. Then it ended."
    assert [text[a:b] for a, b in N.sentences(text)] == [text[:-15], "Then it ended."]
    dotted = "a." * 3000 + "b"
    assert N.sentences(f"Code {dotted} ends here. Next one.")[-1][0] == len(dotted) + 17


def test_marks_of_other_scripts():
    for text in ("هذا أول. كيف حالك؟ نعم.", "یہ پہلا ہے۔ یہ دوسرا ہے۔ بس۔", "ሰላም ነው። እንዴት ነህ፧ ደህና።", "នេះមួយ។ នេះពីរ។ នេះបី។"):
        assert len(N.sentences(text)) == 3, text
    assert len(N.sentences("ผู้ป่วยมีไข้สูงมาก และ ไอแห้งตลอดคืน")) == 1


def test_blocks_lists_and_wraps():
    assert units("2. Results\n\nOne line\nwraps here. Two.\n\n- item one\n\n• item two\n\nNo mark at the end") == ["2. Results", "One line\nwraps here.", "Two.", "- item one", "• item two", "No mark at the end"]
    assert units("Findings\nFirst is here. Second is there.\n8) an item\nThird one is long enough to be a paragraph of its own.") == ["Findings", "First is here.", "Second is there.", "8) an item", "Third one is long enough to be a paragraph of its own."]
    assert units(None) == units("  \n ") == [] and units("word") == ["word"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?\"“”「」。\n-1ก", max_size=200))
def test_units_cover_the_text_in_order(text):
    spans = N.sentences(text)
    at = 0
    for a, b in spans:
        assert a >= at and b > a and not text[at:a].strip() and not text[a].isspace()
        at = b
    assert not text[at:].strip()


def test_sentence_frame(spark):
    schema = "doc_id bigint, text string, key string, starts int"
    rows = [(1, "A one. B two.", "k", 1), (2, None, None, None), (3, " ", None, None), (None, "X.", None, None), (4, "Long one. " * 20000, None, None)]
    got = N.sentence_units(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id, r.start_char) for r in got if r.doc_id in (1, 2, 3)) == [(1, 0), (1, 7)]
    assert len([r for r in got if r.doc_id == 4]) == 20000 and N.sentence_units(spark.createDataFrame([], schema)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_packing_is_valid(sizes):
    p = B.pack(sizes, 40)
    used = {}
    for pattern, n in p.patterns:
        assert sum(s * k for s, k in pattern.items()) <= 40 and n > 0
        for s, k in pattern.items():
            used[s] = used.get(s, 0) + k * n
    assert used == sizes
    low = max(math.ceil(sum(s * n for s, n in sizes.items()) / 40), sum(n for s, n in sizes.items() if s > 20))
    assert low <= p.containers <= math.ceil(1.5 * low)


def best(items, capacity):
    """Fewest containers, by trying every assignment that opens at most one new container at a time."""
    items = sorted(items, reverse=True)
    least = len(items)

    def place(at, load):
        nonlocal least
        if len(load) >= least:
            return
        if at == len(items):
            least = len(load)
            return
        for room in sorted(set(load)):
            if room + items[at] <= capacity:
                i = load.index(room)
                place(at + 1, [*load[:i], room + items[at], *load[i + 1 :]])
        place(at + 1, [*load, items[at]])

    place(0, [])
    return least


def _rest_is_best(items, capacity):
    left = {s: items.count(s) for s in set(items)}
    fixed = B.reduce_by_dominance(left, capacity)
    rest = [s for s, n in left.items() for _ in range(n)]
    return sum(n for _, n in fixed) + best(rest, capacity) == best(items, capacity), fixed


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_fixed_sets_belong_to_a_best_solution(items):
    assert _rest_is_best(items, 20)[0]


def test_pairs_are_fixed_only_if_no_three_others_fit():
    assert _rest_is_best([12, 11, 7, 3, 3, 2, 2], 20)[0]
    ok, fixed = _rest_is_best([11, 5, 4, 4], 20)  # 11 with two others, and no three
    assert ok and {11: 1, 5: 1, 4: 1} in [p for p, _ in fixed]


def test_container_frame(spark):
    schema = "key bigint, tokens bigint, size int, rank int"
    rows = [(i, t, 1, 1) for i, t in enumerate([7, 3, 5, 5, 25, 0, 1])] + [(None, 9, None, None), (9, None, None, None)]
    got = B.fill_containers(spark.createDataFrame(rows, schema), capacity=10).collect()
    load = {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 10 and sum(load.values()) == 55 and len(load) == 6
    assert sorted((r.piece_no, r.first_token, r.n_tokens) for r in got if r.key == 4) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert B.fill_containers(spark.createDataFrame([], schema), capacity=10).count() == 0
