import datetime as dt
import heapq
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow import plans
from folioflow.functions import text as X
from folioflow.operators import benchstats as N
from folioflow.operators import chunking as C
from folioflow.operators import pages as P
from folioflow.operators import routing as M
from folioflow.operators import scheduling as Q
from folioflow.sources import files as S


def brute_lpt(sizes, workers):
    loads = [(0, w) for w in range(workers)]
    out = []
    for s in sorted(sizes, reverse=True):
        load, w = heapq.heappop(loads)
        heapq.heappush(loads, (load + s, w))
        out.append((s, w))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=80), st.integers(1, 6))
def test_longest_first_plan_equals_one_by_one(sizes, workers):
    workers = min(workers, len(sizes))
    counts = {s: sizes.count(s) for s in set(sizes)}
    plan = Q.longest_first_plan(counts, workers)
    got = []
    for s in sorted(counts, reverse=True):
        start, cycle = plan[s]
        got += [(s, start[i] if i < len(start) else cycle[(i - len(start)) % len(cycle)]) for i in range(counts[s])]
    assert got == brute_lpt(sizes, workers)


def test_longest_first_partition(spark):
    rows = [(f"d{i:02d}", p) for i, p in enumerate([50, 40, 30, 20, 10, 5, 5, -1])]
    df = spark.createDataFrame([(*r, None) for r in rows], "document_id string, pages int, key string").drop("key")
    got = Q.longest_first_partition(df, "document_id", "pages", 3).collect()
    assert len(got) == 7 and {r.worker_id for r in got} == {"worker_00", "worker_01", "worker_02"}
    assert Q.longest_first_partition(df.limit(0), "document_id", "pages", 3).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abc .!?\nA É", max_size=3000))
def test_chunks_end_and_stay_within_limits(text):
    got = C.chunk_pages([(1, text)])
    assert all(c.strip() and len(c) <= 2000 for c, _, _ in got)
    plain = C.plain_chunks(text)
    assert all(c for _, _, c in plain)


def test_chunker_terminates_on_unbroken_text_and_overlaps():
    got = C.chunk_pages([(1, "Short text here. " + "x" * 448 + " end of it all."), (2, None)])
    assert any("x" * 100 in c for c, _, _ in got) and got[-1][0].endswith("end of it all.")
    long = " ".join(f"Sentence number {i} is here." for i in range(100))
    got = C.chunk_pages([(1, long), (2, "Next page. Done.")], headings={2: "Part two"})
    assert got[1][0].split(" ")[0] in got[0][0] and got[-1][2] == "Part two" and got[0][2] is None
    assert C.chunk_pages([(1, "  \n ")]) == []


def test_semantic_chunks_spark(spark):
    df = spark.createDataFrame([("d", 2, "B two. More."), ("d", 1, "A one."), (None, 1, "x"), ("e", 1, None)], "document_id string, page_number int, text string")
    got = C.semantic_chunks(df).collect()
    assert [(r.document_id, r.text, r.page_numbers) for r in got] == [("d", "A one. B two. More.", [1, 2])]


def test_page_rules(spark):
    df = spark.createDataFrame([(500, 0.05), (500, 0.30), (0, 0.60), (5, 0.10)], "c int, d double")
    got = [r.t.page_type for r in df.select(P.page_type(F.col("c"), F.col("d")).alias("t")).collect()]
    assert got == ["digital", "mixed", "scanned", "unknown"]
    cells = spark.createDataFrame([([["a", "b"], ["1", None], ['x"y', "2,3"]],)], "c array<array<string>>")
    r = cells.select(P.markdown_table(F.col("c")).alias("m"), P.csv_table(F.col("c")).alias("v")).first()
    assert r.m == '| a | b |\n| --- | --- |\n| 1 |  |\n| x"y | 2,3 |' and r.v == 'a,b\n1,\n"x""y","2,3"'
    b = spark.createDataFrame([([("Figure 1: flow", 110.0), ("fig. 2", 130.0), ("text", 101.0)], 100.0)], "b array<struct<text:string,y0:double>>, y double")
    assert b.select(P.nearest_caption(F.col("b"), F.col("y")).alias("c")).first().c == "Figure 1: flow"
    f = spark.createDataFrame([("Flow of data", 1.0, 1.0), (None, 300.0, 100.0), ("", 1.0, 1.0)], "c string, w double, h double")
    assert [r.t for r in f.select(P.figure_type(F.col("c"), F.col("w"), F.col("h")).alias("t")).collect()] == ["diagram", "chart", "unknown"]
    assert spark.range(1).select(P.duplicate_blocks(F.array(F.lit("A "), F.lit("a"), F.lit(" "), F.lit("b"))).alias("n")).first().n == 1
    z = spark.range(1).select(P.layout_type(F.lit(14.5))["level"].alias("l"), P.block_type(F.lit("- x"), F.lit(10.0)).alias("b"), P.box_area(F.lit(1.0), F.lit(1.0), F.lit(3.0), F.lit(1.0))["valid"].alias("v")).first()
    assert (z.l, z.b, z.v) == (2, "list_item", False)
    m = spark.range(1).select(P.merge_strategies(F.array(F.lit("a"), F.lit(" "), F.lit("b")), F.array(F.lit(1.0), F.lit(0.0), F.lit(3.0)), F.array(F.lit(0.4), F.lit(0.9), F.lit(0.8))).alias("m")).first().m
    assert (m.text, m.confidence) == ("a\nb", 0.7)


def test_text_functions(spark):
    r = spark.range(1).select(
        X.language(F.lit("en-IN")).alias("a"), X.language(F.lit(None).cast("string")).alias("b"), X.file_stem(F.lit("/x/y.z/doc.PDF")).alias("c"), X.file_suffix(F.lit("/x/doc.PDF")).alias("d"),
        X.archive_url(F.lit("PMC1234567"), "http://x.example").alias("e"), X.archive_url(F.lit("abc"), "b").alias("f"), X.pdf_date(F.lit("D:20240131120000")).alias("g"), X.duration(F.lit(3723)).alias("h"), X.chunk_key(F.lit("d"), F.lit(0)).alias("i"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.f, r.h) == ("en", "en", "doc", ".pdf", "", "1h 02m 03s")
    assert r.e == "http://x.example/67/45/PMC1234567.pdf" and r.g == dt.datetime(2024, 1, 31, 12) and len(r.i) == 16


def test_percentile_rules(spark):
    rng = random.Random(3)
    v = [round(rng.random() * 5, 1) for _ in range(237)]
    df = spark.createDataFrame([("g", x) for x in v] + [("h", 1.0), ("h", None)], "g string, x double")
    got = {r.g: r for r in N.percentile_rules(df, ["g"], "x", 0.95).collect()}
    s = sorted(v)
    h = 0.95 * (len(s) - 1)
    lin = s[math.floor(h)] + (h - math.floor(h)) * (s[math.floor(h) + 1] - s[math.floor(h)])
    assert got["g"].nearest == s[math.ceil(0.95 * len(s)) - 1] and got["g"].floor_index == s[int(len(s) * 0.95)] and abs(got["g"].linear - lin) < 1e-9
    assert (got["h"].nearest, got["h"].floor_index, got["h"].linear) == (1.0, 1.0, 1.0)


def test_hold_of_a_device(spark):
    t = dt.datetime(2025, 1, 1)
    at = [0, 1, 2.5, 3, 10, 10.5]
    asked = ["CPU", "GPU", "CPU", "CPU", "GPU", "CPU"]
    df = spark.createDataFrame([("n", f"{i}", t + dt.timedelta(seconds=s), a) for i, (s, a) in enumerate(zip(at, asked, strict=True))], "node string, id string, ts timestamp, device string")
    got = [(r.id, r.device, r.held) for r in M.held_devices(df, "node", "ts", "id", "device").orderBy("id").collect()]
    assert got == [("0", "CPU", False), ("1", "CPU", True), ("2", "CPU", False), ("3", "CPU", False), ("4", "GPU", False), ("5", "GPU", True)]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"%PDF-1 same")
    (tmp_path / "a" / "y.pdf").write_bytes(b"%PDF-1 same")
    (tmp_path / "z.txt").write_text("one\f\f two ")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "n.doc").write_bytes(b"x")
    got = sorted(r.path.rsplit("/", 1)[1] for r in S.scan_directory(spark, str(tmp_path)).collect())
    assert got == ["x.PDF", "y.pdf", "z.txt"] and S.scan_directory(spark, str(tmp_path / "none")).count() == 0
    raw = spark.read.format("binaryFile").load(str(tmp_path / "a"))
    assert S.unique_downloads(raw).count() == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "u.txt").write_bytes(b"one\f \ftwo \xff")
    assert [(r.page_number, r.text[:3]) for r in S.text_uploads(spark, str(tmp_path / "t")).collect()] == [(1, "one"), (3, "two")]
    m = spark.createDataFrame([("d", "/p", 3, 1.5, None, None, "en", dt.datetime(2025, 1, 1))], S.METADATA)
    for fmt, name in (("csv", "m"), ("json", "m2.json")):
        S.write_metadata(m, str(tmp_path / name), fmt)
    assert S.read_metadata(spark, str(tmp_path / "m")).first().pages == 3
    hit, miss = S.cached_or_missing(spark.createDataFrame([("/p",), ("/q",)], "file_path string"), m)
    assert hit.count() == 1 and [r.file_path for r in miss.collect()] == ["/q"]
    c = spark.createDataFrame([("k", 1, b"a"), ("l", 1, b"b")], "cache_key string, created_at int, v binary")
    up = S.upsert_cache(c, spark.createDataFrame([("k", 2, b"c")], c.schema))
    assert {(r.cache_key, bytes(r.v)) for r in up.collect()} == {("k", b"c"), ("l", b"b")}
    S.append_log(m.withColumn("x", F.array(F.lit(1))), str(tmp_path / "log"))
    S.append_log(m, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 2
    x = spark.createDataFrame([("<a><article-title>T</article-title><pub-date><year>2020</year></pub-date></a>",), ("<a/>",)], "xml string")
    assert [(r.title, r.year) for r in S.xml_articles(x, "xml").collect()] == [("T", 2020)]


def test_catalogue_names_are_unique_and_sql_belongs_to_a_query():
    names = [n for m in plans._MODULES for n in m.QUERIES]
    assert len(names) == len(set(names)) and set(plans.sql()) <= set(names)


def test_nothing_but_the_entry_imports_the_optional_subpackage():
    from pathlib import Path

    root = Path(plans.__file__).resolve().parents[1]
    bad = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "folioflow.llm" in p.read_text()]
    assert not bad


@pytest.mark.parametrize("workers,expected", [(1, ("maintain", 1)), (3, ("scale_out", 5))])
def test_scaling(spark, workers, expected):
    cpu = 50.0 if workers == 1 else 90.0
    r = spark.range(1).select(Q.scaling_advice(F.lit(cpu), F.lit(0), F.lit(workers)).alias("a")).first().a
    assert (r.action, r.target) == expected
