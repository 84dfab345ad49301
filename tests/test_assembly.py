"""Results put together: quotes found elsewhere, names that hold references, halves, pages, fences."""

import glob
import json
import time

import pytest
from pyspark.sql import functions as F

from linespan import sinks as K
from linespan.functions.text import strip_fence
from linespan.operators import assembly as A
from linespan.operators import checks as C
from linespan.operators import jobs as J
from linespan.operators import quotes as Q
from linespan.operators import schema as S
from linespan.session import shared_dir

LINES = [("b.md", 7, "The total is  5 units of water"), ("a.md", 1, "Ünits of water are here"), ("a:L2.md", 3, "x"), ("a.md", 2, "of water: yes"), ("z.md", 1, "")]


@pytest.fixture(scope="module")
def carried(spark):
    rows = [(1, 1, k, *x) for k, x in enumerate(LINES)] + [(1, 2, 0, "b.md", 9, "units of water"), (2, 1, 0, "b.md", 7, "nothing")]
    return spark.createDataFrame(rows, "job long, chunk int, at int, name string, n int, text string")


def test_the_first_carried_line_that_holds_a_quote(spark, carried):
    asked = {"of water": "b.md:L7", "units  of\twater": "b.md:L7", "nits of wat": "b.md:L7", "here": "a.md:L1", "er: y": "a.md:L2", "x": "b.md:L7" if "x" in LINES[0][2] else "a:L2.md:L3",
             "Ü": "a.md:L1", "nothing": None, "": None, "total is 5 units of water and": None}
    quotes = spark.createDataFrame([(1, 1, q) for q in [*asked, "of water", None]], "job long, chunk int, quote string")
    got = Q.find_quotes(quotes, carried).collect()
    assert len(got) == len(asked) + 2 and all(r["found"] == asked.get(r["quote"]) for r in got)


def test_notes_say_where_a_quote_stands(spark, carried):
    rows = [("p", 0, '"5"', "b.md:L7", "units of water are"), ("p", 1, '"5"', "a.md:L1", "total is 5"), ("p", 2, '"5"', "a.md:L1", "no such"), ("p", 3, '"5"', "b.md:L7", "is 5 units"), ("p", 4, '"5"', "a.md:L1", " ")]
    values = spark.createDataFrame([(1, 1, *r) for r in rows], "job long, chunk int, path string, seq int, value string, ref string, quote string")
    got = {r["seq"]: (r["status"], r["note"]) for r in S.check_values(values, carried).collect()}
    assert got == {0: ("quote_mismatch", "quote not in the cited lines"), 1: ("quote_mismatch", "quote found at b.md:L7"), 2: ("quote_mismatch", "quote not in the cited lines"), 3: ("ok~", None), 4: ("quote_mismatch", "no quote")}


def test_the_longest_carried_name_is_meant(spark, carried):
    said = ["a:L2.md:L3| x", "a.md:L1 (p.1)| u", " b.md:L7|y", "L5| :L6| z", "a:L2| w", "gone.md:L4| v", "none"]
    lines = spark.createDataFrame([(1, 1, k, x) for k, x in enumerate(said)], "job long, chunk int, pos int, raw string")
    got = [tuple(r) for r in Q.named_quotes(lines, carried).orderBy("pos").select("written", "n", "said").collect()]
    assert got[:6] == [("a:L2.md", 3, "x"), ("a.md", 1, "u"), ("b.md", 7, "y"), (None, 5, ":L6| z"), ("a", 2, "w"), ("gone.md", 4, "v")]
    assert got[6][:2] == (None, None)


def test_halves_of_cut_answers(spark):
    rows = [(1, 1, k, "a" if k < 4 else "b", k, f"t{k}", None) for k in range(1, 12)] + [(1, 2, 1, "a", 1, "t", None)] + [(1, 3, k, "a", k, "t", 9) for k in (1, 2)] + [(2, 1, k, "a", k, "t", None) for k in (1, 2, 3)]
    carried = spark.createDataFrame(rows, "job long, chunk int, at int, name string, n int, text string, resplit_of int")
    answers = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, True), (2, 1, False)], "job long, chunk int, truncated boolean")
    halves, numbers = A.resplit(carried, answers, overlap=2)
    got = {(r["chunk"], r["half"]): r["ns"] for r in halves.groupBy("chunk", "half").agg(F.sort_array(F.collect_list("n")).alias("ns")).collect()}
    assert got == {(1, "a"): [1, 2, 3, 4, 5], (1, "b"): [4, 5, 6, 7, 8, 9, 10, 11]}  # one line, and halves, are left as they are
    assert sorted(tuple(r) for r in numbers.where("job = 1").fillna("").collect()) == [(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "", 3), (1, 3, "", 4)]
    assert [tuple(r) for r in numbers.where("job = 2").collect()] == [(2, 1, None, 1)]


def test_drafts_of_one_and_of_several_chunks(spark):
    answers = spark.createDataFrame([(1, 1, "a\nb \n\n"), (1, 2, None), (1, 3, ""), (1, 4, "c"), (2, 1, "d\n")], "job long, chunk int, body string")
    spans = spark.createDataFrame([(1, k, f"s{k}") for k in (1, 2, 3, 4)] + [(2, 1, "s")], "job long, chunk int, span string")
    parts = A.draft_offsets(answers, spans)
    text = [r["text"] for r in A.draft_lines(parts).where("job = 1").orderBy("result_line").collect()]
    assert text == ["=== chunk 1 (s1) ===", "a", "b", "=== chunk 3 (s3) ===", "", "=== chunk 4 (s4) ===", "c"]
    assert [tuple(r) for r in A.draft_lines(parts).where("job = 2").collect()] == [(2, 1, "d")]
    items = spark.createDataFrame([(1, 1, 2), (1, 4, 1)], "job long, chunk int, pos int")
    assert sorted(r["result_line"] for r in A.place_draft_items(items, parts).collect()) == [3, 7]


def _page(spark, texts, *args, extra=(), **kw):
    rows = spark.createDataFrame([("r", k, t, k in extra) for k, t in enumerate(texts, 1)], "result_id string, at int, text string, extra boolean")
    return [(r["line"], r["text"]) for r in A.result_pages(rows, *args, **kw).orderBy("at").collect()]


def test_pages_by_lines_and_bytes(spark):
    assert _page(spark, list("abcde"), 2, 2) == [(2, "b"), (3, "c")]
    assert _page(spark, ["a", "--- m ---", "b", "--- m ---", "c"], 2, 1, extra={2, 4}) == [(2, "--- m ---"), (2, "b")]
    assert _page(spark, ["x" * 401])[0][1] == "x" * 400 + " … (+1 chars)"
    ten = "y" * 4000
    assert len(_page(spark, [ten] * 10, full=True)) == 4 and len(_page(spark, [ten] * 10)) == 10
    huge = "é" * 20_000
    got = _page(spark, [huge, "a", "b"], full=True)
    assert got[0][1] == "é" * 8160 + " … (line clipped)" and [t for _, t in got[1:]] == ["a", "b"]
    assert _page(spark, ["a", huge, "b"], full=True) == [(1, "a")]
    assert _page(spark, ["a"], 5) == []


def test_fences(spark):
    cases = {"plain": (["a", "b"], ["a", "b"]), "fence": (["", "```json", "a", "```", " "], ["a"]), "edges": ([" ", "a", "", "b", "\t"], ["a", "", "b"]), "open": (["```", "a"], ["```", "a"]), "empty": (["```", "```"], [""])}
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, lines array<string>")
    assert {r["k"]: r["x"] for r in df.select("k", strip_fence(F.col("lines")).alias("x")).collect()} == {k: v[1] for k, v in cases.items()}
    answers = [("array", ["```json", '[{"a": 1},', "2]", "```"]), ("lines", ["```", '{"a": 1},', "NOT IN INPUT", "not_in_input", "```"])]
    got = J.parse_edits(spark.createDataFrame(answers, "answer_id string, lines array<string>")).orderBy("answer_id", "pos").collect()
    assert [(r["value"], r["error"]) for r in got] == [('{"a":1}', None), ("2", None), ('{"a":1}', None), (None, "not JSON: not_in_input")]


def test_documents_that_hold_texts(spark):
    docs = {1: "one two three four", 2: "xone two threex", 3: "a b", 4: "", 5: None, 6: "one  two three", 7: "abc"}
    items = {1: "one two three", 2: "two", 3: "b", 4: " ", 5: "e two", 6: None, 7: "", 8: "zz zz zz", 9: "a b", 10: "bc"}
    got = Q.texts_holding(spark.createDataFrame(list(items.items()), "item_id long, quote string"), spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, d) for i, q in items.items() for d, t in docs.items() if q and t and q in t)


def test_prices_of_two_figures(spark):
    df = spark.createDataFrame([(0.00996,), (0.0099,), (0.001,), (0.25,), (0.0,), (None,)], "p double")
    assert [r[0] for r in df.select(J.price_text(F.col("p"))).collect()] == ["$0.010", "$0.0099", "$0.0010", "$0.25", "$0", "-"]


def test_sources_of_many_results_share_files(spark, tmp_path):
    """Two hundred results are a few files; a result written again is replaced alone, also by fewer lines."""
    copies = spark.range(200).select(F.col("id").alias("result_id"), F.lit(1).cast("long").alias("n"), F.explode(F.array(F.lit(1), F.lit(2))).alias("at"), F.lit(0).alias("side"), F.lit("old").alias("text"))
    index = spark.range(200).select(F.col("id").alias("result_id"), F.lit(1).cast("long").alias("n"), F.lit("a.md").alias("name"))
    at = str(tmp_path / "sources")
    K.write_sources(copies, index, at)
    assert len(list((tmp_path / "sources").rglob("part-*"))) <= 40
    K.write_sources(copies.where("result_id = 7 and at = 1").withColumn("text", F.lit("new")), index.where("result_id = 7"), at)
    assert [r["text"] for r in K.read_source(spark, at, 7, 1).collect()] == ["new"]
    assert [r["text"] for r in K.read_source(spark, at, 8, 1, 2, 2).collect()] == ["old"]
    assert K.read_sources_index(spark, at).count() == 200 and K.read_sources_index(spark, at, 7).count() == 1


def test_numbers_are_found_without_the_texts(spark):
    """Valid edits first, then the rejected with a text; what is written to number them has no text of theirs."""
    carried = spark.createDataFrame([(1, c, "a.md", n, f"line {n} is here") for c in (1, 2) for n in (1, 2, 3)], "job long, chunk int, name string, n int, text string")
    said = [(1, 1, 0, "", "2", "line 9", "x"), (1, 1, 1, "a.md", "L1", "line 1", "x"), (1, 1, 2, "", "3", None, "x"), (1, 2, 0, "", "1", "line", "x"), (1, 2, 1, "", "2", "line 2", "y"), (1, 2, 2, "b.md", "2", "li", "y")]
    edits = spark.createDataFrame([(*x, "why") for x in said], "job long, chunk int, pos int, file string, line string, old string, new string, why string")
    items = C.dedupe_edits(C.check_edits(edits, carried))
    lines = A.assemble_edits(items, edits).orderBy("result_line").collect()
    assert [(r["result_line"], r["status"], json.loads(r["text"]).get("old")) for r in lines] == [(1, "ok", "line 1"), (2, "ok", "line 2"), (3, "bad", "line 9"), (4, "bad", "li")]
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/*"))
    A.assemble_edits(items, edits)
    written = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/*")) - before
    assert written and all("old" not in spark.read.parquet(p).columns for p in written)


def test_a_quote_of_two_letters_more_in_a_very_long_line(spark):
    """A line's letters are not listed one by one, each counted from its start: that took minutes for a line as long as this."""
    carried = spark.createDataFrame([(1, 1, 0, "a.md", 1, "é" * 400_000 + " xyzzy"), (1, 1, 1, "a.md", 2, "xyzzy")], "job long, chunk int, at int, name string, n int, text string")
    quotes = spark.createDataFrame([(1, 1, "yzz"), (1, 1, "yzy")], "job long, chunk int, quote string")
    began = time.time()
    got = {r["quote"]: r["found"] for r in Q.find_quotes(quotes, carried).collect()}
    assert got == {"yzz": "a.md:L1", "yzy": None} and time.time() - began < 60
