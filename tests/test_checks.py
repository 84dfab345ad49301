import pytest
from pyspark.sql import functions as F

from linespan.config import InputError, chunk_budget
from linespan.functions import text as T
from linespan.operators import checks as C
from linespan.operators import schema as S


def test_numbers():
    cases = {"3 605 044,00": [3605044.0], "1.234,56": [1234.56], "0,500": [0.5], "1.2.3": [], "1,500": [1500.0, 1.5], "12.500": [12.5, 12500.0],
             "1.000.000": [1000000.0], "-5": [-5.0], "abc": [], "1'000": [1000.0]}
    assert {k: T.number_readings(k) for k in cases} == cases


def test_values(spark):
    cases = [
        (12.5, "12,500", True), ("ООО Ромашка", "ООО", False), ("да", "Вода", False), ("Москва", "г. Москва", True), ("2026-11-27", "27 ноября 2026 года", True), ("February 17, 2026", "17.02.2026", True),
        (True, "True", True), (True, "it is true", False), (True, 1, False), (False, False, True), (5, True, False), ("5", "5 units", True), (5, "6 units", False), ("1,500", 1500, True), ("1,500", 1.5, False),
        ("2026-11-27 10:00", "27.11.2026 11:00", False), ("2026-11-27 10:00", "2026-11-27", True), ("x", "", False), ("", "x", False), ("a\\Eb", "the a\\Eb.", True), ("«A» — b", "a - B", True), ("ab", "xabx", False),
    ]
    rows = spark.createDataFrame([(k, T.reading(w), T.reading(g)) for k, (w, g, _) in enumerate(cases)], f"k int, w {T.READING}, g {T.READING}")
    got = {r["k"]: r["x"] for r in rows.select("k", T.values_agree(F.col("w"), F.col("g")).alias("x")).collect()}
    assert [(w, g, got[k]) for k, (w, g, _) in enumerate(cases)] == cases
    assert T.norm_text("«Анадырь».") == "Анадырь"


def test_hard_tokens():
    tokens, numbers = T.hard_tokens("at 10:15 on 2026-01-02 host db.local:5432 10.0.0.1 v1.2 /etc/x/y `a b` fe80::1 and 42")
    kinds = {k for k, _ in tokens}
    assert {"time", "date", "host_port", "ipv4", "version", "path", "backtick", "ipv6"} <= kinds and numbers == ["42"]


def test_refs():
    refs, rest = T.Refs(["a.md", "my (old).md"]).parse("x (a.md:L5, my (old).md:L7–L9) y (not a ref)")
    assert [(r["name"], r["from"], r["to"]) for r in refs] == [("a.md", 5, 5), ("my (old).md", 7, 9)] and rest == "x  y (not a ref)"


CARRIED = [(1, 1, "in/a.md", 1, "alpha  beta"), (1, 1, "in/a.md", 2, "gamma 42 items"), (1, 2, "in/a.md", 2, "gamma 42 items")]


def _carried(spark):
    return spark.createDataFrame(CARRIED, "job int, chunk int, name string, n int, text string")


def test_extract(spark):
    raw = ["L1| alpha  beta", "L1| alpha beta", "a.md:L2| gamma…", "L2| other", "L9| x", "hello", "NOT IN INPUT", "z.md:L1| x"]
    df = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(raw)], "job int, chunk int, pos int, raw string")
    got = C.check_extract(df, _carried(spark)).orderBy("pos").collect()
    assert [r["status"] for r in got] == ["ok", "ok~", "partial", "bad", "bad", "bad", "not_in_input", "bad"]
    assert got[4]["reason"] == "line not in this chunk's input" and got[7]["reason"] == "unknown file name"


def test_draft():
    carried = {(n, k): t for _, c, n, k, t in CARRIED if c == 1}
    assert C.judge_line("There are 42 (L2)", carried)[0] == "ok"
    assert C.judge_line("There are 43 (L2)", carried)[:2] == ("flag", ["number not in cited lines: 43"])
    assert C.judge_line("No source", carried)[1] == ["no ref"]
    assert C.judge_line("x (L2-L1)", carried)[1] == ["bad ref range: L2-L1"]
    assert C.judge_line("# Title", carried)[0] is None


def test_edits(spark):
    rows = [(1, 1, 0, "", "2", "42", "43"), (1, 1, 1, "", "L2", "m", "n"), (1, 1, 2, "", "2", "zz", "n"), (1, 1, 3, "", "x", "a", "b"), (1, 1, 4, "", "1", "<TOKEN>", "b")]
    df = spark.createDataFrame(rows, "job int, chunk int, pos int, file string, line string, old string, new string")
    got = {r["pos"]: r["reason"] for r in C.check_edits(df, _carried(spark)).collect()}
    assert got[0] is None and got[1] == '"old" occurs 3 times in the source line' and got[2] == '"old" is not in the source line'
    assert got[3] == 'bad "line"' and got[4].startswith("touches a mask")


def test_edits_keep_the_first_chunk(spark):
    rows = [(1, c, p, "in/a.md", 2, s) for c, p, s in ((1, 0, "ok"), (1, 1, "ok"), (2, 0, "ok"), (2, 1, "bad"))]
    df = spark.createDataFrame(rows, "job int, chunk int, pos int, name string, n int, status string")
    assert sorted((r["chunk"], r["pos"]) for r in C.dedupe_edits(df).collect()) == [(1, 0), (1, 1)]


def test_schema(spark):
    schema = {"title": "string — the title", "rows": [{"price": "number"}]}
    assert [p for p, _, _ in S.leaves(schema)] == ["title", "rows[].price"]
    with pytest.raises(InputError):
        S.leaves({"a": "strange"})
    text = '```json\n{"title": {"value": "alpha", "ref": "L1", "quote": "alpha beta"}, "rows": [{"price": {"value": "42", "ref": "L2", "quote": "gamma 42"}}, {"price": 7}],}\n```'
    answers = S.parse_answers(spark.createDataFrame([(1, 1, text), (1, 2, "[]")], "job int, chunk int, text string"))
    rows = {r["chunk"]: (r["json"] is not None, r["repaired"]) for r in answers.collect()}
    assert rows == {1: (True, True), 2: (False, False)}
    values = S.leaf_values(answers, schema)
    got = {r["path"]: r["status"] for r in S.check_values(values, _carried(spark)).collect()}
    assert got == {"title": "ok~", "rows[0].price": "ok", "rows[1].price": "bad_ref"}


def test_merge(spark):
    rows = [(1, 1, "a", 1, '"30"', "L1", "q"), (1, 2, "a", 2, '"30.0"', "L2", "q"), (1, 3, "b", 1, '"x"', "L1", "q"), (1, 3, "b", 2, '"y"', "L3", "q")]
    got = {r["path"]: r for r in S.merge(spark.createDataFrame(rows, "job int, chunk int, path string, seq int, value string, ref string, quote string")).collect()}
    assert not got["a"]["conflict"] and got["a"]["refs"] == ["L1", "L2"]
    assert got["b"]["conflict"] and got["b"]["distinct"] == 2 and got["b"]["value"] == '["\\"x\\"","\\"y\\""]'


def test_budget():
    assert chunk_budget(32_000, None, 800) == 12_000
    with pytest.raises(InputError):
        chunk_budget(1_000, None, 300)


@pytest.mark.parametrize(
    ("line", "names", "refs", "rest"),
    [
        ("Uplink (L2) and more (a.md:L5, b.md:L7–L9) end", [], [(None, 2, 2), ("a.md", 5, 5), ("b.md", 7, 9)], "Uplink  and more  end"),
        ("a note (see below)", [], [], "a note (see below)"),
        ("- old (my notes (old).md:L5) and more", ["my notes (old).md", "notes (old).md"], [("my notes (old).md", 5, 5)], "- old  and more"),
        ("(a b.md:L3-L7)", ["b.md", "a b.md"], [("a b.md", 3, 7)], ""),
        ("(b.md:L2, a b.md:L4; x#1.md:L1–L3)", ["b.md", "a b.md", "x#1.md"], [("b.md", 2, 2), ("a b.md", 4, 4), ("x#1.md", 1, 3)], ""),
        ("see (the (L5) one) (L6", [], [(None, 5, 5)], "see (the  one) (L6"),
        ("(a, b.md:L5)", ["a, b.md"], [("a, b.md", 5, 5)], ""),
        ("(L1, nope) (L2;)", [], [(None, 2, 2)], "(L1, nope) "),
        ("(a.md:L1-b (x).md:L3)", ["a.md", "b (x).md"], [("a.md", 1, 3)], ""),
        ("(gone (x).md:L3) (C:\\y.md:L4)", [], [("C:\\y.md", 4, 4)], "(gone (x).md:L3) "),
        ("(" + "x" * 500 + ":L1)", [], [], "(" + "x" * 500 + ":L1)"),
    ],
)
def test_references(line, names, refs, rest):
    from linespan.functions.text import Refs

    found, left = Refs(names).parse(line)
    assert [(r["name"], r["from"], r["to"]) for r in found] == refs and left == rest


def test_attachments_named_in_drafts():
    from linespan.operators.checks import judge_line

    lines = {("mail.eml", n): f"text {n}" for n in range(1, 21)} | {("other.eml", n): "x" for n in range(1, 4)}
    parts = {"spec.pdf": {"mail.eml": [(5, 10)]}, "twice.pdf": {"mail.eml": [(11, 12)], "other.eml": [(1, 2)]}, "far.pdf": {"not carried.eml": [(1, 2)]}}
    judge = lambda ref: judge_line(f"A claim ({ref})", lines, parts)
    assert judge("spec.pdf:L6-L8") == ("ok", [], 1, 0)
    assert judge("spec.pdf:L9-L12")[1] == ["L12 is not inside attachment spec.pdf"] and judge("spec.pdf:L2")[1] == ["L2 is not inside attachment spec.pdf"]
    assert judge("twice.pdf:L1")[1] == ["ambiguous file name in ref: twice.pdf"] and judge("far.pdf:L1")[1] == ["ref to an unknown file: far.pdf:L1"]


def test_schema_report_counts_chunks(spark):
    items = spark.createDataFrame([(1, "ok"), (1, "ok~"), (1, "bad_ref"), (1, "null"), (2, "quote_mismatch")], "job long, status string")
    answers = spark.createDataFrame([(1, 1, "{}", False), (1, 2, None, False), (1, 3, "{}", True), (2, 1, "{}", None), (3, 1, None, None)], "job long, chunk int, json string, repaired boolean")
    got = {r["job"]: r.asDict() for r in S.schema_report(items, answers, 7, "job").collect()}
    pick = lambda j: tuple(got[j][c] for c in ("fields", "values", "ok", "ok_folded", "bad_ref", "nulls", "failed_chunks", "repaired_chunks", "refs_ok", "refs_bad", "pass_rate"))
    assert pick(1) == (7, 3, 1, 1, 1, 1, 1, 1, 2, 1, 2 / 3) and pick(2) == (7, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0.0) and pick(3) == (7, 0, 0, 0, 0, 0, 1, 0, 0, 0, None)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange " in x]


def test_extract_deals_texts_once(spark):
    """Carried lines and answers meet in one shuffle; what is kept of overlaps and a probe's verdict add narrow ones only."""
    lines = spark.range(40).select((F.col("id") % 4).alias("job"), F.lit(1).alias("chunk"), F.lit("a.md").alias("name"), F.col("id").cast("int").alias("n"), F.col("id").cast("string").alias("text"))
    answers = lines.select("job", "chunk", F.col("n").alias("pos"), F.concat(F.lit("L"), "n", F.lit("| "), "text").alias("raw"))
    items = C.check_extract(answers, lines).select("job", "chunk", "pos", "name", "n", "status")
    assert len(_exchanges(items)) == 1
    kept = C.dedupe_extract(items)
    assert len(_exchanges(kept)) == 2 and kept.where("status = 'ok'").count() == 40
    verdict = C.probe_verdict(kept, lines.select("job", "name", "n"))
    assert len(_exchanges(verdict)) <= 4 and all(r["passed"] for r in verdict.collect())


def test_names_with_places_and_cut_quotes(spark):
    """The longest carried name is meant, a cut quote is compared with its line's beginning, overlaps stay once, bad items all."""
    carried = spark.createDataFrame([(1, c, n, k, t) for c in (1, 2) for n, k, t in (("a", 1, "one  two three"), ("a:L1| x", 2, "four"), ("b/a.md", 3, "five"), ("c/a.md", 3, "six"))], "job int, chunk int, name string, n int, text string")
    raw = ["a:L1| one two…", "a:L1| x:L2| four", "a.md:L3| five", "b/a.md:L3|five", "b/a.md:L3| …", "L3| five", "a:L1| two...", " NOT IN INPUT. "]
    df = spark.createDataFrame([(1, c, i, t) for c in (1, 2, 3) for i, t in enumerate(raw)], "job int, chunk int, pos int, raw string")
    items = C.check_extract(df, carried)
    got = {(r["chunk"], r["pos"]): (r["name"], r["n"], r["status"], r["reason"]) for r in items.collect()}
    want = [
        ("a", 1, "partial", None), ("a:L1| x", 2, "ok", None), (None, 3, "bad", "ambiguous file name in ref: a.md"), ("b/a.md", 3, "ok", None), ("b/a.md", 3, "bad", "text differs from the source line"),
        (None, 3, "bad", "file name missing (several files)"), ("a", 1, "bad", "text differs from the source line"), (None, None, "not_in_input", None),
    ]
    assert [got[1, k] for k in range(8)] == want and [got[2, k] for k in range(8)] == want
    assert got[3, 0] == (None, 1, "bad", "unknown file name") and got[3, 5][3] == "file name missing (several files)"
    kept = sorted((r["chunk"], r["pos"]) for r in C.dedupe_extract(items).where("chunk < 3").collect())
    assert kept == [(1, k) for k in range(8)] + [(2, k) for k in (2, 4, 5, 6, 7)]
