"""Sections, and chunks of whole jobs, against values worked out by hand and chunks cut in one pass."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from linespan.operators import chunks as C
from linespan.operators import ordered as O
from linespan.operators import sections as S
from linespan.session import shared_dir
from linespan.sources import lines as L

LINK = "array<struct<ref:int,text:string>>"
DOC = "file_id string, lines array<string>, sections array<struct<start:int,end:int>>, markers array<struct<at:int,text:string>>"
MARKERS = [(5, "--- attachments ---"), (7, "--- attachment: spec.pdf ---"), (7, "--- page 1 ---"), (9, "--- page 2 ---")]
SECTIONS = [(6, 7), (8, 12), (8, 9), (10, 12)]
ABC = list("abcdefghijkl")


def _shown(spark, rows, keep=None):
    docs = spark.createDataFrame(rows, DOC)
    numbered = L.numbered(F.col("lines"))
    kept = F.filter(numbered, lambda x: x["n"].isin(keep)) if keep else numbered
    lines = docs.select("file_id", F.size("lines").alias("total"), F.inline(S.shown_lines(kept)))
    return S.with_sections(lines, docs, ["file_id"])


def _texts(df, file_id):
    out = []
    for r in df.where(F.col("file_id") == file_id).orderBy("n").collect():
        out += [m["text"] for m in r["pre"]] + [f"L{r['n']}| {r['text']}"] + ([r["post"]] if r["post"] else [])
    return out


def test_chains_of_sections(spark):
    shifted = [*SECTIONS[:3], (11, 12)]
    rows = [("paired", ABC, SECTIONS, MARKERS), ("none", ABC, [], MARKERS), ("fewer", ABC, SECTIONS[1:], MARKERS), ("shifted", ABC, shifted, MARKERS), ("bare", ABC, [], [])]
    got = {(r["file_id"], r["n"]): r for r in _shown(spark, rows).collect()}
    chain = lambda f, n: got[f, n]["chain"] and [m["text"] for m in got[f, n]["chain"]]
    assert chain("paired", 1) == [] and chain("paired", 6) == ["--- attachments ---"]
    assert chain("paired", 8) == ["--- attachment: spec.pdf ---", "--- page 1 ---"]
    assert chain("paired", 11) == ["--- attachment: spec.pdf ---", "--- page 2 ---"]
    assert all(got[f, n]["chain"] is None for f in ("none", "fewer", "shifted", "bare") for n in range(1, 13))
    assert got["none", 9]["mark"] == "--- page 1 ---" and got["none", 5]["mark"] is None and got["bare", 12]["mark"] is None


def test_what_is_shown_after_skipped_lines(spark):
    rows = [("paired", ABC, SECTIONS, MARKERS), ("none", ABC, [], MARKERS)]
    some, every = _shown(spark, rows, [2, 11]), _shown(spark, rows)
    want = ["… (line 1 skipped)", "L2| b", "… (lines 3–10 skipped)", "--- attachment: spec.pdf ---", "--- page 2 ---", "L11| k", "… (line 12 skipped)"]
    assert _texts(some, "paired") == want
    assert _texts(some, "none") == [w for w in want if w != "--- attachment: spec.pdf ---"]
    assert _texts(every, "paired") == _texts(every, "none")
    assert _texts(every, "paired")[5:10] == ["--- attachments ---", "L6| f", "L7| g", "--- attachment: spec.pdf ---", "--- page 1 ---"]


def test_one_file_over_many_ranges(spark):
    """Running values of one key that lies in many tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(500).select(F.lit("one").alias("k"), F.col("id").cast("int").alias("n"), F.when(F.col("id") % 170 == 3, F.col("id")).alias("v"))
        got = O.before(O.last_at(rows, ["k"], ["n"], {"last": F.col("v")}), ["k"], ["n"], {"ahead": F.col("n").cast("long")}).orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["last"] for r in got] == [max((v for v in range(3, i + 1, 170)), default=None) for i in range(500)]
    assert [r["ahead"] for r in got] == [i * (i - 1) // 2 for i in range(500)]


# --- chunks ---


def _rows(spark, files, multi, sections=None):
    """files: [(name, [line])]; sections: {name: (sections, markers)}."""
    given = sections or {}
    docs = [(name, lines, *given.get(name, ([], []))) for name, lines in files]
    order = spark.createDataFrame([(name, k) for k, (name, _) in enumerate(files)], "file_id string, file_no long")
    df = _shown(spark, docs).join(F.broadcast(order), "file_id").withColumnsRenamed({"file_id": "name"})
    return C.job_rows(df.withColumns({"job": F.lit("j"), "multi": F.lit(multi), "text": F.concat(F.lit("L"), "n", F.lit("| "), "text")}))


def _chunks(spark, files, budget, multi=True, sections=None, **options):
    got = C.chunk_jobs(_rows(spark, files, multi, sections), budget, **options).orderBy("chunk").collect()
    assert [r["chunk"] for r in got] == list(range(1, len(got) + 1))
    return got


def _lines(chunk):
    return [(f["name"], n) for f in chunk["lines"] for r in f["ranges"] for n in range(r["a"], r["b"] + 1)]


def _line(i):
    return f"line {i} {'x' * 20}"


def test_breaks_repeat_header_and_five_lines(spark):
    got = _chunks(spark, [("a.md", [_line(i) for i in range(1, 61)]), ("b.md", [_line(i) for i in range(1, 4)])], 200)
    assert len(got) > 2
    for c in got:
        assert c["tokens"] <= 200 and c["text"].split("\n")[0] in ("=== file: a.md ===", "=== file: b.md ===")
        assert c["tokens"] == sum(-(-len((x + "\n").encode()) // 3) for x in c["text"].split("\n"))
    assert got[1]["first_n"] == got[0]["last_n"] - 4
    assert {x for c in got for x in _lines(c)} == {("a.md", i) for i in range(1, 61)} | {("b.md", i) for i in (1, 2, 3)}
    assert (got[-1]["last_name"], got[-1]["last_n"]) == ("b.md", 3)


def test_a_break_between_files_carries_nothing(spark):
    files = [(n, [_line(i) for i in range(1, 5)]) for n in ("a.md", "b.md")]
    one = _chunks(spark, files[:1], 1000)[0]["tokens"]
    got = _chunks(spark, files, one + 5)
    assert len(got) == 2 and _lines(got[1]) == [("b.md", i) for i in (1, 2, 3, 4)]


def test_one_file_has_no_header_and_bytes_count(spark):
    latin, cyrillic = (_chunks(spark, [("a", [x * 30] * 30)], 150, multi=False) for x in ("a", "я"))
    assert "=== file" not in latin[0]["text"] and len(cyrillic) > len(latin)


def test_a_line_over_the_budget_refuses_its_job(spark):
    rows = _rows(spark, [("big.log", ["ok", "z" * 3000, "ok"])], True)
    assert [tuple(r) for r in C.refused_jobs(rows, 500).collect()] == [("j", "big.log:L2", 1002)]
    assert C.chunk_jobs(rows, 500).collect() == []


def _message():
    lines = [f"line {i} {'w' * 30}" for i in range(1, 68)]
    markers = [(5, "--- attachments ---"), (7, "--- attachment: spec.pdf ---"), (7, "--- page 1 ---"), (37, "--- page 2 ---")]
    sections = [(6, 7), (8, 67), (8, 37), (38, 67)]
    chain = lambda n: [m[1] for s, m in zip(sections, markers, strict=True) if s[0] <= n <= s[1]]
    return lines, sections, markers, chain


@pytest.mark.parametrize("multi", [False, True])
def test_a_chunk_inside_an_attachment_opens_with_its_chain(spark, multi):
    lines, sections, markers, chain = _message()
    got = _chunks(spark, [("mail.eml", lines)], 220, multi, {"mail.eml": (sections, markers)})
    assert len(got) > 5
    for k, c in enumerate(got):
        text = c["text"].split("\n")[int(multi) :]
        lead = text[: next(i for i, x in enumerate(text) if x.startswith("L"))]
        assert c["tokens"] <= 220 and len(set(lead)) == len(lead)
        assert not k or lead == chain(c["first_n"])
    assert {n for c in got for _, n in _lines(c)} == set(range(1, 68))


@pytest.mark.parametrize("overlap", [0, 5])
def test_pieces_give_what_one_pass_gives(spark, overlap):
    """Files with and without sections over many pieces, against one walk over all items."""
    r = random.Random(overlap)
    files, sections = [], {}
    for k in range(12):
        lines = ["w" * r.choice([0, 1, 5, 20, 60]) for _ in range([7, 200, 150, 1, 0, 90][k % 6])]
        name = f"f{k}"
        files.append((name, lines))
        if lines and k % 3:
            step = r.choice([1, 3, 30])
            spans = [(a, min(len(lines), a + step - 1)) for a in range(1, len(lines) + 1, step)]
            both = sorted([*((a, b, f"--- page {a} ---") for a, b in spans), (1, len(lines), "--- attachment: x ---")], key=lambda s: (s[0], -s[1]))
            sections[name] = ([s[:2] for s in both] if k % 3 == 1 else [], [(s[0] - 1, s[2]) for s in both])
    budget = 45
    rows = _rows(spark, files, True, sections)
    got = [(c["text"], c["tokens"], c["first_name"], c["first_n"], c["last_name"], c["last_n"]) for c in C.chunk_jobs(rows, budget, overlap, piece=1).orderBy("chunk").collect()]
    items = C.Items(C._rows(rows.orderBy("g").toPandas().assign(pre=lambda d: [[x.asDict() for x in p] for p in d["pre"]], chain=lambda d: [None if c is None else [x.asDict() for x in c] for c in d["chain"]])), budget, overlap)
    want, i = [], 0
    while i is not None and i < len(items.item) and (made := items.built(i)):
        want.append(made[:6])
        i = items.chunk(i)[3]
    assert got == want and len(got) > 60
    for text, tokens, *_ in want:
        assert tokens == sum(-(-len((x + "\n").encode()) // 3) for x in text.split("\n")) <= budget


def test_a_job_of_a_million_lines(spark):
    rows = spark.range(1_000_000).select(F.lit("j").alias("job"), F.lit(0).alias("file_no"), F.lit("a").alias("name"), (F.col("id") + 1).cast("int").alias("n"), F.concat(F.lit("L"), (F.col("id") + 1).cast("string"), F.lit("| x")).alias("text"))
    bare = {"multi": F.lit(False), "pre": F.array().cast("array<struct<kind:string,ref:int,text:string>>"), "chain": F.lit(None).cast(LINK), "mark": F.lit(None).cast("string"), "post": F.lit(None).cast("string")}
    got = C.chunk_jobs(C.job_rows(rows.withColumns(bare)), 9_000, piece=100_000).select("chunk", "first_n", "last_n", "tokens").orderBy("chunk").collect()
    first, want = 1, []
    cost = lambda n: -(-len(f"L{n}| x\n") // 3)
    while first <= 1_000_000:  # the lines that each chunk adds, by counting
        start = max(1, first - 5) if want else 1
        total, last = sum(cost(n) for n in range(start, first)), first
        while last <= 1_000_000 and total + cost(last) <= 9_000:
            total, last = total + cost(last), last + 1
        want.append((len(want) + 1, start, last - 1, total))
        first = last
    assert [tuple(r) for r in got] == want


def test_documents_in_one_row_are_cut_as_jobs_are(spark):
    """`chunk_documents`, which has a document in one row, against the cutting of whole jobs."""
    from linespan.operators.render import chunk_documents

    r = random.Random(11)
    files = [(f"f{k}", ["w" * r.choice([0, 3, 30, 70]) for _ in range(r.choice([1, 9, 120]))]) for k in range(6)]
    rows = _rows(spark, files, True).withColumn("job", F.col("name"))
    # A job a file: the numbers of its rows begin at 0 again.
    rows = rows.join(rows.groupBy("name").agg(F.min("g").alias("_least")), "name").withColumn("g", F.col("g") - F.col("_least")).drop("_least")
    jobs = [(x["job"], x["chunk"], x["text"], x["tokens"], x["first_n"], x["last_n"]) for x in C.chunk_jobs(rows, 90).collect()]
    docs = spark.createDataFrame([(n, n, [(i, f"L{i}| {x}") for i, x in enumerate(lines, 1)]) for n, lines in files], "file_id string, name string, items array<struct<n:int,text:string>>")
    whole = [(x["file_id"], x["chunk"], x["text"], x["tokens"], x["first"], x["last"]) for x in chunk_documents(docs, 90).collect()]
    assert sorted(jobs) == sorted(whole) and len(jobs) > 20


def test_rows_are_numbered_without_their_texts(spark):
    """Numbers over a job and within its files from one table of ranges, in which no line's text is written."""
    bare = {"pre": F.array().cast("array<struct<kind:string,ref:int,text:string>>"), "chain": F.lit(None).cast(LINK), "mark": F.lit(None).cast("string"), "post": F.lit(None).cast("string")}
    shown = spark.range(60).select(F.lit("j").alias("job"), F.floor(F.col("id") / 20).alias("file_no"), F.lit("a").alias("name"), (F.col("id") % 20 + 1).cast("int").alias("n"), F.lit(True).alias("multi"), F.concat(F.lit("text "), "id").alias("text"))
    at = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{at}/*"))
    rows = C.job_rows(shown.withColumns(bare)).orderBy("g").collect()
    assert [(r["g"], r["n"], r["text"], r["opens"]) for r in rows] == [(k, k % 20 + 1, f"text {k}", k % 20 == 0) for k in range(60)]
    written = set(glob.glob(f"{at}/*")) - before
    assert len(written) == 1 and all("text" not in spark.read.parquet(p).columns for p in written)
