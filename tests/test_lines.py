from datetime import UTC, datetime

from pyspark.sql import functions as F

from linespan.operators import filters as X
from linespan.operators import render as R
from linespan.sources import lines as L


def test_split(spark):
    cases = [("", []), ("\n", [""]), ("a\n\nb", ["a", "", "b"]), ("a\r\nb\rc\n", ["a", "bc"]), (None, []), ("x", ["x"])]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", L.split_lines(F.col("t")).alias("l")).collect()
    assert {r["i"]: r["l"] for r in got} == {i: w for i, (_, w) in enumerate(cases)}


def test_context_and_gaps(spark):
    hits = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda n: F.struct(n.alias("n"), n.isin(8, 15).alias("hit")))
    near = spark.range(1).select(X.context(hits, 2).alias("k")).first()["k"]
    assert near == [6, 7, 8, 9, 10, 13, 14, 15, 16, 17]
    kept = F.array(*[F.struct(F.lit(n).alias("n"), F.lit("t").alias("text")) for n in near])
    rows = spark.range(1).select(R.items(kept, F.lit(20)).alias("i")).first()["i"]
    assert [r["text"] for r in rows if r["kind"] == "gap"] == ["… (lines 1–5 skipped)", "… (lines 11–12 skipped)", "… (lines 18–20 skipped)"]
    assert spark.range(1).select(R.ranges(F.array(*map(F.lit, near))).alias("r")).first()["r"] == [(6, 10), (13, 17)]


def test_context_goes_by_number(spark):
    hits = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(n == 3).alias("hit")) for n in (2, 3, 4)])
    assert spark.range(1).select(X.context(hits, 0).alias("k")).first()["k"] == [3]


LOG = ["start", "2026-09-26 08:00:00 a", "2026-09-26 09:30:00 b", "  at x", "2026-09-26T10:15:00 c", "[2026-09-26 11:00:00] d", "2026-09-26 12:00:00 e", "tail"]


def _ms(h, m=0):
    return int(datetime(2026, 9, 26, h, m, tzinfo=UTC).timestamp() * 1000)


def _log(spark):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(LOG, 1)], "file_id int, n int, text string")


def test_time_window(spark):
    now = datetime(2026, 10, 1, tzinfo=UTC)
    got = X.time_window(_log(spark), _ms(9, 30), _ms(11), now=now).orderBy("n").collect()
    assert [r["n"] for r in got] == [3, 4, 5, 6]
    assert [r["n"] for r in X.time_window(_log(spark), _ms(8), None, now=now).orderBy("n").collect()] == list(range(2, 9))


def test_stamps(spark):
    now = datetime(2026, 1, 2, tzinfo=UTC)
    lines = [("Dec 31 23:00:00 host x", datetime(2025, 12, 31, 23, tzinfo=UTC)), ("2026-09-26 only a date", None), ("no stamp", None),
             ("2026-09-26T13:00:00+03:00 z", datetime(2026, 9, 26, 10, tzinfo=UTC)), ("2026-09-26T13:00:00.250Z z", datetime(2026, 9, 26, 13, 0, 0, 250_000, tzinfo=UTC)),
             ("2026-09-31 00:00:00 rolls", datetime(2026, 10, 1, tzinfo=UTC))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "i int, text string")
    got = {r["i"]: r["own"] for r in X.stamped(df, now=now).collect()}
    assert got == {i: None if w is None else int(w.timestamp() * 1000) for i, (_, w) in enumerate(lines)}


def test_zones(spark):
    cases = [("2026-09-26 13:00:00", "Europe/Moscow", "2026-09-26 10:00"), ("2026-10-25 02:30:00", "Europe/Berlin", "2026-10-25 01:30"),
             ("2026-03-08 02:30:00", "America/New_York", "2026-03-08 06:30")]
    for text, tz, want in cases:
        got = X.stamped(spark.createDataFrame([(text,)], "text string"), tz=tz).first()["own"]
        assert got == int(datetime.fromisoformat(want).replace(tzinfo=UTC).timestamp() * 1000), (text, tz)


def test_names(spark):
    rows = [(1, "x.md", "vault", 1), (2, "x.md", "notes", 2), (3, "x.md", "vault", 3), (4, "y.md", "vault", 1)]
    got = {r["file_id"]: r["name"] for r in R.assign_names(spark.createDataFrame(rows, "file_id int, rel string, root string, root_index int")).collect()}
    assert got == {1: "#1/x.md", 2: "notes/x.md", 3: "#3/x.md", 4: "y.md"}


def test_tokens_and_chunks(spark):
    got = spark.range(1).select(R.estimate_tokens(F.lit("abcdef")).alias("a"), R.estimate_tokens(F.lit("привет")).alias("b")).first()
    assert (got["a"], got["b"]) == (2, 4)
    items = [(n, f"L{n}| line number {n} of the file") for n in range(1, 61)]
    chunks = R.cut(items, "=== file: a.md ===", 200)
    assert all(c[1] <= 200 for c in chunks) and chunks[1][2] == chunks[0][3] - 4
    assert {n for c in chunks for n in range(c[2], c[3] + 1)} == set(range(1, 61))
    df = spark.createDataFrame([(1, "a.md", [(1, "x" * 1000)])], "file_id int, name string, items array<struct<n:int,text:string>>")
    assert R.chunk_documents(df, 100).first()["chunk"] == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\n")
    (tmp_path / "b.txt").write_bytes("﻿два\n".encode("utf-16-le"))
    (tmp_path / "c.bin").write_bytes(b"x\0y")
    good, refused = L.read_files(spark, str(tmp_path))
    assert sorted(r["lines"] for r in good.collect()) == [["one", "two"], ["два"]]
    assert [r["reason"] for r in refused.collect()] == ["binary file"]


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c", "/a/b"), ("/a/bc", "/a/b")], "p string, r string").select("p", L.is_inside(F.col("p"), F.col("r")).alias("i"))
    assert {r["p"]: r["i"] for r in df.collect()} == {"/a/b/c": True, "/a/bc": False}
    r = spark.range(1).select(L.range_of(F.lit("/x/y.md#L3-L9")).alias("r")).first()["r"]
    assert (r["path"], r["first"], r["last"], r["valid"]) == ("/x/y.md", 3, 9, True)
    import re

    deny = re.compile(L.deny_pattern([".env", "*.pem", "secrets/**"]).replace("(?iu)", "(?i)"))
    assert [bool(deny.search(p)) for p in ("a/.env", "k/x.PEM", "secrets/a/b", "env", "a/b.md")] == [True, True, True, False, False]


def test_urls(spark):
    u = "https://me:pw@example.com/a/b?x=1&y=2#top"
    r = spark.range(1).select(L.url_name(F.lit(u)).alias("n"), L.masked_url(F.lit(u)).alias("m")).first()
    assert (r["n"], r["m"]) == ("example.com/a/b", "https://example.com/a/b?x=***&y=***")


def test_ledger_by_hand(spark):
    """Granted jobs and a day's spending against a loop over the events in order."""
    from linespan.streaming import usage as U

    sf = "/root/testdata/sf0.001"
    for cents in (20_000, 3_000):
        spent, want = {}, set()
        for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect():
            key, cost = (r["user_id"], f"{r['ts']:%Y-%m-%d}"), round(r["value"] * 100)
            ok = spent.get(key, 0) + cost <= cents
            spent[key] = spent.get(key, 0) + cost * ok
            want.add((r["user_id"], r["event_id"], key[1], ok, spent[key]))
        got = U.run_once(U.ledger(U.read_events(spark, sf), cents)).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_stamps_as_fixed(spark):
    """Offsets of two digits, fractions and the guards of the fixed patterns."""
    from datetime import UTC, datetime

    from linespan.operators import filters as X

    at = lambda *a: int(datetime(*a, tzinfo=UTC).timestamp() * 1000)
    rows = [
        ("2026-09-26 13:00:00+03 x", at(2026, 9, 26, 10)), ("[2026-09-26T13:00Z", at(2026, 9, 26, 13)), ("  2026-09-26 13:00:00", None), ("2026-09-26 13:00:00:5", None),
        ("2026-09-26 13:00:00.25", at(2026, 9, 26, 13) + 250), ("Dec 31 23:00:00.5 a", at(2025, 12, 31, 23) + 500), ("Dec 31 23:00:001", None), ("Dec  1 23:00:00 a", at(2025, 12, 1, 23)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "n int, text string")
    got = {r["n"]: r["own"] for r in X.stamped(df, now=datetime(2026, 1, 2, tzinfo=UTC)).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows]


def test_sent_lines_keep_blocks_that_begin_outside(spark):
    from linespan.operators import jobs as J

    lines = ["password: |", "  hunter2", "  more", "plain", "-----BEGIN RSA PRIVATE KEY-----", "abc", "-----END RSA PRIVATE KEY-----"]
    df = spark.createDataFrame([(1, lines), (2, None), (3, [])], "file_id long, lines array<string>")
    sent = J.sent_lines(df, "token|key", 0, first=2)
    assert [(r["n"], r["text"]) for r in sent.orderBy("n").collect()] == [(2, "  [token]"), (3, "  [token]"), (6, "[key]")]
    assert {(r["rule"], r["count"]) for r in J.mask_tally(sent).collect()} == {("kv_secret", 1), ("pem", 1)}


def test_edits_and_exports_odd_cases(spark):
    from linespan import sinks
    from linespan.operators import jobs as J

    said = [["[1,", "2]"], ["[1] x"], ['{"a":1}, {"b":2}'], ["", "NOT IN INPUT"], ["null"], []]
    df = spark.createDataFrame(list(enumerate(said)), "answer_id int, lines array<string>")
    got = {}
    for r in J.parse_edits(df).orderBy("answer_id", "pos").collect():
        got.setdefault(r["answer_id"], []).append(r["value"] if r["error"] is None else "error")
    assert got == {0: ["1", "2"], 1: ["error"], 2: ["error"], 4: ["null"]}
    targets = spark.createDataFrame([("relative.md", "r"), ("/else/a.md", "r"), ("/out/a.md", "r")], "path string, result_id string")
    there, none = spark.createDataFrame([("/out/a.md", "link")], "path string, kind string"), spark.createDataFrame([], sinks.MANIFEST)
    plan = {r["path"]: r["refused"] for r in sinks.plan_export(targets, there, none, ["/out"]).collect()}
    assert plan == {"relative.md": "not absolute", "/else/a.md": "outside the roots", "/out/a.md": "a symlink"}
    assert {r["refused"] for r in sinks.plan_export(targets, there, none, []).collect()} == {"export is off"}


def test_ranges_are_runs_of_consecutive_numbers(spark):
    from linespan.operators.render import ranges

    rows = [([1, 2, 3, 7, 9, 10],), ([5],), ([],), (None,)]
    got = [r.r for r in spark.createDataFrame(rows, "ns array<int>").coalesce(1).select(ranges(F.col("ns")).alias("r")).collect()]
    assert [[(x.a, x.b) for x in r] if r is not None else None for r in got] == [[(1, 3), (7, 7), (9, 10)], [(5, 5)], [], None]


def test_screening_without_a_cap_asks_a_price_of_every_endpoint(spark):
    from linespan.operators.analytics import cheapest_fitting, model_facts, screen

    ends = [("a/x", 1, 1000, 10, 1.0, 2.0), ("a/x", 2, 1000, 10, None, 2.0), ("a/y", 1, None, 10, 1.0, 2.0), ("a/z", 1, 500, 10, 1.0, 2.0)]
    e = spark.createDataFrame(ends, "model_id string, provider int, context int, max_out int, price_in double, price_out double")
    ids = spark.createDataFrame([(x,) for x in ("a/x", "a/y", "a/z", "a/Z:Free:ONLINE", "a/z:free")], "model_id string")
    facts, fits = model_facts(e), cheapest_fitting(e, 1.5, 2.5)
    found = {r.model_id: r.reason for r in screen(ids, facts, fits).collect()}
    assert found == {
        "a/x": "price unknown", "a/y": "no context length in the ZDR list", "a/z": None,
        "a/Z:Free:ONLINE": "refused variant suffix", "a/z:free": "no ZDR endpoint",
    }
    assert {r.model_id: r.reason for r in screen(ids, facts, fits, cap=(1.5, 2.5)).collect()}["a/x"] is None


def test_attachment_refs_name_one_file_or_a_problem(spark):
    from linespan.operators.render import attachment_refs

    parts = [("f", "attachment", "a.pdf", 5, 9), ("g", "attachment", " b\t.pdf ", 2, 4), ("h", "attachment", "b .pdf", 2, 4), ("f", "page", "p", 1, 9)]
    refs = [("a.pdf", 5, 9), (" a.pdf", 6, 12), ("a.pdf", 1, 6), ("b .pdf", 2, 3), ("p", 1, 1)]
    got = attachment_refs(
        spark.createDataFrame([(1, *r) for r in refs], "chunk int, name string, a int, b int"),
        spark.createDataFrame([(1, *p) for p in parts], "chunk int, file string, kind string, label string, start int, end int"), "chunk",
    ).collect()
    assert {(r.name.strip(), r.a): r.file or r.problem for r in got} == {
        ("a.pdf", 5): "f", ("a.pdf", 6): "L12 is not inside attachment a.pdf", ("a.pdf", 1): "L1 is not inside attachment a.pdf",
        ("b .pdf", 2): "ambiguous", ("p", 1): "unknown",
    }
