"""Nested ignore files, and time filters on files that lie in many tasks."""

import re

import pytest
from pyspark.sql import functions as F

from linespan.config import InputError
from linespan.operators import filters as X
from linespan.sources import ignores as I


@pytest.mark.parametrize(
    ("rule", "yes", "no"),
    [
        ("*.log", ["a.log", "x/y/a.log", "d.log/"], ["a.logs", "alog"]),
        ("build/", ["build/", "a/build/"], ["build", "rebuild/"]),
        ("/top.md", ["top.md"], ["a/top.md"]),
        ("a/b", ["a/b", "a/b/"], ["x/a/b", "a/bc"]),
        ("**/logs", ["logs", "x/y/logs/"], ["xlogs"]),
        ("a/**/z", ["a/z", "a/b/c/z"], ["az", "x/a/z"]),
        ("a/**", ["a/x", "a/x/y"], ["a", "b/a/x"]),
        ("x?[0-9]", ["xa1", "p/xb2"], ["x/1", "xab"]),
        ("[!a]c", ["bc"], ["ac", "/c"]),
        (r"\#note", ["#note"], ["note"]),
        (r"\!bang", ["!bang"], ["bang"]),
        ("end  ", ["end"], ["end  "]),
        ("a.b(c)+", ["a.b(c)+"], ["aXb(c)+", "a.bcc"]),
    ],
)
def test_rules(rule, yes, no):
    negative, regex = I.ignore_regex(rule)
    assert not negative and all(re.search(regex, p) for p in yes) and not any(re.search(regex, p) for p in no)


def test_lines_that_are_no_rules():
    assert [I.ignore_regex(x) for x in ("", "  ", "# note", None, "/")] == [None] * 5
    assert I.ignore_regex("!keep.md") == (True, I.ignore_regex("keep.md")[1])


def _ignored(spark, paths, rules, repositories):
    files = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, k int")
    given = spark.createDataFrame([(d, n, x) for d, xs in rules.items() for n, x in enumerate(xs)], "dir string, no int, line string")
    got = I.nested_ignores(files, given, spark.createDataFrame([(d,) for d in repositories], "dir string")).collect()
    assert len(got) == len(paths)
    return sorted(r["path"] for r in got if r["ignored"])


def test_deeper_files_come_after_and_ignored_folders_stay(spark):
    paths = ["/r/a.md", "/r/build/b.md", "/r/x.tmp.md", "/r/docs/draft1.md", "/r/docs/draft-keep.md", "/r/docs/c.md", "/r/out/keep.md", "/r/out/in/keep.md", "/r/lib/out/z.md", "/r/lib/out/y.md"]
    rules = {"/r": ["build/", "*.tmp.md", "", "out/", "!keep.md"], "/r/docs": ["draft*.md", "!draft-keep.md"], "/r/lib/out": ["!z.md"]}
    want = ["/r/build/b.md", "/r/docs/draft1.md", "/r/lib/out/y.md", "/r/out/in/keep.md", "/r/out/keep.md", "/r/x.tmp.md"]
    assert _ignored(spark, paths, rules, ["/r"]) == want


def test_only_the_nearest_repository_counts(spark):
    paths = ["/r/a.md", "/r/sub/a.md", "/r/sub/b.md", "/else/a.md", "/a.md", "/r/sub/deep/b.md"]
    rules = {"/r": ["a.md", "b.md"], "/r/sub": ["/b.md"], "/else": ["a.md"], "": ["a.md"]}
    assert _ignored(spark, paths, rules, ["/r", "/r/sub"]) == ["/r/a.md", "/r/sub/b.md"]
    assert _ignored(spark, paths, rules, []) == []
    assert _ignored(spark, ["/a.md", "/b.md"], rules, [""]) == ["/a.md"]
    assert _ignored(spark, [], rules, ["/r"]) == []


def test_one_log_over_many_tasks(spark):
    """Stamps are carried over ranges of lines; files without one are named."""
    text = F.when(F.col("id") % 40 == 7, F.concat(F.lit("2024-01-01 00:"), F.lpad((F.col("id") / 40).cast("int").cast("string"), 2, "0"), F.lit(":00 x"))).otherwise(F.lit("  more"))
    log = spark.range(400).select(F.lit("big").alias("file_id"), (F.col("id") + 1).cast("int").alias("n"), text.alias("text"))
    log = log.unionByName(spark.createDataFrame([("bare", 1, "no time"), ("bare", 2, "")], "file_id string, n int, text string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["n"]: r for r in X.carry_stamp(log).where("file_id = 'big'").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    base = 1_704_067_200_000
    assert [got[n]["stamp"] for n in range(1, 401)] == [None if n < 8 else base + 60_000 * ((n - 8) // 40) for n in range(1, 401)]
    assert got[8]["text"].startswith("2024") and got[9]["own"] is None
    assert [tuple(r) for r in X.unstamped(log).collect()] == [("bare", "no recognised timestamp")]
    with pytest.raises(InputError):
        X.time_window(log, None, None)
    with pytest.raises(InputError):
        X.time_window(log, 2, 1)
