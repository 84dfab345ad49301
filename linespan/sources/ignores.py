"""Nested ignore files: which paths of a repository its rules leave out.

A rule belongs to a directory and speaks of what is below it.  In one directory the last rule that matches
decides, and what is below an ignored directory stays ignored; a deeper directory's rules come after
those above it and may take a path back.  Only directories from the nearest repository's root down count.

Rules reach their descendants by a join of every directory's ancestors with the directories that have
rules, on equality.  Directories are judged once, however many files they hold; a file then meets one row, its
directory's chain of rules, and is judged by expressions on that row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE = "negative boolean, regex string"


def ignore_regex(line: str | None) -> tuple[bool, str] | None:
    """Whether a rule takes back, and a pattern for paths below its directory (those of directories end with /)."""
    text = re.sub(r"(?<!\\)[ \t]+$", "", (line or "").rstrip("\r\n"))
    if not text or text.startswith("#"):
        return None
    negative, text = text.startswith("!"), text.removeprefix("!")
    only_dirs, text = text.endswith("/"), text.rstrip("/") if text.endswith("/") else text
    anchored, text = "/" in text, text.removeprefix("/")
    if not text:
        return None
    if text.endswith("/**"):
        return negative, f"^{'' if anchored else '(?:.*/)?'}{_body(text[:-3])}/.+$"
    return negative, f"^{'' if anchored else '(?:.*/)?'}{_body(text)}{'/' if only_dirs else '/?'}$"


def _body(text: str) -> str:
    token = re.compile(r"\*\*/|/\*\*/|\*+|\?|\[[!^]?\]?[^\]/]*\]|\\.|.", re.S)
    out, at = "", 0
    while at < len(text):
        m = re.compile(r"/\*\*(?=/)").match(text, at)
        if m:  # any number of directories between
            out, at = out + "(?:/.*)?", m.end()
            continue
        m = token.match(text, at)
        t, at = m[0], m.end()
        if t == "**/" and m.start() == 0:
            out += "(?:.*/)?"
        elif t.startswith("*"):
            out += "[^/]*" + ("/" if t.endswith("/") else "")
        elif t == "?":
            out += "[^/]"
        elif t.startswith("[") and len(t) > 2:
            body = t[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^/" + body[1:] if body[0] in "!^" else body) + "]"
        else:
            out += re.sub(r"([^A-Za-z0-9_/])", r"\\\1", t[-1])
    return out


def _prefixes(path: Column, least: int) -> Column:
    """A path's directories from the top, itself included; the top is the empty path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(least), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def _decision(rules: Column, path: Column) -> Column:
    """true: ignored; false: taken back; null: no rule matches."""
    hit = F.filter(rules, lambda r: F.regexp_like(path, r["regex"]))
    return F.when(F.size(hit) > 0, ~F.element_at(hit, -1)["negative"])


def nested_ignores(files: DataFrame, rules: DataFrame, repositories: DataFrame) -> DataFrame:
    """files (path, ...) with `ignored`; rules are (dir, no, line) in the order of no, repositories (dir).  Paths are absolute, with slashes."""

    @F.pandas_udf(RULE)
    def parsed(lines: pd.Series) -> pd.DataFrame:
        found = [ignore_regex(x) or (None, None) for x in lines]
        return pd.DataFrame(found, columns=["negative", "regex"])

    packed = rules.select("dir", "no", parsed("line").alias("r")).where("r.regex is not null")
    packed = packed.groupBy("dir").agg(F.sort_array(F.collect_list(F.struct("no", "r.negative", "r.regex"))).alias("rules"))  # an ignore file's rules
    files = files.withColumn("_dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    dirs = files.select(F.col("_dir").alias("at")).distinct().withColumn("dir", F.explode(_prefixes(F.col("at"), 1)))
    marked = dirs.join(packed, "dir", "left").join(repositories.select("dir").distinct().withColumn("repo", F.lit(True)), "dir", "left")
    links = marked.where("rules is not null or repo").groupBy("at").agg(
        F.sort_array(F.collect_list(F.struct(F.length("dir").alias("depth"), "dir", "rules"))).alias("links"), F.max(F.when(F.col("repo"), F.length("dir"))).alias("root")
    )  # a row for each level of a path at most

    def dead(at: Column, link: Column) -> Column:
        below = F.filter(_prefixes(at, 1), lambda q: F.length(q) > link["depth"])
        return F.exists(below, lambda q: F.coalesce(_decision(link["rules"], F.concat(F.substr(q, link["depth"] + 2), F.lit("/"))), F.lit(False)))

    within = F.filter("links", lambda x: x["rules"].isNotNull() & (x["depth"] >= F.col("root")))
    chain = F.transform(within, lambda x: F.struct(x["depth"].alias("depth"), dead(F.col("at"), x).alias("dead"), x["rules"].alias("rules")))
    chains = links.where("root is not null").select("at", chain.alias("chain"))

    def step(state: Column, x: Column) -> Column:
        own = _decision(x["rules"], F.substr(F.col("path"), x["depth"] + 2))
        return F.when(x["dead"], F.lit(True)).otherwise(F.coalesce(own, state))

    met = files.join(chains, files["_dir"] == chains["at"], "left")
    state = F.aggregate(F.coalesce("chain", F.array()), F.lit(False), step)
    return met.withColumn("ignored", F.when(F.col("chain").isNull(), False).otherwise(state)).drop("_dir", "at", "chain")
