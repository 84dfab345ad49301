"""Documents as numbered lines.

A document's lines are an array column, so filters, context and gaps work on the
row where the text is and shuffle nothing; `explode_lines` makes rows of them
where a join needs rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_lines(text: Column) -> Column:
    """Lines of a text: every CR goes, LF ends a line, a last empty piece is no line."""
    parts = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.coalesce(whole, F.array().cast("array<string>"))


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("lines", split_lines(F.col(text)))


def explode_lines(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, text) with n from 1."""
    return docs.select(*keys, F.posexplode("lines").alias("p", "text")).select(*keys, (F.col("p") + 1).alias("n"), "text")


def numbered(lines: Column) -> Column:
    """The lines as structs of n and text."""
    return F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("text")))


def read_files(spark, *paths: str, glob: str | None = None, max_bytes: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """Files as (path, text, bytes, sha256, lines), and those refused as (path, reason)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(list(paths)).select("path", "content", F.col("length").alias("bytes"))
    start = F.hex(F.substring("content", 1, 2))
    charset = F.when(start == "FFFE", "UTF-16LE").when(start == "FEFF", "UTF-16BE").otherwise("UTF-8")
    nul = F.substring("content", 1, 8192).cast("string").contains("\0") & (charset == "UTF-8")
    raw = raw.withColumn("charset", charset).withColumn(
        "reason", F.when(F.col("bytes") > max_bytes, F.format_string("larger than %d bytes", F.lit(max_bytes))).when(nul, "binary file")
    )
    text = (
        F.when(F.col("charset") == "UTF-16LE", F.decode("content", "UTF-16LE"))
        .when(F.col("charset") == "UTF-16BE", F.decode("content", "UTF-16BE"))
        .otherwise(F.decode("content", "UTF-8"))
    )
    good = raw.where("reason is null").withColumn("text", F.regexp_replace(text, "^﻿", "")).withColumn("sha256", F.sha2("content", 256))
    return with_lines(good.select("path", "text", "bytes", "charset", "sha256")), raw.where("reason is not null").select("path", "reason")


def range_of(entry: Column) -> Column:
    """path, first and last of ``path#L3-L9``."""
    found = r"^(.*)#L(\d+)(?:-L?(\d+))?$"
    first = F.regexp_extract(entry, found, 2).try_cast("int")
    last = F.coalesce(F.regexp_extract(entry, found, 3).try_cast("int"), first)
    path = F.when(first.isNotNull(), F.regexp_extract(entry, found, 1)).otherwise(entry)
    return F.struct(path.alias("path"), first.alias("first"), last.alias("last"), (first.isNull() | ((first >= 1) & (first <= last))).alias("valid"))


def deny_pattern(globs: list[str]) -> str:
    """Ignore-file globs as one regular expression over slash paths, in any case and at any depth."""
    out = []
    for g in globs:
        g, anchored = g.rstrip("/"), "/" in g.rstrip("/")
        body, i = "", 0
        while i < len(g):
            if g.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif g.startswith("**", i):
                body, i = body + ".*", i + 2
            else:
                c = g[i]
                body += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() else c
                i += 1
        out.append(("^/?" if anchored else "(?:^|/)") + body.removeprefix("\\/") + "(?:/|$)")
    return "(?iu)(?:" + "|".join(out) + ")"


def is_inside(path: Column, root: Column) -> Column:
    """Whether path is root or below it, by whole segments."""
    p, r = F.split(F.rtrim(path, F.lit("/")), "/"), F.split(F.rtrim(root, F.lit("/")), "/")
    return F.slice(p, F.lit(1), F.size(r)) == r


def first_of_each(files: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in files.columns if c not in (key, order)]
    return files.groupBy(key).agg(F.min_by(F.struct(order, *rest), order).alias("s")).select(key, "s.*")


def too_many_files(files: DataFrame, job: str, max_files: int) -> DataFrame:
    """(job, reason) of jobs that name more than `max_files` files, each path counted once."""
    many = files.groupBy(job, "path").agg(F.lit(1).alias("one")).groupBy(job).agg(F.count("one").alias("n")).where(F.col("n") > max_files)
    return many.select(job, F.lit(f"too many files: more than max_files {max_files}").alias("reason"))


# --- pages -------------------------------------------------------------------


def url_name(url: Column) -> Column:
    """host/path of a url, without query; over 80 characters the middle goes."""
    name = F.rtrim(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?", ""), r"[?#].*$", ""), F.lit("/"))
    short = F.concat(F.substring(name, 1, 40), F.lit("…"), F.right(name, F.lit(39)))
    return F.when(F.length(name) > 80, short).otherwise(name)


def masked_url(url: Column) -> Column:
    """A url without credentials and fragment, every query value as ***."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")
    at = F.locate("?", bare)
    query = F.regexp_replace(bare.substr(at, F.length(bare)), r"=[^&]*", "=***")
    return F.when(at > 0, F.concat(bare.substr(F.lit(1), at - 1), query)).otherwise(bare)


def html_lines(html: Column) -> Column:
    """Lines of a page: the title first, then the text of the body, a line a block."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_replace(html, r"(?is)<(script|style|head|template|noscript)\b.*?</\1\s*>|<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?is)</t[dh]>\s*<t[dh]\b[^>]*>", " | ")
    body = F.regexp_replace(body, r"(?is)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|main|pre|blockquote|hr|body|html)\b[^>]*>", "\n")
    text = F.regexp_replace(F.concat(title, F.lit("\n"), body), r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    pieces = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f ]+", " ")))
    return F.filter(pieces, lambda x: x != "")
