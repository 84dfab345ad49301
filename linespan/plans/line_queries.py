"""Registered queries over lines: sources, filters, masking, rendering; with their SQL."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mask as M
from ..operators import filters as X
from ..operators import render as R
from ..operators import sections as S
from ..session import table
from ..sources import ignores as I
from ..sources import lines as L

QUERIES, SQL = {}, {}
LICENCE = "(?i)licen[sc]e"
NOW = datetime(2026, 1, 2, tzinfo=UTC)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, sf_dir) -> DataFrame:
    return L.with_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


LINES = r"""
l AS (SELECT doc_id, a, len(a) AS total FROM (
        SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS a
        FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS p FROM documents))),
rows_ AS (SELECT doc_id, total, unnest(range(1, total + 1))::INT AS n, unnest(a) AS text FROM l)
"""
MATCHED = "regexp_matches(text, '(?i)licen[sc]e')"
NEAR = f"""
, h AS (SELECT *, {MATCHED} AS hit FROM rows_),
c AS (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY n RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h),
k AS (SELECT doc_id, total, n, text, hit FROM c WHERE near = 1)
"""


@query(f"WITH {LINES} SELECT doc_id, n, text FROM rows_")
def lines_explode(spark, sf_dir):
    """Every line of every document, numbered."""
    return L.explode_lines(_docs(spark, sf_dir), "doc_id")


@query(f"WITH {LINES} SELECT doc_id, n, text FROM rows_ WHERE n BETWEEN 3 AND 7")
def line_range(spark, sf_dir):
    df = _docs(spark, sf_dir).select("doc_id", F.inline(X.line_range(L.numbered(F.col("lines")), 3, 7)))
    return df.select("doc_id", "n", "text")


@query(f"WITH {LINES} SELECT doc_id, n, text FROM rows_ WHERE {MATCHED}")
def grep_match(spark, sf_dir):
    hit = F.filter(L.numbered(F.col("lines")), lambda x: X.matches(x["text"], LICENCE))
    return _docs(spark, sf_dir).select("doc_id", F.inline(hit))


def _near(spark, sf_dir, k: int = 2) -> DataFrame:
    """doc_id, lines, kept: numbered lines within k of a match."""
    df = _docs(spark, sf_dir)
    df = df.withColumn("hits", F.transform("lines", lambda x, i: F.struct((i + 1).alias("n"), X.matches(x, LICENCE).alias("hit"))))
    df = df.where(F.exists("hits", lambda h: h["hit"])).withColumn("near", X.context(F.col("hits"), k))
    return df.withColumn("kept", F.transform("near", lambda n: F.struct(n.alias("n"), F.get("lines", n - 1).alias("text"))))


@query(f"WITH {LINES} {NEAR} SELECT doc_id, n, text, hit FROM k")
def grep_context(spark, sf_dir):
    df = _near(spark, sf_dir).select("doc_id", F.inline("kept"))
    return df.select("doc_id", "n", "text", X.matches(F.col("text"), LICENCE).alias("hit"))


@query(f"WITH {LINES}, t AS (SELECT doc_id, count(*) AS matches FROM rows_ WHERE {MATCHED} GROUP BY 1) SELECT * FROM t")
def grep_counts(spark, sf_dir):
    df = _docs(spark, sf_dir).select("doc_id", F.size(F.filter("lines", lambda x: X.matches(x, LICENCE))).cast("long").alias("matches"))
    return df.where("matches > 0")


@query(
    f"""WITH {LINES} {NEAR},
p AS (SELECT *, coalesce(lag(n) OVER w, 0) AS prev, lead(n) OVER w AS nxt FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
g AS (SELECT doc_id, 2 * n - 1 AS pos, 'gap' AS kind, prev + 1 AS a, n - 1 AS b FROM p WHERE n > prev + 1
      UNION ALL SELECT doc_id, 2 * total + 1, 'gap', n + 1, total FROM p WHERE nxt IS NULL AND n < total)
SELECT doc_id, pos::INT AS pos, kind, CASE WHEN a = b THEN '… (line ' || a || ' skipped)' ELSE '… (lines ' || a || '–' || b || ' skipped)' END AS text FROM g
UNION ALL SELECT doc_id, (2 * n)::INT, 'line', 'L' || n || '| ' || text FROM k"""
)
def grep_windows(spark, sf_dir):
    """The flagship: matched lines with context, numbered, with gaps marked."""
    df = _near(spark, sf_dir)
    return df.select("doc_id", F.inline(R.items(F.col("kept"), F.size("lines")))).select("doc_id", "pos", "kind", "text")


@query(
    f"""WITH {LINES} {NEAR}, i AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM k)
SELECT doc_id, min(n) AS a, max(n) AS b FROM i GROUP BY doc_id, g"""
)
def ranges_islands(spark, sf_dir):
    return _near(spark, sf_dir).select("doc_id", F.inline(R.ranges(F.transform("kept", lambda x: x["n"]))))


@query(
    f"""WITH {LINES} SELECT doc_id, count(*) AS line_count, sum(ceil((strlen(text) + 1) / 3.0))::BIGINT AS tokens,
sum(strlen(text) + 1)::BIGINT AS bytes FROM rows_ GROUP BY 1"""
)
def token_estimate(spark, sf_dir):
    """Lines, estimated tokens (a line at a time) and bytes of each document."""
    costs = F.transform("lines", lambda x: R.estimate_tokens(F.concat(x, F.lit("\n"))))
    df = _docs(spark, sf_dir).select(
        "doc_id",
        F.size("lines").cast("long").alias("line_count"),
        F.aggregate(costs, F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1).alias("bytes"),
    )
    return df.where("line_count > 0")


@query(
    f"""WITH RECURSIVE {LINES}, t AS (SELECT doc_id, n, ceil((strlen(text) + 1) / 3.0)::BIGINT AS c FROM rows_),
f AS (SELECT doc_id, n, c, 1 AS chunk, c AS total FROM t WHERE n = 1
      UNION ALL SELECT t.doc_id, t.n, t.c, CASE WHEN f.total + t.c <= 400 THEN f.chunk ELSE f.chunk + 1 END,
                       CASE WHEN f.total + t.c <= 400 THEN f.total + t.c ELSE t.c END
      FROM f JOIN t ON t.doc_id = f.doc_id AND t.n = f.n + 1)
SELECT doc_id, chunk, min(n) AS first, max(n) AS last, sum(c)::BIGINT AS tokens FROM f GROUP BY doc_id, chunk"""
)
def chunk_greedy(spark, sf_dir):
    costs = F.transform("lines", lambda x, i: F.struct((i + 1).alias("n"), R.estimate_tokens(F.concat(x, F.lit("\n"))).alias("tokens")))
    return _docs(spark, sf_dir).select("doc_id", F.inline(R.chunks_native(costs, 400)))


@query()
def chunk_overlap(spark, sf_dir):
    """Chunks with repeated header and overlap; their text's length and hash."""
    df = _docs(spark, sf_dir).where(F.size("lines") > 0)
    made = df.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
                     R.items(L.numbered(F.col("lines")), F.size("lines")).alias("items"))
    out = R.chunk_documents(made, 2_000)
    return out.select(F.col("file_id").alias("doc_id"), "chunk", "tokens", "first", "last", F.md5("text").alias("text_md5"))


@query(
    r"""WITH f AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS root,
regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) AS rel FROM pages),
a AS (SELECT *, count(*) OVER (PARTITION BY rel) > 1 AS c FROM f),
b AS (SELECT *, CASE WHEN c THEN root || '/' || rel ELSE rel END AS s FROM a),
d AS (SELECT *, count(*) OVER (PARTITION BY s) > 1 AS e FROM b)
SELECT page_id, CASE WHEN e THEN '#' || page_id || '/' || rel ELSE s END AS name FROM d"""
)
def assign_names(spark, sf_dir):
    url = F.col("url")
    files = table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract(url, "://([^/?#]*)", 1).alias("root"),
        F.regexp_extract(url, "://[^/?#]*/?([^?#]*)", 1).alias("rel"),
        F.col("page_id").alias("root_index"),
    )
    return R.assign_names(files).select("page_id", "name")


@query(
    r"""WITH n AS (SELECT page_id, url, rtrim(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?', ''), '[?#].*$', ''), '/') AS s FROM pages),
m AS (SELECT page_id, s, regexp_replace(regexp_replace(url, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\1') AS b FROM n)
SELECT page_id, CASE WHEN length(s) > 80 THEN left(s, 40) || '…' || right(s, 39) ELSE s END AS name,
CASE WHEN strpos(b, '?') > 0 THEN left(b, strpos(b, '?') - 1) || regexp_replace(substr(b, strpos(b, '?')), '=[^&]*', '=***', 'g') ELSE b END AS masked FROM m"""
)
def url_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", L.url_name(url).alias("name"), L.masked_url(url).alias("masked"))


@query(
    r"""WITH t AS (SELECT page_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is') AS title,
regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<template\b.*?</template\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', '', 'gis') AS b FROM pages),
u AS (SELECT page_id, title || chr(10) || regexp_replace(regexp_replace(b, '</t[dh]>\s*<t[dh]\b[^>]*>', ' | ', 'gis'),
 '</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|main|pre|blockquote|hr|body|html)\b[^>]*>', chr(10), 'gis') AS b FROM t),
v AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', '', 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS b FROM u),
w AS (SELECT page_id, list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f' || chr(160) || ']+', ' ', 'g'))), lambda x: x <> '') AS a FROM v)
SELECT page_id, len(a)::BIGINT AS lines, a[1] AS title, md5(array_to_string(a, chr(10))) AS text_md5 FROM w"""
)
def html_lines(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", L.html_lines(F.col("html")).alias("a"))
    return df.select("page_id", F.size("a").cast("long").alias("lines"), F.get("a", F.lit(0)).alias("title"), F.md5(F.array_join("a", "\n")).alias("text_md5"))


# --- time: log lines made of events, a file a user; every third line has no stamp ---


def _log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  at "), F.col("event_type"))).otherwise(F.concat_ws(" ", stamp, "event_type"))
    return e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("n"), text.alias("text"))


STAMPS = """
e AS (SELECT user_id AS file_id, event_id AS n, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS own FROM events),
s AS (SELECT file_id, n, last_value(own IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS stamp FROM e)
"""


@query(f"WITH {STAMPS} SELECT * FROM s")
def time_locf(spark, sf_dir):
    return X.carry_stamp(_log(spark, sf_dir), now=NOW).select("file_id", "n", "stamp")


@query(f"WITH {STAMPS} SELECT file_id, n, stamp FROM s WHERE stamp BETWEEN epoch_ms(TIMESTAMP '2024-01-05') AND epoch_ms(TIMESTAMP '2024-01-20')")
def time_window(spark, sf_dir):
    ms = [int(datetime(2024, 1, d, tzinfo=UTC).timestamp() * 1000) for d in (5, 20)]
    return X.time_window(_log(spark, sf_dir), *ms, now=NOW).select("file_id", "n", "stamp")


@query(
    rf"""WITH {LINES}, t AS (SELECT doc_id, bool_or(regexp_matches(text, '^\[?\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}')) AS stamped FROM rows_ GROUP BY doc_id)
SELECT doc_id, 'no recognised timestamp' AS reason FROM t WHERE NOT stamped"""
)
def time_refused(spark, sf_dir):
    """Documents that a time filter refuses, as none of their lines starts with a time."""
    return X.unstamped(L.explode_lines(_docs(spark, sf_dir), "doc_id"), "doc_id", now=NOW)


@query(f"WITH {LINES}, t AS (SELECT doc_id, max(n) AS total FROM rows_ GROUP BY doc_id) SELECT doc_id, 'range starts after the end (' || total || ' lines)' AS reason FROM t WHERE total < 3")
def range_refused(spark, sf_dir):
    """Documents that a range of lines from 3 on refuses."""
    docs = _docs(spark, sf_dir).where(F.size("lines") > 0)
    return X.beyond_end(docs, F.lit(3), F.size("lines"), "doc_id")


@query(
    """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN epoch_us(timezone('Europe/Berlin', ts)) // 1000 END AS berlin_ms,
CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) // 1000 END AS utc_ms FROM events"""
)
def time_zones(spark, sf_dir):
    """Stamps read as local time of a zone."""
    df = X.stamped(_log(spark, sf_dir), "text", "Europe/Berlin", NOW).withColumnRenamed("own", "berlin_ms")
    return X.stamped(df, "text", "UTC", NOW).select(F.col("n").alias("event_id"), "berlin_ms", F.col("own").alias("utc_ms"))


# --- masking: lines of documents, and lines with secrets made of customers ---


def _secrets(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    h = F.md5(F.col("c_custkey").cast("string"))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    kinds = [
        F.concat(F.lit("id "), uuid, F.lit(" x")),
        F.concat(F.lit("hash "), h, F.lit(" end")),
        F.concat(F.lit("Bearer "), h),
        F.concat(F.lit("key sk-"), h, F.lit(" used")),
        F.concat(F.lit("ghp_"), h, F.lit(" by "), F.col("c_name")),
        F.concat(F.lit("https://user:"), h, F.lit("@example.com/x")),
        F.concat(F.lit("plain "), F.col("c_name"), F.lit(" sha "), F.sha1(F.col("c_name"))),
        F.concat(F.lit("ss://"), h, F.lit("@example.com")),
    ]
    pick = F.element_at(F.array(*kinds), (F.col("c_custkey") % 8 + 1).cast("int"))
    return c.select("c_custkey", "c_name", pick.alias("text"))


SECRETS = """
c AS (SELECT c_custkey, c_name, md5(c_custkey::VARCHAR) AS h FROM customer)
"""


@query(
    f"""WITH {SECRETS} SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'id [uuid] x' WHEN 1 THEN 'hash [id] end' WHEN 2 THEN 'Bearer [token]'
WHEN 3 THEN 'key [key] used' WHEN 4 THEN '[token] by ' || c_name WHEN 5 THEN 'https://[token]@example.com/x'
WHEN 6 THEN 'plain ' || c_name || ' sha ' || sha1(c_name) ELSE 'ss://[token]@example.com' END AS masked FROM c"""
)
def mask_rules_native(spark, sf_dir):
    return _secrets(spark, sf_dir).select("c_custkey", M.mask_text(F.col("text")).alias("masked"))


@query(
    f"""WITH {SECRETS} SELECT 'r' || (c_custkey % 8) AS line_kind, CASE c_custkey % 8 WHEN 0 THEN 'uuid' WHEN 1 THEN 'hex32' WHEN 2 THEN 'bearer'
WHEN 3 THEN 'sk_key' WHEN 4 THEN 'github_token' ELSE 'url_userinfo' END AS rule, count(*) AS masks FROM c WHERE c_custkey % 8 <> 6 GROUP BY 1, 2"""
)
def mask_counts(spark, sf_dir):
    df = _secrets(spark, sf_dir).select(F.concat(F.lit("r"), F.col("c_custkey") % 8).alias("line_kind"), M.mask_lines(F.array("text")).alias("m"))
    df = df.select("line_kind", F.explode(M.mask_counts(F.col("m"))).alias("rule", "k"))
    return df.groupBy("line_kind", "rule").agg(F.sum("k").alias("masks"))


@query(
    f"""WITH {LINES} SELECT doc_id, n, regexp_replace(text, '\\btoken = "[^"]*"', 'token = "[token]"', 'g') AS masked
FROM rows_ WHERE regexp_matches(text, '\\btoken = "[^"]*"')"""
)
def mask_kv(spark, sf_dir):
    """Pairs of a secret key and a value in documents: only documents that have any go to Python."""
    df = _docs(spark, sf_dir).where(F.col("text").rlike('\\btoken = "'))
    df = df.select("doc_id", F.posexplode(F.arrays_zip("lines", M.mask_lines(F.col("lines")).alias("m"))))
    df = df.select("doc_id", (F.col("pos") + 1).alias("n"), "col.lines", F.col("col.m.text").alias("masked"))
    return df.where(F.col("lines").rlike('\\btoken = "[^"]*"')).select("doc_id", "n", "masked")


# --- places ---


@query(
    f"""WITH {LINES} SELECT doc_id, n, 'attachment: part ' || ((n - 1) // 20 + 1) || ', p.' || ((n - 1) // 5 + 1) AS place FROM rows_"""
)
def interval_places(spark, sf_dir):
    """Lines in sections: every 5 lines a page, every 20 an attachment around the pages."""
    docs = _docs(spark, sf_dir)

    def sections(size: int, kind: str, label) -> DataFrame:
        count = F.ceil(F.size("lines") / size).cast("int")
        df = docs.where(F.size("lines") > 0).select("doc_id", F.explode(F.sequence(F.lit(1), count)).alias("num"))
        start = (F.col("num") - 1) * size + 1
        return df.select("doc_id", F.lit(kind).alias("kind"), "num", label.alias("label"), start.alias("start"), (start + size - 1).alias("end"))

    both = sections(5, "page", F.lit(None).cast("string")).unionByName(sections(20, "attachment", F.concat(F.lit("part "), F.col("num"))))
    return S.places(L.explode_lines(docs, "doc_id"), both, "doc_id")


@query(
    f"""WITH {LINES}, m AS (SELECT doc_id, n AS at, 'after ' || n AS text FROM rows_ WHERE n % 4 = 0)
SELECT doc_id, n, CASE WHEN n > 4 THEN 'after ' || (((n - 1) // 4) * 4) END AS marker FROM rows_"""
)
def asof_marker(spark, sf_dir):
    """The last marker ahead of each line: an as-of join."""
    rows = L.explode_lines(_docs(spark, sf_dir), "doc_id")
    markers = rows.where("n % 4 = 0").select("doc_id", F.col("n").alias("at"), F.concat(F.lit("after "), F.col("n")).alias("text"))
    return R.section_chain_rows(rows.select("doc_id", "n"), markers, "doc_id")


@query(
    r"""WITH f AS (SELECT page_id, regexp_replace(lower(url), '^[a-z]+://', '') AS p FROM pages)
SELECT page_id, regexp_matches(p, '^[^/?#]*\.example\.net(/|$)') AS denied FROM f"""
)
def deny_match(spark, sf_dir):
    """Paths under a denied name, by ignore-file rules."""
    p = F.regexp_replace(F.lower("url"), "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(p, r"[?#].*$", "").rlike(L.deny_pattern(["*.example.net"])).alias("denied"))


@query(
    r"""WITH f AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z]+://', '/'), '/?([?#].*)?$', '') AS path FROM pages),
p AS (SELECT page_id, path, string_split(path, '/') AS s FROM f),
q AS (SELECT page_id, path, s[2] AS host, CASE WHEN len(s) > 3 THEN s[3] END AS lang, s[-1] AS leaf FROM p)
SELECT page_id, path, coalesce(CASE
  WHEN NOT regexp_matches(host, '\.(net|org)$') OR path = '/' || host THEN false
  WHEN lang = 'de' THEN false
  WHEN lang = 'en' AND regexp_matches(leaf, '^4.*\.html$') THEN false
  WHEN lang = 'en' AND regexp_matches(leaf, '^9.0$') THEN true
  ELSE leaf LIKE '%.html' OR (lang = 'fr' AND leaf LIKE '1%') END, false) AS ignored FROM q"""
)
def nested_ignores(spark, sf_dir):
    """Pages as files below their hosts: hosts of net and org are repositories, with rules of their own and of some of their folders."""
    path = F.regexp_replace(F.regexp_replace("url", "^[A-Za-z]+://", "/"), r"/?([?#].*)?$", "")
    files = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    hosts = files.select(F.concat(F.lit("/"), F.get(F.split("path", "/"), F.lit(1))).alias("dir")).distinct()
    given = {"": ["# of a host", "*.html", "de/", "/fr/1*"], "/en": ["!4*.html", "9?0"], "/de": ["!*"]}
    lines = F.array(*[F.struct(F.lit(d).alias("below"), F.lit(k).alias("no"), F.lit(x).alias("line")) for d, xs in given.items() for k, x in enumerate(xs)])
    rules = hosts.select("dir", F.explode(lines).alias("r")).select(F.concat("dir", "r.below").alias("dir"), "r.no", "r.line")
    return I.nested_ignores(files, rules, hosts.where(F.col("dir").rlike(r"\.(net|org)$"))).select("page_id", "path", "ignored")


@query(
    """WITH p AS (SELECT c.* FROM conversations c)
SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role FROM p GROUP BY conv_id"""
)
def first_wins(spark, sf_dir):
    """Duplicates by key: the first in order stays."""
    df = L.first_of_each(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")
    return df.select("conv_id", "turn", "role")


