"""Registered queries over sections and the chunks of whole jobs; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import sections as S
from ..session import table
from ..sources import lines as L
from .line_queries import LINES, MATCHED, _docs, _near

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sectioned(docs: DataFrame) -> DataFrame:
    """Documents with `sections` and `markers`: every 5 lines a page, every 20 an attachment around its pages.
    Documents with a third of a line over lack the attachments' markers, so there markers and sections don't pair."""
    size = F.size("lines")
    spans = lambda step, rank, word: F.transform(
        F.sequence(F.lit(1), F.ceil(size / step).cast("int")),
        lambda k: F.struct(((k - 1) * step + 1).alias("start"), F.lit(rank).alias("rank"), F.least(k * step, size).alias("end"), F.concat(F.lit(word), k.cast("string"), F.lit(" ---")).alias("text")),
    )
    both = F.when(size > 0, F.array_sort(F.concat(spans(20, 0, "--- attachment: part "), spans(5, 1, "--- page ")))).otherwise(F.array())
    sections = F.transform("both", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    shown = F.when(size % 3 == 0, F.filter("both", lambda s: s["rank"] == 1)).otherwise(F.col("both"))
    markers = F.transform(shown, lambda s: F.struct((s["start"] - 1).alias("at"), s["text"].alias("text")))
    return docs.withColumn("both", both).select("doc_id", sections.alias("sections"), markers.alias("markers"))


def _sent(text, n):
    return F.concat(F.lit("L"), n.cast("string"), F.lit("| "), text)


@query(
    f"""WITH {LINES} SELECT doc_id, n, CASE WHEN total % 3 = 0 THEN NULL ELSE '--- attachment: part ' || ((n - 1) // 20 + 1) || ' --- > --- page ' || ((n - 1) // 5 + 1) || ' ---' END AS chain,
'--- page ' || ((n - 1) // 5 + 1) || ' ---' AS mark,
CASE WHEN n % 20 = 1 AND total % 3 <> 0 THEN '--- attachment: part ' || ((n - 1) // 20 + 1) || ' --- > ' ELSE '' END
  || CASE WHEN n % 5 = 1 THEN '--- page ' || ((n - 1) // 5 + 1) || ' ---' ELSE '' END AS ahead
FROM rows_"""
)
def section_chains(spark, sf_dir):
    """The chain of sections around every line, the last marker and what is shown ahead of the line."""
    docs = _docs(spark, sf_dir)
    rows = docs.select("doc_id", F.size("lines").alias("total"), F.inline(S.shown_lines(L.numbered(F.col("lines")))))
    df = S.with_sections(rows.drop("text"), _sectioned(docs), ["doc_id"])
    texts = lambda c: F.array_join(F.transform(c, lambda m: m["text"]), " > ")
    return df.select("doc_id", "n", F.when(F.col("chain").isNotNull(), texts("chain")).alias("chain"), "mark", texts("pre").alias("ahead"))


@query(
    f"""WITH {LINES},
h AS (SELECT *, {MATCHED} AS hit FROM rows_),
c AS (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY n RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM h),
k AS (SELECT doc_id, total, n, text, coalesce(lag(n) OVER w, 0) AS prev, lead(n) OVER w AS nxt FROM c WHERE near = 1 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
m AS (SELECT *, 'L' || n || '| ' || text AS line, '--- attachment: part ' || ((n - 1) // 20 + 1) || ' ---' AS att, '--- page ' || ((n - 1) // 5 + 1) || ' ---' AS page,
        (n - 1) // 5 * 5 + 1 AS page_at FROM k),
p AS (SELECT doc_id, n, 0 AS o, CASE WHEN prev + 1 = n - 1 THEN '… (line ' || (n - 1) || ' skipped)' ELSE '… (lines ' || (prev + 1) || '–' || (n - 1) || ' skipped)' END AS text FROM m WHERE n > prev + 1
  UNION ALL SELECT doc_id, n, 1, att FROM m WHERE total % 3 <> 0 AND (n > prev + 1 OR n % 20 = 1)
  UNION ALL SELECT doc_id, n, 2, page FROM m WHERE (n > prev + 1 AND (total % 3 <> 0 OR page_at > prev)) OR (n = prev + 1 AND n % 5 = 1)
  UNION ALL SELECT doc_id, n, 3, line FROM m
  UNION ALL SELECT doc_id, n, 4, CASE WHEN n + 1 = total THEN '… (line ' || total || ' skipped)' ELSE '… (lines ' || (n + 1) || '–' || total || ' skipped)' END FROM m WHERE nxt IS NULL AND n < total)
SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY n, o)) AS sent_md5, count(*) AS items FROM p GROUP BY doc_id"""
)
def marked_windows(spark, sf_dir):
    """Matched lines with context as they are sent: gaps, sections around what follows a gap, markers on the way."""
    near = _near(spark, sf_dir)
    rows = near.select("doc_id", F.size("lines").alias("total"), F.inline(S.shown_lines(F.col("kept"))))
    df = S.with_sections(rows, _sectioned(near), ["doc_id"])
    text = F.concat_ws("\n", F.transform("pre", lambda m: m["text"]), _sent(F.col("text"), F.col("n")), "post")
    sent = df.select("doc_id", "n", text.alias("text"), (F.size("pre") + 1 + F.col("post").isNotNull().cast("int")).alias("items"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")  # one document's windows
    return sent.groupBy("doc_id").agg(F.md5(whole.cast("binary")).alias("sent_md5"), F.sum("items").alias("items"))


def _job_lines(spark, sf_dir) -> DataFrame:
    """A job a source: its documents are the files, whole and in the order of their ids."""
    docs = L.with_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = docs.select(F.coalesce("source", F.lit("none")).alias("job"), "doc_id", F.size("lines").alias("total"), F.inline(S.shown_lines(L.numbered(F.col("lines")))))
    return rows.withColumns({"file_no": F.col("doc_id"), "name": F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")), "multi": F.lit(True), "text": _sent(F.col("text"), F.col("n"))})


def _plain(spark, sf_dir) -> DataFrame:
    link = "array<struct<ref:int,text:string>>"
    bare = {"pre": F.array().cast("array<struct<kind:string,ref:int,text:string>>"), "chain": F.lit(None).cast(link), "mark": F.lit(None).cast("string"), "post": F.lit(None).cast("string")}
    return C.job_rows(_job_lines(spark, sf_dir).withColumns(bare))


BUDGET, SMALL = 12_000, 1_000
JOBS = rf"""
d AS (SELECT coalesce(source, 'none') AS job, doc_id, 'doc-' || doc_id || '.txt' AS name, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS p FROM documents),
e AS (SELECT job, doc_id, name, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS a FROM d),
r AS (SELECT job, doc_id, name, unnest(range(1, len(a) + 1))::INT AS n, unnest(a) AS line FROM e),
i AS (SELECT *, 'L' || n || '| ' || line AS text, ceil((strlen('=== file: ' || name || ' ===') + 1) / 3.0)::BIGINT AS head,
        ceil((strlen('L' || n || '| ' || line) + 1) / 3.0)::BIGINT AS cost, row_number() OVER (PARTITION BY job ORDER BY doc_id, n) AS g FROM r)
"""


@query(
    f"""WITH RECURSIVE {JOBS},
ok AS (SELECT job FROM i GROUP BY job HAVING max(head + cost) <= {BUDGET}),
t AS (SELECT i.*, sum(cost + CASE WHEN n = 1 THEN head ELSE 0 END) OVER (PARTITION BY job ORDER BY g)::BIGINT AS upto FROM i JOIN ok USING (job)),
b AS (SELECT x.job, x.g, x.n, x.head, x.cost, x.upto, k.k, sum(y.cost) AS weight FROM t x, (SELECT unnest(range(1, 6)) AS k) k
      JOIN t y ON y.job = x.job AND y.g BETWEEN x.g - k.k AND x.g - 1 WHERE k.k <= x.n - 1 GROUP BY ALL),
c AS (SELECT job, g, max(k) AS k, arg_max(weight, k) AS weight FROM b WHERE head + cost + weight <= {BUDGET} GROUP BY job, g),
s AS (SELECT t.*, coalesce(c.k, 0) AS k, CASE WHEN n > 1 THEN head + coalesce(weight, 0) ELSE 0 END AS again, upto - cost - CASE WHEN n = 1 THEN head ELSE 0 END AS ahead FROM t LEFT JOIN c USING (job, g)),
z AS (SELECT s.*, coalesce((SELECT min(u.g) FROM t u WHERE u.job = s.job AND u.upto > {BUDGET} - s.again + s.ahead), (SELECT max(u.g) + 1 FROM t u WHERE u.job = s.job)) AS nxt FROM s),
w AS (SELECT job, 1::BIGINT AS chunk, g, k, again, ahead, nxt FROM z WHERE g = 1
      UNION ALL SELECT z.job, w.chunk + 1, z.g, z.k, z.again, z.ahead, z.nxt FROM w JOIN z ON z.job = w.job AND z.g = w.nxt),
p AS (SELECT w.job, w.chunk, t.g, t.name, t.n, CASE WHEN t.n = 1 OR t.g = w.g - w.k THEN '=== file: ' || t.name || ' ===' || chr(10) ELSE '' END || t.text AS text,
        w.again - w.ahead + max(t.upto) OVER (PARTITION BY w.job, w.chunk) AS tokens
      FROM w JOIN t ON t.job = w.job AND t.g BETWEEN w.g - w.k AND w.nxt - 1)
SELECT job, chunk, md5(string_agg(text, chr(10) ORDER BY g)) AS text_md5, max(tokens)::BIGINT AS tokens, arg_min(name, g) AS first_name, arg_min(n, g) AS first_n, arg_max(name, g) AS last_name, arg_max(n, g) AS last_n,
  count(*) AS n_lines, count(DISTINCT name) AS n_files FROM p GROUP BY job, chunk"""
)
def job_chunks(spark, sf_dir):
    """Chunks of jobs of many files: greedy over the whole job, breaks repeat the header and up to five lines."""
    df = C.chunk_jobs(_plain(spark, sf_dir), BUDGET)
    lines = F.aggregate("lines", F.lit(0).cast("long"), lambda a, f: a + F.aggregate(f["ranges"], F.lit(0).cast("long"), lambda b, r: b + r["b"] - r["a"] + 1))
    return df.select("job", "chunk", F.md5(F.col("text").cast("binary")).alias("text_md5"), "tokens", "first_name", "first_n", "last_name", "last_n", lines.alias("n_lines"), F.size("lines").cast("long").alias("n_files"))


@query(
    f"""WITH {JOBS}, f AS (SELECT job, arg_min(name || ':L' || n, g) AS place, arg_min(cost, g) AS tokens FROM i WHERE head + cost > {SMALL} GROUP BY job) SELECT * FROM f"""
)
def job_chunks_refused(spark, sf_dir):
    """Jobs in which one line doesn't fit a chunk, with the first such line."""
    return C.refused_jobs(_plain(spark, sf_dir), SMALL)


@query()
def job_chunks_marked(spark, sf_dir):
    """The same jobs with sections: a break repeats the chain of the chunk's first line.  Tested against chunks cut in one pass."""
    docs = _docs(spark, sf_dir)
    lines = _job_lines(spark, sf_dir)
    marked = S.with_sections(lines.drop("text"), _sectioned(docs), ["doc_id"])
    df = C.chunk_jobs(C.job_rows(marked, lines), BUDGET)
    return df.select("job", "chunk", "tokens", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lines")


@query(
    f"""WITH {JOBS}, s AS (SELECT job, sum(strlen(text) + 1 + CASE WHEN n = 1 THEN strlen('=== file: ' || name || ' ===') + 1 ELSE 0 END)::BIGINT AS bytes FROM i GROUP BY job)
SELECT job, 'job too large after filtering: ' || bytes || ' bytes > max_job_bytes 100000' AS reason FROM s WHERE bytes > 100000"""
)
def jobs_too_large(spark, sf_dir):
    """Jobs whose lines and headers are larger than a job may be."""
    return C.oversized_jobs(_plain(spark, sf_dir), 100_000)


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT source, 'too many files: more than max_files 40' AS reason FROM c WHERE n > 40""")
def jobs_of_too_many_files(spark, sf_dir):
    """Sources with more documents than a job may have files."""
    files = table(spark, sf_dir, "documents").where("source is not null").select("source", F.col("doc_id").cast("string").alias("path"))
    return L.too_many_files(files, "source", 40)
