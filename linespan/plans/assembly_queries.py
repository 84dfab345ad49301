"""Registered queries of checks over jobs of several files, and of results put together; with their SQL.

A job is four documents; its chunk k carries block k (six lines) of each of them, and the block's last line again in
chunk k + 1.  Names hold brackets, commas and what looks like a reference.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sinks as K
from ..operators import assembly as A
from ..operators import checks as C
from ..operators import jobs as J
from ..operators import quotes as Q
from ..session import shared_dir, table
from ..sources import lines as L
from .line_queries import LINES

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _carried(spark, sf_dir) -> DataFrame:
    rows = L.explode_lines(L.with_lines(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    k = F.floor((F.col("n") - 1) / 6).cast("int") + 1
    part = (F.col("doc_id") % 4).cast("string")
    name = F.concat(F.lit("in ("), part, F.lit(":L"), part, F.lit(")/doc, "), F.col("doc_id").cast("string"), F.lit(".txt"))
    job = F.floor(F.col("doc_id") / 4).cast("long")
    rows = rows.select(job.alias("job"), F.explode(F.when(F.col("n") % 6 == 0, F.array(k, k + 1)).otherwise(F.array(k))).alias("chunk"), "doc_id", name.alias("name"), "n", "text")
    return rows.withColumn("at", F.col("doc_id") * 1_000_000 + F.col("n"))


CARRIED = f"""{LINES},
carried AS (SELECT doc_id // 4 AS job, unnest(CASE WHEN n % 6 = 0 THEN [(n - 1) // 6 + 1, (n - 1) // 6 + 2] ELSE [(n - 1) // 6 + 1] END)::INT AS chunk, doc_id,
  'in (' || (doc_id % 4) || ':L' || (doc_id % 4) || ')/doc, ' || doc_id || '.txt' AS name, n, text, doc_id * 1000000 + n AS spot FROM rows_)"""
FOLD = "trim(regexp_replace(replace({}, chr(173), ''), '\\s+', ' ', 'g'))"


def _missed(spark, sf_dir) -> DataFrame:
    """Quotes that are looked for: cut out of the middle of lines, folded anew, of two words, of two letters, and of nothing."""
    c = _carried(spark, sf_dir)
    t, k = F.col("text"), F.col("n") % 5
    quote = (
        F.when(k == 0, F.substring(t, 3, 40)).when(k == 1, F.concat(F.lit(" "), F.replace(F.substring(t, 1, 30), F.lit(" "), F.lit("   "))))
        .when(k == 2, F.concat_ws(" ", F.slice(F.split(t, " "), 2, 2))).when(k == 3, F.substring(t, 4, 2)).otherwise(F.concat(F.lit("zz"), F.substring(t, 1, 20)))
    )
    return c.select("job", "chunk", "name", "n", quote.alias("quote"))


@query(
    f"""WITH {CARRIED}, q AS (SELECT job, chunk, name, n, CASE n % 5 WHEN 0 THEN substr(text, 3, 40) WHEN 1 THEN ' ' || replace(substr(text, 1, 30), ' ', '   ')
  WHEN 2 THEN array_to_string(string_split(text, ' ')[2:3], ' ') WHEN 3 THEN substr(text, 4, 2) ELSE 'zz' || substr(text, 1, 20) END AS quote FROM carried),
f AS (SELECT *, {FOLD.format('quote')} AS folded FROM q), u AS (SELECT job, chunk, name, n, spot, {FOLD.format('text')} AS folded FROM carried),
m AS (SELECT f.job, f.chunk, f.name, f.n, arg_min(u.name || ':L' || u.n, u.spot) AS found FROM f JOIN u ON u.job = f.job AND u.chunk = f.chunk AND f.folded <> '' AND contains(u.folded, f.folded) GROUP BY ALL)
SELECT f.job, f.chunk, f.name, f.n, m.found FROM f LEFT JOIN m USING (job, chunk, name, n)"""
)
def quotes_found(spark, sf_dir):
    """The first line of its chunk, over several files, that holds a quote."""
    return Q.find_quotes(_missed(spark, sf_dir), _carried(spark, sf_dir)).select("job", "chunk", "name", "n", "found")


def _answers(spark, sf_dir) -> DataFrame:
    """A quote of every carried line: by its whole name, by a beginning of it that isn't one, of an unknown file, without a name, with a place, or changed."""
    c = _carried(spark, sf_dir)
    n, k = F.col("n").cast("string"), F.col("n") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("  "), "name", F.lit(":L"), n, F.lit(" (p.2)| "), "text")).when(k == 1, F.concat(F.lit("in (0:L"), n, F.lit("| "), "text"))
        .when(k == 2, F.concat(F.lit("L"), n, F.lit("| "), "text")).when(k == 3, F.concat("name", F.lit(":L"), n, F.lit("| :L3| "), "text"))
        .when(k == 4, F.concat("name", F.lit(":L"), n, F.lit("|"), "text")).otherwise(F.concat(F.lit("say "), "text"))
    )
    return c.select("job", "chunk", F.col("at").alias("pos"), raw.alias("raw"))


ANSWERS = f"""{CARRIED}, a AS (SELECT job, chunk, spot AS pos, name, n, text, n % 6 AS k,
  (SELECT count(DISTINCT x.name) FROM carried x WHERE x.job = carried.job AND x.chunk = carried.chunk) AS files FROM carried),
i AS (SELECT job, chunk, pos, name, n, CASE k WHEN 1 THEN 'bad' WHEN 2 THEN CASE WHEN files = 1 THEN 'ok' ELSE 'bad' END WHEN 3 THEN 'bad' WHEN 5 THEN 'bad' ELSE 'ok' END AS status,
  CASE k WHEN 1 THEN 'unknown file name' WHEN 2 THEN CASE WHEN files > 1 THEN 'file name missing (several files)' END
    WHEN 3 THEN 'text differs from the source line' WHEN 5 THEN 'not a quoted input line' END AS reason FROM a)"""


@query(f"WITH {ANSWERS} SELECT job, chunk, pos, status, reason FROM i")
def extract_files(spark, sf_dir):
    """Quotes against chunks of several files: the longest carried name that a line begins with is meant."""
    return C.check_extract(_answers(spark, sf_dir), _carried(spark, sf_dir)).select("job", "chunk", "pos", "status", "reason")


@query(
    f"""WITH {ANSWERS}, g AS (SELECT *, row_number() OVER (PARTITION BY job, name, n ORDER BY chunk, pos) AS no FROM i WHERE status <> 'bad'),
u AS (SELECT job, chunk, pos, status FROM g WHERE no = 1 UNION ALL SELECT job, chunk, pos, status FROM i WHERE status = 'bad')
SELECT job, chunk, pos, status, row_number() OVER (PARTITION BY job ORDER BY chunk, pos) AS result_line FROM u"""
)
def assembled_extract(spark, sf_dir):
    """The lines of a job's result: overlaps once, numbered over all chunks."""
    items = C.dedupe_extract(C.check_extract(_answers(spark, sf_dir), _carried(spark, sf_dir)))
    return A.assemble_extract(items.select("job", "chunk", "pos", "status"))


def _drafts(spark, sf_dir) -> DataFrame:
    """An answer a chunk: a claim about each line that quotes its first word, cites its name and ends with a word of the next number's line; every seventh chunk did not finish."""
    c = _carried(spark, sf_dir)
    first = F.get(F.split("text", " "), F.lit(0))
    claim = F.concat(F.lit("The word `"), F.replace(first, F.lit("`"), F.lit("'")), F.lit("` stands there ("), "name", F.lit(":L"), F.when(F.col("n") % 4 == 3, F.col("n") + 500).otherwise(F.col("n")).cast("string"), F.lit(")"))
    line = F.when(F.col("n") % 4 == 0, F.lit("## About this")).when(F.col("n") % 4 == 1, claim).when(F.col("n") % 4 == 2, F.concat(F.lit("No source for "), F.col("n").cast("string"))).otherwise(claim)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"])
    body = F.concat(F.array_join(texts, "\n"), F.lit(" \n\n"))
    return c.groupBy("job", "chunk").agg(F.when((F.col("job") + F.col("chunk")) % 7 != 0, body).alias("body"))


def _spans(spark, sf_dir) -> DataFrame:
    ends = [F.min_by(F.struct("name", "n"), "at").alias("a"), F.max_by(F.struct("name", "n"), "at").alias("b")]
    c = _carried(spark, sf_dir).groupBy("job", "chunk").agg(*ends)
    return c.select("job", "chunk", J.span_text(F.col("a.name"), F.col("a.n"), F.col("b.name"), F.col("b.n")).alias("span"))


DRAFTS = f"""{CARRIED}, s AS (SELECT job, chunk, count(*) AS lines, arg_min(name, spot) AS an, arg_min(n, spot) AS ax, arg_max(name, spot) AS bn, arg_max(n, spot) AS bx FROM carried GROUP BY job, chunk),
o AS (SELECT *, count(*) OVER (PARTITION BY job) > 1 AS several, '=== chunk ' || chunk || ' (' || an || ':L' || ax || '–' || CASE WHEN an = bn THEN '' ELSE bn || ':' END || 'L' || bx || ') ===' AS head FROM s),
p AS (SELECT *, coalesce(sum(lines + several::INT) OVER (PARTITION BY job ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM o WHERE (job + chunk) % 7 <> 0),
d AS (SELECT c.job, c.chunk, p.ahead + several::INT + row_number() OVER (PARTITION BY c.job, c.chunk ORDER BY spot) AS result_line, n, text, name,
  replace(string_split(text, ' ')[1], chr(96), chr(39)) AS word FROM carried c JOIN p USING (job, chunk)),
e AS (SELECT *, CASE n % 4 WHEN 0 THEN '## About this' WHEN 2 THEN 'No source for ' || n ELSE 'The word `' || word || '` stands there (' || name || ':L' || CASE WHEN n % 4 = 3 THEN n + 500 ELSE n END || ')' END AS line FROM d)"""


@query(f"WITH {DRAFTS} SELECT job, result_line, line AS text FROM e UNION ALL SELECT job, ahead + 1, head FROM p WHERE several")
def assembled_draft(spark, sf_dir):
    """The lines of a job's draft: every chunk's answer behind a head that names its lines."""
    return A.draft_lines(A.draft_offsets(_drafts(spark, sf_dir), _spans(spark, sf_dir)))


@query(
    f"""WITH {DRAFTS} SELECT job, chunk, result_line, CASE WHEN n % 4 = 2 OR n % 4 = 3 THEN 'bad' WHEN word = '' OR contains(lower(text), lower(word)) THEN 'ok' ELSE 'bad' END AS status,
CASE n % 4 WHEN 2 THEN 'no ref' WHEN 3 THEN 'ref outside this chunk''s input: ' || name || ':L' || (n + 500) ELSE CASE WHEN word = '' OR contains(lower(text), lower(word)) THEN '' ELSE 'token not in cited lines: ' || word END END AS issues
FROM e WHERE n % 4 <> 0"""
)
def draft_files(spark, sf_dir):
    """Claims over several files with names like `in (1:L1)/doc, 5.txt`, and where each stands in the result."""
    bodies = _drafts(spark, sf_dir)
    parts = A.draft_offsets(bodies, _spans(spark, sf_dir))
    lines = parts.select("job", "chunk", F.posexplode("lines").alias("p", "raw")).select("job", "chunk", (F.col("p") + 1).cast("long").alias("pos"), "raw")
    items = A.place_draft_items(C.check_draft(lines, _carried(spark, sf_dir).select("job", "chunk", "name", "n", "text")), parts)
    return items.select("job", "chunk", "result_line", "status", F.array_join("issues", "; ").alias("issues"))


@query(
    f"""WITH {CARRIED}, e AS (SELECT *, n % 3 <> 0 AS ok, CASE WHEN n % 3 = 0 THEN text || '?' ELSE text END AS old FROM carried WHERE text <> ''),
f AS (SELECT job, name, n, min(chunk) FILTER (ok) AS first FROM e GROUP BY ALL),
d AS (SELECT e.* FROM e JOIN f USING (job, name, n) WHERE CASE WHEN ok THEN chunk = first ELSE coalesce(chunk <= first, true) END)
SELECT job, row_number() OVER (PARTITION BY job ORDER BY ok DESC, chunk, spot) AS result_line, md5(name || ' ' || n || ' ' || old) AS edit_md5, CASE WHEN ok THEN 'ok' ELSE 'bad' END AS status FROM d"""
)
def assembled_edits(spark, sf_dir):
    """A job's edits as lines: valid ones first, each line's from its first chunk alone."""
    c = _carried(spark, sf_dir).where("text <> ''")
    old = F.when(F.col("n") % 3 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    edits = c.select("job", "chunk", F.col("at").alias("pos"), F.col("name").alias("file"), F.col("n").alias("line"), old.alias("old"), F.lit("x").alias("new"), F.lit("because").alias("why"))
    items = C.check_edits(edits, c).select("job", "chunk", "pos", "name", "n", "status", "says")
    lines = A.assemble_edits(C.dedupe_edits(items), edits)
    said = F.from_json("text", "file string, line int, old string, new string, why string")
    return lines.select("job", "result_line", F.md5(F.concat_ws(" ", said["file"], said["line"].cast("string"), said["old"])).alias("edit_md5"), "status")


@query(
    f"""WITH {CARRIED}, c AS (SELECT job, chunk, name, n, text, row_number() OVER (PARTITION BY job, chunk ORDER BY spot) AS spot, count(*) OVER (PARTITION BY job, chunk) AS size FROM carried),
x AS (SELECT * FROM c WHERE chunk % 5 IN (1, 3) AND size > 1),
h AS (SELECT job, chunk, 'a' AS half, spot, name, n, text FROM x WHERE spot <= size // 2 UNION ALL SELECT job, chunk, 'b', spot, name, n, text FROM x WHERE spot > size // 2
  UNION ALL SELECT y.job, y.chunk, 'b', y.spot, y.name, y.n, y.text FROM x y JOIN x m ON m.job = y.job AND m.chunk = y.chunk AND m.spot = m.size // 2 + 1 AND m.name = y.name AND y.spot BETWEEN m.spot - 5 AND m.spot - 1)
SELECT job, chunk, half, name, n, row_number() OVER (PARTITION BY job, chunk, half ORDER BY spot) AS spot,
  dense_rank() OVER (PARTITION BY job ORDER BY chunk, half) + (SELECT count(DISTINCT z.chunk) FROM c z WHERE z.job = h.job AND z.chunk < h.chunk AND NOT (z.chunk % 5 IN (1, 3) AND z.size > 1)) AS number FROM h"""
)
def resplit_halves(spark, sf_dir):
    """Chunks whose answers were cut short, two of five, as halves, with their numbers among all chunks of the second pass."""
    c = _carried(spark, sf_dir)
    answers = c.select("job", "chunk", F.pmod("chunk", F.lit(5)).isin(1, 3).alias("truncated")).distinct()
    halves, numbers = A.resplit(c.select("job", "chunk", "at", "name", "n", "text"), answers)
    return halves.join(numbers, ["job", "chunk", "half"]).select("job", "chunk", "half", "name", "n", F.col("at").cast("long").alias("spot"), "number")


@query(
    f"""WITH {LINES}, r AS (SELECT doc_id, n, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || ' … (+' || (length(text) - 400) || ' chars)' ELSE text END AS text FROM rows_ WHERE n >= 3),
b AS (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS upto FROM r WHERE n < 3 + 40)
SELECT doc_id AS result_id, n AS line, text FROM b WHERE upto <= 16384 OR n = 3"""
)
def result_pages(spark, sf_dir):
    """Of every document as a result, the page from line 3 on: at most 40 lines and 16 KB, long lines clipped."""
    rows = L.explode_lines(L.with_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("result_id"), "text")), "result_id")
    page = A.result_pages(rows.withColumnRenamed("n", "at").withColumn("extra", F.lit(False)), 3, 40)
    return page.select("result_id", F.col("line").cast("int").alias("line"), "text")


@query(
    f"""WITH {LINES}, d AS (SELECT doc_id, doc_id // 10 AS result_id, coalesce(text, '') AS text, ['text', 'pdf', 'docx'][doc_id % 3 + 1] AS format, CASE WHEN doc_id % 5 = 0 THEN 'url' ELSE 'file' END AS kind FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY doc_id) AS n FROM d WHERE kind = 'url' OR format <> 'text' OR result_id % 4 = 0),
c AS (SELECT k.result_id, k.n, r.n AS spot, 0 AS side, 'L' || r.n || '| ' || r.text AS line FROM k JOIN rows_ r USING (doc_id)
  UNION ALL SELECT k.result_id, k.n, r.n, 1, '--- after ' || r.n || ' ---' FROM k JOIN rows_ r USING (doc_id) WHERE r.n % 7 = 0),
g AS (SELECT result_id, n, md5(string_agg(line, chr(10) ORDER BY spot, side)) AS copy_md5 FROM c GROUP BY result_id, n)
SELECT k.result_id, k.n, k.kind, k.format, strlen(k.text) AS bytes, sha256(k.text) AS sha256, coalesce((SELECT max(n) FROM rows_ r WHERE r.doc_id = k.doc_id), 0)::BIGINT AS lines, g.copy_md5
FROM k LEFT JOIN g USING (result_id, n)"""
)
def sources_kept(spark, sf_dir):
    """Sources that results keep, with their markers, written and read back with their index."""
    docs = L.with_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    kinds = F.element_at(F.array(F.lit("text"), F.lit("pdf"), F.lit("docx")), (d % 3 + 1).cast("int"))
    files = docs.select(
        F.floor(d / 10).cast("long").alias("result_id"), d.alias("at"), d.cast("string").alias("name"), F.when(d % 5 == 0, "url").otherwise("file").alias("kind"), F.concat(F.lit("/d/"), d.cast("string")).alias("path"),
        kinds.alias("format"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text.cast("binary"), 256).alias("sha256"), F.size("lines").cast("long").alias("lines"), F.col("lines").alias("all"),
    )
    kept = K.sources_to_keep(files, F.when(F.col("result_id") % 4 == 0, "schema").otherwise("extract"))
    index = K.source_index(kept.drop("all"))
    place = f"{shared_dir(spark)}/sources-{uuid.uuid4().hex[:12]}"
    rows = kept.join(index.select("result_id", "name", "n"), ["result_id", "name"]).select(F.concat_ws(":", "result_id", "n").alias("file_id"), F.posexplode("all").alias("p", "text"))
    rows = rows.select("file_id", (F.col("p") + 1).alias("n"), "text")
    marks = rows.where("n % 7 = 0").select("file_id", F.col("n").alias("at"), F.concat(F.lit("--- after "), F.col("n").cast("string"), F.lit(" ---")).alias("text"))
    copies = J.with_markers(rows, marks).withColumn("f", F.split("file_id", ":"))
    K.write_sources(copies.select(F.col("f")[0].cast("long").alias("result_id"), F.col("f")[1].cast("long").alias("n"), "at", "side", "text"), index, place)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "side", "text"))), lambda x: x["text"]), "\n")  # one document's lines
    digests = K.read_copies(spark, place).groupBy("result_id", "batch", "n").agg(F.md5(whole.cast("binary")).alias("copy_md5"))
    read = K.read_sources_index(spark, place)
    return read.join(digests, ["result_id", "batch", "n"], "left").select("result_id", "n", "kind", "format", "bytes", "sha256", "lines", "copy_md5")
