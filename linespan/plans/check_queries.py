"""Registered queries of the checks: answers are derived from documents, so every status occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import quotes as Q
from ..operators import schema as S
from ..session import table
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


def _carried(spark, sf_dir, total: bool = False) -> DataFrame:
    """Documents as jobs of chunks of 8 lines; chunk k also carries the last line of chunk k - 1.  total: with the document's number of lines."""
    docs = L.with_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job"), "text")).withColumn("total", F.size("lines"))
    rows = L.explode_lines(docs, "job", "total")
    at = F.floor((F.col("n") - 1) / 8).cast("int") + 1
    chunks = F.when(F.col("n") % 8 == 0, F.array(at, at + 1)).otherwise(F.array(at))
    name = F.concat(F.lit("in/doc-"), F.col("job").cast("string"), F.lit(".txt"))
    return rows.select("job", F.explode(chunks).alias("chunk"), name.alias("name"), "n", "text", *["total"] * total)


CARRIED = f"""{LINES},
carried AS (SELECT doc_id AS job, unnest(CASE WHEN n % 8 = 0 THEN [(n - 1) // 8 + 1, (n - 1) // 8 + 2] ELSE [(n - 1) // 8 + 1] END)::INT AS chunk, n, text FROM rows_)"""


def _quotes(spark, sf_dir) -> DataFrame:
    """A quote of every carried line: right, with wide spaces, cut, with a short name, changed, of a line that isn't there, or not one."""
    c = _carried(spark, sf_dir)
    n, text, short = F.col("n").cast("string"), F.col("text"), F.element_at(F.split("name", "/"), -1)
    kinds = [
        F.concat(F.lit("L"), n, F.lit("| "), text),
        F.concat(F.lit("L"), n, F.lit("|  "), F.replace(text, F.lit(" "), F.lit("  "))),
        F.concat(F.lit("L"), n, F.lit(" (p.1)| "), F.substring(text, 1, 12), F.lit("…")),
        F.concat(short, F.lit(":L"), n, F.lit("| "), text),
        F.concat(F.lit("L"), n, F.lit("| invented "), text),
        F.concat(F.lit("L"), (F.col("n") + 100_000).cast("string"), F.lit("| "), text),
        F.concat(F.lit("no quote "), n),
        F.lit("NOT IN INPUT"),
        F.concat(F.lit("other.txt:L"), n, F.lit("| "), text),
    ]
    raw = F.element_at(F.array(*kinds), (F.col("n") % 9 + 1).cast("int"))
    return c.select("job", "chunk", F.col("n").alias("pos"), raw.alias("raw"))


FOLDED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
EXTRACT = f"""{CARRIED},
x AS (SELECT job, chunk, n AS pos, text, CASE n % 9
   WHEN 0 THEN 'ok' WHEN 1 THEN CASE WHEN text LIKE '% %' OR text LIKE ' %' THEN 'ok~' ELSE 'ok~' END
   WHEN 2 THEN 'partial' WHEN 3 THEN 'ok' WHEN 4 THEN 'bad' WHEN 5 THEN 'bad' WHEN 6 THEN 'bad' WHEN 7 THEN 'not_in_input' ELSE 'bad' END AS status,
   CASE n % 9 WHEN 4 THEN 'text differs from the source line' WHEN 5 THEN 'line not in this chunk''s input' WHEN 6 THEN 'not a quoted input line'
     WHEN 8 THEN 'unknown file name' END AS reason,
   CASE n % 9 WHEN 5 THEN n + 100000 WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE n END AS n FROM carried)"""


@query(f"WITH {EXTRACT} SELECT job, chunk, pos, n::INT AS n, status, reason FROM x")
def extract_check(spark, sf_dir):
    """Quotes against the lines that their chunk carried."""
    items = C.check_extract(_quotes(spark, sf_dir), _carried(spark, sf_dir))
    return items.select("job", "chunk", "pos", "n", "status", "reason")


@query(
    f"""WITH {EXTRACT}, g AS (SELECT *, row_number() OVER (PARTITION BY job, n ORDER BY chunk, pos) AS k FROM x WHERE status <> 'bad' AND n IS NOT NULL)
SELECT job, chunk, pos, status FROM g WHERE k = 1 UNION ALL SELECT job, chunk, pos, status FROM x WHERE status = 'bad' OR n IS NULL"""
)
def extract_dedupe(spark, sf_dir):
    items = C.check_extract(_quotes(spark, sf_dir), _carried(spark, sf_dir))
    return C.dedupe_extract(items).select("job", "chunk", "pos", "status")


@query(
    f"""WITH {EXTRACT} SELECT job, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'ok~') AS ok_folded, count(*) FILTER (status = 'partial') AS partial,
count(*) FILTER (status = 'bad') AS bad, count(*) FILTER (status = 'not_in_input') AS not_in_input,
count(*) FILTER (status IN ('ok', 'ok~', 'partial')) AS refs_ok, count(*) FILTER (status = 'bad') AS refs_bad,
count(*) FILTER (status IN ('ok', 'ok~')) / nullif(count(*) FILTER (status <> 'not_in_input'), 0) AS pass_rate FROM x GROUP BY job"""
)
def extract_summary(spark, sf_dir):
    return C.extract_summary(C.check_extract(_quotes(spark, sf_dir), _carried(spark, sf_dir)), "job")


@query(
    f"""WITH {CARRIED}, s AS (SELECT job, min(chunk) AS c FROM carried GROUP BY 1)
SELECT job, n % 2 = 0 AS passed FROM (SELECT doc_id AS job, count(*) AS n FROM rows_ GROUP BY 1)"""
)
def probe_verdict(spark, sf_dir):
    """Jobs that quote all their lines pass; in jobs of an odd number of lines the last is left out."""
    c = _carried(spark, sf_dir)
    quoted = _carried(spark, sf_dir, total=True).where("total % 2 = 0 or n < total")
    raw = F.concat(F.lit("L"), F.col("n").cast("string"), F.lit("| "), "text")
    answers = quoted.select("job", "chunk", F.col("n").alias("pos"), raw.alias("raw"))
    items = C.dedupe_extract(C.check_extract(answers, c))
    return C.probe_verdict(items, c.select("job", "name", "n"))


@query(
    f"""WITH {CARRIED}, e AS (SELECT job, chunk, n, n % 7 AS k, text, string_split(text, ' ')[1] AS w FROM carried),
t AS (SELECT *, (len(text) - len(replace(text, w, ''))) // greatest(len(w), 1) AS often FROM e)
SELECT job, chunk, n AS pos, CASE k WHEN 0 THEN NULL WHEN 1 THEN '"old" and "new" must be strings, "old" non-empty' WHEN 2 THEN 'bad "line"'
 WHEN 3 THEN 'unknown file name' WHEN 4 THEN 'line not in this chunk''s input' WHEN 5 THEN 'touches a mask: the masked text is not what is on disk'
 ELSE '"old" is not in the source line' END AS reason FROM t"""
)
def edits_check(spark, sf_dir):
    """Proposed edits: the first fault decides."""
    c = _carried(spark, sf_dir)
    k = F.col("n") % 7
    edits = c.select(
        "job", "chunk", F.col("n").alias("pos"),
        F.when(k == 3, "none.txt").otherwise("").alias("file"),
        F.when(k == 2, "about here").when(k == 4, F.concat(F.lit("L"), F.col("n") + 100_000)).otherwise(F.col("n").cast("string")).alias("line"),
        F.when(k == 1, "").when(k == 5, "[token]").when(k == 6, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("old"),
        F.lit("new").alias("new"),
    )
    return C.check_edits(edits, c).select("job", "chunk", "pos", "reason")


@query(
    f"""WITH {CARRIED}, e AS (SELECT job, chunk, n, n % 3 = 0 AS ok FROM carried), f AS (SELECT job, n, min(chunk) FILTER (ok) AS first FROM e GROUP BY 1, 2),
d AS (SELECT e.* FROM e JOIN f USING (job, n) WHERE CASE WHEN ok THEN chunk = first ELSE coalesce(chunk <= first, true) END)
SELECT job, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS rejected, count(*) FILTER (ok) / count(*) AS pass_rate FROM d GROUP BY job"""
)
def edits_summary(spark, sf_dir):
    c = _carried(spark, sf_dir)
    old = F.when(F.col("n") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("?")))
    edits = c.select("job", "chunk", F.col("n").alias("pos"), F.lit("").alias("file"), F.col("n").alias("line"), old.alias("old"), F.lit("x").alias("new"))
    return C.edits_summary(C.dedupe_edits(C.check_edits(edits, c)), "job")


DRAFTS = f"""{CARRIED}, d AS (SELECT job, chunk, n AS pos, CASE n % 8 WHEN 0 THEN 'ok' WHEN 1 THEN 'bad' WHEN 2 THEN 'bad' WHEN 3 THEN 'flag' WHEN 4 THEN 'bad'
 WHEN 5 THEN 'bad' WHEN 6 THEN 'not_in_input' END AS status,
 CASE n % 8 WHEN 1 THEN ['no ref'] WHEN 2 THEN ['ref outside this chunk''s input: L' || (n + 100000)]
  WHEN 3 THEN ['number not in cited lines: 987654321'] WHEN 4 THEN ['token not in cited lines: no-such-token-here'] WHEN 5 THEN ['ref to an unknown file: gone.txt:L' || n] ELSE [] END AS issues,
 CASE n % 8 WHEN 0 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS refs_ok, CASE n % 8 WHEN 2 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS refs_bad FROM carried WHERE n % 8 <> 7)"""


def _drafts(spark, sf_dir) -> DataFrame:
    c = _carried(spark, sf_dir)
    n = F.col("n").cast("string")
    kinds = [
        F.concat(F.lit("A claim (L"), n, F.lit(")")),
        F.lit("A claim without a source"),
        F.concat(F.lit("A claim (L"), (F.col("n") + 100_000).cast("string"), F.lit(")")),
        F.concat(F.lit("It was 987654321 (L"), n, F.lit(")")),
        F.concat(F.lit("It said `no-such-token-here` (L"), n, F.lit(")")),
        F.concat(F.lit("A claim (gone.txt:L"), n, F.lit(")")),
        F.lit("NOT IN INPUT"),
        F.lit("## A heading"),
    ]
    return c.select("job", "chunk", F.col("n").alias("pos"), F.element_at(F.array(*kinds), (F.col("n") % 8 + 1).cast("int")).alias("raw"))


@query(f"WITH {DRAFTS} SELECT job, chunk, pos, status, array_to_string(issues, '; ') AS issues, refs_ok, refs_bad FROM d")
def draft_check(spark, sf_dir):
    """Lines of prose and their references, in a vectorised UDF."""
    items = C.check_draft(_drafts(spark, sf_dir), _carried(spark, sf_dir))
    return items.select("job", "chunk", "pos", "status", F.array_join("issues", "; ").alias("issues"), "refs_ok", "refs_bad")


@query(
    f"""WITH {DRAFTS}, s AS (SELECT job, count(*) FILTER (status IN ('ok', 'flag', 'bad')) AS lines, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'flag') AS flag,
count(*) FILTER (status = 'bad') AS bad, sum(refs_ok)::BIGINT AS refs_ok, sum(refs_bad)::BIGINT AS refs_bad, sum(len(issues)) AS i FROM d GROUP BY job)
SELECT job, lines, ok, flag, bad, refs_ok, refs_bad, i / nullif(lines, 0) AS flags_per_line, ok / nullif(lines, 0) AS pass_rate FROM s"""
)
def draft_summary(spark, sf_dir):
    return C.draft_summary(C.check_draft(_drafts(spark, sf_dir), _carried(spark, sf_dir)), "job")


# --- schema answers ---


def _values(spark, sf_dir) -> DataFrame:
    c = _carried(spark, sf_dir)
    k, n, text = F.col("n") % 6, F.col("n").cast("string"), F.col("text")
    word = F.get(F.split("text", " "), F.lit(0))
    return c.select(
        "job", "chunk", F.concat(F.lit("f"), F.col("n") % 4).alias("path"), F.col("n").alias("seq"),
        F.when(k == 5, None).otherwise(F.to_json(F.struct(word.alias("v")))).alias("value"),
        F.when(k == 1, None).when(k == 2, F.concat(F.lit("L"), F.col("n") + 100_000)).otherwise(F.concat(F.lit("L"), n)).alias("ref"),
        F.when(k == 3, "nothing like it").when(k == 4, F.replace(text, F.lit(" "), F.lit("  "))).otherwise(text).alias("quote"),
    )


@query(
    f"""WITH {CARRIED} SELECT job, chunk, 'f' || (n % 4) AS path, n AS seq, CASE n % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'bad_ref' WHEN 2 THEN 'bad_ref' WHEN 3 THEN 'quote_mismatch'
WHEN 4 THEN CASE WHEN contains(text, ' ') THEN 'ok~' ELSE 'ok' END ELSE 'null' END AS status FROM carried"""
)
def schema_check(spark, sf_dir):
    """Leaf values: reference, quote, value."""
    items = S.check_values(_values(spark, sf_dir), _carried(spark, sf_dir))
    return items.select("job", "chunk", "path", "seq", "status")


@query(
    f"""WITH {CARRIED}, w AS (SELECT job, chunk, 'f' || (n % 4) AS path, n, 'v' || (n % 8 // 4 * (job % 2)) AS value, 'L' || n AS ref FROM carried),
o AS (SELECT job, path, value, ref, min(chunk) AS chunk, min(n) AS n FROM w GROUP BY ALL),
g AS (SELECT job, path, value, min((chunk, n)) AS f FROM o GROUP BY ALL)
SELECT job, path, count(*) > 1 AS conflict, count(*) AS distinct_values, array_to_string(list(value ORDER BY f), ',') AS values_seen FROM g GROUP BY job, path"""
)
def schema_merge(spark, sf_dir):
    """Values of chunks merged: one, or a conflict."""
    c = _carried(spark, sf_dir)
    value = F.concat(F.lit('"v'), F.floor(F.col("n") % 8 / 4).cast("int") * (F.col("job") % 2), F.lit('"'))
    v = c.select("job", "chunk", F.concat(F.lit("f"), F.col("n") % 4).alias("path"), F.col("n").alias("seq"), value.alias("value"), F.concat(F.lit("L"), "n").alias("ref"), F.col("text").alias("quote"))
    m = S.merge(v)
    seen = F.when(F.col("conflict"), F.array_join(F.from_json("value", "array<string>").cast("array<string>"), ",")).otherwise(F.col("value"))
    return m.select("job", "path", "conflict", F.col("distinct").alias("distinct_values"), F.replace(seen, F.lit('"'), F.lit("")).alias("values_seen"))


@query(
    f"""WITH {CARRIED}, s AS (SELECT n % 6 AS k, contains(text, ' ') AS sp FROM carried)
SELECT count(*) FILTER (k <> 5) AS "values", count(*) FILTER (k = 0 OR (k = 4 AND NOT sp)) AS ok, count(*) FILTER (k = 4 AND sp) AS ok_folded, count(*) FILTER (k = 3) AS quote_mismatch,
count(*) FILTER (k IN (1, 2)) AS bad_ref, 0::BIGINT AS value_not_in_quote, count(*) FILTER (k = 5) AS nulls, count(*) FILTER (k IN (0, 4)) AS refs_ok,
count(*) FILTER (k IN (1, 2, 3)) AS refs_bad, count(*) FILTER (k IN (0, 4)) / count(*) FILTER (k <> 5) AS pass_rate FROM s"""
)
def schema_summary(spark, sf_dir):
    return S.schema_summary(S.check_values(_values(spark, sf_dir), _carried(spark, sf_dir)))


@query(
    r"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '{"a":1}' WHEN 2 THEN '{"a":1}' END AS json, turn % 4 = 1 AS repaired FROM conversations"""
)
def parse_answers(spark, sf_dir):
    """JSON answers: in a fence, repaired once, or failed."""
    c = table(spark, sf_dir, "conversations")
    kinds = F.array(F.lit('{"a":1}'), F.lit('Here: {"a":1}, as asked'), F.lit('```json\n{"a":1}\n```'), F.lit("[1, 2]"))
    answers = c.select("conv_id", "turn", F.element_at(kinds, (F.col("turn") % 4 + 1).cast("int")).alias("text"))
    return S.parse_answers(answers).select("conv_id", "turn", "json", "repaired")


# --- joins of other kinds ---


@query(
    """WITH w AS (SELECT item_id, text FROM benchmark) SELECT item_id, doc_id FROM w JOIN documents d ON contains(d.text, w.text)"""
)
def quote_containment(spark, sf_dir):
    """Which documents hold a text whole."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return Q.texts_holding(items, table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS full_name FROM pages), q AS (SELECT *, string_split(full_name, '/')[-1] AS tail FROM p)
SELECT q.page_id, count(*) AS near, count(*) = 1 AS found FROM q JOIN q r ON r.full_name = q.tail OR ends_with(r.full_name, '/' || q.tail) GROUP BY q.page_id"""
)
def name_suffix_lookup(spark, sf_dir):
    """Short names and the names that end with them: a join on the last part."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("full_name"))
    tails = p.groupBy(F.element_at(F.split("full_name", "/"), -1).alias("tail")).agg(F.count(F.lit(1)).alias("near"))
    q = p.withColumn("tail", F.element_at(F.split("full_name", "/"), -1)).join(tails, "tail")
    return q.select("page_id", "near", (F.col("near") == 1).alias("found"))


@query(
    f"""WITH {LINES}, r AS (SELECT doc_id, n AS a, least(n + 2, total) AS b FROM rows_ WHERE n % 5 = 1)
SELECT r.doc_id, r.a, r.b, count(*) AS lines, sum(length(x.text))::BIGINT AS chars FROM r JOIN rows_ x ON x.doc_id = r.doc_id AND x.n BETWEEN r.a AND r.b GROUP BY ALL"""
)
def ref_range_join(spark, sf_dir):
    """References to ranges of lines, expanded to lines and joined on equality."""
    docs = L.with_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = L.explode_lines(docs, "doc_id")
    refs = docs.select("doc_id", F.size("lines").alias("total")).join(rows.where("n % 5 = 1").select("doc_id", F.col("n").alias("a")), "doc_id")
    refs = refs.select("doc_id", "a", F.least(F.col("a") + 2, "total").alias("b"))
    df = refs.withColumn("n", F.explode(F.sequence("a", "b"))).join(rows, ["doc_id", "n"])
    return df.groupBy("doc_id", "a", "b").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


