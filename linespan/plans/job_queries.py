"""Registered queries of whole jobs: what is sent, costs, reports, and what is written; with their SQL."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sinks as K
from ..operators import analytics as A
from ..operators import jobs as J
from ..operators import render as R
from ..session import shared_dir, table
from ..sources import lines as L
from .line_queries import LINES

QUERIES, SQL = {}, {}
MINUTE = 60_000
START = int(datetime(2024, 1, 1, tzinfo=UTC).timestamp() * 1000)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(n) -> F.Column:
    """A log of a document's lines: three of four have a stamp, a minute apart, some a secret."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(START // 1000) + n * 60), "yyyy-MM-dd HH:mm:ss ")
    secret = F.when(n % 5 == 0, F.concat(F.lit(" Bearer abcdefgh"), n.cast("string"))).when(n % 7 == 0, F.lit(" password=hunter2")).otherwise("")
    return F.concat(F.when(n % 4 == 1, "").otherwise(stamp), F.lit("line "), n.cast("string"), secret)


def _sent(spark, sf_dir) -> DataFrame:
    """Lines 2 to 90, from 00:05 to 01:15, with a masked bearer and one line around."""
    docs = L.with_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", F.transform("lines", lambda x, i: _text(i + 1)).alias("lines"))
    return J.sent_lines(docs, r"Bearer \[token\]", 1, 2, 90, START + 5 * MINUTE, START + 75 * MINUTE, key="doc_id")


SENT = rf"""
WITH {LINES}, t AS (SELECT doc_id, n, CASE WHEN n % 4 = 1 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_minutes(n) END AS own,
  'line ' || n || CASE WHEN n % 5 = 0 THEN ' Bearer [token]' WHEN n % 7 = 0 THEN ' password=[token]' ELSE '' END AS said, n % 5 = 0 AS bearer, n % 7 = 0 AND n % 5 <> 0 AS kv
  FROM rows_ WHERE n BETWEEN 2 AND 90),
w AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stamp FROM t),
g AS (SELECT *, max(bearer::INT) OVER (PARTITION BY doc_id ORDER BY n RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM w
      WHERE stamp BETWEEN TIMESTAMP '2024-01-01 00:05:00' AND TIMESTAMP '2024-01-01 01:15:00'),
sent AS (SELECT doc_id, n, coalesce(strftime(own, '%Y-%m-%d %H:%M:%S '), '') || said AS text, bearer, kv FROM g WHERE near = 1)
"""


@query(SENT + "SELECT doc_id, n, text, bearer AS hit FROM sent")
def job_sent_lines(spark, sf_dir):
    """Range, time, masking and pattern in the one safe order."""
    return _sent(spark, sf_dir).select("doc_id", "n", "text", "hit")


@query(
    SENT + """SELECT doc_id, rule, count(*) AS "count" FROM (SELECT doc_id, CASE WHEN bearer THEN 'bearer' WHEN kv THEN 'kv_secret' END AS rule FROM sent)
WHERE rule IS NOT NULL GROUP BY ALL"""
)
def job_mask_tally(spark, sf_dir):
    """What was masked, over the sent lines alone."""
    return J.mask_tally(_sent(spark, sf_dir), "doc_id")


FRAME_IN = "('--- untrusted model output ---', '--- end ---', '--- source text (masked) ---', '--- end of source text ---')"


@query(
    rf"""WITH {LINES}, f AS (SELECT doc_id, n, CASE WHEN n % 6 = 0 THEN chr(9) || '--- end --- ' ELSE text END AS text FROM rows_ WHERE n <= 20),
c AS (SELECT doc_id, n, CASE WHEN length(text) > 40 THEN text[:40] || '…' ELSE text END AS text FROM f)
SELECT doc_id, n, CASE WHEN trim(text, ' ' || chr(9)) IN {FRAME_IN} THEN '> ' || text ELSE text END AS text FROM c"""
)
def preview_lines(spark, sf_dir):
    """The first twenty lines, clipped, with frames quoted."""
    docs = L.with_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.transform("lines", lambda x, i: F.when((i + 1) % 6 == 0, F.lit("\t--- end --- ")).otherwise(x))
    return docs.select("doc_id", F.posexplode(J.preview(lines, 20, 40)).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("n"), "text")


@query(
    rf"""WITH {LINES}, m AS (SELECT doc_id, n AS at, 1 AS side, '[p.' || (n // 10) || ']' AS text FROM rows_ WHERE n % 10 = 0)
SELECT doc_id, n AS at, 0 AS side, 'L' || n || '| ' || text AS text FROM rows_ UNION ALL SELECT * FROM m"""
)
def source_copy(spark, sf_dir):
    """A numbered copy of every source, with markers behind every tenth line."""
    lines = L.explode_lines(L.with_lines(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    at = F.col("n").alias("at")
    markers = lines.where("n % 10 = 0").select("doc_id", at, F.concat(F.lit("[p."), F.floor(F.col("n") / 10).cast("string"), F.lit("]")).alias("text"))
    return J.with_markers(lines, markers, "doc_id")


@query(
    """WITH a AS (SELECT o_orderkey AS answer_id, o_orderkey % 3 AS kind, o_orderkey % 2 AS fenced, '{"find":"' || o_orderstatus || '","n":' || o_custkey || '}' AS one FROM orders)
SELECT answer_id, 0 AS pos, one AS value, NULL::VARCHAR AS error FROM a WHERE kind < 2
UNION ALL SELECT answer_id, 1, '[1,2]', NULL FROM a WHERE kind = 0
UNION ALL SELECT answer_id, 2, NULL, 'not JSON: and ' || one FROM a WHERE kind = 1
UNION ALL SELECT answer_id, 2, one, NULL FROM a WHERE kind = 2"""
)
def edits_parse(spark, sf_dir):
    """Edits out of answers that are one array, lines with commas and prose, or lines in brackets; half of them in a fence."""
    one = F.concat(F.lit('{"find":"'), "o_orderstatus", F.lit('","n":'), F.col("o_custkey").cast("string"), F.lit("}"))
    kind = F.col("o_orderkey") % 3
    lines = (
        F.when(kind == 0, F.array(F.concat(F.lit(" [ "), one, F.lit(",")), F.lit("[1, 2]]")))
        .when(kind == 1, F.array(F.concat(one, F.lit(",")), F.lit("Not in input."), F.concat(F.lit("and "), one)))
        .otherwise(F.array(F.lit("["), F.lit(""), one, F.lit("],")))
    )
    fenced = F.concat(F.array(F.lit(" "), F.lit("```json")), lines, F.array(F.lit("``` "), F.lit("")))
    lines = F.when(F.col("o_orderkey") % 2 == 1, fenced).otherwise(lines)
    return J.parse_edits(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), lines.alias("lines")), "answer_id")


CALLS = """c AS (SELECT l_orderkey AS job, l_linenumber AS chunk, 'm/' || (l_suppkey % 3) AS model, l_partkey AS tokens_in, l_suppkey AS tokens_out,
CASE l_linenumber % 3 WHEN 0 THEN l_tax WHEN 1 THEN NULL ELSE -1.0 END AS said, l_quantity / 10 AS price_in, l_discount * 10 AS price_out,
CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'N' THEN 'dropped' ELSE 'failed' END AS state, l_linenumber % 2 = 0 AS truncated FROM lineitem)"""


def _calls(spark, sf_dir) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job"), n.alias("chunk"), F.concat(F.lit("m/"), (F.col("l_suppkey") % 3).cast("string")).alias("model"),
        F.col("l_partkey").alias("tokens_in"), F.col("l_suppkey").alias("tokens_out"),
        F.when(n % 3 == 0, F.col("l_tax")).when(n % 3 == 2, F.lit(-1.0)).alias("said"), (F.col("l_quantity") / 10).alias("price_in"), (F.col("l_discount") * 10).alias("price_out"),
        F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "N", "dropped").otherwise("failed").alias("state"), (n % 2 == 0).alias("truncated"),
    )


@query(
    f"""WITH {CALLS} SELECT job, chunk, round(CASE WHEN said >= 0 THEN said ELSE (tokens_in * price_in + tokens_out * price_out) / 1e6 END * 1e9)::BIGINT AS nano,
coalesce(said < 0, true) AS estimated, least(4096, tokens_out * 10, 32000 - tokens_in) AS most,
round(((tokens_in * least(price_in, 1.0) + least(4096, tokens_out * 10, 32000 - tokens_in) * least(price_out, 4.0)) / 1e6 + 0.01) * 1e9)::BIGINT AS worst,
round(tokens_in * least(price_in, 1.0) / 1e6 * 1e9)::BIGINT AS failed FROM c"""
)
def call_costs(spark, sf_dir):
    """What calls cost, may cost at most, and cost when they fail, under a cap of prices."""
    prompt, out = F.col("tokens_in"), F.col("tokens_out")
    nano = lambda usd: F.round(usd * F.lit(1e9)).cast("long")
    cap_in, cap_out = J.price_within(F.col("price_in"), F.lit(1.0)), J.price_within(F.col("price_out"), F.lit(4.0))
    most = J.max_tokens_within(F.lit(4096), out * 10, F.lit(32_000), prompt)
    paid = J.actual_cost(F.col("said"), prompt, out, F.col("price_in"), F.col("price_out"), F.lit(None).cast("double"))
    df = _calls(spark, sf_dir).withColumn("paid", paid)
    return df.select(
        "job", "chunk", nano(F.col("paid.cost")).alias("nano"), "paid.estimated", most.alias("most"),
        nano(J.worst_cost(prompt, most, cap_in, cap_out, F.lit(0.01))).alias("worst"), nano(J.prompt_cost(prompt, cap_in, F.lit(0.0))).alias("failed"),
    )


@query(
    f"""WITH {CALLS} SELECT job, coalesce(sum(tokens_in) FILTER (state <> 'failed'), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_out) FILTER (state <> 'failed'), 0)::BIGINT AS tokens_out,
sum(round(price_in * 100)::BIGINT)::BIGINT AS cost, count(*) FILTER (state = 'failed') > 0 AS failed_any, bool_or(state = 'failed' OR coalesce(said < 0, true)) AS cost_estimated,
count(DISTINCT chunk) FILTER (state <> 'dropped') AS chunks, count(DISTINCT chunk) FILTER (state = 'done') AS chunks_done,
count(*) FILTER (state = 'done' AND truncated) AS truncated, coalesce(array_to_string(list_sort(list(DISTINCT model) FILTER (state <> 'failed')), ','), '') AS models FROM c GROUP BY job"""
)
def job_totals(spark, sf_dir):
    """Tokens, cost, chunks and models of every job over its calls."""
    calls = _calls(spark, sf_dir).withColumn("estimated", ~F.coalesce(F.col("said") >= 0, F.lit(False))).withColumn("cost", F.round(F.col("price_in") * 100).cast("long"))
    return J.job_totals(calls).withColumn("models", F.array_join("models_used", ",")).drop("models_used")


@query(
    """WITH f AS (SELECT p_partkey AS model_id, p_size * 1000 AS context, p_size % 7 * 1000 AS max_out, CASE WHEN p_size % 11 = 0 THEN 'blocked' END AS reason FROM part),
i AS (SELECT l_orderkey AS job, l_linenumber AS ord, CASE WHEN l_linenumber = 3 THEN -1 ELSE l_partkey END AS model_id FROM lineitem),
w AS (SELECT job, ord, i.model_id, least(4096, max_out, context - 3000) AS most, CASE WHEN context IS NULL THEN 'unknown' WHEN reason IS NOT NULL THEN reason
  WHEN least(4096, max_out, context - 3000) < 1 THEN 'context too small' END AS why FROM i LEFT JOIN f ON f.model_id = i.model_id)
SELECT job, ord, model_id, most, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY job, why IS NULL ORDER BY ord, model_id) = 1 THEN 'primary' ELSE 'fallback' END) AS part FROM w"""
)
def model_choice(spark, sf_dir):
    """Of each job's ids in their order the first usable one, the ones behind it, and why not the others."""
    size = F.col("p_size")
    facts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("model_id"), (size * 1000).alias("context"), (size % 7 * 1000).alias("max_out"), F.when(size % 11 == 0, "blocked").alias("reason")
    )
    one = F.when(F.col("l_linenumber") == 3, -1).otherwise(F.col("l_partkey"))
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("ord"), one.alias("model_id"))
    return J.pick_models(ids, facts, F.lit(3000), F.lit(4096)).select("job", "ord", "model_id", "most", "part")


ITEMS = """i AS (SELECT l_suppkey AS job, l_orderkey * 10 + l_linenumber AS pos, ['bad', 'flag', 'partial', 'ok', 'ok~'][l_linenumber % 5 + 1] AS status,
'a.md:L' || l_linenumber AS place, 'part ' || l_partkey AS why FROM lineitem)"""


def _items(spark, sf_dir) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("job"), (F.col("l_orderkey") * 10 + n).alias("pos"),
        F.element_at(F.array(*map(F.lit, ("bad", "flag", "partial", "ok", "ok~"))), (n % 5 + 1).cast("int")).alias("status"),
        F.concat(F.lit("a.md:L"), n.cast("string")).alias("where"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("why"),
    )


@query(
    f"""WITH {ITEMS}, b AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY CASE status WHEN 'bad' THEN 0 ELSE 1 END, pos, place, why) AS k FROM i WHERE status IN ('bad', 'flag')),
m AS (SELECT job, count(*) - 10 AS more FROM b GROUP BY job HAVING count(*) > 10)
SELECT job, k::INT AS "at", place || ' [' || status || '] ' || why AS line FROM b WHERE k <= 10 UNION ALL SELECT job, 11, '… +' || more || ' more' FROM m"""
)
def worst_items(spark, sf_dir):
    """The ten worst items of every job, in order, and how many more there are."""
    return J.worst_items(_items(spark, sf_dir))


@query(
    f"""WITH {ITEMS} SELECT job, format('check (extract): refs ok {{}} / bad {{}} — ok {{}}, ok~ {{}}, partial {{}}, not-in-input {{}}', count(*) FILTER (status IN ('ok', 'ok~')), count(*) FILTER (status = 'bad'),
count(*) FILTER (status = 'ok'), count(*) FILTER (status = 'ok~'), count(*) FILTER (status = 'partial'), 0) AS extract,
format('check (edits): refs ok {{}} / bad {{}} — valid {{}}, rejected {{}} (never applied)', count(*) FILTER (status IN ('ok', 'ok~')), count(*) FILTER (status = 'bad'), count(*) FILTER (status = 'ok'), 0) AS edits FROM i GROUP BY job"""
)
def check_summaries(spark, sf_dir):
    """A job's counts in the line of each mode."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    totals = _items(spark, sf_dir).groupBy("job").agg(of("ok", "ok~").alias("refs_ok"), of("bad").alias("refs_bad"), of("ok").alias("ok"), of("ok~").alias("ok~"), of("partial").alias("partial"))
    t = {c: F.col(f"`{c}`") for c in totals.columns} | {k: F.lit(0) for k in ("not_in_input", "rejected")}
    return totals.select("job", J.summary_line("extract", t).alias("extract"), J.summary_line("edits", t | {"valid": t["ok"]}).alias("edits"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 >= 3 THEN NULL ELSE '  ' || CASE WHEN l_linenumber % 2 = 0 THEN 'b.md:' ELSE '' END || 'L' || l_partkey ||
CASE WHEN l_suppkey % 2 = 0 THEN ' (p.' || l_suppkey || ')' ELSE '' END || '| text | ' || l_returnflag END AS text FROM lineitem"""
)
def placed_lines(spark, sf_dir):
    """Answer lines with the place that is known, in place of what the model wrote; ok ones keep no text."""
    n, said = F.col("l_linenumber"), F.concat(F.lit("  a.md:L7 (slide 2)| text | "), F.col("l_returnflag"))
    place = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("p."), F.col("l_suppkey").cast("string")))
    text = J.with_place(said, F.col("l_partkey"), F.when(n % 2 == 0, "b.md"), place)
    status = F.element_at(F.array(*map(F.lit, ("bad", "flag", "partial", "ok", "ok~"))), (n % 5 + 1).cast("int"))
    return J.lean(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"), text.alias("text"))).drop("status")


@query(
    r"""SELECT p_partkey, CASE WHEN p_size % 13 = 0 THEN '-' WHEN p_size % 7 = 0 THEN '?' WHEN p_size < 10 THEN '$' || format('{:.4f}', p_size / 1000.0)
ELSE '$' || regexp_replace(regexp_replace(format('{:.3f}', p_size / 1000.0), '0+$', ''), '\.$', '') END AS price,
CASE WHEN p_size % 5 = 0 THEN '-' ELSE floor(p_size / 64.0 * 100 + 0.5)::BIGINT || '%' END AS share, format('${:.4f}', p_size / 8.0) AS money,
'a.md:L' || p_partkey || '–' || CASE WHEN p_size % 2 = 0 THEN '' ELSE 'b.md:' END || 'L' || (p_partkey + p_size) AS span, p_size % 3 = 0 AS control, p_size % 4 = 0 AS dots FROM part"""
)
def report_texts(spark, sf_dir):
    """Prices, shares, sums and spans as reports write them; paths that are refused."""
    size = F.col("p_size").cast("double")
    price = F.when(F.col("p_size") % 13 == 0, F.lit(None)).when(F.col("p_size") % 7 == 0, F.lit(float("inf"))).otherwise(size / 1000)
    end = F.when(F.col("p_size") % 2 == 0, "a.md").otherwise("b.md")
    path = F.concat(F.lit("/a/"), F.when(F.col("p_size") % 4 == 0, "../").otherwise("..x/"), F.when(F.col("p_size") % 3 == 0, "b ").otherwise("b"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", J.price_text(price).alias("price"), J.percent_text(F.when(F.col("p_size") % 5 != 0, size / 64)).alias("share"), J.money_text(size / 8).alias("money"),
        J.span_text(F.lit("a.md"), F.col("p_partkey"), end, F.col("p_partkey") + F.col("p_size")).alias("span"), J.has_control_chars(path).alias("control"), J.has_dot_dot(path).alias("dots"),
    )


@query(
    r"""SELECT conv_id, turn, '{' || CASE WHEN turn % 2 = 0 THEN '"effort":"low",' ELSE '' END || '"model":"m/' || (conv_id % 3) || '","messages":[{"role":"system","content":"s"},{"role":"user","content":"turn ' || turn ||
'"}],"provider":{"zdr":true,"data_collection":"deny"' || CASE WHEN conv_id % 2 = 0 THEN ',"max_price":{"prompt":1.0,"completion":4.0}' ELSE '' END || '},"plugins":[{"id":"context-compression","enabled":false}],"max_completion_tokens":' || (turn + 100) || '}' AS body FROM conversations"""
)
def request_bodies(spark, sf_dir):
    """Calls as JSON; what the job says wins over the parameters."""
    model = F.concat(F.lit("m/"), (F.col("conv_id") % 3).cast("string"))
    params = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("model"), F.lit("other"), F.lit("effort"), F.lit("low"))).otherwise(F.create_map(F.lit("model"), F.lit("x")))
    cap = lambda usd: F.when(F.col("conv_id") % 2 == 0, F.lit(usd))
    user = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", J.request_body(model, params, F.lit("s"), user, F.col("turn") + 100, cap(1.0), cap(4.0)).alias("body"))


# --- what is written -----------------------------------------------------------------


def _place(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


@query(
    rf"""WITH {LINES} SELECT (doc_id % 7)::VARCHAR AS result_id, doc_id * 100000 + n AS n, CASE WHEN doc_id % 7 = 3 THEN 'again' ELSE text END AS text FROM rows_ WHERE doc_id % 7 IN (3, 5)"""
)
def results_written(spark, sf_dir):
    """Results written by id, one of them again, and two read back."""
    lines = L.explode_lines(L.with_lines(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    rows = lines.select((F.col("doc_id") % 7).cast("string").alias("result_id"), (F.col("doc_id") * 100_000 + F.col("n")).alias("n"), "text")
    at = _place(spark, "results")
    K.write_results(rows, at)
    K.write_results(rows.where("result_id = '3'").withColumn("text", F.lit("again")), at)
    three, five = (K.read_result(spark, at, i, last=2**62).select(F.col("result_id").cast("string").alias("result_id"), "n", "text") for i in ("3", "5"))
    return three.unionByName(five)


@query("""SELECT event_type AS alias, count(*) AS jobs, sum(user_id)::BIGINT AS tokens_in, sum(event_id)::BIGINT AS tokens_out FROM events GROUP BY event_type""")
def usage_appended(spark, sf_dir):
    """Usage records appended as JSON lines in two runs and read back."""
    e = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("alias"), F.col("user_id").alias("tokens_in"), F.col("event_id").alias("tokens_out"), F.lit("done").alias("status")
    )
    at = _place(spark, "usage")
    K.append_usage(e.where("tokens_out % 2 = 0"), at)
    K.append_usage(e.where("tokens_out % 2 = 1"), at)
    return A.read_usage(spark, at).groupBy("alias").agg(F.count(F.lit(1)).alias("jobs"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


MANIFEST = """t AS (SELECT c_custkey AS k, '/out/' || CASE c_custkey % 9 WHEN 0 THEN '../' WHEN 1 THEN 'a' || chr(8232) ELSE '' END || c_name || '.md' AS path, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'dir' ELSE 'file' END AS kind FROM customer)"""


def _targets(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    odd = F.when(k % 9 == 0, "../").when(k % 9 == 1, "a ").otherwise("")
    kind = F.when(k % 4 == 1, "dir").when(k % 4 >= 2, "file")
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.concat(F.lit("/out/"), odd, "c_name", F.lit(".md")).alias("path"), kind.alias("kind"))


def _manifest(spark, targets: DataFrame) -> DataFrame:
    """A manifest written in two runs: of every other target, of some of these again, later."""
    at = _place(spark, "manifest")
    row = [F.col("k").alias("size"), F.col("k").cast("double").alias("mtime_ms"), F.timestamp_seconds(F.lit(START // 1000) + F.col("k") * 3600).alias("ts"), F.lit("r").alias("result_id")]
    ours = targets.where("k % 2 = 0").select("path", "k")
    K.append_manifest(ours.select("path", *row), at)
    K.append_manifest(ours.where("k % 10 = 0").withColumn("k", F.col("k") + 24).select("path", *row), at)
    return K.read_manifest(spark, at)


@query(
    f"""WITH {MANIFEST} SELECT path, kind IS NOT NULL AS replaces, CASE WHEN k % 9 = 1 THEN 'control characters' WHEN k % 9 = 0 THEN '".." segments' WHEN kind = 'dir' THEN 'not a file'
WHEN kind = 'file' AND k % 2 = 1 THEN 'exists and was not exported' END AS refused FROM t"""
)
def export_plan(spark, sf_dir):
    """What speaks against each target of an export that may overwrite its own files."""
    t = _targets(spark, sf_dir)
    there = t.where("kind is not null").select("path", "kind")
    return K.plan_export(t.select("path", F.lit("r").alias("result_id")), there, _manifest(spark, t), ["/out"], overwrite=True).drop("result_id")


@query(
    f"""WITH {MANIFEST}, m AS (SELECT *, CASE WHEN k % 10 = 0 THEN k + 24 ELSE k END AS v FROM t WHERE k % 2 = 0)
SELECT path, CASE WHEN v * 3600 >= 30 * 86400 THEN 'kept' WHEN kind = 'file' AND k % 3 <> 0 AND v = k THEN 'deleted' ELSE 'dropped' END AS fate FROM m"""
)
def export_prune(spark, sf_dir):
    """Which exports of thirty days are deleted, kept, or left alone since they were changed."""
    t = _targets(spark, sf_dir)
    there = t.where("kind is not null").select("path", "kind", F.col("k").alias("size"), F.when(F.col("k") % 3 == 0, -1.0).otherwise(F.col("k").cast("double")).alias("mtime_ms"))
    now = F.timestamp_seconds(F.lit(START // 1000 + 60 * 86_400))
    return K.prune_exports(_manifest(spark, t), there, now, 30).select("path", "fate")


@query(
    """WITH s AS (SELECT conv_id, 'f' || (turn % 2) AS file, trim(regexp_replace(regexp_replace('a' || chr(1) || 'tt' || chr(9) || (turn % 3), '[\\r\\n\\t]+', ' ', 'g'), '[\\x00-\\x1f]', '', 'g')) AS label, turn * 10 + 1 AS lo, turn * 10 + 8 AS hi FROM conversations),
r AS (SELECT DISTINCT conv_id, ' att ' || (turn % 4) AS name, turn * 10 + 2 AS a, turn * 10 + 2 + turn % 9 AS b FROM conversations),
g AS (SELECT r.conv_id, name, a, b, min(file) AS lo_file, max(file) AS hi_file, bool_or(lo <= a AND b <= hi) AS both_in, bool_or(a BETWEEN lo AND hi) AS a_in
 FROM r LEFT JOIN s ON s.conv_id = r.conv_id AND s.label = trim(r.name) GROUP BY ALL),
p AS (SELECT *, CASE WHEN lo_file IS NULL THEN 'unknown' WHEN lo_file <> hi_file THEN 'ambiguous' WHEN NOT both_in
 THEN 'L' || CASE WHEN a_in THEN b ELSE a END || ' is not inside attachment ' || trim(name) END AS problem FROM g)
SELECT conv_id, name, a, b, CASE WHEN problem IS NULL THEN lo_file END AS file, problem FROM p"""
)
def attachment_refs(spark, sf_dir):
    """Turns stand for attachments of two files, and for references to them."""
    c, t = table(spark, sf_dir, "conversations"), F.col("turn")
    label = F.concat(F.lit("a\x01tt\t"), (t % 3).cast("string"))
    sections = c.select("conv_id", F.concat(F.lit("f"), (t % 2).cast("string")).alias("file"), F.lit("attachment").alias("kind"), label.alias("label"), (t * 10 + 1).alias("start"), (t * 10 + 8).alias("end"))
    refs = c.select("conv_id", F.concat(F.lit(" att "), (t % 4).cast("string")).alias("name"), (t * 10 + 2).alias("a"), (t * 10 + 2 + t % 9).alias("b"))
    return R.attachment_refs(refs, sections, "conv_id")
