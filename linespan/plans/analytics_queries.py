"""Registered queries of usage, models, benchmark scores and stored results; events, parts and labels stand for logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import scoring as S
from ..session import table

QUERIES, SQL = {}, {}
TODAY = "2024-01-10"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _usage(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("alias"),
        F.when(F.col("event_id") % 10 == 0, "failed").otherwise("done").alias("status"), cents.alias("cost"),
        F.col("user_id").alias("tokens_in"), F.col("event_id").alias("tokens_out"),
        F.element_at(F.array(F.lit("draft"), F.lit("edits"), F.lit("extract")), (F.col("event_id") % 3 + 1).cast("int")).alias("mode"),
        F.when(F.col("event_id") % 4 != 0, (F.col("user_id") % 5).cast("double") / 4).alias("pass_rate"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("m/a"), F.lit("m/b"))).otherwise(F.array(F.lit("m/a"))).alias("models_used"),
    )


USAGE = """u AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS alias, CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'done' END AS status,
round(value * 100)::BIGINT AS cost, user_id AS tokens_in, event_id AS tokens_out, ['draft', 'edits', 'extract'][event_id % 3 + 1] AS mode,
CASE WHEN event_id % 4 <> 0 THEN (user_id % 5)::DOUBLE / 4 END AS pass_rate, CASE WHEN event_id % 2 = 0 THEN ['m/a', 'm/b'] ELSE ['m/a'] END AS models FROM events)"""
TOTALS = "count(*) AS jobs, count(*) FILTER (status <> 'done') AS failed, sum(cost)::BIGINT AS cost, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out"


@query(
    f"""WITH {USAGE}, s AS (SELECT *, 'all' AS scope FROM u UNION ALL SELECT *, 'today' FROM u WHERE starts_with(ts, '{TODAY}'))
SELECT scope, alias, {TOTALS}, grouping(alias)::INT AS is_total FROM s GROUP BY GROUPING SETS ((scope), (scope, alias))"""
)
def usage_aggregate(spark, sf_dir):
    return A.usage_scopes(_usage(spark, sf_dir), TODAY)


@query(
    f"""WITH {USAGE}, v AS (SELECT ts, status, cost, tokens_in, tokens_out, CASE WHEN mode = 'draft' THEN '(grep, no model)' ELSE coalesce(nullif(alias, 'view'), '(raw id)') END AS alias,
CASE WHEN tokens_out % 11 = 3 THEN 'probe' ELSE 'job' END AS kind, tokens_out % 6 = 0 AS guess FROM u WHERE tokens_out % 13 <> 1 AND tokens_out % 11 <> 5),
s AS (SELECT *, 'all' AS scope FROM v UNION ALL SELECT *, 'today' FROM v WHERE starts_with(ts, '{TODAY}'))
SELECT scope, kind, alias, {TOTALS}, count(*) FILTER (guess) AS estimated, grouping(alias)::INT AS is_total FROM s
GROUP BY GROUPING SETS ((scope, kind), (scope, kind, alias)) HAVING kind = 'job' OR grouping(alias) = 1"""
)
def usage_report(spark, sf_dir):
    """Some records are of probes, of another tool, of dry runs or of no alias."""
    n = F.col("tokens_out")
    u = _usage(spark, sf_dir).withColumn("tool", F.when(n % 11 == 3, "probe").when(n % 11 == 5, "status").otherwise("run")).withColumn("dry_run", F.when(n % 13 == 1, True))
    u = u.withColumn("mode", F.when(F.col("mode") == "draft", "grep").otherwise(F.col("mode"))).withColumn("alias", F.when(F.col("alias") != "view", F.col("alias")))
    return A.usage_report(u.withColumn("cost_estimated", n % 6 == 0), TODAY)


@query(f"WITH {USAGE}, m AS (SELECT *, unnest(models) AS model FROM u) SELECT model, {TOTALS} FROM m GROUP BY model")
def usage_by_model(spark, sf_dir):
    return A.usage_by_model(_usage(spark, sf_dir))


@query(
    f"""WITH {USAGE}, m AS (SELECT alias, mode, min(ts) AS f, avg(pass_rate) AS r, count(*) AS k FROM u WHERE pass_rate IS NOT NULL GROUP BY ALL),
t AS (SELECT alias, string_agg(mode || ' ' || round(r * 100)::INT || '% (' || k || ')', ', ' ORDER BY f, mode) AS pass_rates FROM m GROUP BY alias)
SELECT alias, jobs, cost, pass_rates FROM (SELECT alias, count(*) AS jobs, sum(cost)::BIGINT AS cost FROM u GROUP BY alias) JOIN t USING (alias)"""
)
def usage_by_alias(spark, sf_dir):
    return A.usage_by_alias(_usage(spark, sf_dir))


@query(f"WITH {USAGE} SELECT substr(ts, 1, 10) AS day, sum(cost)::BIGINT AS spent, count(*) AS jobs FROM u GROUP BY 1")
def spent_by_day(spark, sf_dir):
    return _usage(spark, sf_dir).groupBy(F.substring("ts", 1, 10).alias("day")).agg(F.sum("cost").alias("spent"), F.count(F.lit(1)).alias("jobs"))


# --- models: parts offered by suppliers stand for models offered by providers ---


def _endpoints(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    price = F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 20)
    return li.select(
        F.concat(F.lit("m/"), F.col("l_partkey") % 500).alias("model_id"), F.col("l_suppkey").alias("provider"), (F.col("l_quantity") * 1000).cast("long").alias("context"),
        (F.col("l_orderkey") % 9000 + 1000).alias("max_out"), price.alias("price_in"), (F.col("l_tax") * 100).alias("price_out"),
        F.when(F.col("l_linenumber") != 3, (F.col("l_quantity") - 2).cast("long") * 500).alias("max_prompt"), F.when(F.col("l_linenumber") > 4, F.col("l_discount")).alias("price_request"),
    )


ENDPOINTS = """e AS (SELECT 'm/' || (l_partkey % 500) AS model_id, l_suppkey AS provider, (l_quantity * 1000)::BIGINT AS context, l_orderkey % 9000 + 1000 AS max_out,
CASE WHEN l_linenumber <> 7 THEN l_discount * 20 END AS price_in, l_tax * 100 AS price_out,
CASE WHEN l_linenumber <> 3 THEN (l_quantity - 2)::BIGINT * 500 END AS max_prompt, CASE WHEN l_linenumber > 4 THEN l_discount END AS price_request FROM lineitem),
f AS (SELECT model_id, count(*) AS endpoints, count(DISTINCT provider) AS providers, min(context) AS context, min(max_out) AS max_out,
min(coalesce(price_in, 'inf'::DOUBLE)) AS min_in, max(coalesce(price_in, 'inf'::DOUBLE)) AS max_in, min(coalesce(price_out, 'inf'::DOUBLE)) AS min_out,
max(coalesce(price_out, 'inf'::DOUBLE)) AS max_out_price, min(max_prompt) FILTER (max_prompt > 0) AS max_prompt, greatest(max(coalesce(price_request, 0)), 0)::DOUBLE AS price_request FROM e GROUP BY 1),
c AS (SELECT model_id, min((price_in, price_out)) AS b FROM e WHERE price_in <= 0.15 AND price_out <= 2 GROUP BY 1),
ids AS (SELECT DISTINCT 'm/' || (l_partkey % 500) || CASE l_linenumber % 4 WHEN 1 THEN ':Nitro:free' WHEN 2 THEN ':free' ELSE '' END AS model_id FROM lineitem),
t AS (SELECT model_id, CASE WHEN isinf(min_in) THEN '?' ELSE '$' || rtrim(rtrim(printf('%.3f', min_in), '0'), '.') END AS low_in,
 CASE WHEN isinf(min_out) THEN '?' ELSE '$' || rtrim(rtrim(printf('%.3f', min_out), '0'), '.') END AS low_out FROM f),
s AS (SELECT ids.model_id, c.b[1] AS fit_in, c.b[2] AS fit_out, CASE WHEN contains(lower(ids.model_id), ':nitro') THEN 'refused variant suffix' WHEN f.model_id IS NULL THEN 'no ZDR endpoint'
 WHEN ids.model_id LIKE '%7' THEN 'blocked by account' WHEN c.b IS NULL THEN 'over price cap (no ZDR endpoint within in $0.15 / out $2 per 1M; lowest in ' || low_in || ' / out ' || low_out
 || CASE WHEN min_in <= 0.15 AND min_out <= 2 THEN ', on different endpoints)' ELSE ')' END END AS reason
 FROM ids LEFT JOIN f USING (model_id) LEFT JOIN c USING (model_id) LEFT JOIN t USING (model_id))"""


@query(f"WITH {ENDPOINTS} SELECT * REPLACE (CASE WHEN isinf(max_in) THEN NULL ELSE max_in END AS max_in) FROM f")
def model_facts(spark, sf_dir):
    df = A.model_facts(_endpoints(spark, sf_dir))
    return df.withColumn("max_in", F.when(F.col("max_in") < float("inf"), F.col("max_in")))


@query(f"WITH {ENDPOINTS} SELECT model_id, b[1] AS fit_in, b[2] AS fit_out FROM c")
def cheapest_fit(spark, sf_dir):
    return A.cheapest_fitting(_endpoints(spark, sf_dir), 0.15, 2.0)


def _screened(spark, sf_dir) -> DataFrame:
    e = _endpoints(spark, sf_dir)
    facts = A.model_facts(e)
    variant = F.when(F.col("l_linenumber") % 4 == 1, ":Nitro:free").when(F.col("l_linenumber") % 4 == 2, ":free").otherwise("")
    ids = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m/"), F.col("l_partkey") % 500, variant).alias("model_id")).distinct()
    account = facts.where(~F.col("model_id").endswith("7"))
    return A.screen(ids, facts, A.cheapest_fitting(e, 0.15, 2.0), account, (0.15, 2.0))


@query(f"WITH {ENDPOINTS} SELECT model_id, reason FROM s")
def screen_ids(spark, sf_dir):
    return _screened(spark, sf_dir).select("model_id", "reason")


@query(f"WITH {ENDPOINTS} SELECT model_id, fit_in, fit_out FROM s WHERE reason IS NULL ORDER BY fit_in, fit_out, model_id LIMIT 10")
def candidates_topk(spark, sf_dir):
    return A.candidates(_screened(spark, sf_dir)).select("model_id", "fit_in", "fit_out")


# --- benchmark scores: labels and documents stand for truth and answers ---


def _truth(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    line = F.concat(F.lit("L"), "doc_id")
    lab = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("line", line)
    required = lab.where("quality = 1").select("source", "line")
    allowed = lab.where("toxic = 1").select("source", "line")
    items = docs.where("doc_id % 3 != 0").select("source", line.alias("line"))
    return items, required, allowed


SCORES = """l AS (SELECT source, 'L' || doc_id AS line, quality, toxic FROM labels JOIN documents USING (doc_id)),
i AS (SELECT source, 'L' || doc_id AS line FROM documents WHERE doc_id % 3 <> 0),
sc AS (SELECT source, coalesce(n.need, 0) AS need, coalesce(g.hit, 0) AS hit, coalesce(g.answered, 0) AS answered, coalesce(g.in_allowed, 0) AS in_allowed
FROM (SELECT source, count(DISTINCT line) AS need FROM l WHERE quality = 1 GROUP BY 1) n FULL JOIN
(SELECT i.source, count(DISTINCT CASE WHEN quality = 1 THEN i.line END) AS hit, count(*) AS answered, count(*) FILTER (quality = 1 OR toxic = 1) AS in_allowed
 FROM i LEFT JOIN l ON l.source = i.source AND l.line = i.line GROUP BY 1) g USING (source))"""


@query(f"WITH {SCORES} SELECT source, hit, need, answered, in_allowed FROM sc")
def score_extract(spark, sf_dir):
    return A.score_extract(*_truth(spark, sf_dir), "source")


@query(
    f"""WITH {SCORES} SELECT DISTINCT source, line, 'missing' AS what FROM l WHERE quality = 1 AND NOT EXISTS (FROM i WHERE i.source = l.source AND i.line = l.line)
UNION ALL SELECT DISTINCT source, line, 'extra' FROM i WHERE NOT EXISTS (FROM l WHERE l.source = i.source AND l.line = i.line AND (quality = 1 OR toxic = 1))"""
)
def score_extract_misses(spark, sf_dir):
    return A.extract_misses(*_truth(spark, sf_dir), "source")


@query(
    """WITH c AS (SELECT item_id AS case_id, CASE item_id % 4 WHEN 0 THEN 'grep' ELSE 'extract' END AS mode FROM benchmark)
SELECT case_id, mode, model, rep FROM c, unnest(CASE mode WHEN 'grep' THEN ['(grep)'] ELSE ['m/a', 'm/b'] END) AS m(model), unnest([1, 2, 3]) AS r(rep)"""
)
def bench_runs(spark, sf_dir):
    """Items of the benchmark stand for cases."""
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.when(F.col("item_id") % 4 == 0, "grep").otherwise("extract").alias("mode"))
    return A.bench_runs(cases, ["m/a", "m/b"], 3)


@query(
    f"""WITH {SCORES}, b AS (SELECT 'm' || substr(source, 4)::INT % 3 AS model, 'p' || substr(source, 4)::INT % 2 AS provider, hit, need, answered, in_allowed,
substr(source, 4)::INT % 7 = 0 AS failed, substr(source, 4)::INT AS cost FROM sc)
SELECT model, provider, sum(hit) FILTER (NOT failed)::BIGINT AS hit, sum(need) FILTER (NOT failed)::BIGINT AS need, sum(answered) FILTER (NOT failed)::BIGINT AS answered,
sum(in_allowed) FILTER (NOT failed)::BIGINT AS in_allowed, sum(cost)::BIGINT AS cost, count(*) AS runs,
sum(hit) FILTER (NOT failed) / sum(need) FILTER (NOT failed) AS recall, sum(in_allowed) FILTER (NOT failed) / sum(answered) FILTER (NOT failed) AS precision
FROM b GROUP BY GROUPING SETS ((model), (provider))"""
)
def bench_summary(spark, sf_dir):
    k = F.substring("source", 4, 9).cast("int")
    runs = A.score_extract(*_truth(spark, sf_dir), "source").select(
        F.concat(F.lit("m"), k % 3).alias("model"), F.concat(F.lit("p"), k % 2).alias("provider"), "hit", "need", "answered", "in_allowed",
        (k % 7 == 0).alias("failed"), k.alias("cost"),
    )
    return A.bench_summary(runs)


# --- stored results ---


@query(
    """WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations),
p AS (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS so_far FROM r WHERE k BETWEEN 1 AND 3)
SELECT conv_id, turn, k::INT AS k FROM p WHERE so_far <= 2000 OR k = 1"""
)
def page_results(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return A.page_rows(rows, "conv_id", "turn", 1, 3, 2000).select("conv_id", "turn", F.col("at").alias("k"))


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey AS id, o_orderdate AS time, o_totalprice::BIGINT AS bytes, o_orderstatus = 'P' AS running FROM orders),
p AS (SELECT *, sum(bytes) OVER (PARTITION BY o_custkey ORDER BY running DESC, time DESC, id DESC ROWS UNBOUNDED PRECEDING) AS s FROM r)
SELECT id, running OR s <= 500000 AS kept FROM p"""
)
def prune_results(spark, sf_dir):
    """Per customer, as per state folder: the newest results within a limit of bytes."""
    o = table(spark, sf_dir, "orders")
    r = o.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("time"), F.round("o_totalprice").cast("long").alias("bytes"), (F.col("o_orderstatus") == "P").alias("running"))
    return A.prune_plan(r, 500_000, "o_custkey").select("id", "kept")


@query("SELECT user_id AS path, max(event_id) AS seq, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id")
def manifest_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return A.latest(e, "path", "seq").select("path", "seq", "kind")


@query(
    """WITH o AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'done' END AS status FROM orders),
l AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity >= 45)
SELECT id, CASE WHEN status = 'running' AND id NOT IN (SELECT id FROM l) THEN 'interrupted' ELSE status END AS status FROM o"""
)
def result_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    live = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("id"))
    return A.with_status(o, live).select("id", "status")


@query(
    """WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'union' AS op, doc_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', doc_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', doc_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""
)
def set_ops(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    a, b = lab.where("quality = 1").select("doc_id"), lab.where("toxic = 1").select("doc_id")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b).distinct()}
    out = None
    for k, df in parts.items():
        one = df.select(F.lit(k).alias("op"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT page_id, strlen(html) AS bytes, CASE WHEN strlen(html) > 30720 THEN 'whole read refused' END AS reason FROM pages"""
)
def size_gate(spark, sf_dir):
    """Which pages are too large to be read whole."""
    n = F.octet_length("html").cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n.alias("bytes"), F.when(n > 30_720, "whole read refused").alias("reason"))


@query(
    """WITH d AS (SELECT lang, doc_id % 3 AS k FROM documents WHERE lang IS NOT NULL)
SELECT lang, sum(CASE k WHEN 1 THEN 0 ELSE 1 END + 1)::BIGINT AS hit, 2 * count(*) AS need, sum(CASE k WHEN 1 THEN 0 ELSE 1 END + 1)::BIGINT AS "right",
sum(CASE k WHEN 2 THEN 3 ELSE 2 END)::BIGINT AS answered, sum(CASE k WHEN 1 THEN 0 ELSE 1 END + 1) / (2 * count(*)) AS recall,
sum(CASE k WHEN 1 THEN 0 ELSE 1 END + 1) / sum(CASE k WHEN 2 THEN 3 ELSE 2 END) AS precision, count(*) FILTER (k = 2) / count(*) AS invented_rate FROM d GROUP BY lang"""
)
def score_schema(spark, sf_dir):
    """Answers in a schema's shape against the truth: right, wrong and invented leaves, and a list of one item."""
    d = table(spark, sf_dir, "documents").where("lang is not null").select("lang", "doc_id", "n_chars")
    k, item = F.col("doc_id") % 3, F.array(F.struct(F.col("n_chars").alias("n")))
    never = {"ignoreNullFields": "false"}
    want = F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("gone"), item.alias("rows")), never)
    got = F.to_json(F.struct(F.when(k == 1, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("id"), F.when(k == 2, "made up").alias("gone"), item.alias("rows")), never)
    return S.recall_precision(d.select("lang", S.score_schema(want, got).alias("s")), "lang")
