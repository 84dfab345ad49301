"""Usage, model catalogue and benchmark scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import price_text

# Variants of a model that are refused, wherever in its id they stand.
REFUSED_SUFFIXES = ("online", "nitro", "floor", "exacto", "thinking", "extended")

USAGE = (
    "ts string, tool string, mode string, alias string, primary string, models_used array<string>, chunks int, chunks_done int, tokens_in bigint, "
    "tokens_out bigint, cost double, cost_estimated boolean, failed_attempts int, ms bigint, truncated int, status string, "
    "check struct<mode:string,pass_rate:double>, result_id string, error string"
)


def read_usage(spark, path: str) -> DataFrame:
    """Usage records of JSON lines; torn lines are skipped."""
    return spark.read.schema(USAGE).option("mode", "DROPMALFORMED").json(path)


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("status").isNotNull() & (F.col("status") != "done")).alias("failed"),
        F.sum("cost").alias("cost"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
    ]


def usage_scopes(records: DataFrame, today: str) -> DataFrame:
    """Totals for scope all and today, altogether and by alias: one pass with grouping sets."""
    scoped = records.withColumn("scope", F.explode(F.when(F.col("ts").startswith(today), F.array(F.lit("all"), F.lit("today"))).otherwise(F.array(F.lit("all")))))
    return scoped.groupingSets([["scope"], ["scope", "alias"]], "scope", "alias").agg(*_totals(), F.grouping("alias").cast("int").alias("is_total"))


def usage_report(records: DataFrame, today: str, tool: str = "run") -> DataFrame:
    """(scope, kind, alias, jobs, failed, cost, tokens_in, tokens_out, estimated, is_total): jobs altogether
    and by alias, probes altogether; dry runs and other tools count nowhere."""
    kept = records.where(~F.coalesce("dry_run", F.lit(False)) & F.col("tool").isin(tool, "probe"))
    kept = kept.withColumn("kind", F.when(F.col("tool") == "probe", "probe").otherwise("job"))
    kept = kept.withColumn("alias", F.when(F.col("mode") == "grep", "(grep, no model)").otherwise(F.coalesce("alias", F.lit("(raw id)"))))
    scoped = kept.withColumn("scope", F.explode(F.when(F.col("ts").startswith(today), F.array(F.lit("all"), F.lit("today"))).otherwise(F.array(F.lit("all")))))
    groups = scoped.groupingSets([["scope", "kind"], ["scope", "kind", "alias"]], "scope", "kind", "alias")
    out = groups.agg(*_totals(), F.count_if("cost_estimated").alias("estimated"), F.grouping("alias").cast("int").alias("is_total"))
    return out.where("kind = 'job' or is_total = 1")


def usage_by_model(records: DataFrame) -> DataFrame:
    """A job's whole cost goes to each model that it used."""
    return records.withColumn("model", F.explode("models_used")).groupBy("model").agg(*_totals())


def usage_by_alias(records: DataFrame) -> DataFrame:
    """Jobs, cost, and the mean pass rate of each mode as text, in order of first use."""
    modes = records.where("pass_rate is not null").groupBy("alias", "mode").agg(F.min("ts").alias("first"), F.avg("pass_rate").alias("rate"), F.count(F.lit(1)).alias("k"))
    text = F.concat("mode", F.lit(" "), F.round(F.col("rate") * 100).cast("int"), F.lit("% ("), "k", F.lit(")"))
    rates = modes.groupBy("alias").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", text.alias("t")))), lambda x: x["t"]), ", ").alias("pass_rates"))
    return records.groupBy("alias").agg(F.count(F.lit(1)).alias("jobs"), F.sum("cost").alias("cost")).join(rates, "alias", "left")


# --- models ---


def model_facts(endpoints: DataFrame) -> DataFrame:
    """Per model of endpoints (model_id, provider, context, max_out, price_in, price_out): what holds for all of them.
    A price that is missing is unknown and so endless.  Where endpoints have max_prompt and price_request, the
    smallest prompt limit above 0 and the highest price a request, a missing one being none."""
    inf = F.lit(float("inf"))
    more = []
    if "max_prompt" in endpoints.columns:
        more.append(F.min(F.when(F.col("max_prompt") > 0, F.col("max_prompt"))).alias("max_prompt"))
    if "price_request" in endpoints.columns:
        more.append(F.max(F.greatest(F.coalesce("price_request", F.lit(0.0)), F.lit(0.0))).alias("price_request"))
    return endpoints.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("endpoints"), F.countDistinct("provider").alias("providers"), F.min("context").alias("context"), F.min("max_out").alias("max_out"),
        F.min(F.coalesce("price_in", inf)).alias("min_in"), F.max(F.coalesce("price_in", inf)).alias("max_in"),
        F.min(F.coalesce("price_out", inf)).alias("min_out"), F.max(F.coalesce("price_out", inf)).alias("max_out_price"), *more,
    )


def cheapest_fitting(endpoints: DataFrame, cap_in: float, cap_out: float) -> DataFrame:
    """Per model the cheapest endpoint with both prices within the cap."""
    fits = endpoints.where((F.col("price_in") <= cap_in) & (F.col("price_out") <= cap_out))
    best = fits.groupBy("model_id").agg(F.min(F.struct("price_in", "price_out")).alias("b"))
    return best.select("model_id", F.col("b.price_in").alias("fit_in"), F.col("b.price_out").alias("fit_out"))


def refused(model_id: Column) -> Column:
    """Whether an id (`vendor/model:free:nitro`) has a refused variant in any place."""
    parts = F.split(F.lower(model_id), ":")
    return F.arrays_overlap(F.slice(parts, 2, F.size(parts)), F.array(*map(F.lit, REFUSED_SUFFIXES)))


def screen(ids: DataFrame, facts: DataFrame, fitting: DataFrame, account: DataFrame | None = None, cap: tuple[float, float] | None = None) -> DataFrame:
    """ids (model_id) with what is known of each and `reason`, the first thing that speaks against it, else null.

    `account` has the ids that may be used.  With a cap one endpoint must be within both prices
    (`fitting`); without one every endpoint needs a price."""
    df = ids.join(facts, "model_id", "left").join(fitting, "model_id", "left")
    reason = F.when(refused(F.col("model_id")), "refused variant suffix").when(F.col("endpoints").isNull(), "no ZDR endpoint")
    if account is not None:
        df = df.join(account.select("model_id").distinct().withColumn("usable", F.lit(True)), "model_id", "left")
        reason = reason.when(F.col("usable").isNull(), "blocked by account")
    reason = reason.when(F.col("context").isNull(), "no context length in the ZDR list")
    if cap is None:
        endless = F.lit(float("inf"))
        reason = reason.when((F.col("max_in") == endless) | (F.col("max_out_price") == endless), "price unknown")
    else:
        most = [price_text(F.lit(c)) for c in cap]
        apart = F.when((F.col("min_in") <= cap[0]) & (F.col("min_out") <= cap[1]), ", on different endpoints").otherwise("")
        lowest = [F.lit("; lowest in "), price_text(F.col("min_in")), F.lit(" / out "), price_text(F.col("min_out")), apart, F.lit(")")]
        over = F.concat(F.lit("over price cap (no ZDR endpoint within in "), most[0], F.lit(" / out "), most[1], F.lit(" per 1M"), *lowest)
        reason = reason.when(F.col("fit_in").isNull(), over)
    return df.withColumn("reason", reason).drop("usable")


def candidates(screened: DataFrame, top: int = 10) -> DataFrame:
    """The cheapest models that nothing speaks against."""
    return screened.where("reason is null").orderBy("fit_in", "fit_out", "model_id").limit(top)


# --- benchmark ---


def score_extract(items: DataFrame, required: DataFrame, allowed: DataFrame, *by: str) -> DataFrame:
    """hit, need, answered, in_allowed per key; items, required and allowed are (by, line) rows."""
    ok = required.select(*by, "line").unionByName(allowed.select(*by, "line")).distinct().withColumn("fine", F.lit(True))
    need = required.select(*by, "line").distinct().withColumn("wanted", F.lit(True))
    rows = items.join(ok, [*by, "line"], "left").join(need, [*by, "line"], "left")
    got = rows.groupBy(*by).agg(F.countDistinct(F.when(F.col("wanted"), F.col("line"))).alias("hit"), F.count(F.lit(1)).alias("answered"), F.count_if("fine").alias("in_allowed"))
    out = need.groupBy(*by).agg(F.count(F.lit(1)).alias("need")).join(got, list(by), "full")
    return out.select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hit", "need", "answered", "in_allowed")])


def extract_misses(items: DataFrame, required: DataFrame, allowed: DataFrame, *by: str) -> DataFrame:
    """(by, line, what): required lines that no item has are missing, lines neither required nor allowed are extra."""
    on = [*by, "line"]
    need, got = required.select(*on).distinct(), items.where("line is not null").select(*on).distinct()
    missing = need.join(got, on, "left_anti").withColumn("what", F.lit("missing"))
    extra = got.join(need.unionByName(allowed.select(*on)), on, "left_anti").withColumn("what", F.lit("extra"))
    return missing.unionByName(extra)


def bench_runs(cases: DataFrame, models: list[str], reps: int) -> DataFrame:
    """cases (case_id, mode) by model and repetition; a grep case calls no model and has a run of `(grep)` each time."""
    used = F.when(F.col("mode") == "grep", F.array(F.lit("(grep)"))).otherwise(F.array(*map(F.lit, models)))
    return cases.withColumn("model", F.explode(used)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))


def bench_summary(scores: DataFrame) -> DataFrame:
    """Recall and precision by model and by provider, of sums; failed runs count in cost alone."""
    done = [F.sum(F.when(~F.col("failed"), F.col(c))).alias(c) for c in ("hit", "need", "answered", "in_allowed")]
    df = scores.groupingSets([["model"], ["provider"]], "model", "provider").agg(*done, F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("runs"))
    return df.withColumn("recall", F.try_divide("hit", "need")).withColumn("precision", F.try_divide("in_allowed", "answered"))


# --- stored results ---


def page_rows(rows: DataFrame, key: str, order: str, offset: int, limit: int, max_bytes: int) -> DataFrame:
    """A page of rows (key, order, text): at most `limit` from `offset`, stopping before max_bytes; one at least."""
    w = Window.partitionBy(key).orderBy(order)
    df = rows.withColumn("at", F.row_number().over(w) - 1).where(F.col("at").between(offset, offset + limit - 1))
    so_far = F.sum(F.octet_length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("so_far", so_far).where((F.col("so_far") <= max_bytes) | (F.col("at") == offset)).drop("so_far")


def prune_plan(results: DataFrame, max_bytes: int, *by: str) -> DataFrame:
    """results (id, time, bytes, running) with `kept`: newest first until the limit; running ones stay and count."""
    w = Window.partitionBy(*by).orderBy(F.col("running").desc(), F.col("time").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("so_far", F.sum("bytes").over(w)).withColumn("kept", F.col("running") | (F.col("so_far") <= max_bytes)).drop("so_far")


def latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*")


def with_status(results: DataFrame, live: DataFrame) -> DataFrame:
    """`running` results that aren't live are interrupted."""
    df = results.join(live.select("id").distinct().withColumn("alive", F.lit(True)), "id", "left")
    return df.withColumn("status", F.when((F.col("status") == "running") & F.col("alive").isNull(), "interrupted").otherwise(F.col("status"))).drop("alive")
