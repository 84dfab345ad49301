"""A job from its lines to its report: what is sent, what it costs, what is said about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mask import mask_lines
from ..functions.text import strip_fence
from . import filters as X
from .checks import NOT_IN_INPUT, clip

# The frames around text that isn't to be obeyed.
FRAMES = ("--- untrusted model output ---", "--- end ---", "--- source text (masked) ---", "--- end of source text ---")
#: How bad a status is, worst first; all others come last.
RANKS = ("bad", "flag", "partial")
CONTROL = r"[\x00-\x1f\x7f-\x9f\u2028\u2029]"
SHOWN, WIDTH = 20, 200


# --- what is sent -------------------------------------------------------------------


def sent_lines(
    docs: DataFrame,
    pattern: str,
    k: int = 3,
    first: int = 1,
    last: int = 2**31 - 1,
    since_ms: int | None = None,
    until_ms: int | None = None,
    ignore_case: bool = False,
    key: str = "file_id",
) -> DataFrame:
    """(key, n, text, hits, block, hit) of documents (key, lines) in the one order that is safe:
    range, time on the raw lines, masking, pattern on the masked ones with k lines around.

    All lines are masked before any is dropped, as a secret of several lines may begin
    outside the range."""
    both = docs.select(key, F.posexplode(F.arrays_zip(F.col("lines").alias("raw"), mask_lines(F.col("lines")).alias("m"))).alias("at", "x"))
    rows = both.select(key, (F.col("at") + 1).alias("n"), F.col("x.raw").alias("text"), F.col("x.m").alias("m")).where(F.col("n").between(first, last))
    if since_ms is not None or until_ms is not None:
        rows = X.time_window(rows, since_ms, until_ms, key)
    rows = rows.select(key, "n", F.col("m.text").alias("text"), F.col("m.hits").alias("hits"), F.col("m.block").alias("block"))
    return X.context_rows(rows, X.matches(F.col("text"), pattern, ignore_case), k, key)


def mask_tally(sent: DataFrame, *by: str) -> DataFrame:
    """(by, rule, count) over sent lines only; a secret of several lines counts once."""
    ones = sent.select(*by, F.explode("hits").alias("rule", "count"))
    blocks = sent.where("block is not null").select(*by, "block").distinct()
    named = blocks.select(*by, F.when(F.col("block").startswith("pem:"), "pem").otherwise("kv_secret").alias("rule"), F.lit(1).alias("count"))
    return ones.unionByName(named).groupBy(*by, "rule").agg(F.sum("count").cast("long").alias("count"))


def neutralize(line: Column) -> Column:
    """A line that looks like a frame is quoted, so it can't close or open one."""
    return F.when(F.trim(line, F.lit(" \t")).isin(*FRAMES), F.concat(F.lit("> "), line)).otherwise(line)


def preview(lines: Column, shown: int = SHOWN, width: int = WIDTH) -> Column:
    """The first lines of an array, clipped and neutralized."""
    clip = lambda x: F.when(F.length(x) > width, F.concat(F.substring(x, 1, width), F.lit("…"))).otherwise(x)
    return F.transform(F.slice(lines, 1, shown), lambda x: neutralize(clip(x)))


def with_markers(lines: DataFrame, markers: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, at, side, text): a source's full numbered copy, each marker (key, at, text) behind line `at`."""
    numbered = lines.select(key, F.col("n").alias("at"), F.lit(0).alias("side"), F.concat(F.lit("L"), F.col("n").cast("string"), F.lit("| "), "text").alias("text"))
    return numbered.unionByName(markers.select(key, "at", F.lit(1).alias("side"), "text"))


def request_body(model: Column, params: Column, system: Column, user: Column, max_tokens: Column, cap_in: Column, cap_out: Column) -> Column:
    """A call as JSON: parameters (a map) first, what the job says wins over them."""
    own = F.struct(
        model.alias("model"),
        F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"),
        F.struct(F.lit(True).alias("zdr"), F.lit("deny").alias("data_collection"), F.when(cap_in.isNotNull(), F.struct(cap_in.alias("prompt"), cap_out.alias("completion"))).alias("max_price")).alias("provider"),
        F.array(F.struct(F.lit("context-compression").alias("id"), F.lit(False).alias("enabled"))).alias("plugins"),
        max_tokens.alias("max_completion_tokens"),
    )
    left = F.map_filter(params, lambda k, _: ~k.isin("model", "messages", "max_completion_tokens", "provider", "plugins"))
    body = F.to_json(own)
    return F.when(F.size(left) > 0, F.concat(F.regexp_replace(F.to_json(left), r"\}$", ","), F.substring(body, 2, 2**31 - 1))).otherwise(body)


# --- edits ---------------------------------------------------------------------------


def _one_json(text: Column) -> Column:
    """The one JSON value that a text is, else null; in brackets, as what comes behind a value would be passed over."""
    each = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(each) == 1, F.get(each, F.lit(0)))


def parse_edits(answers: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, pos, value, error) of answers (key, lines), taken out of their fence: the elements of one JSON array, or one
    JSON value a line with a comma allowed behind it; a line that is neither is an error."""
    kind = "array<struct<pos:int,value:string,error:string>>"
    whole = F.trim(F.array_join("_lines", "\n"))
    listed = F.transform("_all", lambda v, i: F.struct(i.alias("pos"), F.to_json(v).alias("value"), F.lit(None).cast("string").alias("error"))).cast(kind)
    read = F.transform("_lines", lambda x, i: F.struct(i.alias("pos"), x.alias("raw"), F.regexp_replace(F.trim(x), ",$", "").alias("t")))
    read = F.filter(read, lambda x: ~x["t"].isin("", "[", "]") & ~x["t"].rlike(NOT_IN_INPUT))
    read = F.transform(read, lambda x: F.struct(x["pos"].alias("pos"), x["raw"].alias("raw"), F.to_json(_one_json(x["t"])).alias("value")))
    fault = lambda x: F.when(x["value"].isNull(), F.concat(F.lit("not JSON: "), clip(x["raw"])))
    lines = F.transform(read, lambda x: F.struct(x["pos"].alias("pos"), x["value"].alias("value"), fault(x).alias("error"))).cast(kind)
    df = answers.select(key, strip_fence(F.col("lines")).alias("_lines"))
    df = df.withColumn("_all", F.when(whole.startswith("["), F.try_variant_get(_one_json(whole), "$", "array<variant>")))
    return df.select(key, F.inline(F.when(F.col("_all").isNotNull(), listed).otherwise(lines)))


# --- what it costs -------------------------------------------------------------------


def price_within(price: Column, cap: Column | None) -> Column:
    """The price that a call may be charged: the highest, or the cap if that is lower."""
    return price if cap is None else F.least(price, cap)


def max_tokens_within(requested: Column, max_out: Column, context: Column, prompt: Column) -> Column:
    """Tokens that a call may answer with: as asked, as the model allows, as the context leaves."""
    return F.least(requested, max_out, context - prompt)


def worst_cost(prompt: Column, out: Column, price_in: Column, price_out: Column, a_call: Column) -> Column:
    """Prices are of a million tokens; a call may have a price of its own."""
    return (prompt * price_in + out * price_out) / F.lit(1e6) + F.coalesce(a_call, F.lit(0.0))


def prompt_cost(prompt: Column, price_in: Column, a_call: Column) -> Column:
    """What a failed call that may have been read costs."""
    return worst_cost(prompt, F.lit(0), price_in, F.lit(0.0), a_call)


def actual_cost(said: Column, prompt: Column, out: Column, price_in: Column, price_out: Column, a_call: Column) -> Column:
    """(cost, estimated): what the provider says, or an estimate where it says nothing sound."""
    sound = said.isNotNull() & ~F.isnan(said) & (said >= 0) & (said < float("inf"))
    guess = worst_cost(F.coalesce(prompt, F.lit(0)), F.coalesce(out, F.lit(0)), price_in, price_out, a_call)
    return F.struct(F.when(sound, said).otherwise(guess).alias("cost"), (~sound).alias("estimated"))


def job_totals(calls: DataFrame, key: str = "job") -> DataFrame:
    """Per job of calls (key, chunk, model, tokens_in, tokens_out, cost, estimated, state, truncated):
    failed and dropped calls are paid for but do nothing; a failed one brings no model."""
    billed = F.col("state").isin("done", "dropped")
    return calls.groupBy(key).agg(
        F.sum(F.when(billed, F.col("tokens_in")).otherwise(0)).alias("tokens_in"),
        F.sum(F.when(billed, F.col("tokens_out")).otherwise(0)).alias("tokens_out"),
        F.sum("cost").alias("cost"),
        (F.count_if(F.col("state") == "failed") > 0).alias("failed_any"),
        F.coalesce(F.bool_or((F.col("state") == "failed") | F.col("estimated")), F.lit(False)).alias("cost_estimated"),
        F.countDistinct(F.when(F.col("state") != "dropped", F.col("chunk"))).alias("chunks"),
        F.countDistinct(F.when(F.col("state") == "done", F.col("chunk"))).alias("chunks_done"),
        F.count_if((F.col("state") == "done") & F.col("truncated")).alias("truncated"),
        F.sort_array(F.collect_set(F.when(billed, F.col("model")))).alias("models_used"),
    )


def pick_models(ids: DataFrame, facts: DataFrame, prompt: Column, requested: Column, key: str = "job") -> DataFrame:
    """Ids (key, ord, model_id) in their order with `part`: primary, fallback, or why not."""
    df = ids.join(facts, "model_id", "left").withColumn("most", max_tokens_within(requested, F.col("max_out"), F.col("context"), prompt))
    why = F.when(F.col("context").isNull(), "unknown").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("most") < 1, "context too small")
    df = df.withColumn("why", why)
    place = F.row_number().over(Window.partitionBy(key, F.col("why").isNull()).orderBy("ord", "model_id"))
    return df.withColumn("part", F.coalesce("why", F.when(place == 1, "primary").otherwise("fallback"))).drop("why", "reason")


# --- what is said about it -----------------------------------------------------------


def lean(items: DataFrame) -> DataFrame:
    """Items that are ok keep no text, as the result has the line."""
    return items.withColumn("text", F.when(~F.coalesce(F.col("status").isin("ok", "ok~"), F.lit(False)), F.col("text")))


def with_place(line: Column, n: Column, name: Column, place: Column) -> Column:
    """An answer's line with the place that is known for it in its prefix, `a.md:L12 (p.3)| text`."""
    lead, text = F.regexp_extract(line, r"^\s*", 0), F.regexp_extract(line, r"(?s)L\d+(?:\s*\([^|]*\))?\|(.*)$", 1)
    where = F.when(place.isNotNull(), F.concat(F.lit(" ("), place, F.lit(")"))).otherwise("")
    head = F.when(name.isNotNull(), F.concat(name, F.lit(":"))).otherwise("")
    return F.concat(lead, head, F.lit("L"), n.cast("string"), where, F.lit("|"), text)


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def describe(where: Column, status: Column, why: Column) -> Column:
    """One line about an item: where, what, why."""
    return clipped(F.rtrim(F.concat(where, F.lit(" ["), F.coalesce(status, F.lit("bad")), F.lit("] "), F.coalesce(why, F.lit("")))), 180)


def rank(status: Column) -> Column:
    out = F.lit(len(RANKS))
    for i, name in enumerate(RANKS):
        out = F.when(status == name, i).otherwise(out)
    return out


def worst_items(items: DataFrame, key: str = "job", order: str = "pos", most: int = 10) -> DataFrame:
    """(key, at, line) of the worst items (key, pos, where, status, why), bad ones first, each in
    its order, and a last line with how many more there are.  Spark keeps `most` a task before
    it shuffles (a window with a limit on its rank), so a job with very many items is no burden."""
    bad = items.where(F.col("status").isin("bad", "flag"))
    at = F.row_number().over(Window.partitionBy(key).orderBy(rank(F.col("status")), order, "where", "why"))
    first = bad.withColumn("at", at).where(F.col("at") <= most).select(key, "at", describe(F.col("where"), F.col("status"), F.col("why")).alias("line"))
    more = bad.groupBy(key).agg((F.count(F.lit(1)) - most).alias("more")).where("more > 0")
    rest = more.select(key, F.lit(most + 1).alias("at"), F.concat(F.lit("… +"), F.col("more").cast("string"), F.lit(" more")).alias("line"))
    return first.unionByName(rest)


def summary_line(mode: str, totals: dict[str, Column]) -> Column:
    """A check's counts in one line, as each mode puts them."""
    # The lines.
    shapes = {
        "extract": ("check (extract): refs ok {} / bad {} — ok {}, ok~ {}, partial {}, not-in-input {}", ("refs_ok", "refs_bad", "ok", "ok~", "partial", "not_in_input")),
        "draft": ("check (draft): refs ok {} / bad {} — lines {}: ok {}, flagged {}, bad {}, not-in-input {}", ("refs_ok", "refs_bad", "lines", "ok", "flag", "bad", "not_in_input")),
        "edits": ("check (edits): refs ok {} / bad {} — valid {}, rejected {} (never applied)", ("refs_ok", "refs_bad", "valid", "rejected")),
    }
    shape, names = shapes[mode]
    return F.format_string(shape.replace("{}", "%d"), *[F.coalesce(totals[n], F.lit(0)).cast("long") for n in names])


def span_text(name: Column, n: Column, end_name: Column, end_n: Column) -> Column:
    tail = F.when(name == end_name, F.lit("")).otherwise(F.concat(end_name, F.lit(":")))
    return F.concat(name, F.lit(":L"), n.cast("string"), F.lit("–"), tail, F.lit("L"), end_n.cast("string"))


def price_text(price: Column) -> Column:
    """$0.25; two figures below a cent; - if unknown and ? if endless."""
    figures = lambda x: (F.lit(1) - F.floor(F.log10(x) + 1e-9)).cast("int")
    rounded = F.call_function("format_number", price, figures(price)).cast("double")  # 0.00996 gets a figure less by rounding
    small = F.call_function("format_number", price, figures(rounded))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", price), r"0+$", ""), r"\.$", "")
    shown = F.when((price > 0) & (price < 0.01), small).otherwise(plain)
    return F.when(price.isNull(), "-").when(F.isnan(price) | (F.abs(price) == float("inf")), "?").otherwise(F.concat(F.lit("$"), shown))


def percent_text(share: Column) -> Column:
    return F.when(share.isNull(), "-").otherwise(F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%")))


def money_text(usd: Column) -> Column:
    return F.format_string("$%.4f", F.coalesce(usd.cast("double"), F.lit(0.0)))


def has_control_chars(text: Column) -> Column:
    return text.rlike(CONTROL)


def has_dot_dot(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), "..")


def safe_error(text: Column) -> Column:
    """An error's text fit to be shown: clipped, then masked."""
    return F.element_at(mask_lines(F.array(F.substring(text, 1, 500))), 1)["text"]
