"""Where a quote stands that isn't where it was said to be, and whom a quoted line names.

`carried` is (job, chunk, name, n, text), with `at`, the place of the line in its chunk; without it lines are in the order of names and numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_space

KEY = ("job", "chunk")
TAIL = r"^L(\d+)(?: \([^\n]*?\))?\|\s?(.*)$"
PLAIN = r"^(?:(.+?):)??L(\d+)(?: \([^\n]*?\))?\|\s?(.*)$"


def _inner_words(folded: Column) -> Column:
    """The whole words of a folded text: all but the first and the last, which may be cut."""
    words = F.split(folded, " ")
    return F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<string>"))


def find_quotes(quotes: DataFrame, carried: DataFrame) -> DataFrame:
    """quotes (job, chunk, quote) with `found`, the first carried line (`name:L12`) whose folded text holds the folded quote.

    An index of a chunk's lines by word is probed with the longest whole word of a quote, by a join on equality, and
    what it gives is verified; the least place in the chunk wins.  Quotes of one or two words have no whole word, and
    are probed by the letters that three in a row of them are, so they meet only lines that have these."""
    asked = quotes.select(*KEY, "quote").distinct().withColumn("_q", fold_space(F.col("quote"))).where("_q != ''")
    word = F.array_max(F.transform(_inner_words(F.col("_q")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    # A quote's rarest letters can't be known here: its middle ones, as good as any.
    letters = F.when(F.length("_q") >= 3, F.substr(F.col("_q"), F.floor((F.length("_q") - 1) / 2).cast("int"), F.lit(3)))
    asked = asked.withColumn("_key", F.coalesce(F.concat(F.lit("w"), word), F.concat(F.lit("g"), letters), F.lit("")))
    wants = asked.groupBy(*KEY).agg(F.collect_set("_key").alias("_asked"))  # as many as a chunk's answer has quotes
    at = F.col("at") if "at" in carried.columns else F.struct("name", "n")
    lines = carried.select(*KEY, "name", "n", at.alias("at"), fold_space(F.col("text")).alias("_t")).join(wants, list(KEY))
    words = F.transform(F.split("_t", " "), lambda w: F.concat(F.lit("w"), w))
    # Letters are looked for in the line; to list all that it has would take the square of its length.
    letters = F.filter("_asked", lambda k: k.startswith("g") & F.contains(F.col("_t"), F.substr(k, F.lit(2))))
    keys = F.concat(F.array_intersect(F.concat(words, F.array(F.lit(""))), "_asked"), letters)  # of a line, only what is asked for leaves its row
    index = lines.select(*KEY, "name", "n", "at", "_t", F.explode(keys).alias("_key"))
    met = asked.join(index, [*KEY, "_key"]).where(F.contains("_t", F.col("_q")))
    first = met.groupBy(*KEY, "quote").agg(F.min_by(F.concat("name", F.lit(":L"), F.col("n").cast("string")), "at").alias("found"))
    return quotes.join(first, [*KEY, "quote"], "left")


def said_under(text: Column, name: Column) -> Column:
    """(written, n, said) of a line that begins with a name and `:L`."""
    behind = F.substr(text, F.length(name) + 2)
    return _quote(name, F.regexp_extract(behind, TAIL, 1), F.regexp_extract(behind, TAIL, 2))


def said_plainly(text: Column) -> Column:
    """(written, n, said) of a line in which no carried name is looked for: what stands ahead of its first place is the name."""
    return _quote(F.nullif(F.regexp_extract(text, PLAIN, 1), F.lit("")), F.regexp_extract(text, PLAIN, 2), F.regexp_extract(text, PLAIN, 3))


def _quote(written: Column, n: Column, said: Column) -> Column:
    return F.struct(written.alias("written"), n.try_cast("int").alias("n"), said.alias("said"))


def beginnings(text: Column) -> Column:
    """What may be the name that a line begins with, in order of length: every beginning that a further `:L` and a place end.
    A line with one `:L` has none."""
    parts = F.split(text, ":L", -1)
    begins = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ":L"))
    return F.when(F.size(parts) > 2, F.filter(begins, lambda x: F.substr(text, F.length(x) + 2).rlike(TAIL)))


def last_known(quotes: Column, names: Column) -> Column:
    """The last of the quotes whose name is one of the names, or null."""
    known = F.filter(quotes, lambda q: F.array_contains(names, q["written"]))
    return F.get(known, F.size(known) - 1)


def named_quotes(lines: DataFrame, carried: DataFrame, raw: str = "raw") -> DataFrame:
    """Answer lines (job, chunk, pos, raw) with `written`, `n` and `said` of `name:L12| text`.

    A line that begins with a carried name and `:L` is of the longest such name."""
    names = carried.groupBy(*KEY).agg(F.collect_set("name").alias("_names"))
    text = F.ltrim(raw)
    df = lines.join(names, list(KEY), "left")
    known = last_known(F.transform(beginnings(text), lambda x: said_under(text, x)), F.col("_names"))
    return df.withColumn("_q", F.coalesce(known, said_plainly(text))).select(*lines.columns, "_q.written", "_q.n", "_q.said")


def texts_holding(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of every document (doc_id, text) that holds an item's quote (item_id, quote) whole.

    The longest word inside a quote is an anchor that both must have, so candidates come from a join on equality.
    Quotes of one or two words have no word inside; their anchor is three letters of their middle (or all, of
    shorter ones), which only then are taken from the documents."""
    words = F.split("quote", r"\s+")
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<string>"))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = items.where("quote <> ''").select("item_id", "quote", longest.alias("anchor"))
    by_word = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("anchor"))
    hit = by_word.join(asked.where("anchor is not null"), "anchor").select("item_id", "doc_id", "quote")
    short = asked.where("anchor is null").withColumn("size", F.least(F.length("quote"), F.lit(3)))
    short = short.withColumn("anchor", F.substr(F.col("quote"), F.floor((F.length("quote") - F.col("size")) / 2).cast("int") + 1, F.col("size")))
    for size in sorted(r["size"] for r in short.select("size").distinct().collect()):  # of 1, 2 and 3
        starts = F.sequence(F.lit(1), F.length("text") - size + 1)
        letters = F.when(F.length("text") >= size, F.array_distinct(F.transform(starts, lambda i: F.substr(F.col("text"), i, F.lit(size)))))
        by_letters = docs.select("doc_id", F.explode(letters).alias("anchor"))
        hit = hit.unionByName(by_letters.join(short.where(F.col("size") == size), "anchor").select("item_id", "doc_id", "quote"))
    return hit.join(docs, "doc_id").where(F.contains("text", F.col("quote"))).select("item_id", "doc_id")
