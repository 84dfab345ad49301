"""Names, gaps, places, numbering and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERLAP = 5


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 3).cast("long")


def assign_names(files: DataFrame) -> DataFrame:
    """`name` of files (file_id, rel, root, root_index): rel; if that clashes root/rel; else #index/rel.

    Clashes are counted by key and joined, so a name that very many files have is
    combined before it is shuffled.
    """

    def clashing(df: DataFrame, name: str) -> DataFrame:
        return df.join(df.groupBy(name).agg((F.count(F.lit(1)) > 1).alias("clash")), name)

    first = clashing(files, "rel").withColumn("step", F.when(F.col("clash"), F.concat_ws("/", "root", "rel")).otherwise(F.col("rel"))).drop("clash")
    indexed = F.concat(F.lit("#"), F.col("root_index").cast("string"), F.lit("/"), F.col("rel"))
    return clashing(first, "step").withColumn("name", F.when(F.col("clash"), indexed).otherwise(F.col("step"))).drop("clash", "step")


def gap_text(first: Column, last: Column) -> Column:
    one = F.concat(F.lit("… (line "), first.cast("string"), F.lit(" skipped)"))
    more = F.concat(F.lit("… (lines "), first.cast("string"), F.lit("–"), last.cast("string"), F.lit(" skipped)"))
    return F.when(first == last, one).otherwise(more)


def items(kept: Column, total: Column) -> Column:
    """Of an array of (n, text) of kept lines: numbered lines with gaps before, between and behind.

    Each item is (pos, kind, n, text); nothing kept gives nothing.
    """

    def line(x: Column, i: Column) -> Column:
        before = F.when(i > 0, kept[i - 1]["n"]).otherwise(F.lit(0))
        n = x["n"]
        gap = F.struct((n * 2 - 1).alias("pos"), F.lit("gap").alias("kind"), F.lit(None).cast("int").alias("n"), gap_text(before + 1, n - 1).alias("text"))
        own = F.struct((n * 2).alias("pos"), F.lit("line").alias("kind"), n.alias("n"), F.concat(F.lit("L"), n.cast("string"), F.lit("| "), x["text"]).alias("text"))
        return F.when(n > before + 1, F.array(gap, own)).otherwise(F.array(own))

    body = F.flatten(F.transform(kept, line))
    last = F.element_at(kept, -1)["n"]
    tail = F.struct((total * 2 + 1).alias("pos"), F.lit("gap").alias("kind"), F.lit(None).cast("int").alias("n"), gap_text(last + 1, total).alias("text"))
    return F.when(F.size(kept) == 0, body).when(last < total, F.concat(body, F.array(tail))).otherwise(body)


def ranges(ns: Column) -> Column:
    """Runs of consecutive numbers of an ascending array, as (a, b)."""
    none, size = F.array(F.lit(None).cast("int")), F.size(ns)
    before, behind = F.concat(none, F.slice(ns, 1, F.greatest(size - 1, F.lit(0)))), F.concat(F.slice(ns, 2, F.greatest(size, F.lit(0))), none)
    heads = F.array_compact(F.zip_with(ns, before, lambda x, p: F.when(p.isNull() | (x != p + 1), x)))
    tails = F.array_compact(F.zip_with(ns, behind, lambda x, q: F.when(q.isNull() | (q != x + 1), x)))
    return F.arrays_zip(heads.alias("a"), tails.alias("b"))


def label_text(label: Column) -> Column:
    """A section's label as its marker shows it: line breaks and tabs as blanks, no other control characters."""
    shown = F.regexp_replace(F.regexp_replace(label, r"[\r\n\t]+", " "), r"[\x00-\x1f\x7f-\x9f]", "")
    return F.substring(F.trim(F.regexp_replace(shown, " {2,}", " ")), 1, 120)


def place_of(section: Column) -> Column:
    """What a section is called: p.3, slide 2, attachment: name, footnotes."""
    label = label_text(section["label"])
    return (
        F.when(section["kind"] == "page", F.concat(F.lit("p."), section["num"].cast("string")))
        .when(section["kind"] == "attachment", F.concat(F.lit("attachment: "), F.coalesce(label, F.lit(""))))
        .when(section["kind"].isin("footnotes", "endnotes", "attachments") | section["num"].isNull(), section["kind"])
        .otherwise(F.concat_ws(" ", section["kind"], section["num"].cast("string")))
    )


def attachment_refs(refs: DataFrame, sections: DataFrame, *by: str) -> DataFrame:
    """Refs (by, name, a, b) to lines a to b of an attachment, with `file`, the one file that has it
    with both lines inside, or `problem`; sections are (by, file, kind, label, start, end)."""
    parts = sections.where("kind = 'attachment'").select(*by, "file", "start", "end", label_text(F.col("label")).alias("_label"))
    met = refs.withColumn("_label", F.trim("name")).join(parts, [*by, "_label"], "left").groupBy(*by, "name", "a", "b")
    inside = lambda n: (F.col("start") <= n) & (n <= F.col("end"))
    found = met.agg(
        F.min("file").alias("file"), F.max("file").alias("_other"), F.bool_or(inside(F.col("a")) & inside(F.col("b")) & (F.col("start") <= F.col("b"))).alias("_both"),
        F.bool_or(inside(F.col("a"))).alias("_first"),
    )
    outside = F.concat(F.lit("L"), F.when(F.col("_first"), F.col("b")).otherwise(F.col("a")), F.lit(" is not inside attachment "), F.trim("name"))
    problem = F.when(F.col("file").isNull(), "unknown").when(F.col("file") != F.col("_other"), "ambiguous").when(~F.col("_both"), outside)
    return found.select(*by, "name", "a", "b", F.when(problem.isNull(), F.col("file")).alias("file"), problem.alias("problem"))


def page_of(page_starts: Column, n: Column) -> Column:
    return F.size(F.filter(page_starts, lambda s: s <= n))


def chunks_native(lines: Column, budget: int) -> Column:
    """Greedy chunks of an array of (n, tokens) without overlap: (chunk, first, last, tokens).

    A line longer than the budget is a chunk of its own here; `chunk_documents` refuses it.
    """
    kind = "struct<done:array<struct<chunk:int,first:int,last:int,tokens:bigint>>,first:int,last:int,tokens:bigint>"
    start = F.from_json(F.lit('{"done":[]}'), F.lit(kind))

    def closed(a: Column) -> Column:
        one = F.struct((F.size(a["done"]) + 1).alias("chunk"), a["first"].alias("first"), a["last"].alias("last"), a["tokens"].alias("tokens"))
        return F.when(a["first"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(one)))

    def add(a: Column, x: Column) -> Column:
        fits = a["first"].isNotNull() & (a["tokens"] + x["tokens"] <= budget)
        more = F.struct(a["done"].alias("done"), a["first"].alias("first"), x["n"].alias("last"), (a["tokens"] + x["tokens"]).alias("tokens"))
        new = F.struct(closed(a).alias("done"), x["n"].alias("first"), x["n"].alias("last"), x["tokens"].alias("tokens"))
        return F.when(fits, more).otherwise(new).cast(kind)

    return F.aggregate(lines, start, add, closed)


def _tokens(text: str) -> int:
    return -(-len(text.encode()) // 3)


def cut(items: list[tuple[int, str]], header: str, budget: int, overlap: int = OVERLAP) -> list[tuple[str, int, int, int]]:
    """Chunks (text, tokens, first, last) of one document's lines; a break repeats the header and
    the last lines of the chunk before, as many of them as leave room for the next line."""
    head, out = _tokens(header + "\n"), []
    cost = [_tokens(t + "\n") for _, t in items]
    i = begin = 0
    while i < len(items):
        if head + cost[i] > budget:
            raise ValueError(f"line {items[i][0]} alone is over the budget")
        total, j = head + sum(cost[begin:i]), i
        while j < len(items) and total + cost[j] <= budget:
            total, j = total + cost[j], j + 1
        out.append(("\n".join([header, *[t for _, t in items[begin:j]]]), total, items[begin][0], items[j - 1][0]))
        i, begin = j, max(begin, j - overlap)
        while i < len(items) and begin < j and head + sum(cost[begin:j]) + cost[j] > budget:
            begin += 1
    return out


def chunk_documents(docs: DataFrame, budget: int, overlap: int = OVERLAP) -> DataFrame:
    """(file_id, chunk, text, tokens, first, last) of documents (file_id, name, items).

    A document is a job of its own here: its lines are in one row, so cutting them
    shuffles nothing.  A line over the budget refuses the document (chunk 0, no text).
    """
    out = "array<struct<chunk:int,text:string,tokens:bigint,first:int,last:int>>"

    @F.pandas_udf(out)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            made = []
            for name, rows in zip(batch["name"], batch["items"], strict=True):
                try:
                    done = cut([(int(r["n"]), r["text"]) for r in rows], f"=== file: {name} ===", budget, overlap)
                except ValueError:
                    done = [(None, None, None, None)]
                made.append([dict(chunk=k if d[0] is not None else 0, text=d[0], tokens=d[1], first=d[2], last=d[3]) for k, d in enumerate(done, 1)])
            yield pd.Series(made)

    return docs.withColumn("c", F.explode(run(F.struct("name", "items")))).select("file_id", "c.*")


def split_at_median(first: Column, last: Column) -> Column:
    """The two halves of a chunk that was cut short, overlapping by up to OVERLAP lines; null under two lines."""
    middle = F.floor((first + last) / 2).cast("int")
    again = F.greatest(first, middle + 1 - OVERLAP)
    return F.when(last > first, F.array(F.struct(first.alias("first"), middle.alias("last")), F.struct(again.alias("first"), last.alias("last"))))


def section_chain_rows(lines: DataFrame, markers: DataFrame, key: str = "file_id") -> DataFrame:
    """Lines with the last marker (key, at, text) at or above them: an as-of join as a window over both."""
    both = lines.select(key, F.col("n").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("marker"))
    both = both.unionByName(markers.select(key, (F.col("at") + 1).alias("at"), F.lit(0).alias("side"), F.col("text").alias("marker")))
    w = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("marker", F.last("marker", ignorenulls=True).over(w)).where("side = 1").select(key, F.col("at").alias("n"), "marker")
