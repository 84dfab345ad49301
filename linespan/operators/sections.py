"""Sections of documents and the marker lines that open them.

A document row has `sections` (start, end, in the order of their starts, an outer one first; they nest)
and `markers` (at, text), each placed ahead of line at + 1.  Where marker i opens section i, a line has a chain:
the markers of all sections around it, outermost first.  The chain changes only where sections open and
close, so one sweep over those places with a stack gives the spans of equal chains, and lines take the
last span at or above them: no line meets a section that isn't around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import last_at
from .render import gap_text, place_of

_LINK = "struct<ref:int,text:string>"
_SPAN = f"struct<start:int,chain:array<{_LINK}>>"


def paired(sections: Column, markers: Column) -> Column:
    """Whether every section has its marker, right ahead of it."""
    same = F.zip_with(sections, markers, lambda s, m: m["at"] == s["start"] - 1)
    return (F.size(sections) > 0) & (F.size(sections) == F.size(markers)) & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


def chain_spans(sections: Column, markers: Column) -> Column:
    """(start, chain) of every stretch of lines inside the same sections, from line 1."""
    both = F.arrays_zip(sections.alias("s"), markers.alias("m"))
    event = lambda at, kind, i, text: F.struct(at.cast("int").alias("at"), F.lit(kind).alias("opens"), i.alias("ref"), text.alias("text"))
    opens = F.transform(both, lambda x, i: event(x["s"]["start"], 1, i, x["m"]["text"]))
    closes = F.transform(both, lambda x, i: event(x["s"]["end"] + 1, 0, i, F.lit(None).cast("string")))
    state = f"struct<stack:array<{_LINK}>,spans:array<{_SPAN}>>"
    empty = F.array().cast(f"array<{_LINK}>")
    zero = F.struct(empty.alias("stack"), F.array(F.struct(F.lit(1).alias("start"), empty.alias("chain"))).alias("spans")).cast(state)

    def step(a: Column, e: Column) -> Column:
        link = F.struct(e["ref"].alias("ref"), e["text"].alias("text"))
        stack = F.when(e["opens"] == 1, F.concat(a["stack"], F.array(link))).otherwise(F.filter(a["stack"], lambda x: x["ref"] != e["ref"]))
        again = F.element_at(a["spans"], -1)["start"] == e["at"]
        behind = F.when(again, F.slice(a["spans"], F.lit(1), F.size(a["spans"]) - 1)).otherwise(a["spans"])
        return F.struct(stack.alias("stack"), F.concat(behind, F.array(F.struct(e["at"].alias("start"), stack.alias("chain")))).alias("spans")).cast(state)

    return F.aggregate(F.array_sort(F.concat(opens, closes)), zero, step, lambda a: a["spans"])


def with_sections(lines: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Shown lines (keys, n, prev, last, total, ...) with what is shown around them:

    pre: the gap and the markers (kind, ref, text) ahead of the line; chain: its sections (ref, text), null where they
    don't pair with the markers; mark: the last marker at or above it; post: the gap at the file's end.
    prev is the number of the shown line before, 0 for the first; documents have sections and markers."""
    spans = documents.where(paired(F.col("sections"), F.col("markers"))).select(*keys, F.inline(chain_spans(F.col("sections"), F.col("markers"))))
    marks = documents.select(*keys, F.posexplode("markers").alias("ref", "m")).select(*keys, (F.col("m.at") + 1).cast("int").alias("n"), "ref", F.col("m.text").alias("text"))
    here = F.sort_array(F.collect_list(F.struct("ref", "text")))
    marks = marks.groupBy(*keys, "n").agg(here.alias("here")).select(*keys, "n", F.struct("n", "here").alias("_mark"))
    rows = lines.withColumn("_side", F.lit(1))
    rows = rows.unionByName(spans.select(*keys, F.col("start").alias("n"), F.col("chain").alias("_chain"), F.lit(0).alias("_side")), allowMissingColumns=True)
    rows = rows.unionByName(marks.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    met = last_at(rows, keys, [F.col("n"), F.col("_side")], {"chain": F.col("_chain"), "near": F.col("_mark")}).where("_side = 1")
    none = F.array().cast(f"array<{_LINK}>")
    near = F.when(F.col("near.n") > F.col("prev"), F.col("near.here"))
    skipped = F.when(F.size("chain") > 0, F.col("chain")).otherwise(F.coalesce(F.slice(near, -1, 1), none))
    shown = F.when(F.col("n") == F.col("prev") + 1, F.coalesce(near, none)).otherwise(skipped)
    shown = F.transform(shown, lambda m: F.struct(F.lit("marker").alias("kind"), m["ref"].alias("ref"), m["text"].alias("text")))
    gap = F.struct(F.lit("gap").alias("kind"), F.lit(-1).alias("ref"), gap_text(F.col("prev") + 1, F.col("n") - 1).alias("text"))
    pre = F.when(F.col("n") > F.col("prev") + 1, F.concat(F.array(gap), shown)).otherwise(shown)
    post = F.when(F.col("last") & (F.col("n") < F.col("total")), gap_text(F.col("n") + 1, F.col("total")))
    mark = F.element_at(F.col("near.here"), -1)["text"]
    return met.select(*lines.columns, pre.alias("pre"), "chain", mark.alias("mark"), post.alias("post"))


def shown_lines(kept: Column) -> Column:
    """(n, prev, last, text) of an array of kept (n, text); neighbours are zipped, so each line is looked at once."""
    ns, size = F.transform(kept, lambda x: x["n"]), F.size(kept)
    prev = F.concat(F.array(F.lit(0)), F.slice(ns, F.lit(1), F.greatest(size - 1, F.lit(0))))
    more = F.concat(F.transform(F.slice(ns, F.lit(2), F.greatest(size, F.lit(0))), lambda _: F.lit(False)), F.array(F.lit(True)))
    rows = F.zip_with(kept, F.arrays_zip(prev.alias("prev"), more.alias("last")), lambda x, y: F.struct(x["n"].alias("n"), y["prev"].alias("prev"), y["last"].alias("last"), x["text"].alias("text")))
    return F.filter(rows, lambda r: r["n"].isNotNull())  # an array without lines is zipped with one neighbour


def places(lines: DataFrame, sections: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, n, place) of lines in sections (key, kind, num, label, start, end), outermost first; other lines have none.

    A file's sections become spans by the same sweep, and lines take the last span at or above them."""
    one = F.struct(F.col("start").cast("int").alias("start"), (-F.col("end")).cast("int").alias("width"), F.col("end").cast("int").alias("end"), place_of(F.struct("kind", "num", "label")).alias("text"))
    packed = sections.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("sections"))
    spans = packed.select(key, F.inline(chain_spans(F.col("sections"), F.transform("sections", lambda s: F.struct((s["start"] - 1).alias("at"), s["text"].alias("text"))))))
    rows = lines.select(key, "n").withColumn("_side", F.lit(1)).unionByName(spans.select(key, F.col("start").alias("n"), F.col("chain").alias("_chain"), F.lit(0).alias("_side")), allowMissingColumns=True)
    met = last_at(rows, [key], [F.col("n"), F.col("_side")], {"chain": F.col("_chain")}).where((F.col("_side") == 1) & (F.size("chain") > 0))
    return met.select(key, "n", F.array_join(F.transform("chain", lambda s: s["text"]), ", ").alias("place"))
