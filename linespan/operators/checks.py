"""Checks of answers against the lines that each chunk carried.

`carried` is a table (job, chunk, name, n, text): the lines of each chunk, a row
a line.  Answers are tables of lines or of edits.  Names are found, references
resolved and texts compared with joins on job, chunk and name; only what needs a
parser (references in prose, hard tokens) is a function in a vectorised UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Refs, fold_space, hard_tokens
from .quotes import beginnings, last_known, said_plainly, said_under
from .render import label_text

KEY = ("job", "chunk")
NOT_IN_INPUT = r"(?i)^\W*NOT IN INPUT\W*$"
MASK = r"\[[a-z_]+\]|<[A-Z][A-Z_]*>"
WIDE = 30
CUT = r"(?:…|\.\.\.)\s*$"


def clip(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def resolve_names(refs: DataFrame, carried: DataFrame) -> DataFrame:
    """refs (job, chunk, written, ...) with `name` and `problem`.

    A written name is the name it equals, or the only carried one that ends with / and
    it; without a name the chunk's only file is meant.  Names that end alike have the
    same last part, so this is a join on equality.
    """
    names = carried.select(*KEY, "name").distinct()
    one = names.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_files"), F.min("name").alias("_only"))
    tail = F.element_at(F.split("name", "/"), -1)
    wanted = refs.select(*KEY, "written").where("written is not null").distinct()
    near = wanted.withColumn("_tail", F.element_at(F.split("written", "/"), -1)).join(names.withColumn("_tail", tail), [*KEY, "_tail"])
    near = near.withColumn("_exact", F.col("name") == F.col("written"))
    near = near.where(F.col("_exact") | F.endswith("name", F.concat(F.lit("/"), F.col("written"))))
    near = near.groupBy(*KEY, "written").agg(F.count(F.lit(1)).alias("_near"), F.max(F.when(F.col("_exact"), F.col("name"))).alias("_same"), F.min("name").alias("_like"))
    df = refs.join(one, list(KEY), "left").join(near, [*KEY, "written"], "left")
    found = F.when(F.col("written").isNull(), F.when(F.col("_files") == 1, F.col("_only")))
    found = found.otherwise(F.coalesce("_same", F.when(F.col("_near") == 1, F.col("_like"))))
    problem = (
        F.when(F.col("written").isNull(), "file name missing (several files)")
        .when(F.col("_near") > 1, F.concat(F.lit("ambiguous file name in ref: "), F.col("written")))
        .otherwise("unknown file name")
    )
    return df.withColumn("name", found).withColumn("problem", F.when(F.col("name").isNull(), problem)).drop("_files", "_only", "_near", "_same", "_like")


def resolved(written: Column, names: Column) -> Column:
    """(name, problem) of a written name among the names of its chunk, as `resolve_names` has them."""
    like = F.filter(names, lambda x: F.endswith(x, F.concat(F.lit("/"), written)))
    only = lambda xs: F.when(F.size(xs) == 1, F.get(xs, F.lit(0)))
    name = F.when(written.isNull(), only(names)).when(F.array_contains(names, written), written).otherwise(only(like))
    problem = (
        F.when(name.isNotNull(), F.lit(None).cast("string"))
        .when(written.isNull(), "file name missing (several files)")
        .when(F.size(like) > 1, F.concat(F.lit("ambiguous file name in ref: "), written))
        .otherwise("unknown file name")
    )
    return F.struct(name.alias("name"), problem.alias("problem"))


def with_sources(asked: DataFrame, carried: DataFrame, place: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """asked (job, chunk, ...) with the columns that `place` has for the names of a row's chunk, name and n among them, and
    `source`, the carried line that these mean.

    Both tables are dealt by chunk once and lie in one order there, so a chunk's names and a line's text reach what asks
    for them without a further shuffle, and columns that nothing asks for travel nowhere."""
    lines = carried.select(*KEY, F.lit(0).alias("_side"), F.col("name").alias("_name"), F.col("n").alias("_n"), F.col("text").alias("_source"))
    rows = lines.unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumn("_names", F.collect_set("_name").over(Window.partitionBy(*KEY)))
    own, new = F.col("_side") == 0, place(F.col("_names"))
    rows = rows.withColumns({f"_of_{c}": x for c, x in new.items()}).drop("_names")
    rows = rows.withColumns({"_name": F.when(own, F.col("_name")).otherwise(F.col("_of_name")), "_n": F.when(own, F.col("_n")).otherwise(F.col("_of_n"))})
    line = Window.partitionBy(*KEY, "_name", "_n").orderBy("_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_source", F.first("_source", ignorenulls=True).over(line)).where("_side = 1")
    rest = [c for c in asked.columns if c not in new]
    return rows.select(*rest, *[F.col(f"_of_{c}").alias(c) for c in new], F.col("_source").alias("source"))


def _lean(q: Column) -> Column:
    """A quote without its text, which may be as long as its line: digests of it and of its folded form, and its beginning if it was cut."""
    digest = lambda text: F.unhex(F.md5(text.cast("binary")))
    cut = F.when(q["said"].rlike(CUT), F.nullif(fold_space(F.regexp_replace(q["said"], CUT, "")), F.lit("")))
    return F.struct(q["written"].alias("written"), q["n"].alias("n"), digest(q["said"]).alias("same"), digest(fold_space(q["said"])).alias("folded"), cut.alias("cut"))


def check_extract(answers: DataFrame, carried: DataFrame) -> DataFrame:
    """Answer lines (job, chunk, pos, raw) with name, n, status and reason.

    A text is compared with its line by digests; only the beginnings of quotes that were cut are sent to their lines."""
    text = F.ltrim("raw")
    lines = answers.where(F.trim("raw") != "").withColumn("_nothing", F.col("raw").rlike(NOT_IN_INPUT)).withColumn("_plain", said_plainly(text))
    lines = lines.withColumn("_plain", _lean(F.col("_plain"))).withColumn("_begun", F.transform(beginnings(text), lambda x: _lean(said_under(text, x))))

    def place(names: Column) -> dict[str, Column]:
        q = F.coalesce(last_known(F.col("_begun"), names), F.col("_plain"))
        found = resolved(q["written"], names)
        return {"name": found["name"], "n": q["n"], "problem": found["problem"], "quote": q}

    df = with_sources(lines, carried, place)
    source, q = F.col("source"), F.col("quote")
    digest = lambda text: F.unhex(F.md5(text.cast("binary")))
    status = (
        F.when(F.col("_nothing"), "not_in_input")
        .when(F.col("n").isNull() | F.col("name").isNull() | source.isNull(), "bad")
        .when(q["same"] == digest(source), "ok")
        .when(q["folded"] == digest(fold_space(source)), "ok~")
        .when(F.startswith(fold_space(source), q["cut"]), "partial")
        .otherwise("bad")
    )
    reason = (
        F.when(F.col("status") != "bad", None)
        .when(F.col("n").isNull(), "not a quoted input line")
        .when(F.col("name").isNull(), F.col("problem"))
        .when(source.isNull(), "line not in this chunk's input")
        .otherwise("text differs from the source line")
    )
    return df.withColumn("status", status).withColumn("reason", reason).select(*answers.columns, "name", "n", "status", "reason")


def dedupe_extract(items: DataFrame) -> DataFrame:
    """Of items of one line that aren't bad, the first by chunk and position; bad ones all stay."""
    stays = (F.col("status") == "bad") | F.col("name").isNull() | F.col("n").isNull()
    alone = [F.when(stays, F.col(c)) for c in ("chunk", "pos")]  # else all of a job's that name no line would meet
    first = F.rank().over(Window.partitionBy("job", "name", "n", *alone).orderBy("chunk", "pos")) == 1
    return items.withColumn("_first", first).where(stays | F.col("_first")).drop("_first")


def extract_summary(items: DataFrame, *by: str) -> DataFrame:
    def n(*status: str) -> Column:
        return F.count_if(F.col("status").isin(*status))

    return items.groupBy(*by).agg(
        n("ok").alias("ok"), n("ok~").alias("ok_folded"), n("partial").alias("partial"), n("bad").alias("bad"), n("not_in_input").alias("not_in_input"),
        n("ok", "ok~", "partial").alias("refs_ok"), n("bad").alias("refs_bad"),
        F.try_divide(n("ok", "ok~"), n("ok", "ok~", "partial", "bad")).alias("pass_rate"),
    )


# --- edits ---


def check_edits(edits: DataFrame, carried: DataFrame) -> DataFrame:
    """Edits (job, chunk, pos, file, line, old, new) with n, name, status, reason and says (whether there is an old text); the first fault decides."""
    n = F.regexp_extract(F.trim(F.col("line").cast("string")), r"^L?(\d+)$", 1).try_cast("int")
    old, new = F.col("old"), F.col("new")
    asked = edits.withColumns(
        {"_n_said": n, "_written": F.when(F.col("file") != "", F.col("file")), "says": old.isNotNull(), "_unsaid": old.isNull() | new.isNull() | (old == ""), "_masked": old.rlike(MASK) | new.rlike(MASK)}
    )

    def place(names: Column) -> dict[str, Column]:
        found = resolved(F.col("_written"), names)
        return {"name": found["name"], "n": F.col("_n_said"), "problem": found["problem"]}

    df = with_sources(asked, carried, place)
    often = F.size(F.regexp_extract_all("source", F.concat(F.lit("(?=("), _quoted(F.col("old")), F.lit("))")), F.lit(1)))
    df = df.withColumn("often", F.when(F.col("source").isNotNull() & (F.col("old") != ""), often))
    reason = (
        F.when(F.col("_unsaid"), '"old" and "new" must be strings, "old" non-empty')
        .when(F.col("n").isNull(), 'bad "line"')
        .when(F.col("name").isNull(), F.col("problem"))
        .when(F.col("source").isNull(), "line not in this chunk's input")
        .when(F.col("_masked"), "touches a mask: the masked text is not what is on disk")
        .when(F.col("often") == 0, '"old" is not in the source line')
        .when(F.col("often") > 1, F.concat(F.lit('"old" occurs '), F.col("often"), F.lit(" times in the source line")))
    )
    df = df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("bad"))
    return df.select(*[c for c in edits.columns if c not in ("name", "n", "status", "reason", "says")], "name", "n", "status", "reason", "says")


def _quoted(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def dedupe_edits(items: DataFrame) -> DataFrame:
    """Of a line's valid edits those of its first chunk; rejected ones go if an earlier chunk has a valid edit there."""
    nowhere = F.col("name").isNull() | F.col("n").isNull()
    alone = [F.when(nowhere, F.col(c)) for c in ("chunk", "pos")]  # else all of a job's that name no line would meet
    first = F.min(F.when(F.col("status") == "ok", F.col("chunk"))).over(Window.partitionBy("job", "name", "n", *alone))
    df = items.withColumn("_first", first)
    keep = F.when(F.col("status") == "ok", F.col("chunk") == F.col("_first")).otherwise(F.coalesce(F.col("chunk") <= F.col("_first"), F.lit(True)))
    return df.where(keep).drop("_first")


def edits_summary(items: DataFrame, *by: str) -> DataFrame:
    ok = F.count_if(F.col("status") == "ok")
    return items.groupBy(*by).agg(ok.alias("valid"), F.count_if(F.col("status") == "bad").alias("rejected"), F.try_divide(ok, F.count(F.lit(1))).alias("pass_rate"))


# --- drafts ---

DRAFT = "status string, issues array<string>, refs_ok int, refs_bad int"
_EXEMPT = re.compile(r"^(?:#{1,6}\s.*|```.*|[\s|:-]+|(?:\*\s*){3,}|)$")
_NOT_IN_INPUT = re.compile(NOT_IN_INPUT)


@lru_cache(maxsize=256)
def _refs(names: tuple[str, ...]) -> Refs:
    return Refs(list(names))


Parts = dict[str, dict[str, list[tuple[int, int]]]]


def judge_line(line: str, carried: dict[tuple[str, int], str], attachments: Parts | None = None) -> tuple[str | None, list[str], int, int]:
    """Status, issues and numbers of good and bad references of one line of prose.

    attachments: name of an attachment -> file -> its spans of lines; a name that no file has may be meant for one."""
    text = line.strip()
    if _NOT_IN_INPUT.match(text):
        return "not_in_input", [], 0, 0
    if _EXEMPT.match(text):
        return None, [], 0, 0
    names = sorted({k[0] for k in carried})

    def found(name: str | None, *lines: int) -> tuple[str | None, str]:
        if name is None:
            return (names[0], "") if len(names) == 1 else (None, "unknown")
        if name in names:
            return name, ""
        like = [x for x in names if x.endswith("/" + name)]
        if like:
            return (like[0], "") if len(like) == 1 else (None, "ambiguous")
        inside = {f: spans for f, spans in (attachments or {}).get(name.strip(), {}).items() if f in names}
        if len(inside) != 1:
            return None, "ambiguous" if inside else "unknown"
        ((file, spans),) = inside.items()
        if any(a <= lines[0] and lines[-1] <= b for a, b in spans):
            return file, ""
        n = lines[-1] if any(a <= lines[0] <= b for a, b in spans) else lines[0]
        return None, f"L{n} is not inside attachment {name.strip()}"

    refs, rest = _refs(tuple(names)).parse(line)
    issues, soft, good, bad, cited = [], [], 0, 0, []
    if not refs:
        issues.append("no ref")
    for r in refs:
        name, why = found(r["name"], r["from"], r["to"])
        end = found(r["end_name"], r["to"])[0] if r["end_name"] else name
        if name is None or end != name:
            fault = f"ambiguous file name in ref: {r['name']}" if why == "ambiguous" else why if "inside" in why else f"ref to an unknown file: {r['raw']}"
        elif r["to"] < r["from"]:
            fault = f"bad ref range: {r['raw']}"
        elif (name, r["from"]) not in carried or (name, r["to"]) not in carried:  # the ends only
            fault = f"ref outside this chunk's input: {r['raw']}"
        else:
            good += 1
            if r["to"] - r["from"] + 1 > WIDE:
                soft.append(f"wide ref: {r['raw']}")
            cited += [carried[name, n] for n in range(r["from"], r["to"] + 1) if (name, n) in carried]
            continue
        bad += 1
        issues.append(fault)
    if cited:
        hay = "\n".join(cited)
        tokens, numbers = hard_tokens(rest)
        issues += [f"token not in cited lines: {t}" for _, t in tokens if t.lower() not in hay.lower()]
        soft += [f"number not in cited lines: {n}" for n in numbers if not re.search(rf"(?<!\d){n}(?!\d)", hay)]
    return "bad" if issues else "flag" if soft else "ok", issues + soft, good, bad


def check_draft(answers: DataFrame, carried: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Lines of prose (job, chunk, pos, raw) with status, issues, refs_ok and refs_bad; exempt lines go.
    sections (job, name, kind, label, start, end): attachments may be named in place of their files.

    A chunk's lines are within its budget and its answer within the model's, so both come as one
    array each, in one row a chunk: the lines are looked up by name and number once for all of
    the answer, and travel once.
    """
    rest = [c for c in answers.columns if c not in KEY]
    have = carried.groupBy(*KEY).agg(F.collect_list(F.struct("name", "n", "text")).alias("lines"))
    said = answers.groupBy(*KEY).agg(F.collect_list(F.struct(*rest)).alias("said"))

    @F.pandas_udf(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in DRAFT.split(', '))}>>")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = ("status", "issues", "refs_ok", "refs_bad")
        for said, lines, parts in batches:
            out = []
            for raws, chunk, own in zip(said, lines, parts, strict=True):
                known = {(x["name"], x["n"]): x["text"] for x in chunk} if chunk is not None else {}
                attachments: Parts = {}
                for x in own if own is not None else ():
                    attachments.setdefault(x["label"], {}).setdefault(x["name"], []).append((x["start"], x["end"]))
                out.append([dict(zip(names, judge_line(r, known, attachments), strict=True)) for r in raws])
            yield pd.Series(out)

    df = said.join(have, list(KEY), "left")
    if sections is None:
        df = df.withColumn("parts", F.lit(None).cast("array<struct<label:string,name:string,start:int,end:int>>"))
    else:
        files = carried.select(*KEY, "name").distinct()
        own = sections.where("kind = 'attachment'").select("job", "name", label_text(F.col("label")).alias("label"), "start", "end")
        own = files.join(own, ["job", "name"])  # a chunk's files and their attachments
        df = df.join(own.groupBy(*KEY).agg(F.collect_list(F.struct("label", "name", "start", "end")).alias("parts")), list(KEY), "left")
    df = df.withColumn("d", judge(F.transform("said", lambda x: x["raw"]), "lines", "parts"))
    df = df.select(*KEY, F.explode(F.arrays_zip("said", "d")).alias("x"))
    return df.select(*KEY, *[F.col(f"x.said.{c}").alias(c) for c in rest], "x.d.*").where("status is not null").select(*answers.columns, "status", "issues", "refs_ok", "refs_bad")


def draft_summary(items: DataFrame, *by: str) -> DataFrame:
    lines = F.count_if(F.col("status").isin("ok", "flag", "bad"))
    return items.groupBy(*by).agg(
        lines.alias("lines"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "flag").alias("flag"),
        F.count_if(F.col("status") == "bad").alias("bad"), F.sum("refs_ok").alias("refs_ok"), F.sum("refs_bad").alias("refs_bad"),
        F.try_divide(F.sum(F.size("issues")), lines).alias("flags_per_line"), F.try_divide(F.count_if(F.col("status") == "ok"), lines).alias("pass_rate"),
    )


def result_lines(items: DataFrame) -> DataFrame:
    """Items with `result_line`, their number within the job's result."""
    return items.withColumn("result_line", F.row_number().over(Window.partitionBy("job").orderBy("chunk", "pos")))


def probe_verdict(items: DataFrame, expected: DataFrame) -> DataFrame:
    """Per job: whether its lines are exactly the expected (job, name, n) and all are ok."""
    got = items.where("status != 'not_in_input'").select("job", "name", "n", (F.col("status") == "ok").alias("ok"), F.lit(None).cast("boolean").alias("wanted"))
    want = expected.select("job", "name", "n", F.lit(None).cast("boolean").alias("ok"), F.lit(True).alias("wanted"))
    both = got.unionByName(want).groupBy("job", "name", "n").agg(F.min("ok").alias("ok"), F.max("wanted").alias("wanted"))
    return both.groupBy("job").agg(F.min(F.coalesce(F.col("ok") & F.col("wanted"), F.lit(False))).alias("passed"))
