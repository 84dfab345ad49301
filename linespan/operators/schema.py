"""Answers in the shape of a schema: leaves checked by quote, merged over chunks.

A job's answers are a long table of leaf values (job, path, chunk, seq, value,
ref, quote), value as JSON.  Merging is grouping by path and normalised value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import InputError
from ..functions.text import fold_space, missing_tokens, norm_key
from .checks import KEY, clip, resolve_names
from .quotes import find_quotes

# Fixed value: a type and what it is, as the leaves of a schema are written.
HINT = re.compile(r"^\s*(string|number|integer|boolean|date|datetime|time)\s*(?:(?:[—–]|\s-\s)\s*(.*))?$", re.I | re.S)
REF = r"^\(?\s*(?:(.+?):)?L(\d+)(?:\s*[-–]\s*L?(\d+))?\s*(?:\(.*\))?\s*\)?$"
#: What a number or a hard token has at least one of: other values can't miss any, and their texts don't go to Python.
TOKENS = r"[\p{Nd}`./\\:]"
MAX_LEAVES, MAX_DEPTH, MAX_KEY, MAX_TEXT = 60, 4, 200, 1000


def leaves(schema: dict) -> list[tuple[str, str, str]]:
    """(path, type, description) of the leaves of a schema; a list's one template counts once."""
    out: list[tuple[str, str, str]] = []

    def walk(node, path: str, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise InputError(f"{path}: deeper than {MAX_DEPTH}")
        if isinstance(node, str):
            m = HINT.match(node.strip())
            if not m or len(node) > MAX_TEXT:
                raise InputError(f'{path}: a leaf is "type — description"')
            out.append((path, m[1].lower(), m[2] or ""))
        elif isinstance(node, list) and len(node) == 1:
            walk(node[0], path + "[]", depth + 1)
        elif isinstance(node, dict) and node:
            for k, v in node.items():
                if not k or len(k) > MAX_KEY:
                    raise InputError(f"{path}: bad key")
                walk(v, f"{path}.{k}" if path else k, depth + 1)
        else:
            raise InputError(f"{path}: a schema is made of objects, one-template lists and leaves")

    if not isinstance(schema, dict):
        raise InputError("a schema is an object")
    walk(schema, "", 0)
    if len(out) > MAX_LEAVES:
        raise InputError(f"more than {MAX_LEAVES} leaves")
    return out


def parse_answers(answers: DataFrame) -> DataFrame:
    """answers (job, chunk, text) with `json` (null: failed) and `repaired`: one repair is tried."""
    body = F.trim(F.regexp_replace(F.regexp_replace("text", r"^\s*```[\w-]*\s*\n", ""), r"\n```\s*$", ""))
    inner = F.regexp_replace(F.regexp_extract(body, r"(?s)^[^{]*(\{.*\})[^}]*$", 1), r",(\s*[}\]])", "$1")

    def is_object(s: Column) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_parse_json(s)).startswith("OBJECT"), F.lit(False))

    df = answers.withColumn("_body", body).withColumn("_inner", inner)
    good = is_object(F.col("_body"))
    fixed = ~good & is_object(F.col("_inner"))
    return df.withColumn("json", F.when(good, F.col("_body")).when(fixed, F.col("_inner"))).withColumn("repaired", fixed).drop("_body", "_inner")


def leaf_values(answers: DataFrame, schema: dict) -> DataFrame:
    """(job, chunk, path, seq, value, ref, quote, reason) of answers (job, chunk, json): a row a leaf and item."""
    paths = [p for p, _, _ in leaves(schema)]
    out = "array<struct<path:string,seq:int,value:string,ref:string,quote:string,reason:string>>"

    def one(path: str, seq: int, a) -> list[tuple]:
        dump = lambda v: json.dumps(v, ensure_ascii=False)
        if isinstance(a, dict) and a.get("conflict") is True and isinstance(a.get("value"), list):
            refs, quotes = a.get("refs") or [], a.get("quotes") or []
            return [(path, seq, dump(v), *(x[i] if i < len(x) else None for x in (refs, quotes)), None) for i, v in enumerate(a["value"])]
        if isinstance(a, dict):
            if a.get("value") is None:
                return [(path, seq, None, None, None, str(a.get("reason") or "NOT IN INPUT")[:200])]
            ref = a.get("ref")
            return [(path, seq, dump(a["value"]), ", ".join(ref) if isinstance(ref, list) else ref, a.get("quote"), None)]
        if a is None:
            return [(path, seq, None, None, None, "NOT IN INPUT")]
        return [(path, seq, dump(a), None, None, None)]

    def find(node, parts: list[str], path: str, seq: int) -> list[tuple]:
        if not parts:
            return one(path, seq, node)
        head, is_list = parts[0].removesuffix("[]"), parts[0].endswith("[]")
        below = node.get(head) if isinstance(node, dict) and head else node
        if not is_list:
            missing = not (isinstance(node, dict) and head in node)
            return [(path, seq, None, None, None, "missing in answer")] if missing else find(below, parts[1:], path, seq)
        items = below if isinstance(below, list) else [] if below is None else [below]
        return [r for i, x in enumerate(items) for r in find(x, parts[1:], path.replace("[]", f"[{i}]", 1), i)]

    @F.pandas_udf(out)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys = ("path", "seq", "value", "ref", "quote", "reason")
        for batch in batches:
            yield pd.Series([[dict(zip(keys, r, strict=True)) for p in paths for r in find(json.loads(t), p.split("."), p, 0)] for t in batch])

    return answers.where("json is not null").select(*KEY, F.explode(run("json")).alias("v")).select(*KEY, "v.*")


def check_values(values: DataFrame, carried: DataFrame) -> DataFrame:
    """values (job, chunk, path, seq, value, ref, quote) with status and note.

    Precedence: bad_ref, no quote, quote_mismatch, value_not_in_quote; else ok or ok~.  Where carried has `at`, the
    lines' order in their chunk, a note says which carried line holds a quote that its own lines lack.
    """

    @F.pandas_udf("array<string>")
    def missing(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vs, qs in batches:
            yield pd.Series([missing_tokens(json.loads(v), q) if v is not None and q is not None else [] for v, q in zip(vs, qs, strict=True)])

    got = [F.regexp_extract("ref", REF, i) for i in (1, 2, 3)]
    df = values.withColumn("_id", F.struct("path", "seq", "value", "ref", "quote")).withColumn("written", F.when(got[0] != "", got[0]))
    df = df.withColumn("a", got[1].try_cast("int")).withColumn("b", F.coalesce(got[2].try_cast("int"), F.col("a")))
    df = resolve_names(df, carried)
    wanted = df.where("name is not null and a <= b").select(*KEY, "name", "a", "b").distinct()
    cited = wanted.withColumn("n", F.explode(F.sequence("a", "b"))).join(carried.select(*KEY, "name", "n", "text"), [*KEY, "name", "n"])
    lines = F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    cited = cited.groupBy(*KEY, "name", "a", "b").agg(lines.alias("cited"))
    df = df.join(cited, [*KEY, "name", "a", "b"], "left").withColumn("missing", missing(*[F.when(F.col("value").rlike(TOKENS), F.col(c)) for c in ("value", "quote")]))
    whole = (F.size("cited") == F.col("b") - F.col("a") + 1) & F.col("cited").isNotNull()
    spaced = F.array_join("cited", " ")
    exact = F.contains(F.array_join("cited", "\n"), F.col("quote")) | F.contains(spaced, F.col("quote"))
    near = F.contains(fold_space(spaced), fold_space(F.col("quote")))
    status = (
        F.when(F.col("value").isNull(), "null")
        .when(F.col("a").isNull() | F.col("name").isNull() | (F.col("a") > F.col("b")) | ~whole, "bad_ref")
        .when(F.col("quote").isNull() | (F.trim("quote") == "") | ~(exact | near), "quote_mismatch")
        .when(F.size("missing") > 0, "value_not_in_quote")
        .when(exact, "ok")
        .otherwise("ok~")
    )
    note = (
        F.when(F.col("status") == "value_not_in_quote", F.concat(F.lit("not in quote: "), F.array_join(F.slice("missing", 1, 5), ", ")))
        .when((F.col("status") == "quote_mismatch") & (F.coalesce(F.trim("quote"), F.lit("")) == ""), "no quote")
        .when(F.col("status") == "quote_mismatch", "quote not in the cited lines")
        .when((F.col("status") == "bad_ref") & F.col("ref").isNull(), "no ref (bare value)")
        .when((F.col("status") == "bad_ref") & F.col("name").isNull(), F.col("problem"))
        .when(F.col("status") == "bad_ref", F.concat(F.lit("ref outside this chunk's input: "), F.col("ref")))
    )
    df = df.withColumn("status", status).withColumn("note", note)
    if "at" in carried.columns:  # where quotes that missed their lines stand instead
        missed = df.where((F.col("status") == "quote_mismatch") & (F.trim("quote") != "")).select(*KEY, "quote").distinct()
        df = df.join(find_quotes(missed, carried), [*KEY, "quote"], "left")
        elsewhere = (F.col("status") == "quote_mismatch") & F.col("found").isNotNull()
        df = df.withColumn("note", F.when(elsewhere, F.concat(F.lit("quote found at "), "found")).otherwise(F.col("note"))).select(*values.columns, "status", "note")
    return df.drop("_id", "written", "problem", "cited", "missing", "a", "b", "name")


def with_norm(values: DataFrame) -> DataFrame:
    """values with `norm`, the key by which equal values are told."""

    @F.pandas_udf("string")
    def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([norm_key(json.loads(v)) if v is not None else None for v in batch])

    return values.withColumn("norm", key("value"))


def merge(values: DataFrame) -> DataFrame:
    """(job, path, value, conflict, refs, quotes, distinct): one value, or a conflict of the first of each."""
    order = F.struct("chunk", "seq", "ref", "quote", "value")
    once = with_norm(values.where("value is not null")).groupBy("job", "path", "norm", "ref").agg(F.min(order).alias("f"))
    each = once.groupBy("job", "path", "norm").agg(F.min("f").alias("first"), F.sort_array(F.collect_list("f")).alias("every"))
    by = each.groupBy("job", "path").agg(F.sort_array(F.collect_list(F.struct("first", "every"))).alias("g"))
    several = F.size("g") > 1
    firsts = F.when(several, F.transform("g", lambda x: x["first"])).otherwise(F.element_at("g", 1)["every"])
    return by.select(
        "job",
        "path",
        F.when(several, F.to_json(F.transform("g", lambda x: x["first"]["value"]))).otherwise(F.element_at("g", 1)["first"]["value"]).alias("value"),
        several.alias("conflict"),
        F.transform(firsts, lambda x: x["ref"]).alias("refs"),
        F.transform(firsts, lambda x: x["quote"]).alias("quotes"),
        F.size("g").cast("long").alias("distinct"),
    )


def schema_summary(items: DataFrame, *by: str) -> DataFrame:
    def n(*s: str) -> Column:
        return F.count_if(F.col("status").isin(*s))

    checked = n("ok", "ok~", "quote_mismatch", "bad_ref", "value_not_in_quote")
    return items.groupBy(*by).agg(
        checked.alias("values"), n("ok").alias("ok"), n("ok~").alias("ok_folded"), n("quote_mismatch").alias("quote_mismatch"), n("bad_ref").alias("bad_ref"),
        n("value_not_in_quote").alias("value_not_in_quote"), n("null").alias("nulls"), n("ok", "ok~", "value_not_in_quote").alias("refs_ok"),
        n("bad_ref", "quote_mismatch").alias("refs_bad"), F.try_divide(n("ok", "ok~"), checked).alias("pass_rate"),
    )


def schema_report(items: DataFrame, answers: DataFrame, fields: int, *by: str) -> DataFrame:
    """`schema_summary` with the number of the schema's leaves, and of chunks whose answer (job, chunk, json, repaired)
    could not be read or was repaired; also of jobs in which no answer gave a value."""
    failed, fixed = F.count_if(F.col("json").isNull()), F.count_if(F.coalesce("repaired", F.lit(False)))
    chunks = answers.groupBy(*by).agg(failed.alias("failed_chunks"), fixed.alias("repaired_chunks"))
    met = chunks.join(schema_summary(items, *by), list(by), "left").withColumn("fields", F.lit(fields))
    counts = [c for c, kind in met.dtypes if kind in ("bigint", "int") and c not in by]
    return met.select(*by, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], "pass_rate")


def item_text(value: Column) -> Column:
    return clip(value)
