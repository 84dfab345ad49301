"""Schema answers against the truth: recall and precision of leaves and list items.

A pair of JSON texts is taken apart once, into leaves and lists whose values are readings (what a value can be read as);
all comparing and counting is done on them by SQL functions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import READING, reading, values_agree

COUNTS = ("fields", "correct", "wrong", "missed", "invented", "null_expected", "null_ok", "conflicts_expected", "conflicts_caught",
          "list_expected", "list_answered", "list_matched", "answered_values", "right_values")
_LEAF = f"struct<kind:string,options:array<{READING}>,empty:boolean,conflict:boolean,given:array<array<{READING}>>>"
_WANT = f"struct<path:string,empty:boolean,options:array<{READING}>>"
_LIST = f"struct<wants:array<array<{_WANT}>>,items:array<map<string,array<{READING}>>>>"


def _special(v) -> str | None:
    """any or conflict, of a truth like {"any": [...]}."""
    (key,) = v if isinstance(v, dict) and len(v) == 1 else (None,)
    return key if key in ("any", "conflict") and isinstance(v[key], list) else None


def _value(a):
    return a["value"] if isinstance(a, dict) and "value" in a else a


def _readings(v) -> list[dict]:
    """Of an answered value: it, or what it lists."""
    return [] if v is None else [r for x in v for r in _readings(x)] if isinstance(v, list) else [reading(v)]


def _below(got, key):
    return got.get(key) if isinstance(got, dict) else None


def _leaf(want, got) -> dict:
    kind, value = _special(want), _value(got)
    several = isinstance(got, dict) and got.get("conflict") is True and isinstance(value, list)
    given = [] if value is None else value if several else [value]
    options = [] if want is None else want[kind] if kind else [want]
    return {"kind": "null" if want is None else kind or "one", "options": list(map(reading, options)), "empty": value is None, "conflict": several, "given": list(map(_readings, given))}


def _fields(want, path: tuple = ()) -> Iterator[tuple[tuple, object]]:
    """Paths and truths of an expected item."""
    if isinstance(want, dict) and not _special(want):
        for k, w in want.items():
            yield from _fields(w, (*path, k))
    else:
        yield path, want


def _list(wants: list, got) -> dict:
    fields = [list(_fields(w)) for w in wants]
    name = json.dumps
    paths = {p for f in fields for p, _ in f}

    def at(item, path):
        for k in path:
            item = _below(item, k)
        value = _value(item)
        return None if value is None else _readings(value)

    asked = [[{"path": name(p), "empty": w is None, "options": [] if w is None else list(map(reading, w["any"] if _special(w) == "any" else [w]))} for p, w in f] for f in fields]
    return {"wants": asked, "items": [{name(p): at(x, p) for p in paths} for x in (got if isinstance(got, list) else [])]}


def _apart(want, got, leaves: list, lists: list) -> None:
    if isinstance(want, list):
        lists.append(_list(want, got))
    elif isinstance(want, dict) and not _special(want):
        for k, w in want.items():
            _apart(w, _below(got, k), leaves, lists)
    else:
        leaves.append(_leaf(want, got))


def _leaf_counts(x: Column) -> Column:
    """The counts of one leaf."""
    agrees = lambda given: F.exists(x["options"], lambda o: F.exists(given, lambda a: values_agree(o, a)))
    right = F.size(F.filter(x["given"], agrees))
    answered = F.size(x["given"])
    caught = x["conflict"] & F.forall(x["options"], lambda o: F.exists(F.flatten(x["given"]), lambda a: values_agree(o, a)))
    null, conflict, empty = x["kind"] == "null", x["kind"] == "conflict", x["empty"]
    plain = ~null & ~conflict
    counts = {
        "fields": F.lit(True), "correct": plain & ~empty & (right > 0), "wrong": ~empty & ((plain & (right == 0)) | (conflict & ~caught)), "missed": empty & (plain | conflict),
        "invented": null & ~empty, "null_expected": null, "null_ok": null & empty, "conflicts_expected": conflict, "conflicts_caught": conflict & caught,
        "answered_values": F.when(conflict & caught, 1).otherwise(answered), "right_values": F.when(conflict, caught.cast("int")).when(plain & ~empty, right).otherwise(0),
    }
    return F.struct(*[counts[c].cast("int").alias(c) if c in counts else F.lit(0).alias(c) for c in COUNTS])


def _list_counts(x: Column) -> Column:
    """The counts of one list: each expected item takes the first answer that is free and matches."""

    def matches(want: Column, item: Column) -> Column:
        def field(f: Column) -> Column:
            said = F.try_element_at(item, f["path"])
            hit = F.exists(f["options"], lambda o: F.exists(said, lambda a: values_agree(o, a)))
            return F.when(f["empty"], said.isNull()).otherwise(F.coalesce(hit, F.lit(False)))

        return F.forall(want, field)

    def take(free: Column, want: Column) -> Column:
        hit = F.get(F.filter(free, lambda j: matches(want, F.get(x["items"], j))), F.lit(0))
        return F.when(hit.isNull(), free).otherwise(F.array_remove(free, hit))

    size = F.size(x["items"])
    free = F.aggregate(x["wants"], F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")), take)
    counts = {"list_expected": F.size(x["wants"]), "list_answered": size, "list_matched": size - F.size(free)}
    return F.struct(*[(counts[c] if c in counts else F.lit(0)).cast("int").alias(c) for c in COUNTS])


def score_schema(expected: Column, merged: Column) -> Column:
    """A struct of counts for each pair of JSON texts."""

    @F.pandas_udf(f"leaves array<{_LEAF}>, lists array<{_LIST}>")
    def apart(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for want, got in batches:
            rows = []
            for w, g in zip(want, got, strict=True):
                rows.append(([], []))
                _apart(json.loads(w), json.loads(g) if g else {}, *rows[-1])
            yield pd.DataFrame(rows, columns=["leaves", "lists"])

    parts = apart(expected, merged)
    each = F.concat(F.transform(parts["leaves"], _leaf_counts), F.transform(parts["lists"], _list_counts))
    none = F.struct(*[F.lit(0).alias(c) for c in COUNTS])
    return F.aggregate(each, none, lambda a, x: F.struct(*[(a[c] + x[c]).alias(c) for c in COUNTS]))


def recall_precision(scored: DataFrame, *by: str) -> DataFrame:
    """Micro averages of score structs in a column s."""
    hit = F.sum(F.col("s.correct") + F.col("s.conflicts_caught") + F.col("s.list_matched"))
    need = F.sum(F.col("s.fields") - F.col("s.null_expected") + F.col("s.list_expected"))
    right, answered = F.sum(F.col("s.right_values") + F.col("s.list_matched")), F.sum(F.col("s.answered_values") + F.col("s.list_answered"))
    invented = F.try_divide(F.sum("s.invented"), F.sum("s.null_expected"))
    return scored.groupBy(*by).agg(
        hit.alias("hit"), need.alias("need"), right.alias("right"), answered.alias("answered"),
        F.try_divide(hit, need).alias("recall"), F.try_divide(right, answered).alias("precision"), invented.alias("invented_rate"),
    )
