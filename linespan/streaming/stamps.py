"""Stamps of log lines as a stream: lines come late and out of order, and are told their time in order.

A line waits in its file's state until the watermark has passed the time at which it was written (`ts`); then the lines
that waited are taken in the order of their numbers, and each takes the last stamp at or above it, as the
batch operator `filters.carry_stamp` would give it.  Only (n, own, ts) of waiting lines is kept, besides one number and one
stamp; a timer wakes a file that gets no more lines.  A line that was written after one with a higher number has
been told comes too late: it is told its own stamp alone and marked.  Lines written before the watermark that
come only now are dropped by Spark, as in every stream with a watermark: the delay is how long lines are waited for.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import stamped

STATE = "told bigint, stamp bigint, n array<bigint>, own array<bigint>, ts array<bigint>"
TOLD = "file_id bigint, n bigint, own bigint, stamp bigint, late boolean"


def tell_stamps(lines: DataFrame, delay: str = "1 day", tz: str = "UTC", now: datetime | None = None) -> DataFrame:
    """(file_id, n, own, stamp, late) of a stream of lines (file_id, n, text, ts), each line once."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        told, stamp, *kept = state.get if state.exists else (-1, None, [], [], [])
        waiting = list(zip(*map(list, kept), strict=True))
        if not state.hasTimedOut:
            for rows in batches:
                own = [None if pd.isna(x) else int(x) for x in rows["own"]]
                waiting += zip(map(int, rows["n"]), own, map(int, rows["at"]), strict=True)
        mark, out = state.getCurrentWatermarkMs(), []
        for n, own, _ in sorted((x for x in waiting if x[2] < mark), key=lambda x: (x[0], x[2])):
            late = n < told
            if not late:
                told, stamp = n, stamp if own is None else own
            out.append((key[0], n, own, own if late else stamp, late))
        waiting = sorted(x for x in waiting if x[2] >= mark)
        state.update((told, stamp, *([x[k] for x in waiting] for k in range(3))))
        if waiting:
            state.setTimeoutTimestamp(max(min(x[2] for x in waiting), mark + 1))
        yield pd.DataFrame(out, columns=["file_id", "n", "own", "stamp", "late"]).astype({"own": "Int64", "stamp": "Int64"})

    read = stamped(lines.withWatermark("ts", delay), "text", tz, now)
    read = read.select("file_id", "n", "own", F.unix_millis("ts").alias("at"), "ts")
    return read.groupBy("file_id").applyInPandasWithState(step, TOLD, STATE, "append", "EventTimeTimeout")
