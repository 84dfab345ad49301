"""A daily budget with reservations, as a stream: before a call its worst case is reserved, afterwards it is settled to what it cost.

Actions wait in their user's state until the watermark has passed them and are taken in the order of time, so
their order of arrival doesn't matter.  A reservation is granted if what the day has spent, what is reserved and
it stay within the budget.  A settlement frees its job's reservation and, on the day it was made, adds the cost; a cost that
can't be read counts as the whole reservation, a second settlement and one without a reservation count for nothing.  A new UTC day starts
at nothing spent; open reservations stay.  Amounts are whole cents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ACTION = "array<struct<at:bigint,seq:bigint,job:bigint,settles:boolean,cents:bigint>>"
STATE = f"day bigint, spent bigint, open array<struct<job:bigint,cents:bigint,day:bigint>>, waiting {_ACTION}"
OUT = "user_id bigint, seq bigint, job bigint, settles boolean, granted boolean, spent bigint, reserved bigint"
DAY_MS = 86_400_000


class Account:
    """One user's day: what is spent, and the open reservations (job -> cents, day)."""

    def __init__(self, daily_cents: int | None, day: int = -1, spent: int = 0, open_: dict | None = None):
        self.daily, self.day, self.spent, self.open = daily_cents, day, spent, open_ or {}

    @property
    def reserved(self) -> int:
        return sum(c for c, _ in self.open.values())

    def act(self, at: int, job: int, settles: bool, cents: int | None) -> bool | None:
        """Whether a reservation is granted; nothing for a settlement."""
        if (day := at // DAY_MS) > self.day:
            self.day, self.spent = day, 0
        known = cents is not None and cents >= 0
        if settles:
            if job in self.open:
                held, since = self.open.pop(job)
                self.spent += (cents if known else held) * (since == self.day)
            return None
        granted = known and job not in self.open and (self.daily is None or self.spent + self.reserved + cents <= self.daily)
        if granted:
            self.open[job] = (cents, self.day)
        return granted


def reservations(actions: DataFrame, daily_cents: int | None, delay: str = "1 day") -> DataFrame:
    """(user_id, seq, job, settles, granted, spent, reserved) of a stream of actions (user_id, seq, job, settles, cents, ts);
    spent and reserved are what they are after the action."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        day, spent, open_, waiting = state.get if state.exists else (-1, 0, [], [])
        account = Account(daily_cents, day, spent, {r["job"]: (r["cents"], r["day"]) for r in open_})
        todo = [(r["at"], r["seq"], r["job"], r["settles"], r["cents"]) for r in waiting]
        if not state.hasTimedOut:
            for b in batches:
                cents = [None if pd.isna(x) else int(x) for x in b["cents"]]
                todo += zip(map(int, b["at"]), map(int, b["seq"]), map(int, b["job"]), map(bool, b["settles"]), cents, strict=True)
        mark, out = state.getCurrentWatermarkMs(), []
        todo.sort(key=lambda x: x[:2])
        for at, seq, job, settles, cents in (x for x in todo if x[0] < mark):
            granted = account.act(at, job, settles, cents)
            out.append((key[0], seq, job, settles, granted, account.spent, account.reserved))
        left = [x for x in todo if x[0] >= mark]
        state.update((account.day, account.spent, [(j, c, d) for j, (c, d) in account.open.items()], left))
        if left:
            state.setTimeoutTimestamp(max(left[0][0], mark + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"granted": "boolean"})

    df = actions.withWatermark("ts", delay).select("user_id", "seq", "job", "settles", F.col("cents").cast("long").alias("cents"), F.unix_millis("ts").alias("at"), "ts")
    return df.groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", "EventTimeTimeout")
