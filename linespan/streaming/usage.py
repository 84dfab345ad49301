"""Usage as a stream: daily totals with a watermark, and a day's budget as state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

DAY_MS = 86_400_000
NOBODY, UNKNOWN = -1, 2**62  # the shard of events without a user; a cost that no budget has room for
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """A folder's Parquet files as a stream of events."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder)


def daily_usage(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Jobs and cost of each UTC day and kind; a day is final once the watermark has passed it."""
    day = F.window("ts", "1 day")
    cents = F.round(F.col("value") * 100).cast("long")
    out = events.withWatermark("ts", delay).groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("jobs"), F.sum(cents).alias("cost"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "jobs", "cost")


def ledger(events: DataFrame, daily_cents: int, delay: str = "1 day", shards: int = 32) -> DataFrame:
    """Each user's spending against a daily budget: whether a job is granted when it comes, and
    what the day has cost so far.

    A day's users are dealt to `shards` groups by a hash, as a call and a row of state for every user's day cost
    far more than its few jobs.  State is what each user of a shard's day has spent, as a day starts at nothing, and goes once
    the watermark has passed the day.  Of a micro-batch a task holds one shard's one day; more shards make that less.
    """
    columns = ["user_id", "event_id", "day", "granted", "spent"]

    def settle(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        spent = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        granted, so_far = [], []
        for user, cents in zip(rows["user_id"].tolist(), rows["cents"].tolist(), strict=True):
            before = spent.get(user, 0)
            ok = before + cents <= daily_cents
            granted.append(ok)
            so_far.append(before + cents if ok else before)
            if ok:
                spent[user] = so_far[-1]
        state.update((list(spent), list(spent.values())))
        over = int(pd.Timestamp(key[0], tz="UTC").timestamp() * 1000) + DAY_MS
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        users = [None] * len(rows) if key[1] == NOBODY else rows["user_id"]
        yield pd.DataFrame(dict(zip(columns, (users, rows["event_id"], key[0], granted, so_far), strict=True)))

    cents = F.coalesce(F.round(F.col("value") * 100).cast("long"), F.lit(UNKNOWN)).alias("cents")
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    shard = F.when(F.col("user_id").isNull(), NOBODY).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(shards))).cast("int").alias("shard")
    df = events.withWatermark("ts", delay).select(F.coalesce("user_id", F.lit(0)).alias("user_id"), day, shard, "event_id", "ts", cents)
    return df.groupBy("day", "shard").applyInPandasWithState(
        settle, "user_id bigint, event_id bigint, day string, granted boolean, spent bigint", "users array<bigint>, spent array<bigint>", "append", "EventTimeTimeout"
    )


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, written to the shared folder and read back."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
