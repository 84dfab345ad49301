"""Registered queries that run as streams over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import budget as B
from ..streaming import stamps as T
from ..streaming import usage as U
from .line_queries import NOW

QUERIES, SQL = {}, {}


def stream_daily_usage(spark, sf_dir):
    """Daily totals of the days that the watermark has closed."""
    return U.run_once(U.daily_usage(U.read_events(spark, sf_dir)))


def stream_ledger(spark, sf_dir):
    """Each user's jobs against a daily budget, with the user's day as state."""
    return U.run_once(U.ledger(U.read_events(spark, sf_dir), 20_000))


def stream_stamps(spark, sf_dir):
    """The events as lines of logs, one a user, that are told their times once the watermark has passed them."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  at "), "event_type")).otherwise(F.concat_ws(" ", stamp, "event_type"))
    lines = U.read_events(spark, sf_dir).select(F.col("user_id").alias("file_id"), F.col("event_id").alias("n"), text.alias("text"), "ts")
    return U.run_once(T.tell_stamps(lines, now=NOW)).select("file_id", "n", "stamp", "late")


def stream_reservations(spark, sf_dir):
    """Events as calls: each reserves its value and is settled to four fifths of it an hour later; every eleventh is never settled."""
    events = U.read_events(spark, sf_dir)
    cents = F.round(F.col("value") * 100).cast("long")
    both = F.array(F.struct(F.lit(False).alias("settles"), cents.alias("cents"), F.lit(0).alias("h")), F.struct(F.lit(True).alias("settles"), F.floor(cents * 4 / 5).alias("cents"), F.lit(1).alias("h")))
    rows = events.select("user_id", F.col("event_id").alias("job"), "ts", F.explode(both).alias("a")).where("not (a.settles and job % 11 = 0)")
    actions = rows.select("user_id", (F.col("job") * 2 + F.col("a.h")).alias("seq"), "job", "a.settles", "a.cents", F.timestamp_micros(F.unix_micros("ts") + F.col("a.h") * 3_600_000_000).alias("ts"))
    return U.run_once(B.reservations(actions, 20_000))


QUERIES |= {f.__name__: f for f in (stream_daily_usage, stream_ledger, stream_stamps, stream_reservations)}
SQL["stream_stamps"] = """WITH m AS (SELECT epoch_ms(max(ts)) - 86400000 AS mark FROM events),
e AS (SELECT user_id AS file_id, event_id AS n, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS own FROM events, m WHERE epoch_ms(ts) < mark)
SELECT file_id, n, last_value(own IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS stamp, false AS late FROM e"""
SQL["stream_daily_usage"] = """WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS jobs, sum(round(value * 100)::BIGINT)::BIGINT AS cost
FROM events, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY ALL"""
