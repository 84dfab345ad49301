"""Row filters over lines: range, time window, pattern with context.

The order of a job is range, time, mask, pattern: time reads the raw line, the
pattern reads the masked one, and the data dependency keeps it so.
"""

from __future__ import annotations

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import InputError
from .ordered import last_at

# What a line may start with to carry a time.
_PREFIX = r"^(?:\x1b\[[0-9;]*m)*\[?"
ISO = _PREFIX + r"(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(Z|[+-]\d{2}(?::?\d{2})?)?(?![\d:])"
SYSLOG = _PREFIX + r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) {1,2}(\d{1,2}) (\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?(?!\d)"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def line_range(lines: Column, first: int, last: int) -> Column:
    """Of an array of (n, text): those numbered first to last."""
    return F.filter(lines, lambda x: x["n"].between(first, last))


def context(hits: Column, k: int) -> Column:
    """Of an array of (n, hit) in order: the numbers within k of a hit's number.

    Each hit adds what the hit before it doesn't reach, so numbers come once and in order."""
    at = F.transform(F.filter(hits, lambda x: x["hit"]), lambda x: x["n"])
    before = F.concat(F.array(F.lit(None).cast("int")), F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))))

    def around(n: Column, prev: Column) -> Column:
        start = F.greatest(n - k, prev + k + 1)
        return F.when(start <= n + k, F.sequence(start, F.greatest(start, n + k)))

    near = F.flatten(F.array_compact(F.zip_with(at, before, around)))
    return F.array_intersect(F.transform(hits, lambda x: x["n"]), near)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    if len(pattern) > 1000:
        raise InputError("the pattern is longer than 1000 characters")
    return text.rlike(("(?iu)" if ignore_case else "") + pattern)


def context_rows(lines: DataFrame, hit: Column, k: int, key: str = "file_id") -> DataFrame:
    """The same over rows (key, n, text), for lines that aren't in one array."""
    near = Window.partitionBy(key).orderBy("n").rangeBetween(-k, k)
    return lines.withColumn("hit", hit).withColumn("near", F.max(F.col("hit").cast("int")).over(near)).where("near = 1").drop("near")


# --- time ----------------------------------------------------------------------


def _epoch_s(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Seconds of a civil time, days beyond a month's end counted on into the next."""
    day = F.unix_date(F.make_date(y, F.greatest(mo, F.lit(1)), F.lit(1))) + d - 1
    return day.cast("long") * 86400 + h * 3600 + mi * 60 + s


def stamped(lines: DataFrame, text: str = "text", tz: str = "UTC", now: datetime | None = None) -> DataFrame:
    """lines with `own`: epoch milliseconds of the time that a line starts with, else null.

    Each pattern is matched once, to an array of its groups that the arithmetic reads.
    """
    now = now or datetime.now(UTC)
    here = now.astimezone(ZoneInfo(tz))

    def groups(pattern: str, n: int) -> Column:
        marked = F.regexp_replace(F.col(text), "(?s)" + pattern + ".*", "\x01".join(f"${i}" for i in range(1, n + 1)))
        return F.when(F.col(text).rlike(pattern), F.split(marked, "\x01", -1))

    def num(parts: str, i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))

    def with_zone(df: DataFrame, local: str, out: str) -> DataFrame:
        """Epoch seconds of local seconds: the zone's offset is looked up, applied and looked up again."""
        if tz == "UTC":
            return df.withColumn(out, F.col(local))
        for given, made in ((local, "_near"), ("_near", out)):
            e = F.col(given)
            offset = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(e), tz)) - e
            df = df.withColumn(made, F.col(local) - offset)
        return df

    df = lines.withColumn("_iso", groups(ISO, 8)).withColumn("_sys", groups(SYSLOG, 6))
    sane = num("_iso", 1).between(1, 12) & num("_iso", 2).between(1, 31) & (num("_iso", 3) <= 23) & (num("_iso", 4) <= 59) & (num("_iso", 5) <= 60)
    df = df.withColumn("_iso", F.when(sane, F.col("_iso")))
    df = df.withColumn("_local", F.when(F.col("_iso").isNotNull(), _epoch_s(*[num("_iso", i) for i in range(6)])))
    df = with_zone(df, "_local", "_zoned").withColumn("_zone", F.replace(F.get("_iso", F.lit(7)), F.lit(":"), F.lit("")))
    shift = (F.substring("_zone", 2, 2).try_cast("int") * 3600 + F.coalesce(F.substring("_zone", 4, 2).try_cast("int"), F.lit(0)) * 60) * F.when(F.col("_zone").startswith("-"), -1).otherwise(1)
    at = F.when(F.col("_zone") == "Z", F.col("_local")).when(F.col("_zone") != "", F.col("_local") - shift).otherwise(F.col("_zoned"))
    df = df.withColumn("own", at * 1000 + F.coalesce(F.rpad(F.get("_iso", F.lit(6)), 3, "0").try_cast("int"), F.lit(0)))
    month = F.floor((F.position(F.get("_sys", F.lit(0)), F.lit(MONTHS)) + 2) / 3).cast("int")
    for year, out in ((here.year, "_this"), (here.year - 1, "_before")):
        civil = _epoch_s(F.lit(year), F.greatest(month, F.lit(1)), *[num("_sys", i) for i in range(1, 5)])
        df = with_zone(df.withColumn("_local", F.when(F.col("_sys").isNotNull(), civil)), "_local", out)
    fraction = F.coalesce(F.rpad(F.get("_sys", F.lit(5)), 3, "0").try_cast("int"), F.lit(0))
    syslog = F.when(F.col("_this") * 1000 > int(now.timestamp() * 1000), F.col("_before")).otherwise(F.col("_this")) * 1000 + fraction
    df = df.withColumn("own", F.coalesce("own", syslog))
    return df.drop("_iso", "_sys", "_local", "_near", "_zoned", "_zone", "_this", "_before")


def carry_stamp(lines: DataFrame, key: str = "file_id", tz: str = "UTC", now: datetime | None = None) -> DataFrame:
    """Lines with `own` (their stamp) and `stamp`, the last at or above them in their file.

    A segmented scan: ranges of lines take over the last stamp of the ranges before, so a file may lie in many tasks.
    Only numbers and stamps are scanned, and met by the lines again where these have more columns.
    """
    read = stamped(lines, "text", tz, now)
    marks = last_at(read.select(key, "n", "own"), [key], ["n"], {"stamp": F.col("own")})
    rest = [c for c in lines.columns if c not in (key, "n")]
    return lines.join(marks, [key, "n"]).select(*lines.columns, "own", "stamp") if rest else marks


def unstamped(lines: DataFrame, key: str = "file_id", tz: str = "UTC", now: datetime | None = None) -> DataFrame:
    """(key, reason) of files in which no line carries a time: a time filter refuses them."""
    none = stamped(lines, "text", tz, now).groupBy(key).agg(F.count("own").alias("n")).where("n = 0")
    return none.select(key, F.lit("no recognised timestamp").alias("reason"))


def beyond_end(files: DataFrame, first: Column, total: Column, key: str = "file_id") -> DataFrame:
    """(key, reason) of files whose range starts after their last line."""
    reason = F.concat(F.lit("range starts after the end ("), total.cast("string"), F.lit(" lines)"))
    return files.where(first > total).select(key, reason.alias("reason"))


def time_window(lines: DataFrame, since_ms: int | None, until_ms: int | None, key: str = "file_id", tz: str = "UTC", now: datetime | None = None) -> DataFrame:
    """Lines whose stamp lies in the window, both ends included; lines before the first stamp go.
    Files without any stamp have no lines here; `unstamped` names them."""
    if since_ms is None and until_ms is None:
        raise InputError("give since, until or both")
    if since_ms is not None and until_ms is not None and since_ms > until_ms:
        raise InputError("since is later than until")
    df = carry_stamp(lines, key, tz, now).where("stamp is not null")
    if since_ms is not None:
        df = df.where(F.col("stamp") >= since_ms)
    if until_ms is not None:
        df = df.where(F.col("stamp") <= until_ms)
    return df
