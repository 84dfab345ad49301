"""Running values over rows in an order, where one key may have more rows than a task should hold.

Rows are dealt into ranges of (key, order); each range works on its own rows and takes over what the ranges
before have of the same key, which is one row a range at most.  The ranges are cut off by a table in
the shared folder, so that every later step sees the same ones.  All columns of the rows go there: what is long is better joined afterwards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


#: With this, shuffle files go when the table that they made is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df as written to the shared folder, compressed and by column, and read back."""
    spark = df.sparkSession
    at, kept = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex[:12]}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(at)


def _ranged(rows: DataFrame, keys: list[str], order: list, values: dict[str, Column]) -> DataFrame:
    ranged = rows.repartitionByRange(*keys, *order)
    return cut(ranged.select("*", F.spark_partition_id().alias("_range"), *[c.alias(f"_of_{n}") for n, c in values.items()]))


def before(rows: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """rows with the sum of each of `sums` over the rows of the same key before its own; keys aren't null."""
    return _before(_ranged(rows, keys, order, sums), rows.columns, keys, order, list(sums))


def before_each(rows: DataFrame, keys: list[str], inner: list[str], order: list, outer_sums: dict[str, Column], inner_sums: dict[str, Column]) -> DataFrame:
    """`before` by keys, in the order of inner and order, and by keys and inner, over the same ranges."""
    ranged = _ranged(rows, [*keys, *inner], order, outer_sums | inner_sums)
    some = _before(ranged, ranged.columns, keys, [*inner, *order], list(outer_sums))
    return _before(some, [*rows.columns, *outer_sums], [*keys, *inner], order, list(inner_sums), ranged)


def _before(local: DataFrame, columns: list[str], keys: list[str], order: list, names: list[str], ranged: DataFrame | None = None) -> DataFrame:
    parts = (local if ranged is None else ranged).groupBy(*keys, "_range").agg(*[F.sum(f"_of_{n}").alias(f"_all_{n}") for n in names])
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_range"))
    carried = parts.select(*keys, "_range", first.alias("_no"), *[F.sum(f"_all_{n}").over(ahead).alias(f"_ahead_{n}") for n in names]).where("_no > 1")
    here = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = local.withColumns({f"_here_{n}": F.sum(f"_of_{n}").over(here) for n in names})
    zero = F.lit(0)
    both = {n: (F.coalesce(f"_here_{n}", zero) + F.coalesce(f"_ahead_{n}", zero)).alias(n) for n in names}
    return local.join(F.broadcast(carried), [*keys, "_range"], "left").select(*columns, *both.values())


def last_at(rows: DataFrame, keys: list[str], order: list, values: dict[str, Column]) -> DataFrame:
    """rows with the last value that isn't null at or before each row of the same key."""
    ranged = _ranged(rows, keys, order, values)
    place = F.struct(*order)
    kept = lambda n: F.when(F.col(f"_of_{n}").isNotNull(), place)
    parts = ranged.groupBy(*keys, "_range").agg(*[F.max_by(f"_of_{n}", kept(n)).alias(f"_all_{n}") for n in values])
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_range"))
    carried = parts.select(*keys, "_range", first.alias("_no"), *[F.last(f"_all_{n}", ignorenulls=True).over(ahead).alias(f"_ahead_{n}") for n in values]).where("_no > 1")
    here = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_here_{n}": F.last(f"_of_{n}", ignorenulls=True).over(here) for n in values})
    both = [F.coalesce(f"_here_{n}", f"_ahead_{n}").alias(n) for n in values]
    return local.join(F.broadcast(carried), [*keys, "_range"], "left").select(*rows.columns, *both)
