"""Operator 6: mix sources to target weights, in DataFrame functions only.

Tokens (words) are summed per source; sources get weights by their rank and
share a multiple of the whole.  A target is capped at `cap` times its source
and the excess is dealt again by weight: with sources in the order of
cap/weight that is one water level, found with running sums.  Each document is
emitted floor(rate) times, plus once more when a number from the md5 of its id and
text falls below the rate's fraction, so reruns and retried tasks agree.  Rows that
are equal in id, text and source would all draw alike; they are numbered, and of the
first k of them floor(k * fraction + draw) get the extra copy (systematic sampling).

Ranks and running sums over sources are kept in ranges of sources, joined by the sums
of the ranges before, so no task holds all sources even where a source is a host.
Documents meet the targets in a join that Spark broadcasts when the written table
is small and splits when a source is hot.  Only rows whose id repeats are written
to be numbered, in as many tasks as they were read in.

Defined cases: null text has size 0; null source is a source of its own, last
in rank; null ids and repeated ids draw by their text as well; size 0 everywhere
gives targets 0 and no copies; empty tables give no rows; extra columns pass
through (working names start with ``_mix_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:id:md5(text))."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def before(df: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """df with the sum of each of `sums` over all rows before, in an order, by ranges of rows."""
    ranged = df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_mix_range"), *[c.alias(f"_mix_of_{n}") for n, c in sums.items()])
    ranged = scratch.keep(ranged, name)
    whole = ranged.groupBy("_mix_range").agg(*[F.sum(f"_mix_of_{n}").alias(f"_mix_all_{n}") for n in sums])
    ahead = Window.orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range: as many as tasks
    base = whole.select("_mix_range", *[F.coalesce(F.sum(f"_mix_all_{n}").over(ahead), F.lit(0)).alias(f"_mix_base_{n}") for n in sums])
    within = Window.partitionBy("_mix_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = [(F.col(f"_mix_base_{n}") + F.coalesce(F.sum(f"_mix_of_{n}").over(within), F.lit(0))).alias(n) for n in sums]
    return ranged.join(base, "_mix_range").select(*df.columns, *out)


def allocate(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> the same with weight and target; one row a source."""
    by_name = F.col("source").asc_nulls_last()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    df = before(sizes, [by_name], {"rank": F.lit(1)}, scratch, "ranked")
    df = df.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    df = df.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("level_of", F.col("most") / F.col("weight"))
    df = before(df, [F.col("level_of").asc(), by_name], {"taken_before": F.col("most"), "weight_before": F.col("weight")}, scratch, "levels")
    df = scratch.keep(df, "leveled")
    size, weight = df.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(size or 0)) * F.lit(float(share)) - F.col("taken_before")) / (F.lit(float(weight or 1)) - F.col("weight_before"))
    found = df.where(level <= F.col("level_of")).agg(F.min_by(level, F.struct("level_of", -level))).first()[0]
    target = F.col("most") if found is None else F.least("most", F.col("weight") * F.lit(found))
    return df.select("source", "source_size", "weight", target.alias("target"))


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with `_mix_nth`, the number of a row among those equal in id, text and source, from 0."""
    id_ = F.col("doc_id").cast("string")
    repeated = scratch.keep(docs.groupBy(id_.alias("_mix_id")).agg(F.count(F.lit(1)).alias("_mix_c")).where("_mix_c > 1").select("_mix_id"), "repeated")
    if repeated.isEmpty():
        return docs.withColumn("_mix_nth", F.lit(0).cast("long"))
    again = id_.eqNullSafe(repeated["_mix_id"])
    alone = docs.join(repeated, again, "left_anti").withColumn("_mix_nth", F.lit(0).cast("long"))
    key = F.xxhash64(id_, F.md5(F.col("text").cast("binary")), "source", F.col("doc_id").isNull(), F.col("text").isNull(), F.col("source").isNull())
    some = docs.join(repeated, again, "left_semi").withColumn("_mix_key", key)
    # A group of equal rows is numbered where its rows were read, each place behind the ones before it.
    some = scratch.keep(some.withColumn("_mix_at", F.spark_partition_id()), "equal")
    places = some.groupBy("_mix_key", "_mix_at").agg(F.count(F.lit(1)).alias("_mix_n"))
    ahead = Window.partitionBy("_mix_key").orderBy("_mix_at").rowsBetween(Window.unboundedPreceding, -1)
    places = places.select("_mix_key", "_mix_at", F.coalesce(F.sum("_mix_n").over(ahead), F.lit(0)).alias("_mix_base"))
    here = F.row_number().over(Window.partitionBy("_mix_key", "_mix_at").orderBy(F.lit(0))) - 1
    some = some.withColumn("_mix_here", here).join(places, ["_mix_key", "_mix_at"])
    return alone.unionByName(some.select(*docs.columns, (F.col("_mix_base") + F.col("_mix_here")).cast("long").alias("_mix_nth")))


def plan(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """docs with `_mix_size`, `_mix_source_size`, `_mix_target` and `_mix_copies`."""
    sizes = docs.select("source", words(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    dealt = scratch.keep(allocate(sizes, scratch, weights, share, cap), "targets").select(
        F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target")
    )
    df = numbered(docs, scratch).withColumn("_mix_size", words(F.col("text")))
    df = df.join(dealt, df["source"].eqNullSafe(dealt["_mix_source"])).drop("_mix_source")
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(0.0)
    part, u = rate - F.floor(rate), draw(F.col("doc_id"), F.col("text"), seed)
    upto = lambda k: F.floor(k.cast("double") * part + u)
    return df.withColumn("_mix_copies", F.floor(rate) + upto(F.col("_mix_nth") + 1) - upto(F.col("_mix_nth"))).drop("_mix_nth")


def mix(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """Every document as many times as its plan says, with its own columns."""
    copies = F.array_repeat(F.lit(True), F.col("_mix_copies").cast("int"))
    return plan(docs, scratch, **options).withColumn("_mix_copy", F.explode(copies)).select(*docs.columns)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    df = plan(docs, Scratch(spark, "op6"))
    return df.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS nth, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             source_size * 2.0::DOUBLE AS most FROM s),
b AS (SELECT *, most / weight AS level_of,
             coalesce(sum(most) OVER o, 0.0) AS taken_before, coalesce(sum(weight) OVER o, 0.0) AS weight_before
      FROM w WINDOW o AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - taken_before)
               / ((SELECT sum(weight) FROM w) - weight_before) AS level FROM b),
t AS (SELECT source, source_size,
             coalesce(least(most, weight * (SELECT level FROM l WHERE level <= level_of ORDER BY level_of, level DESC LIMIT 1)), most) AS target
      FROM l),
r AS (SELECT d.doc_id, d.size, d.nth, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, ''))), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + floor((nth + 1)::DOUBLE * (rate - floor(rate)) + u) - floor(nth::DOUBLE * (rate - floor(rate)) + u)))::BIGINT AS taken
FROM r
"""
