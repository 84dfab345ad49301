"""What a job leaves behind: results, sources, usage records, exports; written by Spark.

Every writer adds or replaces whole partitions or appends files, so Spark's commit
makes a result visible at once or not at all.  Many small results share their files.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.jobs import has_control_chars, has_dot_dot
from .operators.ordered import before

MANIFEST = "path string, size bigint, mtime_ms double, ts timestamp, result_id string"


def write_results(results: DataFrame, path: str) -> None:
    """Results (result_id, n, text), a partition each; writing an id again replaces that id alone.
    Rows of one result go to as many tasks as they need, not to one."""
    writer = results.write.mode("overwrite").partitionBy("result_id").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_result(spark: SparkSession, path: str, result_id: str, first: int = 1, last: int = 2**31 - 1) -> DataFrame:
    """Lines of one result: only its partition is read."""
    return spark.read.parquet(path).where((F.col("result_id") == result_id) & F.col("n").between(first, last))


def sources_to_keep(files: DataFrame, mode: Column) -> DataFrame:
    """Sources whose copy a result keeps: of urls, of formats other than text, and all in schema mode."""
    return files.where((F.col("kind") == "url") | (F.col("format") != "text") | (mode == "schema"))


def source_index(files: DataFrame) -> DataFrame:
    """Kept files (result_id, at, name, kind, path, format, bytes, sha256, lines) with `n`, their number in the result
    from 1 in the order of at; sha256 is that of the file's bytes, lines the number of its lines."""
    numbered = before(files, ["result_id"], ["at"], {"n": F.lit(1).cast("long")})
    return numbered.select("result_id", (F.col("n") + 1).alias("n"), "name", "kind", "path", "format", "bytes", "sha256", "lines")


def write_sources(copies: DataFrame, index: DataFrame, path: str) -> None:
    """Numbered copies (result_id, n, at, side, text) of kept sources with their markers, and their index, under a folder.

    Each call is a batch, a partition with as many files as there are tasks, however many results it has; in each file a
    result's rows lie together.  The index comes last and names a result's batch: writing a result again replaces
    that result alone, and a batch without its index counts for nothing."""
    batch = F.lit(time.time_ns())
    for rows, name, order in ((copies, "copies", ("result_id", "n", "at", "side")), (index, "index", ("result_id", "n"))):
        rows.withColumn("batch", batch).sortWithinPartitions(*order).write.mode("append").partitionBy("batch").parquet(f"{path}/{name}")


def read_sources_index(spark: SparkSession, path: str, result_id: str | int | None = None) -> DataFrame:
    """The index of one result's kept sources, or of all, with the batch that has each result's copies."""
    index = spark.read.parquet(f"{path}/index").withColumn("batch", F.col("batch").cast("long"))
    index = index if result_id is None else index.where(F.col("result_id") == result_id)
    last = index.groupBy("result_id").agg(F.max("batch").alias("batch"))
    return index.join(last, ["result_id", "batch"], "left_semi")


def read_copies(spark: SparkSession, path: str) -> DataFrame:
    """The copies of all batches; those of a result's batch in the index count."""
    return spark.read.parquet(f"{path}/copies").withColumn("batch", F.col("batch").cast("long"))


def read_source(spark: SparkSession, path: str, result_id: str | int, n: int, first: int = 1, last: int = 2**31 - 1) -> DataFrame:
    """Lines first to last of one kept source, markers with the line ahead of which they stand; by the files' statistics little else is read."""
    rows = read_copies(spark, path).where((F.col("result_id") == result_id) & (F.col("n") == n))
    batch = read_sources_index(spark, path, result_id).select("batch").distinct()
    rows = rows.join(F.broadcast(batch), "batch", "left_semi")
    return rows.where(F.col("at").between(first, last) | ((F.col("side") == 1) & F.col("at").between(first - 1, last - 1)))


def append_usage(records: DataFrame, path: str) -> None:
    """Usage records as JSON lines, added to those that are there."""
    records.write.mode("append").json(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each path."""
    rows = spark.read.schema(MANIFEST).json(path)
    return rows.groupBy("path").agg(F.max_by(F.struct("size", "mtime_ms", "ts", "result_id"), "ts").alias("s")).select("path", "s.*")


def plan_export(targets: DataFrame, there: DataFrame, manifest: DataFrame, roots: list[str], overwrite: bool = False) -> DataFrame:
    """targets (path, result_id) with `refused`, the first thing that speaks against each, or null.

    `there` has what is at the paths now (path, kind: file, dir or link).  An export is written
    only if no target is refused, and replaces only what was exported before."""
    df = targets.join(there, "path", "left").join(manifest.select("path").distinct().withColumn("ours", F.lit(True)), "path", "left")
    inside = F.lit(False)
    for r in roots:
        inside = inside | F.col("path").startswith(r.rstrip("/") + "/")
    why = (
        F.when(F.lit(not roots), "export is off")
        .when(~F.col("path").startswith("/"), "not absolute")
        .when(has_control_chars(F.col("path")), "control characters")
        .when(has_dot_dot(F.col("path")), '".." segments')
        .when(~inside, "outside the roots")
        .when(F.col("kind") == "link", "a symlink")
        .when(F.col("kind").isNotNull() & (F.col("kind") != "file"), "not a file")
        .when(F.col("kind").isNotNull() & F.lit(not overwrite), "exists")
        .when(F.col("kind").isNotNull() & F.col("ours").isNull(), "exists and was not exported")
    )
    return df.select("path", "result_id", F.col("kind").isNotNull().alias("replaces"), why.alias("refused"))


def prune_exports(manifest: DataFrame, there: DataFrame, now: Column, retention_days: int) -> DataFrame:
    """manifest with `fate`: kept while young, deleted if size and time are still as written, else
    dropped from the manifest and left alone.  `there`: (path, kind, size, mtime_ms) as they are."""
    if retention_days <= 0:
        return manifest.withColumn("fate", F.lit("kept"))
    now_ = there.select("path", "kind", F.col("size").alias("_size"), F.col("mtime_ms").alias("_mtime"))
    same = (F.col("kind") == "file") & (F.col("_size") == F.col("size")) & (F.col("_mtime") == F.col("mtime_ms"))
    old = F.col("ts") < now - F.expr(f"INTERVAL {int(retention_days)} DAYS")
    fate = F.when(~F.coalesce(old, F.lit(False)), "kept").when(F.coalesce(same, F.lit(False)), "deleted").otherwise("dropped")
    return manifest.join(now_, "path", "left").select(*manifest.columns, fate.alias("fate"))
