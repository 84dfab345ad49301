"""Intermediate tables in the folder that driver and executors share.

Iterative and multi-pass operators cut their lineage by writing a table and
reading it back, so a lost executor costs a re-read and not a re-run.  The place
is ``spark.checkpoint.dir``; a local session without one (tests, notebooks) gets a
temporary folder, a cluster without one is refused, as its executors couldn't read it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark keeps shuffle files until the driver's garbage collector meets the
#: query that made them; with this they go when the table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Texts and sets are long rows: fewer at a time bound what a Python worker holds.
ROWS, AT_A_TIME = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_500


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, set for the session only if unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-linespan-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """A folder of written tables that belong to one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: set[str] = set()

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        """Write df and return the table as read back."""
        conf = self.spark.conf
        before = {CLEANUP: conf.get(CLEANUP, "false"), ROWS: conf.get(ROWS)}
        conf.set(CLEANUP, "true")
        conf.set(ROWS, str(min(AT_A_TIME, int(before[ROWS])) if int(before[ROWS]) > 0 else AT_A_TIME))
        try:
            self.tables.add(table)
            df.write.mode("overwrite").parquet(self.path(table))
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Remove tables that no later step reads."""
        for t in tables:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(t))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            self.tables.discard(t)

    def drop_all_but(self, *tables: str) -> None:
        self.drop(*(self.tables - set(tables)))
