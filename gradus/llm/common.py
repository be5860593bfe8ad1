"""Shared pieces: tables in the shared folder, and checks of a table's size before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table of narrow rows (at most 64 bytes each) is broadcast.
BROADCAST_ROWS = 50_000
#: Spark's own setting to remove the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the setting is missing and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gradus-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and lost executors cost nothing.

    Nothing needs the shuffle files of the query that wrote it, so Spark removes them as it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Empty the folders of tables that `saved` gave, once all that was computed from them is written down."""
    for df in tables:
        files = df.inputFiles()
        if files:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a saved table is counted at no more than rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(df: DataFrame, out: str = "_row") -> DataFrame:
    """df with all its columns in one struct `out`, so that an operator's own columns never clash with them."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias(out)) if df.columns else df.select(F.struct(F.lit(0)).alias(out))


def digest(*parts: Column) -> Column:
    """The first 16 bytes of the SHA-256 of the parts, each as text or bytes, one after the other."""
    return F.substring(F.unhex(F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)), F.lit(1), F.lit(16))
