"""Streams over growing tables. Each returns a streaming DataFrame; `drain` and `merge` run one over what is there, from where its last run stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradus.functions.responses import solvability_label
from gradus.sources.io import fresh

from .keyed import KeyedTable, MetricStore


def read(spark: SparkSession, path: str, files: int = 1_000) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream of at most `files` new files a batch."""
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    first = table.select("_metadata.file_path").first()
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
    if first is not None and first[0].rstrip("/").endswith(f"/{name}"):
        return stream.option("pathGlobFilter", name).option("recursiveFileLookup", True).parquet(folder)
    return stream.parquet(path)


def finish(df: DataFrame, mode: str, each: Callable[[DataFrame, int], None], state: str) -> StreamingQuery:
    """Run over all available input, from where the last run with this `state` folder stopped; each(rows, batch) takes a batch, again after a failure."""
    q = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def late_rows(q: StreamingQuery) -> int:
    """Rows that a finished query's stateful operators dropped because they came behind the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])


def drain(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Run over all available input, writing each batch to the shared folder; in complete mode the last batch is the result."""
    spark = df.sparkSession
    root = fresh(spark, name)
    finish(df, mode, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{root}/out/batch={batch}"), f"{root}/state")
    out = spark.read.schema(df.schema.add("batch", "long")).parquet(f"{root}/out")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("last"))
        out = out.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("last")
    return out.drop("batch")


def merge(df: DataFrame, table: KeyedTable, name: str, mode: str = "append", compact_every: int = 100) -> StreamingQuery:
    """Merge a stream into a keyed table under `name`, where the last run under that name stopped. A stream that counts its own batches has the column `version` added.
    Every compact_every batches the table is compacted."""

    def each(rows: DataFrame, batch: int) -> None:
        table.write(rows.withColumn("version", F.lit(batch)) if "version" in table.columns else rows, name, batch)
        if batch % compact_every == compact_every - 1:
            table.compact()

    return finish(df, mode, each, f"{table.root}/state/{name}")


def item_difficulty(trials: DataFrame) -> DataFrame:
    """Running difficulty of each question (complete or update mode)."""
    t = trials.groupBy("question_id").agg(F.count("*").alias("trials"), F.count_if(~F.col("parse_failure")).alias("usable"), F.count_if(F.col("correct") & ~F.col("parse_failure")).alias("n_correct"))
    p = F.col("n_correct") / F.nullif("usable", F.lit(0))
    return t.select("question_id", "trials", "usable", F.round(p, 3).alias("p_value"), solvability_label(p).alias("label"))


def difficulty_table(spark: SparkSession, root: str) -> KeyedTable:
    """The last difficulty of each question, as batches of `item_difficulty` in update mode have left it."""
    return KeyedTable(spark, root, "question_id long, trials long, usable long, p_value double, label string, version long", ["question_id"], ["version"])


def difficulty_report(table: DataFrame, planned: DataFrame) -> DataFrame:
    """One row: questions planned, those with all their trials, those with a p-value, the mean p-value, questions of each label, and whether trials are still to
    come. planned (question_id, trials): how many trials each question shall have."""
    t = planned.select("question_id", F.col("trials").alias("planned")).join(table, "question_id", "left")
    labels = ("trivially_easy", "appropriate", "hard", "too_hard_or_misframed")
    done = F.count_if(F.coalesce("trials", F.lit(0)) >= F.col("planned"))
    return t.agg(
        F.count("*").alias("total_questions"), done.alias("completed_questions"), F.count("p_value").alias("solvable_questions"), F.round(F.avg(F.col("p_value").cast("decimal(10,3)")).cast("double"), 3).alias("mean_p_value"),
        *[F.count_if(F.col("label") == x).alias(x) for x in labels], (done < F.count("*")).alias("partial"),
    )


def spend(calls: DataFrame, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Tokens and calls of each provider and window, tumbling or sliding; rows further behind than `late` are dropped once a batch has moved the watermark."""
    w = calls.withWatermark("ts", late).groupBy(F.window("ts", width, slide or width).alias("w"), "provider")
    return w.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "provider", "input_tokens", "output_tokens", "calls")


def store_reports(payloads: DataFrame, store: MetricStore, name: str = "reports", compact_every: int = 100) -> StreamingQuery:
    """Put a stream of reports into a store, the last of each metric and scope."""
    return merge(payloads.withColumn("scope_type", F.lit("lesson")), store, name, compact_every=compact_every)


def distinct_keys(rows: DataFrame, key: str, time: str, late: str = "3650 days") -> DataFrame:
    """The first row of each key within the watermark (append mode)."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sessions(attempts: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Attempts of each user in sessions that end after a gap."""
    s = attempts.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("answer") == F.col("item") % 4).alias("good")).select("user_id", F.unix_micros("w.start").alias("started"), "n", "good")
