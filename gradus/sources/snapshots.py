"""Snapshots of a corpus: tables, reports of metrics, and a manifest that publishes them.

A snapshot is written into a folder of its own under its label, and the manifest, one small file, is written last; readers start from the manifest. So a snapshot that is half written, or
written anew, is never seen: the last manifest of a label says which folder holds it. Tables are Parquet, reports JSON text in a folder for each metric.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gradus.streaming.keyed import MetricStore

MANIFEST = "label string, created_at timestamp, generator_model string, notes string, table_counts map<string, long>, validation_keys array<string>, env map<string, string>, version string"
#: Metrics whose report has an entry for each lesson, and metrics with one report for the corpus.
PER_LESSON = ["coverage", "misconception_mining"]
CORPUS_WIDE = ["lint", "solo_judge", "cove", "solvability", "stem_only", "ioc", "ambiguity", "readability", "grammar_homogeneity", "face_validity"]
_EMPTY = ["{}", "[]", "null", "0", '""', "false"]


@dataclass
class Snapshot:
    """A published snapshot."""

    spark: SparkSession
    folder: str
    manifest: Row

    def table(self, name: str) -> DataFrame:
        if name not in self.manifest["table_counts"]:
            raise KeyError(f"snapshot {self.manifest['label']} has no table {name}")
        return self.spark.read.parquet(f"{self.folder}/tables/{name}")

    def metrics(self) -> DataFrame:
        """(metric_key, payload) of all reports; none is no error."""
        if not self.manifest["validation_keys"]:
            return self.spark.createDataFrame([], "metric_key string, payload string")
        return self.spark.read.schema("payload string, metric_key string").text(f"{self.folder}/validation", wholetext=True).select("metric_key", F.regexp_replace("payload", r"\n$", "").alias("payload"))

    def counts(self) -> DataFrame:
        """(name, n) of its tables, from the manifest."""
        return self.spark.createDataFrame(sorted(self.manifest["table_counts"].items()), "name string, n long")


def write(spark: SparkSession, root: str, label: str, tables: dict[str, DataFrame], metrics: DataFrame | None = None, model: str | None = None, notes: str | None = None, env: dict[str, str] | None = None) -> Snapshot:
    """Write and publish a snapshot. metrics (metric_key, payload): a report for each metric. Counts are those of what was written."""
    version = uuid.uuid4().hex
    folder = f"{root}/{label}/version-{version}"
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/tables/{name}")
        counts[name] = spark.read.parquet(f"{folder}/tables/{name}").count()
    keys: list[str] = []
    if metrics is not None:
        metrics.select("metric_key", F.col("payload").alias("value")).repartition("metric_key").write.partitionBy("metric_key").text(f"{folder}/validation")
        listed = metrics.agg(F.sort_array(F.collect_set("metric_key")).alias("k")).first()["k"]  # a report a metric
        keys = list(listed)
    row = spark.createDataFrame([(label, model, notes, counts, keys, env or {}, version)], "label string, generator_model string, notes string, table_counts map<string, long>, validation_keys array<string>, env map<string, string>, version string")
    row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{root}/{label}/manifests")
    return read(spark, root, label)


def read(spark: SparkSession, root: str, label: str) -> Snapshot:
    """The snapshot that was published last under the label; FileNotFoundError if none was."""
    try:
        last = spark.read.schema(MANIFEST).json(f"{root}/{label}/manifests").orderBy(F.desc("created_at")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        raise FileNotFoundError(f"no snapshot {label} in {root}")
    return Snapshot(spark, f"{root}/{label}/version-{last['version']}", last)


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """(metric_key, payload) of a folder with a file <metric>.json for each report, as other tools write them."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    return files.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("metric_key"), F.col("value").alias("payload"))


def lesson_reports(metrics: DataFrame, lessons: DataFrame, per_lesson: list[str] | None = None, corpus_wide: list[str] | None = None) -> DataFrame:
    """(metric_key, scope_id, payload): reports as lessons (lesson_id) have them. A report with an entry for each lesson gives each its own; entries whose key is no number go. A
    report of the corpus goes to every lesson. Metrics in neither list go."""
    per_lesson, corpus_wide = per_lesson or PER_LESSON, corpus_wide or CORPUS_WIDE
    entries = metrics.where(F.col("metric_key").isin(per_lesson)).select("metric_key", F.explode(F.from_json("payload", "map<string, string>")).alias("k", "payload"))
    own = entries.select("metric_key", F.expr("try_cast(trim(k) AS bigint)").alias("scope_id"), "payload").where("scope_id IS NOT NULL")
    # one row for each of the listed metrics, however many metrics there are
    whole = metrics.where(F.col("metric_key").isin(corpus_wide)).groupBy("metric_key").agg(F.max("payload").alias("payload"))
    spread = lessons.select(F.col("lesson_id").cast("long").alias("scope_id")).distinct().crossJoin(F.broadcast(whole))
    return own.unionByName(spread.select("metric_key", "scope_id", "payload"))


def hydrate(store: MetricStore, reports: DataFrame, created_at: Column, overwrite: bool = False, source: str | None = None) -> tuple[int, int]:
    """Put reports (metric_key, scope_id, payload) into a store as of created_at; how many were written and skipped. What a lesson has already stays unless
    overwrite is set; an empty report, or one that is no JSON, counts as none."""
    live = store.current().where((F.col("scope_type") == "lesson") & F.try_parse_json("payload").isNotNull() & ~F.trim("payload").isin(_EMPTY)).select("metric_key", "scope_id")
    new = reports if overwrite else reports.join(live, ["metric_key", "scope_id"], "left_anti")
    source = source or f"hydrate-{uuid.uuid4().hex}"
    total = reports.count()
    store.put(new.withColumn("created_at", created_at), source)
    written = store.written(source)
    return written, total - written
