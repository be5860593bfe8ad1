"""Keyed tables that streams and batch jobs write to: the latest row of a key wins, deletions are rows too.

A write is a folder of Parquet under its source and batch number, and writing it again replaces it, so a replayed micro-batch changes nothing. Which row
of a key is the latest follows from the rows alone (the first column of `order`, then deletions before values, then the other columns), not from the order of writes, so any split of
the input into batches gives the same table. Reads take the latest row of each key by one aggregation with partial sums.

`compact` folds all writes into one of a new generation, which readers take up when it is marked as done; a compaction that broke off is never seen. Deletions stay in it
unless the caller says that nothing older than them can still arrive. No write may run beside a compaction.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedTable:
    """Rows of `schema` (DDL) by `keys`, in a folder that all machines share; the latest of a key by `order`."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], order: list[str]):
        self.spark, self.root, self.keys, self.order = spark, root.rstrip("/"), keys, order
        self.schema = T.StructType.fromDDL(schema)
        self.columns = self.schema.fieldNames()
        self.stored = T.StructType([*self.schema.fields, T.StructField("deleted", T.BooleanType())])
        # the folders exist from the start, so a table without writes reads as empty
        spark.createDataFrame([], "generation int").write.mode("ignore").parquet(f"{self.root}/done")
        spark.createDataFrame([], self.stored).write.mode("ignore").parquet(self._path(0, "none", 0))

    def _path(self, generation: int, source: str, batch: int) -> str:
        return f"{self.root}/generation={generation}/source={source}/batch={batch}"

    def _generation(self) -> int:
        """The last generation that is done, 0 before the first compaction."""
        return self.spark.read.schema("generation int").parquet(f"{self.root}/done").agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]

    def _latest(self) -> DataFrame:
        rows = self.spark.read.schema(self.stored).parquet(f"{self.root}/generation={self._generation()}").select(*self.stored.fieldNames())
        first, *others = self.order
        last = F.max_by(F.struct(*[c for c in self.stored.fieldNames() if c not in self.keys]), F.struct(first, "deleted", *others))
        return rows.groupBy(*self.keys).agg(last.alias("last")).select(*self.keys, "last.*")

    def write(self, rows: DataFrame, source: str, batch: int = 0, deleted: bool = False) -> None:
        """Rows of the schema's columns under a source's batch number; they replace what stands there."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(deleted).alias("deleted"))
        rows.write.mode("overwrite").parquet(self._path(self._generation(), source, batch))

    def current(self) -> DataFrame:
        """The live row of each key; filters on keys reach the scan."""
        return self._latest().where("NOT deleted").select(*self.columns)

    def delete(self, keys: DataFrame | None = None, where: Column | None = None, source: str | None = None, batch: int = 0) -> int:
        """Delete live rows that agree with a row of `keys` in its key columns (all without keys) and with `where`; how many. If keys hold the first column of
        the order, rows later than that stay, and rows up to it that arrive later stay deleted."""
        hit = self.current() if where is None else self.current().where(where)
        if keys is not None:
            by, first = [c for c in keys.columns if c in self.keys], self.order[0]
            if first in keys.columns:
                limit = keys.groupBy(*by).agg(F.max(first).cast(self.schema[first].dataType).alias("_limit"))
                hit = hit.join(limit, by).where(F.col(first) <= F.col("_limit")).withColumn(first, F.col("_limit"))
            else:
                hit = hit.join(keys.select(*by).distinct(), by, "left_semi")
        source = source or f"delete-{uuid.uuid4().hex}"
        self.write(hit, source, batch, deleted=True)
        return self.written(source, batch)

    def written(self, source: str, batch: int = 0) -> int:
        """How many rows a write has left."""
        return self.spark.read.schema(self.stored).parquet(self._path(self._generation(), source, batch)).count()

    def compact(self, needed: Column | None = None) -> None:
        """Fold all writes into one of the next generation; deletions for which `needed` (over the row's columns) isn't true go."""
        rows = self._latest() if needed is None else self._latest().where(~F.col("deleted") | needed)
        after = self._generation() + 1
        rows.select(*self.stored.fieldNames()).write.mode("overwrite").parquet(self._path(after, "compacted", 0))
        self.spark.createDataFrame([(after,)], "generation int").write.mode("append").parquet(f"{self.root}/done")


class MetricStore(KeyedTable):
    """The last report of each metric and scope."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, "metric_key string, scope_type string, scope_id long, payload string, created_at timestamp, event_id long", ["metric_key", "scope_type", "scope_id"], ["created_at", "event_id"])

    def put(self, reports: DataFrame, source: str | None = None, batch: int = 0) -> None:
        """Reports (metric_key, scope_id, payload, created_at, and where they have them scope_type and event_id): a later one of a key replaces an earlier one."""
        given = {"scope_type": F.lit("lesson"), "event_id": F.lit(0)}
        self.write(reports.withColumns({c: v for c, v in given.items() if c not in reports.columns}), source or f"put-{uuid.uuid4().hex}", batch)

    def get(self, metric_key: str, scope_id: int, scope_type: str = "lesson") -> DataFrame:
        """(payload, created_at) of one report; no row where there is none or its payload is no JSON."""
        one = self.current().where((F.col("metric_key") == metric_key) & (F.col("scope_id") == scope_id) & (F.col("scope_type") == scope_type))
        return one.where(F.try_parse_json("payload").isNotNull()).select("payload", "created_at")

    def for_lessons(self, lessons: DataFrame) -> DataFrame:
        """(lesson_id, metric_key, payload, created_at) of every report of the lessons (lesson_id) that is JSON."""
        reports = self.current().where((F.col("scope_type") == "lesson") & F.try_parse_json("payload").isNotNull()).withColumnRenamed("scope_id", "lesson_id")
        return reports.join(lessons.select("lesson_id").distinct(), "lesson_id", "left_semi").select("lesson_id", "metric_key", "payload", "created_at")

    def invalidate_lessons(self, lessons: DataFrame, metric_key: str | None = None, **kept) -> int:
        """Drop the reports of lessons (lesson_id, optionally created_at: as of then), of one metric or of all."""
        where = F.col("scope_type") == "lesson"
        return self.delete(lessons.withColumnRenamed("lesson_id", "scope_id"), where if metric_key is None else where & (F.col("metric_key") == metric_key), **kept)

    def invalidate_questions(self, changed: DataFrame, questions: DataFrame, **kept) -> int:
        """Drop the reports of the lessons that own a changed question: its primary and its secondary one. changed (question_id, optionally created_at)."""
        both = F.explode(F.array("primary_lesson_id", "secondary_lesson_id")).alias("lesson_id")
        own = questions.select("question_id", both).where("lesson_id IS NOT NULL")
        return self.invalidate_lessons(changed.join(own, "question_id").drop("question_id"), **kept)

    def clear(self) -> int:
        """Drop every report."""
        return self.delete()
