"""Queries of streams (ST*), order-dependent builders and injected functions (W9, W10, X9, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.operators import injected as U
from gradus.operators import sequences as Q
from gradus.sources.fixtures import Fixtures
from gradus.sources.io import fresh, saved
from gradus.streaming import jobs as J
from gradus.streaming.keyed import MetricStore
from gradus.streaming.questions import QuestionIndex, keep_unique

from .metrics import ITEM, PLABEL
from .registry import query


class Live(Fixtures):
    """The same shapes over streams."""

    def table(self, name: str):
        return J.read(self.spark, f"{self.dir}/{name}.parquet")


def live(fx: Fixtures) -> Live:
    return Live(fx.spark, fx.dir)


@query("ST1_stream_item_difficulty", f"SELECT question_id, usable, round(p, 3) AS p_value, {PLABEL} AS label FROM {ITEM}")
def stream_item_difficulty(fx):
    table = J.difficulty_table(fx.spark, fresh(fx.spark, "st1"))
    J.merge(J.item_difficulty(live(fx).trials), table, "trials", "update")
    return table.current().select("question_id", "usable", "p_value", "label")


@query("ST1_progress_report", f"""SELECT count(*) AS total_questions, count(*) FILTER (trials >= planned) AS completed_questions, count(p) AS solvable_questions, round(avg(round(p, 3)::DECIMAL(10, 3)), 3) AS mean_p_value,
  {", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in ("trivially_easy", "appropriate", "hard", "too_hard_or_misframed"))}, count(*) FILTER (trials >= planned) < count(*) AS partial
  FROM (SELECT *, {PLABEL} AS label FROM {ITEM} JOIN (SELECT question_id, count(*) AS trials FROM trials GROUP BY 1) USING (question_id)) CROSS JOIN (SELECT quantile_disc(n, 0.5) AS planned FROM (SELECT count(*) AS n FROM trials GROUP BY question_id))""")
def progress_report(fx):
    """The report of a stream of trials where each question shall have as many trials as the median question has."""
    table = J.difficulty_table(fx.spark, fresh(fx.spark, "st1"))
    J.merge(J.item_difficulty(live(fx).trials), table, "trials", "update")
    counts = fx.trials.groupBy("question_id").agg(F.count("*").alias("n"))
    median = counts.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").alias("trials"))
    return J.difficulty_report(table.current(), counts.select("question_id").crossJoin(F.broadcast(median)))


@query("ST2_stream_spend", "SELECT strftime(ts, '%Y-%m-%d') AS day, provider, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS calls FROM call_log GROUP BY 1, 2")
def stream_spend(fx):
    log = live(fx).call_log.withColumn("ts", F.col("ts").cast("timestamp"))
    return J.drain(J.spend(log), "complete", "st2")


@query("ST2_stream_spend_sliding", """SELECT strftime(w, '%Y-%m-%d') AS day, provider, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS calls
  FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) - INTERVAL 2 DAY]) AS w FROM call_log) GROUP BY 1, 2""")
def stream_spend_sliding(fx):
    log = live(fx).call_log.withColumn("ts", F.col("ts").cast("timestamp"))
    return J.drain(J.spend(log, "3 days", slide="1 day"), "complete", "st2s")


@query("ST3_stream_metric_upsert", "SELECT metric_key, scope_id, arg_max(event_id, (created_at, event_id)) AS event_id FROM metric_payloads GROUP BY 1, 2")
def stream_metric_upsert(fx):
    store = MetricStore(fx.spark, fresh(fx.spark, "st3"))
    J.store_reports(live(fx).metric_payloads, store)
    return store.current().select("metric_key", "scope_id", "event_id")


@query("D11_store_invalidated", """SELECT metric_key, scope_id, arg_max(event_id, (created_at, event_id)) AS event_id FROM metric_payloads
  LEFT JOIN (SELECT scope_id, max(created_at) AS gone FROM metric_payloads WHERE metric_key = 'error' GROUP BY 1) USING (scope_id) WHERE gone IS NULL OR created_at > gone GROUP BY 1, 2""")
def store_invalidated(fx):
    """Reports are put, then those of each lesson up to its last error are dropped."""
    store = MetricStore(fx.spark, fresh(fx.spark, "d11"))
    store.put(fx.metric_payloads)
    failed = fx.metric_payloads.where("metric_key = 'error'").groupBy(F.col("scope_id").alias("lesson_id")).agg(F.max("created_at").alias("created_at"))
    store.invalidate_lessons(failed)
    store.compact()
    return store.current().select("metric_key", "scope_id", "event_id")


@query("ST4_stream_question_dedup", "SELECT provider, count(*) AS n FROM (SELECT DISTINCT provider, input_tokens FROM call_log) GROUP BY 1")
def stream_question_dedup(fx):
    log = live(fx).call_log.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("key", F.concat_ws("-", "provider", "input_tokens"))
    return J.drain(J.distinct_keys(log, "key", "ts"), "append", "st4").groupBy("provider").agg(F.count("*").alias("n"))


@query("ST4_stream_question_unique")
def stream_question_unique(fx):
    """The bank's questions in three deliveries, each taken up by a run that resumes the last. Rounds of decisions can't be written as SQL; tests hold it against a loop."""
    spark, root = fx.spark, fresh(fx.spark, "st4")
    q = saved(fx.questions.select("question_id", "question_text", "correct_answer", "learning_object_id", "question_section_id"), "st4-questions")
    cuts = q.approxQuantile("question_id", [1 / 3, 2 / 3], 0.01)
    index = QuestionIndex(spark, f"{root}/index")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = q if low is None else q.where(F.col("question_id") > low)
        (part if high is None else part.where(F.col("question_id") <= high)).write.mode("append").parquet(f"{root}/in")
        keep_unique(spark.readStream.schema(q.schema).parquet(f"{root}/in"), index, f"{root}/state")
    return index.kept().select(F.col("id").alias("question_id"))


@query("ST5_stream_attempt_sessions", """SELECT user_id, min(epoch_us(ts)) AS started, count(*) AS n, count(*) FILTER (answer = item % 4) AS good FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
  (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM attempts)) GROUP BY user_id, s""")
def stream_attempt_sessions(fx):
    return J.drain(J.sessions(live(fx).attempts.withColumn("ts", F.col("ts").cast("timestamp"))), "complete", "st5")


@query("W9_section_batches")
def section_batches(fx):
    return Q.section_batches(fx.sections.select("lesson_id", "section_id", "order_index", (F.col("section_id") % 17).alias("n")))


@query("W10_chunk_text")
def chunk_text(fx):
    return Q.chunk_text(fx.lessons, "lesson_id", "raw_content")


@query("X9_title_variants")
def title_variants(fx):
    return fx.sections.select("section_id", F.array_join(Q.title_variants(F.col("title")), "|").alias("variants"))


@query("U1_with_embeddings", "SELECT doc_id, vec_id IS NOT NULL AS found FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def with_embeddings(fx):
    vectors = fx.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return U.with_embeddings(fx.documents.select("doc_id", "text"), "doc_id", "text", vectors).select("doc_id", F.col("vector").isNotNull().alias("found"))


def sizes(texts):
    """A function of the caller in place of a model: a text's length and its number of blanks."""
    return texts.map(lambda t: [float(len(t)), float(t.count(" "))] if t is not None else None)


@query("U1_with_function", "SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM documents")
def with_function(fx):
    v = U.with_embeddings(fx.documents.select("doc_id", "text"), "doc_id", "text", fn=sizes)
    return v.select("doc_id", F.get("vector", F.lit(0)).cast("double").alias("chars"), F.get("vector", F.lit(1)).cast("double").alias("blanks"))


def echo(prompts):
    """A function of the caller in place of a model: the last ten characters."""
    return [None if p is None else p[-10:] for p in prompts]


@query("U2_with_asked", "SELECT doc_id, right(text, 10) AS response FROM documents")
def with_asked(fx):
    return U.with_responses(fx.documents.select("doc_id", F.col("text").alias("prompt")), "doc_id", "prompt", fn=echo).select("doc_id", "response")


@query("U2_with_responses", "SELECT d.doc_id, r.question_id IS NOT NULL AS found FROM documents d LEFT JOIN raw_responses r ON r.question_id = d.doc_id")
def with_responses(fx):
    stored = fx.raw_responses.select(F.col("question_id").alias("doc_id"), "response")
    return U.with_responses(fx.documents.select("doc_id", F.col("text").alias("prompt")), "doc_id", "prompt", stored).select("doc_id", F.col("response").isNotNull().alias("found"))


@query("U3_nfkc")
def nfkc(fx):
    return fx.documents.select("doc_id", F.md5(Q.nfkc(F.col("text"))).alias("normal"))
