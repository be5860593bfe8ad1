"""Reading and writing tables: triples, banks, CSV, and steps of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the setting is missing and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gradus-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_ntriples(triples: DataFrame, path: str) -> None:
    """(s, p, o) as N-Triples; o is an IRI where the column `node`, if there is one, says so or else where it names a subject (kind_number), and a literal elsewhere."""
    from gradus.functions.text import escape_literal

    node = lambda c: F.concat(F.lit("<urn:x:"), F.col(c), F.lit(">"))
    is_node = F.col("node") if "node" in triples.columns else F.col("o").rlike("^[a-z]+_[0-9]+$")
    value = F.when(is_node, node("o")).otherwise(F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"')))
    triples.select(F.concat_ws(" ", node("s"), node("p"), value, F.lit(".")).alias("value")).write.mode("overwrite").text(path)


#: Names of cognitive levels in the nested bank. Fixed values.
BLOOM = {"1": "Remember", "2": "Understand", "3": "Apply", "4": "Analyze"}
CHAPTER = """bname string, chapter string, questions array<struct<question: struct<question_id: long, normal_format: string, question_text: string, question_choices: array<string>>, answer: struct<ans_choice: int>,
  bloom: string, hl_context: string>>"""


def load_nested_bank(spark: SparkSession, splits: dict[str, str]) -> DataFrame:
    """JSON files of chapters with nested questions, a path for each split: a row for each question whose answer index is in range."""
    rows = None
    for split, path in splits.items():
        one = spark.read.schema(CHAPTER).json(path).select(F.lit(split).alias("split"), F.col("bname").alias("book"), "chapter", F.explode("questions").alias("q"))
        rows = one if rows is None else rows.unionByName(one)
    q, key = F.col("q.question"), F.col("q.answer.ans_choice")
    options = F.coalesce(q["question_choices"], F.array().cast("array<string>"))
    rows = rows.where(key.isNotNull() & (key >= 0) & (key < F.size(options)))
    text = F.coalesce(F.nullif(q["normal_format"], F.lit("")), q["question_text"])
    context = F.trim(F.regexp_replace(F.replace(F.coalesce("q.hl_context", F.lit("")), F.lit("<hl>"), F.lit(" ")), r"\s+", " "))
    bloom = F.element_at(F.create_map(*[F.lit(x) for kv in BLOOM.items() for x in kv]), F.col("q.bloom"))
    return rows.select(
        "split", "book", "chapter", q["question_id"].alias("question_id"), text.alias("question_text"), F.get(options, key).alias("correct_answer"), F.filter(options, lambda o, i: i != key).alias("distractors"),
        F.size(options).alias("n_options"), bloom.alias("bloom_name"), context.alias("context"),
    )


def write_nested_bank(chapters: DataFrame, path: str) -> None:
    chapters.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
