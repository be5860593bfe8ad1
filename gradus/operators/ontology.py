"""A knowledge base of triples from the tables of a course, kept in a folder for each predicate.

Every table is read once for all the facts of its rows. Subjects are kinds with ids, so equal titles are not one node. A triple pattern names its predicate, so a
query reads the folders of its own predicates alone (partition pruning); the patterns join on what they share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators import vocabulary as V
from gradus.operators.graph import facts

#: Characters of a content and of a question's label.
CONTENT, LABEL = 500, 100


def _of(df: DataFrame, name: str) -> Column:
    """A column as text, null where the table has none; empty texts are no facts."""
    return F.nullif(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def node(kind: str, id_: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), id_.cast("string"))


def _each(df: DataFrame, subject: Column, name: str, predicate: str) -> list[DataFrame]:
    """A fact for each entry of an array column, if there is one."""
    if name not in df.columns:
        return []
    return [df.select(subject.alias("s"), F.lit(predicate).alias("p"), F.explode(name).alias("o"), F.lit(False).alias("node")).where("o <> ''")]


def _link(child: DataFrame, parent: DataFrame, key: str, subject: str, predicate: str, object_: str, id_: str) -> DataFrame:
    """(subject of the parent) predicate (child) for children whose parent exists."""
    known = child.join(parent.select(key).distinct(), key, "left_semi")
    return known.select(node(subject, F.col(key)).alias("s"), F.lit(predicate).alias("p"), node(object_, F.col(id_)).alias("o"), F.lit(True).alias("node"))


def knowledge_base(courses: DataFrame, lessons: DataFrame, sections: DataFrame, objects: DataFrame, edges: DataFrame, questions: DataFrame, quizzes: DataFrame, date: str | None = None) -> DataFrame:
    """(s, p, o, node) of courses (course_id, name, ...), lessons (lesson_id, course_id, title, ...), sections (section_id, lesson_id, title, ...), objects (lo_id, section_id, title, object_type,
    ...), edges (source_id, target_id, relationship_type), questions (question_id, question_text, solo_level, ...) and quizzes (quiz_id, title, ...). Further columns that
    have facts (code, description, summary, filename, order_index, content, start_page, end_page, key_points, keywords, question_type, bloom_level, difficulty,
    learning_object_id, course_id of quizzes) may lack. What refers to a row that isn't there is left out; node tells whether the object is a subject or an individual."""
    dated = {"date": F.lit(date)} if date else {}
    text = lambda df, **named: {p: _of(df, c) for p, c in named.items()}
    cut = lambda c: F.substring(c, 1, CONTENT)
    s = {k: node(k, F.col(i)) for k, i in (("course", "course_id"), ("lesson", "lesson_id"), ("section", "section_id"), ("lo", "lo_id"), ("question", "question_id"), ("quiz", "quiz_id"))}
    asked = _of(questions, "question_text")
    label = F.when(F.length(asked) > LABEL, F.concat(F.substring(asked, 1, LABEL), F.lit("..."))).otherwise(asked)
    kind = V.question_class(F.coalesce(_of(questions, "question_type"), F.lit("short_answer")))
    parts = [
        facts(courses, s["course"], {"type": F.lit("Course"), **text(courses, label="name", courseCode="code", comment="description"), **dated}, {}),
        facts(lessons, s["lesson"], {"type": F.lit("Lesson"), **text(lessons, label="title", comment="summary", filename="filename", orderIndex="order_index"), **dated}, {}),
        facts(sections, s["section"], {"type": F.lit("Section"), "hasContent": cut(_of(sections, "content")), **text(sections, label="title", comment="summary", startPage="start_page", endPage="end_page", orderIndex="order_index"), **dated}, {}),
        facts(objects, s["lo"], {"type": V.object_class(F.coalesce(_of(objects, "object_type"), F.lit("definition"))), "hasContent": cut(_of(objects, "content")), **text(objects, label="title", comment="description", orderIndex="order_index"), **dated}, {}),
        *_each(objects, s["lo"], "key_points", "hasKeyPoint"), *_each(objects, s["lo"], "keywords", "hasKeyword"),
        facts(questions, s["question"], {"type": kind, "label": label, "questionText": asked, **text(questions, difficulty="difficulty"), **dated}, {"hasSOLOLevel": F.when(_of(questions, "solo_level").isNotNull(), V.solo(_of(questions, "solo_level"))), "hasBloomLevel": V.bloom(_of(questions, "bloom_level"))}),
        facts(quizzes, s["quiz"], {"type": F.lit("Quiz"), **text(quizzes, label="title", comment="description"), **dated}, {}),
        _link(lessons, courses, "course_id", "course", "hasLesson", "lesson", "lesson_id"),
        _link(sections, lessons, "lesson_id", "lesson", "hasSection", "section", "section_id"),
        _link(objects, sections, "section_id", "section", "containsLearningObject", "lo", "lo_id"),
    ]
    ids = objects.select(F.col("lo_id").alias("_lo")).distinct()
    inner = edges.join(ids, edges["source_id"] == ids["_lo"], "left_semi").join(ids, edges["target_id"] == ids["_lo"], "left_semi")
    told = F.coalesce(_of(edges, "description"), F.concat(F.lit("Relationship: "), "relationship_type"))
    parts.append(inner.select(node("lo", F.col("source_id")).alias("s"), F.explode(F.array(
        F.struct(V.relation(F.col("relationship_type")).alias("p"), node("lo", F.col("target_id")).alias("o"), F.lit(True).alias("node")), F.struct(F.lit("comment").alias("p"), told.alias("o"), F.lit(False).alias("node")),
    )).alias("f")).select("s", "f.*"))
    if "learning_object_id" in questions.columns:
        about = questions.join(ids, questions["learning_object_id"] == ids["_lo"], "left_semi")
        parts.append(about.select(s["question"].alias("s"), F.lit("assessesLearningObject").alias("p"), node("lo", F.col("learning_object_id")).alias("o"), F.lit(True).alias("node")))
    if "course_id" in quizzes.columns:
        about = quizzes.join(courses.select("course_id").distinct(), "course_id", "left_semi")
        parts.append(about.select(s["quiz"].alias("s"), F.lit("assessesCourse").alias("p"), s["course"].alias("o"), F.lit(True).alias("node")))
    return reduce(DataFrame.unionByName, parts).select("s", "p", "o", "node").distinct()


def store(triples: DataFrame, path: str) -> DataFrame:
    """Write triples with a folder for each predicate, each by one shuffle on predicate and subject, and read them again."""
    salted = triples.repartition("p", F.pmod(F.xxhash64("s"), F.lit(64)))
    salted.write.mode("overwrite").partitionBy("p").parquet(path)
    return stored(triples.sparkSession, path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("s string, o string, node boolean, p string").parquet(path).select("s", "p", "o", "node")
