"""Concepts of learning objects, their weights in the relation graph, and their mentions in questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.text import normalize_concept, tokens

# Words that are no concept.
STOPWORDS = ["the", "and", "for", "with", "this", "that", "are", "can", "has", "sve", "jedan", "jedna", "jedno", "koji", "koja", "koje", "kao", "kada", "tako", "pri", "biti", "samo", "svaki", "svaka", "svako"]
LETTER = "[A-Za-zĐĆČŠŽđćčšž]"


def acceptable(c: Column) -> Column:
    """A normal form of three characters or more, with a letter, outside the stop list."""
    return (F.length(c) >= 3) & ~c.isin(STOPWORDS) & c.rlike(LETTER)


def extract(objects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, norm, display, lo_ids) from titles and keywords; the first display form stays."""
    keys = keys or []
    names = F.array_distinct(F.concat(F.array("title"), F.coalesce("keywords", F.array().cast("array<string>"))))
    rows = objects.select(*keys, "lo_id", F.posexplode(names).alias("pos", "display")).withColumn("norm", normalize_concept(F.col("display"))).where(acceptable(F.col("norm")))
    return rows.groupBy(*keys, "norm").agg(F.min_by("display", F.struct("lo_id", "pos")).alias("display"), F.sort_array(F.collect_set("lo_id")).alias("lo_ids"))


def degrees(edges: DataFrame) -> DataFrame:
    """(lo_id, degree), in and out."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("lo_id"))
    return ends.groupBy("lo_id").agg(F.count("*").alias("degree"))


def weights(concepts: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, norm, weight): 1 and the degrees of the concept's objects."""
    of = [*(keys or []), "norm"]
    lo = concepts.select(*of, F.explode("lo_ids").alias("lo_id"))
    return lo.join(degrees(edges), "lo_id", "left").groupBy(*of).agg((1 + F.coalesce(F.sum("degree"), F.lit(0))).alias("weight"))


def mentions(concepts: DataFrame, questions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, norm, question_id), of concepts and questions with equal keys: a phrase stands in the question's text as it is, a single word starts one of its words.

    Both mean that the concept's last word starts a word of the text. So words give away their beginnings of every length that a last word has, and concepts are
    met by their whole last word; phrases are then looked up in the text."""
    keys = keys or []
    text = F.concat_ws(" ", "question_text", "correct_answer", F.array_join("options", " "))
    q = questions.select(*keys, "question_id", normalize_concept(text).alias("blob"))
    c = concepts.select(*keys, "norm", F.element_at(F.split("norm", " "), -1).alias("last")).withColumn("phrase", F.contains("norm", F.lit(" ")))
    lengths = c.agg(F.sort_array(F.collect_set(F.length("last"))).alias("lengths"))
    words = q.select(*keys, "question_id", F.explode(F.array_distinct(tokens(F.col("blob")))).alias("w")).crossJoin(F.broadcast(lengths))
    starts = words.select(*keys, "question_id", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("w")), lambda n: F.substring(F.col("w"), F.lit(1), n))).alias("last"))
    met = starts.join(c, [*keys, "last"]).select(*keys, "norm", "question_id", "phrase").distinct()
    whole = met.where("phrase").join(q, [*keys, "question_id"]).where(F.contains("blob", F.col("norm")))
    return met.where("NOT phrase").select(*keys, "norm", "question_id").unionByName(whole.select(*keys, "norm", "question_id"))


def coverage(objects: DataFrame, edges: DataFrame, questions: DataFrame, lessons: DataFrame) -> DataFrame:
    """(level, course_id, lesson_id, total, covered, weighted_pct) for each lesson, each course and the corpus: concepts of a lesson's objects, and those that one of its questions mentions, by
    number and by weight. objects and questions have a lesson_id, lessons (lesson_id, course_id). Lessons are judged once; their sums give all three levels."""
    key = ["lesson_id"]
    c = extract(objects, key)
    seen = mentions(c, questions, key).select("lesson_id", "norm").distinct().withColumn("seen", F.lit(True))
    r = weights(c, edges, key).join(seen, ["lesson_id", "norm"], "left").join(lessons, "lesson_id")
    hit = F.coalesce("seen", F.lit(False))
    per = r.groupBy("course_id", "lesson_id").agg(F.count("*").alias("total"), F.count_if(hit).alias("covered"), F.sum("weight").alias("w"), F.coalesce(F.sum(F.when(hit, F.col("weight"))), F.lit(0)).alias("h"))
    level = F.when(F.grouping("course_id") == 1, "corpus").when(F.grouping("lesson_id") == 1, "course").otherwise("lesson")
    out = per.groupingSets([["course_id", "lesson_id"], ["course_id"], []], "course_id", "lesson_id").agg(level.alias("level"), F.sum("total").alias("total"), F.sum("covered").alias("covered"), F.round(100.0 * F.sum("h") / F.sum("w"), 2).alias("weighted_pct"))
    return out.select("level", "course_id", "lesson_id", "total", "covered", "weighted_pct")


def search(rows: DataFrame, asks: list[str], stop: list[str], more: int = 3) -> DataFrame:
    """rows (rank, kind, id, title, low, boost), low the lower-case text: for each question (ask, kind, id, title, score, related), the row that holds most of its terms
    (words of more than 2 letters that are no stop words; a term in the title counts `boost` more), and the other titles among the next `more`."""
    terms = [[w for w in q.lower().split() if w not in stop and len(w) > 2] for q in asks]
    score = lambda ts: sum((F.contains("low", F.lit(t)).cast("int") + F.col("boost") * F.contains(F.lower("title"), F.lit(t)).cast("int") for t in ts), F.lit(0))
    every = rows.select("rank", "kind", "id", "title", F.explode(F.array(*[F.struct(F.lit(i).alias("ask"), score(ts).alias("score")) for i, ts in enumerate(terms)])).alias("a")).select("rank", "kind", "id", "title", "a.*").where("score > 0")
    # a rank with a fixed limit: each task hands on its own first rows alone
    key = ["rank", "id", "kind", "title", "score"]
    r = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), *key))
    first = every.withColumn("r", r).where(F.col("r") <= more + 1)
    top = first.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("r", *key))).alias("top"))
    best = F.get("top", F.lit(0))
    related = F.filter(F.transform(F.slice("top", 2, more), lambda x: x["title"]), lambda t: t != best["title"])
    return top.select("ask", best["kind"].alias("kind"), best["id"].alias("id"), best["title"].alias("title"), best["score"].alias("score"), F.nullif(F.array_join(related, ", "), F.lit("")).alias("related"))
