"""Material for a prompt: what a message asks about, and what a synthesis question builds on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rag_context(objects: DataFrame, sections: DataFrame, message: str, stop: list[str], boost: int = 3) -> DataFrame:
    """(kind, rank, id, score, part) for a message: of the five objects (id, title, description) and three sections (id, title, content) that hold most of its terms, those with a text of their
    own. A term counts once where title or text hold it, and `boost` more in an object's title; ties go by id. A message without terms has no context."""
    terms = [w for w in message.lower().split() if w not in stop and len(w) > 2]

    def best(df: DataFrame, kind: str, text: str, extra: int, most: int, chars: int, head: str) -> DataFrame:
        title = F.lower(F.coalesce("title", F.lit("")))
        low = F.concat(title, F.lit(" "), F.lower(F.coalesce(text, F.lit(""))))
        score = sum((F.contains(low, F.lit(t)).cast("int") + extra * F.contains(title, F.lit(t)).cast("int") for t in terms), F.lit(0))
        top = df.select("id", "title", F.col(text).alias("text"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(most)
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # of a few rows
        part = F.concat(F.lit(f"**{head}"), "title", F.lit("**: "), F.substring("text", 1, chars))
        return top.select(F.lit(kind).alias("kind"), rank.alias("rank"), "id", "score", part.alias("part"), "text").where("text <> ''").drop("text")

    return best(objects, "object", "description", boost, 5, 500, "").unionByName(best(sections, "section", "content", 0, 3, 400, "Section - "))


def focus_context(asked: DataFrame, objects: DataFrame, sections: DataFrame, per_section: int = 5, most: int = 15, chars: int = 600, total: int = 2000) -> DataFrame:
    """asked (lesson, offset, source_id, target_id): (lesson, offset, concepts, excerpts) of each request. Its sections are the lesson's section at place offset (modulo their number; only sections with
    objects count), then those of the anchor edge's ends, and further ones in order until there are two. objects (lo_id, lesson, section, title, description) give `per_section` lines a
    section and `most` in all; sections (lesson, section, content) the first `chars` characters each, `total` in all."""
    held = sections.join(objects.select("lesson", "section").distinct(), ["lesson", "section"], "left_semi")
    place = held.select("lesson", "section", (F.row_number().over(Window.partitionBy("lesson").orderBy("section")) - 1).alias("i"))
    q = asked.select("lesson", "offset", "source_id", "target_id")
    own = q.join(place, "lesson").withColumn("n", F.count("*").over(Window.partitionBy("lesson", "offset", "source_id", "target_id")))
    own = own.select("lesson", "offset", "section", F.when(F.col("i") == F.col("offset") % F.col("n"), 0).otherwise(10 + F.col("i")).alias("p"))
    ends = q.select("lesson", "offset", F.explode(F.array(F.struct(F.lit(1).alias("p"), F.col("source_id").alias("lo_id")), F.struct(F.lit(2).alias("p"), F.col("target_id").alias("lo_id")))).alias("e")).select("lesson", "offset", "e.*")
    ends = ends.join(objects.select("lo_id", "section"), "lo_id").select("lesson", "offset", "section", "p")
    first = own.unionByName(ends).groupBy("lesson", "offset", "section").agg(F.min("p").alias("p"))
    r = F.row_number().over(Window.partitionBy("lesson", "offset").orderBy("p", "section"))
    chosen = first.withColumn("r", r).where("p < 10 OR r <= 2")
    line = F.concat(F.lit("- "), "title", F.lit(": "), F.substring(F.coalesce("description", F.lit("")), 1, 150))
    few = objects.select("section", "lo_id", line.alias("line"), F.row_number().over(Window.partitionBy("section").orderBy("lo_id")).alias("k")).where(F.col("k") <= per_section)
    texts = sections.select("section", F.substring("content", 1, chars).alias("x")).where("x <> ''")
    ordered = lambda value, *by: F.transform(F.sort_array(F.collect_list(F.struct(*by, value))), lambda x: x[value])
    concepts = chosen.join(few, "section").groupBy("lesson", "offset").agg(F.array_join(F.slice(ordered("line", "r", "k"), 1, most), "\n").alias("concepts"))
    excerpts = chosen.join(texts, "section").groupBy("lesson", "offset").agg(F.substring(F.array_join(ordered("x", "r"), "\n\n"), 1, total).alias("excerpts"))
    return q.select("lesson", "offset").distinct().join(concepts, ["lesson", "offset"], "left").join(excerpts, ["lesson", "offset"], "left").na.fill("", ["concepts", "excerpts"])
