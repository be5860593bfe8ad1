"""Stored model responses: the JSON object inside a response, and what the judges' answers mean. A response that can't be read gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ["unistructural", "multistructural", "relational", "extended_abstract"]
VERDICTS = ["SUPPORTED", "CONTRADICTED", "NOT_FOUND"]
STEM_PASS, STEM_PARTIAL = 0.55, 0.35


def json_object(raw: Column) -> Column:
    """Text from the first { to the last }; null without both."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def field(raw: Column, name: str) -> Column:
    """A top-level field of the object as text; null when the object can't be parsed."""
    return F.get_json_object(json_object(raw), f"$.{name}")


def parse_choice(raw: Column, n_options: Column) -> Column:
    """0-based choice: a letter from A, else a number from 1; null outside the options."""
    c = F.upper(F.trim(field(raw, "choice")))
    at = F.when(c.rlike("^[A-Z]"), F.ascii(c) - 65).when(c.rlike("^[0-9]+$"), c.try_cast("int") - 1)
    return F.when((at >= 0) & (at < n_options), at)


def parse_level(raw: Column) -> Column:
    level = F.lower(F.trim(field(raw, "level")))
    return F.when(level.isin(LEVELS), level)


def parse_confidence(raw: Column) -> Column:
    return field(raw, "confidence").try_cast("double")


def parse_rating(raw: Column) -> Column:
    """-1, 0 or 1."""
    value = field(raw, "rating").try_cast("int")
    return F.when(value.isin(-1, 0, 1), value)


def solvability_label(p: Column) -> Column:
    return F.when(p >= 0.9, "trivially_easy").when(p >= 0.6, "appropriate").when(p >= 0.3, "hard").when(p.isNotNull(), "too_hard_or_misframed")


def ioc_label(mean: Column) -> Column:
    return F.when(mean >= 0.75, "excellent").when(mean >= 0.5, "acceptable").when(mean >= 0, "weak").when(mean.isNotNull(), "misaligned")


def stem_verdict(similarity: Column, answered: Column, judged: Column | None = None) -> Column:
    """The verdict of a free answer: unable without one, by similarity where there are vectors, else by a judge's response that tells whether both mean the same; null if that says nothing."""
    by_vector = F.when(~answered, "unable").when(similarity >= STEM_PASS, "pass").when(similarity >= STEM_PARTIAL, "partial").when(similarity.isNotNull(), "fail")
    return by_vector if judged is None else by_vector.when(equivalent(judged), "pass").when(equivalent(judged).isNotNull(), "fail")


def equivalent(response: Column) -> Column:
    """Whether the object in a response says that two answers are equivalent; null where there is no object or no such entry. Whatever isn't empty, zero, false or null says so."""
    value = F.get_json_object(F.regexp_extract(response, r"(?s)(\{.*\})", 1), "$.equivalent")
    said = F.regexp_extract(response, r"(?s)(\{.*\})", 1).rlike(r'"equivalent"\s*:\s*null')
    return F.when(value.isNotNull(), ~value.isin("", "false", "0", "0.0", "[]", "{}")).when(said, False)


def response_key(model: Column, prompt: Column, temperature: Column, json_mode: Column) -> Column:
    """SHA-256 of the canonical JSON of a request; its keys in alphabetic order, the temperature to four places."""
    doc = F.struct(json_mode.alias("json_mode"), model.alias("model"), prompt.alias("prompt"), F.round(temperature, 4).alias("temperature"))
    return F.sha2(F.to_json(doc), 256)


def content_hash(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("||"), text), 256)


AMBIGUITY_TYPES = ["lexical", "scope", "reference", "syntactic"]
CRITERIA = ["plausible", "clear", "relevant", "grammatical"]


def ambiguity(rows):
    """(question_id, response): ambiguous needs two interpretations at least, otherwise false with type none; five at most count."""
    raw = F.col("response")
    n = F.least(F.lit(5), F.coalesce(F.json_array_length(field(raw, "interpretations")), F.lit(0)))
    yes = F.coalesce(field(raw, "ambiguous") == "true", F.lit(False)) & (n >= 2)
    kind = field(raw, "type")
    return rows.select("question_id", yes.alias("ambiguous"), F.when(yes, F.when(kind.isin(AMBIGUITY_TYPES), kind).otherwise("other")).otherwise("none").alias("type"), n.alias("interpretations"))


def cove(rows):
    """(question_id, response): the verdict of the closed set, whether it needs review, and how many of at most three questions were asked."""
    raw = F.col("response")
    said = F.upper(F.trim(field(raw, "verdict")))
    verdict = F.when(said.isin(VERDICTS), said)
    asked = F.least(F.lit(3), F.coalesce(F.json_array_length(field(raw, "verification_questions")), F.lit(0)))
    return rows.select("question_id", verdict.alias("verdict"), F.coalesce(verdict != "SUPPORTED", F.lit(True)).alias("needs_review"), asked.alias("n_questions"))


def homogeneity(rows):
    """(question_id, pos, t, k): the most frequent type, the first seen on ties; homogeneous, single_outlier or mixed; whether the key is the outlier."""
    counts = rows.groupBy("question_id", "t").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max(F.col("pos") == F.col("k")).alias("key"))
    order = F.struct(-F.col("n"), F.col("first"))
    out = counts.groupBy("question_id").agg(F.min_by("t", order).alias("major"), F.max("n").alias("top"), F.sum("n").alias("total"), F.max_by("t", F.when(F.coalesce("key", F.lit(False)), 1)).alias("key_type"))
    verdict = F.when(F.col("top") == F.col("total"), "homogeneous").when(F.col("top") == F.col("total") - 1, "single_outlier").otherwise("mixed")
    return out.select("question_id", "major", verdict.alias("verdict"), F.coalesce((verdict == "single_outlier") & (F.col("key_type") != F.col("major")), F.lit(False)).alias("key_outlier"))


def face(rows):
    """(question_id, k, n, response): a row for each distractor that has all four ratings from 1 to 5: pos, ratings, mean (two places)."""
    shape = "map<string, struct<" + ", ".join(f"{c}: int" for c in CRITERIA) + ">>"
    parsed = rows.select("question_id", "k", "n", F.explode(F.from_json(json_object(F.col("response")), shape)).alias("letter", "r"))
    parsed = parsed.withColumn("pos", F.ascii(F.upper("letter")) - 65).where("pos >= 0 AND pos < n AND pos <> k")
    good = F.lit(True)
    for c in CRITERIA:
        good = good & F.coalesce(F.col(f"r.{c}").between(1, 5), F.lit(False))
    total = sum((F.col(f"r.{c}") for c in CRITERIA), F.lit(0))
    return parsed.where(good).select("question_id", "pos", "r.*", F.round(total / 4, 2).alias("mean"))


def json_array(c: Column) -> Column:
    """The JSON array that a response holds, from its first [ to its last ]; null without one."""
    return F.nullif(F.regexp_extract(c, r"(?s)\[.*\]", 0), F.lit(""))


def _items(df: DataFrame, key: str, shape: str) -> DataFrame:
    return df.select(key, F.posexplode(F.from_json(json_array(F.col("response")), f"array<struct<{shape}>>")).alias("i", "x")).select(key, "i", "x.*")


def _first_of_title(rows: DataFrame, key: str) -> DataFrame:
    """Rows in order, each title (ignoring case) once for each key."""
    d = F.row_number().over(Window.partitionBy(key, F.lower("title")).orderBy("i"))
    return rows.where("title <> ''").withColumn("d", d).where("d = 1").drop("d")


def section_rows(df: DataFrame, key: str, topics: int = 8) -> DataFrame:
    """df (key, response): (key, title, key_topics, r) of the sections in list responses."""
    rows = _first_of_title(_items(df, key, "title: string, key_topics: array<string>").withColumn("title", F.trim("title")), key)
    r = F.row_number().over(Window.partitionBy(key).orderBy("i"))
    return rows.select(key, "title", F.slice(F.coalesce("key_topics", F.array().cast("array<string>")), 1, topics).alias("key_topics"), r.alias("r"))


def object_rows(df: DataFrame, key: str, most: int = 12, title: int = 150, description: int = 600, keywords: int = 6) -> DataFrame:
    """df (key, response): (key, title, lo_type, description, keywords, r) of the learning objects in list responses, `most` for each key."""
    from gradus.operators.vocabulary import lo_type

    rows = _first_of_title(_items(df, key, "title: string, type: string, description: string, keywords: array<string>"), key)
    rows = rows.where((F.length(F.trim("title")) <= 80) & (F.size(F.split(F.trim("title"), r"\s+")) <= 10))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("i"))).where(F.col("r") <= most)
    return rows.select(key, F.substring("title", 1, title).alias("title"), lo_type(F.col("type")).alias("lo_type"), F.substring("description", 1, description).alias("description"), F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, keywords).alias("keywords"), "r")


def relation_rows(df: DataFrame, key: str) -> DataFrame:
    """df (key, response): (key, source, target, type, target_id) of the relations in list responses; blank ends and a title with itself go."""
    rows = _items(df, key, "source: string, target: string, type: string, target_id: long")
    return rows.where((F.trim("source") != "") & (F.trim("target") != "") & (F.lower(F.trim("source")) != F.lower(F.trim("target")))).drop("i")
