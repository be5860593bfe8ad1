"""Reports over item, rating and judge rows: aggregations that stay partial on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.responses import LEVELS, ioc_label, solvability_label


def rate(hit: Column, of: Column) -> Column:
    """Share of `of` rows that are hits, in percent; null when there are none."""
    return F.round(100.0 * F.count_if(of & hit) / F.nullif(F.count_if(of), F.lit(0)), 2)


def item_difficulty(trials: DataFrame) -> DataFrame:
    """Per question: usable trials, p (three places, null without usable trials) and its label, from the unrounded p."""
    t = trials.groupBy("question_id").agg(F.count_if(~F.col("parse_failure")).alias("usable"), F.count_if(F.col("correct") & ~F.col("parse_failure")).alias("n_correct"))
    p = F.col("n_correct") / F.nullif("usable", F.lit(0))
    return t.select("question_id", "usable", F.round(p, 3).alias("p_value"), solvability_label(p).alias("label"))


def kappa(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of (intended, classified) over known levels, by keys: (po - pe) / (1 - pe); 1 or 0 where pe is 1; null without rows."""
    keys = keys or []
    known = pairs.where(F.col("intended").isin(LEVELS) & F.col("classified").isin(LEVELS))
    sums = [F.count_if(F.col(c) == lv).alias(f"{c[0]}_{i}") for c in ("intended", "classified") for i, lv in enumerate(LEVELS)]
    s = known.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("intended") == F.col("classified")).alias("agree"), *sums)
    n = F.nullif("n", F.lit(0)).cast("double")
    pe = sum((F.col(f"i_{i}") * F.col(f"c_{i}") for i in range(len(LEVELS))), F.lit(0)) / (n * n)
    po = F.col("agree") / n
    return s.select(*keys, "n", "agree", F.round(F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0))), 6).alias("kappa"))


def confusion(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of every intended level, zero-filled, a column for each classified level; unknown labels are ignored."""
    keys = keys or []
    spark = pairs.sparkSession
    known = pairs.where(F.col("intended").isin(LEVELS) & F.col("classified").isin(LEVELS))
    counts = known.groupBy(*keys, "intended").pivot("classified", LEVELS).agg(F.count(F.lit(1)))
    rows = spark.createDataFrame([(x,) for x in LEVELS], "intended string")
    if keys:
        rows = pairs.select(*keys).distinct().crossJoin(F.broadcast(rows))
    return rows.join(counts, [*keys, "intended"], "left").na.fill(0, LEVELS)


def ioc_report(ratings: DataFrame) -> DataFrame:
    r = ratings.where("rating IS NOT NULL").agg(*[F.count_if(F.col("rating") == v).alias(n) for v, n in ((-1, "negative"), (0, "neutral"), (1, "positive"))], F.avg("rating").alias("m"))
    return r.select("negative", "neutral", "positive", F.round("m", 2).alias("ioc_index"), ioc_label(F.col("m")).alias("label"))


def quota(lo: Column, sections: Column) -> list[Column]:
    """Clamped quotas of a lesson with objects and sections: one-concept, several-concept and relating items."""
    return [
        F.greatest(F.lit(10), F.least(F.lit(40), F.floor(lo / 5))).alias("u"),
        F.greatest(F.lit(6), F.least(F.lit(30), F.floor(0.75 * sections))).alias("m"),
        F.greatest(F.lit(4), F.least(F.lit(20), F.floor(sections / 2))).alias("r"),
    ]


def marked(both: DataFrame, up: Column, digits: int | None = 2) -> DataFrame:
    """both (..., before, after) with delta and a mark: for the better, for the worse, unchanged, or none where `up` (higher is better) or a side is null."""
    delta = F.col("after") - F.col("before")
    same = F.when(F.col("after") == F.col("before"), "~").when((F.col("after") > F.col("before")) == up, "✓").otherwise("✗")
    mark = F.when(up.isNull() | F.col("after").isNull() | F.col("before").isNull(), "").otherwise(same)
    return both.withColumn("delta", delta if digits is None else F.round(delta, digits)).withColumn("mark", mark)


def headline_delta(payloads: DataFrame, spec: list[tuple]) -> DataFrame:
    """payloads (snapshot, metric_key, payload): a row for each (metric, JSON path, direction) of spec, with its numbers before and after."""
    paths = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("path"), F.lit(up).cast("boolean").alias("up")) for k, p, up in spec])
    wanted = payloads.sparkSession.range(1).select(F.explode(paths).alias("h")).select(F.col("h.k").alias("metric_key"), "h.path", "h.up")
    number = F.coalesce(*[F.when(F.col("path") == p, F.get_json_object("payload", f"$.{p}")) for p in dict.fromkeys(p for _, p, _ in spec)]).cast("double")
    v = payloads.join(F.broadcast(wanted), "metric_key").select("metric_key", "path", "snapshot", number.alias("v"))
    side = lambda s: F.max(F.when(F.col("snapshot") == s, F.col("v"))).alias(s)
    j = F.broadcast(wanted).join(v.groupBy("metric_key", "path").agg(side("before"), side("after")), ["metric_key", "path"], "left")
    return marked(j, F.col("up")).drop("up")


def headlines(payloads: DataFrame, spec: list[tuple]) -> DataFrame:
    """payloads (scope, metric_key, payload): (scope, metric, value) by the path of each metric; one without a path is a rate of two counts in percent."""
    get = lambda path: F.get_json_object("payload", f"$.{path}").cast("double")
    rate = F.round(100 * get("correct_outlier_count") / get("evaluated_questions"), 1)
    value = F.coalesce(*[F.when(F.col("metric_key") == k, rate if p is None else get(p)) for _, k, p, _ in spec])
    metric = F.coalesce(*[F.when(F.col("metric_key") == k, m) for m, k, *_ in spec])
    return payloads.select("scope", metric.alias("metric"), value.alias("value")).where("metric IS NOT NULL")


def overview(values: DataFrame, spec: list[tuple], expert: str = "expert") -> DataFrame:
    """values (scope, metric, value): (metric, lesson, value, expert), the experts' value only for metrics that can be compared."""
    comparable = [m for m, *_, c in spec if c]
    experts = values.where((F.col("scope") == expert) & F.col("metric").isin(comparable)).select("metric", F.col("value").alias("expert"))
    return values.where(F.col("scope") != expert).join(experts, "metric", "left").select("metric", F.col("scope").alias("lesson"), "value", "expert")


def quality_map(payloads: DataFrame, metrics: list[str]) -> DataFrame:
    """payloads (lesson_id, metric_key, payload) with reports[] in JSON: the verdict of each question by metric. Lint has no place in it, reports without a
    question are skipped, and of several reports the one of the last lesson stands, in it the last."""
    parsed = F.from_json("payload", "reports array<struct<at: long, question_id: long, verdict: long>>")["reports"]
    rows = payloads.where("metric_key <> 'lint'").select("lesson_id", "metric_key", F.posexplode(parsed).alias("i", "r")).where("r.question_id IS NOT NULL")
    return rows.groupBy(F.col("r.question_id").alias("question_id")).pivot("metric_key", metrics).agg(F.max_by("r.verdict", F.struct("lesson_id", "i")))


#: Metric, direction (higher is better), and the values from which it is good and from which it is a warning. Fixed values.
LIGHTS = [
    ("coverage", True, 70.0, 50.0), ("lint", True, 85.0, 65.0), ("solo_kappa", True, 0.61, 0.41), ("cove_supported", True, 80.0, 60.0), ("stem_only", True, 70.0, 50.0), ("ioc", True, 0.5, 0.0),
    ("ambiguity", False, 10.0, 25.0), ("grammar", True, 80.0, 60.0), ("face", True, 4.0, 3.0),
]


def lights(values: DataFrame) -> DataFrame:
    """values (metric, value, ...) with `tone`: good, warn or bad by the metric's limits; a mean difficulty (solvability) is good from 0.5 to 0.9 and else a warning; other metrics
    (readability) have no colour: info. A null value has no tone."""
    v = F.col("value")
    tone = F.when(F.col("metric") == "solvability", F.when(v.between(0.5, 0.9), "good").otherwise("warn"))
    for metric, up, good, warn in LIGHTS:
        reach = (lambda limit, up=up: v >= limit if up else v <= limit)
        tone = tone.when(F.col("metric") == metric, F.when(reach(good), "good").when(reach(warn), "warn").otherwise("bad"))
    return values.withColumn("tone", F.when(v.isNotNull(), tone.otherwise("info")))


def badges(judged: DataFrame) -> DataFrame:
    """(question_id, metric, tone) of a question's judgements: judged (question_id, intended_level, classified_level, cove_verdict, ioc_rating, ambiguous, grammar, key_outlier, stem_passes, fit, grade, p_value, label,
    face_score), any of which may lack or be null. A metric without a judgement has no badge."""
    c = lambda name, kind="string": F.col(name) if name in judged.columns else F.lit(None).cast(kind)
    cove, rating, verdict, label, face = c("cove_verdict"), c("ioc_rating", "int"), c("grammar"), c("label"), c("face_score", "double")
    of = {
        "solo_judge": F.when(c("intended_level").isNotNull() | c("classified_level").isNotNull(), F.when(F.coalesce(c("intended_level") == c("classified_level"), F.lit(False)), "good").otherwise("bad")),
        "cove": F.when(cove == "SUPPORTED", "good").when(cove == "CONTRADICTED", "bad").when(cove.isNotNull(), "warn"),
        "ioc": F.when(rating > 0, "good").when(rating < 0, "bad").when(rating.isNotNull(), "warn"),
        "ambiguity": F.when(c("ambiguous", "boolean"), "bad").when(c("ambiguous", "boolean").isNotNull(), "good"),
        "grammar_homogeneity": F.when(verdict.isNotNull(), F.when(c("key_outlier", "boolean"), "bad").when(verdict == "homogeneous", "good").when(verdict == "single_outlier", "warn").otherwise("bad")),
        "stem_only": F.when(c("stem_passes", "boolean"), "good").when(c("stem_passes", "boolean").isNotNull(), "warn"),
        "readability": F.when(c("grade", "double").isNotNull(), F.when(c("fit") == "in_range", "good").when(c("fit") == "unknown", "info").otherwise("warn")),
        "solvability": F.when(c("p_value", "double").isNotNull(), F.when(label == "trivially_easy", "warn").otherwise("info")),
        "face_validity": F.when(face >= 4, "good").when(face >= 3, "info").when(face.isNotNull(), "warn"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), t.alias("tone")) for m, t in of.items()])).alias("b")
    return judged.select("question_id", rows).select("question_id", "b.*").where("tone IS NOT NULL")


def quiz_scores(answers: DataFrame, questions: DataFrame, quizzes: DataFrame, mark: int = 70) -> DataFrame:
    """(quiz_id, attempt, total, correct, percent, passed) from answers (quiz_id, attempt, question_id, answer as text), questions (quiz_id, question_id, correct_option_index, correct_answer) and
    quizzes (quiz_id, passing_score; null: `mark`). A question with a key is right if the answer is its number, one without if it is its text in any case; what isn't answered is
    wrong, and percents are of all questions of the quiz."""
    q = questions.select("quiz_id", "question_id", "correct_option_index", "correct_answer")
    size = q.groupBy("quiz_id").agg(F.count("*").alias("total"))
    number = F.regexp_extract("answer", r"^\s*([+-]?\d{1,9})", 1).try_cast("int")
    right = F.when(F.col("correct_option_index").isNotNull(), number == F.col("correct_option_index")).otherwise((F.col("correct_answer") != "") & (F.lower("answer") == F.lower("correct_answer")))
    a = answers.join(q, ["quiz_id", "question_id"]).groupBy("quiz_id", "attempt").agg(F.count_if(F.coalesce(right, F.lit(False))).alias("correct"))
    percent = 100.0 * F.col("correct") / F.col("total")
    out = a.join(size, "quiz_id").join(quizzes.select("quiz_id", "passing_score"), "quiz_id", "left")
    return out.select("quiz_id", "attempt", "total", "correct", F.round(percent, 2).alias("percent"), (percent >= F.coalesce("passing_score", F.lit(mark))).alias("passed"))
