"""Queries of stored responses (R*) and reports (A*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradus.functions import responses as R
from gradus.functions.text import exact_mean, exact_mean_sql
from gradus.operators import metrics as M

from .dedup import MATCH, matched
from .registry import query

OBJ = r"nullif(regexp_extract(response, '(?s)\{.*\}'), '')"


def fld(name: str) -> str:
    return f"CASE WHEN json_valid({OBJ}) THEN json_extract_string({OBJ}, '$.{name}') END"


LVL = "['unistructural', 'multistructural', 'relational', 'extended_abstract']"
RATING = f"CASE WHEN try_cast({fld('rating')} AS INT) IN (-1, 0, 1) THEN try_cast({fld('rating')} AS INT) END"
LEVELP = f"CASE WHEN list_contains({LVL}, lower(trim({fld('level')}))) THEN lower(trim({fld('level')})) END"
CH = f"upper(trim({fld('choice')}))"
CHAT = f"CASE WHEN regexp_matches({CH}, '^[A-Z]') THEN ascii({CH}) - 65 WHEN regexp_matches({CH}, '^[0-9]+$') THEN try_cast({CH} AS INT) - 1 END"


@query("R1_json_object", f"SELECT question_id, {OBJ} AS object, {fld('reasoning')} AS reasoning FROM raw_responses")
def json_object(fx):
    r = F.col("response")
    return fx.raw_responses.select("question_id", R.json_object(r).alias("object"), R.field(r, "reasoning").alias("reasoning"))


@query("R2_parse_choice", f"SELECT question_id, CASE WHEN {CHAT} BETWEEN 0 AND 3 THEN {CHAT} END AS choice FROM raw_responses")
def parse_choice(fx):
    return fx.raw_responses.select("question_id", R.parse_choice(F.col("response"), F.lit(4)).alias("choice"))


@query("R3_parse_level", f"SELECT question_id, {LEVELP} AS level, try_cast({fld('confidence')} AS DOUBLE) AS confidence FROM raw_responses")
def parse_level(fx):
    return fx.raw_responses.select("question_id", R.parse_level(F.col("response")).alias("level"), R.parse_confidence(F.col("response")).alias("confidence"))


@query("R4_parse_rating", f"SELECT question_id, {RATING} AS rating FROM raw_responses")
def parse_rating(fx):
    return fx.raw_responses.select("question_id", R.parse_rating(F.col("response")).alias("rating"))


@query("A7_ioc_report", f"""SELECT negative, neutral, positive, round(m, 2) AS ioc_index, CASE WHEN m >= 0.75 THEN 'excellent' WHEN m >= 0.5 THEN 'acceptable' WHEN m >= 0 THEN 'weak' WHEN m IS NOT NULL THEN 'misaligned' END AS label FROM
  (SELECT count(*) FILTER (rating = -1) AS negative, count(*) FILTER (rating = 0) AS neutral, count(*) FILTER (rating = 1) AS positive, avg(rating) AS m FROM (SELECT {RATING} AS rating FROM raw_responses) WHERE rating IS NOT NULL)""")
def ioc_report(fx):
    return M.ioc_report(fx.raw_responses.select(R.parse_rating(F.col("response")).alias("rating")))


ITEM = """(SELECT question_id, usable, n_correct / nullif(usable, 0) AS p FROM (SELECT question_id, count(*) FILTER (NOT parse_failure) AS usable, count(*) FILTER (correct AND NOT parse_failure) AS n_correct FROM trials GROUP BY 1))"""
PLABEL = "CASE WHEN p >= 0.9 THEN 'trivially_easy' WHEN p >= 0.6 THEN 'appropriate' WHEN p >= 0.3 THEN 'hard' WHEN p IS NOT NULL THEN 'too_hard_or_misframed' END"


@query("A4_solvability_item", f"SELECT question_id, usable, round(p, 3) AS p_value, {PLABEL} AS label FROM {ITEM}")
def solvability_item(fx):
    return M.item_difficulty(fx.trials)


@query("A5_solvability_report", f"SELECT {exact_mean_sql('round(p, 3)', 3)} AS mean_p, count(*) FILTER (p IS NOT NULL) AS completed, count(*) AS total, count(*) FILTER (p IS NOT NULL) < count(*) AS partial, count(*) FILTER ({PLABEL} = 'hard') AS hard, count(*) FILTER ({PLABEL} = 'too_hard_or_misframed') AS too_hard FROM {ITEM}")
def solvability_report(fx):
    done = F.count("p_value")
    return M.item_difficulty(fx.trials).agg(exact_mean(F.col("p_value"), 3).alias("mean_p"), done.alias("completed"), F.count("*").alias("total"), (done < F.count("*")).alias("partial"), F.count_if(F.col("label") == "hard").alias("hard"), F.count_if(F.col("label") == "too_hard_or_misframed").alias("too_hard"))


SIM = "(SELECT question_id, pos, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS s FROM (SELECT o.question_id, o.pos, k.vector AS a, o.vector AS b FROM option_vectors o JOIN option_vectors k ON k.question_id = o.question_id AND k.pos = 0 AND o.pos > 0))"
VERDICT = "CASE WHEN question_id % 7 = 0 THEN 'unable' WHEN s >= 0.55 THEN 'pass' WHEN s >= 0.35 THEN 'partial' WHEN s IS NOT NULL THEN 'fail' END"


def stem_rows(fx):
    from gradus.operators.lint import option_pairs

    p = option_pairs(fx.option_vectors).where("i = 0").select("question_id", F.col("j").alias("pos"), F.col("cosine").alias("s"))
    return p.withColumn("verdict", R.stem_verdict(F.col("s"), F.col("question_id") % 7 != 0))


@query("R9_stem_verdict", f"SELECT question_id, pos, {VERDICT} AS verdict FROM {SIM}")
def stem_verdict(fx):
    return stem_rows(fx).select("question_id", "pos", "verdict")


EQUAL = """CASE doc_id % 5 WHEN 0 THEN 'Yes: {"equivalent": true, "reasoning": "same"}' WHEN 1 THEN '{"equivalent": false}' WHEN 2 THEN '{"equivalent": null}' WHEN 3 THEN '{"reasoning": "none"}' ELSE 'no object' END"""


@query("R9_judged_verdict", f"SELECT doc_id AS question_id, CASE WHEN doc_id % 7 = 0 THEN 'unable' WHEN s >= 0.55 THEN 'pass' WHEN s >= 0.35 THEN 'partial' WHEN s IS NOT NULL THEN 'fail' WHEN doc_id % 5 = 0 THEN 'pass' WHEN doc_id % 5 IN (1, 2) THEN 'fail' END AS verdict FROM labels l LEFT JOIN (SELECT * FROM {SIM} WHERE pos = 3) v ON v.question_id = l.doc_id")
def judged_verdict(fx):
    """Free answers with a vector by similarity, the others by a judge's response."""
    from gradus.operators.lint import option_pairs

    s = option_pairs(fx.option_vectors).where("i = 0 AND j = 3").select(F.col("question_id").alias("doc_id"), F.col("cosine").alias("s"))
    return fx.labels.join(s, "doc_id", "left").select(F.col("doc_id").alias("question_id"), R.stem_verdict(F.col("s"), F.col("doc_id") % 7 != 0, F.expr(EQUAL)).alias("verdict"))


@query("A6_stem_only_report", f"SELECT round(100.0 * count(*) FILTER (v = 'pass') / count(*) FILTER (v <> 'unable'), 2) AS pass_rate, {exact_mean_sql('s', 4, " FILTER (v <> 'unable')")} AS mean_similarity, count(*) FILTER (v = 'pass') AS passed, count(*) FILTER (v = 'partial') AS partly, count(*) FILTER (v = 'fail') AS failed, count(*) FILTER (v = 'unable') AS unable FROM (SELECT s, {VERDICT} AS v FROM {SIM})")
def stem_only_report(fx):
    v, is_ = F.col("verdict"), lambda x, n: F.count_if(F.col("verdict") == x).alias(n)
    return stem_rows(fx).agg(M.rate(v == "pass", v != "unable").alias("pass_rate"), exact_mean(F.when(v != "unable", F.col("s")), 4).alias("mean_similarity"), is_("pass", "passed"), is_("partial", "partly"), is_("fail", "failed"), is_("unable", "unable"))


# Responses of the ambiguity, verification, grammar and face judges, made from the labels.
AMB = """(SELECT doc_id AS question_id, '{"ambiguous": ' || (CASE WHEN quality = 1 THEN 'true' ELSE 'false' END) || ', "type": "' || ['lexical', 'scope', 'odd'][doc_id % 3 + 1] || '", "interpretations": [' || ['', '"a"', '"a", "b"', '"a", "b", "c"'][doc_id % 4 + 1] || ']}' AS response FROM labels)"""


def amb_rows(fx):
    n = F.element_at(F.array(*[F.lit(x) for x in ("", '"a"', '"a", "b"', '"a", "b", "c"')]), (F.col("doc_id") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("lexical", "scope", "odd")]), (F.col("doc_id") % 3 + 1).cast("int"))
    raw = F.concat(F.lit('{"ambiguous": '), F.when(F.col("quality") == 1, "true").otherwise("false"), F.lit(', "type": "'), kind, F.lit('", "interpretations": ['), n, F.lit("]}"))
    return R.ambiguity(fx.labels.select(F.col("doc_id").alias("question_id"), raw.alias("response")))


PAMB = f"""(SELECT question_id, a AND n >= 2 AS ambiguous, CASE WHEN a AND n >= 2 THEN CASE WHEN t IN ('lexical', 'scope', 'reference', 'syntactic') THEN t ELSE 'other' END ELSE 'none' END AS type, n FROM
  (SELECT question_id, json_extract_string(response, '$.ambiguous') = 'true' AS a, json_extract_string(response, '$.type') AS t, least(5, json_array_length(response, '$.interpretations'))::INT AS n FROM {AMB}))"""


@query("R5_parse_ambiguity", f"SELECT question_id, ambiguous, type, n AS interpretations FROM {PAMB}")
def parse_ambiguity(fx):
    return amb_rows(fx)


@query("A8_ambiguity_report", f"SELECT type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM {PAMB} GROUP BY type")
def ambiguity_report(fx):
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return amb_rows(fx).groupBy("type").agg(F.count("*").alias("n")).withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(total), 2))


@query("A19_ambiguity_types", f"SELECT type, count(*) AS n FROM {PAMB} WHERE ambiguous GROUP BY type")
def ambiguity_types(fx):
    return amb_rows(fx).where("ambiguous").groupBy("type").agg(F.count("*").alias("n"))


VER = "CASE WHEN question_id % 13 = 0 THEN NULL WHEN question_id % 5 < 3 THEN 'SUPPORTED' WHEN question_id % 5 = 3 THEN 'CONTRADICTED' ELSE 'NOT_FOUND' END"


def cove_rows(fx):
    word = F.when(F.col("doc_id") % 5 < 3, "supported").when(F.col("doc_id") % 5 == 3, "Contradicted").otherwise("NOT_FOUND")
    raw = F.when(F.col("doc_id") % 13 == 0, F.lit('{"verdict": ')).otherwise(F.concat(F.lit('x {"verdict": "'), word, F.lit('", "verification_questions": ["a","b","c","d"]} y')))
    return R.cove(fx.labels.select(F.col("doc_id").alias("question_id"), raw.alias("response")))


@query("R8_cove_verdict", f"SELECT doc_id AS question_id, {VER.replace('question_id', 'doc_id')} AS verdict, coalesce({VER.replace('question_id', 'doc_id')} <> 'SUPPORTED', true) AS needs_review, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE 3 END AS n_questions FROM labels")
def cove_verdict(fx):
    return cove_rows(fx)


@query("A11_cove_report", f"SELECT count(*) FILTER (v = 'SUPPORTED') AS supported, count(*) FILTER (v = 'CONTRADICTED') AS contradicted, count(*) FILTER (v = 'NOT_FOUND') AS not_found, round(100.0 * count(*) FILTER (v = 'SUPPORTED') / count(*), 2) AS support_rate FROM (SELECT {VER.replace('question_id', 'doc_id')} AS v FROM labels)")
def cove_report(fx):
    is_ = lambda x: F.count_if(F.col("verdict") == x)
    return cove_rows(fx).agg(is_("SUPPORTED").alias("supported"), is_("CONTRADICTED").alias("contradicted"), is_("NOT_FOUND").alias("not_found"), F.round(100.0 * is_("SUPPORTED") / F.count("*"), 2).alias("support_rate"))


HOMO = """(WITH x AS (SELECT question_id, unnest(range(len(options))) AS pos, CASE WHEN length(unnest(options)) % 3 = 0 THEN 'noun' ELSE CASE WHEN length(unnest(options)) % 3 = 1 THEN 'verb' ELSE 'other' END END AS t, correct_option_index AS k FROM questions),
  c AS (SELECT question_id, t, count(*) AS n, min(pos) AS first FROM x GROUP BY 1, 2), m AS (SELECT question_id, arg_min(t, (-n * 1000 + first)) AS major, max(n) AS top, sum(n) AS total FROM c GROUP BY 1)
  SELECT m.question_id, major, CASE WHEN top = total THEN 'homogeneous' WHEN top = total - 1 THEN 'single_outlier' ELSE 'mixed' END AS verdict, coalesce(bool_or(pos = k AND t <> major) AND bool_and(top = total - 1), false) AS key_outlier FROM m JOIN x ON x.question_id = m.question_id GROUP BY 1, 2, top, total)"""


def homo_rows(fx):
    kind = F.when(F.length("o") % 3 == 0, "noun").when(F.length("o") % 3 == 1, "verb").otherwise("other")
    return R.homogeneity(fx.questions.select("question_id", F.col("correct_option_index").alias("k"), F.posexplode("options").alias("pos", "o")).withColumn("t", kind))


@query("R6_homogeneity", f"SELECT question_id, major, verdict, key_outlier FROM {HOMO}")
def homogeneity(fx):
    return homo_rows(fx)


@query("A12_homogeneity_report", f"SELECT verdict, count(*) AS n, count(*) FILTER (key_outlier) AS key_outliers FROM {HOMO} GROUP BY verdict")
def homogeneity_report(fx):
    return homo_rows(fx).groupBy("verdict").agg(F.count("*").alias("n"), F.count_if("key_outlier").alias("key_outliers"))


FACE = """(SELECT question_id, pos, 1 + (question_id + pos) % 5 AS plausible, 1 + (question_id + 2 * pos) % 5 AS clear, 1 + (question_id * 3 + pos) % 5 AS relevant, 1 + pos % 5 AS grammatical FROM
  (SELECT question_id, unnest(range(len(options))) AS pos, correct_option_index AS k FROM questions) WHERE pos <> k AND (question_id + pos) % 11 <> 0)"""


RATED = f"(SELECT question_id, round((plausible + clear + relevant + grammatical) / 4, 2) AS m FROM {FACE})"


def face_rows(fx):
    q = fx.questions.select("question_id", F.posexplode("options").alias("pos", "o"), F.col("correct_option_index").alias("k"))
    letter = F.chr(F.lit(65) + F.col("pos"))
    one = lambda e: F.concat((1 + F.expr(e) % 5).cast("string"))
    rated = F.concat(F.lit('"'), letter, F.lit('": {"plausible": '), one("(question_id + pos)"), F.lit(', "clear": '), one("(question_id + 2 * pos)"), F.when(F.expr("(question_id + pos) % 11 = 0"), F.lit("")).otherwise(F.concat(F.lit(', "relevant": '), one("(question_id * 3 + pos)"))), F.lit(', "grammatical": '), one("pos"), F.lit("}"))
    raw = q.groupBy("question_id", "k").agg(F.concat(F.lit("ratings: {"), F.array_join(F.collect_list(rated), ", "), F.lit("}")).alias("response"), F.count("*").cast("int").alias("n"))
    return R.face(raw)


@query("R7_parse_face", f"SELECT question_id, pos, round((plausible + clear + relevant + grammatical) / 4, 2) AS mean FROM {FACE}")
def parse_face(fx):
    return face_rows(fx).select("question_id", "pos", "mean")


@query("A13_face_report", f"SELECT (SELECT {exact_mean_sql('m', 3)} FROM (SELECT {exact_mean_sql('round((plausible + clear + relevant + grammatical) / 4, 2)', 2)} AS m FROM {FACE} GROUP BY question_id)) AS mean_score, round(avg(plausible), 3) AS plausible, round(avg(clear), 3) AS clear, round(avg(relevant), 3) AS relevant, round(avg(grammatical), 3) AS grammatical FROM {FACE}")
def face_report(fx):
    rows = face_rows(fx)
    per = rows.groupBy("question_id").agg(exact_mean(F.col("mean"), 2).alias("m"), *[F.sum(c).alias(c) for c in R.CRITERIA], F.count("*").alias("n"))
    return per.agg(exact_mean(F.col("m"), 3).alias("mean_score"), *[F.round(F.sum(c) / F.sum("n"), 3).alias(c) for c in R.CRITERIA])


CONF = ", ".join(f"count(*) FILTER (classified = '{x}') AS {x}" for x in R.LEVELS)


@query("A14_confusion_matrix", f"SELECT i.intended, {CONF} FROM (SELECT unnest({LVL}) AS intended) i LEFT JOIN judge_pairs j ON i.intended = j.intended GROUP BY 1")
def confusion_matrix(fx):
    return M.confusion(fx.judge_pairs)


KAPPA = f"""SELECT n, agree, round(CASE WHEN pe >= 1 THEN CASE WHEN agree / n >= 1 THEN 1.0 ELSE 0.0 END ELSE (agree / n - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT count(*) AS n, count(*) FILTER (intended = classified) AS agree,
  ({' + '.join(f"count(*) FILTER (intended = '{x}') * count(*) FILTER (classified = '{x}')" for x in R.LEVELS)}) / (count(*) * count(*))::DOUBLE AS pe FROM judge_pairs)"""


@query("A15_cohen_kappa", KAPPA)
def cohen_kappa(fx):
    return M.kappa(fx.judge_pairs)


@query("U5_cohen_kappa", KAPPA.replace("SELECT n,", "SELECT fold, n,").replace("(SELECT count(*) AS n", "(SELECT fold, count(*) AS n").replace("FROM judge_pairs)", "FROM (SELECT *, doc_id % 3 AS fold FROM judge_pairs) GROUP BY fold)"))
def kappa_by_fold(fx):
    return M.kappa(fx.judge_pairs.withColumn("fold", F.col("doc_id") % 3), ["fold"])


@query("A16_judge_report", f"SELECT count(*) AS total, count(*) FILTER (l IS NULL) AS parse_failures, count(*) FILTER (l = i) AS agreements, round(count(*) FILTER (l = i) / count(l), 4) AS accuracy FROM (SELECT {LEVELP} AS l, {LVL}[question_id % 3 + 1] AS i FROM raw_responses)")
def judge_report(fx):
    i = F.element_at(F.array(*[F.lit(x) for x in R.LEVELS]), (F.col("question_id") % 3 + 1).cast("int"))
    rows = fx.raw_responses.select(R.parse_level(F.col("response")).alias("l"), i.alias("i"))
    agree = F.count_if(F.col("l") == F.col("i"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("l").isNull()).alias("parse_failures"), agree.alias("agreements"), F.round(agree / F.nullif(F.count("l"), F.lit(0)), 4).alias("accuracy"))


@query("A20_expert_aggregate", "SELECT round(100.0 * count(*) FILTER (quality = 1) / count(quality), 2) AS lint_rate, round(avg(quality - toxic), 3) AS mean_score, round(100.0 * count(*) FILTER (toxic = 0 AND doc_id % 4 <> 0) / count(*) FILTER (doc_id % 4 <> 0), 2) AS cove_rate FROM labels")
def expert_aggregate(fx):
    has = F.col("doc_id") % 4 != 0
    return fx.labels.agg(M.rate(F.col("quality") == 1, F.col("quality").isNotNull()).alias("lint_rate"), F.round(F.avg(F.col("quality") - F.col("toxic")), 3).alias("mean_score"), M.rate(F.col("toxic") == 0, has).alias("cove_rate"))


@query("A21_book_progress", "SELECT book, count(*) AS total, count(*) FILTER (evaluated) AS evaluated FROM bank GROUP BY book")
def book_progress(fx):
    return fx.bank.groupBy("book").agg(F.count("*").alias("total"), F.count_if("evaluated").alias("evaluated"))


@query("A22_calibration_summary", """SELECT variant, count(*) AS n, round(100.0 * count(*) FILTER (p < 0.5) / count(p), 2) AS solver_flag, round(100.0 * count(*) FILTER (face < 2.5) / count(face), 2) AS face_flag, round(100.0 * count(*) FILTER (amb = 1) / count(*), 2) AS ambiguity FROM
  (SELECT ['clean', 'wrong_key', 'rich_context'][doc_id % 3 + 1] AS variant, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 10) / 10 END AS p, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (1 + doc_id % 5)::DOUBLE END AS face, quality AS amb FROM labels) GROUP BY variant""")
def calibration_summary(fx):
    v = F.element_at(F.array(F.lit("clean"), F.lit("wrong_key"), F.lit("rich_context")), (F.col("doc_id") % 3 + 1).cast("int"))
    p, face = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 10) / 10), F.when(F.col("doc_id") % 11 != 0, (1 + F.col("doc_id") % 5).cast("double"))
    rows = fx.labels.select(v.alias("variant"), p.alias("p"), face.alias("face"), "quality")
    return rows.groupBy("variant").agg(F.count("*").alias("n"), M.rate(F.col("p") < 0.5, F.col("p").isNotNull()).alias("solver_flag"), M.rate(F.col("face") < 2.5, F.col("face").isNotNull()).alias("face_flag"), M.rate(F.col("quality") == 1, F.lit(True)).alias("ambiguity"))


@query("A24_complete_languages", """SELECT t.quiz_id, t.language_code FROM (SELECT quiz_id, language_code, count(DISTINCT question_id) AS n FROM translations GROUP BY 1, 2) t JOIN (SELECT quiz_id, count(DISTINCT question_id) AS total FROM translations GROUP BY 1) q ON t.quiz_id = q.quiz_id WHERE n >= 0.9 * total""")
def complete_languages(fx):
    t = fx.translations
    total = t.groupBy("quiz_id").agg(F.countDistinct("question_id").alias("total"))
    return t.groupBy("quiz_id", "language_code").agg(F.countDistinct("question_id").alias("n")).join(total, "quiz_id").where("n >= 0.9 * total").select("quiz_id", "language_code")


LANGS = ["en", "de", "fr", "es", "it", "pt", "ru", "zh", "sr"]


@query("A25_translation_status", f"""SELECT q.quiz_id, l AS language_code, count(t.question_id) AS translated, count(*) - count(t.question_id) AS missing, count(*) = count(t.question_id) AS is_complete FROM (SELECT DISTINCT quiz_id, question_id FROM translations) q
  CROSS JOIN (SELECT unnest({LANGS}) AS l) LEFT JOIN (SELECT DISTINCT question_id, language_code FROM translations) t ON t.question_id = q.question_id AND t.language_code = l GROUP BY 1, 2""")
def translation_status(fx):
    langs = F.explode(F.array(*[F.lit(x) for x in LANGS]))  # nine constants: a row for each, without a join
    t = fx.translations
    q = t.select("quiz_id", "question_id").distinct().withColumn("language_code", langs)
    has = t.select("question_id", "language_code", F.lit(1).alias("has")).distinct()
    out = q.join(has, ["question_id", "language_code"], "left").groupBy("quiz_id", "language_code").agg(F.count("has").alias("translated"), F.count_if(F.col("has").isNull()).alias("missing"))
    return out.withColumn("is_complete", F.col("missing") == 0)


@query("A26_solo_distribution", f"SELECT quiz_id, {', '.join(f'''count(*) FILTER (solo_level = '{x}') AS {x}''' for x in R.LEVELS)}, count(*) AS total FROM questions GROUP BY quiz_id")
def solo_distribution(fx):
    return fx.questions.groupBy("quiz_id").agg(*[F.count_if(F.col("solo_level") == x).alias(x) for x in R.LEVELS], F.count("*").alias("total"))


@query("A27_lesson_facets", "SELECT primary_lesson_id AS lesson_id, coalesce(any_value(l.title), 'Lesson ' || primary_lesson_id) AS title, count(*) AS n FROM questions LEFT JOIN lessons l ON l.lesson_id = primary_lesson_id WHERE primary_lesson_id IS NOT NULL GROUP BY primary_lesson_id")
def lesson_facets(fx):
    n = fx.questions.where("primary_lesson_id IS NOT NULL").groupBy(F.col("primary_lesson_id").alias("lesson_id")).agg(F.count("*").alias("n"))
    return n.join(fx.lessons.select("lesson_id", "title"), "lesson_id", "left").select("lesson_id", F.coalesce("title", F.concat(F.lit("Lesson "), F.col("lesson_id").cast("string"))).alias("title"), "n")


@query("A28_spend_by_provider", "SELECT provider, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS calls, round(sum(input_tokens) / 1000000.0 * 1 + sum(output_tokens) / 1000000.0 * 5, 6)::DOUBLE AS cost FROM call_log GROUP BY provider")
def spend_by_provider(fx):
    i, o = F.sum("input_tokens"), F.sum("output_tokens")
    return fx.call_log.groupBy("provider").agg(i.alias("input_tokens"), o.alias("output_tokens"), F.count("*").alias("calls"), F.round(i / 1e6 + o / 1e6 * 5, 6).alias("cost"))


@query("A29_cache_stats", "SELECT count(*) AS entries, coalesce(sum(length(response)), 0)::BIGINT AS chars FROM raw_responses")
def cache_stats(fx):
    return fx.raw_responses.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length("response")), F.lit(0)).cast("long").alias("chars"))


@query("A31_quiz_score", """SELECT user_id, day, count(*) AS n, round(100.0 * count(*) FILTER (answer = item % 4) / count(*), 2) AS percent, 100.0 * count(*) FILTER (answer = item % 4) / count(*) >= 70 AS passed FROM attempts GROUP BY 1, 2""")
def quiz_score(fx):
    good = F.count_if(F.col("answer") == F.col("item") % 4)
    return fx.attempts.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.round(100.0 * good / F.count("*"), 2).alias("percent"), (100.0 * good / F.count("*") >= 70).alias("passed"))


@query("A34_child_counts", "SELECT l.lesson_id, count(s.section_id) AS sections FROM lessons l LEFT JOIN sections s ON s.lesson_id = l.lesson_id GROUP BY 1")
def child_counts(fx):
    n = fx.sections.groupBy("lesson_id").agg(F.count("*").alias("sections"))
    return fx.lessons.select("lesson_id").join(n, "lesson_id", "left").na.fill(0, ["sections"])


@query("A35_level_by_lesson", f"SELECT primary_lesson_id AS lesson_id, {', '.join(f'''count(*) FILTER (solo_level = '{x}') AS {x}''' for x in R.LEVELS)}, count(*) AS total FROM questions GROUP BY 1")
def level_by_lesson(fx):
    counts = fx.questions.groupBy(F.col("primary_lesson_id").alias("lesson_id")).pivot("solo_level", R.LEVELS).agg(F.count(F.lit(1))).na.fill(0)
    return counts.withColumn("total", sum((F.col(x) for x in R.LEVELS), F.lit(0)))


@query("A33_dedup_request", "SELECT user_id, array_to_string([x.v for x in list_sort(list_distinct([{'i': list_position(v, y), 'v': y} for y in v]))], ',') AS items FROM (SELECT user_id, list(item ORDER BY event_id) AS v FROM attempts GROUP BY 1)")
def dedup_request(fx):
    v = fx.attempts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "item"))).alias("v"))
    return v.select("user_id", F.array_join(F.array_distinct(F.transform("v", lambda x: x["item"])), ",").alias("items"))


@query("A1_entity_counts", """SELECT course_id, count(*) AS lessons, sum(p)::BIGINT AS pages, sum(s)::BIGINT AS sections FROM (SELECT course_id, l.lesson_id, (SELECT count(*) FROM lesson_pages x WHERE x.lesson_id = l.lesson_id) AS p, (SELECT count(*) FROM sections x WHERE x.lesson_id = l.lesson_id) AS s FROM lessons l) GROUP BY course_id""")
def entity_counts(fx):
    p = fx.lesson_pages.groupBy("lesson_id").agg(F.count("*").alias("p"), F.count_if(F.col("page") % 5 == 1).alias("s"))
    return fx.lessons.select("lesson_id", "course_id").join(p, "lesson_id", "left").groupBy("course_id").agg(F.count("*").alias("lessons"), F.sum("p").alias("pages"), F.sum("s").alias("sections"))


@query("A30_quota_plan", """SELECT lesson_id, u, m, r, u + m + r AS target, CASE WHEN lead(lesson_id) OVER (PARTITION BY course_id ORDER BY lesson_id) IS NOT NULL THEN 5 ELSE 0 END AS ea FROM (SELECT course_id, lesson_id,
  greatest(10, least(40, n_lo // 5)) AS u, greatest(6, least(30, floor(0.75 * n_s)::BIGINT)) AS m, greatest(4, least(20, n_s // 2)) AS r FROM (SELECT l.course_id, l.lesson_id, count(*) AS n_lo, count(*) FILTER (page % 5 = 1) AS n_s FROM lessons l JOIN lesson_pages p ON p.lesson_id = l.lesson_id GROUP BY 1, 2))""")
def quota_plan(fx):
    n = fx.lesson_pages.groupBy("lesson_id").agg(F.count("*").alias("lo"), F.count_if(F.col("page") % 5 == 1).alias("s"))
    q = fx.lessons.select("lesson_id", "course_id").join(n, "lesson_id").select("lesson_id", "course_id", *M.quota(F.col("lo"), F.col("s")))
    following = F.lead("lesson_id").over(Window.partitionBy("course_id").orderBy("lesson_id"))
    return q.select("lesson_id", "u", "m", "r", (F.col("u") + F.col("m") + F.col("r")).alias("target"), F.when(following.isNotNull(), 5).otherwise(0).alias("ea"))


ANSWERED = "(SELECT quiz_id, question_id, unnest(range(3)) AS attempt, correct_option_index AS k, correct_answer AS a, unnest([correct_option_index::VARCHAR, upper(correct_answer), CASE WHEN question_id % 2 = 0 THEN coalesce(correct_option_index::VARCHAR || 'th', lower(correct_answer)) END]) AS answer FROM questions)"


@query("A31_quiz_scores", f"""SELECT a.quiz_id, attempt, any_value(total) AS total, count(*) FILTER (hit) AS correct, round(100.0 * count(*) FILTER (hit) / any_value(total), 2)::DOUBLE AS percent, 100.0 * count(*) FILTER (hit) / any_value(total) >= coalesce(any_value(mark), 70) AS passed
  FROM (SELECT quiz_id, attempt, CASE WHEN k IS NOT NULL THEN try_cast(nullif(regexp_extract(answer, '^\\s*([+-]?\\d{{1,9}})', 1), '') AS INT) = k ELSE a <> '' AND lower(answer) = lower(a) END AS hit FROM {ANSWERED}) a
  JOIN (SELECT quiz_id, count(*) AS total, CASE WHEN quiz_id % 3 = 0 THEN 40 END AS mark FROM questions GROUP BY 1) s ON s.quiz_id = a.quiz_id GROUP BY 1, 2""")
def quiz_scores(fx):
    """Three attempts at every quiz: by number, by text, and half of the questions."""
    q = fx.questions.select("quiz_id", "question_id", "correct_option_index", "correct_answer")
    number = F.col("correct_option_index").cast("string")
    half = F.when(F.col("question_id") % 2 == 0, F.coalesce(F.concat(number, F.lit("th")), F.lower("correct_answer")))
    answers = q.select("quiz_id", "question_id", F.posexplode(F.array(number, F.upper("correct_answer"), half)).alias("attempt", "answer"))
    quizzes = q.select("quiz_id").distinct().withColumn("passing_score", F.when(F.col("quiz_id") % 3 == 0, 40))
    return M.quiz_scores(answers, q, quizzes)


@query("A32_question_quality_map", """SELECT question_id, max(v) FILTER (event_type = 'click') AS click, max(v) FILTER (event_type = 'view') AS view, max(v) FILTER (event_type = 'signup') AS signup FROM (SELECT event_id % 500 AS question_id, event_type, arg_max(event_id % 7, user_id * 1000000000 + event_id) AS v
  FROM events WHERE event_type <> 'error' AND event_id % 11 <> 0 GROUP BY 1, 2) GROUP BY 1""")
def question_quality_map(fx):
    """Reports of all stored payloads but lint's, question by metric; the last lesson's report of a question stands."""
    return M.quality_map(fx.quality_payloads, ["click", "view", "signup"])


@query("A23_distractor_recovery", f"""SELECT count(*) AS gold, sum(exact)::BIGINT AS exact, count(*) FILTER (best >= 0.5) AS fuzzy, round(100.0 * sum(exact) / count(*), 2) AS exact_rate, round(100.0 * count(*) FILTER (best >= 0.5) / count(*), 2) AS fuzzy_rate,
  {exact_mean_sql('best', 4)} AS mean_best, (SELECT {exact_mean_sql('s', 4)} FROM (SELECT question_id, max(s) AS s FROM {SIM} GROUP BY 1)) AS mean_best_cosine,
  (SELECT {exact_mean_sql('m', 3)} FROM {RATED} WHERE question_id % 2 = 0) AS face_ours, (SELECT {exact_mean_sql('m', 3)} FROM {RATED} WHERE question_id % 2 = 1) AS face_gold FROM {MATCH}""")
def distractor_recovery(fx):
    """Exact and fuzzy recovery over all gold options, mean best matches, and face ratings of ours and of gold."""
    best = matched(fx).agg(F.count("*").alias("gold"), F.sum("exact").alias("exact"), F.count_if(F.col("best") >= 0.5).alias("fuzzy"), F.round(100.0 * F.sum("exact") / F.count("*"), 2).alias("exact_rate"), F.round(100.0 * F.count_if(F.col("best") >= 0.5) / F.count("*"), 2).alias("fuzzy_rate"), exact_mean(F.col("best"), 4).alias("mean_best"))
    cosine = stem_rows(fx).groupBy("question_id").agg(F.max("s").alias("s")).agg(exact_mean(F.col("s"), 4).alias("mean_best_cosine"))
    of = lambda k: exact_mean(F.when(F.col("question_id") % 2 == k, F.col("mean")), 3)
    face = face_rows(fx).agg(of(0).alias("face_ours"), of(1).alias("face_gold"))
    return best.join(F.broadcast(cosine)).join(F.broadcast(face))  # a row each


@query("J15_response_lookup", """SELECT metric_key, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM (SELECT p.metric_key, r.question_id IS NOT NULL AS hit FROM metric_payloads p LEFT JOIN raw_responses r ON r.question_id = p.scope_id) GROUP BY 1""")
def response_lookup(fx):
    key = lambda c: R.response_key(F.lit("m"), F.col(c).cast("string"), F.lit(0.7), F.lit(True))
    stored = fx.raw_responses.select(key("question_id").alias("prompt_hash"), F.lit(True).alias("found"))
    asked = fx.metric_payloads.select("metric_key", key("scope_id").alias("prompt_hash"))
    hit = F.col("found").isNotNull()
    return asked.join(stored, "prompt_hash", "left").groupBy("metric_key").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))


@query("J14_resume_anti_join", "SELECT q.question_id FROM (SELECT DISTINCT question_id, 3 AS n_trials FROM trials) q LEFT JOIN (SELECT question_id, (question_id % 4)::INT AS n_trials FROM raw_responses) c ON c.question_id = q.question_id AND c.n_trials = q.n_trials WHERE c.question_id IS NULL")
def resume_anti_join(fx):
    cache = fx.raw_responses.select("question_id", (F.col("question_id") % 4).cast("int").alias("n_trials"))
    return fx.trials.select("question_id", F.lit(3).alias("n_trials")).distinct().join(cache, ["question_id", "n_trials"], "left_anti").select("question_id")


@query("L20_metric_traffic_light", f"SELECT question_id, CASE WHEN p >= 0.6 AND p < 0.9 THEN 'good' WHEN p >= 0.3 THEN 'warn' WHEN p IS NOT NULL THEN 'bad' ELSE 'none' END AS tone FROM {ITEM}")
def metric_traffic_light(fx):
    p = F.col("p_value")
    exact = M.item_difficulty(fx.trials).withColumn("t", F.when(F.col("label") == "appropriate", "good").when(F.col("label").isin("hard", "trivially_easy"), "warn").when(p.isNotNull(), "bad").otherwise("none"))
    return exact.select("question_id", F.col("t").alias("tone"))
