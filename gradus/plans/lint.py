"""Queries of the lint rules (L*), their reports, and options."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.operators import lint as L
from gradus.operators import nearest as N
from gradus.sources.fixture_sql import TOK

from gradus.sources.io import saved

from .registry import query

O = "[trim(coalesce(o, '')) for o in options]"
STEM = "trim(coalesce(question_text, ''))"


def toks(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '{TOK}')"


def jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


IMP = rf"^({L.IMPERATIVES})([^\p{{L}}\p{{N}}_]|$)"
NEG = "[" + ", ".join(f"'{w}'" for w in L.STRONG_NEGATIONS) + "]"
RULES = {
    "no_stem": f"{STEM} = ''",
    "unclear": f"{STEM} <> '' AND NOT contains({STEM}, '?') AND NOT regexp_matches(lower({STEM}), '{IMP}')",
    "long": f"length({STEM}) > 250",
    "negative": f"list_has_any({toks(STEM)}, {NEG}) AND NOT regexp_matches({STEM}, '{L.EMPHASIS}')",
    "count": "len(o) NOT BETWEEN 3 AND 5",
}
#: Question rows with trimmed options (o), their tokens (t) and key text (k).
Q = f"(SELECT *, [{toks('x')} for x in o] AS t, CASE WHEN correct_option_index >= 0 THEN o[correct_option_index + 1] END AS k FROM (SELECT *, {O} AS o FROM questions))"
BLANK = "[i - 1 for i in range(1, len(o) + 1) if o[i] = '']"
KEYP = """CASE WHEN correct_option_index IS NULL THEN 'H19_NO_KEY' WHEN correct_option_index < 0 OR correct_option_index >= len(o) THEN 'H19_KEY_OUT_OF_RANGE'
  WHEN lower(trim(coalesce(correct_answer, ''))) <> '' AND lower(k) <> lower(trim(coalesce(correct_answer, ''))) THEN 'H19_KEY_MISMATCH' END"""
PAIRS = f"[(p // 100)::VARCHAR || '-' || (p % 100)::VARCHAR for p in list_distinct(flatten([[(i - 1) * 100 + j - 1 for j in range(1, len(t) + 1) if i < j AND {jac('t[i]', 't[j]')} >= 0.7] for i in range(1, len(t) + 1)]))]"
EQKEY = f"[i - 1 for i in range(1, len(o) + 1) if k IS NOT NULL AND i - 1 <> correct_option_index AND len({toks('k')}) > 0 AND list_sort(t[i]) = list_sort({toks('k')})]"
LENS = "[length(x) for x in o if length(x) > 0]"
DISP = f"coalesce(len({LENS}) >= 2 AND list_max({LENS}) / list_min({LENS}) > 2, false)"
KLEN = f"CASE WHEN k IS NOT NULL AND len({LENS}) >= 2 AND list_max({LENS}) <> list_min({LENS}) THEN CASE WHEN length(k) = list_max({LENS}) THEN 'H27_CORRECT_LONGEST' WHEN length(k) = list_min({LENS}) THEN 'H27_CORRECT_SHORTEST' END END"
AOTA = f"[i - 1 for i in range(1, len(o) + 1) if regexp_matches(array_to_string(t[i], ' '), '(^| )({L.ALL_OR_NONE})( |$)')]"
NUMERIC = """CASE WHEN len(o) >= 2 AND len([x for x in o if regexp_matches(x, '^-?[0-9]+([.,][0-9]+)?$')]) = len(o) THEN
  v <> list_sort(v) AND v <> list_reverse(list_sort(v)) ELSE false END"""
NQ = "(SELECT *, [try_cast(replace(x, ',', '.') AS DOUBLE) for x in o] AS v FROM (SELECT *, [trim(x) for x in options] AS o FROM {src}))"


def simple(name: str, rule, sql: str):
    query(name, f"SELECT question_id, {sql} AS hit FROM {Q}")(lambda fx: fx.questions.select("question_id", rule(fx.questions).alias("hit")))


simple("L1_no_stem", L.no_stem, RULES["no_stem"])
simple("L2_unclear_directive", L.unclear_directive, RULES["unclear"])
simple("L3_long_stem", L.long_stem, RULES["long"])
simple("L4_negative_stem", L.negative_stem, RULES["negative"])
simple("L5_option_count", L.option_count, RULES["count"])
simple("L6_blank", lambda q: F.concat_ws(",", L.blank_positions(q).cast("array<string>")), f"array_to_string({BLANK}, ',')")
simple("L7_key_problem", L.key_problem, KEYP)
simple("L9_option_overlap", lambda q: F.concat_ws(",", F.sort_array(L.overlaps(q))), f"array_to_string(list_sort({PAIRS}), ',')")
simple("L10_equals_key", lambda q: F.concat_ws(",", L.equals_key(q).cast("array<string>")), f"array_to_string({EQKEY}, ',')")
simple("L11_length_disparity", L.length_disparity, DISP)
simple("L12_key_length", L.key_length, KLEN)
simple("L13_all_or_none", lambda q: F.concat_ws(",", L.all_or_none(q).cast("array<string>")), f"array_to_string({AOTA}, ',')")


@query("L8_numeric_disorder", f"SELECT question_id, {NUMERIC} AS hit FROM {NQ.format(src='numeric_questions')}")
def numeric_disorder(fx):
    q = fx.numeric_questions
    return q.select("question_id", L.numeric_disorder(q).alias("hit"))


FLAGS = f"""list_sort(list_concat([x for x in [CASE WHEN {RULES['no_stem']} THEN 'H14_NO_STEM' END, CASE WHEN {RULES['unclear']} THEN 'H14_UNCLEAR_DIRECTIVE' END, CASE WHEN {RULES['long']} THEN 'H16_LONG_STEM' END,
  CASE WHEN {RULES['negative']} THEN 'H17_NEGATIVE_STEM' END, CASE WHEN {RULES['count']} THEN 'H_OPTION_COUNT' END, CASE WHEN len({BLANK}) > 0 THEN 'H_BLANK' END, {KEYP},
  CASE WHEN {NUMERIC} THEN 'H21_NUMERIC_DISORDER' END, CASE WHEN {DISP} THEN 'H24_LENGTH_DISPARITY' END, {KLEN}] if x IS NOT NULL],
  list_concat(['H22_OPTION_OVERLAP' for x in {PAIRS}], list_concat(['H_DISTRACTOR_EQUALS_KEY' for x in {EQKEY}], ['H25_AOTA_NOTA' for x in {AOTA}]))))"""
ERR = "[" + ", ".join(f"'{c}'" for c in L.ERRORS) + "]"
QV = f"(SELECT *, [try_cast(replace(x, ',', '.') AS DOUBLE) for x in o] AS v FROM {Q})"
LINTED = f"""(SELECT *, len(flags) - errors AS warnings, greatest(0, 100 - 15 * errors - 5 * (len(flags) - errors)) AS score FROM
  (SELECT *, len([x for x in flags if list_contains({ERR}, x)]) AS errors FROM (SELECT *, {FLAGS} AS flags FROM {QV})))"""


@query("L17_lint_question", f"SELECT question_id, array_to_string(flags, ',') AS flags, errors, warnings, score FROM {LINTED}")
def lint_question(fx):
    return L.lint(fx.questions).withColumn("flags", F.concat_ws(",", "flags"))


@query("A2_lint_report", f"SELECT round(avg(score), 1) AS average_score, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, count(*) AS n FROM {LINTED}")
def lint_report(fx):
    return L.lint(fx.questions).agg(F.round(F.avg("score"), 1).alias("average_score"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.count("*").alias("n"))


@query("A2_flag_frequency", f"SELECT code, count(*) AS n FROM (SELECT unnest(flags) AS code FROM {LINTED}) GROUP BY code")
def flag_frequency(fx):
    return L.lint(fx.questions).select(F.explode("flags").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("L19_wrong_key_variant", "SELECT question_id, CASE WHEN correct_option_index = 0 THEN 1 ELSE 0 END AS correct_option_index, options[CASE WHEN correct_option_index = 0 THEN 2 ELSE 1 END] AS correct_answer FROM questions")
def wrong_key_variant(fx):
    return L.wrong_key(fx.questions).select("question_id", "correct_option_index", "correct_answer")


@query("S6_normalize_options", f"SELECT question_id, array_to_string({O}, '|') AS options FROM questions")
def normalize_options(fx):
    q = fx.questions.withColumn("o", F.transform("options", lambda o: F.struct(F.when(F.length(o) % 2 == 0, o).alias("text"), o.alias("value"))))
    return q.select("question_id", F.concat_ws("|", L.normalize_options(F.col("o"))).alias("options"))


COS = "(SELECT a.question_id, a.pos AS i, b.pos AS j, list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))) AS cosine FROM option_vectors a JOIN option_vectors b ON a.question_id = b.question_id AND a.pos < b.pos)"


@query("E1_cosine", f"SELECT question_id, i, j, round(cosine, 9) AS cosine FROM {COS}")
def cosine_pairs(fx):
    return L.option_pairs(fx.option_vectors).withColumn("cosine", F.round("cosine", 9))


@query("L14_plausibility", f"SELECT question_id, j AS option, CASE WHEN cosine < 0.4 THEN 'D_PLAUS_TOO_LOW' WHEN cosine > 0.92 THEN 'D_PLAUS_TOO_HIGH' END AS code FROM {COS} WHERE i = 0 AND (cosine < 0.4 OR cosine > 0.92)")
def plausibility(fx):
    p = L.option_pairs(fx.option_vectors).where("i = 0")
    code = F.when(F.col("cosine") < L.PLAUSIBLE_FROM, "D_PLAUS_TOO_LOW").when(F.col("cosine") > L.PLAUSIBLE_TO, "D_PLAUS_TOO_HIGH")
    return p.select("question_id", F.col("j").alias("option"), code.alias("code")).where("code IS NOT NULL")


@query("L15_diversity_low", f"SELECT question_id, i, j FROM {COS} WHERE i > 0 AND cosine > 0.92")
def diversity_low(fx):
    return L.option_pairs(fx.option_vectors).where((F.col("i") > 0) & (F.col("cosine") > L.DIVERSE_TO)).select("question_id", "i", "j")


@query("L16_plausibility_diversity", f"""SELECT question_id, round(avg(cosine) FILTER (i = 0), 6) AS plausibility, round(1 - avg(cosine) FILTER (i > 0), 6) AS diversity FROM {COS}
  WHERE question_id IN (SELECT question_id FROM option_vectors GROUP BY 1 HAVING count(*) = 4) GROUP BY question_id""")
def plausibility_diversity(fx):
    v = fx.option_vectors
    whole = v.groupBy("question_id").agg(F.count("vector").alias("n")).where("n = 4")
    p = L.option_pairs(v.join(whole, "question_id", "left_semi"))
    return p.groupBy("question_id").agg(F.round(F.avg(F.when(F.col("i") == 0, F.col("cosine"))), 6).alias("plausibility"), F.round(1 - F.avg(F.when(F.col("i") > 0, F.col("cosine"))), 6).alias("diversity"))


@query("A2_lint_report_vectors", f"""SELECT count(*) AS n, round(avg(score), 1) AS average_score, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, round(avg(p::DECIMAL(20, 6)), 3)::DOUBLE AS mean_plausibility, round(avg(d::DECIMAL(20, 6)), 3)::DOUBLE AS mean_diversity, round(100.0 * count(p) / count(*), 1)::DOUBLE AS coverage
  FROM {LINTED} l LEFT JOIN (SELECT question_id * 1000 AS q, avg(cosine) FILTER (i = 0) AS p, 1 - avg(cosine) FILTER (i > 0) AS d FROM {COS} WHERE question_id IN (SELECT question_id FROM option_vectors GROUP BY 1 HAVING count(*) = 4) GROUP BY 1) v ON v.q = l.question_id""")
def lint_report_vectors(fx):
    """The first question of a conversation has the vectors of its number."""
    v = plausibility_diversity(fx)
    return L.report(L.lint(fx.questions), v.withColumn("question_id", F.col("question_id") * 1000))


@query("E2_best_match", f"SELECT question_id, j AS target, round(max(cosine), 9) AS best FROM (SELECT * FROM {COS} UNION ALL SELECT question_id, j, i, cosine FROM {COS}) GROUP BY 1, 2")
def best_match(fx):
    p = L.option_pairs(fx.option_vectors)
    both = p.unionByName(p.select("question_id", F.col("j").alias("i"), F.col("i").alias("j"), "cosine"))
    return both.groupBy("question_id", F.col("j").alias("target")).agg(F.round(F.max("cosine"), 9).alias("best"))


OPTIONS = "(SELECT question_id * 4 + pos AS id, pos, vector, sqrt(list_dot_product(vector, vector)) AS norm FROM option_vectors)"


@query("E2_best_match_all", f"""SELECT t.id AS target, round(max(list_dot_product(t.vector, c.vector) / (t.norm * c.norm)) FILTER (list_dot_product(t.vector, c.vector) / (t.norm * c.norm) >= 0.75), 9) AS best
  FROM {OPTIONS} t JOIN {OPTIONS} c ON t.pos % 2 = 0 AND c.pos % 2 = 1 GROUP BY t.id""")
def best_match_all(fx):
    """Keys and second distractors as targets, first and third distractors of all questions as candidates; no match below 0.75."""
    v = saved(fx.option_vectors.select((F.col("question_id") * 4 + F.col("pos")).alias("id"), "pos", "vector"), "options")
    targets = v.where("pos IN (0, 2)").select("id", "vector")
    best = N.best_matches(targets, v.where("pos IN (1, 3)").select("id", "vector"), 0.75, 1e-9)
    return targets.select(F.col("id").alias("target")).join(best, "target", "left").select("target", F.round("cosine", 9).alias("best"))


@query("F13_option_count_4", "SELECT question_id FROM questions WHERE len(options) = 4")
def option_count_4(fx):
    return fx.questions.where("size(options) = 4").select("question_id")


@query("A17_failure_rates", f"""SELECT key_kind, key, count(*) AS total, count(*) FILTER (errors > 0) AS with_error, count(*) FILTER (list_contains(flags, 'H16_LONG_STEM')) AS long_stem, count(*) FILTER (list_contains(flags, 'H17_NEGATIVE_STEM')) AS negative,
  round(100 * count(*) FILTER (errors > 0) / count(*), 2) AS error_rate FROM (SELECT 'level' AS key_kind, solo_level AS key, * FROM {LINTED} UNION ALL SELECT 'lesson', 'Lesson ' || primary_lesson_id, * FROM {LINTED}) GROUP BY 1, 2""")
def failure_rates(fx):
    q = L.lint(fx.questions, keep=("solo_level", "primary_lesson_id")).withColumn("lesson", F.concat(F.lit("Lesson "), F.col("primary_lesson_id").cast("string")))
    has = lambda code: F.count_if(F.array_contains("flags", code))
    bad = F.count_if(F.col("errors") > 0)
    out = q.groupingSets([["solo_level"], ["lesson"]], "solo_level", "lesson").agg(
        F.grouping("solo_level").alias("by_lesson"), F.count("*").alias("total"), bad.alias("with_error"), has("H16_LONG_STEM").alias("long_stem"), has("H17_NEGATIVE_STEM").alias("negative"), F.round(100 * bad / F.count("*"), 2).alias("error_rate")
    )
    by_lesson = F.col("by_lesson") == 1
    return out.select(F.when(by_lesson, "lesson").otherwise("level").alias("key_kind"), F.when(by_lesson, F.col("lesson")).otherwise(F.col("solo_level")).alias("key"), "total", "with_error", "long_stem", "negative", "error_rate")


@query("A18_lo_clusters", f"""SELECT learning_object_id, count(*) AS total, count(*) FILTER (len(flags) > 0) AS flagged, substr(arg_min(question_text, question_id) FILTER (len(flags) > 0), 1, 80) AS first_stem
  FROM {LINTED} WHERE learning_object_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (len(flags) > 0) > 0 ORDER BY flagged DESC, learning_object_id LIMIT 10""")
def lo_clusters(fx):
    q = L.lint(fx.questions, keep=("learning_object_id", "question_text")).where("learning_object_id IS NOT NULL")
    hit = F.size("flags") > 0
    out = q.groupBy("learning_object_id").agg(F.count("*").alias("total"), F.count_if(hit).alias("flagged"), F.substring(F.min_by("question_text", F.when(hit, F.col("question_id"))), 1, 80).alias("first_stem"))
    return out.where("flagged > 0").orderBy(F.desc("flagged"), "learning_object_id").limit(10)


@query("T1_worst_questions", f"SELECT question_id, len(flags) AS n_flags FROM {LINTED} WHERE len(flags) > 0 ORDER BY n_flags DESC, question_id LIMIT 10")
def worst_questions(fx):
    return L.lint(fx.questions).select("question_id", F.size("flags").alias("n_flags")).where("n_flags > 0").orderBy(F.desc("n_flags"), "question_id").limit(10)
