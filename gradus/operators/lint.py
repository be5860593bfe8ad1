"""Item-writing rules over question rows, as built-in expressions: one scan, no shuffle, no Python.

A rule is a Column that is true where the rule is broken. `flags` collects the codes of a row; `score` is 100 less 15 an error and 5 a warning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import jaccard, tokens

# Word lists, patterns and limits of the rules.
IMPERATIVES = "definiši|navedi|opiši|objasni|odredi|izračunaj|define|describe|explain|determine|calculate"
STRONG_NEGATIONS = ["osim", "izuzev", "nije", "nisu", "netačno", "not", "except", "never", "incorrect"]
EMPHASIS = r"<b>|<strong>|\*\*|__|<u>"
ALL_OR_NONE = "all of the above|none of the above|svi (od )?navedeni[hm]?|nijedan (od )?navedeni[hm]?|sve (od )?navedeno|ništa (od )?navedeno"
LONG_STEM = 250
LENGTH_RATIO = 2.0
OVERLAP = 0.7
PLAUSIBLE_FROM, PLAUSIBLE_TO, DIVERSE_TO = 0.40, 0.92, 0.92


def option_text(options: Column) -> Column:
    """Trimmed option texts; null becomes empty."""
    return F.transform(options, lambda o: F.trim(F.coalesce(o, F.lit(""))))


def normalize_options(options: Column) -> Column:
    """Options given as struct<text, value>: text, else value, else empty; trimmed."""
    return F.transform(options, lambda o: F.trim(F.coalesce(F.nullif(o["text"], F.lit("")), o["value"], F.lit(""))))


def stem(q: DataFrame) -> Column:
    return F.trim(F.coalesce(q["question_text"], F.lit("")))


def options(q: DataFrame) -> Column:
    return option_text(F.coalesce(q["options"], F.array().cast("array<string>")))


def _key(q: DataFrame) -> Column:
    return F.get(options(q), q["correct_option_index"])


def _valid_key(q: DataFrame) -> Column:
    k = q["correct_option_index"]
    return F.coalesce((k >= 0) & (k < F.size(options(q))), F.lit(False))


def no_stem(q):
    return stem(q) == ""


def unclear_directive(q):
    return (stem(q) != "") & ~F.contains(stem(q), F.lit("?")) & ~F.lower(stem(q)).rlike(rf"^({IMPERATIVES})([^\p{{L}}\p{{N}}_]|$)")


def long_stem(q):
    return F.length(stem(q)) > LONG_STEM


def negative_stem(q):
    return F.exists(tokens(stem(q)), lambda t: t.isin(STRONG_NEGATIONS)) & ~stem(q).rlike(EMPHASIS)


def option_count(q):
    return ~F.size(options(q)).between(3, 5)


def blank_positions(q):
    return F.filter(F.transform(options(q), lambda o, i: F.when(o == "", i)), lambda i: i.isNotNull())


def key_problem(q):
    """NO_KEY, KEY_OUT_OF_RANGE or KEY_MISMATCH, the first that holds."""
    answer = F.lower(F.trim(F.coalesce(q["correct_answer"], F.lit("")))) if "correct_answer" in q.columns else F.lit("")
    return (
        F.when(q["correct_option_index"].isNull(), "H19_NO_KEY")
        .when(~_valid_key(q), "H19_KEY_OUT_OF_RANGE")
        .when((answer != "") & (F.lower(_key(q)) != answer), "H19_KEY_MISMATCH")
    )


def numeric_disorder(q):
    """Every option a number (a comma may be the decimal point) and neither order holds."""
    numeric = F.forall(options(q), lambda o: o.rlike(r"^-?[0-9]+([.,][0-9]+)?$")) & (F.size(options(q)) >= 2)
    values = F.transform(options(q), lambda o: F.replace(o, F.lit(","), F.lit(".")).try_cast("double"))
    up = F.sort_array(values)
    return F.coalesce(numeric & (values != up) & (values != F.reverse(up)), F.lit(False))


def overlaps(q):
    """Pairs 'i-j' of options whose token sets are alike."""
    o = F.transform(options(q), lambda x: tokens(x))
    pairs = F.flatten(F.transform(o, lambda a, i: F.transform(o, lambda b, j: F.when((i < j) & (jaccard(a, b) >= OVERLAP), F.concat_ws("-", i.cast("string"), j.cast("string"))))))
    return F.filter(pairs, lambda p: p.isNotNull())


def equals_key(q):
    """Positions of distractors with the key's tokens."""
    k = F.sort_array(tokens(_key(q)))
    at = F.transform(options(q), lambda o, i: F.when((i != q["correct_option_index"]) & (F.size(k) > 0) & (F.sort_array(tokens(o)) == k), i))
    return F.when(_valid_key(q), F.filter(at, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))


def _lengths(q):
    return F.filter(F.transform(options(q), lambda o: F.length(o)), lambda n: n > 0)


def length_disparity(q):
    n = _lengths(q)
    return F.coalesce((F.size(n) >= 2) & (F.array_max(n) / F.nullif(F.array_min(n), F.lit(0)) > LENGTH_RATIO), F.lit(False))


def key_length(q):
    """H27_CORRECT_LONGEST or H27_CORRECT_SHORTEST, where lengths differ at all."""
    n, k = _lengths(q), F.length(_key(q))
    clear = _valid_key(q) & (F.size(n) >= 2) & (F.array_max(n) != F.array_min(n))
    return F.when(clear & (k == F.array_max(n)), "H27_CORRECT_LONGEST").when(clear & (k == F.array_min(n)), "H27_CORRECT_SHORTEST")


def all_or_none(q):
    """Positions of options that say all or none of the above."""
    at = F.transform(options(q), lambda o, i: F.when(F.array_join(tokens(o), " ").rlike(f"(^| )({ALL_OR_NONE})( |$)"), i))
    return F.filter(at, lambda i: i.isNotNull())


def flags(q: DataFrame) -> Column:
    """Codes of all broken rules, one for each offence."""
    many = lambda positions, code: F.transform(positions, lambda _: F.lit(code))
    single = F.array_compact(F.array(
        F.when(no_stem(q), "H14_NO_STEM"), F.when(unclear_directive(q), "H14_UNCLEAR_DIRECTIVE"), F.when(long_stem(q), "H16_LONG_STEM"), F.when(negative_stem(q), "H17_NEGATIVE_STEM"),
        F.when(option_count(q), "H_OPTION_COUNT"), F.when(F.size(blank_positions(q)) > 0, "H_BLANK"), key_problem(q), F.when(numeric_disorder(q), "H21_NUMERIC_DISORDER"),
        F.when(length_disparity(q), "H24_LENGTH_DISPARITY"), key_length(q),
    ))
    return F.concat(single, many(overlaps(q), "H22_OPTION_OVERLAP"), many(equals_key(q), "H_DISTRACTOR_EQUALS_KEY"), many(all_or_none(q), "H25_AOTA_NOTA"))


ERRORS = ["H14_NO_STEM", "H_BLANK", "H19_NO_KEY", "H19_KEY_OUT_OF_RANGE", "H19_KEY_MISMATCH", "H_DISTRACTOR_EQUALS_KEY"]


def lint(q: DataFrame, key: str = "question_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to keep, flags sorted, errors, warnings, score) of each row."""
    out = q.select(q[key], *[q[c] for c in keep], F.sort_array(flags(q)).alias("flags"))
    out = out.withColumn("errors", F.size(F.filter("flags", lambda c: c.isin(ERRORS))))
    out = out.withColumn("warnings", F.size("flags") - F.col("errors"))
    return out.withColumn("score", F.greatest(F.lit(0), 100 - 15 * F.col("errors") - 5 * F.col("warnings")))


def report(linted: DataFrame, scored: DataFrame) -> DataFrame:
    """One row of linted (question_id, errors, warnings, score) and scored (question_id, plausibility, diversity; a row for each question that has vectors): mean score, offences, and
    the means of the vectors' scores with the share of questions, in percent, that have any."""
    j = linted.join(scored.select("question_id", "plausibility", "diversity", F.lit(True).alias("has")), "question_id", "left")
    return j.agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("average_score"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"),
        F.round(F.avg(F.col("plausibility").cast("decimal(20,6)")).cast("double"), 3).alias("mean_plausibility"), F.round(F.avg(F.col("diversity").cast("decimal(20,6)")).cast("double"), 3).alias("mean_diversity"),
        F.round(100.0 * F.count("has") / F.count("*"), 1).alias("coverage"),
    )


def wrong_key(q: DataFrame) -> DataFrame:
    """The bank with each key moved to the first other option."""
    moved = F.when(q["correct_option_index"] == 0, 1).otherwise(0)
    return q.withColumns({"correct_option_index": moved, "correct_answer": F.get(q["options"], moved)})


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null where either is empty, lengths differ, or a norm is 0."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), _dot(a, b) / F.nullif(norm, F.lit(0.0)))


def option_pairs(vectors: DataFrame) -> DataFrame:
    """(question_id, i, j, cosine) for i < j from rows (question_id, pos, vector), joined on the question."""
    a = vectors.select("question_id", F.col("pos").alias("i"), F.col("vector").alias("va"))
    b = vectors.select("question_id", F.col("pos").alias("j"), F.col("vector").alias("vb"))
    return a.join(b, "question_id").where("i < j").select("question_id", "i", "j", cosine(F.col("va"), F.col("vb")).alias("cosine"))


def corpus_flags(questions: DataFrame) -> DataFrame:
    """Linted questions (flags) with judgements (ambiguous, key_outlier, grammar, ioc_rating, cove_verdict; null where a response is missing): corpus_flags,
    has_length_clue, and flag_count, to which a length clue adds one."""
    grammar = F.when(F.col("key_outlier"), "GRAMMAR_CLUE").when(F.col("grammar") == "mixed", "GRAMMAR_MIXED")
    rated = F.when(F.col("ioc_rating") <= 0, F.concat(F.lit("IOC_"), F.col("ioc_rating").cast("string")))
    cove = F.when(F.col("cove_verdict").isin("UNDERDETERMINED", "CONTRADICTED"), F.concat(F.lit("COVE_"), "cove_verdict"))
    flags = F.array_compact(F.array(F.when(F.col("ambiguous"), "AMBIGUOUS"), grammar, rated, cove))
    clue = F.array_contains("flags", "H27_CORRECT_LONGEST")
    return questions.withColumn("corpus_flags", flags).withColumn("has_length_clue", clue).withColumn("flag_count", F.size("corpus_flags") + clue.cast("int"))
