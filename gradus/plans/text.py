"""Queries of text profiling (X*), readability, languages and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import text as T
from gradus.functions.responses import content_hash
from gradus.operators import vocabulary as V
from gradus.sources.fixture_sql import TOK

from gradus.operators import structure as S

from .registry import query

SENT = "CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[.!?]+'))) END"
WORDS = f"len(regexp_extract_all(coalesce(text, ''), '{TOK}'))"
SYL = f"coalesce(list_sum([greatest(1, len(regexp_extract_all(w, '{T.VOWELS}'))) for w in regexp_extract_all(coalesce(text, ''), '{TOK}')]), 0)::BIGINT"
COUNTS = f"(SELECT *, {SENT} AS sentences, {WORDS} AS words, {SYL} AS syllables FROM documents)"
GRADED = f"""(SELECT *, round(206.835::DOUBLE - 1.015::DOUBLE * (words / nullif(sentences, 0)) - 84.6::DOUBLE * (syllables / nullif(words, 0)), 1) AS ease,
  round(0.39::DOUBLE * (words / nullif(sentences, 0)) + 11.8::DOUBLE * (syllables / nullif(words, 0)) - 15.59::DOUBLE, 1) AS grade FROM {COUNTS})"""
BUCKET = "CASE WHEN grade < 6 THEN 'easy' WHEN grade < 12 THEN 'medium' WHEN grade IS NOT NULL THEN 'hard' END"


def counted(df, c="text"):
    return df.withColumns({"sentences": T.count_sentences(F.col(c)), "words": T.count_words(F.col(c)), "syllables": T.count_syllables(F.col(c))})


def graded(df, c="text"):
    s, w, y = F.col("sentences"), F.col("words"), F.col("syllables")
    return counted(df, c).withColumns({"ease": T.flesch_ease(s, w, y), "grade": T.kincaid_grade(s, w, y)})


@query("X1_tokens", f"SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOK}')) AS t FROM documents) GROUP BY t")
def tokens(fx):
    return fx.documents.select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("X2_jaccard", f"""SELECT question_id, i, j, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 9) AS jaccard FROM
 (SELECT x.question_id, x.i, y.i AS j, regexp_extract_all(lower(x.o), '{TOK}') AS a, regexp_extract_all(lower(y.o), '{TOK}') AS b FROM
  (SELECT question_id, unnest(range(len(options))) AS i, unnest(options) AS o FROM questions) x JOIN (SELECT question_id, unnest(range(len(options))) AS i, unnest(options) AS o FROM questions) y ON x.question_id = y.question_id AND x.i < y.i)""")
def jaccard(fx):
    o = fx.questions.select("question_id", F.posexplode("options").alias("i", "o")).withColumn("t", T.tokens(F.col("o")))
    pairs = o.select("question_id", "i", F.col("t").alias("a")).join(o.select("question_id", F.col("i").alias("j"), F.col("t").alias("b")), "question_id").where("i < j")
    return pairs.select("question_id", "i", "j", F.round(T.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@query("X3_counts", f"SELECT doc_id, sentences, words, syllables FROM {COUNTS}")
def counts(fx):
    return counted(fx.documents).select("doc_id", "sentences", "words", "syllables")


@query("X4_flesch", f"SELECT doc_id, ease, grade FROM {GRADED}")
def flesch(fx):
    return graded(fx.documents).select("doc_id", "ease", "grade")


LV = "['unistructural', 'multistructural', 'relational', 'extended_abstract']"
FIT = "CASE WHEN grade IS NULL THEN 'unknown' WHEN grade < 4 + 2 * (doc_id % 4) THEN 'too_easy' WHEN grade > 10 + 2 * (doc_id % 4) THEN 'too_hard' ELSE 'in_range' END"


def fitted(fx):
    level = F.element_at(F.array(*[F.lit(x) for x in T.GRADE_TARGETS]), (F.col("doc_id") % 4 + 1).cast("int"))
    out = graded(fx.documents).withColumn("solo_level", level)
    return out.withColumns({"fit": T.grade_fit(F.col("grade"), F.col("solo_level")), "bucket": T.grade_bucket(F.col("grade"))})


@query("X5_readability_fit", f"SELECT doc_id, {LV}[doc_id % 4 + 1] AS solo_level, {FIT} AS fit, {BUCKET} AS bucket FROM {GRADED}")
def readability_fit(fx):
    return fitted(fx).select("doc_id", "solo_level", "fit", "bucket")


@query("A3_readability_report", f"""SELECT lang, source, {T.exact_mean_sql('grade', 2)} AS mean_grade, {T.exact_mean_sql('ease', 2)} AS mean_ease, count(*) AS n, count(*) FILTER ({BUCKET} = 'easy') AS easy, count(*) FILTER ({BUCKET} = 'medium') AS medium,
  count(*) FILTER ({BUCKET} = 'hard') AS hard, count(*) FILTER ({FIT} = 'in_range') AS in_range, count(*) FILTER ({FIT} = 'too_easy') AS too_easy, count(*) FILTER ({FIT} = 'too_hard') AS too_hard FROM {GRADED} GROUP BY 1, 2""")
def readability_report(fx):
    """Grade, ease, buckets and fit for each language and source, in one pass."""
    is_ = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return fitted(fx).groupBy("lang", "source").agg(
        T.exact_mean(F.col("grade"), 2).alias("mean_grade"), T.exact_mean(F.col("ease"), 2).alias("mean_ease"), F.count("*").alias("n"),
        *[is_("bucket", b) for b in ("easy", "medium", "hard")], *[is_("fit", f) for f in ("in_range", "too_easy", "too_hard")],
    )


def listed(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("X6_detect_language", f"""SELECT doc_id, CASE WHEN regexp_matches(s, '{T.CYRILLIC}') OR d >= 2 OR (d + sr > en AND d + sr >= 1) THEN 'sr' ELSE 'en' END AS detected FROM
  (SELECT doc_id, s, len(regexp_extract_all(s, '{T.SR_LETTERS}')) AS d, len([w for w in t if list_contains({listed(T.SR_WORDS)}, w)]) AS sr, len([w for w in t if list_contains({listed(T.EN_WORDS)}, w)]) AS en FROM
  (SELECT doc_id, s, regexp_extract_all(lower(s), '{TOK}') AS t FROM (SELECT doc_id, substr(text, 1, 5000) AS s FROM documents)))""")
def detect_language(fx):
    return fx.documents.select("doc_id", T.detect_language(F.col("text")).alias("detected"))


@query("X7_normalize_concept", r"SELECT lo_id, regexp_replace(trim(lower(title)), '\s+', ' ', 'g') AS norm FROM learning_objects")
def normalize_concept(fx):
    return fx.learning_objects.select("lo_id", T.normalize_concept(F.col("title")).alias("norm"))


@query("X8_question_blob", "SELECT question_id, md5(concat_ws(' ', question_text, correct_answer, array_to_string(options, ' '))) AS blob FROM questions")
def question_blob(fx):
    return fx.questions.select("question_id", F.md5(F.concat_ws(" ", "question_text", "correct_answer", F.array_join("options", " "))).alias("blob"))


HEAD = r"""CASE WHEN length(h) BETWEEN 3 AND 80 AND len(string_split(regexp_replace(h, '\s+', ' ', 'g'), ' ')) <= 10 AND NOT ends_with(h, '.') AND NOT regexp_matches(h, '^\p{Ll}') THEN h END"""


@query("X10_slide_heading", f"SELECT lesson_id, {HEAD} AS heading FROM (SELECT lesson_id, [y for y in [trim(x) for x in string_split(raw_content, chr(10))] if y <> ''][1] AS h FROM lessons)")
def slide_heading(fx):
    return fx.lessons.select("lesson_id", T.slide_heading(F.col("raw_content")).alias("heading"))


@query("X11_find_all", """SELECT lesson_id, least(len(p) - 1, 200) AS hits, CASE WHEN len(p) > 1 THEN length(p[1]) END AS first_hit, CASE WHEN len(p) > 2 THEN length(p[1]) + length(p[2]) + 4 END AS second_hit
  FROM (SELECT lesson_id, string_split(raw_content, 'tion') AS p FROM lessons)""")
def find_all(fx):
    found = T.offsets_of(F.col("raw_content"), F.lit("tion"))
    rows = fx.lessons.select("lesson_id", found.alias("at"))
    return rows.select("lesson_id", F.size("at").alias("hits"), F.get("at", F.lit(0)).alias("first_hit"), F.get("at", F.lit(1)).alias("second_hit"))


ALIASES = ", ".join(f"('{a}', '{c}')" for a, c in V.LO_TYPES.items())


@query("X20_normalize_lo_type", f"SELECT lo_id, coalesce(c, 'concept') AS lo_type FROM learning_objects LEFT JOIN (VALUES {ALIASES}) v(a, c) ON lower(trim(object_type)) = a")
def normalize_lo_type(fx):
    return fx.learning_objects.select("lo_id", V.lo_type(F.col("object_type")).alias("lo_type"))


def case_sql(column: str, mapping: dict, default: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


#: Types of questions by their number of options, and names of Bloom levels, some unknown.
ASKED_AS = ["open", "short_answer", "True_False", "riddle", " MCQ ", "multiple_choice", "Essay"]
BLOOMS = ["remember", "Understand ", "apply", "analyse", "evaluate", "create", "guess"]


@query("X21_vocabulary_maps", f"""SELECT kind, value, mapped, count(*) AS n FROM (
  SELECT 'relation' AS kind, relationship_type AS value, {case_sql("replace(lower(trim(relationship_type)), ' ', '_')", V.RELATIONS, "'relatedTo'")} AS mapped FROM edges UNION ALL
  SELECT 'object', object_type, {case_sql("lower(trim(object_type))", V.OBJECT_CLASSES, "'LearningObject'")} FROM learning_objects UNION ALL
  SELECT 'level', solo_level, {case_sql("replace(lower(trim(solo_level)), ' ', '_')", V.SOLO, "'Unistructural'")} FROM questions UNION ALL
  SELECT 'question', t, {case_sql("lower(trim(t))", V.QUESTION_CLASSES, "'Question'")} FROM (SELECT {ASKED_AS}[len(options) + 1] AS t FROM questions) UNION ALL
  SELECT 'bloom', b, {case_sql("lower(trim(b))", V.BLOOM, "NULL")} FROM (SELECT {BLOOMS}[question_id % {len(BLOOMS)} + 1] AS b FROM questions)) GROUP BY ALL""")
def vocabulary_maps(fx):
    rows = fx.edges.select(F.lit("relation").alias("kind"), F.col("relationship_type").alias("value"), V.relation(F.col("relationship_type")).alias("mapped"))
    rows = rows.unionByName(fx.learning_objects.select(F.lit("object").alias("kind"), F.col("object_type").alias("value"), V.object_class(F.col("object_type")).alias("mapped")))
    rows = rows.unionByName(fx.questions.select(F.lit("level").alias("kind"), F.col("solo_level").alias("value"), V.solo(F.col("solo_level")).alias("mapped")))
    asked = F.get(F.array(*[F.lit(x) for x in ASKED_AS]), F.size("options"))
    bloom = F.get(F.array(*[F.lit(x) for x in BLOOMS]), (F.col("question_id") % len(BLOOMS)).cast("int"))
    rows = rows.unionByName(fx.questions.select(F.lit("question").alias("kind"), asked.alias("value"), V.question_class(asked).alias("mapped")))
    rows = rows.unionByName(fx.questions.select(F.lit("bloom").alias("kind"), bloom.alias("value"), V.bloom(bloom).alias("mapped")))
    return rows.groupBy("kind", "value", "mapped").agg(F.count("*").alias("n"))


@query("X22_make_iri", r"""SELECT lo_id, CASE WHEN title = '' THEN 'LO_Unknown' ELSE 'LO_' || CASE WHEN regexp_matches(c, '^[0-9]') THEN 'N_' || c ELSE c END END AS iri
  FROM (SELECT lo_id, title, regexp_replace(regexp_replace(regexp_replace(title, '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS c FROM learning_objects)""")
def make_iri(fx):
    return fx.learning_objects.select("lo_id", T.make_iri(F.col("title"), "LO_").alias("iri"))


@query("X23_escape_literal", r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) AS escaped FROM documents""")
def escape_literal(fx):
    return fx.documents.select("doc_id", F.md5(T.escape_literal(F.col("text"))).alias("escaped"))


STEM = "CASE WHEN length(w) > 5 AND ends_with(w, 'ies') THEN left(w, -3) WHEN length(w) > 4 AND ends_with(w, 'es') THEN left(w, -2) WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, -1) WHEN length(w) > 5 AND ends_with(w, 'ing') THEN left(w, -3) WHEN length(w) > 4 AND ends_with(w, 'ed') THEN left(w, -2) ELSE w END"


@query("X24_crude_stem", f"SELECT lo_id, array_to_string([{STEM} for w in string_split(regexp_replace(lower(content), '[^a-z0-9 ]', '', 'g'), ' ') if w <> ''], ' ') AS stemmed FROM learning_objects")
def crude_stem(fx):
    return fx.learning_objects.select("lo_id", F.array_join(T.stemmed(F.col("content")), " ").alias("stemmed"))


@query("X25_strip_markers", r"SELECT doc_id, md5(trim(regexp_replace(replace('<hl>' || text, '<hl>', ' '), '\s+', ' ', 'g'))) AS clean FROM documents")
def strip_markers(fx):
    return fx.documents.select("doc_id", F.md5(T.strip_markers(F.concat(F.lit("<hl>"), "text"))).alias("clean"))


def typo_sql(x: str) -> str:
    for raw, plain in T.TYPOGRAPHY.items():
        x = f"replace({x}, '{raw}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return x


@query("X26_typography", rf"SELECT doc_id, md5(regexp_replace({typo_sql('text')}, '[^\x00-\xFF]', '?', 'g')) AS plain FROM documents")
def typography(fx):
    return fx.documents.select("doc_id", F.md5(T.latinize(F.col("text"))).alias("plain"))


@query("X28_content_hash", "SELECT doc_id, sha256('m||' || text) AS key FROM documents")
def hashed(fx):
    return fx.documents.select("doc_id", content_hash(F.lit("m"), F.col("text")).alias("key"))


SAMPLE = 14_000
JOINED = "SELECT lesson_id, string_agg(chr(10) || '--- Page ' || page || ' ---' || chr(10) || page_text, '' ORDER BY page) AS raw, count(*) AS n FROM lesson_pages GROUP BY 1"
PARTS = r"""string_agg(CASE WHEN page = 1 THEN '=== PAGE 1 (first page, full) ===' || chr(10) || body WHEN page = n THEN '=== PAGE ' || page || ' (last page, full) ===' || chr(10) || body
  WHEN trim(regexp_replace(body, '^\s+|\s+$', '', 'g')) <> '' THEN '=== PAGE ' || page || ' (top excerpt) ===' || chr(10) || substr(regexp_replace(body, '^\s+|\s+$', '', 'g'), 1, 300) END, chr(10) ORDER BY page)"""


@query("X15_outline_sample", f"""SELECT lesson_id, md5(CASE WHEN length(raw) <= {SAMPLE} THEN raw WHEN n < 2 THEN raw[1:{SAMPLE * 7 // 10}] || chr(10) || chr(10) || '[... omitted middle ...]' || chr(10) || chr(10) || right(raw, {SAMPLE * 3 // 10})
  WHEN length(s) > {SAMPLE} THEN substr(s, 1, {SAMPLE}) || chr(10) || '[... truncated ...]' ELSE s END) AS sample FROM ({JOINED}) JOIN (SELECT lesson_id, {PARTS} AS s FROM (SELECT lesson_id, page, chr(10) || '--- Page ' || page || ' ---' || chr(10) || page_text AS body, count(*) OVER (PARTITION BY lesson_id) AS n FROM lesson_pages) GROUP BY 1) USING (lesson_id)""")
def outline_sample(fx):
    return S.outline_sample(fx.lesson_pages, SAMPLE).select("lesson_id", F.md5("sample").alias("sample"))


@query("X16_content_for_pages", "SELECT lesson_id, string_agg(page_text, chr(10) ORDER BY page) AS content FROM lesson_pages WHERE page BETWEEN 2 AND 5 AND page <> 3 GROUP BY lesson_id")
def content_for_pages(fx):
    p = fx.lesson_pages.where("page BETWEEN 2 AND 5 AND page <> 3").groupBy("lesson_id").agg(F.sort_array(F.collect_list(F.struct("page", "page_text"))).alias("r"))
    return p.select("lesson_id", F.array_join(F.transform("r", lambda x: x["page_text"]), "\n").alias("content"))


@query("X17_section_content_lines", """SELECT lesson_id, md5(CASE WHEN len(l) > 0 THEN array_to_string(l[1:50], chr(10)) ELSE substr(raw_content, 1, 1500) END) AS content FROM
  (SELECT *, [x for x in string_split(raw_content, chr(10)) if contains(lower(x), 'tion') OR contains(lower(x), lower(title))] AS l FROM lessons)""")
def section_content_lines(fx):
    lines = F.filter(F.split("raw_content", "\n"), lambda x: F.contains(F.lower(x), F.lit("tion")) | F.contains(F.lower(x), F.lower("title")))
    body = F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, 50), "\n")).otherwise(F.substring("raw_content", 1, 1500))
    return fx.lessons.select("lesson_id", F.md5(body).alias("content"))


@query("X18_section_target", """SELECT lesson_id, CASE WHEN c // n < 600 THEN greatest(5, least(40, n // 2)) ELSE greatest(3, least(35, c // 1800)) END AS target FROM
  (SELECT lesson_id, sum(length(page_text))::BIGINT AS c, count(*) AS n FROM lesson_pages GROUP BY 1)""")
def section_target(fx):
    p = fx.lesson_pages.groupBy("lesson_id").agg(F.sum(F.length("page_text")).alias("c"), F.count("*").alias("n"))
    return p.select("lesson_id", F.expr("CASE WHEN c div n < 600 THEN greatest(5, least(40, n div 2)) ELSE greatest(3, least(35, c div 1800)) END").alias("target"))


@query("X27_direction_fix", """SELECT source_id, target_id, relationship_type, CASE WHEN relationship_type = 'part_of' AND contains(lower(t.title), lower(s.title)) AND s.title <> t.title THEN target_id ELSE source_id END AS new_source,
  CASE WHEN relationship_type = 'part_of' AND contains(lower(t.title), lower(s.title)) AND s.title <> t.title THEN source_id ELSE target_id END AS new_target
  FROM edges JOIN learning_objects s ON s.lo_id = source_id JOIN learning_objects t ON t.lo_id = target_id""")
def direction_fix(fx):
    lo = fx.learning_objects
    e = fx.edges.join(lo.select(F.col("lo_id").alias("source_id"), F.col("title").alias("st")), "source_id").join(lo.select(F.col("lo_id").alias("target_id"), F.col("title").alias("tt")), "target_id")
    swap = (F.col("relationship_type") == "part_of") & F.contains(F.lower("tt"), F.lower("st")) & (F.col("st") != F.col("tt"))
    return e.select("source_id", "target_id", "relationship_type", F.when(swap, F.col("target_id")).otherwise(F.col("source_id")).alias("new_source"), F.when(swap, F.col("source_id")).otherwise(F.col("target_id")).alias("new_target"))
