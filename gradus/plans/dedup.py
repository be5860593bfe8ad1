"""Queries of duplicates (D*), snapshots (C*), lists of responses (R10-R12) and the rest of the text mining."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradus.functions import responses as R
from gradus.functions.text import jaccard, stemmed, tokens
from gradus.operators import dedup as D
from gradus.operators import lint as L
from gradus.operators import metrics as M
from gradus.operators import structure as S
from gradus.sources.fixture_sql import TOK
from gradus.sources.fixtures import HEADLINES, OVERVIEW

from .lint import LINTED
from .registry import query
from .structure import OFFS
from .text import ALIASES, STEM

NT = r"trim(regexp_replace(lower(trim(question_text)), '[^\p{L}\p{N}_\s]', '', 'g'))"
NA = r"nullif(trim(regexp_replace(lower(trim(correct_answer)), '^[a-z]\)\s*', '')), '')"


@query("D1_question_dedup_exact", f"SELECT min(question_id) AS question_id FROM questions GROUP BY md5({NT})")
def question_dedup_exact(fx):
    return D.keep_first(fx.questions, [F.md5(D.normal_text(F.col("question_text")))], "question_id").select("question_id")


@query("D2_question_dedup_answer", f"SELECT question_id FROM (SELECT question_id, {NA} AS a, row_number() OVER (PARTITION BY learning_object_id, {NA} ORDER BY question_id) AS r FROM questions) WHERE a IS NULL OR r = 1")
def question_dedup_answer(fx):
    return D.keep_first(fx.questions, [F.coalesce("learning_object_id", "question_section_id"), D.normal_answer(F.col("correct_answer"))], "question_id").select("question_id")


def pair_sql(src: str, t: float) -> str:
    return f"(SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS j FROM {src} a JOIN {src} b ON a.id < b.id WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= {t})"


QS = f"(SELECT * FROM (SELECT question_id AS id, list_distinct(regexp_extract_all(lower(question_text), '{TOK}')) AS t FROM questions) WHERE len(t) >= 12)"


def stems(fx):
    return fx.questions.select(F.col("question_id").alias("id"), tokens(F.col("question_text")).alias("tokens"))


@query("D3_question_near_pairs", f"SELECT a, b, round(j, 9) AS similarity FROM {pair_sql(QS, 0.7)}")
def question_near_pairs(fx):
    return D.similar_pairs(stems(fx), 0.7, 12, digits=9)


@query("D3_question_dedup_near")
def question_dedup_near(fx):
    """Greedy keep-first over the near pairs; rounds can't be written as one SQL query, so tests hold it against a loop."""
    return D.keep_first_near(stems(fx), 0.7, 12)


LS = f"(SELECT * FROM (SELECT section_id AS id, list_distinct([w for w in string_split_regex(lower(title), '\\s+') if length(w) >= 3]) AS t FROM sections) WHERE len(t) >= 1)"


def titles(fx):
    """Titles of all sections as words; sections of different lessons are compared too."""
    words = F.filter(F.split(F.lower("title"), r"\s+"), lambda w: F.length(w) >= 3)
    return fx.sections.select(F.col("section_id").alias("id"), words.alias("tokens"))


@query("D4_lo_near_pairs", f"SELECT a, b, round(j, 9) AS similarity FROM {pair_sql(LS, 0.6)}")
def lo_near_pairs(fx):
    return D.similar_pairs(titles(fx), 0.6, digits=9)


@query("D4_lo_dedup")
def lo_dedup(fx):
    some = titles(fx).where("size(tokens) > 0")
    return D.keep_first_near(some, 0.6)


@query("D5_edge_dedup", "SELECT l_partkey % 40 AS source_id, l_suppkey % 40 AS target_id, l_returnflag AS type, min(l_orderkey * 10 + l_linenumber) AS first_edge FROM lineitem GROUP BY 1, 2, 3")
def edge_dedup(fx):
    e = fx.lineitem.select((F.col("l_partkey") % 40).alias("source_id"), (F.col("l_suppkey") % 40).alias("target_id"), F.col("l_returnflag").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_edge"))
    return e.groupBy("source_id", "target_id", "type").agg(F.min("first_edge").alias("first_edge"))


NORMW = f"[{STEM} for w in string_split(regexp_replace(lower({{x}}), '[^a-z0-9 ]', '', 'g'), ' ') if w <> '']"
GOLD = f"(SELECT item_id, pos, {NORMW.format(x='s')} AS g FROM (SELECT item_id, unnest(range(len(x))) AS pos, unnest(x) AS s FROM (SELECT item_id, [trim(y) for y in string_split(text, '.') if trim(y) <> ''] AS x FROM benchmark)))"
OURS = f"(SELECT item_id, {NORMW.format(x='s')} AS o FROM (SELECT doc_id % (SELECT count(*) FROM benchmark) AS item_id, unnest([trim(y) for y in string_split(text, '.') if trim(y) <> '']) AS s FROM documents))"


def matched(fx):
    parts = lambda c: F.filter(F.transform(F.split(c, r"\."), lambda x: F.trim(x)), lambda x: x != "")
    gold = fx.benchmark.select("item_id", F.posexplode(parts("text")).alias("pos", "s")).select("item_id", "pos", stemmed(F.col("s")).alias("g"))
    items = fx.benchmark.agg(F.count("*").alias("items"))  # one row
    ours = fx.documents.join(F.broadcast(items)).select((F.col("doc_id") % F.col("items")).alias("item_id"), F.explode(parts("text")).alias("s")).select("item_id", stemmed(F.col("s")).alias("o")).distinct()
    j = gold.join(ours, "item_id", "left")
    return j.groupBy("item_id", "pos").agg(F.coalesce(F.max((F.col("g") == F.col("o")).cast("int")), F.lit(0)).alias("exact"), F.coalesce(F.max(jaccard(F.col("g"), F.col("o"))), F.lit(0.0)).alias("best"))


MATCH = f"(SELECT g.item_id, g.pos, coalesce(max((g.g = o.o)::INT), 0) AS exact, coalesce(max(CASE WHEN len(g.g) = 0 OR len(o.o) = 0 THEN 0.0 ELSE len(list_intersect(g.g, o.o)) / len(list_distinct(list_concat(g.g, o.o))) END), 0.0) AS best FROM {GOLD} g LEFT JOIN {OURS} o ON o.item_id = g.item_id GROUP BY 1, 2)"


@query("D6_distractor_match", f"SELECT item_id, pos, exact, round(best, 9) AS best, best >= 0.5 AS fuzzy FROM {MATCH}")
def distractor_match(fx):
    return matched(fx).select("item_id", "pos", "exact", F.round("best", 9).alias("best"), (F.col("best") >= 0.5).alias("fuzzy"))


@query("D6_best_over_all", f"""WITH g AS {GOLD}, o AS (SELECT DISTINCT list_distinct(o) AS o FROM {OURS} WHERE len(o) > 0), w AS (SELECT DISTINCT list_distinct(g) AS g FROM g WHERE len(g) > 0),
  b AS (SELECT w.g, max(len(list_intersect(w.g, o.o)) / len(list_distinct(list_concat(w.g, o.o)))) AS best FROM w JOIN o ON len(o.o) >= 0.5 * len(w.g) AND len(w.g) >= 0.5 * len(o.o) GROUP BY 1)
  SELECT g.item_id, g.pos, round(CASE WHEN b.best >= 0.5 THEN b.best END, 9) AS best, len(g.g) > 0 AND g.g IN (SELECT o FROM {OURS}) AS exact FROM g LEFT JOIN b ON b.g = list_distinct(g.g)""")
def best_over_all(fx):
    """Each sentence of an item against the sentences of all documents; no match below 0.5."""
    parts = lambda c: F.filter(F.transform(F.split(c, r"\."), lambda x: F.trim(x)), lambda x: x != "")
    gold = fx.benchmark.select("item_id", F.posexplode(parts("text")).alias("pos", "s")).select(F.struct("item_id", "pos").alias("id"), stemmed(F.col("s")).alias("tokens"))
    ours = fx.documents.select(F.explode(parts("text")).alias("s")).select(stemmed(F.col("s")).alias("tokens"))
    return D.best_across(gold, ours, 0.5).select("id.item_id", "id.pos", F.round("best", 9).alias("best"), "exact")


SEC = "(SELECT section_id, lesson_id, start_page, list_distinct(string_split(lower(title), ' ')) AS t, list_distinct([lower(x) for x in key_topics]) AS k FROM sections)"


@query("D7_merge_section_pairs", f"SELECT a, b, round(tt, 6) AS title_overlap, round(kk, 6) AS topic_overlap FROM (SELECT a.section_id AS a, b.section_id AS b, len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) AS tt, CASE WHEN least(len(a.k), len(b.k)) = 0 THEN 0.0 ELSE len(list_intersect(a.k, b.k)) / least(len(a.k), len(b.k)) END AS kk FROM {SEC} a JOIN {SEC} b ON a.lesson_id = b.lesson_id AND a.section_id < b.section_id) WHERE 0.7 * tt + 0.3 * kk > 0.5 OR tt > 0.7 OR kk > 0.6")
def merge_section_pairs(fx):
    return D.section_pairs(fx.sections).select("a", "b", F.round("title_overlap", 6).alias("title_overlap"), F.round("topic_overlap", 6).alias("topic_overlap"))


@query("D7_merge_sections")
def merge_sections(fx):
    """Greedy first-wins merging in rounds; tests hold it against a loop."""
    return D.merge_sections(fx.sections).withColumn("key_topics", F.array_join("key_topics", "|"))


OVERLAPPING = "(SELECT section_id, lesson_id, start_page, start_page + 4 + section_id % 7 AS end_page, title, list_distinct([w for w in string_split(lower(content), ' ') if length(w) >= 4])[1:8] AS los FROM sections)"


def overlapping(fx):
    words = F.filter(F.split(F.lower("content"), " "), lambda w: F.length(w) >= 4)
    return fx.sections.select("section_id", "lesson_id", "start_page", (F.col("start_page") + 4 + F.col("section_id") % 7).alias("end_page"), "title", F.array_distinct(words).alias("los"))


@query("D8_section_overlap_pairs", f"""SELECT a, b, shared FROM (SELECT a.section_id AS a, b.section_id AS b, a.los AS x, b.los AS y, least(a.end_page, b.end_page) - greatest(a.start_page, b.start_page) + 1 AS shared, least(a.end_page - a.start_page, b.end_page - b.start_page) + 1 AS pages
  FROM {OVERLAPPING.replace('[1:8]', '')} a JOIN {OVERLAPPING.replace('[1:8]', '')} b ON a.lesson_id = b.lesson_id AND a.section_id < b.section_id) WHERE shared >= 0.5 * pages AND least(len(x), len(y)) > 0 AND len(list_intersect(x, y)) >= 0.1 * least(len(x), len(y))""")
def section_overlap_pairs(fx):
    """At a tenth of shared objects: the sections of the tables share few words."""
    return D.overlap_pairs(overlapping(fx), objects=0.1).select("a", "b", "shared")


@query("D8_sections_overlap_dedup")
def sections_overlap_dedup(fx):
    """The fold in order of sections, in which winners absorb objects; tests hold it against hand-made cases."""
    return D.dedup_overlapping(overlapping(fx), objects=0.1).withColumn("los", F.array_join("los", "|"))


@query("D9_inject_missing_outline", "SELECT p.lesson_id, p.page FROM lesson_pages p WHERE length(p.page_text) > 3 AND NOT EXISTS (SELECT 1 FROM sections s WHERE s.lesson_id = p.lesson_id AND length(s.title) > 0 AND (contains(lower(p.page_text), lower(s.title)) OR contains(lower(s.title), lower(p.page_text))))")
def inject_missing_outline(fx):
    p = fx.lesson_pages.where("length(page_text) > 3")
    s = fx.sections.where("length(title) > 0").select(F.col("lesson_id").alias("l"), F.lower("title").alias("t"))
    on = (p["lesson_id"] == s["l"]) & (F.contains(F.lower(p["page_text"]), s["t"]) | F.contains(s["t"], F.lower(p["page_text"])))
    return p.join(s, on, "left_anti").select("lesson_id", "page")


@query("D9_inject_located")
def inject_located(fx):
    """Lessons behind a page of contents that lists their sections; those with long texts were planned, the others are located and injected. Held against a loop by tests."""
    titles = fx.sections.where("title <> ''").groupBy("lesson_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("order_index", "title"))), lambda x: x["title"]).alias("t"))
    first = titles.select("lesson_id", F.lit(1).alias("page"), F.concat(F.lit("Contents\n"), F.array_join("t", "\n")).alias("page_text"))
    pages = fx.lesson_pages.withColumn("page", F.col("page") + 1).unionByName(first)
    out = S.missing_outline(pages, fx.sections.where("length(content) >= 100"))
    return out.withColumn("snippet", F.md5("snippet"))


@query("D10_title_dedup", "SELECT min(section_id) AS section_id FROM sections GROUP BY lesson_id, lower(title)")
def title_dedup(fx):
    return D.keep_first(fx.sections, [F.col("lesson_id"), F.lower("title")], "section_id").select("section_id")


@query("D11_metric_upsert", "SELECT metric_key, scope_id, arg_max(event_id, (created_at, event_id)) AS event_id FROM metric_payloads GROUP BY 1, 2")
def metric_upsert(fx):
    return fx.metric_payloads.groupBy("metric_key", "scope_id").agg(F.max_by("event_id", F.struct("created_at", "event_id")).alias("event_id"))


SNAPC = "(SELECT snapshot, lang, lesson, count(*) AS n, sum(n_chars) AS chars, avg(n_chars) AS mean FROM snapshots GROUP BY ALL)"


def both_sides(df, keys, value):
    a = df.where("snapshot = 'before'").select(*keys, F.col(value).alias("before"))
    b = df.where("snapshot = 'after'").select(*keys, F.col(value).alias("after"))
    return a.join(b, keys, "full")


@query("C1_table_count_delta", "SELECT lang AS name, coalesce(b, 0) AS before, coalesce(a, 0) AS after, coalesce(a, 0) - coalesce(b, 0) AS delta FROM (SELECT lang, count(*) FILTER (snapshot = 'before') AS b, count(*) FILTER (snapshot = 'after') AS a FROM snapshots GROUP BY 1)")
def table_count_delta(fx):
    n = fx.snapshots.groupBy("snapshot", F.col("lang").alias("name")).agg(F.count("*").alias("n"))
    return both_sides(n, ["name"], "n").na.fill(0).withColumn("delta", F.col("after") - F.col("before"))


HEADS = "(VALUES " + ", ".join(f"('{k}', '{p}', {'NULL' if up is None else str(up).lower()}::BOOLEAN)" for k, p, up in HEADLINES) + ") h(metric_key, path, up)"
MARK = "CASE WHEN up IS NULL OR a IS NULL OR b IS NULL THEN '' WHEN a = b THEN '~' WHEN (a > b) = up THEN '✓' ELSE '✗' END"


@query("C2_headline_delta", f"""SELECT metric_key, path, b AS before, a AS after, round(a - b, 2) AS delta, {MARK} AS mark FROM {HEADS} LEFT JOIN (SELECT metric_key AS k, path AS p, max(v) FILTER (snapshot = 'before') AS b, max(v) FILTER (snapshot = 'after') AS a
  FROM (SELECT v.metric_key, path, snapshot, json_extract_string(payload, '$.' || path)::DOUBLE AS v FROM validation v JOIN {HEADS} ON h.metric_key = v.metric_key) GROUP BY 1, 2) ON k = metric_key AND p = path""")
def headline_delta(fx):
    """Thirteen headline numbers by JSON path, with the difference and whether it is for the better."""
    return M.headline_delta(fx.validation, HEADLINES)


@query("C3_coverage_delta", f"SELECT lesson, b AS before, a AS after, round(a - b, 2) AS delta, {MARK} AS mark FROM (SELECT lesson, true AS up, max(v) FILTER (snapshot = 'before') AS b, max(v) FILTER (snapshot = 'after') AS a FROM (SELECT *, json_extract_string(payload, '$.concept_coverage.weighted_concept_coverage_pct')::DOUBLE AS v FROM validation WHERE metric_key = 'coverage') GROUP BY 1)")
def coverage_delta(fx):
    v = fx.validation.where("metric_key = 'coverage'").select("snapshot", "lesson", F.get_json_object("payload", "$.concept_coverage.weighted_concept_coverage_pct").cast("double").alias("v"))
    return M.marked(both_sides(v, ["lesson"], "v"), F.lit(True))


@query("C4_flag_delta", f"""SELECT code, b AS before, a AS after, a - b AS delta, CASE WHEN a = b THEN '~' WHEN a < b THEN '✓' ELSE '✗' END AS mark FROM (SELECT code, count(*) FILTER (question_id // 1000 % 2 = 0) AS b, count(*) FILTER (question_id // 1000 % 2 = 1) AS a
  FROM (SELECT question_id, unnest(flags) AS code FROM {LINTED}) GROUP BY 1)""")
def flag_delta(fx):
    """Lint flags of two halves of the questions as snapshots; a code that one lacks counts 0 there, and fewer are better."""
    side = F.when(F.expr("question_id div 1000 % 2 = 0"), "before").otherwise("after")
    n = L.lint(fx.questions).select(side.alias("snapshot"), F.explode("flags").alias("code")).groupBy("snapshot", "code").agg(F.count("*").alias("n"))
    return M.marked(both_sides(n, ["code"], "n").na.fill(0, ["before", "after"]), F.lit(False), digits=None)


CONF = ", ".join(f"count(*) FILTER (classified = '{x}') AS {x}" for x in R.LEVELS)
LVL = "['unistructural', 'multistructural', 'relational', 'extended_abstract']"


@query("C5_confusion_side_by_side", f"SELECT s.snapshot, i.intended, {CONF} FROM (SELECT unnest(['before', 'after']) AS snapshot) s CROSS JOIN (SELECT unnest({LVL}) AS intended) i LEFT JOIN (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'before' ELSE 'after' END AS snap FROM judge_pairs) j ON i.intended = j.intended AND s.snapshot = j.snap GROUP BY 1, 2")
def confusion_side_by_side(fx):
    return M.confusion(fx.judge_pairs.withColumn("snapshot", F.when(F.col("doc_id") % 2 == 0, "before").otherwise("after")), ["snapshot"])


@query("C6_question_transitions", "SELECT before, after, count(*) AS n FROM (SELECT doc_id AS question_id, CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS before FROM labels) JOIN (SELECT doc_id AS question_id, CASE WHEN toxic = 0 THEN 'pass' ELSE 'fail' END AS after FROM labels WHERE doc_id % 10 <> 0) USING (question_id) GROUP BY 1, 2")
def question_transitions(fx):
    verdict = lambda good: F.when(good, "pass").otherwise("fail")
    before = fx.labels.select(F.col("doc_id").alias("question_id"), F.lit("before").alias("snapshot"), verdict(F.col("quality") == 1).alias("v"))
    after = fx.labels.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("question_id"), F.lit("after").alias("snapshot"), verdict(F.col("toxic") == 0).alias("v"))
    return both_sides(before.unionByName(after), ["question_id"], "v").where("before IS NOT NULL AND after IS NOT NULL").groupBy("before", "after").agg(F.count("*").alias("n"))


SPEC = "(VALUES " + ", ".join(f"('{m}', '{k}', {'NULL' if p is None else repr(p)}::VARCHAR, {str(c).lower()})" for m, k, p, c in OVERVIEW) + ") o(metric, metric_key, path, comparable)"
LIVE = f"""(SELECT scope, metric, comparable, CASE WHEN path IS NULL THEN round(100 * json_extract_string(payload, '$.correct_outlier_count')::DOUBLE / json_extract_string(payload, '$.evaluated_questions')::DOUBLE, 1)
  ELSE json_extract_string(payload, '$.' || path)::DOUBLE END AS value FROM lesson_payloads p JOIN {SPEC} ON o.metric_key = p.metric_key)"""


@query("C7_benchmark_overview", f"SELECT l.metric, l.scope AS lesson, l.value, CASE WHEN l.comparable THEN e.value END AS expert FROM {LIVE} l LEFT JOIN {LIVE} e ON e.metric = l.metric AND e.scope = 'expert' WHERE l.scope <> 'expert'")
def benchmark_overview(fx):
    """Each metric of each lesson beside the experts' value, where the metric has one."""
    return M.overview(M.headlines(fx.lesson_payloads, OVERVIEW), OVERVIEW)


LIGHT_SQL = "CASE WHEN value IS NULL THEN NULL WHEN metric = 'solvability' THEN CASE WHEN value BETWEEN 0.5 AND 0.9 THEN 'good' ELSE 'warn' END " + " ".join(
    f"WHEN metric = '{m}' THEN CASE WHEN value {'>=' if up else '<='} {good} THEN 'good' WHEN value {'>=' if up else '<='} {warn} THEN 'warn' ELSE 'bad' END" for m, up, good, warn in M.LIGHTS
) + " ELSE 'info' END"


@query("L20_overview_lights", f"SELECT scope, m AS metric, {LIGHT_SQL} AS tone FROM (SELECT scope, metric AS m, CASE metric WHEN 'grammar_outlier' THEN 'grammar' ELSE metric END AS metric, value FROM {LIVE})")
def overview_lights(fx):
    """Each headline of each course with its colour."""
    v = M.headlines(fx.lesson_payloads, OVERVIEW).withColumnRenamed("metric", "m")
    v = v.withColumn("metric", F.when(F.col("m") == "grammar_outlier", "grammar").otherwise(F.col("m")))
    return M.lights(v).select("scope", F.col("m").alias("metric"), "tone")


@query("C8_provider_reports", f"SELECT scope, metric, value FROM {LIVE}")
def provider_reports(fx):
    """One headline number for each stored payload, by the path or the rate of its metric."""
    return M.headlines(fx.lesson_payloads, OVERVIEW)


@query("D13_outline_union_keys", "SELECT DISTINCT lang, lesson FROM snapshots")
def outline_union_keys(fx):
    k = fx.snapshots.groupBy("snapshot", "lang", "lesson").agg(F.count("*").alias("n"))
    return both_sides(k, ["lang", "lesson"], "n").select("lang", "lesson")


JUDGED = "(SELECT doc_id AS k, quality = 1 AS ambiguous, doc_id % 5 = 0 AS key_outlier, CASE WHEN doc_id % 5 = 1 THEN 'mixed' ELSE 'homogeneous' END AS grammar, quality - toxic AS ioc, CASE WHEN toxic = 1 THEN 'CONTRADICTED' WHEN doc_id % 7 = 0 THEN 'UNDERDETERMINED' ELSE 'SUPPORTED' END AS cove FROM labels)"


@query("L18_corpus_flags", f"""SELECT question_id, array_to_string(f, ',') AS flags, list_contains(lint, 'H27_CORRECT_LONGEST') AS has_length_clue, len(f) + list_contains(lint, 'H27_CORRECT_LONGEST')::INT AS flag_count, ambiguous, grammar, ioc AS ioc_rating, cove AS cove_verdict FROM (SELECT l.question_id, l.flags AS lint, j.*,
  [x for x in [CASE WHEN ambiguous THEN 'AMBIGUOUS' END, CASE WHEN key_outlier THEN 'GRAMMAR_CLUE' WHEN grammar = 'mixed' THEN 'GRAMMAR_MIXED' END, CASE WHEN ioc <= 0 THEN 'IOC_' || ioc END, CASE WHEN cove IN ('UNDERDETERMINED', 'CONTRADICTED') THEN 'COVE_' || cove END] if x IS NOT NULL] AS f
  FROM {LINTED} l LEFT JOIN {JUDGED} j ON j.k = l.question_id // 1000)""")
def corpus_flags(fx):
    """Flags of lint and of four judgements, which are null where a response is missing."""
    q = L.lint(fx.questions).withColumn("k", F.expr("question_id div 1000")).join(judgements(fx), "k", "left")
    return L.corpus_flags(q).select("question_id", F.array_join("corpus_flags", ",").alias("flags"), "has_length_clue", "flag_count", "ambiguous", "grammar", "ioc_rating", "cove_verdict")


@query("L20_question_badges", f"""SELECT question_id, unnest(['cove', 'ioc', 'ambiguity', 'grammar_homogeneity']) AS metric, unnest([CASE cove WHEN 'SUPPORTED' THEN 'good' WHEN 'CONTRADICTED' THEN 'bad' ELSE 'warn' END,
  CASE WHEN ioc > 0 THEN 'good' WHEN ioc < 0 THEN 'bad' ELSE 'warn' END, CASE WHEN ambiguous THEN 'bad' ELSE 'good' END, CASE WHEN key_outlier THEN 'bad' WHEN grammar = 'homogeneous' THEN 'good' ELSE 'bad' END]) AS tone FROM questions q JOIN {JUDGED} j ON j.k = q.question_id // 1000
  UNION ALL SELECT question_id, 'solvability', CASE WHEN p >= 0.9 THEN 'warn' ELSE 'info' END FROM (SELECT question_id, count(*) FILTER (correct AND NOT parse_failure) / nullif(count(*) FILTER (NOT parse_failure), 0) AS p FROM trials GROUP BY 1) WHERE p IS NOT NULL AND question_id IN (SELECT question_id FROM questions)""")
def question_badges(fx):
    """Colours of each question's judgements and difficulty."""
    q = fx.questions.select("question_id", F.expr("question_id div 1000").alias("k")).join(judgements(fx), "k", "left")
    return M.badges(q.join(M.item_difficulty(fx.trials).select("question_id", "p_value", "label"), "question_id", "left"))


def judgements(fx):
    grammar = F.when(F.col("doc_id") % 5 == 1, "mixed").otherwise("homogeneous")
    cove = F.when(F.col("toxic") == 1, "CONTRADICTED").when(F.col("doc_id") % 7 == 0, "UNDERDETERMINED").otherwise("SUPPORTED")
    return fx.labels.select(F.col("doc_id").alias("k"), (F.col("quality") == 1).alias("ambiguous"), (F.col("doc_id") % 5 == 0).alias("key_outlier"), grammar.alias("grammar"), (F.col("quality") - F.col("toxic")).alias("ioc_rating"), cove.alias("cove_verdict"))


@query("R10_parse_pairs", "SELECT doc_id, 'm' || i AS misconception, 'c' || i AS correction FROM (SELECT doc_id, unnest(range(doc_id % 4)) AS i FROM labels) WHERE i <> 1")
def parse_pairs(fx):
    item = lambda i: F.concat(F.lit('{"misconception": "m'), i.cast("string"), F.lit('", "correction": "'), F.when(i == 1, F.lit("")).otherwise(F.concat(F.lit("c"), i.cast("string"))), F.lit('"}'))
    n = (F.col("doc_id") % 4).cast("int")
    raw = F.concat(F.lit('ok {"pairs": ['), F.array_join(F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), item)).otherwise(F.array().cast("array<string>")), ", "), F.lit("]}"))
    parsed = F.from_json(R.json_object(raw), "pairs array<struct<misconception: string, correction: string>>")
    return fx.labels.select("doc_id", F.explode(parsed["pairs"]).alias("p")).select("doc_id", "p.*").where("trim(misconception) <> '' AND trim(correction) <> ''")


@query("R11_parse_sections", """SELECT lesson_id, title, array_to_string(k[1:8], '|') AS key_topics, row_number() OVER (PARTITION BY lesson_id ORDER BY i) AS r FROM (SELECT lesson_id, trim(title) AS title, key_topics AS k, start_page AS i, row_number() OVER (PARTITION BY lesson_id, lower(trim(title)) ORDER BY start_page) AS d
  FROM sections WHERE trim(title) <> '') WHERE d = 1""")
def parse_sections(fx):
    """Sections of list responses: blank and repeated titles go, eight topics stay."""
    answer = F.transform(F.sort_array(F.collect_list(F.struct("start_page", "title", "key_topics"))), lambda x: F.struct(x["title"].alias("title"), x["key_topics"].alias("key_topics")))
    return R.section_rows(fx.sections.groupBy("lesson_id").agg(F.concat(F.lit("Here: "), F.to_json(answer)).alias("response")), "lesson_id").withColumn("key_topics", F.array_join("key_topics", "|"))


ALIASED = f"coalesce((SELECT c FROM (VALUES {ALIASES}) v(a, c) WHERE a = lower(trim(object_type))), 'concept')"


@query("R11_parse_objects", f"""SELECT lo_section, substr(title, 1, 150) AS title, {ALIASED} AS lo_type, substr(content, 1, 600) AS description, array_to_string(keywords[1:6], '|') AS keywords, r FROM (SELECT *, row_number() OVER (PARTITION BY lo_section ORDER BY lo_id) AS r FROM
  (SELECT *, row_number() OVER (PARTITION BY lo_section, lower(title) ORDER BY lo_id) AS d FROM learning_objects WHERE title <> '') WHERE d = 1 AND length(trim(title)) <= 80 AND len(string_split_regex(trim(title), '\\s+')) <= 10) WHERE r <= 12""")
def parse_objects(fx):
    """Learning objects of list responses: repeated and sentence-shaped titles go, twelve a section stay, cut to their limits."""
    answer = F.transform(F.sort_array(F.collect_list(F.struct("lo_id", "title", "object_type", "content", "keywords"))), lambda x: F.struct(x["title"].alias("title"), x["object_type"].alias("type"), x["content"].alias("description"), x["keywords"].alias("keywords")))
    return R.object_rows(fx.learning_objects.groupBy("lo_section").agg(F.to_json(answer).alias("response")), "lo_section").withColumn("keywords", F.array_join("keywords", "|"))


@query("R11_parse_relations", """SELECT e.source_id, e.target_id, relationship_type AS type FROM edges e JOIN learning_objects s ON s.lo_id = source_id JOIN learning_objects t ON t.lo_id = target_id WHERE lower(trim(s.title)) <> lower(trim(t.title))""")
def parse_relations(fx):
    """Relations of list responses, a response for each source; ends are titles, and one that names itself goes."""
    lo = fx.learning_objects
    e = fx.edges.join(lo.select(F.col("lo_id").alias("source_id"), F.col("title").alias("source")), "source_id").join(lo.select(F.col("lo_id").alias("target_id"), F.col("title").alias("target")), "target_id")
    raw = e.groupBy("source_id").agg(F.to_json(F.collect_list(F.struct("source", "target", F.col("relationship_type").alias("type"), "target_id"))).alias("response"))
    return R.relation_rows(raw, "source_id").select("source_id", "target_id", "type")


@query("R12_enrich_by_title", "SELECT l.lo_id, s.section_id FROM learning_objects l LEFT JOIN (SELECT lower(title) AS k, min(section_id) AS section_id FROM sections GROUP BY 1) s ON s.k = lower(l.title)")
def enrich_by_title(fx):
    first = fx.sections.groupBy(F.lower("title").alias("k")).agg(F.min("section_id").alias("section_id"))
    return fx.learning_objects.join(first, F.lower("title") == F.col("k"), "left").select("lo_id", "section_id")


@query("X13_detect_outline", """SELECT lesson_id, page, items, hits FROM (SELECT *, row_number() OVER (PARTITION BY lesson_id ORDER BY hits / items DESC, hits DESC, page) AS r FROM (SELECT p.lesson_id, p.page, count(*) AS items, count(*) FILTER (contains(substr(l.raw, p.e + 1), p.w)) AS hits FROM
  (SELECT lesson_id, page, e, unnest(w) AS w FROM (SELECT lesson_id, page, end_offset::BIGINT AS e, [x for x in string_split(lower(page_text), ' ') if length(x) BETWEEN 4 AND 80] AS w FROM %s WHERE page <= 8 AND char_count BETWEEN 30 AND 800)) p JOIN (SELECT lesson_id, lower(string_agg(chr(10) || '--- Page ' || page || ' ---' || chr(10) || page_text, '' ORDER BY page)) AS raw FROM lesson_pages GROUP BY 1) l ON l.lesson_id = p.lesson_id GROUP BY 1, 2) WHERE hits >= 3 AND hits / items >= 0.6) WHERE r = 1""" % OFFS)
def detect_outline(fx):
    """Pages are single lines here, so their words stand for what they list; `D9_inject_located` has pages of lines."""
    words = F.filter(F.split(F.lower("page_text"), " "), lambda x: F.length(x).between(4, 80))
    return S.outline(fx.lesson_pages, words).select("lesson_id", "page", "items", "hits")


@query("X14_find_toc_pages", "SELECT p.lesson_id, p.page FROM lesson_pages p JOIN (SELECT lesson_id, list(lower(title)) FILTER (length(title) > 0) AS t FROM sections GROUP BY 1) s ON s.lesson_id = p.lesson_id WHERE len([x for x in s.t if contains(lower(p.page_text), x)]) >= greatest(2, floor(0.6 * len(s.t)))")
def find_toc_pages(fx):
    return S.toc_pages(fx.lesson_pages, fx.sections)


WORDS = "(SELECT section_id, lesson_id, start_page, end_page, list_position(keywords, w) AS i, lower(trim(w)) AS w FROM (SELECT *, unnest(keywords) AS w FROM section_objects) WHERE length(trim(w)) >= 4)"
COUNTED = f"""(SELECT *, sum(c) OVER (PARTITION BY section_id, i ORDER BY page) - c AS before FROM (SELECT w.section_id, w.i, w.start_page, w.end_page, p.page, (length(p.page_text) - length(replace(lower(p.page_text), w.w, ''))) // length(w.w) AS c FROM {WORDS} w JOIN lesson_pages p ON p.lesson_id = w.lesson_id AND p.page <= w.end_page))"""
SCORED = f"(SELECT section_id, page, sum(least(c, greatest(0, 30 - before))) AS n, min(i) AS i FROM {COUNTED} WHERE page >= start_page AND least(c, greatest(0, 30 - before)) > 0 GROUP BY 1, 2)"


@query("X19_assign_lo_pages", f"""SELECT o.section_id, array_to_string(coalesce(t.p, s.p, k.p, [o.start_page]), ',') AS pages FROM section_objects o
  LEFT JOIN (SELECT section_id, list(page ORDER BY page)[1:5] AS p FROM section_objects o JOIN lesson_pages g ON g.lesson_id = o.lesson_id AND g.page BETWEEN o.start_page AND o.end_page AND length(o.lo_title) >= 3 AND contains(lower(g.page_text), lower(o.lo_title)) GROUP BY 1) t ON t.section_id = o.section_id
  LEFT JOIN (SELECT section_id, list(page ORDER BY page)[1:5] AS p FROM {SCORED} WHERE n >= 2 GROUP BY 1) s ON s.section_id = o.section_id
  LEFT JOIN (SELECT section_id, list_sort(list(page ORDER BY n DESC, i, page)[1:5]) AS p FROM {SCORED} GROUP BY 1) k ON k.section_id = o.section_id""")
def assign_lo_pages(fx):
    """Pages that hold the title; else those with two keyword hits or more; else the five with most; else the section's first."""
    return S.assign_pages(fx.section_objects, fx.lesson_pages).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))
