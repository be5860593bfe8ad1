"""Queries of sources (S*), filters (F*), joins (J*) and windows (W*) over lessons, pages and sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradus.functions.text import slide_heading
from gradus.operators import structure as S
from gradus.operators import vocabulary as V
from gradus.sources import io, snapshots
from gradus.streaming.keyed import MetricStore

from .registry import query
from .text import HEAD, JOINED


@query("S1_scan_table", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def scan_table(fx):
    return fx.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("S2_load_questions", "SELECT q.question_id, q.question_text, l.title, coalesce(len(q.options), 0) AS n_options FROM questions q LEFT JOIN lessons l ON l.lesson_id = q.primary_lesson_id")
def load_questions(fx):
    title = fx.lessons.select(F.col("lesson_id").alias("primary_lesson_id"), "title")
    return fx.questions.join(title, "primary_lesson_id", "left").select("question_id", "question_text", "title", F.coalesce(F.size("options"), F.lit(0)).alias("n_options"))


@query("S3_load_nested_bank", """SELECT CASE WHEN primary_lesson_id % 5 = 0 THEN 'valid' ELSE 'train' END AS split, 'book ' || quiz_id AS book, primary_lesson_id::VARCHAR AS chapter, question_id, question_text, options[correct_option_index + 1] AS correct_answer,
  array_to_string([options[i] for i in range(1, len(options) + 1) if i <> correct_option_index + 1], '|') AS distractors, len(options) AS n_options, ['Remember', 'Understand', 'Apply', 'Analyze'][question_id % 5] AS bloom_name,
  trim(regexp_replace(' ' || question_text || ' ', '\\s+', ' ', 'g')) AS context FROM questions WHERE correct_option_index IS NOT NULL""")
def load_nested_bank(fx):
    """Questions nested under chapters (lessons), written as two JSON splits and loaded from them."""
    n = F.col("question_id")
    question = F.struct("question_id", F.when(n % 2 == 0, F.col("question_text")).alias("normal_format"), F.when(n % 2 != 0, F.col("question_text")).otherwise("cloze").alias("question_text"), F.col("options").alias("question_choices"))
    q = F.struct(question.alias("question"), F.struct(F.col("correct_option_index").alias("ans_choice")).alias("answer"), (n % 5).cast("string").alias("bloom"), F.concat(F.lit("<hl> "), "question_text", F.lit(" <hl>")).alias("hl_context"))
    chapters = fx.questions.groupBy(F.concat(F.lit("book "), F.col("quiz_id").cast("string")).alias("bname"), F.col("primary_lesson_id").alias("lesson")).agg(F.collect_list(q).alias("questions"))
    chapters, root = chapters.withColumn("chapter", F.col("lesson").cast("string")), io.fresh(fx.spark, "bank")
    splits = {"train": f"{root}/train", "valid": f"{root}/valid"}
    for split, path in splits.items():
        io.write_nested_bank(chapters.where(F.col("lesson") % 5 == 0 if split == "valid" else F.col("lesson") % 5 != 0).drop("lesson"), path)
    return io.load_nested_bank(fx.spark, splits).withColumn("distractors", F.array_join("distractors", "|"))


OFFS = "(SELECT lesson_id, page, length(trim(page_text)) AS char_count, sum(sz) OVER w - sz AS start_offset, sum(sz) OVER w AS end_offset, page_text FROM (SELECT *, length(page_text) + length(page::VARCHAR) + 15 AS sz FROM lesson_pages) WINDOW w AS (PARTITION BY lesson_id ORDER BY page))"


@query("S4_page_offsets", f"SELECT lesson_id, page, char_count, start_offset::BIGINT AS start_offset, end_offset::BIGINT AS end_offset FROM {OFFS}")
def page_offsets(fx):
    return S.page_offsets(fx.lesson_pages)


@query("S5_pages_from_markers", f"SELECT lesson_id, page, char_count, start_offset::BIGINT AS start_offset, end_offset::BIGINT AS end_offset FROM {OFFS}")
def pages_from_markers(fx):
    return S.page_offsets(S.pages_from_markers(S.joined_pages(fx.lesson_pages)))


@query("S7_translations_long", "SELECT 'lesson' AS entity_type, doc_id AS entity_id, lang AS language_code, text AS title, NULL::VARCHAR AS role FROM documents UNION ALL SELECT 'question', conv_id * 1000 + turn, 'en', text, role FROM conversations")
def translations_long(fx):
    a = fx.documents.select(F.lit("lesson").alias("entity_type"), F.col("doc_id").alias("entity_id"), F.col("lang").alias("language_code"), F.col("text").alias("title"))
    b = fx.conversations.select(F.lit("question").alias("entity_type"), (F.col("conv_id") * 1000 + F.col("turn")).alias("entity_id"), F.lit("en").alias("language_code"), F.col("text").alias("title"), "role")
    return a.unionByName(b, allowMissingColumns=True)


TABLES = ("documents", "conversations", "labels", "benchmark", "pages", "embeddings")


@query("S8_write_snapshot", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def write_snapshot(fx):
    return snapshots.write(fx.spark, io.fresh(fx.spark, "snapshot"), "now", {t: fx.table(t) for t in TABLES}).counts()


@query("S9_read_snapshot", "SELECT doc_id, quality, toxic FROM labels")
def read_snapshot(fx):
    root = io.fresh(fx.spark, "snapshot")
    snapshots.write(fx.spark, root, "now", {"labels": fx.labels})
    return snapshots.read(fx.spark, root, "now").table("labels").select("doc_id", "quality", "toxic")


@query("S9_read_metrics", """SELECT metric_key, md5(payload) AS payload FROM validation WHERE snapshot = 'after' AND lesson IS NULL
  UNION ALL SELECT 'coverage', md5('{' || string_agg('"' || lesson || '": ' || payload, ', ' ORDER BY lesson) || '}') FROM validation WHERE snapshot = 'after' AND lesson IS NOT NULL""")
def read_metrics(fx):
    """Reports written with a snapshot and read again, a text a metric."""
    snap = snapshots.write(fx.spark, io.fresh(fx.spark, "snapshot"), "after", {}, reports_of(fx, "after"))
    return snap.metrics().select("metric_key", F.md5("payload").alias("payload"))


def reports_of(fx, label):
    """(metric_key, payload) of a snapshot: coverage has an entry for each lesson."""
    v = fx.validation.where(F.col("snapshot") == label)
    entry = F.concat(F.lit('"'), F.col("lesson").cast("string"), F.lit('": '), "payload")
    entries = F.transform(F.sort_array(F.collect_list(F.struct("lesson", entry.alias("e")))), lambda x: x["e"])
    nested = v.where("lesson IS NOT NULL").groupBy("metric_key").agg(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")).alias("payload"))
    return v.where("lesson IS NULL").select("metric_key", "payload").unionByName(nested)


@query("S12_export_csv", "SELECT question_id::VARCHAR AS question_id, question_text FROM questions")
def export_csv(fx):
    """Written as CSV and read again: quotes, commas and line ends survive."""
    path = io.fresh(fx.spark, "csv")
    io.write_csv(fx.questions.select("question_id", "question_text"), path)
    return fx.spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


@query("S10_hydrate_metrics", """SELECT metric_key, l.lesson_id AS scope_id, v FROM (SELECT metric_key, round(max(value), 4) AS v FROM metric_payloads GROUP BY 1) CROSS JOIN lessons l WHERE (metric_key <> 'click' OR l.lesson_id NOT IN (SELECT scope_id FROM metric_payloads WHERE metric_key = 'click' AND event_id % 2 = 0))""")
def hydrate_metrics(fx):
    """Corpus-wide payloads, one a metric, for every lesson; keys that a lesson has already stay as they are."""
    m = fx.metric_payloads
    corpus = m.groupBy("metric_key").agg(F.round(F.max("value"), 4).cast("string").alias("payload"))
    spread = snapshots.lesson_reports(corpus, fx.lessons, corpus_wide=["click", "error", "purchase", "signup", "view"])
    own = m.where("metric_key = 'click' AND event_id % 2 = 0").select("metric_key", "scope_id").distinct()
    return spread.join(own, ["metric_key", "scope_id"], "left_anti").select("metric_key", "scope_id", F.col("payload").cast("double").alias("v"))


@query("S10_hydrate_store", """SELECT metric_key, lesson AS scope_id, md5(payload) AS payload FROM validation WHERE snapshot = 'before' AND metric_key = 'coverage'
  UNION ALL SELECT metric_key, l.lesson, md5(payload) FROM validation v CROSS JOIN (SELECT DISTINCT lesson FROM snapshots WHERE snapshot = 'after') l WHERE v.snapshot = 'after' AND v.lesson IS NULL
  UNION ALL SELECT metric_key, lesson, md5(payload) FROM validation WHERE snapshot = 'after' AND metric_key = 'coverage' AND lesson NOT IN (SELECT lesson FROM validation WHERE snapshot = 'before' AND lesson IS NOT NULL)""")
def hydrate_store(fx):
    """A store that holds the coverage of one snapshot takes up the other one: what is there stays."""
    snap = snapshots.write(fx.spark, io.fresh(fx.spark, "snapshot"), "after", {"lessons": fx.snapshots.where("snapshot = 'after'").select(F.col("lesson").alias("lesson_id")).distinct()}, reports_of(fx, "after"))
    store = MetricStore(fx.spark, io.fresh(fx.spark, "store"))
    at = F.to_timestamp(F.lit("2026-01-01"))
    store.put(fx.validation.where("snapshot = 'before' AND lesson IS NOT NULL").select("metric_key", F.col("lesson").alias("scope_id"), "payload").withColumn("created_at", at))
    snapshots.hydrate(store, snapshots.lesson_reports(snap.metrics(), snap.table("lessons")), at)
    return store.current().select("metric_key", "scope_id", F.md5("payload").alias("payload"))


BANKROWS = "(SELECT c_mktsegment AS book, CASE WHEN o_custkey % 5 = 0 THEN 'App ' || o_custkey % 3 ELSE (o_custkey % 12)::VARCHAR END AS chapter, o_orderkey AS pos, (o_custkey % 50) || '|' || o_orderpriority AS context FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("S13_source_passages", f"""SELECT book, chapter, row_number() OVER (PARTITION BY book ORDER BY try_cast(chapter AS INT) IS NULL, try_cast(chapter AS INT), chapter) - 1 AS chapter_rank, count(*) AS passages, min(pos) AS first_item
  FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY pos) AS r FROM {BANKROWS}) WHERE r = 1 GROUP BY book, chapter""")
def source_passages(fx):
    o = fx.orders.join(fx.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("book")), "o_custkey")
    chapter = F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("App "), (F.col("o_custkey") % 3).cast("string"))).otherwise((F.col("o_custkey") % 12).cast("string"))
    return S.passages(o.select("book", chapter.alias("chapter"), F.col("o_orderkey").alias("pos"), F.concat_ws("|", F.col("o_custkey") % 50, "o_orderpriority").alias("context")))


@query("F1_questions_by_lesson", "SELECT question_id FROM questions WHERE primary_lesson_id = 7 OR secondary_lesson_id = 7")
def questions_by_lesson(fx):
    return fx.questions.where("primary_lesson_id = 7 OR secondary_lesson_id = 7").select("question_id")


@query("F2_questions_by_level", "SELECT question_id FROM questions WHERE solo_level = 'relational' AND (primary_lesson_id % 5 = 2 OR secondary_lesson_id % 5 = 2)")
def questions_by_level(fx):
    return fx.questions.where("solo_level = 'relational' AND (primary_lesson_id % 5 = 2 OR secondary_lesson_id % 5 = 2)").select("question_id")


@query("F3_questions_by_course", "SELECT question_id FROM questions WHERE primary_lesson_id IN (SELECT lesson_id FROM lessons WHERE course_id = 'src3/0') OR secondary_lesson_id IN (SELECT lesson_id FROM lessons WHERE course_id = 'src3/0')")
def questions_by_course(fx):
    """Two equi semi-joins and a distinct, as an OR would keep the join from hashing."""
    own = fx.lessons.where("course_id = 'src3/0'").select("lesson_id")
    sides = [fx.questions.select("question_id", F.col(c).alias("lesson_id")).join(own, "lesson_id", "left_semi").select("question_id") for c in ("primary_lesson_id", "secondary_lesson_id")]
    return sides[0].unionByName(sides[1]).distinct()


@query("F4_bank_filter", "SELECT question_id FROM questions WHERE solo_level = 'multistructural' AND contains(lower(question_text), 'the')")
def bank_filter(fx):
    return fx.questions.where((F.col("solo_level") == "multistructural") & F.contains(F.lower("question_text"), F.lit("the"))).select("question_id")


@query("F5_paginate", "SELECT item_id, (SELECT count(*) FROM bank WHERE book = 'BUILDING' AND evaluated) AS total FROM bank WHERE book = 'BUILDING' AND evaluated ORDER BY item_id LIMIT 20 OFFSET 40")
def paginate(fx):
    rows = fx.bank.where("book = 'BUILDING' AND evaluated")
    return rows.orderBy("item_id").offset(40).limit(20).join(F.broadcast(rows.agg(F.count("*").alias("total")))).select("item_id", "total")


@query("F6_lo_title_shape", r"SELECT lo_id, length(trim(title)) BETWEEN 1 AND 80 AND len(string_split_regex(trim(title), '\s+')) <= 10 AS shaped FROM learning_objects")
def lo_title_shape(fx):
    t = F.trim("title")
    return fx.learning_objects.select("lo_id", (F.length(t).between(1, 80) & (F.size(F.split(t, r"\s+")) <= 10)).alias("shaped"))


@query("F7_lo_grounded", "SELECT lo_id, s.doc_id, coalesce((length(title) >= 4 AND contains(lower(s.text), lower(title))) OR len([k for k in keywords if length(k) >= 4 AND contains(lower(s.text), lower(k))]) > 0, false) AS grounded FROM learning_objects LEFT JOIN documents s ON s.doc_id % (SELECT count(*) FROM benchmark) = lo_id")
def lo_grounded(fx):
    """Each object against the text of every document that falls to its number."""
    items = fx.benchmark.agg(F.count("*").alias("items"))  # one row
    s = fx.documents.join(F.broadcast(items)).select("doc_id", F.try_mod(F.col("doc_id"), F.col("items")).alias("lo_id"), F.lower("text").alias("t"))
    hit = ((F.length("title") >= 4) & F.contains("t", F.lower("title"))) | F.exists("keywords", lambda k: (F.length(k) >= 4) & F.contains(F.col("t"), F.lower(k)))
    return fx.learning_objects.join(s, "lo_id", "left").select("lo_id", "doc_id", F.coalesce(hit, F.lit(False)).alias("grounded"))


COPIED = "lower(trim(translated)) = lower(trim(original)) OR (original <> '' AND starts_with(translated, substr(original, 1, {n})))"


@query("F9_bad_translations", f"SELECT * FROM (SELECT t.doc_id, t.question_id, {COPIED.format(n=50)} AS stored_bad, {COPIED.format(n=30)} AS refused FROM translations t JOIN (SELECT doc_id AS question_id, text AS original FROM documents) d ON d.question_id = t.question_id WHERE t.doc_id <> t.question_id) WHERE refused")
def bad_translations(fx):
    """Translations that repeat their original: 50 characters of it where one is stored, 30 where one is written."""
    o = fx.documents.select(F.col("doc_id").alias("question_id"), F.col("text").alias("original"))
    t = fx.translations.join(o, "question_id").where("doc_id <> question_id")
    return t.select("doc_id", "question_id", copied(50).alias("stored_bad"), copied(30).alias("refused")).where("refused")


def copied(n):
    return (F.lower(F.trim("translated")) == F.lower(F.trim("original"))) | ((F.col("original") != "") & F.col("translated").startswith(F.substring("original", 1, n)))


@query("F10_relationship_evidence", "SELECT e.source_id, e.target_id, length(trim(s.title)) >= 15 AND contains(lower(t.content), lower(trim(s.title))) AS grounded FROM edges e JOIN learning_objects s ON s.lo_id = source_id JOIN learning_objects t ON t.lo_id = target_id")
def relationship_evidence(fx):
    lo = fx.learning_objects
    e = fx.edges.join(lo.select(F.col("lo_id").alias("source_id"), F.trim("title").alias("ev")), "source_id").join(lo.select(F.col("lo_id").alias("target_id"), F.lower("content").alias("c")), "target_id")
    return e.select("source_id", "target_id", ((F.length("ev") >= 15) & F.contains("c", F.lower("ev"))).alias("grounded"))


@query("F11_soft_edge_exempt", "SELECT source_id, target_id, relationship_type IN ('relates_to', 'prerequisite', 'defines') AND abs(s.lo_section - t.lo_section) <= 1 AS exempt FROM edges JOIN learning_objects s ON s.lo_id = source_id JOIN learning_objects t ON t.lo_id = target_id")
def soft_edge_exempt(fx):
    lo = fx.learning_objects.select("lo_id", "lo_section")
    e = fx.edges.join(lo.select(F.col("lo_id").alias("source_id"), F.col("lo_section").alias("a")), "source_id").join(lo.select(F.col("lo_id").alias("target_id"), F.col("lo_section").alias("b")), "target_id")
    return e.select("source_id", "target_id", (F.col("relationship_type").isin("relates_to", "prerequisite", "defines") & (F.abs(F.col("a") - F.col("b")) <= 1)).alias("exempt"))


LOCATED = "(SELECT section_id, nullif(start_page, 1) AS start_page, start_page + section_id % 12 AS end_page, section_id % 3 = 0 AS matched_via_title FROM sections)"


@query("F12_drop_phantom_sections", f"SELECT section_id FROM {LOCATED} WHERE start_page IS NOT NULL AND (matched_via_title OR end_page - start_page + 1 <= 8)")
def drop_phantom_sections(fx):
    s = fx.sections.select("section_id", F.nullif("start_page", F.lit(1)).alias("start_page"), (F.col("start_page") + F.col("section_id") % 12).alias("end_page"), (F.col("section_id") % 3 == 0).alias("matched_via_title"))
    return S.drop_phantoms(s).select("section_id")


@query("J1_lesson_tree", "SELECT l.lesson_id, l.title, array_to_string(coalesce(list(s.title ORDER BY s.order_index) FILTER (s.section_id IS NOT NULL), []), '|') AS section_titles, count(s.section_id) AS n FROM lessons l LEFT JOIN sections s ON s.lesson_id = l.lesson_id GROUP BY 1, 2")
def lesson_tree(fx):
    s = fx.sections.groupBy("lesson_id").agg(F.sort_array(F.collect_list(F.struct("order_index", "title"))).alias("s"))
    return fx.lessons.select("lesson_id", "title").join(s, "lesson_id", "left").select("lesson_id", "title", F.coalesce(F.array_join(F.transform("s", lambda x: x["title"]), "|"), F.lit("")).alias("section_titles"), F.coalesce(F.size("s"), F.lit(0)).alias("n"))


@query("J2_edges_for_lesson", "SELECT l.lesson AS lesson, e.source_id, e.target_id, s.title AS source_title, t.title AS target_title FROM (SELECT DISTINCT lo_lesson AS lesson FROM learning_objects) l JOIN edges e ON e.source_id // 28 = l.lesson OR e.target_id // 28 = l.lesson JOIN learning_objects s ON s.lo_id = source_id JOIN learning_objects t ON t.lo_id = target_id")
def edges_for_lesson(fx):
    lo = fx.learning_objects
    of = lambda side: fx.object_edges.join(lo.select(F.col("lo_id").alias(side), F.col("lo_lesson").alias("lesson")), side).select("lesson", "source_id", "target_id")
    e = of("source_id").unionByName(of("target_id")).distinct()
    return e.join(lo.select(F.col("lo_id").alias("source_id"), F.col("title").alias("source_title")), "source_id").join(lo.select(F.col("lo_id").alias("target_id"), F.col("title").alias("target_title")), "target_id")


J3SQL = "SELECT q.question_id, CASE WHEN l.lo_id IS NOT NULL THEN 'lo' WHEN s.lo_id IS NOT NULL THEN 'section' ELSE 'none' END AS kind, coalesce(l.title, s.title) AS objective FROM questions q LEFT JOIN learning_objects l ON l.lo_id = q.learning_object_id AND q.learning_object_id % 3 <> 0 LEFT JOIN learning_objects s ON s.lo_id = q.question_section_id AND q.question_section_id < 5"


def resolved(fx):
    lo = fx.learning_objects.select(F.col("lo_id").alias("learning_object_id"), F.col("title").alias("lt"), F.col("content").alias("lc")).where("learning_object_id % 3 <> 0")
    sec = fx.learning_objects.select(F.col("lo_id").alias("question_section_id"), F.col("title").alias("st"), F.col("content").alias("sc")).where("question_section_id < 5")
    q = fx.questions.join(lo, "learning_object_id", "left").join(sec, "question_section_id", "left")
    return q.select("question_id", "question_text", F.when(F.col("lt").isNotNull(), "lo").when(F.col("st").isNotNull(), "section").otherwise("none").alias("kind"), F.coalesce("lt", "st").alias("objective"), F.coalesce("lc", "sc").alias("content"))


@query("J3_resolve_objective", J3SQL)
def resolve_objective(fx):
    return resolved(fx).select("question_id", "kind", "objective")


@query("J4_widen_context", f"SELECT question_id, md5(CASE WHEN o IS NULL OR contains(question_text, o) THEN question_text ELSE question_text || chr(10) || chr(10) || o END) AS context FROM (SELECT q.question_id, q.question_text, r.objective AS o FROM questions q JOIN ({J3SQL}) r ON r.question_id = q.question_id)")
def widen_context(fx):
    r = resolved(fx)
    wide = F.when(F.col("objective").isNull() | F.contains("question_text", F.col("objective")), F.col("question_text")).otherwise(F.concat_ws("\n\n", "question_text", "objective"))
    return r.select("question_id", F.md5(wide).alias("context"))


QP = "(SELECT q.question_id, q.primary_lesson_id AS lesson_id, unnest(CASE WHEN len(l.source_pages) > 0 THEN l.source_pages ELSE range(q.question_section_id::INT + 1, q.question_section_id::INT + 4) END) AS page FROM questions q LEFT JOIN learning_objects l ON l.lo_id = q.learning_object_id)"


def question_pages_df(fx):
    lo = fx.learning_objects.select(F.col("lo_id").alias("learning_object_id"), "source_pages")
    s = F.col("question_section_id").cast("int")
    pages = F.when(F.size("source_pages") > 0, F.col("source_pages")).otherwise(F.sequence(s + 1, s + 3))
    return fx.questions.join(lo, "learning_object_id", "left").select("question_id", F.col("primary_lesson_id").alias("lesson_id"), F.explode(pages).alias("page"))


@query("J5_question_pages", f"SELECT question_id, lesson_id, page FROM {QP}")
def question_pages(fx):
    return question_pages_df(fx)


COVER = f"""(SELECT p.lesson_id, p.page, length(trim(p.page_text)) AS chars, count(DISTINCT x.question_id) AS n FROM lesson_pages p LEFT JOIN {QP} x ON x.lesson_id = p.lesson_id AND x.page = p.page GROUP BY ALL)"""


def page_cover(fx):
    n = question_pages_df(fx).groupBy("lesson_id", "page").agg(F.countDistinct("question_id").alias("n"))
    p = fx.lesson_pages.select("lesson_id", "page", F.length(F.trim("page_text")).alias("chars"))
    return p.join(n, ["lesson_id", "page"], "left").na.fill(0, ["n"])


@query("A9_page_coverage", f"""SELECT lesson_id, round(100.0 * count(*) FILTER (n > 0) / count(*), 2) AS page_pct, round(100.0 * coalesce(sum(chars) FILTER (n > 0), 0) / nullif(sum(chars), 0), 2)::DOUBLE AS char_pct, round(100.0 * coalesce(sum(chars) FILTER (n > 0 AND chars >= 50), 0) / nullif(sum(chars) FILTER (chars >= 50), 0), 2)::DOUBLE AS solid_pct FROM {COVER} GROUP BY 1""")
def page_coverage(fx):
    hit, solid, c = F.col("n") > 0, F.col("chars") >= 50, F.col("chars")
    share = lambda a, b: F.round(100.0 * F.coalesce(F.sum(F.when(a, c)), F.lit(0)) / F.nullif(F.sum(F.when(b, c)), F.lit(0)), 2)
    return page_cover(fx).groupBy("lesson_id").agg(F.round(100.0 * F.count_if(hit) / F.count("*"), 2).alias("page_pct"), share(hit, F.lit(True)).alias("char_pct"), share(hit & solid, solid).alias("solid_pct"))


UNC = f"(SELECT lesson_id, page, chars FROM (SELECT *, row_number() OVER (PARTITION BY lesson_id ORDER BY chars DESC, page) AS r FROM {COVER} WHERE n = 0 AND chars >= 50) WHERE r <= 20)"


def uncovered(fx):
    rank = F.row_number().over(Window.partitionBy("lesson_id").orderBy(F.desc("chars"), "page"))
    return page_cover(fx).where("n = 0 AND chars >= 50").withColumn("r", rank).where("r <= 20").select("lesson_id", "page", "chars")


@query("A9_uncovered_pages", f"SELECT lesson_id, page, chars FROM {UNC}")
def uncovered_pages(fx):
    return uncovered(fx)


@query("J10_uncovered_targets", f"SELECT u.lesson_id, count(DISTINCT lo_id) AS los, count(DISTINCT u.page) AS pages FROM {UNC} u JOIN (SELECT lo_id, unnest(source_pages) AS page FROM learning_objects) l ON l.page = u.page GROUP BY 1")
def uncovered_targets(fx):
    lo = fx.learning_objects.select("lo_id", F.explode("source_pages").alias("page"))
    return uncovered(fx).join(lo, "page").groupBy("lesson_id").agg(F.countDistinct("lo_id").alias("los"), F.countDistinct("page").alias("pages"))


EVERY = "(SELECT lesson_id, unnest(range(0, length(raw_content) // 700 + 1)) * 700 AS o FROM lessons)"


@query("J6_offset_to_page", f"SELECT x.lesson_id, x.o AS \"offset\", coalesce(p.page, (SELECT max(page) FROM lesson_pages l WHERE l.lesson_id = x.lesson_id)) AS page FROM {EVERY} x LEFT JOIN {OFFS} p ON p.lesson_id = x.lesson_id AND x.o >= p.start_offset AND x.o < p.end_offset")
def offset_to_page(fx):
    points = fx.lessons.select("lesson_id", F.explode(F.sequence(F.lit(0), F.expr("int(length(raw_content) div 700)"))).alias("k")).select("lesson_id", (F.col("k") * 700).alias("offset"))
    return S.offset_to_page(points, S.page_offsets(fx.lesson_pages))


HITS = f"(SELECT lesson_id, section_id, start_page, w, is_title, unnest(o) AS off, len_ FROM (SELECT s.lesson_id, s.section_id, s.start_page, 3.0 AS w, true AS is_title, length(s.title) AS len_, [x for x in [list_sum([length(y) for y in p[1:i]])::BIGINT + (i - 1) * length(s.title) for i in range(1, least(len(p), 201))]] AS o FROM (SELECT s.*, string_split(lower(l.raw), lower(s.title)) AS p FROM sections s JOIN ({JOINED}) l ON l.lesson_id = s.lesson_id WHERE length(s.title) >= 3) s UNION ALL SELECT s.lesson_id, s.section_id, s.start_page, 1.0, false, length(k), [list_sum([length(y) for y in p[1:i]])::BIGINT + (i - 1) * length(k) for i in range(1, least(len(p), 101))] FROM (SELECT s.*, string_split(lower(l.raw), lower(k)) AS p FROM (SELECT *, unnest(key_topics) AS k FROM sections) s JOIN ({JOINED}) l ON l.lesson_id = s.lesson_id WHERE length(k) >= 3) s))"


def section_hits(fx):
    row = lambda needle, weight, title, most: [
        "lesson_id", "section_id", needle.alias("needle"), F.lit(weight).alias("weight"), F.lit(title).alias("is_title"), F.lit(most).alias("most")
    ]
    needles = fx.sections.select(*row(F.col("title"), 3.0, True, 200)).unionByName(fx.sections.select(*row(F.explode("key_topics"), 1.0, False, 100)))
    return S.hits(S.joined_pages(fx.lesson_pages), needles.where("length(needle) >= 3")).withColumn("length", F.length("needle"))


CLUST = f"(SELECT *, sum(new) OVER (PARTITION BY section_id ORDER BY off, w ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN off - lag(off) OVER (PARTITION BY section_id ORDER BY off, w) > 3000 THEN 1 ELSE 0 END AS new FROM {HITS}))"


@query("W1_gap_clusters", f"SELECT section_id, cluster::BIGINT AS cluster, count(*) AS hits, min(off) AS first, max(off) AS last FROM {CLUST} GROUP BY 1, 2")
def gap_clusters(fx):
    return S.gap_clusters(section_hits(fx), ["section_id"]).groupBy("section_id", "cluster").agg(F.count("*").alias("hits"), F.min("offset").alias("first"), F.max("offset").alias("last"))


BEST = f"""(SELECT section_id, CASE WHEN titles > 0 THEN t_first ELSE f END AS start_offset, CASE WHEN titles > 0 THEN t_last ELSE l END AS end_offset, titles > 0 AS matched_via_title FROM
  (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY titles DESC, weight DESC, f) AS r FROM (SELECT section_id, cluster, count(*) FILTER (is_title) AS titles, sum(w) AS weight, min(off) AS f, max(off * 1000 + len_) // 1000 + max(off * 1000 + len_) % 1000 AS l,
    min(off) FILTER (is_title) AS t_first, max(off + len_) FILTER (is_title) AS t_last FROM {CLUST} GROUP BY 1, 2)) WHERE r = 1)"""
PAGE_AT = f"coalesce((SELECT p.page FROM {OFFS} p WHERE p.lesson_id = b.section_id // 1000 AND b.{{o}} >= p.start_offset AND b.{{o}} < p.end_offset), (SELECT max(page) FROM lesson_pages p WHERE p.lesson_id = b.section_id // 1000))"


@query("W2_best_cluster", f"""SELECT b.section_id, b.start_offset, b.end_offset, {PAGE_AT.format(o='start_offset')} AS start_page, {PAGE_AT.format(o='end_offset')} AS end_page,
  md5(substr(substr(l.raw, b.start_offset + 1, b.end_offset + 600 - b.start_offset), 1, 3000)) AS snippet, b.matched_via_title FROM {BEST} b JOIN ({JOINED}) l ON l.lesson_id = b.section_id // 1000""")
def best_cluster(fx):
    return S.located(S.best_cluster(section_hits(fx), ["lesson_id", "section_id"]), fx.lesson_pages).select("section_id", "start_offset", "end_offset", "start_page", "end_page", F.md5("snippet").alias("snippet"), "matched_via_title")


@query("J7_excluded_ranges", f"SELECT section_id, count(*) AS hits FROM {HITS} h WHERE NOT EXISTS (SELECT 1 FROM {OFFS} p WHERE p.lesson_id = h.lesson_id AND p.page = 1 AND h.off >= p.start_offset AND h.off < p.end_offset) GROUP BY 1")
def excluded_ranges(fx):
    first = S.page_offsets(fx.lesson_pages).where("page = 1").select("lesson_id", "start_offset", "end_offset")
    h = section_hits(fx)
    on = (h["lesson_id"] == first["lesson_id"]) & (h["offset"] >= first["start_offset"]) & (h["offset"] < first["end_offset"])
    return h.join(first, on, "left_anti").groupBy("section_id").agg(F.count("*").alias("hits"))


ISL = "(SELECT lesson_id, min(page) AS \"start\", max(page) AS \"end\" FROM (SELECT lesson_id, page, page - row_number() OVER (PARTITION BY lesson_id ORDER BY page) AS g FROM {src}) GROUP BY lesson_id, g)"
SOLID = "(SELECT * FROM lesson_pages WHERE length(trim(page_text)) >= 30)"


@query("W3_consecutive_runs", f"SELECT lesson_id, \"start\", \"end\" FROM {ISL.format(src=SOLID)}")
def consecutive_runs(fx):
    return S.runs(fx.lesson_pages.where(F.length(F.trim("page_text")) >= 30).select("lesson_id", "page"), ["lesson_id"])


HEADP = f"(SELECT lesson_id, page, {HEAD} AS heading FROM (SELECT lesson_id, page, nullif(trim(page_text), '') AS h FROM lesson_pages))"


@query("W4_heading_runs", f"""SELECT lesson_id, heading, min(page) AS start_page, max(page) AS end_page FROM (SELECT *, sum(new) OVER (PARTITION BY lesson_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN heading = lag(heading) OVER w AND page = lag(page) OVER w + 1 THEN 0 ELSE 1 END AS new FROM {HEADP} WHERE heading IS NOT NULL WINDOW w AS (PARTITION BY lesson_id ORDER BY page))) GROUP BY lesson_id, heading, g""")
def heading_runs(fx):
    p = fx.lesson_pages.select("lesson_id", "page", slide_heading(F.col("page_text")).alias("heading")).where("heading IS NOT NULL")
    w = Window.partitionBy("lesson_id").orderBy("page")
    same = (F.col("heading") == F.lag("heading").over(w)) & (F.col("page") == F.lag("page").over(w) + 1)
    p = p.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("lesson_id", "heading", "g").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page")).drop("g")


UNCP = f"(SELECT * FROM {SOLID} p WHERE page % 5 IN (0, 4) AND NOT EXISTS (SELECT 1 FROM ({{toc}}) t WHERE t.lesson_id = p.lesson_id AND t.page = p.page))"
TOC = "SELECT p.lesson_id, p.page FROM lesson_pages p JOIN (SELECT lesson_id, list(lower(title)) FILTER (length(title) > 0) AS t FROM sections GROUP BY 1) s ON s.lesson_id = p.lesson_id WHERE len([x for x in s.t if contains(lower(p.page_text), x)]) >= greatest(2, floor(0.6 * len(s.t)))"
RUNS = ISL.format(src=UNCP.format(toc=TOC))


@query("W5_uncovered_runs", f"""SELECT lesson_id, "start", "end", title FROM (SELECT *, row_number() OVER (PARTITION BY lesson_id, lower(title) ORDER BY "start") AS k FROM (SELECT r.lesson_id, r."start", r."end", arg_min(h.heading, h.page) AS title FROM {RUNS} r JOIN {HEADP} h
  ON h.lesson_id = r.lesson_id AND h.page BETWEEN r."start" AND r."end" AND h.heading IS NOT NULL GROUP BY ALL)) x WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM sections s WHERE s.lesson_id = x.lesson_id AND lower(s.title) = lower(x.title))""")
def uncovered_runs(fx):
    """Sections are taken to cover their first three pages, so that runs are left over."""
    p = fx.lesson_pages.where("page % 5 IN (0, 4)").where(F.length(F.trim("page_text")) >= 30).select("lesson_id", "page")
    r = S.runs(p.join(S.toc_pages(fx.lesson_pages, fx.sections), ["lesson_id", "page"], "left_anti"), ["lesson_id"])
    return S.titled_runs(r, fx.lesson_pages.select("lesson_id", "page", slide_heading(F.col("page_text")).alias("heading")), fx.sections)


@query("D12_set_difference_pages", f"SELECT lesson_id, page FROM lesson_pages WHERE page > 1 AND (lesson_id, page) NOT IN (SELECT (lesson_id, page) FROM {QP})")
def set_difference_pages(fx):
    return fx.lesson_pages.where("page > 1").select("lesson_id", "page").join(question_pages_df(fx).select("lesson_id", "page").distinct(), ["lesson_id", "page"], "left_anti")


# the word boundary before a letter that isn't ASCII is left out in SQL, whose boundaries are ASCII ones
CUE_SQL = "(?i)" + "|".join(p.removeprefix(r"\b") if not p.removeprefix(r"\b")[0].isascii() else p for p in V.CUES)
CUE = f"""(SELECT lesson_id, n, unnest([{{'off': list_sum([length(y) for y in p[1:i]])::BIGINT + coalesce(list_sum([length(y) for y in m[1:i - 1]]), 0)::BIGINT, 'cue': m[i]}} for i in range(1, len(m) + 1)], recursive := true)
  FROM (SELECT lesson_id, length(raw) AS n, string_split_regex(raw, '{CUE_SQL}') AS p, regexp_extract_all(raw, '{CUE_SQL}') AS m FROM cue_lessons) WHERE len(m) > 0)"""


def cue_hits(fx):
    return S.cue_hits(fx.cue_lessons, "lesson_id")


@query("X12_find_cues", f"SELECT lesson_id, off AS \"offset\", cue FROM {CUE}")
def find_cues(fx):
    return cue_hits(fx).select("lesson_id", "offset", "cue")


@query("W6_merge_windows", f"""SELECT lesson_id, min(s) AS "start", max(e) AS "end", string_agg(cue, ' | ' ORDER BY s, e, cue) AS cues FROM (SELECT *, coalesce(sum(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY lesson_id ORDER BY s, e, cue ROWS UNBOUNDED PRECEDING), 0) AS g FROM
  (SELECT *, max(e) OVER (PARTITION BY lesson_id ORDER BY s, e, cue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT lesson_id, cue, greatest(0, off - 150) AS s, least(n, off + length(cue) + 250) AS e FROM {CUE}))) GROUP BY lesson_id, g QUALIFY row_number() OVER (PARTITION BY lesson_id ORDER BY min(s)) <= 20""")
def merge_windows(fx):
    return S.merge_windows(cue_hits(fx), ["lesson_id"])


@query("W7_chapter_ranges", """SELECT lesson_id, title, s AS "start", e AS "end" FROM (SELECT t.lesson_id, i.title, t.s, coalesce(t.e, n.pages) AS e, n.pages FROM (SELECT lesson_id, row_number() OVER w - 1 AS i, page + 1 AS s, lead(page) OVER w - 1 AS e FROM lesson_pages WHERE page % 4 = 2 WINDOW w AS (PARTITION BY lesson_id ORDER BY page)) t
  JOIN (SELECT lesson_id, order_index AS i, title FROM sections) i ON i.lesson_id = t.lesson_id AND i.i = t.i JOIN (SELECT lesson_id, count(*) AS pages FROM lesson_pages GROUP BY 1) n ON n.lesson_id = t.lesson_id) WHERE s <= e AND s <= pages""")
def chapter_ranges(fx):
    p = fx.lesson_pages
    items = fx.sections.select("lesson_id", F.col("order_index").cast("int").alias("i"), "title")
    return S.chapter_ranges(items, p.where("page % 4 = 2").select("lesson_id", "page"), p.groupBy("lesson_id").agg(F.count("*").alias("pages")))


@query("W8_section_order", "SELECT section_id, row_number() OVER (PARTITION BY lesson_id ORDER BY start_page, section_id) - 1 AS pos FROM sections")
def section_order(fx):
    return fx.sections.select("section_id", (F.row_number().over(Window.partitionBy("lesson_id").orderBy("start_page", "section_id")) - 1).alias("pos"))


@query("W11_order_index", "SELECT question_id, row_number() OVER (PARTITION BY quiz_id ORDER BY question_id) - 1 AS order_index FROM questions")
def order_index(fx):
    return fx.questions.select("question_id", (F.row_number().over(Window.partitionBy("quiz_id").orderBy("question_id")) - 1).alias("order_index"))


@query("W12_lead_pairs", "SELECT lesson_id, nxt FROM (SELECT lesson_id, lead(lesson_id) OVER (PARTITION BY course_id ORDER BY lesson_id) AS nxt FROM lessons) WHERE nxt IS NOT NULL")
def lead_pairs(fx):
    return fx.lessons.select("lesson_id", F.lead("lesson_id").over(Window.partitionBy("course_id").orderBy("lesson_id")).alias("nxt")).where("nxt IS NOT NULL")


@query("J11_study_guide", "SELECT quiz_id, count(*) AS questions, array_to_string(list_sort(list_distinct(list(l.title))), '|') AS lessons FROM questions q JOIN lessons l ON l.lesson_id = q.primary_lesson_id GROUP BY 1")
def study_guide(fx):
    q = fx.questions.join(fx.lessons.select(F.col("lesson_id").alias("primary_lesson_id"), "title"), "primary_lesson_id")
    return q.groupBy("quiz_id").agg(F.count("*").alias("questions"), F.array_join(F.sort_array(F.collect_set("title")), "|").alias("lessons"))


EL = "(SELECT e.source_id, e.target_id, s.lo_lesson AS ls, t.lo_lesson AS lt, s.lo_section AS ss, t.lo_section AS st FROM edges e JOIN learning_objects s ON s.lo_id = e.source_id JOIN learning_objects t ON t.lo_id = e.target_id)"
ASKED = "(SELECT a, b, unnest(range(7)) AS o FROM (SELECT a, unnest([a + 1, NULL]) AS b FROM (SELECT DISTINCT lo_lesson AS a FROM learning_objects)))"
FOCUS = "(SELECT lo_lesson AS a, list_sort(list_distinct(list(lo_section))) AS f FROM learning_objects GROUP BY 1)"
POOL = "SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY a, k) AS n FROM ({x}) WINDOW w AS (PARTITION BY a, k ORDER BY source_id, target_id)"


ANCHORS = f"""WITH e AS {EL}, c AS ({POOL.format(x='SELECT ls AS a, lt AS k, source_id, target_id FROM e WHERE ls <> lt UNION ALL SELECT lt, ls, source_id, target_id FROM e WHERE ls <> lt')}),
  w AS ({POOL.format(x='SELECT ls AS a, 0 AS k, source_id, target_id FROM e WHERE ls = lt')}), f AS ({POOL.format(x='SELECT DISTINCT a, k, source_id, target_id FROM (SELECT ls AS a, ss AS k, source_id, target_id FROM e WHERE ls = lt UNION ALL SELECT ls, st, source_id, target_id FROM e WHERE ls = lt)')}),
  q AS (SELECT ASKED.*, FOCUS.f[o % len(FOCUS.f) + 1] AS s FROM {ASKED} ASKED JOIN {FOCUS} FOCUS USING (a))
  SELECT q.a AS lesson, q.b AS second_lesson, q.o AS "offset", c.a IS NOT NULL AS spans_lessons, coalesce(c.source_id, f.source_id, w.source_id) AS source_id, coalesce(c.target_id, f.target_id, w.target_id) AS target_id
  FROM q LEFT JOIN c ON c.a = q.a AND c.k = q.b AND c.i = q.o % c.n LEFT JOIN f ON f.a = q.a AND f.k = q.s AND f.i = q.o % f.n LEFT JOIN w ON w.a = q.a AND w.i = q.o % w.n"""


@query("J12_cross_lesson_edges", ANCHORS)
def cross_lesson_edges(fx):
    """Each lesson with the next one and alone, at seven offsets."""
    lo = fx.learning_objects
    ends = lambda side, x: lo.select(F.col("lo_id").alias(side), F.col("lo_lesson").alias(f"l{x}"), F.col("lo_section").alias(f"s{x}"))
    e = fx.object_edges.join(ends("source_id", "s"), "source_id").join(ends("target_id", "t"), "target_id")
    lessons = lo.select(F.col("lo_lesson").alias("lesson")).distinct()
    pairs = lessons.withColumn("second_lesson", F.explode(F.array(F.col("lesson") + 1, F.lit(None).cast("long"))))
    asked = pairs.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return S.anchor_edges(e, asked, lo.select(F.col("lo_lesson").alias("lesson"), F.col("lo_section").alias("section")))


@query("J13_coalesce_live_snapshot", "SELECT coalesce(a.scope_id, b.scope_id) AS scope_id, coalesce(a.v, b.v) AS v FROM (SELECT scope_id, round(max(value), 4) AS v FROM metric_payloads WHERE metric_key = 'click' AND scope_id % 3 <> 0 GROUP BY 1) a FULL JOIN (SELECT scope_id, round(min(value), 4) AS v FROM metric_payloads WHERE metric_key = 'view' GROUP BY 1) b ON a.scope_id = b.scope_id")
def coalesce_live_snapshot(fx):
    m = fx.metric_payloads
    live = m.where("metric_key = 'click' AND scope_id % 3 <> 0").groupBy("scope_id").agg(F.round(F.max("value"), 4).alias("a"))
    old = m.where("metric_key = 'view'").groupBy("scope_id").agg(F.round(F.min("value"), 4).alias("b"))
    return live.join(old, "scope_id", "full").select("scope_id", F.coalesce("a", "b").alias("v"))


@query("J8_bind_edges", r"""SELECT e.source_id, e.target_id, s.lo_id AS bound_source, t.lo_id AS bound_target FROM (SELECT e.source_id, e.target_id, regexp_replace(a.title || ' (x)', '\s*\([^)]*\)\s*$', '') AS st, '  ' || b.title AS tt FROM edges e JOIN learning_objects a ON a.lo_id = e.source_id JOIN learning_objects b ON b.lo_id = e.target_id) e
  JOIN (SELECT lower(trim(title)) AS k, min(lo_id) AS lo_id FROM learning_objects GROUP BY 1) s ON s.k = lower(trim(e.st)) JOIN (SELECT lower(trim(title)) AS k, min(lo_id) AS lo_id FROM learning_objects GROUP BY 1) t ON t.k = lower(trim(e.tt)) WHERE s.lo_id <> t.lo_id""")
def bind_edges(fx):
    lo = fx.learning_objects
    e = fx.edges.join(lo.select(F.col("lo_id").alias("source_id"), F.col("title").alias("st")), "source_id").join(lo.select(F.col("lo_id").alias("target_id"), F.col("title").alias("tt")), "target_id")
    e = e.withColumns({"st": F.regexp_replace(F.concat("st", F.lit(" (x)")), r"\s*\([^)]*\)\s*$", ""), "tt": F.concat(F.lit("  "), "tt")})
    exact = lo.groupBy("title").agg(F.min("lo_id").alias("x"))
    loose = lo.groupBy(F.lower(F.trim("title")).alias("k")).agg(F.min("lo_id").alias("y"))
    for side, out in (("st", "bound_source"), ("tt", "bound_target")):
        e = e.join(exact.withColumnRenamed("title", side), side, "left").join(loose, F.lower(F.trim(side)) == F.col("k"), "left").withColumn(out, F.coalesce("x", "y")).drop("x", "y", "k")
    return e.where("bound_source <> bound_target").select("source_id", "target_id", "bound_source", "bound_target")
