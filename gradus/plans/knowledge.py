"""Queries of concepts, graphs and triples (G*, A10, J9), search (T*) and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradus.functions.text import tokens
from gradus.operators import concepts as C
from gradus.operators import context as X
from gradus.operators import graph as G
from gradus.operators import ontology as K
from gradus.operators import sampling as P
from gradus.operators import vocabulary as V
from gradus.sources import io
from gradus.sources.fixture_sql import TOK

from .registry import query
from .structure import ANCHORS, cross_lesson_edges

STOP = "[" + ", ".join(f"'{w}'" for w in C.STOPWORDS) + "]"
NORM = r"regexp_replace(trim(lower({})), '\s+', ' ', 'g')"
ROWS = f"(SELECT lo_id, lo_lesson, pos, display, {NORM.format('display')} AS norm FROM (SELECT lo_id, lo_lesson, unnest(range(len(d))) AS pos, unnest(d) AS display FROM (SELECT lo_id, lo_lesson, CASE WHEN list_contains(keywords, title) THEN list_concat([title], [k for k in keywords if k <> title]) ELSE list_concat([title], keywords) END AS d FROM learning_objects)))"
OK = f"(SELECT * FROM {ROWS} WHERE length(norm) >= 3 AND NOT list_contains({STOP}, norm) AND regexp_matches(norm, '{C.LETTER}'))"
CON = f"(SELECT norm, arg_min(display, lo_id * 100 + pos) AS display, list_sort(list_distinct(list(lo_id))) AS lo_ids FROM {OK} GROUP BY norm)"
DEG = "(SELECT lo_id, count(*) AS degree FROM (SELECT source_id AS lo_id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1)"
WGT = f"(SELECT norm, 1 + coalesce(sum(degree), 0)::BIGINT AS weight FROM (SELECT norm, unnest(lo_ids) AS lo_id FROM {CON}) LEFT JOIN {DEG} d USING (lo_id) GROUP BY norm)"
BLOB = f"(SELECT question_id, blob, regexp_extract_all(blob, '{TOK}') AS words FROM (SELECT question_id, {NORM.format('''concat_ws(' ', question_text, correct_answer, array_to_string(options, ' '))''')} AS blob FROM questions))"
MEN = f"(SELECT c.norm, q.question_id FROM {CON} c JOIN {BLOB} q ON CASE WHEN contains(c.norm, ' ') THEN contains(q.blob, c.norm) ELSE len([w for w in q.words if starts_with(w, c.norm)]) > 0 END)"


@query("F8_concept_acceptable", f"SELECT norm, length(norm) >= 3 AND NOT list_contains({STOP}, norm) AND regexp_matches(norm, '{C.LETTER}') AS ok FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOK}')) AS norm FROM documents)")
def concept_acceptable(fx):
    return fx.documents.select(F.explode(tokens(F.col("text"))).alias("norm")).distinct().select("norm", C.acceptable(F.col("norm")).alias("ok"))


@query("G2_extract_concepts", f"SELECT norm, display, array_to_string(lo_ids, ',') AS lo_ids FROM {CON}")
def extract_concepts(fx):
    return C.extract(fx.learning_objects).withColumn("lo_ids", F.array_join(F.col("lo_ids").cast("array<string>"), ","))


@query("G1_concept_weights", f"SELECT norm, weight FROM {WGT}")
def concept_weights(fx):
    return C.weights(C.extract(fx.learning_objects), fx.edges)


@query("J9_concept_mentions", f"SELECT norm, question_id FROM {MEN}")
def concept_mentions(fx):
    return C.mentions(C.extract(fx.learning_objects), fx.questions)


REC = f"(SELECT c.norm, w.weight, coalesce(m.n, 0) AS n FROM {CON} c JOIN {WGT} w ON w.norm = c.norm LEFT JOIN (SELECT norm, count(*) AS n FROM {MEN} GROUP BY 1) m ON m.norm = c.norm)"


def records(fx):
    c = C.extract(fx.learning_objects)
    n = C.mentions(c, fx.questions).groupBy("norm").agg(F.count("*").alias("n"))
    return C.weights(c, fx.edges).join(n, "norm", "left").na.fill(0, ["n"])


@query("A10_concept_coverage", f"SELECT count(*) AS total, count(*) FILTER (n > 0) AS covered, round(100.0 * coalesce(sum(weight) FILTER (n > 0), 0) / sum(weight), 2)::DOUBLE AS weighted_pct FROM {REC}")
def concept_coverage(fx):
    hit = F.col("n") > 0
    return records(fx).agg(F.count("*").alias("total"), F.count_if(hit).alias("covered"), F.round(100.0 * F.coalesce(F.sum(F.when(hit, F.col("weight"))), F.lit(0)) / F.sum("weight"), 2).alias("weighted_pct"))


@query("A10_coverage_levels", f"""WITH o AS (SELECT lo_id, lo_id AS lesson_id, norm FROM (SELECT DISTINCT lo_id, norm FROM {OK})),
  q AS (SELECT b.blob, b.words, unnest(list_distinct([q.primary_lesson_id, q.secondary_lesson_id])) AS lesson_id FROM {BLOB} b JOIN questions q USING (question_id)),
  r AS (SELECT o.lesson_id, o.norm, 1 + coalesce(max(d.degree), 0)::BIGINT AS weight,
      count(q.blob) FILTER (CASE WHEN contains(o.norm, ' ') THEN contains(q.blob, o.norm) ELSE len([w for w in q.words if starts_with(w, o.norm)]) > 0 END) > 0 AS hit
    FROM o LEFT JOIN {DEG} d ON d.lo_id = o.lo_id LEFT JOIN q ON q.lesson_id = o.lesson_id GROUP BY 1, 2)
  SELECT CASE WHEN GROUPING(l.course_id) = 1 THEN 'corpus' WHEN GROUPING(r.lesson_id) = 1 THEN 'course' ELSE 'lesson' END AS level, l.course_id, r.lesson_id, count(*) AS total, count(*) FILTER (hit) AS covered,
    round(100.0 * coalesce(sum(weight) FILTER (hit), 0) / sum(weight), 2)::DOUBLE AS weighted_pct FROM r JOIN lessons l USING (lesson_id) GROUP BY GROUPING SETS ((l.course_id, r.lesson_id), (l.course_id), ())""")
def coverage_levels(fx):
    """Concepts of each lesson that its own questions mention, for lessons, courses and the corpus in one pass; an object belongs to the lesson of its number."""
    q = fx.questions.withColumn("lesson_id", F.explode(F.array_distinct(F.array("primary_lesson_id", "secondary_lesson_id"))))
    return C.coverage(fx.learning_objects.withColumn("lesson_id", F.col("lo_id")), fx.edges, q, fx.lessons.select("lesson_id", "course_id"))


@query("A10_uncovered_concepts", f"SELECT norm, weight FROM {REC} WHERE n = 0 ORDER BY weight DESC, norm LIMIT 20")
def uncovered_concepts(fx):
    return records(fx).where("n = 0").orderBy(F.desc("weight"), "norm").limit(20).select("norm", "weight")


FALL = """(SELECT lo_lesson, lo_id AS source_id, head AS target_id, 'is_type_of' AS type FROM (SELECT *, first(lo_id) OVER (PARTITION BY lo_lesson, object_type ORDER BY lo_id) AS head FROM learning_objects) WHERE lo_id <> head UNION ALL
  SELECT a.lo_lesson, a.lo_id, b.lo_id, 'relates_to' FROM (SELECT *, row_number() OVER (PARTITION BY lo_lesson ORDER BY lo_id) AS i FROM learning_objects) a JOIN (SELECT *, row_number() OVER (PARTITION BY lo_lesson ORDER BY lo_id) AS i FROM learning_objects) b ON a.lo_lesson = b.lo_lesson AND b.i BETWEEN a.i + 1 AND a.i + 3 AND list_has_any(a.keywords, b.keywords))"""


@query("G3_fallback_edges", f"SELECT * FROM {FALL}")
def fallback_edges(fx):
    return G.fallback_edges(fx.learning_objects, "lo_lesson")


BOUND = "(SELECT l.lo_id, m.bound FROM learning_objects l JOIN (SELECT lower(trim(title)) AS k, min(lo_id) AS bound FROM learning_objects GROUP BY 1) m ON m.k = lower(trim(l.title)))"


@query("G4_clean_edges", f"""WITH b AS (SELECT DISTINCT s.bound AS source_id, t.bound AS target_id, relationship_type AS type FROM edges e JOIN {BOUND} s ON s.lo_id = source_id JOIN {BOUND} t ON t.lo_id = target_id WHERE s.bound <> t.bound),
  k AS (SELECT DISTINCT s.lo_lesson, CASE WHEN swap THEN target_id ELSE source_id END AS source_id, CASE WHEN swap THEN source_id ELSE target_id END AS target_id, type FROM
    (SELECT b.*, type = 'part_of' AND contains(lower(t.title), lower(s.title)) AND s.title <> t.title AS swap, (length(trim(s.title)) >= 15 AND contains(lower(t.content), lower(trim(s.title)))) OR (type IN ('relates_to', 'prerequisite', 'defines') AND abs(s.lo_section - t.lo_section) <= 1) AS good
      FROM b JOIN learning_objects s ON s.lo_id = source_id JOIN learning_objects t ON t.lo_id = target_id) x JOIN learning_objects s ON s.lo_id = x.source_id WHERE good)
  SELECT source_id, target_id, type FROM k UNION ALL SELECT source_id, target_id, type FROM {FALL} WHERE lo_lesson NOT IN (SELECT lo_lesson FROM k)""")
def clean_edges(fx):
    """Ends bound to the first object of their title, edges without evidence dropped, directions mended, repeats dropped; lessons that have none left get the fallback."""
    kept = G.clean(fx.edges, fx.learning_objects.withColumnsRenamed({"lo_lesson": "lesson", "lo_section": "section"}))
    rest = G.fallback_edges(fx.learning_objects, "lo_lesson").join(kept.select(F.col("lesson").alias("lo_lesson")).distinct(), "lo_lesson", "left_anti")
    return kept.select("source_id", "target_id", "type").unionByName(rest.select("source_id", "target_id", "type"))


@query("G5_ontology_context", """SELECT lesson, relationship_type, source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY lesson, relationship_type ORDER BY source_id, target_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY lesson ORDER BY source_id, target_id) AS k FROM
  (SELECT DISTINCT l.lo_lesson AS lesson, e.* FROM edges e JOIN learning_objects l ON l.lo_id = e.source_id OR l.lo_id = e.target_id)) WHERE k <= 20) WHERE r <= 5""")
def ontology_context(fx):
    lo = fx.learning_objects
    of = lambda side: fx.edges.join(lo.select(F.col("lo_id").alias(side), F.col("lo_lesson").alias("lesson")), side).select("lesson", "relationship_type", "source_id", "target_id")
    e = of("source_id").unionByName(of("target_id")).distinct()
    first = F.row_number().over(Window.partitionBy("lesson").orderBy("source_id", "target_id"))
    e = e.withColumn("k", first).where("k <= 20").drop("k")
    r = F.row_number().over(Window.partitionBy("lesson", "relationship_type").orderBy("source_id", "target_id"))
    return e.withColumn("r", r).where("r <= 5").drop("r")


@query("G6_triples", "SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM triples GROUP BY p")
def triple_counts(fx):
    return fx.triples.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"))


ESC = r"""replace(replace(replace(replace(replace({x}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""
NODE = "'<urn:x:' || {x} || '>'"
FACTS = {  # predicate: (subject, object, rows, whether the object is a node)
    "lesson": [("type", "'Lesson'", 0), ("label", "title", 0), ("belongsTo", "'course_' || regexp_extract(course_id, '[0-9]+$')", 1)],
    "section": [("type", "'Section'", 0), ("label", "title", 0), ("hasContent", "content", 0), ("startPage", "start_page", 0), ("endPage", "end_page", 0), ("orderIndex", "order_index", 0), ("inLesson", "'lesson_' || lesson_id", 1)],
    "lo": [("type", "object_type", 0), ("label", "title", 0), ("hasContent", "content", 0), ("hasKeyword", "unnest(keywords)", 0)],
    "question": [("type", "'Question'", 0), ("questionText", "question_text", 0), ("soloLevel", "solo_level", 0), ("correctAnswer", "correct_answer", 0), ("assesses", "'lo_' || learning_object_id", 1)],
}
TABLE_OF = {"lesson": ("lessons", "lesson_id"), "section": ("sections", "section_id"), "lo": ("learning_objects", "lo_id"), "question": ("questions", "question_id")}
NT = " UNION ALL ".join(
    f"SELECT '<urn:x:{kind}_' || id || '> <urn:x:{p}> ' || {NODE.format(x='o') if node else chr(39) + chr(34) + chr(39) + ' || ' + ESC.format(x='o') + ' || ' + chr(39) + chr(34) + chr(39)} || ' .' AS line FROM (SELECT {TABLE_OF[kind][1]} AS id, ({o})::VARCHAR AS o FROM {TABLE_OF[kind][0]}) WHERE o IS NOT NULL"
    for kind, facts in FACTS.items() for p, o, node in facts
) + " UNION ALL SELECT DISTINCT '<urn:x:lo_' || source_id || '> <urn:x:' || relationship_type || '> <urn:x:lo_' || target_id || '> .' FROM edges"


@query("S11_export_triples", f"SELECT line FROM ({NT})")
def export_triples(fx):
    """Facts of lessons, sections, objects, questions and edges, written as N-Triples and read again."""
    text = lambda c: F.col(c).cast("string")
    node = lambda kind, c: F.concat(F.lit(f"{kind}_"), text(c))
    parts = [
        G.facts(fx.lessons, node("lesson", "lesson_id"), {"type": F.lit("Lesson"), "label": F.col("title")}, {"belongsTo": F.concat(F.lit("course_"), F.regexp_extract("course_id", "[0-9]+$", 0))}),
        G.facts(fx.sections, node("section", "section_id"), {"type": F.lit("Section"), "label": F.col("title"), "hasContent": F.col("content"), "startPage": text("start_page"), "endPage": text("end_page"), "orderIndex": text("order_index")}, {"inLesson": node("lesson", "lesson_id")}),
        G.facts(fx.learning_objects, node("lo", "lo_id"), {"type": F.col("object_type"), "label": F.col("title"), "hasContent": F.col("content")}, {}),
        G.facts(fx.learning_objects.withColumn("k", F.explode("keywords")), node("lo", "lo_id"), {"hasKeyword": F.col("k")}, {}),
        G.facts(fx.questions, node("question", "question_id"), {"type": F.lit("Question"), "questionText": F.col("question_text"), "soloLevel": F.col("solo_level"), "correctAnswer": F.col("correct_answer")}, {"assesses": node("lo", "learning_object_id")}),
        fx.edges.select(node("lo", "source_id").alias("s"), F.col("relationship_type").alias("p"), node("lo", "target_id").alias("o"), F.lit(True).alias("node")),  # an edge a pair, so all differ
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    path = io.fresh(fx.spark, "triples")
    io.write_ntriples(every, path)
    return fx.spark.read.text(path).withColumnRenamed("value", "line")


def kb_tables(fx):
    """The tables of a course: an object lies in the first section of the lesson of its number."""
    lessons = fx.lessons.select("lesson_id", "course_id", "title")
    objects = fx.learning_objects.select("lo_id", (F.col("lo_id") * 1000 + 1).alias("section_id"), "title", "object_type", "content", "keywords")
    edges = fx.edges.select("source_id", "target_id", "relationship_type")
    bloom = F.element_at(F.array(*[F.lit(b) for b in BLOOM_LEVELS]), (F.col("question_id") % len(BLOOM_LEVELS) + 1).cast("int"))
    questions = fx.questions.select("question_id", "question_text", F.when(F.size("options") > 1, "MCQ").otherwise("essay").alias("question_type"), "solo_level", bloom.alias("bloom_level"), "learning_object_id")
    quizzes = fx.questions.groupBy("quiz_id").agg(F.min("primary_lesson_id").alias("lesson_id")).join(lessons.select("lesson_id", "course_id"), "lesson_id", "left")
    quizzes = quizzes.select("quiz_id", F.concat(F.lit("Quiz "), F.col("quiz_id").cast("string")).alias("title"), "course_id")
    return lessons.select("course_id", F.col("course_id").alias("name")).distinct(), lessons, fx.sections, objects, edges, questions, quizzes


BLOOM_LEVELS = ["remember", "Understand", "apply", "analyse", "evaluate", "create", "guess"]


def _fact(table: str, kind: str, id_: str, **named: str) -> str:
    return " UNION ALL ".join(f"SELECT '{kind}_' || {id_} AS s, '{p}' AS p, ({o})::VARCHAR AS o, {str(o.startswith('(node)')).lower()} AS node FROM {table}".replace("(node)", "") for p, o in named.items())


QUIZZES = "(SELECT quiz_id, course_id FROM (SELECT quiz_id, min(primary_lesson_id) AS lesson_id FROM questions GROUP BY 1) LEFT JOIN lessons USING (lesson_id))"
KB = f"""(SELECT DISTINCT s, p, o, node FROM (
  {_fact("(SELECT DISTINCT course_id FROM lessons)", "course", "course_id", type="'Course'", label="course_id")}
  UNION ALL {_fact("lessons", "lesson", "lesson_id", type="'Lesson'", label="title")}
  UNION ALL SELECT 'course_' || course_id, 'hasLesson', 'lesson_' || lesson_id, true FROM lessons
  UNION ALL {_fact("sections", "section", "section_id", type="'Section'", label="title", hasContent="substr(content, 1, 500)", startPage="start_page", endPage="end_page", orderIndex="order_index")}
  UNION ALL SELECT 'lesson_' || lesson_id, 'hasSection', 'section_' || section_id, true FROM sections
  UNION ALL {_fact("learning_objects", "lo", "lo_id", type="CASE object_type WHEN 'concept' THEN 'Concept' WHEN 'procedure' THEN 'Procedure' WHEN 'example' THEN 'Example' ELSE 'Principle' END", label="title", hasContent="substr(content, 1, 500)", hasKeyword="unnest(keywords)")}
  UNION ALL SELECT 'section_' || (lo_id * 1000 + 1), 'containsLearningObject', 'lo_' || lo_id, true FROM learning_objects WHERE lo_id * 1000 + 1 IN (SELECT section_id FROM sections)
  UNION ALL SELECT 'lo_' || source_id, unnest([CASE relationship_type WHEN 'part_of' THEN 'isPartOf' WHEN 'prerequisite' THEN 'isPrerequisiteFor' ELSE 'relatedTo' END, 'comment']), unnest(['lo_' || target_id, 'Relationship: ' || relationship_type]), unnest([true, false])
    FROM edges WHERE source_id IN (SELECT lo_id FROM learning_objects) AND target_id IN (SELECT lo_id FROM learning_objects)
  UNION ALL {_fact("questions", "question", "question_id", type="CASE WHEN len(options) > 1 THEN 'MultipleChoiceQuestion' ELSE 'EssayQuestion' END", label="CASE WHEN length(question_text) > 100 THEN substr(question_text, 1, 100) || '...' ELSE question_text END",
      questionText="question_text", hasSOLOLevel="(node)CASE solo_level WHEN 'extended_abstract' THEN 'ExtendedAbstract' ELSE upper(solo_level[1]) || solo_level[2:] END", hasBloomLevel="(node)['Remember', 'Understand', 'Apply', 'Analyze', 'Evaluate', 'Create', NULL][question_id % 7 + 1]")}
  UNION ALL SELECT 'question_' || question_id, 'assessesLearningObject', 'lo_' || learning_object_id, true FROM questions WHERE learning_object_id IN (SELECT lo_id FROM learning_objects)
  UNION ALL {_fact(QUIZZES, "quiz", "quiz_id", type="'Quiz'", label="'Quiz ' || quiz_id")} UNION ALL SELECT 'quiz_' || quiz_id, 'assessesCourse', 'course_' || course_id, true FROM {QUIZZES} WHERE course_id IS NOT NULL) WHERE o <> '')"""


def kb(fx):
    return K.store(K.knowledge_base(*kb_tables(fx)), io.fresh(fx.spark, "kb"))


@query("G6_knowledge_base", f"SELECT p, node, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects, sum(length(o))::BIGINT AS chars FROM {KB} GROUP BY 1, 2")
def knowledge_base(fx):
    return kb(fx).groupBy("p", "node").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"), F.sum(F.length("o")).alias("chars"))


@query("G11_kb_sections", f"WITH kb AS {KB} SELECT cl.o AS course, ll.o AS lesson, count(*) AS sections FROM kb cl JOIN kb h ON h.s = cl.s AND h.p = 'hasLesson' JOIN kb ll ON ll.s = h.o AND ll.p = 'label' JOIN kb x ON x.s = h.o AND x.p = 'hasSection' JOIN kb t ON t.s = x.o AND t.p = 'type' AND t.o = 'Section' WHERE cl.p = 'label' GROUP BY h.s, h.o, cl.o, ll.o")
def kb_sections(fx):
    """Sections of each lesson of each course, over the folders of four predicates."""
    g = G.bgp(kb(fx), [("?c", "label", "?course"), ("?c", "hasLesson", "?l"), ("?l", "label", "?lesson"), ("?l", "hasSection", "?s"), ("?s", "type", "Section")])
    return g.groupBy("c", "l", "course", "lesson").agg(F.count("*").alias("sections")).select("course", "lesson", "sections")


@query("G12_kb_objects", f"WITH kb AS {KB} SELECT sl.o AS section, ol.o AS object, k.o AS keyword FROM kb c JOIN kb sl ON sl.s = c.s AND sl.p = 'label' JOIN kb ol ON ol.s = c.o AND ol.p = 'label' JOIN kb k ON k.s = c.o AND k.p = 'hasKeyword' WHERE c.p = 'containsLearningObject'")
def kb_objects(fx):
    """Objects of sections with their keywords."""
    return G.bgp(kb(fx), [("?s", "containsLearningObject", "?o"), ("?s", "label", "?section"), ("?o", "label", "?object"), ("?o", "hasKeyword", "?keyword")]).select("section", "object", "keyword")


@query("G7_bgp", "SELECT r.s AS region, n.o AS nation, l.o AS name FROM triples r JOIN triples n ON n.s = r.s AND n.p = 'hasNation' JOIN triples l ON l.s = n.o AND l.p = 'label' WHERE r.p = 'label' AND r.o = 'ASIA'")
def bgp(fx):
    return G.bgp(fx.triples, [("?region", "label", "ASIA"), ("?region", "hasNation", "?nation"), ("?nation", "label", "?name")])


@query("G8_count_by_type", "SELECT o AS type, count(*) AS n FROM triples WHERE p = 'type' GROUP BY o")
def count_by_type(fx):
    return G.bgp(fx.triples, [("?s", "type", "?type")]).groupBy("type").agg(F.count("*").alias("n"))


@query("G9_list_lessons", "SELECT a.s AS nation, b.o AS label FROM triples a JOIN triples b ON a.s = b.s AND b.p = 'label' WHERE a.p = 'type' AND a.o = 'Nation'")
def list_lessons(fx):
    return G.bgp(fx.triples, [("?nation", "type", "Nation"), ("?nation", "label", "?label")])


@query("G10_list_questions", "SELECT a.s AS customer, b.o AS label FROM triples a JOIN triples b ON a.s = b.s AND b.p = 'label' WHERE a.p = 'type' AND a.o = 'Customer'")
def list_questions(fx):
    return G.bgp(fx.triples, [("?customer", "type", "Customer"), ("?customer", "label", "?label")])


@query("G11_sections_by_lesson", "SELECT rl.o AS region, nl.o AS nation, count(*) AS customers FROM triples rl JOIN triples rn ON rn.s = rl.s AND rn.p = 'hasNation' JOIN triples nl ON nl.s = rn.o AND nl.p = 'label' JOIN triples nc ON nc.s = rn.o AND nc.p = 'hasCustomer' JOIN triples rt ON rt.s = rl.s AND rt.p = 'type' AND rt.o = 'Region' WHERE rl.p = 'label' GROUP BY 1, 2")
def sections_by_lesson(fx):
    g = G.bgp(fx.triples, [("?r", "type", "Region"), ("?r", "label", "?region"), ("?r", "hasNation", "?n"), ("?n", "label", "?nation"), ("?n", "hasCustomer", "?c")])
    return g.groupBy("region", "nation").agg(F.count("*").alias("customers"))


@query("G12_los_by_section", "SELECT nl.o AS nation, cl.o AS customer, co.o AS \"order\" FROM triples nc JOIN triples nl ON nl.s = nc.s AND nl.p = 'label' JOIN triples cl ON cl.s = nc.o AND cl.p = 'label' JOIN triples co ON co.s = nc.o AND co.p = 'hasOrder' WHERE nc.p = 'hasCustomer'")
def los_by_section(fx):
    return G.bgp(fx.triples, [("?n", "hasCustomer", "?c"), ("?n", "label", "?nation"), ("?c", "label", "?customer"), ("?c", "hasOrder", "?order")]).select("nation", "customer", "order")


@query("G13_infer_edges", """WITH RECURSIVE part(a, b) AS (SELECT source_id, target_id FROM edges WHERE relationship_type = 'part_of' UNION SELECT p.a, e.target_id FROM part p JOIN edges e ON e.source_id = p.b AND e.relationship_type = 'part_of')
  SELECT DISTINCT * FROM (SELECT a AS source_id, b AS target_id, 'part_of' AS relationship_type FROM part UNION ALL SELECT b, a, 'has_part' FROM part UNION ALL SELECT source_id, target_id, relationship_type FROM edges WHERE relationship_type = 'relates_to' UNION ALL SELECT target_id, source_id, relationship_type FROM edges WHERE relationship_type = 'relates_to'
  UNION ALL SELECT source_id, target_id, relationship_type FROM edges WHERE relationship_type = 'prerequisite' UNION ALL SELECT target_id, source_id, 'has_prerequisite' FROM edges WHERE relationship_type = 'prerequisite')""")
def infer_edges(fx):
    return G.infer(fx.edges, ["part_of"], ["relates_to"], {"part_of": "has_part", "prerequisite": "has_prerequisite"})


KINDS = ["part_of", "type_of", "example", "prerequisite_for", "related", "contrasts", "has_example"]
NAMED = ["isPartOf", "isTypeOf", "isExampleOf", "isPrerequisiteFor", "relatedTo", "contrastsWith", "hasExample"]


@query("G13_infer_all", f"""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, {NAMED}[l_linenumber] AS r FROM lineitem WHERE l_partkey <> l_suppkey AND l_linenumber <= {len(NAMED)}),
  base AS (SELECT a, b, r FROM e WHERE r <> 'hasExample' UNION SELECT b, a, 'isExampleOf' FROM e WHERE r = 'hasExample'),
  path(a, b, r) AS (SELECT a, b, r FROM base WHERE r IN ('isPartOf', 'isTypeOf') UNION SELECT p.a, n.b, p.r FROM path p JOIN base n ON n.a = p.b AND n.r = p.r),
  every AS (SELECT a, b, r FROM base WHERE r IN ('isExampleOf', 'isPrerequisiteFor', 'relatedTo', 'contrastsWith') UNION SELECT b, a, r FROM base WHERE r IN ('relatedTo', 'contrastsWith') UNION SELECT a, b, r FROM path)
  SELECT a AS source_id, b AS target_id, r AS relationship_type FROM every UNION ALL SELECT b, a, CASE r WHEN 'isPartOf' THEN 'hasPart' WHEN 'isExampleOf' THEN 'hasExample' ELSE 'hasPrerequisite' END FROM every WHERE r IN ('isPartOf', 'isExampleOf', 'isPrerequisiteFor')""")
def infer_all(fx):
    """Edges of seven kinds by their line numbers, two transitive, two symmetric, three with inverses."""
    line = fx.lineitem.where((F.col("l_partkey") != F.col("l_suppkey")) & (F.col("l_linenumber") <= len(KINDS)))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("l_linenumber"))
    return G.infer(line.select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), V.relation(kind).alias("relationship_type")).distinct())


TERMS = ["inanin", "thonst", "ouwhea", "tion"]
SCORE = " + ".join(f"(CASE WHEN contains(lower({{c}}), '{t}') THEN 1 ELSE 0 END)" for t in TERMS)
TITLE = " OR ".join(f"contains(lower({{t}}), '{t}')" for t in TERMS)


def scored(df, kind, key, title, content, boost):
    hit = lambda c, t: F.contains(F.lower(c), F.lit(t))
    score = sum((hit(content, t).cast("int") for t in TERMS), F.lit(0)) + F.when(sum((hit(title, t).cast("int") for t in TERMS), F.lit(0)) > 0, boost).otherwise(0)
    return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(title).alias("title"), score.alias("score")).where("score > 0")


def scored_sql(table, kind, key, title, content, boost):
    return f"SELECT '{kind}' AS kind, {key} AS id, {title} AS title, {SCORE.format(c=content)} + CASE WHEN {TITLE.format(t=title)} THEN {boost} ELSE 0 END AS score FROM {table}"


ASKS = ["What is the inanin tion", "how does thonst explain la", "tell me about ouwhea an en"]
STOP = ["what", "is", "a", "an", "the", "whats", "what's", "how", "why", "does", "do", "can", "you", "tell", "me", "about", "explain"]  # fixed values
ASK_SQL = "(SELECT i - 1 AS ask, [w for w in string_split(lower(trim(q)), ' ') if length(w) > 2 AND NOT list_contains([" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP) + "], w)] AS terms FROM (SELECT unnest(range(1, 4)) AS i, unnest([" + ", ".join(f"'{q}'" for q in ASKS) + "]) AS q))"


def hits_sql(kind, n, key, title, text, source, boost="0"):
    return f"SELECT ask, {n} AS rank, '{kind}' AS kind, {key} AS id, {title} AS title, len([t for t in terms if contains(lower({text}), t)]) + {boost} AS score FROM {source}, {ASK_SQL}"


FOUND = " UNION ALL ".join([
    hits_sql("learning_object", 0, "lo_id", "title", "title || ' ' || content", "learning_objects", "2 * len([t for t in terms if contains(lower(title), t)])"), hits_sql("section", 1, "section_id", "title", "title || ' ' || content", "sections"),
    hits_sql("lesson", 2, "lesson_id", "title", "title || ' ' || raw_content", "lessons"),
    hits_sql("ontology", 3, "source_id * 1000000 + target_id", "title", "title || ' ' || relationship_type", "(SELECT e.*, s.title || ' → ' || t.title AS title FROM edges e JOIN learning_objects s ON s.lo_id = source_id JOIN learning_objects t ON t.lo_id = target_id)"),
])


@query("T2_search_content", f"""WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, rank, id) AS r FROM ({FOUND}) WHERE score > 0) WHERE r <= 4)
  SELECT ask, kind, id, title, score, array_to_string((SELECT list(o.title ORDER BY o.r) FROM top o WHERE o.ask = top.ask AND o.r > 1 AND o.title <> top.title), ', ') AS related FROM top WHERE r = 1""")
def search_content(fx):
    """The best match of each question, and the titles of up to three more."""
    lo, title = fx.learning_objects, F.concat("st", F.lit(" → "), "tt")
    e = fx.edges.join(lo.select(F.col("lo_id").alias("source_id"), F.col("title").alias("st")), "source_id").join(lo.select(F.col("lo_id").alias("target_id"), F.col("title").alias("tt")), "target_id").withColumn("title", title)
    row = lambda df, kind, n, key, text, boost: df.select(F.lit(n).alias("rank"), F.lit(kind).alias("kind"), key.alias("id"), "title", F.lower(text).alias("low"), F.lit(boost).alias("boost"))
    both = lambda c: F.concat("title", F.lit(" "), c)
    rows = [
        row(lo, "learning_object", 0, F.col("lo_id"), both("content"), 2), row(fx.sections, "section", 1, F.col("section_id"), both("content"), 0), row(fx.lessons, "lesson", 2, F.col("lesson_id"), both("raw_content"), 0),
        row(e, "ontology", 3, F.col("source_id") * 1_000_000 + F.col("target_id"), both("relationship_type"), 0),
    ]
    return C.search(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]), ASKS, STOP)


def rag_sql(kind: str, table: str, key: str, text: str, boost: int, most: int, chars: int, head: str) -> str:
    return f"""SELECT '{kind}' AS kind, r AS rank, id, score, '**{head}' || title || '**: ' || substr(t, 1, {chars}) AS part FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT {key} AS id, title, {text} AS t,
      len([x for x in terms if contains(lower(coalesce(title, '')) || ' ' || lower(coalesce({text}, '')), x)]) + {boost} * len([x for x in terms if contains(lower(coalesce(title, '')), x)]) AS score FROM {table}, (SELECT ['inanin', 'tion', 'ouwhea'] AS terms)) WHERE score > 0) WHERE r <= {most} AND t <> ''"""


@query("T3_rag_context", f"SELECT kind, rank, id, score, md5(part) AS part FROM ({rag_sql('object', 'learning_objects', 'lo_id', 'nullif(content, title)', 3, 5, 500, '')} UNION ALL {rag_sql('section', 'sections', 'section_id', 'content', 0, 3, 400, 'Section - ')})")
def rag_context(fx):
    objects = fx.learning_objects.select(F.col("lo_id").alias("id"), "title", F.nullif("content", "title").alias("description"))
    sections = fx.sections.select(F.col("section_id").alias("id"), "title", "content")
    return X.rag_context(objects, sections, "What is the inanin tion? tell me about ouwhea".replace("?", ""), [*STOP, "the"]).withColumn("part", F.md5("part"))


MSG = "'tell me about ouwhea the of and Zu und lessons'"


@query("T4_best_name_match", f"""SELECT course_id, lesson_id, score FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY score DESC, lesson_id) AS r FROM (SELECT course_id, lesson_id, len([w for w in regexp_extract_all(lower(title), '{TOK}') if length(w) >= 3 AND list_contains(regexp_extract_all(lower({MSG}), '{TOK}'), w)]) + CASE WHEN contains(lower({MSG}), lower(title)) THEN 10 ELSE 0 END AS score FROM lessons)) WHERE r = 1""")
def best_name_match(fx):
    message = F.lower(F.expr(MSG))
    words = tokens(message)
    score = F.size(F.filter(tokens(F.col("title")), lambda w: (F.length(w) >= 3) & F.array_contains(words, w))) + F.when(F.contains(message, F.lower("title")), 10).otherwise(0)
    r = F.row_number().over(Window.partitionBy("course_id").orderBy(F.desc("score"), "lesson_id"))
    return fx.lessons.withColumn("score", score).withColumn("r", r).where("r = 1").select("course_id", "lesson_id", "score")


@query("T5_practice_set", "SELECT primary_lesson_id AS lesson_id, question_id, n FROM (SELECT *, row_number() OVER (PARTITION BY primary_lesson_id ORDER BY question_id) AS r, count(*) OVER (PARTITION BY primary_lesson_id) AS n FROM questions) WHERE r <= 5")
def practice_set(fx):
    w = Window.partitionBy("primary_lesson_id")
    q = fx.questions.select(F.col("primary_lesson_id").alias("lesson_id"), "question_id", F.row_number().over(w.orderBy("question_id")).alias("r"), F.count("*").over(w).alias("n"))
    return q.where("r <= 5").drop("r")


@query("T6_key_concepts", "SELECT lo_lesson, lo_id, title FROM (SELECT *, row_number() OVER (PARTITION BY lo_lesson ORDER BY lo_section, lo_id) AS r FROM learning_objects) WHERE r <= 25")
def key_concepts(fx):
    r = F.row_number().over(Window.partitionBy("lo_lesson").orderBy("lo_section", "lo_id"))
    return fx.learning_objects.withColumn("r", r).where("r <= 25").select("lo_lesson", "lo_id", "title")


@query("T7_lesson_outline", "SELECT lesson_id, row_number() OVER (PARTITION BY lesson_id ORDER BY order_index) || '. ' || title || ' (' || coalesce(n, 0) || ')' AS line FROM sections s LEFT JOIN (SELECT lo_section, count(*) AS n FROM learning_objects GROUP BY 1) l ON l.lo_section = s.lesson_id")
def lesson_outline(fx):
    n = fx.learning_objects.groupBy("lo_section").agg(F.count("*").alias("n"))
    s = fx.sections.withColumn("lo_section", F.col("lesson_id")).join(n, "lo_section", "left")
    i = F.row_number().over(Window.partitionBy("lesson_id").orderBy("order_index"))
    return s.select("lesson_id", F.concat(i.cast("string"), F.lit(". "), "title", F.lit(" ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")")).alias("line"))


@query("T8_grouped_lists", "SELECT course_id, array_to_string(list(title ORDER BY title, lesson_id)[1:5], '|') || CASE WHEN count(*) > 5 THEN ' +' || (count(*) - 5) || ' more' ELSE '' END AS titles FROM lessons GROUP BY 1")
def grouped_lists(fx):
    # the five first titles come from a rank, so no group is gathered
    w = Window.partitionBy("course_id")
    r = fx.lessons.select("course_id", "title", F.row_number().over(w.orderBy("title", "lesson_id")).alias("r"))
    g = r.groupBy("course_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "title")))).alias("t"))
    more = F.when(F.col("n") > 5, F.concat(F.lit(" +"), (F.col("n") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return g.select("course_id", F.concat(F.array_join(F.transform("t", lambda x: x["title"]), "|"), more).alias("titles"))


@query("T9_stratified_sample", """SELECT book, item_id FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY md5(item_id || '-7'), item_id) AS r, count(*) OVER (PARTITION BY book) AS g, count(*) OVER () AS n FROM bank)
  WHERE r <= greatest(1, round(200 * g / n)) ORDER BY md5(item_id || '-7-trim'), item_id LIMIT 200""")
def stratified_sample(fx):
    return P.proportional(fx.bank, "book", 200, "item_id", "7").select("book", "item_id")


@query("T10_quiz_autoselect", "SELECT solo_level, question_id FROM (SELECT *, row_number() OVER (PARTITION BY solo_level ORDER BY md5(question_id || '-3'), question_id) AS r FROM questions) WHERE r <= CASE solo_level WHEN 'unistructural' THEN 5 WHEN 'multistructural' THEN 4 WHEN 'relational' THEN 3 ELSE 2 END")
def quiz_autoselect(fx):
    quotas = [("unistructural", 5), ("multistructural", 4), ("relational", 3), ("extended_abstract", 2)]
    take = fx.spark.createDataFrame(quotas, "solo_level string, take long")
    return P.lowest(fx.questions, "solo_level", take, "question_id", "3").select("solo_level", "question_id")


BARE = r"trim(regexp_replace({}, '^[A-Da-d]\)\s*', ''))"


@query("T11_shuffle_options", f"""SELECT question_id, array_to_string([chr(64 + i::INT) || ') ' || t[i] for i in range(1, len(t) + 1)], '|') AS shuffled, chr(64 + k::INT) || ') ' || t[k] AS new_answer, k - 1 AS new_key, array_to_string(inverse, ',') AS inverse
  FROM (SELECT *, greatest(1, coalesce(list_position(t, {BARE.format("coalesce(a, '')")}), 1)) AS k FROM (SELECT question_id, any_value(correct_answer) AS a, list({BARE.format('o')} ORDER BY md5(question_id || '-' || pos), pos) AS t, list(pos ORDER BY md5(question_id || '-' || pos), pos) AS inverse
  FROM (SELECT question_id, correct_answer, unnest(range(len(options))) AS pos, unnest(options) AS o FROM questions WHERE len(options) >= 2) GROUP BY question_id))""")
def shuffle_options(fx):
    """Options without their letters, permuted and lettered anew; `inverse` leads from the new places back to the old ones."""
    bare = lambda c: F.trim(F.regexp_replace(c, r"^[A-Da-d]\)\s*", ""))
    order = F.sort_array(F.transform("options", lambda o, i: F.struct(F.md5(F.concat_ws("-", F.col("question_id").cast("string"), i.cast("string"))).alias("h"), i.alias("i"), bare(o).alias("o"))))
    q = fx.questions.where("size(options) > 1").withColumn("s", order).withColumn("t", F.transform("s", lambda x: x["o"]))
    q = q.withColumn("k", F.greatest(F.lit(1), F.array_position("t", bare(F.coalesce("correct_answer", F.lit(""))))))
    q = q.withColumn("new", F.transform("t", lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(") "), o)))
    return q.select("question_id", F.array_join("new", "|").alias("shuffled"), F.element_at("new", F.col("k").cast("int")).alias("new_answer"), (F.col("k") - 1).alias("new_key"), F.array_join(F.transform("s", lambda x: x["i"].cast("string")), ",").alias("inverse"))


@query("T12_find_correct_index", "SELECT question_id, coalesce(nullif(list_position(options, correct_answer), 0) - 1, 0) AS i FROM questions")
def find_correct_index(fx):
    exact = F.nullif(F.array_position("options", F.col("correct_answer")), F.lit(0)) - 1
    letter = F.ascii(F.upper(F.regexp_extract("correct_answer", r"^([A-Za-z])\)", 1))) - 65
    return fx.questions.select("question_id", F.coalesce(exact, F.when(letter.between(0, F.size("options") - 1), letter), F.lit(0)).alias("i"))


@query("T13_lesson_context", "SELECT lesson_id, any_value(title) AS title, md5(any_value(title) || chr(10) || string_agg(substr(content, 1, 500), chr(10) ORDER BY order_index)) AS context FROM (SELECT s.lesson_id, l.title, content, order_index, row_number() OVER (PARTITION BY s.lesson_id ORDER BY order_index) AS r FROM sections s JOIN lessons l ON l.lesson_id = s.lesson_id) WHERE r <= 3 GROUP BY 1")
def lesson_context(fx):
    """A lesson's title and the beginnings of its first three sections."""
    first = F.slice(F.sort_array(F.collect_list(F.struct("order_index", F.substring("content", 1, 500).alias("c")))), 1, 3)
    s = fx.sections.groupBy("lesson_id").agg(first.alias("s")).join(fx.lessons.select("lesson_id", "title"), "lesson_id")
    return s.select("lesson_id", "title", F.md5(F.concat_ws("\n", F.col("title"), F.array_join(F.transform("s", lambda x: x["c"]), "\n"))).alias("context"))


@query("T14_section_structure", "SELECT lo_section, array_to_string(list(title ORDER BY lo_id)[1:10], ', ') || CASE WHEN count(*) > 10 THEN ' (+' || (count(*) - 10) || ' more)' ELSE '' END AS line FROM learning_objects GROUP BY 1")
def section_structure(fx):
    g = fx.learning_objects.groupBy("lo_section").agg(F.sort_array(F.collect_list(F.struct("lo_id", "title"))).alias("t"))
    more = F.when(F.size("t") > 10, F.concat(F.lit(" (+"), (F.size("t") - 10).cast("string"), F.lit(" more)"))).otherwise("")
    return g.select("lo_section", F.concat(F.array_join(F.transform(F.slice("t", 1, 10), lambda x: x["title"]), ", "), more).alias("line"))


@query("T15_focus_context", f"""WITH anchor AS (SELECT lesson, "offset" AS o, source_id, target_id FROM ({ANCHORS}) WHERE second_lesson IS NULL),
  sec AS (SELECT lo_lesson AS lesson, lo_section AS section, arg_min(content, lo_id) AS content, row_number() OVER (PARTITION BY lo_lesson ORDER BY lo_section) - 1 AS i, count(*) OVER (PARTITION BY lo_lesson) AS n FROM learning_objects GROUP BY 1, 2),
  pick AS (SELECT a.lesson, a.o, s.section, CASE WHEN s.i = a.o % s.n THEN 0 ELSE 10 + s.i END AS p FROM anchor a JOIN sec s USING (lesson)
    UNION ALL SELECT a.lesson, a.o, l.lo_section, 1 FROM anchor a JOIN learning_objects l ON l.lo_id = a.source_id UNION ALL SELECT a.lesson, a.o, l.lo_section, 2 FROM anchor a JOIN learning_objects l ON l.lo_id = a.target_id),
  chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lesson, o ORDER BY p, section) AS r FROM (SELECT lesson, o, section, min(p) AS p FROM pick GROUP BY 1, 2, 3)) WHERE p < 10 OR r <= 2),
  few AS (SELECT lo_section AS section, '- ' || title || ': ' || substr(content, 1, 150) AS line, row_number() OVER (PARTITION BY lo_section ORDER BY lo_id) AS k FROM learning_objects)
  SELECT a.lesson, a.o AS "offset", md5(c.concepts) AS concepts, md5(x.excerpts) AS excerpts FROM anchor a
  JOIN (SELECT lesson, o, array_to_string(list(line ORDER BY r, k)[1:15], chr(10)) AS concepts FROM chosen JOIN few USING (section) WHERE k <= 5 GROUP BY 1, 2) c ON c.lesson = a.lesson AND c.o = a.o
  JOIN (SELECT lesson, o, substr(string_agg(substr(content, 1, 600), chr(10) || chr(10) ORDER BY r), 1, 2000) AS excerpts FROM (SELECT c.lesson, c.o, c.r, s.content FROM chosen c JOIN sec s ON s.section = c.section) GROUP BY 1, 2) x ON x.lesson = a.lesson AND x.o = a.o""")
def focus_context(fx):
    """What each lesson's anchored requests build on, a section's text being its first object's."""
    lo = fx.learning_objects.select("lo_id", F.col("lo_lesson").alias("lesson"), F.col("lo_section").alias("section"), "title", F.col("content").alias("description"))
    sections = lo.groupBy("lesson", "section").agg(F.min_by("description", "lo_id").alias("content"))
    out = X.focus_context(cross_lesson_edges(fx).where("second_lesson IS NULL"), lo, sections)
    return out.select("lesson", "offset", F.md5("concepts").alias("concepts"), F.md5("excerpts").alias("excerpts"))

