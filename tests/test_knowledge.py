"""Inference, knowledge bases and snapshots against plain versions."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from gradus.operators import graph as G
from gradus.operators import ontology as K
from gradus.sources import snapshots
from gradus.streaming.keyed import MetricStore

EDGE = "source_id long, target_id long, relationship_type string"


def plain_closure(pairs):
    pairs = set(pairs)
    while more := {(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs:
        pairs |= more
    return pairs


def test_all_axioms_with_cycles(spark):
    rng = random.Random(2)
    kinds = ["isPartOf", "isTypeOf", "isExampleOf", "isPrerequisiteFor", "relatedTo", "contrastsWith", "hasPart", "hasExample", "hasPrerequisite", "enables"]
    edges = {(rng.randrange(14), rng.randrange(14), rng.choice(kinds)) for _ in range(60)} | {(1, 2, "isPartOf"), (2, 3, "isPartOf"), (3, 1, "isPartOf")}
    base = {(b, a, {v: k for k, v in G.INVERSE.items()}[r]) if r.startswith("has") else (a, b, r) for a, b, r in edges}
    want = {e for e in base if e[2] not in G.TRANSITIVE} | {(b, a, r) for a, b, r in base if r in G.SYMMETRIC}
    for r in G.TRANSITIVE:
        want |= {(a, b, r) for a, b in plain_closure((a, b) for a, b, k in base if k == r)}
    want |= {(b, a, G.INVERSE[r]) for a, b, r in want if r in G.INVERSE}
    got = [tuple(r) for r in G.infer(spark.createDataFrame(sorted(edges), EDGE)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (1, 1, "isPartOf") in want
    assert G.infer(spark.createDataFrame([], EDGE)).count() == 0


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = G.saved
    monkeypatch.setattr(G, "saved", lambda df, name: rounds.append(name) or real(df, name))
    n = 1500
    pairs = G.closure(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert pairs.count() == n * (n + 1) // 2 and len(rounds) <= 13
    assert pairs.where("a >= b").count() == 0


def test_cycles_are_one_node_in_the_closure(spark, monkeypatch):
    """Groups on cycles of branching edges, each pair still once; groups that are found in parts, or in no bounded search, change nothing."""
    rng = random.Random(8)
    edges = {(rng.randrange(40) + 100 * g, rng.randrange(15) + 100 * g) for g in range(3) for _ in range(160)} | {(105, 5), (5, 203), (14, 1000), (1000, 1001)}
    df = spark.createDataFrame([(k, *e) for e in sorted(edges) for k in (1, 2) if k == 1 or e[0] < 100], "k int, a long, b long")
    want = [(k, *p) for k in (1, 2) for p in plain_closure(e for e in edges if k == 1 or e[0] < 100)]
    monkeypatch.setattr(G, "FAN", 1)
    assert G._groups(df, ["k"]) is not None
    assert sorted(map(tuple, G.closure(df, ["k"]).select("k", "a", "b").collect())) == sorted(want)
    monkeypatch.setattr(G, "STEPS", 1)
    monkeypatch.setattr(G, "BROADCAST", 0)
    assert sorted(map(tuple, G.closure(df, ["k"]).select("k", "a", "b").collect())) == sorted(want)


def test_cycles_behind_other_nodes_are_found(spark, monkeypatch):
    """Nodes with more edges lead to a cycle, and a cycle to the next one: labels from before must not hide it, or each of its pairs is found once for each of its nodes."""
    cycle = lambda at: {(at + i, at + (i + k) % 12) for i in range(12) for k in (1, 2, 5)}
    edges = cycle(0) | cycle(100) | {(1000 + i, i) for i in range(12)} | {(2000 + i, 1000 + i % 12) for i in range(90)} | {(1000 + i, 50 + i) for i in range(40)} | {(3, 105), (110, 300)}
    monkeypatch.setattr(G, "FAN", 1)
    assert (found := G._groups(spark.createDataFrame(sorted(edges), "a long, b long"), [])) is not None and found.groupBy("c").count().where("count = 12").count() >= 1
    joined, real = [], G.saved
    monkeypatch.setattr(G, "saved", lambda df, name: joined.append((name, real(df, name))) or joined[-1][1])
    got = [tuple(r) for r in G.closure(spark.createDataFrame(sorted(edges), "a long, b long")).select("a", "b").collect()]
    assert sorted(got) == sorted(plain_closure(edges)) and len(got) == len(set(got))
    assert [df.count() for name, df in joined if name == "groups"][-1] == 24


def kb(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    return K.knowledge_base(
        df([("c1", "Physics", "PH", "")], "course_id string, name string, code string, description string"),
        df([(1, "c1", "Mass", "all of it", 0), (2, "zz", "Lost", None, None)], "lesson_id long, course_id string, title string, summary string, order_index int"),
        df([(5, 1, "Weight", "x" * 700, 1, 2), (6, 9, "Weight", None, None, None)], "section_id long, lesson_id long, title string, content string, start_page int, end_page int"),
        df([(7, 5, "Newton", "law", ["force", ""], ["F = ma"]), (8, None, "Kilogram", None, None, None)], "lo_id long, section_id long, title string, object_type string, keywords array<string>, key_points array<string>"),
        df([(7, 8, "part_of", None), (8, 7, "uses", "for scales"), (7, 99, "uses", None)], EDGE + ", description string"),
        df([(3, "q" * 101, "tf", "Extended Abstract", "analyse", 7), (4, "why?", None, None, "guess", 99)], "question_id long, question_text string, question_type string, solo_level string, bloom_level string, learning_object_id long"),
        df([(2, "Quiz", "c1"), (3, "Other", "zz")], "quiz_id long, title string, course_id string"),
        date="2026-01-01",
    )


def test_knowledge_base(spark, tmp_path):
    rows = [tuple(r) for r in kb(spark).collect()]
    assert len(rows) == len(set(rows))
    got = {(s, p, o) for s, p, o, _ in rows if p != "date"}
    assert got == {
        ("course_c1", "type", "Course"), ("course_c1", "label", "Physics"), ("course_c1", "courseCode", "PH"), ("course_c1", "hasLesson", "lesson_1"),
        ("lesson_1", "type", "Lesson"), ("lesson_1", "label", "Mass"), ("lesson_1", "comment", "all of it"), ("lesson_1", "orderIndex", "0"), ("lesson_1", "hasSection", "section_5"), ("lesson_2", "type", "Lesson"), ("lesson_2", "label", "Lost"),
        ("section_5", "type", "Section"), ("section_5", "label", "Weight"), ("section_5", "hasContent", "x" * 500), ("section_5", "startPage", "1"), ("section_5", "endPage", "2"), ("section_5", "containsLearningObject", "lo_7"), ("section_6", "type", "Section"), ("section_6", "label", "Weight"),
        ("lo_7", "type", "Principle"), ("lo_7", "label", "Newton"), ("lo_7", "hasKeyword", "force"), ("lo_7", "hasKeyPoint", "F = ma"), ("lo_7", "isPartOf", "lo_8"), ("lo_7", "comment", "Relationship: part_of"),
        ("lo_8", "type", "Definition"), ("lo_8", "label", "Kilogram"), ("lo_8", "uses", "lo_7"), ("lo_8", "comment", "for scales"),
        ("question_3", "type", "TrueFalseQuestion"), ("question_3", "label", "q" * 100 + "..."), ("question_3", "questionText", "q" * 101), ("question_3", "hasSOLOLevel", "ExtendedAbstract"), ("question_3", "hasBloomLevel", "Analyze"), ("question_3", "assessesLearningObject", "lo_7"),
        ("question_4", "type", "ShortAnswerQuestion"), ("question_4", "label", "why?"), ("question_4", "questionText", "why?"),
        ("quiz_2", "type", "Quiz"), ("quiz_2", "label", "Quiz"), ("quiz_2", "assessesCourse", "course_c1"), ("quiz_3", "type", "Quiz"), ("quiz_3", "label", "Other"),
    }
    assert {p for _, p, _, n in rows if n} == {"hasLesson", "hasSection", "containsLearningObject", "isPartOf", "uses", "hasSOLOLevel", "hasBloomLevel", "assessesLearningObject", "assessesCourse"}
    assert sum(p == "date" for _, p, _, _ in rows) == 11


def test_patterns_read_their_predicates_alone(spark, tmp_path, capsys):
    triples = K.store(kb(spark), str(tmp_path / "kb"))
    found = G.bgp(triples, [("?c", "label", "Physics"), ("?c", "hasLesson", "?l"), ("?l", "hasSection", "?s")])
    assert [tuple(r) for r in found.select("l", "s").collect()] == [("lesson_1", "section_5")]
    found.explain("formatted")
    plan = capsys.readouterr().out
    wanted = re.findall(r"PartitionFilters: \[[^\]]*\(p#\d+ = (\w+)\)[^\]]*\]", plan)
    assert sorted(set(wanted)) == ["hasLesson", "hasSection", "label"]
    one = G.bgp(triples, [("?l", "hasSection", "?s")])
    assert {f.split("/p=")[1].split("/")[0] for f in one.inputFiles()} >= {"hasSection"}
    read = one.select("*").where("true")
    assert {r[0].split("/p=")[1].split("/")[0] for r in triples.where("p = 'hasSection'").select("_metadata.file_path").collect()} == {"hasSection"} and read.count() == 1


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError, match="no snapshot one"):
        snapshots.read(spark, root, "one")
    df = spark.range(7).withColumnRenamed("id", "k")
    metrics = spark.createDataFrame([("lint", '{"average_score": 9}'), ("a metric/2", '{\n "x": [1,\n 2]}')], "metric_key string, payload string")
    snap = snapshots.write(spark, root, "one", {"t": df, "none": df.limit(0)}, metrics, model="m", notes="n", env={"A": "b"})
    assert snap.manifest["table_counts"] == {"t": 7, "none": 0} and snap.manifest["validation_keys"] == ["a metric/2", "lint"] and snap.manifest["env"] == {"A": "b"}
    assert sorted(r["k"] for r in snap.table("t").collect()) == list(range(7)) and snap.table("none").count() == 0
    assert {tuple(r) for r in snap.metrics().collect()} == {("lint", '{"average_score": 9}'), ("a metric/2", '{\n "x": [1,\n 2]}')}
    with pytest.raises(KeyError, match="no table other"):
        snap.table("other")
    # one that breaks off after its tables is not seen
    broken = df.select(F.raise_error(F.lit("broken off")).cast("string").alias("metric_key"), F.lit("x").alias("payload"))
    with pytest.raises(Exception, match="broken off"):
        snapshots.write(spark, root, "one", {"t": df.limit(3)}, broken)
    assert snapshots.read(spark, root, "one").manifest["version"] == snap.manifest["version"] and snapshots.read(spark, root, "one").table("t").count() == 7
    again = snapshots.write(spark, root, "one", {"t": df.limit(2)})
    assert snapshots.read(spark, root, "one").table("t").count() == 2 and again.metrics().count() == 0
    with pytest.raises(Exception, match="broken off"):
        snapshots.write(spark, root, "two", {"t": df}, broken)
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root, "two")


def test_foreign_reports_are_hydrated(spark, tmp_path):
    folder = tmp_path / "validation"
    folder.mkdir()
    (folder / "lint.json").write_text('{"average_score": 95}')
    (folder / "coverage.json").write_text('{"1": {"pct": 5,\n "z": [1]}, "2": {}, "x": {"pct": 6}}')
    (folder / "unheard_of.json").write_text("{}")
    (folder / "notes.txt").write_text("no report")
    files = snapshots.report_files(spark, str(folder))
    assert {r["metric_key"] for r in files.collect()} == {"lint", "coverage", "unheard_of"}
    reports = snapshots.lesson_reports(files, spark.createDataFrame([(1,), (2,), (3,)], "lesson_id long"))
    squeezed = lambda rows: {(r["metric_key"], r["scope_id"], re.sub(r"\s", "", r["payload"])) for r in rows}
    want = {("coverage", 1, '{"pct":5,"z":[1]}'), ("coverage", 2, "{}"), *product(["lint"], [1, 2, 3], ['{"average_score":95}'])}
    assert squeezed(reports.collect()) == want
    store = MetricStore(spark, str(tmp_path / "store"))
    at = lambda day: F.to_timestamp(F.lit(f"2026-01-0{day}"))
    own = spark.createDataFrame([("lint", 1, '{"mine": 1}'), ("lint", 2, "{}"), ("lint", 3, "no json")], "metric_key string, scope_id long, payload string")
    store.put(own.withColumn("created_at", at(1)))
    assert snapshots.hydrate(store, reports, at(2)) == (4, 1)
    kept = {("lint", 1, '{"mine":1}')} | {w for w in want if w[:2] != ("lint", 1)}
    assert squeezed(store.current().collect()) == kept
    assert snapshots.hydrate(store, reports, at(3)) == (1, 4)  # an empty report counts as none
    assert snapshots.hydrate(store, reports, at(4), overwrite=True) == (5, 0)
    assert squeezed(store.current().collect()) == want


def test_edges_are_cleaned_in_order(spark):
    objects = [
        (1, 1, 1, "Gravitational pull", "..."), (2, 1, 1, "gravitational pull ", "a copy of the first"), (3, 1, 2, "Orbit", "the Gravitational Pull keeps it"), (4, 1, 9, "Far away", "nothing"), (5, 2, 1, "Cell wall of a plant", "x"), (6, 2, 1, "Cell", "the cell wall of a plant, told"),
        (7, 2, 1, "Wall of a plant", "x"), (8, 2, 5, "The wall of a plant cell", "the wall of a plant is here"),
    ]
    edges = [
        (2, 3, "uses"), (1, 3, "uses"),  # one edge, after its end is bound to the first of its title
        (1, 2, "relates_to"),  # both ends are one object
        (4, 3, "relates_to"), (3, 1, "relates_to"),  # soft: far sections, neighbouring sections
        (3, 4, "uses"),  # no evidence
        (7, 8, "part_of"),  # a title within the other: turned round
        (5, 6, "part_of"),
    ]
    lo = spark.createDataFrame(objects, "lo_id long, lesson long, section long, title string, content string")
    got = {tuple(r) for r in G.clean(spark.createDataFrame(edges, EDGE), lo).collect()}
    assert got == {(1, 1, 3, "uses"), (1, 3, 1, "relates_to"), (2, 8, 7, "part_of"), (2, 5, 6, "part_of")}
