"""Contexts, colours and scores on small tables."""

import pytest
from pyspark.sql import functions as F

from gradus.functions import responses as R
from gradus.operators import context as X
from gradus.operators import metrics as M


def test_rag_context(spark):
    objects = [(i, f"Mass {i}" if i < 3 else f"Thing {i}", "about mass and force" if i != 2 else None) for i in range(9)] + [(20, None, "mass"), (21, "Other", "nothing")]
    sections = [(1, "Mass", "x" * 900), (2, "Force", ""), (3, "y", "mass force"), (4, "y", "mass")]
    o = spark.createDataFrame(objects, "id long, title string, description string")
    s = spark.createDataFrame(sections, "id long, title string, content string")
    got = [tuple(r) for r in X.rag_context(o, s, "tell me about MASS force", ["tell", "about"]).orderBy("kind", "rank").collect()]
    # the third object holds its place among the five, but has no text of its own; so does the second section
    assert [(k, r, i, n) for k, r, i, n, _ in got] == [("object", 1, 0, 5), ("object", 2, 1, 5), ("object", 4, 3, 2), ("object", 5, 4, 2), ("section", 1, 3, 2), ("section", 2, 1, 1)]
    assert got[0][4] == "**Mass 0**: about mass and force" and any(x[4] == "**Section - Mass**: " + "x" * 400 for x in got)
    assert X.rag_context(o, s, "is it", []).count() == 0


def test_focus_context(spark):
    objects = [(n, 1, n // 7, f"T{n}", f"d{n}" * 100) for n in range(21)] + [(30, 2, 9, "other", None)]
    o = spark.createDataFrame(objects, "lo_id long, lesson long, section long, title string, description string")
    s = spark.createDataFrame([(1, k, f"section {k} " + "z" * 700) for k in range(4)] + [(2, 9, "")], "lesson long, section long, content string")
    asked = spark.createDataFrame([(1, 0, None, None), (1, 4, 0, 8), (1, 2, 20, 1), (2, 5, None, None), (3, 0, None, None)], "lesson long, offset long, source_id long, target_id long")
    got = {(r["lesson"], r["offset"]): (r["concepts"], r["excerpts"]) for r in X.focus_context(asked, o, s).collect()}
    line = lambda n: f"- T{n}: " + (f"d{n}" * 100)[:150]
    want = {(1, 0): [0, 1], (1, 4): [1, 0], (1, 2): [2, 0]}  # focus, then the anchor's ends, then what makes two
    for key, sections in want.items():
        assert got[key][0] == "\n".join(line(k * 7 + n) for k in sections for n in range(5))
        assert got[key][1] == "\n\n".join((f"section {k} " + "z" * 700)[:600] for k in sections)
    assert got[2, 5] == ("- other: ", "") and got[3, 0] == ("", "")


def test_colours(spark):
    rows = [("lint", 85.0), ("lint", 84.9), ("lint", 64.0), ("ambiguity", 10.0), ("ambiguity", 11.0), ("ambiguity", 26.0), ("solvability", 0.9), ("solvability", 0.95), ("readability", 3.0), ("ioc", -0.1), ("face", None)]
    got = [r["tone"] for r in M.lights(spark.createDataFrame([(i, m, v) for i, (m, v) in enumerate(rows)], "i int, metric string, value double")).orderBy("i").collect()]
    assert got == ["good", "warn", "bad", "good", "warn", "bad", "good", "warn", "info", "bad", None]
    judged = spark.createDataFrame([(1, "a", "b", "SUPPORTED", 0, False, "single_outlier", True, 3.5, "hard", 0.4), (2, None, None, None, None, None, None, None, None, None, None)], "question_id long, intended_level string, classified_level string, cove_verdict string, ioc_rating int, ambiguous boolean, grammar string, key_outlier boolean, face_score double, label string, p_value double")
    got = {(r["question_id"], r["metric"]): r["tone"] for r in M.badges(judged).collect()}
    assert got == {(1, m): t for m, t in {"solo_judge": "bad", "cove": "good", "ioc": "warn", "ambiguity": "good", "grammar_homogeneity": "bad", "solvability": "info", "face_validity": "info"}.items()}


def test_quiz_scores(spark):
    q = spark.createDataFrame([(1, 1, 2, "x"), (1, 2, None, "Yes"), (1, 3, None, None), (2, 4, 0, None)], "quiz_id long, question_id long, correct_option_index int, correct_answer string")
    a = spark.createDataFrame([(1, 0, 1, "2"), (1, 0, 2, "yEs"), (1, 0, 3, "z"), (1, 1, 1, " 2b"), (1, 1, 2, None), (1, 2, 1, "two"), (2, 0, 4, "0")], "quiz_id long, attempt int, question_id long, answer string")
    z = spark.createDataFrame([(1, 60), (2, None)], "quiz_id long, passing_score int")
    got = {(r["quiz_id"], r["attempt"]): (r["total"], r["correct"], r["percent"], r["passed"]) for r in M.quiz_scores(a, q, z).collect()}
    assert got == {(1, 0): (3, 2, pytest.approx(66.67), True), (1, 1): (3, 1, pytest.approx(33.33), False), (1, 2): (3, 0, 0.0, False), (2, 0): (1, 1, 100.0, True)}


def test_equivalence(spark):
    from pyspark.sql import functions as F

    said = ['{"equivalent": true}', 'so {"equivalent": "no", "a": {"b": 1}} end', '{"equivalent": false}', '{"equivalent": 0}', '{"equivalent": ""}', '{"equivalent": null}', '{"other": 1}', "{broken", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, r string").orderBy("i")
    assert [r[0] for r in rows.select(R.equivalent(F.col("r"))).collect()] == [True, True, False, False, False, False, None, None, None]
    verdicts = rows.select(R.stem_verdict(F.lit(None).cast("double"), F.lit(True), F.col("r"))).collect()
    assert [r[0] for r in verdicts] == ["pass", "pass", "fail", "fail", "fail", "fail", None, None, None]


def test_prompts_come_in_bounded_numbers(spark):
    from gradus.operators import injected as U

    df = spark.range(2 * U.PROMPTS + 7).coalesce(1).select("id", F.col("id").cast("string").alias("p"), F.array("id").alias("kept"))
    got = U.with_responses(df, "id", "p", fn=lambda prompts: [f"{len(prompts)}:{p}" for p in prompts]).collect()
    assert {int(r["response"].split(":")[0]) for r in got} <= set(range(1, U.PROMPTS + 1)) and len(got) == 2 * U.PROMPTS + 7
    assert all(r["response"].split(":")[1] == r["p"] and r["kept"] == [r["id"]] for r in got)
