"""Boundaries of the rules and of the order-dependent operators, on tiny rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gradus.functions import text as T
from gradus.operators import dedup as D
from gradus.operators import lint as L
from gradus.operators import metrics as M
from gradus.operators import sampling as P
from gradus.operators import sequences as Q
from gradus.operators import structure as S
from gradus.sources import io

SHAPE = "question_id long, question_text string, options array<string>, correct_option_index int, correct_answer string"


def flags(spark, text="What is it?", options=("aaaa", "bbbb", "cccc"), key=0, answer="aaaa"):
    df = spark.createDataFrame([(1, text, list(options) if options is not None else None, key, answer)], SHAPE)
    return L.lint(df).first()["flags"]


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"text": "  "}, "H14_NO_STEM"),
        ({"text": "The thing"}, "H14_UNCLEAR_DIRECTIVE"),
        ({"text": "x" * 250 + "?"}, "H16_LONG_STEM"),
        ({"text": "Which is not it?"}, "H17_NEGATIVE_STEM"),
        ({"options": ("aaaa", "bbbb")}, "H_OPTION_COUNT"),
        ({"options": ("aaaa", " ", "cccc")}, "H_BLANK"),
        ({"key": None}, "H19_NO_KEY"),
        ({"key": 3}, "H19_KEY_OUT_OF_RANGE"),
        ({"answer": "other"}, "H19_KEY_MISMATCH"),
        ({"options": ("1", "3", "2"), "answer": "1"}, "H21_NUMERIC_DISORDER"),
        ({"options": ("a b c d", "a b c d e", "zz y x w"), "answer": None}, "H22_OPTION_OVERLAP"),
        ({"options": ("b a", "a b", "cccc"), "answer": "b a"}, "H_DISTRACTOR_EQUALS_KEY"),
        ({"options": ("aaaa", "b" * 9, "cccc")}, "H24_LENGTH_DISPARITY"),
        ({"options": ("aaaaa", "bbbb", "cccc"), "answer": "aaaaa"}, "H27_CORRECT_LONGEST"),
        ({"options": ("aaaa", "bbbb", "All of the above")}, "H25_AOTA_NOTA"),
    ],
)
def test_rule(spark, change, code):
    assert code in flags(spark, **change)


def test_clean_question_and_nulls(spark):
    assert flags(spark) == []
    assert flags(spark, text=None, options=None, key=None, answer=None) == ["H14_NO_STEM", "H19_NO_KEY", "H_OPTION_COUNT"]
    assert flags(spark, text="Which is **not** it?") == []
    assert flags(spark, text="Define it") == []


def test_wrong_key_is_caught(spark):
    df = spark.createDataFrame([(1, "What?", ["aaaa", "bbbb", "cccc"], 0, "aaaa")], SHAPE)
    moved = L.wrong_key(df).first()
    assert (moved["correct_option_index"], moved["correct_answer"]) == (1, "bbbb")


def test_greedy_dedup_is_the_loop(spark):
    rng = random.Random(5)
    sets = {i: {rng.randrange(12) for _ in range(6)} for i in range(60)}
    kept = []
    for i in sorted(sets):
        if all(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.5 for j in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, tokens array<string>")
    pairs = D.similar_pairs(df, 0.5)
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    assert sorted(r["id"] for r in D.keep_first_greedy(df.select("id"), pairs).where("kept").collect()) == kept


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.7])
def test_copies_are_compared_once(spark, monkeypatch, threshold):
    """Rows with equal sets make every pair of the result, but neither pairs to compare nor pairs for the greedy loop; also where they fill several blocks."""
    rng = random.Random(7)
    different = [rng.sample("abcdefghij", rng.randint(0, 6)) for _ in range(70)]
    sets = {i: rng.choice(different) for i in range(100, 300)} | {i: list("abc") for i in range(0, 90, 3)}
    alike = lambda x, y: bool(x and y) and len(set(x) & set(y)) / len(set(x) | set(y)) >= threshold
    want = {(a, b): round(len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])), 9) for a in sets for b in sets if a < b and alike(sets[a], sets[b])}
    kept = []
    for i in sorted(sets):
        if not any(alike(sets[i], sets[j]) for j in kept):
            kept.append(i)
    written, real = {}, D.saved
    monkeypatch.setattr(D, "saved", lambda df, name: written.setdefault(name, []).append(real(df, name)) or written[name][-1])
    monkeypatch.setattr(D, "MEMBERS", 7, raising=False)
    df = spark.createDataFrame([(i, [*s, *s[:1]]) for i, s in sets.items()], "id long, tokens array<string>")
    got = [tuple(r) for r in D.similar_pairs(df, threshold, digits=9).collect()]
    assert len(got) == len(want) and {(a, b): j for a, b, j in got} == want
    assert sorted(r["id"] for r in D.keep_first_near(df, threshold).where("kept").collect()) == kept
    once = {frozenset(x) for x in sets.values()}
    assert written["similar-blocks"][0].where("blocks > 1").count() > 2 and written["greedy-pairs"][0].count() * 2 == sum(alike(x, y) for x in once for y in once if x != y)


def test_best_across_is_the_best_of_all(spark):
    rng = random.Random(12)
    some = lambda n: [[rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 7))] for _ in range(n)]
    left, right = some(60), some(150)
    left += right[:5] + [list(reversed(right[6]))]
    right += [right[0]] * 50
    got = {r["id"]: (r["best"], r["exact"]) for r in D.best_across(spark.createDataFrame(list(enumerate(left)), "id long, tokens array<string>"), spark.createDataFrame([(r,) for r in right], "tokens array<string>"), 0.5).collect()}
    for i, x in enumerate(left):
        best = max((len(set(x) & set(y)) / len(set(x) | set(y)) for y in right if set(x) | set(y)), default=0)
        assert got[i] == (pytest.approx(best) if best >= 0.5 else None, bool(x) and x in right)


@pytest.mark.parametrize("rows", [0, 100_000])
def test_best_across_posts_no_set_of_other_words(spark, monkeypatch, rows):
    """Right sets with too few of the left words are dropped before any is joined, with and without broadcasts; what is written is the ranks of words."""
    monkeypatch.setattr(D, "BROADCAST", rows)
    written = {}
    real = D.saved
    monkeypatch.setattr(D, "saved", lambda df, name: written.setdefault(name, real(df, name)))
    left = [(1, ["a", "b", "c"]), (2, ["a", "a", "d"]), (3, []), (4, ["z"])]
    right = [(["a", "b", "x", "y"],), (["x", "y", "a"],), (["c", "b"],), (["d", "a"],), (None,), ([],)]
    got = D.best_across(spark.createDataFrame(left, "id long, tokens array<string>"), spark.createDataFrame(right, "tokens array<string>"), 0.5)
    assert {r["id"]: (r["best"], r["exact"]) for r in got.collect()} == {1: (pytest.approx(2 / 3), False), 2: (1.0, False), 3: (None, False), 4: (None, False)}
    assert dict(written["across-posts"].dtypes)["wa"] == "array<bigint>"


def test_runs_and_pages(spark):
    df = spark.createDataFrame([(1, p) for p in (1, 2, 3, 7, 9, 10)], "lesson_id long, page int")
    assert {(r["start"], r["end"]) for r in S.runs(df, ["lesson_id"]).collect()} == {(1, 3), (7, 7), (9, 10)}
    pages = spark.createDataFrame([(1, 1, "ab"), (1, 2, ""), (1, 3, "c\nd")], "lesson_id long, page int, page_text string")
    back = S.pages_from_markers(S.joined_pages(pages))
    assert {(r["page"], r["page_text"]) for r in back.collect()} == {(1, "ab"), (2, ""), (3, "c\nd")}


def test_chunks_end_at_the_end():
    assert Q.chunks("", 10, 2) == []
    assert Q.chunks("a" * 25, 10, 2) == [(0, 10), (8, 18), (16, 25)]
    assert Q.chunks("aaaaaaa\n\nbbbbbbbb", 10, 0)[0] == (0, 7)


def test_batches_overlap_by_one_section(spark):
    df = spark.createDataFrame([(1, i, i, 12) for i in range(5)], "lesson_id long, section_id long, order_index int, n int")
    out = {}
    for r in Q.section_batches(df).collect():
        out.setdefault(r["batch"], []).append(r["section_id"])
    assert {k: sorted(v) for k, v in out.items()} == {0: [0, 1], 1: [1, 2], 2: [2, 3], 3: [3, 4]}


def test_csv_and_triples_round_trip(spark, tmp_path):
    df = spark.range(7).withColumnRenamed("id", "k")
    io.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 7
    t = spark.createDataFrame([("a_1", "label", 'x"y'), ("a_1", "has", "b_2")], "s string, p string, o string")
    io.write_ntriples(t, str(tmp_path / "n"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "n")).collect()) == ['<urn:x:a_1> <urn:x:has> <urn:x:b_2> .', '<urn:x:a_1> <urn:x:label> "x\\"y" .']


def test_merged_sections_are_the_loop(spark):
    rng = random.Random(3)
    rows = [(i, i // 12, " ".join(rng.choice("abcd") for _ in range(3)), rng.sample("uvwxyz", 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "section_id long, lesson_id long, title string, key_topics array<string>")
    pairs = {(r["a"], r["b"]) for r in D.section_pairs(df).collect()}
    want, used = {}, set()
    for i, lesson, _, topics in rows:
        if i in used:
            continue
        all_, n = list(topics), 0
        for j, other, _, more in rows[i + 1 :]:
            if other == lesson and j not in used and (i, j) in pairs:
                used.add(j)
                all_ += more
                n += 1
        want[i] = (n, list(dict.fromkeys(all_))[:10])
    assert {r["section_id"]: (r["absorbed"], r["key_topics"]) for r in D.merge_sections(df).collect()} == want and used


def test_overlapping_sections_fold_in_order(spark):
    shape = "section_id long, lesson_id long, start_page int, end_page int, title string, los array<string>"
    rows = [
        (1, 1, 1, 4, "long title", ["a", "b", "c"]), (2, 1, 1, 4, "short", ["a", "b", "d"]), (3, 1, 2, 3, "more", ["a", "b", "c", "d", "e"]),  # 2 beats 1 by its title, 3 beats 2 by its objects
        (4, 1, 9, 9, "far", ["a", "b", "c"]), (5, 2, 1, 4, "other lesson", ["a", "b", "c"]), (6, 2, 1, 4, "no objects", []),
    ]
    got = {r["section_id"]: r["los"] for r in D.dedup_overlapping(spark.createDataFrame(rows, shape)).collect()}
    assert got == {3: ["a", "b", "c", "d", "e"], 4: ["a", "b", "c"], 5: ["a", "b", "c"], 6: []}


def fold(rows):
    """One section after the other against those behind it."""
    out = {}
    for lesson in {r[1] for r in rows}:
        alive = {r[0]: [*r[2:5], list(r[5])] for r in sorted(rows) if r[1] == lesson}
        for a in sorted(alive):
            for b in sorted(alive):
                if b <= a or a not in alive or b not in alive:
                    continue
                (s1, e1, t1, l1), (s2, e2, t2, l2) = alive[a], alive[b]
                if min(e1, e2) - max(s1, s2) + 1 < 0.5 * (min(e1 - s1, e2 - s2) + 1) or not l1 or not l2 or len(set(l1) & set(l2)) < 0.6 * min(len(set(l1)), len(set(l2))):
                    continue
                if (len(l2), -len(t2)) > (len(l1), -len(t1)):
                    alive[b][3] = l2 + [x for x in dict.fromkeys(l1) if x not in l2]
                    del alive[a]
                else:
                    alive[a][3] = l1 + [x for x in dict.fromkeys(l2) if x not in l1]
                    del alive[b]
        out |= {k: v[3] for k, v in alive.items()}
    return out


def test_overlapping_sections_are_the_loop(spark):
    rng = random.Random(8)
    shape = "section_id long, lesson_id long, start_page int, end_page int, title string, los array<string>"
    rows = [(i, rng.randint(1, 4), a := rng.randint(1, 6), a + rng.randint(0, 4), "t" * rng.randint(1, 4), rng.sample("abcdef", rng.randint(0, 4))) for i in range(48)]
    got = {r["section_id"]: r["los"] for r in D.dedup_overlapping(spark.createDataFrame(rows, shape)).collect()}
    assert got == fold(rows) and len(got) < 40


def test_overlapping_sections_of_two_lessons_with_one_id(spark):
    """Ids of sections are numbers of pages, so a long lesson has some of the next lesson's; all sections meet in one shuffle, however many go."""
    shape = "section_id long, lesson_id long, start_page int, end_page int, title string, los array<string>"
    rows = [(1, 1, 1, 4, "t", ["a", "b"]), (2, 1, 1, 4, "t", ["a", "b", "c"]), (1, 2, 1, 4, "t", ["a", "b", "c", "d"]), (2, 2, 1, 4, "t", ["x"]), (3, 2, 1, 4, "t", ["x", "y"]), (4, None, 1, 4, "t", ["a"]), (5, None, 1, 4, "t", ["a"])]
    out = D.dedup_overlapping(spark.createDataFrame(rows, shape))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    want = [(1, 2, ["a", "b", "c", "d"]), (2, 1, ["a", "b", "c"]), (3, 2, ["x", "y"]), (4, None, ["a"]), (5, None, ["a"])]
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0], r[1] or 0)) == want


def test_section_batches(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for lesson in range(12):
        sizes = [rng.choice([0, 1, 5, 12, 29, 31, 45]) for _ in range(rng.randint(0, 9))]
        rows += [(lesson, lesson * 100 + i, i, n) for i, n in enumerate(sizes)] + [(lesson, None, 0, n) for n in [3] * (lesson % 3)]
        batches, now = [], []
        for i, n in [(i, n) for i, n in enumerate(sizes) if n]:
            if now and sum(sizes[x] for x in now) + n > 30:
                batches.append(now)
                now = now[-1:]
            now = [*now, i]
        batches += [now] if now else []
        want[lesson] = [(b, lesson * 100 + i) for b, part in enumerate(batches) for i in part] + ([(len(batches), None)] if lesson % 3 else [])
    got = {k: [] for k in want}
    df = spark.createDataFrame(rows, "lesson_id long, section_id long, order_index int, n int")
    for r in Q.section_batches(df).collect():
        got[r["lesson_id"]].append((r["batch"], r["section_id"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    df.createOrReplaceTempView("some_sections")
    sql = spark.sql("SELECT count(*) AS n FROM section_batches(TABLE(some_sections) PARTITION BY lesson_id ORDER BY (order_index, section_id))")
    assert sql.first()["n"] == sum(map(len, want.values()))
    found = Q.chunk_text(spark.createDataFrame([(1, "a" * 25), (2, ""), (3, None)], "k long, t string"), "k", "t", 10, 2).collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 0, 10), (1, 1, 8, 18), (1, 2, 16, 25)]


def test_samples_are_those_of_a_full_sort(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("aaaaaaaabbc")) for i in range(3000)] + [(9000, "d"), (9001, None), (0, "b")]
    df = spark.createDataFrame(rows, "id long, s string")
    key = lambda r, seed: (hashlib.md5(f"{r[0]}-{seed}".encode()).hexdigest(), r[0])
    take = {"a": 40, "b": 5000, "c": 1, "d": 3, "e": 2}
    got = P.lowest(df, "s", spark.createDataFrame(list(take.items()), "s string, take long"), "id", "x").collect()
    want = [r for s, k in take.items() for r in sorted((r for r in rows if r[1] == s), key=lambda r: key(r, "x"))[:k]]
    assert sorted(tuple(r) for r in got) == sorted(want)
    part = [tuple(r) for r in P.proportional(df.where("s IS NOT NULL"), "s", 100, "id", "y").collect()]
    some = [r for r in rows if r[1]]
    picked = [r for s in "abcd" for r in sorted((r for r in some if r[1] == s), key=lambda r: key(r, "y"))[: max(1, round(100 * sum(x[1] == s for x in some) / len(some)))]]
    assert sorted(part) == sorted(sorted(picked, key=lambda r: key(r, "y-trim"))[:100])


def test_a_stratum_with_too_few_low_hashes_is_ranked_whole(spark, monkeypatch):
    monkeypatch.setattr(P, "order", lambda c, seed: F.concat(F.lit("ff"), F.lpad(c.cast("string"), 30, "0")))  # nothing lies below a cut-off
    df = spark.range(500).select("id", F.lit("a").alias("s"))
    got = P.lowest(df, "s", spark.createDataFrame([("a", 3)], "s string, take long"), "id", "x")
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2]


def test_cues_have_their_places(spark):
    text = "X. Česta greška je to; students often think. Umesto sile, neki misle so. Precesta greška"
    got = [(r["offset"], r["cue"]) for r in S.cue_hits(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "k long, raw string"), "k").orderBy("offset").collect()]
    assert got == [(3, "Česta greška"), (23, "students often think"), (45, "Umesto sile, neki misle")] and all(text[o : o + len(c)] == c for o, c in got)


def test_title_variants_and_normal_forms(spark):
    df = spark.createDataFrame([(1, " Ｆｏｏ Bar. "), (2, "ab"), (3, "A  b c"), (4, None)], "k long, t string")
    got = {r["k"]: r["v"] for r in df.select("k", Q.title_variants(F.col("t")).alias("v")).collect()}
    assert got[1] == ["ｆｏｏ bar.", "ｆｏｏ bar", "foo bar.", "foo bar"] and not got[2] and "a b c" in got[3] and not got[4]
    assert [r["v"] for r in df.select("k", Q.nfkc(F.col("t")).alias("v")).orderBy("k").collect()] == [" Foo Bar. ", "ab", "A  b c", None]


def test_headlines_mark_what_is_better(spark):
    rows = [("before", "m", '{"x": 1, "y": 5, "z": 2}'), ("after", "m", '{"x": 2, "y": 7, "z": 2}'), ("after", "n", '{"w": 1}')]
    spec = [("m", "x", True), ("m", "y", False), ("m", "z", True), ("n", "w", True), ("m", "y", None), ("q", "none", True)]
    got = {(r["metric_key"], r["path"]): (r["before"], r["after"], r["mark"]) for r in M.headline_delta(spark.createDataFrame(rows, "snapshot string, metric_key string, payload string"), spec[:4]).collect()}
    assert got == {("m", "x"): (1, 2, "✓"), ("m", "y"): (5, 7, "✗"), ("m", "z"): (2, 2, "~"), ("n", "w"): (None, 1, "")}


def test_means_do_not_depend_on_the_order(spark):
    values = [0.1 * i for i in range(1, 400)]
    one = lambda v: spark.createDataFrame([(x,) for x in v], "x double").agg(T.exact_mean(F.col("x"), 2)).first()[0]
    assert one(values) == one(values[::-1]) == round(sum(values) / len(values), 2)
    assert one([]) is None


def test_readability_near_a_half_is_rounded_as_in_sql(spark):
    import duckdb

    counts = [(s, w, y) for s in (1, 3, 7, 20) for w in range(40, 140, 3) for y in range(w, w + 160, 1)]
    df = spark.createDataFrame(counts, "s long, w long, y long").select(T.flesch_ease(F.col("s"), F.col("w"), F.col("y")).alias("e"), T.kincaid_grade(F.col("s"), F.col("w"), F.col("y")).alias("g"))
    sql = "SELECT round(206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (y / w), 1), round(0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (y / w) - 15.59::DOUBLE, 1)"
    want = duckdb.execute(f"{sql} FROM (SELECT unnest(?) AS s, unnest(?) AS w, unnest(?) AS y)", [list(c) for c in zip(*counts, strict=True)]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_keyword_listed_twice_is_one_keyword(spark):
    """After 34 hits of a word that is listed twice no more count, so page 3 holds nothing of its own and the first page is taken."""
    pages = spark.createDataFrame([(1, 1, "that " * 17), (1, 2, "none"), (1, 3, "that that"), (1, 4, "that")], "lesson_id long, page int, page_text string")
    objects = spark.createDataFrame([(7, 1, 2, 4, "qq 7", ["that", "that"]), (8, 1, 2, 4, "qq 8", ["that"])], "section_id long, lesson_id long, start_page int, end_page int, lo_title string, keywords array<string>")
    assert {r["section_id"]: r["pages"] for r in S.assign_pages(objects, pages).collect()} == {7: [2], 8: [3]}


def test_strata_of_a_sample_are_not_shuffled_whole(spark):
    """Rows meet the cut-offs of their strata where they are read."""
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("book"))
    plan = P.proportional(df, "book", 40, "id", "7")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
