"""Streams over several micro-batches, restarts and replays against the batch result, and the keyed store."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gradus.streaming import jobs as J
from gradus.streaming.keyed import KeyedTable, MetricStore
from gradus.streaming.questions import QuestionIndex, keep_unique

START = datetime(2026, 1, 1)


def hours(n):
    return START + timedelta(hours=n)


def deliver(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


TRIAL = "question_id long, correct boolean, parse_failure boolean"


def test_item_difficulty_resumes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(q, rng.random() < 0.6, rng.random() < 0.1) for q in range(12) for _ in range(6)]
    rng.shuffle(rows)
    table = J.difficulty_table(spark, f"{tmp_path}/table")
    planned = spark.createDataFrame([(q, 6) for q in range(12)], "question_id long, trials long")
    for i, part in enumerate((rows[:20], rows[20:41], [], rows[41:])):
        if part:
            deliver(spark, part, TRIAL, f"{tmp_path}/in")
        J.merge(J.item_difficulty(stream(spark, TRIAL, f"{tmp_path}/in")), table, "trials", "update", compact_every=2)
        report = J.difficulty_report(table.current(), planned).first()
        assert report["partial"] == (i < 3) and report["total_questions"] == 12
    want = {}
    for q, ok, bad in rows:
        w = want.setdefault(q, [0, 0, 0])
        w[0] += 1
        w[1] += not bad
        w[2] += ok and not bad
    got = {r["question_id"]: (r["trials"], r["usable"], r["p_value"]) for r in table.current().collect()}
    assert got == {q: (n, u, round(c / u, 3) if u else None) for q, (n, u, c) in want.items()}
    assert report["completed_questions"] == 12
    batch = J.item_difficulty(spark.createDataFrame(rows, TRIAL)).select("question_id", "trials", "usable", "p_value", "label")
    assert sorted(batch.collect()) == sorted(table.current().select(*batch.columns).collect())


CALL = "ts timestamp, provider string, input_tokens long, output_tokens long"


def test_sliding_sums_and_late_rows(spark, tmp_path):
    at = f"{tmp_path}/calls"
    batches = [
        [(hours(1), "a", 10, 1), (hours(30), "a", 20, 1), (hours(30), "b", 5, 1)],
        [(hours(200), "a", 40, 1)],  # the watermark is at 200 - 48 hours behind this batch, and rows are late against that of a batch before
        [(hours(201), "a", 1, 1)],
        [(hours(2), "a", 999, 1), (hours(160), "a", 80, 1), (hours(3), "b", 999, 1)],
    ]
    for rows in batches:
        deliver(spark, rows, CALL, at)
    out = {}

    def each(rows, batch):
        out.update({(r["day"], r["provider"]): r["input_tokens"] for r in rows.collect()})

    q = J.finish(J.spend(stream(spark, CALL, at), "2 days", "2 days", "1 day"), "update", each, f"{tmp_path}/state")
    # each late row falls into two windows
    assert J.late_rows(q) == 4
    day = lambda n: (START + timedelta(days=n)).strftime("%Y-%m-%d")
    want = {}
    for ts, provider, n, _ in [r for b in batches for r in b if r[2] != 999]:
        d = (ts - START).days
        for w in (d, d - 1):
            want[day(w), provider] = want.get((day(w), provider), 0) + n
    assert out == want


def test_sessions_drop_and_count_late_rows(spark, tmp_path):
    schema = "ts timestamp, user_id long, item long, answer int"
    at = f"{tmp_path}/attempts"
    batches = [[(hours(0), 1, 0, 0), (hours(5), 1, 1, 0)], [(hours(100), 1, 2, 2)], [(hours(100), 9, 0, 0)], [(hours(8), 1, 3, 3), (hours(99), 1, 4, 0), (hours(90), 2, 5, 1)], [(hours(300), 3, 0, 0)], [(hours(301), 3, 1, 1)]]
    for rows in batches:
        deliver(spark, rows, schema, at)
    out = []
    q = J.finish(J.sessions(stream(spark, schema, at)), "append", lambda rows, batch: out.extend(tuple(r) for r in rows.collect()), f"{tmp_path}/state")
    assert J.late_rows(q) == 1
    us = lambda n: int((hours(n) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    assert sorted(out) == [(1, us(0), 2, 1), (1, us(99), 2, 2), (2, us(90), 1, 1), (9, us(100), 1, 1)]


def report_rows(store):
    return sorted(((r["metric_key"], r["scope_id"], r["payload"]) for r in store.current().collect()), key=str)


PUT = "metric_key string, scope_id long, payload string, created_at timestamp"


def test_store(spark, tmp_path):
    store = MetricStore(spark, f"{tmp_path}/store")
    assert report_rows(store) == [] and store.clear() == 0
    put = lambda rows, **kw: store.put(spark.createDataFrame(rows, PUT), **kw)
    put([("lint", 1, '{"a": 1}', hours(1)), ("ioc", 1, '{"b": 1}', hours(1)), ("lint", 2, "no json", hours(1)), ("lint", 3, "[3]", hours(1)), ("lint", None, "{}", hours(1))])
    put([("lint", 1, '{"a": 2}', hours(2))], source="x", batch=5)
    put([("lint", 1, '{"a": 2}', hours(2))], source="x", batch=5)
    put([("lint", 1, '{"a": 0}', hours(0))])
    assert [tuple(r) for r in store.get("lint", 1).collect()] == [('{"a": 2}', hours(2))]
    assert store.get("lint", 2).count() == 0 and store.get("nothing", 1).count() == 0 and store.get("lint", 1, "course").count() == 0
    one = spark.createDataFrame([(1,), (1,), (2,)], "lesson_id long")
    assert sorted((r["lesson_id"], r["metric_key"]) for r in store.for_lessons(one).collect()) == [(1, "ioc"), (1, "lint")]
    assert store.invalidate_lessons(one, "ioc") == 1 and store.invalidate_lessons(one, "ioc") == 0
    questions = spark.createDataFrame([(7, 3, 99), (8, None, 2), (9, 1, 1)], "question_id long, primary_lesson_id long, secondary_lesson_id long")
    assert store.invalidate_questions(spark.createDataFrame([(7,), (8,), (70,)], "question_id long"), questions) == 2
    want = [("lint", 1, '{"a": 2}'), ("lint", None, "{}")]
    assert report_rows(store) == sorted(want, key=str)
    store.compact()
    put([("lint", 3, "[3]", hours(1))])  # what was deleted doesn't come back with the same time, a newer report does
    put([("lint", 2, "{}", hours(3))], source="x", batch=6)
    assert report_rows(store) == sorted([*want, ("lint", 2, "{}")], key=str)
    store.compact(F.lit(False))
    assert report_rows(MetricStore(spark, f"{tmp_path}/store")) == sorted([*want, ("lint", 2, "{}")], key=str)
    assert store.clear() == 3 and report_rows(store) == []


def test_deletions_as_of_a_time(spark, tmp_path):
    store = MetricStore(spark, f"{tmp_path}/store")
    store.put(spark.createDataFrame([("lint", 1, "1", hours(1)), ("ioc", 1, "5", hours(5))], PUT))
    assert store.invalidate_lessons(spark.createDataFrame([(1, hours(3)), (1, hours(2))], "lesson_id long, created_at timestamp")) == 1
    store.put(spark.createDataFrame([("lint", 1, "2", hours(2))], PUT))  # arrives late
    assert report_rows(store) == [("ioc", 1, "5")]
    store.put(spark.createDataFrame([("lint", 1, "4", hours(4))], PUT))
    assert report_rows(store) == [("ioc", 1, "5"), ("lint", 1, "4")]


@pytest.mark.parametrize("parts", [1, 4])
def test_streamed_store_and_replays(spark, tmp_path, parts):
    rng = random.Random(2)
    rows = [(f"m{rng.randint(0, 3)}", rng.randint(0, 5), str(i), hours(rng.randint(0, 40)), i) for i in range(120)]
    schema = PUT + ", event_id long"
    for i in range(parts):
        deliver(spark, rows[i::parts], schema, f"{tmp_path}/in")
    store = MetricStore(spark, f"{tmp_path}/store")
    source = stream(spark, schema, f"{tmp_path}/in")
    J.store_reports(source, store, compact_every=3)
    want = {}
    for k, s, p, t, e in rows:
        want[k, s] = max(want.get((k, s), ((datetime.min, -1), "")), ((t, e), p))
    assert report_rows(store) == sorted(((k, s, p) for (k, s), (_, p) in want.items()), key=str)
    for batch in range(parts):  # a replay of any batch, also one that was folded away
        store.write(spark.createDataFrame([(*r, "lesson") for r in rows[batch::parts]], schema + ", scope_type string"), "reports", batch)
    assert report_rows(store) == sorted(((k, s, p) for (k, s), (_, p) in want.items()), key=str)


def test_unfinished_compaction_is_not_seen(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k long, v long, at long", ["k"], ["at"])
    table.write(spark.createDataFrame([(1, 1, 1)], "k long, v long, at long"), "s")
    spark.createDataFrame([(1, 9, 9, False)], table.stored).write.parquet(f"{tmp_path}/t/generation=1/source=compacted/batch=0")
    assert [tuple(r) for r in table.current().collect()] == [(1, 1, 1)]


QUESTION = "question_id long, question_text string, correct_answer string, learning_object_id long, question_section_id long"


def loop(rows):
    texts, keys, stems, kept = set(), set(), [], []
    for i, text, answer, lo, section in sorted(rows, key=lambda r: r[0]):
        normal = re.sub(r"[^\w\s]", "", (text or "").strip().lower()).strip()
        if not normal:
            continue
        short = re.sub(r"^[a-z]\)\s*", "", (answer or "").strip().lower()).strip()
        anchor = lo if lo is not None else section
        key = f"{anchor}::{short}" if anchor is not None and short else None
        words = set(re.findall(r"\w+", text.lower()))
        if normal in texts or key in keys or (len(words) >= 12 and any(len(words & s) / len(words | s) >= 0.7 for s in stems)):
            continue
        kept.append(i)
        texts.add(normal)
        if key:
            keys.add(key)
        if len(words) >= 12:
            stems.append(words)
    return kept


def bank(n=140):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.55:
            text = rows[rng.randrange(len(rows))][1] or ""
            parts = text.split()
            for _ in range(rng.randint(0, 4)):
                if parts:
                    parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randint(4, 24))) + rng.choice(["?", " ?!", ""])
        rows.append((i, text if kind < 0.97 else rng.choice([None, "  ", "??"]), rng.choice(["A) yes", "yes", "no", None, "", *map(str, range(40))]), rng.choice([None, *range(12)]), rng.choice([None, 1])))
    return rows


@pytest.mark.parametrize("cuts", [[], [30, 31, 90], [139]])
def test_unique_questions_in_any_batches(spark, tmp_path, cuts):
    rows = bank()
    want = loop(rows)
    index = QuestionIndex(spark, f"{tmp_path}/index")
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        deliver(spark, rows[a:b], QUESTION, f"{tmp_path}/in")
        keep_unique(stream(spark, QUESTION, f"{tmp_path}/in"), index, f"{tmp_path}/state")
    assert sorted(r["id"] for r in index.kept().collect()) == want and 20 < len(want) < 120
    if cuts == [139]:
        index.add(spark.createDataFrame(rows[139:], QUESTION), 1)  # a replay
        assert sorted(r["id"] for r in index.kept().collect()) == want


def test_copies_make_no_pairs(spark, tmp_path):
    rows = [(i, "the same long stem of more than twelve different words that comes again and again", f"a{i}", i, None) for i in range(400)]
    index = QuestionIndex(spark, f"{tmp_path}/index")
    index.add(spark.createDataFrame(rows, QUESTION), 0)
    assert [r["id"] for r in index.kept().collect()] == [0]
    assert spark.read.parquet(f"{tmp_path}/index/postings").select("stem").distinct().count() == 1


def test_stems_meet_without_a_broadcast(spark):
    """Small sides don't go through the driver either: there is a join for each round of each batch."""
    from gradus.streaming.questions import alike, posted

    words = spark.createDataFrame([("a b c", ["a", "b", "c"]), ("a b c d", ["a", "b", "c", "d"]), ("x", ["x"])], "stem string, words array<string>")
    posts = posted(words, spark.createDataFrame([("a", 2), ("b", 2)], "word string, rank long"), 0.7)
    met = alike(posts, posts, 0.7)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in met.collect()) == [("a b c", "a b c d"), ("a b c d", "a b c")]
