"""Many literal phrases in long texts: each text is read once, however many phrases are sought in it.

Texts and phrases meet on their key. All phrases of a key form one Aho-Corasick automaton, which finds them in one pass over each of its texts, in the middle
of words too. (An index of words would not do: a phrase counts wherever it stands, also inside a longer word.) The text itself is shuffled once and
never copied to phrases, sections or pages; what comes back are offsets. A task holds one key's texts and phrases and their hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hits that are handed back at a time.
ROWS = 50_000
#: Texts whose lists are searched at a time.
TEXTS = 500


def places(text: str, phrases: list[str], automaton: ahocorasick.Automaton, most: int | None) -> dict[str, list[int]]:
    """Offsets of each phrase in the text, from the left and not overlapping itself, the first `most`; the last place of each alone where most is None."""
    found: dict[str, list[int]] = defaultdict(list)
    free: dict[str, int] = {}
    for end, i in automaton.iter(text):
        p = phrases[i]
        start = end - len(p) + 1
        if most is None:
            found[p] = [start]
        elif start >= free.get(p, 0) and len(found[p]) < most:
            found[p].append(start)
            free[p] = end + 1
    return found


def occurrences(texts: DataFrame, phrases: DataFrame, key: str = "lesson_id", most: int | None = 200) -> DataFrame:
    """(key, part, phrase, nth, offset) of phrases (key, phrase) in texts (key, part, raw) of their key, a long; nth counts the hits of a phrase in a part from 0. Both are
    compared as they are. Null or empty texts and phrases have no hits. Without `most`, each phrase's last place in a part is its only hit."""
    held = texts.where("raw <> ''").groupBy(F.col(key).cast("long").alias("key")).agg(F.collect_list(F.struct(F.col("part").cast("long").alias("part"), "raw")).alias("texts"))
    sought = phrases.where("phrase <> ''").groupBy(F.col(key).cast("long").alias("key")).agg(F.collect_set("phrase").alias("phrases"))
    out = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("phrase", pa.string()), ("nth", pa.int64()), ("offset", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
        for b in batches:
            for i in range(b.num_rows):
                k, parts, listed = (b.column(c)[i].as_py() for c in range(3))
                automaton = ahocorasick.Automaton()
                for n, p in enumerate(listed):
                    automaton.add_word(p, n)
                automaton.make_automaton()
                for part in parts:
                    rows.extend((k, part["part"], p, nth, at) for p, offsets in places(part["raw"], listed, automaton, most).items() for nth, at in enumerate(offsets))
                    if len(rows) >= ROWS:
                        yield batch()
                        rows = []
        if rows:
            yield batch()

    return held.join(sought, "key").select("key", "texts", "phrases").mapInArrow(task, "key long, part long, phrase string, nth long, offset long").withColumnRenamed("key", key)


def coming_again(texts: DataFrame) -> DataFrame:
    """texts (lesson_id, raw, tried: page, end, listed, low): (lesson_id, page, items, hits, listed), a row a list that was tried; hits are the entries of `low` that stand in the text from
    the offset `end` on. An entry is sought from there until it is found, which most are soon; empty and null ones have no hits."""
    out = ["lesson_id", "page", "items", "hits", "listed"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                lesson, raw, tried = whole.slice(at, TEXTS).columns
                page, end, listed, low = tried.flatten().flatten()
                parents = [i for i, n in enumerate(pc.list_value_length(tried).to_pylist()) for _ in range(n)]
                asked = low.to_pylist()
                text, held, hits = "", -1, []
                for i, e, entries in zip(parents, end.to_pylist(), asked, strict=True):
                    if i != held:
                        text, held = raw[i].as_py(), i
                    hits.append(sum(1 for w in entries if w and text.find(w, e) >= 0))
                items = pa.array([len(x) for x in asked], pa.int64())
                yield pa.RecordBatch.from_arrays([lesson.take(pa.array(parents, pa.int64())), page, items, pa.array(hits, pa.int64()), listed], out)

    rows = texts.select(F.col("lesson_id").cast("long"), "raw", "tried")
    return rows.mapInArrow(task, "lesson_id long, page long, items long, hits long, listed array<string>")
