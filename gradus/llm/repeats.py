"""Windows of a fixed number of units (bytes or words) that occur more than once in a corpus, by passes from the most significant digit on.

Sorting every window by its first digit would move the whole text once for each unit. So a window's first digit is not taken at its start but
at its anchor: a place inside it that a finder derives from the window's content alone. Equal windows have equal anchors at equal distances, and
neighbouring windows mostly share one, so an occurrence is one anchor with the run of windows that have it.

1. First digit: occurrences are counted by their anchor's key, and those whose key nobody else has go no further. The others carry the units that
   their windows cover.
2. Each pass settles and splits. Settle: occurrences whose windows cover the same units are one class, of which the first (lowest document, then
   place) leads; all windows of the others have occurred. Split: a class's windows fall into families by their distance from the anchor, and the units
   that all windows of a family share, wider from pass to pass, are its next digit. Families whose digit stands in one class alone go no further.
3. After the last pass a family is one window, its digit the window itself.

Classes are told apart by the SHA-256 of their units (its first 16 bytes), which names them from then on; other hashes only choose candidates. Every step is an aggregation with
map-side sums or a join of two plain shuffles, which Spark splits where a key is hot: no group is gathered in a task, no pair of documents written down,
nothing sampled or capped.

A document is a row (doc, alt, text): doc its id, alt tells texts apart that share an id. None of those is earlier than another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, digest, forget, saved

#: Ids up to which the documents to be changed are found by a broadcast (16 bytes each).
BROADCAST_IDS = 300_000
#: Bytes of text that a finder takes at once; it needs some 220 for each.
PIECE = 1 << 17
#: Names of classes that a task keeps in mind.
SEEN = 100_000


class Anchors(NamedTuple):
    """The occurrences of one piece of text: anchors with runs of neighbouring windows; places are in units of the piece's rows."""

    row: np.ndarray
    key: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    covered: Callable[[int], bytes]  # the units that the windows of the occurrence with this index cover

    @staticmethod
    def none() -> Anchors:
        z = np.zeros(0, np.int64)
        return Anchors(z, np.zeros(0, np.uint64), z, z, z, lambda _: b"")


class Kind(NamedTuple):
    """What a unit is."""

    #: Of a column of texts: (number of the first row, anchors), each window once.
    find: Callable[[pa.Array], Iterator[tuple[int, Anchors]]]
    #: (covered units as bytes, first unit from 0, number of units) to those units as bytes.
    cut: Callable[[Column, Column, Column], Column]
    window: int
    #: Numbers of neighbouring distances in a family, from pass to pass; each divides the one before, the last is 1.
    widths: tuple[int, ...]
    #: Whether a window that occurs further up in its own document is a repeat.
    within: bool


def grouped(anchor: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) index of each run of windows with one anchor in one row."""
    if not len(anchor):
        z = np.zeros(0, np.int64)
        return z, z
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(anchor)) - 1


def _keys(kind: Kind):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, alts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, x in kind.find(batch.column(2)):
                yield pa.RecordBatch.from_arrays([pa.array(x.key.view(np.int64)), pa.array(docs[i + x.row]), pa.array(alts[i + x.row]), pa.array(x.first.astype(np.int32))], names=["key", "doc", "alt", "first"])

    return keys


def _occurrences(kind: Kind):
    """(doc, alt, text, firsts) to the occurrences at `firsts`, the first windows of a document's shared anchors: (key, class, doc, alt, anchor, a, b, units);
    a to b are the distances of the windows from the anchor. A class that the task has sent already comes without units. Where repeats within a
    document count, one that the document holds already comes as a run of repeats, without a class: (null, null, doc, alt, start, null, windows, null)."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            docs, alts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            wanted = batch.column(3)
            starts, flat = wanted.offsets.to_numpy(), wanted.values.to_numpy()
            mine: set[bytes] = set()
            of = -1
            for i, x in kind.find(batch.column(2)):
                out: list[list] = []
                order = np.flatnonzero(_wanted(i + x.row, x.first, starts, flat))
                for k, row, first, last, place in zip(order.tolist(), *(v[order].tolist() for v in (x.row, x.first, x.last, x.place)), strict=True):
                    if of != i + row:
                        of, mine = i + row, set()
                    units, a, b = x.covered(k), place - last, place - first
                    name = hashlib.sha256(b"%d %d " % (a, b) + units).digest()[:16]
                    if kind.within and name in mine:
                        if out and out[-1][1] is None and out[-1][2] == of and out[-1][4] + out[-1][6] == first:
                            out[-1][6] += last - first + 1
                        else:
                            out.append([None, None, of, None, first, None, last - first + 1, None])
                        continue
                    out.append([int(x.key[k].view(np.int64)), name, of, None, place, a, b, None if name in seen else units])
                    if len(seen) >= SEEN:  # then their units are sent once more
                        seen.clear()
                    seen.add(name)
                    mine.add(name)
                columns = list(zip(*out, strict=True)) or [()] * 8
                at = np.array(columns[2], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(docs[at]), pa.array(alts[at]), *[pa.array(columns[c], pa.int32()) for c in (4, 5, 6)], pa.array(columns[7], pa.binary())],
                    names=["key", "class", "doc", "alt", "anchor", "a", "b", "units"],
                )

    return occurrences


def _wanted(rows: np.ndarray, first: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Which (row, first) the lists hold: row r's list is flat[starts[r]:starts[r + 1]]."""
    if not len(rows):
        return np.zeros(0, bool)
    low, high = int(rows.min()), int(rows.max()) + 1
    counts = np.diff(starts[low : high + 1])
    lists = np.repeat(np.arange(low, high), counts) << 40 | flat[starts[low] : starts[high]].astype(np.int64)
    return np.isin(rows << 40 | first, lists)


STATE = ["class", "source", "doc", "alt", "anchor", "a", "b", "name"]


def _settled(rows: DataFrame, within: bool, shared_ids: bool, step: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows of STATE: (leading rows of each class, (doc, alt, start, n) runs of windows that have occurred, the written table from which, with rows, the former come)."""
    lead = F.min(F.struct("doc", "alt", "anchor", "source")).alias("l")
    leads = saved(rows.groupBy("class").agg(lead, F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("a", "b", "name")]), f"{step}-leads")
    copied = leads.where("copies > 1").select("class", F.col("l.doc").alias("ldoc"), F.col("l.alt").alias("lalt"), F.col("l.anchor").alias("lanchor"))
    pairs = rows.join(copied, "class")
    tied = (F.col("doc") == F.col("ldoc")) & ~((F.col("alt") == F.col("lalt")) & (F.col("anchor") == F.col("lanchor")))
    run = [F.col("doc"), F.col("alt"), (F.col("anchor") - F.col("b")).alias("start"), (F.col("b") - F.col("a") + 1).alias("n")]
    found = pairs.where("doc > ldoc").select(run)
    out = leads.select("class", "l.*", "a", "b", "name").select(STATE)
    if within:
        found = found.unionByName(pairs.where(tied & (F.col("alt") == F.col("lalt"))).select(run))
    if not within or shared_ids:
        # occurrences that are no later than the leading one go on beside it
        also = pairs.where(tied & (F.lit(not within) | (F.col("alt") != F.col("lalt"))))
        if within:
            least = also.withColumn("least", F.min("anchor").over(Window.partitionBy("class", "alt")))
            found = found.unionByName(least.where("anchor > least").select(run))
            also = least.where("anchor = least")
        out = out.unionByName(also.select(STATE))
    return out, saved(found, f"{step}-found"), leads


def _shared(rows: DataFrame, kind: Kind, settled: bool, step: str) -> DataFrame:
    """rows of STATE without those whose name stands in one row alone or, where classes are settled, in one class alone."""
    counts = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("class").alias("x"), F.max("class").alias("y"), F.min("doc").alias("p"), F.max("doc").alias("q"))
    several = counts.where(("x < y" if settled else "n > 1") + ("" if kind.within else " AND p < q"))
    names = saved(several.select("name"), f"{step}-names")
    shared = saved(rows.join(names, "name").select(STATE), f"{step}-shared")
    forget(names)
    return shared


def _families(rows: DataFrame, units: DataFrame, kind: Kind, width: int) -> DataFrame:
    """rows of STATE split by distance into families of `width` neighbouring distances, named by the units that all windows of a family share. units (source,
    units, top): what the windows of a row's first class cover, from the one farthest from the anchor, at distance top, on."""
    w = F.lit(width)
    out = rows.join(units, "source").withColumn("lo", F.explode(F.transform(F.sequence(F.floor(F.col("a") / w).cast("int"), F.floor(F.col("b") / w).cast("int")), lambda f: f * w)))
    out = out.withColumn("a2", F.greatest("a", "lo")).withColumn("b2", F.least(F.col("b"), F.col("lo") + w - 1))
    covered_ = kind.cut(F.col("units"), F.col("top") - F.col("b2"), F.col("b2") - F.col("a2") + F.lit(kind.window))
    shared = kind.cut(F.col("units"), F.col("top") - F.col("lo"), F.lit(kind.window + 1 - width))
    name = digest(F.concat_ws(" ", "a2", "b2", F.lit("")), covered_)
    out = out.select(name.alias("class"), "source", "doc", "alt", "anchor", F.col("a2").alias("a"), F.col("b2").alias("b"), (F.xxhash64("lo", shared) if width > 1 else F.lit(0).cast("long")).alias("name"))
    return out.select(STATE)


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """docs (doc, text): (documents (doc, alt, text), each once, without those whose text a lower doc has; odd (doc, hash, alt, copy), the texts that are
    such copies or whose id stands on several rows; whether an id has several texts)."""
    hashed = docs.select("doc", digest(F.col("text")).alias("hash"))
    twice = saved(hashed.groupBy("hash").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeat-texts")
    ids = saved(docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "repeat-ids")
    odd = hashed.join(twice, "hash").where("doc > least").select("doc", "hash", F.lit(True).alias("copy")).unionByName(hashed.join(ids, "doc").select("doc", "hash", F.lit(False).alias("copy")))
    odd = odd.groupBy("doc", "hash").agg(F.max("copy").alias("copy"))
    odd = saved(odd.withColumn("alt", F.row_number().over(Window.partitionBy("doc").orderBy("hash")) - 1), "repeat-odd")
    some = broadcast_if_small(odd.select("doc").distinct(), BROADCAST_IDS)
    again = docs.join(ids, "doc", "left_semi").withColumn("hash", digest(F.col("text"))).join(odd.where("NOT copy"), ["doc", "hash"])
    again = again.groupBy("doc", "alt").agg(F.first("text").alias("text"))
    return docs.join(some, "doc", "left_anti").select("doc", F.lit(0).alias("alt"), "text").unionByName(again), odd, not odd.where("alt > 0").isEmpty()


def repeated(docs: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """docs (doc, text), neither null: ((doc, alt, runs), runs an array of (start, n) runs of windows that occur earlier; documents without any and copies
    are left out; odd as distinct_texts gives it). A step's table is emptied as soon as what follows from it is written."""
    each, odd, shared_ids = distinct_texts(docs)
    keys = each.mapInArrow(_keys(kind), "key long, doc long, alt int, first int")
    several = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("p"), F.max("doc").alias("q"))
    # written down, so that both sides of the join are plain shuffles, of which Spark splits what is hot
    several = saved(several.where("n > 1" if kind.within else "p < q").select("key"), "repeat-keys")
    places = saved(keys.join(several, "key").groupBy("doc", "alt").agg(F.collect_list("first").alias("firsts")), "repeat-places")
    shape = "key long, class binary, doc long, alt int, anchor int, a int, b int, units binary"
    met = saved(each.join(places, ["doc", "alt"]).select("doc", "alt", "text", "firsts").mapInArrow(_occurrences(kind), shape), "repeat-occurrences")
    forget(several, places)
    found = [saved(met.where("class IS NULL").select("doc", "alt", F.col("anchor").alias("start"), F.col("b").alias("n")), "repeat-within")]
    rows = met.where("class IS NOT NULL").select("class", F.col("class").alias("source"), "doc", "alt", "anchor", "a", "b", F.col("key").alias("name"))
    rows, more, leads = _settled(rows, kind.within, shared_ids, "repeat-0")
    found.append(more)
    rows = _shared(rows, kind, True, "repeat-0")
    # from here on rows are names and numbers; what they stand for is looked up in the units of the classes that are still open
    units = met.where("units IS NOT NULL").join(rows.select("class").distinct(), "class", "left_semi").groupBy(F.col("class").alias("source")).agg(F.max("units").alias("units"), F.max("b").alias("top"))
    units = saved(units, "repeat-units")
    forget(met, leads)
    for step, width in enumerate(kind.widths, 1):
        families = saved(_families(rows, units, kind, width), f"repeat-{step}")
        forget(rows)
        if width > 1:
            rows = _shared(families, kind, False, f"repeat-{step}")
            forget(families)
            families = rows
        rows, more, leads = _settled(families, kind.within, shared_ids, f"repeat-{step}")
        found.append(more)
        if width > 1:
            rows = _shared(rows, kind, True, f"repeat-{step}")
        forget(families, leads)
    forget(units)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    runs = saved(every.groupBy("doc", "alt").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "repeat-runs")
    forget(*found)
    return runs, odd


def with_runs(docs: DataFrame, runs: DataFrame, odd: DataFrame) -> DataFrame:
    """(doc, text, runs, copy) for every row of docs; rows without either join nothing when their ids are few enough to broadcast."""
    none = F.lit(None)
    plain = runs.join(odd.select("doc").distinct(), "doc", "left_anti").select("doc", none.cast("binary").alias("hash"), "runs", F.lit(False).alias("copy"))
    touched = saved(plain.unionByName(odd.join(runs, ["doc", "alt"], "left").select("doc", "hash", "runs", "copy")), "repeat-touched")
    ids = broadcast_if_small(saved(touched.select(F.col("doc").alias("id")).distinct(), "repeat-touched-ids"), BROADCAST_IDS)
    changed = docs.join(ids, F.col("doc") == F.col("id"), "left_semi").withColumn("own", digest(F.col("text")))
    changed = changed.join(touched.withColumnRenamed("doc", "id"), (F.col("doc") == F.col("id")) & (F.col("hash").isNull() | (F.col("hash") == F.col("own")))).select("doc", "text", "runs", "copy")
    same = docs.join(ids, F.col("doc") == F.col("id"), "left_anti").select("doc", "text", none.cast(runs.schema["runs"].dataType).alias("runs"), F.lit(False).alias("copy"))
    return changed.unionByName(same)


def covered(starts: np.ndarray, counts: np.ndarray, units: int, window: int) -> np.ndarray:
    """Which of `units` are in a window that starts in one of the runs."""
    step = np.zeros(units + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + counts + window - 1, units), -1)
    return np.cumsum(step[:-1]) > 0
