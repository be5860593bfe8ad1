"""Runs of words that repeat with a period, caught online over completed power-of-two blocks.

A catcher of level k holds a completed block of 2 * 2^k words, one for each 2^k words of the stream, and waits for the block to end again 2^k to
2 * 2^k - 1 words later. As words arrive, the hashes of all suffixes of the block's length advance (a window's hash comes from those of its halves) and are
compared with the block that waits for them. A block is longer than any period of its level, so each hit is a square, and any stretch of four
periods holds one. Squares of a period that overlap by it are one stretch; its ends are less than 2^k words off and are found by comparing the words
themselves, which also settles a clash of hashes. Words may be appended in slices of any size, with the same result.

Several documents are appended one behind the other with words between them that equal no other, so a stretch never crosses documents. A task holds one
group of documents (`GROUP` words or one document, if longer) and, for each level, the hashes of fewer than three blocks: some 100 bytes a word. A very long text takes n * log2(n)
comparisons of whole arrays. No rows are shuffled.

Defined results: a null or empty text has no words and no runs; repeated rows give a row each; equal lengths are told apart by start, then period, in
the query; an empty table gives no rows. Of the input only the id and the text are read, whatever else it holds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Words of documents that are searched together, and words that are appended at a time.
GROUP, SLICE = 1 << 18, 1 << 16
#: Least words of a run, and periods that it must have.
LEAST, PERIODS = 6, 4
_FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of windows from those of their halves."""
    h = (first * _FACTORS[0] + second) * _FACTORS[1]
    return h ^ (h >> np.uint64(29))


class _Level:
    """Blocks of 2 * half words that wait, and the hashes of suffixes that have no completed row yet."""

    def __init__(self, half: int):
        self.half, self.at = half, 0
        self.halves, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def advance(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the further windows of half the length: hashes of whole windows, and starts and periods of squares."""
        half = self.half
        halves = np.concatenate([self.halves, halves])
        whole = _joined(halves[:-half], halves[half:]) if len(halves) > half else np.zeros(0, np.uint64)
        self.halves = halves[-half:]
        rows = np.concatenate([self.rows, whole])
        full = len(rows) // half
        starts, periods = [], []
        if full >= 2:
            table = rows[: full * half].reshape(full, half)
            block, shift = np.nonzero(table[1:] == table[:-1, :1])
            starts.append(block * half)
            periods.append(shift + half)
        if full:  # suffixes of the row that is still filling
            shift = np.flatnonzero(rows[full * half :] == rows[(full - 1) * half])
            starts.append(np.full(len(shift), (full - 1) * half))
            periods.append(shift + half)
        starts = np.concatenate([*starts, np.zeros(0, np.int64)]) + self.at
        done = max(full - 1, 0) * half
        self.rows, self.at = rows[done:], self.at + done
        return whole, starts, np.concatenate([*periods, np.zeros(0, np.int64)])


class Catchers:
    """Catchers over one stream of word numbers, for runs within stretches of at most `longest` words."""

    def __init__(self, longest: int):
        self.words, self.n = np.zeros(1024, np.int64), 0
        self.levels = [_Level(1 << k) for k in range(max(longest // PERIODS, 1).bit_length())] if longest >= LEAST else []
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def append(self, words: np.ndarray) -> None:
        if self.n + len(words) > len(self.words):
            self.words = np.concatenate([self.words[: self.n], np.zeros(max(len(words), self.n), np.int64)])
        self.words[self.n : self.n + len(words)] = words
        self.n += len(words)
        hashes = words.astype(np.uint64)
        for level in self.levels:
            hashes, starts, periods = level.advance(hashes)
            if len(starts):
                self.squares.append((starts, periods))

    def runs(self) -> np.ndarray:
        """(start, length, period) of each run, by start, then period."""
        found: dict[tuple[int, int], int] = {}
        if self.squares:
            start, period = (np.concatenate(x) for x in zip(*self.squares, strict=True))
            order = np.lexsort((start, period))
            start, period = start[order], period[order]
            half = 1 << (np.frexp(period.astype(float))[1].astype(np.int64) - 1)
            end = start + 2 * half + period
            new = np.ones(len(start), bool)
            new[1:] = (period[1:] != period[:-1]) | (start[1:] > end[:-1] - period[1:])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            words = self.words[: self.n]
            for lo, hi, q, near in zip(start[first].tolist(), end[last].tolist(), period[first].tolist(), half[first].tolist(), strict=True):
                lo, hi = max(lo - near, 0), min(hi + near, self.n)
                same = np.concatenate([[False], words[lo : hi - q] == words[lo + q : hi], [False]])
                edge = np.flatnonzero(same[1:] != same[:-1])
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    # a stretch with a smaller period has the same ends, and smaller periods come first
                    if b - a + q >= max(LEAST, PERIODS * q):
                        found.setdefault((lo + a, lo + b + q), q)
        return np.array(sorted((a, b - a, q) for (a, b), q in found.items()), np.int64).reshape(-1, 3)


def runs_of(documents: list[list]) -> list[np.ndarray]:
    """The runs of each list of words, with starts counted from 0 in each."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    catch = Catchers(max(map(len, documents), default=0))
    waiting, held = [], 0
    for i, words in enumerate(documents):
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        waiting.append(np.append(ids, -1 - i))
        held += len(words) + 1
        if held >= SLICE:
            joined = np.concatenate(waiting)
            for at in range(0, len(joined), SLICE):
                catch.append(joined[at : at + SLICE])
            waiting, held = [], 0
    if waiting:
        catch.append(np.concatenate(waiting))
    runs = catch.runs()
    begin = np.cumsum([0, *[len(w) + 1 for w in documents]])
    cut = np.searchsorted(runs[:, 0], begin)
    return [runs[cut[i] : cut[i + 1]] - [begin[i], 0, 0] for i in range(len(documents))]


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words without those that a run holds behind its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): a document's runs by start, then period, and its kept words joined by one space."""

    def batch(ids: list, documents: list[list]) -> pa.RecordBatch:
        found = runs_of(documents)
        texts = [b" ".join(collapsed(w, r)) for w, r in zip(documents, found, strict=True)]
        every = np.concatenate([*found, np.zeros((0, 3), np.int64)])
        rows = pa.StructArray.from_arrays([pa.array(every[:, j]) for j in range(3)], fields=list(RUN))
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, rows), pa.array(texts, pa.binary())], names=["doc_id", "runs", "collapsed"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, documents, held = [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                # bytes are split at the six white spaces of ASCII, which are the separators of words here
                words = (b.column(1)[i].as_py() or b"").split()
                if ids and held + len(words) > GROUP:
                    yield batch(ids, documents)
                    ids, documents, held = [], [], 0
                ids.append(b.column(0)[i].as_py())
                documents.append(words)
                held += len(words)
        if ids:
            yield batch(ids, documents)

    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("binary").alias("text"))
    out = rows.mapInArrow(task, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def looped(doc_id: Column, text: Column) -> Column:
    """The text, of which a tenth (by crc32 of the id) loops from some word on with some period: known runs to find."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli (nulls without one), runs_sha256, collapsed_sha256."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.q")
    return out.select("doc_id", "n_runs", (-F.col("best.a")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
