"""Substring dedup by recompression.

Rounds rename a document's words: each maximal run of one symbol becomes a symbol (in the first round), then, round after round, each pair of a left and
a right symbol becomes one; a bit of a symbol's name and the round's number says which side it is on. A name is a hash of what it stands for, so it is the
same in every document and on every worker. Equal substrings get equal symbols but for the few at their ends that something outside may have paired with.
Those are known from the substring alone: a first symbol on the right side, a last one on the left side, and runs that touch an end.

So each 50-word window has a zone of symbols that depend on its words only. Its anchor is the longest symbol (of those the one with the least name) in
the zone of the highest round in which the zone isn't empty. These rounds run where a text is read, since a name needs nothing from elsewhere; the
rounds behind them are Spark's: the symbols that stand in one place alone are dropped over the whole corpus, and what is left is named again, globally,
by the symbol with its neighbours, in rounds: all words that the windows of a symbol cover, 41 words that 10 neighbouring windows share, then the
window's own 50 (see `repeats`). Those names are made of the words themselves, so equal windows are verified by them.

Defined results: a null, empty or blank text has no words; a text of fewer words than a window stays; words are runs of anything but the six blanks,
unchanged; rows that share an id are documents of their own, none earlier than another; a null id is kept as it is and is no document that others
repeat; an empty table gives no rows; further columns are not carried. Texts of any length are read in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .repeats import PIECE, Anchors, Kind, covered, grouped, repeated, with_runs

WINDOW = 50
ROUNDS = 4
_LOW = np.uint64(0xFFFFFFFF)


def _join_runs(names: np.ndarray, row: np.ndarray) -> np.ndarray:
    """First index of each maximal run of one name in one row."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (row[1:] != row[:-1])
    return np.flatnonzero(new)


def _left(names: np.ndarray, round_: int) -> np.ndarray:
    return (tb.mix(names ^ np.uint64(0xA5A5 + round_)) & np.uint64(1)).astype(bool)


def _longest(names: np.ndarray, length: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Index of the longest symbol in [begin, end), of those the least name, of those the first; end > begin."""
    rank = (np.uint64(63) - np.minimum(length, 63).astype(np.uint64)) << np.uint64(58)
    table = [rank | (tb.mix(names) >> np.uint64(6) & ~_LOW) | np.arange(len(names), dtype=np.uint64)]
    widest = int((end - begin).max())
    while 2 << len(table) - 1 <= widest:
        have = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-have], table[-1][have:]))
    power = np.frexp((end - begin).astype(float))[1] - 1
    out = np.empty(len(begin), np.uint64)
    for k in np.unique(power):
        at = power == k
        out[at] = np.minimum(table[k][begin[at]], table[k][end[at] - (1 << int(k))])
    return (out & _LOW).astype(np.int64)


def _round(names: np.ndarray, row: np.ndarray, left: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair each left symbol with a right one behind it: (first index of each new symbol, its name)."""
    pair = np.zeros(len(names), bool)
    pair[:-1] = left[:-1] & ~left[1:] & (row[:-1] == row[1:])
    second = np.zeros(len(names), bool)
    second[1:] = pair[:-1]
    starts = np.flatnonzero(~second)
    out, two = names[starts].copy(), pair[starts]
    with np.errstate(over="ignore"):
        out[two] = tb.mix(out[two] * np.uint64(0xD6E8FEB86659FD93) + tb.mix(names[starts[two] + 1]) + np.uint64(r))
    return starts, out


def _anchors(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, base: int, window: int = WINDOW, rounds: int = ROUNDS) -> Anchors:
    """The occurrences of a piece of which these are the words; its first word is word `base` of its row."""
    at = np.flatnonzero(row[: max(0, len(row) - window + 1)] == row[window - 1 :])  # first word of each window
    if not len(at):
        return Anchors.none()
    names = tb.word_hashes(data, start, end)
    begin, stop, live = at.copy(), at + window, np.arange(len(at))  # the zone of each window that has one, in symbols of the round
    place, symbol_row = np.arange(len(names)), row  # first word and row of each symbol
    anchor, key = np.empty(len(at), np.int64), np.empty(len(at), np.uint64)

    def settle(which: np.ndarray) -> None:
        """These windows have no zone in the next round."""
        if len(which):
            found = _longest(names, np.diff(np.append(place, len(row))), begin[which], stop[which])
            anchor[live[which]], key[live[which]] = place[found], names[found]

    for r in range(rounds + 1):
        if r == 0:  # runs: one that touches an end of the zone may go on outside it
            firsts = _join_runs(names, symbol_row)
            of = np.zeros(len(names), np.int64)
            of[firsts] = 1
            of = np.cumsum(of) - 1
            size = np.diff(np.append(firsts, len(names)))
            renamed, long = names[firsts].copy(), size > 1
            with np.errstate(over="ignore"):
                renamed[long] = tb.mix(renamed[long] + size[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            next_begin, next_stop = of[begin] + 1, of[stop - 1]
        else:  # pairs: a first symbol on the right side, or a last one on the left side, may pair with one outside
            left = _left(names, r)
            firsts, renamed = _round(names, symbol_row, left, r)
            of = np.zeros(len(names), np.int64)
            of[firsts] = 1
            of = np.cumsum(of) - 1
            inner, outer = begin + ~left[begin], stop - left[stop - 1]
            empty = inner >= outer
            next_begin = of[np.where(empty, begin, inner)]
            next_stop = np.where(empty, next_begin, of[np.where(empty, begin, outer - 1)] + 1)
        gone = next_begin >= next_stop
        settle(np.flatnonzero(gone))
        on = ~gone
        begin, stop, live = next_begin[on], next_stop[on], live[on]
        names, place, symbol_row = renamed, place[firsts], symbol_row[firsts]
        if not len(live):
            break
    settle(np.arange(len(live)))
    a, b = grouped(anchor, row[at])
    first, last = at[a], at[b]
    move = base - np.searchsorted(row, row[first])
    raw = data.tobytes()
    return Anchors(row[first], key[a], anchor[a] + move, first + move, last + move, lambda k: b" ".join(raw[start[first[k]] : end[last[k] + window - 1]].split()))


def _parts(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """A long text in pieces cut at blanks, each with the WINDOW - 1 words before it: (bytes, start, end and row of its words, number of the first)."""
    at, base, carried = 0, 0, data[:0]
    while at < len(data):
        stop = at + PIECE
        while stop < len(data) and not (gap := np.flatnonzero(tb.blanks(data[stop : stop + PIECE]))).size:
            stop += PIECE
        stop = stop + int(gap[0]) if stop < len(data) else len(data)
        piece = np.concatenate([carried, data[at:stop]])
        start, end, row = tb.words(piece, np.array([0, len(piece)]))
        yield piece, start, end, row, base
        keep = min(len(start), WINDOW - 1)
        carried, base, at = piece[start[len(start) - keep] :] if keep else data[:0], base + len(start) - keep, stop


def find(column: pa.Array) -> Iterator[tuple[int, Anchors]]:
    """Pieces of bounded size; a longer text comes in several."""
    for i, _, data, offsets in tb.slices(column, PIECE):
        if len(data) <= PIECE:
            yield i, _anchors(data, *tb.words(data, offsets), 0)
            continue
        for part in _parts(data):
            yield i, _anchors(*part)


def cut(units: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(units.cast("string"), " ", -1), start + 1, n), " ").cast("binary")


WORDS = Kind(find, cut, WINDOW, (10, 1), within=False)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, runs, copy) to (doc, n_words, n_removed, kept)."""
    for batch in batches:
        out = []
        for text, runs, copy in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            words = (text.as_py() or "").encode().split()
            n = len(words)
            if copy.as_py() and n >= WINDOW:
                out.append((n, n, ""))
            elif not runs.is_valid:
                out.append((n, 0, b" ".join(words).decode()))
            else:
                values = runs.values
                gone = covered(values.field("start").to_numpy(), values.field("n").to_numpy(), n, WINDOW)
                out.append((n, int(gone.sum()), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:2]], pa.array(columns[2], pa.string())], names=["doc", "n_words", "n_removed", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cleaned(batches):
        kept = pa.array([hashlib.sha256(x.as_py().encode()).hexdigest() for x in batch.column(3)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], kept], names=["doc", "n_words", "n_removed", "kept_sha256"])


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """A row for each row of df: doc, n_words, n_removed, and the remaining words (kept), or their SHA-256 if digest."""
    docs = df.select(df[doc_id].cast("long").alias("doc"), F.coalesce(df[text], F.lit("")).alias("text"))
    rows = with_runs(docs, *repeated(docs.where("doc IS NOT NULL"), WORDS))
    if digest:
        return rows.mapInArrow(_digest, "doc long, n_words long, n_removed long, kept_sha256 string")
    return rows.mapInArrow(_cleaned, "doc long, n_words long, n_removed long, kept string")
