"""Suffix dedup by a depth-limited radix sort.

A suffix counts as far as its first `LENGTH` bytes. Passes sort by the most significant digit first, and what has no equal after a pass goes no
further; what is equal after the last is exactly the repeated windows (see `repeats`). A suffix's first digit is its least `DIGIT`-byte string
(by hash) rather than its first bytes: equal suffixes have it in common at the same place, and some 31 neighbouring suffixes share one, so the first pass
moves one row for all of them. The next digits grow from there to both sides: 86 bytes that 15 neighbouring suffixes share, then the suffix's own 100 bytes.

Defined results: a null text is empty; a text shorter than LENGTH has no window and stays; equal texts of LENGTH bytes or more go wholly but for the
lowest id; rows that share an id are documents of their own, none earlier than another; rows that share an id and a text get the same result; a null id
is kept as it is and is no document that others repeat; an empty table gives no rows; further columns are not carried. Texts of any length are read
in pieces of bounded size.
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

LENGTH = 100
DIGIT = 32
_LOW = np.uint64(0xFFFFFFFF)


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` consecutive values, the first of equals."""
    m = (values & ~_LOW) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return (m & _LOW).astype(np.int64)


def _anchors(data: np.ndarray, offsets: np.ndarray, base: int, length: int = LENGTH, digit: int = DIGIT) -> Anchors:
    """The occurrences of a piece whose first byte is byte `base` of its row."""
    n = len(data)
    if n < length:
        return Anchors.none()
    sums = tb.prefix(data)
    at = np.arange(n - digit + 1)
    digits = tb.span(sums, at, at + digit)
    anchor = least_in_windows(digits, length - digit + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
    anchor, row = anchor[inside], row[inside]
    a, b = grouped(anchor, row)
    first, last, row, anchor = inside[a], inside[b], row[a], anchor[a]
    move = base - offsets[row]
    raw = data.tobytes()
    return Anchors(row, digits[anchor], anchor + move, first + move, last + move, lambda k: raw[first[k] : last[k] + length])


def find(column: pa.Array) -> Iterator[tuple[int, Anchors]]:
    """Pieces of bounded size; a longer text comes in several, each with the bytes that its last windows need of the next."""
    for i, _, data, offsets in tb.slices(column, PIECE):
        if len(data) <= PIECE:
            yield i, _anchors(data, offsets, 0)
            continue
        for base in range(0, len(data) - LENGTH + 1, PIECE):
            part = data[base : base + PIECE + LENGTH - 1]
            yield i, _anchors(part, np.array([0, len(part)]), base)


def cut(units: Column, start: Column, n: Column) -> Column:
    return F.substring(units, start + 1, n)


BYTES = Kind(find, cut, LENGTH, (15, 1), within=True)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, runs, copy) to (doc, n_bytes, n_removed, n_spans, kept)."""
    for batch in batches:
        out = []
        for text, runs, copy in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            raw = (text.as_py() or "").encode()
            n = len(raw)
            if copy.as_py() and n >= LENGTH:
                out.append((n, n, 1, b""))
            elif not runs.is_valid:
                out.append((n, 0, 0, raw))
            else:
                values = runs.values
                gone = covered(values.field("start").to_numpy(), values.field("n").to_numpy(), n, LENGTH)
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((n, int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cleaned(batches):
        kept = pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in batch.column(4)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], kept], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """A row for each row of df: doc, n_bytes, n_removed, n_spans, and the remaining bytes (kept), or their SHA-256 if digest."""
    docs = df.select(df[doc_id].cast("long").alias("doc"), F.coalesce(df[text], F.lit("")).alias("text"))
    rows = with_runs(docs, *repeated(docs.where("doc IS NOT NULL"), BYTES))
    if digest:
        return rows.mapInArrow(_digest, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return rows.mapInArrow(_cleaned, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
