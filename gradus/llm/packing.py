"""Harmonic packing of token ids into sequences of a fixed capacity.

A document whose length lies in (capacity / (k + 1), capacity / k] is of class k, and each sequence of class k takes k whole documents; the
documents of `CLASSES` or more to a sequence are one class, which takes them as long as the next fits. What a full sequence lacks to its capacity is
filled by cutting: one document at a time gives its ids away, piece by piece, and when it is used up the next that arrives takes its place. So most
documents stay whole, and no sequence of a class needs padding. A document longer than the capacity is cut into whole capacities first, and what is left of it is packed
as a document.

Every task fills its classes alone, in one pass over its rows and without a shuffle; what is open at its end (fewer than k documents in each of the classes) is put
one behind the other and cut into sequences of the capacity and, for the last, powers of two, which need no padding either. A task holds the ids of
CLASSES + 2 sequences and of one document at any time.

sequence_id holds the task's partition in its upper bits, so a task that is run again gives the same rows.

Defined results: a null or empty text is its closing id alone; repeated rows are packed as documents of their own; an
empty table gives no rows. Further columns of the input are not carried. class_k is a sequence's class, 0 for what was open at a task's end.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *[T.StructField(n, T.LongType(), False) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class_k")],
])
#: Classes of a fixed number of documents, and one for all shorter documents.
CLASSES = 32
_loaded: dict[str, object] = {}
_SPACES = re.compile(r"\s\s")


class Encoder:
    """Ids of a byte-level vocabulary, as `tokenizers` gives them with add_special_tokens=False.

    Where the same vocabulary lies beside the file as ranks, `tiktoken` encodes texts that hold no special token: it gives the
    same ids several times faster. Without two white spaces in a row the lookahead of the public pattern changes nothing, and the
    pattern without it is faster again."""

    def __init__(self, path: str):
        self.path, self.exact = path, None
        import public_tokenizers
        import tiktoken

        ranks_path = Path(path).with_suffix(".tiktoken")
        self.special = None
        self.fast = None
        if ranks_path.exists():
            lines = (line.split() for line in ranks_path.read_bytes().splitlines())
            ranks = {base64.b64decode(a): int(b) for a, b in lines}
            pattern = public_tokenizers.PATTERN
            plain = pattern.replace(r"\s+(?!\S)|", "")
            self.fast = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.fastest = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens={}) if plain != pattern else self.fast

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or "<|" in text:
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return self.exact.encode(text, add_special_tokens=False).ids
        return (self.fast if _SPACES.search(text) else self.fastest).encode_ordinary(text)


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Piece(NamedTuple):
    name: int | None
    start: int
    length: int
    raw: memoryview  # the document's ids, 4 bytes each
    tokens: int

    def part(self, at: int, n: int) -> Piece:
        return self._replace(start=self.start + at, length=n)

    def row(self, sequence: int, offset: int, k: int) -> tuple:
        return (self.name, self.start, self.length, zlib.crc32(self.raw[4 * self.start : 4 * (self.start + self.length)]), self.tokens, sequence, offset, k)


class Bins:
    """The open sequence of each class, the document that fills up closed ones, and closed ones that wait for such a document."""

    def __init__(self, capacity: int, first: int, classes: int = CLASSES):
        self.capacity, self.next, self.classes = capacity, first, classes
        self.open: dict[int, list[Piece]] = {}
        self.waiting: list[tuple[int, list[Piece]]] = []
        self.filler: Piece | None = None

    def _rows(self, pieces: list[Piece], k: int) -> Iterator[tuple]:
        at = 0
        for p in pieces:
            yield p.row(self.next, at, k)
            at += p.length
        self.next += 1

    def _fill(self) -> Iterator[tuple]:
        """Give the closed sequences what they lack from the filling document, as far as it goes."""
        while self.waiting:
            k, pieces = self.waiting[0]
            lack = self.capacity - sum(p.length for p in pieces)
            if lack and self.filler is None:
                return
            if lack:
                n = min(lack, self.filler.length)
                pieces.append(self.filler.part(0, n))
                self.filler = self.filler.part(n, self.filler.length - n) if n < self.filler.length else None
            if lack == 0 or n == lack:
                self.waiting.pop(0)
                yield from self._rows(pieces, k)

    def _close(self, k: int) -> Iterator[tuple]:
        self.waiting.append((k, self.open.pop(k)))
        yield from self._fill()

    def add(self, document: Piece) -> Iterator[tuple]:
        while document.length >= self.capacity:
            yield from self._rows([document.part(0, self.capacity)], 1)
            document = document.part(self.capacity, document.length - self.capacity)
        if not document.length:
            return
        if self.filler is None:
            self.filler = document
            yield from self._fill()
            return
        k = min(self.capacity // document.length, self.classes)
        if k == self.classes and sum(p.length for p in self.open.get(k, [])) + document.length > self.capacity:
            yield from self._close(k)
        self.open.setdefault(k, []).append(document)
        if k < self.classes and len(self.open[k]) == k:
            yield from self._close(k)

    def rest(self) -> Iterator[tuple]:
        """What is open at the end, one behind the other: whole sequences, then falling powers of two."""
        left = [p for _, pieces in [*self.waiting, *sorted(self.open.items())] for p in pieces] + ([self.filler] if self.filler else [])
        self.open, self.waiting, self.filler = {}, [], None
        total = sum(p.length for p in left)
        while total:
            room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= room
            pieces = []
            while room:
                n = min(room, left[0].length)
                pieces.append(left[0].part(0, n))
                left[0] = left[0].part(n, left[0].length - n)
                if not left[0].length:
                    left.pop(0)
                room -= n
            yield from self._rows(pieces, 0)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(PIECE)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECE.names)


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class_k. capacity is a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = str(public_tokenizers.path("byte_bpe_50k.json"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        out: list[tuple] = []
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                tokens = np.array([*encode(texts[i].as_py() or ""), end_id], dtype="<u4")
                raw, n, name = memoryview(tokens.tobytes()), len(tokens), ids[i].as_py()
                out.extend(bins.add(Piece(name, 0, n, raw, n)))
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
        yield _batch([*out, *bins.rest()])

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(task, PIECE)
