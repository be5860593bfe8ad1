"""Byte-pair encoding and decoding of whole texts with an index of pairs.

A task splits its texts into the pieces that merges never cross and gathers the pieces that it has not encoded yet. Their symbols lie in one array, and an index maps
each pair that has a rank to all its positions there. The active ranks are applied from the lowest on: all positions of a pair are merged at once, and
the pairs that a merge makes with its neighbours enter the lists of their ranks. A position whose symbols have changed since it was listed is passed over. A merge
makes only pairs of higher rank (checked when a vocabulary is read), so this gives what merging piece by piece gives.

A task holds the texts of one batch, at most `KNOWN` encoded pieces (what was encoded is forgotten beyond, and encoded again) and 40 bytes for each byte of new
pieces, of at most `FRESH` bytes of pieces at a time, or of one piece if that is longer. A very long text is one row and is encoded whole. No rows are shuffled.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows give a row each; an empty table gives no rows. Strings of added
tokens, such as an end of text, are that token's id wherever they stand. Of the input only the id and the text are read, whatever else it holds.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoded pieces that a task keeps, and bytes of new pieces that are encoded together.
KNOWN, FRESH = 500_000, 1 << 22
# White space as the libraries take it, which leaves out the separators U+001C to U+001F.
_SPACE = r"\t-\r\x20\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The public pattern of byte-level vocabularies.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself, or the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level vocabulary file: ids of bytes, pairs by rank, bytes of tokens, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has added tokens that depend on what surrounds them")
        alphabet, ids = _byte_alphabet(), model["vocab"]
        self.size = 1 + max([*ids.values(), *[t["id"] for t in added]])
        self.tokens = [b""] * self.size
        for token, i in ids.items():
            self.tokens[i] = bytes(map(alphabet.__getitem__, token))
        self.added = {t["content"]: t["id"] for t in added}
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right, self.merged = (np.array([ids[x] for x in part], np.int64) for part in (*zip(*pairs, strict=True), ["".join(p) for p in pairs]))
        made = np.full(self.size, -1)
        made[self.merged] = np.arange(len(pairs))
        if len(set(self.merged.tolist())) < len(pairs) or (np.maximum(made[self.left], made[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path} has merges that make pairs of lower rank")
        keys = self._key(self.left, self.right)
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left * (self.size + 2) + right + 2  # two places for what is no symbol

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where a pair has none."""
        key = self._key(left, right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def split(self, text: str) -> list[str | int]:
        """Pieces of the text; an added token is its id."""
        if self.specials is None or not self.specials.search(text):
            return self.pieces.findall(text)
        out: list[str | int] = []
        for i, part in enumerate(self.specials.split(text)):
            out.extend([self.added[part]] if i % 2 else self.pieces.findall(part))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; unknown ones are left out, and bytes that are no UTF-8 become U+FFFD."""
        if len(ids) and ids.max() >= self.size:
            ids = ids[ids < self.size]
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Symbols of many pieces, and the positions of each pair by its rank."""

    END, GONE = -1, -2

    def __init__(self, vocab: Vocabulary, pieces: list[bytes]):
        self.vocab = vocab
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        n = self.n = int(self.sizes.sum())
        self.symbol = np.append(vocab.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], self.END)
        self.next, self.previous = np.arange(1, n + 2), np.arange(-1, n)
        self.ends = np.cumsum(self.sizes)
        self.next[self.ends[self.sizes > 0] - 1] = n
        self.previous[(self.ends - self.sizes)[self.sizes > 0]] = n
        self.positions: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._enter(np.arange(n))

    def _enter(self, at: np.ndarray) -> None:
        """List the pairs that begin at these positions."""
        rank = self.vocab.rank(self.symbol[at], self.symbol[self.next[at]])
        order = np.argsort(rank, kind="stable")
        order = order[np.searchsorted(rank, 0, sorter=order) :]
        if not len(order):
            return
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
            if r not in self.positions:
                self.positions[r] = []
                heapq.heappush(self.active, r)
            self.positions[r].append(part)

    def _merge(self, r: int) -> None:
        at = np.unique(np.concatenate(self.positions.pop(r)))
        left, right = self.vocab.left[r], self.vocab.right[r]
        second = self.next[at]
        holds = (self.symbol[at] == left) & (self.symbol[second] == right)
        at, second = at[holds], second[holds]
        if left == right and len(at):
            # of pairs that overlap, the first, third, ... of a chain
            i = np.arange(len(at))
            head = np.append(True, at[1:] != second[:-1])
            first = (i - np.maximum.accumulate(np.where(head, i, 0))) % 2 == 0
            at, second = at[first], second[first]
        after = self.next[second]
        self.symbol[at], self.symbol[second] = self.vocab.merged[r], self.GONE
        self.next[at], self.previous[after] = after, at
        before = self.previous[at]
        self._enter(np.unique(np.concatenate([before[before < self.n], at])))

    def encode(self) -> list[bytes]:
        """Each piece's ids, 4 bytes each, lowest first."""
        while self.active:
            self._merge(heapq.heappop(self.active))
        stays = self.symbol[: self.n] >= 0
        raw = self.symbol[: self.n][stays].astype("<u4").tobytes()
        ends = np.append(0, np.cumsum(stays))[self.ends] * 4
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    """Encodes texts a batch at a time and remembers the pieces it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known = vocab, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self.vocab.split(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known = {}
        known = self.known
        for i in self.vocab.added.values():
            known[i] = np.array([i], "<u4").tobytes()
        fresh, size = [], 0
        for piece in {p for pieces in split for p in pieces if p not in known}:
            fresh.append(piece)
            size += len(piece)
            if size >= FRESH:
                self._learn(fresh)
                fresh, size = [], 0
        self._learn(fresh)
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def _learn(self, pieces: list[str]) -> None:
        if pieces:
            self.known.update(zip(pieces, PairIndex(self.vocab, [p.encode() for p in pieces]).encode(), strict=True))


def _path(tokenizer_path: str | None) -> str:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenizer_path


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, chars: int = 1 << 21) -> DataFrame:
    """(doc_id, ids): the ids of each text as unsigned 32-bit integers, lowest byte first, in one binary value. Texts of some `chars` characters are encoded together."""
    path = _path(tokenizer_path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))

        def batch(ids: list, texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(encoder(texts), pa.binary())], names=["doc_id", "ids"])

        ids, texts, held = [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                ids.append(b.column(0)[i].as_py())
                texts.append((b.column(1)[i].as_py() or b"").decode("utf-8", "replace"))
                held += len(texts[-1])
                if held >= chars:
                    yield batch(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield batch(ids, texts)

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("binary").alias("text")).mapInArrow(task, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) from rows (doc_id, ids)."""
    path = _path(tokenizer_path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            texts = [vocab.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows (doc_id, ids, text)."""
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
