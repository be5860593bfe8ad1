"""Spelling variants: words one inserted, deleted or replaced letter apart, found in a trie of letter counts.

The letters of the corpus are dealt into groups of like frequency. A word's vector counts its letters in each group; the trie arranges words by these counts,
one level a count. One edit adds at most one to a count (the surplus) and takes at most one from another (the
deficit), so a search that goes down the trie with its own count, with one more (once) and with one less (once) meets every near word. Of two words of
one length the search starts at the one whose surplus comes first, of two lengths at the shorter, so each pair is met once.

The upper levels of the trie are dealt out by Spark: as many as it takes until no node holds more than `node_words` words. A word goes to its own node and, with its budget spent in
the upper levels, to each node that it could reach: at most 1 + D + D * (D - 1) / 2 rows for D levels. If even all levels leave more, each letter
is a group. Below, each node is searched depth first in its own task with all words that came to it. At a leaf (few words, or no count left) two words are compared only if their first or last halves agree, and then letter by letter.

Counts of words are summed on the map side before they are shuffled, so frequent words cost no more than others. Forms are followed to their ends by pointer doubling: a form
is twice as frequent as its word, so chains are short and have no cycles.

Defined results: null and empty texts have no words, an id of null deletes no letter, repeated rows count again, ties between forms go to the word that
comes first in code-point order, an empty table gives no rows. A very long text is one array of its runs while they are counted. Of the input only the id and the text are read, whatever else it holds.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Letters of a word, fixed by the operator's contract: at most 116 different ones.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Groups of letters, and words of a leaf.
GROUPS, LEAF = 12, 24
#: Cells of the comparisons that a leaf makes at a time.
CELLS = 1 << 22


def words_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text", thinned: int = 97) -> DataFrame:
    """(word) of every run of letters, A to Z in lower case; of one run in `thinned`, by crc32 of its id and word, one letter is deleted."""
    run = F.col("run")
    # `lower` knows A to Z alone where all letters are of one byte
    low = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, string.ascii_uppercase, string.ascii_lowercase))
    runs = df.select(df[doc_id].cast("string").alias("id"), F.explode(F.regexp_extract_all(df[text], F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select("id", low.alias("low")).select("id", "low", F.crc32(F.concat("id", F.lit(":"), "low").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("low")).cast("int")
    cut = F.concat(F.substring("low", F.lit(1), at), F.substring("low", at + 2, F.length("low")))
    return runs.select(F.when(F.col("h") % thinned == 0, cut).otherwise(F.col("low")).alias("word"))


def letter_groups(words: DataFrame) -> list[str]:
    """All letters of the words, dealt into at most GROUPS groups of like frequency; the different letters are few and are collected."""
    n = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    groups: list[list] = [[0, i, ""] for i in range(min(GROUPS, len(n)))]
    for r in sorted(n, key=lambda r: (-r["count"], r["c"])):
        least = min(groups)
        least[0] += r["count"]
        least[2] += r["c"]
    return [g[2] for g in groups]


def counts(word: Column, groups: list[str]) -> Column:
    """How many letters of each group the word has."""
    return F.array(*[F.length(word) - F.length(F.translate(word, g, "")) for g in groups])


def dealt_levels(vectors: DataFrame, levels: int, node_words: int) -> int:
    """The number of upper levels from which on no node holds more than node_words words; all of them if there is none."""
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda d: F.struct(d.alias("d"), F.slice("v", F.lit(1), d).alias("p")))).alias("x")
    largest = vectors.groupBy("v").agg(F.count("*").alias("n")).select(prefix, "n").groupBy("x.d", "x.p").agg(F.sum("n").alias("n")).groupBy("d").agg(F.max("n").alias("n"))
    return min((r["d"] for r in largest.collect() if r["n"] <= node_words), default=levels)


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with one letter replaced, or inserted."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


class Node:
    """Words below one node of the trie, and the words that came to search it with what is left of their budget."""

    #: What a search has spent: nothing, its surplus, both.
    WHOLE, SURPLUS, BOTH = 0, 1, 2

    def __init__(self, word: list[str], vector: np.ndarray, state: np.ndarray, level: int):
        self.word, self.vector, self.level = word, vector, level
        self.length = np.array([len(w) for w in word])
        # hashes of a word's first and last half, and of those of the word that lacks one letter of the other half
        half = lambda f: np.array([hash(f(w)) for w in word], np.int64)
        self.first, self.last = half(lambda w: w[: len(w) // 2]), half(lambda w: w[len(w) // 2 :])
        self.first_less, self.last_less = half(lambda w: w[: (len(w) - 1) // 2]), half(lambda w: w[(len(w) - 1) // 2 + 1 :])
        self.own = np.flatnonzero(state == self.WHOLE)
        self.state = state

    def pairs(self) -> Iterator[tuple[int, int]]:
        yield from self._search(self.own, np.arange(len(self.word)), self.state, self.level)

    def _search(self, own: np.ndarray, seekers: np.ndarray, state: np.ndarray, level: int) -> Iterator[tuple[int, int]]:
        if not len(own) or not len(seekers):
            return
        if len(own) <= LEAF or level == self.vector.shape[1]:
            yield from self._leaf(own, seekers, state)
            return
        here, theirs = self.vector[own, level], self.vector[seekers, level]
        for c in np.unique(here):
            stay, more, less = theirs == c, (theirs + 1 == c) & (state == self.WHOLE), (theirs - 1 == c) & (state == self.SURPLUS)
            go = np.concatenate([seekers[stay], seekers[more], seekers[less]])
            spent = np.concatenate([state[stay], np.full(more.sum(), self.SURPLUS), np.full(less.sum(), self.BOTH)])
            yield from self._search(own[here == c], go, spent, level + 1)

    def _leaf(self, own: np.ndarray, seekers: np.ndarray, state: np.ndarray) -> Iterator[tuple[int, int]]:
        step = max(CELLS // len(own), 1)
        for at in range(0, len(seekers), step):
            s, spent = seekers[at : at + step, None], state[at : at + step, None]
            equal = (self.length[s] == self.length[own]) & ((self.first[s] == self.first[own]) | (self.last[s] == self.last[own]))
            longer = (self.length[s] + 1 == self.length[own]) & ((self.first[s] == self.first_less[own]) | (self.last[s] == self.last_less[own])) & (spent != self.BOTH)
            for i, j in zip(*np.nonzero(equal | longer), strict=True):
                a, b = int(s[i, 0]), int(own[j])
                # words of one node and one length see each other
                if (spent[i, 0] != self.WHOLE or self.length[a] != self.length[b] or self.word[a] < self.word[b]) and one_edit(self.word[a], self.word[b]):
                    yield a, b


def near_words(words: DataFrame, node_words: int = 1_000) -> DataFrame:
    """(a, n_a, b, n_b) of each pair of near words, once, from rows (word, n) of different words, which are read several times."""
    groups = letter_groups(words)
    schema = "a string, n_a long, b string, n_b long"
    if not groups:
        return words.sparkSession.createDataFrame([], schema)
    vectors = words.select("word", "n", counts(F.col("word"), groups).alias("v"))
    depth = dealt_levels(vectors, len(groups), node_words)
    if depth == len(groups):
        # too many words with the same counts: a level for each letter
        groups = sorted("".join(groups))
        vectors = words.select("word", "n", counts(F.col("word"), groups).alias("v"))
        depth = dealt_levels(vectors, len(groups), node_words)
    spends = [(-1, -1, Node.WHOLE)] + [(i, -1, Node.SURPLUS) for i in range(depth)] + [(i, j, Node.BOTH) for i in range(depth) for j in range(i + 1, depth)]
    spend = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("state")) for i, j, k in spends])).alias("s")
    sent = vectors.select("word", "n", "v", spend).where((F.col("s.j") < 0) | (F.get("v", F.col("s.j")) > 0))
    node = F.transform(F.slice("v", F.lit(1), F.lit(depth)), lambda x, k: x + (k == F.col("s.i")).cast("int") - (k == F.col("s.j")).cast("int"))
    sent = sent.select(node.alias("node"), "word", "n", "v", F.col("s.state").alias("state"))
    # where no word lives the search ends; the join deals out by node, as the groups need it
    lived = vectors.select(F.slice("v", F.lit(1), F.lit(depth)).alias("node")).distinct()
    sent = sent.join(lived.hint("shuffle_merge"), "node", "left_semi")

    def search(rows: pa.Table) -> pa.Table:
        word, n, state = rows["word"].to_pylist(), rows["n"].to_numpy(), rows["state"].to_numpy()
        vector = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(word), -1)
        found = np.array(list(Node(word, vector, state, depth).pairs()), np.int64).reshape(-1, 2)
        a, b = found[:, 0], found[:, 1]
        return pa.table({"a": pa.array([word[i] for i in a], pa.string()), "n_a": n[a], "b": pa.array([word[i] for i in b], pa.string()), "n_b": n[b]})

    return sent.groupBy("node").applyInArrow(search, schema)


def followed(links: DataFrame) -> DataFrame:
    """(word, root) from rows (word, form): the last word that forms lead to. Each round doubles the steps taken."""
    roots = saved(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = saved(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return roots


def variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, thinned: int = 97) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least least_length letters that stands least_count times in the texts."""
    long_enough = words_of(df, doc_id, text, thinned).where(F.length("word") >= least_length)
    words = saved(long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count), "spelling-words")
    pairs = saved(near_words(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word")).alias("near"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("word")).alias("near")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    out = words.join(best, "word", "left")
    enough = -F.col("best.less") >= 2 * F.col("n")
    out = out.select("word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n"))
    out = saved(out, "spelling-forms")
    roots = followed(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
