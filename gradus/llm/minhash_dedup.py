"""MinHash near-dedup by an inverted join of signature coordinates.

A document is its set of five-word shingles (A-Z in lower case). Documents with equal sets collapse to one representative first. Each
representative posts itself under its K coordinate-value pairs. Two documents are candidates when at least `match` of K coordinates are equal:

* a document with fewer than `match` coordinates that anyone shares is skipped;
* the others order their shared coordinates from rare to common and keep the first (shared - match + 1): two documents with `match`
  equal coordinates have one of these in common (prefix), and common values, such as those of a passage that many documents hold, are posted only
  by documents that consist of them;
* documents that meet in a list are merged coordinate by coordinate, and those with too few equal ones are left out.

With similarity 0.75 and K = 64 a pair has 48 equal coordinates on average (standard deviation 3.5); `match` = 32 loses about 2 in a million.

What leaves a list is no set of all pairs but a spanning forest of its candidates, so a group of n near copies makes n edges. Edges are confirmed on
the full sets. Where a candidate group is not one component then, its documents outside its largest component are compared with all of the group on full sets, in
blocks (`regrouped`); that is the one step whose work grows with the square of a group, and no pair that isn't linked leaves it. So no link between different texts is lost, and nothing is sampled or capped.

Defined results: null, empty and blank texts have no shingles and link with nothing; fewer words than five are one shingle; rows that share an id
are one node, each linked by its own text; a null id is no node: component null, kept; an empty table gives no rows; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .blocks import large_groups
from .common import broadcast_if_small, saved
from .components import components

K = 64
MATCH = 32
SHINGLE = 5
SMALL = 12
CHUNK = 1024
SET_CHUNK = 64
_rng = np.random.default_rng(20_260_101)
_MULTIPLY = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, K, dtype=np.uint64)


def _sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, ordered by row and hash."""
    data = tb.lower_ascii(data)
    start, end, row = tb.words(data, offsets)
    hashes = tb.word_hashes(data, start, end)
    at = np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :])
    rows, values = [row[at]], [tb.sequences(hashes, at, n)]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    for size in range(1, n):
        few = np.flatnonzero(counts == size)
        rows.append(few)
        values.append(tb.sequences(hashes, np.searchsorted(row, few), size))
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def named(rows: np.ndarray, values: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, first and second hash) of each row's set: 128 bits and the size stand for the set."""
    size = np.bincount(rows, minlength=n_rows)
    sums = [np.zeros(n_rows, np.uint64) for _ in range(2)]
    has = np.flatnonzero(size)
    if len(has):
        first = np.concatenate([[0], np.cumsum(size[has])[:-1]])
        with np.errstate(over="ignore"):
            for i, salt in enumerate((0x51ED270B7A4F3C15, 0x2545F4914F6CDD1D)):
                sums[i][has] = np.add.reduceat(tb.mix(values ^ np.uint64(salt)), first)
    return size, *sums


def signatures(rows: np.ndarray, values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """K 32-bit coordinates of each row."""
    out = np.zeros((len(size), K), np.uint32)
    has = np.flatnonzero(size)
    if len(has):
        first = np.concatenate([[0], np.cumsum(size[has])[:-1]])
        with np.errstate(over="ignore"):
            for k in range(K):
                out[has, k] = tb.mix(np.minimum.reduceat(values * _MULTIPLY[k] + _ADD[k], first)) >> np.uint64(32)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in tb.slices(batch.column(1)):
            rows, values = _sets(data, offsets)
            size, a, b = named(rows, values, j - i)
            sig = signatures(rows, values, size)
            flat = pa.array(sig.view(np.int32).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * K + 1, K, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(size.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], names=["doc", "n", "a", "b", "sig"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (n, a, b, set): the name of a set as `_sign` gives it, and the set."""
    for batch in batches:
        for i, j, data, offsets in tb.slices(batch.column(0)):
            rows, values = _sets(data, offsets)
            size, a, b = named(rows, values, j - i)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), sets], names=["n", "a", "b", "set"])


def _forest(docs: np.ndarray, sig: np.ndarray, chunk: np.ndarray, cross: bool, match: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with `match` equal coordinates, best pairs first; between chunks only if cross."""
    n = len(docs)
    left = np.arange(n)
    best, parent, edges = np.zeros(n, int), np.full(n, -1), []
    while len(left):
        pick = left[np.argmax(best[left])]
        if best[pick] >= match:
            edges.append((int(docs[pick]), int(docs[parent[pick]])))
        left = left[left != pick]
        equal = (sig[left] == sig[pick]).sum(1)
        if cross:
            equal[chunk[left] == chunk[pick]] = 0
        better = equal > best[left]
        best[left[better]], parent[left[better]] = equal[better], pick
    return edges


def _list_edges(match: int):
    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc")
        found = _forest(rows["doc"].to_numpy(), np.stack(rows["sig"].to_numpy()), rows["chunk"].to_numpy(), bool(rows["lo"].iloc[0] != rows["hi"].iloc[0]), match)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return edges


def candidate_edges(lists: DataFrame, signed: DataFrame, match: int) -> DataFrame:
    """lists (key, doc), a doc once a key; signed (doc, sig): (a, b), a spanning forest of each list's candidates."""
    large = large_groups(lists, "key", SMALL)
    few = lists.join(large, "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("doc")).alias("docs")).where(F.size("docs") > 1).select("docs").distinct()
    few = few.select("docs", F.posexplode("docs").alias("i", "a")).select("a", F.explode(F.expr("slice(docs, i + 2, size(docs))")).alias("b")).distinct()
    one = few.join(signed.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a").join(signed.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b")
    equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    one = one.where(equal >= match).select("a", "b")
    many = lists.join(large, "key").withColumn("_chunks", F.ceil(F.col("_n") / F.lit(CHUNK)).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("_chunks")).cast("int"))
    many = many.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).join(signed, "doc")
    many = many.select("key", "doc", "sig", "chunk", F.least("chunk", "_o").alias("lo"), F.greatest("chunk", "_o").alias("hi"))
    return one.unionByName(many.groupBy("key", "lo", "hi").applyInPandas(_list_edges(match), "a long, b long"))


def _links_in(sets: list[np.ndarray], other: np.ndarray, ask: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (i, j) of `ask` rows i and any rows j, of different `other`, whose sets are alike enough."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    name = np.cumsum(new) - 1
    shared = np.bincount(name) > 1
    keep = shared[name]
    name, owner = (np.cumsum(shared) - 1)[name[keep]], owner[keep]
    both = np.zeros((n, n), np.float32)
    for first in range(0, int(shared.sum()), 8192):
        here = (name >= first) & (name < first + 8192)
        grid = np.zeros((n, 8192), np.float32)
        grid[owner[here], name[here] - first] = 1
        both += grid @ grid.T
    union = size[:, None] + size[None, :] - both
    good = (100 * both >= percent * union) & (other[:, None] != other[None, :]) & ask[:, None]
    return np.argwhere(good)


def _block_links(percent: int):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc")
        docs = rows["doc"].to_numpy()
        found = _links_in([np.asarray(s) for s in rows["set"]], rows["comp"].to_numpy(), ~rows["main"].to_numpy(bool), percent)
        return pd.DataFrame({"a": docs[found[:, 0]], "b": docs[found[:, 1]]}, dtype="int64").drop_duplicates()

    return links


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    pairs = edges.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def regrouped(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """groups (doc, key, comp), candidate groups `key` of several components: (a, b), all links in a group between documents of two components.

    What is in the largest component of a group is linked already, so the others are compared with all of the group, on full sets, a block of SET_CHUNK documents
    against a block: a task holds two blocks, and what leaves it are links. The copies of a set number the blocks that its document meets."""
    sizes = saved(groups.groupBy("key", "comp").agg(F.count("*").alias("n")), "minhash-sizes")
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("comps")).where("comps > 1")
    work = groups.join(main, "key").withColumn("main", F.col("comp") == F.col("top"))
    side = F.ceil((F.col("all") - F.col("most")) / F.lit(SET_CHUNK)).cast("int")
    core = F.ceil(F.col("most") / F.lit(SET_CHUNK)).cast("int")
    work = work.withColumn("own", F.when(F.col("main"), -1 - F.pmod(F.xxhash64("doc"), core)).otherwise(F.pmod(F.xxhash64("doc"), side)).cast("int"))
    # a row of the main component meets every side block; a row outside it meets all blocks
    meets = F.when(F.col("main"), F.sequence(F.lit(0), side - 1)).otherwise(F.sequence(-core, side - 1))
    work = work.withColumn("with", F.explode(meets)).select("doc", "comp", "main", "key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"))
    return work.join(sets, "doc").groupBy("key", "lo", "hi").applyInPandas(_block_links(percent), "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, match: int = MATCH) -> DataFrame:
    """A row for each row of df: doc_id, n_shingles, component_id (the smallest id that it reaches), kept."""
    docs = df.select(df[doc_id].cast("long").alias("doc"), df[text].alias("text"))
    signed = saved(docs.mapInArrow(_sign, "doc long, n long, a long, b long, sig array<int>"), "minhash-signatures")
    full = signed.where("n > 0 AND doc IS NOT NULL")
    # equal sets have one representative, with a number of its own: an id may stand on several rows
    groups = full.groupBy("n", "a", "b").agg(F.min("doc").alias("least"), F.first("sig").alias("sig"))
    groups = saved(groups.withColumn("rep", F.monotonically_increasing_id()), "minhash-groups")
    reps = groups.select(F.col("rep").alias("doc"), "sig")

    posts = reps.select("doc", F.posexplode("sig").alias("k", "v")).select("doc", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    # saved, so that both sides of the join are plain shuffles, of which Spark splits what is skewed
    shared = saved(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "minhash-shared")
    posts = posts.join(shared, "key")
    by_doc = Window.partitionBy("doc")
    prefix = posts.withColumn("rank", F.row_number().over(by_doc.orderBy("n", "key"))).withColumn("have", F.count("*").over(by_doc))
    prefix = saved(prefix.where(f"rank <= have - {match - 1}").select("doc", "key", "rank"), "minhash-postings")

    # the rarest coordinates first; lists that their groups already span need no second look
    first = saved(candidate_edges(prefix.where("rank <= 2").select("key", "doc"), reps, match), "minhash-candidates")
    group = saved(components(first), "minhash-known")
    known = prefix.join(group, prefix["doc"] == group["node"], "left").select("key", "doc", F.coalesce("component", "doc").alias("g"))
    mixed = saved(known.groupBy("key").agg((F.min("g") != F.max("g")).alias("mixed")).where("mixed").select("key"), "minhash-mixed")
    rest = known.join(mixed, "key").select("key", "doc")
    edges = saved(first.unionByName(candidate_edges(rest, reps, match)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "minhash-candidates")

    # confirm on full sets, which are cut from one text of each set
    name = ["n", "a", "b"]
    wanted = saved(edges.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(groups.select("rep", "least", *name), "rep"), "minhash-wanted")
    texts = docs.join(broadcast_if_small(wanted.select(F.col("least").alias("doc")).distinct()), "doc").select("text")
    sets = texts.mapInArrow(_full, "n long, a long, b long, set array<bigint>").join(wanted.select("rep", *name), name)
    sets = saved(sets.select(F.col("rep").alias("doc"), "set").dropDuplicates(["doc"]), "minhash-sets")
    links = saved(_confirmed(edges, sets, percent), "minhash-links")
    comp = saved(components(links), "minhash-components")

    # groups of candidates that confirmed links don't hold together: components joined by edges that were not confirmed
    ends = [comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    across = edges.join(links, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    group = saved(components(across), "minhash-candidate-groups")
    member = comp.join(group.select(F.col("node").alias("component"), F.col("component").alias("key")), "component").select(F.col("node").alias("doc"), "key", F.col("component").alias("comp"))
    alone = group.join(comp, "node", "left_anti").select(F.col("node").alias("doc"), F.col("component").alias("key"), F.col("node").alias("comp"))
    more = saved(regrouped(saved(member.unionByName(alone), "minhash-apart"), sets, percent), "minhash-more")

    # an id that stands on several rows is one node, whatever its sets
    owner = full.select("doc", *name).join(groups.select("rep", *name), name).select("doc", "rep").distinct()
    several = saved(owner.groupBy("doc").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b < most").select("doc", "b"), "minhash-shared-ids")
    beside = more.unionByName(owner.join(several, "doc").select(F.col("rep").alias("a"), "b")).join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = saved(components(beside), "minhash-joined").select(F.col("node").alias("component"), F.col("component").alias("top"))
    lone = top.select(F.col("component").alias("node"), F.col("component")).join(comp.select("node"), "node", "left_anti")
    final = comp.unionByName(lone).join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    reach = groups.select("rep", "least", *name).join(final, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep"))
    reach = reach.join(reach.groupBy("c").agg(F.min("least").alias("component_id")), "c").select(*name, "component_id")
    # a row without a set goes with the other rows of its id
    out = signed.where("doc IS NOT NULL").select("doc", *name).join(saved(reach, "minhash-reach"), name, "left")
    per_id = saved(out.groupBy("doc").agg(F.min(F.coalesce("component_id", "doc")).alias("component_id")), "minhash-ids")
    out = signed.select("doc", "n").join(per_id, "doc", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))
