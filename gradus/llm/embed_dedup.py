"""Embedding near-dedup: sign hashes of random hyperplanes in several tables, exact cosine, distributed components.

Vectors are compared only where labels are equal. Equal vectors of one label collapse to one representative with a count. A table hashes a vector
to the signs of `bits` random projections; vectors that meet in a bucket of any table are compared exactly, in double precision. bits grows
with the logarithm of the rows of the largest label, so buckets stay small, and the number of tables follows from bits, so that a pair at the
threshold is missed by all tables with probability `miss` at most.

A pair is counted in the first table where both meet, so no pair counts twice. Buckets are compared inside tasks, a chunk against a chunk; a task
returns a row for each vector (its number of links there, and the least vector of its component there), never a row for each pair.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with nothing; vectors of different
lengths link with nothing; rows that share an id are vectors of their own and one node; a null id has a null component and is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components

CHUNK = 512
MISS = 1e-6


def plan(rows: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for labels of at most `rows` vectors."""
    bits = max(8, min(24, math.ceil(math.log2(max(rows, 2)))))
    agree = (1 - math.acos(min(cosine, 1.0)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def _signer(bits: int, tables: int):
    """Buckets of a batch of vectors: a list of one 32-bit value for each table."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(bits, dtype=np.int64)
        for rows in batches:
            lengths = rows["v"].map(len).to_numpy()
            out = np.empty(len(rows), object)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                if d not in planes:
                    planes[d] = np.random.default_rng(7_000 + int(d)).standard_normal((int(d), bits * tables))
                x = np.stack(rows["v"].iloc[at].to_numpy()).astype(float)
                signs = ((x @ planes[d]) > 0).reshape(len(at), tables, bits) @ weight
                for i, s in zip(at, signs, strict=True):
                    out[i] = s.astype(np.int32)
            yield rows.assign(buckets=out)

    return sign


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class _Bucket:
    """Links inside one chunk pair of one bucket, and what they say of each vector."""

    def __init__(self, cosine: float):
        self.cosine = cosine

    def links(self, rows: pd.DataFrame) -> list[tuple[int, int, int]]:
        ids, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        n, t = len(ids), int(rows["t"].iloc[0])
        cross = rows["lo"].iloc[0] != rows["hi"].iloc[0]
        chunk, sigs = rows["chunk"].to_numpy(), np.stack(rows["buckets"].to_numpy())
        x = _unit(rows["v"])
        count, root = np.zeros(n, np.int64), np.arange(n)
        linked = np.zeros((n, n), bool)
        for i in range(0, n, 256):
            near = x[i : i + 256] @ x.T >= self.cosine
            if t:
                near &= ~(sigs[i : i + 256, None, :t] == sigs[None, :, :t]).any(2)
            linked[i : i + 256] = near
        np.fill_diagonal(linked, False)
        linked |= linked.T
        if cross:
            linked &= chunk[:, None] != chunk[None, :]
        count = linked @ copies
        some = np.flatnonzero(linked.any(1))
        changed = len(some) > 0
        while changed:  # the least member of each component
            least = np.array([min(root[i], root[linked[i]].min()) for i in some])
            changed = bool((least != root[some]).any())
            root[some] = least
        return [(int(ids[i]), int(ids[root[i]]), int(count[i])) for i in some]


def _walk(cosine: float):
    """Over a partition sorted by bucket: the links of each bucket as it ends."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held = _Bucket(cosine), None
        key = ["label", "d", "t", "bucket", "lo", "hi"]

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            change = (rows[key] != rows[key].shift()).any(axis=1).to_numpy()
            first = np.flatnonzero(change)
            out = []
            for i, j in zip(first, [*first[1:], len(rows)], strict=True):
                if j - i > 1:
                    out += bucket.links(rows.iloc[i:j].sort_values("rep", ignore_index=True))
            return pd.DataFrame(out, columns=["rep", "least", "links"], dtype="int64")

        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[key] == rows[key].iloc[-1]).all(axis=1).to_numpy()
            cut = len(rows) - int(last[::-1].argmin()) if not last.all() else 0
            held = rows.iloc[cut:]
            if cut:
                yield done(rows.iloc[:cut])
        if held is not None:
            yield done(held)

    return walk


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """A row for each row of df: vec_id, n_links, component_id, kept."""
    rows = df.select(df[vec_id].cast("long").alias("id"), df[label].alias("label"), F.transform(df[vector], lambda x: x.cast("double")).alias("v"))
    fine = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = saved(rows.withColumn("fine", F.coalesce(F.col("label").isNotNull() & fine & F.col("id").isNotNull(), F.lit(False))), "embed-rows")
    # -0.0 and 0.0 are one value
    good = rows.where("fine").withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    groups = good.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # an id may stand on several rows, so a representative has a number of its own
    groups = saved(groups.withColumn("rep", F.monotonically_increasing_id()), "embed-groups")
    bits, tables = plan(groups.groupBy("label").count().agg(F.max("count")).first()[0] or 0, cosine)
    shape = "rep long, label string, copies long, v array<double>, buckets array<int>"
    signed = saved(groups.select("rep", F.col("label").cast("string").alias("label"), "copies", "v").mapInPandas(_signer(bits, tables), shape).withColumn("d", F.size("v")), "embed-signed")
    posts = signed.select("rep", "label", "d", F.posexplode("buckets").alias("t", "bucket"))
    counts = posts.groupBy("label", "d", "t", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    posts = posts.join(counts, ["label", "d", "t", "bucket"]).withColumn("chunks", F.ceil(F.col("n") / F.lit(CHUNK)).cast("int"))
    posts = posts.withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    posts = posts.withColumn("lo", F.least("chunk", "o")).withColumn("hi", F.greatest("chunk", "o")).drop("chunks", "n", "o")
    met = posts.join(signed.select("rep", "copies", "v", "buckets"), "rep")
    key = ["label", "d", "t", "bucket", "lo", "hi"]
    found = met.repartition(*key).sortWithinPartitions(*key).mapInPandas(_walk(cosine), "rep long, least long, links long")
    found = saved(found, "embed-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("others"))
    # components over ids, so that rows which share an id hold together
    ids = groups.select("rep", "least")
    named = found.join(ids.withColumnRenamed("least", "a"), "rep").join(ids.select(F.col("rep").alias("least"), F.col("least").alias("b")), "least").select("a", "b")
    member = good.select("id", "label", "v").join(groups, ["label", "v"]).select("id", "rep", "least", "copies").distinct()
    comp = components(named.unionByName(member.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))))
    reach = member.join(links, "rep", "left")
    # rows, not ids, are counted: one row of each representative that the id stands on
    per_id = reach.groupBy("id").agg(F.sum(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.select("id", "fine").join(per_id, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.when(F.col("fine"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))
