"""Best matches by cosine over all candidates: buckets of random-projection signs, and exact cosines inside them.

Two vectors at an angle t agree on the sign of a random projection with probability 1 - t / pi. A candidate is posted under one bucket a table, `bits` signs long; a target
looks into its own bucket and into those that differ in one sign. From the number of candidates follow the bits, and from bits, `least` and `miss` the number of tables, so that a pair at
cosine `least` or above is missed with probability `miss` at most.

Equal vectors are one (the smallest id stands for them), so copies make no bucket hot. A bucket with many different vectors is dealt out to chunks of
candidates and of targets, and each pair of chunks is one multiplication of two bounded matrices that gives back one row a target: no pair is
written. What is found has its exact cosine in double precision.

Where buckets would cost more than all pairs, as they do when almost nothing may be missed, there are none: both sides lie in rows of some CHUNK vectors, and every row of one meets every row
of the other. That compares all pairs, exactly, but posts nothing: what is shuffled is each vector once, and a task holds GRID rows of each side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.sources.io import saved

#: Candidates that a bucket should hold, and rows of a chunk of a bucket that holds more.
BUCKET, CHUNK = 64, 2_048
#: Rows that a task posts at a time.
POSTS = 8_192
#: Rows up to which the list of large buckets is broadcast.
BROADCAST = 100_000
#: Comparisons that cost as much as one post, bytes of vectors in a row of them, and such rows of each side in a task.
POST, ROW_BYTES, GRID = 4_096, 1 << 20, 4


def plan(candidates: int, least: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for so many candidates."""
    bits = min(max(round(math.log2(max(candidates, 1) / BUCKET)), 2), 30)
    same = 1 - math.acos(least) / math.pi
    met = same**bits + bits * same ** (bits - 1) * (1 - same)
    return bits, max(math.ceil(math.log(miss) / math.log1p(-met)), 1)


def usable(v: Column) -> Column:
    """Whether a vector has a direction: no null or infinite component, not all zero."""
    finite = F.forall(v, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")) & ~F.isnan(x), F.lit(False)))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def at_once(times: int) -> int:
    """Vectors that are posted at a time, each under so many buckets: with more tables, fewer."""
    return max(POSTS // times, 1)


def coded(vectors: DataFrame, dims: int, bits: int, tables: int, seed: int, flips: bool) -> DataFrame:
    """(id, vector of length 1, bucket): a row for each table, or with flips also for each bucket that is one sign away."""
    planes = np.random.default_rng(seed).standard_normal((dims, tables * bits))
    masks = np.array([0, *(1 << np.arange(bits))] if flips else [0], np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        rows = at_once(tables * len(masks))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                unit = np.array(part.column(1).to_pylist(), float).reshape(part.num_rows, dims)
                unit /= np.abs(unit).max(axis=1, keepdims=True)
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                signs = (unit @ planes > 0).reshape(-1, tables, bits)
                codes = (signs @ powers) + (np.arange(tables, dtype=np.int64) << 32)
                codes = (codes[:, :, None] ^ masks).reshape(part.num_rows, -1)
                times = codes.shape[1]
                ends = pa.array(np.arange(0, codes.size * dims + 1, dims, dtype=np.int32))
                copies = pa.ListArray.from_arrays(ends, pa.array(np.repeat(unit, times, axis=0).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), times)), copies, pa.array(codes.ravel())], names=["id", "vector", "bucket"])

    return vectors.mapInArrow(task, "id long, vector array<double>, bucket long")


def all_pairs(asked: DataFrame, held: DataFrame, counts: tuple[int, int], dims: int, least: float) -> DataFrame:
    """asked and held (id, vector): (target, candidate, cosine), the best of each target among the candidates that met it in a task, at cosine `least` or above."""
    rows = max(min(CHUNK, ROW_BYTES // (8 * dims)), 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column(0).to_numpy()
                order = np.argsort(ids)
                unit = part.column(1).flatten().to_numpy().reshape(-1, dims)[order]
                unit = unit / np.abs(unit).max(axis=1, keepdims=True)
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids[order].astype(np.int64), unit)], names=["ids", "vectors"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                t, tv, c, cv = (batch.column(k)[i].as_buffer() for k in range(4))
                ids = np.frombuffer(c, np.int64)
                cosine = np.frombuffer(tv).reshape(-1, dims) @ np.frombuffer(cv).reshape(-1, dims).T
                at = cosine.argmax(axis=1)
                new = cosine[np.arange(len(at)), at], ids[at]
                old = best.setdefault(t.to_pybytes(), new)
                closer = (new[0] > old[0]) | ((new[0] == old[0]) & (new[1] < old[1]))
                best[t.to_pybytes()] = np.where(closer, new[0], old[0]), np.where(closer, new[1], old[1])
        for t, (cosine, candidate) in best.items():
            near = cosine >= least - 1e-9
            out = np.frombuffer(t, np.int64)[near], candidate[near], cosine[near]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["target", "candidate", "cosine"])

    def packed(df: DataFrame, n: int, side: str) -> DataFrame:
        chunks = math.ceil(n / rows)
        return df.mapInArrow(pack, "ids binary, vectors binary").repartition(max(math.ceil(chunks / GRID), min(chunks, GRID), 1)).select(F.col("ids").alias(f"ids{side}"), F.col("vectors").alias(f"vectors{side}"))

    met = packed(asked, counts[0], "t").crossJoin(packed(held, counts[1], "c").hint("shuffle_replicate_nl"))
    return met.mapInArrow(compare, "target long, candidate long, cosine double")


def _met(asked: DataFrame, held: DataFrame, dims: int, bits: int, tables: int, least: float, seed: int) -> DataFrame:
    """As `all_pairs`, of those that meet in a bucket."""
    posted = coded(held, dims, bits, tables, seed, flips=False)
    sought = coded(asked, dims, bits, tables, seed, flips=True)
    # a bucket of many vectors is a grid of chunks
    parts = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).alias(name)).where(F.col(name) > 1)
    sizes = saved(parts(posted, "c").join(parts(sought, "t"), "bucket", "full"), "nearest-large")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST else sizes
    chunk = lambda n: F.pmod(F.xxhash64("id"), F.coalesce(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1).cast("long")) - 1))
    p = posted.join(sizes, "bucket", "left").withColumn("cc", chunk(F.col("c"))).withColumn("tc", every(F.col("t")))
    s = sought.join(sizes, "bucket", "left").withColumn("tc", chunk(F.col("t"))).withColumn("cc", every(F.col("c")))
    keys = ["bucket", "cc", "tc"]

    def compare(t: pa.Table, c: pa.Table) -> pa.Table:
        out = {"target": [], "candidate": [], "cosine": []}
        if t.num_rows and c.num_rows:
            ids = c["id"].to_numpy()
            order = np.argsort(ids)
            matrix = lambda x: x["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
            cosine = matrix(t) @ matrix(c)[order].T
            best = cosine.argmax(axis=1)
            value = cosine[np.arange(len(best)), best]
            near = value >= least - 1e-9
            out = {"target": t["id"].to_numpy()[near], "candidate": ids[order][best][near], "cosine": value[near]}
        return pa.table({"target": pa.array(out["target"], pa.int64()), "candidate": pa.array(out["candidate"], pa.int64()), "cosine": pa.array(out["cosine"], pa.float64())})

    select = lambda df: df.select(*keys, "id", "vector")
    return select(s).groupBy(*keys).cogroup(select(p).groupBy(*keys)).applyInArrow(compare, "target long, candidate long, cosine double")


def best_matches(targets: DataFrame, candidates: DataFrame, least: float = 0.75, miss: float = 0.01, seed: int = 11) -> DataFrame:
    """targets and candidates (id, vector): (target, candidate, cosine) of each target that has a candidate at cosine `least` or above: the nearest, the
    smallest id of those whose vectors are equal. Vectors without a direction, or of another dimension than most candidates have, match nothing; without candidates the result is empty."""
    spark = targets.sparkSession
    common = candidates.where(usable(F.col("vector"))).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "target long, candidate long, cosine double")
    dims = common["d"]
    doubles = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    ready = lambda df: df.where(usable(F.col("vector")) & (F.size("vector") == dims)).select(F.col("id").cast("long").alias("id"), doubles)
    members = ready(targets)
    one_of = lambda df: saved(df.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"), "nearest")
    asked, held = one_of(members), one_of(ready(candidates))
    targeted, n = asked.count(), held.count()
    bits, tables = plan(n, least, miss)
    times = tables * (bits + 1)
    if targeted * n <= targeted * times * (POST + n / (1 << bits)) + n * tables * POST:
        met = all_pairs(asked, held, (targeted, n), dims, least)
    else:
        met = _met(asked, held, dims, bits, tables, least, seed)
    best = met.groupBy("target").agg(F.max(F.struct(F.col("cosine"), (-F.col("candidate")).alias("c"))).alias("b")).where(F.col("b.cosine") >= least)
    best = best.select(F.col("target").alias("id"), (-F.col("b.c")).alias("candidate"), F.col("b.cosine").alias("cosine"))
    # what was found for a vector holds for all targets that have it
    found = asked.join(best, "id").select("vector", "candidate", "cosine")
    return members.join(found, "vector").select(F.col("id").alias("target"), "candidate", "cosine")
