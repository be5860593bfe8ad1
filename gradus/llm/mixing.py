"""Mixing sources to target weights by balanced sampling with the cube method.

Targets: source s wants weight w_s of the budget, at most `cap` times its own size, and what a capped source can't
take goes to the others by weight (so target = min(cap * size, level * w) for one common level). A document of source s is
taken floor(target / size) times, and once more with the probability that is left over.

That last choice is balanced: in blocks of at most `block` documents the vector of inclusion probabilities walks in the
null space of the constraints (sum of tokens, number of documents), a step at a time until every document but at most two
is 0 or 1. The documents left over of all blocks form new blocks, until one block a source remains; its last two documents are
the landing problem: the constraint on documents is let go, then the last document is drawn. Blocks are dealt by
hash within a source, so one source with a third of all rows is many blocks. Every random draw is a function of the seed, the
document and its block: reruns agree.

Defined results: a null or blank text has size 0 and is never more than 0 words; a null source is a source of its own, last in
order; repeated rows are documents of their own; an empty table gives an empty result; further columns, whatever their names, are carried by
`mixed_documents` and left out by `mix`.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, saved, whole_rows

NEAR = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row a source, so its windows are over the sources alone."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    # the level at which source s gets capped is cap * size / w; below it go those with smaller ratios, wholly
    per = per.withColumn("_at", cap * F.col("source_size") / F.col("_w"))
    up = Window.orderBy("_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_at", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_level", (share * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(up), F.lit(0))) / F.sum("_w").over(rest))
    per = per.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_at"), F.col("_level"))).over(every))
    full = cap * F.col("source_size")
    return per.select("source", "source_size", "source_docs", F.least(full, F.coalesce(F.col("_level") * F.col("_w"), full)).cast("double").alias("target"))


def flight(size: np.ndarray, p: np.ndarray, draw: np.ndarray, land: bool) -> np.ndarray:
    """Walk p to 0 or 1, keeping sum(p) and sum(size * p); at most two values stay between unless land."""
    p = p.copy()
    free: list[int] = []
    step = 0

    def settle() -> None:
        for i in list(free):
            if p[i] < NEAR or p[i] > 1 - NEAR:
                p[i] = round(p[i])
                free.remove(i)

    def move(direction: list[float]) -> None:
        nonlocal step
        up = min(((1 - p[i]) if d > 0 else p[i]) / abs(d) for i, d in zip(free, direction, strict=True) if d)
        down = min((p[i] if d > 0 else (1 - p[i])) / abs(d) for i, d in zip(free, direction, strict=True) if d)
        go = up if draw[step % len(draw)] * (up + down) < down else -down
        for i, d in zip(free, direction, strict=True):
            p[i] += go * d
        step += 1
        settle()

    for i in range(len(p)):
        if NEAR < p[i] < 1 - NEAR:
            free.append(i)
        if len(free) == 3:
            a, b, c = (float(size[j]) for j in free)
            direction = [c - b, a - c, b - a]
            move(direction if any(direction) else [1.0, -1.0, 0.0])
    while land and len(free) == 2:  # sizes are kept, or numbers where sizes are 0
        a, b = (float(size[j]) for j in free)
        move([b, -a] if a > 0 and b > 0 else [1.0, -1.0])
    if land and free:
        p[free[0]] = float(draw[step % len(draw)] < p[free[0]])
    return p


def _uniform(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed & (1 << 63) - 1).random(n)


def _walker(level: int, last: bool, seed: int):
    """The flight of one block; with landing at the last level."""

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "draw", "unit"], ascending=[False, True, True], kind="stable")
        at = int(key[1]) * 1_000_003 + level * 7919 + seed + int(rows["draw"].iloc[0])
        p = flight(rows["size"].to_numpy(), rows["p"].to_numpy(), _uniform(at, len(rows) + 3), last)
        return rows.assign(p=p, settled=(p <= 0) | (p >= 1))[["unit", "draw", "source", "size", "p", "settled"]]

    return walk


def balanced(units: DataFrame, block: int = 1024, seed: int = 1) -> DataFrame:
    """units (unit, draw, source, size, p), p in [0, 1]: (unit, chosen), chosen 0 or 1. unit names a row; draw, a hash of the document, decides.

    Each level leaves 2 of `block` documents undecided, so there are log(rows) / log(block / 2) levels."""
    schema = "unit long, draw long, source string, size long, p double, settled boolean"
    open_, done, level = units, [], 0
    while True:
        counts = saved(open_.groupBy("source").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")), "mix-blocks")
        last = counts.where("blocks > 1").isEmpty()
        dealt = open_.join(broadcast_if_small(counts), open_["source"].eqNullSafe(counts["source"])).select(open_["*"], F.pmod(F.xxhash64(F.lit(seed + level), "draw"), "blocks").alias("_block"))

        walked = saved(dealt.groupBy("source", "_block").applyInPandas(_walker(level, last, seed), schema), f"mix-level-{level}")
        done.append(walked.where("settled").select("unit", F.col("p").cast("int").alias("chosen")))
        if last:
            break
        open_, level = walked.where("NOT settled").drop("settled"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def ranked(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows with a column rank that numbers rows of equal key, 0 where a key stands once. rows is a saved table with a column unit that holds a
    row's partition in its upper bits: equal rows are numbered a partition at a time, so no task gets all of them."""
    same = lambda other: reduce(lambda x, y: x & y, (rows[c].eqNullSafe(other[c]) for c in key))
    again = saved(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"), f"{name}-again")
    if again.isEmpty():
        return rows.withColumn("rank", F.lit(0).cast("long"))
    many = rows.join(again, same(again), "left_semi").withColumn("part", F.shiftright("unit", 33))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = saved(many.groupBy(*key, "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), f"{name}-parts")
    many = many.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "part").orderBy("unit")) - 1)
    both = reduce(lambda x, y: x & y, (many[c].eqNullSafe(parts[c]) for c in [*key, "part"]))
    many = many.join(parts, both).select(*[many[c] for c in rows.columns], (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    return rows.join(again, same(again), "left_anti").withColumn("rank", F.lit(0).cast("long")).unionByName(many)


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 1024, seed: int = 1) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken), a row for each row of df."""
    rows = df.select(df[doc_id].alias("doc_id"), df[source].cast("string").alias("source"), F.coalesce(F.regexp_count(df[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # the place of a row in the saved table is its name; the table is written once, so it stays
    rows = saved(rows.withColumn("unit", F.monotonically_increasing_id()), "mix-sizes")
    targets = saved(source_targets(rows, weights, share, cap), "mix-targets")
    # what is drawn for equal rows differs by their number, so that they are dealt out over the blocks
    rows = ranked(rows, ["doc_id", "source", "size"], "mix").withColumn("draw", F.xxhash64("doc_id", "size", "rank")).drop("rank")
    every = rows.join(broadcast_if_small(targets), rows["source"].eqNullSafe(targets["source"])).select(rows["*"], "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    every = every.withColumn("whole", F.floor(ratio + F.lit(NEAR)).cast("int")).withColumn("p", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    chosen = balanced(every.select("unit", "draw", "source", "size", "p"), block, seed)
    out = every.join(chosen, "unit").withColumn("copies", F.col("whole") + F.col("chosen"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """The rows that the mix takes, as often as it takes them; rows equal in id, source and size change places freely."""
    key = ["id", "owner", "size"]
    picked = mix(df, doc_id, text, source, **kw).select(F.col("doc_id").alias("id"), F.col("source").alias("owner"), "size", "copies")
    picked = saved(picked.withColumn("unit", F.monotonically_increasing_id()), "mix-picked")
    size = F.coalesce(F.regexp_count(F.col("_row")[text], F.lit(WORD)), F.lit(0)).cast("long")
    rows = whole_rows(df).select("_row", F.col("_row")[doc_id].alias("id"), F.col("_row")[source].cast("string").alias("owner"), size.alias("size"))
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in key))
    again = saved(picked.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "mix-equal")
    taken = picked.where("copies > 0")
    if again.isEmpty():
        out = rows.join(taken, same(rows, taken)).select("_row", "copies")
    else:
        once, few = rows.join(again, same(rows, again), "left_anti"), taken.join(again, same(taken, again), "left_anti")
        out = once.join(few, same(once, few)).select("_row", "copies")
        many = ranked(saved(rows.join(again, same(rows, again), "left_semi").withColumn("unit", F.monotonically_increasing_id()), "mix-equal-rows"), key, "mix-rows")
        several = ranked(saved(picked.join(again, same(picked, again), "left_semi"), "mix-equal-picked"), key, "mix-picks")
        out = out.unionByName(many.join(several, same(many, several) & (many["rank"] == several["rank"])).where("copies > 0").select("_row", "copies"))
    return out.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col("_row")[c].alias(c) for c in df.columns])
