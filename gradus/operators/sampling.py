"""Samples by a hash of the id: the same rows at every run, and no stratum sorted whole.

Hashes are uniform, so the k lowest of g lie below about k / g of their range. A cut-off a little above it lets some k + 4 * sqrt(k) rows of a stratum through, and only these are
ranked; a stratum for which it let too few through is ranked whole, so the result is always that of a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.sources.io import saved

#: Hexadecimal digits of the hash that a cut-off looks at.
DIGITS = 12
#: Strata up to which their cut-offs are broadcast. (Joined by a shuffle, few strata would each be one task's.)
BROADCAST = 100_000


def order(id_: Column, seed: str) -> Column:
    """The hash by which rows are drawn."""
    return F.md5(F.concat(id_.cast("string"), F.lit(f"-{seed}")))


def lowest(df: DataFrame, stratum: str, take: DataFrame, id_: str, seed: str) -> DataFrame:
    """The rows of each stratum with the lowest hashes, as many as take (stratum, take) says; strata without an entry give none. Equal hashes go by id."""
    hashed = df.withColumn("_h", order(F.col(id_), seed))
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_g")).join(take.where("take > 0").select(stratum, F.col("take").cast("long").alias("_take")), stratum)
    share = (F.col("_take") + 4 * F.sqrt("_take") + 8) / F.col("_g")
    cut = F.lpad(F.lower(F.hex(F.floor(share * 16**DIGITS).cast("long"))), DIGITS, "0")
    cuts = saved(sizes.select(stratum, "_take", F.when(share < 1, cut).alias("_cut")), "cuts")
    few = F.broadcast if cuts.count() <= BROADCAST else lambda x: x
    cuts = few(cuts)
    below = hashed.join(cuts, stratum).where(F.col("_cut").isNull() | (F.substring("_h", 1, DIGITS) < F.col("_cut")))
    seen = below.groupBy(stratum).agg(F.count("*").alias("_n"))
    short = cuts.where("_cut IS NOT NULL").join(seen, stratum, "left").where(F.coalesce("_n", F.lit(0)) < F.col("_take")).select(stratum, "_take")
    short = few(saved(short, "short"))
    rows = below.join(short, stratum, "left_anti").drop("_cut").unionByName(hashed.join(short, stratum))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", id_))
    return rows.withColumn("_r", rank).where("_r <= _take").select(*df.columns)


def proportional(df: DataFrame, stratum: str, n: int, id_: str, seed: str) -> DataFrame:
    """About n rows, of each stratum in proportion to its size and one at least, then trimmed to n by another hash."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("g"))
    total = sizes.agg(F.sum("g").alias("total"))
    take = sizes.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.round(n * F.col("g") / F.col("total"))).alias("take"))
    return lowest(df, stratum, take, id_, seed).orderBy(order(F.col(id_), f"{seed}-trim"), id_).limit(n)
