"""One-permutation MinHash fingerprints of documents, all in DataFrame functions.

The five-word shingles of a text are hashed once. A hash falls into one of `bins` bins by its upper bits, and the smallest of each bin
stays. An empty bin copies the first filled bin on its own chain of hashed bins (optimal densification); a text with so few filled
bins that the chain of `PROBES` steps finds none takes the filled bin that hashes lowest with it, which is where the endless chain
ends. Of each bin's minimum, hashed with the bin, the lowest 4 bits are kept, a hex digit each. Likeness is the share of equal digits, corrected for
the 1 in 16 that are equal by chance.

Minima come from one sort of the hashes together with a sentinel at each bin's upper end: the first of each bin is its minimum, or
the sentinel where the bin is empty. Nothing is exploded, so a document's cost is its own length.

Defined results: a null or empty text has the fingerprint `EMPTY`, alike to itself alone; a text of fewer than five words is one
shingle; equal texts have equal fingerprints; further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

BINS = 128
BITS = 4
SHINGLE = 5
PROBES = 24
#: Ranges of ids at most, each a row of the table that links them.
RANGES = 4_096
_SHIFT = 63 - (BINS.bit_length() - 1)
EMPTY = "-" * BINS


def _bin(h: Column) -> Column:
    return F.shiftright(h, _SHIFT)


def shingle_hashes(words: Column) -> Column:
    """63-bit hashes of the shingles of an array of words; the whole array is one when it is shorter than a shingle."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1))), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(SHINGLE)]), 1))
    return F.when(n >= SHINGLE, many).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(F.concat_ws(" ", words)), 1)))


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of `text` as `out`; the steps are columns of their own so that each is computed once."""
    sentinel = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: F.shiftleft(b, _SHIFT).bitwiseOR(F.lit((1 << _SHIFT) - 1)))
    w, s, m, v = (f"{out}_{x}" for x in ("words", "sorted", "minima", "filled"))
    df = df.withColumn(w, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), 0))
    df = df.withColumn(s, F.sort_array(F.concat(shingle_hashes(F.col(w)), sentinel)))
    first = F.filter(F.col(s), lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(s), i - 1))))
    df = df.withColumn(m, first)
    # a sentinel is all ones below its bin: that minimum is "empty"
    full = F.lit((1 << _SHIFT) - 1)
    df = df.withColumn(v, F.transform(F.col(m), lambda x: F.when(x.bitwiseAND(full) != full, x)))
    some = F.filter(F.transform(F.col(v), lambda x, b: F.struct(b.alias("b"), x.alias("x"))), lambda y: y["x"].isNotNull())
    lowest = lambda j: F.array_min(F.transform(some, lambda y: F.struct(F.xxhash64(F.lit(-1), j, y["b"]).alias("h"), y["x"].alias("x"))))["x"]
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        lambda j: F.coalesce(F.get(F.col(v), j), *[F.get(F.col(v), F.pmod(F.xxhash64(F.lit(t), j), F.lit(BINS)).cast("int")) for t in range(PROBES)], lowest(j)),
    )
    # hashed with the bin, so that a minimum which fills many bins gives each its own bits
    digits = F.array_join(F.transform(dense, lambda x, j: F.lower(F.hex(F.xxhash64(x, j).bitwiseAND(F.lit((1 << BITS) - 1))))), "")
    return df.withColumn(out, F.when(F.size(w) == 0, F.lit(EMPTY)).otherwise(digits)).drop(w, s, m, v)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingle sets, 0 to 1."""
    digits = lambda f, i: F.conv(F.substring(f, 1 + 15 * i, 15), 16, 10).cast("long")
    differ = F.lit(0)
    for i in range(-(-BINS // 15)):  # 15 digits at a time: a digit differs where any of its 4 bits does
        x = digits(a, i).bitwiseXOR(digits(b, i))
        x = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x111111111111111)))
    same = F.lit(BINS) - differ
    chance = 1.0 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == EMPTY) | (b == EMPTY), F.lit(0.0)).otherwise(estimate)


def ranges(ids: DataFrame, parts: int) -> DataFrame:
    """ids with a column `range`: what a sample says makes ranges of about equal size, whatever the values; -1 where the id is null."""
    dealt = ids.repartitionByRange(max(1, min(parts, RANGES)), F.col("doc_id").asc_nulls_first())
    return dealt.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.spark_partition_id()))


def next_ids(ids: DataFrame, parts: int = 32) -> DataFrame:
    """(doc_id, next_id, n_chars) from (doc_id, n_chars), ids distinct: the next higher id, after the last the first.

    Each range is written down, then ordered in a task of its own; the first id of each, one row a range and RANGES at most, links them. A null id is
    followed by the first id, and follows none."""
    ids = saved(ranges(ids, parts), "fingerprint-ranges")
    inner = ids.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id")))
    firsts = ids.groupBy("range").agg(F.min("doc_id").alias("first_id"))
    order = Window.orderBy("range")
    real = F.when(F.col("range") >= 0, F.col("first_id"))
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = firsts.select("range", F.coalesce(F.lead("first_id").over(order), F.first(real, ignorenulls=True).over(every)).alias("after"))
    return inner.join(F.broadcast(links), "range").select("doc_id", "n_chars", F.coalesce("next_id", "after").alias("next_id"))


def with_neighbours(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by as much of the next document's start. Of rows that share an id, the one whose text has the least hash
    is what neighbours see, and each of them is edited; a null id is a document after which the first follows, and none precedes."""
    # an id is two columns, neither ever null
    number, none = F.coalesce(df[doc_id].cast("long"), F.lit(0)).alias("k"), df[doc_id].isNull().alias("z")
    docs = df.select(number, none, F.coalesce(df[text], F.lit("")).alias("t"))
    own = F.xxhash64("t").alias("h")
    # every text is fingerprinted once, where it is read
    prints = saved(add_fingerprint(docs, "t", "fingerprint").select("k", "z", own, F.length("t").cast("long").alias("n_chars"), "fingerprint"), "fingerprint-prints")
    prints_of = prints.groupBy("k", "z", "h").agg(F.first("fingerprint").alias("fingerprint"))
    sizes = prints.select(F.when(~F.col("z"), F.col("k")).alias("doc_id"), "n_chars").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    links = next_ids(sizes, -(-prints.count() // 2_000)).where("next_id IS NOT NULL")
    links = links.select(F.coalesce("doc_id", F.lit(0)).alias("pk"), F.col("doc_id").isNull().alias("pz"), F.col("next_id").alias("k"), F.lit(False).alias("z"), F.expr("int(n_chars div 2)").alias("need"))
    seen = prints.groupBy("k", "z").agg(F.min(F.struct("h", "fingerprint")).alias("s")).select("k", "z", F.col("s.h").alias("seen_h"), F.col("s.fingerprint").alias("next_fingerprint"))
    links = saved(links.join(seen, ["k", "z"]), "fingerprint-links")
    # what each document hands on: its start, cut to what the one before it needs
    heads = docs.join(links, ["k", "z"]).where(own == F.col("seen_h")).select("pk", "pz", F.substring("t", F.lit(1), F.col("need")).alias("head"), "next_fingerprint")
    heads = saved(heads, "fingerprint-heads").groupBy(F.col("pk").alias("k"), F.col("pz").alias("z")).agg(F.first("head").alias("head"), F.first("next_fingerprint").alias("next_fingerprint"))
    # and what stays of each document
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    fronts = docs.select("k", "z", own, n.alias("n"), half.alias("half"), F.substring("t", F.lit(1), n - half).alias("front"))
    out = fronts.join(heads, ["k", "z"], "left")
    out = add_fingerprint(out.withColumn("edited", F.concat("front", F.substring(F.coalesce("head", F.lit("")), F.lit(1), F.col("half")))), "edited", "edited_fingerprint")
    out = out.select("k", "z", "h", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "edited_fingerprint", "next_fingerprint").join(prints_of, ["k", "z", "h"])
    return out.select(
        F.when(~F.col("z"), F.col("k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_fingerprint", "fingerprint")).alias("near_next"),
    )
