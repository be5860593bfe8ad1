"""Line dedup by site-relative frequency.

A line that stands on more than `max_ratio` of a host's pages is boilerplate of that host and is dropped from all its pages. Every page and every
line counts; a line counts once a page. A line on one page alone is repeated nowhere and stays, else a host of a single page would lose all of it. With
`distinct`, pages of a host whose texts are equal count as one, so that many copies of one page don't make its body boilerplate. With `deviations`, the count
must exceed the ratio by so many standard deviations of a count at that ratio (a score test), so that a small group's chance repeats stay; 0
takes the ratio as it is.

How many lines of a host can be boilerplate is bounded by (mean lines a page) / max_ratio, so the set that is sent
back to a page is small for any number of pages. Counting is one aggregation with map-side sums, so neither a hot host
nor a hot line meets in one task; the set joins back by broadcast when its lines were counted few, else by a shuffled join that
adaptive execution splits where a host is skewed.

Defined results: a null text stays null; a blank line is never dropped; equal lines differ by nothing but blanks, tabs and
carriage returns at their ends; pages without a host are left as they are; repeated rows are pages of their own; an empty table gives no rows; further
columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_rows

LINE_END = "\n"
BLANKS = " \t\r"
#: Boilerplate lines of all hosts (16 bytes each) up to which they are broadcast.
BROADCAST_LINES = 100_000


def _key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """Text of a page, a line for each stretch between tags; scripts, styles and comments go."""
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->"):
        html = F.regexp_replace(html, pattern, "\n")
    return F.regexp_replace(html, r"<[^>]*>", "\n")


def boilerplate(df: DataFrame, max_ratio: float, distinct: bool, deviations: float) -> DataFrame:
    """df (host, text): (host, line, pages, host_pages), the lines that exceed the ratio."""
    pages = df.where("host IS NOT NULL").select("host", "text", F.array_distinct(F.transform(F.split("text", LINE_END), lambda x: _key(F.btrim(x, F.lit(BLANKS))))).alias("keys"))
    if distinct:
        pages = pages.groupBy("host", _key(F.col("text")).alias("whole")).agg(F.first("keys").alias("keys"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    lines = pages.select("host", F.explode("keys").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("pages")).where((F.col("pages") > 1) & (F.col("line") != _key(F.lit(""))))
    least = max_ratio * F.col("host_pages")
    if deviations:
        least = least + deviations * F.sqrt(F.col("host_pages") * (max_ratio * (1 - max_ratio)))
    return counts.join(totals, "host").where(F.col("pages") > least)


def drop_boilerplate(df: DataFrame, host: str, text: str, max_ratio: float = 0.2, distinct: bool = False, deviations: float = 0.0) -> DataFrame:
    """df with boilerplate lines taken out of `text`, and n_lines and n_dropped (longs) for each row; columns of df with these names are replaced."""
    bad = boilerplate(df.select(df[host].alias("host"), df[text].alias("text")), max_ratio, distinct, deviations)
    bad = saved(bad.groupBy("host").agg(F.collect_list("line").alias("bad")).withColumnRenamed("host", "_host"), "boilerplate")
    if (bad.agg(F.sum(F.size("bad"))).first()[0] or 0) <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    rows = whole_rows(df).withColumn("lines", F.split(F.col("_row")[text], LINE_END)).join(bad, F.col("_row")[host] == F.col("_host"), "left")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("bad"), _key(F.btrim(x, F.lit(BLANKS)))))
    rows = rows.withColumn("kept", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(kept))
    own = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    return rows.select(
        *[F.array_join("kept", LINE_END).alias(c) if c == text else F.col("_row")[c].alias(c) for c in own],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )
