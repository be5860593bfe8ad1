"""Secret scans with corpus-wide ownership frequency, all in DataFrame functions.

Base kinds are found in every whole text: `assign`, `access` and `hex`. Beside them stand candidate tokens (20 characters or more
of letters, digits and +/_- that look drawn by chance, see `live_looking`). The value of every find is hashed; one aggregation over the
corpus counts in how many different documents (repositories) and sources (owners) each hash stands. A value that more than `max_owners`
owners or more than `max_repositories` repositories share is a widely copied example; the others belong to their owner and count as live. A candidate
outside all base spans is added as a span of kind `owned` when it is live and one owner alone has it.

Counting goes (hash, owner, document) -> (hash, owner) -> hash, each step with map-side sums, so a value that a third of all rows
hold is spread over all tasks. Positions come from the lengths between matches, as running sums within a document.

Defined results: a null text is empty and has no spans; a null source is an owner of its own; rows that repeat an id and a text
are one document and each get its spans; positions are code points, end exclusive; further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

# The patterns of the kinds, the group that holds the value, and the least length of the value.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (ASSIGN, 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),  # the same finds as with any length and a limit of 16 afterwards: a run has one start
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "owned": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
}
RANK = {kind: i for i, kind in enumerate(KINDS)}
NONE = "cast(array() as array<struct<kind: int, pos: int, gap: int, size: int, value: string>>)"


def _finds(text: Column, kind: str) -> Column:
    """array<struct<kind, pos, gap, size, value>>: each match, the length of the text before it since the last, and its value."""
    pattern, group, _ = KINDS[kind]
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, 0)
    zipped = F.arrays_zip(F.split(text, pattern, -1), whole, whole if not group else F.regexp_extract_all(text, p, group))
    rows = F.transform(
        zipped,
        lambda x, i: F.struct(F.lit(RANK[kind]).alias("kind"), i.alias("pos"), F.length(x["0"]).alias("gap"), F.length(x["1"]).alias("size"), x["2"].alias("value")),
    )
    # most texts hold no match: one look tells
    return F.when(text.rlike(pattern), F.filter(rows, lambda x: x["size"].isNotNull()))


def live_looking(value: Column) -> Column:
    """Whether a token looks drawn by chance: letters and digits, 10 different characters at least, and no word that examples have."""
    varied = F.size(F.array_distinct(F.split(value, "", -1))) >= 10
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied & ~value.rlike("(?i)example|sample|dummy|changeme|placeholder|x{6}|0{6}|1234567|abcdefg")


def candidates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """(doc_id, key, owner, kind, start, end, hash): every base find and every candidate outside base spans."""
    t = F.coalesce(df[text], F.lit(""))
    docs = df.select(df[doc_id].alias("doc_id"), F.xxhash64(t).alias("key"), df[owner].cast("string").alias("owner"), t.alias("t"))
    found = docs.select("doc_id", "key", "owner", F.explode(F.concat(*[F.coalesce(_finds(F.col("t"), k), F.expr(NONE)) for k in KINDS])).alias("f")).select("doc_id", "key", "owner", "f.*")
    token = (F.col("kind") < RANK["owned"]) | live_looking(F.col("value"))
    found = found.withColumn("value", F.when((F.length("value") >= F.element_at(F.array(*[F.lit(KINDS[k][2]) for k in KINDS]), F.col("kind") + 1)) & token, F.sha2("value", 256)))
    # a token that doesn't look live is no candidate, but its length counts for the places of those behind it
    found = found.repartition("doc_id", "key").dropDuplicates(["doc_id", "key", "kind", "pos"])
    before = Window.partitionBy("doc_id", "key", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    found = found.where("value IS NOT NULL")
    base = F.col("kind") < RANK["owned"]
    place = Window.partitionBy("doc_id", "key").orderBy("start", "kind")
    left = F.max(F.when(base, F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(base, F.col("start"))).over(place.rowsBetween(1, Window.unboundedFollowing))
    outside = base | ((F.coalesce(left, F.lit(0)) <= F.col("start")) & (F.coalesce(right, F.col("end")) >= F.col("end")))
    return found.withColumn("outside", outside).where("outside").select("doc_id", "key", "owner", "kind", "start", "end", F.col("value").alias("hash"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) over all finds."""
    pairs = found.groupBy("hash", "owner", "doc_id", "key").agg(F.lit(1).alias("one"))
    per_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", max_owners: int = 2, max_repositories: int = 20) -> DataFrame:
    """A row for each row of df: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples.

    n_live and n_examples count all its spans by what the corpus says of their values."""
    found = saved(candidates(df, doc_id, text, owner), "secret-finds")
    known = found.join(saved(ownership(found), "secret-owners"), "hash").withColumn("example", (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories))
    known = known.where((F.col("kind") < RANK["owned"]) | ((F.col("owners") == 1) & ~F.col("example")))
    spans = known.groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"),
        F.sum((~F.col("example")).cast("long")).alias("n_live"),
        F.sum(F.col("example").cast("long")).alias("n_examples"),
        *[F.sum((F.col("kind") == RANK[k]).cast("long")).alias(f"n_{k}") for k in ("assign", "access", "hex")],
    )

    def said(column: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    docs = df.select(df[doc_id].alias("doc_id"), F.xxhash64(F.coalesce(df[text], F.lit(""))).alias("key"))
    out = docs.join(spans, docs["doc_id"].eqNullSafe(spans["doc_id"]) & (docs["key"] == spans["key"]), "left")
    s = F.coalesce(F.col("s"), F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        docs["doc_id"],
        zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.sha2(said(F.filter(s, lambda x: x["kind"] < RANK["owned"])), 256).alias("base_sha256"),
        said(s).alias("spans"),
        zero("n_live"), zero("n_examples"),
    )
