"""Registered queries of the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, fingerprint, line_dedup, minhash_dedup, mixing, packing, periodic_runs, secrets, spelling, substring_dedup, suffix_dedup, toxicity
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it; see `mixing`."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def learnable(labels: DataFrame) -> DataFrame:
    """Labelled rows that a model may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score of its whole text, learnt from labelled rows that aren't held out; see `toxicity`. A null id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, learnable(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of secrets, the base kinds counted, and what the corpus says of their values; see `secrets`."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; see `packing`."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its edited text's, and their likeness; see `fingerprint`."""
    return fingerprint.with_neighbours(table(spark, sf_dir, "documents"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of `pages`, without the boilerplate of their hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.html_lines(F.col("html")).alias("text"))
    return line_dedup.drop_boilerplate(pages, "host", "text")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component; see `embed_dedup`."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and its component; see `minhash_dedup`."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that windows of earlier documents cover; see `substring_dedup`."""
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("doc", "doc_id")


def op10_radix_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the bytes that earlier 100-byte strings cover; see `suffix_dedup`."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("doc", "doc_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its near words counted, the form that it stands for and the last of the forms; see `spelling`."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, a tenth of the documents looped; see `periodic_runs`."""
    docs = table(spark, sf_dir, "documents")
    return periodic_runs.digests(periodic_runs.collapse(docs.select("doc_id", periodic_runs.looped(docs["doc_id"], docs["text"]).alias("text"))))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the text that they decode to, as digests; see `bpe`."""
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_toxicity, op3_secrets, op4_packing, op5_fingerprint, op6_line_frequency, op7_embeddings, op8_minhash, op9_recompression, op10_radix_suffixes,
        op11_spelling, op12_periodic_runs, op13_bpe,
    )
}

ORACLES = {
    "op6_line_frequency": r"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', chr(10), 'g'),
      '(?is)<style.*?</style>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), chr(10)) AS lines
  FROM pages),
l AS (SELECT page_id, host, pos, lines[pos] AS line, trim(lines[pos], chr(32) || chr(9) || chr(13)) AS k
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS pos FROM p)),
t AS (SELECT host, count(*) AS n FROM p GROUP BY host),
bad AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT page_id) AS c FROM l WHERE host IS NOT NULL AND k <> '' GROUP BY ALL) JOIN t USING (host)
  WHERE c > 1 AND c > 0.2 * n),
m AS (SELECT l.*, bad.k IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.host = bad.host AND l.k = bad.k)
SELECT page_id, any_value(host) AS host, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
  count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM m GROUP BY page_id""",
}
