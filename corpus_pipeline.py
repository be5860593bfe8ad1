"""From documents to packed training sequences: toxic documents go, boilerplate lines go, one document of each group of near duplicates
stays, sources are mixed to their weights, and what is left is packed.

Each stage reads all that the one before it kept and returns the columns of documents, further ones included whatever their names; the last returns
packed pieces. Defined results, for every stage: an empty table gives an empty one; repeated rows are documents of their own, which the near-duplicate stage
keeps together where they share an id; a null or empty text scores 0 (it stays), keeps its text, has no near duplicates, has size 0
for the mix and packs to its closing id; a null source keeps its lines and is mixed as a source of its own; a null id is never a near duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import line_dedup, minhash_dedup, mixing, packing, toxicity
from gradus.llm.common import broadcast_if_small, saved, table, whole_rows
from gradus.llm.queries import learnable

#: Score from which a document is rejected as toxic.
TOXIC = 0.3
#: Share of a source's different texts from which a line is boilerplate. A source is far larger than a web host, and its commonest lines stand
#: in a few hundredths of it: 0.2, as for hosts, drops nothing at size.
LINE_RATIO = 0.02
#: Standard deviations by which a line's count must exceed that ratio: in a source of 50 documents a line on 2 of them is chance, one on 5 is not.
LINE_DEVIATIONS = 3.0
#: Ids up to which the documents to be dropped are broadcast.
DROP_IDS = 300_000


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below TOXIC; a blank one scores 0."""
    model = toxicity.fit(docs, learnable(table(spark, sf_dir, "labels")))
    scored = toxicity.score(whole_rows(docs), model, F.col("_row")["text"], out="score")
    return scored.where(F.col("score") < TOXIC).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that more than LINE_RATIO of their source's different texts hold; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs, "source", "text", max_ratio=LINE_RATIO, distinct=True, deviations=LINE_DEVIATIONS)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    gone = saved(minhash_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "pipeline-near")
    return docs.join(broadcast_if_small(gone, DROP_IDS), "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_out), ("minhash_near_dedup", near_duplicates_out), ("mixing", mixed), ("packing", packed)]

#: No SQL: a trained model, a random draw and a tokenizer stand in the way. Tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
