"""Questions that repeat an earlier one, on a stream: an index of the questions kept so far stays between micro-batches.

A question goes if an earlier one that was kept has the same normal text, the same anchor and answer, or a stem that shares most of its words. Stems meet through postings: a
stem is posted under its first words in an order that is fixed with the first batch (rare ones first), as many as two stems that are alike enough must share one of.
The postings of kept stems are a table; a batch joins it with its own words, compares those that meet in full, and appends what it keeps. A question costs the postings
of its own words and no scan of all earlier stems.

Equal texts, answers and stems are groups: what matters of a group is its first kept and its first open question, which one aggregation
gives, so copies make no pairs. Within a batch, decisions go in rounds, as a loop over the questions in order would take them. Writing a batch again replaces what it
wrote, and a batch reads earlier batches alone, so replays and any split of the input into batches give the same questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.text import jaccard, tokens
from gradus.operators.dedup import normal_answer, normal_text
from gradus.sources.io import saved
from gradus.streaming.jobs import StreamingQuery, finish

#: What a kept question is known by: its text, its anchor and answer, its stem.
GROUPS = ("text", "answer", "stem")


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: each round of each batch would send what is still small enough through the driver."""
    return side.hint("merge")


def described(questions: DataFrame, least: int) -> DataFrame:
    """questions (question_id, question_text, correct_answer, learning_object_id, question_section_id): (id, text, answer, stem, words). Null where a group has no say: a question without text
    is no question, one without an answer repeats none, a stem of fewer than `least` different words is too short to compare."""
    anchor = F.coalesce("learning_object_id", "question_section_id").cast("string")
    q = questions.select(F.col("question_id").alias("id"), F.nullif(normal_text(F.col("question_text")), F.lit("")).alias("text"), F.concat(anchor, F.lit("::"), normal_answer(F.col("correct_answer"))).alias("answer"), F.array_sort(F.array_distinct(tokens(F.col("question_text")))).alias("words"))
    return q.where("text IS NOT NULL").select("id", "text", "answer", F.when(F.size("words") >= least, F.array_join("words", " ")).alias("stem"), "words")


def posted(stems: DataFrame, ranks: DataFrame, threshold: float) -> DataFrame:
    """stems (stem, words): (stem, n, word) for the first words of each by (rank, word); words without a rank come first."""
    rows = stems.select("stem", F.size("words").alias("n"), F.explode("words").alias("word")).join(shuffled(ranks), "word", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("rank", F.lit(0).cast("long")).alias("rank"), "word")))
    firsts = rows.groupBy("stem", "n").agg(order.alias("w"))
    return firsts.select("stem", "n", F.explode(F.slice("w", F.lit(1), (F.col("n") - F.ceil(threshold * F.col("n")) + 1).cast("int"))).alias("w")).select("stem", "n", F.col("w.word").alias("word"))


def alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different stems of two postings whose words' Jaccard similarity is threshold or more."""
    a, b = left.select(F.col("stem").alias("a"), F.col("n").alias("na"), "word"), right.select(F.col("stem").alias("b"), F.col("n").alias("nb"), "word")
    met = a.join(shuffled(b), "word").where((F.col("a") != F.col("b")) & (F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))).select("a", "b").distinct()
    return met.where(jaccard(F.split("a", " "), F.split("b", " ")) >= threshold)


def decide(q: DataFrame, near: DataFrame) -> DataFrame:
    """(id, kept) of rows (id, text, answer, stem), as a loop in order of ids takes them; near (a, b) are stems that are alike, both ways."""
    state = saved(q.select("id", *GROUPS, F.lit(None).cast("boolean").alias("kept")), "unique-state")
    first = lambda kept: F.min(F.when(kept, F.col("id")))
    while True:
        kept, open_ = F.coalesce("kept", F.lit(False)), F.col("kept").isNull()
        out = state
        beaten, waits = F.lit(False), F.lit(False)
        groups = {g: state.where(F.col(g).isNotNull()).groupBy(g).agg(first(kept).alias(f"{g}_kept"), first(open_).alias(f"{g}_open")) for g in GROUPS}
        others = near.join(shuffled(groups["stem"]), near["b"] == groups["stem"]["stem"]).groupBy(F.col("a").alias("stem")).agg(F.min("stem_kept").alias("near_kept"), F.min("stem_open").alias("near_open"))
        for g, rows in [*groups.items(), ("near", others)]:
            out = out.join(shuffled(rows), "stem" if g == "near" else g, "left")
            beaten = beaten | F.coalesce(F.col(f"{g}_kept") < F.col("id"), F.lit(False))
            waits = waits | F.coalesce(F.col(f"{g}_open") < F.col("id"), F.lit(False))
        state = saved(out.select("id", *GROUPS, F.when(~open_, F.col("kept")).when(beaten, False).when(~waits, True).alias("kept")), "unique-state")
        if state.where("kept IS NULL").isEmpty():
            return state.select("id", "kept")


class QuestionIndex:
    """The questions kept so far, in a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str, threshold: float = 0.7, least: int = 12):
        self.spark, self.root, self.threshold, self.least = spark, root.rstrip("/"), threshold, least

    def _before(self, name: str, schema: str, batch: int) -> DataFrame:
        if batch == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.root}/{name}").where(F.col("batch") < batch).drop("batch")

    def _append(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.root}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self) -> DataFrame:
        """The questions kept so far: id, text, answer, stem."""
        return self.spark.read.schema("id long, text string, answer string, stem string").parquet(f"{self.root}/kept")

    def add(self, questions: DataFrame, batch: int) -> None:
        """Keep those of a batch's questions that repeat none; batches are numbered from 0."""
        q = saved(described(questions, self.least), "unique-batch")
        ranks = self.spark.read.schema("word string, rank long").parquet(f"{self.root}/ranks") if batch else None
        if ranks is None:
            df = q.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("rank"))
            df.write.mode("overwrite").parquet(f"{self.root}/ranks")
            ranks = self.spark.read.schema("word string, rank long").parquet(f"{self.root}/ranks")
        stems = saved(posted(q.where("stem IS NOT NULL").select("stem", "words").distinct(), ranks, self.threshold), "unique-posted")
        old = self._before("kept", "id long, text string, answer string, stem string", batch)
        repeats = alike(stems, self._before("postings", "stem string, n int, word string", batch), self.threshold).select(F.col("a").alias("stem"))
        for g in ("text", "answer"):
            q = q.join(shuffled(old.where(F.col(g).isNotNull()).select(g).distinct()), g, "left_anti")
        q = saved(q.join(shuffled(old.select("stem").where("stem IS NOT NULL").unionByName(repeats).distinct()), "stem", "left_anti"), "unique-new")
        left = stems.join(shuffled(q.where("stem IS NOT NULL").select("stem").distinct()), "stem", "left_semi")
        keeps = q.join(shuffled(decide(q, saved(alike(left, left, self.threshold), "unique-near")).where("kept").select("id")), "id", "left_semi")
        kept = self._append(keeps.select("id", *GROUPS), "kept", batch)
        self._append(left.join(shuffled(kept.where("stem IS NOT NULL").select("stem").distinct()), "stem", "left_semi"), "postings", batch)


def keep_unique(questions: DataFrame, index: QuestionIndex, state: str) -> StreamingQuery:
    """Run a stream of questions into an index, from where its last run stopped."""
    return finish(questions, "append", index.add, state)
