"""The shapes that the operators take (lessons, questions, edges, ...), derived from the tables of a folder.

Each is a lazy DataFrame over whole tables; `fixture_sql` has the same definitions for DuckDB."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.text import tokens

#: Metric, JSON path and direction (None: neutral) of the headline numbers of two snapshots. Fixed values.
HEADLINES = [
    ("lint", "average_score", True), ("solo_judge", "cohen_kappa", True), ("solo_judge", "accuracy", True), ("cove", "support_rate", True), ("cove", "needs_review", False), ("solvability", "mean_p_value", None),
    ("stem_only", "h4_pass_rate", True), ("ioc", "ioc_index", True), ("ambiguity", "ambiguity_rate", False), ("readability", "mean_flesch_kincaid_grade", False), ("grammar_homogeneity", "homogeneous_rate", True),
    ("grammar_homogeneity", "correct_outlier_count", False), ("face_validity", "mean_face_validity_score", True),
]
#: Metric of the overview, payload, JSON path (None: a rate of two counts), whether experts' questions have it. Fixed values.
OVERVIEW = [
    ("solo_kappa", "solo_judge", "cohen_kappa", False), ("ioc", "ioc", "ioc_index", False), ("stem_only", "stem_only", "h4_pass_rate", True), ("cove_supported", "cove", "support_rate", True), ("solvability", "solvability", "mean_p_value", True),
    ("face", "face_validity", "mean_face_validity_score", True), ("ambiguity", "ambiguity", "ambiguity_rate", True), ("grammar_outlier", "grammar_homogeneity", None, True), ("lint", "lint", "average_score", True), ("readability", "readability", "mean_flesch_kincaid_grade", True),
]
#: Words of the texts and the phrases that stand for them in `cue_lessons`.
CUE_PHRASES = [
    ("loser", "a common misconception"), ("idiot", "česta greška"), ("pathetic", "students often think"), ("scum", "za razliku od drugih"), ("worthless", "not to be confused with"), ("moron", "nije isto što i"),
    ("trash", "Contrary to intuition"), ("clown", "izgleda kao krug ali je elipsa"), ("disgusting", "some people mistakenly"), ("stupid", "umesto mase, neki misle"),
]
#: Objects up to which they are broadcast.
BROADCAST = 1_000_000
#: Rows of lineitem that a task groups into edges, so that its memory doesn't grow with the table.
EDGE_ROWS = 1_000_000
LEVELS = ["unistructural", "multistructural", "relational", "extended_abstract"]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def level_at(i) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), i + 1)


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def lessons(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("lesson_id"), F.concat("source", F.lit("/"), F.expr("doc_id div 200").cast("string")).alias("course_id"), F.concat_ws(" ", F.slice(tokens(F.col("text"), lower=False), 1, 3)).alias("title"), F.col("text").alias("raw_content"), F.col("lang")
        )

    @cached_property
    def lesson_pages(self) -> DataFrame:
        return self.lessons.select("lesson_id", F.posexplode(F.split("raw_content", "\n")).alias("p", "page_text")).select("lesson_id", (F.col("p") + 1).alias("page"), "page_text")

    @cached_property
    def sections(self) -> DataFrame:
        """Every fifth page opens a section; it runs to the page before the next one."""
        words = F.split("page_text", " ")
        return self.lesson_pages.where("page % 5 = 1").select(
            (F.col("lesson_id") * 1000 + F.col("page")).alias("section_id"), "lesson_id", F.concat_ws(" ", F.slice(words, 1, 3)).alias("title"),
            F.slice(words, 4, 2).alias("key_topics"), F.col("page").alias("start_page"), (F.col("page") + 4).alias("end_page"), F.expr("page div 5").alias("order_index"), F.col("page_text").alias("content"),
        )

    @cached_property
    def learning_objects(self) -> DataFrame:
        words = tokens(F.col("text"), lower=False)
        return self.benchmark.select(
            F.col("item_id").alias("lo_id"), F.expr("item_id div 14").alias("lo_section"), F.expr("item_id div 28").alias("lo_lesson"), F.concat_ws(" ", F.slice(words, 1, 3)).alias("title"),
            F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 8)), 1, 6).alias("keywords"), F.col("text").alias("content"),
            F.element_at(F.array(*[F.lit(x) for x in ("concept", "procedure", "example", "law")]), (F.col("item_id") % 4 + 1).cast("int")).alias("object_type"),
            F.when(F.col("item_id") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("item_id") % 7 + 1).cast("int"), (F.col("item_id") % 7 + 3).cast("int"))).alias("source_pages"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges(self.lineitem, self.lineitem.count() // EDGE_ROWS + 1)

    @cached_property
    def object_edges(self) -> DataFrame:
        """The edges both of whose ends are learning objects; the rows of others go before they are grouped."""
        lo = self.benchmark.select(F.col("item_id").alias("l_partkey"))
        ends = F.broadcast(lo) if lo.count() <= BROADCAST else lo
        return self._edges(self.lineitem.join(ends, "l_partkey", "left_semi").join(ends.withColumnRenamed("l_partkey", "l_suppkey"), "l_suppkey", "left_semi"))

    def _edges(self, lines: DataFrame, tasks: int = 1) -> DataFrame:
        """Where that is more than Spark's own number of partitions, the rows are dealt to so many tasks. The order of flags goes as a number, which aggregates by hash, without a sort."""
        f = F.col("l_returnflag")
        rank = F.when(f < "A", 0).when(f == "A", 1).when(f < "N", 2).when(f == "N", 3).otherwise(4)
        kinds = F.when(F.col("f") == 1, "part_of").when(F.col("f") == 3, "prerequisite").otherwise("relates_to")
        pairs = lines.select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), rank.alias("f")).where("source_id <> target_id")
        if tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            pairs = pairs.repartition(tasks, "source_id", "target_id")
        return pairs.groupBy("source_id", "target_id").agg(F.min("f").alias("f")).select("source_id", "target_id", kinds.alias("relationship_type"))

    @cached_property
    def questions(self) -> DataFrame:
        c = self.conversations
        user = c.where("role = 'user'").select("conv_id", "turn", "text")
        reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
        q = user.join(reply, ["conv_id", "turn"]).withColumn("question_id", F.col("conv_id") * 1000 + F.col("turn"))
        stem = F.concat(F.when(F.col("question_id") % 5 == 0, "Which is not ").otherwise(""), F.col("text"), F.when(F.col("question_id") % 3 != 0, "?").otherwise(""))
        pieces = F.filter(F.transform(F.split("reply", r"[.\n]+"), lambda x: F.trim(x)), lambda x: x != "")
        q = q.crossJoin(F.broadcast(self.benchmark.agg(F.count("*").alias("objects"))))  # one row
        q = q.withColumn("options", F.slice(pieces, F.lit(1), (F.col("conv_id") % 5 + 2).cast("int"))).withColumn("n", F.size("options"))
        q = q.withColumn("key", F.when((F.col("conv_id") % 17 == 0) | (F.col("n") == 0), None).otherwise((F.col("conv_id") % F.greatest("n", F.lit(1))).cast("int")))
        return q.select(
            "question_id", stem.alias("question_text"), "options", F.col("key").alias("correct_option_index"), F.get("options", F.col("key")).alias("correct_answer"), level_at((F.col("conv_id") % 4).cast("int")).alias("solo_level"),
            F.try_mod(F.col("conv_id"), F.col("objects")).alias("learning_object_id"), F.col("conv_id").alias("primary_lesson_id"), (F.col("conv_id") + 1).alias("secondary_lesson_id"), F.expr("conv_id div 10").alias("quiz_id"), (F.col("conv_id") % 7).alias("question_section_id"),
        )

    @cached_property
    def numeric_questions(self) -> DataFrame:
        """The quantities of an order as options."""
        rows = self.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("o")))).alias("x"))
        return rows.select(F.col("l_orderkey").alias("question_id"), F.transform("x", lambda s: s["o"]).alias("options"), (F.col("l_orderkey") % F.size("x")).cast("int").alias("correct_option_index"))

    @cached_property
    def option_vectors(self) -> DataFrame:
        """Four options a question: the first is the key, the others blend towards their own vector."""
        e = self.embeddings.select(F.expr("vec_id div 4").alias("question_id"), (F.col("vec_id") % 4).cast("int").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("own"))
        key = e.where("pos = 0").select("question_id", F.col("own").alias("k"))
        w = F.when(F.col("pos") == 0, 1.0).when(F.col("pos") == 1, 0.95).when(F.col("pos") == 2, F.when(F.col("question_id") % 3 == 0, 0.94).otherwise(0.6)).otherwise(0.0)
        j = e.join(key, "question_id").withColumn("w", w)
        return j.select("question_id", "pos", F.zip_with("k", "own", lambda a, b: F.col("w") * a + (1 - F.col("w")) * b).alias("vector"))

    @cached_property
    def judge_pairs(self) -> DataFrame:
        return self.labels.select("doc_id", level_at((F.col("doc_id") % 4).cast("int")).alias("intended"), level_at(F.col("quality") + 2 * F.col("toxic")).alias("classified"))

    @cached_property
    def raw_responses(self) -> DataFrame:
        text = F.concat(F.lit('Sure: {"rating": '), (F.col("quality") - F.col("toxic")).cast("string"), F.lit(', "reasoning": "r", "level": "'), level_at((F.col("doc_id") % 4).cast("int")), F.lit('", "choice": "'), F.substring(F.lit("ABCDEF"), (F.col("doc_id") % 6 + 1).cast("int"), F.lit(1)), F.lit('", "confidence": 0.'), (F.col("doc_id") % 10).cast("string"), F.lit("} done"))
        return self.labels.select(F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 13 == 0, F.substring(text, 1, 20)).otherwise(text).alias("response"))

    @cached_property
    def trials(self) -> DataFrame:
        return self.events.select("event_id", F.col("user_id").alias("question_id"), (F.col("event_type") == "purchase").alias("correct"), (F.col("event_type") == "error").alias("parse_failure"))

    @cached_property
    def call_log(self) -> DataFrame:
        return self.events.select("event_id", "ts", F.col("event_type").alias("provider"), F.floor(F.col("value") * 10).cast("long").alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"))

    @cached_property
    def attempts(self) -> DataFrame:
        return self.events.select("event_id", "ts", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 40).alias("item"), (F.col("event_id") % 4).cast("int").alias("answer"))

    @cached_property
    def metric_payloads(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("metric_key"), F.col("user_id").alias("scope_id"), F.col("props").alias("payload"), F.col("ts").alias("created_at"), "event_id", "value")

    @cached_property
    def translations(self) -> DataFrame:
        """Documents that begin alike are translations of the first of them."""
        title = F.concat_ws(" ", F.slice(tokens(F.col("text"), lower=False), 1, 3)).alias("title")
        d = self.documents.select("doc_id", "lang", "text", title)
        first = d.groupBy("title").agg(F.min("doc_id").alias("question_id"))
        return d.join(first, "title").select("question_id", F.col("lang").alias("language_code"), F.expr("question_id div 20").alias("quiz_id"), F.col("text").alias("translated"), "doc_id")

    @cached_property
    def cue_lessons(self) -> DataFrame:
        """Lessons in which ten words stand for phrases that announce a misconception."""
        text = F.col("raw_content")
        for word, phrase in CUE_PHRASES:
            text = F.replace(text, F.lit(word), F.lit(phrase))
        return self.lessons.select("lesson_id", text.alias("raw"))

    @cached_property
    def section_objects(self) -> DataFrame:
        """A learning object a section: a third with the section's title, a third with a title that is nowhere and keywords, a third with neither."""
        kind = F.col("section_id") % 3
        title = F.when(kind == 0, F.col("title")).otherwise(F.concat(F.lit("qq "), F.col("section_id").cast("string")))
        return self.sections.select("section_id", "lesson_id", "start_page", "end_page", title.alias("lo_title"), F.when(kind < 2, F.col("key_topics")).otherwise(F.array().cast("array<string>")).alias("keywords"))

    @cached_property
    def validation(self) -> DataFrame:
        """A JSON payload for each snapshot and metric, with numbers of its documents; coverage is nested, a payload a lesson."""
        n = self.snapshots.groupBy("snapshot").agg(F.sum("n_chars").alias("c"), F.count_if(F.contains("text", F.lit("?"))).alias("q"))
        number = lambda i: ((F.col("c") * (i + 1) + F.col("q")) % 9973 / 100).cast("decimal(20,2)").cast("string")
        keys = list(dict.fromkeys(k for k, *_ in HEADLINES))
        rows = [n.select("snapshot", F.lit(k).alias("metric_key"), F.lit(None).cast("int").alias("lesson"), F.concat(F.lit("{"), *[x for j, i in enumerate([i for i, h in enumerate(HEADLINES) if h[0] == k]) for x in (F.lit((", " if j else "") + f'"{HEADLINES[i][1]}": '), number(i))], F.lit("}")).alias("payload")) for k in keys]
        per = self.snapshots.groupBy("snapshot", "lesson").agg(F.sum("n_chars").alias("w"), F.sum(F.when(F.col("n_chars") > 1000, F.col("n_chars")).otherwise(0)).alias("hit"))
        pct = (F.expr("10000 * hit div w") / 100).cast("decimal(20,2)").cast("string")
        rows.append(per.select("snapshot", F.lit("coverage").alias("metric_key"), "lesson", F.concat(F.lit('{"concept_coverage": {"weighted_concept_coverage_pct": '), pct, F.lit("}}")).alias("payload")))
        return reduce(DataFrame.unionByName, rows)

    @cached_property
    def lesson_payloads(self) -> DataFrame:
        """A JSON payload for each course and metric, and for the experts' benchmark under `expert`."""
        n = self.documents.groupBy(F.col("source").alias("scope")).agg(F.sum(F.length("text")).alias("c"), F.count("*").alias("k"))
        n = n.unionByName(self.benchmark.agg(F.lit("expert").alias("scope"), F.sum(F.length("text")).alias("c"), F.count("*").alias("k")))
        number = lambda i: ((F.col("c") * (i + 1)) % 997 / 10).cast("decimal(20,1)").cast("string")
        body = lambda i, path: F.concat(F.lit("{" + f'"{path}": '), number(i), F.lit("}"))
        rows = [n.select("scope", F.lit(k).alias("metric_key"), (F.concat(F.lit('{"evaluated_questions": '), F.col("k").cast("string"), F.lit(', "correct_outlier_count": '), (F.col("c") % F.col("k")).cast("string"), F.lit("}")) if path is None else body(i, path)).alias("payload")) for i, (_, k, path, *_) in enumerate(OVERVIEW)]
        return reduce(DataFrame.unionByName, rows)

    @cached_property
    def quality_payloads(self) -> DataFrame:
        """Stored payloads of a lesson and metric with a report for each question; some reports have no question."""
        q = F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("event_id") % 500)
        key = F.when(F.col("event_type") == "error", "lint").otherwise(F.col("event_type"))
        reports = F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("at"), q.alias("question_id"), (F.col("event_id") % 7).alias("verdict"))))
        return self.events.groupBy(F.col("user_id").alias("lesson_id"), key.alias("metric_key")).agg(F.to_json(F.struct(reports.alias("reports"))).alias("payload"))

    @cached_property
    def bank(self) -> DataFrame:
        return self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("book"), F.col("o_orderkey").alias("item_id"), (F.col("o_orderstatus") == "F").alias("evaluated"))

    @cached_property
    def triples(self) -> DataFrame:
        iri = lambda kind, c: F.concat(F.lit(kind + "_"), F.col(c).cast("string"))

        def rows(df: DataFrame, s, p: str, o) -> DataFrame:
            return df.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))

        r, n, c, o = self.region, self.nation, self.customer, self.orders
        parts = [
            rows(r, iri("region", "r_regionkey"), "type", F.lit("Region")), rows(r, iri("region", "r_regionkey"), "label", F.col("r_name")),
            rows(n, iri("nation", "n_nationkey"), "type", F.lit("Nation")), rows(n, iri("nation", "n_nationkey"), "label", F.col("n_name")), rows(n, iri("region", "n_regionkey"), "hasNation", iri("nation", "n_nationkey")),
            rows(c, iri("customer", "c_custkey"), "type", F.lit("Customer")), rows(c, iri("customer", "c_custkey"), "label", F.col("c_name")), rows(c, iri("nation", "c_nationkey"), "hasCustomer", iri("customer", "c_custkey")),
            rows(o, iri("order", "o_orderkey"), "type", F.lit("Order")), rows(o, iri("customer", "o_custkey"), "hasOrder", iri("order", "o_orderkey")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def snapshots(self) -> DataFrame:
        """Documents as two snapshots of ten lessons each."""
        n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
        return self.documents.select("doc_id", F.when(n < 10, "before").otherwise("after").alias("snapshot"), (n % 10).alias("lesson"), "lang", "n_chars", F.col("text"))
