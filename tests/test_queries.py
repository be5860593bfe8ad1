"""Registered queries against DuckDB on the smallest tables; the whole list is compared by `__spark_entry__` users at sf0.01."""

import os

import duckdb
import pandas as pd
import pytest

from gradus.plans.registered import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "A3_readability_report", "A10_concept_coverage", "A13_face_report", "A14_confusion_matrix", "A15_cohen_kappa", "A17_failure_rates", "A25_translation_status", "C2_headline_delta", "C5_confusion_side_by_side", "D4_lo_near_pairs",
    "D7_merge_section_pairs", "G3_fallback_edges", "G7_bgp", "G11_sections_by_lesson", "G13_infer_edges", "J6_offset_to_page", "J8_bind_edges", "J9_concept_mentions", "L17_lint_question", "R6_homogeneity", "R7_parse_face", "S5_pages_from_markers",
    "ST1_stream_item_difficulty", "ST5_stream_attempt_sessions", "T2_search_content", "T9_stratified_sample", "T11_shuffle_options", "W2_best_cluster", "W6_merge_windows", "W7_chapter_ranges", "X6_detect_language", "X13_detect_outline",
    "A5_solvability_report", "A6_stem_only_report", "A23_distractor_recovery", "A32_question_quality_map", "C3_coverage_delta", "C4_flag_delta", "C6_question_transitions", "C7_benchmark_overview", "C8_provider_reports", "D6_distractor_match",
    "D8_section_overlap_pairs", "F7_lo_grounded", "F9_bad_translations", "F12_drop_phantom_sections", "G5_ontology_context", "J12_cross_lesson_edges", "L18_corpus_flags", "R11_parse_objects", "R11_parse_relations", "R11_parse_sections",
    "D6_best_over_all", "A2_lint_report_vectors", "L20_overview_lights", "L20_question_badges", "R9_judged_verdict", "A31_quiz_scores", "G4_clean_edges", "J2_edges_for_lesson", "R11_parse_objects", "T3_rag_context", "T15_focus_context", "A24_complete_languages", "J3_resolve_objective", "J5_question_pages", "D2_question_dedup_answer", "T13_lesson_context", "X21_vocabulary_maps", "U5_cohen_kappa", "U1_with_function", "U2_with_asked", "A10_coverage_levels", "A18_lo_clusters", "T10_quiz_autoselect", "G6_knowledge_base", "G11_kb_sections", "G12_kb_objects", "G13_infer_all", "S8_write_snapshot", "S9_read_snapshot", "S9_read_metrics", "S10_hydrate_metrics", "S10_hydrate_store", "D11_store_invalidated", "E2_best_match_all", "ST1_progress_report", "ST2_stream_spend", "ST2_stream_spend_sliding", "ST3_stream_metric_upsert", "S3_load_nested_bank", "S11_export_triples", "S13_source_passages", "W5_uncovered_runs", "X12_find_cues", "X15_outline_sample", "X19_assign_lo_pages",
]


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "NULL"
    if isinstance(v, (bool, str)):
        return str(v)
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda x: sorted(tuple(plain(v) for v in r) for r in x[columns].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_every_query_has_sql_or_a_reason():
    without = {"D3_question_dedup_near", "D4_lo_dedup", "D7_merge_sections", "D8_sections_overlap_dedup", "W9_section_batches", "W10_chunk_text", "X9_title_variants", "U3_nfkc", "ST4_stream_question_unique", "D9_inject_located"}
    assert set(QUERIES) - set(ORACLES) == without


def test_entry_imports():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_objects_are_grounded_in_every_document(spark):
    """Documents are dealt out to the objects by their number; none is left unread."""
    got = {r["doc_id"] for r in QUERIES["F7_lo_grounded"](spark, DIR).collect()} - {None}
    assert got == {r["doc_id"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect()}


def test_near_titles_of_different_lessons_are_pairs(spark):
    pairs = QUERIES["D4_lo_near_pairs"](spark, DIR).collect()
    assert any(r["a"] // 1000 != r["b"] // 1000 for r in pairs) and any(r["a"] % 3 for r in pairs)


def test_edges_of_objects_are_cut_before_they_are_grouped(spark):
    from gradus.sources.fixtures import Fixtures

    fx = Fixtures(spark, DIR)
    lo = {r["item_id"] for r in fx.benchmark.collect()}
    want = {tuple(r) for r in fx.edges.collect() if r["source_id"] in lo and r["target_id"] in lo}
    assert {tuple(r) for r in fx.object_edges.collect()} == want and want
    plan = fx.object_edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_edges_are_dealt_to_more_tasks_as_the_table_grows(spark, monkeypatch):
    from gradus.sources import fixtures

    plain = fixtures.Fixtures(spark, DIR).edges
    want = sorted(tuple(r) for r in plain.collect())
    monkeypatch.setattr(fixtures, "EDGE_ROWS", 500)
    dealt = fixtures.Fixtures(spark, DIR).edges
    rows = dealt.sparkSession.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert dealt.rdd.getNumPartitions() == rows // 500 + 1 > 4 and sorted(tuple(r) for r in dealt.collect()) == want
    assert "SortAggregate" not in plain._jdf.queryExecution().executedPlan().toString()


def test_triples_hold_whole_contents(spark):
    from gradus.sources.fixtures import Fixtures

    fx = Fixtures(spark, DIR)
    plain = lambda x: x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    want = {plain(r["content"]) for r in fx.sections.select("content").union(fx.learning_objects.select("content")).collect()}
    lines = [r["line"] for r in QUERIES["S11_export_triples"](spark, DIR).where("contains(line, '<urn:x:hasContent>')").collect()]
    assert {x.split('> "', 1)[1].removesuffix('" .') for x in lines} == want and max(map(len, want)) > 500
