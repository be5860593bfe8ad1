"""Each stage of the pipeline on its own input, and the whole run."""

import os
import random
from collections import Counter

import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "mixing", "packing"]


def test_near_stage_keeps_one_of_each_group(spark):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(3, t), (5, t), (7, t + " more"), (9, "something else altogether, and long enough"), (11, None), (12, "")]
    df = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], DOC)
    out = corpus_pipeline.near_duplicates_out(spark, df, "")
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [3, 9, 11, 12]


def test_line_stage_follows_the_text(spark):
    df = spark.createDataFrame([(i, f"Top\nown {i}", "en", "s", 9) for i in range(8)], DOC)
    out = corpus_pipeline.lines_out(spark, df, "").collect()
    assert {(r["text"], r["n_chars"]) for r in out} == {(f"own {i}", 5) for i in range(8)}


def test_line_stage_finds_planted_lines_and_keeps_bodies(spark):
    """In a source of 400 documents lines on 5 and 10 % go; a body line on 1.5 % and the body of 30 exact copies stay."""
    rows = [(i, f"own {i}" + "\nten" * (i % 10 == 0) + "\nfive" * (i % 20 == 3) + "\nbody" * (i % 67 == 5)) for i in range(400)] + [(1000 + i, "copied whole\nbody of copies") for i in range(30)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines_out(spark, df, "").collect()}
    assert got == {i: t.replace("\nten", "").replace("\nfive", "") for i, t in rows}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    assert out.count() > 100


def test_toxic_stage_keeps_columns_of_any_name(spark):
    rng = random.Random(2)
    words = ["an", "the", "oust", "tier", "stan"]
    text = lambda y: " ".join([rng.choice(words) for _ in range(40)] + ["halunke grobian"] * y)
    rows = [(i, text(i % 3 == 0), "en", "s", 9, 9.0, 8.0) for i in range(120)] + [(500, None, "en", "s", 0, 9.0, 8.0), (501, " ", "en", "s", 1, 9.0, 8.0)]
    df = spark.createDataFrame(rows, DOC + ", score double, _score double")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/labels-of-test"
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.toxic_out(spark, df, folder)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == df.columns and {(r["score"], r["_score"]) for r in out.collect()} == {(9.0, 8.0)}
    assert {500, 501} <= kept and len(kept & {i for i in range(120) if i % 3}) > 75 and len(kept & {i for i in range(120) if i % 3 == 0}) < 5


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages_against_plain_versions(spark):
    """Lines, near duplicates, mixing and packing of the smallest table, each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    before, lined = rows(docs), corpus_pipeline.lines_out(spark, docs, DIR)
    pages = {}
    for r in before.values():
        pages.setdefault(r["source"], set()).add(r["text"])
    after = rows(lined)
    for i, r in before.items():
        own = pages[r["source"]]
        n = Counter(k for t in own if t is not None for k in {x.strip(" \t\r") for x in t.split("\n")})
        bad = {k for k, c in n.items() if k and c > 1 and c > 0.02 * len(own) + 3 * (len(own) * 0.02 * 0.98) ** 0.5}
        want = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if x.strip(" \t\r") not in bad)
        assert after[i]["text"] == want and after[i]["source"] == r["source"]
    near = brute.near_duplicates([(i, r["text"]) for i, r in after.items()])
    kept = corpus_pipeline.near_duplicates_out(spark, lined, DIR)
    assert set(rows(kept)) == {i for i, (_, c) in near.items() if c == i}
    mixed = corpus_pipeline.mixed(spark, kept, DIR)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(rows(kept)) and mixed.columns == docs.columns
    pieces = corpus_pipeline.packed(spark, mixed, DIR).collect()
    tokens = Counter()
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
    assert all(tokens[i] == n * next(p["doc_tokens"] for p in pieces if p["doc_id"] == i) for i, n in copies.items())
