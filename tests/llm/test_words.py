"""Periodic runs, pairs of symbols and spelling variants against brute force and the tokenizer library."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradus.llm import bpe, periodic_runs, queries, spelling

public_tokenizers = pytest.importorskip("public_tokenizers")


def written(spark, folder, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


CLASH = "doc_id long, text string, n long, word string, runs string, ids string, v string, state string, start string, root string"


def clashing(rows):
    return [(*r, 7, "word", "runs", "ids", "v", "state", "start", "root") for r in rows]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(1, 9), st.integers(0, 3))
def test_any_slices_give_all_runs(words, step, alphabet):
    words = [w % (alphabet + 1) for w in words]
    want = brute.all_runs(words)
    catch = periodic_runs.Catchers(len(words))
    for i in range(0, len(words), step):
        catch.append(np.array(words[i : i + step], np.int64))
    assert [tuple(r) for r in catch.runs().tolist()] == want
    assert [tuple(r) for r in periodic_runs.runs_of([words, [], words])[2].tolist()] == want


def test_long_runs():
    rng = random.Random(3)
    block = [rng.randint(0, 9) for _ in range(777)]
    words = [*range(100, 400), *block * 5, *block[:300], *[5] * 70_000, *range(500, 1500), *[1, 2, 3] * 40_000]
    at = 300 + 5 * 777 + 300
    got = [tuple(r) for r in periodic_runs.runs_of([[1, 2], words])[1].tolist()]
    assert (300, 5 * 777 + 300, 777) in got or any(q == 777 and s <= 300 and n >= 5 * 777 for s, n, q in got)
    assert any(q == 1 and n >= 70_000 and abs(s - at) < 2 for s, n, q in got) and any(q == 3 and n >= 120_000 for _, n, q in got)
    assert len(periodic_runs.collapsed(words, np.array(got))) < 300 + 777 + 1100


def test_op12(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "b c " * 4, "x x x x " * 3, "é é é é é é é", "tail " + "one two three " * 9 + "end"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(str(rng.randint(0, 50)) for _ in range(400)) for _ in range(40)]
    rows = [*enumerate(texts), (3, "a"), (3, "other words"), (None, "b " * 9), (None, None)]
    folder = written(spark, tmp_path / "a", clashing(rows), CLASH)
    got = queries.op12_periodic_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(((i, *brute.op12_row(i, t)) for i, t in rows), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert any(r[1] for r in want) and queries.op12_periodic_runs(spark, written(spark, tmp_path / "e", [])).count() == 0
    parts = periodic_runs.collapse(spark.createDataFrame([(1, "x " + "y z " * 5)], "doc_id long, text string")).collect()[0]
    assert parts["collapsed"] == "x y z" and [tuple(r) for r in parts["runs"]] == [(1, 10, 2)]


def test_op13(spark, tmp_path):
    rng = random.Random(7)
    exact = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    odd = "a\x1cb \x1f\x85    　​ x́ ½ ² 日本語 \U0001f600\U0001f600 don't WE'LL 'S\r\n\r\n  \t end   "
    texts = [None, "", " ", odd, "a" * 5000, "ab" * 3001, "   " * 700, "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "<|endoftext|", "the theatre The THE", "\x00\x01 \x7f"]
    texts += ["".join(rng.choice("ab th e.,'é \n中1") for _ in range(rng.randint(1, 300))) for _ in range(120)]
    texts += ["word " * 20_000 + odd * 50]
    rows = [*enumerate(texts), (3, odd), (None, "null id")]
    folder = written(spark, tmp_path / "a", clashing(rows), CLASH)
    got = queries.op13_bpe(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, t in rows:
        ids = exact.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(exact.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert queries.op13_bpe(spark, written(spark, tmp_path / "e", [])).count() == 0
    split = bpe.encode(spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string"), chars=200)
    assert {r["text"] for r in bpe.decode(split).collect()} == {t or "" for t in texts}


def test_decoding_bytes_that_are_no_text():
    vocab, exact = bpe.vocabulary(str(public_tokenizers.path("byte_bpe_50k.json"))), Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(0, 50_257, 12)
        assert vocab.decode(ids) == exact.decode(ids.tolist(), skip_special_tokens=False)


def test_merges_of_lower_rank_are_refused(tmp_path):
    import json

    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="lower rank"):
        bpe.Vocabulary(str(tmp_path / "v.json"))


def test_op11(spark, tmp_path):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀÀÀÀÀ", "÷×÷×÷×", "z" * 300, "z" * 301]
    for w in base[:50]:
        i = rng.randrange(len(w))
        base += [w[:i] + rng.choice("abcÉ") + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + rng.choice("xyz") + w[i:]]
    texts = [" ".join(rng.choice([w, w.upper(), w.capitalize()]) for w in rng.choices(base, weights=[1 + 40 // (i % 17 + 1) for i in range(len(base))], k=80)) for _ in range(150)]
    rows = [*enumerate([*texts, None, "", "ab cd", texts[0]]), (3, texts[3]), (None, texts[1]), (None, texts[1])]
    folder = written(spark, tmp_path / "a", clashing(rows), CLASH)
    want = brute.variants(rows)
    got = queries.op11_spelling(spark, folder)
    assert set(got.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
    plain = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()}
    assert plain == want and len(want) > 100
    assert any(root != form for form, root, *_ in want.values() if form) and any(f is None and k for f, _, _, k, _ in want.values())
    assert queries.op11_spelling(spark, written(spark, tmp_path / "e", [])).count() == 0


@pytest.mark.parametrize("node_words", [2, 20, 100_000])
def test_every_depth_meets_each_pair_once(spark, node_words):
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abcdefghijklmnop"[: rng.choice([2, 4, 16])]) for _ in range(rng.randint(5, 7))) for _ in range(400)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = sorted(tuple(sorted((r["a"], r["b"]))) for r in spelling.near_words(df, node_words).collect())
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if spelling.one_edit(*sorted((a, b), key=len)))
    assert got == want and len(want) > 50
