"""Near duplicates, repeated windows and vectors against plain versions, with planted groups and odd rows."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from gradus.llm import components, embed_dedup, minhash_dedup, substring_dedup, suffix_dedup

DOC = "doc_id long, text string, source string, n long, clash string"


def corpus(seed: int, words: int = 300) -> list:
    """Odd texts, exact and near copies, a passage in a third of all documents, repeats inside a document, words in runs."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(words)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(70)
    texts = [None, "", "   ", "one", "a b c d", "a b c d e", "x " * 200, "x y " * 120, passage, passage + " " + passage]
    texts += [say(rng.randint(1, 200)) for _ in range(25)]
    texts += [say(20) + " " + passage + "\n" + say(20) for _ in range(15)]
    base = say(120).split(" ")
    for _ in range(20):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += [texts[12], texts[12], texts[20].upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


def thue_morse(n: int, other: bool = False) -> str:
    """Two such words collide under polynomial hashes modulo powers of two."""
    return "".join("ab"[(bin(i).count("1") + other) % 2] for i in range(n))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "s", 1, "c") for i, t in docs], DOC)


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash(spark, seed):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.near_duplicates(docs)


def test_minhash_in_blocks(spark, monkeypatch):
    """The same result where lists and groups are cut into many small blocks."""
    monkeypatch.setattr(minhash_dedup, "SMALL", 3)
    monkeypatch.setattr(minhash_dedup, "CHUNK", 4)
    monkeypatch.setattr(minhash_dedup, "SET_CHUNK", 3)
    docs = corpus(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.near_duplicates(docs)


def test_minhash_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F")]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True)]
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_minhash_keeps_every_text_of_an_id(spark):
    """The links of each row of an id count, and words of many bytes are told apart."""
    rng = random.Random(11)
    say = lambda n: " ".join(str(rng.randrange(10_000)) for _ in range(n))
    x, y = say(60), say(60)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in minhash_dedup.near_duplicates(frame(spark, [(1, x), (1, y), (2, x + " tail"), (3, y + " tail"), (4, None), (1, "")])).collect()}
    assert got == {(1, 56): 1, (2, 57): 1, (3, 57): 1, (4, 0): 4, (1, 0): 1}
    got = minhash_dedup.near_duplicates(frame(spark, [(1, thue_morse(2048)), (2, thue_morse(2048, True)), (3, "x" * 9000), (4, "x" * 8999 + "y")])).collect()
    assert all(r["kept"] for r in got)


def test_regrouped_finds_all_links_between_components(spark):
    rng = random.Random(12)
    base = list(range(40))
    sets = {i: set(rng.sample(base, 36)) | {100 + 10 * i + k for k in range(rng.randrange(8))} for i in range(40)}
    groups = spark.createDataFrame([(i, i % 2, i // 4) for i in sets], "doc long, key long, comp long")
    got = minhash_dedup.regrouped(groups, spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "doc long, set array<bigint>"), 75)
    want = {(a, b) for a in sets for b in sets if a < b and a % 2 == b % 2 and a // 4 != b // 4 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = {tuple(sorted((r["a"], r["b"]))) for r in got.collect()}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("seed", [1, 4])
def test_substring(spark, seed):
    docs = corpus(seed, 12)
    got = {r["doc"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(frame(spark, docs), digest=True).collect()}
    assert got == brute.remove_words(docs)
    assert sum(v[1] for v in got.values()) > 500


@pytest.mark.parametrize("seed", [1, 5])
def test_suffix(spark, seed):
    docs = corpus(seed)
    got = {r["doc"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(frame(spark, docs), digest=True).collect()}
    assert got == brute.remove_bytes(docs)
    assert sum(v[1] for v in got.values()) > 500


def test_odd_rows_of_repeats(spark):
    rows = [(1, "z" * 300), (1, "z" * 300), (None, "z" * 300), (3, None)]
    got = suffix_dedup.dedup(frame(spark, rows)).collect()
    assert len(got) == 4 and {r["n_bytes"] for r in got} == {300, 0}
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0
    assert substring_dedup.dedup(frame(spark, [])).count() == 0


def test_texts_that_share_an_id(spark):
    """Repeats of the id's other text don't count, those of a lower id do, and each text keeps its own cuts."""
    rng = random.Random(13)
    say = lambda n: " ".join(str(rng.randrange(10_000)) for _ in range(n))
    p, q, r = say(120), say(120), say(120)
    rows = [(1, p), (2, p + " " + say(70)), (2, q), (3, r + " " + r), (3, r), (4, r + " end"), (4, q)]
    want_words = {(2, 190): 120, (4, 121): 120, (4, 120): 120}
    got = {(x["doc"], x["n_words"]): x["n_removed"] for x in substring_dedup.dedup(frame(spark, rows)).collect()}
    assert {k: v for k, v in got.items() if v} == want_words and len(got) == 7
    got = {(x["doc"], x["n_bytes"]): (x["n_removed"], x["n_spans"]) for x in suffix_dedup.dedup(frame(spark, rows)).collect()}
    n = len(r)
    assert {k: v for k, v in got.items() if v[0]} == {(2, len(rows[1][1])): (len(p), 1), (3, 2 * n + 1): (n, 1), (4, n + 4): (n + 1, 1), (4, len(q)): (len(q), 1)}


def test_words_that_collide_by_weak_hashes(spark):
    tail = " ".join(f"w{i}" for i in range(49))
    rows = [(1, thue_morse(2048) + " " + tail), (2, thue_morse(2048, True) + " " + tail), (3, tail)]
    assert {x["doc"]: x["n_removed"] for x in substring_dedup.dedup(frame(spark, rows)).collect()} == {1: 0, 2: 0, 3: 0}
    bits = [(1, thue_morse(4096)), (2, thue_morse(4096, True))]
    got = {x["doc"]: (x["n_bytes"], x["n_removed"], x["n_spans"]) for x in suffix_dedup.dedup(frame(spark, bits)).collect()}
    assert got == {i: v[:3] for i, v in brute.remove_bytes(bits).items()}


def test_long_texts_come_in_pieces(spark, monkeypatch):
    """Texts of many pieces, one letter, one word again and again, and no blank at all give what whole texts give."""
    rng = random.Random(14)
    say = lambda n: " ".join(str(rng.randrange(500)) for _ in range(n))
    shared = say(400)
    docs = [(1, say(700) + " " + shared), (2, "z" * 3000), (3, "no " * 900), (4, shared + "  " + say(900) + " " + shared), (5, "z" * 1500 + shared), (6, "no " * 400 + "z" * 700)]
    for module in (substring_dedup, suffix_dedup):
        monkeypatch.setattr(module, "PIECE", 777)
    col = pa.array([t for _, t in docs])
    for kind, window, split in ((substring_dedup.WORDS, 50, str.split), (suffix_dedup.BYTES, 100, list)):
        got = sorted((i + int(r), w) for i, x in kind.find(col) for r, f, n in zip(x.row, x.first, x.last, strict=True) for w in range(f, n + 1))
        assert got == [(i, w) for i, (_, t) in enumerate(docs) for w in range(len(split(t)) - window + 1)]
    got = {r["doc"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(frame(spark, docs), digest=True).collect()}
    assert got == brute.remove_words(docs)
    got = {r["doc"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(frame(spark, docs), digest=True).collect()}
    assert got == brute.remove_bytes(docs)


def test_anchor_depends_on_the_window_alone():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(6)]
    stretch = [rng.choice(vocabulary) for _ in range(80)]
    found = []
    for around in range(12):
        text = " ".join([rng.choice(vocabulary) for _ in range(around * 3)] + stretch + [rng.choice(vocabulary) for _ in range(around)])
        ((_, a),) = substring_dedup.find(pa.array([text]))
        at = {int(w): (int(k), int(p - w)) for k, p, f, n in zip(a.key, a.place, a.first, a.last, strict=True) for w in range(f, n + 1)}
        found.append([at[around * 3 + i] for i in range(31)])
    assert all(f == found[0] for f in found)


@pytest.mark.parametrize("chunk", [512, 3])
def test_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(15):
            v = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((i, [float(x) for x in v + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2])], label))
                i += 1
    rows += [(i, [0.0] * 16, 0), (i + 1, None, 0), (i + 2, [float("nan")] * 16, 0), (i + 3, [None] * 16, 0), (i + 4, [1.0] * 8, 0), (i + 5, [2.0] * 8, 0), (i + 6, [1.0] * 8, 0), (i + 7, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    exact = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    want = brute.vectors(exact)
    assert got == want and sum(v[0] for v in want.values()) > 50
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = brute.least_reachable({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == want
