"""Mixing, toxicity, secrets, packing, fingerprints and lines against plain versions and exact round trips."""

import os
import random
import zlib

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

from gradus.llm import fingerprint, line_dedup, mixing, packing, secrets, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, source string, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], DOC)


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 40)), f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}") for i in range(900)] + [(900, None, "s0"), (901, "", None), (902, "a b", None), (902, "a b", None)]
    got = mixing.mix(frame(spark, rows), block=64).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len(brute.WORD.findall(dict((a, b) for a, b, _ in rows)[r["doc_id"]] or ""))
        s = by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2] += r["taken"]
        s[3] += r["size"]
    # water filling, by rounds
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, capped, target = 1.5 * sum(v[3] for v in by.values()), set(), {}
    while True:
        free = [s for s in order if s not in capped]
        share = left - sum(2 * by[s][3] for s in capped)
        target = {s: share * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * by[s][3]}
        if not over:
            break
        capped |= over
    for s in order:
        want = target.get(s, 2 * by[s][3]) if s not in capped else 2 * by[s][3]
        assert by[s][1] == pytest.approx(want) and by[s][0] == by[s][3]
        assert abs(by[s][2] - want) <= 41
    again = mixing.mix(frame(spark, rows), block=64).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(0, 1000, 500).astype(float), np.full(500, 0.3)
    out = mixing.flight(size, p, rng.random(503), land=False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    share = np.mean([mixing.flight(size[:30], p[:30], rng.random(33), land=True) for _ in range(400)])
    assert share == pytest.approx(0.3, abs=0.03)


def test_mixed_documents(spark):
    rows = [(i, "a b c", "s") for i in range(20)] + [(5, "a b c", "s")]
    out = mixing.mixed_documents(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "copies"]
    assert out.count() == round(1.5 * 21) or out.count() in (31, 32)


def test_pack_round_trip(spark):
    rng = random.Random(2)
    rows = [(0, None, "s"), (1, "", "s"), (2, "two  spaces and a tab\t\there ", "s"), (3, "<|endoftext|> inside", "s"), (4, "é" * 3000, "s")]
    rows += [(i, " ".join(rng.choice(["alpha", "beta", "1234", "x,y", "ñandú"]) for _ in range(rng.randint(1, 900))), "s") for i in range(5, 60)]
    pieces = packing.pack(frame(spark, rows).repartition(3)).collect()
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == i)
        assert sum(m[1] for m in mine) == len(ids) and all(p["doc_tokens"] == len(ids) for p in pieces if p["doc_id"] == i)
        at = 0
        for start, length, crc in mine:
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
    bins = {}
    for p in pieces:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # a power of two: no padding
    assert packing.pack(frame(spark, [])).count() == 0
    whole = [p for p in pieces if p["class_k"] > 0 and p["length"] == p["doc_tokens"] < 1024]
    assert whole and all(min(1024 // p["length"], packing.CLASSES) == p["class_k"] for p in whole if p["offset"] == 0)


def test_bins_take_a_fixed_number_of_documents():
    """Classes hold k whole documents each, sequences are full, and every id lies in one piece."""
    rng = random.Random(9)
    bins, rows, sizes = packing.Bins(1024, 0), [], [rng.choice([1, 5, 40, 300, 340, 341, 512, 513, 1023, 1024, 5000]) for _ in range(3000)]
    for i, n in enumerate(sizes):
        rows += bins.add(packing.Piece(i, 0, n, memoryview(bytes(4 * n)), n))
    rows += bins.rest()
    by, at = {}, {}
    for name, start, length, _, n, sequence, offset, k in rows:
        by.setdefault(sequence, []).append((offset, length, n, k))
        at.setdefault(name, []).append((start, length))
    assert all(sum(x[1] for x in s) == 1024 for s in list(by.values())[:-12])
    for s in by.values():
        k = s[0][3]
        if 1 < k < packing.CLASSES:
            assert sum(x[1] == x[2] and 1024 // x[1] == k for x in s) in (k, k + 1)
    for i, n in enumerate(sizes):
        assert sorted(at[i])[0][0] == 0 and sum(x[1] for x in at[i]) == n and all(a[0] + a[1] == b[0] for a, b in zip(sorted(at[i]), sorted(at[i])[1:], strict=False))
    assert len(rows) < 1.6 * sum(-(-n // 1024) for n in sizes)


def test_secrets(spark):
    k = "aB3dEfGh1jKlMn0pQrStUvWx"
    rows = [
        (0, None, "s0"), (1, "", "s0"), (2, 'é password = "abc", PASSWD:abcdefgh1 token=token:abcdefghi', "s0"), (3, "AKIA123 AKIAABCDEFGH1234 " + "0a" * 16 + " " + "f" * 31, "s1"), (4, "secret" * 3 + "=secret=abcdefgh1", "s1"),
        (5, f"key {k} and {k}", "s2"), (5, f"key {k} and {k}", "s2"), (6, "api_key: 'zzzzzzzz' apikey=yyyyyyyy", None), (7, "x" * 5000 + " api_key=" + "q1" * 40, "s3"), (None, "token=abcdefgh", "s3"),
    ]
    rows += [(10 + i, "shared " + "Zz9aQ7rT" * 3, f"o{i}") for i in range(4)]
    rows += [(100 + i, "copied q8Wm2Lx9Rt5Kz0Vb7Nc4", "s9") for i in range(21)]
    got = secrets.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in got:
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.base_secrets(text[r["doc_id"]])[:4]
        base = brute.base_secrets(text[r["doc_id"]])[4]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("owned")] == [s for s in base.split(",") if s]
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[5] == "owned:4:28,owned:33:57"  # one owner alone
    assert spans[10] == ""  # four owners share it
    assert spans[100] == "" and spans[7].startswith("assign") and "owned" not in spans[7]  # one owner has it in more repositories than a secret stands in
    assert secrets.scan(frame(spark, [])).count() == 0


def test_fingerprints(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(str(rng.randrange(500)) for _ in range(n))
    docs = [(0, None), (1, ""), (2, "one"), (3, "a b c d e")] + [(i, say(rng.choice([3, 30, 300, 900]))) for i in range(4, 40)]
    docs += [(40, docs[20][1]), (41, docs[20][1] + " tail"), (50, "é" * 7)]
    got = {r["doc_id"]: r for r in fingerprint.with_neighbours(frame(spark, [(i, t, "s") for i, t in docs])).collect()}
    want, text = brute.edited(docs), {i: t or "" for i, t in docs}
    for i, (n, sha, edited, follow) in want.items():
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert abs(r["near_edited"] - brute.jaccard(text[i], edited)) < 0.25 and abs(r["near_next"] - brute.jaccard(text[i], follow)) < 0.25
    assert got[40]["fingerprint"] == got[20]["fingerprint"] and got[0]["fingerprint"] == got[1]["fingerprint"] == fingerprint.EMPTY
    error = [got[i]["near_edited"] - brute.jaccard(text[i], want[i][2]) for i in want]
    assert abs(np.mean(error)) < 0.03
    odd = fingerprint.with_neighbours(frame(spark, [(1, "a", "s"), (1, "a", "s"), (None, "b c", "s")])).collect()
    assert len(odd) == 3
    assert fingerprint.with_neighbours(frame(spark, [])).count() == 0


def test_lines(spark):
    rows = [(i, f"Menu \nown {i}\n\nFooter", "h") for i in range(10)] + [(20, "Menu\nFooter", "other"), (21, None, "h"), (22, "Menu", None), (23, "", "h")]
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(frame(spark, rows), "source", "text").collect()}
    assert got[3]["text"] == "own 3\n" and (got[3]["n_lines"], got[3]["n_dropped"]) == (4, 2)
    assert got[20]["text"] == "Menu\nFooter" and got[21]["text"] is None and got[22]["text"] == "Menu" and got[23]["text"] == ""
    assert line_dedup.drop_boilerplate(frame(spark, []), "source", "text").count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "the", "ou", "ti", "er", "st"]) for _ in range(rng.randint(1, 3)))

    def text(toxic):
        w = [word() for _ in range(rng.randint(10, 120))]
        for _ in range(rng.randint(1, 5) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grobian", "halunke", "nitwit"]))
        return " ".join(w)

    label = {i: int(rng.random() < 0.2) for i in range(600)}
    docs = [(i, text(y), "s") for i, y in label.items()]
    labels = spark.createDataFrame([(i, y) for i, y in label.items() if i < 400] + [(None, 1), (5, None)], "doc_id long, toxic int")
    df = frame(spark, docs + [(700, None, "s"), (701, "", "s"), (702, text(1) + " nitwit " + text(1), "s")])
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[700] == got[701] < 0.3 < got[702]
    held = [(got[i] >= 0.3) == bool(label[i]) for i in range(400, 600)]
    assert np.mean(held) > 0.95
    none = toxicity.fit(df, labels.limit(0))
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.0}


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    """Toxic words that stand only after 9,000 characters of each toxic text train the dictionary and the curve."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "the", "ou", "ti", "er", "st"]) for _ in range(rng.randint(1, 3)))
    long = lambda: " ".join(word() for _ in range(2_500))
    rows = [(i, long() + (" halunke grobian nitwit" * 2 if i % 3 == 0 else ""), "s") for i in range(90)]
    assert min(len(t) for _, t, _ in rows) > 9_000
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, *_ in rows if i < 60], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    assert b"halunke" in model.toxic and b"grobian" in model.toxic
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, rows), model).collect()}
    assert min(got[i] for i in range(60, 90, 3)) > max(got[i] for i in range(60, 90) if i % 3)


def test_next_ids_with_outliers(spark):
    """Ids over all of a long's span, and ids that all but one lie close together, link in order from ranges of about equal size."""
    for ids in ([-(2**63), -5, 0, 7, 2**62, 2**63 - 1], [*range(2_000), 2**60]):
        df = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, n_chars long")
        got = {r["doc_id"]: r["next_id"] for r in fingerprint.next_ids(df, 8).collect()}
        assert got == dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    sizes = [r["count"] for r in fingerprint.ranges(df, 8).groupBy("range").count().collect()]
    assert max(sizes) < 600 and sum(sizes) == 2_001
    null = fingerprint.next_ids(spark.createDataFrame([(None, 1), (3, 1), (4, 1)], "doc_id long, n_chars long"), 2).collect()
    assert {r["doc_id"]: r["next_id"] for r in null} == {None: 3, 3: 4, 4: 3}


def test_extra_columns_may_have_any_name(spark):
    shape = "doc_id long, text string, source string, n_lines long, n_dropped long, _host string, _bad string, _lines string, lines string, bad string, _row string, copies long, unit long, id long, size long, owner string, score double, t string, h long, k long, z boolean"
    rows = [(i, f"Menu\nown {i}", "h", 5, 6, "a", "b", "c", "d", "e", "f", 7, 8, 9, 10, "g", 0.5, "i", 11, 12, True) for i in range(8)]
    df = spark.createDataFrame(rows, shape)
    out = line_dedup.drop_boilerplate(df, "source", "text")
    assert sorted(out.columns) == sorted(df.columns) and {(r["text"], r["n_lines"], r["n_dropped"], r["_bad"], r["bad"]) for r in out.collect()} == {(f"own {i}", 2, 1, "b", "e") for i in range(8)}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and {tuple(r)[3:] for r in mixed.collect()} == {r[3:] for r in rows}
    assert fingerprint.with_neighbours(df).count() == packing.pack(df).select("doc_id").distinct().count() == secrets.scan(df).count() == 8


def test_equal_rows_are_dealt_out(spark):
    """Rows of one id and size are numbered without gaps, so that no block gets them all; the totals hold."""
    df = frame(spark, [(7, "a b c", "s")] * 500 + [(i, "a b", "s") for i in range(1000, 1200)]).repartition(6)
    rows = spark.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (x[0]["doc_id"], x[1] % 4 * (1 << 33) + x[1] // 4)), "doc_id long, unit long")
    ranks = mixing.ranked(rows, ["doc_id"], "test").collect()
    assert sorted(r["rank"] for r in ranks if r["doc_id"] == 7) == list(range(500)) and {r["rank"] for r in ranks if r["doc_id"] != 7} == {0}
    got = mixing.mix(df, block=64).collect()
    assert len(got) == 700 and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 6
    assert 700 < mixing.mixed_documents(df, block=64).count() < 1400


def test_lines_of_small_hosts(spark):
    """A line on one page alone stays, whatever the ratio; one on both pages of a host goes; deviations spare what may be chance."""
    rows = [(1, "a\nb", "one"), (2, "a\nc", "two"), (3, "a\nd", "two"), *[(10 + i, f"x{i}" + "\nrare" * (i < 2), "many") for i in range(40)]]
    text = lambda **kw: {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(frame(spark, rows), "source", "text", **kw).collect()}
    assert [text()[i] for i in (1, 2, 3)] == ["a\nb", "c", "d"]
    assert text(max_ratio=0.02)[10] == "x0" and text(max_ratio=0.02, deviations=3.0)[10] == "x0\nrare"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_toxicity_query(spark):
    """The registered query: a row a document, held out by its id, predicted by its score; held-out labels are found."""
    from gradus.llm import queries

    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    mean = lambda y: np.mean([got[i]["score"] for i, t in labels.items() if t == y and got[i]["held_out"]])
    assert mean(1) > 2 * mean(0)
