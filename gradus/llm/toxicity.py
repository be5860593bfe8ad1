"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled rows, one on ordinary and one on toxic text. A window of `WINDOW` words is compressed with the
ordinary dictionary and with the toxic one (behind the ordinary one, since a toxic text is ordinary for the most part); how many bytes the
toxic one saves is the window's distance. Windows overlap by `WINDOW - STRIDE` words. A logistic curve, fitted on labelled rows that trained neither
dictionary, calibrates a document's largest savings and the counts of its windows beyond three thresholds to a score.

Most of a toxic text is ordinary, and the trainer keeps what is frequent: trained on whole toxic texts, or on those of their windows that compress worst,
the toxic dictionary holds ordinary phrases. So the toxic samples are what toxic texts have beside ordinary ones: their words around
runs of GRAM letters that many toxic texts hold and hardly any ordinary one does (a likelihood ratio test over the learning texts), a sample a text.

Fitting reads a bounded sample of rows: at most `sample` of each label, taken in the order of a hash of the id, one text for each id and each
distinct text once, read whole. Texts stay in Spark tasks; the driver gets at most `stretches` pieces of a label's texts from anywhere in them, counts of
letter runs, and the features of the rows for the curve. Scoring reads every whole text, and labels, language, source and id never enter a score. The fitted model is
two dictionaries of a few KB and some numbers.

Defined results: a null, empty or blank text has no window and scores 0; labels that are null are not
learnt from; without labels of both kinds every score is the share of toxic labels (0 without any labels); repeated rows get equal
scores; an empty table gives no rows; further columns are carried, one named like the score is replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

WINDOW = 6
STRIDE = 4
LEVEL = 3
ORDINARY_BYTES, TOXIC_BYTES = 32_000, 4_000
STRETCH = 256
GRAM = 4
#: Length of the toxic trainer's segments and of the runs that it counts, in bytes, so that a segment is a few words.
SEGMENT, RUN = 24, 8
TOP = 4
_SPLIT = re.compile("[\x20\x09-\x0d]+")


@dataclass
class Model:
    base: bytes
    toxic: bytes
    weights: list[float]
    prior: float

    def compressors(self) -> tuple:
        raw = zstandard.DICT_TYPE_RAWCONTENT
        return tuple(
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=raw), write_checksum=False, write_content_size=False, write_dict_id=False)
            for d in (self.base, self.base + self.toxic)
        )


def windows(text: str) -> list[bytes]:
    words = [w for w in _SPLIT.split(text.lower()) if w]
    return [(" " + " ".join(words[i : i + WINDOW]) + " ").encode() for i in range(0, max(len(words) - WINDOW + STRIDE, 1), STRIDE)] if words else []


def stretches_of(text: str) -> list[bytes]:
    b = " ".join(w for w in _SPLIT.split(text.lower()) if w).encode()
    return [b[i : i + STRETCH] for i in range(0, len(b), STRETCH)]


def savings(text: str, plain, toxic) -> list[float]:
    """Features of a whole text: its TOP largest window savings, and logs of how many windows save much."""
    saved = [len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text)]
    top = sorted(saved, reverse=True)[:TOP]
    top += [min(top, default=0)] * (TOP - len(top)) if top else [0] * TOP
    return [*map(float, top), *[math.log1p(sum(s >= least for s in saved)) for least in (3, 5, 7)], math.log1p(len(saved))]


def _log_likelihood(a: int, n: int, b: int, m: int) -> float:
    """Twice the log likelihood ratio of shares a / n and b / m against one common share."""

    def part(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)

    p = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p))


def grams(text: str) -> set[str]:
    """Runs of GRAM letters of a text in lower case."""
    return {g for i in range(len(text) - GRAM + 1) if " " not in (g := text[i : i + GRAM])}


def distinctive(counts: list[tuple[str, int, int]], n: int, m: int) -> set[str]:
    """Of (gram, toxic texts, ordinary texts), the runs that many of n toxic texts have and hardly any of m ordinary ones does."""
    return {g for g, a, b in counts if a >= max(3, 0.006 * n) and a / n > 30 * (b + 0.5) / m and _log_likelihood(a, n, b, m) > 20}


def beside(text: str, good: set[str]) -> list[bytes]:
    """The words of a text that hold a run of `good`, in stretches."""
    b = "".join(f" {w} " for w in (x.strip(".,!?;:") for x in _SPLIT.split(text.lower())) if grams(w) & good).encode()
    return [b[i : i + STRETCH] for i in range(0, len(b), STRETCH)]


def _train(samples: list[bytes], size: int, **how: int) -> bytes:
    """A trained dictionary's content; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError):
        return b" ".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 1_500, stretches: int = 20_000, tasks: int = 12) -> Model:
    """Fit on the whole texts of at most `sample` labelled ids of each label, in the order of a hash of the id; equal texts count once.

    Every third text is kept from the dictionaries, for the curve. A dictionary is trained on at most `stretches` stretches of STRETCH bytes, in the order of
    a hash, of all that the other texts of its label hold."""
    known = labels.select(labels[doc_id].alias("_id"), labels[label].cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)").distinct()
    share = known.agg(F.avg(F.col("_y").cast("double"))).first()[0] or 0.0
    taken = known.where("_y = 1").orderBy(F.xxhash64("_id"), "_id").limit(sample).unionByName(known.where("_y = 0").orderBy(F.xxhash64("_id"), "_id").limit(sample))
    found = docs.select(docs[doc_id].alias("_id"), docs[text].alias("_t")).join(F.broadcast(taken), "_id").where("_t <> ''")
    found = found.groupBy("_id", "_y").agg(F.min("_t").alias("_t")).groupBy("_t").agg(F.min_by("_y", F.struct("_id", "_y")).alias("_y"))
    found = found.withColumn("_k", F.struct(F.crc32(F.col("_t").cast("binary")).alias("c"), F.xxhash64("_t").alias("h")))
    rows = saved(found.repartition(tasks, "_k"), "toxicity-rows")
    keys: dict[int, list[tuple]] = {0: [], 1: []}
    for r in rows.select("_y", "_k").collect():
        keys[r["_y"]].append(tuple(r["_k"]))
    if not keys[0] or not keys[1]:
        return Model(b"", b"", [], share)
    curve = {k for ks in keys.values() for i, k in enumerate(sorted(ks)) if not i % 3 or len(ks) < 3}
    learn = {k for ks in keys.values() for i, k in enumerate(sorted(ks)) if i % 3 or len(ks) < 3}
    some = lambda kept, y: rows.where(F.udf(lambda k: tuple(k) in kept, "boolean")("_k")).where(F.col("_y") == y)

    def trained(y: int, pieces, size: int, **how: int) -> bytes:
        """The trainer sets its own parameters on the last samples, so they come in the order of the texts' hashes."""
        cut = some(learn, y).select("_k", F.posexplode(F.udf(pieces, "array<binary>")("_t")).alias("i", "b"))
        held = cut.orderBy(F.xxhash64("b", "_k", "i"), "_k", "i").limit(stretches).collect()
        return _train([bytes(r["b"]) for r in sorted(held, key=lambda r: (*r["_k"], r["i"]))], size, **how)

    n, m = (len(learn.intersection(keys[y])) for y in (1, 0))
    runs = some(learn, 0).unionByName(some(learn, 1)).select("_y", F.explode(F.udf(lambda t: list(grams(t.lower())), "array<string>")("_t")).alias("g"))
    counts = runs.groupBy("g").agg(F.sum("_y").alias("a"), F.sum(1 - F.col("_y")).alias("b")).where(F.col("a") >= max(3, 0.006 * n)).where(F.col("a") / n > 30 * (F.col("b") + 0.5) / m)
    good = distinctive([tuple(r) for r in counts.collect()], n, m)
    model = Model(trained(0, stretches_of, ORDINARY_BYTES), trained(1, lambda t: beside(t, good), TOXIC_BYTES, k=SEGMENT, d=RUN) or b" ", [], share)

    @F.udf("array<double>")
    def features(t):
        return [1.0, *savings(t, *model.compressors())]

    shown = sorted((r["_y"], r["x"]) for r in some(curve, 0).unionByName(some(curve, 1)).select("_y", features("_t").alias("x")).collect())
    model.weights = [float(w) for w in _logistic(np.array([x for _, x in shown]), np.array([y for y, _ in shown], float))]
    # the sample holds more toxic rows than the labels do: shift the curve to their share
    had = len(keys[1]) / (len(keys[0]) + len(keys[1]))
    model.weights[0] += math.log(max(share, 1e-6) / max(1 - share, 1e-6)) - math.log(had / (1 - had))
    return model


def score(df: DataFrame, model: Model, text: str | Column = "text", out: str = "score") -> DataFrame:
    """df with a column `out`: 0 to 1, higher where the text is likelier toxic. Every whole text is read."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        if not model.weights:
            return pa.array([model.prior] * len(texts), pa.float64())
        two = model.compressors()
        w = np.array(model.weights)

        def one(text: str) -> float:
            x = savings(text, *two)
            if not x[-1]:  # no window
                return 0.0
            z = float(np.dot(w, [1.0, *x]))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return pa.array([one(t.as_py() or "") for t in texts], pa.float64())

    return df.withColumn(out, of(df[text] if isinstance(text, str) else text))
