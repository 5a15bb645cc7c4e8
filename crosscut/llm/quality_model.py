"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its words, runs of signs and line ends (single and in pairs, hashed to 2^20 places) and the fact
that a word repeats the one before it; values are log(1 + count), scaled to length one. Training is per-coordinate
FTRL-proximal with L1 and L2 terms over a bounded sample of labelled rows (FIT_ROWS, of any length and whole), chosen by
a hash of doc_id from all labelled rows. Scores are sparse dot products of whole texts with the memory-mapped weights.

Defined cases: a null or empty text has the score of the bias alone; a very long text is read whole, alone in its slice; labels other than 0 and 1 and rows without a label
teach nothing, a doc_id labelled twice has its highest label; without any usable label every score is 0.5; repeated
rows, null ids and extra columns pass through, and an input column named like a result is replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts, mapped_file, put_file, shared_path, table
from .langid import held_out

BITS = 20
FIT_ROWS, EPOCHS = 6_000, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.5, 1.0
THRESHOLD = 0.3

TOKENS = regex.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")
MIX1, MIX2, MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text; place 2^BITS is that of a word that repeats the one before it."""
    import xxhash

    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, TOKENS.findall(text)), np.uint64)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    pairs = (ids[:-1] * MIX1 ^ ids[1:] * MIX2) * MIX3
    again = int((ids[:-1] == ids[1:]).sum())
    shift = np.uint64(64 - BITS)
    every = np.sort(np.concatenate([ids >> shift, pairs >> shift]).astype(np.int32))
    at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    places, counts = every[at].astype(np.int64), np.diff(np.append(at, len(every)))
    if again:
        places, counts = np.append(places, 1 << BITS), np.append(counts, again)
    values = np.log1p(counts)
    return places, (values / math.sqrt(float(values @ values))).astype(np.float32)


class Ftrl:
    """Per-coordinate follow-the-(proximally-)regularised-leader for logistic loss, with an unregularised bias."""

    def __init__(self, size: int = (1 << BITS) + 1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bz = self.bn = 0.0

    @staticmethod
    def _solve(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    @property
    def bias(self) -> float:
        return -self.bz / ((BETA + math.sqrt(self.bn)) / ALPHA)

    @property
    def weights(self) -> np.ndarray:
        return self._solve(self.z, self.n)

    def update(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        z, n, bias = self.z[places], self.n[places], self.bias
        w = self._solve(z, n)
        g = sigmoid(float(w @ values) + bias) - label
        step = g * values
        self.z[places] = z + step - (np.sqrt(n + step * step) - np.sqrt(n)) / ALPHA * w
        self.n[places] = n + step * step
        self.bz += g - (math.sqrt(self.bn + g * g) - math.sqrt(self.bn)) / ALPHA * bias
        self.bn += g * g


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", fit_rows: int = FIT_ROWS) -> str:
    """Weights learnt from labels (doc_id and label) of docs, written to the shared folder; returns their path."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    sample = known.withColumn("__h", F.xxhash64("doc_id")).orderBy("__h", "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")  # at most fit_rows rows of 20 bytes

    def kernel(texts: list[str]) -> dict:
        found = [features(t) for t in texts]
        return {"places": [p.astype("<u4").tobytes() for p, _ in found], "values": [v.tobytes() for _, v in found]}

    made = map_texts(rows, lambda: kernel, "places binary, values binary", ["__h", "doc_id", "__label"])
    got = sorted((tuple(r) for r in made.collect()), key=lambda r: r[:2])  # the bounded sample's sparse vectors
    vectors = [(np.frombuffer(p, "<u4").astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64), y) for _, _, y, p, v in got]
    model, order = Ftrl(), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(vectors)):
            model.update(*vectors[i])
    path = shared_path(docs.sparkSession, "quality")
    put_file(path, "weights", [model.weights.astype("<f4"), np.array([model.bias], "<f4")])
    return path


def score(docs: DataFrame, model: str, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (0 or 1)."""

    def make():
        weights = mapped_file(model, "weights", "<f4")
        bias = float(weights[-1])

        def kernel(texts: list[str]) -> dict:
            return {"score": [sigmoid(float(weights[p] @ v) + bias) for p, v in map(features, texts)]}

        return kernel

    out = map_texts(docs, make, "score double", [c for c in docs.columns if c not in ("score", "predicted")], text)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    model = fit(docs, table(spark, sf_dir, "labels").filter(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")
