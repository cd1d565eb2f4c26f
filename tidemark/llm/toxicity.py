"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Features of a text are the sets of its hashed words, word pairs and pairs with one word between them, in 2 ** 22
buckets, of the whole text whatever its length. Training is online: every coordinate has a learning rate of its own,
and the L1 penalty leaves most weights at exactly zero, so that the model is a short list of buckets and weights, which is
broadcast. The logit is then scaled and shifted on labelled rows that training didn't see. A text without any feature
of weight gets the intercept's probability.

The classifier learns from at most ``sample`` labelled documents of either label (those of lowest hash), and of these from as many, in
that order, as have ``most_bytes`` / 2 bytes of features: bounds that don't grow with the corpus. The features are made on the executors; no
text goes to the driver. Scoring takes one scan without a shuffle.

Null, empty and blank texts have no features and get the intercept's score; repeated rows are scored each, and learnt from once a doc_id (the
text of lowest hash) and label; a label that is null or whose document is missing is not learnt from; without labels of both kinds the score is
the prior (0.5 without any). Texts of any length are scored whole, one at a time where they exceed a block; an empty table gives an empty
result. Only doc_id and text of the documents are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, within
from .text import PUNCTUATION, U64, blocks, grams, whole, words

BITS = 22
#: Word positions of each feature family.
FAMILIES = ((0,), (0, 1), (0, 2))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every occurrence, in no order."""
    w = words(data, offsets, PUNCTUATION)
    rows, buckets = [], []
    for k, shifts in enumerate(FAMILIES):
        g = grams(w.hash, shifts, 31 + k)
        at = np.arange(len(g))
        inside = whole(at, w, shifts[-1] + 1) if len(at) else np.zeros(0, bool)
        rows.append(w.row[: len(g)][inside])
        buckets.append((g[inside] >> U64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def row_features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct buckets of each text."""
    out = []
    for _, data, offsets in blocks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), "text"):
        row, bucket = features(data, offsets)
        order = np.argsort(row, kind="stable")
        cut = np.searchsorted(row[order], np.arange(len(offsets)))
        bucket = bucket[order]
        out += [np.unique(bucket[a:b]).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


@dataclass
class Model:
    bucket: np.ndarray
    weight: np.ndarray
    intercept: float
    scale: float = 1.0
    shift: float = 0.0

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.bucket] = self.weight
        return table


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(np.asarray(x, float), -500, 500)))


def train(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, epochs: int = 4, seed: int = 5) -> Model:
    """FTRL-proximal over rows of distinct buckets; labels 0 or 1."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weight(i: np.ndarray, zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        strict = np.where(i == bias, 0.0, l1)
        return np.where(np.abs(zi) <= strict, 0.0, -(zi - np.sign(zi) * strict) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i = np.append(rows[r], bias)
            zi, ni = z[i], n[i]
            w = weight(i, zi, ni)
            g = sigmoid(w.sum()) - labels[r]
            rate = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] = zi + g - rate * w
            n[i] = ni + g * g
    touched = np.flatnonzero(n)
    w = weight(touched, z[touched], n[touched])
    keep = (w != 0) & (touched != bias)
    return Model(touched[keep].astype(np.int32), w[keep].astype(np.float32), float(w[touched == bias].sum()))


def logit(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    table = model.dense()
    return np.array([table[r].sum() for r in rows]) + model.intercept


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, prior: float) -> Model:
    """Scale and shift of the logit that fit unseen labels, with the classes weighted to the prior."""
    share = y.mean() if len(y) else 0
    if not 0 < share < 1:
        return model
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9)
        hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hessian, [(g * x).sum() + 1e-3 * (a - 1), g.sum()])
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    model.scale, model.shift = float(max(a, 0.05)), float(b)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = [r.astype("<i4").tobytes() for r in row_features(part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, pa.binary())], names=["h", "label", "n", "buckets"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, most_bytes: int = 64 << 20) -> Model:
    """labels: doc_id, label (0, 1). At most ``sample`` documents of each label are taken, by hash of doc_id; a fifth of them calibrates."""
    ship(docs.sparkSession)
    labels = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    counts = dict(labels.groupBy("label").count().collect())
    chosen = None
    for label in (0, 1):
        part = labels.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    made = texts.select(F.xxhash64("doc_id").alias("h"), "label", "text").mapInArrow(_features, "h long, label int, n long, buckets binary")
    got = sorted(within(made, "label", "n", most_bytes // 2).select("h", "label", "buckets").collect(), key=lambda r: (r.h, r.label))
    y = np.array([r.label for r in got], float)
    if len(set(y)) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(share / (1 - share))))
    rows = [np.frombuffer(r.buckets, "<i4") for r in got]
    aside = np.random.default_rng(11).random(len(rows)) < 0.2
    aside &= len(rows) >= 50
    model = train([r for r, out in zip(rows, aside, strict=True) if not out], y[~aside])
    prior = counts[1] / sum(counts.values())
    return calibrate(model, logit(model, [r for r, out in zip(rows, aside, strict=True) if out]), y[aside], prior)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        table = model.dense()
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                row, bucket = features(data, offsets)
                heavy = table[bucket] != 0
                pairs = np.unique((row[heavy] << BITS) | bucket[heavy])
                x = np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], len(offsets) - 1) + model.intercept
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(model.scale * x + model.shift))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared), "doc_id long, score double")


def learnable(labels: DataFrame, label: str, fold: Column, out: int) -> DataFrame:
    """doc_id and label of the rows that aren't held out."""
    return labels.where(fold != out).select("doc_id", F.col(label).alias("label"))
