"""Quality scores by random Fourier features, ridge regression and isotonic calibration.

A document is described by statistics of its whole text. Standardised, they pass through cosines of random
projections, whose inner products approximate a Gaussian kernel. Each partition sums its part of the normal equations
(X'X and X'y), the sums are added up by matrix row, and the ridge solution follows from them; its size doesn't depend
on the data. Scores are calibrated by isotonic regression on counts in score bins, of labelled rows that the fit left aside.

``fit_and_score`` reads the texts once: it keeps each document's statistics (under 150 bytes) in the shared folder, joins
those with the labels to fit, and scores them. No text is shuffled.

All labelled rows that aren't held out are used. Null, empty and blank texts have statistics too (zeros) and get a score; labels that are
null or without a document are ignored, and a repeated label of a document counts once; labels all alike give their smoothed share as every
score; tied scores share a bin; repeated rows are scored each; texts of any length are read whole, one at a time where they exceed a block; an empty
table gives an empty result. Only doc_id and text of the documents are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ship
from .text import U64, blocks, grams, mix, words

STATS = ("log_words", "mean_length", "long_words", "short_words", "upper", "digits", "symbols", "pipes", "shouts", "stops", "spaces", "log_lines", "line_length", "repeat_lines", "repeat_words", "distinct_words", "other_bytes")
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~", b"|", b"!?", b".,;:", b" \t\n\x0b\x0c\r", bytes(range(128, 256)))):
    _CLASS[list(_chars)] = _k + 1


def _repeats(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """How many of each row's keys occurred before in the row."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    again = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    return np.bincount(r[1:][again], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x len(STATS)."""
    n = len(offsets) - 1
    w = words(data, offsets)
    size = np.diff(offsets).astype(float)
    many = np.diff(w.first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(owner * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9).astype(float)
    length = w.end - w.start
    chars = np.bincount(w.row, length, n)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    line_row = owner[starts] if len(starts) else np.zeros(0, np.int64)
    lines = np.bincount(line_row, minlength=n).astype(float)
    prefix = np.append(U64(0), np.cumsum(w.hash * mix(np.arange(len(w.hash), dtype=U64) * U64(0) + U64(3)), dtype=U64))
    a, b = np.searchsorted(w.start, starts), np.searchsorted(w.start, np.append(starts[1:], len(data)))
    filled = b > a
    line_key = mix(prefix[b] - prefix[a])
    three = grams(w.hash, (0, 1, 2), 5)
    inside = w.row[: len(three)] == w.row[2 : 2 + len(three)] if len(three) else np.zeros(0, bool)
    per = np.maximum(size, 1)
    words_ = np.maximum(many, 1)
    return np.stack(
        [
            np.log1p(many), chars / words_, np.bincount(w.row, length > 12, n) / words_, np.bincount(w.row, length < 3, n) / words_,
            kinds[:, 1] / per, kinds[:, 2] / per, kinds[:, 3] / words_, kinds[:, 4] / words_, kinds[:, 5] / words_, kinds[:, 6] / words_, kinds[:, 7] / per,
            np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), _repeats(line_row[filled], line_key[filled], n) / np.maximum(lines, 1),
            _repeats(w.row[: len(three)][inside], three[inside], n) / words_, _repeats(w.row, w.hash, n) / words_, kinds[:, 8] / per,
        ],
        1,
    )


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    edges: np.ndarray | None = None
    values: np.ndarray | None = None
    constant: float | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(x @ self.projection + self.phase), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0, 1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to value, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in pools] or [np.zeros(0)])


def calibrated(n0: np.ndarray, n1: np.ndarray, share: float) -> np.ndarray:
    """Non-decreasing shares of label 1 for bins in order. Bins are pooled by their plain counts first; each pool, not each bin, is then drawn towards ``share`` by one row."""
    plain = isotonic(n1 / (n0 + n1), n0 + n1)
    pool = np.append(0, np.cumsum(np.diff(plain) != 0))
    ones, all_ = np.bincount(pool, n1), np.bincount(pool, n0 + n1)
    return isotonic((ones + share) / (all_ + 1), all_)[pool]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            s = statistics(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "stats"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATS))


def _normal(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        total = np.zeros((len(model.phase) + 1, len(model.phase) + 2))
        for batch in batches:
            x = model.features(_matrix(batch.column(0)))
            total += x.T @ np.hstack([x, batch.column(1).to_numpy().astype(float)[:, None]])
        if total.any():
            d = total.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * d), pa.array(total.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), lists], names=["i", "v"])

    return run


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[i] = sums.get(i, 0) + v.values.to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "v"])


def _bins(shared, low: float, high: float, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        counts = np.zeros((bins, 2), np.int64)
        for batch in batches:
            k = np.clip(((model.raw(_matrix(batch.column(0))) - low) / (high - low) * bins).astype(int), 0, bins - 1)
            np.add.at(counts, (k, batch.column(1).to_numpy()), 1)
        used = np.flatnonzero(counts.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used, 0]), pa.array(counts[used, 1])], names=["k", "n0", "n1"])

    return run


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    return run


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and stats of each row."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_describe, "doc_id long, stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """The model of the documents' statistics; see ``fit_described``."""
    return fit_described(describe(docs), labels, **options)


def fit_described(described: DataFrame, labels: DataFrame, width: int = 256, gamma: float = 0.04, ridge: float = 1.0, bins: int = 400, seed: int = 3) -> Model:
    """described: doc_id, stats. labels: doc_id, label (0, 1). A quarter of the labelled rows, by hash, calibrates; the others give the normal equations."""
    spark = described.sparkSession
    labels = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    rows = described.join(labels.hint("shuffle_hash"), "doc_id").select("doc_id", "stats", "label")
    rows = durable(rows.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(4)) == 0))
    counts = dict(rows.groupBy("label").count().collect())
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    d = len(STATS)
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(d), np.ones(d), rng.normal(0, np.sqrt(2 * gamma), (d, width)), rng.uniform(0, 2 * np.pi, width), np.zeros(width + 1))
    if len(counts) < 2:
        model.constant = share
        return model
    got = rows.agg(*[f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(d)]).first()
    model.mean, model.spread = np.array(got[:d]), np.maximum(np.array(got[d:]), 1e-6)
    shared = spark.sparkContext.broadcast(model)
    parts = rows.where("not aside").select("stats", "label").mapInArrow(_normal(shared), "i long, v array<double>")
    sums = parts.repartition(8, "i").mapInArrow(_sum_rows, "i long, v array<double>").collect()
    total = np.zeros((width + 1, width + 2))
    for r in sums:
        total[r.i] = r.v
    model.weight = np.linalg.solve(total[:, :-1] + ridge * np.eye(width + 1), total[:, -1])
    shared = spark.sparkContext.broadcast(model)
    low, high = -0.5, 1.5
    calibration = rows.where("aside").select("stats", "label").mapInArrow(_bins(shared, low, high, bins), "k long, n0 long, n1 long")
    binned = sorted(calibration.groupBy("k").agg(F.sum("n0"), F.sum("n1")).collect())
    if not binned:
        model.edges, model.values = np.array([low, high]), np.full(2, share)
        return model
    k, n0, n1 = (np.array(c, float) for c in zip(*binned, strict=True))
    model.edges = low + (k + 0.5) * (high - low) / bins
    model.values = calibrated(n0, n1, share)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row."""
    return score_described(describe(docs), model)


def score_described(described: DataFrame, model: Model) -> DataFrame:
    shared = described.sparkSession.sparkContext.broadcast(model)
    return described.select("doc_id", "stats").mapInArrow(_scores(shared), "doc_id long, score double")


def fit_and_score(docs: DataFrame, labels: DataFrame, **options) -> tuple[Model, DataFrame]:
    """The model, and doc_id and score of each row, from one pass over the texts."""
    described = durable(describe(docs))
    model = fit_described(described, labels, **options)
    return model, score_described(described, model)
