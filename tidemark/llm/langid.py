"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

The features are hashed 1- to 3-grams of the code points (ASCII letters lower-cased, other ASCII characters as spaces) of the
whole text, weighted by relative frequency times inverse document frequency. Training follows the regularised leader
per coordinate with L1 and L2 penalties, so most weights are zero; a temperature fitted on sample rows that training
didn't see calibrates the probabilities. The table of weights has a fixed number of rows, and is broadcast; every text is
scored in one scan.

The document frequencies are of all rows that may be learnt from. The classifier's fit alone learns from a sample: of each language the
``sample`` distinct rows of lowest hash of doc_id and text, and of these as many, in that order, as have an equal share of ``most_bytes`` of
features: bounds that don't grow with the corpus. The features are made on the executors; no text goes to the driver. There may be up to
``most`` languages, more are an error.

Null texts and texts without a letter are ``und`` with score 1; without anything to learn from all are ``und``; of equally likely
languages the first by name is given; repeated rows are scored each and learnt from once; rows of null lang aren't learnt from; texts of any
length are read whole, one at a time where they exceed a block; an empty table gives an empty result; only doc_id, text and, to learn, lang
are read, whatever other columns there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, within
from .text import U64, blocks, mix

BITS = 15
ORDERS = 3
_LOWER = np.arange(128, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[i for i in range(128) if not chr(i).isalpha()]] = 32


def points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block of UTF-8, and the n + 1 offsets of its rows among them."""
    lead = (data & 0xC0) != 0x80
    start = np.flatnonzero(lead)
    first = data[start].astype(np.uint32)
    size = np.diff(np.append(start, len(data)))
    value = np.where(size == 1, first, np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07)))
    for k in (1, 2, 3):
        more = size > k
        value[more] = (value[more] << np.uint32(6)) | (data[start[more] + k] & 0x3F)
    return value.astype(np.uint32), np.searchsorted(start, offsets)


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of every n-gram and the n + 1 offsets of the rows' n-grams. A row begins and ends with a space."""
    point, first = points(data, offsets)
    low = point < 128
    point[low] = _LOWER[point[low]]
    n = len(first) - 1
    padded = np.full(len(point) + 2 * n, 32, np.uint32)
    row = np.repeat(np.arange(n), np.diff(first))
    padded[np.arange(len(point)) + 2 * row + 1] = point
    edge = first + 2 * np.arange(n + 1)
    blank = padded == 32
    repeat = np.append(False, blank[1:] & blank[:-1])
    repeat[edge[:-1]] = False
    at = np.append(0, np.cumsum(~repeat))[edge]
    padded = padded[~repeat].astype(U64)
    out = []
    for k in range(1, ORDERS + 1):
        key = padded.copy()
        for j in range(1, k):
            key[:-j] = (key[:-j] << U64(21)) | padded[j:] if j == 1 else key[:-j] * U64(0x9E3779B97F4A7C15) + padded[j:]
        bucket = (mix(key + U64(k * 0x632BE59B)) >> U64(64 - BITS)).astype(np.int32)
        # n-grams that would run into the next row are left out
        keep = np.ones(len(bucket), bool)
        for j in range(1, k):
            keep[np.maximum(at[1:] - j, 0)] = False
        out.append((bucket[keep], np.append(0, np.cumsum(keep))[at]))
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        x = np.zeros((n, len(self.langs)))
        for bucket, at in gram_buckets(data, offsets):
            count = np.diff(at)
            full = count > 0
            if not full.any():
                continue
            for c in range(len(self.langs)):
                x[full, c] += np.add.reduceat(self.table[c].take(bucket), at[:-1][full], dtype=np.float64) / count[full]
        x = (x + self.bias) / self.temperature
        p = np.exp(x - x.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def tf(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their relative frequencies, summed over the orders."""
    out = []
    for _, data, offsets in blocks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), "text"):
        found = gram_buckets(data, offsets)
        for i in range(len(offsets) - 1):
            parts = [(b[a[i] : a[i + 1]], a[i + 1] - a[i]) for b, a in found]
            key = np.concatenate([b for b, _ in parts])
            share = np.concatenate([np.full(n, 1 / max(n, 1)) for _, n in parts])
            distinct, back = np.unique(key, return_inverse=True)
            out.append((distinct, np.bincount(back, share, len(distinct))))
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for part, data, offsets in blocks(batch, "text", 1 << 20):
            keys = [np.repeat(np.arange(part.num_rows, dtype=np.int64) << BITS, np.diff(at)) + bucket for bucket, at in gram_buckets(data, offsets)]
            n += np.bincount(np.unique(np.concatenate(keys)) & ((1 << BITS) - 1), minlength=1 << BITS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["bucket", "n"])


def document_frequency(docs: DataFrame) -> np.ndarray:
    """How many rows of docs (text) hold each bucket, from one scan that gives at most 2**BITS counts a partition."""
    ship(docs.sparkSession)
    counts = docs.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(1 << BITS)
    for r in counts:
        n[r.bucket] = r.n
    return n


def train(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, langs: list[str], n_docs: np.ndarray, total: int, alpha: float = 1.0, beta: float = 0.1, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, seed: int = 2) -> Model:
    """n_docs: how many of all ``total`` documents hold each bucket."""
    idf = np.log((1 + total) / (1 + n_docs)) + 1
    k = len(langs)
    z, n, zb, nb = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k)), np.zeros(k), np.zeros(k)
    solve = lambda z, n, l1: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            b, share = rows[r]
            x = (share * idf[b])[:, None]
            w, wb = solve(z[b], n[b], l1), solve(zb, nb, 0.0)
            s = (x * w).sum(0) + wb
            p = np.exp(s - s.max())
            p /= p.sum()
            g = p.copy()
            g[label[r]] -= 1
            step = x * g
            z[b] += step - (np.sqrt(n[b] + step * step) - np.sqrt(n[b])) / alpha * w
            n[b] += step * step
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb
            nb += g * g
    return Model(langs, np.ascontiguousarray((solve(z, n, l1) * idf[:, None]).T.astype(np.float32)), solve(zb, nb, 0.0))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = tf(part.column(2).to_pylist())
            keys, shares = [b.astype("<i4").tobytes() for b, _ in rows], [x.astype("<f4").tobytes() for _, x in rows]
            size = pa.array([len(k) + len(x) for k, x in zip(keys, shares, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), size, pa.array(keys, pa.binary()), pa.array(shares, pa.binary())], names=["lang", "h", "n", "buckets", "shares"])


def _sample(rows: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """lang and h of the ``sample`` lowest distinct h of each language. rows: lang, h.

    A scan looks at the share of hashes in which about four times as many should lie; a language of which copies leave too few is looked at again with a larger share."""
    place, low = F.pmod("h", F.lit(1 << 30)) / float(1 << 30), Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    share, found = {lang: min(1.0, 4 * sample / n) for lang, n in counts.items()}, []
    while share:
        of = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
        near = rows.where(place < F.coalesce(F.try_element_at(of, F.col("lang")), F.lit(0.0))).distinct()
        got = near.withColumn("at", F.row_number().over(low)).where(F.col("at") <= sample).select("lang", "h").collect()
        have = Counter(r.lang for r in got)
        done = {lang for lang, x in share.items() if have[lang] >= sample or x >= 1}
        found += [(r.lang, r.h) for r in got if r.lang in done]
        share = {lang: min(1.0, 16 * x) for lang, x in share.items() if lang not in done}
    return rows.sparkSession.createDataFrame(found, "lang string, h long")


def fit(docs: DataFrame, sample: int = 1000, most: int = 500, most_bytes: int = 64 << 20) -> Model | None:
    """docs: doc_id, text, lang of the rows to learn from."""
    ship(docs.sparkSession)
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"))
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most + 1).collect()
    if not counts:
        return None
    if len(counts) > most:
        raise ValueError(f"more than {most} languages to learn; give a larger bound, and the driver memory for its weights")
    langs = sorted(r[0] for r in counts)
    chosen = _sample(docs.select("lang", "h"), {r[0]: r[1] for r in counts}, sample)
    texts = docs.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    made = texts.select("lang", "h", "text").mapInArrow(_packed, "lang string, h long, n long, buckets binary, shares binary")
    got = within(made, "lang", "n", most_bytes // len(langs)).select("lang", "h", "buckets", "shares").collect()
    got.sort(key=lambda r: (r.h, r.lang))
    y = np.array([langs.index(r.lang) for r in got], int)
    if len(set(y.tolist())) < 2:
        only = got[0].lang if got else langs[0]
        return Model([only], np.zeros((1, 1 << BITS), np.float32), np.zeros(1))
    rows = [(np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.shares, "<f4").astype(float)) for r in got]
    aside = np.random.default_rng(4).random(len(got)) < 0.2
    aside &= len(got) >= 50
    model = train([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside], langs, document_frequency(docs), sum(r[1] for r in counts))
    if aside.any():
        x = np.stack([model.table[:, b] @ s + model.bias for (b, s), a in zip(rows, aside, strict=True) if a])
        target = y[aside]

        def loss(t: float) -> float:
            s = x / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), target]).mean())

        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            for part, data, offsets in blocks(batch, "text", 1 << 20):
                none = part.column(2).to_numpy(zero_copy_only=False)
                lang, score = np.full(part.num_rows, "und", object), np.ones(part.num_rows)
                if model is not None:
                    p = model.probabilities(data, offsets)
                    best = p.argmax(1)
                    lang = np.where(none, "und", np.array(model.langs, object)[best])
                    score = np.where(none, 1.0, p[np.arange(len(best)), best])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (its probability) of each row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    none = ~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", none.alias("none")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
