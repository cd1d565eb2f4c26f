"""Benchmark decontamination by spaced seeds.

A mask selects token positions of a short span and ignores the others, so a substituted word at an
ignored position leaves the seed's hash as it was. The benchmark's seeds, under every mask, form an
index of sorted 64-bit hashes; each document's seeds are looked up in it in one scan, without a shuffle.
Around each hit the tokens of item and document are compared along the hit's diagonal. An overlap is a stretch of
six words or more of which three quarters match; a diagonal's overlaps are the disjoint ones that match most in all (where
there is none, its best-scoring run). A document is contaminated by an item if its overlaps, on one diagonal or on diagonals
up to ``drift`` apart (inserted or deleted words), match ``min_matched`` tokens in all, or all tokens of a shorter item.

The index is built and broadcast in blocks of items of about ``block_bytes`` of text at most, each with
a scan of its own, so its size never grows with the benchmark. A longer item is a block for itself.

Null, empty and blank texts match nothing; items shorter than the shortest mask (six tokens) can't be told
from ordinary language and match nothing; repeated document rows each give their own rows, repeated items count once; of overlaps that match
equally, the first in the document is shown; texts of any length are searched whole, one at a time where they exceed a block; an empty table of
documents gives an empty result, an empty benchmark finds nothing; other columns, of whatever name, are ignored or pass through.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ship
from .text import U64, blocks, grams, whole, words

#: 1: the position counts; 0: it is ignored.
MASKS = ("111111", "1101011", "11010011", "110010111")
SHORTEST = 6
_SHORT_BITS = 22


def _shifts(mask: str) -> tuple[int, ...]:
    return tuple(i for i, x in enumerate(mask) if x == "1")


class Index:
    """Seeds of benchmark items, sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        table = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        self.tokens: list[np.ndarray] = []
        for _, data, offsets in blocks(table, "text"):
            w = words(data, offsets)
            self.tokens += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        found = [(grams(t, _shifts(m), 7 + k), i) for i, t in enumerate(self.tokens) for k, m in enumerate(MASKS)]
        seed = np.concatenate([s for s, _ in found] or [np.zeros(0, U64)])
        item = np.concatenate([np.full(len(s), i, np.int32) for s, i in found] or [np.zeros(0, np.int32)])
        at = np.concatenate([np.arange(len(s), dtype=np.int32) for s, _ in found] or [np.zeros(0, np.int32)])
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.at = seed[order], item[order], at[order]
        self.short = np.zeros(1 << _SHORT_BITS, bool)
        self.short[(seed >> U64(64 - _SHORT_BITS)).astype(np.int64)] = True

    def hits(self, w, most: int = 2_000_000) -> Iterator[np.ndarray]:
        """Distinct (row, item, diagonal) of a block's words, sorted; the diagonal is document word minus item word. They come in
        stretches of whole rows that meet about ``most`` seeds of the index, however many items share a phrase."""
        found = []
        for k, mask in enumerate(MASKS):
            seed = grams(w.hash, _shifts(mask), 7 + k)
            at = np.flatnonzero(self.short[(seed >> U64(64 - _SHORT_BITS)).astype(np.int64)])
            at = at[whole(at, w, len(mask))]
            low = np.searchsorted(self.seed, seed[at], "left")
            found.append((at, low, np.searchsorted(self.seed, seed[at], "right") - low))
        at, low, times = (np.concatenate(c) for c in zip(*found, strict=True))
        met = np.flatnonzero(times)
        met = met[np.argsort(at[met], kind="stable")]
        at, low, times = at[met], low[met], times[met]
        row, total, done = w.row[at], np.cumsum(times), 0
        while done < len(at):
            to = int(np.searchsorted(total, total[done] + most, "left"))
            part = slice(done, int(np.searchsorted(row, row[min(to, len(at) - 1)], "right")))
            done, n = part.stop, times[part]
            entry = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            r, item = np.repeat(row[part], n), self.item[entry]
            hit = np.stack([r, item, np.repeat(at[part], n) - w.first[r] - self.at[entry]], 1)
            hit = hit[np.lexsort((hit[:, 2], r * len(self.ids) + item))]
            yield hit[np.append(True, np.any(np.diff(hit, axis=0), axis=1))]


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the best-scoring run."""
    total = np.append(0, np.cumsum(np.where(equal, 1, -3)))
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(equal[start:end].sum())


def stretches(equal: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, end and matches of disjoint stretches of SHORTEST words or more, each three quarters matched, that match most in all.

    A stretch may as well begin and end with a run of matches. Of the runs it may begin with, those stay in ``level`` and ``value`` that
    no other betters with a lower level, so that each end finds its best begin by bisection."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    done = np.cumsum(end - start)
    before = done - (end - start)
    opens, closes = (4 * before - 3 * start).tolist(), (4 * done - 3 * end).tolist()
    start, end, done, before = start.tolist(), end.tolist(), done.tolist(), before.tolist()
    most, begin, level, value, run, ready = [0], [], [], [], [], 0
    for k in range(len(start)):
        while ready <= k and end[k] - start[ready] >= SHORTEST:
            gain, p = most[ready] - before[ready], bisect_right(level, opens[ready])
            if not p or value[p - 1] < gain:
                q = p
                while q < len(level) and value[q] < gain:
                    q += 1
                level[p:q], value[p:q], run[p:q] = [opens[ready]], [gain], [ready]
            ready += 1
        p = bisect_right(level, closes[k])
        better = bool(p) and value[p - 1] + done[k] > most[k]
        most.append(value[p - 1] + done[k] if better else most[k])
        begin.append(run[p - 1] if better else -1)
    found, k = [], len(start) - 1
    while k >= 0:
        if (i := begin[k]) >= 0:
            found.append((start[i], end[k], done[k] - before[i]))
            k = i
        k -= 1
    return found[::-1]


def _overlaps(index: Index, w, row: int, item: int, diagonals: list[int], min_matched: int, drift: int):
    """The document's overlaps with an item: words start and end, matches; [] if they are too few."""
    tokens, own = index.tokens[item], w.hash[w.first[row] : w.first[row + 1]]
    need, equal = min(min_matched, len(tokens)), {}
    for d in diagonals:
        a, b = max(0, d), min(len(own), d + len(tokens))
        equal[d] = own[a:b] == tokens[a - d : b - d]
    same = {d: int(np.count_nonzero(e)) for d, e in equal.items()}
    near_to = {d: [e for e in range(d - drift, d + drift + 1) if e in equal] for d in equal}
    hopeful = {e for es in near_to.values() if sum(same[e] for e in es) >= need for e in es}
    runs = []
    for d in diagonals:
        if d in hopeful:
            parts = stretches(equal[d]) or [best_run(equal[d])]
            start, end, n = max(parts, key=lambda p: p[2])
            runs.append((d, max(0, d) + start, max(0, d) + end, n, sum(p[2] for p in parts)))
    on, found = {r[0]: r for r in runs}, []
    for d, start, end, n, _ in runs:
        near = [on[e] for e in near_to[d] if e in on and abs(on[e][1] - start) <= 2 * len(tokens)]
        total = sum(r[4] for r in near if r[4] >= SHORTEST or r[0] == d)
        if total >= need:
            found.append((start, end, n, total))
    return found


def _matches(index: Index, data: np.ndarray, offsets: np.ndarray, min_matched: int, drift: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Row of a block, and item_id, start_word, end_word, n_matched, item_words, n_overlaps, for each row and item that overlap."""
    w = words(data, offsets)
    for hits in index.hits(w):
        cut = np.flatnonzero(np.any(np.diff(hits[:, :2], axis=0), axis=1)) + 1
        for group in np.split(hits, cut):
            if not len(group):
                continue
            row, item = int(group[0, 0]), int(group[0, 1])
            if found := _overlaps(index, w, row, item, group[:, 2].tolist(), min_matched, drift):
                start, end, _, total = max(found, key=lambda f: (f[2], -f[0]))
                yield row, (index.ids[item], start, end, total, len(index.tokens[item]), len(found))


def _scan(shared, min_matched: int, drift: int, most: int = 20_000):
    names = ["doc_id", "item_id", "start_word", "end_word", "n_matched", "item_words", "n_overlaps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        out: list[tuple] = []
        kind = pa.int64()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, kind if k == 0 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=names)
            out.clear()
            return rows

        for batch in batches:
            kind = batch.column(0).type
            for part, data, offsets in blocks(batch, "text"):
                for row, match in _matches(index, data, offsets, min_matched, drift):
                    out.append((part.column(0)[row].as_py(), *match))
                    if len(out) >= most:
                        yield flush()
        if out:
            yield flush()

    return run


def _clean(shared, text: str, min_matched: int, drift: int):
    """The rows whose column ``text`` overlaps no item of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, text):
                keep = np.ones(part.num_rows, bool)
                for row, _ in _matches(shared.value, data, offsets, min_matched, drift):
                    keep[row] = False
                yield part.filter(pa.array(keep))

    return run


def _items(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The distinct items with text, and into how many blocks they are dealt."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") > 0).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return items, max(1, -(-2 * size // block_bytes))


def _shared(items: DataFrame, k: int, parts: int):
    """The index of block k, broadcast."""
    block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
    return items.sparkSession.sparkContext.broadcast(Index([r.item_id for r in block], [r.text for r in block]))


def _found(docs: DataFrame, items: DataFrame, parts: int, min_matched: int, drift: int) -> DataFrame:
    """The overlaps of docs (doc_id, of any type, and text)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, start_word long, end_word long, n_matched long, item_words long, n_overlaps long"
    return reduce(DataFrame.unionByName, [docs.mapInArrow(_scan(_shared(items, k, parts), min_matched, drift), schema) for k in range(parts)])


def contaminated(docs: DataFrame, benchmark: DataFrame, min_matched: int = 10, drift: int = 4, block_bytes: int = 4 << 20) -> DataFrame:
    """A row for each document row and benchmark item that overlap: doc_id, item_id, start_word and end_word of the best
    overlap in the document, n_matched tokens, item_words, n_overlaps. Documents without a row are clean."""
    return _found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), *_items(benchmark, block_bytes), min_matched, drift)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_matched: int = 10, drift: int = 4, block_bytes: int = 4 << 20, broadcast_texts: int = 200_000) -> DataFrame:
    """docs without the contaminated rows, each judged by its own text, whatever its doc_id.

    With an index of one block the one scan drops them; with more, the digests of contaminated texts are found block by block and broadcast up to
    ``broadcast_texts`` of them (64 bytes each), joined beyond."""
    ship(docs.sparkSession)
    items, parts = _items(benchmark, block_bytes)
    if parts == 1:
        plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
        kept = plain.mapInArrow(_clean(_shared(items, 0, 1), f"c{docs.columns.index('text')}", min_matched, drift), plain.schema)
        return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
    digest = F.sha2("text", 256)
    bad = durable(_found(docs.select(digest.alias("doc_id"), "text"), items, parts, min_matched, drift).select(F.col("doc_id").alias("__bad")).distinct())
    return docs.join(F.broadcast(bad) if bad.count() <= broadcast_texts else bad, digest == bad["__bad"], "left_anti")
