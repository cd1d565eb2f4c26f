"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention stays within a piece). Each partition
packs blocks of about ``block_tokens`` tokens as they stream by, so memory is bounded and no row is shuffled.
Within a block, whole stretches of ``capacity`` tokens fill sequences of their own. The rest of each document goes,
costliest first, to the cheapest of the block's ceil(tokens / capacity) open sequences that has room for
all of it; where none has, it is cut over the cheapest ones that have any room. A block so pads less than
one sequence.

Null or empty texts are the end token alone; a document longer than a block is a block for itself. Rows that repeat are
packed each. Only doc_id and text are read. Sequence ids are unique: the partition's number times 2**40 plus a count.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

_encoders: dict[tuple[str, str], object] = {}


def encoder(vocabulary: str, ranks: str | None):
    """A function from text to an array of ids. ranks, a file of the same vocabulary for the faster library, serves texts without the special token."""
    if (vocabulary, ranks) not in _encoders:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(vocabulary)
        fast, special = None, [t.content for t in slow.get_added_tokens_decoder().values()]
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if fast is None or any(s in text for s in special):
                return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
            return np.array(fast.encode_ordinary(text), np.uint32)

        _encoders[vocabulary, ranks] = encode
    return _encoders[vocabulary, ranks]


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences count from 0."""
    out, opened = [], 0
    for i, n in enumerate(lengths.tolist()):
        for k in range(n // capacity):
            out.append((i, k * capacity, capacity, opened, 0))
            opened += 1
    rest = lengths % capacity
    room = np.full(-(-int(rest.sum()) // capacity), capacity)
    cost = np.zeros(len(room))
    for i in np.argsort(-rest, kind="stable").tolist():
        start, left = int(lengths[i] - rest[i]), int(rest[i])
        while left:
            fits = room >= left
            fits = fits if fits.any() else room > 0
            s = int(np.where(fits, cost, np.inf).argmin())
            n = min(left, int(room[s]))
            out.append((i, start, n, opened + s, capacity - int(room[s])))
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def _pack(vocabulary: str, ranks: str | None, capacity: int, end: int, block_tokens: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, sequence = encoder(vocabulary, ranks), TaskContext.get().partitionId() << 40

        def flush(held: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
            nonlocal sequence
            pieces = assign(np.array([len(x) for _, x in held]), capacity)
            rows = [(held[i][0], a, n, zlib.crc32(held[i][1][a : a + n]), len(held[i][1]), sequence + s, o) for i, a, n, s, o in pieces]
            sequence += 1 + max(p[3] for p in pieces)
            arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if with_ids:
                arrays.append(pa.array([held[i][1][a : a + n].astype(np.int32) for i, a, n, _, _ in pieces], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        held, tokens = [], 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for i in range(batch.num_rows):
                ids = np.append(encode(texts[i].as_py()), np.uint32(end)).astype("<u4")
                held.append((batch.column(0)[i].as_py(), ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield flush(held)
                    held, tokens = [], 0
        if held:
            yield flush(held)

    return run


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = 1024, end: int = 0, block_tokens: int = 1 << 20, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start (tokens of its document before it), length, ids_crc32 (of its ids as little-endian unsigned
    32-bit), doc_tokens (with the end id), sequence_id, offset in the sequence, and ids if asked for.

    vocabulary: a tokenizers file, present on every executor. ranks: the same vocabulary as tiktoken ranks, or None."""
    ship(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(vocabulary, ranks, capacity, end, block_tokens, with_ids), schema)
