"""Drop lines that many documents share.

A row of the input is a document. Its text splits at \\n; a line's key is the line without
``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. Each document sends the distinct 128-bit
hashes of its keys; per hash the documents are counted, partly before the shuffle. Lines whose key has
``min_chars`` code points or more and is in ``min_docs`` documents or more go from every document; the
others stay in their order.

The hashes over the threshold are broadcast while they are no more than ``broadcast_keys`` (16 bytes
each); the text then isn't shuffled. Beyond that they are joined to the lines' hashes, gathered per
distinct text and joined to the documents.

Null or empty texts are one empty line (and become the empty text); keys of fewer code points are never
dropped; rows that repeat are documents of their own; other columns pass through, and a column of the
input named n_lines or n_dropped is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, ship

SPACE = b" \t\n\x0b\x0c\r"


def _keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The hash of each line's key, None where the key is too short to be dropped."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE).lower()
        long = len(key) >= min_chars if min_chars <= 1 else len(key.decode("utf-8", "replace")) >= min_chars
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.binary()), b"").to_pylist()


def _counts(min_chars: int, most: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["h", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in _bytes(batch, "text"):
                seen.update({k for k in _keys(text, min_chars) if k is not None})
                if len(seen) >= most:
                    yield flush()
        if seen:
            yield flush()

    return run


def _strip(min_chars: int, names: list[str], drop: object | None):
    """drop: a broadcast set of hashes, or None if each row has its own in the column __drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = drop.value if drop is not None else None
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("__drop")).to_pylist() if drop is None else None
            kept, lines, dropped = [], [], []
            for i, text in enumerate(_bytes(batch, "text")):
                gone = fixed if own is None else set(own[i] or ())
                parts = text.split(b"\n")
                stay = [p for p, k in zip(parts, _keys(text, min_chars), strict=True) if k not in gone] if gone else parts
                kept.append(b"\n".join(stay))
                lines.append(len(parts))
                dropped.append(len(parts) - len(stay))
            new = {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    return run


def _texts(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(t, k) for t, x in zip(batch.column(1).to_pylist(), _bytes(batch, "text"), strict=True) for k in set(_keys(x, min_chars)) if k is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.binary())], names=["t", "h"])

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_keys: int = 1_000_000) -> DataFrame:
    """docs with its shared lines dropped from ``text``, and n_lines (before) and n_dropped of each row."""
    spark = docs.sparkSession
    ship(spark)
    names = [n for n in docs.columns if n not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    fields = {f.name: f for f in docs.schema.fields} | {"n_lines": T.StructField("n_lines", T.LongType()), "n_dropped": T.StructField("n_dropped", T.LongType())}
    schema = T.StructType([fields[n] for n in names])
    docs = docs.drop("n_lines", "n_dropped")
    counts = docs.select("text").mapInArrow(_counts(min_chars), "h binary, n long")
    common = durable(counts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("h"))
    if common.count() <= broadcast_keys:
        drop = spark.sparkContext.broadcast({bytes(r.h) for r in common.collect()})
        return docs.mapInArrow(_strip(min_chars, names, drop), schema)
    keyed = docs.withColumn("__t", F.sha2(F.coalesce("text", F.lit("")), 256))
    gone = keyed.select("text", "__t").mapInArrow(_texts(min_chars), "t string, h binary").join(common, "h", "left_semi")
    gone = gone.groupBy(F.col("t").alias("__t")).agg(F.collect_set("h").alias("__drop"))
    return keyed.join(gone, "__t", "left").drop("__t").mapInArrow(_strip(min_chars, names, None), schema)
