"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact checks.

A document's set holds its distinct 5-word shingles (with fewer words, the whole sequence as one).

1. One pass computes per document the set's size, a 128-bit order-free digest of the set and its
   sketch. Documents with equal sets are one class; only the class's smallest id goes on.
2. The sketch has 128 registers of 16 bits: floor(1 - log_b x) of the smallest of exponentially
   spaced values that the set's elements give to each register. An element's j-th value falls in the
   j-th of 128 intervals and goes to the j-th register of its own permutation, so that large sets
   need one value an element: once no register stands above the next interval, the rest can't matter.
3. Four registers make a band. Documents with equal registers in a band share a bucket. In buckets of two or three all members
   meet; a larger one is a star: every member meets the bucket's smallest id and, in buckets of up to ``ring`` members, one more
   centre that differs from bucket to bucket. No bucket is dropped and pairs grow linearly with members.
4. For each pair whose sets' sizes allow the threshold, the maximum-likelihood Jaccard similarity follows from how many registers
   are greater, smaller and equal. Pairs over five standard errors below the threshold go.
5. The others are checked exactly on the sets of the whole texts.
6. Components come from alternating large-star and small-star steps.
7. Stars that still hold several components are looked at again, in cells of bounded size: every member outside a bucket's largest
   component meets all its members, first by their sketches, in the first bucket that both share, and then, where the estimate
   leaves a link of two components possible, by the sets of the whole texts. So two texts that share a band value are compared
   unless sizes or sketches rule the link out or other links join them anyway.

Only texts that a likely pair needs are moved. Intermediate tables are written to the shared folder and dropped when they are of no more use.

Nulls and ties: null, empty or blank texts have no set and link with nothing; a null doc_id never links, its component is null and the
row is kept. Rows that repeat a doc_id are judged each by its own text: the component is the smallest doc_id that its text reaches, and
k equal rows cost as much as k documents of equal text. Texts of any length are compared whole (a text must fit an executor's memory
about forty times over, as its words become 64-bit hashes); an empty table gives an empty result; further columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, durable, ship
from .text import BLOCK_BYTES, U64, blocks, grams, mix, signed, words

WORDS = 5
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
B, RATE, LIMIT = 1.001, 20.0, 65534
#: Up to so many ids a set of ids is broadcast (8 bytes an id); beyond, it is joined.
BROADCAST_IDS = 500_000
_EDGES = np.append(np.log1p(np.arange(REGISTERS) / (REGISTERS - np.arange(REGISTERS))) / RATE, np.inf)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = words(data, offsets)
    found = grams(w.hash, tuple(range(k)))
    sets = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            sets.append(np.unique(found[a : b - k + 1]))
        elif b > a:
            sets.append(grams(w.hash[a:b], tuple(range(b - a)), seed=100 + int(b - a)))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def sketch(elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x 128 registers of the sets that hold elements[i] for owner[i]; a set without elements has zeros."""
    m = REGISTERS
    least = np.full(n * m, np.inf)
    at, step = (elements >> U64(7)).astype(np.int64) & (m - 1), ((elements >> U64(15)).astype(np.int64) & (m - 1)) | 1
    for j in range(m):
        if not len(elements):
            break
        u = (mix(elements + U64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(11)) * 2.0**-53
        np.minimum.at(least, owner * m + ((at + j * step) & (m - 1)), _EDGES[j] - np.log1p(-u / (m - j)) / RATE)
        going = (least.reshape(n, m).max(1) > _EDGES[j + 1])[owner]
        elements, owner, at, step = elements[going], owner[going], at[going], step[going]
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least) / np.log(B))
    return np.clip(level, 0, LIMIT + 1).astype(np.uint16).reshape(n, m)


def _fit(j: np.ndarray, u: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Log likelihood of similarity j, where u is the first set's share of both sizes."""
    lead = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (B - 1) / B) / np.log(B)
    p, q = lead(u - (1 - u) * j), lead(1 - u - u * j)
    return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of sets with registers a, b and sizes na, nb, on a grid of 1/128."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    j = np.minimum(np.linspace(0, 1, 129)[None, :], np.minimum(u / (1 - u), (1 - u) / u) * (1 - 1e-9))
    fit = _fit(j, u, more, less, a.shape[1] - more - less)
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]


def floor_of(percent: int) -> float:
    """Five standard errors below the threshold."""
    j = percent / 100
    return j - 5 * float(np.sqrt(j * (1 - j) / REGISTERS))


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes allow the threshold and the likeliest similarity, of a likelihood with one peak, is floor_of(percent) or more: whether it still rises there."""
    out = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    at = np.flatnonzero(out)
    more, less = (a[at] > b[at]).sum(1), (a[at] < b[at]).sum(1)
    u, j, same = na[at] / (na[at] + nb[at]), floor_of(percent), REGISTERS - more - less
    out[at] = _fit(j + 1e-4, u, more, less, same) >= _fit(j, u, more, less, same)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            sets = shingle_sets(data, offsets)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            first = np.append(0, np.cumsum(sizes))
            sums = [np.append(U64(0), np.cumsum(mix(elements ^ U64(salt)), dtype=U64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            s1, s2 = (signed(s[first[1:]] - s[first[:-1]]) for s in sums)
            bands = np.ascontiguousarray(sketch(elements, owner, len(sets))).view(np.int64)
            empty = pa.array(sizes == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.compute.if_else(empty, none, pa.array(s1)), pa.compute.if_else(empty, none, pa.array(s2)), lists],
                names=["doc_id", "n_shingles", "s1", "s2", "bands"],
            )


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest s1 and s2 (null for empty sets), bands (four registers in each long)."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_describe, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _registers(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).view(np.uint16).reshape(len(column), REGISTERS)


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
                keep = pa.array(may_link(_registers(batch.column(4)), _registers(batch.column(5)), na, nb, percent))
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["id", "centre"])

    return run


def _check(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for part in _steps(batch, "text_a", "text_b"):
                sets_a, sets_b = ([s for _, data, offsets in blocks(part, column) for s in shingle_sets(data, offsets)] for column in ("text_a", "text_b"))
                for a, b in zip(sets_a, sets_b, strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["u", "v"])

    return run


def _steps(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Slices of whose columns no more than about a block of text is held at once, or of one row."""
    size = sum(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(c))), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    total, at = np.append(0, np.cumsum(size)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + BLOCK_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def contract(scratch: Scratch, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Edges u > v with the same components as the given ones, after alternating large-star and small-star steps: until nothing changes, which
    leaves one edge from each id to its component's smallest, or ``most`` times. Each round's table replaces the one before."""
    edges, state, rounds = scratch.keep(edges.select("u", "v").distinct()), None, 0
    while most is None or rounds < most:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state, rounds, last = now, rounds + 1, edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = scratch.keep(small.select("e.u", "e.v").where("u <> v").distinct())
        scratch.drop(last)
    return edges


def _only(rows: DataFrame, ids: DataFrame, broadcast_ids: int, key: str = "id") -> DataFrame:
    """The rows whose key is among ids (one column, distinct): their number decides whether ids are broadcast or both sides are joined."""
    ids = ids.select(F.col(ids.columns[0]).alias(key))
    return rows.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, key, "left_semi")


_CELL = "bucket long, i int, j int, id long, comp long, outsider boolean, member boolean"


def _sift(percent: int):
    """Of a cell, the rows that may link, by sizes and sketches, to a row of another component with which they share no earlier band."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        comp, out, member, size = (cell.column(c).to_numpy() for c in ("comp", "outsider", "member", "n_shingles"))
        bands = cell.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(size), BANDS)
        regs = np.ascontiguousarray(bands).view(np.uint16)
        own = int(cell.column("bucket")[0].as_py()) % BANDS
        m, keep = np.flatnonzero(member), np.zeros(len(size), bool)
        rows, n = regs[m], size[m].astype(float)
        for u in np.flatnonzero(out):
            hopeful = np.flatnonzero((comp[m] != comp[u]) & (100 * np.minimum(n, size[u]) >= percent * np.maximum(n, size[u])))
            hopeful = hopeful[(bands[m[hopeful], :own] != bands[u, :own]).all(1)]
            if len(hopeful):
                v = hopeful[may_link(np.broadcast_to(regs[u], (len(hopeful), REGISTERS)), rows[hopeful], np.full(len(hopeful), float(size[u])), n[hopeful], percent)]
                if len(v):
                    keep[u] = True
                    keep[m[v]] = True
        return cell.select([f.split()[0] for f in _CELL.split(", ")]).filter(pa.array(keep))

    return run


def _cells(percent: int):
    """Outsiders against members of one cell, on the sets of their whole texts: a link for each two components that have one."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        batch = cell.to_batches()[0]
        sets = [s for _, data, offsets in blocks(batch, "text") for s in shingle_sets(data, offsets)]
        ids, comp, out, member = (cell.column(c).to_numpy() for c in ("id", "comp", "outsider", "member"))
        size = np.array([len(s) for s in sets])
        m = np.flatnonzero(member & (size > 0))
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if len(m):
            vocabulary, place = np.unique(np.concatenate([sets[i] for i in m]), return_inverse=True)
            starts = np.append(0, np.cumsum(size[m])[:-1])
            for u in np.flatnonzero(out):
                own = np.zeros(len(vocabulary), bool)
                at = np.minimum(np.searchsorted(vocabulary, sets[u]), len(vocabulary) - 1)
                own[at[vocabulary[at] == sets[u]]] = True
                both = np.add.reduceat(own[place], starts, dtype=np.int64)
                hit = (100 * both >= percent * (size[u] + size[m] - both)) & (comp[m] != comp[u])
                for v in m[hit]:
                    found.setdefault((min(comp[u], comp[v]), max(comp[u], comp[v])), (max(ids[u], ids[v]), min(ids[u], ids[v])))
        us, vs = zip(*found.values(), strict=True) if found else ((), ())
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def leftover_links(scratch: Scratch, docs: DataFrame, reps: DataFrame, members: DataFrame, roots: DataFrame, percent: int, cell: int = 400_000, rows: int = 1024, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Links u > v of different components that share a bucket. docs: id, text. reps: id, n_shingles, bands. members: id, n_shingles, bucket of all members of a bucket.

    A bucket's largest component needs no comparing with itself; all its other members, the outsiders, meet every member. Of buckets with the same members
    only that of the first band counts. Both sides are dealt into blocks of about ``rows`` rows and ``cell`` shingles, so that no task holds more than two."""
    held = members.join(roots, members["id"] == roots["u"], "left").select("id", "n_shingles", "bucket", F.coalesce("root", "id").alias("comp"))
    by_comp = held.groupBy("bucket", "comp").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("size"), F.bit_xor(F.xxhash64("id")).alias("who"))
    mixed = by_comp.groupBy("bucket").agg(
        F.sum("k").alias("n"), F.sum("size").alias("size"), F.max("k").alias("n_most"), F.max_by("size", "k").alias("most"), F.max_by("comp", "k").alias("main"), F.bit_xor("who").alias("who"), F.count("*").alias("comps")
    )
    mixed = mixed.where("comps > 1").groupBy("n", "size", "who").agg(F.min_by(F.struct("bucket", "n_most", "most", "main"), F.struct(F.pmod("bucket", F.lit(BANDS)), "bucket")).alias("one"))
    blocks_of = lambda n, size: F.greatest(F.ceil(n / float(rows)), F.ceil(size / float(cell)), F.lit(1)).cast("int")
    mixed = mixed.select("one.bucket", "one.main", blocks_of(F.col("n") - F.col("one.n_most"), F.col("size") - F.col("one.most")).alias("ni"), blocks_of(F.col("n"), F.col("size")).alias("nj"))
    inside = held.join(mixed, "bucket").select("id", "bucket", "comp", "n_shingles", (F.col("comp") != F.col("main")).alias("outsider"), "ni", "nj")
    own = lambda n: F.pmod(F.xxhash64("id", F.lit("cell")), n).cast("int")
    place = lambda i, j, out, member: F.struct(i.alias("i"), j.alias("j"), out.alias("outsider"), F.lit(member).alias("member"))
    zero, single = F.lit(0), (F.col("ni") == 1) & (F.col("nj") == 1)
    as_member = F.transform(F.sequence(zero, F.col("ni") - 1), lambda i: place(i, own(F.col("nj")), F.lit(False), True))
    as_outsider = F.transform(F.sequence(zero, F.col("nj") - 1), lambda j: place(own(F.col("ni")), j, F.lit(True), False))
    cells = F.when(single, F.array(place(zero, zero, F.col("outsider"), True))).when(F.col("outsider"), F.concat(as_member, as_outsider)).otherwise(as_member)
    dealt = scratch.keep(inside.select("id", "bucket", "comp", "n_shingles", F.explode(cells).alias("c")).select("id", "bucket", "comp", "n_shingles", "c.*"))
    sketches = _only(reps.select("id", "bands"), dealt.select("id").distinct(), broadcast_ids)
    sifted = scratch.keep(dealt.join(sketches, "id").groupBy("bucket", "i", "j").applyInArrow(_sift(percent), _CELL))
    scratch.drop(dealt)
    texts = _only(docs, sifted.select("id").distinct(), broadcast_ids)
    return sifted.join(texts, "id").groupBy("bucket", "i", "j").applyInArrow(_cells(percent), "u long, v long")


def _verified(docs: DataFrame, pairs: DataFrame, percent: int, broadcast_ids: int) -> DataFrame:
    """The pairs id, centre that are similar by their whole texts' sets, as u, v."""
    needed = pairs.select(F.explode(F.array("id", "centre")).alias("id")).distinct()
    texts = _only(docs, needed, broadcast_ids)
    one = pairs.join(texts.select("id", F.col("text").alias("text_a")), "id")
    two = one.join(texts.select(F.col("id").alias("centre"), F.col("text").alias("text_b")), "centre")
    return two.select("id", "centre", "text_a", "text_b").mapInArrow(_check(percent), "u long, v long")


def _first_links(scratch: Scratch, reps: DataFrame, members: DataFrame, grouped: DataFrame, percent: int, ring: int, broadcast_ids: int) -> DataFrame:
    """The likely pairs id > centre of small buckets' members and of larger ones' members with their centres."""
    few = grouped.where("n <= 3").withColumn("mid", F.when(F.col("n") == 3, F.col("hi").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("all"))))
    pair = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("centre"))
    all_pairs = few.select(F.inline(F.array(pair("hi", "lo"), pair("hi", "mid"), pair("mid", "lo")))).where("id is not null and centre is not null")
    stars = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("c1"), F.min_by("id", F.xxhash64("id", "bucket")).alias("c2"))
    centres = F.when(F.col("n") <= ring, F.array_distinct(F.array("c1", "c2"))).otherwise(F.array("c1"))
    star_pairs = members.join(stars, "bucket").select("id", F.explode(centres).alias("centre")).where("id <> centre")
    pairs = all_pairs.unionByName(star_pairs.select(F.greatest("id", "centre").alias("id"), F.least("id", "centre").alias("centre"))).distinct()
    pairs = scratch.keep(pairs)
    known = _only(reps, pairs.select(F.explode(F.array("id", "centre")).alias("id")).distinct(), broadcast_ids)
    near = pairs.join(known.select("id", F.col("n_shingles").alias("na"), F.col("bands").alias("ba")), "id")
    near = near.join(known.select(F.col("id").alias("centre"), F.col("n_shingles").alias("nb"), F.col("bands").alias("bb")), "centre")
    near = near.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    likely = scratch.keep(near.select("id", "centre", "na", "nb", "ba", "bb").mapInArrow(_likely(percent), "id long, centre long"))
    scratch.drop(pairs)
    return likely


def components_of(scratch: Scratch, docs: DataFrame, described: DataFrame, classes: DataFrame, percent: int = 75, ring: int = 64, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """u, root of the class representatives that link to a smaller one. docs: id (unique), text. classes: s1, s2, id of each class."""
    sets = described.where("s1 is not null").select(F.col("doc_id").alias("id"), "s1", "s2", "n_shingles", "bands")
    copies = scratch.keep(sets.select("id", "s1", "s2").join(classes.withColumnRenamed("id", "first"), ["s1", "s2"]).where("id <> first").select("id"))
    reps = sets.join(F.broadcast(copies) if copies.count() <= broadcast_ids else copies, "id", "left_anti").select("id", "n_shingles", "bands")
    # A bucket's number is a hash of band and value whose lowest bits are the band.
    spread = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "value")).select("id", "n_shingles", (F.shiftleft(F.xxhash64("band", "value"), BANDS.bit_length() - 1) + F.col("band")).alias("bucket"))
    grouped = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor("id").alias("all"))
    grouped = scratch.keep(grouped.where("n > 1"))
    large = grouped.where("n > 3").select("bucket")
    members = scratch.keep(spread.join(F.broadcast(large) if large.count() <= broadcast_ids else large, "bucket", "left_semi").select("id", "n_shingles", "bucket"))
    likely = _first_links(scratch, reps, members, grouped, percent, ring, broadcast_ids)
    scratch.drop(grouped)
    # Two rounds join up nearly all of each component. What they leave apart is at worst compared again below.
    edges = contract(scratch, _verified(docs, likely, percent, broadcast_ids), most=2)
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    more = leftover_links(scratch, docs, reps, members, roots, percent, broadcast_ids=broadcast_ids)
    return contract(scratch, edges.unionByName(more)).select("u", F.col("v").alias("root"))


def _numbered(docs: DataFrame, broadcast_ids: int) -> tuple[DataFrame, bool]:
    """docs with a unique __key for each row, and whether it is other than doc_id: rows of a null or repeated doc_id are stored with keys of their own, apart from all ids."""
    named = docs.withColumn("__key", F.col("doc_id").cast("long"))
    again = durable(named.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1 or __key is null").select(F.col("__key").alias("__again")))
    n_again = again.count()
    if not n_again:
        return named, False
    again = F.broadcast(again) if n_again <= broadcast_ids else again
    repeats = named["__key"].eqNullSafe(again["__again"])
    low, high = named.agg(F.coalesce(F.min("__key"), F.lit(0)), F.coalesce(F.max("__key"), F.lit(0))).first()
    place = F.monotonically_increasing_id()
    own = F.lit(low) - 1 - place if low > -(1 << 62) else F.lit(high) + 1 + place
    odd = durable(named.join(again, repeats, "left_semi").withColumn("__key", own))
    return named.join(again, repeats, "left_anti").unionByName(odd), True


def _components(docs: DataFrame, percent: int, ring: int, broadcast_ids: int) -> DataFrame:
    """key, n_shingles, root (the smallest key that the row reaches; null without a set) of each row. docs: __key (unique), text."""
    with Scratch(docs.sparkSession) as scratch:
        described = scratch.keep(describe(docs.select(F.col("__key").alias("doc_id"), "text")))
        classes = scratch.keep(described.where("s1 is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id")))
        roots = components_of(scratch, docs.select(F.col("__key").alias("id"), "text"), described, classes, percent, ring, broadcast_ids)
        of = classes.join(roots, classes["id"] == roots["u"], "left").select("s1", "s2", F.coalesce("root", "id").alias("root"))
        return durable(described.select(F.col("doc_id").alias("key"), "n_shingles", "s1", "s2").join(of, ["s1", "s2"], "left").select("key", "n_shingles", F.coalesce("root", "key").alias("root")))


def near_duplicates(docs: DataFrame, percent: int = 75, ring: int = 64, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text); linked: 100 * intersection >= percent * union."""
    rows, odd = _numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), broadcast_ids)
    found = _components(rows.where("doc_id is not null") if odd else rows, percent, ring, broadcast_ids)
    if not odd:
        return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("root").alias("component_id"), (F.col("key") == F.col("root")).alias("kept"))
    known = found.join(rows.select(F.col("__key").alias("key"), "doc_id"), "key")
    least = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = known.join(least, "root").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    none = describe(rows.where("doc_id is null")).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return named.unionByName(none)


def without_near_duplicates(docs: DataFrame, percent: int = 75, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs with only the row of smallest doc_id (null is last) of each component. Every row is judged by its own text, those of a null or repeated doc_id too."""
    rows, odd = _numbered(docs, broadcast_ids)
    found = _components(rows.select("__key", "text"), percent, 64, broadcast_ids)
    if odd:
        known = found.join(rows.select(F.col("__key").alias("key"), "doc_id"), "key")
        first = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
        gone = known.join(first.select("root", F.col("first.key").alias("first")), "root").where("key <> first").select(F.col("key").alias("__key"))
    else:
        gone = found.where("key <> root").select(F.col("key").alias("__key"))
    gone = durable(gone)
    return rows.join(F.broadcast(gone) if gone.count() <= broadcast_ids else gone, "__key", "left_anti").select(*[f"`{c}`" for c in docs.columns])
