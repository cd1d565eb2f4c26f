"""Secret scanning over an incremental ledger of blobs, in DataFrame functions only.

Every version of every text is addressed by the SHA-256 of its content. The ledger holds, for each blob and version of
the rules, the spans found. A scan takes one row of each blob that the ledger lacks under the current version, scans only
those, adds them to the ledger and joins the findings back to every path (here doc_id) that has the blob.

Spans are zero-based code points, end exclusive; matches of a kind are leftmost and don't overlap. Where a text splits at a pattern,
the pieces and the matches alternate, so their lengths give every span without leaving the engine's expressions.

Null texts count as empty; texts without a finding get zeros and an empty string; repeated rows and rows with a
null doc_id get their findings each; a ledger has at most one entry for a blob and a version; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, exists

#: Kind, pattern, group whose length counts, least length, a literal that every match holds (or none). In order of rank.
BASE = (
    ("assign", r"((?i)password|passwd|secret|token|api_?key)(?-i)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, None),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18, "AKIA"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, None),
)
EXTRA = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, "eyJ"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh"),
)
RULES_VERSION = "1"
_FOUND = "array<struct<start:long,rank:int,end:long,kind:string>>"


def _spans(text: Column, rank: int, rule: tuple) -> Column:
    """The rule's spans of a text, those of the least length or more."""
    kind, pattern, group, least, literal = rule
    may = text.rlike(pattern) if literal is None else F.contains(text, F.lit(literal)) & text.rlike(pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("p"), whole.alias("m"), counted.alias("g"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_FOUND).alias("found"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["p"])
        end = begin + F.coalesce(F.char_length(x["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        hit = F.coalesce(F.char_length(x["g"]), F.lit(-1)) >= least
        return F.struct(end.alias("at"), F.when(hit, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    return F.when(may, F.aggregate(pairs, start, step)["found"])


def find(text: Column, rules: tuple = BASE + EXTRA) -> Column:
    """All spans of a text, by start and rank."""
    none = F.array().cast(_FOUND)
    return F.array_sort(F.concat(*[F.coalesce(_spans(text, k, r), none) for k, r in enumerate(rules)]))


def new_ledger(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULES_VERSION) -> DataFrame:
    """The ledger's missing entries for docs: blob, rules, found. Only blobs without an entry under this version are scanned, each once."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    first = rows.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rules") == version).select("blob"), "blob", "left_anti")
    first = first.select(F.col("blob").alias("b"), F.col("doc_id").alias("d"))
    chosen = rows.join(first.hint("shuffle_hash"), (rows["blob"] == first["b"]) & rows["doc_id"].eqNullSafe(first["d"]), "left_semi")
    return chosen.select("blob", F.lit(version).alias("rules"), find(F.col("text")).alias("found")).dropDuplicates(["blob"])


def scan(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings for each row of docs (doc_id, blob, found), and the ledger's new entries, which the caller appends to its ledger.

    The new entries are made once and stored before their use, so that no later filter can move the scan below the choice of blobs."""
    entries = durable(new_ledger(docs, ledger, version))
    known = entries if ledger is None else entries.unionByName(ledger.where(F.col("rules") == version).select("blob", "rules", F.col("found").cast(_FOUND).alias("found")))
    hits = known.where(F.size("found") > 0).select("blob", "found")
    paths = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"))
    return paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("found", F.array().cast(_FOUND)).alias("found")), entries


def scan_stored(docs: DataFrame, path: str, version: str = RULES_VERSION) -> DataFrame:
    """Findings for each row of docs as of ``scan``, against the ledger kept as Parquet under path (a shared folder; made if missing), which gains the new entries.

    Entries of a version are a partition, so older versions aren't read. A scan that fails before its entries are stored leaves the ledger as it was, and one
    that fails later finds nothing unseen when run again. One scan at a time may write to a ledger."""
    spark = docs.sparkSession
    ledger = spark.read.schema(f"blob string, found {_FOUND}, rules string").parquet(path) if exists(spark, path) else None
    found, entries = scan(docs, ledger, version)
    entries.write.mode("append").partitionBy("rules").parquet(path)
    return found


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 of the base kinds' spans, and spans of all kinds."""
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(r[0]) for r in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
