"""Document quality by weak supervision, in DataFrame functions only.

Rules look at counts of the whole text; each votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over how often each combination of votes occurs (at most 3 ** rules rows, whatever the corpus) estimates the share of
good documents and, per rule, how often it votes each way, rightly or wrongly, on good and on bad ones. A document stays if it doesn't fail
the base rule and its posterior probability of being good is ``threshold`` or more; a tie with the threshold stays.

Every text is measured once: ``judge`` stores the counts alone, ``keep_good`` the rows with their votes, in the shared folder, and the estimate
and the verdicts read what is stored. Nothing is cached, so each call sees its table as it is then.

Null, empty and blank texts have no words and fail the base rule; repeated rows are judged each for itself; very long texts are measured
whole, as arrays of their words in one row; other columns, of whatever name, are left out of ``judge`` and pass through ``keep_good``; doc_id may
be null; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, durable

SPACE = r"[\x20\x09-\x0D]+"


def measure(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper and n_shouts of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.size(F.split(text, pattern, -1)) - 1
    step = docs.select(
        *docs.columns,
        F.array_remove(F.split(text, SPACE, -1), "").alias("__words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        count(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        count("[A-Z]").cast("long").alias("n_upper"),
        count("!").cast("long").alias("n_shouts"),
    )
    words = F.col("__words")
    window = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    step = step.select(
        *docs.columns,
        "n_symbols",
        "n_upper",
        "n_shouts",
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        window.alias("__windows"),
    )
    hashes = F.col("__windows")
    ordered = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.withColumn("__windows", ordered)
    same = lambda p, k: p["h"] == F.get(F.col("__windows"), k)["h"]
    again = F.filter("__windows", lambda p, k: F.coalesce(same(p, k + 1), F.lit(False)) | F.coalesce(same(p, k - 1), F.lit(False)))
    step = step.withColumn("__windows", F.sort_array(F.transform(again, lambda p: p["i"])))
    covered = F.transform("__windows", lambda s, k: F.least(F.lit(3), F.coalesce(F.get(F.col("__windows"), k + 1) - s, F.lit(3))))
    repeated = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0).cast("long"))).drop("__windows")


def rules() -> dict[str, Column]:
    """A vote for each rule: good (1), bad (-1) or none (0). Most rules know one flaw and vote bad or abstain; two know
    prose and vote good or abstain. A document without words gets none."""
    n, some = F.col("n_words"), F.col("n_words") > 0
    bad = lambda c: F.when(some & c, -1).otherwise(0)
    good = lambda c: F.when(some & c, 1).otherwise(0)
    calm = (F.col("n_symbols") * 50 <= n) & (F.col("n_upper") * 5 <= F.col("word_chars")) & (F.col("n_shouts") * 20 <= n)
    # A line that comes back once or twice, such as a heading or a footer, is no flaw in itself.
    again = (F.col("n_dup_lines") > 2) & (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3)
    fresh = (F.col("n_repeat_words") * 10 <= n * 3) & ~again
    return {
        "symbols": bad(F.col("n_symbols") * 10 > n),
        "shouting": bad(F.col("n_upper") * 10 > F.col("word_chars") * 4),
        "exclaiming": bad(F.col("n_shouts") * 5 > n),
        "lines": bad(again),
        "repeats": bad(F.col("n_repeat_words") * 10 > n * 3),
        "word_length": bad((F.col("word_chars") > n * 14) | (F.col("word_chars") < n * 2)),
        "prose": good(calm & fresh & (F.col("word_chars") >= n * 3) & (F.col("word_chars") <= n * 11)),
        "long": good((n >= 100) & calm & fresh),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


Rates = list[tuple[dict[int, float], dict[int, float]]]


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500) -> tuple[float, Rates]:
    """The prior of good and, per rule, how often it votes each way on good and on bad documents.

    patterns: votes and how often they occur. A rule's bad vote never counts for good, nor its good vote for bad."""
    width = len(patterns[0][0]) if patterns else 0
    prior, rates = 0.8, [({-1: 0.05, 0: 0.45, 1: 0.5}, {-1: 0.3, 0: 0.65, 1: 0.05})] * width
    for _ in range(rounds):
        weight, seen = [0.8, 0.2], [({-1: 0.05, 0: 0.45, 1: 0.5}, {-1: 0.3, 0: 0.65, 1: 0.05}) for _ in range(width)]
        for votes, n in patterns:
            p = posterior(votes, prior, rates)
            weight[0] += n * p
            weight[1] += n * (1 - p)
            for (good, bad), v in zip(seen, votes, strict=True):
                good[v] += n * p
                bad[v] += n * (1 - p)
        new: Rates = []
        for good, bad in seen:
            g, b = ({v: x / sum(c.values()) for v, x in c.items()} for c in (good, bad))
            if g[-1] > b[-1] or b[1] > g[1]:
                both = sum(good.values()) + sum(bad.values())
                g = b = {v: (good[v] + bad[v]) / both for v in good}
            new.append((g, b))
        moved = max([abs(a[v] - b[v]) for x, y in zip(new, rates, strict=True) for a, b in zip(x, y, strict=True) for v in a], default=0)
        prior, rates = weight[0] / sum(weight), new
        if moved < 1e-9:
            break
    return prior, rates


def log_odds(rates: Rates) -> list[dict[int, float]]:
    """What each vote of each rule adds to the log odds of good."""
    return [{v: math.log(max(g[v], 1e-9) / max(b[v], 1e-9)) for v in g} for g, b in rates]


def posterior(votes: tuple[int, ...], prior: float, rates: Rates) -> float:
    z = math.log(prior / (1 - prior)) + sum(w[v] for v, w in zip(votes, log_odds(rates), strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _verdict(stored: DataFrame, votes: list[str], threshold: float) -> DataFrame:
    """stored (base_failed and a column for each vote) with posterior and kept."""
    counted = stored.groupBy(*votes).agg(F.count("*").alias("__n"))
    patterns = sorted((tuple(r[v] for v in votes), r["__n"]) for r in counted.collect())
    prior, rates = expectation_maximisation(patterns)
    z = F.lit(math.log(prior / (1 - prior)))
    for vote, add in zip(votes, log_odds(rates), strict=False):
        z = z + F.when(F.col(vote) > 0, F.lit(add[1])).when(F.col(vote) < 0, F.lit(add[-1])).otherwise(F.lit(add[0]))
    return stored.withColumn("posterior", 1 / (1 + F.exp(-z))).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def _voted(measured: DataFrame) -> tuple[DataFrame, list[str]]:
    """measured with base_failed and the votes, and the votes' columns."""
    votes = {f"__{k}": c.cast("tinyint") for k, c in rules().items()}
    return measured.withColumns({"base_failed": base_failed()} | votes), list(votes)


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts of ``measure``, base_failed, posterior and kept for each row of docs."""
    stored, votes = _voted(durable(measure(docs.select("doc_id", "text")).drop("text")))
    return _verdict(stored, votes, threshold).drop(*votes)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that ``judge`` keeps, as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    voted, votes = _voted(measure(docs.select(row, "text")))
    stored = Scratch(docs.sparkSession).keep_till_exit(voted.select("__row", "base_failed", *votes))
    return _verdict(stored, votes, threshold).where("kept").select("__row.*").select(*[f"`{c}`" for c in docs.columns])
