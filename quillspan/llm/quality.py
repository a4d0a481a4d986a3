"""Quality rules under weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (0) or abstains (null) on a document. How often
each pattern of votes occurs is counted over all documents; expectation
maximisation over those counts estimates how often each rule votes bad on good and
on bad documents and the share of good documents, with no labels. A document's
posterior probability of being good then decides, in place of every rule having to pass.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import store

SPLIT = r"[\x20\x09-\x0D]+"
#: Of its votes on bad and on good documents, how many of a rule are bad before any data, and for how many votes that
#: counts; it is constant, so data overrule it. A rule sees one kind of junk, so it passes most bad documents.
BELIEF, WEIGHT = (0.3, 0.03), 10.0
GOOD = 0.8
LIMITS = (0.01, 0.99)
ROUNDS = 25


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are sorted as 64-bit numbers that hold as much of a hash as the
    position leaves free; those with an equal neighbour are sorted once more by
    another hash, so that two different windows pass as equal only if both
    hashes agree.
    """
    bits = F.ceil(F.log2(n + F.lit(2.0))).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def twins(sorted_: Column) -> Column:
        high = lambda x: F.call_function("shiftrightunsigned", x, bits)
        same = lambda x, i, d: F.coalesce(high(x) == high(F.get(sorted_, i + d)), F.lit(False))
        return F.filter(sorted_, lambda x, i: same(x, i, -1) | same(x, i, 1))

    def packed(positions: Column, seed: int) -> Column:
        key = lambda i: F.xxhash64(*([F.lit(seed)] * (seed > 0)), F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.sort_array(F.transform(positions, lambda i: key(i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

    once = let(packed(F.sequence(F.lit(0), n.cast("int") - 3), 0), twins)
    again = let(once, lambda a: F.when(F.size(a) == 0, a).otherwise(let(packed(F.transform(a, lambda x: x.bitwiseAND(mask).cast("int")), 1), twins)))
    starts = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(mask)))
    gained = let(starts, lambda s: F.aggregate(s, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")), lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"]))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(gained)


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts that rules look at, over whole texts; null is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), t.alias("t"), F.filter(F.split(t, SPLIT), lambda w: w != "").alias("w"))
    base = base.withColumn("n_words", F.size("w").cast("long"))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return base.select(
        "doc_id", "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        repeat_words(F.col("w"), F.col("n_words")).alias("n_repeat_words"),
        F.length(F.regexp_replace("t", r"[^A-Z]", "")).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.regexp_replace("t", r"!", ""))).cast("long").alias("n_bangs"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[0-9]", ""))).cast("long").alias("n_digits"),
        F.length(F.regexp_replace("t", r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")).cast("long").alias("n_marks"),
    ).select("*", "l.n_lines", "l.n_dup_lines").drop("l")


def votes() -> dict[str, Column]:
    """The rules: 1 good, 0 bad, null abstains. Shares are compared with counts, so nothing is divided.

    Each votes good where its measure is plain, bad where it is far off, and abstains between
    and where there is nothing to measure. ``marks``, all that is neither letter nor number,
    covers what ``symbols`` and ``bangs`` look at, ``repeats`` what ``dup_lines`` does, so
    rules have peers.
    """
    c = F.col
    n, chars = c("n_words"), c("word_chars")

    def rule(bad: Column, good: Column, seen: Column = n > 0) -> Column:
        return F.when(seen & bad, 0).when(seen & good, 1)

    def share(part: Column, of: Column, bad: int, good: int, seen: Column = n > 0) -> Column:
        return rule(part * 100 > of * bad, part * 100 <= of * good, seen)

    return {
        "short": rule(n < 20, n >= 30, F.lit(True)),
        "symbols": share(c("n_symbols"), n, 12, 4),
        "marks": share(c("n_marks"), chars, 10, 6),
        "dup_lines": share(c("n_dup_lines"), c("n_lines"), 35, 15, c("n_lines") >= 4),
        "repeats": share(c("n_repeat_words"), n, 40, 20),
        "upper": share(c("n_upper"), chars, 35, 12),
        "bangs": share(c("n_bangs"), n, 15, 4),
        "word_length": rule((chars > 15 * n) | (chars < 2 * n), (chars >= 3 * n) & (chars <= 12 * n)),
        "digits": share(c("n_digits"), chars, 25, 8),
    }


def log_odds(prior: float, bad_votes: dict[str, tuple[float, float]]) -> Column:
    """Log odds of good, given the votes: a vote counts by how often its rule casts it on bad and on good documents,
    an abstention not at all."""
    terms = [F.when(F.col(r) == 0, F.lit(math.log(g / b))).when(F.col(r) == 1, F.lit(math.log((1 - g) / (1 - b)))).otherwise(F.lit(0.0)) for r, (b, g) in bad_votes.items()]
    return reduce(lambda x, y: x + y, terms, F.lit(math.log(prior / (1 - prior))))


def estimate(patterns: DataFrame, rules: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, tuple[float, float]]]:
    """Share of good documents and, by rule, the bad ones of its votes on bad and on good documents, from counts of
    vote patterns (3 ** rules at most), by EM.

    Each share starts from ``BELIEF`` (``GOOD``), which goes on counting as ``WEIGHT`` votes (documents). A rule
    never votes bad more often on good documents than on bad ones: at worst its votes are worth nothing. A round is
    one aggregate that returns one row. Without rows the start is kept.
    """
    prior, bad_votes = GOOD, dict.fromkeys(rules, BELIEF)
    held = lambda x: min(LIMITS[1], max(LIMITS[0], x))
    for _ in range(rounds):
        weighed = patterns.withColumn("p", F.col("n") / (1 + F.exp(-log_odds(prior, bad_votes))))
        sums = [F.coalesce(F.sum(F.when(F.col(r) == v, x)), F.lit(0.0)).alias(f"{k}{v}_{r}") for r in rules for v in (0, 1) for k, x in (("g", F.col("p")), ("b", F.col("n") - F.col("p")))]
        row = weighed.agg(F.sum("p").alias("good"), F.sum("n").alias("all"), *sums).first()
        if not row["all"]:
            break
        was = (prior, *(x for r in rules for x in bad_votes[r]))
        prior = held((row["good"] + WEIGHT * GOOD) / (row["all"] + WEIGHT))
        for r in rules:
            b, g = (held((row[f"{k}0_{r}"] + WEIGHT * m) / (row[f"{k}0_{r}"] + row[f"{k}1_{r}"] + WEIGHT)) for k, m in zip("bg", BELIEF, strict=True))
            bad_votes[r] = (max(b, g), g)
        if max(abs(x - y) for x, y in zip(was, (prior, *(x for r in rules for x in bad_votes[r])), strict=True)) < 1e-4:
            break
    return prior, bad_votes


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row a document: the measures, ``posterior`` of good and ``good`` at the threshold.

    Texts without words, null ones too, are never good. Repeated
    rows are counted each; a null key is carried along; other columns are not
    read. Without rows there is nothing to estimate and nothing is returned.
    """
    rules = votes()
    seen = measures(docs, key, text)
    seen = store.staged(seen.select("*", *[v.cast("int").alias(r) for r, v in rules.items()]), "votes")
    patterns = store.staged(seen.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")), "patterns")
    prior, bad_votes = estimate(patterns, list(rules))
    posterior = 1 / (1 + F.exp(-log_odds(prior, bad_votes)))
    return seen.withColumn("posterior", posterior).withColumn("good", (F.col("n_words") > 0) & (F.col("posterior") >= threshold))
