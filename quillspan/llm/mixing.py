"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations.

Every document gets the exponential key -ln(u) / q, u from a hash of its key and
the seed, q its quality weight; ascending keys are a weighted sample without
replacement. A source whose target is e whole epochs and a rest takes every
document e times, then documents in key order until the rest is filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import linking

#: Ranges of keys that a source's prefix sums are taken over, before those within a range.
RANGES = 4096
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of characters outside ASCII white space; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_SPLIT)
    return (F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - ((F.size(parts) > 1) & (F.try_element_at(parts, F.lit(-1)) == "")).cast("int")).cast("long")


def quality(text: Column) -> Column:
    """1 down to 0.1 with the share of `#*$%&|<>` in the text."""
    t = F.coalesce(text, F.lit(""))
    marks = F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - 4.0 * marks / F.greatest(F.length(t), F.lit(1)))


def unit_hash(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 48 bits of md5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size) with the target of each source.

    Sources by code point, null last, take the weights in turn and share the sum
    of sizes. No target passes ``cap`` times its size; the excess is shared by
    weight among the rest. A source is capped if, with sources in order of
    cap / weight, the level reached after capping all before it still exceeds its
    own ratio; the levels after the first source that is not capped only fall, so
    the greatest of them is the one all share. One row a source; a window over all of them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("c", cap * F.col("source_size")).withColumn("r", F.col("c") / F.col("w"))
    total, everyone = F.sum("source_size").over(Window.partitionBy()), F.sum("w").over(Window.partitionBy())
    by_ratio = Window.orderBy("r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    spent, gone = F.coalesce(F.sum("c").over(by_ratio), F.lit(0.0)), F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0))
    rows = rows.withColumn("level", (total - spent) / (everyone - gone)).withColumn("capped", F.col("r") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("c")).otherwise(level * F.col("w")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row a document: doc_id, text_hash, source, size, source_size, target, epochs, extra and taken (words).

    Null or empty texts have size 0 and are taken in whole epochs only; null
    sources are one source; a null key hashes as "null"; equal keys with equal
    texts tie and are taken in any order, which changes no sum. No rows give no
    rows. Other columns are not read.

    A document is an extra if at least half of it lies within the rest, so the sum
    misses the target by half a document at most. Prefix sums within a source run
    over ``RANGES`` ranges of the key's own distribution, then within each range,
    so that a source with most of the rows is spread over many tasks.
    """
    base = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash"),
        (-F.log(unit_hash(F.col(key), seed)) / quality(F.col(text))).alias("es_key"),
    ).withColumn("range", F.floor((1 - F.exp(-F.col("es_key"))) * RANGES).cast("int"))
    ranges = base.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    sizes = ranges.groupBy("source").agg(F.sum("in_range").alias("source_size"))
    goal = targets(sizes, weights, cap)
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = ranges.select("source", "range", F.coalesce(F.sum("in_range").over(up_to), F.lit(0)).alias("before")).alias("a")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).alias("g")
    plan = plan.join(goal, F.col("a.source").eqNullSafe(F.col("g.source"))).select(
        F.col("a.source").alias("s"), F.col("range").alias("g"), "before", "source_size", "target", "epochs", "rest")
    within = Window.partitionBy("source", "range").orderBy("es_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("g")))
    extra = (F.col("size") > 0) & (F.col("before") + F.col("inner") + F.col("size") / 2.0 <= F.col("rest"))
    return rows.withColumn("extra", extra.cast("long")).select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", "epochs", "extra",
        ((F.col("epochs") + F.col("extra")) * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: epochs, and once more if it is an extra.

    Rows of equal key and text are taken equally often. All columns are kept.
    """
    times, own, hashed, turn = linking.spare(docs.columns, "times", "key", "hash", "turn")
    plan = mix(docs, key, text, **settings).groupBy("doc_id", "text_hash").agg(F.max(F.col("epochs") + F.col("extra")).cast("int").alias(times))
    plan = plan.where(F.col(times) > 0).withColumnsRenamed({"doc_id": own, "text_hash": hashed})
    joined = docs.join(plan.hint("merge"), docs[key].eqNullSafe(F.col(own)) & (F.xxhash64(docs[text]) == F.col(hashed)))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(turn)).drop(turn)
