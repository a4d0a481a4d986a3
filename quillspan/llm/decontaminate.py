"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window of a benchmark item is a set of positioned shingles of three words. For
exact containment all shingles of a window must occur, so its necessary prefix is
its rarest one by count over all documents. A first pass only counts how often
the benchmark's shingles occur. A second joins the documents' shingles with the
prefixes alone; length and position bounds place the window in the document, and
the words around the match are compared with the window's, word by word. Joins
are broadcast up to ``MAX_BROADCAST`` shingles; beyond it they shuffle hashes and
positions, and words are fetched only for what has matched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import store

SHINGLE = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct shingles of the benchmark that are broadcast at most (16 bytes each); beyond it the join shuffles.
MAX_BROADCAST = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    """Runs of digits, letters a-z after lower-casing A-Z, and all that is not ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def windows(items: DataFrame, size: int) -> DataFrame:
    """window (its words), n, and item_id of each window of each item."""
    rows = items.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size + 1, F.lit(1))
    rows = rows.select("item_id", "w", F.explode(F.sequence(F.lit(1), last)).alias("i"))
    return rows.select("item_id", F.slice("w", F.col("i"), size).alias("window")).distinct().withColumn("n", F.size("window"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 8, min_items: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items (sorted strings), n_full (items with an occurring window of
    ``size`` words), contaminated.

    A window is ``size`` consecutive words of an item, or all words of a shorter
    one. A document word inside any occurrence of a window is hit. Null or empty
    texts have no words and hit nothing; null or empty items have no windows; with
    an empty benchmark no document is hit. Equal items or windows count for each
    item. Rows are told apart by key and text, so a repeated row repeats its
    result; a null key is a key. Other columns are not read.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("row"), F.split("text", SEPARATORS_ANY_CASE).alias("raw"))
    held = store.staged(windows(benchmark.select("item_id", "text"), size).withColumn("window_id", F.xxhash64("window")), "windows")
    width = F.least(F.lit(SHINGLE), F.col("n"))
    grams = held.select("window_id", "window", "n").distinct().select("window_id", "window", "n", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("off"))
    gram = F.slice("window", F.col("off") + 1, F.col("width"))
    grams = store.staged(grams.withColumn("h", F.xxhash64(F.transform(gram, F.lower))), "shingles")
    words = own.select("doc_id", "row", "raw", F.posexplode("raw").alias("pos", "word"))
    reach = size - 1

    def meets(m: int, side: DataFrame, few: bool, *more: str) -> DataFrame:
        """The places of the shingles of m words that are among ``side`` (h)."""
        folded = [F.lower(F.get("raw", F.col("pos") + i)) for i in range(m)]
        every = words.select("doc_id", "row", *more, "pos", F.xxhash64(*folded).alias("h"))
        return every.join(F.broadcast(side) if few else side.hint("merge"), "h")

    def split(tokens: DataFrame) -> list[tuple[int, DataFrame, bool]]:
        """Distinct shingles (width, h) by width, and whether they are few enough to broadcast."""
        distinct = tokens.select("width", "h").distinct()
        sizes = distinct.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()  # three rows at most
        return [(r["width"], distinct.where(F.col("width") == r["width"]).select("h"), r["n"] <= MAX_BROADCAST) for r in sizes]

    counts = own.select("doc_id", "row", (F.size("raw") - edge_blanks("raw")).cast("long").alias("n_words"))
    found = [meets(m, side, few).groupBy("h").agg(F.count(F.lit(1)).alias("df")).withColumn("width", F.lit(m)) for m, side, few in split(grams)]
    if not found:
        none = F.lit(0).cast("long")
        return counts.select("doc_id", "n_words", none.alias("n_hit"), none.alias("n_items"), F.array().cast("array<string>").alias("items"), none.alias("n_full"), F.lit(False).alias("contaminated"))
    rarity = store.staged(reduce(DataFrame.unionByName, found), "rarity")
    prefix = grams.join(rarity, ["width", "h"]).groupBy("window_id", "window", "n", "width").agg(
        F.min_by(F.struct("h", "off"), F.struct("df", "off")).alias("p"), F.count(F.lit(1)).alias("present"))
    prefix = prefix.where(F.col("present") == F.col("n") - F.col("width") + 1).select("window_id", "window", "n", "width", "p.h", "p.off")
    prefix = store.staged(prefix, "prefix")

    found = [grams.select("window_id").where("false").select(F.lit(None).cast(own.schema["doc_id"].dataType).alias("doc_id"), *(F.lit(None).cast(t).alias(c) for c, t in (
        ("row", "long"), ("h", "long"), ("width", "int"), ("at", "int"), ("lead", "int"), ("around", "array<string>"))))]
    for m, side, few in split(prefix):
        if few:
            hits = meets(m, side, True, "raw")
        else:
            at = meets(m, side, False).groupBy("doc_id", "row").agg(F.collect_set(F.struct("pos", "h")).alias("spots")).withColumnsRenamed({"doc_id": "d", "row": "r"})
            hits = own.dropDuplicates(["doc_id", "row"]).join(at.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")))
            hits = hits.select("doc_id", "row", "raw", F.inline("spots"))
        found.append(hits.select(
            "doc_id", "row", "h", F.lit(m).alias("width"), F.col("pos").alias("at"), F.least(F.col("pos"), F.lit(reach)).alias("lead"),
            F.slice("raw", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach)) + m + reach).alias("around")))
    matches = store.staged(reduce(DataFrame.unionByName, found), "matches")
    items = held.groupBy("window_id", "window").agg(F.collect_set(F.struct(F.col("item_id").cast("string").alias("item"), (F.col("n") == size).alias("full"))).alias("items"))
    prefix = prefix.join(items, ["window_id", "window"])
    placed = matches.join(prefix, ["width", "h"]).where(
        (F.col("lead") >= F.col("off")) & (F.size("around") - F.col("lead") >= F.col("n") - F.col("off")))
    exact = F.transform(F.slice("around", F.col("lead") - F.col("off") + 1, F.col("n")), lambda w: F.translate(w, UPPER, LOWER))
    spans = placed.where(exact == F.col("window")).select("doc_id", "row", (F.col("at") - F.col("off")).alias("start"), (F.col("at") - F.col("off") + F.col("n")).alias("end"), "items")

    before = F.max("end").over(Window.partitionBy("doc_id", "row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))))
    hit = spans.withColumn("fresh", fresh).groupBy("doc_id", "row").agg(
        F.sum("fresh").cast("long").alias("n_hit"), F.flatten(F.collect_set("items")).alias("both"))
    named = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: x["item"]), lambda x: x.isNotNull())))
    hit = hit.select("doc_id", "row", "n_hit", named(F.col("both")).alias("items"), F.size(named(F.filter("both", lambda x: x["full"]))).cast("long").alias("n_full"))
    hit = hit.withColumnsRenamed({"doc_id": "d", "row": "r"})
    out = counts.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items_col).cast("long").alias("n_items"),
        items_col.alias("items"), F.coalesce("n_full", F.lit(0).cast("long")).alias("n_full"), (F.size(items_col) >= min_items).alias("contaminated"))


def edge_blanks(raw: str) -> Column:
    """The empty strings at the ends of a split."""
    first = (F.get(raw, F.lit(0)) == "").cast("int")
    return first + ((F.size(raw) > 1) & (F.try_element_at(F.col(raw), F.lit(-1)) == "")).cast("int")
