"""Ranked lists as the relation (query_id, source, rank, chunk_id, text): near-duplicate removal, relevance
filtering and reciprocal-rank fusion, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.similarity import overlap_smaller, rank_term
from quillspan.functions.text import token_set

#: Sources in the order in which equal ranks and equal scores are settled.
SOURCES = ("dense", "sparse")


def source_order(source: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SOURCES]), source)


def dedup_ranked(lists: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy near-duplicate removal within and across a query's lists.

    Candidates come by rank, dense before sparse; one is kept unless its token
    overlap, over the smaller set, with a kept one reaches the threshold. Texts
    without words overlap with nothing. Ranks close up per source. The fold is per
    query, over its top-k lists only.
    """
    cand = F.struct(F.col("rank"), source_order(F.col("source")).alias("so"), "source", "chunk_id", "text", token_set("text").alias("t"))
    grouped = lists.groupBy("query_id").agg(F.array_sort(F.collect_list(cand)).alias("c"))
    kind = "array<struct<source:string,chunk_id:bigint,text:string,t:array<string>>>"
    near = lambda acc, x: F.exists(acc, lambda y: overlap_smaller(y["t"], x["t"]) >= threshold)
    item = lambda x: F.struct(x["source"].alias("source"), x["chunk_id"].cast("bigint").alias("chunk_id"), x["text"].alias("text"), x["t"].alias("t"))
    kept = F.aggregate("c", F.array().cast(kind), lambda acc, x: F.when(near(acc, x), acc).otherwise(F.array_append(acc, item(x))))
    rows = grouped.select("query_id", F.posexplode(kept).alias("at", "k")).select("query_id", "at", "k.source", "k.chunk_id", "k.text")
    again = Window.partitionBy("query_id", "source").orderBy("at")
    return rows.withColumn("rank", F.row_number().over(again) - 1).drop("at")


def filter_relevant(scored: DataFrame, threshold: float = 0.3, score: str = "score") -> DataFrame:
    """Rows of (query_id, source, rank, ..., score) at or above the threshold; a list with none keeps its best, the
    first on ties. Order is kept and ranks close up. An empty list stays empty."""
    per = Window.partitionBy("query_id", "source")
    best = F.row_number().over(per.orderBy(F.col(score).desc(), "rank"))
    rows = scored.withColumn("_most", F.max(score).over(per)).withColumn("_best", best)
    rows = rows.where((F.col(score) >= threshold) | ((F.col("_most") < threshold) & (F.col("_best") == 1)))
    return rows.drop("_most", "_best").withColumn("rank", F.row_number().over(per.orderBy("rank")) - 1)


def fuse(lists: DataFrame, weights: dict[str, float] | None = None, top: int = 25, c: int = 60, digits: int = 12) -> DataFrame:
    """Weighted reciprocal-rank fusion, merged by text: (query_id, rank, chunk_id, text, score).

    Every occurrence of a text adds weight / (c + rank + 1), repeats within a list
    too; the first seen, dense before sparse and by rank, lends its chunk_id and
    settles ties. ``weights`` names every source or is None for 1 each; a source
    without a weight is an error.
    """
    if weights is not None:
        missing = set(SOURCES) ^ set(weights)
        if missing:
            raise ValueError(f"one weight for each of {SOURCES} is needed; differs in {sorted(missing)}")
        weight = F.element_at(F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))]), F.col("source"))
    else:
        weight = F.lit(1.0)
    seen = F.struct(source_order(F.col("source")).alias("so"), "rank", "chunk_id")
    merged = lists.groupBy("query_id", "text").agg(F.round(F.sum(rank_term(F.col("rank"), weight, c)), digits).alias("score"), F.min(seen).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    ranked = merged.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top)
    return ranked.select("query_id", "rank", F.col("first.chunk_id").alias("chunk_id"), "text", "score")
