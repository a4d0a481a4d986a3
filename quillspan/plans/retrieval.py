"""Hybrid retrieval over a batch of queries: lists, near-duplicates, relevance, fusion, critique, answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.parsing import critique_ids
from quillspan.functions.text import joined_context, numbered_candidates
from quillspan.operators import dense, fusion, sparse

CRITIC = "Choose the chunks that help to answer the question. Reply with a JSON array of at most {k} chunk ids, best first.\n"
ANSWER = "Answer from the context only. If it is not there, say that it does not contain enough information.\n"


def ranked_lists(dense_top: DataFrame, sparse_top: DataFrame, chunks: DataFrame) -> DataFrame:
    """Both lists as (query_id, source, rank, chunk_id, text), texts from chunks (chunk_id, text).

    The lists, k short rows a query, go to where the texts are.
    """
    lists = dense_top.select("query_id", F.lit("dense").alias("source"), "rank", "chunk_id").unionByName(
        sparse_top.select("query_id", F.lit("sparse").alias("source"), "rank", "chunk_id"))
    return chunks.select("chunk_id", "text").join(F.broadcast(lists), "chunk_id").select("query_id", "source", "rank", "chunk_id", "text")


def retrieve_stages(
    lists: DataFrame, weights: dict[str, float] | None = None, top_k: int = 15, final_k: int = 7, dedup: float | None = 0.5,
    relevance: DataFrame | None = None, threshold: float = 0.3,
) -> DataFrame:
    """(query_id, stage, rank, chunk_id, text): dense and sparse as they came; hybrid and final after near-duplicate
    removal, the relevance filter if ``relevance`` (query_id, chunk_id, score) is given, and fusion."""
    kept = lists if dedup is None else fusion.dedup_ranked(lists, dedup)
    if relevance is not None:
        kept = fusion.filter_relevant(kept.join(relevance, ["query_id", "chunk_id"]), threshold).drop("score")
    fused = fusion.fuse(kept, weights, top_k)
    stages = F.when(F.col("rank") < final_k, F.array(F.lit("hybrid"), F.lit("final"))).otherwise(F.array(F.lit("hybrid")))
    raw = lists.select("query_id", F.col("source").alias("stage"), "rank", "chunk_id", "text")
    return raw.unionByName(fused.select("query_id", F.explode(stages).alias("stage"), "rank", "chunk_id", "text"))


def criticised(fused: DataFrame, queries: DataFrame, complete: Callable[[Column], Column], k: int = 6) -> DataFrame:
    """The critic's choice of each query's fused list, in its order; lists of k or fewer need no critic."""
    lists = fused.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "chunk_id"))).alias("c")).join(queries, "query_id")
    prompt = F.concat(F.lit(CRITIC.replace("{k}", str(k))), F.lit("Question: "), F.col("query"), F.lit("\n\n"), numbered_candidates(F.col("c")))
    # Two frames: under a condition within one, the model would be called for every row.
    n = F.size("c")
    asked = lists.where(n > k).select("query_id", "c", critique_ids(complete(prompt), n, k).alias("ids"))
    spared = lists.where(n <= k).select("query_id", "c", F.sequence(F.lit(0), n - 1).alias("ids"))
    picked = asked.unionByName(spared).select("query_id", "c", F.posexplode("ids").alias("rank", "i"))
    return picked.select("query_id", "rank", F.get("c", F.col("i"))["chunk_id"].alias("chunk_id"), F.get("c", F.col("i"))["text"].alias("text"))


def answered(chosen: DataFrame, queries: DataFrame, complete: Callable[[Column], Column]) -> DataFrame:
    """(query_id, answer, context) from the chosen chunks."""
    context = chosen.groupBy("query_id").agg(joined_context(F.collect_list(F.struct("rank", "text"))).alias("context"))
    rows = queries.join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompt = F.concat(F.lit(ANSWER), F.lit("=== CONTEXT START ===\n"), F.col("context"), F.lit("\n=== CONTEXT END ===\n\nQuestion: "), F.col("query"))
    return rows.select("query_id", complete(prompt).alias("answer"), "context")


def respond(
    queries: DataFrame, chunks: DataFrame, index: DataFrame, vectors: DataFrame, query_vectors: DataFrame, complete: Callable[[Column], Column],
    top_k: int = 25, final_k: int = 6, weights: dict[str, float] | None = None, dedup: float | None = 0.5, expand: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One answer a query (query_id, query): the whole chain. ``expand`` rewrites the query for keyword search."""
    asked = queries.withColumn("query", expand(F.col("query"))) if expand else queries
    keyword = sparse.top_k(sparse.sparse_scores(sparse.query_terms(asked, "query_id", "query"), index), top_k)
    lists = ranked_lists(dense.dense_top_k(query_vectors, vectors, top_k), keyword, chunks)
    stages = retrieve_stages(lists, weights or {"dense": 0.7, "sparse": 0.3}, top_k, final_k, dedup)
    fused = stages.where("stage = 'hybrid'").drop("stage")
    return answered(criticised(fused, queries, complete, final_k), queries, complete)
