"""Keyword retrieval: term relations, inverted-index scoring, BM25, top-k.

A posting list is the relation (chunk_id, term, weight); a query is (query_id,
term, weight). Scoring is an equi-join on the term and a sum; Spark broadcasts
the query side when its statistics say that it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import search_tokens


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): tf per term and the number of terms of the text."""
    tokens = docs.select(key, search_tokens(text).alias("_t"))
    return tokens.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: n_docs and avgdl, texts without terms included."""
    sizes = docs.select(F.size(search_tokens(text)).alias("dl"))
    return sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def bm25_index(docs: DataFrame, key: str, text: str, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """Postings (chunk_id, term, weight) of Okapi BM25.

    idf = ln(N - df + 0.5) - ln(df + 0.5); negative values become ``floor`` times
    the mean idf over all terms, before that replacement.
    """
    tf = term_counts(docs, key, text)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = corpus_stats(docs, text)
    idf = df.join(F.broadcast(stats), F.lit(True)).withColumn("idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    idf = idf.join(F.broadcast(mean), F.lit(True)).select("term", "avgdl", F.when(F.col("idf") < 0, floor * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    scored = tf.join(idf, "term")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    return scored.select(F.col(key).alias("chunk_id"), "term", (F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("weight"))


def tfidf_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Postings weighted by (1 + ln tf) * ln(1 + N / df): a stand-in for a learned sparse encoder's weights."""
    tf = term_counts(docs, key, text)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    idf = df.join(F.broadcast(n), F.lit(True)).select("term", F.log1p(F.col("n_docs") / F.col("df")).alias("idf"))
    return tf.join(idf, "term").select(F.col(key).alias("chunk_id"), "term", ((1 + F.log("tf")) * F.col("idf")).alias("weight"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, term, weight): each query term weighs as often as it is asked."""
    return term_counts(queries, key, text).select(F.col(key).alias("query_id"), "term", F.col("tf").cast("double").alias("weight"))


def sparse_scores(queries: DataFrame, index: DataFrame, digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, score) of chunks that share a term, rounded so that sums of any order tie alike."""
    q = queries.select("query_id", "term", F.col("weight").alias("qw"))
    return q.join(index, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("qw") * F.col("weight")), digits).alias("score"))


def top_k(scores: DataFrame, k: int, by: Column | None = None) -> DataFrame:
    """The k best per query with their rank from 0; ties go to the smaller chunk_id."""
    order = Window.partitionBy("query_id").orderBy((by if by is not None else F.col("score")).desc(), F.col("chunk_id"))
    return scores.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def scan_top_k(scores: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Always k rows a query: after the scored chunks, those of score 0, by chunk_id.

    ``scores`` may be the k best of each query alone.
    A query that is short of k has fewer than k scored chunks, so its blanks are
    among the 2k smallest ids.
    """
    best = top_k(scores, k)
    scored = scores.select("query_id", "chunk_id")
    short = queries.select("query_id").distinct().join(scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    short = short.select("query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    firsts = chunks.select("chunk_id").distinct().orderBy("chunk_id").limit(2 * k)
    blank = short.join(F.broadcast(firsts), F.lit(True)).join(scored, ["query_id", "chunk_id"], "left_anti")
    fill = Window.partitionBy("query_id").orderBy("chunk_id")
    blank = blank.withColumn("rank", F.col("n") + F.row_number().over(fill) - 1).where(F.col("rank") < k)
    return best.select("query_id", "chunk_id", "score", "rank").unionByName(blank.select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.col("rank").cast("int")))
