"""Exact nearest neighbours by cosine: a set of queries, in blocks, against all vectors.

Each block of queries is one matrix that travels with the tasks; a few vectors
are multiplied with a part of it at once. A task keeps the k best of each query, so
what is shuffled is k rows a query and task, and what a task holds depends on
neither the number of vectors nor, beyond a block, that of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.scoring import BLOCK, NULL, TEXTS, Best
from quillspan.operators.sparse import top_k

#: Queries of one pass over the vectors.
PASS = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, score, rank from 0): cosine in doubles, rounded, ties to the smaller chunk_id.

    queries (query_id, vector) and vectors (chunk_id, vector) of one dimension;
    null vectors are left out; a vector without length scores 0. The queries are
    read block by block to the driver, never all at once.
    """
    rows = queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("long"), "vector").toLocalIterator(prefetchPartitions=True)
    spark, out, block = queries.sparkSession, None, []

    def best_of(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block], np.int64)
        shared = spark.sparkContext.broadcast((ids, _matrix(pa.array([r[1] for r in block]))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            best = Best(len(names), k)
            for batch in batches:
                chunk = pc.fill_null(batch.column(0), NULL).to_numpy()
                for at in range(0, len(chunk), TEXTS):
                    few = _matrix(batch.column(1).slice(at, TEXTS)).T
                    for lo in range(0, len(names), BLOCK):
                        best.add(lo, asked[lo : lo + BLOCK] @ few, chunk[at : at + TEXTS], True, digits)
            yield pa.RecordBatch.from_arrays([pa.array(names[best.query]), pa.array(best.id, mask=best.id == NULL), pa.array(best.score)], ["query_id", "chunk_id", "score"])

        return vectors.where(F.col("vector").isNotNull()).select(F.col("chunk_id").cast("long"), "vector").mapInArrow(run, "query_id long, chunk_id long, score double")

    for row in rows:
        block.append(row)
        if len(block) == PASS:
            part, block = best_of(block), []
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = best_of(block) if block else spark.createDataFrame([], "query_id long, chunk_id long, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, k)
