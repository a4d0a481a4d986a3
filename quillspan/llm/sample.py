"""A bounded choice of labelled rows, for classifiers that are fitted on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded(rows: DataFrame, text: str, order: list[str], max_rows: int, max_bytes: int) -> pa.Table:
    """Distinct rows, the first by ``order``, then by the other columns: ``max_rows`` at most, and as many of them
    as together have ``max_bytes`` of text at most. Rows come in that order; null texts as empty.

    Only keys, hashes and sizes are compared; the chosen rows' texts are fetched by a broadcast join.
    """
    rows = rows.withColumn(text, F.coalesce(text, F.lit(""))).withColumn("_hash", F.xxhash64(text))
    names = [*order, *(c for c in rows.columns if c not in (*order, text, "_hash")), "_hash"]
    first = rows.select(*names, F.octet_length(text).alias("_size")).distinct().orderBy(*names).limit(max_rows)
    so_far = F.sum("_size").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, 0))  # max_rows rows in one task
    chosen = first.withColumn("_sum", so_far).where(F.col("_sum") <= max_bytes).select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(names)))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(names)]
    found = rows.join(F.broadcast(chosen), same).select(*names, text).dropDuplicates(names)
    return found.toArrow().sort_by([(c, "ascending") for c in names]).drop_columns(["_hash"])
