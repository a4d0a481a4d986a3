"""Building and running evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import strip


def long_enough(text: Column, more_than: int = 100) -> Column:
    return F.length(strip(text)) > more_than


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of the key: random, without replacement, the same on every run; all if fewer."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def subset(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows whose key is in a fixed list."""
    return df.where(F.col(key).isin(ids))


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet answered; an answer that records an error counts as done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def numbered(accepted: DataFrame, order: str, name: str = "id", pattern: str = "q%04d") -> DataFrame:
    """Ids in sequence over accepted rows only, in the order given (one window over an evaluation set)."""
    return accepted.withColumn(name, F.format_string(pattern, F.row_number().over(Window.orderBy(order))))
