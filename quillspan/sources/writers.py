"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import strip


def write_text(df: DataFrame, column: str, path: str, append: bool = False, separator: str = "\n\n") -> None:
    """Texts that are not blank as corpus text, each followed by the separator."""
    kept = df.where(strip(column) != "").select(column)
    kept.write.mode("append" if append else "overwrite").option("lineSep", separator).text(path)


def concatenate(first: DataFrame, second: DataFrame, order: str) -> DataFrame:
    """Rows of both, the first's before the second's: (part, then the order column)."""
    return first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)), allowMissingColumns=True).orderBy("part", order)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_summary(df: DataFrame, columns: list[str], path: str) -> None:
    """CSV of the named columns only, in their order; a column that is missing is written empty."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True)


def log_lines(df: DataFrame) -> DataFrame:
    """The human side of a run's log: one text a result."""
    return df.select(F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns], F.lit("-" * 40)).alias("line"))
