"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspan.functions.text import BAR, strip

RECORD = "title string, document_type string, document_date string, volume string, section string, source string, original_language string, contents string, footnotes map<string,string>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, one row each: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON records: a file is one object or a list of them."""
    return spark.read.schema(RECORD).json(path, multiLine=True)


QUESTION = "struct<id:string,question:string,ground_truth:string,context:string,source:string,chunk_id:bigint>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON evaluation set: a list, or an object with it under `data`, `questions` or `items`.

    context is a string or a list; blank contexts go, and so do rows without a
    question or any context. A missing id is q and the row's place in the input,
    from 1, with four digits. (id, question, ground_truth, context, source, chunk_id)
    """
    raw = spark.read.text(path, wholetext=True).select(strip("value").alias("j"))
    listed = F.when(F.col("j").startswith("["), F.col("j")).otherwise(F.coalesce(*[F.get_json_object("j", f"$.{k}") for k in ("data", "questions", "items")]))
    rows = raw.select(F.posexplode(F.from_json(listed, f"array<{QUESTION}>")).alias("pos", "q")).select("pos", "q.*")
    as_list = F.from_json(F.when(F.col("context").startswith("["), F.col("context")), "array<string>")
    contexts = F.filter(F.coalesce(as_list, F.array("context")), lambda c: c.isNotNull() & (strip(c) != ""))
    rows = rows.withColumn("id", F.coalesce("id", F.format_string("q%04d", F.col("pos") + 1))).withColumn("context", contexts)
    return rows.where((strip("question") != "") & (F.size("context") > 0)).drop("pos")


def read_table(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header, quoted fields over several lines and of any length, a byte-order mark allowed.

    Columns of ``schema`` are found by their header name, wherever they stand, and cast; one that the header
    lacks is null. ``required`` columns that the header lacks are an error.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "maxCharsPerColumn": -1, "encoding": "UTF-8"}
    head = spark.read.csv(path, **options).columns
    lost = [c for c in required if c not in [h.lstrip("﻿") for h in head]]
    if lost:
        raise ValueError(f"columns {lost} are missing; there are {head}")
    names = [h.lstrip("\ufeff") for h in head]
    rows = spark.read.csv(path, **options).toDF(*names)
    return rows.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in StructType.fromDDL(schema).fields])


def corpus_blocks(corpus: DataFrame, text: str = "text", least: int = 50) -> DataFrame:
    """(idx, doc_id, title, full_text) of blocks between bars, stripped, of ``least`` characters or more.

    The id is doc_v and _s with the block's volume and section; a missing volume
    is 0, a missing section and a missing title take the block's place, from 1,
    before short ones go.
    """
    rows = corpus.select(F.posexplode(F.split(text, BAR)).alias("idx", "b")).select("idx", strip(F.col("b")).alias("b")).where(F.length("b") >= least)

    def field(pattern: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract("b", pattern, 1), F.lit("")), default)

    place = (F.col("idx") + 1).cast("string")
    return rows.select(
        "idx", F.concat(F.lit("doc_v"), field(r"Volume:\s*(\d+)", F.lit("0")), F.lit("_s"), field(r"Section:\s*(\d+)", place)).alias("doc_id"),
        strip(field(r"Title:\s*([^\n]+)", F.concat(F.lit("Document "), place))).alias("title"), F.col("b").alias("full_text"))
