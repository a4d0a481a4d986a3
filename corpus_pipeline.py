"""A training corpus from raw documents: toxicity, near-duplicates, benchmark leaks, mix, token files.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept,
written as Parquet and read again, and works on all of it. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, linking, mixing, ngram_join, store, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, marks as toxic go.

    Null and empty texts get the class prior, so they stay unless most labelled documents are toxic. Each row is
    judged by its own text, repeated rows alike; without labels all rows stay. Other columns pass through,
    whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, flag = linking.spare(docs.columns, "score", "flag")
    scored = toxicity.toxicity(docs, toxicity.train(docs, labels), score_as=score, flag_as=flag)
    return scored.where(~F.col(flag)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles at 0.8 tie together, the document with the least id stays.

    Null and empty texts link with nothing and stay, as do rows with a null key. Of rows that share the id that
    stays, whether their texts are equal or not, one stays: that with the least hash of all its columns.
    """
    groups = ngram_join.ngram_join(docs, n=5, percent=80)
    gone = groups.where("component_id < doc_id").select("doc_id").distinct()
    left = linking.without(docs, "doc_id", store.staged(gone, "gone")).select(*docs.columns)
    return linking.one_row_each(left, "doc_id")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an eight-word window of any benchmark item go, or with all words of two shorter items.

    One short item alone is no evidence: its words may stand in any text. Null and empty texts stay, and all rows
    if the benchmark has no words. Rows of one key go together; a null key is a key.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items, min_items=2)
    gone = store.staged(found.where("n_full >= 1 or contaminated").select(F.col("doc_id").alias("gone_id")).distinct(), "leaks")
    (own,) = linking.spare(docs.columns, "gone")
    gone = gone.withColumnRenamed("gone_id", own)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[own]), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that sources come near their target weights.

    Rows of equal key and text are taken equally often. Null and empty texts have no size: they come once for each
    whole epoch of their source, in a source of no words never. A null source is a source, null keys tie.
    """
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone; null keys come first; repeated rows are written each.
    """
    return tokens.read_tokens(tokens.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: The toxicity stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.staged(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
