"""Evaluation runs as streams: results are appended as they come, and a stopped run goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan.sources.writers import log_lines


def evaluate_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Answers each new question of a stream once and appends JSON results and a text log under ``out``.

    A batch that runs again after a failure first leaves out keys that its earlier
    run has written, errors included, as a restarted run does.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        done_at = f"{out}/results"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(done_at)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            df = df.join(spark.read.schema(df.select(key).schema).json(done_at), key, "left_anti")
        results = answer(df).withColumn("batch", F.lit(number)).persist()
        results.write.mode("append").json(done_at)
        log_lines(results).write.mode("append").text(f"{out}/log")
        results.unpersist()

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
