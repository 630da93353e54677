"""Incremental ingestion as a Structured Streaming job. An extension: the batch operators don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.chunking import paragraphs


def run_available(spark: SparkSession, folder: str, records: str, state: str) -> None:
    """Chunks the text files that are new since the last call and appends them to a record table."""

    def append(batch: DataFrame, number: int) -> None:
        chunks = paragraphs(batch, "name", "text")
        chunks.select(F.concat_ws("", "name", F.lit(":chunk"), F.col("chunk").cast("string")).alias("id"), F.col("name").alias("source"), "start_line", "end_line", "text").write.mode("append").parquet(records)

    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    texts = spark.readStream.format("text").option("wholetext", True).load(folder).select(stem.alias("name"), F.col("value").alias("text"))
    texts.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
