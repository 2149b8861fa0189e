"""Scoring an unbounded table with a fitted pipeline. Stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablewright.plans.supervised import score


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.parquet", like: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is that of ``like`` or of the folder."""
    schema = spark.read.parquet(like or folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def score_stream(
    model: PipelineModel, rows: DataFrame, output: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append scored rows to ``output`` as Parquet; restarts go on from ``checkpoint``."""
    writer = (
        score(model, rows)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(output)
