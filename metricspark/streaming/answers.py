"""Metrics of statements as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from metricspark.operators.metrics import metric_values
from metricspark.plans.definitions import DEFINITIONS, Definition


def answered(spark: SparkSession, folder: str, schema: str, definitions: tuple[Definition, ...] = DEFINITIONS) -> DataFrame:
    """The answers to all metrics of every statement that a folder of Parquet files gets.

    A metric reads one statement only, so the stream keeps no state and needs no watermark.
    """
    return metric_values(spark.readStream.schema(schema).parquet(folder), definitions)


def written(answers: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what there is to ``target`` and end; a next run goes on from the checkpoint."""
    return answers.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(target)
