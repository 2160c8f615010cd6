"""Search results that arrive as files: the filter of the batch operators on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spectrail import schemas
from spectrail.operators.summary import fdr_filter


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of search results, each read once as it comes."""
    return spark.readStream.schema(schemas.PSMS).parquet(folder)


def filter_arriving(spark: SparkSession, folder: str, target: str, checkpoint: str, fdr: float = 0.01, level: str = "peptide") -> StreamingQuery:
    """Appends what passes to ``target`` and ends when all files that are there are read."""
    rows = fdr_filter(arriving(spark, folder), fdr, level)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
