"""Frames as they arrive: late and repeated rows handled by a watermark, growth kept per position and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Result rows from files that appear in a folder; ``schema`` is the table's."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_deliveries(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each frame (pos, meta_t) once while its first delivery is within the watermark; rows later than that are dropped."""
    at = rows.withColumn("received_at", F.col("received_at").cast("timestamp"))
    return at.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["pos", "meta_t"])


def growth_per_window(rows: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per position and window of arrival: frames, least and greatest edge length; closed windows come out once."""
    at = rows.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", late)
    length = F.when(~F.isnan("graph_edge_length"), F.col("graph_edge_length"))
    g = at.groupBy(F.window("received_at", window), "pos").agg(F.count(F.lit(1)).alias("n_frames"), F.min(length).alias("least_length"), F.max(length).alias("greatest_length"))
    return g.select(F.col("window.start").alias("window_start"), "pos", "n_frames", "least_length", "greatest_length")
