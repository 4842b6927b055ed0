"""Structured Streaming variants: bucket counts, deduplication, and live query matches.

They share expressions with the batch operators; watermarks bound the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.functions.text import text_hash
from tesserae.plans.boolean import matching


def read(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def bucket_counts(stream: DataFrame, date: str = "created_at", group: str = "platform", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(bucket, group, n) per tumbling window; rows later than ``late`` are left out."""
    cells = stream.withWatermark(date, late).groupBy(F.window(date, width).alias("w"), group).agg(F.count("*").alias("n"))
    return cells.select(F.col("w.start").alias("bucket"), group, "n")


def sessions(stream: DataFrame, date: str = "created_at", by: str = "author_handle", gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    cells = stream.withWatermark(date, late).groupBy(F.session_window(date, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return cells.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, date: str = "created_at", late: str = "2 days", near: bool = False) -> DataFrame:
    """Rows whose id, or whose normalised text, has not come within the watermark."""
    marked = stream.withWatermark(date, late)
    if not near:
        return marked.dropDuplicatesWithinWatermark(["post_id"])
    keyed = marked.withColumn("_hash", F.coalesce(text_hash(F.col("text")), F.concat(F.lit("id:"), "post_id")))
    return keyed.dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def live_matches(stream: DataFrame, query: str) -> DataFrame:
    return matching(stream, query)


def run_once(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take in all that has come and stop; a second call goes on from the checkpoint."""
    out = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    out.format("parquet").option("path", path).start().awaitTermination()
