"""Work on files as they come: each page once, however often it is delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_stream(spark: SparkSession, folder: str, schema: str = "md5 string, page_no int, text string, ts timestamp", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_per_page(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first delivery of every (md5, page_no); later ones within the delay are dropped, and state beyond it is forgotten."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["md5", "page_no"])


def clean_pages(stream: DataFrame) -> DataFrame:
    from foliospark.functions.repetition import postprocess

    return once_per_page(stream).withColumn("text", postprocess(F.col("text")))


def keep_writing(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Appends to a Parquet table; with availableNow=True it ends when all files are done."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()
