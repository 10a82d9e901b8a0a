"""New files as a stream of element rows: an extension, the record format has no streaming of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import elements


def stream(spark: SparkSession, path: str, glob: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    found = reader.option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return elements(found.select(F.col("path").alias("instance_id"), "content"))
