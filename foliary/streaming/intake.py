"""Intake as a stream: packages that arrive in a folder become job rows, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliary.operators import jobs

FILES = "path string, modificationTime timestamp, length long, content binary"


def uploads(spark: SparkSession, folder: str, at_a_time: int = 1000) -> DataFrame:
    """A stream of intake decisions for the files of ``folder``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", at_a_time).load(folder)
    return jobs.intake(files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("input_sha256")))


def record(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the decisions as Parquet until what is there has been taken in."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
