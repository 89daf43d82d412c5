"""Progress lines: NDJSON in and out, batch and streaming."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbframe.operators import progress


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return progress.parse_lines(spark.read.text(path))


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    return progress.parse_lines(spark.readStream.text(folder))


def to_lines(events: DataFrame) -> DataFrame:
    """Each row as one JSON object; NULL fields are left out."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def write_lines(events: DataFrame, path: str) -> None:
    to_lines(events).write.text(path)
