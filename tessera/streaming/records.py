"""A1 as a stream: new generation files become feature records, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.text import handcrafted


def feature_stream(spark: SparkSession, path: str, schema: StructType, text: str = "output", source: str = "parquet") -> DataFrame:
    """A streaming frame of the files that appear in ``path``, with the text features of each row."""
    return handcrafted(spark.readStream.format(source).schema(schema).load(path), text)


def write_records(stream: DataFrame, out: str, checkpoint: str):
    """Starts a query that appends the records as Parquet and stops once the files there are used up."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
