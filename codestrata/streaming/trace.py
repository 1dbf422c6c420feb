"""The event trace as a stream: append, and counts per type, over a file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import Stage


def summary(events: DataFrame) -> DataFrame:
    """event_type, events and users of a batch of events."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))


def stream_summary(spark: SparkSession, path: str, schema) -> DataFrame:
    """Counts per event_type of all files below ``path``, by an incremental run that ends with the data there is.

    The stream appends to a table in the shared folder with its checkpoint
    beside it, so a restarted run neither loses nor repeats events.
    """
    root = Stage(spark, "trace").root
    stream = spark.readStream.schema(schema).parquet(path).select("event_id", "event_type", "user_id")
    run = (
        stream.writeStream.format("parquet").option("path", f"{root}/table").option("checkpointLocation", f"{root}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return summary(spark.read.schema("event_id long, event_type string, user_id long").parquet(f"{root}/table"))
