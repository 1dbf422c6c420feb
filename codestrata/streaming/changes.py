"""Changed files as a stream: each micro-batch of hashes is merged into the table of what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import Stage
from codestrata.sources.tables import newest_rows, plain_path


def newest_hashes(hashes: DataFrame) -> DataFrame:
    """path, sha1 (lower case), snapshot_no and loaded_at: one row per path, of the greatest snapshot and then the latest."""
    rows = hashes.select(plain_path(F.col("path")).alias("path"), F.lower("sha1").alias("sha1"), "snapshot_no", "loaded_at").where("path is not null")
    order = F.struct("snapshot_no", "loaded_at")
    return newest_rows(rows.withColumn("order", order), ["path"], ["sha1", "snapshot_no", "loaded_at"], "order")


def stream_hashes(spark: SparkSession, path: str, schema) -> DataFrame:
    """``newest_hashes`` of all files below ``path``, merged batch by batch; ends with the data there is.

    A batch reads the table of the batch before it and writes its own, named by
    the batch's number: a batch that is repeated after a failure writes the
    same table again. Removed files never come by a stream; they need the
    comparison of whole snapshots (``sync_plan``).
    """
    stage = Stage(spark, "changes")
    fields = "path string, sha1 string, snapshot_no int, loaded_at timestamp_ntz"
    empty = spark.createDataFrame([], fields)
    last = {"number": None}

    def table(number: int) -> str:
        return f"{stage.root}/batch-{number}"

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        known = s.read.schema(fields).parquet(table(number - 1)) if number else s.createDataFrame([], fields)
        newest_hashes(known.unionByName(newest_hashes(batch).select(known.columns))).select(known.columns).write.mode("overwrite").parquet(table(number))
        last["number"] = number

    run = (
        spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{stage.root}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return empty if last["number"] is None else spark.read.schema(fields).parquet(table(last["number"]))
