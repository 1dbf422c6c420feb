"""The code-graph tables: reading, delivered snapshots, one row per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a graph folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dotted(name: Column) -> Column:
    """A qualified name with ``.`` for ``::``."""
    return F.replace(name, F.lit("::"), F.lit("."))


def plain_path(path: Column) -> Column:
    """A path as in files: ``/`` for ``\\`` and no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def first_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/", 2), 1)


def newest_rows(df: DataFrame, keys: list[str], values: list[str], order: str = "loaded_at") -> DataFrame:
    """One row per key: the one with the greatest ``order`` value.

    A null order value loses against any other; rows that tie are settled by
    the greatest values, so the result does not depend on the input's order.
    The aggregate is partial before the shuffle, so a key repeated by a third
    of all rows still sends one row per map task.
    """
    best = F.max(F.struct(F.col(order), *[F.col(v) for v in values])).alias("_best")
    picked = df.select(*keys, order, *values).groupBy(*keys).agg(best)
    return picked.select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def project_files(files: DataFrame) -> DataFrame:
    """file_id, path and project; a file whose project is null takes the path's first segment."""
    return files.where(F.col("file_id").isNotNull()).select(
        "file_id", "path", F.coalesce("project", first_segment(F.col("path"))).alias("project")
    )


def delivered_snapshots(files: DataFrame, functions: DataFrame, classes: DataFrame, hashes: DataFrame) -> DataFrame:
    """(project, snapshot_no), distinct, of every snapshot any of the three snapshot tables has rows of."""
    owner = project_files(files).select("file_id", "project")
    by_file = functions.select("file_id", "snapshot_no").unionByName(classes.select("file_id", "snapshot_no")).distinct()
    by_path = hashes.select(first_segment(plain_path(F.col("path"))).alias("project"), "snapshot_no")
    return (
        by_file.join(owner, "file_id")
        .select("project", "snapshot_no")
        .unionByName(by_path)
        .where("project is not null and snapshot_no is not null")
        .distinct()
    )


def latest_snapshots(delivered: DataFrame) -> DataFrame:
    """(project, snapshot_no) of the greatest delivered number of each project."""
    return delivered.groupBy("project").agg(F.max("snapshot_no").alias("snapshot_no"))


FUNCTION_VALUES = ["file_id", "name", "qualified_name", "start_line", "end_line"]
CLASS_VALUES = ["file_id", "name", "qualified_name", "start_line", "end_line"]


def function_records(functions: DataFrame, files: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per snapshot_no and func_id with its project and path; names with ``.``."""
    rows = newest_rows(functions.where("func_id is not null"), ["snapshot_no", "func_id"], [*FUNCTION_VALUES, *extra])
    return rows.withColumn("qualified_name", dotted(F.col("qualified_name"))).join(project_files(files), "file_id")


def class_records(classes: DataFrame, files: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per snapshot_no and class_id with its project and path; names with ``.``."""
    rows = newest_rows(classes.where("class_id is not null"), ["snapshot_no", "class_id"], [*CLASS_VALUES, *extra])
    return rows.withColumn("qualified_name", dotted(F.col("qualified_name"))).join(project_files(files), "file_id")


class Graph:
    """The tables of one folder and the views the operators share."""

    def __init__(self, spark: SparkSession, folder: str):
        ship(spark)
        self.spark = spark
        names = ("files", "functions", "classes", "call_edges", "imports", "file_hashes", "file_contents")
        for name in names:
            setattr(self, name, table(spark, folder, name))

    def delivered(self) -> DataFrame:
        return delivered_snapshots(self.files, self.functions, self.classes, self.file_hashes)

    def latest(self) -> DataFrame:
        return latest_snapshots(self.delivered())

    def latest_functions(self, extra: tuple[str, ...] = ()) -> DataFrame:
        return function_records(self.functions, self.files, extra).join(self.latest(), ["project", "snapshot_no"])

    def latest_classes(self, extra: tuple[str, ...] = ()) -> DataFrame:
        return class_records(self.classes, self.files, extra).join(self.latest(), ["project", "snapshot_no"])
