"""Loading parse results: file ids, binding of callers, rows per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_ids(known: DataFrame, paths: DataFrame) -> DataFrame:
    """path and file_id: the id of each known path (``known``: path, file_id), and a new one for every other path.

    Paths are made plain (``/``) and distinct. New ids follow the greatest
    known one in the order of the paths: they are sorted in ranges, counted per
    range, and numbered within it, so no task sees them all.
    """
    plain = paths.select(F.translate("path", "\\", "/").alias("path")).where("path is not null and path <> ''").distinct()
    old = known.where("path is not null and file_id is not null").groupBy("path").agg(F.min("file_id").alias("file_id"))
    fresh = plain.join(old, "path", "left_anti").repartitionByRange("path").withColumn("_range", F.spark_partition_id())
    before = fresh.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = old.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("path"))
    numbered = fresh.withColumn("at", within).join(before.select("_range", "before"), "_range").join(F.broadcast(top))
    return old.join(plain, "path", "left_semi").select("path", "file_id").unionByName(
        numbered.select("path", (F.col("top") + F.col("before") + F.col("at")).alias("file_id")))


def bind_callers(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """The rows of ``calls`` (path, caller_name) with the caller_func_id of the function of that file they name.

    ``functions`` has path, qualified_name, func_id and at, the order of
    loading. A name binds to the function of exactly that qualified name (the
    last loaded of namesakes), else to the first loaded whose qualified name
    ends with ``.`` and the name; a call that binds to nothing is dropped.
    """
    named = functions.where("path is not null and qualified_name is not null").groupBy("path", "qualified_name").agg(
        F.max_by("func_id", F.struct("at", "func_id")).alias("func_id"), F.min("at").alias("at"))
    parts = F.split("qualified_name", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    order = F.struct((F.col("tail") != F.col("qualified_name")).alias("inexact"), "at", "qualified_name")
    best = named.withColumn("tail", F.explode(F.array_distinct(tails))).groupBy("path", F.col("tail").alias("caller_name")).agg(
        F.min_by("func_id", order).alias("caller_func_id"))
    return calls.join(best, ["path", "caller_name"])


def load_order(functions: DataFrame) -> DataFrame:
    """``functions`` with ``at``: methods, class by class, come before plain functions of a file, each by line."""
    return functions.withColumn("at", F.struct(F.col("class_name").isNull().alias("plain"), F.coalesce("start_line", F.lit(0)).alias("line"), "func_id"))
