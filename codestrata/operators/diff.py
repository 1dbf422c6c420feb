"""Differences between two versions of keyed records, incremental sync, and review findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(base: DataFrame, head: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and status: added, removed, modified or same. A null value equals a null value only."""
    b = base.select(*keys, F.col(value).alias("_base"), F.lit(True).alias("_in_base"))
    h = head.select(*keys, F.col(value).alias("_head"), F.lit(True).alias("_in_head"))
    status = (
        F.when(F.col("_in_base").isNull(), "added").when(F.col("_in_head").isNull(), "removed")
        .when(~F.col("_base").eqNullSafe(F.col("_head")), "modified").otherwise("same")
    )
    return b.join(h, keys, "full").select(*keys, status.alias("status"))


def latest_pairs(delivered: DataFrame) -> DataFrame:
    """project, head_no and base_no of each project's latest snapshot and the one before; base_no null for the first."""
    order = Window.partitionBy("project").orderBy(F.desc("snapshot_no"))
    return (
        delivered.withColumn("at", F.row_number().over(order)).withColumn("base_no", F.lead("snapshot_no").over(order))
        .where("at = 1").select("project", F.col("snapshot_no").alias("head_no"), "base_no")
    )


def versions(records: DataFrame, pairs: DataFrame, column: str = "snapshot_no") -> tuple[DataFrame, DataFrame]:
    """The records of the base and of the head version of every project that has both."""
    both = pairs.where("base_no is not null")
    met = records.join(both, "project")
    return met.where(F.col(column) == F.col("base_no")), met.where(F.col(column) == F.col("head_no"))


def record_changes(records: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status (added, removed, modified, same) of the records of the last two versions of every project.

    One grouping over both versions in place of a join: records with equal keys
    within a version must be one row. A null value equals a null value only.
    """
    met = records.join(pairs.where("base_no is not null"), "project").where("snapshot_no in (base_no, head_no)")
    new = F.col("snapshot_no") == F.col("head_no")
    sides = met.groupBy(*keys).agg(
        F.bool_or(new).alias("_new"), F.bool_or(~new).alias("_old"),
        F.max(F.when(new, F.col("value"))).alias("_head"), F.max(F.when(~new, F.col("value"))).alias("_base"))
    status = F.when(~F.col("_old"), "added").when(~F.col("_new"), "removed").when(~F.col("_head").eqNullSafe(F.col("_base")), "modified").otherwise("same")
    return sides.select(*keys, status.alias("status"))


def status_counts(compared: DataFrame, kind: str) -> DataFrame:
    """kind, project, status and number."""
    return compared.groupBy("project", "status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "project", "status", "n")


def callee_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """caller, callee and change (gained, lost) between two sets of call sites."""
    b = base.select("caller", F.col("callee_name").alias("callee")).distinct().withColumn("_in_base", F.lit(True))
    h = head.select("caller", F.col("callee_name").alias("callee")).distinct().withColumn("_in_head", F.lit(True))
    return b.join(h, ["caller", "callee"], "full").where("_in_base is null or _in_head is null").select(
        "caller", "callee", F.when(F.col("_in_base").isNull(), "gained").otherwise("lost").alias("change")
    )


def sync_plan(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """path, project and action (parse, update, remove, keep) that bring an indexed version to the current one."""
    actions = {"added": "parse", "removed": "remove", "modified": "update", "same": "keep"}
    names = F.create_map(*[F.lit(x) for pair in actions.items() for x in pair])
    return compare(indexed, current, ["project", "path"], "sha1").select("project", "path", names[F.col("status")].alias("action"))


def sync_apply(indexed: DataFrame, parsed: DataFrame, plan: DataFrame) -> DataFrame:
    """The indexed records of kept files and the parsed records of new and updated ones; both have project, path and the same columns."""
    stale = plan.where("action in ('update', 'remove')").select("project", "path")
    fresh = plan.where("action in ('parse', 'update')").select("project", "path")
    return indexed.join(stale, ["project", "path"], "left_anti").unionByName(parsed.join(fresh, ["project", "path"], "left_semi"))


def sync_counts(plan: DataFrame) -> DataFrame:
    """Per project: files parsed, updated, removed and unchanged, and those there are now."""
    count = lambda action: F.count_if(F.col("action") == action)
    return plan.groupBy("project").agg(
        count("parse").alias("parsed"), count("update").alias("updated"), count("remove").alias("removed"), count("keep").alias("unchanged"),
        F.count_if(F.col("action") != "remove").alias("total_files"))


def recorded_hashes(current: DataFrame, parsed: DataFrame) -> DataFrame:
    """path and sha1 of the current files that were parsed (``path``); others are tried again by the next sync."""
    return current.join(parsed.select("path").distinct(), "path", "left_semi").select("path", "sha1")


def review_lists(changed: DataFrame, reached: DataFrame) -> DataFrame:
    """source, status, item_kind (direct_caller, affected_file) and item: the lists of each finding, one row an item.

    Rows in place of arrays, so a function that half of all code calls is no
    larger a group than any other. Functions that nothing calls give no row.
    """
    return listed_items(changed, reached.where("depth = 1").select("source", "caller").distinct(), reached.where("file is not null").select("source", "file").distinct())


def listed_items(changed: DataFrame, direct: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of ``review_lists`` from distinct (source, caller) and (source, file); the changed names are handed to the tasks, so no item is moved."""
    items = direct.select("source", F.lit("direct_caller").alias("item_kind"), F.col("caller").alias("item")).unionByName(
        files.select("source", F.lit("affected_file").alias("item_kind"), F.col("file").alias("item")))
    return items.join(F.broadcast(changed.select(F.col("name").alias("source"), "status").distinct()), "source").select("source", "status", "item_kind", "item")


def review_recall(expected: DataFrame, changed: DataFrame) -> DataFrame:
    """Per suite: expected functions, how many of them are among the changed ones, how many are spoken of, and both shares.

    ``expected`` has suite, target, summary and hints (array): a function is
    spoken of if any hint stands in the summary.
    """
    known = changed.select(F.col("name").alias("target")).distinct().withColumn("found", F.lit(1))
    spoken = F.coalesce(F.exists("hints", lambda h: F.contains(F.col("summary"), h)), F.lit(False))
    sums = expected.where("target is not null").withColumn("spoken", spoken.cast("int")).join(known, "target", "left").groupBy("suite").agg(
        F.count(F.lit(1)).alias("expected"), F.count("found").alias("found"), F.sum("spoken").alias("spoken"))
    return sums.select("suite", "expected", "found", "spoken", F.round(F.col("found") / F.col("expected"), 6).alias("structural_recall"),
                       F.round(F.col("spoken") / F.col("expected"), 6).alias("semantic_recall"))


def review_findings(changed: DataFrame, reached: DataFrame) -> DataFrame:
    """Per changed function: direct callers, all callers reached and affected files, 0 where nothing is reached."""
    sums = reached.groupBy("source").agg(
        F.count_if(F.col("depth") == 1).alias("direct_callers"), F.count(F.lit(1)).alias("all_affected"),
        F.count_distinct("file").alias("affected_files"),
    )
    return counted(changed, sums)


def counted(changed: DataFrame, sums: DataFrame) -> DataFrame:
    """The rows of ``review_findings`` from the counts of each source that reaches anything."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return changed.select(F.col("name").alias("source"), "status").distinct().join(sums, "source", "left").select(
        "source", "status", zero("direct_callers"), zero("all_affected"), zero("affected_files")
    )
