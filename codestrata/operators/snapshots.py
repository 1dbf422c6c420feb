"""What changed between full snapshots of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.sources.tables import (
    CLASS_VALUES, FUNCTION_VALUES, class_records, dotted, first_segment, function_records, newest_rows, plain_path, project_files,
)

#: Up to so many (scope, snapshot) rows are broadcast, some 20 MB; more are joined.
MAX_BROADCAST_SNAPSHOTS = 200_000
#: A key starts a chunk if its hash is divisible by this, so a chunk has so many rows on average.
CHUNK_ROWS = 32
#: Rows of one snapshot that a sorted bucket aims at; a table has as many buckets as its size asks for.
ROWS_PER_BUCKET = 100_000


def snapshot_neighbours(delivered: DataFrame) -> DataFrame:
    """(scope, snapshot_no, previous_no, next_no) of each delivered snapshot."""
    order = Window.partitionBy("scope").orderBy("snapshot_no")
    return (
        delivered.select("scope", "snapshot_no").distinct()
        .withColumn("previous_no", F.lag("snapshot_no").over(order))
        .withColumn("next_no", F.lead("snapshot_no").over(order))
    )


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Content-defined chunks of each key-sorted snapshot, with a digest of each.

    ``rows`` has scope, kind, snapshot_no, unit, path, name (the key) and value.
    The caller has brought them together by unit, which no chunk crosses, and they are sorted there;
    nothing after that is shuffled again. A key whose hash is divisible by
    ``chunk_rows`` starts a chunk: where a chunk begins depends on its own
    content only, so an insertion changes the chunk it falls into and no other.
    A chunk's length is geometric with mean ``chunk_rows``.
    """
    key = F.xxhash64("path", "name")
    starts = F.when(F.pmod(key, F.lit(chunk_rows)) == 0, key)
    sorted_rows = Window.partitionBy("unit", "scope", "kind", "snapshot_no").orderBy("path", "name")
    ruled = rows.withColumn("start", starts).withColumn(
        "chunk", F.last("start", ignorenulls=True).over(sorted_rows.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        ruled.groupBy("unit", "scope", "kind", "snapshot_no", "chunk")
        .agg(F.sort_array(F.collect_set(F.struct("path", "name", "value"))).alias("members"))
        .withColumn("digest", F.struct(F.xxhash64("members").alias("a"), F.xxhash64(F.lit(1), "members").alias("b")))
    )


def snapshot_changes(rows: DataFrame, delivered: DataFrame, chunk_rows: int = CHUNK_ROWS, buckets: int | None = None) -> DataFrame:
    """(scope, kind, path, name, snapshot_no, change_kind) between consecutive delivered snapshots.

    ``rows`` has scope, kind, snapshot_no, path, name and the compared content
    as a STRING ``value``; a null value differs from any other, and several
    rows of one key are one record with all their values. ``delivered`` has
    (scope, snapshot_no) of every snapshot that was delivered, even an empty
    one. ``unit``, if rows have it, is what they are partitioned by already (rows
    of equal path must have one); else paths are spread over ``buckets`` by hash. Chunks whose
    digest occurs in both snapshots of a pair are discarded; only the rows of
    the others are joined. The first snapshot of a scope has nothing to be
    compared with and gives no rows.
    """
    if "unit" not in rows.columns:
        if buckets is None:
            buckets = max(1, -(-rows.count() // ROWS_PER_BUCKET))
        rows = rows.withColumn("unit", F.xxhash64("scope", "kind", F.pmod(F.xxhash64("path"), F.lit(buckets)))).repartition("unit")
    near = snapshot_neighbours(delivered)
    if near.count() <= MAX_BROADCAST_SNAPSHOTS:
        near = F.broadcast(near)
    # A chunk takes part in up to two pairs: as newer side of its own number, as older side of the next.
    as_newer = F.when(F.col("previous_no").isNotNull(), F.struct(F.col("snapshot_no").alias("pair"), F.lit(1).alias("side")))
    as_older = F.when(F.col("next_no").isNotNull(), F.struct(F.col("next_no").alias("pair"), F.lit(2).alias("side")))
    sided = (
        chunks(rows, chunk_rows).join(near, ["scope", "snapshot_no"])
        .withColumn("take", F.explode(F.array_compact(F.array(as_newer, as_older))))
        .select("unit", "scope", "kind", "digest", "members", "take.pair", "take.side")
    )
    same = Window.partitionBy("unit", "scope", "kind", "pair", "digest")
    unmatched = sided.withColumn("sides", F.bit_or("side").over(same)).where("sides <> 3")
    left = unmatched.select("unit", "scope", "kind", "pair", "side", F.explode("members").alias("m")).select(
        "unit", "scope", "kind", "pair", "side", "m.path", "m.name", F.struct("m.value").alias("value")
    )
    values = lambda side: F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("value"))))
    met = left.groupBy("unit", "scope", "kind", "pair", "path", "name").agg(
        F.bit_or("side").alias("sides"), values(1).alias("new_values"), values(2).alias("old_values")
    )
    kind = (
        F.when(F.col("sides") == 1, "added").when(F.col("sides") == 2, "removed")
        .when(F.col("new_values") != F.col("old_values"), "changed")
    )
    return met.select(
        "scope", "kind", "path", "name", F.col("pair").alias("snapshot_no"), kind.alias("change_kind")
    ).where("change_kind is not null")


def _file_rows(hashes: DataFrame) -> DataFrame:
    paths = hashes.withColumn("path", plain_path(F.col("path"))).where("path is not null and snapshot_no is not null")
    return newest_rows(paths.withColumn("value", F.lower("sha1")), ["snapshot_no", "path"], ["value"]).select(
        first_segment(F.col("path")).alias("scope"), F.lit("file").alias("kind"), "snapshot_no", "path", F.lit("").alias("name"), "value"
    )


def _ranged_rows(records: DataFrame, kind: str) -> DataFrame:
    lines = F.concat_ws("-", F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.coalesce(F.col("end_line").cast("string"), F.lit("?")))
    return records.where("qualified_name is not null and path is not null and snapshot_no is not null").select(
        F.col("project").alias("scope"), F.lit(kind).alias("kind"), "snapshot_no", "file_id", "path", F.col("qualified_name").alias("name"), lines.alias("value"))


def graph_changes(files: DataFrame, functions: DataFrame, classes: DataFrame, hashes: DataFrame, delivered: DataFrame) -> DataFrame:
    """``snapshot_changes`` of files, functions and classes, by the rules of :func:`graph_records`.

    The records of a file are kept together by its id, as the join with files
    has them, so they are shuffled once to settle repeated deliveries and once more
    to sort them.
    """
    out = snapshot_changes(_file_rows(hashes), delivered, buckets=max(1, -(-hashes.count() // ROWS_PER_BUCKET)))
    for records, key, values, kind in ((functions, "func_id", FUNCTION_VALUES, "function"), (classes, "class_id", CLASS_VALUES, "class")):
        newest = newest_rows(records.where(F.col(key).isNotNull()), ["snapshot_no", key], values)
        owned = newest.repartition("file_id").join(project_files(files), "file_id").withColumn("qualified_name", dotted(F.col("qualified_name")))
        out = out.unionByName(snapshot_changes(_ranged_rows(owned, kind).withColumnRenamed("file_id", "unit"), delivered))
    return out


def ranged_records(records: DataFrame, kind: str) -> DataFrame:
    """The rows of ``graph_records`` from functions or classes."""
    return _ranged_rows(records, kind).groupBy("scope", "kind", "snapshot_no", "path", "name").agg(
        F.array_join(F.array_sort(F.collect_set("value")), ",").alias("value"))


def graph_records(files: DataFrame, functions: DataFrame, classes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files, functions and classes of every snapshot as rows for :func:`snapshot_changes`.

    Within a snapshot the row with the greatest loaded_at counts, per path for
    file_hashes and per id for the others; a name that several ids share keeps
    all their line ranges in its value. The letter case of a hash, a leading
    ``./`` and ``\\`` in a path are no difference. Null paths and names give nothing.
    """
    return _file_rows(hashes).unionByName(ranged_records(function_records(functions, files), "function")).unionByName(
        ranged_records(class_records(classes, files), "class")
    )
