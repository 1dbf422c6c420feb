"""Calls by name: which function a callee name refers to, and references to records that do not exist."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import Stage, python_rows
from codestrata.sources.tables import dotted

#: Bits and probes of the parent-key filter. 2**26 bits are 8 MB, which bounds what is broadcast
#: at once; more keys than fit (5.6 million) are split into shards, each with a filter of its own.
MAX_FILTER_BITS = 1 << 26
BITS_PER_KEY, FILTER_PROBES = 12, 5
RECEIVERS = ("self", "this")


def caller_class(qualified_name: Column) -> Column:
    """The part before the last ``.``; null for a plain function."""
    return F.when(F.contains(qualified_name, F.lit(".")), F.regexp_extract(qualified_name, r"^(.*)\.[^.]*$", 1))


def name_probes(callee: Column, owner: Column) -> Column:
    """The qualified names that ``callee`` would refer to, as an array.

    With ``::`` read as ``.``: for ``self.x`` and ``this.x`` only ``owner.x``;
    else the name itself and what follows each ``.``. Empty for a null callee
    and for ``self.x`` outside a class.
    """
    name = dotted(callee)
    own = F.regexp_extract(name, r"^(?:self|this)\.(.*)$", 1)
    parts = F.split(name, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    none = F.array().cast("array<string>")
    is_own = name.rlike(r"^(self|this)\.")
    return (
        F.when(name.isNull(), none)
        .when(is_own & owner.isNull(), none)
        .when(is_own, F.array(F.concat(owner, F.lit("."), own)))
        .otherwise(F.array_distinct(tails))
    )


def referable(functions: DataFrame) -> DataFrame:
    """Functions a call can refer to: all but those named main."""
    return functions.where("qualified_name is not null and coalesce(name, '') <> 'main'").where(
        ~F.col("qualified_name").rlike(r"(^|\.)main$")
    )


def call_links(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller, callee): func_ids of functions and of the functions their calls refer to, distinct.

    ``functions`` are those of the latest snapshots. Names are made distinct
    per caller before any name is expanded, so the hottest callee name costs
    one row per caller, and the join by (project, name) sees each spelling once
    per project. Null callers and callees and repeated edges give nothing.
    """
    callers = functions.select(
        F.col("func_id").alias("caller"), "project", caller_class(F.col("qualified_name")).alias("owner")
    )
    calls = (
        edges.where("caller_func_id is not null and callee_name is not null")
        .select(F.col("caller_func_id").alias("caller"), "callee_name")
        .distinct()
        .join(callers, "caller")
        .withColumn("owner", F.when(dotted(F.col("callee_name")).rlike(r"^(self|this)\."), F.col("owner")))
    )
    spellings = calls.select("project", "callee_name", "owner").distinct()
    targets = referable(functions).select("project", F.col("qualified_name").alias("probe"), F.col("func_id").alias("callee"))
    found = (
        spellings.withColumn("probe", F.explode(name_probes(F.col("callee_name"), F.col("owner"))))
        .join(targets, ["project", "probe"])
        .select("project", "callee_name", "owner", "callee")
        .distinct()
        .withColumnsRenamed({"project": "_p", "callee_name": "_n", "owner": "_o"})
    )
    same = (F.col("project") == F.col("_p")) & (F.col("callee_name") == F.col("_n")) & F.col("owner").eqNullSafe(F.col("_o"))
    return calls.join(found, same).select("caller", "callee").distinct()


def filter_size(keys: int) -> int:
    """Bits of the filter: BITS_PER_KEY a key, a power of two, at most MAX_FILTER_BITS."""
    bits = 1 << 13
    while bits < BITS_PER_KEY * keys and bits < MAX_FILTER_BITS:
        bits *= 2
    return bits


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """FILTER_PROBES bit positions of each 64-bit hash, by double hashing."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    k = np.arange(FILTER_PROBES, dtype=np.uint64)[:, None]
    return ((h[None, :] + k * step[None, :]) & np.uint64(bits - 1)).astype(np.int64)


def key_filter(keys: DataFrame, bits: int) -> bytes:
    """A Bloom filter of the LONG column ``key`` (a hash), built by Spark and returned as bytes.

    Each task ors its keys into words of 64 bits and emits the words it
    touched; ``bit_or`` merges them by word. The driver receives at most
    bits / 64 words, so its share is bounded by MAX_FILTER_BITS.
    """

    def words(batches):
        own = np.zeros(bits // 64, dtype=np.uint64)
        for pdf in batches:
            h = pdf["key"].to_numpy(dtype=np.int64)
            at = _positions(h, bits).ravel()
            np.bitwise_or.at(own, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        touched = np.nonzero(own)[0]
        yield pd.DataFrame({"word": touched.astype(np.int64), "value": own[touched].view(np.int64)})

    rows = (
        python_rows(keys.where("key is not null").select("key"), words, "word long, value long")
        .groupBy("word").agg(F.bit_or("value").alias("value"))
    )
    table = np.zeros(bits // 64, dtype=np.int64)
    got = rows.toPandas()
    table[got["word"].to_numpy()] = got["value"].to_numpy()
    return table.tobytes()


def passes_filter(spark, filter_bytes: bytes, bits: int):
    """A column function: whether a LONG hash may be among the filter's keys. Null hashes don't pass."""
    shared = spark.sparkContext.broadcast(filter_bytes)

    @F.pandas_udf("boolean")
    def may_contain(h: pd.Series) -> pd.Series:
        words = np.frombuffer(shared.value, dtype=np.uint64)
        known = h.notna()
        at = _positions(h.fillna(0).to_numpy(dtype=np.int64), bits)
        hit = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
        return pd.Series(hit & known.to_numpy(), index=h.index)

    return may_contain


def maybe_known(refs: DataFrame, column: str, keys: DataFrame, stage: Stage) -> DataFrame:
    """``refs`` with ``_maybe``: whether the hash in ``column`` (LONG, not null) may be one of ``keys`` (column ``key``).

    False is proof that it is not. Bits follow the keys: where they need more than
    MAX_FILTER_BITS, keys and references are split by hash, once, and each
    shard's references meet the filter of its own keys.
    """
    spark = refs.sparkSession
    count = keys.count()
    shards = max(1, -(-count * BITS_PER_KEY // MAX_FILTER_BITS))
    bits = filter_size(-(-count // shards))
    if shards == 1:
        return refs.withColumn("_maybe", passes_filter(spark, key_filter(keys, bits), bits)(F.col(column)))
    # the filters take their positions from the low and high bits, so the shard is drawn from a hash of its own
    shard = lambda c: F.pmod(F.hash(c), F.lit(shards)).alias("_shard")
    keys = stage.keep(keys.select("key", shard("key")), by="_shard")
    names = refs.columns
    refs = stage.keep(refs.select("*", shard(column)), by="_shard")
    out = None
    for i in range(shards):
        may = passes_filter(spark, key_filter(keys.where(F.col("_shard") == i), bits), bits)
        part = refs.where(F.col("_shard") == i).select(*names).withColumn("_maybe", may(F.col(column)))
        out = part if out is None else out.unionByName(part)
    return out


def orphan_keys(refs: DataFrame, parents: DataFrame, stage: Stage | None = None) -> DataFrame:
    """The rows of ``refs`` none of whose ``probes`` is a key of ``parents``.

    ``refs`` has the array column ``probes`` of LONG hashes and ``exact``, an
    array of the same length with the keys themselves (STRING); ``parents`` has
    ``key`` (hash) and ``exact``. References that fail the broadcast filter in
    every probe are orphans without any join; only those that pass are verified
    by an exact anti-join. Every row of ``refs`` must have a unique ``ref_id``.
    """
    stage = stage or Stage(refs.sparkSession, "orphans")
    probed = refs.select("ref_id", F.explode_outer(F.arrays_zip("probes", "exact")).alias("p"))
    asked = probed.where("p is not null").select("ref_id", "p.probes", "p.exact")
    suspects = maybe_known(asked, "probes", parents, stage).where("_maybe")
    real = suspects.join(parents.select("exact").distinct(), "exact", "left_semi").select("ref_id").distinct()
    return refs.join(real, "ref_id", "left_anti")


def orphan_references(edges: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame, stage) -> DataFrame:
    """(edge_id, ref_field, period) of call edges that refer to functions which do not exist.

    ``functions`` and ``classes`` are the records of the latest snapshots.
    caller_func_id: a caller, not null, that is no function. callee_name: the
    caller exists, the name refers to no function, is no class, and by its
    first segment belongs to the project. period is the week of loaded_at
    (null stays null). Edges delivered again count once, in the week of their
    first delivery. Edges with a null edge_id are left out.
    """
    rows = (
        edges.where("edge_id is not null")
        .groupBy("edge_id", "caller_func_id", "callee_name")
        .agg(F.min("loaded_at").alias("loaded_at"))
    )
    edge = stage.keep(rows)
    period = F.date_trunc("week", F.col("loaded_at").cast("timestamp_ntz")).cast("date").alias("period")

    # caller_func_id: the filter proves most orphans; the join settles the others and finds each caller's project.
    func = stage.keep(functions.select("func_id", "project", "file_id", "name", "qualified_name"))
    called = edge.where("caller_func_id is not null").withColumn("_hash", F.xxhash64("caller_func_id"))
    flagged = maybe_known(called, "_hash", func.select(F.xxhash64("func_id").alias("key")), stage)
    callers = func.select(
        F.col("func_id").alias("caller_func_id"), "project", "file_id",
        caller_class(F.col("qualified_name")).alias("owner"),
    )
    proven = flagged.where("not _maybe").select("edge_id", period, F.lit(None).cast("string").alias("callee_name"),
                                              F.lit(None).cast("string").alias("project"), F.lit(None).cast("long").alias("file_id"),
                                              F.lit(None).cast("string").alias("owner"), F.lit(False).alias("_exists"))
    checked = (
        flagged.where("_maybe").join(callers.withColumn("_exists", F.lit(True)), "caller_func_id", "left")
        .select("edge_id", period, "callee_name", "project", "file_id", "owner", F.coalesce("_exists", F.lit(False)).alias("_exists"))
    )
    known = stage.keep(proven.unionByName(checked))
    stage.drop(edge)
    dead_callers = known.where("not _exists").select("edge_id", F.lit("caller_func_id").alias("ref_field"), "period")

    # callee_name: one row per project, file, spelling and, for self/this, class.
    own = dotted(F.col("callee_name")).rlike(r"^(self|this)\.")
    live = known.where("_exists and callee_name is not null").withColumn("owner", F.when(own, F.col("owner")))
    spelling = ["project", "file_id", "callee_name", "owner"]
    refs = live.select(*spelling).distinct()
    first = F.element_at(F.split(dotted(F.col("callee_name")), r"\."), 1)
    package = F.translate(F.col("project"), "-", "_")
    class_names = classes.where("name is not null").select("project", F.col("name").alias("_class")).distinct()
    imported = (
        imports.where("file_id is not null and source is not null")
        .select("file_id", F.element_at(F.split("source", r"[./:]"), 1).alias("_root"), F.explode("names").alias("first"))
        .distinct()
    )
    refs = refs.withColumn("first", first)
    of_class = class_names.withColumnRenamed("_class", "first").withColumn("_by_class", F.lit(True))
    exact_class = class_names.withColumnRenamed("_class", "callee_name").withColumn("_is_class", F.lit(True))
    judged = (
        refs.join(of_class, ["project", "first"], "left")
        .join(exact_class, ["project", "callee_name"], "left")
        .join(imported.groupBy("file_id", "first").agg(F.collect_set("_root").alias("_roots")), ["file_id", "first"], "left")
    )
    local = (
        (F.col("first") == package)
        | F.col("_by_class").isNotNull()
        | F.coalesce(F.array_contains("_roots", package), F.lit(False))
        | dotted(F.col("callee_name")).rlike(r"^(self|this)\.[^.]+$")
    )
    candidates = stage.keep(
        judged.where(local & F.col("_is_class").isNull()).select(
            *spelling, F.concat_ws("\x00", "project", "file_id", "callee_name", F.coalesce("owner", F.lit(""))).alias("ref_id")
        )
    )
    key = F.concat_ws("\x00", F.col("project"), F.col("qualified_name"))
    parents = referable(func).select(key.alias("exact")).distinct().withColumn("key", F.xxhash64("exact"))
    exact = F.transform(name_probes(F.col("callee_name"), F.col("owner")), lambda q: F.concat_ws("\x00", F.col("project"), q))
    probes = candidates.withColumn("exact", exact).withColumn("probes", F.transform("exact", lambda x: F.xxhash64(x)))
    orphans = orphan_keys(probes, parents, stage).select(*[F.col(c).alias(f"_{c}") for c in spelling])
    match = (F.col("project") == F.col("_project")) & (F.col("file_id") == F.col("_file_id")) & (
        F.col("callee_name") == F.col("_callee_name")) & F.col("owner").eqNullSafe(F.col("_owner"))
    dead_callees = live.join(orphans, match, "left_semi").select("edge_id", F.lit("callee_name").alias("ref_field"), "period")
    return dead_callers.unionByName(dead_callees).distinct()


def orphan_report(orphans: DataFrame, table: str) -> DataFrame:
    """Orphans per table, field and week."""
    return (
        orphans.groupBy("ref_field", "period").agg(F.count(F.lit(1)).alias("orphans"))
        .select(F.lit(table).alias("table_name"), "ref_field", F.col("period").cast("string").alias("period"), "orphans")
    )
