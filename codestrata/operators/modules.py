"""Module dependencies, their ranking, layers and cycles; modules are those of one project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.names import module_name, texts_holding
from codestrata.session import Stage


def modules(files: DataFrame) -> DataFrame:
    """project, module and number of files."""
    named = files.withColumn("module", module_name(F.col("path"))).where("module is not null")
    return named.groupBy("project", "module").agg(F.count(F.lit(1)).alias("files"))


def dependencies(files: DataFrame, imports: DataFrame) -> DataFrame:
    """project, from_module, to_module and number of distinct (file, source) details.

    An import's source is a module if it equals its name, else by its first
    dotted segment, else the least module whose name contains it or is
    contained in it; names meet by runs of characters they share. Imports of
    the own module don't count.
    """
    named = files.withColumn("module", module_name(F.col("path"))).where("module is not null")
    names = named.select("project", "module").distinct()
    own = (
        imports.where("source is not null").select("file_id", "source").distinct()
        .join(named.select("file_id", "path", "project", "module"), "file_id")
    )
    spelled = own.select("project", "source").distinct()
    first = spelled.withColumn("module", F.element_at(F.split("source", r"\."), 1))
    plain = spelled.withColumn("module", F.col("source")).withColumn("tier", F.lit(1)).unionByName(first.withColumn("tier", F.lit(2)))
    plain = plain.join(names, ["project", "module"], "left_semi").groupBy("project", "source").agg(
        F.min_by("module", "tier").alias("to_module"))
    rest = spelled.join(plain, ["project", "source"], "left_anti")
    # an empty name stands in every other
    least = names.groupBy("project").agg(F.min("module").alias("module"))
    near = (
        texts_holding(rest, "source", names, "module", ("project",)).select("project", "source", "module")
        .unionByName(texts_holding(names, "module", rest, "source", ("project",)).select("project", "source", "module"))
        .unionByName(rest.join(least, "project").where("source = '' or module = ''").select("project", "source", "module"))
    )
    resolved = plain.unionByName(near.groupBy("project", "source").agg(F.min("module").alias("to_module")))
    return (
        own.join(resolved, ["project", "source"]).where("module <> to_module")
        .groupBy("project", F.col("module").alias("from_module"), "to_module")
        .agg(F.count_distinct("path", "source").alias("details"))
    )


def fan(deps: DataFrame) -> DataFrame:
    """project, module, fan_in, fan_out: distinct neighbours in either direction."""
    into = deps.groupBy("project", F.col("to_module").alias("module")).agg(F.count_distinct("from_module").alias("fan_in"))
    out = deps.groupBy("project", F.col("from_module").alias("module")).agg(F.count_distinct("to_module").alias("fan_out"))
    return into.join(out, ["project", "module"], "full").select(
        "project", "module", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out")
    )


def core_modules(ranked: DataFrame, n: int = 5) -> DataFrame:
    """The n modules of each project most depended on, ties by name."""
    at = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("fan_in"), "module"))
    return ranked.where("fan_in > 0").withColumn("rank", at).where(F.col("rank") <= n)


def layers(ranked: DataFrame) -> DataFrame:
    """layer: 0 for a fan-in of at least half the project's greatest, 1 with any link, else 2."""
    most = F.max("fan_in").over(Window.partitionBy("project"))
    layer = F.when((most > 0) & (F.col("fan_in") >= 0.5 * most), 0).when((F.col("fan_in") > 0) | (F.col("fan_out") > 0), 1).otherwise(2)
    return ranked.select("project", "module", layer.alias("layer"))


def orphans(all_modules: DataFrame, deps: DataFrame) -> DataFrame:
    """Modules without any dependency."""
    linked = deps.select("project", F.col("from_module").alias("module")).union(deps.select("project", "to_module")).distinct()
    return all_modules.select("project", "module").join(linked, ["project", "module"], "left_anti")


def module_files(files: DataFrame, imports: DataFrame) -> DataFrame:
    """project, module, files and distinct imports (file and source) of each module."""
    named = files.withColumn("module", module_name(F.col("path"))).where("module is not null").select("project", "module", "file_id")
    own = imports.where("source is not null").select("file_id", "source").distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("imports"))
    return named.join(own, "file_id", "left").groupBy("project", "module").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("imports"), F.lit(0)).alias("imports"))


def cycles(deps: DataFrame, stage: Stage) -> DataFrame:
    """project, cycle (``a->b->a``, least module first) and length of every elementary cycle, whatever its length.

    Only dependencies between modules of one ring can lie on a cycle, so paths
    grow along those alone, round by round, until none can be continued.
    """
    ring = rings(deps, stage).select("project", "module", "ring")
    ends = [ring.select("project", F.col("module").alias(end), "ring") for end in ("from_module", "to_module")]
    arcs = stage.keep(deps.select("project", "from_module", "to_module").distinct().join(ends[0], ["project", "from_module"])
                      .join(ends[1], ["project", "to_module", "ring"]).where("from_module <> to_module").select("project", "from_module", "to_module"))
    step = arcs.withColumnsRenamed({"from_module": "last", "to_module": "next"})
    paths = arcs.where("from_module < to_module").select(
        "project", F.array("from_module", "to_module").alias("path"), F.col("to_module").alias("last")
    )
    found = arcs.limit(0).select("project", F.lit("").alias("cycle"), F.lit(0).alias("length"))
    while paths.limit(1).count():
        onward = paths.join(step, ["project", "last"])
        closed = onward.where(F.col("next") == F.col("path")[0]).select(
            "project", F.array_join(F.concat("path", F.array("next")), "->").alias("cycle"), F.size("path").alias("length")
        )
        found = found.unionByName(closed)
        paths = stage.keep(onward.where((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next"))).select(
            "project", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("last")
        ))
    return found


def rings(deps: DataFrame, stage: Stage) -> DataFrame:
    """project, ring, module and modules: every module on a cycle of any length, by strongly connected component.

    A ring is named by its least module; modules is its size. Each round joins
    what is reached with itself, so the rounds follow the logarithm of the
    longest way, until nothing is new.
    """
    reach = stage.keep(deps.select("project", "from_module", "to_module").distinct())
    size, last = reach.count(), -1
    while size > last:
        onward = reach.select("project", "from_module", F.col("to_module").alias("mid")).join(
            reach.select("project", F.col("from_module").alias("mid"), "to_module"), ["project", "mid"])
        reach = stage.keep(reach.union(onward.select("project", "from_module", "to_module")).distinct())
        size, last = reach.count(), size
    back = reach.select("project", F.col("to_module").alias("from_module"), F.col("from_module").alias("to_module"))
    return (
        reach.join(back, ["project", "from_module", "to_module"]).groupBy("project", F.col("from_module").alias("module"))
        .agg(F.min("to_module").alias("ring"), F.count(F.lit(1)).alias("modules")).select("project", "ring", "module", "modules")
    )


def ring_stats(all_modules: DataFrame, found: DataFrame) -> DataFrame:
    """Per project: rings, modules on them and the size of the largest."""
    sums = found.groupBy("project").agg(F.count_distinct("ring").alias("rings"), F.count(F.lit(1)).alias("on_rings"), F.max("modules").alias("largest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return all_modules.select("project").distinct().join(sums, "project", "left").select("project", zero("rings"), zero("on_rings"), zero("largest"))


def module_stats(all_modules: DataFrame, deps: DataFrame, found_cycles: DataFrame) -> DataFrame:
    """Per project: modules, dependencies, modules with any, cycles and orphans."""
    total = all_modules.groupBy("project").agg(F.count(F.lit(1)).alias("total_modules"))
    linked = deps.select("project", F.col("from_module").alias("module")).union(deps.select("project", "to_module")).distinct()
    with_deps = linked.groupBy("project").agg(F.count(F.lit(1)).alias("modules_with_deps"))
    counts = deps.groupBy("project").agg(F.count(F.lit(1)).alias("total_dependencies"))
    loops = found_cycles.groupBy("project").agg(F.count(F.lit(1)).alias("circular_dep_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        total.join(counts, "project", "left").join(with_deps, "project", "left").join(loops, "project", "left")
        .select("project", "total_modules", zero("total_dependencies"), zero("modules_with_deps"), zero("circular_dep_count"),
                (F.col("total_modules") - F.coalesce("modules_with_deps", F.lit(0))).alias("orphan_count"))
    )
