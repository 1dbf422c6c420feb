"""Queries of the general problems: hierarchies, orphan references, snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import hierarchy as H
from codestrata.operators import references as R
from codestrata.operators import snapshots as S
from codestrata.session import Stage
from codestrata.sources.tables import Graph


def _graph_links(graph: Graph, stage: Stage) -> DataFrame:
    """Class and call links in one graph: a class_id is doubled, a func_id doubled plus one."""
    functions = stage.keep(graph.latest_functions().select("func_id", "project", "name", "qualified_name"))
    calls = R.call_links(graph.call_edges, functions).select(
        (F.col("callee") * 2 + 1).alias("child"), (F.col("caller") * 2 + 1).alias("parent")
    )
    classes = graph.latest_classes(extra=("base_classes",))
    bases = H.base_class_links(classes).select((F.col("child") * 2).alias("child"), (F.col("parent") * 2).alias("parent"))
    return stage.keep(calls.unionByName(bases))


def _kind(node) -> F.Column:
    return F.when(F.pmod(node, F.lit(2)) == 1, "call").otherwise("class")


def _id(node) -> F.Column:
    return F.shiftright(node, 1)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    stage = Stage(spark, "p2")
    rows, _ = H.ancestors(_graph_links(Graph(spark, folder), stage), stage=stage)
    return rows.select(
        _kind(F.col("node")).alias("rec_kind"), _id(F.col("node")).alias("node_id"),
        _id(F.col("ancestor")).alias("ancestor_id"), "distance",
    )


def p2_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Depth, roots, number of descendants and membership of a loop; a row for each root of every latest class and function."""
    stage, graph = Stage(spark, "p2"), Graph(spark, folder)
    links = _graph_links(graph, stage)
    rows, _ = H.ancestors(links, stage=stage)
    nodes = graph.latest_functions().select((F.col("func_id") * 2 + 1).alias("node")).union(graph.latest_classes().select(F.col("class_id") * 2))
    return H.hierarchy(stage.keep(rows), links, nodes).select(
        _kind(F.col("node")).alias("rec_kind"), _id(F.col("node")).alias("node_id"), "depth",
        _id(F.col("root")).alias("root_id"), "descendants", "is_cyclic",
    )


def p2_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """The links on loops, by strongly connected component."""
    stage = Stage(spark, "p2")
    _, loops = H.ancestors(_graph_links(Graph(spark, folder), stage), stage=stage)
    return H.cycles(loops, stage).select(
        _kind(F.col("child")).alias("rec_kind"), _id(F.col("cycle")).alias("cycle_id"), _id(F.col("child")).alias("node_id"), _id(F.col("parent")).alias("parent_id"))


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """For each node and ancestor the next node on a shortest path, which spells out every path."""
    stage = Stage(spark, "p2")
    links = _graph_links(Graph(spark, folder), stage)
    rows, _ = H.ancestors(links, stage=stage)
    return H.shortest_paths(stage.keep(rows), links).select(
        _kind(F.col("node")).alias("rec_kind"), _id(F.col("node")).alias("node_id"),
        _id(F.col("ancestor")).alias("ancestor_id"), "distance", _id(F.col("next")).alias("next_id"),
    )


def p2_root_paths(spark: SparkSession, folder: str) -> DataFrame:
    """For each node and each root (or closed cycle) above it one whole shortest path, node first and root last, as ids."""
    stage = Stage(spark, "p2")
    links = _graph_links(Graph(spark, folder), stage)
    rows, _ = H.ancestors(links, stage=stage)
    rows = stage.keep(rows)
    found = H.root_paths(H.shortest_paths(rows, links), H.path_ends(rows), stage)
    return found.select(
        _kind(F.col("node")).alias("rec_kind"), _id(F.col("node")).alias("node_id"), _id(F.col("root")).alias("root_id"), "distance",
        F.array_join(F.transform("path", lambda n: _id(n).cast("string")), ">").alias("path"),
    )


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    graph, stage = Graph(spark, folder), Stage(spark, "p5")
    latest = stage.keep(graph.latest())
    functions = _functions(graph, latest)
    classes = _classes(graph, latest)
    return R.orphan_references(graph.call_edges, functions, classes, graph.imports, stage)


def _functions(graph: Graph, latest: DataFrame) -> DataFrame:
    from codestrata.sources.tables import function_records

    return function_records(graph.functions, graph.files).join(latest, ["project", "snapshot_no"])


def _classes(graph: Graph, latest: DataFrame) -> DataFrame:
    from codestrata.sources.tables import class_records

    return class_records(graph.classes, graph.files).join(latest, ["project", "snapshot_no"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("edge_id", "ref_field").distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.orphan_report(_orphans(spark, folder), "call_edges")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    graph, stage = Graph(spark, folder), Stage(spark, "p7")
    delivered = stage.keep(graph.delivered().withColumnRenamed("project", "scope"))
    return S.graph_changes(graph.files, graph.functions, graph.classes, graph.file_hashes, delivered).select(
        F.col("kind").alias("rec_kind"), "path", F.col("name").alias("rec_name"), "snapshot_no", "change_kind"
    )


def queries() -> dict:
    own = (p2_found, p2_hierarchy, p2_cycles, p2_paths, p2_root_paths, p5_found, p5_report, p7_found)
    return {f.__name__: f for f in own}
