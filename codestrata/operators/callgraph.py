"""The drawn call graph: nodes by degree, links between them, one node's neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.names import base_name, simple_name

NODE_LIMIT, LONGEST_CALLEE = 200, 60


def degrees(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """func_id, qualified_name, path, calls and called_by of every function.

    called_by counts the edges whose callee ends (in any letter case) with the
    function's name. Callees are counted per spelling first and meet the names
    by the suffixes of their last word, so no pair is compared.
    """
    own = edges.select("edge_id", "caller_func_id", "callee_name").distinct()
    calls = own.where("caller_func_id is not null").groupBy(F.col("caller_func_id").alias("func_id")).agg(F.count(F.lit(1)).alias("calls"))
    spelled = own.where("callee_name is not null").groupBy(F.lower("callee_name").alias("callee")).agg(F.count(F.lit(1)).alias("n"))
    word = F.regexp_extract("callee", r"(\w+)$", 1)
    ends = spelled.withColumn("word", word).where("word <> ''").withColumn(
        "key", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr(F.col("word"), i)))
    )
    called = ends.groupBy("key").agg(F.sum("n").alias("called_by"))
    named = functions.where("qualified_name is not null and qualified_name <> ''").withColumn("key", F.lower("name"))
    return named.join(calls, "func_id", "left").join(called, "key", "left").select(
        "func_id", "qualified_name", "path", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("called_by", F.lit(0)).alias("called_by")
    )


def nodes(ranked: DataFrame, limit: int = NODE_LIMIT) -> DataFrame:
    """The ``limit`` nodes of greatest degree: node_id, qualified_name, file, calls, called_by.

    A node's id is its qualified name; of namesakes the first by degree keeps
    it and the others add ``@file``, one node per file name.
    """
    degree = F.desc(F.col("calls") + F.col("called_by"))
    at = F.row_number().over(Window.partitionBy("qualified_name").orderBy(degree, "func_id"))
    file = base_name(F.col("path"))
    named = ranked.withColumn("node_id", F.when(at == 1, F.col("qualified_name")).otherwise(F.concat_ws("@", "qualified_name", file)))
    once = F.row_number().over(Window.partitionBy("node_id").orderBy(degree, "func_id"))
    return (
        named.withColumn("once", once).where("once = 1").orderBy(degree, "func_id").limit(limit)
        .select("node_id", "qualified_name", file.alias("file"), "calls", "called_by")
    )


def search_nodes(shown: DataFrame, word: str) -> DataFrame:
    """rank and node_id of the nodes whose id contains ``word`` in any letter case, the greatest degree first, ties by id."""
    hit = shown.where(F.contains(F.lower("node_id"), F.lit(word.lower())))
    at = F.row_number().over(Window.orderBy(F.desc(F.col("calls") + F.col("called_by")), "node_id"))
    return hit.select(at.alias("rank"), "node_id")


def links(sites: DataFrame, shown: DataFrame) -> DataFrame:
    """(source, target), distinct, between the nodes of ``shown``.

    A call goes to the nodes whose qualified name equals the callee or ends
    with ``.callee``, and for a plain callee to its namesakes; if there is
    none, to the nodes that share the callee's last segment.
    """
    short = sites.where(F.length("callee_name") < LONGEST_CALLEE).select("caller", "callee_name", base_name(F.col("file")).alias("file")).distinct()
    by_name = shown.select(F.col("node_id").alias("source"))
    plain = short.join(by_name, short.caller == by_name.source)
    at_file = short.join(by_name, short.caller == by_name.source, "left_anti").join(by_name, F.concat_ws("@", "caller", "file") == F.col("source"))
    calls = plain.unionByName(at_file).select("source", "callee_name").distinct()
    parts = F.split("qualified_name", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    target = shown.select(F.col("node_id").alias("target"), "qualified_name")
    exact = target.select("target", F.explode(tails).alias("callee_name"))
    met = calls.join(exact, "callee_name")
    missed = calls.join(met.select("callee_name").distinct(), "callee_name", "left_anti")
    fallback = missed.withColumn("word", F.element_at(F.split("callee_name", r"\."), -1)).join(
        target.withColumn("word", simple_name(F.col("qualified_name"))), "word"
    )
    return met.select("source", "target").unionByName(fallback.select("source", "target")).where("source <> target").distinct()


def ego_network(all_links: DataFrame, centre: DataFrame) -> DataFrame:
    """Links that begin or end at the one node of ``centre`` (node_id)."""
    one = centre.select("node_id").limit(1)
    out = all_links.join(one.withColumnRenamed("node_id", "source"), "source", "left_semi")
    into = all_links.join(one.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return out.unionByName(into).distinct()


def adjacency(all_links: DataFrame) -> DataFrame:
    """node_id with its callers and callees, each sorted and joined by commas; the links are those of at most ``NODE_LIMIT`` nodes."""
    def side(node: str, other: str, name: str) -> DataFrame:
        named = F.concat_ws(",", F.array_sort(F.collect_set(other))).alias(name)
        return all_links.groupBy(F.col(node).alias("node_id")).agg(named)

    both = side("target", "source", "callers").join(side("source", "target", "callees"), "node_id", "full")
    return both.select("node_id", F.coalesce("callers", F.lit("")).alias("callers"), F.coalesce("callees", F.lit("")).alias("callees"))
