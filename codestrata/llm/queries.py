"""Registered queries of the llm operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import docs, leakage, natural, origin, packing, quality, syntax
from codestrata.llm.files import spread
from codestrata.session import Stage
from codestrata.sources.tables import Graph, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    graph = Graph(spark, folder)
    return origin.machine_made(graph.files, graph.file_contents, Stage(spark, "p1")).select("file_id")


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Machine-made files with the kind of evidence."""
    graph = Graph(spark, folder)
    return origin.machine_made(graph.files, graph.file_contents, Stage(spark, "p1"))


def _documented(spark: SparkSession, folder: str) -> DataFrame:
    graph = Graph(spark, folder)
    return docs.documented_functions(graph.latest_functions(), graph.files, graph.file_contents)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _documented(spark, folder).select("func_id").distinct()


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Code and documentation of every documented function."""
    return _documented(spark, folder)


def _natural(spark: SparkSession, folder: str, docstrings: bool = False) -> DataFrame:
    graph = Graph(spark, folder)
    own = graph.functions.select("file_id", "docstring").union(graph.classes.select("file_id", "docstring")) if docstrings else None
    return natural.natural_language(graph.files, graph.file_contents, table(spark, folder, "documents"), own)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _natural(spark, folder).select("file_id", "nl_lang")


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each file's bytes that is running text of each language; null for files known by their docstrings alone."""
    return _natural(spark, folder, docstrings=True).withColumn("share", F.round(F.col("nl_bytes") / F.col("file_bytes"), 6))


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    graph = Graph(spark, folder)
    return syntax.syntax_verdicts(graph.files, graph.file_contents)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).where("failure is not null").select("file_id")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of invalid files per project and language."""
    return syntax.syntax_rates(_verdicts(spark, folder))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    stage = Stage(spark, "p8")
    items = stage.keep(packing.pieces(table(spark, folder, "documents")))
    return packing.pack_documents(items)


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Container of every piece of every document."""
    return _packed(spark, folder)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, segments and unused room of every container."""
    return packing.container_fill(_packed(spark, folder))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked items with the number of documents that hold a piece of them."""
    return leakage.leak_report(_leaks(spark, folder), table(spark, folder, "eval_items"))


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every document's text."""
    return quality.text_statistics(table(spark, folder, "documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rules are learned from the labelled documents; the others' statistics are computed as far as the rules ask for them."""
    documents, labels = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id"), table(spark, folder, "doc_labels")
    labelled = documents.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    case = quality.fit_text_kinds(quality.text_statistics(labelled), labels)
    # kept, as a filter on the kind would be pushed into the statistics and compute them once for each rule
    statistics = Stage(spark, "p10").keep(quality.text_statistics(documents).select("doc_id", *quality.used_statistics(case)))
    return quality.text_kinds(statistics, case).where("text_kind <> 'prose'").select("doc_id", "text_kind")


_RUNS = """
runs AS (
  SELECT id, n, list_aggregate(list_slice(u, i, i + n - 1), 'string_agg', ' ') AS run
  FROM (SELECT id, n, u, unnest(generate_series(1, len(u) - n + 1)) AS i FROM units WHERE len(u) >= n)
)
"""
_UNITS = """
SELECT {id} AS id, 15 AS n, regexp_extract_all(lower({text}), '[a-z0-9]+') AS u FROM {table} WHERE {text} IS NOT NULL
UNION ALL
SELECT {id}, 30, regexp_extract_all({text}, '[㐀-䶿一-鿿豈-﫿]') FROM {table} WHERE {text} IS NOT NULL
"""

P9_SQL = f"""
WITH d AS (WITH units AS ({_UNITS.format(id='doc_id', text='text', table='documents')}), {_RUNS} SELECT DISTINCT id AS doc_id, n, run FROM runs),
e AS (WITH units AS ({_UNITS.format(id='item_id', text='passage', table='eval_items')}), {_RUNS} SELECT DISTINCT id AS item_id, n, run FROM runs)
SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (n, run)
"""


def queries() -> dict:
    own = (p1_found, p1_reasons, p3_found, p3_pairs, p4_found, p4_shares, p6_found, p6_rates, p8_packed, p8_fill, p9_found, p9_report,
           p10_found, p10_statistics)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "p9_found": P9_SQL,
        "p9_report": f"SELECT item_id, suite, category, count(*) AS documents FROM ({P9_SQL}) JOIN (SELECT DISTINCT item_id, suite, category FROM eval_items) USING (item_id) GROUP BY ALL",
    }
