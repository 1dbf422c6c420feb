"""Point queries over the code graph: callers, callees, searches, details, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.names import callee_forms, form_refers, name_forms, refers, simple_name, spaced

SEARCH_LIMIT, FILE_LIMIT = 30, 10


def call_sites(edges: DataFrame, functions: DataFrame, every: bool = False) -> DataFrame:
    """caller (qualified name), file, line and callee_name of each distinct edge with a known caller; of ``every`` edge, repeated ones too, if asked."""
    own = edges.where("callee_name is not null").select("edge_id", "caller_func_id", "callee_name", "caller_line")
    own = own if every else own.distinct()
    callers = functions.select(
        F.col("func_id").alias("caller_func_id"), F.col("qualified_name").alias("caller"), F.col("name").alias("caller_name"),
        F.col("path").alias("file"), "project"
    )
    return own.join(callers, "caller_func_id").select(
        "edge_id", "caller", "caller_name", "callee_name", "file", F.col("caller_line").alias("line"), "project")


def callers_of(sites: DataFrame, name: str) -> DataFrame:
    """caller, file, line of the call sites that refer to ``name``."""
    return sites.where(refers(F.col("callee_name"), spaced(F.col("callee_name")), F.lit(name))).select("caller", "file", "line")


def _made_by() -> Column:
    """Whether ``target`` stands for the function caller_name, caller.

    It does if it equals either name, or if the qualified name begins or ends
    with it (as a LIKE pattern, in any letter case) and ends with ``.`` and the
    target or its last segment.
    """
    caller, target = F.col("caller"), F.col("target")
    simple = simple_name(target)
    near = F.expr("lower(caller) LIKE concat('%', lower(target)) OR lower(caller) LIKE concat(lower(target), '%')")
    ends = F.endswith(caller, F.concat(F.lit("."), target)) | ((simple != target) & F.endswith(caller, F.concat(F.lit("."), simple)))
    return F.coalesce(F.col("caller_name") == target, F.lit(False)) | (caller == target) | (near & ends)


def callees_of(sites: DataFrame, name: str) -> DataFrame:
    """callee and line, distinct, of the calls made by the functions that ``name`` stands for (see ``_made_by``)."""
    return sites.withColumn("target", F.lit(name)).where(_made_by()).select(F.col("callee_name").alias("callee"), "line").distinct()


def callees_of_each(sites: DataFrame, names: DataFrame) -> DataFrame:
    """target, callee and line, distinct, for every qualified name of ``names`` (column ``target``, with a ``.``).

    The last segment of such a name is that of every function it stands for,
    so the two sides meet by it and the exact rule is a residual.
    """
    dots = names.where("target is not null").select("target").distinct().withColumn("word", simple_name(F.col("target")))
    calls = sites.select("caller", F.lit(None).cast("string").alias("caller_name"), "callee_name", "line").distinct()
    met = calls.withColumn("word", simple_name(F.col("caller"))).join(dots, "word").where(_made_by())
    return met.select("target", F.col("callee_name").alias("callee"), "line").distinct()


def _like(column: Column, word: str) -> Column:
    return column.ilike(f"%{word}%")


def search_functions(functions: DataFrame, word: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The first functions by path and line whose name or qualified name contains ``word`` in any letter case.

    ``%`` and ``_`` in the word stay wildcards. Ties go by func_id. A limit
    below 1 counts as 1, one above SEARCH_LIMIT as that.
    """
    limit = min(max(limit, 1), SEARCH_LIMIT)
    hit = functions.where(_like(F.col("name"), word) | _like(F.col("qualified_name"), word))
    return hit.orderBy("path", "start_line", "func_id").limit(limit).select("func_id", "qualified_name", "path", "start_line", "end_line")


def search_files(files: DataFrame, word: str, limit: int = FILE_LIMIT) -> DataFrame:
    """The first files by path whose name or path contains ``word``."""
    return files.where(_like(F.col("name"), word) | _like(F.col("path"), word)).orderBy("path").limit(limit).select("file_id", "path", "name")


def function_detail(functions: DataFrame, name: str) -> DataFrame:
    """The function of the least id among those of this simple or qualified name."""
    hit = functions.where((F.col("name") == name) | (F.col("qualified_name") == name))
    return hit.orderBy("func_id").limit(1).select("func_id", "qualified_name", "path", "start_line", "end_line", "class_name")


def file_structure(file: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """kind, qualified_name and lines of everything in the one file of ``file`` (file_id)."""
    one = file.select("file_id").limit(1)
    columns = ["qualified_name", "start_line", "end_line"]
    return (
        functions.join(one, "file_id", "left_semi").select(F.lit("function").alias("kind"), *columns)
        .unionByName(classes.join(one, "file_id", "left_semi").select(F.lit("class").alias("kind"), *columns))
    )


def structure_by_file(files: DataFrame, functions: DataFrame, hint: str) -> DataFrame:
    """file_key and number of functions of every file whose path contains ``hint``.

    The key is the base name, ``parent/name`` for the second file of that name,
    and the whole path from the third on (by file_id).
    """
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    at = F.row_number().over(Window.partitionBy("name_").orderBy("file_id"))
    keyed = files.select("file_id", "path").where(_like(F.col("path"), hint)).withColumn("name_", name).withColumn("at", at)
    key = F.when(F.col("at") == 1, F.col("name_")).when(
        (F.col("at") == 2) & (F.size(parts) > 1), F.concat_ws("/", F.element_at(parts, -2), F.col("name_"))
    ).otherwise(F.col("path"))
    counts = functions.groupBy("file_id").agg(F.count(F.lit(1)).alias("functions"))
    return keyed.join(counts, "file_id", "left").select("file_id", key.alias("file_key"), F.coalesce("functions", F.lit(0)).alias("functions"))


def graph_stats(**tables: DataFrame) -> DataFrame:
    """(metric, n): rows of each table."""
    rows = [t.select(F.lit(name).alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("n")) for name, t in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def callee_words(sites: DataFrame) -> DataFrame:
    """Each distinct spelling of a callee, with the forms it is compared by, and each of its identifiers (word)."""
    spelled = sites.select("callee_name").distinct().select(*callee_forms(F.col("callee_name")))
    return spelled.withColumn("word", F.explode(F.array_distinct(F.filter(F.split("spaced", r"\W+"), lambda w: w != ""))))


def referring_callees(words: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``names`` (with a column ``target``) joined to each callee_name of ``words`` that refers to the target.

    A name can only be meant where its last segment is one of the callee's
    identifiers, so the join is by that word and the exact rule is a residual.
    """
    name = F.col("target")
    meant = names.where("target is not null").select(*names.columns, simple_name(name).alias("word"), *name_forms(name))
    return words.join(meant, "word").where(form_refers()).select("callee_name", *names.columns)


def reference_edges(sites: DataFrame, names: DataFrame) -> DataFrame:
    """Call sites joined to every name of ``names`` (column ``target``) they refer to."""
    return sites.join(referring_callees(callee_words(sites), names.select("target").distinct()), "callee_name")
