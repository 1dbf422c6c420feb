"""Reading and maintaining a stored graph: file lines, content hashes, overview by directory, cascading removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.sources.tables import plain_path, project_files

LINE_LIMIT = 50

# Directories left out and extensions read by the baseline's listing.
BASELINE_SKIPPED = ("venv", ".git", "__pycache__", "node_modules", "dist", "build", ".idea", ".claude")
BASELINE_EXTENSIONS = ("py", "java", "js", "ts", "go", "cpp", "c", "h", "hpp", "cs", "rb", "rs")


def listed_files(files: DataFrame, skipped: tuple[str, ...], extensions: tuple[str, ...]) -> DataFrame:
    """file_id and path of the files with one of the extensions, in no directory that is left out; names count as they are spelled."""
    parts = F.split("path", "/")
    inside = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in skipped]))
    return files.where(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).isin(*extensions) & ~inside).select("file_id", "path")


def module_descriptions(files: DataFrame, contents: DataFrame) -> DataFrame:
    """project, directory, python_files, description, is_tool and is_agent of each top directory.

    The description is the docstring of the directory's __init__.py if it
    stands in its first 500 characters, cut to 100 (a display limit); a
    directory is a tool or agent one by its own name or by a directory
    ``tools`` or ``agent`` right in it. Names that begin with ``.`` or ``_`` and
    virtual environments are left out.
    """
    parts = F.split("path", "/")
    named = project_files(files).where(F.size(parts) > 2).select(
        "file_id", "project", F.element_at(parts, 2).alias("directory"), F.element_at(parts, 3).alias("below"), F.size(parts).alias("deep"), "path")
    named = named.where(~F.col("directory").rlike(r"^(\.|_|venv|node_modules)"))
    opening = named.where("deep = 3 and below = '__init__.py'").join(newest_contents(contents), "file_id").select(
        "project", "directory", F.substring(F.trim(F.regexp_extract(F.substring("content", 1, 500), r'(?s)"""(.*?)"""', 1)), 1, 100).alias("description"))
    flag = lambda word, folder: F.contains(F.lower("directory"), F.lit(word)) | ((F.col("below") == folder) & (F.col("deep") > 3))
    sums = named.groupBy("project", "directory").agg(
        F.count_if(F.endswith("path", F.lit(".py"))).alias("python_files"), F.bool_or(flag("tool", "tools")).alias("is_tool"),
        F.bool_or(flag("agent", "agent")).alias("is_agent"))
    heads = opening.groupBy("project", "directory").agg(F.min("description").alias("description"))
    return sums.join(heads, ["project", "directory"], "left").select(
        "project", "directory", "python_files", F.coalesce("description", F.lit("")).alias("description"), "is_tool", "is_agent")


def totals(files: DataFrame, functions: DataFrame) -> DataFrame:
    """project, total_files (distinct paths) and total_functions."""
    own = project_files(files).where("path is not null").groupBy("project").agg(F.count_distinct("path").alias("total_files"))
    made = functions.groupBy("project").agg(F.count(F.lit(1)).alias("total_functions"))
    return own.join(made, "project", "left").select("project", "total_files", F.coalesce("total_functions", F.lit(0)).alias("total_functions"))


def newest_contents(contents: DataFrame) -> DataFrame:
    """file_id and content, one row per file: the latest that is not null, ties by the greatest text's hash."""
    kept = contents.where("file_id is not null and content is not null")
    order = F.struct("loaded_at", F.xxhash64("content"))
    return kept.groupBy("file_id").agg(F.max_by("content", order).alias("content"))


def numbered_lines(contents: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """file_id, line_no and line of the first ``limit`` lines of each content; LF, CRLF and CR end a line.

    A null content has no lines, an empty one a single empty line.
    """
    lines = F.slice(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n"), 1, limit)
    return contents.where("content is not null").select("file_id", F.posexplode(lines).alias("at", "line")).select(
        "file_id", (F.col("at") + 1).alias("line_no"), "line"
    )


def content_hashes(contents: DataFrame) -> DataFrame:
    """file_id and SHA-1, in lower case, of each file's newest content."""
    return newest_contents(contents).select("file_id", F.sha1("content").alias("sha1"))


def overview(files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """project, directory, files, python_files, functions and classes of each top directory.

    The directory is the path's second segment, empty for files right below
    the project. Records are counted per file before they meet the files.
    """
    parts = F.split("path", "/")
    top = F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise(F.lit(""))
    named = project_files(files).where("path is not null")
    out = named.select("file_id", "project", top.alias("directory"), F.endswith("path", F.lit(".py")).cast("int").alias("python"))
    for name, records in (("functions", functions), ("classes", classes)):
        out = out.join(records.groupBy("file_id").agg(F.count(F.lit(1)).alias(name)), "file_id", "left")
    return out.groupBy("project", "directory").agg(
        F.count(F.lit(1)).alias("files"), F.sum("python").alias("python_files"),
        F.coalesce(F.sum("functions"), F.lit(0)).alias("functions"), F.coalesce(F.sum("classes"), F.lit(0)).alias("classes"),
    )


def remove_files(gone: DataFrame, files: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame,
                 call_edges: DataFrame, file_hashes: DataFrame) -> dict[str, DataFrame]:
    """All tables without the files of ``gone`` (file_id, path) and what hangs on them.

    Calls go with the function they are made from, hashes with their path in
    any spelling. Rows whose reference is null stay, as do calls whose caller
    also stands in a file that is kept.
    """
    ids = gone.select("file_id").distinct()
    kept = {name: df.join(ids, "file_id", "left_anti") for name, df in
            (("files", files), ("functions", functions), ("classes", classes), ("imports", imports))}
    lost = functions.join(ids, "file_id", "left_semi").select("func_id").distinct().join(kept["functions"].select("func_id"), "func_id", "left_anti")
    kept["call_edges"] = call_edges.join(lost, call_edges.caller_func_id == lost.func_id, "left_anti")
    paths = gone.select(F.col("path").alias("_gone")).distinct()
    kept["file_hashes"] = file_hashes.join(paths, plain_path(F.col("path")) == F.col("_gone"), "left_anti")
    return kept
