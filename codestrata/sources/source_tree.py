"""Source trees as tables of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that are not entered, and extensions that are read.
SKIPPED_DIRECTORIES = (
    "venv", "node_modules", "__pycache__", ".git", ".idea", "dist", "build", "egg-info", ".mypy_cache", ".pytest_cache", ".tox", "env", "envs",
    "target", "Dev-C++", "Dev-C++-Easyx", "MinGW64", "MinGW", "coverage", ".nyc_output", ".next",
)
EXTENSIONS = ("py", "java", "js", "jsx", "ts", "tsx", "vue", "go", "c", "h", "cpp", "hpp", "cc", "cxx", "rs", "cs")


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, content and sha1 of the source files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    wanted = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS)
    skipped = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in SKIPPED_DIRECTORIES]))
    return files.where(wanted & ~skipped).select("path", F.col("content").cast("string").alias("content"), F.sha1("content").alias("sha1"))


def vue_script(content) -> F.Column:
    """The body of the first script element."""
    return F.trim(F.regexp_extract(content, r"(?s)<script\b[^>]*>(.*?)</script>", 1))
