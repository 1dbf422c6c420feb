"""Source files with their contents, spread for work in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.lexers import ALIKE, LANGUAGES
from codestrata.operators.store import newest_contents
from codestrata.sources.tables import project_files


def tasks(df: DataFrame, least: int = 0) -> int:
    """Number of partitions for work in Python: the session's shuffle partitions, three to a core at least."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, least)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Rows read from files, ready for work in Python.

    Files that make four partitions a core or more are taken as they lie; fewer
    (a small input, or few large row groups) are spread by ``key``.
    """
    if scan.rdd.getNumPartitions() >= 4 * scan.sparkSession.sparkContext.defaultParallelism:
        return scan
    return scan.repartition(tasks(scan), key)


def with_language(files: DataFrame, alike: bool = False) -> DataFrame:
    """Adds ``ext`` (lower case) and ``language``, null where the extension is of no known language.

    With ``alike`` languages that read alike (C++, JSX) count as the known one.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    names = F.create_map(*[F.lit(x) for pair in (LANGUAGES | (ALIKE if alike else {})).items() for x in pair])
    return files.withColumn("ext", ext).withColumn("language", names[F.col("ext")])


def source_files(files: DataFrame, contents: DataFrame, alike: bool = False) -> DataFrame:
    """file_id, path, project, language and content of files with content in a known language.

    ``alike`` is that of ``with_language``. A file_id delivered several times counts once, with its newest content.
    Partitions are many and fixed in number, for the Python stage that follows.
    """
    many = newest_contents(contents).repartition(tasks(contents), "file_id")
    return many.join(with_language(project_files(files), alike).where("language is not null"), "file_id")
