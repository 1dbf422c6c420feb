"""Session helpers: local sessions for tests, and lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "codestrata", shuffle: int | None = None) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session that names none gets a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("codestrata.shared.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("codestrata.shared.dir", folder)
    return folder


class Stage:
    """Intermediate tables of one run in the shared folder.

    ``keep`` writes a frame once as Parquet and reads it back, which cuts the
    lineage without computing anything twice and survives the loss of
    executors. ``drop`` deletes a table that a later one supersedes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        context = spark.sparkContext
        if not hasattr(context, "_codestrata_roots"):
            context._codestrata_roots = []
            atexit.register(release, spark)
        context._codestrata_roots.append(self.root)

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` written and read back; ``by`` names a column of few values that gets a folder for each."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._stage_path = path
        return kept

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_stage_path", None)
        if path:
            delete_folder(self.spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables of all runs of this Spark context; their results can't be read any more.

    Called when the driver's Python ends; call it yourself once results are written.
    """
    roots = getattr(spark.sparkContext, "_codestrata_roots", [])
    while roots:
        try:
            delete_folder(spark, roots.pop())
        except Exception:  # the JVM may be gone
            return


def python_rows(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInPandas`` with the package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)


def ship(spark: SparkSession) -> None:
    """Makes the package importable in the executors' Python, as --py-files would; once per Spark context.

    Only code travels this way, served by the driver; no data does.
    """
    context = spark.sparkContext
    if getattr(context, "_codestrata_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="codestrata-")) / "codestrata.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._codestrata_shipped = True
