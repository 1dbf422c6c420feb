"""Exact nearest neighbours by cosine distance, in blocks; ids and texts of the vector index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import delete_folder

#: From this cosine on two texts say the same.
SEMANTIC_HIT = 0.55
#: Rows and queries of one block: a task holds both and their distances, some 350 MB at most.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000


def _best(n: int):
    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "distance"]
        if queries.empty or rows.empty:
            return pd.DataFrame(columns=columns).astype({"query_id": "int64", "vec_id": "int64", "distance": "float64"})

        def unit(v):
            m = np.stack(v.to_list()).astype(np.float64)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            return m / np.where(size == 0, 1, size)

        rows = rows.sort_values("vec_id")
        away = 1.0 - unit(queries["embedding"]) @ unit(rows["embedding"]).T
        ids = rows["vec_id"].to_numpy()
        out = []
        for q, d in zip(queries["vec_id"].to_numpy(), away):
            top = np.lexsort((ids, d))[:n]
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[top], "distance": d[top]}))
        return pd.concat(out)[columns]

    return best


def neighbours(queries: DataFrame, rows: DataFrame, project: str | None = None, n: int = 10) -> DataFrame:
    """``nearest`` among the rows of one project, or of all if none is named; ``rows`` has a column ``project`` then."""
    return nearest(queries, rows if project is None else rows.where(F.col("project") == project), n)


def nearest(queries: DataFrame, rows: DataFrame, n: int = 10) -> DataFrame:
    """query_id, vec_id, distance and rank: the n rows of least cosine distance for each query, ties by vec_id.

    Both inputs have vec_id and embedding; null vectors are left out, a zero
    vector has distance 1 to everything, and vectors of other lengths than the
    rest fail. Every pair of a block of queries and a block of rows is one
    bounded task that keeps its n best; a window merges them.
    """
    rows, queries = (df.where("vec_id is not null and embedding is not null").select("vec_id", "embedding").toDF("vec_id", "embedding") for df in (rows, queries))
    row_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    r = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int")).withColumn("qb", every(query_blocks))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("rb", every(row_blocks))
    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(
        lambda a, b: _best(n)(a, b), "query_id long, vec_id long, distance double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def index_items(functions: DataFrame) -> DataFrame:
    """func_id, project, item_id (md5 of file, name and line) and the whole document text of each function."""
    item = F.md5(F.concat_ws(":", "path", "qualified_name", F.col("start_line").cast("string")))
    text = F.concat_ws("\n", F.concat(F.lit("函数: "), "qualified_name"), F.concat(F.lit("文件: "), "path"), F.concat(F.lit("说明: "), "docstring"))
    return functions.select("func_id", "project", item.alias("item_id"), text.alias("document"))


class VectorStore:
    """Index items as Parquet, one folder a project, in the folder ``root`` that all executors share."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root

    def add(self, items: DataFrame) -> None:
        """Appends items (with a column ``project``)."""
        items.write.mode("append").partitionBy("project").parquet(self.root)

    def replace_projects(self, items: DataFrame) -> None:
        """The items of the projects that occur in ``items`` take the place of those stored; other projects stay."""
        items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(self.root)

    def delete_project(self, project: str) -> None:
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(project)
        delete_folder(self.spark, f"{self.root}/project={escaped}")

    def read(self, schema) -> DataFrame:
        """All stored items; ``schema`` is that of the items added."""
        return self.spark.read.schema(schema).parquet(self.root)


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length; zero vectors are like nothing."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))


def semantic_hits(pairs: DataFrame, threshold: float = SEMANTIC_HIT) -> DataFrame:
    """pair_id, similarity of ``a`` and ``b``, and whether it reaches the threshold."""
    like = similarity(F.col("a"), F.col("b"))
    return pairs.select("pair_id", F.round(like, 6).alias("similarity"), (like >= threshold).alias("hit"))
