"""Tables in the shared folder that cut lineage in loops."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, local mode gets one of its own; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them again: an executor lost later costs no recomputation."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the place of each row, from 1, in the order given. Ranges of rows are sorted side by side, and only their sizes are summed up in one task."""
    rows = stored(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("range_").agg(F.count("*").alias("size_"))
    sizes = sizes.select("range_", (F.sum("size_").over(Window.orderBy("range_")) - F.col("size_")).alias("before_"))
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) + F.col("before_")
    return rows.join(F.broadcast(sizes), "range_").withColumn(name, place.cast("long")).drop("range_", "before_")
