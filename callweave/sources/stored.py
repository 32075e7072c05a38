"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a derived table that are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
#: Tasks for each core that rows are dealt to.
TASKS_PER_CORE = 4


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in local mode, if unset, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not root:
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, label: str) -> DataFrame:
    """rows written as Parquet and read again: what is used several times is made once, and a lost executor loses none of it."""
    path = shared_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def broadcast_if_few(rows: DataFrame) -> DataFrame:
    """rows, broadcast if they are few enough."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def dealt(rows: DataFrame) -> DataFrame:
    """rows over all cores, where what follows costs far more than reading: a file of one row group is read by one task."""
    return rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
