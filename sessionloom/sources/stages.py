"""Tables that a job writes for itself: they cut the lineage and are read by several steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, which the driver and all executors share.

    Where that is unset a temporary folder stands in if all work is done on this machine; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-stages-")
        base = _LOCAL["dir"]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns into all of `spark.sql.shuffle.partitions`.

    For rows that grow after the shuffle (texts, terms): Spark joins small partitions by the bytes it has shuffled, and so
    would make few large tasks of them. A number that is asked for is kept."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in a fresh folder, in one folder for each value of column `by`."""
    path = folder(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
