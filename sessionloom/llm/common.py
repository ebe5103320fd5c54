"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java and a Python pattern.
BLANKS = r"[\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}
#: Folders of staged tables in each open `clearing`.
_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: `spark.checkpoint.dir`.

    Where that is unset a temporary folder stands in if all work is done on this machine; on
    a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
    return _LOCAL["dir"]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder, as a URI."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the running stage, not the ones before.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    for made in _OPEN:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the folder of a staged table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


@contextlib.contextmanager
def clearing(spark: SparkSession):
    """Delete at the end what was staged within; results that read it are to be written by then."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for folder in made:
            delete(spark, folder)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df, written, with `_pos`: the place of each row from 0 in `order`.

    Rows are dealt by sampled ranges and sorted within them; only the row count of each range
    goes through the driver. Ties are dealt by the row's place in the input, so rows that are equal
    in all of `order` spread over ranges too. df should be cheap to read twice (a written table).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, *order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie")).drop("_tie")
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    written = staged(dealt.select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), name)
    bases, total = [], 0
    for part, n in sorted(written.groupBy("_part").agg(F.max("_at") + 1).collect()):
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "_part int, _base long")
    return written.join(F.broadcast(base), "_part").withColumn("_pos", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _dup, _text): `_id` may be null or repeated, (`_id`, `_dup`) may not.

    `_dup` numbers the rows of one id by the hash of their text; it costs a pass
    over the ids, and a shuffle of the texts only if some id is repeated.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    if base.groupBy("_id").count().where("count > 1").isEmpty():
        return base.select("_id", F.lit(0).alias("_dup"), "_text")
    from pyspark.sql import Window

    order = Window.partitionBy("_id").orderBy(F.xxhash64("_text"), F.length("_text"))
    return base.select("_id", (F.row_number().over(order) - 1).cast("int").alias("_dup"), "_text")


def parts_for(rows: int, each: int, least: int = 1) -> int:
    """How many partitions or blocks hold `rows` at about `each` rows."""
    return max(least, -(-rows // each))


def let(value: Column, body) -> Column:
    """Bind `value` once inside an expression: `body` may use it many times, even in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
