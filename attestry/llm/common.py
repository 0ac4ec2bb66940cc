"""Shared helpers of the training-data operators: scratch tables and small column tools."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A local master without that setting (tests) gets a temporary folder; a cluster without it is
    refused, because a machine-local folder would lose rows there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="attestry-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables written once to the shared folder; later reads survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_BYTES = 64 << 20


def small_enough(df: DataFrame, size: int) -> DataFrame:
    """df marked for broadcast if ``size``, a bound of its bytes, is at most BROADCAST_BYTES."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often and however deep in lambdas body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


SALTS = 16


def salted(rows: DataFrame, small: DataFrame, on: list[str], by: Column, salts: int = SALTS) -> DataFrame:
    """rows joined with small on columns of which ``small`` has each value once, a value's rows dealt over ``salts`` tasks.

    ``by`` deals the rows of a value; small is repeated for each share, so it should be an aggregate.
    """
    shares = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(by, F.lit(salts)).cast("int")).join(shares, [*on, "_salt"]).drop("_salt")


ROWS_A_TASK = 200_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """As many tasks as so many small rows need, at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, rows // ROWS_A_TASK)


def sized(df: DataFrame, rows: int, *on: str) -> DataFrame:
    """df dealt by columns over tasks_for its rows."""
    return df.repartition(tasks_for(df.sparkSession, rows), *on)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, where a row's result is as large as its text."""
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)
