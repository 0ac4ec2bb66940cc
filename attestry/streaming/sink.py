"""Running a finite stream to its end, for batch callers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder that spark.checkpoint.dir names; a temporary one on a local master without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='attestry-')}/stream-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """df written once and read again, so that later steps neither repeat it nor lose it with an executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_to_end(spark: SparkSession, query: DataFrame, name: str, mode: str = "append", stateful: bool = False) -> DataFrame:
    """Processes what the source holds now; the last state of each update goes to Parquet in the shared folder.

    ``stateful``: the query has processors of its own, whose state needs the RocksDB store.
    """
    folder = scratch(spark)
    out = f"{folder}/{name}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    before = spark.conf.get(PROVIDER, None)
    if stateful:
        spark.conf.set(PROVIDER, ROCKS)
    try:
        run = query.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if stateful:
            spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(query.schema).parquet(out)
