"""Run a stream over what its source holds now and give its result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_dir
from tidemark.sources.files import append_history


def drained(stream: DataFrame, mode: str, keys: list[str], order: str | None = None) -> DataFrame:
    """The last row of each key after all available input: by batch, then by ``order``.

    Every batch is written to the shared folder, keyed by its number, so that a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/out")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch"), *([F.desc(order)] if order else [])))
    return out.withColumn("__n", last).filter("__n = 1").drop("__n", "batch")


def kept_history(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that a stream's source holds now to a history (``files.append_history``), batch by batch: one that runs again changes nothing."""

    def keep(batch: DataFrame, number: int) -> None:
        append_history(batch, path, number)

    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
