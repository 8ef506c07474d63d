"""Streaming sources and a runner that drives a query to completion.

File sources read a directory; a single driver table is selected with
``pathGlobFilter``. ``run_available`` processes everything available
(``trigger(availableNow=True)``) into Parquet under the cluster's shared
checkpoint folder and returns the written result as a static DataFrame.

A ``Fold`` is a stream with a state per key that is kept in a table of its own:
each micro-batch joins its keys with their states and writes those that changed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shredline.session import ensure_checkpoint_dir
from shredline.sources.tables import table_path


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    schema = spark.read.parquet(table_path(sf_dir, name)).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def scratch(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared checkpoint location (never a machine-local temp on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "shredline", *parts, uuid.uuid4().hex)


FULL = 16       # micro-batches from one full copy of the states to the next


@dataclass
class Fold:
    """A stream whose messages change a state per key, by joins and column expressions.

    ``collected`` are aggregates over a key's messages of a micro-batch (null for a key that has none in it). ``step``
    gets rows of the key, these and the state before (``_old``, a struct; null at first) and returns the key, the state's
    columns and what ``emit`` needs; ``emit`` makes the output from the rows of the keys that had messages.
    """
    messages: DataFrame
    key: str
    collected: list[Column]
    state: T.StructType
    step: Callable[[DataFrame], DataFrame]
    emit: Callable[[DataFrame], DataFrame]
    schema: T.StructType

    @property
    def sparkSession(self) -> SparkSession:
        return self.messages.sparkSession

    def stored(self, spark: SparkSession, path: str, batch_id: int) -> DataFrame:
        """Every key's state before a micro-batch: its last row since the last full copy."""
        folders = [f"{path}/_batch_id={i}" for i in range((batch_id - 1) // FULL * FULL, batch_id)]
        fields = [T.StructField("_key", self.messages.schema[self.key].dataType), *self.state.fields]
        rows = spark.read.schema(T.StructType(fields)).option("basePath", path).parquet(*folders)
        old = F.struct(*self.state.fieldNames())
        return rows.groupBy("_key").agg(F.max_by(old, "_batch_id").alias("_old"))

    def apply(self, batch: DataFrame, batch_id: int, path: str) -> DataFrame:
        """The output of a micro-batch, after its new states are written; a batch that runs again replaces its own."""
        spark, target = batch.sparkSession, f"{path}/_batch_id={batch_id}"
        now = batch.groupBy(F.col(self.key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), *self.collected)
        if batch_id == 0:
            both = now.withColumn("_old", F.lit(None).cast(self.state))
        else:
            old = self.stored(spark, path, batch_id).withColumnRenamed("_key", "_old_key")
            both = (now.join(old, F.col("_key").eqNullSafe(F.col("_old_key")), "left" if batch_id % FULL else "full_outer")
                    .withColumn("_key", F.coalesce("_key", "_old_key")).drop("_old_key"))
        self.step(both).write.mode("overwrite").parquet(target)
        return self.emit(spark.read.parquet(target).where("_n > 0").withColumnRenamed("_key", self.key))


def run_available(df: DataFrame | Fold, name: str, output_mode: str = "append", batch_fn=None) -> DataFrame:
    """Run a streaming DataFrame over all available input and return what it wrote.

    ``batch_fn(batch_df, batch_id) -> DataFrame`` may transform each micro-batch
    before it is appended (used for MERGE-like sinks). Output rows carry
    ``_batch_id`` so callers can pick the latest state per key. A ``Fold`` brings its own
    ``batch_fn``; its states lie beside the output.
    """
    spark, schema = df.sparkSession, df.schema
    root = scratch(spark, "streams", name)
    out, ck = os.path.join(root, "out"), os.path.join(root, "checkpoint")
    if isinstance(df, Fold):
        fold, states = df, os.path.join(root, "states")
        df, batch_fn = fold.messages, lambda batch, batch_id: fold.apply(batch, batch_id, states)

    def sink(batch, batch_id):
        # One folder per micro-batch, overwritten: a batch re-run after a failure replaces its own
        # output instead of appending it twice (idempotent sink).
        b = batch_fn(batch, batch_id) if batch_fn else batch
        b.write.mode("overwrite").parquet(f"{out}/_batch_id={batch_id}")

    q = (df.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    try:
        return spark.read.parquet(out)
    except Exception:  # nothing was written: empty result with the stream's schema
        return spark.createDataFrame([], schema.add("_batch_id", "long"))
