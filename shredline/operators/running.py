"""Running aggregates over long ordered groups, spread over tasks.

A window over a key sorts all of the key's rows in one task. Here the rows are
range-partitioned by key and order instead, so a key that holds a third of the
table lies in several partitions. Each row then gets the running value within
its own partition and key, and the totals of the key's earlier partitions on
top. Only keys that cross a partition's edge need that: two for each partition
at most, so the offsets are a small table whatever the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shredline.session import ensure_checkpoint_dir

PART = "_part"

#: How an aggregate over earlier rows and one over later rows make one over both.
MERGE = {
    "count": lambda a, b: a + b,
    "sum": lambda a, b: a + b,
    "bit_xor": lambda a, b: a.bitwiseXOR(b),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """df with a partition label in ``_part``, range-partitioned by keys and order.

    The labelled rows are written to the shared checkpoint folder: a label must not
    change when a task runs again. Rows equal in keys and order share a label.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark)}/spread-{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(parts, *[F.col(k).asc() for k in keys], *order)
    ranged.withColumn(PART, F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(ranged.withColumn(PART, F.lit(0)).schema).parquet(path)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
            values: dict[str, tuple[str, Column]]) -> DataFrame:
    """df (labelled by ``spread``) with columns of ``values``: name -> (aggregate of MERGE, column).

    Each is the aggregate over the key's rows from the first to the row itself, in order.
    """
    local = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.select("*", *[getattr(F, kind)(c).over(local).alias(n) for n, (kind, c) in values.items()])

    key = F.struct(*keys)
    edges = df.groupBy(PART).agg(F.min(key).alias("a"), F.max(key).alias("b"))
    crossing = (edges.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("_key")).groupBy("_key")
                .agg(F.count("*").alias("_n")).where("_n > 1")                              # at most one for each part
                .select(*[F.col(f"_key.{k}").alias(f"c_{k}") for k in keys]))
    of_key = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys])
    totals = (df.join(F.broadcast(crossing), of_key, "left_semi")
              .groupBy(PART, *keys).agg(*[getattr(F, kind)(c).alias(n) for n, (kind, c) in values.items()]))
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    merged = {"count": "sum"}
    offsets = totals.select(
        F.col(PART).alias("o_part"), *[F.col(k).alias(f"o_{k}") for k in keys],
        *[getattr(F, merged.get(kind, kind))(n).over(earlier).alias(f"o_{n}") for n, (kind, _) in values.items()])
    on = reduce(lambda x, y: x & y, [F.col(PART) == F.col("o_part"),
                                     *[F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys]])
    return (out.join(F.broadcast(offsets), on, "left")                 # at most two rows for each part
            .select(*df.columns, *[
                F.when(F.col(f"o_{n}").isNull(), F.col(n)).otherwise(MERGE[kind](F.col(f"o_{n}"), F.col(n))).alias(n)
                for n, (kind, _) in values.items()]))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank",
              parts: int | None = None) -> DataFrame:
    """df with the 1-based place of each row among its key's rows; no task holds a whole long key."""
    return running(spread(df, keys, order, parts), keys, order, {name: ("count", F.lit(1))}).drop(PART)
