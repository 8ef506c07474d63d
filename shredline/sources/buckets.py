"""Tables stored by a bucket of their key, changed bucket by bucket.

A change reads the buckets of the keys that it concerns and writes them again by
dynamic partition overwrite: the old files of those buckets are deleted when the
job commits, all other buckets keep theirs. Bytes read and written follow the
number of buckets hit, not the table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["tenant_id", "user_id"]


@dataclass
class BucketTable:
    """``bucket`` is an expression over the keys with values from 0 to ``buckets`` - 1, fixed for the life of the table."""
    path: str
    schema: T.StructType
    buckets: int = 1024
    bucket: Column | None = None
    keys: list[str] = field(default_factory=lambda: list(KEYS))

    def _bucket(self) -> Column:
        own = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)) if self.bucket is None else self.bucket
        return own.cast("int").alias("bucket")

    def _files(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        rows.select(*self.schema.fieldNames(), self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._files(spark).select(*self.schema.fieldNames())

    def hit(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys."""
        return [r["bucket"] for r in rows.select(self._bucket()).distinct().collect()]         # at most `buckets` numbers

    def read_buckets(self, spark: SparkSession, hit: list[int]) -> DataFrame:
        return self._files(spark).where(F.col("bucket").isin(hit)).select(*self.schema.fieldNames())

    def replace(self, rows: DataFrame) -> None:
        """Write the whole content of the buckets that the rows lie in."""
        (rows.select(*self.schema.fieldNames(), self._bucket()).repartition("bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path))
