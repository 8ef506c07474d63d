"""Append-only sinks (SRC-06, SRC-12/13, SRC-14/15, SRC-16).

All are plain DataFrame writes: Parquet appends for event-like tables, and
a tenant / issue-date partitioned layout for certificates, whose stored
bytes are read back as they were written (never re-signed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SRC-06 / SRC-12 / SRC-13 / SRC-16: append rows to a table folder."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def store_certificates(rows: DataFrame, root: str) -> None:
    """SRC-14: certificate JSON wrapper + hash, laid out by tenant and issue date.

    ``rows`` from ``certificates.certificate_rows``: the stored document is
    the JSON object {certificate, hash, previous_hash, sequence, path}; ``hash_path`` names the
    hash kept beside it.
    """
    doc = F.to_json(F.struct(F.col("certificate"), F.col("certificate_hash").alias("hash"), "previous_hash",
                             F.col("sequence").alias("chain_sequence"), "deletion_request_id", "path"))
    (rows.select("tenant_id", "issue_date", "deletion_request_id", "certificate_hash", "path", "hash_path", doc.alias("document"))
     .write.mode("append").partitionBy("tenant_id", "issue_date").parquet(root))


def read_certificates(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame:
    """SRC-15: stored certificates (optionally only the given ``path`` values), bytes as written."""
    df = spark.read.parquet(root)
    if paths is not None:
        df = df.join(paths.select("path"), "path", "left_semi")
    return df.select("tenant_id", "issue_date", "deletion_request_id", "certificate_hash", "path", "hash_path",
                     F.get_json_object("document", "$.certificate").alias("certificate"), "document")
