"""Registry loading at job start (SRC-01, SRC-04, SRC-05, SRC-19, SET-02, UDF-03).

Loaders are callables ``spark -> DataFrame`` (the warehouse-independent
loader interface). Each slice is optional: a table that doesn't exist means
"no entries". Any other failure (permissions, a broken file, a bug) is raised:
resources silently left out would be left out of redaction plans too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shredline import schemas
from shredline.operators import registry as REG
from shredline.sources.tables import lowercase_columns, read_or_empty

ABSENT = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")

Loader = Callable[[SparkSession], DataFrame]


def dbt_loader(rows_path: str, lineage_path: str) -> Loader:
    """SRC-01 + SRC-02 + SRC-03: flat registry rows and field lineage (missing lineage = none)."""
    def load(spark: SparkSession) -> DataFrame:
        rows = lowercase_columns(spark.read.parquet(rows_path)).select(*schemas.REGISTRY_ROWS.fieldNames())
        lineage = read_or_empty(spark, lineage_path, schemas.FIELD_LINEAGE)
        return REG.assemble(rows, lowercase_columns(lineage))
    return load


def table_loader(path: str) -> Loader:
    """SRC-04: a snapshot of registry entries (e.g. manual declarations)."""
    def load(spark: SparkSession) -> DataFrame:
        return REG.conform(spark.read.parquet(path))
    return load


def _safe(spark: SparkSession, loader: Loader | None) -> DataFrame:
    empty = spark.createDataFrame([], schemas.REGISTRY_ENTRY)
    if loader is None:
        return empty
    try:
        return REG.conform(loader(spark))
    except AnalysisException as missing:
        if missing.getCondition() not in ABSENT:
            raise
        return empty


def load_registry(spark: SparkSession, connector: Loader | None = None, dbt: list[Loader] | None = None,
                  manual: Loader | None = None) -> DataFrame:
    """SRC-19 / SET-02: connector slice, every dbt warehouse concatenated, manual declarations."""
    dbt_df = None
    for ld in dbt or []:
        d = _safe(spark, ld)
        dbt_df = d if dbt_df is None else dbt_df.unionByName(d)
    if dbt_df is None:
        dbt_df = _safe(spark, None)
    return REG.compose(_safe(spark, connector), dbt_df, _safe(spark, manual))


def seed_registry(spark: SparkSession) -> DataFrame:
    """SRC-05: a small opt-in connector seed (SaaS systems the janitor can wipe)."""
    rows = []
    for system in ("hubspot", "salesforce"):
        rows.append({"resource_id": f"{system}:contacts", "system": system, "resource_layer": "SAAS",
                     "visibility": "CUSTOMER_FACING", "owner_connector": system, "lineage_destination": system,
                     "deletion_strategy": "EXTERNAL_WIPE", "registry_version": "seed"})
    df = spark.createDataFrame(rows)
    fields = F.array(F.struct(F.lit("email").alias("name"), F.lit("CONTACT").alias("classification"),
                              F.lit("REDACT").alias("handling"), F.lit(False).alias("required_in_mart"),
                              F.lit("DECLARED").alias("confidence"), F.array().cast("array<string>").alias("evidence")))
    scan = F.struct(F.lit(False).alias("enabled"), F.lit("DISABLED").alias("scan_mode"),
                    F.array().cast("array<string>").alias("patterns"))
    return REG.conform(df.withColumn("pii_fields", fields).withColumn("ghost_data_scan", scan))
