"""Readers for the driver's Parquet tables and the engine's own tables (SRC-01..04, 08, 10, 11)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; callers select columns so pruning reaches the reader."""
    return spark.read.parquet(table_path(sf_dir, name))


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """SRC-02/SRC-04: a missing table means "nothing there", not an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def lowercase_columns(df: DataFrame) -> DataFrame:
    """SRC-03: one row type for warehouses that upper-case result names."""
    return df.toDF(*[c.lower() for c in df.columns])


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """SRC-10: column introspection as rows (table, column_name, data_type, is_nullable, ordinal)."""
    rows = [(t, f.name, f.dataType.simpleString(), bool(f.nullable), i + 1)
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, "
                                       "is_nullable boolean, ordinal long")


def table_type(spark: SparkSession, name: str) -> str:
    """SRC-11: BASE TABLE / VIEW / MISSING for a catalog name."""
    try:
        t = spark.catalog.getTable(name)
    except Exception:
        return "MISSING"
    return "VIEW" if (t.tableType or "").upper() in ("VIEW", "TEMPORARY") or t.isTemporary else "BASE TABLE"


def table_types(names: DataFrame, name_col: str = "table") -> DataFrame:
    """SRC-11 for a table of names: each with its type, by a join with the catalogue's listing."""
    spark = names.sparkSession
    known = [(t.name.lower(), "VIEW" if t.isTemporary or (t.tableType or "").upper() in ("VIEW", "TEMPORARY") else "BASE TABLE")
             for t in spark.catalog.listTables()]
    listing = spark.createDataFrame(known, "_name string, table_type string").dropDuplicates(["_name"])
    return (names.join(listing, F.lower(F.col(name_col)) == F.col("_name"), "left")
            .withColumn("table_type", F.coalesce("table_type", F.lit("MISSING"))).drop("_name"))


def parse_resource_id(col):
    """SRC-09: ``system:project.dataset.table`` → struct(system, project, dataset, table)."""
    pat = r"^([a-z]+):([^.]+)\.([^.]+)\.(.+)$"
    return F.struct(
        F.regexp_extract(col, pat, 1).alias("system"),
        F.regexp_extract(col, pat, 2).alias("project"),
        F.regexp_extract(col, pat, 3).alias("dataset"),
        F.regexp_extract(col, pat, 4).alias("table"),
    )
