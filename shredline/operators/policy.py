"""Registry policy evaluation (FN-25, AGG-12, AGG-06, EXT-04).

Each entry gets an ordered ``issues`` array built with higher-order
functions over ``pii_fields``; no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed issue codes, severities and messages (equal the reference's wording).
MSG_TENANT = "Tenant-scoped warehouse resources must declare tenantIdColumn."
MSG_USER = "Crypto-shredded resources must declare how user scope is represented."
MSG_MANUAL = "Manual review is required before this resource can be considered fully automated."
MSG_MART = "Mart resources may not expose direct identifiers without aggregate-only approval."
MSG_GHOST = "Ghost-data scanning is disabled for this resource."
STATUS_RANK = {"PASS": 0, "WARN": 1, "FAIL": 2}


def _issue(code: str, severity: str, msg: str, field: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                    F.col("resource_id").alias("resource_id"),
                    (field if field is not None else F.lit(None).cast("string")).alias("field"),
                    F.lit(msg).alias("message"))


def _empty(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def is_mart() -> Column:
    """A resource is a mart by name only: ``.mart_`` inside or a leading ``mart_``."""
    last = F.element_at(F.split("resource_id", ":"), -1)
    name = F.when(F.length(last) > 0, last).otherwise(F.col("resource_id"))
    return F.contains(name, F.lit(".mart_")) | F.startswith(name, F.lit("mart_"))


def issues() -> Column:
    """FN-25: ordered issue structs (code, severity, resource_id, field, message)."""
    head = F.array_compact(F.array(
        F.when((F.col("system") == "bigquery") & _empty("tenant_id_column"),
               _issue("MISSING_TENANT_SCOPE", "ERROR", MSG_TENANT)),
        F.when((F.col("deletion_strategy") == "CRYPTO_SHRED") & _empty("user_id_column"),
               _issue("MISSING_USER_SCOPE", "ERROR", MSG_USER)),
        F.when(F.col("deletion_strategy") == "MANUAL_REVIEW", _issue("MANUAL_REVIEW_REQUIRED", "WARNING", MSG_MANUAL)),
    ))
    mart = is_mart()
    per_field = F.flatten(F.transform(F.coalesce(F.col("pii_fields"), F.array()), lambda f: F.array_compact(F.array(
        F.when(mart & (f["classification"] == "DIRECT_IDENTIFIER") & (f["handling"] != "ALLOW_AGGREGATE_ONLY"),
               _issue("DIRECT_IDENTIFIER_IN_MART", "ERROR", MSG_MART, f["name"])),
        F.when(f["handling"] == "MANUAL_REVIEW", _issue("MANUAL_REVIEW_REQUIRED", "WARNING", MSG_MANUAL, f["name"])),
    ))))
    tail = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("ghost_data_scan.enabled"), F.lit(False)),
               _issue("GHOST_SCAN_DISABLED", "INFO", MSG_GHOST))))
    return F.concat(head, per_field, tail)


def status_of(iss: Column) -> Column:
    """AGG-12: FAIL if any ERROR, WARN if any WARNING, else PASS."""
    return (F.when(F.exists(iss, lambda i: i["severity"] == "ERROR"), "FAIL")
            .when(F.exists(iss, lambda i: i["severity"] == "WARNING"), "WARN").otherwise("PASS"))


def evaluate(entries: DataFrame) -> DataFrame:
    """Per entry: status and issues."""
    return entries.withColumn("issues", issues()).withColumn("policy_status", status_of(F.col("issues")))


def overall(evaluated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG-06: FAIL > WARN > PASS over entries (PASS when there are none)."""
    rank = (F.when(F.col("policy_status") == "FAIL", 2).when(F.col("policy_status") == "WARN", 1).otherwise(0))
    g = evaluated.groupBy(*(by or [])) if by else evaluated.groupBy()
    agg = g.agg(F.max(rank).alias("_r"), F.count(F.lit(1)).alias("entries"),
                F.count_if(F.col("policy_status") == "FAIL").alias("failing"),
                F.count_if(F.col("policy_status") == "WARN").alias("warning"))
    return agg.select(*(by or []), F.when(F.col("_r") == 2, "FAIL").when(F.col("_r") == 1, "WARN")
                      .otherwise("PASS").alias("status"), "entries", "failing", "warning")


def assertion_failures(evaluated: DataFrame) -> DataFrame:
    """EXT-04: dbt-style tests as a query: one row per failing (resource, code) of severity ERROR."""
    return (evaluated.select("resource_id", F.explode("issues").alias("i"))
            .where(F.col("i.severity") == "ERROR")
            .select("resource_id", F.col("i.code").alias("code"), F.col("i.field").alias("field")))
