"""Decrypted-view catalogue (STA-16, VAL-08, SRC-18) and named views over DataFrames.

A declared view is a row (tenant, view_name, fields, ...); its content is
``vault.decrypted_pivot`` restricted to the tenant and fields, registered as
a temporary view ``{tenant}_{view}`` when asked for.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shredline.functions import text as TX
from shredline.functions import validation as VAL
from shredline.operators import vault as V

CATALOG_SCHEMA = ("tenant_id string, view_name string, fields array<string>, justification string, "
                  "created_by string, consumer string, status string, created_at timestamp, "
                  "revoked_at timestamp, revoked_by string")


# View declaration rule messages.
VIEW_MESSAGES = {
    "name": "View name must be a valid identifier: letters, numbers, underscores, not starting with a number.",
    "justification": "businessJustification is required.",
    "fields": "At least one declared field is required.",
    "unsynced": "Some declared fields have no synced rows in the vault for this tenant.",
    "exists": "Decrypted view already exists for tenant.",
    "duplicate": "Duplicate declaration in batch.",
}


def empty_catalog(spark) -> DataFrame:
    return spark.createDataFrame([], CATALOG_SCHEMA)


def declare(catalog: DataFrame, decls: DataFrame, available: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """VAL-08 + STA-16: validate and add declarations.

    Rules: identifier name, non-blank justification, ≥ 1 field, every field
    synced for the tenant (anti join on FIL-13), no active view of the same
    name (a revoked name can be reused). Several declarations of one name in
    a batch: the first (by declared_at, then consumer) is considered.
    Returns (catalog, outcome).
    """
    w = Window.partitionBy("tenant_id", "view_name").orderBy("declared_at", "consumer")
    d = decls.withColumn("_n", F.row_number().over(w))
    missing = (d.select("tenant_id", "view_name", "_n", F.explode_outer("fields").alias("field_name"))
               .where(F.col("field_name").isNotNull())
               .join(available.select("tenant_id", "field_name"), ["tenant_id", "field_name"], "left_anti")
               .groupBy("tenant_id", "view_name", "_n").agg(F.array_sort(F.collect_set("field_name")).alias("_missing")))
    active = catalog.where(F.col("status") == "active").select("tenant_id", "view_name", F.lit(True).alias("_active"))
    d = d.join(missing, ["tenant_id", "view_name", "_n"], "left").join(active, ["tenant_id", "view_name"], "left")
    errs = VAL.errors([
        (~TX.is_safe_identifier("view_name"), VIEW_MESSAGES["name"]),
        (F.col("justification").isNull() | (F.length(F.trim("justification")) == 0), VIEW_MESSAGES["justification"]),
        (F.coalesce(F.size("fields"), F.lit(0)) <= 0, VIEW_MESSAGES["fields"]),
        (F.size(F.coalesce("_missing", F.array().cast("array<string>"))) > 0, VIEW_MESSAGES["unsynced"]),
        (F.col("_active").isNotNull(), VIEW_MESSAGES["exists"]),
        (F.col("_n") > 1, VIEW_MESSAGES["duplicate"]),
    ])
    d = d.withColumn("errors", errs)
    ok = d.where(F.size("errors") == 0)
    new = ok.select("tenant_id", "view_name", "fields", "justification", "created_by", "consumer",
                    F.lit("active").alias("status"), now.alias("created_at"),
                    F.lit(None).cast("timestamp").alias("revoked_at"), F.lit(None).cast("string").alias("revoked_by"))
    kept = catalog.join(new.select("tenant_id", "view_name"), ["tenant_id", "view_name"], "left_anti")
    outcome = d.select("tenant_id", "view_name", (F.size("errors") == 0).alias("created"), "errors",
                       F.coalesce("_missing", F.array().cast("array<string>")).alias("missing_fields"))
    return kept.unionByName(new), outcome


def revoke(catalog: DataFrame, revokes: DataFrame, now: Column) -> DataFrame:
    """STA-16: status flip to revoked (the record stays as audit trail).

    Several revokes of one view in a batch are one, by the first name in order.
    """
    r = revokes.groupBy("tenant_id", "view_name").agg(F.min("revoked_by").alias("_by")).withColumn("_hit", F.lit(True))
    j = catalog.join(r, ["tenant_id", "view_name"], "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "active")
    return j.select("tenant_id", "view_name", "fields", "justification", "created_by", "consumer",
                    F.when(hit, "revoked").otherwise(F.col("status")).alias("status"), "created_at",
                    F.when(hit, now).otherwise(F.col("revoked_at")).alias("revoked_at"),
                    F.when(hit, F.col("_by")).otherwise(F.col("revoked_by")).alias("revoked_by"))


def list_views(catalog: DataFrame, tenant: str | None = None) -> DataFrame:
    return catalog if tenant is None else catalog.where(F.col("tenant_id") == tenant)


def view_id(tenant: str, view_name: str) -> str:
    """A catalogue name that no other (tenant, view) has: the readable part may be shared, the digest isn't."""
    TX.assert_safe_identifiers([view_name])
    digest = hashlib.sha256(f"{tenant}\0{view_name}".encode()).hexdigest()[:16]
    return f"{tenant}_{view_name}_{digest}".replace("-", "_")


def materialise(vault: DataFrame, kv: DataFrame, tenant: str, view_name: str, fields: list[str],
                register: bool = True) -> DataFrame:
    """SRC-18 / QRY-01: the decrypted view as a DataFrame, optionally as the temp view ``view_id``."""
    TX.assert_safe_identifiers(fields)
    df = V.decrypted_pivot(vault, kv, fields, tenant=tenant)
    if register:
        df.createOrReplaceTempView(view_id(tenant, view_name))
    return df
