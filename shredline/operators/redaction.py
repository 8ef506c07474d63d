"""Source-table redaction strategies (QRY-02, QRY-03, SRC-17, WIN-02, STA-10, STA-11).

Requested users are a (tenant, user) DataFrame; whether it is broadcast is left
to the size that AQE measures, so a large erasure batch still works. Row rewrites are copy-on-write: the caller
writes the returned DataFrame as the new version of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shredline.functions.text import assert_safe_identifiers
from shredline.session import ensure_checkpoint_dir


@dataclass
class Rewrite:
    table: DataFrame       # the new table content
    affected: DataFrame    # one row: rows_affected


def _targets(users: DataFrame, user_col: str, tenant_col: str | None) -> tuple[DataFrame, list]:
    cols = [F.col("user_id").alias(user_col)]
    on = [user_col]
    if tenant_col:
        cols.append(F.col("tenant_id").alias(tenant_col))
        on.append(tenant_col)
    return users.select(*cols).dropDuplicates(on).withColumn("_hit", F.lit(True)), on


def shadow_copy(source: DataFrame, fields: list[str], pivot: DataFrame, user_col: str,
                tenant_col: str | None = None, tenant: str | None = None) -> DataFrame:
    """JOIN-01 / QRY-02: source without its PII columns plus the decrypted pivot per user.

    With a tenant column the join also matches the tenant (and an explicit
    ``tenant`` restricts the source to it, pushed to the scan).
    """
    assert_safe_identifiers([user_col, tenant_col, *fields])
    src = source if tenant is None or not tenant_col else source.where(F.col(tenant_col) == tenant)
    piv = pivot.select(F.col("user_id").alias(user_col),
                       *([F.col("tenant_id").alias(tenant_col)] if tenant_col else []), *fields)
    on = [user_col] + ([tenant_col] if tenant_col else [])
    return src.drop(*fields).join(piv, on, "left")


def encrypted_copy_schema(source: DataFrame, fields: list[str]) -> DataFrame:
    """SRC-17: zero-row raw table: source columns, PII columns as strings, plus synced_at."""
    assert_safe_identifiers(fields)
    return (source.drop(*fields)
            .select("*", *[F.lit(None).cast("string").alias(f) for f in fields],
                    F.lit(None).cast("timestamp").alias("synced_at"))
            .limit(0))


def widen(raw: DataFrame, schema_df: DataFrame) -> DataFrame:
    """SRC-17 second half: add newly declared columns to an existing raw table without loss."""
    return raw.unionByName(schema_df, allowMissingColumns=True)


def encrypted_copy_view(raw: DataFrame, user_col: str, tenant_col: str | None = None) -> DataFrame:
    """WIN-02: dedup view of the raw copy, newest ``synced_at`` per user (per tenant and user with a tenant column).

    Rows of the same time are told apart by their other columns, so the choice is fixed.
    """
    keys = [c for c in (tenant_col, user_col) if c]
    rest = sorted(c for c in raw.columns if c not in (*keys, "synced_at"))
    w = Window.partitionBy(*keys).orderBy(F.col("synced_at").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rest])
    return raw.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def redact_in_place(table: DataFrame, fields: list[str], users: DataFrame, user_col: str,
                    tenant_col: str | None = None) -> Rewrite:
    """STA-10: set the declared PII columns to NULL on the requested users' rows."""
    assert_safe_identifiers([user_col, tenant_col, *fields])
    if not fields:
        raise ValueError("Resource has no declared piiFields to redact.")
    targets, on = _targets(users, user_col, tenant_col)
    j = table.join(targets, on, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = j.select(*[F.when(hit, F.lit(None).cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                     if c in fields else F.col(c) for c in table.columns])
    affected = j.agg(F.count_if(hit).alias("rows_affected"))
    return Rewrite(out, affected)


def delete_users(table: DataFrame, users: DataFrame, user_col: str, tenant_col: str | None = None) -> Rewrite:
    """STA-11: remove the requested users' rows (real delete of ciphertext)."""
    assert_safe_identifiers([user_col, tenant_col])
    targets, on = _targets(users, user_col, tenant_col)
    out = table.join(targets.drop("_hit"), on, "left_anti")
    affected = table.join(targets.drop("_hit"), on, "left_semi").agg(F.count(F.lit(1)).alias("rows_affected"))
    return Rewrite(out, affected)


@dataclass
class StoredTable:
    """A stored table that holds users' data, as a destination of the cascade.

    ``destination``: ``{resource_id}::{strategy}`` of a declared resource or the name of a system;
    ``fields``: the columns to NULL; without them the users' rows are removed.
    """
    destination: str
    path: str
    partition_by: str
    user_col: str
    tenant_col: str | None = None
    fields: list[str] | None = None


def erase_and_count(spark, table: StoredTable, users: DataFrame) -> DataFrame:
    """``erase_stored`` for a StoredTable; returns the rows affected of every user that had any.

    The counts are checkpointed before a file changes.
    """
    ensure_checkpoint_dir(spark)
    targets, on = _targets(users, table.user_col, table.tenant_col)
    counts = (spark.read.parquet(table.path).join(targets, on).groupBy(*on).agg(F.count(F.lit(1)).alias("rows_affected"))
              .withColumnsRenamed({table.user_col: "user_id"} | ({table.tenant_col: "tenant_id"} if table.tenant_col else {}))
              .checkpoint())
    erase_stored(spark, table.path, table.partition_by, users, table.user_col, table.tenant_col, table.fields)
    return counts


def erase_stored(spark, path: str, partition_by: str, users: DataFrame, user_col: str, tenant_col: str | None = None,
                 fields: list[str] | None = None) -> int:
    """STA-10 / STA-11 on a stored table: NULL the ``fields`` of the users' rows, or remove the rows without ``fields``.

    Only the partitions (of ``partition_by``, e.g. a bucket of the user id) that hold a requested user are
    rewritten, by dynamic partition overwrite; all other partitions keep their files. A partition that loses
    all its rows is removed. Returns the number of rows affected. Counting reads the key columns alone.
    """
    table = spark.read.parquet(path)
    targets, on = _targets(users, user_col, tenant_col)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    hit = (table.withColumn("_folder", folder).join(targets, on, "left").groupBy(partition_by)
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_hit")).alias("hits"), F.collect_set("_folder").alias("folders"))
           .where("hits > 0").collect())
    if not hit:
        return 0
    gone = [r for r in hit if not fields and r["hits"] == r["n"]]
    left = [r[partition_by] for r in hit if r not in gone]
    if left:
        match = F.col(partition_by).isin([v for v in left if v is not None])
        own = table.where(match | F.col(partition_by).isNull() if None in left else match)
        new = (redact_in_place(own, fields, users, user_col, tenant_col) if fields
               else delete_users(own, users, user_col, tenant_col)).table
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)
    for name in (f for r in gone for f in r["folders"]):       # as URIs, so null and escaped values are found
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True):
            raise OSError(f"partition {name} was not deleted")
    return sum(r["hits"] for r in hit)
