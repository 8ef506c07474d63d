"""Ghost-data scan and warehouse crawl (EXT-01, EXT-02).

The scan reads whole text columns with native regex functions (no UDF): per
(resource, column, pattern) the rows matched and the total matches, plus a
hash of every distinct match so findings carry no values. Sampling is a
documented mode (``SAMPLED``) and uses Spark's seeded ``sample``; ``FULL``
reads everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredline.functions import text as TX

# Our own detection patterns (Java regex; also valid RE2). NAME is a heuristic:
# a salutation followed by one or two capitalised words.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"\+?[0-9][0-9 ().-]{7,}[0-9]",
    "NAME": r"\b(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?",
}
CONFIDENCE = {"EMAIL": 0.98, "PHONE": 0.85, "NAME": 0.6}


def scan_columns(df: DataFrame, resource_id: str, columns: list[str], patterns: list[str] | None = None,
                 mode: str = "FULL", fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """EXT-02: one finding row per (column, pattern) with at least one hit.

    One pass over the table: every (column, pattern) count is a conditional
    aggregate in the same ``agg`` (partial aggregation map-side).
    """
    TX.assert_safe_identifiers(columns)
    pats = patterns or list(PATTERNS)
    src = df.sample(fraction=fraction, seed=seed) if mode == "SAMPLED" else df
    aggs = []
    for c in columns:
        for p in pats:
            n = F.col(f"_{c}__{p}")
            aggs.append(F.count_if(n > 0).alias(f"{c}__{p}__rows"))
            aggs.append(F.sum(n).alias(f"{c}__{p}__matches"))
    # each regex runs once per value: the match count feeds both aggregates
    counts = src.select(*[F.coalesce(F.regexp_count(F.col(c), F.lit(PATTERNS[p])), F.lit(0)).alias(f"_{c}__{p}")
                          for c in columns for p in pats])
    wide = counts.agg(*aggs)
    stacks = []
    for c in columns:
        for p in pats:
            stacks.append(F.struct(F.lit(c).alias("column"), F.lit(p).alias("pattern"),
                                   F.col(f"{c}__{p}__rows").alias("rows_matched"),
                                   F.col(f"{c}__{p}__matches").cast("bigint").alias("matches")))
    long = wide.select(F.explode(F.array(*stacks)).alias("f")).select("f.*")
    conf = F.create_map(*[x for p in pats for x in (F.lit(p), F.lit(CONFIDENCE[p]))])
    return (long.where(F.col("rows_matched") > 0)
            .select(F.lit(resource_id).alias("resource_id"), "column", "pattern", "rows_matched", "matches",
                    conf[F.col("pattern")].alias("confidence"), F.lit(mode).alias("scan_mode")))


def match_hashes(df: DataFrame, resource_id: str, column: str, pattern: str) -> DataFrame:
    """Distinct SHA-256 hashes of the matched values (evidence without the values)."""
    TX.assert_safe_identifiers([column])
    rx = PATTERNS[pattern]
    return (df.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(f"({rx})"), 1)).alias("m"))
            .select(F.sha2(F.lower("m"), 256).alias("value_hash")).distinct()
            .select(F.lit(resource_id).alias("resource_id"), F.lit(column).alias("column"),
                    F.lit(pattern).alias("pattern"), "value_hash"))


def ghost_events(findings: DataFrame, now: Column, tenant: str) -> DataFrame:
    """Findings as GHOST_DATA lineage events (user UNKNOWN: resource level), metadata only."""
    ctx = F.to_json(F.struct(F.lit("GHOST_DATA").alias("data_classification"), "resource_id",
                             F.col("column").alias("column"), "pattern", F.col("rows_matched").alias("count"),
                             "confidence", F.lit("ghost-data-scanner").alias("scanner")))
    return findings.select(
        F.expr("uuid()").alias("event_id"), F.lit(tenant).alias("tenant_id"), F.lit("UNKNOWN").alias("user_id"),
        F.lit("ghost-data-scanner").alias("source"), F.col("resource_id").alias("destination"),
        now.alias("timestamp"), ctx.alias("context"), F.lit(None).cast("string").alias("metadata"),
        F.lit("GHOST_DATA").alias("data_classification"))


def crawl(inventory: DataFrame, previous: DataFrame | None, registry: DataFrame,
          pii_columns: DataFrame | None = None) -> DataFrame:
    """EXT-01: compare the column inventory with the registry and the previous crawl.

    ``inventory`` / ``previous``: (resource_id, column_name, data_type).
    ``pii_columns``: (resource_id, column) with detected personal data.
    Status per resource: UNREGISTERED (no entry), DRIFTED (entry exists but
    PII columns are undeclared, or columns were added / removed / retyped
    since the previous crawl), REGISTERED otherwise.
    """
    spark = inventory.sparkSession
    prev = previous if previous is not None else spark.createDataFrame(
        [], "resource_id string, column_name string, data_type string")
    cols = (inventory.select("resource_id", "column_name", F.col("data_type").alias("_now"))
            .join(prev.select("resource_id", "column_name", F.col("data_type").alias("_prev")),
                  ["resource_id", "column_name"], "full_outer"))
    had_prev = prev.select("resource_id").distinct().withColumn("_seen", F.lit(True))
    cols = cols.join(had_prev, "resource_id", "left")
    declared = registry.select("resource_id", F.explode("pii_fields.name").alias("column_name")).distinct() \
        .withColumn("_declared", F.lit(True))
    cols = cols.join(declared, ["resource_id", "column_name"], "left")
    if pii_columns is not None:
        cols = cols.join(pii_columns.select("resource_id", F.col("column").alias("column_name"))
                         .distinct().withColumn("_pii", F.lit(True)), ["resource_id", "column_name"], "left")
    else:
        cols = cols.withColumn("_pii", F.lit(None).cast("boolean"))
    per = cols.groupBy("resource_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_seen").isNotNull() & F.col("_prev").isNull(), F.col("column_name"))))
        .alias("new_columns"),
        F.array_sort(F.collect_list(F.when(F.col("_now").isNull(), F.col("column_name")))).alias("missing_columns"),
        F.array_sort(F.collect_list(F.when(F.col("_now").isNotNull() & F.col("_prev").isNotNull()
                                           & (F.col("_now") != F.col("_prev")), F.col("column_name"))))
        .alias("type_changed"),
        F.array_sort(F.collect_list(F.when(F.col("_pii") & F.col("_declared").isNull() & F.col("_now").isNotNull(),
                                           F.col("column_name")))).alias("undeclared_pii"))
    entries = registry.select("resource_id").distinct().withColumn("_entry", F.lit(True))
    per = per.join(entries, "resource_id", "left")
    drift = ((F.size("new_columns") > 0) | (F.size("missing_columns") > 0) | (F.size("type_changed") > 0)
             | (F.size("undeclared_pii") > 0))
    status = F.when(F.col("_entry").isNull(), "UNREGISTERED").when(drift, "DRIFTED").otherwise("REGISTERED")
    return per.select("resource_id", status.alias("registry_status"), "new_columns", "missing_columns",
                      "type_changed", "undeclared_pii")


def crawl_events(findings: DataFrame, now: Column, tenant: str) -> DataFrame:
    """WAREHOUSE_METADATA_DISCOVERED events (column names only, never values)."""
    cols = F.array_union("new_columns", "undeclared_pii")
    ctx = F.to_json(F.struct(F.lit("WAREHOUSE_METADATA_DISCOVERED").alias("event_type"), "resource_id",
                             "registry_status", cols.alias("new_columns")))
    return findings.select(
        F.expr("uuid()").alias("event_id"), F.lit(tenant).alias("tenant_id"), F.lit("UNKNOWN").alias("user_id"),
        F.lit("warehouse-metadata-crawler").alias("source"), F.col("resource_id").alias("destination"),
        now.alias("timestamp"), ctx.alias("context"), F.lit(None).cast("string").alias("metadata"),
        F.lit("METADATA").alias("data_classification"))
