"""Engine tables derived from the driver's Parquet tables.

Each simple fixture is a list of SQL expressions over one driver table. The
same expressions run in Spark (``selectExpr``, so the scan only reads the
columns they touch) and, as CTE text, in the DuckDB oracle: one definition,
two engines. Fixtures that need crypto (key registry, vault) are built by the
engine's own operators from these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shredline.sources.tables import read_table

# Fixed instants used by the fixtures (UTC).
BASE_TS = "2026-01-01 00:00:00"
SYNC_OLD_TS = "2026-01-01 00:00:00"
SYNC_NEW_TS = "2026-01-02 00:00:00"
SYNC_JUNK_TS = "2026-01-03 00:00:00"
KEYGEN_TS = "2025-12-01 00:00:00"
SHRED_TS = "2026-02-01 00:00:00"
NOW_TS = "2026-06-01 00:00:00"

_LAYER_ID = "CAST(floor(p_partkey / 4) AS bigint)"

FIXTURES: dict[str, tuple[str, list[str]]] = {
    "users": ("customer", [
        "concat('tenant-', c_custkey % 3) AS tenant_id",
        "concat('user-', c_custkey) AS user_id",
        "concat(lower(replace(c_name, '#', '.')), '@example.com') AS email",
        "concat('+1-555-', lpad(CAST(c_custkey AS string), 7, '0')) AS phone",
        "c_mktsegment AS segment",
        "c_custkey AS custkey",
    ]),
    "lineage_events": ("events", [
        "concat('ev-', event_id) AS event_id",
        "concat('tenant-', user_id % 3) AS tenant_id",
        "CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'UNKNOWN' ELSE concat('user-', user_id) END AS user_id",
        "CASE event_type WHEN 'error' THEN 'ghost-data-scanner' WHEN 'view' THEN 'bigquery_metadata_crawler' "
        "ELSE 'api-ingestion' END AS source",
        "CASE event_type WHEN 'purchase' THEN 'hubspot' WHEN 'click' THEN 'salesforce' WHEN 'signup' THEN 'segment' "
        "ELSE concat('bigquery:proj.ds.table_', event_id % 20) END AS destination",
        "CAST(ts AS timestamp) AS timestamp",
        "CASE event_type "
        "WHEN 'error' THEN concat('{\"data_classification\":\"GHOST_DATA\",\"resource_id\":\"bigquery:proj.ds.table_', "
        "event_id % 20, '\",\"column\":\"email\",\"pattern\":\"EMAIL\",\"count\":', event_id % 5, ',\"confidence\":0.9}') "
        "WHEN 'view' THEN concat('{\"event_type\":\"WAREHOUSE_METADATA_DISCOVERED\",\"resource_id\":\"bigquery:proj.ds.table_', "
        "event_id % 20, '\",\"registry_status\":\"', CASE event_id % 3 WHEN 0 THEN 'UNREGISTERED' WHEN 1 THEN 'DRIFTED' "
        "ELSE 'REGISTERED' END, '\",\"new_columns\":[\"email\",\"col_', event_id % 4, '\"]}') "
        "ELSE '{\"event_type\":\"DATA_MOVEMENT\"}' END AS context",
        "CAST(NULL AS string) AS metadata",
        "CAST(NULL AS string) AS data_classification",
    ]),
    "deletion_requests": ("orders", [
        "concat('req-', o_orderkey) AS deletion_request_id",
        "concat('tenant-', o_custkey % 3) AS tenant_id",
        "concat('user-', o_custkey) AS user_id",
        "CASE o_orderkey % 7 WHEN 0 THEN 'SHRED_REQUESTED' WHEN 1 THEN 'KEY_DESTROYED' WHEN 2 THEN 'CASCADE_PENDING' "
        "WHEN 3 THEN 'CASCADE_IN_PROGRESS' WHEN 4 THEN 'CASCADE_PARTIAL_FAILURE' WHEN 5 THEN 'CASCADE_COMPLETE' "
        "ELSE 'CERTIFICATE_ISSUED' END AS status",
        "CAST(o_orderdate AS timestamp) AS created_at",
        "concat('analyst-', o_orderkey % 5, '@example.com') AS requested_by",
        "o_orderkey AS orderkey",
    ]),
    "wipes": ("lineitem", [
        "concat('req-', l_orderkey) AS deletion_request_id",
        "CASE l_linenumber % 3 WHEN 0 THEN 'hubspot' WHEN 1 THEN 'salesforce' "
        "ELSE 'bigquery:proj.ds.users::REDACT_IN_PLACE' END AS destination",
        "CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status",
        "CAST(l_quantity AS bigint) % 4 AS records_found",
        "CAST(l_shipdate AS timestamp) AS updated_at",
        "l_linenumber AS linenumber",
    ]),
    "registry_rows": ("part", [
        f"concat('bigquery:proj.ds.', CASE {_LAYER_ID} % 3 WHEN 0 THEN 'mart_' WHEN 1 THEN 'stg_' ELSE 'raw_' END, "
        f"{_LAYER_ID}) AS resource_id",
        f"concat(CASE {_LAYER_ID} % 3 WHEN 0 THEN 'mart_' WHEN 1 THEN 'stg_' ELSE 'raw_' END, {_LAYER_ID}) AS model_name",
        "'bigquery' AS system",
        f"CASE {_LAYER_ID} % 3 WHEN 0 THEN 'MART' WHEN 1 THEN 'STAGING' ELSE 'RAW' END AS resource_layer",
        "'dbt' AS owner",
        "concat('field_', p_partkey % 4) AS field_name",
        "CASE p_size % 6 WHEN 0 THEN 'DIRECT_IDENTIFIER' WHEN 1 THEN 'QUASI_IDENTIFIER' WHEN 2 THEN 'CONTACT' "
        "WHEN 3 THEN 'SENSITIVE' WHEN 4 THEN 'BEHAVIORAL' ELSE 'SYSTEM_IDENTIFIER' END AS classification",
        "CASE p_partkey % 5 WHEN 0 THEN 'TOKENIZE' WHEN 1 THEN 'HASH_SURROGATE' WHEN 2 THEN 'MANUAL_REVIEW' "
        "ELSE 'ENCRYPT' END AS handling",
        "'DECLARED' AS confidence",
        "'DECLARED' AS detection_method",
        "false AS required_in_mart",
        "'2026-01-01' AS registry_version",
    ]),
    "field_lineage": ("part", [
        f"concat('bigquery:proj.ds.', CASE {_LAYER_ID} % 3 WHEN 0 THEN 'mart_' WHEN 1 THEN 'stg_' ELSE 'raw_' END, "
        f"{_LAYER_ID}) AS source_resource_id",
        "concat('field_', p_partkey % 4) AS field_name",
        "concat('int_model_', p_partkey % 17) AS downstream_model",
        "CAST(1 + p_size % 3 AS bigint) AS hops",
    ]),
    # Manual declarations as they arrive from users: valid and invalid ones, repeats per resource.
    "declarations": ("supplier", [
        "s_suppkey AS decl_id",
        "CASE WHEN s_suppkey % 17 = 0 THEN '' ELSE concat('tenant-', s_suppkey % 3) END AS tenant_id",
        "CASE WHEN s_suppkey % 13 = 0 THEN concat('BigQuery:', s_name) "
        "WHEN s_suppkey % 2 = 0 THEN concat('bigquery:proj.ds.table_', s_suppkey % 25) "
        "ELSE concat('bigquery:proj.crm.', CASE WHEN s_suppkey % 4 = 1 THEN 'mart_' ELSE '' END, 'contacts_', "
        "s_suppkey % 25) END AS resource_id",
        "CASE s_suppkey % 9 WHEN 0 THEN 'snowflake' WHEN 1 THEN 'mainframe' ELSE 'bigquery' END AS system",
        "CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'RAW' WHEN 2 THEN 'MART' WHEN 3 THEN 'STAGING' "
        "WHEN 4 THEN 'GOLD' ELSE 'SAAS' END AS resource_layer",
        "CASE WHEN s_suppkey % 10 = 3 THEN 'PUBLIC' END AS visibility",
        "CASE s_suppkey % 8 WHEN 0 THEN 'user_id' WHEN 1 THEN NULL ELSE 'tenant_id' END AS tenant_id_column",
        "CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE 'user_id' END AS user_id_column",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'updated_at' END AS updated_at_column",
        "CASE s_suppkey % 5 WHEN 0 THEN 'MANUAL_REVIEW' WHEN 1 THEN 'DELETE_ROWS' WHEN 2 THEN NULL "
        "ELSE 'CRYPTO_SHRED' END AS deletion_strategy",
        "CASE s_suppkey % 7 WHEN 0 THEN 'REDACT_IN_PLACE' WHEN 1 THEN 'NONE' WHEN 2 THEN 'SHADOW_COPY' "
        "WHEN 3 THEN 'ERASE' END AS source_redaction_strategy",
        "CASE s_suppkey % 11 WHEN 0 THEN 'ENCRYPTED_COPY' WHEN 1 THEN 'REDACT_IN_PLACE,ENCRYPTED_COPY' "
        "WHEN 2 THEN 'NONE' WHEN 3 THEN '' END AS source_redaction_strategies",
        "CASE WHEN s_suppkey % 12 = 0 THEN 'ARCHIVED' WHEN s_suppkey % 3 = 0 THEN 'APPROVED' END AS status",
        "CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE concat('email:', CASE WHEN s_suppkey % 4 = 0 "
        "THEN 'DIRECT_IDENTIFIER' ELSE 'CONTACT' END, ':', CASE s_suppkey % 3 WHEN 0 THEN 'ENCRYPT' "
        "WHEN 1 THEN 'MANUAL_REVIEW' ELSE 'TOKENIZE' END, ';phone:', CASE WHEN s_suppkey % 14 = 0 THEN 'PHONE' "
        "ELSE 'CONTACT' END, ':ENCRYPT') END AS fields_spec",
        "s_suppkey % 4 <> 1 AS scan_enabled",
        "CASE WHEN s_suppkey % 15 = 0 THEN 'ALWAYS' END AS scan_mode",
        "CAST(concat('2026-08-', lpad(CAST(1 + s_suppkey % 28 AS string), 2, '0'), ' 00:00:00') AS timestamp) "
        "AS declared_at",
        "CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE concat('analyst-', s_suppkey % 4, '@example.com') END AS actor",
    ]),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, exprs = FIXTURES[name]
    return read_table(spark, sf_dir, table).selectExpr(*exprs)


def fixture_sql(name: str) -> str:
    """The same fixture as SQL text (for the DuckDB oracle's CTEs)."""
    table, exprs = FIXTURES[name]
    return f"SELECT {', '.join(exprs)} FROM {table}"


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations with parsed field specs and strategy arrays (for the registry operators)."""
    from shredline.operators.registry import parse_fields, parse_strategies
    d = fixture(spark, sf_dir, "declarations")
    return (d.withColumn("fields", parse_fields("fields_spec"))
            .withColumn("source_redaction_strategies", parse_strategies("source_redaction_strategies")))


def tenant_keys(users: DataFrame) -> DataFrame:
    """Test key material per tenant, derived from the tenants present in the data.

    Production tenant keys come from a key service; for compared queries a
    tenant's key-encryption, token and signing keys are SHA-256 of a seed string.
    """
    return (users.select("tenant_id").distinct()
            .withColumn("kek", F.unhex(F.sha2(F.concat(F.lit("kek-"), F.col("tenant_id")), 256)))
            .withColumn("token_key", F.unhex(F.sha2(F.concat(F.lit("token-"), F.col("tenant_id")), 256)))
            .withColumn("sign_key", F.unhex(F.sha2(F.concat(F.lit("sign-"), F.col("tenant_id")), 256))))


def shred_requests(users: DataFrame) -> DataFrame:
    """Users who asked to be erased in the fixture scenario (every 7th customer)."""
    return users.where(F.col("custkey") % 7 == 0).select("tenant_id", "user_id")


def ts(value: str):
    return F.to_timestamp(F.lit(value))
