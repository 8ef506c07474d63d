"""Explicit schemas of the engine's state tables and fixed enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, TS, BIN = (T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(),
                       T.TimestampType(), T.BinaryType())


def struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


KEY_REGISTRY = struct(
    ("tenant_id", S), ("user_id", S), ("deks", T.MapType(S, BIN)), ("active_dek_id", S),
    ("status", S), ("created_at", TS), ("shred_at", TS), ("rotated_at", TS),
    ("encryption_version", S), ("token_algorithm", S), ("token_key_id", S),
    ("deletion_request_id", S), ("destinations", T.ArrayType(S)),
)

TENANT_KEYS = struct(("tenant_id", S), ("kek", BIN), ("token_key", BIN))

PII_VAULT = struct(
    ("tenant_id", S), ("user_id", S), ("resource_id", S), ("field_name", S), ("key_id", S),
    ("token", S), ("encrypted_value", S), ("synced_at", TS),
)

LINEAGE_EVENTS = struct(
    ("event_id", S), ("tenant_id", S), ("user_id", S), ("source", S), ("destination", S),
    ("timestamp", TS), ("context", S), ("metadata", S), ("data_classification", S),
)

REGISTRY_ROWS = struct(
    ("resource_id", S), ("model_name", S), ("system", S), ("resource_layer", S), ("owner", S),
    ("field_name", S), ("classification", S), ("handling", S), ("confidence", S),
    ("detection_method", S), ("required_in_mart", B), ("registry_version", S),
)

FIELD_LINEAGE = struct(("source_resource_id", S), ("field_name", S), ("downstream_model", S), ("hops", L))

PII_FIELD = struct(("name", S), ("classification", S), ("handling", S), ("required_in_mart", B),
                   ("confidence", S), ("evidence", T.ArrayType(S)))

GHOST_SCAN = struct(("enabled", B), ("scan_mode", S), ("patterns", T.ArrayType(S)))

REGISTRY_ENTRY = struct(
    ("registry_version", S), ("resource_id", S), ("system", S), ("resource_layer", S),
    ("visibility", S), ("tenant_id_column", S), ("user_id_column", S), ("updated_at_column", S),
    ("last_synced_at", TS), ("last_sync_attempt_at", TS), ("pii_fields", T.ArrayType(PII_FIELD)),
    ("owner_connector", S), ("lineage_destination", S), ("deletion_strategy", S),
    ("source_redaction_strategy", S), ("source_redaction_strategies", T.ArrayType(S)),
    ("ghost_data_scan", GHOST_SCAN), ("handling_policy", S), ("evidence_pointers", T.ArrayType(S)),
    ("notes", S), ("tenant_id", S), ("status", S), ("created_at", TS), ("updated_at", TS),
    ("declared_by", S), ("last_modified_by", S),
)

WIPE = struct(("destination", S), ("status", S), ("attempts", L), ("records_found", L),
              ("rows_affected", L), ("error", S), ("updated_at", TS))

STATUS_EVENT = struct(("status", S), ("at", TS), ("operation_id", S))

DELETION_REQUEST = struct(
    ("deletion_request_id", S), ("tenant_id", S), ("user_id", S), ("status", S), ("created_at", TS),
    ("updated_at", TS), ("status_history", T.ArrayType(STATUS_EVENT)), ("janitor_wipes", T.ArrayType(WIPE)),
    ("key_destroyed_at", TS), ("cascade_initiated_at", TS), ("certificate_issued_at", TS),
    ("certificate_path", S), ("requested_by", S), ("operation_id", S),
)

CHAIN_HEAD = struct(("tenant_id", S), ("sequence", L), ("last_hash", S), ("last_deletion_request_id", S))

# --- fixed enumerations (values equal the reference's) ---------------------------
# Deletion request states and the allowed transitions between them.
DELETION_STATES = [
    "SHRED_REQUESTED", "KEY_DESTROYED", "CASCADE_PENDING", "CASCADE_IN_PROGRESS",
    "CASCADE_PARTIAL_FAILURE", "CASCADE_COMPLETE", "CERTIFICATE_ISSUED",
]
TRANSITIONS = {
    "SHRED_REQUESTED": ["KEY_DESTROYED", "CASCADE_PARTIAL_FAILURE"],
    "KEY_DESTROYED": ["CASCADE_PENDING", "CASCADE_COMPLETE", "CERTIFICATE_ISSUED", "CASCADE_PARTIAL_FAILURE"],
    "CASCADE_PENDING": ["CASCADE_IN_PROGRESS", "CASCADE_COMPLETE", "CASCADE_PARTIAL_FAILURE"],
    "CASCADE_IN_PROGRESS": ["CASCADE_COMPLETE", "CASCADE_PARTIAL_FAILURE"],
    "CASCADE_PARTIAL_FAILURE": ["CASCADE_IN_PROGRESS", "SHRED_REQUESTED"],
    "CASCADE_COMPLETE": ["CERTIFICATE_ISSUED", "CASCADE_PARTIAL_FAILURE"],
    "CERTIFICATE_ISSUED": [],
}
ACTIVE_REQUEST_STATES = ["SHRED_REQUESTED", "KEY_DESTROYED", "CASCADE_PENDING", "CASCADE_IN_PROGRESS",
                         "CASCADE_PARTIAL_FAILURE"]
COMPLETED_REQUEST_STATES = ["CASCADE_COMPLETE", "CERTIFICATE_ISSUED"]

# Registered wipe connectors (destination types the janitor can wipe), lower case.
CONNECTORS = ["hubspot", "salesforce"]

# Stores made unreadable by key erasure, as stated in a deletion plan.
ERASURE_STORES = ["bigquery", "gcs-landing-zone", "firestore-logs"]

DEFAULT_TENANT = "default-tenant"
