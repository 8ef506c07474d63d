"""PII registry: which resources hold personal data, and how each is handled.

Entries are rows of ``schemas.REGISTRY_ENTRY`` with nested ``pii_fields``.
The registry is metadata (one row per resource), so its operators are plain
DataFrame transformations; the only joins against data-sized tables happen
in coverage / discovery (findings) and they are equi-joins on resource_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shredline import schemas
from shredline.functions import text as TX
from shredline.functions import validation as VAL

GLOBAL = "*"
MANUAL = "manual"

# Fixed enumerations of declarations (values equal the reference's, plus 'snowflake',
# which the reference types allow but its validation rejects; we accept it).
SYSTEMS = ["bigquery", "snowflake", "gcs", "firestore", "log", "hubspot", "salesforce", "external"]
CLASSIFICATIONS = ["DIRECT_IDENTIFIER", "QUASI_IDENTIFIER", "CONTACT", "SENSITIVE", "BEHAVIORAL", "SYSTEM_IDENTIFIER"]
HANDLINGS = ["ENCRYPT", "TOKENIZE", "REDACT", "HASH_SURROGATE", "ALLOW_AGGREGATE_ONLY", "MANUAL_REVIEW"]
DELETION_STRATEGIES = ["CRYPTO_SHRED", "DELETE_ROWS", "REDACT_FIELDS", "EXTERNAL_WIPE", "MANUAL_REVIEW"]
SOURCE_REDACTION_STRATEGIES = ["NONE", "REDACT_IN_PLACE", "SHADOW_COPY", "ENCRYPTED_COPY"]
SOURCE_REDACTION_ARRAY_STRATEGIES = ["REDACT_IN_PLACE", "SHADOW_COPY", "ENCRYPTED_COPY"]
LAYERS = ["RAW", "STAGING", "INTERMEDIATE", "MART", "SAAS"]
VISIBILITIES = ["CUSTOMER_FACING", "INTERNAL"]
STATUSES = ["APPROVED", "PENDING_REVIEW", "DEPRECATED", "DISABLED"]
SCAN_MODES = ["FULL", "SAMPLED", "DISABLED"]
DEFAULT_SCAN_PATTERNS = ["EMAIL", "PHONE", "NAME"]
# Severity order of classifications, most → least sensitive.
CLASSIFICATION_SEVERITY = ["DIRECT_IDENTIFIER", "SENSITIVE", "CONTACT", "QUASI_IDENTIFIER", "BEHAVIORAL",
                           "SYSTEM_IDENTIFIER"]

# Declaration error messages (wording equals the reference's; {…} are filled in).
DECLARATION_MESSAGES = {
    "tenant": "tenantId is required (pass it via the x-tenant-id header).",
    "resource": "resourceId is required.",
    "resource_shape": 'resourceId must be a URI-like value such as "bigquery:project.dataset.table" or "gcs:bucket/prefix".',
    "one_of": "{field} must be one of: {values}.",
    "array_item": ("sourceRedactionStrategies[{i}] must be one of: {values} "
                   "('NONE' is not valid inside the array -- send an empty array for none)."),
    "user_column": ("userIdColumn is required when sourceRedactionStrategies is non-empty "
                    "(REDACT_IN_PLACE, SHADOW_COPY, and ENCRYPTED_COPY all need it)."),
    "same_column": "userIdColumn and tenantIdColumn cannot be the same column.",
    "no_fields": "piiFields must contain at least one field.",
    "field_name": "piiFields[{i}].name is required.",
    "field_one_of": "piiFields[{i}].{attr} must be one of: {values}.",
    "view_redaction": "REDACT_IN_PLACE cannot be declared on a view; use SHADOW_COPY or ENCRYPTED_COPY.",
}

ENTRY_COLS = schemas.REGISTRY_ENTRY.fieldNames()


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def blank(c) -> Column:
    """True for NULL or whitespace-only text (the reference's "not a non-empty string")."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.length(F.trim(c)) == 0)


def conform(df: DataFrame) -> DataFrame:
    """Select the entry columns in schema order, adding missing ones as NULL."""
    cols = []
    for f in schemas.REGISTRY_ENTRY.fields:
        cols.append(F.col(f.name).cast(f.dataType) if f.name in df.columns else _null(f.dataType.simpleString()).alias(f.name))
    return df.select(*[c.alias(f.name) for c, f in zip(cols, schemas.REGISTRY_ENTRY.fields)])


# --- AGG-04 / JOIN-04: flat dbt rows + lineage → entries ---------------------------------

def assemble(rows: DataFrame, lineage: DataFrame) -> DataFrame:
    """Group flat registry rows into entries, attach lineage pointers, derive layer policies.

    Resource-level columns are constant per resource in the source; ``min``
    picks them deterministically. Fields are ordered by name.
    """
    fields = rows.groupBy("resource_id").agg(
        F.min("model_name").alias("model_name"), F.min("system").alias("system"),
        F.min("resource_layer").alias("resource_layer"), F.min("owner").alias("owner"),
        F.min("registry_version").alias("registry_version"),
        F.array_sort(F.collect_list(F.struct(
            F.col("field_name").alias("name"), "classification", "handling",
            F.coalesce(F.col("required_in_mart"), F.lit(False)).alias("required_in_mart"),
            "confidence",
            F.array(F.concat(F.lit("dbt:detection:"), F.col("detection_method"))).alias("evidence"),
        ))).alias("pii_fields"))
    pointers = lineage.groupBy(F.col("source_resource_id").alias("resource_id")).agg(
        F.array_sort(F.collect_list(F.concat(
            F.lit("lineage:used_in="), F.col("downstream_model"), F.lit(":"), F.col("field_name"),
            F.lit("@"), F.col("hops").cast("string"), F.lit("hops")))).alias("lineage_pointers"))
    j = fields.join(pointers, "resource_id", "left")
    layer = F.coalesce(F.nullif(F.col("resource_layer"), F.lit("")), F.lit("UNKNOWN"))
    no_scan = layer.isin("RAW", "SAAS")
    out = j.select(
        "registry_version", "resource_id",
        F.coalesce(F.col("system"), F.lit("bigquery")).alias("system"),
        layer.alias("resource_layer"),
        F.when(layer == "RAW", "INTERNAL").otherwise("CUSTOMER_FACING").alias("visibility"),
        F.lit("tenant_id").alias("tenant_id_column"), F.lit("user_id").alias("user_id_column"),
        "pii_fields",
        F.coalesce(F.nullif(F.col("owner"), F.lit("")), F.lit("dbt")).alias("owner_connector"),
        F.col("resource_id").alias("lineage_destination"),
        F.when(layer == "MART", "MANUAL_REVIEW").otherwise("CRYPTO_SHRED").alias("deletion_strategy"),
        F.when(no_scan, F.struct(F.lit(False).alias("enabled"), F.lit("DISABLED").alias("scan_mode"),
                                 F.array().cast("array<string>").alias("patterns")))
         .otherwise(F.struct(F.lit(True).alias("enabled"), F.lit("SAMPLED").alias("scan_mode"),
                             F.array(*[F.lit(p) for p in DEFAULT_SCAN_PATTERNS]).alias("patterns")))
         .alias("ghost_data_scan"),
        F.concat(F.lower(layer), F.lit("_auto_registry")).alias("handling_policy"),
        F.concat(F.array(F.concat(F.lit("dbt:model:"), F.col("model_name"))),
                 F.coalesce(F.col("lineage_pointers"), F.array().cast("array<string>"))).alias("evidence_pointers"),
        F.lit("Generated from warehouse metadata by the registry build.").alias("notes"),
    )
    return conform(out)


# --- SET-01 / SET-02: federation ------------------------------------------------------------

def compose(connector: DataFrame, dbt: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Connector entries (minus dbt-owned when a dbt slice exists) ∪ dbt ∪ manual; manual wins.

    The last-wins index is keyed by (tenant or ``*``, resource_id): manual
    entries carry a tenant, so they coexist with global entries of the same id.
    """
    dbt_present = not dbt.isEmpty()
    platform = connector.where(~F.col("owner_connector").eqNullSafe("dbt")) if dbt_present else connector
    parts = [conform(platform).withColumn("_rank", F.lit(0))]
    if dbt_present:
        parts.append(conform(dbt).withColumn("_rank", F.lit(1)))
    if manual is not None:
        parts.append(conform(manual).withColumn("_rank", F.lit(2)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy(F.coalesce(F.col("tenant_id"), F.lit(GLOBAL)), F.col("resource_id")).orderBy(
        F.col("_rank").desc(), F.col("updated_at").desc_nulls_last(), F.col("owner_connector").desc())
    return u.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_rank")


# --- FIL-01..09 -------------------------------------------------------------------------------

def visible_to(tenant: str | None) -> Column:
    """FIL-01: global entries and the tenant's own; no tenant → everything."""
    if tenant is None:
        return F.lit(True)
    return F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant)


def list_entries(reg: DataFrame, tenant: str | None = None, system: str | None = None,
                 owner: str | None = None, scan_enabled: bool | None = None,
                 actor: str | None = None) -> DataFrame:
    """FIL-02."""
    out = reg.where(visible_to(tenant))
    if system:
        out = out.where(F.col("system") == system)
    if owner:
        out = out.where(F.col("owner_connector") == owner)
    if scan_enabled is not None:
        out = out.where(F.col("ghost_data_scan.enabled") == F.lit(scan_enabled))
    if actor:
        out = out.where((F.col("declared_by") == actor) | (F.col("last_modified_by") == actor))
    return out


def lookup(requests: DataFrame, reg: DataFrame) -> DataFrame:
    """FIL-03 set-wise: (request_id, resource_id, tenant_id?) → the entry by precedence.

    With a tenant: own entry, then global. Without: global, then any (lowest
    tenant id for determinism). Requests without a match get no row.
    """
    r = requests.select("request_id", "resource_id", F.col("tenant_id").alias("_req_tenant"))
    j = r.join(reg, "resource_id", "inner")
    rank = (F.when(F.col("_req_tenant").isNotNull(),
                   F.when(F.col("tenant_id") == F.col("_req_tenant"), 0).when(F.col("tenant_id").isNull(), 1))
            .otherwise(F.when(F.col("tenant_id").isNull(), 0).otherwise(1)))
    j = j.withColumn("_prec", rank).where(F.col("_prec").isNotNull())
    w = Window.partitionBy("request_id").orderBy("_prec", F.col("tenant_id").asc_nulls_first())
    return j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_prec", "_req_tenant")


def by_lineage_destination(destinations: DataFrame, reg: DataFrame) -> DataFrame:
    """FIL-04: entries whose lineage destination or resource id equals a requested destination.

    The OR condition is two equi-joins and a distinct union, not a theta join.
    """
    d = destinations.select("destination")
    a = d.join(reg, d["destination"] == reg["lineage_destination"], "inner").select("destination", *reg.columns)
    b = d.join(reg, d["destination"] == reg["resource_id"], "inner").select("destination", *reg.columns)
    keys = ["destination", "resource_id", "tenant_id"]
    return a.unionByName(b).dropDuplicates(keys)


def strategies() -> Column:
    """FIL-05: redaction strategies: the array if present, else the legacy value minus NONE."""
    legacy = F.col("source_redaction_strategy")
    return F.coalesce(F.col("source_redaction_strategies"),
                      F.when(legacy.isNotNull() & (legacy != "NONE"), F.array(legacy)),
                      F.array().cast("array<string>"))


def has_strategy(s: str) -> Column:
    """FIL-06."""
    return F.array_contains(strategies(), s)


def plan_redaction(reg: DataFrame, tenant: str | None = None) -> DataFrame:
    """FIL-07: manual entries of the tenant with REDACT_IN_PLACE."""
    return list_entries(reg, tenant, owner=MANUAL).where(has_strategy("REDACT_IN_PLACE"))


def plan_encrypted_copy(reg: DataFrame, tenant: str | None = None) -> DataFrame:
    """FIL-08: same for ENCRYPTED_COPY."""
    return list_entries(reg, tenant, owner=MANUAL).where(has_strategy("ENCRYPTED_COPY"))


def encrypted_fields() -> Column:
    """FIL-09: fields handled by ENCRYPT (only those enter the vault)."""
    return F.filter("pii_fields", lambda f: f["handling"] == "ENCRYPT")


# --- AGG-07 / AGG-08 / SRC-12 / SRC-13 audit mirror ----------------------------------------

def representative_classification() -> Column:
    """AGG-07: most severe classification present, else 'PII'."""
    present = F.transform("pii_fields", lambda f: f["classification"])
    expr = F.lit("PII")
    for c in reversed(CLASSIFICATION_SEVERITY):
        expr = F.when(F.array_contains(present, c), F.lit(c)).otherwise(expr)
    return expr


def representative_handling() -> Column:
    """AGG-08: the single handling of all fields, else 'MIXED'."""
    hs = F.array_distinct(F.transform("pii_fields", lambda f: f["handling"]))
    return F.when(F.size(hs) == 1, F.get(hs, 0)).otherwise(F.lit("MIXED"))


def audit_rows(entries: DataFrame, now: Column) -> DataFrame:
    """SRC-12: one audit-mirror row per declaration that has a tenant."""
    return entries.where(F.col("tenant_id").isNotNull()).select(
        "tenant_id", "resource_id", "system",
        representative_classification().alias("classification"),
        representative_handling().alias("handling"),
        "deletion_strategy",
        F.coalesce(F.col("status"), F.lit("PENDING_REVIEW")).alias("status"),
        F.lit(1.0).alias("confidence"),
        F.col("owner_connector").alias("owner"), "notes",
        F.to_json(F.struct("resource_layer", "visibility", "tenant_id_column", "user_id_column",
                           "ghost_data_scan", "pii_fields")).alias("metadata"),
        F.coalesce(F.col("created_at"), now).alias("created_at"),
        F.coalesce(F.col("updated_at"), now).alias("updated_at"),
        now.alias("last_seen_at"),
    )


def removal_rows(removed: DataFrame, now: Column) -> DataFrame:
    """SRC-13: soft-delete marker row per removed (tenant, resource)."""
    return removed.select(
        "tenant_id", "resource_id", F.lit("external").alias("system"), F.lit("PII").alias("classification"),
        F.lit("MANUAL_REVIEW").alias("handling"), F.lit("MANUAL_REVIEW").alias("deletion_strategy"),
        F.lit("DEPRECATED").alias("status"), F.lit(None).cast("double").alias("confidence"),
        F.lit(MANUAL).alias("owner"), F.lit("Declaration removed.").alias("notes"),
        F.to_json(F.struct(F.lit("DECLARATION_REMOVED").alias("event"))).alias("metadata"),
        now.alias("created_at"), now.alias("updated_at"), now.alias("last_seen_at"),
    )


# --- VAL-05 / VAL-06: declarations → entries ---------------------------------------------------

def parse_fields(spec) -> Column:
    """``name:CLASSIFICATION:HANDLING;...`` text → array<struct(name, classification, handling)>."""
    s = F.col(spec) if isinstance(spec, str) else spec
    items = F.when(blank(s), F.array().cast("array<string>")).otherwise(F.split(s, ";"))
    return F.transform(items, lambda it: F.struct(
        F.get(F.split(it, ":"), 0).alias("name"),
        F.get(F.split(it, ":"), 1).alias("classification"),
        F.get(F.split(it, ":"), 2).alias("handling")))


def parse_strategies(spec) -> Column:
    """Comma text → array (NULL stays NULL = absent; '' = empty array)."""
    s = F.col(spec) if isinstance(spec, str) else spec
    return F.when(s.isNull(), _null("array<string>")).when(F.length(s) == 0, F.array().cast("array<string>")) \
        .otherwise(F.split(s, ","))


def _one_of(c: Column, allowed: list[str]) -> Column:
    return c.isNotNull() & ~c.isin(*allowed)


def _one_of_msg(field: str, values: list[str]) -> str:
    return DECLARATION_MESSAGES["one_of"].format(field=field, values=", ".join(values))


def _indexed(template: str, i: Column, **kw) -> Column:
    """A message with the field/array index (a column) spliced in at ``{i}``."""
    head, tail = template.format(i="\0", **kw).split("\0")
    return F.concat(F.lit(head), i.cast("string"), F.lit(tail))


def declaration_errors(d: DataFrame) -> Column:
    """VAL-05: every rule, collected in order; per-field messages carry the field index.

    Expects: tenant_id, resource_id, system, resource_layer, visibility,
    tenant_id_column, user_id_column, deletion_strategy, source_redaction_strategy,
    source_redaction_strategies (array or NULL), status, fields (array of
    struct(name, classification, handling)), scan_mode.
    """
    m = DECLARATION_MESSAGES
    strat_arr = F.col("source_redaction_strategies")
    legacy = F.col("source_redaction_strategy")
    resolved = F.coalesce(strat_arr, F.when(legacy.isNotNull() & (legacy != "NONE"), F.array(legacy)),
                          F.array().cast("array<string>"))
    rules = [
        (blank("tenant_id"), m["tenant"]),
        (blank("resource_id"), m["resource"]),
        (~blank("resource_id") & ~TX.is_resource_id("resource_id"), m["resource_shape"]),
        (F.col("system").isNull() | ~F.col("system").isin(*SYSTEMS), _one_of_msg("system", SYSTEMS)),
        (_one_of(F.col("resource_layer"), LAYERS), _one_of_msg("resourceLayer", LAYERS)),
        (_one_of(F.col("visibility"), VISIBILITIES), _one_of_msg("visibility", VISIBILITIES)),
        (_one_of(F.col("deletion_strategy"), DELETION_STRATEGIES), _one_of_msg("deletionStrategy", DELETION_STRATEGIES)),
        (_one_of(legacy, SOURCE_REDACTION_STRATEGIES),
         _one_of_msg("sourceRedactionStrategy", SOURCE_REDACTION_STRATEGIES)),
    ]
    base = VAL.errors(rules)
    bad_array = F.array_compact(F.transform(
        F.coalesce(strat_arr, F.array().cast("array<string>")),
        lambda v, i: F.when(~v.isin(*SOURCE_REDACTION_ARRAY_STRATEGIES),
                            _indexed(m["array_item"], i, values=", ".join(SOURCE_REDACTION_ARRAY_STRATEGIES)))))
    tail_rules = [
        ((F.size(resolved) > 0) & blank("user_id_column"), m["user_column"]),
        (~blank("user_id_column") & ~blank("tenant_id_column") & (F.col("user_id_column") == F.col("tenant_id_column")),
         m["same_column"]),
        (_one_of(F.col("status"), STATUSES), _one_of_msg("status", STATUSES)),
        (F.coalesce(F.size("fields"), F.lit(0)) <= 0, m["no_fields"]),
    ]
    fields_idx = F.transform(F.coalesce(F.col("fields"), F.array()), lambda f, i: F.struct(f.alias("f"), i.alias("i")))
    per_field = F.flatten(F.transform(fields_idx, lambda x: F.array_compact(F.array(
        F.when(blank(x["f"]["name"]), _indexed(m["field_name"], x["i"])),
        F.when(x["f"]["classification"].isNull() | ~x["f"]["classification"].isin(*CLASSIFICATIONS),
               _indexed(m["field_one_of"], x["i"], attr="classification", values=", ".join(CLASSIFICATIONS))),
        F.when(x["f"]["handling"].isNull() | ~x["f"]["handling"].isin(*HANDLINGS),
               _indexed(m["field_one_of"], x["i"], attr="handling", values=", ".join(HANDLINGS))),
    ))))
    scan = [(_one_of(F.col("scan_mode"), SCAN_MODES), _one_of_msg("ghostDataScan.scanMode", SCAN_MODES))]
    return F.concat(base, bad_array, VAL.errors(tail_rules), per_field, VAL.errors(scan))


def build_entries(decls: DataFrame, existing: DataFrame | None, now: Column) -> tuple[DataFrame, DataFrame]:
    """VAL-05 + VAL-06 + STA-12: validate declarations and build canonical manual entries.

    Several valid declarations of one (tenant, resource) apply in
    ``declared_at`` order (then ``decl_id``), as repeated upserts into a
    merging store would:

    * fields with defaults (visibility, strategy, status, scan policy, fields)
      come from the last declaration;
    * optional fields left empty keep their earlier value — the last non-empty
      one in the batch, else the stored entry's (resource_layer, tenant and user
      columns);
    * ``updated_at_column`` is always the last declaration's, and the sync
      watermark survives only if no declaration cleared that column;
      ``last_sync_attempt_at`` is never touched;
    * ``created_at`` / ``declared_by`` come from the stored entry, else the first
      declaration (first non-empty actor); ``last_modified_by`` is the last
      declaration's actor, empty included.
    Returns (entries, rejects).
    """
    checked = decls.withColumn("errors", declaration_errors(decls))
    rejects = checked.where(F.size("errors") > 0).select("decl_id", "tenant_id", "resource_id", "errors")
    ok = checked.where(F.size("errors") == 0)
    keys = ["tenant_id", "resource_id"]
    w = Window.partitionBy(*keys).orderBy(F.col("declared_at").desc(), F.col("decl_id").desc())
    seq = Window.partitionBy(*keys).orderBy("declared_at", "decl_id").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    ok = (ok.withColumn("_first_at", F.first("declared_at").over(seq))
          .withColumn("_first_by", F.first("actor", ignorenulls=True).over(seq))
          .withColumn("_m_layer", F.last("resource_layer", ignorenulls=True).over(seq))
          .withColumn("_m_tcol", F.last("tenant_id_column", ignorenulls=True).over(seq))
          .withColumn("_m_ucol", F.last("user_id_column", ignorenulls=True).over(seq))
          .withColumn("_all_upcol", F.min(F.col("updated_at_column").isNotNull().cast("int")).over(seq))
          .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn"))
    legacy = F.col("source_redaction_strategy")
    resolved = F.coalesce(F.col("source_redaction_strategies"),
                          F.when(legacy.isNotNull() & (legacy != "NONE"), F.array(legacy)),
                          F.array().cast("array<string>"))
    ex_cols = {"_ex_created": ("created_at", "timestamp"), "_ex_by": ("declared_by", "string"),
               "_ex_synced": ("last_synced_at", "timestamp"), "_ex_attempt": ("last_sync_attempt_at", "timestamp"),
               "_ex_layer": ("resource_layer", "string"), "_ex_tcol": ("tenant_id_column", "string"),
               "_ex_ucol": ("user_id_column", "string")}
    if existing is not None:
        ex = existing.where(F.col("owner_connector") == MANUAL).select(
            *keys, *[F.col(src).alias(alias) for alias, (src, _t) in ex_cols.items()])
        ok = ok.join(ex, keys, "left")
    else:
        for alias, (_src, t) in ex_cols.items():
            ok = ok.withColumn(alias, _null(t))
    keep_watermark = F.col("updated_at_column").isNotNull() & (F.col("_all_upcol") == 1)
    entries = ok.select(
        F.date_format(now, "yyyy-MM-dd").alias("registry_version"), "resource_id", "system",
        F.coalesce("_m_layer", "_ex_layer").alias("resource_layer"),
        F.coalesce(F.col("visibility"), F.lit("CUSTOMER_FACING")).alias("visibility"),
        F.coalesce("_m_tcol", "_ex_tcol").alias("tenant_id_column"),
        F.coalesce("_m_ucol", "_ex_ucol").alias("user_id_column"), "updated_at_column",
        F.when(keep_watermark, F.col("_ex_synced")).alias("last_synced_at"),
        F.col("_ex_attempt").alias("last_sync_attempt_at"),
        F.transform("fields", lambda f: F.struct(
            f["name"].alias("name"), f["classification"].alias("classification"), f["handling"].alias("handling"),
            F.lit(False).alias("required_in_mart"), F.lit("DECLARED").alias("confidence"),
            F.array(F.lit("console:manual-declaration")).alias("evidence"))).alias("pii_fields"),
        F.lit(MANUAL).alias("owner_connector"), F.col("resource_id").alias("lineage_destination"),
        F.coalesce(F.col("deletion_strategy"), F.lit("CRYPTO_SHRED")).alias("deletion_strategy"),
        F.coalesce(legacy, F.lit("NONE")).alias("source_redaction_strategy"),
        resolved.alias("source_redaction_strategies"),
        F.struct(F.coalesce(F.col("scan_enabled"), F.lit(True)).alias("enabled"),
                 F.coalesce(F.col("scan_mode"), F.lit("SAMPLED")).alias("scan_mode"),
                 F.array(*[F.lit(p) for p in DEFAULT_SCAN_PATTERNS]).alias("patterns")).alias("ghost_data_scan"),
        F.lit("manual_declaration").alias("handling_policy"),
        F.array(F.lit("console:manual-declaration")).alias("evidence_pointers"),
        F.lit(None).cast("string").alias("notes"), "tenant_id",
        F.coalesce(F.col("status"), F.lit("PENDING_REVIEW")).alias("status"),
        F.coalesce(F.col("_ex_created"), F.col("_first_at")).alias("created_at"),
        F.col("declared_at").alias("updated_at"),
        F.coalesce(F.col("_ex_by"), F.col("_first_by")).alias("declared_by"),
        F.col("actor").alias("last_modified_by"),
    )
    return conform(entries), rejects


def upsert(reg: DataFrame, entries: DataFrame) -> DataFrame:
    """STA-12: replace manual (tenant, resource) entries with new ones; others untouched."""
    keys = entries.select("tenant_id", "resource_id").withColumn("_new", F.lit(True))
    manual = reg.where(F.col("owner_connector") == MANUAL).join(keys, ["tenant_id", "resource_id"], "left") \
        .where(F.col("_new").isNull()).drop("_new")
    return conform(reg.where(~F.col("owner_connector").eqNullSafe(MANUAL)).unionByName(conform(manual)).unionByName(conform(entries)))


def remove(reg: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STA-13: drop manual entries named by (tenant, resource); returns (registry, removed keys)."""
    r = removals.select("tenant_id", "resource_id").distinct()
    manual = reg.where(F.col("owner_connector") == MANUAL)
    removed = manual.join(r, ["tenant_id", "resource_id"], "left_semi").select("tenant_id", "resource_id")
    kept = reg.join(removed.withColumn("_gone", F.lit(True)), ["tenant_id", "resource_id"], "left") \
        .where(F.col("_gone").isNull()).drop("_gone")
    return conform(kept), removed


def advance_watermarks(reg: DataFrame, marks: DataFrame) -> DataFrame:
    """STA-14: ``last_synced_at`` / ``last_sync_attempt_at`` only move forward.

    ``marks``: (tenant_id, resource_id, synced_at?, attempt_at?), timestamps
    as text; unparsable values are ignored (VAL-09). Several marks per
    resource fold to their maximum first.
    """
    m = marks.select("tenant_id", "resource_id",
                     F.try_to_timestamp(F.col("synced_at")).alias("s"),
                     F.try_to_timestamp(F.col("attempt_at")).alias("a")) \
        .groupBy("tenant_id", "resource_id").agg(F.max("s").alias("_s"), F.max("a").alias("_a"))
    j = reg.join(m, ["tenant_id", "resource_id"], "left")
    return conform(j.withColumn("last_synced_at", F.greatest("last_synced_at", "_s"))
                   .withColumn("last_sync_attempt_at", F.greatest("last_sync_attempt_at", "_a")))


# --- JOIN-09 / SET-06 / VAL-07: checks against the real table ---------------------------------

def missing_columns(decls: DataFrame, schema_rows: DataFrame) -> DataFrame:
    """Declared columns (user, tenant, fields) that the real table lacks, all of them, plus the real names.

    ``schema_rows``: (resource_id, column_name). A resource with no known
    columns is skipped (nothing to check against).
    """
    real = schema_rows.groupBy("resource_id").agg(F.array_sort(F.collect_set("column_name")).alias("real_columns"))
    declared = F.array_distinct(F.array_compact(F.concat(
        F.array(F.col("user_id_column"), F.col("tenant_id_column")),
        F.transform(F.coalesce(F.col("fields"), F.array()), lambda f: f["name"]))))
    j = decls.join(real, "resource_id", "inner")
    return j.select("decl_id", "tenant_id", "resource_id",
                    F.array_sort(F.array_except(declared, F.col("real_columns"))).alias("missing_columns"),
                    "real_columns").where(F.size("missing_columns") > 0)


def view_conflicts(decls: DataFrame, table_types: DataFrame) -> DataFrame:
    """VAL-07: REDACT_IN_PLACE (in the resolved strategy set) declared on a view is rejected.

    ``table_types``: (resource_id, table_type in BASE TABLE / VIEW / MISSING); unknown types pass.
    """
    legacy = F.col("source_redaction_strategy")
    resolved = F.coalesce(F.col("source_redaction_strategies"),
                          F.when(legacy.isNotNull() & (legacy != "NONE"), F.array(legacy)),
                          F.array().cast("array<string>"))
    return (decls.join(table_types, "resource_id", "inner")
            .where((F.col("table_type") == "VIEW") & F.array_contains(resolved, "REDACT_IN_PLACE"))
            .select("decl_id", "tenant_id", "resource_id",
                    F.lit(DECLARATION_MESSAGES["view_redaction"]).alias("error")))
