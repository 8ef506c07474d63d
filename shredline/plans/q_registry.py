"""Queries over the PII registry, policy and coverage (AGG-04..08/12, JOIN-04/05/09, SET-01..03/06, FIL-01..09,
VAL-05..07, STA-12..14, SRC-12/13, FN-12..15/19/20/25, EXT-04, QRY-06/07/08, SRT-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shredline.functions import text as TX
from shredline.operators import coverage as COV
from shredline.operators import lineage as LIN
from shredline.operators import policy as P
from shredline.operators import registry as REG
from shredline.operators.util import iso
from shredline.plans.catalog import register
from shredline.plans.oracle import duck_iso, with_fixtures
from shredline.sources import fixtures as FX
from shredline.sources.tables import read_table


# --- shared Spark inputs ------------------------------------------------------------------

def dbt_registry(spark, sf_dir):
    return REG.assemble(FX.fixture(spark, sf_dir, "registry_rows"), FX.fixture(spark, sf_dir, "field_lineage"))


def manual_entries(spark, sf_dir):
    entries, _rejects = REG.build_entries(FX.declarations(spark, sf_dir), None, FX.ts(FX.NOW_TS))
    return entries


def connector_registry(spark, sf_dir):
    """Connector slice derived from the SaaS destinations seen in lineage, plus stale dbt-owned copies."""
    ev = FX.fixture(spark, sf_dir, "lineage_events")
    saas = (ev.where(~F.col("destination").startswith("bigquery:")).select("destination").distinct()
            .select(F.concat(F.col("destination"), F.lit(":contacts")).alias("resource_id"),
                    F.when(F.col("destination").isin("hubspot", "salesforce"), F.col("destination"))
                    .otherwise(F.lit("external")).alias("system"),
                    F.lit("SAAS").alias("resource_layer"), F.col("destination").alias("owner_connector"),
                    F.lit("EXTERNAL_WIPE").alias("deletion_strategy"), F.lit("2025-06-01").alias("registry_version"),
                    F.array(F.struct(F.lit("email").alias("name"), F.lit("CONTACT").alias("classification"),
                                     F.lit("REDACT").alias("handling"), F.lit(False).alias("required_in_mart"),
                                     F.lit("DECLARED").alias("confidence"),
                                     F.array().cast("array<string>").alias("evidence"))).alias("pii_fields"),
                    F.struct(F.lit(False).alias("enabled"), F.lit("DISABLED").alias("scan_mode"),
                             F.array().cast("array<string>").alias("patterns")).alias("ghost_data_scan")))
    stale = dbt_registry(spark, sf_dir).where(F.col("resource_layer") == "STAGING") \
        .withColumn("registry_version", F.lit("2025-06-01"))
    return REG.conform(saas).unionByName(stale)


def composed_registry(spark, sf_dir):
    return REG.compose(connector_registry(spark, sf_dir), dbt_registry(spark, sf_dir), manual_entries(spark, sf_dir))


# --- shared oracle SQL --------------------------------------------------------------------------

def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _blank(c):
    return f"({c} IS NULL OR trim({c}) = '')"


def _bad(c, allowed):
    return f"({c} IS NOT NULL AND {c} NOT IN {_in(allowed)})"


_STRAT_LIST = ("CASE WHEN source_redaction_strategies IS NULL OR source_redaction_strategies = '' "
               "THEN []::VARCHAR[] ELSE string_split(source_redaction_strategies, ',') END")
_FIELD_LIST = "CASE WHEN fields_spec IS NULL OR fields_spec = '' THEN []::VARCHAR[] ELSE string_split(fields_spec, ';') END"

DECL_CHECK_SQL = f"""SELECT *,
  CAST((CASE WHEN {_blank('tenant_id')} THEN 1 ELSE 0 END)
   + (CASE WHEN {_blank('resource_id')} THEN 1 ELSE 0 END)
   + (CASE WHEN NOT {_blank('resource_id')} AND NOT regexp_matches(resource_id, '{TX.RESOURCE_ID}') THEN 1 ELSE 0 END)
   + (CASE WHEN system IS NULL OR system NOT IN {_in(REG.SYSTEMS)} THEN 1 ELSE 0 END)
   + (CASE WHEN {_bad('resource_layer', REG.LAYERS)} THEN 1 ELSE 0 END)
   + (CASE WHEN {_bad('visibility', REG.VISIBILITIES)} THEN 1 ELSE 0 END)
   + (CASE WHEN {_bad('deletion_strategy', REG.DELETION_STRATEGIES)} THEN 1 ELSE 0 END)
   + (CASE WHEN {_bad('source_redaction_strategy', REG.SOURCE_REDACTION_STRATEGIES)} THEN 1 ELSE 0 END)
   + len(list_filter({_STRAT_LIST}, lambda x: x NOT IN {_in(REG.SOURCE_REDACTION_ARRAY_STRATEGIES)}))
   + (CASE WHEN ((source_redaction_strategies IS NOT NULL AND source_redaction_strategies <> '')
                 OR (source_redaction_strategies IS NULL AND source_redaction_strategy IS NOT NULL
                     AND source_redaction_strategy <> 'NONE')) AND {_blank('user_id_column')} THEN 1 ELSE 0 END)
   + (CASE WHEN NOT {_blank('user_id_column')} AND NOT {_blank('tenant_id_column')}
                AND user_id_column = tenant_id_column THEN 1 ELSE 0 END)
   + (CASE WHEN {_bad('status', REG.STATUSES)} THEN 1 ELSE 0 END)
   + (CASE WHEN len({_FIELD_LIST}) = 0 THEN 1 ELSE 0 END)
   + len(list_filter({_FIELD_LIST}, lambda f: trim(coalesce(split_part(f, ':', 1), '')) = ''))
   + len(list_filter({_FIELD_LIST}, lambda f: split_part(f, ':', 2) NOT IN {_in(REG.CLASSIFICATIONS)}))
   + len(list_filter({_FIELD_LIST}, lambda f: split_part(f, ':', 3) NOT IN {_in(REG.HANDLINGS)}))
   + (CASE WHEN {_bad('scan_mode', REG.SCAN_MODES)} THEN 1 ELSE 0 END) AS INTEGER) AS n_errors
FROM declarations"""

# Valid declarations folded per (tenant, resource): the last one wins, created/declared from the first.
MANUAL_SQL = """SELECT tenant_id, resource_id,
  arg_max(decl_id, (declared_at, decl_id)) AS decl_id,
  min(declared_at) AS created_at, max(declared_at) AS updated_at,
  first(actor ORDER BY declared_at, decl_id) FILTER (WHERE actor IS NOT NULL) AS declared_by,
  arg_max(resource_layer, (declared_at, decl_id)) FILTER (WHERE resource_layer IS NOT NULL) AS m_layer,
  arg_max(tenant_id_column, (declared_at, decl_id)) FILTER (WHERE tenant_id_column IS NOT NULL) AS m_tcol,
  arg_max(user_id_column, (declared_at, decl_id)) FILTER (WHERE user_id_column IS NOT NULL) AS m_ucol,
  bool_and(updated_at_column IS NOT NULL) AS all_upcol
FROM decl_checked WHERE n_errors = 0 GROUP BY tenant_id, resource_id"""

MANUAL_FULL_SQL = """SELECT m.tenant_id, m.resource_id, m.created_at, m.updated_at, m.declared_by, d.actor AS last_modified_by,
  coalesce(d.deletion_strategy, 'CRYPTO_SHRED') AS deletion_strategy, coalesce(d.visibility, 'CUSTOMER_FACING') AS visibility,
  coalesce(d.status, 'PENDING_REVIEW') AS status, coalesce(d.source_redaction_strategy, 'NONE') AS source_redaction_strategy,
  CASE WHEN d.source_redaction_strategies IS NOT NULL THEN d.source_redaction_strategies
       WHEN d.source_redaction_strategy IS NOT NULL AND d.source_redaction_strategy <> 'NONE' THEN d.source_redaction_strategy
       ELSE '' END AS strategies,
  coalesce(d.scan_enabled, true) AS scan_enabled, coalesce(d.scan_mode, 'SAMPLED') AS scan_mode,
  d.updated_at_column, m.m_ucol AS user_id_column, m.m_tcol AS tenant_id_column, m.m_layer AS resource_layer,
  m.all_upcol, d.system, d.fields_spec
FROM manual0 m JOIN decl_checked d ON d.decl_id = m.decl_id"""

# From the events themselves: a view event reports its table's status and columns.
DISCOVERY_SQL = """SELECT tenant_id, resource_id, 'bigquery' AS system, arg_max(state, (t, n)) AS registry_status,
  arg_max(cols, (t, n)) AS new_columns, max(t) AS timestamp
FROM (SELECT concat('tenant-', user_id % 3) AS tenant_id, concat('bigquery:proj.ds.table_', event_id % 20) AS resource_id,
        ['UNREGISTERED', 'DRIFTED', 'REGISTERED'][event_id % 3 + 1] AS state, ['email', concat('col_', event_id % 4)] AS cols,
        CAST(ts AS TIMESTAMP) AS t, concat('ev-', event_id) AS n
      FROM events WHERE event_type = 'view')
GROUP BY tenant_id, resource_id HAVING registry_status <> 'REGISTERED'"""


def _sens_case(c: str) -> str:
    parts = []
    for subs, w in TX.SENSITIVITY_RULES:
        cond = " OR ".join(f"contains(lower({c}), '{s}')" for s in subs)
        parts.append(f"WHEN {cond} THEN {w}")
    return "CAST(CASE " + " ".join(parts) + f" ELSE {TX.DEFAULT_SENSITIVITY} END AS DOUBLE)"


def _field_sens_case(c: str) -> str:
    return ("CAST(CASE " + " ".join(f"WHEN {c} = '{k}' THEN {w}" for k, w in TX.FIELD_SENSITIVITY.items())
            + " ELSE 1.0 END AS DOUBLE)")


DBT_FIELDS_SQL = f"""SELECT resource_id, resource_layer, field_name, classification, handling,
  {_field_sens_case('classification')} AS sens,
  (handling IN ('ENCRYPT', 'TOKENIZE') OR (classification = 'SYSTEM_IDENTIFIER' AND handling = 'HASH_SURROGATE')) AS safe
FROM registry_rows"""

DBT_ENT_SQL = """SELECT resource_id, min(resource_layer) AS layer, greatest(CAST(0.5 AS DOUBLE), sum(sens)) AS weight,
  bool_or(NOT safe) AS any_weak,
  string_agg(CASE WHEN NOT safe THEN field_name || '=' || handling END, ', ' ORDER BY field_name) AS weak_text,
  bool_or(classification = 'DIRECT_IDENTIFIER' AND handling <> 'ALLOW_AGGREGATE_ONLY') AS any_direct,
  bool_or(handling = 'MANUAL_REVIEW') AS any_manual, count(*) AS n_fields
FROM dbt_fields GROUP BY resource_id"""

DBT_STATUS_SQL = """SELECT *, CASE WHEN layer = 'MART' AND any_direct THEN 'FAIL'
  WHEN layer = 'MART' OR any_manual THEN 'WARN' ELSE 'PASS' END AS pstatus FROM dbt_ent"""

REG_CTES = [("dbt_fields", DBT_FIELDS_SQL), ("dbt_ent", DBT_ENT_SQL), ("dbt_status", DBT_STATUS_SQL)]


def _codes(col):
    return F.array_join(F.array_sort(F.transform(col, lambda i: i["code"])), ",")


# --- AGG-04 / JOIN-04 ----------------------------------------------------------------------------

@register("agg04_registry_entries", with_fixtures(["registry_rows", "field_lineage"], """
SELECT r.resource_id, min(r.resource_layer) AS resource_layer,
  CASE WHEN min(r.resource_layer) = 'RAW' THEN 'INTERNAL' ELSE 'CUSTOMER_FACING' END AS visibility,
  CASE WHEN min(r.resource_layer) = 'MART' THEN 'MANUAL_REVIEW' ELSE 'CRYPTO_SHRED' END AS deletion_strategy,
  min(r.resource_layer) NOT IN ('RAW', 'SAAS') AS scan_enabled,
  count(*) AS n_fields, string_agg(r.field_name, ',' ORDER BY r.field_name) AS field_names,
  1 + coalesce(min(l.n), 0) AS n_evidence,
  lower(min(r.resource_layer)) || '_auto_registry' AS handling_policy
FROM registry_rows r
LEFT JOIN (SELECT source_resource_id, count(*) AS n FROM field_lineage GROUP BY 1) l ON l.source_resource_id = r.resource_id
GROUP BY r.resource_id"""))
def registry_entries(spark, sf_dir):
    e = dbt_registry(spark, sf_dir)
    return e.select("resource_id", "resource_layer", "visibility", "deletion_strategy",
                    F.col("ghost_data_scan.enabled").alias("scan_enabled"),
                    F.size("pii_fields").cast("bigint").alias("n_fields"),
                    F.array_join(F.transform("pii_fields", lambda f: f["name"]), ",").alias("field_names"),
                    F.size("evidence_pointers").cast("bigint").alias("n_evidence"), "handling_policy")


# --- VAL-05 / VAL-06 / STA-12 ------------------------------------------------------------------------

@register("val05_declaration_errors", with_fixtures(["declarations"], """
SELECT decl_id, n_errors, n_errors = 0 AS valid FROM decl_checked""", [("decl_checked", DECL_CHECK_SQL)]))
def declaration_errors(spark, sf_dir):
    d = FX.declarations(spark, sf_dir)
    errs = REG.declaration_errors(d)
    return d.select("decl_id", F.size(errs).alias("n_errors"), (F.size(errs) == 0).alias("valid"))


@register("sta12_upsert_declarations", with_fixtures(["declarations"], f"""
SELECT 'someone' AS owner, NULL AS tenant_id, 'kept:' || decl_id AS resource_id, NULL AS created_at, NULL AS updated_at,
  NULL AS declared_by, NULL AS last_modified_by, NULL AS deletion_strategy, NULL AS visibility, NULL AS status,
  NULL AS source_redaction_strategy, NULL AS strategies, NULL AS scan_enabled, NULL AS scan_mode, NULL AS updated_at_column,
  NULL AS n_fields, NULL AS resource_layer, NULL AS tenant_id_column, NULL AS user_id_column
FROM declarations WHERE decl_id % 4 = 0
UNION ALL
SELECT 'manual', tenant_id, resource_id, {duck_iso('created_at')} AS created_at, {duck_iso('updated_at')} AS updated_at,
  declared_by, last_modified_by, deletion_strategy, visibility, status, source_redaction_strategy, strategies,
  scan_enabled, scan_mode, updated_at_column, CAST(len(string_split(fields_spec, ';')) AS BIGINT) AS n_fields,
  resource_layer, tenant_id_column, user_id_column
FROM manual""", [("decl_checked", DECL_CHECK_SQL), ("manual0", MANUAL_SQL), ("manual", MANUAL_FULL_SQL)]))
def upsert_declarations(spark, sf_dir):
    """Declarations stored twice over a registry that has entries without an owner and older manual entries."""
    e = manual_entries(spark, sf_dir)
    ownerless = REG.conform(FX.fixture(spark, sf_dir, "declarations").where(F.col("decl_id") % 4 == 0)
                            .select(F.concat(F.lit("kept:"), F.col("decl_id")).alias("resource_id")))
    stale = REG.conform(e.withColumn("status", F.lit("OLD")))
    e = REG.upsert(REG.upsert(ownerless, stale), e)
    return e.select(F.when(F.col("owner_connector").isNull(), "someone").otherwise("manual").alias("owner"), "tenant_id", "resource_id", iso("created_at").alias("created_at"),
                    iso("updated_at").alias("updated_at"), "declared_by", "last_modified_by", "deletion_strategy",
                    "visibility", "status", "source_redaction_strategy",
                    F.array_join("source_redaction_strategies", ",").alias("strategies"),
                    F.col("ghost_data_scan.enabled").alias("scan_enabled"),
                    F.col("ghost_data_scan.scan_mode").alias("scan_mode"), "updated_at_column",
                    F.size("pii_fields").cast("bigint").alias("n_fields"),
                    "resource_layer", "tenant_id_column", "user_id_column")


# --- SET-01 / SET-02 composition ----------------------------------------------------------------------

_COMPOSE_SQL = """
SELECT '*' AS scope, saas || ':contacts' AS resource_id, saas AS owner_connector, '2025-06-01' AS registry_version
FROM (SELECT DISTINCT destination AS saas FROM lineage_events WHERE NOT starts_with(destination, 'bigquery:'))
UNION ALL
SELECT '*', resource_id, 'dbt', min(registry_version) FROM registry_rows GROUP BY resource_id
UNION ALL
SELECT tenant_id, resource_id, 'manual', strftime(DATE '2026-06-01', '%Y-%m-%d') FROM manual0"""


@register("set01_registry_compose", with_fixtures(["registry_rows", "lineage_events", "declarations"], _COMPOSE_SQL,
                                                  [("decl_checked", DECL_CHECK_SQL), ("manual0", MANUAL_SQL)]))
def registry_compose(spark, sf_dir):
    """Connector ∪ dbt (stale dbt-owned connector copies dropped) ∪ manual, last wins per (tenant or *, resource)."""
    r = composed_registry(spark, sf_dir)
    return r.select(F.coalesce("tenant_id", F.lit("*")).alias("scope"), "resource_id", "owner_connector",
                    "registry_version")


# --- FIL-03 lookup precedence / FIL-01 visibility -------------------------------------------------------

@register("fil03_registry_lookup", with_fixtures(["registry_rows", "lineage_events", "declarations"], """
SELECT request_id, resource_id, scope, owner_connector FROM cand WHERE prec IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY prec, CASE WHEN scope = '*' THEN '' ELSE scope END) = 1""",
    [("decl_checked", DECL_CHECK_SQL), ("manual0", MANUAL_SQL), ("reg", _COMPOSE_SQL),
     ("req", "SELECT concat('q-', decl_id) AS request_id, resource_id, nullif(tenant_id, '') AS tenant_id FROM declarations"),
     ("cand", """SELECT q.request_id, q.resource_id, r.scope, r.owner_connector,
    CASE WHEN q.tenant_id IS NOT NULL THEN (CASE WHEN r.scope = q.tenant_id THEN 0 WHEN r.scope = '*' THEN 1 END)
         ELSE (CASE WHEN r.scope = '*' THEN 0 ELSE 1 END) END AS prec
  FROM req q JOIN reg r ON r.resource_id = q.resource_id""")]))
def registry_lookup(spark, sf_dir):
    """Every declaration asks for the entry of its resource as seen by its tenant (blank tenant → no tenant)."""
    reg = composed_registry(spark, sf_dir)
    req = FX.fixture(spark, sf_dir, "declarations").select(
        F.concat(F.lit("q-"), F.col("decl_id")).alias("request_id"), "resource_id",
        F.nullif(F.col("tenant_id"), F.lit("")).alias("tenant_id"))
    hit = REG.lookup(req, reg)
    return hit.select("request_id", "resource_id", F.coalesce("tenant_id", F.lit("*")).alias("scope"), "owner_connector")


@register("fil02_list_entries", with_fixtures(["registry_rows", "lineage_events", "declarations"], """
SELECT scope, resource_id, owner_connector FROM (""" + _COMPOSE_SQL + """) WHERE scope IN ('*', 'tenant-1')
  AND owner_connector = 'manual'""", [("decl_checked", DECL_CHECK_SQL), ("manual0", MANUAL_SQL)]))
def list_entries(spark, sf_dir):
    """Entries visible to tenant-1 (global + own), restricted to manual declarations."""
    reg = REG.list_entries(composed_registry(spark, sf_dir), tenant="tenant-1", owner="manual")
    return reg.select(F.coalesce("tenant_id", F.lit("*")).alias("scope"), "resource_id", "owner_connector")


# --- FIL-05..09 redaction plans ---------------------------------------------------------------------------

@register("fil07_redaction_plan", with_fixtures(["declarations"], """
SELECT tenant_id, resource_id,
  list_contains(CASE WHEN strategies = '' THEN []::VARCHAR[] ELSE string_split(strategies, ',') END, 'REDACT_IN_PLACE') AS redact_in_place,
  list_contains(CASE WHEN strategies = '' THEN []::VARCHAR[] ELSE string_split(strategies, ',') END, 'ENCRYPTED_COPY') AS encrypted_copy,
  CAST(len(list_filter(string_split(fields_spec, ';'), lambda f: split_part(f, ':', 3) = 'ENCRYPT')) AS BIGINT) AS n_encrypted_fields
FROM manual WHERE contains(strategies, 'REDACT_IN_PLACE') OR contains(strategies, 'ENCRYPTED_COPY')""",
    [("decl_checked", DECL_CHECK_SQL), ("manual0", MANUAL_SQL), ("manual", MANUAL_FULL_SQL)]))
def redaction_plan(spark, sf_dir):
    """Manual entries with a source-redaction strategy that acts on deletion (FIL-07 ∪ FIL-08)."""
    reg = composed_registry(spark, sf_dir)
    a = REG.plan_redaction(reg).select("tenant_id", "resource_id")
    b = REG.plan_encrypted_copy(reg).select("tenant_id", "resource_id")
    keys = a.unionByName(b).distinct()
    e = reg.join(keys, ["tenant_id", "resource_id"], "left_semi")
    return e.select("tenant_id", "resource_id", REG.has_strategy("REDACT_IN_PLACE").alias("redact_in_place"),
                    REG.has_strategy("ENCRYPTED_COPY").alias("encrypted_copy"),
                    F.size(REG.encrypted_fields()).cast("bigint").alias("n_encrypted_fields"))


# --- FN-25 / AGG-12 / AGG-06 / QRY-07 / EXT-04 ---------------------------------------------------------------

_ISSUES_SQL = """
SELECT resource_id, 'MANUAL_REVIEW_REQUIRED' AS code, 'WARNING' AS severity, CAST(NULL AS VARCHAR) AS field
  FROM registry_rows GROUP BY resource_id HAVING min(resource_layer) = 'MART'
UNION ALL
SELECT resource_id, 'DIRECT_IDENTIFIER_IN_MART', 'ERROR', field_name FROM registry_rows
  WHERE resource_layer = 'MART' AND classification = 'DIRECT_IDENTIFIER' AND handling <> 'ALLOW_AGGREGATE_ONLY'
UNION ALL
SELECT resource_id, 'MANUAL_REVIEW_REQUIRED', 'WARNING', field_name FROM registry_rows WHERE handling = 'MANUAL_REVIEW'
UNION ALL
SELECT resource_id, 'GHOST_SCAN_DISABLED', 'INFO', NULL FROM registry_rows GROUP BY resource_id
  HAVING min(resource_layer) IN ('RAW', 'SAAS')"""


@register("fn25_policy_issues", with_fixtures(["registry_rows"], _ISSUES_SQL))
def policy_issues(spark, sf_dir):
    ev = P.evaluate(dbt_registry(spark, sf_dir))
    return ev.select("resource_id", F.explode("issues").alias("i")).select(
        "resource_id", F.col("i.code").alias("code"), F.col("i.severity").alias("severity"),
        F.col("i.field").alias("field"))


@register("qry07_policy_report", with_fixtures(["registry_rows"], """
SELECT resource_id,
  CASE WHEN bool_or(severity = 'ERROR') THEN 'FAIL' WHEN bool_or(severity = 'WARNING') THEN 'WARN' ELSE 'PASS' END AS status,
  count(*) AS n_issues, count(*) FILTER (WHERE severity = 'ERROR') AS n_errors,
  count(*) FILTER (WHERE severity = 'WARNING') AS n_warnings
FROM (""" + _ISSUES_SQL + """) GROUP BY resource_id
UNION ALL
SELECT resource_id, 'PASS', 0, 0, 0 FROM registry_rows GROUP BY resource_id
  HAVING NOT (min(resource_layer) IN ('MART', 'RAW', 'SAAS')) AND NOT bool_or(handling = 'MANUAL_REVIEW')"""))
def policy_report(spark, sf_dir):
    ev = P.evaluate(dbt_registry(spark, sf_dir))
    return ev.select("resource_id", F.col("policy_status").alias("status"),
                     F.size("issues").cast("bigint").alias("n_issues"),
                     F.size(F.filter("issues", lambda i: i["severity"] == "ERROR")).cast("bigint").alias("n_errors"),
                     F.size(F.filter("issues", lambda i: i["severity"] == "WARNING")).cast("bigint").alias("n_warnings"))


@register("agg06_policy_overall", with_fixtures(["registry_rows"], """
SELECT CASE WHEN max(r) = 2 THEN 'FAIL' WHEN max(r) = 1 THEN 'WARN' ELSE 'PASS' END AS status,
  count(*) AS entries, count(*) FILTER (WHERE r = 2) AS failing, count(*) FILTER (WHERE r = 1) AS warning
FROM (SELECT resource_id, CASE WHEN pstatus = 'FAIL' THEN 2 WHEN pstatus = 'WARN' THEN 1 ELSE 0 END AS r FROM dbt_status)""",
    REG_CTES))
def policy_overall(spark, sf_dir):
    return P.overall(P.evaluate(dbt_registry(spark, sf_dir)))


@register("ext04_policy_assertions", with_fixtures(["registry_rows"], """
SELECT resource_id, code, field FROM (""" + _ISSUES_SQL + """) WHERE severity = 'ERROR'"""))
def policy_assertions(spark, sf_dir):
    return P.assertion_failures(P.evaluate(dbt_registry(spark, sf_dir)))


# --- FN-12..15 / SET-03 / AGG-05 / SRT-01 / QRY-06 ----------------------------------------------------------

_COVERAGE_ITEMS_SQL = f"""
SELECT CAST(NULL AS VARCHAR) AS tenant_id, resource_id, 'bigquery' AS system,
  CASE WHEN pstatus = 'FAIL' THEN 'EXPOSED' WHEN any_weak OR layer = 'MART' OR pstatus = 'WARN' THEN 'PARTIAL'
       ELSE 'PROTECTED' END AS state,
  weight,
  CASE WHEN pstatus = 'FAIL' THEN 'policy evaluation FAILs'
       ELSE concat_ws(' | ', CASE WHEN any_weak THEN 'not key-reversible: ' || weak_text END,
                      CASE WHEN layer = 'MART' THEN 'deletion strategy is MANUAL_REVIEW, not CRYPTO_SHRED' END,
                      CASE WHEN pstatus = 'WARN' THEN 'policy WARNs' END) END AS reasons
FROM dbt_status
UNION ALL
SELECT tenant_id, resource_id, system, 'EXPOSED',
  greatest(CAST(1.0 AS DOUBLE), coalesce(list_sum(list_transform(CAST(new_columns AS VARCHAR[]), lambda c: {_sens_case('c')})),
                                       CAST(0.0 AS DOUBLE))),
  CASE WHEN registry_status = 'DRIFTED' THEN 'schema drift vs registry' ELSE 'discovered but undeclared' END
FROM disc WHERE resource_id NOT IN (SELECT resource_id FROM registry_rows)"""

_COV_CTES = REG_CTES + [("disc", DISCOVERY_SQL), ("items", _COVERAGE_ITEMS_SQL)]


def _coverage_items(spark, sf_dir):
    findings = LIN.discovery_findings(FX.fixture(spark, sf_dir, "lineage_events"))
    return COV.items(dbt_registry(spark, sf_dir), findings)


@register("qry06_coverage_items", with_fixtures(["registry_rows", "lineage_events"], "SELECT * FROM items", _COV_CTES))
def coverage_items(spark, sf_dir):
    it = _coverage_items(spark, sf_dir)
    return it.select("tenant_id", "resource_id", "system", "state", "weight", F.array_join("reasons", " | ").alias("reasons"))


@register("agg05_coverage_report", with_fixtures(["registry_rows", "lineage_events"], """
SELECT *, CASE WHEN w_total = 0 THEN 100 ELSE CAST(floor((w_protected + 0.5 * w_partial) / w_total * 100 + 0.5) AS INTEGER) END AS score
FROM (SELECT t.tenant_id, count(*) FILTER (WHERE state = 'PROTECTED') AS n_protected, count(*) FILTER (WHERE state = 'PARTIAL') AS n_partial,
  count(*) FILTER (WHERE state = 'EXPOSED') AS n_exposed, count(*) AS n_total,
  coalesce(sum(weight) FILTER (WHERE state = 'PROTECTED'), 0.0) AS w_protected,
  coalesce(sum(weight) FILTER (WHERE state = 'PARTIAL'), 0.0) AS w_partial,
  coalesce(sum(weight) FILTER (WHERE state = 'EXPOSED'), 0.0) AS w_exposed, coalesce(sum(weight), 0.0) AS w_total
  FROM (SELECT DISTINCT tenant_id FROM items) t JOIN items i ON i.tenant_id IS NULL OR i.tenant_id = t.tenant_id
  GROUP BY t.tenant_id)""", _COV_CTES))
def coverage_report(spark, sf_dir):
    """Score of every tenant over its own items and the shared ones; the row without a tenant has the shared ones alone."""
    return COV.report(_coverage_items(spark, sf_dir))


@register("srt01_coverage_top", with_fixtures(["registry_rows", "lineage_events"], """
SELECT tenant_id, resource_id, state, weight, row_number() OVER (PARTITION BY tenant_id
  ORDER BY CASE state WHEN 'EXPOSED' THEN 0 WHEN 'PARTIAL' THEN 1 ELSE 2 END, weight DESC,
  CASE WHEN resource_id IN (SELECT resource_id FROM registry_rows) THEN 0 ELSE 1 END, resource_id) AS rank
FROM items""", _COV_CTES))
def coverage_ranked(spark, sf_dir):
    """All coverage items with their rank in the tenant, the riskiest first."""
    return COV.ranked_items(_coverage_items(spark, sf_dir)).select("tenant_id", "resource_id", "state", "weight",
                                                                   F.col("rank").cast("bigint").alias("rank"))


# --- WIN-01 / JOIN-05 / QRY-08 ---------------------------------------------------------------------------------

@register("win01_discovery_findings", with_fixtures(["lineage_events"], f"""
SELECT tenant_id, resource_id, system, registry_status,
  array_to_string(CAST(new_columns AS VARCHAR[]), ',') AS columns, {duck_iso('timestamp')} AS last_seen
FROM disc""", [("disc", DISCOVERY_SQL)]))
def discovery(spark, sf_dir):
    d = LIN.discovery_findings(FX.fixture(spark, sf_dir, "lineage_events"))
    return d.select("tenant_id", "resource_id", "system", "registry_status",
                    F.array_join("columns", ",").alias("columns"), iso("last_seen").alias("last_seen"))


@register("qry08_discovery_queue", with_fixtures(["lineage_events", "registry_rows", "declarations"], f"""
SELECT tenant_id, resource_id, registry_status, {duck_iso('timestamp')} AS last_seen FROM disc d
WHERE NOT EXISTS (SELECT 1 FROM manual0 m WHERE m.tenant_id = d.tenant_id AND m.resource_id = d.resource_id)
  AND d.resource_id NOT IN (SELECT resource_id FROM registry_rows)""",
    [("disc", DISCOVERY_SQL), ("decl_checked", DECL_CHECK_SQL), ("manual0", MANUAL_SQL)]))
def discovery_queue(spark, sf_dir):
    """Discovered tables with no entry visible to the tenant: the self-clearing declare queue."""
    d = LIN.discovery_findings(FX.fixture(spark, sf_dir, "lineage_events"))
    reg = REG.compose(REG.conform(spark.createDataFrame([], REG.schemas.REGISTRY_ENTRY)),
                      dbt_registry(spark, sf_dir), manual_entries(spark, sf_dir))
    q = LIN.undeclared(d, reg)
    return q.select("tenant_id", "resource_id", "registry_status", iso("last_seen").alias("last_seen"))


# --- AGG-07 / AGG-08 / SRC-12 / SRC-13 / STA-13 ----------------------------------------------------------------

@register("agg07_audit_mirror", with_fixtures(["declarations"], """
SELECT tenant_id, resource_id,
  CASE WHEN contains(fields_spec, 'DIRECT_IDENTIFIER') THEN 'DIRECT_IDENTIFIER' WHEN contains(fields_spec, ':CONTACT:') THEN 'CONTACT'
       ELSE 'PII' END AS classification,
  CASE WHEN split_part(split_part(fields_spec, ';', 1), ':', 3) = split_part(split_part(fields_spec, ';', 2), ':', 3)
       THEN split_part(split_part(fields_spec, ';', 1), ':', 3) ELSE 'MIXED' END AS handling,
  status, 'manual' AS owner
FROM manual""", [("decl_checked", DECL_CHECK_SQL), ("manual0", MANUAL_SQL), ("manual", MANUAL_FULL_SQL)]))
def audit_mirror(spark, sf_dir):
    rows = REG.audit_rows(manual_entries(spark, sf_dir), FX.ts(FX.NOW_TS))
    return rows.select("tenant_id", "resource_id", "classification", "handling", "status", "owner")


@register("sta13_remove_declarations", with_fixtures(["declarations"], """
SELECT tenant_id, resource_id, 'DEPRECATED' AS status, 'removed' AS outcome FROM manual0
WHERE contains(resource_id, 'contacts_')
UNION ALL
SELECT tenant_id, resource_id, 'KEPT', 'kept' FROM manual0 WHERE NOT contains(resource_id, 'contacts_')""",
    [("decl_checked", DECL_CHECK_SQL), ("manual0", MANUAL_SQL)]))
def remove_declarations(spark, sf_dir):
    """Remove every crm contacts declaration; the rest stays. Removal marker rows + kept keys."""
    reg = composed_registry(spark, sf_dir)
    manual = reg.where(F.col("owner_connector") == "manual")
    kept, removed = REG.remove(reg, manual.where(F.col("resource_id").contains("contacts_")))
    markers = REG.removal_rows(removed, FX.ts(FX.NOW_TS)).select("tenant_id", "resource_id", "status",
                                                                   F.lit("removed").alias("outcome"))
    still = kept.where(F.col("owner_connector") == "manual").select(
        "tenant_id", "resource_id", F.lit("KEPT").alias("status"), F.lit("kept").alias("outcome"))
    return markers.unionByName(still)


@register("sta14_sync_watermarks", with_fixtures(["declarations"], f"""
SELECT m.tenant_id, m.resource_id, {duck_iso('max(w.s)')} AS last_synced_at
FROM manual m LEFT JOIN (
  SELECT concat('tenant-', decl_id % 3) AS tenant_id, resource_id,
         CAST(concat('2026-09-', lpad(CAST(1 + decl_id % 28 AS string), 2, '0'), ' 00:00:00') AS timestamp) AS s
  FROM declarations) w
  ON w.tenant_id = m.tenant_id AND w.resource_id = m.resource_id AND m.updated_at_column IS NOT NULL
GROUP BY m.tenant_id, m.resource_id""",
    [("decl_checked", DECL_CHECK_SQL), ("manual0", MANUAL_SQL), ("manual", MANUAL_FULL_SQL)]))
def sync_watermarks(spark, sf_dir):
    """Every supplier row reports a sync of its declared resource; watermarks only move forward.

    Resources without an ``updated_at_column`` take full syncs and keep no watermark.
    """
    reg = manual_entries(spark, sf_dir)
    d = FX.fixture(spark, sf_dir, "declarations").select("decl_id", "resource_id")
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("tenant-"), F.col("s_suppkey") % 3).alias("tenant_id"), F.col("s_suppkey").alias("decl_id"),
        F.concat(F.lit("2026-09-"), F.lpad((1 + F.col("s_suppkey") % 28).cast("string"), 2, "0"),
                 F.lit(" 00:00:00")).alias("synced_at"))
    marks = sup.join(d, "decl_id").select("tenant_id", "resource_id", "synced_at",
                                          F.lit(None).cast("string").alias("attempt_at"))
    incremental = reg.where(F.col("updated_at_column").isNotNull())
    marks = marks.join(incremental.select("tenant_id", "resource_id"), ["tenant_id", "resource_id"], "left_semi")
    out = REG.advance_watermarks(reg, marks)
    # a second round of older and unreadable marks (VAL-09) moves nothing back
    worse = marks.withColumn("synced_at", F.when(F.col("synced_at") > "2026-09-14", "2020-01-01 00:00:00").otherwise("last Tuesday"))
    out = REG.advance_watermarks(out, worse.withColumn("attempt_at", F.lit("soon")))
    return out.select("tenant_id", "resource_id", iso("last_synced_at").alias("last_synced_at"))


# --- FIL-04 ------------------------------------------------------------------------------------------

@register("fil04_entries_by_destination", with_fixtures(["registry_rows", "lineage_events", "declarations"], """
SELECT DISTINCT e.destination, m.tenant_id, m.resource_id
FROM (SELECT DISTINCT destination FROM lineage_events) e JOIN manual0 m ON m.resource_id = e.destination
UNION
SELECT DISTINCT e.destination, NULL, r.resource_id
FROM (SELECT DISTINCT destination FROM lineage_events) e JOIN registry_rows r ON r.resource_id = e.destination""",
    [("decl_checked", DECL_CHECK_SQL), ("manual0", MANUAL_SQL)]))
def entries_by_destination(spark, sf_dir):
    """Registry entries matching each lineage destination (by lineage destination or resource id)."""
    dests = FX.fixture(spark, sf_dir, "lineage_events").select("destination").distinct()
    reg = REG.compose(REG.conform(spark.createDataFrame([], REG.schemas.REGISTRY_ENTRY)),
                      dbt_registry(spark, sf_dir), manual_entries(spark, sf_dir))
    return REG.by_lineage_destination(dests, reg).select("destination", "tenant_id", "resource_id")


# --- JOIN-09 / SET-06 / VAL-07: declarations against the real tables ----------------------------------------------

def _real_tables(spark, sf_dir):
    """One table or view for each of the suppliers' resources, with the columns it really has."""
    n = F.col("s_suppkey") % 25
    return (read_table(spark, sf_dir, "supplier").select("s_suppkey").select(
        F.concat(F.lit("bigquery:proj.ds.table_"), n).alias("resource_id"),
        F.when(n % 2 == 0, "VIEW").otherwise("BASE TABLE").alias("table_type"),
        F.when(n % 3 == 0, F.array(F.lit("user_id"), F.lit("email"))).otherwise(
            F.array(F.lit("user_id"), F.lit("tenant_id"), F.lit("email"), F.lit("phone"))).alias("columns")).distinct())


@register("join09_missing_columns", with_fixtures(["declarations"], """
SELECT decl_id, tenant_id, resource_id, list_aggregate(list_sort(list_filter(list_distinct(declared),
    lambda c: NOT list_contains(real, c))), 'string_agg', ',') AS missing_columns
FROM (SELECT decl_id, tenant_id, resource_id,
        list_filter([user_id_column, tenant_id_column] || CASE WHEN fields_spec = '' THEN [] ELSE ['email', 'phone'] END,
                    lambda c: c IS NOT NULL) AS declared,
        CASE WHEN CAST(split_part(resource_id, 'table_', 2) AS INTEGER) % 3 = 0 THEN ['user_id', 'email']
             ELSE ['user_id', 'tenant_id', 'email', 'phone'] END AS real
      FROM declarations WHERE resource_id LIKE 'bigquery:proj.ds.table\\_%' ESCAPE '\\'
        AND resource_id IN (SELECT 'bigquery:proj.ds.table_' || (s_suppkey % 25) FROM supplier))
WHERE missing_columns IS NOT NULL"""))
def missing_columns(spark, sf_dir):
    """Declared columns that the real table lacks; resources without a known table are skipped."""
    schema = _real_tables(spark, sf_dir).select("resource_id", F.explode("columns").alias("column_name"))
    out = REG.missing_columns(FX.declarations(spark, sf_dir), schema)
    return out.select("decl_id", "tenant_id", "resource_id", F.array_join("missing_columns", ",").alias("missing_columns"))


@register("val07_view_conflicts", with_fixtures(["declarations"], """
SELECT decl_id, tenant_id, resource_id FROM declarations
WHERE resource_id LIKE 'bigquery:proj.ds.table\\_%' ESCAPE '\\' AND CAST(split_part(resource_id, 'table_', 2) AS INTEGER) % 2 = 0
  AND resource_id IN (SELECT 'bigquery:proj.ds.table_' || (s_suppkey % 25) FROM supplier)
  AND list_contains(CASE WHEN source_redaction_strategies IS NOT NULL THEN string_split(source_redaction_strategies, ',')
                         WHEN source_redaction_strategy <> 'NONE' THEN [source_redaction_strategy] ELSE [] END, 'REDACT_IN_PLACE')"""))
def view_conflicts(spark, sf_dir):
    """Declarations that would redact a view in place."""
    out = REG.view_conflicts(FX.declarations(spark, sf_dir), _real_tables(spark, sf_dir).select("resource_id", "table_type"))
    return out.select("decl_id", "tenant_id", "resource_id")
