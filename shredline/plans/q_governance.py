"""Governance queries: audit (QRY-09, FN-26, SET-04, SRT-03), view catalogue (STA-16, VAL-08),
sync runs (AGG-09, STA-15), ghost scan (EXT-02) and warehouse crawl (EXT-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shredline.operators import audit as AU
from shredline.operators import scan as SCN
from shredline.operators import sync_runs as SR
from shredline.operators import vault as V
from shredline.operators import views as VW
from shredline.operators.util import iso
from shredline.plans import q_deletion as QD
from shredline.plans import q_registry as QR
from shredline.plans import scenario as SC
from shredline.plans.catalog import register
from shredline.plans.oracle import duck_iso, with_fixtures
from shredline.sources import fixtures as FX
from shredline.sources.tables import read_table

# --- audit -------------------------------------------------------------------------------------------

_AUDIT_EVENTS = """SELECT 'PII_REGISTRY_DECLARED' AS type, resource_id, declared_by AS actor_email, tenant_id, created_at AS ts
  FROM manual WHERE declared_by IS NOT NULL
UNION ALL
SELECT 'PII_REGISTRY_MODIFIED', resource_id, last_modified_by, tenant_id, updated_at FROM manual
  WHERE last_modified_by IS NOT NULL AND updated_at <> created_at
UNION ALL
SELECT 'DELETION_REQUESTED', user_id, requested_by, tenant_id, created_at FROM deletion_requests WHERE requested_by IS NOT NULL"""

_AUDIT_CTES = [("decl_checked", QR.DECL_CHECK_SQL), ("manual0", QR.MANUAL_SQL), ("manual", QR.MANUAL_FULL_SQL),
               ("ev", _AUDIT_EVENTS)]


def _audit_events(spark, sf_dir):
    return AU.events(QR.manual_entries(spark, sf_dir), QD.requests_state(spark, sf_dir))


def _audit_sql(key, kinds="true"):
    return f"""SELECT type, resource_id, actor_email, tenant_id, {duck_iso('ts')} AS timestamp,
  row_number() OVER (PARTITION BY tenant_id, {key} ORDER BY ts DESC, type, resource_id, actor_email) AS rank
FROM ev WHERE {kinds}"""


def _audit_out(df):
    return df.select("type", "resource_id", "actor_email", "tenant_id", iso("timestamp").alias("timestamp"),
                     F.col("rank").cast("bigint").alias("rank"))


@register("qry09_actor_audit", with_fixtures(["declarations", "deletion_requests"], _audit_sql("actor_email"), _AUDIT_CTES))
def actor_audit(spark, sf_dir):
    """Every actor's registry and deletion events in each tenant, newest first."""
    return _audit_out(AU.by_actor(_audit_events(spark, sf_dir)))


@register("qry09_resource_audit", with_fixtures(["declarations", "deletion_requests"],
                                                _audit_sql("resource_id", "type LIKE 'PII_REGISTRY%'"), _AUDIT_CTES))
def resource_audit(spark, sf_dir):
    """The registry events of every resource in each tenant, newest first."""
    return _audit_out(AU.by_resource(QR.manual_entries(spark, sf_dir)))


# --- decrypted-view catalogue -------------------------------------------------------------------------

def _view_decls(users):
    seg = users.select("tenant_id", "segment").distinct()
    return seg.select(
        "tenant_id", F.lower("segment").alias("view_name"),
        F.when(F.col("segment") == "MACHINERY", F.array(F.lit("email"), F.lit("ssn")))
         .otherwise(F.array(F.lit("email"), F.lit("phone"))).alias("fields"),
        F.when(F.col("segment") == "HOUSEHOLD", F.lit(" ")).otherwise(F.lit("support case lookup")).alias("justification"),
        F.lit("analyst-0@example.com").alias("created_by"),
        F.concat(F.lit("svc-"), F.lower("segment")).alias("consumer"),
        FX.ts(FX.NOW_TS).alias("declared_at"))


@register("sta16_view_catalog", with_fixtures(["users"], """
SELECT tenant_id, lower(segment) AS view_name,
  CASE WHEN segment = 'HOUSEHOLD' OR segment = 'MACHINERY' THEN false ELSE true END AS created,
  CASE WHEN segment = 'HOUSEHOLD' OR segment = 'MACHINERY' THEN NULL
       WHEN segment = 'BUILDING' THEN 'revoked' ELSE 'active' END AS status,
  CASE WHEN segment = 'MACHINERY' THEN 'ssn' ELSE '' END AS missing_fields,
  CAST(CASE WHEN segment IN ('HOUSEHOLD', 'MACHINERY') THEN 1 ELSE 0 END AS INTEGER) AS n_errors
FROM (SELECT DISTINCT tenant_id, segment FROM users)"""))
def view_catalog(spark, sf_dir):
    """A view per (tenant, market segment); bad ones rejected; BUILDING views then revoked."""
    s = SC.build(spark, sf_dir)
    avail = V.available_fields(s.vault)
    cat, outcome = VW.declare(VW.empty_catalog(spark), _view_decls(s.users), avail, FX.ts(FX.NOW_TS))
    revokes = cat.where(F.col("view_name") == "building").select("tenant_id", "view_name",
                                                                 F.lit("analyst-1@example.com").alias("revoked_by"))
    cat = VW.revoke(cat, revokes, FX.ts(FX.NOW_TS))
    j = outcome.join(cat.select("tenant_id", "view_name", "status"), ["tenant_id", "view_name"], "left")
    return j.select("tenant_id", "view_name", "created", "status",
                    F.array_join("missing_fields", ",").alias("missing_fields"), F.size("errors").alias("n_errors"))


# --- sync runs ----------------------------------------------------------------------------------------------

def _runs_and_messages(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    runs = orders.select(F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"),
                         F.concat(F.lit("tenant-"), F.col("o_custkey") % 3).alias("tenant_id"),
                         F.lit(SC.VAULT_RESOURCE).alias("resource_id"),
                         F.col("o_orderdate").cast("timestamp").alias("started_at"))
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    chunks = li.select(F.concat(F.lit("run-"), F.col("l_orderkey")).alias("run_id"), F.lit("chunk").alias("kind"),
                       F.lit(None).cast("bigint").alias("chunks_total"),
                       F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("outcome"),
                       F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_linenumber").alias("chunk_id"))
    totals = (li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
              .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
              .where(F.col("l_orderkey") % 5 != 0)
              .select(F.concat(F.lit("run-"), F.col("l_orderkey")).alias("run_id"), F.lit("total").alias("kind"),
                      F.col("n").alias("chunks_total"), F.lit(None).cast("string").alias("outcome"),
                      (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("at"),
                      F.lit(None).cast("int").alias("chunk_id")))
    return runs, chunks.unionByName(totals)


@register("agg09_sync_runs", f"""
WITH tot AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS done,
             count(*) FILTER (WHERE l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1),
k AS (SELECT l_orderkey, l_shipdate AS at, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) AS kk
      FROM lineitem WHERE l_returnflag <> 'R')
SELECT 'run-' || o.o_orderkey AS run_id,
  CASE WHEN o.o_orderkey % 5 = 0 OR t.n IS NULL THEN 'enumerating'
       WHEN coalesce(c.done, 0) >= t.n THEN 'complete' ELSE 'running' END AS status,
  CASE WHEN o.o_orderkey % 5 <> 0 THEN t.n END AS chunks_total,
  coalesce(c.done, 0) AS chunks_completed, coalesce(c.failed, 0) AS chunks_failed,
  CASE WHEN o.o_orderkey % 5 <> 0 AND t.n IS NOT NULL AND coalesce(c.done, 0) >= t.n
       THEN {duck_iso("greatest(o.o_orderdate + INTERVAL 30 DAY, k.at)")} END AS completed_at
FROM orders o LEFT JOIN tot t ON t.l_orderkey = o.o_orderkey LEFT JOIN c ON c.l_orderkey = o.o_orderkey
LEFT JOIN k ON k.l_orderkey = o.o_orderkey AND k.kk = t.n""")
def sync_runs(spark, sf_dir):
    """Every order is a sync run, its line items are chunk outcomes; totals arrive late (or never, every 5th)."""
    runs, msgs = _runs_and_messages(spark, sf_dir)
    p = SR.progress(runs, msgs)
    return p.select("run_id", "status", "chunks_total", "chunks_completed", "chunks_failed",
                    iso("completed_at").alias("completed_at"))


# --- EXT-02 ghost scan / EXT-01 crawl --------------------------------------------------------------------------

SCAN_TARGETS = [("documents", "text"), ("conversations", "text"), ("pages", "html")]


def _resource(t):
    return f"bigquery:proj.raw.{t}"


def _scan(spark, sf_dir):
    out = None
    for t, c in SCAN_TARGETS:
        f = SCN.scan_columns(read_table(spark, sf_dir, t).select(c), _resource(t), [c])
        out = f if out is None else out.unionByName(f)
    return out


def _scan_sql():
    parts = []
    for t, c in SCAN_TARGETS:
        for p, rx in SCN.PATTERNS.items():
            parts.append(f"""SELECT '{_resource(t)}' AS resource_id, '{c}' AS "column", '{p}' AS pattern,
  count(*) FILTER (WHERE regexp_matches({c}, '{rx}')) AS rows_matched,
  CAST(coalesce(sum(len(regexp_extract_all({c}, '{rx}'))), 0) AS BIGINT) AS matches, CAST({SCN.CONFIDENCE[p]} AS DOUBLE) AS confidence
FROM {t}""")
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE rows_matched > 0"


@register("ext02_ghost_scan", _scan_sql())
def ghost_scan(spark, sf_dir):
    """Full scan of the free-text columns for e-mail, phone and name patterns (counts only, no values)."""
    return _scan(spark, sf_dir).select("resource_id", "column", "pattern", "rows_matched", "matches", "confidence")


@register("ext01_warehouse_crawl", "WITH s AS (" + _scan_sql() + """)
SELECT resource_id, 'UNREGISTERED' AS registry_status,
  coalesce((SELECT string_agg(DISTINCT "column", ',') FROM s WHERE s.resource_id = r.resource_id), '') AS undeclared_pii
FROM (VALUES """ + ", ".join(f"('{_resource(t)}')" for t, _ in SCAN_TARGETS) + ") r(resource_id)")
def warehouse_crawl(spark, sf_dir):
    """Crawl the raw text tables: inventory from their schemas, PII columns from the scan, against the registry."""
    from shredline.sources.tables import schema_rows
    inv = schema_rows(spark, {_resource(t): read_table(spark, sf_dir, t) for t, _c in SCAN_TARGETS}) \
        .select(F.col("table_name").alias("resource_id"), "column_name", "data_type")
    findings = SCN.crawl(inv, None, QR.composed_registry(spark, sf_dir), _scan(spark, sf_dir))
    return findings.select("resource_id", "registry_status", F.array_join("undeclared_pii", ",").alias("undeclared_pii"))
