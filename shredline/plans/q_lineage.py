"""Lineage queries (AGG-01/02, WIN-06, JOIN-03/08/10, STA-05, FIL-15, FN-16..18, QRY-05/10, SRT-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shredline.operators import lineage as LIN
from shredline.operators.util import iso, join_sorted
from shredline.plans import scenario as SC
from shredline.plans.catalog import register
from shredline.plans.oracle import duck_iso, with_fixtures
from shredline.sources import fixtures as FX

# From the events themselves: an error event is a scan finding in its table, of no known user for even ids.
GHOST_SQL = """SELECT tenant, who AS user_id, scan AS source, place AS destination, place AS resource_id, 'bigquery' AS system,
  'email' AS column_name, 'EMAIL' AS pattern, n AS finding_count, CAST(0.9 AS DOUBLE) AS confidence, scan AS scanner,
  max(seen) AS last_seen, tenant AS tenant_id
FROM (SELECT concat('tenant-', user_id % 3) AS tenant, if(user_id % 2 = 0, 'UNKNOWN', concat('user-', user_id)) AS who,
        'ghost-data-scanner' AS scan, concat('bigquery:proj.ds.table_', event_id % 20) AS place,
        CAST(event_id % 5 AS BIGINT) AS n, CAST(ts AS TIMESTAMP) AS seen
      FROM events WHERE event_type = 'error')
GROUP BY tenant, who, scan, place, n"""

HOT_SQL = """SELECT tenant_id, user_id, list_sort(list(DISTINCT destination)) AS destinations
FROM lineage_events
WHERE NOT (coalesce(coalesce(data_classification, json_extract_string(context, '$.data_classification')) = 'GHOST_DATA'
           AND user_id = 'UNKNOWN', false))
GROUP BY tenant_id, user_id"""

REQ_SQL = "SELECT DISTINCT tenant_id, user_id FROM deletion_requests"


def _events(spark, sf_dir):
    return FX.fixture(spark, sf_dir, "lineage_events")


def _hot_registry(spark, sf_dir):
    """Key registry (after the shred) with destinations maintained from lineage (STA-05)."""
    s = SC.build(spark, sf_dir)
    return LIN.add_destinations(s.registry, _events(spark, sf_dir))


# --- AGG-01 / SRT-04 -----------------------------------------------------------------------------

@register("agg01_user_lineage", with_fixtures(["lineage_events"], f"""
SELECT tenant_id, user_id, destination, {duck_iso('max(timestamp)')} AS last_seen
FROM lineage_events GROUP BY tenant_id, user_id, destination"""))
def user_lineage(spark, sf_dir):
    ul = LIN.user_lineage(_events(spark, sf_dir))
    return ul.select("tenant_id", "user_id", "destination", iso("last_seen").alias("last_seen"))


@register("srt04_lineage_recent", with_fixtures(["lineage_events"], f"""
SELECT tenant_id, user_id, destination, {duck_iso('last_seen')} AS last_seen,
  row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY last_seen DESC, destination) AS rank FROM (
  SELECT tenant_id, user_id, destination, max(timestamp) AS last_seen FROM lineage_events
  GROUP BY tenant_id, user_id, destination)"""))
def lineage_recent(spark, sf_dir):
    """Every user's destinations, newest first."""
    return LIN.recent_lineage(_events(spark, sf_dir)).withColumn("last_seen", iso("last_seen"))


# --- AGG-02 + WIN-06 ------------------------------------------------------------------------------

@register("agg02_ghost_findings", with_fixtures(["lineage_events"], f"""
SELECT tenant_id, nullif(user_id, 'UNKNOWN') AS req_user_id,
  CASE WHEN user_id = 'UNKNOWN' THEN 'RESOURCE_LEVEL' ELSE 'USER_LINKED' END AS scope,
  resource_id, system, column_name, pattern, finding_count, confidence, scanner, {duck_iso('last_seen')} AS last_seen,
  row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY last_seen DESC, destination, finding_count) AS rank
FROM ghost g WHERE user_id <> 'UNKNOWN'
  OR tenant_id IN (SELECT tenant_id FROM lineage_events WHERE user_id <> 'UNKNOWN')""", [("ghost", GHOST_SQL)]))
def ghost_findings(spark, sf_dir):
    """Every user seen in lineage: all its own findings, and those of each tenant's resources once."""
    ev = _events(spark, sf_dir)
    req = ev.where(F.col("user_id") != "UNKNOWN").select("tenant_id", "user_id")
    g = LIN.ghost_findings(req, ev)
    return g.withColumn("last_seen", iso("last_seen")).withColumn("rank", F.col("rank").cast("bigint"))


# --- FIL-15 / STA-05 ----------------------------------------------------------------------------------

@register("sta05_hot_path_destinations", with_fixtures(["users", "lineage_events"], """
SELECT u.tenant_id, u.user_id, coalesce(array_to_string(h.destinations, ','), '') AS destinations
FROM users u LEFT JOIN hot h ON h.tenant_id = u.tenant_id AND h.user_id = u.user_id""", [("hot", HOT_SQL)]))
def hot_path(spark, sf_dir):
    """Destination sets on the key rows; resource-level ghost findings are not destinations; unknown users ignored."""
    reg = _hot_registry(spark, sf_dir)
    return reg.select("tenant_id", "user_id", join_sorted("destinations").alias("destinations"))


# --- JOIN-03 cleanup plan --------------------------------------------------------------------------

@register("join03_cleanup_plan", with_fixtures(["users", "lineage_events", "deletion_requests"], """
SELECT DISTINCT r.tenant_id, r.user_id, d.destination, 'PENDING' AS status
FROM (""" + REQ_SQL + """) r JOIN users u ON u.tenant_id = r.tenant_id AND u.user_id = r.user_id
JOIN (SELECT tenant_id, user_id, unnest(destinations) AS destination FROM hot) d
  ON d.tenant_id = r.tenant_id AND d.user_id = r.user_id
WHERE lower(d.destination) IN ('hubspot', 'salesforce')""", [("hot", HOT_SQL)]))
def cleanup_plan(spark, sf_dir):
    """Wipe tasks for every deletion request's user: hot-path destinations with a connector."""
    req = FX.fixture(spark, sf_dir, "deletion_requests")
    return LIN.cleanup_plan(req, _hot_registry(spark, sf_dir)).select("tenant_id", "user_id", "destination", "status")


# --- JOIN-08 / QRY-10 ----------------------------------------------------------------------------------

@register("qry10_user_lineage_fallback", with_fixtures(["users", "lineage_events"], f"""
SELECT e.tenant_id, e.user_id, e.destination, {duck_iso('max(e.timestamp)')} AS last_seen, 'warehouse' AS read_model
FROM lineage_events e JOIN users u ON u.tenant_id = e.tenant_id AND u.user_id = e.user_id
WHERE e.source = 'api-ingestion' GROUP BY e.tenant_id, e.user_id, e.destination
UNION ALL
SELECT h.tenant_id, h.user_id, unnest(h.destinations), CASE WHEN u.custkey % 7 = 0 THEN {duck_iso("TIMESTAMP '" + FX.SHRED_TS + "'")}
  ELSE {duck_iso("TIMESTAMP '" + FX.KEYGEN_TS + "'")} END, 'hot-path'
FROM hot h JOIN users u ON u.tenant_id = h.tenant_id AND u.user_id = h.user_id
WHERE NOT EXISTS (SELECT 1 FROM lineage_events e WHERE e.tenant_id = h.tenant_id AND e.user_id = h.user_id
                  AND e.source = 'api-ingestion')""", [("hot", HOT_SQL)]))
def lineage_fallback(spark, sf_dir):
    """Lineage of every customer from a warehouse that holds API events only; the others' destinations from their key row."""
    s = SC.build(spark, sf_dir)
    warehouse = _events(spark, sf_dir).where(F.col("source") == "api-ingestion")
    out = LIN.lineage_with_fallback(s.users, warehouse, _hot_registry(spark, sf_dir))
    return out.select("tenant_id", "user_id", "destination", iso("last_seen").alias("last_seen"), "read_model")


# --- JOIN-10 / QRY-05 deletion plan -----------------------------------------------------------------------

@register("qry05_deletion_plan", with_fixtures(["users", "lineage_events", "deletion_requests"], """
SELECT r.tenant_id, r.user_id,
  coalesce(array_to_string(list_sort(list(DISTINCT e.destination) FILTER (WHERE e.destination IS NOT NULL)), ','), '')
    AS impacted_destinations,
  CAST(coalesce(min(o.n), 0) + coalesce(min(s.n), 0) AS BIGINT) AS ghost_findings,
  (count(e.destination) > 0 OR coalesce(min(o.n), 0) + coalesce(min(s.n), 0) > 0) AS found
FROM (""" + REQ_SQL + """) r
LEFT JOIN lineage_events e ON e.tenant_id = r.tenant_id AND e.user_id = r.user_id
LEFT JOIN (SELECT tenant_id, user_id, count(*) AS n FROM ghost WHERE user_id <> 'UNKNOWN' GROUP BY 1, 2) o
  ON o.tenant_id = r.tenant_id AND o.user_id = r.user_id
LEFT JOIN (SELECT tenant_id, count(*) AS n FROM ghost WHERE user_id = 'UNKNOWN' GROUP BY 1) s ON s.tenant_id = r.tenant_id
GROUP BY r.tenant_id, r.user_id""", [("ghost", GHOST_SQL)]))
def deletion_plan(spark, sf_dir):
    """Deletion plan for the user of every deletion request."""
    req = FX.fixture(spark, sf_dir, "deletion_requests")
    plan = LIN.deletion_plan(req, _events(spark, sf_dir), _hot_registry(spark, sf_dir))
    return plan.select("tenant_id", "user_id", F.array_join("impacted_destinations", ",").alias("impacted_destinations"),
                       F.col("ghost_findings").cast("bigint").alias("ghost_findings"), "found")


# --- FN-16 / VAL-04 normalisation ------------------------------------------------------------------------

@register("fn16_normalise_events", """
SELECT CASE WHEN user_id % 4 = 0 THEN 'default-tenant' ELSE concat('tenant-', user_id % 3) END AS tenant_id,
  CASE WHEN user_id % 5 = 0 THEN 'UNKNOWN' ELSE concat('u', user_id) END AS user_id,
  event_type AS source, coalesce(json_extract_string(props, '$.k'), '') AS k,
  upper(event_type) AS event_type_ctx, CASE WHEN event_id % 2 = 0 THEN 'PII' ELSE 'UNKNOWN' END AS data_classification,
  'NONE' AS deletion_request_id
FROM events""")
def normalise_events(spark, sf_dir):
    """Raw payloads with camel/snake aliases and caller context → the 7-field record, read back by JSON path."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("tenant-"), F.col("user_id") % 3)).alias("tenantId"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("u"), F.col("user_id"))).alias("user_id"),
        F.col("event_type").alias("source"), F.lit("warehouse").alias("destination"),
        F.upper("event_type").alias("eventType"),
        F.when(F.col("event_id") % 2 == 0, F.lit("PII")).alias("data_classification"),
        F.col("props").alias("context"))
    ev = LIN.normalise(raw)
    return ev.select("tenant_id", "user_id", "source",
                     F.coalesce(F.get_json_object("context", "$.k"), F.lit("")).alias("k"),
                     F.get_json_object("context", "$.event_type").alias("event_type_ctx"),
                     F.get_json_object("context", "$.data_classification").alias("data_classification"),
                     F.get_json_object("context", "$.deletion_request_id").alias("deletion_request_id"))
