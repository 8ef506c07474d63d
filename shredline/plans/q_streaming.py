"""Streaming queries (STR-01..07). Each runs its stream over all available input (availableNow)
into the shared checkpoint folder and returns the written result; where the stream must end in
the same state as the batch operator, the batch oracle is reused."""

from __future__ import annotations

from pyspark.sql import functions as F

from shredline.operators.util import iso, join_sorted
from shredline.plans import q_certificates as QC
from shredline.plans import q_deletion, q_governance  # noqa: F401  (register the queries whose oracles are reused)
from shredline.plans import scenario as SC
from shredline.plans.catalog import QUERIES, register
from shredline.plans.oracle import duck_iso, with_fixtures
from shredline.plans.q_lineage import HOT_SQL
from shredline.sources import fixtures as FX
from shredline.streaming import ingest as ING
from shredline.streaming import stateful as ST
from shredline.streaming.sources import run_available, scratch, stream_table


def _fixture_stream(spark, sf_dir, name):
    table, exprs = FX.FIXTURES[name]
    return stream_table(spark, sf_dir, table).selectExpr(*exprs)


# --- STR-01 / STR-02 ingestion ----------------------------------------------------------------------

def _payloads(raw):
    return raw.select(
        F.concat(F.lit("d-"), F.col("event_id")).alias("delivery_id"), F.col("ts").cast("timestamp").alias("received_at"),
        F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("tenant-"), F.col("user_id") % 3)).alias("tenantId"),
        F.when(F.col("user_id") % 13 == 0, F.lit("bad user!")).otherwise(F.concat(F.lit("u"), F.col("user_id")))
         .alias("user_id"),
        F.col("event_type").alias("source"), F.concat(F.lit("store-"), F.col("event_id") % 7).alias("destination"),
        F.upper("event_type").alias("eventType"),
        F.when(F.col("event_id") % 97 == 0, F.lit("SECRET")).alias("data_classification"),
        F.col("props").alias("context"))


@register("str01_ingest_lineage", """
SELECT CASE WHEN user_id % 4 = 0 THEN 'default-tenant' ELSE 'tenant-' || (user_id % 3) END AS tenant_id,
  'u' || user_id AS user_id, event_type AS source, 'store-' || (event_id % 7) AS destination,
  upper(event_type) AS event_type, coalesce(json_extract_string(props, '$.k'), '') AS k
FROM events WHERE user_id % 13 <> 0 AND event_id % 97 <> 0""")
def ingest_lineage(spark, sf_dir):
    """Payload stream delivered twice (redelivery), deduplicated, validated, normalised and appended."""
    raw = stream_table(spark, sf_dir, "events")
    p = _payloads(raw).unionByName(_payloads(stream_table(spark, sf_dir, "events")))
    root = scratch(spark, "ingest")
    ING.ingest_lineage(p, root, f"{root}/checkpoint").awaitTermination()
    ev = spark.read.parquet(f"{root}/events")
    return ev.select("tenant_id", "user_id", "source", "destination",
                     F.get_json_object("context", "$.event_type").alias("event_type"),
                     F.coalesce(F.get_json_object("context", "$.k"), F.lit("")).alias("k"))


# --- STR-03 hot path ----------------------------------------------------------------------------------

@register("str03_hot_path_stream", with_fixtures(["lineage_events"], f"""
SELECT h.tenant_id, h.user_id, array_to_string(h.destinations, ',') AS destinations, {duck_iso('m.last_seen')} AS last_seen
FROM hot h JOIN (SELECT tenant_id, user_id, max(timestamp) AS last_seen FROM lineage_events
  WHERE NOT (coalesce(coalesce(data_classification, json_extract_string(context, '$.data_classification')) = 'GHOST_DATA'
             AND user_id = 'UNKNOWN', false)) GROUP BY 1, 2) m ON m.tenant_id = h.tenant_id AND m.user_id = h.user_id""",
    [("hot", HOT_SQL)]))
def hot_path_stream(spark, sf_dir):
    """Running destination set and last-seen per user, maintained by a streaming aggregation."""
    agg = ING.hot_path(_fixture_stream(spark, sf_dir, "lineage_events"))
    changed = run_available(agg, "hot_path", output_mode="update")
    out = (changed.groupBy("tenant_id", "user_id")
           .agg(F.max_by(F.struct("destinations", "last_seen"), "_batch_id").alias("s")).select("tenant_id", "user_id", "s.*"))
    return out.select("tenant_id", "user_id", join_sorted("destinations").alias("destinations"),
                      iso("last_seen").alias("last_seen"))


# --- STR-04 sync progress ------------------------------------------------------------------------------

@register("str04_sync_progress_stream", QUERIES["agg09_sync_runs"][1].replace(
    "FROM orders o LEFT JOIN tot t", "FROM orders o JOIN tot t"))
def sync_progress_stream(spark, sf_dir):
    """Out-of-order chunk outcomes and late totals folded per run with O(1) state."""
    li = stream_table(spark, sf_dir, "lineitem")
    chunks = li.select(F.concat(F.lit("run-"), F.col("l_orderkey")).alias("run_id"), F.lit("chunk").alias("kind"),
                       F.lit(None).cast("bigint").alias("chunks_total"),
                       F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("outcome"),
                       F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_linenumber").alias("chunk_id"))
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = stream_table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 5 != 0)
    totals = orders.join(counts, orders["o_orderkey"] == counts["l_orderkey"]).select(
        F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), F.lit("total").alias("kind"),
        F.col("n").alias("chunks_total"), F.lit(None).cast("string").alias("outcome"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("at"),
        F.lit(None).cast("int").alias("chunk_id"))
    out = run_available(ST.sync_progress(chunks.unionByName(totals)), "sync_progress", output_mode="update")
    latest = out.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("run_id", "_batch_id")]),
                                                "_batch_id").alias("s")).select("run_id", "s.*")
    return latest.select("run_id", "status", "chunks_total", "chunks_completed", "chunks_failed",
                         iso("completed_at").alias("completed_at"))


# --- STR-05 request status -------------------------------------------------------------------------------

@register("str05_request_status_stream", QUERIES["sta07_advance_requests"][1].replace(
    "SELECT deletion_request_id, tenant_id, user_id, from_status, to_status, accepted FROM (",
    "SELECT deletion_request_id, from_status, to_status, accepted FROM (", 1).replace(
    "SELECT deletion_request_id, tenant_id, user_id, after1, 'CASCADE_PARTIAL_FAILURE',",
    "SELECT deletion_request_id, after1, 'CASCADE_PARTIAL_FAILURE',", 1))
def request_status_stream(spark, sf_dir):
    """Snapshots and moves of deletion requests through the live state machine; rejects flagged."""
    r = _fixture_stream(spark, sf_dir, "deletion_requests")
    snap = r.select("deletion_request_id", F.lit("snapshot").alias("kind"), F.col("status").alias("to_status"),
                    F.lit("").alias("operation_id"), "created_at")
    snap = snap.withColumnRenamed("created_at", "at")
    m1 = r.select("deletion_request_id", F.lit("move").alias("kind"),
                  F.expr("CASE orderkey % 4 WHEN 0 THEN 'KEY_DESTROYED' WHEN 1 THEN 'CASCADE_PENDING' "
                         "WHEN 2 THEN 'CASCADE_COMPLETE' ELSE 'CERTIFICATE_ISSUED' END").alias("to_status"),
                  F.concat(F.lit("mv1-"), F.col("orderkey")).alias("operation_id"),
                  (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("at"))
    m2 = r.where(F.col("orderkey") % 3 == 0).select(
        "deletion_request_id", F.lit("move").alias("kind"), F.lit("CASCADE_PARTIAL_FAILURE").alias("to_status"),
        F.concat(F.lit("mv2-"), F.col("orderkey")).alias("operation_id"),
        (F.col("created_at") + F.expr("INTERVAL 2 DAY")).alias("at"))
    out = run_available(ST.request_status(snap.unionByName(m1).unionByName(m2)), "request_status")
    return out.select("deletion_request_id", "from_status", "to_status", "accepted")


# --- STR-06 chain append ------------------------------------------------------------------------------------

@register("str06_chain_stream", QUERIES["qry11_issue_certificates"][1])
def chain_stream(spark, sf_dir):
    """Claims of completed requests land in a folder (delivered twice); the stream chains each once per tenant."""
    s = SC.build(spark, sf_dir)
    claims = QC._claims(spark, sf_dir, s).join(s.tenant_keys.select("tenant_id", "sign_key"), "tenant_id")
    landing = scratch(spark, "claims")
    claims.write.mode("overwrite").parquet(landing)
    claims.write.mode("append").parquet(landing)  # a redelivery of the same completions
    stream = spark.readStream.schema(spark.read.parquet(landing).schema).parquet(landing)
    out = run_available(ST.chain(ST.dedup_requests(stream)), "chain")
    return out.select("tenant_id", "sequence", "deletion_request_id", "previous_hash", "certificate_hash")


# --- STR-07 dead letters ----------------------------------------------------------------------------------------

@register("str07_dead_letters_stream", with_fixtures(["wipes"], f"""
SELECT deletion_request_id, destination, 'ERROR' AS severity, 'janitor' AS source, {duck_iso('updated_at')} AS timestamp
FROM wipes WHERE status = 'FAILED'"""))
def dead_letters_stream(spark, sf_dir):
    out = run_available(ING.dead_letters(_fixture_stream(spark, sf_dir, "wipes")), "dead_letters")
    return out.select("deletion_request_id", "destination", "severity", "source", iso("timestamp").alias("timestamp"))
