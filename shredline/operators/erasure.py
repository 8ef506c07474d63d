"""The erasure job: one batch over all pending deletion requests.

SHRED_REQUESTED → KEY_DESTROYED (key material removed, old versions purged)
→ CASCADE_PENDING (plan: connector wipes + tenant redaction resources)
→ stored tables redacted, wipes executed by connectors, outcomes recorded (suffix per strategy)
→ CASCADE_COMPLETE and CERTIFICATE_ISSUED (claims, chain), or
  CASCADE_PARTIAL_FAILURE (certificate withheld, failures dead-lettered).
Every step is a DataFrame transformation; state tables are written by the
caller (``sources.state.write_version``) between runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredline.operators import certificates as CERT
from shredline.operators import connectors as CN
from shredline.operators import deletion as D
from shredline.operators import keys as K
from shredline.operators import lineage as LIN
from shredline.operators import redaction as R
from shredline.session import ensure_checkpoint_dir


@dataclass
class ErasureRun:
    key_registry: DataFrame
    requests: DataFrame
    wipes: DataFrame
    decisions: DataFrame
    certificates: DataFrame
    heads: DataFrame
    dead_letters: DataFrame
    events: DataFrame


# Janitor event types.
WIPE_STARTED = "SaaS_WIPE_STARTED"
WIPE_COMPLETED = "SaaS_WIPE_COMPLETED"


def janitor_events(results: DataFrame, now: Column) -> DataFrame:
    """STA-18 events: a STARTED event per attempt and a COMPLETED event (final status) per task."""
    base = results.select("tenant_id", "user_id", "destination", "status", "attempts", "deletion_request_id")
    started = (base.where(F.col("attempts") > 0)
               .select("tenant_id", "user_id", "destination",
                       F.explode(F.sequence(F.lit(1), F.col("attempts").cast("int"))).alias("attempt"))
               .select("tenant_id", "user_id", "destination", F.lit(WIPE_STARTED).alias("event_type"),
                       F.to_json(F.struct(F.col("destination").alias("destination_system"), "attempt")).alias("context")))
    done = base.select(
        "tenant_id", "user_id", "destination", F.lit(WIPE_COMPLETED).alias("event_type"),
        F.to_json(F.struct(F.col("destination").alias("destination_system"),
                           F.when(F.col("status") == "SUCCEEDED", "COMPLETE").otherwise("FAILED").alias("status")))
        .alias("context"))
    ev = started.unionByName(done)
    return ev.select(
        F.expr("uuid()").alias("event_id"), "tenant_id", "user_id", F.lit("janitor-service").alias("source"),
        "destination", now.alias("timestamp"),
        F.to_json(F.map_concat(F.create_map(F.lit("event_type"), F.col("event_type")),
                               F.from_json("context", "map<string,string>"))).alias("context"),
        F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("data_classification"))


OUTCOME = ["deletion_request_id", "tenant_id", "user_id", "destination", "status", "attempts", "records_found", "rows_affected", "error"]


def run_stored(tasks: DataFrame, stores: list[R.StoredTable]) -> DataFrame:
    """Erase every task's user in the table that its ``store`` names, all users of a table in one job.

    A table that fails leaves FAILED outcomes with the error's first line for its own tasks; the
    others go on. A user without rows has a SUCCEEDED outcome of 0 rows. Tasks of other destinations have no outcome.
    """
    spark = tasks.sparkSession
    out = []
    for store in stores:
        own = tasks.where(F.col("store") == store.destination)
        users = own.select("tenant_id", "user_id").distinct()
        if users.isEmpty():
            continue
        base = own.select("deletion_request_id", "tenant_id", "user_id", "destination")
        try:
            counts = R.erase_and_count(spark, store, users)
        except Exception as failure:  # noqa: BLE001  a table of its own; the outcome says what happened
            rows, error = base.withColumn("rows_affected", F.lit(None).cast("long")), str(failure).strip().splitlines()[0][:300]
        else:
            on = ["tenant_id", "user_id"] if store.tenant_col else ["user_id"]
            rows, error = base.join(counts, on, "left").withColumn("rows_affected", F.coalesce("rows_affected", F.lit(0))), None
        out.append(rows.select(
            "deletion_request_id", "tenant_id", "user_id", "destination", F.lit("FAILED" if error else "SUCCEEDED").alias("status"),
            F.lit(1).cast("long").alias("attempts"), F.col("rows_affected").alias("records_found"), "rows_affected",
            F.lit(error).cast("string").alias("error")))
    done = reduce(DataFrame.unionByName, out) if out else tasks.limit(0).select(
        "deletion_request_id", "tenant_id", "user_id", "destination", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("status", "string"), ("attempts", "long"), ("records_found", "long"), ("rows_affected", "long"), ("error", "string"))])
    return done.checkpoint()


def erase(requests: DataFrame, key_registry: DataFrame, events: DataFrame, resources: DataFrame,
          connectors: list, tenant_keys: DataFrame, now: Column, heads: DataFrame | None = None,
          previous_wipes: DataFrame | None = None, stores: Sequence[R.StoredTable] = ()) -> ErasureRun:
    """Run the cascade for every request that is due: new ones, failed ones again, certificates still missing.

    * SHRED_REQUESTED: the key is destroyed, then the cascade runs;
    * CASCADE_PARTIAL_FAILURE: the cascade runs again over the whole plan;
    * CASCADE_COMPLETE: only the certificate is still to be issued.

    ``resources``: (tenant_id, resource_id, strategy) of source-side redaction
    targets. Those (and hot-path destinations) that one of ``stores`` names are
    erased here by ``run_stored``, except where ``previous_wipes`` has a SUCCEEDED
    outcome already; the other hot-path destinations are wiped by
    ``connectors``; outcomes of any other resource must be in ``previous_wipes``. A request becomes
    CERTIFICATE_ISSUED only with its row in the chain; one whose claims can't be made
    stays CASCADE_COMPLETE and is taken up by the next run.
    """
    spark = requests.sparkSession
    due = requests.where(F.col("status").isin("SHRED_REQUESTED", "CASCADE_PARTIAL_FAILURE"))
    ids = due.select("deletion_request_id", "tenant_id", "user_id")
    fresh = requests.where(F.col("status") == "SHRED_REQUESTED").select("deletion_request_id", "tenant_id", "user_id")
    again = requests.where(F.col("status") == "CASCADE_PARTIAL_FAILURE").select("deletion_request_id")

    def moves(rows, to, seconds):
        to = F.lit(to) if isinstance(to, str) else to
        return rows.select("deletion_request_id", to.alias("to_status"), F.lit("erasure").alias("operation_id"),
                           (now + F.make_interval(secs=F.lit(seconds))).alias("at"))

    ensure_checkpoint_dir(spark)

    # 1. destroy keys
    reg = K.shred(key_registry, fresh, now).state.checkpoint(eager=True)
    state, dec1 = D.advance_once(requests, moves(fresh, "KEY_DESTROYED", 0).unionByName(
        moves(again, "CASCADE_IN_PROGRESS", 0)))

    # 2. plan and execute connector wipes (hot-path destinations with a connector)
    hot = LIN.add_destinations(reg.join(ids.select("tenant_id", "user_id").distinct(), ["tenant_id", "user_id"], "left_semi"),
                               events)
    tasks = LIN.cleanup_plan(ids, hot).join(ids, ["tenant_id", "user_id"])
    held = [t.destination for t in stores]
    planned = tasks.select(*OUTCOME[:4], F.lower("destination").alias("store")).where(F.col("store").isin(held))
    planned = planned.unionByName(ids.join(resources.select(
        "tenant_id", F.concat("resource_id", F.lit("::"), "strategy").alias("destination")).where(
            F.col("destination").isin(held)).distinct(), "tenant_id").select(*OUTCOME[:4], F.col("destination").alias("store"))).distinct()
    if previous_wipes is not None:
        achieved = D.latest_wipes(previous_wipes).where(F.col("status") == "SUCCEEDED").select("deletion_request_id", "destination")
        planned = planned.join(achieved, ["deletion_request_id", "destination"], "left_anti").select(*OUTCOME[:4], "store")
    stored = run_stored(planned.checkpoint(), list(stores))
    # External calls happen exactly once: the results are checkpointed to the shared checkpoint
    # folder before the three consumers below (a task retry re-runs only its own, idempotent wipes).
    results = (CN.run_wipes(tasks.where(~F.lower("destination").isin(held)), connectors)
               .withColumn("rows_affected", F.lit(None).cast("bigint")).select(*OUTCOME).checkpoint(eager=True).unionByName(stored))
    wipes = results.select("deletion_request_id", "destination", "status", "attempts", "records_found",
                           "rows_affected", "error", now.alias("updated_at"))
    if previous_wipes is not None:
        wipes = previous_wipes.unionByName(wipes, allowMissingColumns=True)
    state = D.record_wipes(state, wipes)

    # 3. decide: nothing planned → COMPLETE at once; all recorded → AGG-10; else still in progress
    # Written once: the decisions feed three branches, the new state the claims and the run after this one.
    outcome = D.cascade(ids, tasks.select("tenant_id", "user_id", "destination"), resources, wipes).checkpoint(eager=True)
    started = outcome.join(fresh.select("deletion_request_id"), "deletion_request_id", "left_semi")
    open_again = (F.col("next_status") == "CASCADE_IN_PROGRESS") & ~F.col("_fresh")
    known = outcome.join(fresh.select("deletion_request_id", F.lit(True).alias("_fresh")), "deletion_request_id", "left") \
        .withColumn("_fresh", F.coalesce("_fresh", F.lit(False)))
    state, dec2 = D.advance(state, moves(started, "CASCADE_PENDING", 1).unionByName(
        moves(known.where(~open_again), F.col("next_status"), 2)))
    state = state.checkpoint(eager=True)

    # 4. certificates (claims read the recorded wipes and the shredded keys), then the status of those that have one
    done = state.where(F.col("status") == "CASCADE_COMPLETE")
    claims = CERT.claims(done, reg, wipes, events, now, connectors=[c.name.lower() for c in connectors] + [d for d in held if "::" not in d])
    chain = CERT.append_chain(claims, tenant_keys, heads).checkpoint(eager=True)
    state, dec3 = D.advance_once(state, moves(chain, "CERTIFICATE_ISSUED", 3))
    state = state.checkpoint(eager=True)
    dec2 = dec2.unionByName(dec3)
    new_heads = CERT.chain_heads(chain)
    if heads is not None:
        new_heads = heads.join(new_heads.select("tenant_id"), "tenant_id", "left_anti").unionByName(new_heads)

    dlq = D.dead_letters(results.withColumnRenamed("error", "last_error"), now)
    return ErasureRun(reg, state, wipes, dec1.unionByName(dec2), chain, new_heads, dlq,
                      janitor_events(results, now))
