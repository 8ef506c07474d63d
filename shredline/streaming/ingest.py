"""Lineage ingestion stream (STR-01, STR-02, STR-03, STR-07, SRC-06, SRC-07).

validate (VAL-04) → split valid / rejects → normalise (FN-16) → append.
Redelivered payloads are known by their delivery ids, which the stream keeps in its
state store (STR-02); a failing sink write diverts the batch to a quarantine folder
instead of failing the stream (SRC-07).
"""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredline.functions import validation as VAL
from shredline.operators import lineage as LIN


def validated(payloads: DataFrame) -> DataFrame:
    """Attach the VAL-04 error array to raw payload rows (stream or batch)."""
    return payloads.withColumn("errors", VAL.errors(VAL.lineage_event_rules(payloads)))


def once(payloads: DataFrame, id_col: str = "delivery_id") -> DataFrame:
    """STR-02 on a stream: each delivery id once, however late it comes again.

    The ids live in the state store (RocksDB with changelog checkpoints, see ``session``), hash-partitioned
    by id: a micro-batch looks up and writes its own ids only, however many came before. No watermark, so none
    is forgotten and no payload is dropped for being late. Payloads without an id are all kept.
    """
    return (payloads.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
            .unionByName(payloads.where(F.col(id_col).isNull())))


def new_deliveries(batch: DataFrame, deliveries_path: str, batch_id: int | None, id_col: str = "delivery_id") -> DataFrame:
    """STR-02 for batch jobs without a stream: payloads whose delivery id no earlier batch nor this one has brought before.

    The ids of all batches are kept in a table, so a redelivery is known however late
    it comes, and a payload is never dropped for being late. Every batch reads that table; a stream uses ``once``.
    """
    first = once(batch, id_col)
    try:
        known = batch.sparkSession.read.option("basePath", deliveries_path).parquet(deliveries_path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return first
    if batch_id is not None:            # a batch that is run again replaces its own ids
        known = known.where(F.col("batch") != batch_id)
    return first.join(known.select(id_col), id_col, "left_anti")


def ingest_batch(batch: DataFrame, events_path: str, rejects_path: str, quarantine_path: str,
                 now=None, batch_id: int | None = None, deliveries_path: str | None = None) -> None:
    """foreachBatch body: normalised valid events, rejects aside; quarantine on sink failure.

    With a ``batch_id`` every output goes to its own ``batch=<id>`` folder in
    overwrite mode, so a micro-batch replayed after a failure does not
    duplicate events. With ``deliveries_path`` redelivered payloads are left out. The
    normalised batch is persisted, so a quarantined event is the very event that could not be written.
    """
    if deliveries_path is not None:
        batch = new_deliveries(batch, deliveries_path, batch_id)
    v = validated(batch).persist()
    good = LIN.normalise(v.where(F.size("errors") == 0).drop("errors"), now).persist()
    bad = v.where(F.size("errors") > 0)
    part = "" if batch_id is None else f"/batch={batch_id}"
    mode = "append" if batch_id is None else "overwrite"
    good.count()                # an error in the rules or the data is not a sink failure
    try:
        good.write.mode(mode).parquet(events_path + part)
    except (Py4JJavaError, PySparkException):  # SRC-07: keep the events, let the stream go on
        good.write.mode(mode).json(quarantine_path + part)
    bad.write.mode(mode).parquet(rejects_path + part)
    if deliveries_path is not None:         # last: a failure before this line brings the batch again
        v.select("delivery_id").write.mode(mode).parquet(deliveries_path + part)
    good.unpersist()
    v.unpersist()


def ingest_lineage(payloads: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, events: str | None = None):
    """STR-01: start the ingestion stream; returns the StreamingQuery. ``events``: a sink folder outside of ``root``."""
    events = events or os.path.join(root, "events")
    rejects, quarantine = (os.path.join(root, p) for p in ("rejects", "quarantine"))

    def body(batch, batch_id):
        ingest_batch(batch, events, rejects, quarantine, batch_id=batch_id)

    new = once(payloads) if "delivery_id" in payloads.columns else payloads
    w = new.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def hot_path(events: DataFrame) -> DataFrame:
    """STR-03: running destination set and last-seen per user (resource-level ghost findings excluded)."""
    e = events.where(~LIN.is_resource_level_ghost())
    return e.groupBy("tenant_id", "user_id").agg(F.collect_set("destination").alias("destinations"),
                                                 F.max("timestamp").alias("last_seen"))


def dead_letters(wipe_outcomes: DataFrame) -> DataFrame:
    """STR-07: FAILED wipe outcomes as dead-letter rows (filtered stream)."""
    return wipe_outcomes.where(F.col("status") == "FAILED").select(
        "deletion_request_id", "destination", F.lit("ERROR").alias("severity"),
        F.lit("janitor").alias("source"), F.col("updated_at").alias("timestamp"))
