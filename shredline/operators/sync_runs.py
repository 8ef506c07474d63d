"""Vault sync runs (AGG-09, STA-15, EXT-03 watermark scan).

Run progress arrives as messages in any order: one ``total`` message (the
chunk count, known once enumeration ends) and one ``chunk`` message per
chunk outcome. The batch form folds them with aggregates, so the result does
not depend on arrival order; the streaming form is in ``streaming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def progress(runs: DataFrame, messages: DataFrame) -> DataFrame:
    """State per run: enumerating → running → complete; ``completed_at`` set once.

    ``runs``: (run_id, tenant_id, resource_id, started_at).
    ``messages``: (run_id, kind 'total'|'chunk', chunks_total, outcome 'completed'|'failed', at).
    A run is complete when the total is known and completed chunks ≥ total;
    completed_at = the moment that first held (the later of the total message
    and the total-th completed chunk). Messages for unknown runs are ignored.
    """
    # One histogram of the outcomes by time, with partial sums, then one row per run: totals, counts and the
    # completions as (time, number), in which the k-th is found by a running sum. A run of any number of chunks
    # holds as many entries as there are different times.
    kind, done = F.col("kind"), F.col("outcome") == "completed"
    hist = messages.groupBy("run_id", "kind", "outcome", "at").agg(F.count(F.lit(1)).alias("n"), F.max("chunks_total").alias("total"))
    is_total, is_chunk = kind == "total", kind == "chunk"
    per_run = hist.groupBy("run_id").agg(
        F.max_by(F.when(is_total, F.col("total")), F.when(is_total, F.col("at"))).alias("chunks_total"),
        F.max(F.when(is_total, F.col("at"))).alias("_total_at"),
        F.coalesce(F.sum(F.when(is_chunk & done, F.col("n"))), F.lit(0)).alias("chunks_completed"),
        F.coalesce(F.sum(F.when(is_chunk & (F.col("outcome") == "failed"), F.col("n"))), F.lit(0)).alias("chunks_failed"),
        F.sort_array(F.collect_list(F.when(is_chunk & done, F.struct("at", "n")))).alias("_times"))
    k = F.greatest(F.col("chunks_total"), F.lit(1))
    none = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("timestamp").alias("at"))
    kth = F.aggregate("_times", none, lambda acc, x: F.struct(
        (acc["seen"] + x["n"]).alias("seen"),
        F.when((acc["seen"] < k) & (acc["seen"] + x["n"] >= k), x["at"]).otherwise(acc["at"]).alias("at")), lambda acc: acc["at"])
    j = runs.join(per_run.withColumn("_kth_at", kth).drop("_times"), "run_id", "left")
    done = F.col("chunks_total").isNotNull() & (F.coalesce("chunks_completed", F.lit(0)) >= F.col("chunks_total"))
    return j.select(
        "run_id", "tenant_id", "resource_id", "started_at",
        F.when(F.col("chunks_total").isNull(), "enumerating").when(done, "complete").otherwise("running").alias("status"),
        "chunks_total", F.coalesce("chunks_completed", F.lit(0)).alias("chunks_completed"),
        F.coalesce("chunks_failed", F.lit(0)).alias("chunks_failed"),
        F.when(done, F.when(F.col("chunks_total") == 0, F.col("_total_at"))
               .otherwise(F.greatest("_total_at", "_kth_at"))).alias("completed_at"))


def incremental_rows(source: DataFrame, updated_at_col: str | None, last_synced_at) -> DataFrame:
    """EXT-03 scan: rows changed since the watermark, or everything (no column / no watermark / sync-now)."""
    if updated_at_col is None or last_synced_at is None:
        return source
    ts = last_synced_at if isinstance(last_synced_at, Column) else F.lit(last_synced_at).cast("timestamp")
    return source.where(F.col(updated_at_col) > ts)
