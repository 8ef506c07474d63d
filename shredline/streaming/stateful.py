"""Stateful streams keyed by run, request or tenant (STR-04, STR-05, STR-06).

The state per key is a handful of scalars (counts, status, chain head), so it
stays O(1) per key however long the stream runs. A key's rows of a micro-batch
are put in event-time order before the fold (a key's rows in one trigger,
bounded by the source's trigger limit such as ``maxFilesPerTrigger``). Across
micro-batches messages apply in arrival order, as a live system would.

Runs and requests are as many as the source's rows, so they are folded by column
expressions (``sources.Fold``): no call of Python per key. The chain has a key
per tenant and signs with Python, so it uses ``applyInPandasWithState``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from shredline import schemas
from shredline.operators import certificates as CERT
from shredline.operators import deletion as D
from shredline.streaming.sources import Fold

# --- STR-04 sync-run progress ------------------------------------------------------------------

PROGRESS_OUT = ("run_id string, status string, chunks_total long, chunks_completed long, chunks_failed long, "
                "completed_at timestamp")
PROGRESS_STATE = "chunks_total long, chunks_completed long, chunks_failed long, completed_at timestamp"


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _progress(acc: Column, m: Column) -> Column:
    """A run's state after a message; ``closed`` is true from the message on at which it was complete for the first time."""
    is_total = m["kind"].eqNullSafe(F.lit("total"))
    total = F.when(is_total, F.coalesce(m["chunks_total"], acc["chunks_total"])).otherwise(acc["chunks_total"])
    one = lambda outcome: (~is_total & m["outcome"].eqNullSafe(F.lit(outcome))).cast("bigint")
    done, failed = acc["chunks_completed"] + one("completed"), acc["chunks_failed"] + one("failed")
    complete = F.coalesce(done >= total, F.lit(False))
    return F.struct(total.alias("chunks_total"), done.alias("chunks_completed"), failed.alias("chunks_failed"),
                    F.when(~acc["closed"] & complete, m["at"]).otherwise(acc["completed_at"]).alias("completed_at"),
                    (acc["closed"] | complete).alias("closed"))


def _progress_step(rows: DataFrame) -> DataFrame:
    zero, at = F.lit(0).cast("bigint"), F.col("_old.completed_at")
    start = F.struct(F.col("_old.chunks_total").alias("chunks_total"),
                     F.coalesce("_old.chunks_completed", zero).alias("chunks_completed"),
                     F.coalesce("_old.chunks_failed", zero).alias("chunks_failed"), at.alias("completed_at"),
                     at.isNotNull().alias("closed"))
    messages = F.coalesce("_messages", F.array().cast(rows.schema["_messages"].dataType))
    return rows.withColumn("_new", F.aggregate(messages, start, _progress)).select(
        "_key", "_n", *[F.col(f"_new.{c}").alias(c) for c in _schema(PROGRESS_STATE).fieldNames()])


def sync_progress(messages: DataFrame) -> Fold:
    """Run progress from out-of-order total / chunk messages; completion fixed the first time it holds."""
    item = F.struct("at", F.col("chunk_id"), "kind", F.col("chunks_total").cast("bigint").alias("chunks_total"), "outcome")
    total, done = F.col("chunks_total"), F.col("chunks_completed")
    status = F.when(total.isNull(), "enumerating").when(done >= total, "complete").otherwise("running")
    return Fold(messages, "run_id", [F.sort_array(F.collect_list(item)).alias("_messages")], _schema(PROGRESS_STATE), _progress_step,
                lambda rows: rows.withColumn("status", status).select(*_schema(PROGRESS_OUT).fieldNames()), _schema(PROGRESS_OUT))


# --- STR-05 request status ----------------------------------------------------------------------

STATUS_OUT = ("deletion_request_id string, from_status string, to_status string, accepted boolean, "
              "at timestamp, kind string")
STATUS_STATE = "status string"
_MOVE = "struct<from_status:string,to_status:string,accepted:boolean,at:timestamp>"


def _status_step(rows: DataFrame) -> DataFrame:
    """Snapshots first, then moves in time order; states are places in DELETION_STATES, as in ``deletion.advance``.

    Moves are folded CHUNK at a time, so that the list of states before them is not copied for each move.
    """
    rows = rows.withColumns({
        "_start": F.when(F.col("_snapshots") > 0, F.col("_snapshot")).otherwise(F.col("_old.status")),
        "_moves": F.coalesce("_moves", F.array().cast(rows.schema["_moves"].dataType))})

    def chunk(ways: Column, i: Column) -> Column:
        part = F.slice("_moves", i * D.CHUNK + 1, F.lit(D.CHUNK))
        return F.concat(ways, F.array(D._prefixes(part, F.element_at(F.element_at(ways, -1), -1), lambda s, m: D._step(s, m["to"]))))

    chunks = F.sequence(F.lit(0), F.floor((F.size("_moves") - 1) / D.CHUNK).cast("int"))
    ways = F.aggregate(F.when(F.size("_moves") > 0, chunks).otherwise(F.array().cast("array<int>")),
                       F.array(F.array(D._index(F.col("_start")))), chunk)
    names = F.array(*[F.lit(x) for x in schemas.DELETION_STATES])
    name = lambda place: F.coalesce(F.get(names, place), F.col("_start"))
    before = F.flatten(F.transform(F.slice("_ways", F.lit(2), F.size("_ways")), lambda w: F.slice(w, F.lit(1), F.size(w) - 1)))
    moves = F.zip_with("_moves", before, lambda m, s: F.struct(
        name(s).alias("from_status"), m["to_status"].alias("to_status"),
        F.coalesce(D._step(s, m["to"]) != s, F.lit(False)).alias("accepted"), m["at"].alias("at")))
    return rows.withColumn("_ways", ways).select(
        "_key", "_n", name(F.element_at(F.element_at("_ways", -1), -1)).alias("status"), moves.cast(f"array<{_MOVE}>").alias("_moves"))


def request_status(messages: DataFrame) -> Fold:
    """Live state machine: snapshot rows set the status, move rows are validated against the matrix.

    ``messages``: (deletion_request_id, kind 'snapshot'|'move', to_status, operation_id, at).
    Rejected moves come out with ``accepted = false`` (the rejects stream).
    """
    snapshot, order = F.col("kind").eqNullSafe(F.lit("snapshot")), F.struct("at", "operation_id", "to_status")
    move = F.struct("at", "operation_id", "to_status", D._index(F.col("to_status")).alias("to"))
    collected = [F.count_if(snapshot).alias("_snapshots"),
                 F.max_by("to_status", F.when(snapshot, order)).alias("_snapshot"),
                 F.sort_array(F.collect_list(F.when(~snapshot, move))).alias("_moves")]
    return Fold(messages, "deletion_request_id", collected, _schema(STATUS_STATE), _status_step,
                lambda rows: rows.select("deletion_request_id", F.inline("_moves")).withColumn("kind", F.lit("move"))
                .select(*_schema(STATUS_OUT).fieldNames()), _schema(STATUS_OUT))


# --- STR-06 chain append ------------------------------------------------------------------------------

CHAIN_STATE = "sequence long, last_hash string"


def _in_order(chunks, cols: list[str], order: list[str]) -> list[tuple]:
    """All of a key's rows in this micro-batch as tuples of ``cols``, sorted by ``order`` (NULLs first).

    Plain tuples, not pandas operations: groups are small and this runs once per key.
    """
    rows = []
    for pdf in chunks:
        rows.extend(zip(*(pdf[c].tolist() for c in cols)))
    idx = [cols.index(c) for c in order]

    def key(r):
        return tuple((0, 0) if _missing(r[i]) else (1, r[i]) for i in idx)

    rows.sort(key=key)
    return rows


def _missing(v) -> bool:
    return v is None or (isinstance(v, float) and v != v) or v is pd.NaT


def _chain(key, rows, state):
    (tenant,) = key
    seq, last = state.get if state.exists else (0, None)
    out = {k: [] for k in ("tenant_id", "sequence", "deletion_request_id", "user_id", "previous_hash",
                           "certificate_hash", "certificate")}
    for _ts, rid, uid, cj, k in _in_order(rows, ["created_at", "deletion_request_id", "user_id", "claims_json",
                                                 "sign_key"], ["created_at", "deletion_request_id"]):
        seq += 1
        prev = "null" if last is None else f'"{last}"'
        token, h = CERT._sign_and_hash(cj[:-1] + f',"previous_certificate_hash":{prev},"chain_sequence":{seq}}}',
                                       bytes(k))
        for col, v in (("tenant_id", tenant), ("sequence", seq), ("deletion_request_id", rid), ("user_id", uid),
                       ("previous_hash", last), ("certificate_hash", h), ("certificate", token)):
            out[col].append(v)
        last = h
    state.update((seq, last))
    yield pd.DataFrame(out)


def chain(claims: DataFrame) -> DataFrame:
    """Append certificates to each tenant's chain as completed requests arrive.

    ``claims``: (tenant_id, deletion_request_id, user_id, created_at, claims_json, sign_key), already
    deduplicated by request id (idempotence; see ``dedup_requests``).
    """
    return claims.groupBy("tenant_id").applyInPandasWithState(
        _chain, CERT.CHAIN_SCHEMA, CHAIN_STATE, "append", GroupStateTimeout.NoTimeout)


def dedup_requests(claims: DataFrame) -> DataFrame:
    """A request id is chained once, however late its completion is delivered again.

    No watermark: the ids of all chained requests stay in the state store (one id for each certificate).
    """
    return claims.dropDuplicates(["deletion_request_id"])
