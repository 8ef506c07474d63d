"""Deletion requests as a batch state machine (WIN-04/05, STA-06/07/08/17/18, AGG-10, SRT-02, SRC-16).

State: ``schemas.DELETION_REQUEST`` rows. Wipe outcomes are also kept in
long form (one row per request × destination) so updates are joins and
window picks, and the nested ``janitor_wipes`` array is only rebuilt from
the latest row per destination (bounded by the number of destinations).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shredline import schemas
from shredline.functions import text as TX
from shredline.operators.running import positions
from shredline.operators.util import literal_table

KEYS = ["tenant_id", "user_id"]
RETRY_LIMIT = 3


def transitions(spark) -> DataFrame:
    """The allowed (from, to) pairs as a broadcast lookup table (fixed size)."""
    rows = [(a, b) for a, tos in schemas.TRANSITIONS.items() for b in tos]
    return literal_table(spark, rows, "from_status string, to_status string")


def _latest(df: DataFrame, states: list[str]) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy(F.col("created_at").desc(), F.col("deletion_request_id").desc())
    return (df.where(F.col("status").isin(*states)).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == 1).drop("_rn"))


def active_requests(requests: DataFrame) -> DataFrame:
    """WIN-04: newest request per user in one of the five non-final states."""
    return _latest(requests, schemas.ACTIVE_REQUEST_STATES)


def latest_completed(requests: DataFrame) -> DataFrame:
    """WIN-05: newest request per user that reached CASCADE_COMPLETE or CERTIFICATE_ISSUED."""
    return _latest(requests, schemas.COMPLETED_REQUEST_STATES)


def create(state: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """STA-06: new requests (operation_id, tenant_id, user_id, requested_by), idempotent.

    * an operation id already in the state returns that request (a different
      user/tenant under the same id is an error row);
    * else a user with an active request gets it back (``already_existed``);
    * else a new SHRED_REQUESTED request with id = operation id. Several new
      requests of one user in a batch: the first (by operation id) creates,
      the rest get it back;
    * one new id under several users in a batch: it belongs to the first by
      (tenant, user), the others are error rows.
    Every batch row is answered. Returns (new state, outcome).
    """
    owner = F.struct("tenant_id", "user_id")
    same_id = Window.partitionBy("operation_id")
    b = batch.withColumn("_first_owner", F.min(owner).over(same_id)).withColumn(
        "_again", F.row_number().over(Window.partitionBy("operation_id", *KEYS).orderBy("requested_by")) > 1)
    by_id = state.select(F.col("deletion_request_id").alias("operation_id"),
                         F.struct(F.col("tenant_id").alias("tenant_id"), F.col("user_id").alias("user_id")).alias("_stored"))
    b = b.join(by_id, "operation_id", "left")
    active = active_requests(state).select(*KEYS, F.col("deletion_request_id").alias("_active_id"))
    b = b.join(active, KEYS, "left")
    mismatch = F.coalesce("_stored", "_first_owner") != owner
    stored = F.col("_stored").isNotNull() & ~mismatch
    candidate = ~mismatch & ~stored & F.col("_active_id").isNull()
    b = b.withColumn("_first_op", F.min(F.when(candidate, F.col("operation_id"))).over(Window.partitionBy(*KEYS)))
    fresh = candidate & (F.col("_first_op") == F.col("operation_id")) & ~F.col("_again")
    outcome = b.select(
        "operation_id", *KEYS,
        F.when(mismatch, F.lit(None)).when(stored, F.col("operation_id"))
         .otherwise(F.coalesce("_active_id", "_first_op")).alias("deletion_request_id"),
        (~fresh & ~mismatch).alias("already_existed"),
        F.when(mismatch, F.lit("Operation id belongs to another user or tenant")).alias("error"))
    new_rows = b.where(fresh).select(
        F.col("operation_id").alias("deletion_request_id"), *KEYS, F.lit("SHRED_REQUESTED").alias("status"),
        now.alias("created_at"), now.alias("updated_at"),
        F.array(F.struct(F.lit("SHRED_REQUESTED").alias("status"), now.alias("at"),
                         F.col("operation_id").alias("operation_id"))).alias("status_history"),
        F.array().cast(schemas.DELETION_REQUEST["janitor_wipes"].dataType).alias("janitor_wipes"),
        F.lit(None).cast("timestamp").alias("key_destroyed_at"),
        F.lit(None).cast("timestamp").alias("cascade_initiated_at"),
        F.lit(None).cast("timestamp").alias("certificate_issued_at"),
        F.lit(None).cast("string").alias("certificate_path"), "requested_by", "operation_id")
    return conform(state).unionByName(conform(new_rows)), outcome


def conform(df: DataFrame) -> DataFrame:
    cols = []
    for f in schemas.DELETION_REQUEST.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def _advance(state: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STA-07, one move per request: validate against the matrix, append history, stamp times.

    ``moves``: (deletion_request_id, to_status, operation_id, at), at most one
    per request. Returns (new state, decisions with accepted/error).
    """
    spark = state.sparkSession
    m = moves.select("deletion_request_id", F.col("to_status").alias("_to"), F.col("operation_id").alias("_op"),
                     F.col("at").alias("_at"))
    j = state.join(m, "deletion_request_id", "left")
    allowed = transitions(spark)
    j = j.join(allowed, (F.col("status") == F.col("from_status")) & (F.col("_to") == F.col("to_status")), "left")
    moved = F.col("to_status").isNotNull()
    hist_t = schemas.DELETION_REQUEST["status_history"].dataType
    cols = {
        "status": F.when(moved, F.col("_to")).otherwise(F.col("status")),
        "updated_at": F.when(moved, F.col("_at")).otherwise(F.col("updated_at")),
        "status_history": F.when(moved, F.concat(F.coalesce("status_history", F.array().cast(hist_t)),
                                                 F.array(F.struct(F.col("_to").alias("status"), F.col("_at").alias("at"),
                                                                  F.col("_op").alias("operation_id")))))
                           .otherwise(F.col("status_history")),
        "key_destroyed_at": F.when(moved & (F.col("_to") == "KEY_DESTROYED"), F.col("_at"))
                             .otherwise(F.col("key_destroyed_at")),
        "cascade_initiated_at": F.when(moved & F.col("_to").isin("CASCADE_PENDING", "CASCADE_IN_PROGRESS"), F.col("_at"))
                                 .otherwise(F.col("cascade_initiated_at")),
        "certificate_issued_at": F.when(moved & (F.col("_to") == "CERTIFICATE_ISSUED"), F.col("_at"))
                                  .otherwise(F.col("certificate_issued_at")),
        "operation_id": F.when(moved, F.col("_op")).otherwise(F.col("operation_id")),
    }
    new_state = j.select(*[cols[f].alias(f) if f in cols else F.col(f) for f in schemas.DELETION_REQUEST.fieldNames()])
    decisions = j.where(F.col("_to").isNotNull()).select(
        "deletion_request_id", *KEYS, F.col("status").alias("from_status"), F.col("_to").alias("to_status"),
        moved.alias("accepted"),
        F.when(~moved, F.concat(F.lit("Invalid state transition from "), F.col("status"), F.lit(" to "), F.col("_to")))
         .alias("error"), F.col("_at").alias("at"))
    return new_state, decisions


CHUNK = 512             # moves of one request that are applied in one row


def _index(status: Column) -> Column:
    """The place of a state in DELETION_STATES, from 0; null if it is none of them."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in schemas.DELETION_STATES]), status), F.lit(0)).cast("int") - 1


def _step(state: Column, to: Column) -> Column:
    """The state after a move: its target where the matrix allows it, else the state as it was (all as places)."""
    after = F.array(*[F.array(*[F.lit(j if b in schemas.TRANSITIONS[a] else i) for i, a in enumerate(schemas.DELETION_STATES)])
                      for j, b in enumerate(schemas.DELETION_STATES)])
    return F.when(to.isNull(), state).otherwise(F.get(F.get(after, to), state))


def _prefixes(moves: Column, start: Column, step) -> Column:
    """The values before each move, in order, and the value after the last: a fold that keeps its way."""
    return F.aggregate(moves, F.array(start), lambda way, m: F.concat(way, F.array(step(F.element_at(way, -1), m))))


def advance(state: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STA-07 for batches with several moves per request: applied in (at, operation_id, to_status) order.

    A move is a map of the seven states to seven states, and maps compose: runs of at most CHUNK moves of a
    request become one map each, the maps of a request's runs give every run its first state, and each run
    then decides its own moves. So a request's number of moves changes neither the number of exchanges nor
    what a row holds: moves are numbered by ``running.positions``, which spreads a long list over partitions,
    and only the maps of a request's runs (seven numbers for CHUNK moves) meet in one row.
    Requests without moves stay as they are; moves of unknown requests are ignored.
    """
    order = [F.col("at").asc(), F.col("operation_id").asc(), F.col("to_status").asc()]
    m = moves.select("deletion_request_id", "to_status", "operation_id", "at")
    numbered = positions(m, ["deletion_request_id"], order, "_seq")
    item = F.struct("_seq", _index(F.col("to_status")).alias("to"), "to_status", "operation_id", "at")
    runs = (numbered.groupBy("deletion_request_id", F.expr(f"(_seq - 1) div {CHUNK}").alias("_run"))
            .agg(F.sort_array(F.collect_list(item)).alias("_moves")))                    # at most CHUNK
    identity = F.array(*[F.lit(i) for i in range(len(schemas.DELETION_STATES))])
    maps = runs.select("deletion_request_id", "_run", F.aggregate(
        "_moves", identity, lambda f, x: F.transform(f, lambda i: _step(i, x["to"]))).alias("_map"))
    per_request = maps.groupBy("deletion_request_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_run", "_map"))), lambda x: x["_map"]).alias("_maps"))
    first = (state.select("deletion_request_id", *KEYS, "status", _index(F.col("status")).alias("_start"))
             .join(per_request, "deletion_request_id")
             .select("deletion_request_id", *KEYS, "status", F.posexplode(F.slice(
                 _prefixes(F.col("_maps"), F.col("_start"), lambda i, f: F.get(f, i)), 1, F.size("_maps"))).alias("_run", "_first")))
    decided = (runs.join(first, ["deletion_request_id", "_run"])
               .withColumn("_way", _prefixes(F.col("_moves"), F.col("_first"), lambda i, x: _step(i, x["to"])))
               .select("deletion_request_id", *KEYS, "status", F.inline(F.zip_with(
                   "_moves", F.slice("_way", 1, F.size("_moves")), lambda x, i: F.struct(x.alias("_m"), i.alias("_from"))))))
    names = F.array(*[F.lit(x) for x in schemas.DELETION_STATES])
    before = F.coalesce(F.get(names, F.col("_from")), F.col("status"))
    ok = F.coalesce(_step(F.col("_from"), F.col("_m.to")) != F.col("_from"), F.lit(False))
    decisions = decided.select(
        "deletion_request_id", *KEYS, before.alias("from_status"), F.col("_m.to_status").alias("to_status"), ok.alias("accepted"),
        F.when(~ok, F.concat(F.lit("Invalid state transition from "), before, F.lit(" to "), F.col("_m.to_status"))).alias("error"),
        F.col("_m.at").alias("at"), F.col("_m._seq").alias("_seq"), F.col("_m.operation_id").alias("_op"))
    at_of = lambda *to: F.max_by(F.when(F.col("to_status").isin(*to), F.col("at")),
                                 F.when(F.col("to_status").isin(*to), F.col("_seq")))
    last = decisions.where("accepted").groupBy("deletion_request_id").agg(
        F.max_by("to_status", "_seq").alias("_status"), F.max_by("at", "_seq").alias("_at"), F.max_by("_op", "_seq").alias("_op"),
        F.transform(F.sort_array(F.collect_list(F.struct("_seq", F.col("to_status").alias("status"), "at", F.col("_op").alias("operation_id")))),
                    lambda x: F.struct(x["status"].alias("status"), x["at"].alias("at"), x["operation_id"].alias("operation_id"))
                    ).alias("_history"),
        at_of("KEY_DESTROYED").alias("_destroyed"), at_of("CASCADE_PENDING", "CASCADE_IN_PROGRESS").alias("_initiated"),
        at_of("CERTIFICATE_ISSUED").alias("_issued"))
    hist_t = schemas.DELETION_REQUEST["status_history"].dataType
    new = {"status": "_status", "updated_at": "_at", "operation_id": "_op", "key_destroyed_at": "_destroyed",
           "cascade_initiated_at": "_initiated", "certificate_issued_at": "_issued"}
    state_cols = [F.coalesce(new[f], f"s.{f}").alias(f) if f in new else
                  F.when(F.col("_history").isNull(), F.col(f)).otherwise(
                      F.concat(F.coalesce(f, F.array().cast(hist_t)), F.col("_history").cast(hist_t))).alias(f)
                  if f == "status_history" else F.col(f) for f in schemas.DELETION_REQUEST.fieldNames()]
    new_state = state.alias("s").join(last, "deletion_request_id", "left").select(*state_cols)
    return new_state, decisions.drop("_seq", "_op")


advance_once = _advance


# --- wipes ---------------------------------------------------------------------------------------

def latest_wipes(wipes: DataFrame) -> DataFrame:
    """STA-08 core: latest outcome per (request, destination); destination keys carry the strategy suffix."""
    w = Window.partitionBy("deletion_request_id", "destination").orderBy(
        F.col("updated_at").desc(), F.col("status").desc(), F.col("records_found").desc_nulls_last())
    return wipes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def record_wipes(state: DataFrame, wipes: DataFrame) -> DataFrame:
    """STA-08: upsert wipe outcomes into each request's ``janitor_wipes`` (array rebuilt from latest rows)."""
    old = state.select("deletion_request_id", F.explode("janitor_wipes").alias("w")).select("deletion_request_id", "w.*")
    new = wipes.select("deletion_request_id", "destination", "status",
                       *[(F.col(c) if c in wipes.columns else F.lit(None)).cast(t).alias(c)
                         for c, t in [("attempts", "bigint"), ("records_found", "bigint"), ("rows_affected", "bigint"),
                                      ("error", "string")]], "updated_at")
    latest = latest_wipes(old.unionByName(new))
    wt = schemas.DELETION_REQUEST["janitor_wipes"].dataType
    nested = latest.groupBy("deletion_request_id").agg(F.array_sort(F.collect_list(F.struct(
        "destination", "status", "attempts", "records_found", "rows_affected", "error", "updated_at"))).cast(wt).alias("_w"))
    j = state.join(nested, "deletion_request_id", "left")
    return j.withColumn("janitor_wipes", F.coalesce("_w", "janitor_wipes")).drop("_w")


def cascade_outcome(latest: DataFrame) -> DataFrame:
    """AGG-10: any FAILED destination → CASCADE_PARTIAL_FAILURE (failed names listed), else CASCADE_COMPLETE."""
    return latest.groupBy("deletion_request_id").agg(
        F.bool_or(F.col("status") == "FAILED").alias("_failed"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "FAILED", F.col("destination")))).alias("failed_destinations"),
        F.count(F.lit(1)).alias("destinations")).select(
        "deletion_request_id",
        F.when(F.col("_failed"), "CASCADE_PARTIAL_FAILURE").otherwise("CASCADE_COMPLETE").alias("next_status"),
        "failed_destinations", "destinations")


def cascade(requests: DataFrame, tasks: DataFrame, resources: DataFrame, wipes: DataFrame) -> DataFrame:
    """STA-17: decide the next status of every request in the cascade.

    ``tasks``: (tenant_id, user_id, destination) connector wipes (JOIN-03);
    ``resources``: (tenant_id, resource_id, strategy) from FIL-07/08, which
    become destinations ``{resource_id}::{strategy}`` for every request of the
    tenant; ``wipes``: recorded outcomes. Nothing planned → CASCADE_COMPLETE
    at once; every planned destination recorded → AGG-10; otherwise the
    request stays CASCADE_IN_PROGRESS. A retry (CASCADE_IN_PROGRESS) re-plans
    everything, as the reference does.
    """
    req = requests.select("deletion_request_id", *KEYS)
    own = req.join(tasks.select(*KEYS, "destination"), KEYS).select("deletion_request_id", "destination").distinct()
    res = resources.select("tenant_id", F.concat("resource_id", F.lit("::"), "strategy").alias("destination")).distinct()
    # Planned resources are counted by tenant, recorded outcomes are matched with plans: no request meets a resource
    # that it has no outcome for.
    n_own = own.groupBy("deletion_request_id").agg(F.count(F.lit(1)).alias("n_own"))
    n_res = res.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_res"))
    recorded = (latest_wipes(wipes).select("deletion_request_id", "destination", "status")
                .join(req.select("deletion_request_id", "tenant_id"), "deletion_request_id"))
    done = (recorded.join(res, ["tenant_id", "destination"], "left_semi")
            .unionByName(recorded.join(own, ["deletion_request_id", "destination"], "left_semi"))
            .dropDuplicates(["deletion_request_id", "destination"]))
    outcomes = done.groupBy("deletion_request_id").agg(
        F.count(F.lit(1)).alias("n_done"), F.count_if(F.col("status") == "FAILED").alias("n_failed"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "FAILED", F.col("destination")))).alias("failed_destinations"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    agg = (req.join(n_own, "deletion_request_id", "left").join(n_res, "tenant_id", "left")
           .join(outcomes, "deletion_request_id", "left")
           .select("deletion_request_id", *KEYS, (zero("n_own") + zero("n_res")).alias("n_planned"),
                   (zero("n_own") + zero("n_res") - zero("n_done")).alias("n_open"), zero("n_failed").alias("n_failed"),
                   "failed_destinations"))
    n = F.col("n_planned")
    return agg.select(
        "deletion_request_id", *KEYS, n.alias("n_planned"), "n_failed",
        F.when(n == 0, "CASCADE_COMPLETE").when(F.col("n_open") > 0, "CASCADE_IN_PROGRESS")
         .when(F.col("n_failed") > 0, "CASCADE_PARTIAL_FAILURE").otherwise("CASCADE_COMPLETE").alias("next_status"),
        F.coalesce("failed_destinations", F.array().cast("array<string>")).alias("failed_destinations"))


def wipe_attempts(attempts: DataFrame, limit: int = RETRY_LIMIT) -> DataFrame:
    """STA-18: per task, attempts in order until the first success, at most ``limit``.

    ``attempts``: (task_id, attempt, ok, error). COMPLETE when one of the
    first ``limit`` attempts succeeded; FAILED otherwise (then dead-lettered).
    A non-retryable error (FN-27 plus a connector ``retryable`` flag, if
    present) stops the retries early.
    """
    retryable = F.col("retryable") if "retryable" in attempts.columns else TX.is_retryable("error")
    w = Window.partitionBy("task_id").orderBy("attempt")
    a = (attempts.withColumn("_n", F.row_number().over(w))
         .withColumn("_stop", F.when(F.col("ok") | ~F.coalesce(retryable, F.lit(False)), F.col("_n")))
         .withColumn("_first_stop", F.min("_stop").over(Window.partitionBy("task_id"))))
    used = a.where((F.col("_n") <= limit) & (F.col("_first_stop").isNull() | (F.col("_n") <= F.col("_first_stop"))))
    return used.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.bool_or("ok").alias("_ok"),
        F.max_by("error", "_n").alias("last_error")).select(
        "task_id", F.when(F.col("_ok"), "COMPLETE").otherwise("FAILED").alias("status"), "attempts",
        F.when(~F.col("_ok"), F.col("last_error")).alias("last_error"))


def dead_letters(results: DataFrame, now: Column) -> DataFrame:
    """SRC-16 / STR-07: FAILED wipes as dead-letter rows."""
    return results.where(F.col("status") == "FAILED").select(
        *[c for c in results.columns if c in ("task_id", "user_id", "tenant_id", "destination")],
        F.coalesce(F.col("last_error"), F.lit("unknown error")).alias("error"), now.alias("timestamp"),
        F.lit("ERROR").alias("severity"), F.lit("janitor").alias("source"))


def by_requester(requests: DataFrame, limit: int = 50, before: DataFrame | Column | tuple | None = None) -> DataFrame:
    """SRT-02: per (tenant, requested_by), newest requests first, keyset cursor, first ``limit``.

    The cursor is the last row of the page before: (created_at, deletion_request_id), so requests of one
    moment are all reached. A DataFrame (tenant_id, requested_by, created_at, deletion_request_id) gives every
    requester's own cursor, and requesters that have none start at the top. A time alone leaves out its whole moment.
    """
    r = requests.where(F.col("requested_by").isNotNull())
    if isinstance(before, DataFrame):
        at = before.select("tenant_id", "requested_by", F.struct("created_at", "deletion_request_id").alias("_cursor"))
        r = (r.join(at, ["tenant_id", "requested_by"], "left")
             .where(F.col("_cursor").isNull() | (F.struct("created_at", "deletion_request_id") < F.col("_cursor"))).drop("_cursor"))
    elif isinstance(before, tuple):
        at, last = before
        r = r.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("deletion_request_id") < last)))
    elif before is not None:
        r = r.where(F.col("created_at") < before)
    w = Window.partitionBy("tenant_id", "requested_by").orderBy(F.col("created_at").desc(),
                                                                F.col("deletion_request_id").desc())
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
