"""Stateful streams over several micro-batches: the state must carry across batches."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from shredline import schemas
from shredline.operators import certificates as CERT
from shredline.streaming import ingest as ING
from shredline.streaming import sources as SRC
from shredline.streaming import stateful as ST
from shredline.streaming.sources import run_available

T = dt.datetime(2026, 1, 1)


def _files_stream(spark, tmp_dir, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_dir}/in/part{i}")
    # one file per trigger: each written folder becomes its own micro-batch
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(f"{tmp_dir}/in"))


def test_sync_progress_across_batches(spark, tmp_dir):
    schema = "run_id string, kind string, chunks_total long, outcome string, at timestamp, chunk_id int"
    b1 = [("r1", "chunk", None, "completed", T, 1), ("r2", "total", 1, None, T, None)]
    b2 = [("r1", "chunk", None, "completed", T + dt.timedelta(hours=1), 2), ("r2", "chunk", None, "failed", T, 1)]
    b3 = [("r1", "total", 2, None, T + dt.timedelta(hours=2), None)]
    out = run_available(ST.sync_progress(_files_stream(spark, tmp_dir, [b1, b2, b3], schema)), "t_sync", "update")
    assert out.select("_batch_id").distinct().count() == 3
    last = {r.run_id: r for r in out.groupBy("run_id").agg(
        F.max_by(F.struct("status", "chunks_completed", "chunks_failed", "completed_at"), "_batch_id").alias("s"))
        .select("run_id", "s.*").collect()}
    assert last["r1"].status == "complete" and last["r1"].chunks_completed == 2
    assert last["r1"].completed_at == T + dt.timedelta(hours=2)
    assert last["r2"].status == "running" and last["r2"].chunks_failed == 1


def test_chain_head_carries_across_batches(spark, tmp_dir):
    key = hashlib.sha256(b"sign-A").digest()
    schema = "tenant_id string, deletion_request_id string, user_id string, created_at timestamp, claims_json string, sign_key binary"
    b1 = [("A", "r1", "u1", T, '{"a":1}', key)]
    b2 = [("A", "r2", "u2", T + dt.timedelta(1), '{"a":2}', key), ("A", "r1", "u1", T, '{"a":1}', key)]
    s = _files_stream(spark, tmp_dir, [b1, b2], schema)
    out = run_available(ST.chain(ST.dedup_requests(s)), "t_chain").drop("_batch_id")
    rows = {r.deletion_request_id: r for r in out.collect()}
    assert set(rows) == {"r1", "r2"}                       # the redelivered r1 is chained once
    assert rows["r2"].sequence == 2 and rows["r2"].previous_hash == rows["r1"].certificate_hash
    assert CERT.verify_chain(out).where("problem IS NOT NULL").count() == 0


def test_request_status_stream_rejects_invalid_moves(spark, tmp_dir):
    schema = "deletion_request_id string, kind string, to_status string, operation_id string, at timestamp"
    b1 = [("q", "snapshot", "SHRED_REQUESTED", "", T)]
    b2 = [("q", "move", "KEY_DESTROYED", "a", T + dt.timedelta(1)), ("q", "move", "CERTIFICATE_ISSUED", "b", T + dt.timedelta(2))]
    b3 = [("q", "move", "CASCADE_PENDING", "c", T + dt.timedelta(3))]
    out = run_available(ST.request_status(_files_stream(spark, tmp_dir, [b1, b2, b3], schema)), "t_status")
    got = [(r.from_status, r.to_status, r.accepted) for r in out.orderBy("at").collect()]
    assert got == [("SHRED_REQUESTED", "KEY_DESTROYED", True), ("KEY_DESTROYED", "CERTIFICATE_ISSUED", True),
                   ("CERTIFICATE_ISSUED", "CASCADE_PENDING", False)]


def _run_fold(spark, tmp_dir, monkeypatch, make, batches, schema, name):
    """A fold over several micro-batches with a full copy of the states after every second; no Python is called per key."""
    monkeypatch.setattr(SRC, "FULL", 2)
    plans = []
    apply = SRC.Fold.apply

    def watched(self, batch, batch_id, path):
        out = apply(self, batch, batch_id, path)
        plans.append(out._jdf.queryExecution().toString())
        states = spark.read.parquet(f"{path}/_batch_id={batch_id}").collect()
        if batch_id % 2 == 0:
            assert len(states) == len({r[0] for b in batches[:batch_id + 1] for r in b})        # every key so far
        return out

    monkeypatch.setattr(SRC.Fold, "apply", watched)
    out = run_available(make(_files_stream(spark, tmp_dir, batches, schema)), name, "update")
    assert len(plans) == len(batches) and not any("Pandas" in p or "Python" in p for p in plans)
    return out


def test_sync_progress_equals_a_plain_fold(spark, tmp_dir, monkeypatch):
    """Runs of any mix of messages, null ids and times among them, over micro-batches with and without a run's messages."""
    r = random.Random(7)
    at = lambda: None if r.random() < 0.03 else T + dt.timedelta(minutes=r.randrange(50))
    batches = [[(r.choice([None, "r1", "r2", "r3", "r4", f"only{b}"]), "total", r.randrange(4), None, at(), None) if r.random() < 0.2 else
                (r.choice([None, "r1", "r2", "r3", "r4"]), "chunk", None, r.choice(["completed", "failed", None]), at(), r.randrange(100))
                for _ in range(15)] for b in range(4)]
    out = _run_fold(spark, tmp_dir, monkeypatch, ST.sync_progress, batches,
                    "run_id string, kind string, chunks_total long, outcome string, at timestamp, chunk_id int", "t_fold")
    state, want = {}, set()
    for i, rows in enumerate(batches):
        for run in {x[0] for x in rows}:
            total, done, failed, ended = state.get(run, (None, 0, 0, None))
            closed = ended is not None
            for _, kind, n, outcome, when, _id in sorted((x for x in rows if x[0] == run), key=lambda x: (
                    x[4] is not None, x[4] or T, x[5] is not None, x[5] or 0, x[2] or 0)):
                total = n if kind == "total" else total
                done, failed = done + (outcome == "completed"), failed + (outcome == "failed")
                if not closed and total is not None and done >= total:
                    ended, closed = when, True
            state[run] = total, done, failed, ended
            status = "enumerating" if total is None else "complete" if done >= total else "running"
            want.add((run, status, total, done, failed, ended, i))
    assert {tuple(x) for x in out.collect()} == want and out.count() == len(want)


def test_request_status_equals_a_plain_fold(spark, tmp_dir, monkeypatch):
    """More moves of a request than are folded at once, unknown requests and states, a null id, late snapshots."""
    r = random.Random(8)
    states = [*schemas.DELETION_STATES, "NO_STATE", None]
    batches = [[("long", "move", r.choice(states), f"o{i:05}", T + dt.timedelta(minutes=r.randrange(900))) for i in range(1500 * (b == 2))] +
               [(r.choice([None, "q1", "q2", f"only{b}"]), r.choice(["snapshot", "move", "move", None]), r.choice(states), f"o{i}",
                 T + dt.timedelta(minutes=r.randrange(50))) for i in range(15)] +
               [("long", "snapshot", "SHRED_REQUESTED", "", T)] * (b < 2) for b in range(4)]
    out = _run_fold(spark, tmp_dir, monkeypatch, ST.request_status, batches,
                    "deletion_request_id string, kind string, to_status string, operation_id string, at timestamp", "t_moves")
    state, want = {}, []
    for i, rows in enumerate(batches):
        for rid in {x[0] for x in rows}:
            status = state.get(rid)
            for _, kind, to, op, when in sorted((x for x in rows if x[0] == rid), key=lambda x: (x[1] != "snapshot", x[4], x[3], x[2] or "")):
                ok = kind != "snapshot" and to in schemas.TRANSITIONS.get(status, [])
                if kind != "snapshot":
                    want.append((rid or "", status or "", to or "", ok, when, "move", i))
                status = to if ok or kind == "snapshot" else status
            state[rid] = status
    got = [(x[0] or "", x[1] or "", x[2] or "", *x[3:]) for x in out.collect()]
    assert sorted(got) == sorted(want) and len(want) > 1500


def test_hot_path_and_dead_letters_streams(spark, tmp_dir):
    schema = "deletion_request_id string, destination string, status string, updated_at timestamp"
    w = _files_stream(spark, tmp_dir, [[("r1", "hubspot", "FAILED", T), ("r1", "salesforce", "SUCCEEDED", T)],
                                       [("r2", "hubspot", "FAILED", T)]], schema)
    dl = run_available(ING.dead_letters(w), "t_dlq")
    assert sorted(r.deletion_request_id for r in dl.collect()) == ["r1", "r2"]


def test_ingest_quarantines_events_when_the_sink_fails(spark, tmp_dir):
    """SRC-07: a failing event write diverts the batch to the quarantine folder; rejects still land."""
    import os

    payloads = spark.createDataFrame([("u1", "api", "hubspot", None), ("bad user!", "api", "crm", None)],
                                     "user_id string, source string, destination string, context string")
    events = f"{tmp_dir}/events"
    with open(events, "w") as fh:            # a plain file where the events folder should be: the write fails
        fh.write("not a folder")
    ING.ingest_batch(payloads, events, f"{tmp_dir}/rejects", f"{tmp_dir}/quarantine", batch_id=0)
    q = spark.read.json(f"{tmp_dir}/quarantine")
    assert [r.user_id for r in q.collect()] == ["u1"]
    assert spark.read.parquet(f"{tmp_dir}/rejects").count() == 1
    assert os.path.isfile(events)


def test_late_and_redelivered_payloads(spark, tmp_dir):
    """Nothing is dropped for being late; a delivery is known again in any later batch, and a batch can be run twice."""
    schema = "delivery_id string, received_at timestamp, user_id string, source string, destination string, context string"
    row = lambda d, days: (d, T + dt.timedelta(days), "u1", "api", "hubspot", None)
    batches = [[row("d1", 0), row("d1", 0)], [row("d2", 30)], [row("d3", 1), row("d1", 0)], [row("d2", 30), row("d4", -400)]]
    for i, rows in list(enumerate(batches)) + [(2, batches[2])]:
        ING.ingest_batch(spark.createDataFrame(rows, schema), f"{tmp_dir}/events", f"{tmp_dir}/rejects", f"{tmp_dir}/quarantine",
                         batch_id=i, deliveries_path=f"{tmp_dir}/deliveries")
    assert spark.read.parquet(f"{tmp_dir}/events").count() == 4
    seen = spark.read.parquet(f"{tmp_dir}/deliveries")
    assert sorted(r.delivery_id for r in seen.collect()) == ["d1", "d2", "d3", "d4"]


def test_a_stream_knows_redeliveries_from_its_state(spark, tmp_dir):
    """Each micro-batch looks up and adds its own ids alone; nothing is dropped for being late or for lacking an id."""
    schema = "delivery_id string, received_at timestamp, user_id string, source string, destination string, context string"
    row = lambda d, days, u="u1": (d, T + dt.timedelta(days), u, "api", "hubspot", None)
    batches = [[row("d1", 0), row("d1", 0), row(None, 0, "u5")], [row("d2", 30), row(None, 0, "u5")], [row("d3", 1), row("d1", 0)],
               [row("d2", 30), row("d4", -400), row("d5", 0, "bad user!")]]
    q = ING.ingest_lineage(_files_stream(spark, tmp_dir, batches, schema), f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination()
    steps = [p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]]
    assert [s["numRowsUpdated"] for s in steps] == [1, 1, 1, 2] and steps[-1]["numRowsTotal"] == 5
    assert "RocksDB" in str(steps[-1]["customMetrics"]) or "rocksdb" in str(steps[-1]["customMetrics"])
    got = {r.user_id: r["count"] for r in spark.read.parquet(f"{tmp_dir}/out/events").groupBy("user_id").count().collect()}
    assert got == {"u1": 4, "u5": 2} and spark.read.parquet(f"{tmp_dir}/out/rejects").count() == 1
