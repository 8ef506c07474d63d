import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shredline import schemas
from shredline.operators import connectors as CN
from shredline.operators import deletion as D

T = dt.datetime(2026, 1, 1)


def _state(spark, rows):
    df = spark.createDataFrame(rows, "deletion_request_id string, tenant_id string, user_id string, status string, "
                                     "created_at timestamp, requested_by string")
    return D.conform(df)


@pytest.mark.parametrize("frm", schemas.DELETION_STATES)
def test_transition_matrix(spark, frm):
    state = _state(spark, [(f"r-{to}", "t", "u", frm, T, None) for to in schemas.DELETION_STATES])
    moves = spark.createDataFrame([(f"r-{to}", to, "op", T + dt.timedelta(days=1)) for to in schemas.DELETION_STATES],
                                  "deletion_request_id string, to_status string, operation_id string, at timestamp")
    new, dec = D.advance(state, moves)
    got = {r.to_status: r.accepted for r in dec.collect()}
    assert got == {to: to in schemas.TRANSITIONS[frm] for to in schemas.DELETION_STATES}
    st = {r.deletion_request_id: r for r in new.collect()}
    for to, ok in got.items():
        row = st[f"r-{to}"]
        assert row.status == (to if ok else frm)
        assert (row.status_history is not None and row.status_history[-1].status == to) == ok


def test_several_moves_apply_in_time_order(spark):
    state = _state(spark, [("r1", "t", "u", "SHRED_REQUESTED", T, None)])
    moves = spark.createDataFrame([("r1", "CASCADE_PENDING", "b", T + dt.timedelta(days=2)),
                                   ("r1", "KEY_DESTROYED", "a", T + dt.timedelta(days=1)),
                                   ("r1", "CERTIFICATE_ISSUED", "c", T + dt.timedelta(days=3))],
                                  "deletion_request_id string, to_status string, operation_id string, at timestamp")
    new, dec = D.advance(state, moves)
    assert [(r.from_status, r.to_status, r.accepted) for r in dec.orderBy("at").collect()] == [
        ("SHRED_REQUESTED", "KEY_DESTROYED", True), ("KEY_DESTROYED", "CASCADE_PENDING", True),
        ("CASCADE_PENDING", "CERTIFICATE_ISSUED", False)]
    row = new.collect()[0]
    assert row.status == "CASCADE_PENDING" and row.key_destroyed_at is not None and row.cascade_initiated_at is not None


def test_create_is_idempotent(spark):
    state = _state(spark, [("r1", "t", "u1", "KEY_DESTROYED", T, None), ("r2", "t", "u2", "CERTIFICATE_ISSUED", T, None)])
    batch = spark.createDataFrame([("op-a", "t", "u1", "x"), ("op-b", "t", "u2", "x"), ("op-c", "t", "u2", "x"),
                                   ("r2", "t", "u2", "x"), ("r1", "t", "other", "x")],
                                  "operation_id string, tenant_id string, user_id string, requested_by string")
    new, out = D.create(state, batch, F.lit(T))
    o = {r.operation_id: (r.deletion_request_id, r.already_existed, r.error) for r in out.collect()}
    assert o["op-a"] == ("r1", True, None)             # active request returned
    assert o["op-b"] == ("op-b", False, None)          # first of the batch creates
    assert o["op-c"] == ("op-b", True, None)           # the second gets it back
    assert o["r2"] == ("r2", True, None)               # same id: idempotent
    assert o["r1"][0] is None and o["r1"][2] is not None  # id reused for another user
    assert new.count() == 3


def test_wipes_latest_per_destination_and_outcome(spark):
    state = _state(spark, [("r1", "t", "u", "CASCADE_IN_PROGRESS", T, None)])
    w = spark.createDataFrame([("r1", "hubspot", "FAILED", 0, T), ("r1", "hubspot", "SUCCEEDED", 2, T + dt.timedelta(1)),
                               ("r1", "res::REDACT_IN_PLACE", "SUCCEEDED", 0, T),
                               ("r1", "res::ENCRYPTED_COPY", "FAILED", None, T)],
                              "deletion_request_id string, destination string, status string, records_found long, "
                              "updated_at timestamp")
    st = D.record_wipes(state, w).collect()[0]
    assert {x.destination: x.status for x in st.janitor_wipes} == {
        "hubspot": "SUCCEEDED", "res::REDACT_IN_PLACE": "SUCCEEDED", "res::ENCRYPTED_COPY": "FAILED"}
    out = D.cascade_outcome(D.latest_wipes(w)).collect()[0]
    assert out.next_status == "CASCADE_PARTIAL_FAILURE" and out.failed_destinations == ["res::ENCRYPTED_COPY"]


def test_cascade_shortcut_and_open_destinations(spark):
    req = _state(spark, [("r1", "t", "u1", "CASCADE_PENDING", T, None), ("r2", "t", "u2", "CASCADE_PENDING", T, None),
                         ("r3", "t2", "u3", "CASCADE_PENDING", T, None)])
    tasks = spark.createDataFrame([("t", "u1", "hubspot")], "tenant_id string, user_id string, destination string")
    res = spark.createDataFrame([("t", "res", "REDACT_IN_PLACE")], "tenant_id string, resource_id string, strategy string")
    w = spark.createDataFrame([("r1", "hubspot", "SUCCEEDED", 1, T), ("r1", "res::REDACT_IN_PLACE", "SUCCEEDED", 1, T)],
                              "deletion_request_id string, destination string, status string, records_found long, "
                              "updated_at timestamp")
    out = {r.deletion_request_id: (r.next_status, r.n_planned) for r in D.cascade(req, tasks, res, w).collect()}
    assert out == {"r1": ("CASCADE_COMPLETE", 2), "r2": ("CASCADE_IN_PROGRESS", 1), "r3": ("CASCADE_COMPLETE", 0)}


def test_wipe_attempt_rules(spark):
    a = spark.createDataFrame([("t1", 1, False, "HTTP 500"), ("t1", 2, False, "Rate limited"), ("t1", 3, False, "500"),
                               ("t1", 4, True, None), ("t2", 1, False, "HTTP 500"), ("t2", 2, True, None),
                               ("t3", 1, False, "invalid token"), ("t3", 2, True, None)],
                              "task_id string, attempt int, ok boolean, error string")
    r = {x.task_id: (x.status, x.attempts) for x in D.wipe_attempts(a).collect()}
    assert r == {"t1": ("FAILED", 3), "t2": ("COMPLETE", 2), "t3": ("FAILED", 1)}


def test_connectors_run_on_executors(spark):
    tasks = spark.createDataFrame([("r1", "t", "u1", "HubSpot"), ("r2", "t", "u2", "hubspot"), ("r3", "t", "u3", "zendesk"),
                                   ("r4", "t", "u4", "salesforce")],
                                  "deletion_request_id string, tenant_id string, user_id string, destination string")
    hub = CN.TableConnector("hubspot", {("t", "u2"): {"status": "FAILED", "error": "HTTP 500 upstream"}})
    sf = CN.TableConnector("salesforce", {("t", "u4"): RuntimeError("connection reset")})
    out = {r.deletion_request_id: (r.status, r.attempts) for r in CN.run_wipes(tasks, [hub, sf]).collect()}
    assert out == {"r1": ("SUCCEEDED", 1), "r2": ("FAILED", 3), "r3": ("FAILED", 0), "r4": ("FAILED", 1)}


def test_requests_by_requester_keyset_page(spark):
    rows = [(f"r{i}", "t", f"u{i}", "SHRED_REQUESTED", T + dt.timedelta(days=i), "a@x") for i in range(60)]
    st = _state(spark, rows)
    page = D.by_requester(st, 50).collect()
    assert len(page) == 50 and max(r.rank for r in page) == 50
    nxt = D.by_requester(st, 50, F.lit(T + dt.timedelta(days=10))).collect()
    assert len(nxt) == 10 and {r.deletion_request_id for r in nxt} == {f"r{i}" for i in range(10)}


def test_a_thousand_moves_of_one_request(spark):
    """Accepted and refused moves in turn over several runs; the number of exchanges doesn't follow the moves."""
    state = _state(spark, [("r1", "t", "u", "CASCADE_PARTIAL_FAILURE", T, None), ("r2", "t", "v", "SHRED_REQUESTED", T, None),
                           ("r3", "t", "w", "NO_SUCH_STATE", T, None), ("r4", "t", "x", "KEY_DESTROYED", T, None)])
    seq = ["CASCADE_IN_PROGRESS", "CERTIFICATE_ISSUED", "CASCADE_PARTIAL_FAILURE", "NO_SUCH_STATE"] * 300
    rows = [("r1", s, f"op{i:05}", T + dt.timedelta(hours=i + 1)) for i, s in enumerate(seq)]
    rows += [("r2", "KEY_DESTROYED", "a", T), ("r2", "CASCADE_PENDING", "b", T), ("r3", "KEY_DESTROYED", "a", T),
             ("r9", "KEY_DESTROYED", "a", T)]
    schema = "deletion_request_id string, to_status string, operation_id string, at timestamp"
    new, dec = D.advance(state, spark.createDataFrame(rows, schema))
    after = {r.deletion_request_id: r for r in new.collect()}
    got = [r for r in dec.orderBy("at").collect() if r.deletion_request_id == "r1"]
    assert [r.accepted for r in got] == [True, False] * 600 and [r.to_status for r in got] == seq
    assert [r.from_status for r in got] == ["CASCADE_PARTIAL_FAILURE", *["CASCADE_IN_PROGRESS"] * 2, "CASCADE_PARTIAL_FAILURE"] * 300
    assert got[1].error == "Invalid state transition from CASCADE_IN_PROGRESS to CERTIFICATE_ISSUED"
    assert after["r1"].status == "CASCADE_PARTIAL_FAILURE" and len(after["r1"].status_history) == 600
    assert after["r1"].updated_at == T + dt.timedelta(hours=1199) and after["r1"].cascade_initiated_at == T + dt.timedelta(hours=1197)
    assert after["r2"].status == "CASCADE_PENDING" and [h.operation_id for h in after["r2"].status_history] == ["a", "b"]
    assert after["r2"].key_destroyed_at == T and after["r3"].status == "NO_SUCH_STATE" and after["r4"].status == "KEY_DESTROYED"
    assert {(r.deletion_request_id, r.accepted) for r in dec.collect()} == {("r1", True), ("r1", False), ("r2", True), ("r3", False)}

    def exchanges(moves):
        plan = D.advance(state, moves)[1]._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange ")
    assert exchanges(spark.createDataFrame(rows, schema)) == exchanges(spark.createDataFrame(rows[-4:], schema))


def test_state_maps_equal_single_moves(spark):
    r = random.Random(3)
    state = _state(spark, [(f"r{i}", "t", f"u{i}", r.choice(schemas.DELETION_STATES), T, None) for i in range(40)])
    moves = [(f"r{i}", r.choice(schemas.DELETION_STATES), f"op{j}", T + dt.timedelta(hours=j)) for i in range(40) for j in range(r.randrange(7))]
    now = {x.deletion_request_id: x.status for x in state.collect()}
    want = []
    for rid, to, _, at in sorted(moves, key=lambda m: (m[0], m[3])):
        ok = to in schemas.TRANSITIONS[now[rid]]
        want.append((rid, at, now[rid], to, ok))
        now[rid] = to if ok else now[rid]
    new, dec = D.advance(state, spark.createDataFrame(moves, "deletion_request_id string, to_status string, operation_id string, at timestamp"))
    got = [(x.deletion_request_id, x.at, x.from_status, x.to_status, x.accepted) for x in dec.collect()]
    assert sorted(got) == sorted(want) and {x.deletion_request_id: x.status for x in new.collect()} == now


def test_cursor_reaches_requests_of_one_moment(spark):
    st = _state(spark, [(f"r{i:02}", "t", f"u{i}", "SHRED_REQUESTED", T, "a@x") for i in range(80)]
                + [("q", "t", "u", "SHRED_REQUESTED", T, "b@x")])
    page = D.by_requester(st.where("requested_by = 'a@x'"), 50).orderBy("rank").collect()
    nxt = D.by_requester(st.where("requested_by = 'a@x'"), 50, (F.lit(T), F.lit(page[-1].deletion_request_id))).collect()
    assert len(page) == 50 and {x.deletion_request_id for x in page + nxt} == {f"r{i:02}" for i in range(80)} and len(nxt) == 30
    cursors = D.by_requester(st, 50).where("rank = 50")
    own = D.by_requester(st, 50, cursors).collect()
    assert sorted(x.deletion_request_id for x in own) == sorted(["q", *[x.deletion_request_id for x in nxt]])
