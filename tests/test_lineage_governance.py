import datetime as dt
import json

from pyspark.sql import functions as F

from shredline import schemas
from shredline.operators import audit as AU
from shredline.operators import keys as K
from shredline.operators import lineage as LIN
from shredline.operators import scan as SCN
from shredline.operators import sync_runs as SR
from shredline.operators import views as VW

T = dt.datetime(2026, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame(rows, schemas.LINEAGE_EVENTS)


def _ghost(eid, tenant, user, res, count, ts):
    ctx = json.dumps({"data_classification": "GHOST_DATA", "resource_id": res, "column": "email", "pattern": "EMAIL",
                      "count": count, "confidence": 0.98})
    return (eid, tenant, user, "ghost-data-scanner", res, ts, ctx, None, None)


def test_normalise_aliases_defaults_and_caller_override(spark):
    raw = spark.createDataFrame([("u1", None, "t1", "api", "hubspot", '{"event_type":"CUSTOM","x":1}', None),
                                 (None, "u2", None, "api", "crm", None, '{"k":"v"}')],
                                "userId string, user_id string, tenantId string, source string, destination string, "
                                "context string, metadata string").withColumn("eventType", F.lit("VIEW"))
    ev = {r.user_id: r for r in LIN.normalise(raw).collect()}
    c1, c2 = json.loads(ev["u1"].context), json.loads(ev["u2"].context)
    assert ev["u1"].tenant_id == "t1" and ev["u2"].tenant_id == "default-tenant"
    assert c1["event_type"] == "CUSTOM" and c1["x"] == "1" and c1["deletion_request_id"] == "NONE"
    assert c2["event_type"] == "VIEW" and c2["k"] == "v" and c2["data_classification"] == "UNKNOWN"
    assert c1["operation_id"] == ev["u1"].event_id


def test_ghost_findings_are_whole_and_not_paired_with_requests(spark):
    rows = [_ghost(f"e{i}", "A", "UNKNOWN", f"bigquery:p.d.t{i}", i, T + dt.timedelta(hours=i)) for i in range(60)]
    rows += [_ghost("mine", "A", "u1", "bigquery:p.d.mine", 1, T + dt.timedelta(days=30))]
    rows += [_ghost("other", "B", "UNKNOWN", "bigquery:p.d.b", 1, T)]
    ev = _events(spark, rows)
    req = spark.createDataFrame([("A", "u1"), ("A", "u2"), ("B", "u3")], "tenant_id string, user_id string")
    per = {}
    for r in LIN.ghost_findings(req, ev).collect():
        per.setdefault((r.tenant_id, r.req_user_id), []).append(r)
    assert {k: len(v) for k, v in per.items()} == {("A", "u1"): 1, ("A", None): 60, ("B", None): 1}
    assert per["A", "u1"][0].scope == "USER_LINKED" and all(r.scope == "RESOURCE_LEVEL" for r in per["A", None])
    assert sorted(r["rank"] for r in per["A", None]) == list(range(1, 61))
    assert LIN.ghost_findings(req, ev, page=5).count() == 1 + 5 + 1
    counts = {(r.tenant_id, r.user_id): r.ghost_findings for r in LIN.ghost_counts(req, ev).collect()}
    assert counts == {("A", "u1"): 61, ("A", "u2"): 60, ("B", "u3"): 1}


def test_discovery_latest_before_status_filter(spark):
    def disc(eid, res, status, ts):
        return (eid, "A", "UNKNOWN", "crawler", res, ts, json.dumps(
            {"event_type": "WAREHOUSE_METADATA_DISCOVERED", "resource_id": res, "registry_status": status,
             "new_columns": ["email"]}), None, None)
    ev = _events(spark, [disc("1", "r1", "UNREGISTERED", T), disc("2", "r1", "REGISTERED", T + dt.timedelta(1)),
                         disc("3", "r2", "REGISTERED", T), disc("4", "r2", "DRIFTED", T + dt.timedelta(1)),
                         ("5", "A", "UNKNOWN", "crawler", "r3", T, '{"event_type":"WAREHOUSE_METADATA_DISCOVERED",'
                          '"registry_status":"UNREGISTERED","new_columns":"not json"}', None, None)])
    d = {r.resource_id: r for r in LIN.discovery_findings(ev).collect()}
    assert set(d) == {"r2", "r3"} and d["r2"].columns == ["email"] and d["r3"].columns == []


def test_hot_path_fallback_and_deletion_plan(spark):
    tk = spark.createDataFrame([("A",)], "tenant_id string").withColumn("kek", F.unhex(F.sha2(F.lit("k"), 256)))
    users = spark.createDataFrame([("A", "u1"), ("A", "u2"), ("A", "u3")], "tenant_id string, user_id string")
    reg = K.generate(K.empty_registry(spark), users, tk, F.lit(T)).state
    hot_only = _events(spark, [("e1", "A", "u2", "api", "HubSpot", T, "{}", None, None)])
    reg = LIN.add_destinations(reg, hot_only)
    warehouse = _events(spark, [("e2", "A", "u1", "api", "salesforce", T, "{}", None, None),
                                _ghost("g", "A", "UNKNOWN", "bigquery:p.d.x", 1, T)])
    fb = {(r.user_id, r.destination): r.read_model for r in LIN.lineage_with_fallback(users, warehouse, reg).collect()}
    assert fb == {("u1", "salesforce"): "warehouse", ("u2", "HubSpot"): "hot-path"}
    plan = {r.user_id: r for r in LIN.deletion_plan(users, warehouse, reg).collect()}
    assert plan["u2"].impacted_destinations == ["HubSpot"]          # connector match is case-insensitive
    assert plan["u1"].ghost_findings == 1 and plan["u3"].found       # resource-level finding only
    none = LIN.deletion_plan(users, warehouse.where("user_id <> 'UNKNOWN'"), reg)
    assert {r.user_id: r.found for r in none.collect()}["u3"] is False


def test_scan_counts_without_values(spark):
    df = spark.createDataFrame([("mail me at a.b@example.com or c@d.org",), ("call +1 (555) 010-9999",),
                                ("Dear Mr. Smith",), ("nothing here",)], "text string")
    f = {r.pattern: r for r in SCN.scan_columns(df, "bigquery:p.raw.docs", ["text"]).collect()}
    assert f["EMAIL"].rows_matched == 1 and f["EMAIL"].matches == 2
    assert f["PHONE"].rows_matched == 1 and f["NAME"].rows_matched == 1
    hashes = SCN.match_hashes(df, "r", "text", "EMAIL").collect()
    assert len(hashes) == 2 and all(len(h.value_hash) == 64 for h in hashes)


def test_crawl_statuses(spark):
    inv = spark.createDataFrame([("r1", "email", "string"), ("r1", "id", "bigint"), ("r2", "x", "string"),
                                 ("r3", "a", "string"), ("r3", "b", "int")], "resource_id string, column_name string, data_type string")
    prev = spark.createDataFrame([("r1", "email", "string"), ("r1", "id", "bigint"), ("r3", "a", "string"),
                                  ("r3", "b", "string"), ("r3", "c", "string")], "resource_id string, column_name string, data_type string")
    reg = spark.createDataFrame([("r1", ["email"]), ("r3", ["a"])], "resource_id string, names array<string>") \
        .select("resource_id", F.transform("names", lambda n: F.struct(n.alias("name"))).alias("pii_fields"))
    out = {r.resource_id: r for r in SCN.crawl(inv, prev, reg).collect()}
    assert out["r1"].registry_status == "REGISTERED" and out["r2"].registry_status == "UNREGISTERED"
    assert out["r3"].registry_status == "DRIFTED" and out["r3"].missing_columns == ["c"] and out["r3"].type_changed == ["b"]


def test_sync_progress_out_of_order(spark):
    runs = spark.createDataFrame([("run1", "t", "r", T), ("run2", "t", "r", T), ("run3", "t", "r", T)],
                                 "run_id string, tenant_id string, resource_id string, started_at timestamp")
    m = spark.createDataFrame([
        ("run1", "chunk", None, "completed", T + dt.timedelta(hours=1), 1),
        ("run1", "chunk", None, "completed", T + dt.timedelta(hours=2), 2),
        ("run1", "total", 2, None, T + dt.timedelta(hours=3), None),
        ("run2", "total", 3, None, T, None), ("run2", "chunk", None, "failed", T, 1),
        ("ghost", "chunk", None, "completed", T, 1)],
        "run_id string, kind string, chunks_total long, outcome string, at timestamp, chunk_id int")
    p = {r.run_id: r for r in SR.progress(runs, m).collect()}
    assert p["run1"].status == "complete" and p["run1"].completed_at == T + dt.timedelta(hours=3)
    assert p["run2"].status == "running" and p["run2"].chunks_failed == 1
    assert p["run3"].status == "enumerating" and "ghost" not in p


def test_view_catalog_rules(spark):
    avail = spark.createDataFrame([("t", "email"), ("t", "phone")], "tenant_id string, field_name string")
    decls = spark.createDataFrame([("t", "support", ["email"], "tickets", "a", "svc", T),
                                   ("t", "1bad", ["email"], "x", "a", "svc", T),
                                   ("t", "nojust", ["email"], "  ", "a", "svc", T),
                                   ("t", "nofields", [], "x", "a", "svc", T),
                                   ("t", "unsynced", ["ssn"], "x", "a", "svc", T)],
                                  "tenant_id string, view_name string, fields array<string>, justification string, "
                                  "created_by string, consumer string, declared_at timestamp")
    cat, out = VW.declare(VW.empty_catalog(spark), decls, avail, F.lit(T))
    assert {r.view_name: r.created for r in out.collect()} == {
        "support": True, "1bad": False, "nojust": False, "nofields": False, "unsynced": False}
    cat2, out2 = VW.declare(cat, decls.where("view_name = 'support'"), avail, F.lit(T))
    assert out2.collect()[0].created is False                         # active duplicate refused
    revoked = VW.revoke(cat, spark.createDataFrame([("t", "support", "b")], "tenant_id string, view_name string, revoked_by string"), F.lit(T))
    assert revoked.collect()[0].status == "revoked"
    cat3, out3 = VW.declare(revoked, decls.where("view_name = 'support'"), avail, F.lit(T))
    assert out3.collect()[0].created is True                          # revoked name reusable


def test_audit_events_and_paging(spark):
    e = spark.createDataFrame([("r1", "t", "a@x", T, "b@x", T + dt.timedelta(1)), ("r2", "t", "a@x", T, "a@x", T)],
                              "resource_id string, tenant_id string, declared_by string, created_at timestamp, "
                              "last_modified_by string, updated_at timestamp")
    req = spark.createDataFrame([("u9", "t", "a@x", T + dt.timedelta(2))],
                                "user_id string, tenant_id string, requested_by string, created_at timestamp")
    ev = AU.events(e, req)
    got = sorted((r.type, r.resource_id, r.actor_email) for r in ev.collect())
    assert got == [("DELETION_REQUESTED", "u9", "a@x"), ("PII_REGISTRY_DECLARED", "r1", "a@x"),
                   ("PII_REGISTRY_DECLARED", "r2", "a@x"), ("PII_REGISTRY_MODIFIED", "r1", "b@x")]
    page = AU.by_actor(ev, "a@x", page=2).collect()
    assert [r.resource_id for r in sorted(page, key=lambda r: r["rank"])] == ["u9", "r1"]
    assert [r.resource_id for r in AU.by_actor(ev, "a@x", page=2, after=2).collect()] == ["r2"]
    assert AU.by_actor(ev).count() == 4 and AU.by_actor(ev.unionByName(ev.withColumn("tenant_id", F.lit("u")))).where("rank > 3").count() == 0
    assert sorted(r.type for r in AU.by_resource(e, "r1").collect()) == ["PII_REGISTRY_DECLARED", "PII_REGISTRY_MODIFIED"]
    assert AU.page_size("abc") == 50 and AU.page_size(-1) == 50 and AU.page_size(500) == 200 and AU.page_size("7") == 7


def test_scan_and_crawl_events_feed_the_lineage_readers(spark):
    docs = spark.createDataFrame([(f"contact {i} at p{i}@example.com",) for i in range(200)], "text string")
    full = SCN.scan_columns(docs, "bigquery:p.raw.docs", ["text"])
    sampled = SCN.scan_columns(docs, "bigquery:p.raw.docs", ["text"], mode="SAMPLED", fraction=0.2)
    f, s = full.collect()[0], sampled.collect()[0]
    assert f.rows_matched == 200 and 0 < s.rows_matched < 200 and s.scan_mode == "SAMPLED"
    ghosts = LIN.ghost_groups(SCN.ghost_events(full, F.lit(T), "A")).collect()
    assert len(ghosts) == 1 and ghosts[0].user_id == "UNKNOWN" and ghosts[0].finding_count == 200
    inv = spark.createDataFrame([("bigquery:p.raw.docs", "text", "string")], "resource_id string, column_name string, data_type string")
    reg = spark.createDataFrame([], "resource_id string, pii_fields array<struct<name:string>>")
    crawl = SCN.crawl(inv, None, reg, full)
    disc = LIN.discovery_findings(SCN.crawl_events(crawl, F.lit(T), "A")).collect()
    assert [(d.resource_id, d.registry_status, d.columns) for d in disc] == [("bigquery:p.raw.docs", "UNREGISTERED", ["text"])]
