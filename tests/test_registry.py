from pyspark.sql import functions as F

from shredline import schemas
from shredline.operators import coverage as COV
from shredline.operators import policy as P
from shredline.operators import registry as REG
from shredline.sources import registry_loader as RL

ROW_COLS = schemas.REGISTRY_ROWS.fieldNames()


def _rows(spark, rows):
    return spark.createDataFrame(rows, schemas.REGISTRY_ROWS)


def _row(res, layer, field, cls_, handling):
    return (res, res.split(".")[-1], "bigquery", layer, "dbt", field, cls_, handling, "HIGH", "name", False, "v1")


def test_assemble_derives_layer_policies_and_lineage(spark):
    rows = _rows(spark, [_row("bigquery:p.d.stg_users", "STAGING", "email", "DIRECT_IDENTIFIER", "ENCRYPT"),
                         _row("bigquery:p.d.stg_users", "STAGING", "user_id", "SYSTEM_IDENTIFIER", "HASH_SURROGATE"),
                         _row("bigquery:p.d.raw_users", "RAW", "email", "DIRECT_IDENTIFIER", "ENCRYPT")])
    lin = spark.createDataFrame([("bigquery:p.d.stg_users", "user_id", "int_customer_activity", 1)], schemas.FIELD_LINEAGE)
    e = {r.resource_id: r for r in REG.assemble(rows, lin).collect()}
    stg, raw = e["bigquery:p.d.stg_users"], e["bigquery:p.d.raw_users"]
    assert [f.name for f in stg.pii_fields] == ["email", "user_id"]
    assert stg.evidence_pointers == ["dbt:model:stg_users", "lineage:used_in=int_customer_activity:user_id@1hops"]
    assert stg.visibility == "CUSTOMER_FACING" and stg.deletion_strategy == "CRYPTO_SHRED" and stg.ghost_data_scan.enabled
    assert raw.visibility == "INTERNAL" and not raw.ghost_data_scan.enabled and raw.ghost_data_scan.scan_mode == "DISABLED"
    assert raw.handling_policy == "raw_auto_registry" and raw.pii_fields[0].evidence == ["dbt:detection:name"]


def _entry(spark, **kw):
    base = {"resource_id": "bigquery:acme.warehouse.users", "system": "bigquery", "tenant_id_column": "tenant_id",
            "user_id_column": "user_id", "deletion_strategy": "CRYPTO_SHRED", "owner_connector": "dbt"}
    base.update(kw)
    fields = base.pop("fields", [("email", "DIRECT_IDENTIFIER", "ENCRYPT")])
    scan = base.pop("scan", True)
    keys = sorted(base)
    df = spark.createDataFrame([tuple(base[k] for k in keys)], ", ".join(f"{k} string" for k in keys))
    df = df.withColumn("pii_fields", F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(c).alias("classification"), F.lit(h).alias("handling"),
                 F.lit(False).alias("required_in_mart"), F.lit("DECLARED").alias("confidence"),
                 F.array().cast("array<string>").alias("evidence")) for n, c, h in fields]))
    df = df.withColumn("ghost_data_scan", F.struct(F.lit(scan).alias("enabled"), F.lit("SAMPLED").alias("scan_mode"),
                                                   F.array().cast("array<string>").alias("patterns")))
    return REG.conform(df)


def test_compose_manual_wins_and_stale_dbt_connector_entries_drop(spark):
    conn = _entry(spark, resource_id="hubspot:contacts", system="hubspot", owner_connector="hubspot") \
        .unionByName(_entry(spark, resource_id="bigquery:p.d.stg_users", owner_connector="dbt", registry_version="old"))
    dbt = _entry(spark, resource_id="bigquery:p.d.stg_users", owner_connector="dbt", registry_version="new")
    manual = _entry(spark, resource_id="bigquery:p.d.stg_users", owner_connector="manual", tenant_id="acme")
    out = {(r.tenant_id, r.resource_id): r for r in REG.compose(conn, dbt, manual).collect()}
    assert out[(None, "bigquery:p.d.stg_users")].registry_version == "new"
    assert out[("acme", "bigquery:p.d.stg_users")].owner_connector == "manual"
    assert (None, "hubspot:contacts") in out and len(out) == 3
    # without a dbt slice the connector registry is used unchanged
    only = REG.compose(conn, dbt.limit(0))
    assert only.count() == 2


def test_lookup_precedence(spark):
    reg = _entry(spark, resource_id="r1").unionByName(_entry(spark, resource_id="r1", tenant_id="t1", owner_connector="manual")) \
        .unionByName(_entry(spark, resource_id="r2", tenant_id="t2", owner_connector="manual"))
    req = spark.createDataFrame([("q1", "r1", "t1"), ("q2", "r1", "t9"), ("q3", "r1", None), ("q4", "r2", None),
                                 ("q5", "r2", "t1")], "request_id string, resource_id string, tenant_id string")
    got = {r.request_id: r.tenant_id for r in REG.lookup(req, reg).collect()}
    assert got == {"q1": "t1", "q2": None, "q3": None, "q4": "t2"}


def test_declaration_validation_collects_every_error(spark):
    rec = {"tenant_id": "", "resource_id": "BigQuery:x", "system": "mainframe", "resource_layer": "GOLD",
           "visibility": None, "tenant_id_column": "uid", "user_id_column": "uid", "deletion_strategy": None,
           "source_redaction_strategy": None, "status": None, "fields_spec": "email:CONTACT:ENCRYPT;:PHONE:ZIP",
           "scan_mode": "ALWAYS", "source_redaction_strategies": "NONE,REDACT_IN_PLACE"}
    keys = sorted(rec)
    d = spark.createDataFrame([tuple(rec[k] for k in keys)], ", ".join(f"{k} string" for k in keys))
    d = d.withColumn("fields", REG.parse_fields("fields_spec")) \
        .withColumn("source_redaction_strategies", REG.parse_strategies("source_redaction_strategies"))
    errs = d.select(REG.declaration_errors(d).alias("e")).collect()[0].e
    assert errs[0].startswith("tenantId is required")
    assert any(e.startswith("resourceId must be a URI-like") for e in errs)
    assert any(e.startswith("system must be one of") for e in errs)
    assert any(e.startswith("resourceLayer must be one of") for e in errs)
    assert any(e.startswith("sourceRedactionStrategies[0] must be one of") for e in errs)
    assert any(e.startswith("userIdColumn and tenantIdColumn cannot be the same column") for e in errs)
    assert "piiFields[1].name is required." in errs
    assert any(e.startswith("piiFields[1].classification") for e in errs)
    assert any(e.startswith("piiFields[1].handling") for e in errs)
    assert errs[-1].startswith("ghostDataScan.scanMode")
    assert len(errs) == 10


def test_policy_issues_and_status(spark):
    mart = _entry(spark, resource_id="bigquery:p.d.mart_users", deletion_strategy="MANUAL_REVIEW",
                  fields=[("email", "DIRECT_IDENTIFIER", "ENCRYPT"), ("city", "QUASI_IDENTIFIER", "MANUAL_REVIEW")],
                  scan=False, tenant_id_column=None)
    ev = P.evaluate(mart).collect()[0]
    assert [i.code for i in ev.issues] == ["MISSING_TENANT_SCOPE", "MANUAL_REVIEW_REQUIRED", "DIRECT_IDENTIFIER_IN_MART",
                                           "MANUAL_REVIEW_REQUIRED", "GHOST_SCAN_DISABLED"]
    assert ev.policy_status == "FAIL"
    ok = P.evaluate(_entry(spark)).collect()[0]
    assert ok.policy_status == "PASS" and ok.issues == []
    overall = P.overall(P.evaluate(mart.unionByName(_entry(spark)))).collect()[0]
    assert overall.status == "FAIL" and overall.entries == 2


def test_coverage_score_matches_reference_example(spark):
    items = spark.createDataFrame([("t", "a", "bigquery", "PROTECTED", 3.0, ["x"]), (None, "b", "bigquery", "PARTIAL", 5.0, ["y"]),
                                   ("t", "c", "bigquery", "EXPOSED", 5.0, ["z"]), ("u", "d", "bigquery", "PROTECTED", 1.0, ["z"])],
                                  "tenant_id string, resource_id string, system string, state string, weight double, "
                                  "reasons array<string>")
    r = {x.tenant_id: x for x in COV.report(items).collect()}
    assert r["t"].score == 42 and r["t"].n_total == 3 and r["t"].w_total == 13.0
    assert (r["u"].n_total, r["u"].w_total, r["u"].score) == (2, 6.0, 58) and r[None].n_total == 1
    assert COV.report(items.limit(0)).count() == 0
    order = COV.ranked_items(items.withColumn("kind", F.lit(0))).where("tenant_id = 't'").orderBy("rank").collect()
    assert [x.resource_id for x in order] == ["c", "a"]


def test_classify_entry(spark):
    findings = spark.createDataFrame([("t", "bigquery:p.d.t", "bigquery", "DRIFTED", ["email", "paid", "description"])],
                                     "tenant_id string, resource_id string, system string, registry_status string, "
                                     "columns array<string>")
    entries = _entry(spark).unionByName(_entry(spark, resource_id="r2", deletion_strategy="DELETE_ROWS",
                                               fields=[("ip", "QUASI_IDENTIFIER", "REDACT")]))
    it = {r.resource_id: r for r in COV.items(entries, findings).collect()}
    assert it["bigquery:acme.warehouse.users"].state == "PROTECTED" and it["bigquery:acme.warehouse.users"].weight == 3.0
    assert it["r2"].state == "PARTIAL"
    assert it["r2"].reasons == ["not key-reversible: ip=REDACT", "deletion strategy is DELETE_ROWS, not CRYPTO_SHRED"]
    # email 3 + paid 0.5 (by "id") + description 2 (by "ip")
    assert it["bigquery:p.d.t"].state == "EXPOSED" and it["bigquery:p.d.t"].weight == 5.5
    assert it["bigquery:p.d.t"].reasons == ["schema drift vs registry"]


def test_missing_columns_and_view_conflicts(spark):
    decls = spark.createDataFrame([(1, "t", "r1", "user_id", "tenant", "REDACT_IN_PLACE"),
                                   (2, "t", "r2", "user_id", None, "REDACT_IN_PLACE")],
                                  "decl_id int, tenant_id string, resource_id string, user_id_column string, "
                                  "tenant_id_column string, source_redaction_strategy string") \
        .withColumn("fields", F.array(F.struct(F.lit("email").alias("name")), F.struct(F.lit("phone").alias("name")))) \
        .withColumn("source_redaction_strategies", F.lit(None).cast("array<string>"))
    cols = spark.createDataFrame([("r1", "user_id"), ("r1", "email")], "resource_id string, column_name string")
    miss = REG.missing_columns(decls, cols).collect()
    assert len(miss) == 1 and miss[0].missing_columns == ["phone", "tenant"] and miss[0].real_columns == ["email", "user_id"]
    types = spark.createDataFrame([("r1", "VIEW"), ("r2", "BASE TABLE")], "resource_id string, table_type string")
    assert [r.decl_id for r in REG.view_conflicts(decls, types).collect()] == [1]


def test_registry_loader_tolerates_missing_slices(spark, tmp_dir):
    rows = _rows(spark, [_row("bigquery:p.d.stg_users", "STAGING", "email", "DIRECT_IDENTIFIER", "ENCRYPT")])
    rows.write.parquet(f"{tmp_dir}/rows")
    reg = RL.load_registry(spark, connector=lambda s: RL.seed_registry(s),
                           dbt=[RL.dbt_loader(f"{tmp_dir}/rows", f"{tmp_dir}/missing_lineage"),
                                RL.dbt_loader(f"{tmp_dir}/nope", f"{tmp_dir}/nope2")],
                           manual=RL.table_loader(f"{tmp_dir}/no_manual"))
    ids = sorted(r.resource_id for r in reg.collect())
    assert ids == ["bigquery:p.d.stg_users", "hubspot:contacts", "salesforce:contacts"]


def test_watermarks_only_move_forward(spark):
    e = _entry(spark, tenant_id="t", owner_connector="manual").withColumn(
        "last_synced_at", F.to_timestamp(F.lit("2026-05-01 00:00:00")))
    marks = spark.createDataFrame([("t", "bigquery:acme.warehouse.users", "2026-04-01T00:00:00", "not a date"),
                                   ("t", "bigquery:acme.warehouse.users", "2026-06-01T00:00:00", None)],
                                  "tenant_id string, resource_id string, synced_at string, attempt_at string")
    r = REG.advance_watermarks(e, marks).collect()[0]
    assert str(r.last_synced_at).startswith("2026-06-01") and r.last_sync_attempt_at is None
    older = marks.where("synced_at < '2026-05'")
    assert str(REG.advance_watermarks(e, older).collect()[0].last_synced_at).startswith("2026-05-01")


def test_upsert_merges_like_repeated_writes(spark):
    import datetime as dt
    base = {"tenant_id": "t", "resource_id": "bigquery:p.d.c", "system": "bigquery", "visibility": None,
            "tenant_id_column": "tenant_id", "deletion_strategy": None, "source_redaction_strategy": None,
            "status": None, "scan_mode": None, "fields_spec": "email:CONTACT:ENCRYPT"}
    rows = [dict(base, decl_id=1, resource_layer="RAW", user_id_column="uid", updated_at_column="updated_at",
                 actor="a@x", declared_at=dt.datetime(2026, 8, 1)),
            dict(base, decl_id=2, resource_layer=None, user_id_column=None, updated_at_column="updated_at",
                 actor=None, declared_at=dt.datetime(2026, 8, 2))]
    keys = sorted(rows[0])
    types = {"decl_id": "int", "declared_at": "timestamp"}
    d = spark.createDataFrame([tuple(r[k] for k in keys) for r in rows],
                              ", ".join(f"{k} {types.get(k, 'string')}" for k in keys))
    d = d.withColumn("fields", REG.parse_fields("fields_spec")) \
        .withColumn("source_redaction_strategies", F.lit(None).cast("array<string>")) \
        .withColumn("scan_enabled", F.lit(True))
    stored = REG.conform(spark.createDataFrame(
        [("t", "bigquery:p.d.c", "manual", dt.datetime(2026, 1, 1), "first@x", dt.datetime(2026, 7, 1),
          dt.datetime(2026, 7, 2))],
        "tenant_id string, resource_id string, owner_connector string, created_at timestamp, declared_by string, "
        "last_synced_at timestamp, last_sync_attempt_at timestamp"))
    e = REG.build_entries(d, stored, F.lit(dt.datetime(2026, 9, 1)))[0].collect()[0]
    assert e.resource_layer == "RAW" and e.user_id_column == "uid"          # empty fields keep earlier values
    assert e.last_modified_by is None and e.declared_by == "first@x"        # actor cleared; first declarer kept
    assert str(e.created_at).startswith("2026-01-01") and str(e.last_synced_at).startswith("2026-07-01")
    cleared = d.withColumn("updated_at_column", F.when(F.col("decl_id") == 1, F.lit(None)).otherwise(F.col("updated_at_column")))
    e2 = REG.build_entries(cleared, stored, F.lit(dt.datetime(2026, 9, 1)))[0].collect()[0]
    assert e2.updated_at_column == "updated_at" and e2.last_synced_at is None   # watermark cleared on the way
    assert str(e2.last_sync_attempt_at).startswith("2026-07-02")
