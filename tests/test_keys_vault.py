import datetime as dt

from pyspark.sql import functions as F

from shredline.functions import crypto as C
from shredline.operators import keys as K
from shredline.operators import redaction as R
from shredline.operators import vault as V

def T0():
    return F.to_timestamp(F.lit("2026-01-01 00:00:00"))


def T1():
    return F.to_timestamp(F.lit("2026-01-02 00:00:00"))


def T2():
    return F.to_timestamp(F.lit("2026-01-03 00:00:00"))


def _tk(spark, tenants=("A", "B")):
    df = spark.createDataFrame([(t,) for t in tenants], "tenant_id string")
    return (df.withColumn("kek", F.unhex(F.sha2(F.concat(F.lit("kek-"), "tenant_id"), 256)))
            .withColumn("token_key", F.unhex(F.sha2(F.concat(F.lit("tok-"), "tenant_id"), 256))))


def _users(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, user_id string, email string")


def test_generate_is_idempotent_and_regenerates_shredded(spark):
    tk = _tk(spark)
    users = _users(spark, [("A", "u1", "a@x"), ("A", "u2", "b@x"), ("B", "u1", "c@x")])
    reg = K.generate(K.empty_registry(spark), users, tk, T0()).state
    again = K.generate(reg, users, tk, T1())
    assert {r.outcome for r in again.outcome.collect()} == {"EXISTS"}
    shredded = K.shred(reg, users.where("user_id = 'u2'").select("tenant_id", "user_id"), T1()).state
    out = {(r.tenant_id, r.user_id): (r.outcome, r.regenerated)
           for r in K.generate(shredded, users, tk, T2()).outcome.collect()}
    assert out[("A", "u2")] == ("GENERATED", True)
    assert out[("A", "u1")] == ("EXISTS", False)


def test_shred_upserts_unknown_user_and_empties_material(spark):
    tk = _tk(spark)
    reg = K.generate(K.empty_registry(spark), _users(spark, [("A", "u1", "x")]), tk, T0()).state
    req = spark.createDataFrame([("A", "u1", "r1"), ("A", "ghost", "r2")], "tenant_id string, user_id string, deletion_request_id string")
    st = {(r.tenant_id, r.user_id): r for r in K.shred(reg, req, T1()).state.collect()}
    assert st[("A", "u1")].status == "SHREDDED" and st[("A", "u1")].deks == {} and st[("A", "u1")].active_dek_id is None
    assert st[("A", "ghost")].status == "SHREDDED" and st[("A", "ghost")].deletion_request_id == "r2"
    assert K.key_versions(K.shred(reg, req, T1()).state, tk).count() == 0


def test_rotate_keeps_old_versions_readable(spark):
    tk = _tk(spark)
    users = _users(spark, [("A", "u1", "old@x")])
    reg = K.generate(K.empty_registry(spark), users, tk, T0()).state
    reg.cache()
    kv1 = K.key_versions(reg, tk)
    v_old = V.encrypt_table(users, ["email"], "r", kv1, tk, T0()).cache()
    v_old.count()
    rot = K.rotate(reg, users, tk, T1())
    assert rot.outcome.collect()[0].new_version == "v2"
    reg2 = rot.state.cache()
    kv2 = K.key_versions(reg2, tk)
    assert kv2.collect()[0].active_dek_id == "v2"
    assert V.decrypt_vault(v_old, kv2).collect()[0].value == "old@x"
    missing = K.rotate(reg2, _users(spark, [("A", "nobody", None)]), tk, T1()).outcome.collect()[0]
    assert missing.outcome == "ERROR"


def test_encryption_contexts_codes(spark):
    tk = _tk(spark)
    reg = K.generate(K.empty_registry(spark), _users(spark, [("A", "u1", "x"), ("A", "u2", "y")]), tk, T0()).state
    reg = K.shred(reg, spark.createDataFrame([("A", "u2")], "tenant_id string, user_id string"), T1()).state
    broken = reg.withColumn("active_dek_id", F.when(F.col("user_id") == "u1", F.lit("v9")).otherwise(F.col("active_dek_id")))
    req = _users(spark, [("A", "u1", None), ("A", "u2", None), ("A", "u3", None)])
    ok = {r.user_id: r.status_code for r in K.encryption_contexts(reg, req).collect()}
    assert ok == {"u1": 200, "u2": 404, "u3": 404}
    assert {r.user_id: r.status_code for r in K.encryption_contexts(broken, req).collect()}["u1"] == 500
    empty = reg.withColumn("deks", F.when(F.col("user_id") == "u1", F.create_map().cast("map<string,binary>"))
                           .otherwise(F.col("deks")))
    assert {r.user_id: r.status_code for r in K.encryption_contexts(empty, req).collect()}["u1"] == 500


def test_pivot_prefers_newest_decryptable_and_cross_tenant_isolation(spark):
    tk = _tk(spark)
    users = _users(spark, [("A", "u1", "new@a"), ("B", "u1", "new@b")])
    reg = K.generate(K.empty_registry(spark), users, tk, T0(), dek_fn=C.seeded_dek).state
    kv = K.key_versions(reg, tk)
    new = V.encrypt_table(users, ["email"], "r", kv, tk, T1())
    old = V.encrypt_table(users.withColumn("email", F.concat(F.lit("old-"), "email")), ["email"], "r", kv, tk, T0())
    junk = spark.createDataFrame([("A", "u1", "r", "email", "v1", None, "v1:bm90LWFuLWl2Cg==:eA==")],
                                 "tenant_id string, user_id string, resource_id string, field_name string, key_id string, "
                                 "token string, encrypted_value string").withColumn("synced_at", T2())
    vault = new.unionByName(old).unionByName(junk).cache()
    piv = {(r.tenant_id, r.user_id): r.email for r in V.decrypted_pivot(vault, kv, ["email"]).collect()}
    assert piv == {("A", "u1"): "new@a", ("B", "u1"): "new@b"}
    latest = {(r.tenant_id, r.user_id): r.value for r in V.latest_ciphertext(vault, kv).collect()}
    assert latest[("A", "u1")] is None and latest[("B", "u1")] == "new@b"
    # shred u1 in tenant A only: B still decrypts
    reg2 = K.shred(reg, spark.createDataFrame([("A", "u1")], "tenant_id string, user_id string"), T2()).state
    piv2 = {(r.tenant_id, r.user_id): r.email for r in V.decrypted_pivot(vault, K.key_versions(reg2, tk), ["email"]).collect()}
    assert piv2 == {("A", "u1"): None, ("B", "u1"): "new@b"}


def test_tokens_are_stable_join_keys(spark):
    tk = _tk(spark)
    users = _users(spark, [("A", "u1", "same@x"), ("A", "u2", "same@x")])
    reg = K.generate(K.empty_registry(spark), users, tk, T0()).state
    v = V.encrypt_table(users, ["email"], "r", K.key_versions(reg, tk), tk, T0()).collect()
    assert len({r.token for r in v}) == 1 and len({r.encrypted_value for r in v}) == 2


def test_redaction_strategies(spark):
    src = spark.createDataFrame([("A", "u1", "a@x", 1), ("A", "u2", "b@x", 2), ("B", "u1", "c@x", 3)],
                                "tenant_id string, user_id string, email string, n int")
    users = spark.createDataFrame([("A", "u1")], "tenant_id string, user_id string")
    red = R.redact_in_place(src, ["email"], users, "user_id", "tenant_id")
    rows = {(r.tenant_id, r.user_id): r.email for r in red.table.collect()}
    assert rows == {("A", "u1"): None, ("A", "u2"): "b@x", ("B", "u1"): "c@x"}
    assert red.affected.collect()[0].rows_affected == 1
    d = R.delete_users(src, users, "user_id", "tenant_id")
    assert d.table.count() == 2 and d.affected.collect()[0].rows_affected == 1
    schema = R.encrypted_copy_schema(src, ["email"])
    assert schema.count() == 0 and schema.columns[-1] == "synced_at" and dict(schema.dtypes)["email"] == "string"
    try:
        R.redact_in_place(src, ["email; drop"], users, "user_id")
        raise AssertionError("unsafe identifier accepted")
    except ValueError:
        pass


def test_ladder_decrypts_older_versions_only_where_the_newest_is_corrupt(spark):
    """A user with 1,000 versions: none of the older is read while the newest decrypts."""
    tk = spark.createDataFrame([("A",)], "tenant_id string").withColumns(
        {"kek": F.unhex(F.sha2(F.lit("kek"), 256)), "token_key": F.unhex(F.sha2(F.lit("tok"), 256))})
    users = spark.createDataFrame([("A", "many"), ("A", "corrupt"), ("A", "gone")], "tenant_id string, user_id string")
    reg = K.generate(K.empty_registry(spark), users, tk, F.lit(dt.datetime(2026, 1, 1)), dek_fn=C.seeded_dek).state
    kv = K.key_versions(K.shred(reg, users.where("user_id = 'gone'"), F.lit(dt.datetime(2026, 1, 2))).state, tk)
    all_keys = K.key_versions(reg, tk)
    versions = users.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(999))))
    plain = versions.withColumn("email", F.concat_ws("-", "user_id", "id"))
    vault = V.encrypt_table(plain, ["email"], "r", all_keys, tk, F.lit(dt.datetime(2026, 1, 1))).checkpoint()
    value = {r.encrypted_value: r.value for r in V.decrypt_vault(vault, all_keys).collect()}
    number = spark.createDataFrame([(b, int(v.split("-")[1])) for b, v in value.items()], "encrypted_value string, n int")
    vault = vault.join(number, "encrypted_value").withColumn(
        "synced_at", F.timestamp_add("SECOND", F.col("n"), F.lit(dt.datetime(2026, 1, 1)))).withColumn(
        "encrypted_value", F.when((F.col("user_id") == "corrupt") & (F.col("n") >= 997), F.lit("v1:bm90:bm90"))
        .otherwise(F.col("encrypted_value"))).drop("n").checkpoint()
    first, older = V.rungs(vault, kv, ["email"])
    assert first.count() == 3 and {r.user_id: r["count"] for r in older.groupBy("user_id").count().collect()} == {"corrupt": 999}
    got = {r.user_id: r.email for r in V.decrypted_pivot(vault, kv, ["email"]).collect()}
    assert got == {"many": "many-999", "corrupt": "corrupt-996", "gone": None}
