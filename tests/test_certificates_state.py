import datetime as dt
import glob
import hashlib
import os

from pyspark.sql import functions as F

from shredline.operators import certificates as CERT
from shredline.operators import keys as K
from shredline.sources import sinks, state

T = dt.datetime(2026, 1, 1)


def _claims(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, deletion_request_id string, user_id string, created_at timestamp, "
                                       "claims_json string")


def _keys(spark, tenants):
    return spark.createDataFrame([(t, hashlib.sha256(f"sign-{t}".encode()).digest()) for t in tenants],
                                 "tenant_id string, sign_key binary")


def test_chain_links_and_tenants_are_independent(spark):
    c = _claims(spark, [("A", "r1", "u1", T, '{"a":1}'), ("A", "r2", "u2", T + dt.timedelta(1), '{"a":2}'),
                        ("B", "r3", "u3", T, '{"b":1}')])
    chain = {r.deletion_request_id: r for r in CERT.append_chain(c, _keys(spark, ["A", "B"])).collect()}
    assert chain["r1"].sequence == 1 and chain["r1"].previous_hash is None
    assert chain["r2"].sequence == 2 and chain["r2"].previous_hash == chain["r1"].certificate_hash
    assert chain["r3"].sequence == 1 and chain["r3"].previous_hash is None
    for r in chain.values():
        assert hashlib.sha256(r.certificate.encode()).hexdigest() == r.certificate_hash
        assert r.certificate.count(".") == 2


def test_chain_continues_from_stored_head_and_verify_detects_tampering(spark):
    keys = _keys(spark, ["A"])
    first = CERT.append_chain(_claims(spark, [("A", "r1", "u1", T, '{"a":1}')]), keys).cache()
    heads = CERT.chain_heads(first)
    second = CERT.append_chain(_claims(spark, [("A", "r2", "u2", T, '{"a":2}')]), keys, heads).cache()
    r2 = second.collect()[0]
    assert r2.sequence == 2 and r2.previous_hash == first.collect()[0].certificate_hash
    both = first.unionByName(second)
    assert CERT.verify_chain(both).where("problem IS NOT NULL").count() == 0
    tampered = both.withColumn("certificate", F.when(F.col("sequence") == 2, F.concat("certificate", F.lit("x")))
                               .otherwise(F.col("certificate")))
    assert [r.problem for r in CERT.verify_chain(tampered).where("problem IS NOT NULL").collect()] == ["HASH_MISMATCH"]
    gap = both.where("sequence = 2")
    assert [r.problem for r in CERT.verify_chain(gap).where("problem IS NOT NULL").collect()] == ["MISSING_PREDECESSOR"]


def test_wipe_labels(spark):
    w = spark.createDataFrame([("r", "a", "SUCCEEDED", 0, None, T), ("r", "b", "SUCCEEDED", 3, None, T),
                               ("r", "c", "SUCCEEDED", 5, 0, T), ("r", "d", "FAILED", 1, None, T)],
                              "deletion_request_id string, destination string, status string, records_found long, "
                              "rows_affected long, updated_at timestamp")
    s = CERT.lineage_summary(w).collect()[0]
    assert s.destinations_checked == 4 and s.destinations_succeeded == 3
    labels = {x.system: x.status == "CONFIRMED_ABSENT" for x in s._items}
    assert labels == {"a": True, "b": False, "c": True}


def test_certificate_sink_roundtrip(spark, tmp_dir):
    chain = CERT.append_chain(_claims(spark, [("A", "r1", "u1", T, '{"a":1}')]), _keys(spark, ["A"]))
    rows = CERT.certificate_rows(chain, F.to_timestamp(F.lit("2026-03-04 00:00:00"))).cache()
    sinks.store_certificates(rows, f"{tmp_dir}/certs")
    back = sinks.read_certificates(spark, f"{tmp_dir}/certs").collect()[0]
    orig = rows.collect()[0]
    assert back.certificate == orig.certificate and back.path == "certificates/A/2026/03/04/certificate-r1.json"
    assert os.path.isdir(f"{tmp_dir}/certs/tenant_id=A/issue_date=2026-03-04")


def test_shred_purges_old_key_versions_from_storage(spark, tmp_dir):
    tk = spark.createDataFrame([("A",)], "tenant_id string").withColumn("kek", F.unhex(F.sha2(F.lit("k"), 256)))
    users = spark.createDataFrame([("A", "u1"), ("A", "u2")], "tenant_id string, user_id string")
    root = f"{tmp_dir}/key_registry"
    state.write_version(K.generate(K.empty_registry(spark), users, tk, F.lit(T)).state, root)
    reg = state.read_current(spark, root)
    wrapped = [bytes(r.deks["v1"]) for r in reg.where("user_id = 'u1'").collect()][0]
    state.write_version(K.shred(reg, users.where("user_id = 'u1'"), F.lit(T)).state, root)
    assert state.versions(spark, root) == [2] and state.current_version(spark, root) == 2
    blobs = b"".join(open(f, "rb").read() for f in glob.glob(f"{root}/**/*", recursive=True) if os.path.isfile(f))
    assert wrapped not in blobs
    cur = {r.user_id: r.status for r in state.read_current(spark, root).collect()}
    assert cur == {"u1": "SHREDDED", "u2": "ACTIVE"}


def test_failed_write_keeps_the_current_version(spark, tmp_dir):
    root = f"{tmp_dir}/table"
    state.write_version(spark.range(3).toDF("x"), root)
    bad = spark.range(3).toDF("x").select(F.when(F.col("x") == 2, F.raise_error(F.lit("boom"))).otherwise(F.col("x"))
                                          .alias("x"))
    try:
        state.write_version(bad, root)
        raise AssertionError("the failing write should raise")
    except Exception as exc:  # noqa: BLE001
        assert "boom" in str(exc)
    assert state.current_version(spark, root) == 1 and state.read_current(spark, root).count() == 3
    n = state.write_version(spark.range(5).toDF("x"), root)      # the next write still goes through
    assert state.current_version(spark, root) == n and state.read_current(spark, root).count() == 5
    assert state.versions(spark, root) == [n]


def test_a_failed_first_write_is_never_current(spark, tmp_dir):
    root = f"{tmp_dir}/first"
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("x"))
    try:
        state.write_version(bad, root)
        raise AssertionError("the failing write should raise")
    except Exception as exc:  # noqa: BLE001
        assert "boom" in str(exc)
    assert state.current_version(spark, root) is None and state.read_current(spark, root) is None


def test_erasing_touches_only_the_partitions_hit(spark, tmp_dir):
    from shredline.operators import redaction as R

    rows = spark.range(40).selectExpr("'t' AS tenant_id", "concat('u', id) AS user_id", "concat('mail', id) AS email",
                                      "cast(id div 10 AS int) AS bucket")
    for name, fields in (("redact", ["email"]), ("delete", None)):
        path = f"{tmp_dir}/{name}"
        rows.repartition(1).write.partitionBy("bucket").parquet(path)
        files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}
        before = files()
        users = spark.createDataFrame([("t", "u3"), ("t", "u31"), ("x", "u12")], "tenant_id string, user_id string")
        assert R.erase_stored(spark, path, "bucket", users, "user_id", "tenant_id", fields) == 2
        after = files()
        kept = {f for f in before if after.get(f) == before[f]}
        assert {f.split("bucket=")[1][0] for f in kept} == {"1", "2"}
        blobs = b"".join(open(f, "rb").read() for f in after)
        back = spark.read.parquet(path)
        assert back.count() == (40 if fields else 38) and back.where("email is null").count() == (2 if fields else 0)
        assert b"mail31" not in blobs
    whole = spark.createDataFrame([("t", f"u{i}") for i in range(10, 20)], "tenant_id string, user_id string")
    assert R.erase_stored(spark, f"{tmp_dir}/delete", "bucket", whole, "user_id", "tenant_id") == 10
    assert not os.path.exists(f"{tmp_dir}/delete/bucket=1") and R.erase_stored(
        spark, f"{tmp_dir}/delete", "bucket", whole, "user_id", "tenant_id") == 0


def test_erasing_finds_null_and_escaped_partitions(spark, tmp_dir):
    from shredline.operators import redaction as R

    parts = [None, "a:b/c d", "plain"]
    rows = spark.createDataFrame([("t", f"u{i}", f"mail{i}", parts[i % 3]) for i in range(9)],
                                 "tenant_id string, user_id string, email string, part string")
    blobs = lambda path: b"".join(open(f, "rb").read() for f in glob.glob(f"{path}/part=*/*.parquet"))
    for name, fields, asked in (("redact", ["email"], [0, 1]), ("delete", None, [0, 1]), ("whole", None, [0, 3, 6, 1, 4, 7])):
        path = f"{tmp_dir}/{name}"
        rows.repartition(1).write.partitionBy("part").parquet(path)
        users = spark.createDataFrame([("t", f"u{i}") for i in asked], "tenant_id string, user_id string")
        assert R.erase_stored(spark, path, "part", users, "user_id", "tenant_id", fields) == len(asked)
        back = {r.user_id: r.email for r in spark.read.parquet(path).collect()}
        assert {u for u in back if back[u]} == {f"u{i}" for i in range(9) if i not in asked}
        assert len(back) == (9 if fields else 9 - len(asked)) and not any(f"mail{i}".encode() in blobs(path) for i in asked)


def test_stored_registry_rewrites_hit_buckets_only(spark, tmp_dir):
    """File names and bytes: the erased keys' bytes are in no file, the other buckets keep theirs; rotate and generate alike."""
    tk = spark.createDataFrame([("A",)], "tenant_id string").withColumns(
        {"kek": F.unhex(F.sha2(F.lit("k"), 256)), "token_key": F.unhex(F.sha2(F.lit("t"), 256))})
    users = spark.createDataFrame([("A", f"u{i}") for i in range(60)], "tenant_id string, user_id string")
    store = K.StoredRegistry(f"{tmp_dir}/keys", 16)
    store.create(K.generate(K.empty_registry(spark), users, tk, F.lit(T)).state)
    wrapped = {r.user_id: bytes(r.deks["v1"]) for r in store.read(spark).collect()}
    state = lambda: {f: (os.stat(f).st_mtime_ns, os.path.getsize(f)) for f in glob.glob(f"{store.path}/bucket=*/*.parquet")}
    bucket = {r.user_id: r.b for r in users.select("user_id", F.pmod(F.xxhash64("tenant_id", "user_id"), F.lit(16)).alias("b")).collect()}
    due = ["u3", "u17"]
    before = state()
    outcome = store.shred(users.where(F.col("user_id").isin(due)), F.lit(T))
    assert sorted(r.user_id for r in outcome.collect()) == sorted(due)
    hit = {str(bucket[u]) for u in due}
    changed = {f.split("bucket=")[1].split("/")[0] for f in set(before) ^ set(state())}
    assert changed == hit and all(state()[f] == before[f] for f in before if f.split("bucket=")[1].split("/")[0] not in hit)
    blobs = b"".join(open(f, "rb").read() for f in state())
    after = {r.user_id: r for r in store.read(spark).collect()}
    assert len(after) == 60 and {u for u, r in after.items() if r.status == "SHREDDED"} == set(due)
    assert all((bytes(r.deks["v1"]) == wrapped[u]) for u, r in after.items() if u not in due)
    assert not any(wrapped[u] in blobs for u in due)
    assert {r.outcome for r in store.rotate(users.where("user_id in ('u1', 'u3')"), tk, F.lit(T)).collect()} == {"ROTATED", "ERROR"}
    assert {(r.user_id, r.outcome) for r in store.generate(users.where("user_id in ('u1', 'u3')"), tk, F.lit(T)).collect()} == {
        ("u1", "EXISTS"), ("u3", "GENERATED")}
    assert sorted(r.active_dek_id for r in store.read(spark).where("user_id in ('u1', 'u3')").collect()) == ["v1", "v2"]
    assert store.shred(users.limit(0), F.lit(T)).count() == 0 and store.read(spark).count() == 60
