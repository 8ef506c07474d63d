"""End-to-end erasure on a tiny scenario: two users in two tenants, one SaaS failure."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from shredline import schemas
from shredline.functions import crypto as C
from shredline.operators import connectors as CN
from shredline.operators import deletion as D
from shredline.operators import erasure as ER
from shredline.operators import keys as K
from shredline.operators import vault as V

T = dt.datetime(2026, 1, 1)


def test_erase_batch(spark):
    tk = spark.createDataFrame([("A",), ("B",)], "tenant_id string") \
        .withColumn("kek", F.unhex(F.sha2(F.concat(F.lit("kek-"), "tenant_id"), 256))) \
        .withColumn("token_key", F.unhex(F.sha2(F.concat(F.lit("tok-"), "tenant_id"), 256))) \
        .withColumn("sign_key", F.unhex(F.sha2(F.concat(F.lit("sign-"), "tenant_id"), 256)))
    users = spark.createDataFrame([("A", "alice", "alice@x"), ("A", "bob", "bob@x"), ("B", "alice", "alice@b")],
                                  "tenant_id string, user_id string, email string")
    reg = K.generate(K.empty_registry(spark), users, tk, F.lit(T), dek_fn=C.seeded_dek).state.cache()
    kv = K.key_versions(reg, tk)
    vault = V.encrypt_table(users, ["email"], "r", kv, tk, F.lit(T)).cache()
    vault.count()
    events = spark.createDataFrame([("e1", "A", "alice", "api", "hubspot", T, "{}", None, None),
                                    ("e2", "A", "bob", "api", "salesforce", T, "{}", None, None),
                                    ("e3", "B", "alice", "api", "hubspot", T, "{}", None, None)], schemas.LINEAGE_EVENTS)
    requests = D.conform(spark.createDataFrame(
        [("req-a", "A", "alice", "SHRED_REQUESTED", T, "dpo@x"), ("req-b", "A", "bob", "SHRED_REQUESTED", T, "dpo@x")],
        "deletion_request_id string, tenant_id string, user_id string, status string, created_at timestamp, "
        "requested_by string"))
    resources = spark.createDataFrame([], "tenant_id string, resource_id string, strategy string")
    hub = CN.TableConnector("hubspot", {}, {"status": "SUCCEEDED", "records_found": 1})
    sf = CN.TableConnector("salesforce", {("A", "bob"): {"status": "FAILED", "error": "HTTP 500"}})
    run = ER.erase(requests, reg, events, resources, [hub, sf], tk, F.lit(T))

    st = {r.deletion_request_id: r.status for r in run.requests.collect()}
    assert st == {"req-a": "CERTIFICATE_ISSUED", "req-b": "CASCADE_PARTIAL_FAILURE"}
    certs = run.certificates.collect()
    assert [c.deletion_request_id for c in certs] == ["req-a"] and certs[0].sequence == 1
    assert hashlib.sha256(certs[0].certificate.encode()).hexdigest() == certs[0].certificate_hash
    assert [r.destination for r in run.dead_letters.collect()] == ["salesforce"]
    ev = run.events.select(F.get_json_object("context", "$.event_type").alias("t")).groupBy("t").count().collect()
    assert {r.t: r["count"] for r in ev} == {"SaaS_WIPE_STARTED": 4, "SaaS_WIPE_COMPLETED": 2}
    # keys: tenant A users shredded, tenant B alice untouched -> her data still decrypts
    piv = {(r.tenant_id, r.user_id): r.email for r in V.decrypted_pivot(vault, K.key_versions(run.key_registry, tk),
                                                                           ["email"]).collect()}
    assert piv == {("A", "alice"): None, ("A", "bob"): None, ("B", "alice"): "alice@b"}

    # the failed request is taken up again; what is done stays as it is
    sf.answers.clear()
    second = ER.erase(run.requests, run.key_registry, events, resources, [hub, sf], tk, F.lit(T), run.heads, run.wipes)
    st = {r.deletion_request_id: r.status for r in second.requests.collect()}
    assert st == {"req-a": "CERTIFICATE_ISSUED", "req-b": "CERTIFICATE_ISSUED"}
    again = second.certificates.collect()
    assert [(c.deletion_request_id, c.sequence, c.previous_hash) for c in again] == [("req-b", 2, certs[0].certificate_hash)]
