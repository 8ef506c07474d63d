"""Queries over keys, vault and crypto columns (QRY-01..04, QRY-12/13, STA-01..04, FIL-10..14, FN-01..11, EXT-06)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shredline.functions import crypto as C
from shredline.functions.sql import register_functions
from shredline.operators import column_crypto as CC
from shredline.operators import keys as K
from shredline.operators import redaction as R
from shredline.operators import vault as V
from shredline.operators import views as VW
from shredline.operators.util import iso, join_sorted
from shredline.plans import scenario as SC
from shredline.plans.catalog import register
from shredline.plans.oracle import duck_hmac, duck_iso, with_fixtures
from shredline.session import ensure_checkpoint_dir
from shredline.sources import fixtures as FX

LIVE = "custkey % 7 <> 0"
# Customers whose newest vault row is undecryptable.
JUNK = "custkey % 11 = 0"


def _key_requests(spark, sf_dir):
    """Users of the customer table plus users seen in lineage events (some unknown to the registry)."""
    users = FX.fixture(spark, sf_dir, "users").select("tenant_id", "user_id")
    ev = (FX.fixture(spark, sf_dir, "lineage_events").where(F.col("user_id") != "UNKNOWN")
          .select("tenant_id", "user_id"))
    return users.unionByName(ev).distinct()


KEY_REQUESTS_SQL = ("SELECT DISTINCT tenant_id, user_id FROM (SELECT tenant_id, user_id FROM users UNION ALL "
                    "SELECT tenant_id, user_id FROM lineage_events WHERE user_id <> 'UNKNOWN')")


# --- QRY-01 decrypted view -----------------------------------------------------------

def decrypted_view(spark, sf_dir):
    s = SC.build(spark, sf_dir)
    return V.decrypted_pivot(s.vault, s.key_versions(), SC.VAULT_FIELDS)


register("qry01_decrypted_view", with_fixtures(["users"], f"""
SELECT tenant_id, user_id,
       CASE WHEN {LIVE} THEN email END AS email,
       CASE WHEN {LIVE} THEN phone END AS phone
FROM users"""))(decrypted_view)


@register("qry01_decrypted_view_tenant", with_fixtures(["users"], f"""
SELECT tenant_id, user_id, CASE WHEN {LIVE} THEN email END AS email
FROM users WHERE tenant_id = 'tenant-1'"""))
def decrypted_view_tenant(spark, sf_dir):
    """QRY-01 scoped to one tenant and one field (tenant filter reaches the vault scan)."""
    s = SC.build(spark, sf_dir)
    return V.decrypted_pivot(s.vault, s.key_versions(), ["email"], tenant="tenant-1")


# --- WIN-03 latest ciphertext ------------------------------------------------------------

@register("win03_latest_ciphertext", with_fixtures(["users"], f"""
SELECT tenant_id, user_id, 'bigquery:proj.ds.users' AS resource_id, f.field_name,
       CASE WHEN {LIVE} AND NOT ({JUNK}) THEN CASE f.field_name WHEN 'email' THEN email ELSE phone END END AS value
FROM users, (VALUES ('email'), ('phone')) f(field_name)"""))
def latest_ciphertext(spark, sf_dir):
    s = SC.build(spark, sf_dir)
    return V.latest_ciphertext(s.vault, s.key_versions()).select(
        "tenant_id", "user_id", "resource_id", "field_name", "value")


# --- QRY-02 shadow copy ---------------------------------------------------------------------

@register("qry02_shadow_copy", with_fixtures(["users"], f"""
SELECT o_orderkey, concat('tenant-', o_custkey % 3) AS tenant_id, concat('user-', o_custkey) AS user_id,
       o_totalprice, CASE WHEN u.custkey IS NOT NULL AND u.{LIVE} THEN u.email END AS email
FROM orders o LEFT JOIN users u ON u.custkey = o.o_custkey"""))
def shadow_copy(spark, sf_dir):
    """Orders as a PII source (raw ``email`` column) → shadow copy with the vault's decrypted email."""
    s = SC.build(spark, sf_dir)
    src = (spark.read.parquet(f"{sf_dir}/orders.parquet")
           .select("o_orderkey",
                   F.concat(F.lit("tenant-"), F.col("o_custkey") % 3).alias("tenant_id"),
                   F.concat(F.lit("user-"), F.col("o_custkey")).alias("user_id"),
                   "o_totalprice",
                   F.concat(F.lit("raw-"), F.col("o_custkey"), F.lit("@example.com")).alias("email")))
    pivot = V.decrypted_pivot(s.vault, s.key_versions(), ["email"])
    return R.shadow_copy(src, ["email"], pivot, user_col="user_id", tenant_col="tenant_id")


# --- QRY-03 encrypted copy -------------------------------------------------------------------

@register("qry03_encrypted_copy", with_fixtures(["users"], f"""
SELECT tenant_id, user_id, segment, {duck_iso("TIMESTAMP '" + FX.SYNC_NEW_TS + "'")} AS synced_at, email
FROM users WHERE {LIVE}"""))
def encrypted_copy(spark, sf_dir):
    """SRC-17 raw table ← two syncs of encrypted users; STA-11 delete shredded users; WIN-02 dedup view."""
    s = SC.build(spark, sf_dir)
    kv1 = K.key_versions(s.registry_before_shred, s.tenant_keys)
    fields = ["email", "phone"]
    src = s.users.select("tenant_id", "user_id", "segment", "email", "phone")

    def sync(ts):
        j = src.join(kv1, ["tenant_id", "user_id"])
        dek = F.try_element_at("dek_map", F.col("active_dek_id"))
        return j.select("tenant_id", "user_id", "segment",
                        *[C.encrypt_random(F.col(f), F.col("user_id"), dek, F.col("active_dek_id")).alias(f)
                          for f in fields],
                        FX.ts(ts).alias("synced_at"))

    raw = R.widen(R.encrypted_copy_schema(src, fields), sync(FX.SYNC_OLD_TS).unionByName(sync(FX.SYNC_NEW_TS)))
    shredded = FX.shred_requests(s.users)
    raw = R.delete_users(raw, shredded, user_col="user_id", tenant_col="tenant_id").table
    view = R.encrypted_copy_view(raw, "user_id", "tenant_id")
    kv = s.key_versions()
    dec = view.join(kv.select("tenant_id", "user_id", "dek_map"), ["tenant_id", "user_id"], "left")
    dek = F.try_element_at("dek_map", C.bundle_key_id(F.col("email")))
    return dec.select("tenant_id", "user_id", "segment", iso("synced_at").alias("synced_at"),
                      C.decrypt_bundle(F.col("email"), F.col("user_id"), dek).alias("email"))


# --- FIL-13 / FIL-14 -----------------------------------------------------------------------------

@register("fil13_available_fields", with_fixtures(["users"], """
SELECT DISTINCT tenant_id, f.field_name FROM users, (VALUES ('email'), ('phone')) f(field_name)"""))
def available_fields(spark, sf_dir):
    return V.available_fields(SC.build(spark, sf_dir).vault)


@register("fil14_synced_tenants", with_fixtures(["users"], """
SELECT tenant_id FROM (SELECT DISTINCT tenant_id FROM users) WHERE tenant_id <> 'tenant-unsynced'"""))
def synced_tenants(spark, sf_dir):
    """What a tenant without synced fields is shown: all tenants that have some."""
    return V.synced_tenants(SC.build(spark, sf_dir).vault, "tenant-unsynced")


# --- QRY-04 ad-hoc decrypt --------------------------------------------------------------------------

@register("qry04_adhoc_decrypt", with_fixtures(["users", "lineage_events"], f"""
SELECT r.tenant_id, r.user_id, r.resource_id, r.field_name,
       CASE WHEN u.custkey IS NOT NULL AND u.{LIVE} AND NOT (u.{JUNK}) THEN u.phone END AS plaintext,
       (u.custkey IS NOT NULL AND u.{LIVE} AND NOT (u.{JUNK})) AS found
FROM (SELECT DISTINCT tenant_id, user_id, 'bigquery:proj.ds.users' AS resource_id, 'phone' AS field_name
      FROM lineage_events WHERE user_id <> 'UNKNOWN') r
LEFT JOIN users u ON u.user_id = r.user_id AND u.tenant_id = r.tenant_id"""))
def adhoc_decrypt(spark, sf_dir):
    """Every user seen in lineage asks for their phone field."""
    s = SC.build(spark, sf_dir)
    req = (FX.fixture(spark, sf_dir, "lineage_events").where(F.col("user_id") != "UNKNOWN")
           .select("tenant_id", "user_id", F.lit(SC.VAULT_RESOURCE).alias("resource_id"),
                   F.lit("phone").alias("field_name")))
    out, _audit = V.adhoc_decrypt(req, s.vault, s.key_versions())
    return out


# --- STA-01 / STA-02 / STA-03 / FIL-11 / FIL-12 -------------------------------------------------------

@register("sta01_generate_keys", with_fixtures(["users", "lineage_events"], f"""
SELECT q.tenant_id, q.user_id,
       CASE WHEN u.custkey IS NOT NULL AND u.{LIVE} THEN 'EXISTS' ELSE 'GENERATED' END AS outcome,
       (u.custkey IS NOT NULL AND NOT (u.{LIVE})) AS regenerated, CAST(NULL AS VARCHAR) AS error
FROM ({KEY_REQUESTS_SQL}) q LEFT JOIN users u ON u.user_id = q.user_id AND u.tenant_id = q.tenant_id
UNION ALL
SELECT 'keyless-' || tenant_id, user_id, 'ERROR', false, 'Tenant has no wrapping key' FROM users WHERE custkey % 9 = 0"""))
def generate_keys(spark, sf_dir):
    """Key generation over the post-shred registry: shredded users get a fresh key, tenants without a key an error."""
    s = SC.build(spark, sf_dir)
    keyless = s.users.where("custkey % 9 = 0").select(F.concat(F.lit("keyless-"), "tenant_id").alias("tenant_id"), "user_id")
    requests = _key_requests(spark, sf_dir).select("tenant_id", "user_id").unionByName(keyless)
    return K.generate(s.registry, requests, s.tenant_keys, FX.ts(FX.NOW_TS), dek_fn=SC.seeded).outcome


@register("sta02_rotate_keys", with_fixtures(["users"], f"""
SELECT tenant_id, user_id,
       CASE WHEN {LIVE} THEN 'ROTATED' ELSE 'ERROR' END AS outcome,
       CASE WHEN {LIVE} THEN 'v2' END AS new_version,
       CASE WHEN NOT ({LIVE}) THEN 'Cannot rotate a shredded key' END AS error,
       CASE WHEN {LIVE} THEN 'v1,v2' ELSE '' END AS versions
FROM users WHERE custkey % 5 = 0"""))
def rotate_keys(spark, sf_dir):
    """Every 5th customer rotates (shredded ones get an error row); with the versions that unwrap afterwards."""
    s = SC.build(spark, sf_dir)
    req = s.users.where(F.col("custkey") % 5 == 0)
    change = K.rotate(s.registry, req, s.tenant_keys, FX.ts(FX.NOW_TS), dek_fn=SC.seeded)
    after = K.key_versions(change.state, s.tenant_keys)
    held = F.filter(F.map_keys("dek_map"), lambda k: F.try_element_at("dek_map", k).isNotNull())
    return (change.outcome.join(after.select("tenant_id", "user_id", join_sorted(held).alias("versions")),
                                ["tenant_id", "user_id"], "left")
            .withColumn("versions", F.coalesce("versions", F.lit(""))))


_DUE = "custkey % 32 IN (3, 17) AND custkey % 2 = 1 AND custkey % 3 = 0"


@register("sta03_shred_stored", with_fixtures(["users"], f"""
SELECT 'key' AS kind, tenant_id || '/' || user_id AS key, CASE WHEN {_DUE} THEN 'SHREDDED 0' ELSE 'ACTIVE 1' END AS value FROM users
UNION ALL SELECT 'key', 'tenant-0/never-keyed-3', 'SHREDDED 0'
UNION ALL SELECT 'bucket', CAST(custkey % 32 AS VARCHAR), CASE WHEN bool_or({_DUE}) OR custkey % 32 = 3 THEN 'rewritten' ELSE 'same files' END
FROM users GROUP BY custkey % 32
UNION ALL SELECT 'outcome', tenant_id || '/' || user_id, 'SHREDDED' FROM users WHERE {_DUE}
UNION ALL SELECT 'outcome', 'tenant-0/never-keyed-3', 'SHREDDED'"""))
def shred_stored(spark, sf_dir):
    """Keys erased in a stored registry of 32 buckets: only the buckets of the requested users get new files.

    Rows: every key's state and number of versions as stored in the end, every bucket, every request's outcome.
    """
    users = FX.fixture(spark, sf_dir, "users")
    tenant_keys = FX.tenant_keys(users)
    store = K.StoredRegistry(f"{ensure_checkpoint_dir(spark)}/keys-{uuid.uuid4().hex}", 32,
                             F.element_at(F.split("user_id", "-"), -1).cast("int") % 32)
    store.create(K.generate(K.empty_registry(spark), users, tenant_keys, FX.ts(FX.KEYGEN_TS), dek_fn=SC.seeded).state)

    def files():
        return (spark.read.parquet(store.path).select("bucket", F.input_file_name().alias("file")).distinct()
                .groupBy("bucket").agg(F.array_sort(F.collect_set("file")).alias("files")).checkpoint())

    before = files()
    due = users.where(_DUE).select("tenant_id", "user_id").unionByName(
        users.limit(1).select(F.lit("tenant-0").alias("tenant_id"), F.lit("never-keyed-3").alias("user_id")))
    outcome = store.shred(due, FX.ts(FX.SHRED_TS))
    name = F.concat_ws("/", "tenant_id", "user_id").alias("key")
    keys = store.read(spark).select(F.lit("key").alias("kind"), name, F.concat_ws(
        " ", "status", F.size("deks").cast("string")).alias("value"))
    buckets = before.alias("a").join(files().alias("b"), "bucket").select(
        F.lit("bucket").alias("kind"), F.col("bucket").cast("string").alias("key"),
        F.when(F.col("a.files") == F.col("b.files"), "same files").otherwise("rewritten").alias("value"))
    return keys.unionByName(buckets).unionByName(outcome.select(F.lit("outcome").alias("kind"), name, F.col("outcome").alias("value")))


@register("fil11_key_status", with_fixtures(["users"], f"""
SELECT tenant_id, user_id,
       CASE WHEN {LIVE} THEN 'ACTIVE' ELSE 'SHREDDED' END AS status,
       CASE WHEN {LIVE} THEN 'v1' END AS active_dek_id,
       'v2' AS encryption_version,
       CASE WHEN {LIVE} THEN 1 ELSE 0 END AS key_versions,
       {duck_iso("TIMESTAMP '" + FX.KEYGEN_TS + "'")} AS created_at,
       CASE WHEN NOT ({LIVE}) THEN {duck_iso("TIMESTAMP '" + FX.SHRED_TS + "'")} END AS shred_at,
       CAST(NULL AS VARCHAR) AS rotated_at, '' AS destinations
FROM users"""))
def key_status(spark, sf_dir):
    s = SC.build(spark, sf_dir)
    st = K.key_status(s.registry)
    return st.select("tenant_id", "user_id", "status", "active_dek_id", "encryption_version",
                     F.col("key_versions").cast("int").alias("key_versions"), "created_at", "shred_at",
                     "rotated_at", join_sorted("destinations").alias("destinations"))


@register("fil12_encryption_contexts", with_fixtures(["users", "lineage_events"], f"""
SELECT q.tenant_id, q.user_id,
       CASE WHEN u.custkey IS NOT NULL AND u.{LIVE} THEN 200 ELSE 404 END AS status_code,
       CASE WHEN u.custkey IS NOT NULL AND u.{LIVE} THEN 'v1' END AS key_id,
       CASE WHEN u.custkey IS NOT NULL AND u.{LIVE} THEN 'AES-256-GCM' END AS algorithm,
       CASE WHEN u.custkey IS NOT NULL AND u.{LIVE} THEN 60 END AS wrapped_dek_len
FROM ({KEY_REQUESTS_SQL}) q LEFT JOIN users u ON u.user_id = q.user_id AND u.tenant_id = q.tenant_id"""))
def encryption_contexts(spark, sf_dir):
    """Wrapped DEK = base64(12-byte IV + 32-byte key + 16-byte tag) = 80 chars; compared by decoded length."""
    s = SC.build(spark, sf_dir)
    ctx = K.encryption_contexts(s.registry, _key_requests(spark, sf_dir))
    return ctx.select("tenant_id", "user_id", "status_code", "key_id", "algorithm",
                      F.length(C.unb64(F.col("wrapped_dek"))).alias("wrapped_dek_len"))


# --- EXT-06 re-encryption after rotation ---------------------------------------------------------------

@register("ext06_reencrypt", with_fixtures(["users"], f"""
SELECT tenant_id, user_id, f.field_name,
       CASE WHEN {JUNK} THEN 'v1' WHEN custkey % 5 = 0 AND {LIVE} THEN 'v2' ELSE 'v1' END AS key_id,
       CASE WHEN {LIVE} AND NOT ({JUNK}) THEN CASE f.field_name WHEN 'email' THEN email ELSE phone END END AS value
FROM users, (VALUES ('email'), ('phone')) f(field_name)"""))
def reencrypt(spark, sf_dir):
    """Rotate every 5th customer, move all their values to the new version, read the latest back."""
    s = SC.build(spark, sf_dir)
    rotated = K.rotate(s.registry, s.users.where(F.col("custkey") % 5 == 0), s.tenant_keys,
                       FX.ts(FX.NOW_TS), dek_fn=lambda u: C.seeded_dek(u, "rotated-")).state
    kv = K.key_versions(rotated, s.tenant_keys)
    moved = V.reencrypt(s.vault, kv)
    latest = V.latest_ciphertext(moved, kv)
    return latest.select("tenant_id", "user_id", "field_name",
                         C.bundle_key_id(F.col("encrypted_value")).alias("key_id"), "value")


# --- FN-10 tokens ---------------------------------------------------------------------------------------

@register("fn10_tokens", with_fixtures(["users"], f"""
SELECT tenant_id, user_id, f.field_name,
       {duck_hmac("unhex(sha256('token-' || tenant_id))", "CASE f.field_name WHEN 'email' THEN email ELSE phone END")} AS token
FROM users, (VALUES ('email'), ('phone')) f(field_name)"""))
def tokens(spark, sf_dir):
    """Tokens of the current vault copy (HMAC-SHA256 under the tenant token key)."""
    s = SC.build(spark, sf_dir)
    return (s.vault.where(F.col("synced_at") == FX.ts(FX.SYNC_NEW_TS))
            .select("tenant_id", "user_id", "field_name", "token"))


# --- QRY-12 / QRY-13 deterministic column crypto ---------------------------------------------------------

def _det_input(spark, sf_dir):
    users = FX.fixture(spark, sf_dir, "users").select("tenant_id", "user_id", F.col("email").alias("plaintext"))
    ev = (FX.fixture(spark, sf_dir, "lineage_events").where(F.col("user_id") != "UNKNOWN")
          .select("tenant_id", "user_id", F.concat(F.lit("note-"), F.col("event_id")).alias("plaintext")))
    return users.unionByName(ev)


@register("qry12_encrypt_deterministic", with_fixtures(["users", "lineage_events"], f"""
SELECT q.tenant_id, q.user_id, length(q.plaintext) AS plaintext_length,
       CASE WHEN u.custkey IS NOT NULL AND u.{LIVE} THEN 200 ELSE 404 END AS status_code,
       CASE WHEN u.custkey IS NOT NULL AND u.{LIVE}
            THEN 3 + CAST(4 * ceil((octet_length(encode(q.plaintext)) + 16) / 3.0) AS BIGINT) END AS ciphertext_length
FROM (SELECT tenant_id, user_id, email AS plaintext FROM users UNION ALL
      SELECT tenant_id, user_id, 'note-' || event_id FROM lineage_events WHERE user_id <> 'UNKNOWN') q
LEFT JOIN users u ON u.user_id = q.user_id AND u.tenant_id = q.tenant_id"""))
def encrypt_deterministic(spark, sf_dir):
    """Audit-shaped output: lengths only, no plaintext (the bundle itself is checked by QRY-13)."""
    s = SC.build(spark, sf_dir)
    out = CC.encrypt_column(s.registry, s.tenant_keys, _det_input(spark, sf_dir)).rows
    return out.select("tenant_id", "user_id", F.length("plaintext").cast("bigint").alias("plaintext_length"), "status_code",
                      F.length("ciphertext").cast("bigint").alias("ciphertext_length"))


@register("qry13_decrypt_deterministic", with_fixtures(["users"], f"""
SELECT tenant_id, user_id,
       CASE WHEN NOT ({LIVE}) THEN 404 WHEN custkey % 13 = 0 THEN 400 ELSE 200 END AS status_code,
       CASE WHEN {LIVE} AND custkey % 13 <> 0 THEN email END AS plaintext
FROM users"""))
def decrypt_deterministic(spark, sf_dir):
    """Encrypt with the pre-shred keys, tamper every 13th bundle, decrypt with the current registry."""
    s = SC.build(spark, sf_dir)
    rows = s.users.select("tenant_id", "user_id", F.col("email").alias("plaintext"), "custkey")
    enc = CC.encrypt_column(s.registry_before_shred, s.tenant_keys, rows.drop("custkey")).rows
    enc = enc.join(rows.select("tenant_id", "user_id", "custkey"), ["tenant_id", "user_id"])
    # Change the first ciphertext character after "v1:": the tag no longer verifies.
    c = F.col("ciphertext")
    flipped = F.concat(F.substring(c, 1, 3), F.when(F.substring(c, 4, 1) == "A", "B").otherwise("A"),
                       F.substr(c, F.lit(5)))
    tampered = F.when(F.col("custkey") % 13 == 0, flipped).otherwise(c)
    return CC.decrypt_column(s.registry, s.tenant_keys, enc.select("tenant_id", "user_id", tampered.alias("bundle"))).rows


# --- QRY-12 / QRY-13 / QRY-04 audit events, VAL-02 -------------------------------------------------------------

@register("qry12_column_audit", with_fixtures(["users"], f"""
SELECT tenant_id, user_id, destination, context FROM (
SELECT tenant_id, user_id, 'encryption-audit' AS destination, '{{"event_type":"ENCRYPTION_PERFORMED","operation":"ENCRYPT","plaintextLength":'
  || length(email) || ',"analystEmail":' || CASE WHEN custkey % 4 = 0 THEN 'null' ELSE '"analyst-' || custkey % 4 || '@example.com"' END || '}}' AS context, custkey
FROM users UNION ALL
SELECT tenant_id, user_id, 'decryption-audit', '{{"event_type":"DECRYPTION_PERFORMED","operation":"DECRYPT","analystEmail":'
  || CASE WHEN custkey % 4 = 0 THEN 'null' ELSE '"analyst-' || custkey % 4 || '@example.com"' END || '}}', custkey FROM users)
WHERE {LIVE} AND NOT (destination = 'encryption-audit' AND custkey % 5 = 0)"""))
def column_audit(spark, sf_dir):
    """One event for every value encrypted or decrypted, by whom, with lengths at most; none for rejected and keyless rows."""
    s = SC.build(spark, sf_dir)
    who = F.when(F.col("custkey") % 4 != 0, F.concat(F.lit("analyst-"), F.col("custkey") % 4, F.lit("@example.com"))).alias("analyst_email")
    rows = s.users.select("tenant_id", "user_id", F.when(F.col("custkey") % 5 == 0, F.lit("")).otherwise(F.col("email")).alias("plaintext"), who)
    one = CC.encrypt_column(s.registry, s.tenant_keys, rows, FX.ts(FX.NOW_TS))
    back = CC.encrypt_column(s.registry_before_shred, s.tenant_keys, rows.withColumn("plaintext", F.lit("x"))).rows
    two = CC.decrypt_column(s.registry, s.tenant_keys, back.select("tenant_id", "user_id", F.col("ciphertext").alias("bundle"), "analyst_email"))
    return one.audit.unionByName(two.audit).select("tenant_id", "user_id", "destination", "context")


@register("val02_encrypt_rejects", with_fixtures(["users"], f"""
SELECT tenant_id, uid AS user_id, kind, CASE WHEN kind = 'good' THEN CASE WHEN {LIVE} THEN 200 ELSE 404 END ELSE 400 END AS status_code,
  CASE kind WHEN 'empty' THEN 'Plaintext cannot be empty' WHEN 'long' THEN 'Plaintext must not exceed 10KB'
    WHEN 'none' THEN 'plaintext is required'
    WHEN 'user' THEN 'userId must contain only alphanumeric characters, hyphens, and underscores; plaintext is required'
    WHEN 'wide' THEN 'userId must not exceed 64 characters'
    ELSE CASE WHEN NOT ({LIVE}) THEN 'Key not found or shredded' END END AS error
FROM (SELECT *, ['good', 'empty', 'long', 'none', 'user', 'wide', 'edge'][custkey % 7 + 1] AS k FROM users),
LATERAL (SELECT CASE k WHEN 'edge' THEN 'good' ELSE k END AS kind,
  CASE k WHEN 'user' THEN user_id || ' ?' WHEN 'wide' THEN user_id || repeat('x', 64) ELSE user_id END AS uid)"""))
def encrypt_rejects(spark, sf_dir):
    """Values that must not be encrypted, every rule of theirs named; a value of exactly 10 KB still is."""
    s = SC.build(spark, sf_dir)
    k = F.element_at(F.array(*[F.lit(x) for x in ("good", "empty", "long", "none", "user", "wide", "edge")]), (F.col("custkey") % 7 + 1).cast("int"))
    rows = s.users.select(
        "tenant_id", F.when(k == "user", F.concat("user_id", F.lit(" ?"))).when(k == "wide", F.concat("user_id", F.repeat(F.lit("x"), 64)))
        .otherwise(F.col("user_id")).alias("user_id"),
        F.when(k == "empty", "").when(k == "long", F.repeat(F.lit("y"), 10241)).when(k == "edge", F.repeat(F.lit("y"), 10240))
        .when(~k.isin("none", "user"), F.col("email")).alias("plaintext"), F.when(k == "edge", "good").otherwise(k).alias("kind"))
    out = CC.encrypt_column(s.registry, s.tenant_keys, rows).rows
    return out.select("tenant_id", "user_id", "kind", "status_code", "error")


@register("qry04_adhoc_audit", with_fixtures(["users", "lineage_events"], f"""
SELECT r.tenant_id, r.user_id, 'pii-vault' AS source, 'bigquery:proj.ds.users' AS destination,
  '{{"event_type":"PII_VAULT_DECRYPT","resource_id":"bigquery:proj.ds.users","field_name":"phone","found":'
  || CASE WHEN u.custkey IS NOT NULL AND u.{LIVE} AND NOT (u.{JUNK}) THEN 'true' ELSE 'false' END || '}}' AS context
FROM (SELECT DISTINCT tenant_id, user_id FROM lineage_events WHERE user_id <> 'UNKNOWN') r
LEFT JOIN users u ON u.user_id = r.user_id AND u.tenant_id = r.tenant_id"""))
def adhoc_audit(spark, sf_dir):
    """The audit event of every ad-hoc request, found or not, without a value."""
    s = SC.build(spark, sf_dir)
    req = (FX.fixture(spark, sf_dir, "lineage_events").where(F.col("user_id") != "UNKNOWN")
           .select("tenant_id", "user_id", F.lit(SC.VAULT_RESOURCE).alias("resource_id"), F.lit("phone").alias("field_name")))
    return V.adhoc_decrypt(req, s.vault, s.key_versions())[1].select("tenant_id", "user_id", "source", "destination", "context")


# --- FN-08 random keys, AGG-13 contexts, SRC-18 views -----------------------------------------------------------

@register("fn08_random_keys", with_fixtures(["users"], """
SELECT tenant_id, count(*) AS n_users, count(*) AS n_keys, count(*) AS n_of_32_bytes, count(*) AS n_read_back FROM users GROUP BY tenant_id"""))
def random_keys(spark, sf_dir):
    """Keys from the system's random source, stored before use: all different, 32 bytes, and they decrypt what they encrypted."""
    users = FX.fixture(spark, sf_dir, "users")
    tk = FX.tenant_keys(users)
    store = K.StoredRegistry(f"{ensure_checkpoint_dir(spark)}/random-{uuid.uuid4().hex}", 8)
    store.create(K.generate(K.empty_registry(spark), users, tk, FX.ts(FX.KEYGEN_TS)).state)
    kv = K.key_versions(store.read(spark), tk)
    dek = F.try_element_at("dek_map", F.col("active_dek_id"))
    rows = users.join(kv, ["tenant_id", "user_id"], "left").select(
        "tenant_id", dek.alias("dek"), C.decrypt_bundle(C.encrypt_random(F.col("email"), F.col("user_id"), dek, F.col("active_dek_id")),
                                                        F.col("user_id"), dek).alias("back"), "email")
    return rows.groupBy("tenant_id").agg(
        F.count("*").alias("n_users"), F.count_distinct("dek").alias("n_keys"), F.count_if(F.length("dek") == 32).alias("n_of_32_bytes"),
        F.count_if(F.col("back") == F.col("email")).alias("n_read_back"))


@register("agg13_contexts_by_user", with_fixtures(["users"], f"""
SELECT tenant_id, user_id, 'v1' AS key_id, 'AES-256-GCM' AS algorithm FROM users WHERE {LIVE}"""))
def contexts_by_user(spark, sf_dir):
    """The maps from user id to encryption context, read through their keys."""
    s = SC.build(spark, sf_dir)
    maps = K.contexts_by_user(K.encryption_contexts(s.registry, s.users), 16)
    one = maps.select("tenant_id", F.explode("contexts").alias("user_id", "c"))
    return one.select("tenant_id", "user_id", "c.key_id", "c.algorithm")


@register("src18_named_views", with_fixtures(["users"], f"""
SELECT 'decrypted' AS view_kind, tenant_id, user_id, CASE WHEN {LIVE} THEN email END AS email FROM users
UNION ALL SELECT 'deduplicated', tenant_id, user_id, CASE WHEN {LIVE} THEN phone END FROM users"""))
def named_views(spark, sf_dir):
    """Every tenant's decrypted view and the deduplicated raw copy, created and read by their names in SQL."""
    s = SC.build(spark, sf_dir)
    kv = s.key_versions()
    names = {}
    for r in s.tenant_keys.select("tenant_id").orderBy("tenant_id").collect():        # one view for each tenant, as declared
        VW.materialise(s.vault, kv, r["tenant_id"], "contact_mail", ["email"])
        names[r["tenant_id"]] = VW.view_id(r["tenant_id"], "contact_mail")
    raw = s.vault.where("field_name = 'phone'").withColumnRenamed("encrypted_value", "phone")
    R.encrypted_copy_view(raw.where(F.col("synced_at") < FX.ts(FX.SYNC_JUNK_TS)), "user_id", "tenant_id").createOrReplaceTempView("users_encrypted")
    kv.createOrReplaceTempView("users_keys")
    register_functions(spark)
    views = " UNION ALL ".join(f"SELECT 'decrypted' AS view_kind, tenant_id, user_id, email FROM {n}" for n in names.values())
    return spark.sql(f"""{views} UNION ALL
        SELECT 'deduplicated', c.tenant_id, c.user_id, decrypt_value(c.phone, c.user_id, try_element_at(k.dek_map, bundle_key_id(c.phone)))
        FROM users_encrypted c LEFT JOIN users_keys k USING (tenant_id, user_id)""")


# --- STA-10 redact in place --------------------------------------------------------------------------

@register("sta10_redact_in_place", with_fixtures(["users"], f"""
SELECT o_orderkey, concat('user-', o_custkey) AS user_id,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('raw-', o_custkey, '@example.com') END AS email, o_totalprice
FROM orders"""))
def redact_in_place(spark, sf_dir):
    """Null the declared PII column of every shredded user's rows in an orders-derived source table."""
    from shredline.operators import redaction as RR
    src = (spark.read.parquet(f"{sf_dir}/orders.parquet")
           .select("o_orderkey", F.concat(F.lit("tenant-"), F.col("o_custkey") % 3).alias("tenant_id"),
                   F.concat(F.lit("user-"), F.col("o_custkey")).alias("user_id"),
                   F.concat(F.lit("raw-"), F.col("o_custkey"), F.lit("@example.com")).alias("email"), "o_totalprice"))
    users = FX.shred_requests(FX.fixture(spark, sf_dir, "users"))
    out = RR.redact_in_place(src, ["email"], users, user_col="user_id", tenant_col="tenant_id")
    return out.table.select("o_orderkey", "user_id", "email", "o_totalprice")


# --- EXT-03 incremental vault sync ----------------------------------------------------------------------

@register("ext03_incremental_sync", with_fixtures(["users"], f"""
SELECT tenant_id, user_id, 'email' AS field_name,
  CASE WHEN custkey % 10 = 9 THEN 'old.' || email WHEN custkey % 10 >= 5 THEN 'new.' || email ELSE email END AS value
FROM users WHERE custkey % 10 >= 5 OR (custkey % 10 >= 3 AND ({JUNK} OR NOT ({LIVE})))
UNION ALL
SELECT tenant_id, user_id, 'phone', phone FROM users WHERE custkey % 10 >= 3 AND ({JUNK} OR NOT ({LIVE}))"""))
def incremental_sync(spark, sf_dir):
    """Changed values are synced, also one that returns to a former value; so is what no key of now decrypts any more.

    Shredded users have got a new key since; rows whose newest ciphertext is corrupt are written again.
    """
    s = SC.build(spark, sf_dir)
    day = F.col("custkey") % 10
    src = s.users.select(
        "tenant_id", "user_id",
        F.when(day == 9, F.concat(F.lit("old."), "email")).when(day >= 5, F.concat(F.lit("new."), "email"))
         .otherwise(F.col("email")).alias("email"), "phone",
        (F.to_timestamp(F.lit("2026-01-01 00:00:00")) + F.make_interval(days=day.cast("int"))).alias("updated_at"))
    again = K.generate(s.registry, s.users, s.tenant_keys, FX.ts(FX.NOW_TS),
                       dek_fn=lambda user: SC.seeded(F.concat(F.lit("again-"), user))).state
    kv = K.key_versions(again, s.tenant_keys)
    new = V.sync_increment(src, ["email", "phone"], SC.VAULT_RESOURCE, s.vault, kv, s.tenant_keys,
                           FX.ts(FX.NOW_TS), "updated_at", "2026-01-03 00:00:00")
    return V.decrypt_vault(new, kv).select("tenant_id", "user_id", "field_name", "value")


_TOUCHED = "custkey % 32 IN (3, 17)"


@register("ext03_sync_stored", with_fixtures(["users"], f"""
SELECT 'value' AS kind, tenant_id || '/' || user_id || '/email' AS key,
  CASE WHEN {_TOUCHED} AND custkey % 3 = 0 THEN 'new.' ELSE '' END || email AS value FROM users
UNION ALL SELECT 'value', tenant_id || '/' || user_id || '/phone', phone FROM users
UNION ALL SELECT 'bucket', CAST(custkey % 32 AS VARCHAR), CASE WHEN custkey % 32 IN (3, 17) THEN 'rewritten' ELSE 'same files' END
FROM users GROUP BY custkey % 32
UNION ALL SELECT 'rows', 'first', CAST(2 * count(*) AS VARCHAR) FROM users
UNION ALL SELECT 'rows', 'second', CAST(count(*) AS VARCHAR) FROM users WHERE {_TOUCHED} AND custkey % 3 = 0
UNION ALL SELECT 'rows', 'second again', CAST(count(*) AS VARCHAR) FROM users WHERE {_TOUCHED} AND custkey % 3 = 0"""))
def sync_stored(spark, sf_dir):
    """A full sync, an increment of two of 32 buckets (a third of its rows changed), then values that change there and back."""
    users = FX.fixture(spark, sf_dir, "users")
    tk = FX.tenant_keys(users)
    kv = K.key_versions(K.generate(K.empty_registry(spark), users, tk, FX.ts(FX.KEYGEN_TS), dek_fn=SC.seeded).state, tk)
    root = f"{ensure_checkpoint_dir(spark)}/sync-{uuid.uuid4().hex}"
    tokens = V.CurrentTokens(f"{root}/current", 32, F.element_at(F.split("user_id", "-"), -1).cast("int") % 32)
    tokens.create(spark.createDataFrame([], tokens.schema))

    def files():
        return (spark.read.parquet(tokens.path).select("bucket", F.input_file_name().alias("file")).distinct()
                .groupBy("bucket").agg(F.array_sort(F.collect_set("file")).alias("files")).checkpoint())

    def sync(run, source, at, since=None):
        added = tokens.sync(source, SC.VAULT_FIELDS, SC.VAULT_RESOURCE, f"{root}/vault", run, kv, tk, FX.ts(at), "updated_at", since)
        return added.agg(F.count("*").cast("string").alias("value")).select(F.lit("rows").alias("kind"), F.lit(run).alias("key"), "value")

    first = users.withColumn("updated_at", FX.ts(FX.BASE_TS))
    later = users.withColumns({
        "email": F.when(F.expr(f"{_TOUCHED} AND custkey % 3 = 0"), F.concat(F.lit("new."), "email")).otherwise(F.col("email")),
        "updated_at": F.when(F.expr(_TOUCHED), FX.ts(FX.SYNC_JUNK_TS)).otherwise(FX.ts(FX.BASE_TS))})
    counts = [sync("first", first, FX.SYNC_OLD_TS)]
    before = files()
    counts.append(sync("second", later, FX.SYNC_JUNK_TS, FX.SYNC_NEW_TS))
    after = files()
    back = later.withColumn("email", F.when(F.col("email").startswith("new."), F.concat(F.lit("x."), "email")).otherwise(F.col("email")))
    counts.append(sync("second again", back, FX.NOW_TS, FX.SYNC_NEW_TS))      # other values, then the ones of the increment
    sync("third", later, "2026-06-02 00:00:00", FX.SYNC_NEW_TS)
    values = V.decrypt_vault(tokens.read(spark), kv).select(
        F.lit("value").alias("kind"), F.concat_ws("/", "tenant_id", "user_id", "field_name").alias("key"), "value")
    buckets = before.alias("a").join(after.alias("b"), "bucket").select(
        F.lit("bucket").alias("kind"), F.col("bucket").cast("string").alias("key"),
        F.when(F.col("a.files") == F.col("b.files"), "same files").otherwise("rewritten").alias("value"))
    return values.unionByName(buckets).unionByName(counts[0]).unionByName(counts[1]).unionByName(counts[2])


# --- UDF-01: the SQL functions over the vault ------------------------------------------------------------

@register("udf01_sql_decrypt", with_fixtures(["users"], f"""
SELECT tenant_id, user_id, 'phone' AS field_name, 'v1' AS key_id, phone AS value FROM users WHERE {LIVE}
UNION ALL SELECT tenant_id, user_id, 'phone', 'v1', 'old.' || phone FROM users WHERE {LIVE}
UNION ALL SELECT tenant_id, user_id, 'phone', 'v1', NULL FROM users WHERE {LIVE} AND {JUNK}"""))
def sql_decrypt(spark, sf_dir):
    """Every phone row of the vault through ``decrypt_value`` and ``bundle_key_id`` in SQL."""
    register_functions(spark)
    s = SC.build(spark, sf_dir)
    keyed = (s.vault.where(F.col("field_name") == "phone")
             .join(s.key_versions().select("tenant_id", "user_id", "dek_map"), ["tenant_id", "user_id"]))
    return keyed.selectExpr("tenant_id", "user_id", "field_name", "bundle_key_id(encrypted_value) AS key_id",
                            "decrypt_value(encrypted_value, user_id, try_element_at(dek_map, bundle_key_id(encrypted_value))) "
                            "AS value")
