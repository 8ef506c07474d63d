import hashlib
import hmac

from pyspark.sql import functions as F

from shredline.functions import crypto as C

# Published cross-language vector (AES-256-GCM, AAD = user id).
DEK_HEX = "a3155cde1ca95aadd7ec1c03b75bcde1ed882bbc2288c0afae08f574c67e1049"
USER = "user_verify_12345"
IV = "yTUdvEqhzpvLXMA1"
CT = "mbB/UPJHhP7IhDz49zwZ5NOqxTvNwy4qI5eihriPfKmLeRPThn86UkHmqu0="
PT = "verify-roundtrip@example.com"


def _one(spark, *cols):
    df = spark.createDataFrame([(DEK_HEX, USER, IV, CT)], "dekhex string, user string, iv string, ct string")
    return df.withColumn("dek", F.unhex("dekhex")).select(*cols).collect()[0]


def test_golden_vector_decrypts(spark):
    r = _one(spark, C.decrypt_random("iv", "ct", "user", "dek").alias("a"),
             C.decrypt_bundle(F.concat_ws(":", F.lit("v1"), "iv", "ct"), "user", "dek").alias("b"))
    assert r.a == PT and r.b == PT


def test_wrong_user_tamper_and_bad_inputs_give_null(spark):
    tampered = F.concat(F.lit("A"), F.substr(F.col("ct"), F.lit(2)))
    r = _one(spark,
             C.decrypt_random("iv", "ct", F.lit("someone-else"), "dek").alias("wrong_user"),
             C.decrypt_random("iv", tampered, "user", "dek").alias("tampered"),
             C.decrypt_random("iv", "ct", "user", F.substring("dek", 1, 16)).alias("short_key"),
             C.decrypt_random("iv", F.lit("%%%not base64%%%"), "user", "dek").alias("bad_b64"),
             C.decrypt_bundle(F.lit(None).cast("string"), "user", "dek").alias("null_bundle"),
             C.decrypt_bundle(F.lit(""), "user", "dek").alias("empty_bundle"),
             C.decrypt_bundle(F.lit("v1:onlytwoparts"), "user", "dek").alias("two_parts"),
             C.decrypt_bundle(F.lit("v1::abc"), "user", "dek").alias("empty_part"),
             C.decrypt_bundle(F.concat_ws(":", F.lit("v1"), "iv", "ct"), F.lit(None).cast("string"), "dek").alias("no_user"),
             C.decrypt_bundle(F.lit("v1:bm90LWFuLWl2Cg==:bm90LXJlYWwtY2lwaGVydGV4dA=="), "user", "dek").alias("junk"),
             C.decrypt_bundle(F.concat_ws(":", F.lit("v1"), "iv", "ct"), "user", F.lit(None).cast("binary")).alias("no_key"))
    assert all(v is None for v in r)


def test_extra_colons_belong_to_ciphertext(spark):
    r = _one(spark, C.decrypt_bundle(F.concat_ws(":", F.lit("v1"), "iv", F.concat("ct", F.lit(":x"))), "user", "dek")
             .alias("x"), C.bundle_key_id(F.lit("v7:a:b:c")).alias("k"))
    assert r.x is None and r.k == "v7"


def test_random_mode_roundtrip_and_fresh_iv(spark):
    # Two rows with the same plaintext, user and key: every row draws its own IV.
    df = spark.createDataFrame([("héllo wörld ✓", USER, DEK_HEX)] * 2, "pt string, user string, dekhex string") \
        .withColumn("dek", F.unhex("dekhex"))
    rows = df.select(C.encrypt_random("pt", "user", "dek", F.lit("v1")).alias("b")) \
        .select("b", C.decrypt_bundle("b", F.lit(USER), F.unhex(F.lit(DEK_HEX))).alias("pt")).collect()
    assert [r.pt for r in rows] == ["héllo wörld ✓"] * 2
    assert rows[0].b != rows[1].b
    assert all(r.b.startswith("v1:") and len(r.b.split(":")) == 3 for r in rows)


def test_deterministic_mode(spark):
    df = spark.createDataFrame([("a@b.c", "u1", "u2", DEK_HEX)], "pt string, u1 string, u2 string, dekhex string") \
        .withColumn("dek", F.unhex("dekhex"))
    e1 = C.encrypt_deterministic("pt", "u1", "dek")
    r = df.select(e1.alias("a"), C.encrypt_deterministic("pt", "u1", "dek").alias("b"),
                  C.encrypt_deterministic("pt", "u2", "dek").alias("c"),
                  C.decrypt_deterministic(e1, "u1", "dek").alias("rt"),
                  C.decrypt_deterministic(e1, "u2", "dek").alias("wrong_user"),
                  C.encrypt_deterministic("pt", "u1", F.substring("dek", 1, 31)).alias("short")).collect()[0]
    assert r.a == r.b and r.a != r.c and r.rt == "a@b.c" and r.wrong_user is None and r.short is None
    v, body = C.parse_deterministic_bundle(F.lit("v12:QUJD"))
    v2, _ = C.parse_deterministic_bundle(F.lit("x1:QUJD"))
    got = df.select(v.alias("v"), body.alias("b"), v2.alias("bad")).collect()[0]
    assert (got.v, got.b, got.bad) == ("v12", "QUJD", None)


def test_deterministic_iv_is_sha256_prefix(spark):
    r = spark.range(1).select(C.deterministic_iv(F.lit("user-1")).alias("iv")).collect()[0]
    assert bytes(r.iv) == hashlib.sha256(b"user-1").digest()[:12]


def test_hmac_matches_stdlib(spark):
    key = hashlib.sha256(b"token-tenant-1").digest()
    ipad, opad = C.hmac_pads(F.lit(key))
    r = spark.range(1).select(C.hmac_sha256_hex(F.lit("alice@example.com"), ipad, opad).alias("h")).collect()[0]
    assert r.h == hmac.new(key, b"alice@example.com", hashlib.sha256).hexdigest()


def test_wrap_unwrap(spark):
    df = spark.createDataFrame([(bytes(range(32)), bytes([7]) * 32, bytes([8]) * 32)], "dek binary, kek binary, other binary")
    r = df.select(C.unwrap_key(C.wrap_key("dek", "kek"), "kek").alias("ok"),
                  C.unwrap_key(C.wrap_key("dek", "kek"), "other").alias("bad")).collect()[0]
    assert bytes(r.ok) == bytes(range(32)) and r.bad is None


def test_random_dek_is_32_bytes_and_distinct(spark):
    rows = spark.range(50).select(C.random_dek().alias("k")).collect()
    keys = {bytes(r.k) for r in rows}
    assert len(keys) == 50 and all(len(k) == 32 for k in keys)


def test_sql_function_matches_column_function(spark):
    from shredline.functions.sql import register_functions
    register_functions(spark)
    r = spark.sql(f"SELECT decrypt_value('v1:{IV}:{CT}', '{USER}', unhex('{DEK_HEX}')) AS a, "
                  f"decrypt_value('v1:{IV}:{CT}', 'other', unhex('{DEK_HEX}')) AS b, bundle_key_id('v3:x:y') AS k").collect()[0]
    assert r.a == PT and r.b is None and r.k == "v3"
