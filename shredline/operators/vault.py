"""PII vault: long table of encrypted values, decrypted views on top of it.

Plan shape for the big operators: the vault and the key map are both hash
partitioned on (tenant_id, user_id); the join and the per-user aggregation
then share that partitioning, so the vault is shuffled once. Filters on
tenant / field name are applied before the join and reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shredline import schemas
from shredline.functions import crypto as C
from shredline.operators.sync_runs import incremental_rows
from shredline.sources.buckets import BucketTable

KEYS = ["tenant_id", "user_id"]
VAULT_COLS = ["tenant_id", "user_id", "resource_id", "field_name", "key_id", "token", "encrypted_value", "synced_at"]


def token_pads(tenant_keys: DataFrame) -> DataFrame:
    """HMAC pads of every tenant token key, computed once per tenant."""
    ipad, opad = C.hmac_pads(F.col("token_key"))
    return tenant_keys.select("tenant_id", ipad.alias("ipad"), opad.alias("opad"))


def encrypt_table(df: DataFrame, fields: list[str], resource_id: str, kv: DataFrame,
                  tenant_keys: DataFrame, synced_at: Column,
                  tenant_col: str = "tenant_id", user_col: str = "user_id") -> DataFrame:
    """STA-04 / EXT-03 core: unpivot declared fields and encrypt each value.

    One vault row per (user, field) with a non-NULL value: randomised
    AES-GCM bundle under the user's active key plus an HMAC-SHA256 token
    under the tenant token key (join key that survives shredding). Users
    without a usable key produce no rows (see ``encrypt_rejects``).
    The output is nondeterministic (random IVs): write it before reuse.
    """
    return encrypted(tokenised(df, fields, resource_id, kv, tenant_keys, tenant_col, user_col), synced_at)


def tokenised(df: DataFrame, fields: list[str], resource_id: str, kv: DataFrame, tenant_keys: DataFrame,
              tenant_col: str = "tenant_id", user_col: str = "user_id") -> DataFrame:
    """One row per (user, field) with a value: its token and the user's keys, not yet encrypted.

    The keys are joined to the narrow source rows and unpivoted after: the shuffle
    carries one row per source row, not one per (row, field).
    """
    narrow = df.select(F.col(tenant_col).alias("tenant_id"), F.col(user_col).alias("user_id"),
                       *[F.col(f).cast("string").alias(f) for f in fields])
    keyed = (narrow.join(kv.select(*KEYS, "active_dek_id", "dek_map"), KEYS, "inner")
             .unpivot([*KEYS, "active_dek_id", "dek_map"], fields, "field_name", "value")
             .where(F.col("value").isNotNull())
             .join(token_pads(tenant_keys), "tenant_id", "left"))
    return keyed.select(*KEYS, F.lit(resource_id).alias("resource_id"), "field_name", "value", "active_dek_id", "dek_map",
                        C.hmac_sha256_hex(F.col("value"), F.col("ipad"), F.col("opad")).alias("token"))


def encrypted(rows: DataFrame, synced_at: Column) -> DataFrame:
    """Vault rows of tokenised values, encrypted under the user's active key."""
    dek = F.try_element_at("dek_map", F.col("active_dek_id"))
    return rows.select(
        *KEYS, "resource_id", "field_name", F.col("active_dek_id").alias("key_id"), "token",
        C.encrypt_random(F.col("value"), F.col("user_id"), dek, F.col("active_dek_id")).alias("encrypted_value"),
        synced_at.alias("synced_at"))


def encrypt_rejects(df: DataFrame, kv: DataFrame, tenant_col: str = "tenant_id",
                    user_col: str = "user_id") -> DataFrame:
    """Rows whose user has no usable key (they cannot enter the vault)."""
    return (df.withColumnRenamed(tenant_col, "tenant_id").withColumnRenamed(user_col, "user_id")
            .join(kv.select(*KEYS), KEYS, "left_anti")
            .withColumn("error", F.lit("No usable key for user")))


def decrypt_vault(vault: DataFrame, kv: DataFrame) -> DataFrame:
    """JOIN-02 + FN-06: attach each row's key version (named in the bundle) and decrypt.

    Left join: a row whose user is shredded, unknown, or whose version is
    missing keeps ``value`` NULL.
    """
    j = vault.join(kv.select(*KEYS, "dek_map"), KEYS, "left")
    dek = F.try_element_at("dek_map", C.bundle_key_id(F.col("encrypted_value")))
    return j.withColumn("value", C.decrypt_bundle(F.col("encrypted_value"), F.col("user_id"), dek)).drop("dek_map")


def _scope(vault: DataFrame, tenant: str | None, fields: list[str] | None, resource_id: str | None) -> DataFrame:
    v = vault
    if tenant is not None:
        v = v.where(F.col("tenant_id") == tenant)
    if fields:
        v = v.where(F.col("field_name").isin(*fields))
    if resource_id is not None:
        v = v.where(F.col("resource_id") == resource_id)
    return v


def rungs(vault: DataFrame, kv: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The ladder of AGG-03: every user's newest row of each field, decrypted, and the older rows where that one fails.

    ``first`` has one row per user: ``_at<i>``, ``_value<i>`` of field i. The newest is a maximum by ``synced_at``,
    key_id, resource_id, bundle, so neither shuffles nor decrypts a history. ``older`` has the rows of those
    fields alone whose user has a key and whose newest bundle is corrupt.
    """
    at = F.struct("synced_at", "key_id", "resource_id", "encrypted_value")
    newest = vault.groupBy(*KEYS).agg(*[F.max(F.when(F.col("field_name") == f, at)).alias(f"_at{i}") for i, f in enumerate(fields)])

    def opened(bundle: Column) -> Column:
        return C.decrypt_bundle(bundle, F.col("user_id"), F.try_element_at("dek_map", C.bundle_key_id(bundle)))

    first = newest.join(kv.select(*KEYS, "dek_map"), KEYS, "left").withColumns(
        {f"_value{i}": opened(F.col(f"_at{i}.encrypted_value")) for i in range(len(fields))})
    lost = F.array(*[F.when(F.col(f"_at{i}").isNotNull() & F.col(f"_value{i}").isNull(), F.struct(
        F.lit(f).alias("field_name"), F.col(f"_at{i}").alias("at"))) for i, f in enumerate(fields)])
    failed = (first.where(F.col("dek_map").isNotNull()).select(*KEYS, "dek_map", F.filter(lost, lambda x: x.isNotNull()).alias("_lost"))
              .where(F.size("_lost") > 0))
    before = F.exists("_lost", lambda x: (x["field_name"] == F.col("field_name")) & (at < x["at"]))
    older = vault.join(failed, KEYS).where(before).select(*KEYS, "field_name", at.alias("_at"), opened(F.col("encrypted_value")).alias("value"))
    return first.drop("dek_map"), older


def decrypted_pivot(vault: DataFrame, kv: DataFrame, fields: list[str], tenant: str | None = None,
                    resource_id: str | None = None) -> DataFrame:
    """AGG-03 / QRY-01: one column per field per user: the newest value that decrypts.

    NULL values are skipped, so an older good value wins over a newer undecryptable one. Values are
    never written: the newest of each field is decrypted at most twice (to see whether it is readable, and
    as the value), the others only where it isn't.
    """
    kv = kv if tenant is None else kv.where(F.col("tenant_id") == tenant)
    first, older = rungs(_scope(vault, tenant, fields, resource_id), kv, fields)
    hit = [(F.col("field_name") == f) & F.col("value").isNotNull() for f in fields]
    second = older.groupBy(*KEYS).agg(*[F.max_by(F.when(h, F.col("value")), F.when(h, F.col("_at"))).alias(f"_older{i}")
                                        for i, h in enumerate(hit)])
    return first.join(second, KEYS, "left").select(
        *KEYS, *[F.coalesce(f"_value{i}", f"_older{i}").alias(f) for i, f in enumerate(fields)])


def latest_ciphertext(vault: DataFrame, kv: DataFrame) -> DataFrame:
    """WIN-03: newest row per (tenant, user, resource, field), decryptable or not.

    A ``max_by`` aggregate: partial results meet, so one row per field and task is
    shuffled, not the history.
    """
    newest = F.max_by(F.struct("key_id", "token", "encrypted_value", "synced_at"),
                      F.struct("synced_at", "key_id", "encrypted_value"))
    latest = (vault.groupBy("tenant_id", "user_id", "resource_id", "field_name").agg(newest.alias("_v"))
              .select("tenant_id", "user_id", "resource_id", "field_name", "_v.*"))
    j = latest.join(kv.select(*KEYS, "dek_map"), KEYS, "left")
    dek = F.try_element_at("dek_map", C.bundle_key_id(F.col("encrypted_value")))
    return j.withColumn("value", C.decrypt_bundle(F.col("encrypted_value"), F.col("user_id"), dek)).drop("dek_map")


def adhoc_decrypt(requests: DataFrame, vault: DataFrame, kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """QRY-04: decrypt (tenant, user, resource, field) requests; audit rows carry no plaintext."""
    req_keys = ["tenant_id", "user_id", "resource_id", "field_name"]
    req = requests.select(*req_keys).dropDuplicates(req_keys)
    scoped = vault.join(req, req_keys, "left_semi")
    latest = latest_ciphertext(scoped, kv)
    out = req.join(latest.select(*req_keys, "value", "synced_at"), req_keys, "left").select(
        *req_keys, F.col("value").alias("plaintext"), F.col("value").isNotNull().alias("found"))
    audit = out.select(
        F.expr("uuid()").alias("event_id"), "tenant_id", "user_id",
        F.lit("pii-vault").alias("source"), F.col("resource_id").alias("destination"),
        F.current_timestamp().alias("timestamp"),
        F.to_json(F.struct(F.lit("PII_VAULT_DECRYPT").alias("event_type"), "resource_id", "field_name",
                           "found")).alias("context"))
    return out, audit


def available_fields(vault: DataFrame) -> DataFrame:
    """FIL-13: distinct synced fields per tenant."""
    return vault.select("tenant_id", "field_name").distinct()


def synced_tenants(vault: DataFrame, tenant: str, page: int | None = None) -> DataFrame:
    """FIL-14: the other tenants with synced fields, shown to ``tenant`` only when it has none itself.

    All of them by default; ``page`` keeps the first by name (the reference shows 5).
    """
    names = vault.select("tenant_id").distinct()
    if not names.where(F.col("tenant_id") == tenant).isEmpty():
        return names.limit(0)
    return names if page is None else names.orderBy("tenant_id").limit(page)


def reencrypt(vault: DataFrame, kv: DataFrame) -> DataFrame:
    """EXT-06: re-encrypt every value not under the active version (after rotation).

    Rows already under the active key are kept as they are; others are
    decrypted with their old version and encrypted with the active one,
    keeping their ``synced_at`` (same value, new key). Rows that do not
    decrypt (shredded users, corrupt bundles) are kept unchanged, so the row
    count before and after the rewrite is equal.
    """
    dv = vault.join(kv.select(*KEYS, "active_dek_id", "dek_map"), KEYS, "left")
    old_dek = F.try_element_at("dek_map", C.bundle_key_id(F.col("encrypted_value")))
    dv = dv.withColumn("value", C.decrypt_bundle(F.col("encrypted_value"), F.col("user_id"), old_dek))
    old = F.coalesce(C.bundle_key_id(F.col("encrypted_value")) != F.col("active_dek_id"), F.lit(False))
    moves = old & F.col("value").isNotNull()
    dek = F.try_element_at("dek_map", F.col("active_dek_id"))
    fresh = C.encrypt_random(F.col("value"), F.col("user_id"), dek, F.col("active_dek_id"))
    return dv.select(*KEYS, "resource_id", "field_name", F.when(moves, F.col("active_dek_id")).otherwise(F.col("key_id")).alias("key_id"),
                     "token", F.when(moves, fresh).otherwise(F.col("encrypted_value")).alias("encrypted_value"), "synced_at")


def sync_increment(source: DataFrame, fields: list[str], resource_id: str, vault: DataFrame, kv: DataFrame,
                   tenant_keys: DataFrame, synced_at: Column, updated_at_col: str | None = None,
                   last_synced_at=None) -> DataFrame:
    """EXT-03: encrypt only what changed since the watermark and is not in the vault yet.

    Rows newer than ``last_synced_at`` (all rows without a watermark column or
    value: a full sync) are unpivoted, tokenised and compared with the newest
    vault row of their (tenant, user, resource, field). A value is unchanged only
    if that row has its token and still decrypts under the user's keys, so a value
    that returns to a former one is appended, and so is one of a user who was
    shredded and got a new key. Values are encrypted after the comparison.
    """
    rows = tokenised(incremental_rows(source, updated_at_col, last_synced_at), fields, resource_id, kv, tenant_keys)
    newest = newest_tokens(vault.where(F.col("resource_id") == resource_id))
    return encrypted(changed_rows(rows, newest), synced_at)


def newest_tokens(vault: DataFrame) -> DataFrame:
    """The newest vault row of each (tenant, user, resource, field): what the values of now are compared with."""
    keys = ["resource_id", "field_name"]
    last = F.max_by(F.struct("key_id", "token", "encrypted_value", "synced_at"), F.struct("synced_at", "key_id", "encrypted_value"))
    return vault.groupBy(*KEYS, *keys).agg(last.alias("_l")).select(*KEYS, *keys, "_l.*").select(*VAULT_COLS)


def changed_rows(rows: DataFrame, newest: DataFrame) -> DataFrame:
    """Tokenised values that their newest vault row doesn't hold readably."""
    keys = [*KEYS, "resource_id", "field_name"]
    both = rows.join(newest.select(*keys, F.col("token").alias("_token"), F.col("encrypted_value").alias("_last")), keys, "left")
    old_dek = F.try_element_at("dek_map", C.bundle_key_id(F.col("_last")))
    readable = C.decrypt_bundle(F.col("_last"), F.col("user_id"), old_dek).isNotNull()
    return both.where(~F.coalesce((F.col("_token") == F.col("token")) & readable, F.lit(False)))


class CurrentTokens(BucketTable):
    """EXT-03: the newest vault row of every (tenant, user, resource, field), maintained beside the vault.

    An increment reads the buckets of its own users instead of aggregating the resource's vault.
    """

    def __init__(self, path: str, buckets: int = 1024, bucket: Column | None = None):
        super().__init__(path, schemas.PII_VAULT, buckets, bucket)

    def sync(self, source: DataFrame, fields: list[str], resource_id: str, vault_path: str, run_id: str, kv: DataFrame,
             tenant_keys: DataFrame, synced_at: Column, updated_at_col: str | None = None, last_synced_at=None) -> DataFrame:
        """Append what changed to the vault as ``run=<run_id>`` and bring the table up to date; returns the rows appended.

        The values are encrypted once, by the write; only ciphertext and tokens are stored. A run that
        failed half way is run again under its id and replaces what it wrote.
        """
        spark = source.sparkSession
        new = incremental_rows(source, updated_at_col, last_synced_at)
        hit = self.hit(new)
        rows = tokenised(new, fields, resource_id, kv, tenant_keys)
        now = self.read_buckets(spark, hit)
        out = f"{vault_path}/run={run_id}"
        encrypted(changed_rows(rows, now), synced_at).write.mode("overwrite").parquet(out)
        added = spark.read.schema(self.schema).parquet(out)
        if hit:
            keys = [*KEYS, "resource_id", "field_name"]
            self.replace(now.join(added.select(*keys), keys, "left_anti").unionByName(added))
        return added
