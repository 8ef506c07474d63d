"""Key registry: one data-encryption key (DEK) map per (tenant, user).

State is a DataFrame with schema ``schemas.KEY_REGISTRY``; every change is a
function ``new_state = f(state, batch)`` that joins the batch to the state on
(tenant_id, user_id) — one shuffle on the key both sides share — and rebuilds
the touched rows. DEKs are stored wrapped under the tenant key (FN-09) and are
unwrapped once per key row (``key_versions``), never once per value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredline import schemas
from shredline.functions import crypto as C
from shredline.operators.util import iso
from shredline.session import ensure_checkpoint_dir
from shredline.sources.buckets import BucketTable

KEYS = ["tenant_id", "user_id"]
DEAD = ["SHREDDED", "DELETED"]
TOKEN_ALGORITHM = "HMAC-SHA256"


@dataclass
class StateChange:
    state: DataFrame      # the new table
    outcome: DataFrame    # one row per request: what happened


def empty_registry(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.KEY_REGISTRY)


def usable(reg_prefix: str = "") -> Column:
    """FIL-10: key row is usable: not shredded/deleted, has material, active version present."""
    p = reg_prefix
    deks = F.col(f"{p}deks")
    return (F.col(f"{p}user_id").isNotNull()
            & ~F.coalesce(F.col(f"{p}status"), F.lit("")).isin(*DEAD)
            & (F.coalesce(F.size(deks), F.lit(0)) > 0)
            & F.col(f"{p}active_dek_id").isNotNull()
            & F.try_element_at(deks, F.col(f"{p}active_dek_id")).isNotNull())


NO_TENANT_KEY = "Tenant has no wrapping key"


def _requests(users: DataFrame) -> DataFrame:
    return users.select(*KEYS).dropDuplicates(KEYS)


def generate(registry: DataFrame, users: DataFrame, tenant_keys: DataFrame, now: Column,
             dek_fn=None, token_key_id: str = "token-key-v1",
             encryption_version: str = "v2") -> StateChange:
    """STA-01: give every requested user a usable key, idempotently.

    ``EXISTS`` when a usable key is present, else ``GENERATED`` with version
    ``v1``; a shredded user gets a fresh key document (``regenerated``). Without a key
    of the tenant to wrap it with, no key is made and the outcome is ``ERROR``.
    ``dek_fn(user_col)`` makes the DEK; the default is the OS CSPRNG, whose
    output must be written before any value is encrypted with it.
    One full outer join of the registry with the requests: the registry is
    read and shuffled once, and every row of the new state comes out of it.
    """
    dek_fn = dek_fn or (lambda _u: C.random_dek())
    req = _requests(users).withColumn("_req", F.lit(True))
    kek = tenant_keys.select("tenant_id", "kek")
    j = registry.join(req, KEYS, "full_outer").join(kek, "tenant_id", "left")
    ok = usable()
    fresh = F.coalesce(F.col("_req"), F.lit(False)) & ~ok & F.col("kek").isNotNull()
    existed = F.col("status").isNotNull()
    state = j.select(
        *KEYS,
        F.when(fresh, F.create_map(F.lit("v1"), C.wrap_key(dek_fn(F.col("user_id")), F.col("kek"))))
         .otherwise(F.col("deks")).alias("deks"),
        F.when(fresh, F.lit("v1")).otherwise(F.col("active_dek_id")).alias("active_dek_id"),
        F.when(fresh, F.lit("ACTIVE")).otherwise(F.col("status")).alias("status"),
        F.when(fresh, now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(fresh, F.lit(None).cast("timestamp")).otherwise(F.col("shred_at")).alias("shred_at"),
        F.when(fresh, F.lit(None).cast("timestamp")).otherwise(F.col("rotated_at")).alias("rotated_at"),
        F.when(fresh, F.lit(encryption_version)).otherwise(F.col("encryption_version")).alias("encryption_version"),
        F.when(fresh, F.lit(TOKEN_ALGORITHM)).otherwise(F.col("token_algorithm")).alias("token_algorithm"),
        F.when(fresh, F.lit(token_key_id)).otherwise(F.col("token_key_id")).alias("token_key_id"),
        F.when(fresh, F.lit(None).cast("string")).otherwise(F.col("deletion_request_id")).alias("deletion_request_id"),
        F.coalesce(F.col("destinations"), F.array().cast("array<string>")).alias("destinations"),
    )
    outcome = j.where(F.col("_req")).select(
        *KEYS, F.when(ok, "EXISTS").when(fresh, "GENERATED").otherwise("ERROR").alias("outcome"),
        (existed & fresh).alias("regenerated"), F.when(~ok & ~fresh, NO_TENANT_KEY).alias("error"))
    return StateChange(state.where(F.col("status").isNotNull()), outcome)


def rotate(registry: DataFrame, users: DataFrame, tenant_keys: DataFrame, now: Column,
           dek_fn=None) -> StateChange:
    """STA-02: add version ``v{n+1}``, make it active, keep older versions readable.

    Missing or shredded users get an error outcome and are left unchanged.
    """
    dek_fn = dek_fn or (lambda _u: C.random_dek())
    req = _requests(users).withColumn("_req", F.lit(True))
    j = registry.join(req, KEYS, "full_outer")
    live = F.col("status").isNotNull() & (F.col("status") != "SHREDDED") & F.col("active_dek_id").isNotNull()
    can = F.col("_req") & live & F.col("kek").isNotNull()
    new_version = F.concat(F.lit("v"), (F.size("deks") + 1).cast("string"))
    kek = tenant_keys.select("tenant_id", "kek")
    j = j.join(kek, "tenant_id", "left")
    rotated = j.select(
        *KEYS,
        F.when(can, F.map_concat("deks", F.create_map(new_version, C.wrap_key(dek_fn(F.col("user_id")), F.col("kek")))))
         .otherwise(F.col("deks")).alias("deks"),
        F.when(can, new_version).otherwise(F.col("active_dek_id")).alias("active_dek_id"),
        F.when(can, F.lit("ACTIVE")).otherwise(F.col("status")).alias("status"),
        "created_at", "shred_at",
        F.when(can, now).otherwise(F.col("rotated_at")).alias("rotated_at"),
        "encryption_version", "token_algorithm", "token_key_id", "deletion_request_id", "destinations",
        F.col("_req"), can.alias("_ok"), live.alias("_live"), new_version.alias("_newv"),
    )
    state = rotated.where(F.col("status").isNotNull()).select(*schemas.KEY_REGISTRY.fieldNames())
    outcome = rotated.where(F.col("_req")).select(
        *KEYS,
        F.when(F.col("_ok"), "ROTATED").otherwise("ERROR").alias("outcome"),
        F.when(F.col("_ok"), F.col("_newv")).alias("new_version"),
        F.when(~F.col("_ok"), F.when(F.col("status").isNull(), "User key not found for rotation")
               .when(F.col("_live"), NO_TENANT_KEY).otherwise("Cannot rotate a shredded key")).alias("error"),
    )
    return StateChange(state, outcome)


def shred(registry: DataFrame, requests: DataFrame, now: Column) -> StateChange:
    """STA-03: erase key material; upserts a SHREDDED row even for users never keyed.

    ``requests`` has (tenant_id, user_id) and optionally deletion_request_id.
    The caller must write the new state and purge old files (sources.state).
    """
    cols = requests.columns
    req = requests.select(*KEYS, (F.col("deletion_request_id") if "deletion_request_id" in cols
                                  else F.lit(None).cast("string")).alias("_drid")).dropDuplicates(KEYS)
    req = req.withColumn("_req", F.lit(True))
    j = registry.join(req, KEYS, "full_outer")
    hit = F.coalesce(F.col("_req"), F.lit(False))
    state = j.select(
        *KEYS,
        F.when(hit, F.create_map().cast("map<string,binary>")).otherwise(F.col("deks")).alias("deks"),
        F.when(hit, F.lit(None).cast("string")).otherwise(F.col("active_dek_id")).alias("active_dek_id"),
        F.when(hit, F.lit("SHREDDED")).otherwise(F.col("status")).alias("status"),
        "created_at",
        F.when(hit, now).otherwise(F.col("shred_at")).alias("shred_at"),
        "rotated_at", "encryption_version", "token_algorithm", "token_key_id",
        F.when(hit, F.coalesce(F.col("_drid"), F.col("deletion_request_id")))
         .otherwise(F.col("deletion_request_id")).alias("deletion_request_id"),
        F.coalesce(F.col("destinations"), F.array().cast("array<string>")).alias("destinations"),
    )
    outcome = req.select(*KEYS, F.lit("SHREDDED").alias("outcome"))
    return StateChange(state, outcome)


def key_versions(registry: DataFrame, tenant_keys: DataFrame) -> DataFrame:
    """Unwrapped DEKs per usable user: (tenant_id, user_id, active_dek_id, dek_map).

    Shredded / deleted users have no row, so every join against this yields
    a NULL key and every decrypt yields NULL.
    """
    kek = tenant_keys.select("tenant_id", "kek")
    live = registry.where(usable()).select(*KEYS, "active_dek_id", "deks")
    return (live.join(kek, "tenant_id", "inner")
            .select(*KEYS, "active_dek_id",
                    F.transform_values("deks", lambda _k, v: C.unwrap_key(v, F.col("kek"))).alias("dek_map")))


def key_status(registry: DataFrame) -> DataFrame:
    """FIL-11: status projection with ISO timestamps."""
    return registry.select(
        *KEYS, "status", "active_dek_id", "encryption_version",
        F.size("deks").alias("key_versions"),
        iso("created_at").alias("created_at"), iso("shred_at").alias("shred_at"),
        iso("rotated_at").alias("rotated_at"), "destinations", "deletion_request_id",
    )


def encryption_contexts(registry: DataFrame, users: DataFrame) -> DataFrame:
    """FIL-12: per requested user, the wrapped DEK and key id, or an error row.

    404 when there is no key or it is shredded/deleted, 500 when a live key
    row has no material for its active version, 200 otherwise.
    """
    j = _requests(users).join(registry, KEYS, "left")
    dead = F.col("status").isNull() | F.col("status").isin(*DEAD)
    material = F.try_element_at("deks", F.col("active_dek_id"))
    code = F.when(dead, 404).when(F.col("active_dek_id").isNull() | material.isNull(), 500).otherwise(200)
    return j.select(
        *KEYS,
        code.alias("status_code"),
        F.when(code == 404, "Key not found or shredded").when(code == 500, "Key material missing").alias("error"),
        F.when(code == 200, C.b64(material)).alias("wrapped_dek"),
        F.when(code == 200, F.col("active_dek_id")).alias("key_id"),
        F.when(code == 200, F.lit("AES-256-GCM")).alias("algorithm"),
        F.when(code == 200, F.col("token_algorithm")).alias("token_algorithm"),
        F.when(code == 200, F.col("token_key_id")).alias("token_key_id"),
        F.when(code == 200, F.col("encryption_version")).alias("encryption_version"),
    )


def contexts_by_user(contexts: DataFrame, parts: int = 1024) -> DataFrame:
    """AGG-13: contexts indexed by user id: maps of at most about 1 / ``parts`` of a tenant's users each.

    A user's context is in the map of part pmod(xxhash64(user_id), parts), so a tenant of any size has no row that holds it whole.
    """
    ok = contexts.where(F.col("status_code") == 200)
    part = F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int")
    return ok.groupBy("tenant_id", part.alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct("user_id", F.struct("key_id", "wrapped_dek", "algorithm"))))
        .alias("contexts"))


# --- the stored registry --------------------------------------------------------------------------------

class StoredRegistry(BucketTable):
    """STA-01/02/03 on a stored registry, bucketed by user.

    A change rewrites only the buckets that hold a requested user: their old files are deleted when the
    job commits, so the erased key bytes are gone from storage, and every other bucket keeps its files.
    """

    def __init__(self, path: str, buckets: int = 1024, bucket: Column | None = None):
        super().__init__(path, schemas.KEY_REGISTRY, buckets, bucket)

    def change(self, users: DataFrame, step: Callable[[DataFrame, DataFrame], StateChange]) -> DataFrame:
        """Apply ``step(registry, users)`` to the buckets of the users; returns its outcome, fixed before a file changes."""
        spark = users.sparkSession
        ensure_checkpoint_dir(spark)
        asked = users.checkpoint()
        hit = self.hit(asked)
        done = step(self.read_buckets(spark, hit), asked)
        outcome = done.outcome.checkpoint()
        if hit:
            self.replace(done.state)
        return outcome

    def generate(self, users: DataFrame, tenant_keys: DataFrame, now: Column, **kw) -> DataFrame:
        return self.change(users, lambda registry, asked: generate(registry, asked, tenant_keys, now, **kw))

    def rotate(self, users: DataFrame, tenant_keys: DataFrame, now: Column, **kw) -> DataFrame:
        return self.change(users, lambda registry, asked: rotate(registry, asked, tenant_keys, now, **kw))

    def shred(self, requests: DataFrame, now: Column) -> DataFrame:
        return self.change(requests, lambda registry, asked: shred(registry, asked, now))
