"""The engine state derived from the driver tables, built by the engine's own operators.

users (customer) → tenant keys → key registry (STA-01, seeded DEKs so the
oracle can reason about the outcome) → vault (STA-04: current copy, an older
copy with different values, and an undecryptable newest row for every 11th
customer) → shred every 7th customer (STA-03).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shredline.functions import crypto as C
from shredline.operators import keys as K
from shredline.operators import vault as V
from shredline.sources import fixtures as FX

VAULT_RESOURCE = "bigquery:proj.ds.users"
VAULT_FIELDS = ["email", "phone"]
# A bundle that parses but never decrypts (fixed test value).
JUNK_BUNDLE = "v1:bm90LWFuLWl2Cg==:bm90LXJlYWwtY2lwaGVydGV4dA=="


@dataclass
class Scenario:
    users: DataFrame
    tenant_keys: DataFrame
    registry_before_shred: DataFrame
    registry: DataFrame
    vault: DataFrame

    def key_versions(self) -> DataFrame:
        return K.key_versions(self.registry, self.tenant_keys)


def seeded(user_col):
    return C.seeded_dek(user_col)


def build(spark: SparkSession, sf_dir: str) -> Scenario:
    users = FX.fixture(spark, sf_dir, "users")
    tk = FX.tenant_keys(users)
    reg1 = K.generate(K.empty_registry(spark), users, tk, FX.ts(FX.KEYGEN_TS), dek_fn=seeded).state
    kv1 = K.key_versions(reg1, tk)
    current = V.encrypt_table(users, VAULT_FIELDS, VAULT_RESOURCE, kv1, tk, FX.ts(FX.SYNC_NEW_TS))
    older = users.select("tenant_id", "user_id",
                         F.concat(F.lit("old."), F.col("email")).alias("email"),
                         F.concat(F.lit("old."), F.col("phone")).alias("phone"))
    old = V.encrypt_table(older, VAULT_FIELDS, VAULT_RESOURCE, kv1, tk, FX.ts(FX.SYNC_OLD_TS))
    junk = (users.where(F.col("custkey") % 11 == 0)
            .select("tenant_id", "user_id", F.explode(F.array(*[F.lit(f) for f in VAULT_FIELDS])).alias("field_name"))
            .select("tenant_id", "user_id", F.lit(VAULT_RESOURCE).alias("resource_id"), "field_name",
                    F.lit("v1").alias("key_id"), F.lit(None).cast("string").alias("token"),
                    F.lit(JUNK_BUNDLE).alias("encrypted_value"), FX.ts(FX.SYNC_JUNK_TS).alias("synced_at")))
    vault = current.unionByName(old).unionByName(junk)
    reg2 = K.shred(reg1, FX.shred_requests(users), FX.ts(FX.SHRED_TS)).state
    return Scenario(users, tk, reg1, reg2, vault)
