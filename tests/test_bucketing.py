import datetime as dt

from pyspark.sql import functions as F

from shredline.functions import crypto as C
from shredline.operators import keys as K
from shredline.operators import vault as V
from shredline.sources import state


def test_bucketed_vault_and_keys_join_without_shuffle(spark):
    tk = spark.createDataFrame([("A",), ("B",)], "tenant_id string") \
        .withColumn("kek", F.unhex(F.sha2(F.concat(F.lit("kek-"), "tenant_id"), 256))) \
        .withColumn("token_key", F.unhex(F.sha2(F.lit("t"), 256)))
    tk = F.broadcast(tk)                # two tenants; the vault and the key registry are what must not move
    users = spark.range(200).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("tenant_id"),
                                    F.concat(F.lit("u"), F.col("id")).alias("user_id"),
                                    F.concat(F.lit("e"), F.col("id"), F.lit("@x")).alias("email"))
    reg = K.generate(K.empty_registry(spark), users, tk, F.lit(dt.datetime(2026, 1, 1)), dek_fn=C.seeded_dek).state
    state.save_bucketed(reg, "kr_bucketed", 8, ["tenant_id", "user_id"])
    kv = K.key_versions(spark.table("kr_bucketed"), tk)
    vault = V.encrypt_table(users, ["email"], "r", kv, tk, F.lit(dt.datetime(2026, 1, 1)))
    state.save_bucketed(vault, "vault_bucketed", 8, ["tenant_id", "user_id"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        piv = V.decrypted_pivot(spark.table("vault_bucketed"), K.key_versions(spark.table("kr_bucketed"), tk), ["email"])
        plan = piv._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
        rows = {r.user_id: r.email for r in piv.collect()}
        assert len(rows) == 200 and rows["u7"] == "e7@x"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
