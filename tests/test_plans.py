"""Physical-plan properties the scale design relies on (checked on executed plans, AQE off)."""

import re

import pytest

from shredline.operators import keys as K
from shredline.operators import lineage as LIN
from shredline.operators import vault as V
from shredline.plans import q_lineage as QL
from shredline.plans import scenario as SC

from conftest import SF_SMALL


@pytest.fixture()
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _plan(df, mode: str = "simple") -> str:
    """The text ``df.explain(mode)`` prints."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    s = SC.build(spark, SF_SMALL)
    s.vault.write.partitionBy("tenant_id").parquet(f"{root}/vault")
    s.registry.write.parquet(f"{root}/registry")
    return spark.read.parquet(f"{root}/vault"), spark.read.parquet(f"{root}/registry"), s.tenant_keys


def test_decrypted_view_shuffles_the_vault_once(spark, stored, no_broadcast):
    vault, reg, tk = stored
    plan = _plan(V.rungs(vault, K.key_versions(reg, tk), ["email"])[0])
    vault_side = plan.split("SortMergeJoin")[1]
    assert vault_side.index("Exchange hashpartitioning(tenant_id") < vault_side.index("partial_max(")
    # vault: one exchange on (tenant_id, user_id) of each user's newest rows; the join adds none
    assert plan.split("SortMergeJoin")[0].count("Exchange") == 0
    assert "Exchange hashpartitioning(tenant_id" in vault_side


def test_filters_and_columns_reach_the_scan(spark, stored):
    vault, reg, tk = stored
    df = V.decrypted_pivot(vault, K.key_versions(reg, tk), ["email"], tenant="tenant-1")
    plan = _plan(df, "formatted")
    assert re.search(r"PartitionFilters: \[\(tenant_id#\d+ = tenant-1\)\]", plan)
    assert "PushedFilters: [EqualTo(field_name,email)]" in plan
    assert "ReadSchema: struct<user_id:string,resource_id:string,field_name:string,key_id:string," \
           "encrypted_value:string,synced_at:timestamp>" in plan


def test_findings_are_grouped_before_the_shuffle(spark, no_broadcast):
    plan = _plan(LIN.ghost_groups(QL._events(spark, SF_SMALL)))
    assert "partial_max(timestamp" in plan
    plan += _plan(QL.ghost_findings(spark, SF_SMALL))       # its ranks start from stored rows: see test_running
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_latest_ciphertext_is_aggregated_before_the_shuffle(spark, stored, no_broadcast):
    vault, reg, tk = stored
    plan = _plan(V.latest_ciphertext(vault, K.key_versions(reg, tk)))
    assert "partial_max_by" in plan and "Window" not in plan


def test_one_tenants_view_reads_one_tenants_keys(spark, stored):
    vault, reg, tk = stored
    plan = _plan(V.decrypted_pivot(vault, K.key_versions(reg, tk), ["email"], tenant="tenant-1"), "formatted")
    assert "EqualTo(tenant_id,tenant-1)" in plan.split("registry")[-1] or plan.count("EqualTo(tenant_id,tenant-1)") >= 1


def test_hot_user_partition_is_split_by_aqe(spark, tmp_dir):
    """One user holds a third of the vault: AQE splits that partition where whole histories meet their keys.

    The view takes the newest of each field before the keys are joined, so no history is shuffled there.
    """
    import datetime as dt

    from pyspark.sql import functions as F

    from shredline.functions import crypto as C

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        tk = spark.createDataFrame([("A",)], "tenant_id string").withColumn("kek", F.unhex(F.sha2(F.lit("k"), 256))) \
            .withColumn("token_key", F.unhex(F.sha2(F.lit("t"), 256)))
        users = spark.range(1000).select(F.lit("A").alias("tenant_id"), F.concat(F.lit("u"), F.col("id")).alias("user_id"))
        t0 = F.lit(dt.datetime(2026, 1, 1))
        kv = K.key_versions(K.generate(K.empty_registry(spark), users, tk, t0, dek_fn=C.seeded_dek).state, tk)
        rows = spark.range(15000).select(
            F.lit("A").alias("tenant_id"),
            F.when(F.col("id") < 5000, F.lit("u0")).otherwise(F.concat(F.lit("u"), F.col("id") % 1000)).alias("user_id"),
            F.concat(F.lit("v"), F.col("id")).alias("email"))
        V.encrypt_table(rows, ["email"], "r", kv, tk, t0).write.parquet(f"{tmp_dir}/vault")
        view = V.decrypted_pivot(spark.read.parquet(f"{tmp_dir}/vault"), kv, ["email"])
        assert re.search(r"partial_max\(CASE WHEN \(field_name", view._jdf.queryExecution().executedPlan().toString())
        out = view.collect()
        assert len(out) == 1000 and all(r.email is not None for r in out)
        df = V.decrypt_vault(spark.read.parquet(f"{tmp_dir}/vault"), kv)
        assert all(r.value is not None for r in df.collect())
        assert "SortMergeJoin(skew=true)" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_a_task_of_the_deletion_plan_holds_few_sorted_inputs(spark, no_broadcast):
    """The joins of a deletion plan are all on (tenant, user): those of the key rows and of lineage are done and written before the last ones."""
    plan = _plan(QL.deletion_plan(spark, SF_SMALL))
    assert plan.count("SortMergeJoin") <= 5 and "FullOuter" not in plan
