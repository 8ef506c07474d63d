import datetime as dt

from pyspark.sql import functions as F

from shredline.operators import keys as K
from shredline.operators import views as VW
from shredline.sources import tables as TB

from conftest import SF_SMALL


def test_parse_resource_id_and_lowercase(spark):
    df = spark.createDataFrame([("bigquery:proj.ds.users",), ("gcs:bucket",)], "rid string")
    r = df.select(TB.parse_resource_id(F.col("rid")).alias("p")).collect()
    assert (r[0].p.system, r[0].p.project, r[0].p.dataset, r[0].p.table) == ("bigquery", "proj", "ds", "users")
    assert r[1].p.table == ""
    assert TB.lowercase_columns(spark.createDataFrame([(1,)], "RESOURCE_ID int")).columns == ["resource_id"]


def test_schema_rows_table_type_and_missing_tables(spark, tmp_dir):
    cust = TB.read_table(spark, SF_SMALL, "customer")
    rows = {(r.column_name, r.ordinal) for r in TB.schema_rows(spark, {"customer": cust}).collect()}
    assert ("c_custkey", 1) in rows and len(rows) == len(cust.columns)
    cust.createOrReplaceTempView("shredline_probe_view")
    assert TB.table_type(spark, "shredline_probe_view") == "VIEW"
    assert TB.table_type(spark, "no_such_table_here") == "MISSING"
    empty = TB.read_or_empty(spark, f"{tmp_dir}/absent", "a string")
    assert empty.count() == 0 and empty.columns == ["a"]


def test_materialised_view_and_contexts_map(spark):
    tk = spark.createDataFrame([("t-1",)], "tenant_id string").withColumn("kek", F.unhex(F.sha2(F.lit("k"), 256))) \
        .withColumn("token_key", F.unhex(F.sha2(F.lit("t"), 256)))
    users = spark.createDataFrame([("t-1", "u1", "a@x")], "tenant_id string, user_id string, email string")
    reg = K.generate(K.empty_registry(spark), users, tk, F.lit(dt.datetime(2026, 1, 1))).state.cache()
    from shredline.operators import vault as V
    kv = K.key_versions(reg, tk)
    vault = V.encrypt_table(users, ["email"], "r", kv, tk, F.lit(dt.datetime(2026, 1, 1))).cache()
    VW.materialise(vault, kv, "t-1", "support", ["email"])
    assert spark.table(VW.view_id("t-1", "support")).collect()[0].email == "a@x"
    same = [VW.view_id(t, v) for t, v in (("a-b", "c"), ("a_b", "c"), ("a", "b_c"), ("A", "b_c"))]
    assert len({x.lower() for x in same}) == 4
    ctx = K.contexts_by_user(K.encryption_contexts(reg, users)).collect()[0]
    assert set(ctx.contexts) == {"u1"} and ctx.contexts["u1"].key_id == "v1"
