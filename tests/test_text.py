import pytest
from pyspark.sql import functions as F

from shredline.functions import text as TX


def test_column_sensitivity_order_and_quirks(spark):
    names = ["Email_Address", "ssn", "phone", "city", "ip_addr", "description", "paid", "user_id", "notes"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.w for r in df.select("n", TX.column_sensitivity("n").alias("w")).collect()}
    # first matching group decides: "description" scores 2 by "ip", "paid" 0.5 by "id"
    assert got == {"Email_Address": 3.0, "ssn": 3.0, "phone": 2.0, "city": 2.0, "ip_addr": 2.0,
                   "description": 2.0, "paid": 0.5, "user_id": 0.5, "notes": 2.0}


def test_field_sensitivity_defaults_to_one(spark):
    df = spark.createDataFrame([("DIRECT_IDENTIFIER",), ("SYSTEM_IDENTIFIER",), ("SOMETHING_ELSE",)], "c string")
    assert [r.w for r in df.select(TX.field_sensitivity("c").alias("w")).collect()] == [3.0, 0.5, 1.0]


def test_identifier_and_resource_checks(spark):
    df = spark.createDataFrame([("good_name1", "bigquery:p.d.t"), ("1bad", "BigQuery:x"), ("drop table", "gcs:a b")],
                               "i string, r string")
    got = [(r.a, r.b) for r in df.select(TX.is_safe_identifier("i").alias("a"), TX.is_resource_id("r").alias("b")).collect()]
    assert got == [(True, True), (False, False), (False, False)]
    TX.assert_safe_identifiers(["user_id", None, "tenant_id"])
    with pytest.raises(ValueError):
        TX.assert_safe_identifiers(["email; DROP TABLE x"])


def test_retry_classification(spark):
    df = spark.createDataFrame([("Rate limit exceeded",), ("HTTP 500",), ("Unauthorized",), (None,)], "e string")
    assert [r.x for r in df.select(TX.is_retryable("e").alias("x")).collect()] == [True, True, False, False]
