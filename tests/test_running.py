import random

from pyspark.sql import functions as F

from shredline.operators import coverage as COV
from shredline.operators import running as RUN


def _rows(spark, n=900):
    r = random.Random(7)
    rows = [("hot" if i % 3 == 0 else r.choice(["a", "b", None, "c"]), r.randrange(50), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, x int, id long")


def test_running_values_equal_a_window(spark):
    rows, df = _rows(spark)
    order = [F.col("x").desc(), F.col("id").asc()]
    got = {r.id: r for r in RUN.running(RUN.spread(df, ["k"], order, 7), ["k"], order, {
        "n": ("count", F.lit(1)), "s": ("sum", F.col("id")), "z": ("bit_xor", F.col("id")),
        "hi": ("max", F.col("id")), "lo": ("min", F.col("id"))}).collect()}
    assert len(got) == len(rows)
    for key in {k for k, _, _ in rows}:
        n = s = z = 0
        hi, lo = -1, 10**9
        for _, _, i in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])):
            n, s, z, hi, lo = n + 1, s + i, z ^ i, max(hi, i), min(lo, i)
            assert (got[i].n, got[i].s, got[i].z, got[i].hi, got[i].lo) == (n, s, z, hi, lo)


def test_no_partition_holds_a_hot_key(spark):
    _, df = _rows(spark)
    spread = RUN.spread(df, ["k"], [F.col("x").asc(), F.col("id").asc()], 12)
    most = spread.where("k = 'hot'").groupBy("_part").count().agg(F.max("count")).first()[0]
    assert most < 150 and spread.where("k = 'hot'").select("_part").distinct().count() >= 3      # of 300


def test_ranks_of_a_tenant_that_holds_a_third(spark):
    rows = [("hot" if i % 3 == 0 else f"t{i % 5}", f"r{i:04}", ["EXPOSED", "PARTIAL", "PROTECTED"][i % 7 % 3], float(i % 4), 1)
            for i in range(600)]
    df = spark.createDataFrame(rows, "tenant_id string, resource_id string, state string, weight double, kind int")
    got = {(r.tenant_id, r.resource_id): r["rank"] for r in COV.ranked_items(df).collect()}
    level = {"EXPOSED": 0, "PARTIAL": 1, "PROTECTED": 2}
    for t in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (level[r[2]], -r[3], r[4], r[1]))
        assert [got[t, r[1]] for r in own] == list(range(1, len(own) + 1))


def test_empty_table_has_no_positions(spark):
    _, df = _rows(spark)
    assert RUN.positions(df.limit(0), ["k"], [F.col("x").asc()]).count() == 0
