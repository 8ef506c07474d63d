"""Deletion-request queries (WIN-04/05, STA-06/07/08/17/18, AGG-10, SRT-02, SRC-16, FN-27)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from shredline import schemas
from shredline.operators import connectors as CN
from shredline.operators import deletion as D
from shredline.operators import erasure as ER
from shredline.operators import lineage as LIN
from shredline.operators import redaction as R
from shredline.operators import registry as REG
from shredline.operators.util import iso
from shredline.plans import q_registry as QR
from shredline.plans import scenario as SC
from shredline.plans.catalog import register
from shredline.plans.oracle import duck_iso, with_fixtures
from shredline.plans.q_lineage import HOT_SQL
from shredline.session import ensure_checkpoint_dir
from shredline.sources import fixtures as FX


def requests_state(spark, sf_dir):
    return D.conform(FX.fixture(spark, sf_dir, "deletion_requests"))


def wipes_table(spark, sf_dir):
    return FX.fixture(spark, sf_dir, "wipes").withColumn("rows_affected", F.lit(None).cast("bigint"))


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


MATRIX_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}')" for a, tos in schemas.TRANSITIONS.items() for b in tos) + ") t(from_status, to_status)"

LATEST_WIPES_SQL = """SELECT * FROM wipes QUALIFY row_number() OVER (PARTITION BY deletion_request_id, destination
  ORDER BY updated_at DESC, status DESC, records_found DESC NULLS LAST) = 1"""


# --- WIN-04 / WIN-05 --------------------------------------------------------------------------------

def _latest_sql(states):
    return f"""SELECT tenant_id, user_id, deletion_request_id, status, {duck_iso('created_at')} AS created_at
FROM deletion_requests WHERE status IN {_in(states)}
QUALIFY row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY created_at DESC, deletion_request_id DESC) = 1"""


@register("win04_active_requests", with_fixtures(["deletion_requests"], _latest_sql(schemas.ACTIVE_REQUEST_STATES)))
def active_requests(spark, sf_dir):
    a = D.active_requests(requests_state(spark, sf_dir))
    return a.select("tenant_id", "user_id", "deletion_request_id", "status", iso("created_at").alias("created_at"))


@register("win05_latest_completed", with_fixtures(["deletion_requests"], _latest_sql(schemas.COMPLETED_REQUEST_STATES)))
def latest_completed(spark, sf_dir):
    a = D.latest_completed(requests_state(spark, sf_dir))
    return a.select("tenant_id", "user_id", "deletion_request_id", "status", iso("created_at").alias("created_at"))


# --- STA-06 -----------------------------------------------------------------------------------------------

_BATCH_SQL = """SELECT 'op-' || custkey AS op, tenant_id, user_id FROM users WHERE custkey % 3 = 0
UNION ALL SELECT 'z-' || custkey, tenant_id, user_id FROM users
UNION ALL SELECT 'pair-' || (custkey // 2), tenant_id, user_id FROM users WHERE custkey % 4 >= 2
UNION ALL SELECT deletion_request_id, tenant_id, user_id FROM deletion_requests
UNION ALL SELECT deletion_request_id, tenant_id, user_id || '9' FROM deletion_requests WHERE orderkey % 2 = 0
UNION ALL SELECT 'a-' || deletion_request_id, tenant_id, user_id FROM deletion_requests WHERE orderkey % 5 = 0"""


@register("sta06_create_requests", with_fixtures(["users", "deletion_requests"], """
SELECT op AS operation_id, tenant_id, user_id,
  CASE WHEN verdict = 'refused' THEN NULL WHEN verdict = 'stored' THEN op
       WHEN active_id IS NOT NULL THEN active_id ELSE opener END AS deletion_request_id,
  verdict = 'stored' OR (verdict = 'new' AND NOT (active_id IS NULL AND op = opener)) AS already_existed,
  CASE WHEN verdict = 'refused' THEN 'Operation id belongs to another user or tenant' END AS error
FROM (SELECT j.*, o.opener FROM judged j LEFT JOIN
        (SELECT tenant_id, user_id, min(op) AS opener FROM judged WHERE verdict = 'new' AND active_id IS NULL GROUP BY ALL) o
      USING (tenant_id, user_id))""",
    [("active", _latest_sql(schemas.ACTIVE_REQUEST_STATES)), ("batch", _BATCH_SQL),
     ("holder", """SELECT op, min(tenant_id || chr(1) || user_id) AS who FROM batch
        WHERE op NOT IN (SELECT deletion_request_id FROM deletion_requests) GROUP BY op
      UNION ALL SELECT deletion_request_id, tenant_id || chr(1) || user_id FROM deletion_requests"""),
     ("judged", """SELECT b.op, b.tenant_id, b.user_id, a.deletion_request_id AS active_id,
        CASE WHEN h.who <> b.tenant_id || chr(1) || b.user_id THEN 'refused'
             WHEN b.op IN (SELECT deletion_request_id FROM deletion_requests) THEN 'stored' ELSE 'new' END AS verdict
      FROM batch b JOIN holder h USING (op) LEFT JOIN active a USING (tenant_id, user_id)""")]))
def create_requests(spark, sf_dir):
    """One batch with new ids, one id under two users, finished ids sent again (by their user and by others)."""
    users = FX.fixture(spark, sf_dir, "users")
    reqs = FX.fixture(spark, sf_dir, "deletion_requests")
    by = F.lit("dpo@example.com").alias("requested_by")

    def some(df, op, user="user_id"):
        return df.select(F.expr(op).alias("operation_id"), "tenant_id", F.expr(user).alias("user_id"), by)

    batch = (some(users.where("custkey % 3 = 0"), "concat('op-', custkey)")
             .unionByName(some(users, "concat('z-', custkey)"))
             .unionByName(some(users.where("custkey % 4 >= 2"), "concat('pair-', custkey div 2)"))
             .unionByName(some(reqs, "deletion_request_id"))
             .unionByName(some(reqs.where("orderkey % 2 = 0"), "deletion_request_id", "concat(user_id, '9')"))
             .unionByName(some(reqs.where("orderkey % 5 = 0"), "concat('a-', deletion_request_id)")))
    _state, outcome = D.create(requests_state(spark, sf_dir), batch, FX.ts(FX.NOW_TS))
    return outcome


# --- STA-07 -------------------------------------------------------------------------------------------------

def _moves(spark, sf_dir):
    r = FX.fixture(spark, sf_dir, "deletion_requests")
    first = r.select("deletion_request_id",
                     F.expr("CASE orderkey % 4 WHEN 0 THEN 'KEY_DESTROYED' WHEN 1 THEN 'CASCADE_PENDING' "
                            "WHEN 2 THEN 'CASCADE_COMPLETE' ELSE 'CERTIFICATE_ISSUED' END").alias("to_status"),
                     F.concat(F.lit("mv1-"), F.col("orderkey")).alias("operation_id"),
                     (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("at"))
    second = r.where(F.col("orderkey") % 3 == 0).select(
        "deletion_request_id", F.lit("CASCADE_PARTIAL_FAILURE").alias("to_status"),
        F.concat(F.lit("mv2-"), F.col("orderkey")).alias("operation_id"),
        (F.col("created_at") + F.expr("INTERVAL 2 DAY")).alias("at"))
    return first.unionByName(second)


@register("sta07_advance_requests", with_fixtures(["deletion_requests"], """
SELECT deletion_request_id, tenant_id, user_id, from_status, to_status, accepted FROM (
  SELECT r.deletion_request_id, r.tenant_id, r.user_id, r.status AS from_status, m1.to_status,
         m1.to_status IN (SELECT to_status FROM matrix x WHERE x.from_status = r.status) AS accepted, r.orderkey,
         CASE WHEN m1.to_status IN (SELECT to_status FROM matrix x WHERE x.from_status = r.status)
              THEN m1.to_status ELSE r.status END AS after1
  FROM deletion_requests r JOIN m1 ON m1.orderkey = r.orderkey)
UNION ALL
SELECT deletion_request_id, tenant_id, user_id, after1, 'CASCADE_PARTIAL_FAILURE',
       'CASCADE_PARTIAL_FAILURE' IN (SELECT to_status FROM matrix x WHERE x.from_status = after1)
FROM (SELECT r.deletion_request_id, r.tenant_id, r.user_id, r.orderkey,
         CASE WHEN m1.to_status IN (SELECT to_status FROM matrix x WHERE x.from_status = r.status)
              THEN m1.to_status ELSE r.status END AS after1
      FROM deletion_requests r JOIN m1 ON m1.orderkey = r.orderkey)
WHERE orderkey % 3 = 0""", [("matrix", MATRIX_SQL), ("m1", """SELECT orderkey, CASE orderkey % 4 WHEN 0 THEN 'KEY_DESTROYED'
  WHEN 1 THEN 'CASCADE_PENDING' WHEN 2 THEN 'CASCADE_COMPLETE' ELSE 'CERTIFICATE_ISSUED' END AS to_status
  FROM deletion_requests""")]))
def advance_requests(spark, sf_dir):
    """Two rounds of moves (every request, then every third again); invalid moves rejected."""
    _state, decisions = D.advance(requests_state(spark, sf_dir), _moves(spark, sf_dir))
    return decisions.select("deletion_request_id", "tenant_id", "user_id", "from_status", "to_status", "accepted")


# --- STA-08 / AGG-10 ------------------------------------------------------------------------------------------

@register("sta08_record_wipes", with_fixtures(["wipes", "deletion_requests"], f"""
SELECT deletion_request_id, destination, status, records_found, {duck_iso('updated_at')} AS updated_at
FROM latest WHERE deletion_request_id IN (SELECT deletion_request_id FROM deletion_requests)""",
    [("latest", LATEST_WIPES_SQL)]))
def record_wipes(spark, sf_dir):
    """Wipe outcomes upserted into each request's nested wipe list (latest per destination)."""
    st = D.record_wipes(requests_state(spark, sf_dir), wipes_table(spark, sf_dir))
    w = st.select("deletion_request_id", F.explode("janitor_wipes").alias("w"))
    return w.select("deletion_request_id", "w.destination", "w.status", "w.records_found",
                    iso("w.updated_at").alias("updated_at"))


@register("agg10_cascade_outcome", with_fixtures(["wipes"], """
SELECT deletion_request_id,
  CASE WHEN bool_or(status = 'FAILED') THEN 'CASCADE_PARTIAL_FAILURE' ELSE 'CASCADE_COMPLETE' END AS next_status,
  coalesce(string_agg(CASE WHEN status = 'FAILED' THEN destination END, ',' ORDER BY destination), '') AS failed_destinations,
  count(*) AS destinations
FROM latest GROUP BY deletion_request_id""", [("latest", LATEST_WIPES_SQL)]))
def cascade_outcome(spark, sf_dir):
    out = D.cascade_outcome(D.latest_wipes(wipes_table(spark, sf_dir)))
    return out.select("deletion_request_id", "next_status",
                      F.array_join("failed_destinations", ",").alias("failed_destinations"), "destinations")


# --- STA-17 cascade -------------------------------------------------------------------------------------------

@register("sta17_cascade", with_fixtures(["users", "lineage_events", "deletion_requests", "wipes", "declarations"], """
SELECT r.deletion_request_id, r.tenant_id, r.user_id, CAST(count(p.destination) AS BIGINT) AS n_planned,
  CAST(count(*) FILTER (WHERE l.status = 'FAILED') AS BIGINT) AS n_failed,
  CASE WHEN count(p.destination) = 0 THEN 'CASCADE_COMPLETE'
       WHEN count(*) FILTER (WHERE p.destination IS NOT NULL AND l.status IS NULL) > 0 THEN 'CASCADE_IN_PROGRESS'
       WHEN count(*) FILTER (WHERE l.status = 'FAILED') > 0 THEN 'CASCADE_PARTIAL_FAILURE'
       ELSE 'CASCADE_COMPLETE' END AS next_status
FROM req r
LEFT JOIN planned p ON p.deletion_request_id = r.deletion_request_id
LEFT JOIN latest l ON l.deletion_request_id = p.deletion_request_id AND l.destination = p.destination
GROUP BY r.deletion_request_id, r.tenant_id, r.user_id""",
    [("hot", HOT_SQL), ("latest", LATEST_WIPES_SQL), ("decl_checked", QR.DECL_CHECK_SQL),
     ("manual0", QR.MANUAL_SQL), ("manual", QR.MANUAL_FULL_SQL),
     ("req", "SELECT deletion_request_id, tenant_id, user_id FROM deletion_requests "
             "WHERE status IN ('CASCADE_PENDING', 'CASCADE_IN_PROGRESS')"),
     ("planned", """SELECT DISTINCT * FROM (
        SELECT r.deletion_request_id, d.destination FROM req r
        JOIN users u ON u.tenant_id = r.tenant_id AND u.user_id = r.user_id
        JOIN (SELECT tenant_id, user_id, unnest(destinations) AS destination FROM hot) d
          ON d.tenant_id = r.tenant_id AND d.user_id = r.user_id
        WHERE lower(d.destination) IN ('hubspot', 'salesforce')
        UNION ALL
        SELECT r.deletion_request_id, m.resource_id || '::' || s.strategy FROM req r
        JOIN (SELECT tenant_id, resource_id, unnest(string_split(strategies, ',')) AS strategy FROM manual
              WHERE strategies <> '') m ON m.tenant_id = r.tenant_id
        JOIN (VALUES ('REDACT_IN_PLACE'), ('ENCRYPTED_COPY')) s(strategy) ON s.strategy = m.strategy)""")]))
def cascade(spark, sf_dir):
    """Next status of every request in the cascade: plan (connector wipes + tenant redaction resources) vs outcomes."""
    reqs = requests_state(spark, sf_dir).where(F.col("status").isin("CASCADE_PENDING", "CASCADE_IN_PROGRESS"))
    hot = LIN.add_destinations(SC.build(spark, sf_dir).registry, FX.fixture(spark, sf_dir, "lineage_events"))
    tasks = LIN.cleanup_plan(reqs, hot)
    manual = QR.manual_entries(spark, sf_dir)
    res = (manual.select("tenant_id", "resource_id", F.explode(REG.strategies()).alias("strategy"))
           .where(F.col("strategy").isin("REDACT_IN_PLACE", "ENCRYPTED_COPY")))
    out = D.cascade(reqs, tasks, res, wipes_table(spark, sf_dir))
    return out.select("deletion_request_id", "tenant_id", "user_id", "n_planned", "n_failed", "next_status")


# --- STA-17 with STA-10 / STA-11: the erasure job over stored tables -----------------------------------------------

_PLAN_SQL = """SELECT r.*, t.destination FROM due r JOIN (
  SELECT tenant_id, user_id, unnest(destinations) AS destination FROM hot) t
    ON t.tenant_id = r.tenant_id AND t.user_id = r.user_id
  WHERE t.destination IN ('hubspot', 'salesforce') AND EXISTS (SELECT 1 FROM users u WHERE u.tenant_id = r.tenant_id AND u.user_id = r.user_id)
UNION ALL SELECT due.*, 'bigquery:proj.ds.users::REDACT_IN_PLACE' FROM due
UNION ALL SELECT due.*, 'bigquery:proj.ds.users::ENCRYPTED_COPY' FROM due WHERE tenant_id = 'tenant-1'"""

_RUN_SQL = """SELECT 'request' AS kind, r.deletion_request_id AS key,
  CASE WHEN p.failed THEN 'CASCADE_PARTIAL_FAILURE ' ELSE '' END || CASE WHEN r.orderkey % 7 NOT IN (0, 4, 5) THEN r.status
    WHEN r.custkey % 7 = 0 OR EXISTS (SELECT 1 FROM due d WHERE d.orderkey % 7 = 0 AND d.tenant_id = r.tenant_id AND d.user_id = r.user_id)
    THEN 'CERTIFICATE_ISSUED' ELSE 'CASCADE_COMPLETE' END AS value
FROM (SELECT d.*, CAST(split_part(user_id, '-', 2) AS BIGINT) AS custkey FROM deletion_requests d) r
LEFT JOIN (SELECT deletion_request_id, bool_or(destination = 'salesforce') AS failed FROM plan GROUP BY 1) p USING (deletion_request_id)
UNION ALL
SELECT 'outcome', p.destination || ' ' || p.deletion_request_id,
  'SUCCEEDED ' || CASE WHEN p.destination = 'hubspot' THEN (SELECT count(*) FROM users u WHERE u.tenant_id = p.tenant_id AND u.user_id = p.user_id AND u.custkey % 2 = 0)
                       ELSE (SELECT count(*) FROM users u WHERE u.tenant_id = p.tenant_id AND u.user_id = p.user_id) END
  || CASE WHEN p.destination = 'salesforce' THEN ' after a failure' ELSE '' END
FROM plan p
UNION ALL
SELECT 'bucket', CAST(custkey % 64 AS VARCHAR),
  CASE WHEN bool_or(EXISTS (SELECT 1 FROM due d WHERE d.tenant_id = u.tenant_id AND d.user_id = u.user_id)) THEN 'rewritten' ELSE 'same files' END
FROM users u GROUP BY custkey % 64
UNION ALL
SELECT 'rows', 'bigquery:proj.ds.users', count(*) || ' with email ' ||
  count(*) FILTER (NOT EXISTS (SELECT 1 FROM due d WHERE d.tenant_id = u.tenant_id AND d.user_id = u.user_id)) FROM users u
UNION ALL
SELECT 'rows', 'encrypted copy', CAST(count(*) FILTER (NOT (tenant_id = 'tenant-1'
  AND EXISTS (SELECT 1 FROM due d WHERE d.tenant_id = u.tenant_id AND d.user_id = u.user_id))) AS VARCHAR) FROM users u"""


@register("sta17_erasure_run", with_fixtures(["users", "lineage_events", "deletion_requests"], "SELECT * FROM run", [
    ("hot", HOT_SQL), ("due", "SELECT * FROM deletion_requests WHERE orderkey % 7 IN (0, 4)"), ("plan", _PLAN_SQL), ("run", _RUN_SQL)]))
def erasure_run(spark, sf_dir):
    """The erasure job over all requests and stored tables, twice: one table fails at first and is there for the retry.

    Rows: every request's state (after a first CASCADE_PARTIAL_FAILURE, if any), every planned destination's outcome,
    whether each bucket of the redacted table kept its files, and what the tables hold in the end.
    """
    s = SC.build(spark, sf_dir)
    root = f"{ensure_checkpoint_dir(spark)}/erasure-{uuid.uuid4().hex}"
    rows = s.users.withColumn("bucket", (F.col("custkey") % 64).cast("int"))

    def stored(name, destination, df, fields=None):
        df.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{name}")
        return R.StoredTable(destination, f"{root}/{name}", "bucket", "user_id", "tenant_id", fields)

    def files():
        return (spark.read.parquet(f"{root}/users").select("bucket", F.input_file_name().alias("file")).distinct()
                .groupBy("bucket").agg(F.array_sort(F.collect_set("file")).alias("files")).checkpoint())

    tables = [stored("users", "bigquery:proj.ds.users::REDACT_IN_PLACE", rows, ["email", "phone"]),
              stored("copy", "bigquery:proj.ds.users::ENCRYPTED_COPY", rows),
              stored("hubspot", "hubspot", rows.where("custkey % 2 = 0")),
              R.StoredTable("salesforce", f"{root}/salesforce", "bucket", "user_id", "tenant_id")]        # not there yet
    resources = s.tenant_keys.select("tenant_id", F.lit("bigquery:proj.ds.users").alias("resource_id"), F.explode(
        F.array(F.lit("REDACT_IN_PLACE"), F.when(F.col("tenant_id") == "tenant-1", "ENCRYPTED_COPY"))).alias("strategy")
    ).where("strategy IS NOT NULL")
    events, before = FX.fixture(spark, sf_dir, "lineage_events"), files()
    requests = requests_state(spark, sf_dir)
    one = ER.erase(requests, s.registry, events, resources, [], s.tenant_keys, FX.ts(FX.NOW_TS), stores=tables)
    stored("salesforce", "salesforce", rows)
    two = ER.erase(one.requests, one.key_registry, events, resources, [], s.tenant_keys,
                   FX.ts(FX.NOW_TS) + F.expr("INTERVAL 1 DAY"), one.heads, one.wipes, stores=tables)

    key = F.col("deletion_request_id")
    failed = one.requests.where("status = 'CASCADE_PARTIAL_FAILURE'").select(key, F.lit("CASCADE_PARTIAL_FAILURE ").alias("first"))
    states = two.requests.join(failed, "deletion_request_id", "left").select(
        F.lit("request").alias("kind"), key.alias("key"), F.concat(F.coalesce("first", F.lit("")), "status").alias("value"))
    again = one.wipes.where("status = 'FAILED'").select(key, "destination", F.lit(" after a failure").alias("again"))
    outcomes = D.latest_wipes(two.wipes).join(again, ["deletion_request_id", "destination"], "left").select(
        F.lit("outcome").alias("kind"), F.concat_ws(" ", "destination", key).alias("key"),
        F.concat(F.concat_ws(" ", "status", F.col("rows_affected").cast("string")), F.coalesce("again", F.lit(""))).alias("value"))
    buckets = before.alias("a").join(files().alias("b"), "bucket").select(
        F.lit("bucket").alias("kind"), F.col("bucket").cast("string").alias("key"),
        F.when(F.col("a.files") == F.col("b.files"), "same files").otherwise("rewritten").alias("value"))
    held = spark.read.parquet(f"{root}/users").agg(F.concat(F.count("*"), F.lit(" with email "), F.count("email")).alias("value"))
    copy = spark.read.parquet(f"{root}/copy").agg(F.count("*").cast("string").alias("value"))
    ends = [x.select(F.lit("rows").alias("kind"), F.lit(k).alias("key"), "value")
            for k, x in (("bigquery:proj.ds.users", held), ("encrypted copy", copy))]
    return reduce(lambda a, b: a.unionByName(b), [states, outcomes, buckets, *ends])


# --- STA-18 / SRC-16 / FN-27 -------------------------------------------------------------------------------------

def _attempts(spark, sf_dir):
    """Attempts per task in a total order (line numbers repeat within an order, so ties break on the rest)."""
    from pyspark.sql import Window
    w = FX.fixture(spark, sf_dir, "wipes")
    task = F.concat("deletion_request_id", F.lit("/"), "destination")
    order = Window.partitionBy(task).orderBy("linenumber", "updated_at", "status", "records_found")
    return w.select(task.alias("task_id"),
                    F.row_number().over(order).alias("attempt"), (F.col("status") == "SUCCEEDED").alias("ok"),
                    F.when(F.col("status") == "FAILED",
                           F.when(F.col("linenumber") % 2 == 0, F.lit("HTTP 500 upstream"))
                           .otherwise(F.lit("invalid token"))).alias("error"))


_ATTEMPTS_SQL = """SELECT deletion_request_id || '/' || destination AS task_id, status = 'SUCCEEDED' AS ok,
  CASE WHEN status = 'FAILED' THEN CASE WHEN linenumber % 2 = 0 THEN 'HTTP 500 upstream' ELSE 'invalid token' END END AS error,
  row_number() OVER (PARTITION BY deletion_request_id || '/' || destination
                     ORDER BY linenumber, updated_at, status, records_found) AS n
FROM wipes"""

_TASKS_SQL = """SELECT a.*, min(CASE WHEN ok OR NOT coalesce(contains(lower(error), 'rate limit') OR contains(lower(error), '500'), false)
  THEN n END) OVER (PARTITION BY task_id) AS first_stop FROM attempts a"""

_RESULTS_SQL = """SELECT task_id, CASE WHEN bool_or(ok) THEN 'COMPLETE' ELSE 'FAILED' END AS status, count(*) AS attempts,
  CASE WHEN NOT bool_or(ok) THEN arg_max(error, n) END AS last_error
FROM tasks WHERE n <= 3 AND (first_stop IS NULL OR n <= first_stop) GROUP BY task_id"""


@register("sta18_wipe_attempts", with_fixtures(["wipes"], "SELECT * FROM results",
                                               [("attempts", _ATTEMPTS_SQL), ("tasks", _TASKS_SQL),
                                                ("results", _RESULTS_SQL)]))
def wipe_attempts(spark, sf_dir):
    """Wipe tasks with their attempt history: ≤3 attempts, non-retryable errors stop early."""
    return D.wipe_attempts(_attempts(spark, sf_dir))


@register("src16_dead_letters", with_fixtures(["wipes"], """
SELECT task_id, coalesce(last_error, 'unknown error') AS error, 'ERROR' AS severity, 'janitor' AS source
FROM results WHERE status = 'FAILED'""", [("attempts", _ATTEMPTS_SQL), ("tasks", _TASKS_SQL), ("results", _RESULTS_SQL)]))
def dead_letters(spark, sf_dir):
    dl = D.dead_letters(D.wipe_attempts(_attempts(spark, sf_dir)), FX.ts(FX.NOW_TS))
    return dl.select("task_id", "error", "severity", "source")


# --- SRT-02 ---------------------------------------------------------------------------------------------------------

@register("srt02_requests_by_actor", with_fixtures(["deletion_requests"], f"""
SELECT tenant_id, requested_by, deletion_request_id, {duck_iso('created_at')} AS created_at,
  row_number() OVER (PARTITION BY tenant_id, requested_by ORDER BY created_at DESC, deletion_request_id DESC) AS rank
FROM deletion_requests QUALIFY rank <= 50"""))
def requests_by_actor(spark, sf_dir):
    """First page (50, newest first) of every requester's deletion requests per tenant."""
    r = D.by_requester(requests_state(spark, sf_dir), 50)
    return r.select("tenant_id", "requested_by", "deletion_request_id", iso("created_at").alias("created_at"),
                    F.col("rank").cast("bigint").alias("rank"))


# --- UDF-02 / STA-18: wipes executed by connectors -----------------------------------------------------------------

class _ByUser:
    """A connector of the fixture: every 5th user's wipes fail for good, every 7th user's until the calls run out."""

    def __init__(self, name):
        self.name = name

    def wipe(self, user_id, tenant_id):
        n = int(user_id.rsplit("-", 1)[1])
        if n % 5 == 0:
            return {"status": "FAILED", "error": "HTTP 404"}
        if n % 7 == 0:
            raise RuntimeError("HTTP 500")
        return {"status": "SUCCEEDED", "records_found": n % 3}


@register("udf02_run_wipes", with_fixtures(["deletion_requests"], """
SELECT deletion_request_id, destination,
  CASE WHEN destination = 'fax' OR n % 5 = 0 OR n % 7 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
  CAST(CASE WHEN destination = 'fax' THEN 0 WHEN n % 5 = 0 THEN 1 WHEN n % 7 = 0 THEN 3 ELSE 1 END AS BIGINT) AS attempts,
  CAST(CASE WHEN destination <> 'fax' AND n % 5 <> 0 AND n % 7 <> 0 THEN n % 3 END AS BIGINT) AS records_found,
  CASE WHEN destination = 'fax' THEN 'No connector registered' WHEN n % 5 = 0 THEN 'HTTP 404' WHEN n % 7 = 0 THEN 'HTTP 500' END
    AS error
FROM (SELECT deletion_request_id, CAST(split_part(user_id, '-', 2) AS INTEGER) AS n,
        ['hubspot', 'HubSpot', 'fax'][orderkey % 3 + 1] AS destination FROM deletion_requests)"""))
def run_wipes(spark, sf_dir):
    """A wipe for every deletion request: names in any case, retries, failures for good, an unknown destination."""
    r = FX.fixture(spark, sf_dir, "deletion_requests")
    to = F.element_at(F.array(F.lit("hubspot"), F.lit("HubSpot"), F.lit("fax")), (F.col("orderkey") % 3 + 1).cast("int"))
    out = CN.run_wipes(r.withColumn("destination", to), [_ByUser("hubspot")])
    return out.select("deletion_request_id", "destination", "status", "attempts", "records_found", "error")
