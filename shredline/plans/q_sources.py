"""Queries over sources and sinks (SRC-01..04, SRC-07, SRC-09, SRC-11, SRC-14/15, SRC-19, SET-02, UDF-03, STA-19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shredline.operators import certificates as CERT
from shredline.plans import q_certificates as QC
from shredline.plans import q_deletion as QD
from shredline.plans import q_registry as QR
from shredline.plans import q_streaming as QST
from shredline.plans import scenario as SC
from shredline.plans.catalog import register
from shredline.plans.oracle import with_fixtures
from shredline.sources import fixtures as FX
from shredline.sources import registry_loader as RL
from shredline.sources import sinks
from shredline.sources import tables as TB
from shredline.sources.tables import read_table
from shredline.streaming import ingest as ING
from shredline.streaming.sources import scratch, stream_table

#: Resources of the second warehouse: those whose layer number is odd (read off the name's end, in both engines).
_ODD = "CAST(regexp_extract(resource_id, '([0-9]+)$', 1) AS bigint) % 2 = 1"


@register("src19_registry_load", with_fixtures(["registry_rows", "field_lineage", "lineage_events", "declarations"], f"""
SELECT s.scope, s.resource_id, s.owner_connector, s.registry_version, coalesce(f.n, 0) AS n_fields,
  CASE WHEN s.owner_connector = 'dbt' AND NOT ({_ODD.replace("resource_id", "s.resource_id")}) THEN coalesce(l.n, 0) ELSE 0 END AS n_downstream
FROM reg s
LEFT JOIN (SELECT resource_id, count(*) AS n FROM registry_rows GROUP BY 1) f
  ON f.resource_id = s.resource_id AND s.owner_connector = 'dbt'
LEFT JOIN (SELECT source_resource_id AS resource_id, count(*) AS n FROM field_lineage GROUP BY 1) l
  ON l.resource_id = s.resource_id AND s.owner_connector = 'dbt'""",
    [("decl_checked", QR.DECL_CHECK_SQL), ("manual0", QR.MANUAL_SQL), ("reg", QR._COMPOSE_SQL)]))
def registry_load(spark, sf_dir):
    """The registry as a job loads it at its start: two warehouses, stored declarations, a slice that isn't there.

    The first warehouse has flat rows and field lineage; the second upper-cases its columns and has no
    lineage table; the declarations are a stored snapshot. Each is a loader.
    """
    root = scratch(spark, "registry")
    rows, lineage = (FX.fixture(spark, sf_dir, n) for n in ("registry_rows", "field_lineage"))
    rows.where(f"NOT ({_ODD})").write.parquet(f"{root}/first/rows")
    lineage.write.parquet(f"{root}/first/lineage")
    second = rows.where(_ODD)
    second.toDF(*[c.upper() for c in second.columns]).write.parquet(f"{root}/second/rows")
    QR.manual_entries(spark, sf_dir).write.parquet(f"{root}/manual")
    connector = QR.connector_registry(spark, sf_dir)
    loaded = RL.load_registry(
        spark, connector=lambda _spark: connector,
        dbt=[RL.dbt_loader(f"{root}/first/rows", f"{root}/first/lineage"), RL.dbt_loader(f"{root}/second/rows", f"{root}/second/lineage"),
             RL.dbt_loader(f"{root}/third/rows", f"{root}/third/lineage")],
        manual=RL.table_loader(f"{root}/manual"))
    dbt = F.col("owner_connector") == "dbt"
    traced = F.size(F.filter("evidence_pointers", lambda e: e.startswith("lineage:")))
    return loaded.select(
        F.coalesce("tenant_id", F.lit("*")).alias("scope"), "resource_id", "owner_connector", "registry_version",
        F.when(dbt, F.size("pii_fields")).otherwise(0).cast("long").alias("n_fields"),
        F.when(dbt, traced).otherwise(0).cast("long").alias("n_downstream"))


@register("src09_resource_ids", with_fixtures(["declarations"], r"""
SELECT decl_id, regexp_extract(resource_id, '^([a-z]+):([^.]+)\.([^.]+)\.(.+)$', 1) AS system,
  regexp_extract(resource_id, '^([a-z]+):([^.]+)\.([^.]+)\.(.+)$', 2) AS project,
  regexp_extract(resource_id, '^([a-z]+):([^.]+)\.([^.]+)\.(.+)$', 3) AS dataset,
  regexp_extract(resource_id, '^([a-z]+):([^.]+)\.([^.]+)\.(.+)$', 4) AS "table" FROM declarations"""))
def resource_ids(spark, sf_dir):
    """Every declared resource id resolved to its source table; parts are empty where the id has another form."""
    d = FX.fixture(spark, sf_dir, "declarations")
    return d.select("decl_id", TB.parse_resource_id(F.col("resource_id")).alias("p")).select("decl_id", "p.*")


@register("src11_table_types", with_fixtures(["declarations"], """
SELECT DISTINCT t AS "table", CASE WHEN t LIKE 'contacts%' THEN 'VIEW' ELSE 'MISSING' END AS table_type
FROM (SELECT regexp_extract(resource_id, '^([a-z]+):([^.]+)[.]([^.]+)[.](.+)$', 4) AS t FROM declarations) WHERE t <> ''"""))
def table_types(spark, sf_dir):
    """Every declared table looked up in the catalogue, where the contact tables are views and the others aren't there."""
    names = (FX.fixture(spark, sf_dir, "declarations").select(TB.parse_resource_id(F.col("resource_id"))["table"].alias("table"))
             .where("table <> ''").distinct())
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    for r in names.where(F.col("table").startswith("contacts")).collect():            # the declared tables' names
        customer.createOrReplaceTempView(r["table"])
    return TB.table_types(names)


@register("src14_certificate_store", with_fixtures(QC._FIX, """
SELECT tenant_id, deletion_request_id, certificate_hash, certificate_hash AS rehashed,
  'certificates/' || tenant_id || '/2026/06/01/certificate-' || deletion_request_id || '.json' AS path,
  'certificates/' || tenant_id || '/2026/06/01/audit-hash-' || deletion_request_id || '.txt' AS hash_path,
  previous_hash, sequence FROM chain""", QC._CHAIN_CTES))
def certificate_store(spark, sf_dir):
    """Every issued certificate stored beside its hash and read back by its path: the same bytes."""
    root = scratch(spark, "certificates")
    rows = CERT.certificate_rows(QC._chain(spark, sf_dir), FX.ts(FX.NOW_TS)).checkpoint()
    sinks.store_certificates(rows, root)
    back = sinks.read_certificates(spark, root, rows.select("path"))
    doc = F.from_json("document", "previous_hash string, chain_sequence long")
    return back.select("tenant_id", "deletion_request_id", "certificate_hash", F.sha2("certificate", 256).alias("rehashed"), "path",
                       "hash_path", doc["previous_hash"].alias("previous_hash"), doc["chain_sequence"].alias("sequence"))


@register("sta19_certificate_documents", with_fixtures(QC._FIX, """
SELECT l.tenant_id, l.user_id, l.deletion_request_id,
  CASE WHEN l.status = 'CERTIFICATE_ISSUED' THEN c.certificate_hash ELSE sha256(m.claims_json) END AS document_sha256
FROM (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY tenant_id, user_id
      ORDER BY created_at DESC, deletion_request_id DESC) = 1) l
LEFT JOIN chain c ON c.deletion_request_id = l.deletion_request_id
LEFT JOIN claims m ON m.deletion_request_id = l.deletion_request_id""", QC._CHAIN_CTES))
def certificate_documents(spark, sf_dir):
    """The document itself: the stored certificate's bytes where one is issued, else the claims made on demand."""
    s = SC.build(spark, sf_dir)
    claims = QC._claims(spark, sf_dir, s)
    f = CERT.fetch(s.users, QD.requests_state(spark, sf_dir), s.registry, CERT.append_chain(claims, s.tenant_keys), claims)
    return f.select("tenant_id", "user_id", "deletion_request_id", F.sha2("document", 256).alias("document_sha256"))


@register("src07_quarantine", """
SELECT 'quarantine' AS place, user_id, source, destination FROM (SELECT 'u' || user_id AS user_id, event_type AS source,
  'store-' || (event_id % 7) AS destination FROM events WHERE user_id % 13 <> 0 AND event_id % 97 <> 0)
UNION ALL SELECT 'rejects', CASE WHEN user_id % 13 = 0 THEN 'bad user!' ELSE 'u' || user_id END, event_type, 'store-' || (event_id % 7)
FROM events WHERE user_id % 13 = 0 OR event_id % 97 = 0""")
def quarantine(spark, sf_dir):
    """A stream whose event sink fails: every normalised event lands in the quarantine folder, every reject aside, nothing is lost."""
    root = scratch(spark, "quarantine")
    blocked = f"{root}/events"
    spark.createDataFrame([("taken",)], "value string").coalesce(1).write.text(blocked)
    q = ING.ingest_lineage(QST._payloads(stream_table(spark, sf_dir, "events")), root, f"{root}/checkpoint",
                           events=f"{blocked}/_SUCCESS")            # a file: nothing can be written below it
    q.awaitTermination()
    cols = ["user_id", "source", "destination"]
    return (spark.read.json(f"{root}/quarantine").select(F.lit("quarantine").alias("place"), *cols)
            .unionByName(spark.read.parquet(f"{root}/rejects").select(F.lit("rejects").alias("place"), *cols)))
