"""Certificate queries (JOIN-06/07, STA-09/19, WIN-07/08, FN-21..24, AGG-11, QRY-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shredline.functions import crypto as C
from shredline.operators import certificates as CERT
from shredline.plans import q_deletion as QD
from shredline.plans import scenario as SC
from shredline.plans.catalog import register
from shredline.plans.oracle import duck_hmac, duck_iso, with_fixtures
from shredline.plans.q_lineage import GHOST_SQL
from shredline.session import ensure_checkpoint_dir
from shredline.sources import fixtures as FX

# --- Spark side -------------------------------------------------------------------------------------


def _claims(spark, sf_dir, s=None):
    s = s or SC.build(spark, sf_dir)
    return CERT.claims(QD.requests_state(spark, sf_dir), s.registry, QD.wipes_table(spark, sf_dir),
                       FX.fixture(spark, sf_dir, "lineage_events"), FX.ts(FX.NOW_TS))


def _chain(spark, sf_dir):
    s = SC.build(spark, sf_dir)
    return CERT.append_chain(_claims(spark, sf_dir, s), s.tenant_keys)


# --- oracle side --------------------------------------------------------------------------------------

def _b64url(x: str) -> str:
    return f"rtrim(replace(replace(to_base64({x}), '+', '-'), '/', '_'), '=')"


_LATEST = f"""SELECT * FROM wipes WHERE deletion_request_id IN (SELECT deletion_request_id FROM el)
QUALIFY row_number() OVER (PARTITION BY deletion_request_id, destination
  ORDER BY updated_at DESC, status DESC, records_found DESC NULLS LAST) = 1"""

_ITEM = ("'{\"system\":\"' || destination || '\",\"status\":\"' || "
         "CASE WHEN records_found = 0 THEN 'CONFIRMED_ABSENT' ELSE 'ERASED' END || '\",\"timestamp\":\"' || "
         + duck_iso("updated_at") + " || '\"}'")

_CLAIMS = f"""SELECT el.deletion_request_id, el.tenant_id, el.user_id, el.created_at,
  coalesce(s.checked, 0) AS destinations_checked, coalesce(s.succeeded, 0) AS destinations_succeeded,
  '{{"iss":"{CERT.DEFAULT_ISSUER}","sub":"' || el.user_id || '","jti":"cert-' || el.deletion_request_id || '","tenant_id":"' || el.tenant_id || '","user_id":"' || el.user_id
  || '","deletion_request_id":"' || el.deletion_request_id
  || '","key_destruction_status":"COMPLETE","key_destruction_method":"DEK_ERASURE"'
  || ',"warehouse_data":"CRYPTOGRAPHICALLY UNREADABLE","shred_date":"' || {duck_iso("TIMESTAMP '" + FX.SHRED_TS + "'")}
  || '","lineage_summary":[' || coalesce(s.items, '') || '],"lineage_coverage":{{"destinations_checked":'
  || CAST(coalesce(s.checked, 0) AS VARCHAR) || ',"destinations_succeeded":' || CAST(coalesce(s.succeeded, 0) AS VARCHAR)
  || ',"known_destination_types":["hubspot","salesforce"]}},"ghost_findings":'
  || CAST(coalesce(o.n, 0) + coalesce(sh.n, 0) AS VARCHAR) || ',"iat":'
  || CAST(CAST(epoch(TIMESTAMP '{FX.NOW_TS}') AS BIGINT) AS VARCHAR) || '}}'
  AS claims_json
FROM el
LEFT JOIN (SELECT deletion_request_id, count(*) AS checked, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded,
             string_agg(CASE WHEN status = 'SUCCEEDED' THEN {_ITEM} END, ',' ORDER BY CASE WHEN status = 'SUCCEEDED'
               THEN {_ITEM} END) AS items
           FROM latest GROUP BY deletion_request_id) s ON s.deletion_request_id = el.deletion_request_id
LEFT JOIN (SELECT tenant_id, user_id, count(*) AS n FROM ghost WHERE user_id <> 'UNKNOWN' GROUP BY 1, 2) o
  ON o.tenant_id = el.tenant_id AND o.user_id = el.user_id
LEFT JOIN (SELECT tenant_id, count(*) AS n FROM ghost WHERE user_id = 'UNKNOWN' GROUP BY 1) sh ON sh.tenant_id = el.tenant_id"""

_EL = """SELECT r.deletion_request_id, r.tenant_id, r.user_id, r.created_at, r.status FROM deletion_requests r
JOIN users u ON u.tenant_id = r.tenant_id AND u.user_id = r.user_id
WHERE r.status IN ('CASCADE_COMPLETE', 'CERTIFICATE_ISSUED') AND u.custkey % 7 = 0"""


def _chain_step(acc: str, y: str) -> str:
    seq = f"split_part({y}, '|', 1)"
    ten = f"split_part({y}, '|', 2)"
    cl = f"substr({y}, length({seq}) + length({ten}) + 3)"
    prev = f"(CASE WHEN {acc} = '' THEN 'null' ELSE '\"' || {acc} || '\"' END)"
    payload = (f"(left({cl}, length({cl}) - 1) || ',\"previous_certificate_hash\":' || {prev} "
               f"|| ',\"chain_sequence\":' || {seq} || '}}')")
    signing_input = f"('{CERT.b64url_text(CERT.TOKEN_HEADER)}.' || {_b64url(f'encode({payload})')})"
    sig = duck_hmac(f"unhex(sha256('sign-' || {ten}))", signing_input)
    token = f"({signing_input} || '.' || {_b64url(f'unhex({sig})')})"
    return f"sha256({token})"


_CERTS = """SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, deletion_request_id) AS seq FROM claims"""
_LISTS = "SELECT tenant_id, list(CAST(seq AS VARCHAR) || '|' || tenant_id || '|' || claims_json ORDER BY seq) AS l FROM certs GROUP BY tenant_id"
_CHAIN = f"""SELECT c.tenant_id, c.seq AS sequence, c.deletion_request_id, c.user_id,
  list_reduce(list_prepend('', l.l[1:c.seq]), lambda acc, y: {_chain_step('acc', 'y')}) AS certificate_hash
FROM certs c JOIN lists l ON l.tenant_id = c.tenant_id"""
_CHAIN_FULL = """SELECT *, lag(certificate_hash) OVER (PARTITION BY tenant_id ORDER BY sequence) AS previous_hash FROM chain0"""

_CTES = [("el", _EL), ("latest", _LATEST), ("ghost", GHOST_SQL), ("claims", _CLAIMS)]
_CHAIN_CTES = _CTES + [("certs", _CERTS), ("lists", _LISTS), ("chain0", _CHAIN), ("chain", _CHAIN_FULL)]
_FIX = ["users", "lineage_events", "deletion_requests", "wipes"]


# --- queries -------------------------------------------------------------------------------------------

@register("fn23_certificate_claims", with_fixtures(_FIX, """
SELECT deletion_request_id, tenant_id, user_id, claims_json FROM claims""", _CTES))
def certificate_claims(spark, sf_dir):
    """Claims of every request whose cascade completed and whose user's key is shredded."""
    return _claims(spark, sf_dir).select("deletion_request_id", "tenant_id", "user_id", "claims_json")


@register("agg11_certificate_coverage", with_fixtures(_FIX, """
SELECT deletion_request_id, destinations_checked, destinations_succeeded FROM claims""", _CTES))
def certificate_coverage(spark, sf_dir):
    c = _claims(spark, sf_dir)
    return c.select("deletion_request_id", F.col("destinations_checked").cast("bigint").alias("destinations_checked"),
                    F.col("destinations_succeeded").cast("bigint").alias("destinations_succeeded"))


@register("fn21_wipe_labels", with_fixtures(_FIX, """
SELECT deletion_request_id, destination, CASE WHEN records_found = 0 THEN 'CONFIRMED_ABSENT' ELSE 'ERASED' END AS label
FROM latest WHERE status = 'SUCCEEDED'""", _CTES))
def wipe_labels(spark, sf_dir):
    s = SC.build(spark, sf_dir)
    from shredline.operators import deletion as D
    el = CERT.eligible(QD.requests_state(spark, sf_dir), s.registry).select("deletion_request_id")
    lw = D.latest_wipes(QD.wipes_table(spark, sf_dir).join(el, "deletion_request_id", "left_semi"))
    return lw.where(F.col("status") == "SUCCEEDED").select("deletion_request_id", "destination",
                                                          CERT.wipe_label().alias("label"))


@register("qry11_issue_certificates", with_fixtures(_FIX, """
SELECT tenant_id, sequence, deletion_request_id, previous_hash, certificate_hash FROM chain""", _CHAIN_CTES))
def issue_certificates(spark, sf_dir):
    """Sign and chain a certificate for every eligible request; per-tenant chains start at sequence 1."""
    return _chain(spark, sf_dir).select("tenant_id", "sequence", "deletion_request_id", "previous_hash",
                                        "certificate_hash")


@register("win08_verify_chain", with_fixtures(_FIX, """
SELECT tenant_id, count(*) AS n_certificates, CAST(0 AS BIGINT) AS n_problems, max(sequence) AS head_sequence,
  arg_max(certificate_hash, sequence) AS head_hash
FROM chain GROUP BY tenant_id""", _CHAIN_CTES))
def verify_chain(spark, sf_dir):
    """Verify every chain link; report per tenant (a clean chain has no problems)."""
    ensure_checkpoint_dir(spark)
    chain = _chain(spark, sf_dir).checkpoint()
    heads = CERT.chain_heads(chain)
    v = CERT.verify_chain(chain, FX.tenant_keys(FX.fixture(spark, sf_dir, "users")), heads)
    agg = v.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_certificates"),
                                     F.count("problem").alias("n_problems"))
    return agg.join(heads, "tenant_id").select("tenant_id", "n_certificates", "n_problems",
                                               F.col("head_sequence").alias("head_sequence"), "head_hash")


_BROKEN = """SELECT 'tenant-0' AS tenant_id, max(seq) AS sequence, 'BAD_SIGNATURE,CLAIMS_MISMATCH,HEAD_MISMATCH' AS problems
FROM certs WHERE tenant_id = 'tenant-0'
UNION ALL SELECT 'tenant-1', 2, 'CLAIMS_MISMATCH'
UNION ALL SELECT 'tenant-1', max(seq), 'CUT_TAIL' FROM certs WHERE tenant_id = 'tenant-1'
UNION ALL SELECT 'tenant-2', 5, 'FORK' UNION ALL SELECT 'tenant-2', 5, 'BROKEN_LINK,CLAIMS_MISMATCH,FORK'
UNION ALL SELECT 'tenant-2', 9, 'MISSING_PREDECESSOR'
UNION ALL SELECT 'tenant-2', max(seq) + 1, 'BAD_SIGNATURE,BEYOND_HEAD,HASH_MISMATCH,MALFORMED' FROM certs WHERE tenant_id = 'tenant-2'"""


@register("win08_broken_chains", with_fixtures(_FIX, "SELECT tenant_id, CAST(sequence AS BIGINT) AS sequence, problems FROM broken",
                                               _CTES + [("certs", _CERTS), ("broken", _BROKEN)]))
def broken_chains(spark, sf_dir):
    """Every issued chain verified against its stored head after tampering.

    tenant-0: the last certificate is signed by another key, for another user, its hash made to fit;
    tenant-1: an entry names another request, the last three entries are gone;
    tenant-2: a second entry 5 that follows entry 2, entry 8 is gone, an entry without a token beyond the head.
    """
    ensure_checkpoint_dir(spark)
    chain = _chain(spark, sf_dir).checkpoint()
    keys = FX.tenant_keys(FX.fixture(spark, sf_dir, "users"))
    heads = CERT.chain_heads(chain)
    t, n, last = F.col("tenant_id"), F.col("sequence"), F.col("head_sequence")
    c = chain.join(heads.select("tenant_id", "head_sequence"), "tenant_id").withColumn(
        "forger", F.unhex(F.sha2(F.lit("forger"), 256)))
    body = F.decode(CERT.from_b64url(F.get(F.split("certificate", r"\."), F.lit(1))), "UTF-8")
    other = F.concat(F.lit(CERT.b64url_text(CERT.TOKEN_HEADER) + "."), CERT.b64url(F.encode(
        F.replace(body, F.concat(F.lit('"user_id":"'), F.col("user_id")), F.lit('"user_id":"nobody')), "UTF-8")))
    forged = c.withColumn("certificate", F.when((t == "tenant-0") & (n == last), F.concat(
        other, F.lit("."), CERT.sign(other, *C.hmac_pads("forger")))).otherwise(F.col("certificate")))
    forged = forged.withColumn("certificate_hash", F.sha2("certificate", 256)).withColumn(
        "deletion_request_id", F.when((t == "tenant-1") & (n == 2), F.lit("req-other")).otherwise(F.col("deletion_request_id")))
    kept = forged.where(~((t == "tenant-1") & (n > last - 3)) & ~((t == "tenant-2") & (n == 8))).select(*chain.columns)
    second = c.where((t == "tenant-2") & (n == 3)).withColumn("sequence", F.lit(5).cast("long")).select(*chain.columns)
    beyond = c.where((t == "tenant-2") & (n == last)).select(
        t, (n + 1).alias("sequence"), "deletion_request_id", "user_id", F.col("certificate_hash").alias("previous_hash"),
        F.lit("none").alias("certificate_hash"), F.lit("not.a.certificate").alias("certificate"))
    found = CERT.verify_chain(kept.unionByName(second).unionByName(beyond), keys, heads).where("problem IS NOT NULL")
    return found.select("tenant_id", "sequence", F.array_join(F.array_sort("problems"), ",").alias("problems"))


@register("join07_certificate_by_hash", with_fixtures(_FIX, """
SELECT c.certificate_hash, c.deletion_request_id, r.user_id, c.tenant_id, c.sequence, r.status
FROM chain c JOIN deletion_requests r ON r.deletion_request_id = c.deletion_request_id""", _CHAIN_CTES))
def certificate_by_hash(spark, sf_dir):
    """Look every issued hash up: chain entry → deletion request."""
    chain = _chain(spark, sf_dir)
    hits = CERT.by_hash(chain.select("certificate_hash"), chain, QD.requests_state(spark, sf_dir))
    return hits.select("certificate_hash", "deletion_request_id", "user_id", "tenant_id", "sequence", "status")


@register("sta19_fetch_certificate", with_fixtures(_FIX, """
SELECT l.tenant_id, l.user_id, l.deletion_request_id, (l.status = 'CERTIFICATE_ISSUED') AS stored,
  CASE WHEN l.status = 'CERTIFICATE_ISSUED' THEN c.sequence END AS sequence
FROM (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY tenant_id, user_id
      ORDER BY created_at DESC, deletion_request_id DESC) = 1) l
LEFT JOIN chain c ON c.deletion_request_id = l.deletion_request_id""", _CHAIN_CTES))
def fetch_certificate(spark, sf_dir):
    """Per shredded user: the stored certificate if issued, else unchained on-demand claims."""
    s = SC.build(spark, sf_dir)
    claims = _claims(spark, sf_dir, s)
    chain = CERT.append_chain(claims, s.tenant_keys)
    f = CERT.fetch(s.users, QD.requests_state(spark, sf_dir), s.registry, chain, claims)
    return f.select("tenant_id", "user_id", "deletion_request_id", "stored", "sequence")
