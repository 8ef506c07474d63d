"""Destruction certificates and the per-tenant hash chain (JOIN-06/07, STA-09/19, WIN-07/08, FN-21..24, AGG-11).

Claims are built in parallel with native expressions. The chain itself is a
fold: certificate n embeds the hash of certificate n-1 of the same tenant,
so within a tenant it is sequential by definition. It runs as a
``mapInPandas`` over data hash-partitioned by tenant and sorted inside each
partition: rows stream through the fold batch by batch, so memory per task
is one Arrow batch, not one tenant. Tenants are folded in parallel.
"""

from __future__ import annotations

import base64
import hashlib
import hmac as _hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredline import schemas
from shredline.functions import crypto as C
from shredline.operators import deletion as D
from shredline.operators import lineage as LIN
from shredline.operators.util import iso

# Fixed token header (HMAC-SHA256 signed; RSA signing is not built).
TOKEN_HEADER = '{"alg":"HS256","typ":"JWT"}'
DEFAULT_ISSUER = "shredline key vault"
CHAIN_SCHEMA = ("tenant_id string, sequence long, deletion_request_id string, user_id string, "
                "previous_hash string, certificate_hash string, certificate string")


def b64url_text(s: str) -> str:
    return base64.urlsafe_b64encode(s.encode("utf-8")).decode("ascii").rstrip("=")


ITEMS = "array<struct<system:string,status:string,timestamp:string>>"


def wipe_label() -> Column:
    """FN-21: SUCCEEDED wipe that found nothing → CONFIRMED_ABSENT, else ERASED."""
    return F.when((F.col("records_found") == 0) | (F.col("rows_affected") == 0), "CONFIRMED_ABSENT").otherwise("ERASED")


def lineage_summary(latest_wipes: DataFrame) -> DataFrame:
    """Per request: SUCCEEDED destinations (sorted; the time is NULL where none was recorded), checked and succeeded counts (AGG-11)."""
    w = latest_wipes
    item = F.struct(F.col("destination").alias("system"), wipe_label().alias("status"),
                    iso("updated_at").alias("timestamp"))
    return w.groupBy("deletion_request_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("status") == "SUCCEEDED", item))).alias("_items"),
        F.count(F.lit(1)).alias("destinations_checked"),
        F.count_if(F.col("status") == "SUCCEEDED").alias("destinations_succeeded"))


def eligible(requests: DataFrame, key_registry: DataFrame) -> DataFrame:
    """Requests whose cascade completed and whose user's key is shredded (the issuing gate)."""
    keys = key_registry.where(F.col("status").isin("SHREDDED", "DELETED")).select(
        "tenant_id", "user_id", "shred_at")
    updated = F.col("updated_at") if "updated_at" in requests.columns else F.lit(None).cast("timestamp")
    return (requests.where(F.col("status").isin(*schemas.COMPLETED_REQUEST_STATES))
            .withColumn("request_updated_at", updated).join(keys, ["tenant_id", "user_id"], "inner"))


def claims(requests: DataFrame, key_registry: DataFrame, wipes: DataFrame, events: DataFrame,
           issued_at: Column, issuer: str = DEFAULT_ISSUER, connectors=schemas.CONNECTORS) -> DataFrame:
    """JOIN-06 / FN-23: claims JSON per eligible request (without chain fields).

    Lineage comes only from the request's recorded wipes (latest per
    destination); ghost findings are counted exactly as in the deletion plan. The
    JSON is made by ``to_json``, so ids may hold any character. A key without a
    shred time takes the request's last change, else its creation, as shred date.
    ``connectors`` are the names that are registered.
    """
    el = eligible(requests, key_registry)
    summ = lineage_summary(D.latest_wipes(wipes.join(el.select("deletion_request_id"), "deletion_request_id",
                                                     "left_semi")))
    ghost = LIN.ghost_counts(el.select("tenant_id", "user_id"), events)
    j = el.join(summ, "deletion_request_id", "left").join(ghost, ["tenant_id", "user_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    body = F.struct(
        F.lit(issuer).alias("iss"), F.col("user_id").alias("sub"),
        F.concat(F.lit("cert-"), F.col("deletion_request_id")).alias("jti"), "tenant_id", "user_id",
        "deletion_request_id", F.lit("COMPLETE").alias("key_destruction_status"),
        F.lit("DEK_ERASURE").alias("key_destruction_method"),
        F.lit("CRYPTOGRAPHICALLY UNREADABLE").alias("warehouse_data"),
        iso(F.coalesce("shred_at", "request_updated_at", "created_at")).alias("shred_date"),
        F.coalesce("_items", F.array().cast(ITEMS)).alias("lineage_summary"),
        F.struct(zero("destinations_checked").alias("destinations_checked"),
                 zero("destinations_succeeded").alias("destinations_succeeded"),
                 F.array(*[F.lit(c) for c in sorted(connectors)]).alias("known_destination_types")).alias("lineage_coverage"),
        zero("ghost_findings").alias("ghost_findings"), F.unix_timestamp(issued_at).alias("iat"))
    js = F.to_json(body)
    return j.select("tenant_id", "user_id", "deletion_request_id", "created_at",
                    F.coalesce("destinations_checked", F.lit(0)).alias("destinations_checked"),
                    F.coalesce("destinations_succeeded", F.lit(0)).alias("destinations_succeeded"),
                    js.alias("claims_json"))


# --- STA-09 / WIN-07 chain ---------------------------------------------------------------------

def _sign_and_hash(payload: str, key: bytes) -> tuple[str, str]:
    signing_input = b64url_text(TOKEN_HEADER) + "." + b64url_text(payload)
    sig = _hmac.new(key, signing_input.encode("ascii"), hashlib.sha256).digest()
    token = signing_input + "." + base64.urlsafe_b64encode(sig).decode("ascii").rstrip("=")
    return token, hashlib.sha256(token.encode("ascii")).hexdigest()


def _fold(batches):
    """Per tenant, in order: previous hash → sign → hash. Carries state across Arrow batches."""
    import pandas as pd

    tenant, seq, last = None, 0, None
    for pdf in batches:
        out = {k: [] for k in ("tenant_id", "sequence", "deletion_request_id", "user_id",
                               "previous_hash", "certificate_hash", "certificate")}
        for t, rid, uid, cj, key, hseq, hhash in zip(pdf["tenant_id"], pdf["deletion_request_id"], pdf["user_id"],
                                                     pdf["claims_json"], pdf["sign_key"], pdf["head_sequence"],
                                                     pdf["head_hash"]):
            if t != tenant:
                tenant = t
                seq = 0 if pd.isna(hseq) else int(hseq)
                last = None if (hhash is None or (isinstance(hhash, float) and pd.isna(hhash))) else hhash
            seq += 1
            prev = "null" if last is None else f'"{last}"'
            payload = cj[:-1] + f',"previous_certificate_hash":{prev},"chain_sequence":{seq}}}'
            token, h = _sign_and_hash(payload, bytes(key))
            out["tenant_id"].append(t)
            out["sequence"].append(seq)
            out["deletion_request_id"].append(rid)
            out["user_id"].append(uid)
            out["previous_hash"].append(last)
            out["certificate_hash"].append(h)
            out["certificate"].append(token)
            last = h
        yield pd.DataFrame(out)


def append_chain(claims_df: DataFrame, sign_keys: DataFrame, heads: DataFrame | None = None,
                 partitions: int | None = None) -> DataFrame:
    """STA-09: chain certificates per tenant after the stored head (sequence, last hash).

    Order inside a tenant: request ``created_at``, then id. Runs of a
    later batch pass the heads written by the previous one.
    """
    spark = claims_df.sparkSession
    if heads is None:
        heads = spark.createDataFrame([], "tenant_id string, head_sequence long, head_hash string")
    keys = sign_keys.select("tenant_id", "sign_key")
    x = (claims_df.select("tenant_id", "deletion_request_id", "user_id", "created_at", "claims_json")
         .join(keys, "tenant_id", "left")
         .join(heads.select("tenant_id", "head_sequence", "head_hash"), "tenant_id", "left"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartition(n, "tenant_id").sortWithinPartitions("tenant_id", "created_at", "deletion_request_id")
    return x.mapInPandas(_fold, CHAIN_SCHEMA)


def chain_heads(chain: DataFrame) -> DataFrame:
    """New heads: last (sequence, hash) per tenant (a max_by aggregate, partial before the shuffle)."""
    return chain.groupBy("tenant_id").agg(F.max("sequence").alias("head_sequence"),
                                          F.max_by("certificate_hash", "sequence").alias("head_hash"))


def b64url(binary: Column) -> Column:
    return F.rtrim(F.translate(C.b64(binary), "+/", "-_"), F.lit("="))


def from_b64url(text: Column) -> Column:
    """URL-safe base64 without padding → binary; NULL if malformed."""
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4))))
    return C.unb64(padded)


def sign(signing_input: Column, ipad: Column, opad: Column) -> Column:
    """The signature part of a token, given the key's pads (``crypto.hmac_pads``)."""
    return b64url(F.unhex(C.hmac_sha256_hex(signing_input, ipad, opad)))


#: Claims that must say the same as the entry's columns.
CLAIM_COLUMNS = ("tenant_id", "user_id", "deletion_request_id")

# What is wrong with an entry, in the order in which `problem` names the first.
PROBLEMS = ("HASH_MISMATCH", "MALFORMED", "BAD_SIGNATURE", "CLAIMS_MISMATCH", "FORK", "MISSING_PREDECESSOR", "BROKEN_LINK",
            "HEAD_MISMATCH", "BEYOND_HEAD", "CUT_TAIL")


def verify_chain(chain: DataFrame, sign_keys: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
    """WIN-08: proof of the chain; ``problems`` of every entry (empty: none) and ``problem``, the first of them.

    * HASH_MISMATCH: the stored hash isn't that of the certificate's bytes;
    * MALFORMED: no token of three parts with the fixed header and JSON claims;
    * BAD_SIGNATURE (with ``sign_keys``): not signed by the tenant's key, or the tenant has none;
    * CLAIMS_MISMATCH: the signed claims say another sequence or previous hash than the columns, or
      (with ``sign_keys``) another tenant, user or request;
    * FORK: several entries of one sequence; MISSING_PREDECESSOR, BROKEN_LINK: against the entry before;
    * with ``heads`` (tenant_id, head_sequence, head_hash, stored apart from the chain): HEAD_MISMATCH, entries
      BEYOND_HEAD, and a row of its own for a head that is no longer in the chain (CUT_TAIL).

    Tokens are decoded and signed again in column expressions; links are equi-joins on (tenant,
    sequence) and the hash, so a tenant of any size is verified by all tasks.
    """
    e = chain.select(*CLAIM_COLUMNS, "sequence", "previous_hash", "certificate_hash", "certificate")
    if sign_keys is not None:
        ipad, opad = C.hmac_pads("sign_key")                 # once for each tenant
        e = e.join(sign_keys.select("tenant_id", ipad.alias("_ipad"), opad.alias("_opad")), "tenant_id", "left")
    if heads is not None:
        e = e.join(heads.select("tenant_id", "head_sequence", "head_hash"), "tenant_id", "left")
    counts = chain.groupBy("tenant_id", "sequence").agg(F.count(F.lit(1)).alias("_same"))
    before = counts.select("tenant_id", (F.col("sequence") + 1).alias("sequence"), F.lit(True).alias("_before"))
    link = chain.select("tenant_id", (F.col("sequence") + 1).alias("sequence"), F.col("certificate_hash").alias("previous_hash"),
                        F.lit(True).alias("_linked")).distinct()
    e = (e.join(counts, ["tenant_id", "sequence"]).join(before, ["tenant_id", "sequence"], "left")
         .join(link, ["tenant_id", "sequence", "previous_hash"], "left"))

    part = F.split("certificate", r"\.")
    body = F.decode(from_b64url(F.get(part, F.lit(1))), "UTF-8")
    e = e.withColumns({"_header": F.get(part, F.lit(0)), "_body": body, "_signature": F.get(part, F.lit(2)),
                       "_input": F.substring_index("certificate", ".", 2), "_parts": F.size(part)})
    said = lambda name: F.get_json_object("_body", f"$.{name}")
    first = F.col("sequence") == 1
    whole = (F.col("_parts") == 3) & (F.col("_header") == b64url_text(TOKEN_HEADER)) & said("chain_sequence").isNotNull()
    own = ~(said("chain_sequence").eqNullSafe(F.col("sequence").cast("string"))
            & said("previous_certificate_hash").eqNullSafe(F.col("previous_hash")))
    if sign_keys is not None:
        for c in CLAIM_COLUMNS:
            own = own | ~said(c).eqNullSafe(F.col(c))
    found = {
        "HASH_MISMATCH": ~F.sha2("certificate", 256).eqNullSafe(F.col("certificate_hash")),
        "MALFORMED": ~F.coalesce(whole, F.lit(False)),
        "CLAIMS_MISMATCH": F.coalesce(whole, F.lit(False)) & own,
        "FORK": F.col("_same") > 1,
        "MISSING_PREDECESSOR": ~first & F.col("_before").isNull(),
        "BROKEN_LINK": F.when(first, F.col("previous_hash").isNotNull())
                        .otherwise(F.col("_before").isNotNull() & F.col("_linked").isNull()),
    }
    if sign_keys is not None:
        found["BAD_SIGNATURE"] = ~sign(F.col("_input"), F.col("_ipad"), F.col("_opad")).eqNullSafe(F.col("_signature"))
    if heads is not None:
        at_head = F.col("sequence") == F.col("head_sequence")
        found["HEAD_MISMATCH"] = at_head & ~F.col("certificate_hash").eqNullSafe(F.col("head_hash"))
        found["BEYOND_HEAD"] = F.col("head_sequence").isNull() | (F.col("sequence") > F.col("head_sequence"))
    problems = F.filter(F.array(*[F.when(found[p], p) for p in PROBLEMS if p in found]), lambda p: p.isNotNull())
    out = e.select("tenant_id", "sequence", "deletion_request_id", "certificate_hash", problems.alias("problems"))
    if heads is not None:
        cut = heads.select("tenant_id", F.col("head_sequence").alias("sequence")).join(
            counts, ["tenant_id", "sequence"], "left_anti").where("sequence > 0")
        out = out.unionByName(cut.select("tenant_id", "sequence", F.lit(None).cast("string").alias("deletion_request_id"),
                                         F.lit(None).cast("string").alias("certificate_hash"),
                                         F.array(F.lit("CUT_TAIL")).alias("problems")))
    return out.withColumn("problem", F.get("problems", F.lit(0)))


def by_hash(hashes: DataFrame, chain: DataFrame, requests: DataFrame) -> DataFrame:
    """JOIN-07: certificate hash → chain entry → deletion request."""
    e = chain.select("certificate_hash", "tenant_id", "sequence", "previous_hash", "deletion_request_id", "certificate")
    r = requests.select("deletion_request_id", "user_id", "status")
    return hashes.select("certificate_hash").join(e, "certificate_hash").join(r, "deletion_request_id")


def fetch(users: DataFrame, requests: DataFrame, key_registry: DataFrame, chain: DataFrame,
          claims_df: DataFrame) -> DataFrame:
    """STA-19: per user the stored certificate of the latest completed request, else unchained claims."""
    latest = D.latest_completed(requests).select("tenant_id", "user_id", "deletion_request_id", "status")
    shredded = key_registry.where(F.col("status").isin("SHREDDED", "DELETED")).select("tenant_id", "user_id")
    u = users.select("tenant_id", "user_id").dropDuplicates().join(shredded, ["tenant_id", "user_id"])
    j = (u.join(latest, ["tenant_id", "user_id"])
         .join(chain.select("deletion_request_id", "sequence", "certificate"), "deletion_request_id", "left")
         .join(claims_df.select("deletion_request_id", "claims_json"), "deletion_request_id", "left"))
    stored = (F.col("status") == "CERTIFICATE_ISSUED") & F.col("certificate").isNotNull()
    return j.select("tenant_id", "user_id", "deletion_request_id", stored.alias("stored"),
                    F.when(stored, F.col("sequence")).alias("sequence"),
                    F.when(stored, F.col("certificate")).otherwise(F.col("claims_json")).alias("document"))


def certificate_rows(chain: DataFrame, issued_at: Column) -> DataFrame:
    """SRC-14 layout: one row per certificate with its storage path and that of its hash."""
    folder = F.concat(F.lit("certificates/"), F.col("tenant_id"), F.lit("/"), F.date_format(issued_at, "yyyy/MM/dd"))
    name = F.col("deletion_request_id")
    return chain.select(
        "tenant_id", F.date_format(issued_at, "yyyy-MM-dd").alias("issue_date"), "deletion_request_id", "user_id",
        "sequence", "previous_hash", "certificate_hash", "certificate",
        F.concat(folder, F.lit("/certificate-"), name, F.lit(".json")).alias("path"),
        F.concat(folder, F.lit("/audit-hash-"), name, F.lit(".txt")).alias("hash_path"))
