"""Crypto-shred coverage: PROTECTED / PARTIAL / EXPOSED items and the weighted score.

Items are metadata rows (one per declared resource or undeclared finding);
the roll-up is a single conditional aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredline.functions import text as TX
from shredline.operators import policy as P
from shredline.operators.running import positions

STATE_ORDER = {"EXPOSED": 0, "PARTIAL": 1, "PROTECTED": 2}

# Coverage reason texts (wording equals the reference's).
REASONS = {
    "weak": "not key-reversible: ",
    "no_fields": "no fields",
    "strategy": "deletion strategy is {strategy}, not CRYPTO_SHRED",
    "no_user": "no user identity link (userIdColumn) — no per-user key",
    "warn": "policy WARNs",
    "fail": "policy evaluation FAILs",
    "drift": "schema drift vs registry",
    "undeclared": "discovered but undeclared",
}


def entry_weight() -> Column:
    """FN-13: Σ field sensitivity (unknown classification → 1), at least 0.5."""
    total = F.aggregate(F.coalesce(F.col("pii_fields"), F.array()), F.lit(0.0),
                        lambda acc, f: acc + TX.field_sensitivity(f["classification"]))
    return F.greatest(F.lit(0.5), total)


def discovery_weight() -> Column:
    """FN-14: Σ column-name sensitivity, at least 1."""
    total = F.aggregate(F.coalesce(F.col("columns"), F.array().cast("array<string>")), F.lit(0.0),
                        lambda acc, c: acc + TX.column_sensitivity(c))
    return F.greatest(F.lit(1.0), total)


def _shred_safe(f) -> Column:
    return (f["handling"].isin("ENCRYPT", "TOKENIZE")
            | ((f["classification"] == "SYSTEM_IDENTIFIER") & (f["handling"] == "HASH_SURROGATE")))


def classify() -> tuple[Column, Column]:
    """FN-15: (state, reasons) of an evaluated entry (needs ``policy_status``)."""
    fields = F.coalesce(F.col("pii_fields"), F.array())
    weak = F.filter(fields, lambda f: ~_shred_safe(f))
    reversible = (F.size(fields) > 0) & (F.size(weak) == 0)
    weak_text = F.array_join(F.transform(weak, lambda f: F.concat(f["name"], F.lit("="), f["handling"])), ", ")
    reasons = F.array_compact(F.array(
        F.when(~reversible, F.concat(F.lit(REASONS["weak"]),
                                     F.when(F.length(weak_text) > 0, weak_text).otherwise(F.lit(REASONS["no_fields"])))),
        F.when(F.coalesce(F.col("deletion_strategy"), F.lit("")) != "CRYPTO_SHRED",
               F.concat(F.lit(REASONS["strategy"].split("{strategy}")[0]),
                        F.coalesce(F.col("deletion_strategy"), F.lit("undefined")),
                        F.lit(REASONS["strategy"].split("{strategy}")[1]))),
        F.when(F.col("user_id_column").isNull() | (F.col("user_id_column") == ""),
               F.lit(REASONS["no_user"])),
        F.when(F.col("policy_status") == "WARN", F.lit(REASONS["warn"])),
    ))
    fail = F.col("policy_status") == "FAIL"
    state = F.when(fail, "EXPOSED").when(F.size(reasons) == 0, "PROTECTED").otherwise("PARTIAL")
    return state, F.when(fail, F.array(F.lit(REASONS["fail"]))).otherwise(reasons)


def items(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """SET-03: declared entries (classified) and findings that no entry visible to their tenant declares (EXPOSED).

    Entries without a tenant are visible to all: their items come once, with a NULL ``tenant_id``.
    """
    ev = P.evaluate(entries)
    state, reasons = classify()
    declared = ev.select("tenant_id", "resource_id", "system", state.alias("state"), entry_weight().alias("weight"),
                         reasons.alias("reasons"), F.lit(0).alias("kind"))
    own = entries.where("tenant_id is not null").select("tenant_id", "resource_id")
    shared = entries.where("tenant_id is null").select("resource_id")
    und = (findings.join(own, ["tenant_id", "resource_id"], "left_anti").join(shared, "resource_id", "left_anti").select(
        "tenant_id", "resource_id", "system", F.lit("EXPOSED").alias("state"), discovery_weight().alias("weight"),
        F.array(F.when(F.col("registry_status") == "DRIFTED", F.lit(REASONS["drift"]))
                .otherwise(F.lit(REASONS["undeclared"]))).alias("reasons"), F.lit(1).alias("kind")))
    return declared.unionByName(und)


def state_rank() -> Column:
    return F.when(F.col("state") == "EXPOSED", 0).when(F.col("state") == "PARTIAL", 1).otherwise(2)


def ranked_items(it: DataFrame) -> DataFrame:
    """SRT-01: rank within a tenant: EXPOSED, PARTIAL, PROTECTED; then weight descending; ties by kind and resource id."""
    return positions(it, ["tenant_id"], [state_rank(), F.col("weight").desc(), F.col("kind").asc(), F.col("resource_id").asc()])


def report(it: DataFrame) -> DataFrame:
    """AGG-05: per tenant, the counts, weights and score = round(100·(protected + ½·partial)/total); 100 when empty.

    Items of all tenants (NULL tenant) count for each tenant; they have a row of their own too.
    """
    states = ("PROTECTED", "PARTIAL", "EXPOSED")
    sums = [F.count_if(F.col("state") == s).alias(f"n_{s.lower()}") for s in states]
    sums += [F.coalesce(F.sum(F.when(F.col("state") == s, F.col("weight"))), F.lit(0.0)).alias(f"w_{s.lower()}") for s in states]
    by_tenant = it.groupBy("tenant_id").agg(*sums, F.count(F.lit(1)).alias("n_total"), F.sum("weight").alias("w_total"))
    names = [c for c in by_tenant.columns if c != "tenant_id"]
    shared = by_tenant.where("tenant_id is null").select(F.lit(True).alias("_own"), *[F.col(c).alias(f"_{c}") for c in names])
    both = by_tenant.withColumn("_own", F.col("tenant_id").isNotNull()).join(shared, "_own", "left")   # one row
    both = both.select("tenant_id", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0).cast(by_tenant.schema[c].dataType)))
                                      .alias(c) for c in names])
    score = F.when(F.col("w_total") == 0, F.lit(100)).otherwise(
        F.floor((F.col("w_protected") + 0.5 * F.col("w_partial")) / F.col("w_total") * 100 + 0.5))
    return both.withColumn("score", score.cast("int"))
