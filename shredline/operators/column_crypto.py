"""Deterministic encryption and decryption of whole columns, with their audit events (QRY-12, QRY-13)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredline.functions import crypto as C
from shredline.functions import validation as VAL
from shredline.operators import keys as K

KEYS = ["tenant_id", "user_id"]

# Source, destinations and event types of the audit events.
AUDIT_SOURCE = "key-vault"
ENCRYPTED = ("encryption-audit", "ENCRYPTION_PERFORMED", "ENCRYPT")
DECRYPTED = ("decryption-audit", "DECRYPTION_PERFORMED", "DECRYPT")


@dataclass
class ColumnCrypto:
    rows: DataFrame      # one row for each input row: status_code and the result, or an error
    audit: DataFrame     # one event for each row with status 200; never a plaintext or a ciphertext


def _audit(done: DataFrame, kind: tuple[str, str, str], now: Column, **context: Column) -> DataFrame:
    """Event ids depend on chance: write the events before a second use."""
    destination, event_type, operation = kind
    actor = F.col("analyst_email") if "analyst_email" in done.columns else F.lit(None).cast("string")
    what = F.struct(F.lit(event_type).alias("event_type"), F.lit(operation).alias("operation"),
                    *[c.alias(name) for name, c in context.items()], actor.alias("analystEmail"))
    return done.where(F.col("status_code") == 200).select(
        F.expr("uuid()").alias("event_id"), *KEYS, F.lit(AUDIT_SOURCE).alias("source"), F.lit(destination).alias("destination"),
        now.alias("timestamp"), F.to_json(what, {"ignoreNullFields": "false"}).alias("context"))


def encrypt_column(registry: DataFrame, tenant_keys: DataFrame, rows: DataFrame, now: Column | None = None) -> ColumnCrypto:
    """QRY-12: ``rows`` (tenant_id, user_id, plaintext) under each user's active key: 400 invalid, 404 no key, 200 done.

    Further columns are kept; ``analyst_email``, if there is one, goes into the audit event.
    """
    kv = K.key_versions(registry, tenant_keys)
    j = rows.join(kv, KEYS, "left")
    dek = F.try_element_at("dek_map", F.col("active_dek_id"))
    errs = VAL.errors(VAL.user_id_rules("user_id") + VAL.plaintext_rules("plaintext"))
    code = F.when(F.size(errs) > 0, 400).when(dek.isNull(), 404).otherwise(200)
    done = j.select(
        *rows.columns, code.alias("status_code"),
        F.when(code == 200, C.deterministic_bundle(F.col("active_dek_id"), C.encrypt_deterministic("plaintext", "user_id", dek)))
        .alias("ciphertext"),
        F.when(code == 400, F.array_join(errs, "; ")).when(code == 404, "Key not found or shredded").alias("error"))
    return ColumnCrypto(done, _audit(done, ENCRYPTED, now if now is not None else F.current_timestamp(),
                                     plaintextLength=F.length("plaintext")))


def decrypt_column(registry: DataFrame, tenant_keys: DataFrame, rows: DataFrame, now: Column | None = None) -> ColumnCrypto:
    """QRY-13: bundles ``v{n}:ct`` decrypted with the version they name; 404 no key, 400 bad bundle or tag."""
    kv = K.key_versions(registry, tenant_keys)
    version, body = C.parse_deterministic_bundle(F.col("bundle"))
    j = rows.join(kv.select(*KEYS, "dek_map"), KEYS, "left")
    dek = F.try_element_at("dek_map", version)
    pt = C.decrypt_deterministic(body, F.col("user_id"), dek)
    code = (F.when(version.isNull(), 400).when(F.col("dek_map").isNull() | dek.isNull(), 404)
            .when(pt.isNull(), 400).otherwise(200))
    actor = [c for c in ("analyst_email",) if c in rows.columns]
    done = j.select(*KEYS, *actor, code.alias("status_code"), F.when(code == 200, pt).alias("plaintext"))
    return ColumnCrypto(done, _audit(done, DECRYPTED, now if now is not None else F.current_timestamp()))
