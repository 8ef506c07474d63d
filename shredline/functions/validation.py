"""Bulk row validation with collected errors (VAL-01..04, VAL-09, VAL-10).

A rule is ``(failure_condition, message)``; ``errors(rules)`` is an
``array<string>`` column with every failing message in rule order (all errors
collected, not only the first). Bad rows go to a rejects table instead of
failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (must equal the reference's validation rules).
USER_ID_PATTERN = r"^[a-zA-Z0-9-_]+$"
USER_ID_MAX = 64
PLAINTEXT_MAX = 10240
DETERMINISTIC_BUNDLE = r"^v\d+:[A-Za-z0-9+/=]+$"
SOURCE_MAX = 128
LINEAGE_CLASSIFICATIONS = ["PII", "ENCRYPTED_ONLY", "UNSTRUCTURED_CACHE", "GHOST_DATA", "AUDIT_TRAIL",
                           "METADATA", "UNKNOWN"]
RETENTION_POLICIES = ["DELETE", "REDACT", "IMMUTABLE"]
# Request validation messages.
MESSAGES = {
    "user_pattern": "{name} must contain only alphanumeric characters, hyphens, and underscores",
    "user_min": "{name} must be at least 1 character",
    "user_max": "{name} must not exceed 64 characters",
    "user_required": "{name} is required",
    "user_alias": "one of userId or user_id is required",
    "plaintext_required": "plaintext is required",
    "plaintext_empty": "Plaintext cannot be empty",
    "plaintext_max": "Plaintext must not exceed 10KB",
    "ciphertext_required": "ciphertext is required",
    "ciphertext_format": "Ciphertext must be in format v{version}:{base64}",
    "source_required": "source is required",
    "source_empty": "Source cannot be empty",
    "source_max": "Source must not exceed 128 characters",
    "destination_required": "destination is required",
    "destination_empty": "Destination cannot be empty",
    "destination_max": "Destination must not exceed 128 characters",
    "classification": "dataClassification must be one of the allowed values",
    "retention": "retentionPolicy must be one of DELETE, REDACT, IMMUTABLE",
    "timestamp": "{name} must be a valid timestamp",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def errors(rules: list[tuple[Column, str]]) -> Column:
    """Array of messages whose condition is true (NULL conditions count as passing)."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(msg)) for cond, msg in rules]))


def user_id_rules(col, required: bool = True, name: str = "userId") -> list[tuple[Column, str]]:
    """VAL-01."""
    c = _c(col)
    rules = [
        (c.isNotNull() & (F.length(c) >= 1) & ~c.rlike(USER_ID_PATTERN),
         MESSAGES["user_pattern"].format(name=name)),
        (c.isNotNull() & (F.length(c) < 1), MESSAGES["user_min"].format(name=name)),
        (c.isNotNull() & (F.length(c) > USER_ID_MAX), MESSAGES["user_max"].format(name=name)),
    ]
    if required:
        rules.insert(0, (c.isNull(), MESSAGES["user_required"].format(name=name)))
    return rules


def plaintext_rules(col) -> list[tuple[Column, str]]:
    """VAL-02."""
    c = _c(col)
    return [
        (c.isNull(), MESSAGES["plaintext_required"]),
        (F.length(c) < 1, MESSAGES["plaintext_empty"]),
        (F.length(c) > PLAINTEXT_MAX, MESSAGES["plaintext_max"]),
    ]


def bundle_rules(col) -> list[tuple[Column, str]]:
    """VAL-03."""
    c = _c(col)
    return [(c.isNull(), MESSAGES["ciphertext_required"]),
            (c.isNotNull() & ~c.rlike(DETERMINISTIC_BUNDLE), MESSAGES["ciphertext_format"])]


def lineage_event_rules(df: DataFrame) -> list[tuple[Column, str]]:
    """VAL-04 over a raw payload table with camel or snake columns (missing ones count as NULL)."""
    def col(*names):
        cs = [F.col(n) for n in names if n in df.columns]
        return F.coalesce(*cs) if len(cs) > 1 else (cs[0] if cs else F.lit(None).cast("string"))

    user = col("userId", "user_id")
    source, dest = col("source"), col("destination")
    cls_ = col("dataClassification", "data_classification")
    ret = col("retentionPolicy", "retention_policy")
    rules = [(user.isNull(), MESSAGES["user_alias"])]
    rules += user_id_rules(user, required=False)
    rules += [
        (source.isNull(), MESSAGES["source_required"]),
        (source.isNotNull() & (F.length(source) < 1), MESSAGES["source_empty"]),
        (F.length(source) > SOURCE_MAX, MESSAGES["source_max"]),
        (dest.isNull(), MESSAGES["destination_required"]),
        (dest.isNotNull() & (F.length(dest) < 1), MESSAGES["destination_empty"]),
        (F.length(dest) > SOURCE_MAX, MESSAGES["destination_max"]),
        (cls_.isNotNull() & ~cls_.isin(*LINEAGE_CLASSIFICATIONS), MESSAGES["classification"]),
        (ret.isNotNull() & ~ret.isin(*RETENTION_POLICIES), MESSAGES["retention"]),
    ]
    return rules


def timestamp_rules(col, name: str = "syncedAt") -> list[tuple[Column, str]]:
    """VAL-09: value must parse as a timestamp."""
    c = _c(col)
    return [(c.isNotNull() & F.try_to_timestamp(c).isNull(), MESSAGES["timestamp"].format(name=name))]


def split_valid(df: DataFrame, rules: list[tuple[Column, str]], keep: list[str] | None = None):
    """VAL-10: (valid rows restricted to known columns, rejects with their error array)."""
    checked = df.withColumn("_errors", errors(rules))
    valid = checked.where(F.size("_errors") == 0).drop("_errors")
    if keep:
        valid = valid.select(*[c for c in keep if c in df.columns])
    rejects = checked.where(F.size("_errors") > 0).withColumnRenamed("_errors", "errors")
    return valid, rejects
