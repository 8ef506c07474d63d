"""Scalar text helpers: identifiers, resource ids, sensitivity, retry class (FN-12/14/19/20/27)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (must equal the reference's rules).
SAFE_IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
RESOURCE_ID = r"^[a-z]+:[^\s]+$"

# Column-name sensitivity: ordered substring groups and their weights; default 2.
SENSITIVITY_RULES = [
    (["email", "ssn", "social", "dob", "birth", "passport", "tax"], 3.0),
    (["phone", "mobile", "name", "address", "street", "city", "zip", "postal"], 2.0),
    (["ip", "geo", "device", "lat", "lon"], 2.0),
    (["_id", "id", "uuid", "token"], 0.5),
]
DEFAULT_SENSITIVITY = 2.0

# Field classification weights; classifications not listed weigh 1.
FIELD_SENSITIVITY = {
    "DIRECT_IDENTIFIER": 3.0,
    "SENSITIVE": 3.0,
    "CONTACT": 2.0,
    "QUASI_IDENTIFIER": 2.0,
    "BEHAVIORAL": 1.0,
    "SYSTEM_IDENTIFIER": 0.5,
}


def assert_safe_identifiers(names) -> None:
    """FN-19: fail closed on any name that is not a plain identifier (None entries skipped)."""
    for n in names:
        if n is None:
            continue
        if not isinstance(n, str) or not re.match(SAFE_IDENTIFIER, n):
            raise ValueError(f"Unsafe SQL identifier: {n!r}")


def is_safe_identifier(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(SAFE_IDENTIFIER), F.lit(False))


def is_resource_id(col) -> Column:
    """FN-20."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(RESOURCE_ID), F.lit(False))


def column_sensitivity(name) -> Column:
    """FN-12: first matching substring group decides; default 2."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    expr = None
    for parts, w in SENSITIVITY_RULES:
        cond = None
        for p in parts:
            c = F.contains(n, F.lit(p))
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(w)) if expr is None else expr.when(cond, F.lit(w))
    return expr.otherwise(F.lit(DEFAULT_SENSITIVITY))


def field_sensitivity(classification) -> Column:
    c = F.col(classification) if isinstance(classification, str) else classification
    expr = None
    for k, w in FIELD_SENSITIVITY.items():
        expr = F.when(c == k, F.lit(w)) if expr is None else expr.when(c == k, F.lit(w))
    return expr.otherwise(F.lit(1.0))


def is_retryable(error) -> Column:
    """FN-27: retry class of an error text (case-insensitive ``rate limit`` or ``500``)."""
    e = F.lower(F.col(error) if isinstance(error, str) else error)
    return F.coalesce(F.contains(e, F.lit("rate limit")) | F.contains(e, F.lit("500")), F.lit(False))
