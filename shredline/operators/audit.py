"""Audit trail: who declared / modified registry entries and who requested deletions (FN-26, SET-04, SRT-03, QRY-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredline.operators.running import positions

# Fixed paging rules.
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 200


def page_size(raw) -> int:
    """SRT-03: positive numbers are clamped to 200; anything else → 50."""
    try:
        n = float(raw)
    except (TypeError, ValueError):
        return DEFAULT_PAGE_SIZE
    if n != n or n <= 0 or n == float("inf"):
        return DEFAULT_PAGE_SIZE if n != float("inf") else MAX_PAGE_SIZE
    return int(min(n, MAX_PAGE_SIZE))


def registry_events(entries: DataFrame) -> DataFrame:
    """FN-26: DECLARED (declared_by + created_at) and MODIFIED (last_modified_by, updated_at ≠ created_at)."""
    ev = F.array_compact(F.array(
        F.when(F.col("declared_by").isNotNull() & F.col("created_at").isNotNull(),
               F.struct(F.lit("PII_REGISTRY_DECLARED").alias("type"), F.col("declared_by").alias("actor_email"),
                        F.col("created_at").alias("timestamp"))),
        F.when(F.col("last_modified_by").isNotNull() & F.col("updated_at").isNotNull()
               & ~F.col("updated_at").eqNullSafe(F.col("created_at")),
               F.struct(F.lit("PII_REGISTRY_MODIFIED").alias("type"), F.col("last_modified_by").alias("actor_email"),
                        F.col("updated_at").alias("timestamp"))),
    ))
    return (entries.select("resource_id", "tenant_id", F.explode(ev).alias("e"))
            .select(F.col("e.type").alias("type"), "resource_id", F.col("e.actor_email").alias("actor_email"),
                    "tenant_id", F.col("e.timestamp").alias("timestamp")))


def deletion_events(requests: DataFrame) -> DataFrame:
    """FN-26: DELETION_REQUESTED per request with a requester and a creation time."""
    return requests.where(F.col("requested_by").isNotNull() & F.col("created_at").isNotNull()).select(
        F.lit("DELETION_REQUESTED").alias("type"), F.col("user_id").alias("resource_id"),
        F.col("requested_by").alias("actor_email"), "tenant_id", F.col("created_at").alias("timestamp"))


def events(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """SET-04: registry ∪ deletion events."""
    return registry_events(entries).unionByName(deletion_events(requests))


def _ranked(ev: DataFrame, key: str, page, after) -> DataFrame:
    newest = [F.col("timestamp").desc(), *[F.col(c).asc() for c in ("type", "resource_id", "actor_email")]]
    ranked = positions(ev, ["tenant_id", key], newest)
    if page is None:
        return ranked if not after else ranked.where(F.col("rank") > after)
    return ranked.where((F.col("rank") > after) & (F.col("rank") <= after + page_size(page)))


def by_actor(ev: DataFrame, actor: str | None = None, page=None, after: int = 0) -> DataFrame:
    """QRY-09 actor view: every actor's events within a tenant, newest first by ``rank``.

    ``page`` asks for one page of each list (clamped, see ``page_size``), ``after`` is the cursor: the last rank seen.
    """
    return _ranked(ev if actor is None else ev.where(F.col("actor_email") == actor), "actor_email", page, after)


def by_resource(entries: DataFrame, resource_id: str | None = None, page=None, after: int = 0) -> DataFrame:
    """QRY-09 resource view: the registry events of every resource within a tenant, newest first by ``rank``."""
    ev = registry_events(entries)
    return _ranked(ev if resource_id is None else ev.where(F.col("resource_id") == resource_id), "resource_id", page, after)
