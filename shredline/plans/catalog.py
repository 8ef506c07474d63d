"""Named queries: one Spark plan per operator ID, each with its oracle SQL.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Every query reads the driver tables (through the fixtures) over their whole
extent; oracles compare decrypted text, tokens and hashes, never random
ciphertext.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        QUERIES[name] = (fn, oracle)
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable, str | None]]:
    # Importing the modules fills QUERIES.
    from shredline.plans import (q_crypto, q_registry, q_lineage, q_deletion,  # noqa: F401
                                 q_certificates, q_governance, q_streaming, q_sources)
    return QUERIES
