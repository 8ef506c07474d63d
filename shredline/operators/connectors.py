"""Wipe connectors (UDF-02, STA-18 execution).

A connector is any object with a lower-case ``name`` and
``wipe(user_id, tenant_id) -> dict`` returning ``status`` ('SUCCEEDED' /
'FAILED'), ``records_found`` and optionally ``error`` / ``retryable``. The
calls run on executors through ``mapInPandas`` over the task table — one
call per task, which is the external API's own granularity — with at most
three attempts per task. Real SaaS clients are not part of this package;
tests use a table-backed fake.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from shredline.operators.deletion import RETRY_LIMIT

RESULT_SCHEMA = ("deletion_request_id string, tenant_id string, user_id string, destination string, "
                 "status string, attempts long, records_found long, error string")


class WipeConnector(Protocol):
    name: str

    def wipe(self, user_id: str, tenant_id: str) -> dict: ...


def _retryable(result: dict) -> bool:
    if "retryable" in result and result["retryable"] is not None:
        return bool(result["retryable"])
    e = (result.get("error") or "").lower()
    return "rate limit" in e or "500" in e


def run_wipes(tasks: DataFrame, connectors: list[WipeConnector], max_attempts: int = RETRY_LIMIT) -> DataFrame:
    """Execute every (deletion_request_id, tenant_id, user_id, destination) task with its connector.

    Unknown destinations fail without a call; exceptions count as failed
    attempts; non-retryable failures stop early.
    """
    registry = {c.name.lower(): c for c in connectors}

    def run(batches):
        for pdf in batches:
            out = []
            for rid, tenant, user, dest in zip(pdf["deletion_request_id"], pdf["tenant_id"], pdf["user_id"],
                                               pdf["destination"]):
                conn = registry.get(str(dest).lower())
                if conn is None:
                    out.append((rid, tenant, user, dest, "FAILED", 0, None, "No connector registered"))
                    continue
                attempts, result = 0, {"status": "FAILED", "error": "not attempted"}
                while attempts < max_attempts:
                    attempts += 1
                    try:
                        result = conn.wipe(user, tenant) or {}
                    except Exception as exc:  # a throw is a failed attempt
                        result = {"status": "FAILED", "error": str(exc)}
                    if result.get("status") == "SUCCEEDED" or not _retryable(result):
                        break
                ok = result.get("status") == "SUCCEEDED"
                out.append((rid, tenant, user, dest, "SUCCEEDED" if ok else "FAILED", attempts,
                            result.get("records_found"), None if ok else result.get("error")))
            yield pd.DataFrame(out, columns=["deletion_request_id", "tenant_id", "user_id", "destination", "status",
                                             "attempts", "records_found", "error"])

    return tasks.select("deletion_request_id", "tenant_id", "user_id", "destination").mapInPandas(run, RESULT_SCHEMA)


class TableConnector:
    """Fake connector answering from a dict {(tenant, user): result} (for tests and dry runs)."""

    def __init__(self, name: str, answers: dict, default: dict | None = None):
        self.name = name
        self.answers = answers
        self.default = default or {"status": "SUCCEEDED", "records_found": 0}

    def wipe(self, user_id: str, tenant_id: str) -> dict:
        a = self.answers.get((tenant_id, user_id), self.default)
        if isinstance(a, Exception):
            raise a
        return dict(a)
