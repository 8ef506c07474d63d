"""The documents fixture, imported by the tests that use it (a second conftest.py would hide the library's)."""

import pytest


@pytest.fixture()
def frame(spark):
    """Documents with clashing extra columns from (doc_id, text) pairs."""
    def make(rows, kind="long"):
        extra = [(i, t, "x", 1, "y", 0.5, "z") for i, t in rows]
        return spark.createDataFrame(
            extra, f"doc_id {kind}, text string, fp string, n_words int, grp string, score double, items string")
    return make
