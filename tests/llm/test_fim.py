import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import frame  # noqa: F401
from shredline.llm import fim as M


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the contract's words."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "a", "é", "Two words", "a<P>b", "<S>", "x<M", "<", "<<<S<P<M", "\n\n \t", "日本 text 😀😀é", "a" * 70000 + " b",
         "ab " * 60000, "!" * 140000, ("w" * 1000 + ".") * 200]


def test_cuts_and_output_equal_brute_force_and_texts_come_back(frame):  # noqa: F811
    r = random.Random(4)
    rows = list(enumerate(TEXTS * 8)) + [(10_000 + i, "".join(r.choice("ab<PSM> é😀\n") for _ in range(r.randrange(40))))
                                         for i in range(400)] + [(None, "null id"), (5, "a<Pb"), (5, "a<Pb")]
    done = M.transform(frame(rows)).withColumn("back", M.restore(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done), key=repr)
    assert got == sorted(((i, *brute(i, t)) for i, t in rows), key=repr)
    assert all(r.back == r.text for r in done) and {r.form for r in done} == {"plain", "psm", "spm"}
    assert "fp" in done[0]


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some words here", "x", 9)], "doc_id long, text string, form string, n int")
    row = M.transform(docs).first()
    assert row.form in ("plain", "psm", "spm") and row.n == 5
    assert M.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", M.KINDS)
def test_containers_select_every_member(kind):
    r = np.random.default_rng(5)
    for share in (0.0001, 0.01, 0.5, 0.99):
        low = np.flatnonzero(r.random(M.SPAN) < share)
        if len(low):
            c = kind(low)
            assert [c.select(k) for k in range(0, len(low), 97)] == low[::97].tolist()
            assert c.select(len(low) - 1) == low[-1]


def test_set_over_many_containers():
    r = np.random.default_rng(6)
    dense, mixed = np.arange(70_000), 200_000 + np.flatnonzero(r.random(65_536) < 0.5)
    offsets = np.concatenate([dense, mixed, [900_000, 4_000_000]])
    found = M.BoundarySet(offsets)
    assert {type(c) for c in found.containers} == set(M.KINDS) and len(found) == len(offsets)
    assert [found.select(k) for k in range(0, len(offsets), 31)] == offsets[::31].tolist()
    for k in (-1, len(offsets)):
        with pytest.raises(IndexError):
            found.select(k)
    assert len(M.BoundarySet(np.array([], dtype=np.int64))) == 0
