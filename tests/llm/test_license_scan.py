import random
import re

from frames import frame  # noqa: F401
from shredline.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    found = [(i, label) for label, phrase in L.BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


ROWS = [(1, None), (2, ""), (3, "cc"), (4, "CC-BY cc by, cc by"), (5, "All rights\nreserved. General Public License v3"),
        (6, "all rights"), (7, "x " * 4000 + "general public license"), (8, "ÉCC by"), (8, "ÉCC by"), (None, "cc by"),
        (9, "This work is licensed under the GNU General Public License, version 3."), (10, "Licensed under CC BY-NC 4.0."),
        (11, "permission is hereby very granted, free of charge, to any person"), (12, "the \u212aelvin cc by É"),
        (13, "mit license"), (14, "cc by cc by all rights reserved all rights reserved")]


def test_equals_brute_force(frame):
    r = random.Random(4)
    voc = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x"]
    rows = ROWS + [(100 + i, " ".join(r.choice(voc) for _ in range(60))) for i in range(30)]
    got = L.scan(frame(rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t in rows:
        want[d] = brute(t)
    for g in got:
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == want[g.doc_id], g
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1
    labels = {g.doc_id: g.labels for g in got}
    assert labels[9] == "gpl" and labels[10] == "cc-by,cc-by-nc" and labels[11] == "mit" and labels[13] == ""


def test_spans_and_empty_table(frame):
    row = L.scan(frame([(1, "a b released under the new mit license c")])).first()
    assert [(s.label, s.start, s.end) for s in row.spans] == [("mit", 2, 8)]
    assert L.scan(frame([])).count() == 0


def test_no_python_in_the_plan(frame):
    plan = L.scan(frame(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Cartesian" not in plan and "NestedLoop" not in plan
