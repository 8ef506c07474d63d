import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from shredline.llm import trie as T

SCHEMA = "conv_id long, turn int, role string, text string, depth int, z1 string, weight string"


def brute(rows):
    """The nodes by the contract's words; rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    children = {}
    for seq in members:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for seq, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += seq not in children
            saved[seq[:d]] += (len(m) - 1) * words
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children.get(s, [])), leaves[s], saved[s],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest())
                  for s, m in members.items())


def conversations(seed, n, texts, most=7):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(3 * n), n):
        out += [(c, t if t else None, r.choice(["user", "user", None]), r.choice(texts)) for t in range(r.randrange(1, most))]
    r.shuffle(out)
    return out


CASES = {
    "few texts": conversations(1, 150, ["a", "b b", None]),
    "many texts": conversations(2, 120, [f"w{i} x\ty\x0bz" for i in range(40)] + ["", "é x"]),
    "one conversation holds a third": conversations(3, 60, ["a", "b"]) + [(7, 100 + i, "user", f"t{i % 5}") for i in range(120)],
    "chain of long copies": [(20 * c, i, "user", "same words") for c in range(4) for i in range(80 - c)],
    "no base, null ids, no turns left": [(21, 0, "a", "x"), (22, 0, "a", "x"), (39, None, None, None), (None, 1, "a", "x"), (None, None, None, None)],
    "empty": [],
}


@pytest.mark.parametrize("limit", [3, 40, T.LIMIT])
@pytest.mark.parametrize("case", CASES)
def test_nodes_equal_brute_force(spark, case, limit):
    rows = CASES[case]
    if limit != T.LIMIT and case not in ("few texts", "one conversation holds a third"):
        pytest.skip("the split by joins is tested on two cases")
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in T.prefix_trie(docs, limit=limit).collect())
    assert got == brute(rows)


def test_sums_of_random_forests():
    r = np.random.default_rng(4)
    for n in (1, 2, 7, 60, 500):
        for reach in (1, 3, n):
            parent = np.array([-1 if i == 0 or r.random() < 0.02 else r.integers(max(0, i - reach), i) for i in range(n)])
            depth, weight = np.zeros(n, int), r.integers(1, 5, n)
            values = r.integers(0, 9, (2, n))
            want = values.copy()
            for i in range(n):
                depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
            for i in reversed(range(n)):
                if parent[i] >= 0:
                    weight[parent[i]] += weight[i]
                    want[:, parent[i]] += want[:, i]
            assert (T.split_components(parent, depth, weight, values) == want).all()
