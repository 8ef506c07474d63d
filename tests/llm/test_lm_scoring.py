import math
import zlib
from collections import Counter

import pytest

from frames import frame  # noqa: F401
from shredline.llm.lm_scoring import Positions, score_texts, traverse


def tokens(text):
    return [w for w in (text or "").encode().lower().split()] + [b""]


def brute(rows, order, prior=100.0, floor=1.0):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts, histories = Counter(), Counter()
    for d, t in rows:
        if not held(d):
            seq = [b" "] + tokens(t)
            for i in range(1, len(seq)):
                counts[(seq[i],)] += 1
                for k in range(2, order + 1):
                    if i - k + 1 >= 0:
                        counts[tuple(seq[i - k + 1:i + 1])] += 1
            histories[(b" ",)] += 1
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(1 for g in counts if len(g) == 1)
    count = lambda g: counts[g] + histories[g]
    out = []
    for d, t in rows:
        seq, base, score, known = [b" "] + tokens(t), 0.0, 0.0, 0
        for i in range(1, len(seq)):
            c = counts[(seq[i],)]
            known += c > 0
            base += math.log10((c + 1) / (n + v + 1))
            p = (c + floor) / (n + floor * (v + 1))
            for k in range(2, order + 1):
                if i - k + 1 >= 0:
                    g = tuple(seq[i - k + 1:i + 1])
                    p = (counts[g] + prior * p) / (count(g[:-1]) + prior)
            score += math.log10(p)
        out.append((d, held(d), len(seq) - 1, known, n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


ROWS = [(1, "The cat sat on the mat"), (2, "the cat sat"), (3, None), (4, ""), (5, "   \t\n"), (None, "the dog"),
        (6, "the cat sat"), (6, "the cat sat"), (7, "É é the\x0bcat x"), (12, "on the mat the dog sat"),
        (19, "unseen words here"), (8, "w " * 5000)]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("group", [10 << 20, 400])
def test_equals_brute_force(frame, order, group):
    got = score_texts(frame(ROWS), order=order, group_bytes=group).collect()
    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                   for r in got), key=str)
    want = brute(ROWS, order)
    for a, b in zip(mine, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-6) and a[6] == pytest.approx(b[6], rel=1e-6)


def test_empty_table_and_nothing_learned(frame):
    assert score_texts(frame([])).count() == 0
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    row = score_texts(frame([(held, "a b")])).first()
    assert (row.train_tokens, row.n_known, row.n_tokens, row.base_score) == (0, 0, 3, 0.0)


def test_probabilities_sum_to_one(frame):
    """The next token's probabilities in a state, read off pairs of texts that differ in one more token."""
    held = [d for d in range(2000) if zlib.crc32(str(d).encode()) % 7 == 2]
    free = [d for d in range(100) if d not in held]
    train = list(zip(free, ["a b a c", "b a", "c"]))
    words = ["a", "b", "c", "unknown"]
    probes = ["a"] + [f"a {w}" for w in words] + [f"a {w} {v}" for w in words for v in words]
    got = {r.doc_id: 10 ** r.score for r in score_texts(frame(train + list(zip(held, probes)))).collect()}
    total = {t: got[d] for d, t in zip(held, probes)}
    stop = total["a"]
    one = sum(total[f"a {w}"] for w in words)
    counts, follow = {"a": 3, "b": 2, "c": 2, "": 3}, {"b": 1, "c": 1, "": 1}
    n, v = 10, 4
    uni = {w: (c + 1) / (n + v + 1) for w, c in counts.items()} | {"unknown": 1 / (n + v + 1)}
    after_a = {w: (follow.get(w, 0) + 100 * p) / (3 + 100) for w, p in uni.items()}
    assert sum(after_a.values()) == pytest.approx(1.0)
    end_after_b = 100 * uni[""] / (counts["b"] + 100)           # no text ends after b
    assert total["a b"] / stop == pytest.approx(after_a["b"] / after_a[""] * end_after_b)
    assert 0 < one < stop / after_a[""]


def test_traverse_carries_the_state():
    arcs = [[-1.0, -1.0, -1.0], [-0.5, None, -0.25]]
    fails = [[], [0.0, -0.125, 0.0]]
    assert traverse(arcs, fails, 3) == -0.5 - 0.125 - 1.0 - 0.25


def test_positions_do_not_cross_texts():
    both = Positions([b"a b", b"c"], 2)
    alone = Positions([b"a b"], 2), Positions([b"c"], 2)
    assert sorted(both.all_keys().tolist()) == sorted(alone[0].all_keys().tolist() + alone[1].all_keys().tolist())
