import itertools
import random
import re

import numpy as np
from collections import Counter

from frames import frame  # noqa: F401
from shredline.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def texts():
    r = random.Random(7)
    out = [None, "", " \n\x0b", "a b c a b c", "a a a a", "#*$%&|<>", "é ü x y", "x\n\nx\n x\nx", "\x1c a\x1c b", "w " * 9000]
    for _ in range(30):
        out.append("".join(r.choice(["a", "b", "C", "é", " ", " ", "\n", "\t", "#", "日"]) for _ in range(r.randrange(400))))
    return out


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_base_equals_brute_force(spark, frame):
    rows = list(enumerate(texts())) + [(3, texts()[3]), (None, "no id")]
    got = Q.judge(frame(rows).select("doc_id", "text"), labels(spark)).collect()
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is not None:
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute(
                texts()[g.doc_id]), g
        assert not (g.base_failed and g.kept)


def test_viterbi_is_exact():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        x, stay = r.normal(size=n), r.normal(size=(2, 2))
        score = lambda y: sum(a * b for a, b in zip(x, y)) + sum(stay[a][b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert abs(score(Q.viterbi(x.tolist(), stay)) - score(best)) < 1e-9
    assert Q.viterbi([], np.zeros((2, 2))) == []


def test_gradient_fits_and_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = Q.fit(docs, known.where("doc_id % 2 = 0"))
    got = Q.judge(docs, labels(spark), model).join(known.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [g for g in got if g.quality], [g for g in got if not g.quality]
    assert sum(g.kept or g.base_failed for g in good) >= 0.98 * len(good)
    assert sum(not g.kept for g in bad) >= 0.9 * len(bad)


def test_clashing_columns_and_empty_tables(spark, frame):
    rows = frame([(1, "a b"), (2, None)])
    out = Q.judge(rows, labels(spark, [(1, 1, 0), (2, 0, 0), (None, None, None)]))
    assert set(out.columns) == set(rows.columns) | set(Q.NAMES) and out.count() == 2
    assert Q.judge(rows.limit(0), labels(spark)).count() == 0


def test_long_labelled_documents_are_learned(spark):
    """All bad documents over 64 KB: the model is fitted on them whole and doesn't fall back to the prior."""
    good = [(i, "\n".join(f"This is line {j} of a text with plain words and a full stop." for j in range(30)), 1) for i in range(20)]
    bad = [(100 + i, "\n".join(f"HOME | LOGIN | CART | {j}" for j in range(4000)), 0) for i in range(4)]
    docs = spark.createDataFrame([r[:2] for r in good + bad] + [(7, None)], "doc_id long, text string")
    assert min(len(t) for _, t, _ in bad) > 64 << 10
    known = labels(spark, [(i, q, 0) for i, _, q in good + bad])
    weights, stay = Q.fit(docs, known)
    assert not np.allclose(weights, Q.PRIOR)
    got = {r.doc_id: r.content_share for r in Q.judge(docs, known, (weights, stay)).where("n_words > 0").collect()}
    assert all(got[i] >= 0.5 for i, _, _ in good) and all(got[i] < 0.5 for i, _, _ in bad)
    one = Q.fit(docs, known, train_bytes=1)                     # one document of each quality at least
    assert not np.allclose(one[0], Q.PRIOR)
