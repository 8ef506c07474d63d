import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from frames import frame  # noqa: F401
from shredline.llm import packing as P

PATH = P.default_tokenizer()


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


TEXTS = ["Hello world. It's a test!", None, "", " ", "  two  spaces ", "a\n\n b\t c \n", "é\u00a0x \u3000y", "tab\t tab",
         "x " * 3000, "word" * 900, " lead. Then? \"Yes.\" ok", "end ", "1 2 3 'll 's", "<|endoftext|> in text", "日本 語 。", "a  b   c    d"]


def test_ids_equal_the_tokenizer(tok):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("ab. \n\té'1\u2003,") for _ in range(200)) for _ in range(60)]
    mine = P.ChunkTokenizer(PATH, keep=50)
    for _ in range(2):
        got = mine.encode([t.encode() if t is not None else None for t in texts])
        for t, ids in zip(texts, got, strict=True):
            assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def check(rows, pieces, tok, capacity=1024):
    """Every id in exactly one piece, sequences gapless and short enough."""
    want = {}
    for i, (d, t) in enumerate(rows):
        want.setdefault(d, []).append(tok.encode(t or "", add_special_tokens=False).ids + [0])
    got, sequences = {}, {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(got) == set(want)
    for d, ps in got.items():
        if len(want[d]) == 1:
            ids, at = want[d][0], 0
            for p in sorted(ps, key=lambda p: p.start):
                own = np.array(ids[p.start:p.start + p.length], "<u4")
                assert p.start == at and p.ids_crc32 == zlib.crc32(own.tobytes()) and p.doc_tokens == len(ids)
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in ps) == sum(map(len, want[d]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return [sum(n for _, n in s) for s in sequences.values()]


def test_pieces(frame, tok):
    rows = list(enumerate(TEXTS)) + [(90, "twice the same"), (90, "twice the same"), (None, "no id")]
    check(rows, P.pack(frame(rows)).collect(), tok)
    check(rows, P.pack(frame(rows), block_tokens=64, capacity=16).collect(), tok, 16)
    assert P.pack(frame([])).count() == 0


def test_little_padding(spark, tok):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    sizes = check([(r.doc_id, r.text) for r in docs.collect()], P.pack(docs).collect(), tok)
    padding = sum(1024 - n for n in sizes if n & (n - 1))
    assert padding < 0.02 * sum(sizes)


def brute_cost(places, penalties, capacity, each):
    cost = [0.0] + [float("inf")] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = places[j] - places[i]
            if n <= capacity:
                pad = 0 if n & (n - 1) == 0 else capacity - n
                cost[j] = min(cost[j], cost[i] + pad + each + penalties[j])
    return cost[-1]


@pytest.mark.parametrize("seed", range(8))
def test_cuts_are_optimal(seed):
    r = random.Random(seed)
    places = [0]
    while len(places) < 60:
        places.append(places[-1] + r.randrange(1, 12))
    places, penalties = np.array(places), np.array([0.0] + [r.choice([0.0, 1.0, 8.0]) for _ in places[1:]])
    cuts = P.best_cuts(places, penalties, 32, 4.0)
    cost = sum((0 if (b - a) & (b - a - 1) == 0 else 32 - (b - a)) + 4.0 + penalties[np.searchsorted(places, b)]
               for a, b in zip(cuts, cuts[1:]))
    assert cuts[0] == 0 and cuts[-1] == places[-1] and max(np.diff(cuts)) <= 32
    assert cost == pytest.approx(brute_cost(places.tolist(), penalties.tolist(), 32, 4.0))
