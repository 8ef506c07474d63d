import random

import numpy as np
import pytest

from frames import frame  # noqa: F401
from shredline.llm import decontamination as D

R = random.Random(5)
VOC = ["a", "b", "c", "the", "É", "x9"]
ITEMS = [(i, " ".join(R.choice(VOC) for _ in range(R.choice([0, 2, 5, 13, 14, 40])))) for i in range(12)]
ITEMS += [(90, None), (91, " ,. "), (92, "the the the the the the the the the the the the the the the"), (93, ITEMS[5][1])]


def docs():
    out = [(1, None), (2, ""), (3, "--"), (3, "--"), (4, "the " * 300), (None, ITEMS[4][1])]
    for i in range(40):
        words = [R.choice(VOC) for _ in range(R.randrange(80))]
        item = R.choice(ITEMS)[1] or ""
        own = item.split()
        cut = own[R.randrange(3):] if R.random() < .5 else own
        at = R.randrange(len(words) + 1)
        out.append((100 + i, ", ".join(words[:at] + [w.upper() for w in cut] + words[at:])))
    return out


@pytest.mark.parametrize("block,shard", [(8 << 20, 1 << 19), (300, 64)])
def test_equals_brute_force(spark, frame, monkeypatch, block, shard):
    monkeypatch.setattr(D, "SHARD_WORDS", shard)
    rows = docs()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    if shard == 64:
        # the workers import the module themselves: compare the finder directly
        found = D.TestSuffixes([(str(i), t.encode() if t is not None else None) for i, t in ITEMS], 13)
        index = D.counter_index()
        index[b"\x00"]
        a = np.concatenate([np.append(D.number(index, D.alnum_words(t.encode() if t else t)), 0) for _, t in rows])
        small = {tuple(x) for x in zip(*map(np.ndarray.tolist, found.find(a, index)))}
        monkeypatch.setattr(D, "SHARD_WORDS", 1 << 19)
        assert small == {tuple(x) for x in zip(*map(np.ndarray.tolist, found.find(a, index)))}
    got = D.judge(D.match_benchmark(frame(rows).select("doc_id", "text"), items, block_bytes=block)).collect()
    want = D.brute_force([(i, t.encode() if t else t) for i, t in rows], [(i, t.encode() if t else t) for i, t in ITEMS])
    assert len(got) == len(rows)
    for r in got:
        n, hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, ids)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        assert (r.longest > 0) == (hit > 0) and r.longest <= max(r.n_hit, 0)


def test_longest_match(spark, frame):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    r = D.match_benchmark(frame([(1, "x " + " ".join(words[5:35]) + " y")]).select("doc_id", "text"), items).first()
    assert (r.longest, r.n_hit) == (30, 30)


def test_removal_keeps_columns_and_empty_tables(spark, frame):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = frame([(1, "one two three"), (2, "clean text"), (3, None)])
    left = D.remove_contaminated(rows, items)
    assert left.columns == rows.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    assert D.remove_contaminated(rows, items.limit(0)).count() == 3
    assert D.remove_contaminated(rows.limit(0), items).count() == 0


def test_suffix_array_sorts_to_depth():
    a = np.array([R.randrange(4) for _ in range(500)], dtype=np.int64)
    order = D.suffix_array(a, 13)
    cut = [tuple(np.append(a, [0] * 20)[i:i + 13]) for i in order]
    assert cut == sorted(cut)
