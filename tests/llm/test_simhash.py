import random

import numpy as np
import xxhash

from frames import frame  # noqa: F401
from shredline.llm import simhash as S


def brute_fp(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    """fps: list of (doc_id, fp)."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, f, low.get(root(i))) for i, (d, f) in enumerate(fps) if d is not None)


def test_documents_equal_brute_force(frame):
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefgh") * 3 for _ in range(120)) for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(base)] + [(50 + i, t + " end") for i, t in enumerate(base)]
    rows += [(80, None), (81, ""), (82, " \n"), (83, "one"), (84, "one two"), (84, "one two"), (85, "ONE two"), (86, "É " * 9000),
             (None, base[0])]
    got = S.near_duplicates(frame(rows)).collect()
    assert len(got) == len(rows)
    mask = (1 << 64) - 1
    mine = sorted((g.doc_id, g.fp & mask, g.component_id) for g in got if g.doc_id is not None)
    assert mine == brute_components([(d, brute_fp(t)) for d, t in rows])


def chain(seed, n):
    """Fingerprints in chains and clouds of 1 or 2 bits."""
    r, out = random.Random(seed), []
    for _ in range(n):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 30])):
            out.append(x)
            for _ in range(r.choice([1, 2, 3])):
                x ^= 1 << r.randrange(64)
    return sorted(set(out))


def components_of(spark, fps):
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in S.components(S.near_links(nodes)).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(roots.get(x, x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def brute_groups(fps):
    groups = {}
    for x, _, low in brute_components(list(enumerate(fps))) and [(fps[d], f, low) for d, f, low in brute_components(list(enumerate(fps)))]:
        groups.setdefault(low, set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_links_equal_brute_force(spark):
    fps = chain(3, 25) + [0, 1, 2, 3, (1 << 64) - 1, (1 << 64) - 2]
    fps = sorted(set(fps))
    assert components_of(spark, fps) == brute_groups(fps)


def test_dense_cells_are_linked_exactly(spark):
    """All words within 2 bits of a centre share cells with over DENSE members."""
    centre = 0x0123456789ABCDEF
    cloud = {centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    fps = sorted(cloud | set(chain(4, 6)))
    assert len(cloud) > S.DENSE
    got = components_of(spark, fps)
    assert [g for g in got if set(g) & cloud] == [sorted(cloud)]
    rest = [x for x in fps if x not in cloud]
    assert sorted(g for g in got if not set(g) & cloud) == brute_groups(rest)


def test_dense_cells_across_batches(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(S, "DENSE", 4)
    cells = np.array([1, 1, 2] + [3] * 12 + [4, 4, 5], dtype=np.int64)
    fps = np.array([0, 1, 9] + list(range(100, 112)) + [1 << 20, 1 << 20 | 1, 7], dtype=np.int64)
    for size in (1, 2, 3, 5, 40):
        parts = [pa.RecordBatch.from_arrays([pa.array(cells[i:i + size]), pa.array(fps[i:i + size])], names=["cell", "fp"])
                 for i in range(0, len(cells), size)]
        rows = [r for b in S._links(parts) for r in b.to_pylist()]
        linked = {(r["a"], r["b"]) for r in rows if r["b"] is not None}
        dense = {r["a"] for r in rows if r["b"] is None}
        assert linked == {(1, 0), (1 << 20 | 1, 1 << 20)} and dense == set(range(100, 112)), size


def test_manhattan_distance_is_a_lower_bound():
    r = random.Random(2)
    for _ in range(50):
        x = r.getrandbits(64)
        y = x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        cells = [set(S.popcount_cells(np.array([v], dtype=np.uint64).view(np.int64))[0].tolist()) for v in (x, y)]
        assert cells[0] & cells[1]


def test_keep_one(frame):
    rows = frame([(3, "a b c d e"), (1, "a b c d e"), (2, None), (7, ""), (9, "other text of its own"), (9, "other text of its own")])
    left = S.keep_one(rows)
    assert left.columns == rows.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 9]
    assert S.keep_one(rows.limit(0)).count() == 0


def test_keep_one_with_null_ids(frame):
    rows = frame([(None, "a b c d"), (5, "a b c d"), (None, "only null ids have this"), (None, "only null ids have this"), (6, None)])
    left = sorted(((r.doc_id, r.text) for r in S.keep_one(rows).collect()), key=str)
    assert left == sorted([(5, "a b c d"), (6, None), (None, "only null ids have this")], key=str)


def test_keep_one_with_an_id_on_several_texts(frame):
    """Every component keeps one row, however its ids are shared and whatever the partitions."""
    a, b, c = ("alpha beta gamma delta " * 3, "one two three four five six", "red green blue black white grey")
    rows = [(5, a), (5, b), (6, a), (3, c), (5, c), (7, "seven eight nine ten"), (7, "seven eight nine ten"), (None, b)]
    rows += [(8, "x y z"), (8, "X y z"), (9, "x y z"), (8, "x y z")]       # one component, one id, two texts
    left = [sorted((r.doc_id, r.text) for r in S.keep_one(frame(order).repartition(n)).collect())
            for order, n in ((rows, 1), (rows[::-1], 1), (rows, 7))]
    assert [x for x in left[0] if x[0] != 8] == sorted([(3, c), (5, a), (5, b), (7, "seven eight nine ten")])
    assert len([x for x in left[0] if x[0] == 8]) == 1 and left[0] == left[1] == left[2]


def test_keep_one_of_equal_ids_and_texts_does_not_depend_on_partitions(spark):
    rows = [(1, "a b c d", lang, n) for n, lang in enumerate(["en", "de", None, "fr"])] + [(2, "other words than these", "en", 9)]
    docs = [spark.createDataFrame(r, "doc_id long, text string, lang string, n int").coalesce(1) for r in (rows, rows[::-1])]
    left = [sorted(map(tuple, S.keep_one(d).collect())) for d in docs]
    assert left[0] == left[1] and [r[0] for r in left[0]] == [1, 2]
