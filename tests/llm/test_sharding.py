import zlib
from collections import Counter, defaultdict

from frames import frame  # noqa: F401
from shredline.llm import sharding as S

ROWS = [(i, f"text {i}") for i in range(300)] + [(1000 + i, "the same text") for i in range(150)]
ROWS += [(7000, None), (7001, ""), (7002, "É" * 5000), (None, "no id"), (7003, "twice"), (7003, "twice")]


def test_law_rows(frame):
    got = S.assign_shards(frame(ROWS)).collect()
    assert len(got) == len(ROWS)
    texts = defaultdict(list)
    for d, t in ROWS:
        texts[d].append(t or "")
    by = defaultdict(list)
    for g in got:
        raw = texts[g.doc_id][0].encode()
        assert (g["size"], g.text_crc32, g.law, g.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by[g.shard].append(g.slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_few_rows_and_empty(frame):
    assert S.assign_shards(frame([])).count() == 0
    assert sorted(Counter(r.shard for r in S.assign_shards(frame(ROWS[:3])).collect()).values()) == [1, 1, 1]


def test_equal_texts_go_together_where_there_is_room(frame):
    rows = [(i, f"text {i % 300}") for i in range(3000)]
    shards = defaultdict(set)
    for r in S.assign_shards(frame(rows)).collect():
        shards[r.doc_id % 300].add(r.shard)
    assert sum(len(s) == 1 for s in shards.values()) > 0.8 * 300


def brute_walk(counts, shards, nodes):
    """Row by row round the ring: all first choices, then all second ones, ..."""
    owner, total = S.ring(shards, nodes), sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, left, out = [0] * shards, list(counts), {}
    for turn in range(shards):
        for p in range(S.POINTS):
            if not left[p]:
                continue
            met, q = [], p
            while len(met) <= turn:
                if owner[q % S.POINTS] not in met:
                    met.append(owner[q % S.POINTS])
                q += 1
            while left[p] and used[met[turn]] < room[met[turn]]:
                out[p, counts[p] - left[p]] = (met[turn], used[met[turn]])
                used[met[turn]] += 1
                left[p] -= 1
    return out


def test_walk_equals_brute_force():
    counts = [0] * S.POINTS
    for i in range(400):
        counts[zlib.crc32(str(i).encode()) % S.POINTS] += 1
    counts[77] += 300
    mine = {(p, i): (s, base + i - lo) for p, lo, hi, s, base in S.walk(counts, 8) for i in range(lo, hi)}
    assert mine == brute_walk(counts, 8, 32)


def test_little_moves_when_a_shard_is_added(frame):
    rows = [(i, f"t{i}") for i in range(2000)]
    a = {r.doc_id: r.shard for r in S.assign_shards(frame(rows), 8).collect()}
    b = {r.doc_id: r.shard for r in S.assign_shards(frame(rows), 9).collect()}
    assert sum(a[d] != b[d] for d in a) < 0.45 * len(a)       # hashing modulo the number of shards moves 8 of 9
