"""Benchmark decontamination: suffix arrays of the training texts, searched for every test suffix.

Every task turns its documents into word numbers and sorts the suffixes of each
shard (some hundred thousand words) by prefix doubling. All suffixes of the
benchmark items, cut to the window length, are looked up in every shard by
vectorised binary search; the range found in the suffix array holds all their
locations. Overlapping windows merge into the longest verbatim matches. A
document is contaminated when its matched words are a large enough share.

The benchmark is the stated query set. It is sent to the tasks in blocks of at
most ``block_bytes`` of text; each block is one more pass over the documents,
which carry their hits from pass to pass. Documents are never shuffled.

Defined results: a null or wordless text has no words and is not contaminated;
items without words match nothing; an item of fewer words than the window is
one window; the same item twice counts once; repeated documents are judged one
by one; null item ids match like others but are not listed; columns other than
the named ones are carried or ignored as stated below.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredline.llm.common import alnum_words, binary_column, counter_index, number, text_slices

SHARD_WORDS = 1 << 19
ADDED = ("n_words", "n_hit", "hits", "items", "longest")


def suffix_array(a: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``a`` (numbers from 0, 0 ends a text) sorted by the ``depth`` numbers that follow, by doubling."""
    rank, width = a.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        after = np.zeros_like(rank)
        after[:-width or None] = rank[width:]
        key = (rank << 32) | after
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.concatenate([[1], key[1:] != key[:-1]]).astype(np.int64)
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(heads)
        width *= 2
        if rank.max(initial=0) == len(rank):
            break
    return order


def suffix_ranges(a: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``wanted``: the range of the suffix array whose suffixes begin with it."""
    width = wanted.shape[1]
    padded = np.concatenate([a, np.zeros(width, a.dtype)])
    steps = np.arange(width)
    rows = np.arange(len(wanted))

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = np.minimum((lo + hi) // 2, len(order) - 1)
            there = padded[order[mid][:, None] + steps]
            differ = there != wanted
            first = differ.argmax(axis=1)
            equal = ~differ.any(axis=1)
            right = np.where(equal, upper, there[rows, first] < wanted[rows, first])
            lo = np.where(open_ & right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)

    return bound(False), bound(True)


class TestSuffixes:
    """The distinct windows of some items: their words, the items that hold them, and which window follows which."""

    __test__ = False

    def __init__(self, items: list[tuple], window: int):
        self.window = window
        words_of = {}
        for item, text in items:
            words_of.setdefault((item, text), alnum_words(text))
        windows: dict[tuple, int] = {}
        self.owners: list[set] = []
        self.follows: set[tuple[int, int]] = set()
        for (item, _), words in words_of.items():
            width, before = min(window, len(words)), None
            for j in range(len(words) - width + 1 if words else 0):
                at = windows.setdefault(tuple(words[j:j + width]), len(windows))
                if at == len(self.owners):
                    self.owners.append(set())
                self.owners[at].add(item)
                if before is not None:
                    self.follows.add((before, at))
                before = at
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for k in windows for w in k))}
        self.by_width = {}
        for width in sorted({len(k) for k in windows}):
            own = [(at, [self.vocabulary[w] for w in k]) for k, at in windows.items() if len(k) == width]
            self.by_width[width] = (np.array([at for at, _ in own]), np.array([k for _, k in own], dtype=np.int64))

    def find(self, a: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
        """All places in ``a`` where a window begins, and which window."""
        local = np.array([index.get(w, -1) for w in self.vocabulary], dtype=np.int64)
        places, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        overlap = self.window - 1
        for lo in range(0, len(a), SHARD_WORDS):
            shard = a[lo:lo + SHARD_WORDS + overlap]
            order = None
            for names, words in self.by_width.values():
                wanted = local[words]
                there = (wanted >= 0).all(axis=1)
                if not there.any():
                    continue
                if order is None:
                    order = suffix_array(shard, self.window)
                first, end = suffix_ranges(shard, order, wanted[there])
                n = end - first
                got = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                own = got < SHARD_WORDS
                places.append(got[own] + lo)
                which.append(np.repeat(names[there], n)[own])
        return np.concatenate(places), np.concatenate(which)


def _pass(found: TestSuffixes):
    """One pass over documents: adds the hits of a block of items to what earlier passes found."""
    def run(batches):
        width = {at: w for w, (names, _) in found.by_width.items() for at in names.tolist()}
        for part in text_slices(batches):
            texts = binary_column(part, "text")
            index = counter_index()
            index[b"\x00"]          # 0 closes every text; no word holds that byte
            parts, lengths = [], []
            for text in texts:
                words = alnum_words(text)
                parts.append(number(index, words))
                parts.append(np.zeros(1, np.int64))
                lengths.append(len(words))
            n = np.array(lengths, dtype=np.int64)
            a = np.concatenate(parts)
            begin = np.concatenate([[0], np.cumsum(n + 1)])[:-1]
            places, which = found.find(a, index)
            at = np.argsort(places, kind="stable")
            places, which = places[at], which[at]
            widths = np.array([width[w] for w in which.tolist()], dtype=np.int64)
            cover = np.zeros(len(a) + 1, dtype=np.int64)
            np.add.at(cover, places, 1)
            np.add.at(cover, places + widths, -1)
            hit = np.cumsum(cover)[:-1] > 0
            doc = np.searchsorted(begin, places, side="right") - 1
            items = [set(x or ()) for x in part.column(part.schema.get_field_index("items")).to_pylist()]
            longest = part.column(part.schema.get_field_index("longest")).to_pylist()
            chain, before = 0, (-2, -1)
            for d, p, w in zip(doc.tolist(), places.tolist(), which.tolist()):
                items[d].update(i for i in found.owners[w] if i is not None)
                chain = chain + 1 if before[0] == p - 1 and (before[1], w) in found.follows else 0
                before = (p, w)
                longest[d] = max(longest[d], chain + width[w])
            masks, n_hit = [], []
            for b, size, old in zip(begin.tolist(), lengths, part.column(part.schema.get_field_index("hits")).to_pylist()):
                new = hit[b:b + size]
                if old:
                    new = new | np.unpackbits(np.frombuffer(old, np.uint8), count=size).astype(bool)
                n_hit.append(int(new.sum()))
                masks.append(np.packbits(new).tobytes() if new.any() else None)
            put = {"n_words": pa.array(lengths, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                   "hits": pa.array(masks, pa.binary()),
                   "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                   "longest": pa.array(longest, pa.int64())}
            yield pa.RecordBatch.from_arrays([put.get(f.name, part.column(i)) for i, f in enumerate(part.schema)],
                                             names=part.schema.names)
    return run


def _blocks(items: DataFrame, block_bytes: int):
    """The items in blocks of about ``block_bytes``, one at a time on the driver."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for b in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"], r["text"].encode() if r["text"] is not None else None) for r in own.collect()]


def match_benchmark(docs: DataFrame, items: DataFrame, window: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """Verbatim matches of benchmark windows, per document.

    ``docs`` keeps all its columns (it must hold text); added are ``n_words``,
    ``n_hit``, ``hits`` (one packed bit for each word, null without a hit), ``items`` (ids as
    strings, sorted) and ``longest`` (words of the longest verbatim match).
    """
    out = docs.select(*[c for c in docs.columns if c not in ADDED], F.lit(0).cast("long").alias("n_words"),
                      F.lit(0).cast("long").alias("n_hit"),
                      F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"),
                      F.lit(0).cast("long").alias("longest"))
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    for block in _blocks(items, block_bytes):
        out = out.mapInArrow(_pass(TestSuffixes(block, window)), out.schema)
    return out


def judge(matches: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_items and contaminated: ``share`` * n_hit >= n_words and any hit."""
    return (matches.withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    clash = {*ADDED, "n_items", "contaminated"} & set(docs.columns)
    own = docs.select(F.struct(*docs.columns).alias("row"), "text") if clash else docs
    return (judge(match_benchmark(own, items, window), share).where(~F.col("contaminated"))
            .select(*(["row.*"] if clash else docs.columns)))


def brute_force(docs: list[tuple], items: list[tuple], window: int = 13) -> dict:
    """doc_id -> (n_words, n_hit, item ids as sorted strings), by comparing every place; for tests."""
    out = {}
    for doc_id, text in docs:
        words, hit, ids = alnum_words(text), set(), set()
        for item, body in items:
            own = alnum_words(body)
            width = min(window, len(own))
            for j in range(len(own) - width + 1 if own else 0):
                for p in range(len(words) - width + 1):
                    if words[p:p + width] == own[j:j + width]:
                        hit.update(range(p, p + width))
                        ids.add(str(item))
        out[doc_id] = (len(words), len(hit), sorted(ids))
    return out


def sha256_of(ids) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()

