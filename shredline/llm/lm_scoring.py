"""LM scoring: weighted backoff automaton over smoothed n-grams.

States are n-gram histories. From state ``h`` there is an explicit arc for
every word that followed ``h`` in the training texts and one failure arc to the
next shorter history. With ``c`` the training counts, ``mu`` the prior and
``p(w)`` the add-``floor`` unigram, the smoothed probabilities are

    p(w | h) = (c(h w) + mu * p(w | shorter h)) / (c(h) + mu)

so an explicit arc weighs ``log10 p(w | h)`` and the failure arc
``log10(mu / (c(h) + mu))``; over all words and one unknown type each state's
probabilities sum to 1. A text is scored in one left-to-right traversal that
carries the state.

The model grows with the corpus and never exists in one place:

1. documents are hashed into groups of about ``group_bytes`` of text;
2. a group sends its distinct n-gram keys with their training counts to key
   ranges (map-side combined, one packed block for each group and range);
3. a range adds the blocks up and answers every group with the totals of the
   keys it asked for, in the order asked;
4. each group's automaton is the part of the model that its own texts can
   reach; documents and totals meet in a cogroup and are traversed there.

n-grams are named by 63-bit hashes (about one collision among 10^9 n-grams).

Defined results: null and empty texts have the end token only; a null id
counts as the empty text when the held-out rows are chosen; repeated rows are
learned and returned as often as they stand; without training rows every
count is 0; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredline.llm.common import (binary_column, counter_index, even_numbers, mix64, number,
                                  remainder, space_words, text_bytes, text_slices)

END = xxhash.xxh64_intdigest(b"", 1)      # no word is empty
START = xxhash.xxh64_intdigest(b" ", 1)   # no word holds a space
UNIGRAM = np.uint64(1)                    # lowest bit: the key of a token, not of a longer n-gram

OUT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
       "base_score double, score double")


class Positions:
    """Tokens of some texts in a row, each text led by START and closed by END, and their n-gram keys."""

    def __init__(self, texts: list[bytes | None], order: int):
        index, parts, lengths = counter_index(), [], []
        for text in texts:
            words = space_words(text)
            parts.append(number(index, words))
            lengths.append(len(words))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in index), dtype=np.uint64, count=len(index))
        n = np.array(lengths, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(n + 2)])[:-1]   # START's place of each text
        self.last = self.first + n + 1                              # END's
        total = int((n + 2).sum())
        word = np.empty(total, dtype=np.uint64)
        inner = np.ones(total, dtype=bool)
        inner[self.first] = inner[self.last] = False
        word[self.first], word[self.last] = START, END
        word[inner] = hashes[np.concatenate(parts)] if parts else 0
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), n + 2)
        self.start = np.zeros(total, dtype=bool)
        self.start[self.first] = True
        depth = np.arange(total) - self.first[self.doc]             # elements before, START included
        self.keys = {}      # order -> keys of the n-grams that end here
        self.valid = {}     # order -> where the n-gram lies inside the text
        prefix = word
        for k in range(1, order + 1):
            if k > 1:
                prefix = mix64(np.concatenate([[np.uint64(0)], prefix[:-1]]), word)
            self.keys[k] = np.where(self.start, prefix & ~UNIGRAM, prefix | UNIGRAM) if k == 1 else prefix & ~UNIGRAM
            self.valid[k] = depth >= k - 1

    def all_keys(self, rows: np.ndarray | None = None) -> np.ndarray:
        """The keys of all n-grams, of the marked texts only if ``rows`` is given."""
        keep = slice(None) if rows is None else rows[self.doc]
        return np.concatenate([k[self.valid[o] if rows is None else self.valid[o] & keep]
                               for o, k in self.keys.items()])


def merge_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    at = np.argsort(keys)
    keys, counts = keys[at], counts[at]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts, heads)


def _positions(part, order: int) -> tuple[Positions, np.ndarray]:
    """The n-grams of a batch, and which of its texts are for training."""
    held = part.column(part.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
    return Positions(binary_column(part, "text"), order), ~held


def packed(counts: np.ndarray) -> bytes:
    """Counts in the smallest width that holds them all; ``unpacked`` tells it from the length."""
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def unpacked(block: bytes, n: int) -> np.ndarray:
    return np.frombuffer(block, np.dtype(f"u{len(block) // n}") if n else np.uint8).astype(np.int64)


def _asked(positions, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys of a group, sorted, and their counts in its training texts."""
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for here, train in positions:
        both = np.unique(here.all_keys())
        learned, n = np.unique(here.all_keys(train), return_counts=True)
        count = np.zeros(len(both), dtype=np.int64)
        count[np.searchsorted(both, learned)] = n
        keys.append(both)
        counts.append(count)
        if len(keys) > 8:
            k, c = merge_counts(np.concatenate(keys), np.concatenate(counts))
            keys, counts = [k], [c]
    return merge_counts(np.concatenate(keys), np.concatenate(counts))


def _range_bounds(n: int) -> np.ndarray:
    """Lower bounds of n key ranges of the same width."""
    return np.array([(i << 64) // n for i in range(n)], dtype=np.uint64)


def traverse(arcs: list[list], fails: list[list], n: int) -> float:
    """One pass over n tokens of the automaton; carries the state's length.

    ``arcs[k][i]``: weight of the explicit arc by token i from the history of
    k words, None where there is none; every token has one at k = 0.
    ``fails[k][i]``: weight of the failure arc out of the history of k words before token i.
    """
    deepest, state, score = len(arcs) - 1, min(1, len(arcs) - 1), 0.0
    for i in range(n):
        while (weight := arcs[state][i]) is None:
            score += fails[state][i]
            state -= 1
        score += weight
        if state < deepest:
            state += 1
    return score


def _scores(here: Positions, keys: np.ndarray, totals: np.ndarray, n_train: int, n_types: int, order: int, prior: float,
            floor: float):
    """n_tokens, n_known, base and model score of each row."""
    token = ~here.start
    known = totals[np.searchsorted(keys, here.keys[1])]
    base = np.log10((known + 1) / (n_train + n_types + 1))
    p = (known + floor) / (n_train + floor * (n_types + 1))
    weight = {0: np.log10(p)}
    fail: dict[int, np.ndarray] = {}
    explicit: dict[int, np.ndarray] = {}
    seen = known                                         # count of the history of k words that ends here
    for k in range(1, order):
        ok = here.valid[k + 1] & token
        count = np.zeros(len(ok), dtype=np.int64)
        count[ok] = totals[np.searchsorted(keys, here.keys[k + 1][ok])]
        history = np.concatenate([[0], seen[:-1]])
        p = np.where(ok, (count + prior * p) / (history + prior), p)
        weight[k] = np.log10(p)
        fail[k] = np.where(ok, np.log10(prior / (history + prior)), 0.0)
        explicit[k] = ok & (count > 0)
        seen = count
    out = []
    for a, b in zip(here.first.tolist(), here.last.tolist()):
        span = slice(a + 1, b + 1)
        arcs = [weight[0][span].tolist()]
        fails = [[]]
        for k in range(1, order):
            arcs.append([w if e else None for w, e in zip(weight[k][span].tolist(), explicit[k][span].tolist())])
            fails.append(fail[k][span].tolist())
        n = b - a
        out.append((n, int((known[span] > 0).sum()), float(base[span].sum()), traverse(arcs, fails, n)))
    return out


def score_texts(docs: DataFrame, order: int = 2, prior: float = 100.0, floor: float = 1.0, hold_mod: int = 7,
                hold_rest: int = 2, group_bytes: int = 10 << 20) -> DataFrame:
    """Score every text with a model learned from the rows that are not held out.

    Held out are the rows whose crc32(doc_id as text) leaves ``hold_rest`` modulo
    ``hold_mod``. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigram) and score (log10 probability under the automaton).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n = max(1, math.ceil(text_bytes(docs) / group_bytes))
    names = even_numbers(spark, n)
    bounds = _range_bounds(n)
    numbers = F.array(*[F.lit(x) for x in names]) if n <= 512 else F.lit(names)
    docs = (docs
            .withColumn("held_out", remainder(F.col("doc_id"), hold_mod) == hold_rest)
            .withColumn("grp", F.element_at(numbers, (F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n)) + 1)
                                            .cast("int")).cast("int"))
            .repartition(n, "grp"))

    def ask(batches):
        by_group: dict[int, list] = {}
        for part in text_slices(batches):
            groups = part.column(part.schema.get_field_index("grp")).to_numpy(zero_copy_only=False)
            for g in np.unique(groups).tolist():
                own = part if (groups == g).all() else pa.RecordBatch.from_struct_array(
                    part.to_struct_array().filter(pa.array(groups == g)))
                by_group.setdefault(g, []).append(_asked([_positions(own, order)], order))
                if len(by_group[g]) > 8:
                    by_group[g] = [merge_counts(*map(np.concatenate, zip(*by_group[g])))]
        for g, got in by_group.items():
            keys, counts = merge_counts(*map(np.concatenate, zip(*got)))
            cuts = np.append(np.searchsorted(keys, bounds), len(keys)).tolist()
            spans = [slice(cuts[i], cuts[i + 1]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.int32()), pa.array([g] * n, pa.int32()),
                pa.array([keys[s].tobytes() for s in spans], pa.binary()),
                pa.array([packed(counts[s]) for s in spans], pa.binary())], ["rng", "grp", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(b, np.uint64) for b in table["keys"].to_pylist()]
        counts = [unpacked(b, len(k)) for b, k in zip(table["counts"].to_pylist(), keys)]
        sizes = np.cumsum([0] + [len(k) for k in keys]).tolist()
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        tokens = (distinct & UNIGRAM) > 0
        blocks = [packed(totals[place[a:b]]) for a, b in zip(sizes, sizes[1:])]
        return pa.table({
            "grp": table["grp"], "rng": table["rng"], "totals": pa.array(blocks, pa.binary()),
            "n_types": pa.array([int((totals[tokens] > 0).sum())] * len(keys), pa.int64()),
            "n_train": pa.array([int(totals[tokens].sum())] * len(keys), pa.int64())})

    def walk(rows: pa.Table, got: pa.Table) -> pa.Table:
        place = {r: i for i, r in enumerate(names)}
        n_types, n_train = sum(got["n_types"].to_pylist()), sum(got["n_train"].to_pylist())
        positions = [_positions(part, order) for part in text_slices(rows.to_batches())]
        keys, _ = _asked(positions, order)
        sizes = np.diff(np.append(np.searchsorted(keys, bounds), len(keys))).tolist()
        answers = sorted(zip([place[r] for r in got["rng"].to_pylist()], got["totals"].to_pylist()))
        totals = np.concatenate([unpacked(b, sizes[i]) for i, b in answers])
        out = []
        for here, _ in positions:
            out += _scores(here, keys, totals, n_train, n_types, order, prior, floor)
        cols = list(zip(*out)) if out else [(), (), (), ()]
        return pa.table({
            "doc_id": rows["doc_id"], "held_out": rows["held_out"],
            "n_tokens": pa.array(cols[0], pa.int64()), "n_known": pa.array(cols[1], pa.int64()),
            "train_tokens": pa.array([n_train] * rows.num_rows, pa.int64()),
            "base_score": pa.array(cols[2], pa.float64()), "score": pa.array(cols[3], pa.float64())})

    asked = docs.mapInArrow(ask, "rng int, grp int, keys binary, counts binary").repartition(n, "rng")
    answers = (asked.groupBy("rng")
               .applyInArrow(answer, "grp int, rng int, totals binary, n_types long, n_train long")
               .repartition(n, "grp"))
    return docs.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(walk, OUT)
