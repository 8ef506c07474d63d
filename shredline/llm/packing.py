"""Packing: order-preserving dynamic programming over window cuts.

The documents of a task, in the order of the table, form one stream of token
ids, each document closed by ``close_id``. A sequence is a window of at most
``capacity`` ids of that stream. Cuts may lie at document ends (free), at
sentence ends (``sentence_cut``) and inside a sentence (``hard_cut``): a whole
window after any of these, and where none comes for a while. The cheapest cuts minimise

    sum over sequences of  padding + per_sequence + penalty of the cut,

where padding is ``capacity - length``, and 0 if the length is a power of two.
Since padding is linear in the cut, the best earlier cut is a sliding-window
minimum, kept in a monotone queue; the powers of two are looked up directly.
The stream is solved in blocks; the windows at a block's end are taken back and
solved again with the next block, so memory doesn't grow with the task.

Tokens: the text is split before spaces that a visible character follows, where
the tokenizer's own pattern always splits too; every distinct chunk is encoded
once in a while and looked up after that. Texts with other white space after a
space are left to the tokenizer as they are.

Defined results: null and empty texts are the closing id alone; repeated rows
are packed one by one; an empty table gives no pieces; columns other than
``doc_id`` and ``text`` are ignored. Sequence ids are unique over the table
(task number * 2^36 + number in the task).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shredline.llm.common import binary_column, counter_index, number, text_slices

PIECES = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

#: A space before anything that could be white space or isn't known not to be.
_UNSURE = re.compile(rb" (?![\x21-\x7e\xc3-\xdf\xe4-\xf4])")
#: Beyond the Latin letters.
_FAR = re.compile(rb"[\xd0-\xf4]")
_FIRST = b"\xff"        # marks a chunk that no space leads; the byte never occurs in UTF-8


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _token_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones for themselves, others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def merge_ranks(path: str, size: int) -> dict[bytes, int] | None:
    """Tokens as bytes with their ids, if the file's merges stand in the order of the ids; else None.

    Byte-pair encoding by such ids takes the same merges in the same order.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges, to_byte = model["vocab"], model["merges"], _token_bytes()
    pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    if [vocab.get(m) for m in pairs] != list(range(256, 256 + len(pairs))):
        return None
    kept = {t: i for t, i in vocab.items() if i < 256 + len(pairs) and i < size}
    return {bytes(to_byte[c] for c in t): i for t, i in kept.items()}


class ChunkTokenizer:
    """Token ids of texts; keeps the ids of chunks it has met (at most ``keep`` before it starts afresh).

    ``path`` is a file of the tokenizers library with a byte-level vocabulary. Where
    its merges allow it, new chunks of ASCII and Latin letters are encoded by tiktoken
    from the same vocabulary, which is several times faster; all else by tokenizers.
    """

    def __init__(self, path: str, keep: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        vocab = self.tok.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, dtype=np.int64)     # bytes of each token
        self.sentence_end = np.zeros(len(self.size), dtype=bool)
        for token, i in vocab.items():
            self.size[i] = len(token)                                     # one character stands for a byte
            self.sentence_end[i] = token[-1:] in (".", "!", "?", "Ċ") or token[-2:] in ('."', "!\"", '?"')
        ranks = merge_ranks(path, len(self.size))
        self.fast = ranks and tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                                special_tokens={})
        self.keep = keep
        self.reset()

    def reset(self):
        self.index = counter_index()
        self.ids = np.empty(0, dtype=np.uint32)
        self.begin = np.empty(0, dtype=np.int64)
        self.length = np.empty(0, dtype=np.int64)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[bytes]) -> list[int]:
        """Ids of chunks that each follow a space."""
        raw = b"".join(b" " + c for c in chunks)
        if self.fast and not _FAR.search(raw):
            return self.fast.encode_ordinary(raw.decode())
        return self.plain([raw.decode()])[0]

    def _learn(self, chunks: list[bytes]):
        """Add the ids of new chunks, in the order of their numbers."""
        begin, length = np.zeros(len(chunks), dtype=np.int64), np.zeros(len(chunks), dtype=np.int64)
        blocks, held = [self.ids], len(self.ids)
        first = [i for i, c in enumerate(chunks) if c[:1] == _FIRST]
        rest = [i for i, c in enumerate(chunks) if c[:1] != _FIRST]
        for i, ids in zip(first, self.plain([chunks[i][1:].decode() for i in first]) if first else []):
            blocks.append(np.array(ids, dtype=np.uint32))
            begin[i], length[i] = held, len(ids)
            held += len(ids)
        for lo in range(0, len(rest), 4096):
            own = rest[lo:lo + 4096]
            ids = np.array(self._joined([chunks[i] for i in own]), dtype=np.uint32)
            ends = np.cumsum([len(chunks[i]) + 1 for i in own])
            cuts = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1     # no token crosses a chunk's end
            length[own] = np.diff(cuts, prepend=0)
            begin[own] = held + cuts - length[own]
            blocks.append(ids)
            held += len(ids)
        self.ids = np.concatenate(blocks)
        self.begin = np.concatenate([self.begin, begin])
        self.length = np.concatenate([self.length, length])

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if len(self.index) > self.keep:
            self.reset()
        sizes, chunks, whole = [], [], {}
        for i, text in enumerate(texts):
            if not text:
                sizes.append(0)
                continue
            if _UNSURE.search(text):
                whole[i] = text.decode()
                sizes.append(0)
                continue
            own = text.split(b" ")
            if own[0]:
                own[0] = _FIRST + own[0]
            else:                   # the text begins with a space and a visible character
                del own[0]
            sizes.append(len(own))
            chunks += own
        numbers = number(self.index, chunks)
        new = list(islice(self.index, len(self.begin), None))
        if new:
            self._learn(new)
        n = self.length[numbers]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.begin[numbers] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[np.cumsum([0, *sizes])]
        out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        for i, own in zip(whole, self.plain(list(whole.values())) if whole else []):
            out[i] = np.array(own, dtype=np.uint32)
        return out


def best_cuts(places: np.ndarray, penalties: np.ndarray, capacity: int, per_sequence: float) -> list[int]:
    """The cheapest cuts (places, the first and last included) with at most ``capacity`` between neighbours.

    ``places`` rise from 0 in steps of at most ``capacity``.
    """
    n = len(places)
    ends, starts, width = [], [], 1          # cuts that close a window of a power of two, and where it begins
    while width <= capacity:
        at = np.searchsorted(places, places - width)
        hit = np.flatnonzero(places[np.minimum(at, n - 1)] == places - width)
        ends.append(hit)
        starts.append(at[hit])
        width *= 2
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    exact = starts[order].tolist()
    until = np.searchsorted(ends[order], np.arange(n), side="right").tolist()
    place, penalty = places.tolist(), (penalties + per_sequence).tolist()
    cost, back, key = [0.0] * n, [0] * n, [0.0] * n
    queue, head, seen = [0], 0, 0           # candidates from head on; key (cost + place) rises from left to right
    for j in range(1, n):
        here = place[j]
        lowest = here - capacity
        while place[queue[head]] < lowest:
            head += 1
        i = queue[head]
        best = key[i] - lowest
        while seen < until[j]:
            e = exact[seen]
            seen += 1
            if cost[e] < best:
                best, i = cost[e], e
        best += penalty[j]
        cost[j], back[j] = best, i
        best += here
        key[j] = best
        while len(queue) > head and key[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    cuts, j = [place[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(place[j])
    return cuts[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, capacity: int, sentence_cut: float,
               hard_cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and at what penalty.

    Document and sentence ends; hard cuts a whole window after each of them, and in gaps of over half a capacity.
    """
    natural = np.unique(np.concatenate([[0], np.flatnonzero(sentence_end[ids]) + 1, doc_ends, [len(ids)]])).astype(np.int64)
    gaps = np.diff(natural)
    step = max(1, capacity // 2)
    hard = [np.arange(a + step, a + g, step) for a, g in zip(natural[:-1][gaps > step], gaps[gaps > step])]
    full = natural[natural < len(ids) - capacity] + capacity
    near = full - natural[np.searchsorted(natural, full, side="right") - 1]
    hard.append(full[near > hard_cut - sentence_cut])        # a natural cut as near costs no more
    places = np.unique(np.concatenate([natural, *hard]))
    penalties = np.full(len(places), hard_cut)
    penalties[np.searchsorted(places, natural)] = sentence_cut
    penalties[np.searchsorted(places, doc_ends)] = 0.0
    penalties[0] = 0.0
    penalties[-1] = 0.0
    return places, penalties


class Packer:
    """Packs a stream of documents block by block."""

    def __init__(self, sentence_end, capacity, sentence_cut, hard_cut, per_sequence, first_sequence):
        self.sentence_end, self.capacity = sentence_end, capacity
        self.sentence_cut, self.hard_cut, self.per_sequence = sentence_cut, hard_cut, per_sequence
        self.sequence = first_sequence
        self.docs: list[tuple] = []         # doc_id, tokens of the whole document, its ids not yet packed
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), ids))
        self.held += len(ids)

    def pieces(self, last: bool) -> list[tuple]:
        """The pieces of all sequences that are settled (all if ``last``)."""
        if not self.docs:
            return []
        ids = np.concatenate([d[2] for d in self.docs])
        sizes = np.array([len(d[2]) for d in self.docs], dtype=np.int64)
        ends = np.cumsum(sizes)
        cuts = best_cuts(*cut_places(ids, ends, self.sentence_end, self.capacity, self.sentence_cut, self.hard_cut),
                         self.capacity, self.per_sequence)
        if not last:                        # windows near the end may change with what follows
            settled = [c for c in cuts if c <= len(ids) - 4 * self.capacity]
            cuts = settled if len(settled) > 1 else cuts[:1]
        done = cuts[-1]
        begins = ends - sizes
        marks = np.unique(np.concatenate([cuts, begins[begins < done]]).astype(np.int64))
        raw = ids.astype("<u4")
        which = np.searchsorted(ends, marks[:-1], side="right").tolist()
        window = np.searchsorted(cuts, marks[:-1], side="right") - 1
        out = []
        for a, b, d, w in zip(marks[:-1].tolist(), marks[1:].tolist(), which, window.tolist()):
            doc_id, total, own = self.docs[d]
            start = total - len(own) + a - int(begins[d])
            out.append((doc_id, start, b - a, zlib.crc32(raw[a:b]), total, self.sequence + w, a - cuts[w]))
        self.sequence += len(cuts) - 1
        rest = []
        for d in range(len(self.docs)):
            if ends[d] > done:
                doc_id, total, own = self.docs[d]
                rest.append((doc_id, total, own[max(0, done - int(begins[d])):]))
        self.docs, self.held = rest, len(ids) - done
        return out


_LOADED: dict[str, ChunkTokenizer] = {}      # one for each Python worker


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, close_id: int = 0,
         sentence_cut: float = 1.0, hard_cut: float = 8.0, per_sequence: float = 16.0,
         block_tokens: int = 1 << 18) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tok = _LOADED.get(path) or _LOADED.setdefault(path, ChunkTokenizer(path))
        packer = Packer(tok.sentence_end, capacity, sentence_cut, hard_cut, per_sequence,
                        TaskContext.get().partitionId() << 36)
        close = np.array([close_id], dtype=np.uint32)
        id_type = None

        def batch(pieces):
            cols = list(zip(*pieces))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for part in text_slices(batches, max_bytes=1 << 20):
            id_type = part.schema.field(0).type
            for doc_id, ids in zip(part.column(0).to_pylist(), tok.encode(binary_column(part, "text"))):
                packer.add(doc_id, np.concatenate([ids, close]))
                if packer.held >= block_tokens:
                    if got := packer.pieces(False):
                        yield batch(got)
        if got := packer.pieces(True):
            yield batch(got)
        tok.reset()             # the worker lives on; its memory is for other stages

    return docs.mapInArrow(run, PIECES.format(id=kind))
