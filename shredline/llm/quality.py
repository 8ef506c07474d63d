"""Quality rules: a linear-chain conditional random field labels every line as content or boilerplate.

Viterbi decoding marks the lines of a document; the words in content lines are
the content share, which decides whether the document stays. Two base rules
(too few words, too many repeated ones) reject beforehand.

The model has two labels, eleven features of a line and four transitions. It is
fitted on the driver by gradient ascent on the conditional likelihood, on at
most ``train_rows`` labelled documents and ``train_bytes`` bytes of each quality, chosen
by hash (long ones only where there are too few others); a document's label is
that of its lines. Only line features reach the driver. Without labels of both qualities the prior weights hold.

Defined results: null and wordless texts have no words and fail the base rules;
lines without a word are skipped; repeated rows are judged one by one; columns
other than ``doc_id`` and ``text`` are ignored by the scan and kept by the filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from shredline.llm.common import binary_column, counter_index, number, text_slices

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
_LATER = bytes(range(0x80, 0xC0))                 # bytes that continue a code point
_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
_SHOUT = bytes(c for c in range(256) if c not in b"!|~^=_")
FEATURES = 11
#: Content score of a line before any training: bias, then features as in line_features.
PRIOR = np.array([2.0, 0.5, -8.0, -3.0, 2.0, -4.0, -1.0, 0.5, 0.0, -6.0, -3.0])
STAY = 1.0


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[float]:
    n, size = len(words), max(1, len(line))
    run = sum(a == b for a, b in zip(words, words[1:]))
    return [1.0, min(n, 20) / 20, (size - len(line.translate(None, SYMBOLS))) / size,
            len(line.translate(None, _UPPER)) / size, len(set(words)) / n, len(line.translate(None, _DIGIT)) / size,
            float(repeated), float(line.rstrip(SPACE)[-1:] in (b".", b"!", b"?", b":")), min(size / n, 20) / 10,
            len(line.translate(None, _SHOUT)) / size, run / n]


def lines_of(text: bytes) -> tuple[list[list[float]], list[int], int]:
    """Features and word counts of the lines with a word, and how many of them equal an earlier line."""
    seen, found, sizes, copies = set(), [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            seen.add(line)
            copies += again
            found.append(line_features(line, words, again))
            sizes.append(len(words))
    return found, sizes, copies


def viterbi(content: list[float], stay: np.ndarray) -> list[int]:
    """The best labels (1: content) of lines with the given content scores; ``stay[a][b]``: from a to b."""
    (s00, s01), (s10, s11) = stay.tolist()
    a, b, back = 0.0, 0.0, []
    for i, x in enumerate(content):
        if i:
            from0 = (0, a + s00) if a + s00 >= b + s10 else (1, b + s10)
            from1 = (0, a + s01) if a + s01 > b + s11 else (1, b + s11)
            back.append((from0[0], from1[0]))
            a, b = from0[1], from1[1]
        b += x
    label = int(b >= a)
    out = [label]
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1] if content else []


def fit_crf(sequences: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.5, l2: float = 1e-3):
    """Weights of the content label and transitions from (features of the lines, label of all) by gradient ascent."""
    if len({y for _, y in sequences}) < 2:
        return PRIOR.copy(), np.array([[STAY, 0.0], [0.0, STAY]])
    longest = max(len(x) for x, _ in sequences)
    x = np.zeros((len(sequences), longest, FEATURES))
    there = np.zeros((len(sequences), longest), dtype=bool)
    y = np.array([y for _, y in sequences])
    for i, (f, _) in enumerate(sequences):
        x[i, :len(f)], there[i, :len(f)] = f, True
    lines = there.sum(axis=1)
    each = (1.0 / np.bincount(y, minlength=2))[y] / 2 / lines          # both qualities weigh the same
    w, t = np.zeros(FEATURES), np.zeros((2, 2))
    for _ in range(rounds):
        score = np.stack([np.zeros(x.shape[:2]), x @ w], axis=2)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0]
        for i in range(1, longest):
            nxt = np.logaddexp(alpha[:, i - 1, :1] + t[0], alpha[:, i - 1, 1:] + t[1]) + score[:, i]
            alpha[:, i] = np.where(there[:, i, None], nxt, alpha[:, i - 1])
        for i in range(longest - 2, -1, -1):
            after = score[:, i + 1] + beta[:, i + 1]
            prev = np.logaddexp(t[:, 0] + after[:, :1], t[:, 1] + after[:, 1:])
            beta[:, i] = np.where(there[:, i + 1, None], prev, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * there
        gw = np.einsum("d,dl,dlf->f", each, (y[:, None] - p1) * there, x)
        gt = np.zeros((2, 2))
        for a in range(2):
            for b in range(2):
                pair = np.exp(alpha[:, :-1, a] + t[a, b] + score[:, 1:, b] + beta[:, 1:, b] - z[:, None]) * there[:, 1:]
                gt[a, b] = (each * (((y == a) & (y == b)) * (lines - 1) - pair.sum(axis=1))).sum()
        w += rate * 10 * (gw - l2 * w)
        t += rate * (gt - l2 * t)
    return w, t


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 1500, train_bytes: int = 32 << 20, short_bytes: int = 64 << 10):
    """The model (weights, transitions) from a bounded sample of labelled documents.

    At most ``train_rows`` documents and ``train_bytes`` bytes of each quality (one document at least), chosen by
    hash of their id; those of over ``short_bytes`` only where a quality has too few others.
    """
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = docs.where("text is not null").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")).join(marks, "doc_id")
    picked = []
    for q in (0, 1):                                   # the first train_rows of each by a bounded top-n, no window
        size = 0
        for r in (known.where(F.col("quality") == q).orderBy(F.col("size") > short_bytes, F.xxhash64("doc_id"), "doc_id")
                  .limit(train_rows).collect()):
            size += r["size"]
            if size > train_bytes and size > r["size"]:
                break
            picked.append((r["doc_id"], q))
    own = docs.sparkSession.createDataFrame(picked, T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("quality", T.IntegerType())]))
    rows = (docs.select("doc_id", "text").where("text is not null").join(F.broadcast(own), "doc_id")
            .select("doc_id", "text", "quality"))                                          # at most 2 * train_rows ids

    def run(batches):
        for part in batches:
            found = [lines_of(t)[0] for t in binary_column(part, "text")]
            flat = [np.array(f, dtype=np.float32).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array(flat, pa.binary())],
                                             names=["doc_id", "quality", "lines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = (rows.mapInArrow(run, f"doc_id {kind}, quality int, lines binary")
           .orderBy(F.xxhash64("doc_id", "lines")).limit(2 * train_rows).collect())
    sequences = []
    for r in got:
        x = np.frombuffer(r["lines"], np.float32).reshape(-1, FEATURES).astype(float)
        sequences += [(x[i:i + 40], r["quality"]) for i in range(0, len(x), 40)]
    return fit_crf(sequences)


def repeated_words(texts: list[list[bytes]]) -> list[int]:
    """For each text the number of words in 3-word windows that stand twice or more in it."""
    index = counter_index()
    parts = [number(index, words) for words in texts]
    n = np.array([len(p) for p in parts], dtype=np.int64)
    total = int(n.sum())
    a = np.concatenate([*parts, np.empty(0, np.int64)])
    doc = np.repeat(np.arange(len(texts)), n)
    if total < 3:
        return [0] * len(texts)
    where = np.flatnonzero(doc[:-2] == doc[2:])
    pair = (a[:-1] << 32) | a[1:]
    pair = np.unique(pair, return_inverse=True)[1]                       # below 2^31: so is their number
    key = (pair[where] << 32) | a[where + 2]
    order = np.argsort(key, kind="stable")                               # equal windows stay in the order of the texts
    key, at = key[order], where[order]
    same = (key[1:] == key[:-1]) & (doc[at[1:]] == doc[at[:-1]])
    often = np.zeros(len(key), dtype=bool)
    often[1:] |= same
    often[:-1] |= same
    hit = np.zeros(total, dtype=bool)
    for i in range(3):
        hit[at[often] + i] = True
    return np.bincount(doc[hit], minlength=len(texts)).tolist()


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def measure(texts: list[bytes | None], model, content: float) -> list[tuple]:
    """The columns NAMES of each text."""
    weights, stay = model
    texts = [t or b"" for t in texts]
    words = [t.split() for t in texts]
    out = []
    for text, own, repeat in zip(texts, words, repeated_words(words)):
        n = len(own)
        found, sizes, copies = lines_of(text)
        labels = viterbi((np.array(found) @ weights).tolist(), stay) if found else []
        share = sum(s for s, y in zip(sizes, labels) if y) / n if n else 0.0
        failed = n < 50 or 100 * repeat > 50 * n
        out.append((n, len(text.translate(None, SPACE + _LATER)), len(text) - len(text.translate(None, SYMBOLS)),
                    copies, repeat, failed, not failed and share >= content, share))
    return out


def judge(docs: DataFrame, labels: DataFrame, model=None, content: float = 0.5) -> DataFrame:
    """All columns of ``docs`` (it holds text) and the base counts, base_failed, kept and content_share."""
    model = model or fit(docs, labels)
    docs = docs.select(*[c for c in docs.columns if c not in NAMES])
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
    schema = StructType(list(docs.schema))
    for name, kind in zip(NAMES, ["long"] * 5 + ["boolean"] * 2 + ["double"]):
        schema = schema.add(name, kind)

    def run(batches):
        for part in text_slices(batches):
            cols = list(zip(*measure(binary_column(part, "text"), model, content)))
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, cols, kinds)],
                                             names=[*part.schema.names, *NAMES])

    return docs.mapInArrow(run, schema)
