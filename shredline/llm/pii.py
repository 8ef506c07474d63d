"""PII by a semi-Markov model over candidate regions, trained by the structured perceptron.

Base spans are what four fixed patterns find. Between them a semi-Markov model
looks for more: a region is a run of neighbouring tokens that hold a digit or an
``@``; whole segments of a region (of at most ``SEGMENT`` tokens) are scored by
features of the whole span (number of digits, checksums, groups, shape, the word
before), and dynamic programming chooses the best boundaries and types of all
segments together. Tokens inside base spans are closed to it, so base spans stay.

The weights are trained by the structured perceptron on at most ``train_regions``
regions of the table, chosen by hash; gold are the base spans, and copies of
them written in other ways (a phone number without country code). Training
regions are at most 200 characters long, so the sample is bounded.

Defined results: null and empty texts have no spans; repeated rows are treated
one by one; an empty table trains nothing (the prior weights hold) and returns nothing;
columns other than ``doc_id`` and ``text`` are ignored by the scan and kept by
the masking.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SEGMENT = 6

# An address is found from its @: what may stand before it holds no @ itself.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number's match always begins where its run of digits begins.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_CALLS = frozenset(("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "fon", "tél", "móvil"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and then start."""
    out = []
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            done = m.end()
    if not _LOOK.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        number = digits_of(m.group())
        if 13 <= len(number) <= 19 and luhn(number):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def regions(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """(word before, token places) of every run of neighbouring tokens with a digit or @."""
    if not _LOOK.search(text):
        return []
    out, before, open_, last = [], "", None, -2
    for m in _TOKEN.finditer(text):
        token = m.group()
        if _LOOK.search(token):
            if open_ is None or m.start() != last + 1:
                open_ = (before, [])
                out.append(open_)
            open_[1].append(m.span())
        else:
            open_ = None
        before, last = token, m.end()
    return out


def trim(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the punctuation around it; brackets that close inside stay."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while start < end and not (text[end - 1].isalnum() or text[end - 1] == ")"):
        end -= 1
    if text[start:start + 1] == "(" and ")" not in text[start:end]:
        start += 1
    if text[end - 1:end] == ")" and "(" not in text[start:end]:
        end -= 1
    return start, end


def shape(span: str) -> str:
    """Runs of digits as d, of letters as a, the rest as it stands; at most the first 12 signs name the shape."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "d", span))[:12]


def features(span: str, before: str, tokens: int) -> list[str]:
    """Features of a whole segment."""
    digits = digits_of(span)
    n = len(digits)
    parts = span.split(".")
    out = ["bias", f"tokens={tokens}", f"shape={shape(span)}",
           "digits=" + ("0" if not n else "1-6" if n < 7 else "7-8" if n < 9 else str(n) if n < 20 else "20+")]
    if span[:1] == "+":
        out.append("plus")
    if "(" in span or "-" in span:
        out.append("groups")
    if "@" in span:
        at = span.split("@")
        out.append("address" if len(at) == 2 and at[0] and "." in at[1].strip(".") else "at")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts):
        out.append("octets")
    if 13 <= n <= 19 and luhn(digits):
        out.append("luhn")
    if any(c.isalpha() for c in span):
        out.append("letters")
    if before.lower().strip(".,:;()") in _CALLS:
        out.append("call")
    return out


#: What holds before any training.
PRIOR = {("email", "address"): 2.0, ("email", "bias"): -1.0, ("ip", "octets"): 2.0, ("ip", "bias"): -1.0,
         ("card", "luhn"): 2.0, ("card", "bias"): -1.0, ("card", "letters"): -3.0, ("phone", "plus"): 1.0,
         ("phone", "groups"): 1.0, ("phone", "bias"): -2.0, ("phone", "letters"): -3.0}


def decode(text: str, before: str, places: list[tuple[int, int]], weights, closed=()) -> list[tuple[str, int, int]]:
    """The best segmentation of a region: (kind, first token, end token) of its entities.

    A token outside all entities scores 0. ``closed`` tokens are in no entity.
    """
    n = len(places)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i in range(j - 1, max(-1, j - 1 - SEGMENT), -1):
            if i in closed:
                break
            a, b = trim(text, places[i][0], places[j - 1][1])
            if a >= b:
                continue
            left = before if i == 0 else text[places[i - 1][0]:places[i - 1][1]]
            found = features(text[a:b], left, j - i)
            for kind in KINDS:
                score = best[i] + sum(weights.get((kind, f), 0.0) for f in found)
                if score > best[j] + 1e-9:
                    best[j], back[j] = score, (i, kind)
    out, j = [], n
    while j:
        if back[j]:
            out.append((back[j][1], back[j][0], j))
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def train(samples: list[tuple[str, str]], rounds: int = 6) -> dict:
    """Averaged structured perceptron over (word before, region) samples; gold are the base spans."""
    cases = []
    for before, text in samples:
        texts = [text]
        texts += [re.sub(r"\+[0-9]{1,3}[ .-]", "", text)] if _PHONE.search(text) else []
        for k, t in enumerate(texts):
            spans = base_spans(text if k == 0 else t)
            if k:       # the copy's number is still one
                m = re.search(r"\(?[0-9][\x20().0-9-]+[0-9]", t)
                if not m or not 7 <= len(digits_of(m.group())) <= 12:
                    continue
                spans = [s for s in spans if s[2] <= m.start() or s[1] >= m.end()] + [("phone", m.start(), m.end())]
            places = [m.span() for m in _TOKEN.finditer(t)]
            gold = set()
            for kind, a, b in spans:
                own = [i for i, (x, y) in enumerate(places) if x < b and y > a]
                if own and own[-1] - own[0] < SEGMENT:
                    gold.add((kind, own[0], own[-1] + 1))
            cases.append((before, t, places, gold))
    weights, total, step = defaultdict(float, PRIOR), defaultdict(float), 1
    for _ in range(rounds):
        for before, t, places, gold in cases:
            step += 1
            found = set(decode(t, before, places, weights))
            for spans, sign in ((gold - found, 1.0), (found - gold, -1.0)):
                for kind, i, j in spans:
                    a, b = trim(t, places[i][0], places[j - 1][1])
                    left = before if i == 0 else t[places[i - 1][0]:places[i - 1][1]]
                    for f in features(t[a:b], left, j - i):
                        weights[kind, f] += sign
                        total[kind, f] += sign * step
    return {k: w - total[k] / step for k, w in weights.items() if w or total[k]}


def find_spans(text: str, weights) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans (kind, start, end), by kind and then start."""
    base = base_spans(text)
    more = []
    taken = sorted((a, b) for _, a, b in base)
    for before, places in regions(text):
        lo, hi = places[0][0], places[-1][1]
        own = [(a, b) for a, b in taken if a < hi and b > lo] if taken else []
        closed = {i for i, (x, y) in enumerate(places) if any(a < y and b > x for a, b in own)}
        if len(closed) == len(places):
            continue
        for kind, i, j in decode(text, before, places, weights, closed):
            more.append((kind, *trim(text, places[i][0], places[j - 1][1])))
    rank = KINDS.index
    return base, sorted(base + more, key=lambda s: (rank(s[0]), s[1], s[2]))


def fit(docs: DataFrame, train_regions: int = 4000) -> dict:
    """Weights from a bounded sample of the table's regions."""
    def run(batches):
        for part in batches:
            rows = [(before, text[places[0][0]:places[-1][1]]) for text in part.column(0).to_pylist()
                    for before, places in regions(text) if places[-1][1] - places[0][0] <= 200]
            yield pa.RecordBatch.from_arrays([pa.array([r[0][-40:] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.string())], names=["before", "region"])

    sample = (docs.select("text").where(F.col("text").rlike("[0-9@]")).mapInArrow(run, "before string, region string")
              .groupBy("before", "region").count()
              .orderBy(F.xxhash64("before", "region"), "before", "region").limit(train_regions).collect())
    return train([(r["before"], r["region"]) for r in sample])


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """doc_id, counts and the spans (base ones, all) of every row, in code points."""
    docs = docs.select("doc_id", "text")
    weights = fit(docs) if weights is None else weights
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = [pa.int64()] * 4 + [pa.string()] * 2
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for part in batches:
            rows = []
            for text in part.column(1).to_pylist():
                base, every = find_spans(text or "", weights)
                own = [k for k, _, _ in base]
                rows.append((*(own.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(),
                             joined(every)))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols, types)], names=names)

    return docs.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, "
                                "base_sha256 string, spans string")


def mask_text(text: str, weights) -> str:
    """A text with every span replaced by its kind, as in ``<EMAIL>``; of overlapping spans the union goes."""
    out, at = [], 0
    spans = sorted((a, b, k) for k, a, b in find_spans(text, weights)[1])
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def mask(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """The same rows and columns with personal data masked in ``text``."""
    weights = fit(docs) if weights is None else weights
    at = docs.columns.index("text")

    def run(batches):
        for part in batches:
            texts = [t if t is None else mask_text(t, weights) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
